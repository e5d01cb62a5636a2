"""Sharding by a minimax contiguous partition, with DataFrame operations only.

Groups of equal texts are atomic. They are ordered by the MD5 of their text, and the ordered line is cut into
contiguous shards whose largest byte size is as small as any cut can make it: a binary search over the capacity, with
a greedy fill as the check, then a cut where that fill cuts.

The line itself never leaves the executors. The driver sees byte sums of cells of the line (a cell is a prefix of the
hash, 4,096 of them at first). Bounds on the best capacity show the few cells in which a cut can lie; only those are
split further, 256-fold, until each holds one group. So the driver holds a few hundred thousand numbers at most, for
any number of groups.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

FIRST_HEX, MORE_HEX = 3, 2
#: Rows are numbered in this many parts of each shard; the table of part sizes has n_shards times as many rows.
SLOT_PARTS = 4096


@dataclass(frozen=True)
class Cell:
    prefix: str
    size: int
    groups: int
    largest: int  # of its groups


class Line:
    """Cells in order, with the byte position at which each begins."""

    def __init__(self, cells: list[Cell]):
        self.cells = sorted(cells, key=lambda c: c.prefix)
        self.at = [0, *accumulate(c.size for c in self.cells)]
        self.total = self.at[-1]

    def cell_at(self, pos: int) -> int:
        """Index of the cell that holds the byte position; beyond the last one at the end."""
        return bisect_right(self.at, pos) - 1 if pos < self.total else len(self.cells)

    def ends(self, capacity: int, shards: int, kind: str) -> list[int]:
        """Byte positions at which a greedy fill ends each shard.

        whole: cells are never cut. fluid: a cell of several groups can be cut at any byte (no real fill gets further).
        timid: such a cut falls short by that cell's largest group (every real fill gets at least as far).
        """
        pos, out = 0, []
        for _ in range(shards):
            reach = pos + capacity
            if reach >= self.total:
                pos = self.total
            else:
                k = self.cell_at(reach)
                c, start = self.cells[k], self.at[k]
                if c.groups == 1 or kind == "whole":
                    pos = max(pos, start)
                elif kind == "fluid":
                    pos = reach
                else:
                    pos = max(pos, start, reach - c.largest)
            out.append(pos)
        return out

    def smallest(self, shards: int, kind: str) -> int:
        """Smallest capacity whose fill of that kind gets to the end."""
        low = max([-(-self.total // shards), *((c.size if kind == "whole" else c.largest) for c in self.cells)])
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.ends(mid, shards, kind)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, shards: int) -> list[Cell]:
        """Cells of several groups in which a cut can lie for some capacity between the two bounds."""
        low, high = self.smallest(shards, "fluid"), self.smallest(shards, "whole")
        found = {}
        for a, b in zip(self.ends(low, shards, "timid"), self.ends(high, shards, "fluid"), strict=True):
            for k in range(self.cell_at(a), min(self.cell_at(b) + 1, len(self.cells))):
                if self.cells[k].groups > 1:
                    found[k] = self.cells[k]
        return list(found.values())


def _cells(groups: DataFrame, parents: list[Cell] | None) -> list[Cell]:
    key = F.col("text_key")
    if parents is None:
        prefix = F.substring(key, 1, FIRST_HEX)
    else:
        prefix = F.lit(None).cast("string")
        for n in sorted({len(p.prefix) for p in parents}):
            chosen = F.substring(key, 1, n).isin([p.prefix for p in parents if len(p.prefix) == n])
            prefix = F.when(chosen, F.substring(key, 1, n + MORE_HEX)).otherwise(prefix)
    rows = (
        groups.select(prefix.alias("prefix"), "bytes").where("prefix is not null").groupBy("prefix")
        .agg(F.sum("bytes").alias("size"), F.count("*").alias("groups"), F.max("bytes").alias("largest")).collect()
    )
    return [Cell(r.prefix, r.size, r.groups, r.largest) for r in rows]


def minimax_cuts(groups: DataFrame, n_shards: int) -> list[str]:
    """Hash prefixes at which the 2nd, 3rd ... shard begins; groups has text_key (hex, unique) and bytes."""
    line = Line(_cells(groups, None))
    while parents := line.unclear(n_shards):
        gone = {p.prefix for p in parents}
        line = Line([c for c in line.cells if c.prefix not in gone] + _cells(groups, parents))
    if not line.cells:
        return []
    ends = line.ends(line.smallest(n_shards, "whole"), n_shards, "whole")
    return [line.cells[k].prefix for e in ends if (k := line.cell_at(e)) < len(line.cells)]


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot.

    size is the UTF-8 length of the text plus 1; a null text counts as the empty one. Equal texts share a shard. A
    group of at least an n-th of all bytes gets a shard to itself (largest first) and the others share the rest, since
    no cut could lower the largest shard below it. slot numbers a shard's rows from 0 without gaps. Null and repeated
    ids, empty tables and other columns are fine: only the two named columns are read.
    """
    text = text_or_empty(text_col)
    base = materialize(
        docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_key")),
        "shard-rows",
    )
    groups = materialize(base.groupBy("text_key").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    left = n_shards
    for g in groups.orderBy(F.desc("bytes"), "text_key").limit(n_shards).collect():
        if left < 2 or g.bytes * left < total:
            break
        alone.append(g.text_key)
        total, left = total - g.bytes, left - 1
    cuts = minimax_cuts(groups.where(~F.col("text_key").isin(alone)) if alone else groups, left)

    shard: Column = F.lit(len(alone))
    for c in cuts:
        shard = shard + (F.col("text_key") >= c).cast("int")
    for k, key in enumerate(alone):
        shard = F.when(F.col("text_key") == key, k).otherwise(shard)
    part = F.pmod(F.xxhash64(id_col, "text_key"), F.lit(SLOT_PARTS)).cast("int")
    rows = base.withColumns({"shard": shard.cast("int"), "part": part})
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # n_shards * SLOT_PARTS rows at most, so this side can always be broadcast
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy(id_col, "text_key")
    return (
        rows.withColumn("n", F.row_number().over(own)).join(F.broadcast(starts), ["shard", "part"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"))
    )
