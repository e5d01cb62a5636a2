"""Benchmark decontamination by greedy string tiling.

Texts are word sequences. Running Karp-Rabin hashes of every `least` words of a document are looked up among those of the
test items; seeds that continue each other on one diagonal make matches. Of the matches of a document and an item the
longest is marked again and again, the rest cut to what is still unmarked, until none of `least` words is left. The share
of an item's words that end up marked is its coverage, so passages whose parts were reordered count in full.

Items are read in blocks of a fixed number of words; each block goes to the executors and meets all documents where they
are, so no document is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, arrow_map, text_or_empty

#: Words of test items in one block: 16 MB of hashes, and about three times that with the seeds.
BLOCK_WORDS = 2_000_000
#: Seeds of a document and an item that are held at a time (16 MB).
SEEDS_AT_ONCE = 1 << 20
_BASE = np.uint64(0x100000001B3)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * _BASE + words[i : i + n]
    return h ^ (h >> np.uint64(29))


def maximal(i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Columns (document position, item position, length) of maximal matches from the positions of seeds of k words."""
    return _joined(np.stack([i, j, np.ones_like(i)])) + np.array([[0], [0], [k - 1]])


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs of seeds (i, j, seeds) that continue each other on a diagonal, as one."""
    i, j, n = runs[:, np.lexsort((runs[0], runs[0] - runs[1]))]
    if not len(i):
        return np.zeros((3, 0), np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (i[1:] != i[:-1] + n[:-1])]))
    return np.stack([i[first], j[first], np.add.reduceat(n, first)])


def tile(seeds: list[tuple[int, int]], k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length) from the seeds (i, j) of one document and one item."""
    i, j = np.array(seeds, np.int64).reshape(-1, 2).T
    return greedy(maximal(i, j, k), k, n_item)


def greedy(runs: np.ndarray, k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Marks the longest match (ties: first in the document, then in the item) again and again.

    A match that is marked in part is cut to what is free and waits for its turn; once the item has no k free words in a
    row, no match under its tiles is looked at any more.
    """
    runs = runs[:, np.lexsort((runs[1], runs[0], -runs[2]))]
    in_doc, in_item = np.zeros(int((runs[0] + runs[2]).max(initial=0)), bool), np.zeros(n_item, bool)
    pieces: list[tuple[int, int, int]] = []
    tiles, at = [], 0
    while at < runs.shape[1] or pieces:
        whole = (-int(runs[2, at]), int(runs[0, at]), int(runs[1, at])) if at < runs.shape[1] else None
        if whole and (not pieces or whole <= pieces[0]):
            length, i, j = whole
            at += 1
        else:
            length, i, j = heapq.heappop(pieces)
        length = -length
        taken = in_doc[i : i + length] | in_item[j : j + length]
        if not taken.any():
            tiles.append((i, j, length))
            in_doc[i : i + length] = in_item[j : j + length] = True
            if not any(b - a >= k for a, b in _free(in_item)):
                break
            continue
        for a, b in _free(taken):
            if b - a >= k:
                heapq.heappush(pieces, (a - b, i + a, j + a))
    return tiles


def _free(taken: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of False."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


class Items:
    """A block of test items with its seeds, sorted by hash."""

    def __init__(self, ids: list[int], words: list[np.ndarray], least: int):
        self.ids, self.words, self.sizes, self.least = ids, words, [len(w) for w in words], least
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(least, n) for n in self.sizes if n}):
            hashes, owner, at = [], [], []
            for x, w in enumerate(words):
                if len(w) and min(least, len(w)) == k:
                    h = rolling(w, k)
                    hashes.append(h)
                    owner.append(np.full(len(h), x))
                    at.append(np.arange(len(h)))
            h, o, p = (np.concatenate(v) for v in (hashes, owner, at))
            order = np.argsort(h, kind="stable")
            screen = np.zeros(1 << 16, bool)
            screen[(h >> np.uint64(48)).astype(np.int64)] = True
            self.seeds[k] = h[order], o[order], p[order], screen

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item, coverage, tiles) for each item that shares a seed with the words of a document."""
        found = []
        for k, (hashes, owner, at, screen) in self.seeds.items():
            h = rolling(words, k)
            maybe = np.flatnonzero(screen[(h >> np.uint64(48)).astype(np.int64)])
            if not len(maybe):
                continue
            # each distinct hash of the document: its places there, and the places in items that have it
            places = maybe[np.argsort(h[maybe], kind="stable")]
            distinct, first, count = np.unique(h[places], return_index=True, return_counts=True)
            lo, hi = (np.searchsorted(hashes, distinct, side) for side in ("left", "right"))
            of = np.repeat(np.arange(len(distinct)), hi - lo)
            if not len(of):
                continue
            place = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[of]
            order = np.argsort(owner[place], kind="stable")
            of, place = of[order], place[order]
            items, begin = np.unique(owner[place], return_index=True)
            for x, a, b in zip(items.tolist(), begin, [*begin[1:], len(of)], strict=True):
                runs = self._runs(words, x, k, places, first[of[a:b]], count[of[a:b]], at[place[a:b]])
                if runs.shape[1]:
                    found.append((x, k, runs))
        for x, k, runs in sorted(found, key=lambda f: f[0]):
            tiles = greedy(runs, k, self.sizes[x])
            yield x, sum(t[2] for t in tiles) / self.sizes[x], tiles

    def _runs(self, words: np.ndarray, x: int, k: int, places: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Maximal matches of one item from its seeds: `count` places of the document from `first` on for each place `at`.

        Seeds are made, and their words compared, so many at a time; what stays of them are runs on diagonals.
        """
        item, runs = self.words[x], np.zeros((3, 0), np.int64)
        start, ends = 0, np.cumsum(count)
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SEEDS_AT_ONCE, "right")))
            n = count[start:stop]
            i = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)]
            j = np.repeat(at[start:stop], n)
            same = np.ones(len(i), bool)
            for w in range(k):
                same &= words[i + w] == item[j + w]
            runs = _joined(np.concatenate([runs, np.stack([i[same], j[same], np.ones(int(same.sum()), np.int64)])], axis=1))
            start = stop
        return runs + np.array([[0], [0], [k - 1]])


def item_blocks(benchmark: DataFrame, least: int, item_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items in blocks of about BLOCK_WORDS words, one at a time on the driver."""
    rows = benchmark.select(F.col(item_col).alias("item"), word_hashes(text_or_empty(text_col)).alias("words")).where("item is not null")
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).orderBy("item", "words").toArrow()
        yield Items(own.column(0).to_pylist(), [np.array(w, np.int64).view(np.uint64) for w in own.column(1).to_pylist()], least)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = 5, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item whose coverage reaches the threshold: id, item_id, coverage, longest, n_tiles, tiles.

    Items of fewer than `least` words match when all their words occur in a row; items without words never match. Null
    texts count as empty; null item ids are left out, repeated ones keep a row each. Only the named columns are read.
    """
    spark = docs.sparkSession
    kind, schema = docs.schema[id_col].dataType.simpleString(), "item_id bigint, coverage double, longest int, n_tiles int, tiles array<struct<doc_word:int,item_word:int,length:int>>"
    rows = docs.select(F.col(id_col), word_hashes(text_or_empty(text_col)).alias("words"))
    tile_type = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))
    out = spark.createDataFrame([], f"{id_col} {kind}, {schema}")
    for block in item_blocks(benchmark, least):
        sent = spark.sparkContext.broadcast(block)

        def one(b: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            items = sent.value
            at, found = [], []
            for r, words in enumerate(_documents(b.column(1))):
                for x, coverage, tiles in items.matches(words):
                    if coverage >= threshold - 1e-9:
                        at.append(r)
                        found.append((items.ids[x], coverage, max(t[2] for t in tiles), len(tiles), [{"doc_word": i, "item_word": j, "length": n} for i, j, n in tiles]))
            types = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), tile_type)
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], [id_col, "item_id", "coverage", "longest", "n_tiles", "tiles"])

        out = out.union(arrow_map(rows, one, f"{id_col} {kind}, {schema}"))
    return out


def _documents(lists: pa.Array) -> Iterator[np.ndarray]:
    values, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    for a, b in zip(at[:-1] - at[0], at[1:] - at[0], strict=True):
        yield values[a:b]


def _covers_none(sent: Broadcast, threshold: float):
    """An Arrow function of word arrays: whether a document covers no item of the block."""

    @F.arrow_udf("boolean")
    def clean(words: pa.Array) -> pa.Array:
        return pa.array([not any(c >= threshold - 1e-9 for _, c, _ in sent.value.matches(w)) for w in _documents(words)], pa.bool_())

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: int = 5, threshold: float = 0.6, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without those that cover an item; decided where the row is, unshuffled.

    Only the word hashes go to Python, in batches bounded by ARROW_BYTES; the rows stay with Spark.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    words = word_hashes(text_or_empty(text_col))
    for block in item_blocks(benchmark, least):
        docs = docs.where(_covers_none(docs.sparkSession.sparkContext.broadcast(block), threshold)(words))
    return docs
