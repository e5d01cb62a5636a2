"""Near-duplicate documents by HyperMinHash.

One hash of each word shingle picks a register and, by its other bits, a value: a leading-zero count and a few mantissa
bits of the smallest hash that fell there. Registers that stay empty borrow from filled ones by a rule that depends on
the register alone. Bands of the compressed registers are bucketed; pairs from the buckets pass a Jaccard estimate that
is corrected for chance collisions of registers, and then a check on the full shingle sets.

No bucket emits its pairs. Documents with the same shingle set stand as one. In each bucket every member is paired
with the bucket's pivot (the first by a hash, so that most buckets of a group agree on it), at linear cost: in a first
round over a few bands, which joins most of each group, and in a second round over all bands, where only members of
other components than the pivot's are paired. Then, for buckets of three and more that still hold members of several
components, registers of members outside the bucket's largest component are compared with all of the bucket, in blocks.
What leaves a block are the members with a partner that passes the estimate, a row each. Buckets that share such members
are put together where that makes fewer pairs, so that a member of many like buckets stands once. Full sets are dealt to
blocks and compared there, and what leaves such a block is a spanning forest of the links found: no link between
components is lost. A block moves as one row, so that joins make a row a member and bucket, whatever a group's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, ascii_lower, materialize, text_or_empty, without_ids, words_of

#: Registers; bands of ROWS registers. A pair at Jaccard 0.8 shares no band with a chance of 2e-9.
BITS, ROWS = 8, 5
M = 1 << BITS
BANDS = M // ROWS
#: Stored register value: leading zeros * 2^MANTISSA + mantissa.
MANTISSA, MOST_ZEROS = 10, 62 - BITS
#: Standard errors below the threshold at which the estimate still lets a pair through to the exact check.
SLACK = 6.0
#: Bands of the first round of pairs with pivots.
FIRST_BANDS = 4
BLOCK = 2000
#: Documents and shingles (4 MB) of a bucket's blocks of full sets.
SET_BLOCK, SHINGLE_BLOCK = 1000, 1 << 19
#: Pairs of registers compared in one step of a block (8 MB), and shingles in one step of a block of sets.
PAIRS_AT_ONCE, COLUMNS_AT_ONCE = 1 << 14, 1 << 11
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: Column) -> Column:
    """Array of 64-bit hashes of the words, A-Z lower-cased, in order."""
    return F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w))


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C1
    return h ^ (h >> np.uint64(31))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists as uint64, and where each begins and the last ends."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), at - at[0]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes in order, from its word hashes; fewer words make one shingle, none an empty set."""
    h, at = _lists(column)
    n = max(len(h) - words + 1, 0)
    grams = _scramble(h[:n])
    for k in range(1, words):
        grams = _scramble(grams * _C1 + h[k : n + k])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        else:
            whole = _scramble(h[a : a + 1])
            for k in range(a + 1, b):
                whole = _scramble(whole * _C1 + h[k : k + 1])
            yield whole if b - a == 0 else _scramble(whole ^ np.uint64(b - a))


@lru_cache(1)
def _donors() -> np.ndarray:
    """For each register, the other registers in the order in which it borrows from them if empty."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(M) for _ in range(M)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 registers of a set of distinct uint64 hashes in order, none of them empty."""
    # the first bits pick the register, so the smallest hash of each is the first of its run
    first = np.searchsorted(shingles, np.arange(M, dtype=np.uint64) << np.uint64(64 - BITS))
    filled = np.diff(np.append(first, len(shingles))) > 0
    least = np.zeros(M, np.uint64)
    least[filled] = shingles[first[filled]] << np.uint64(BITS)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _donors()[empty]
        donor = order[np.arange(len(empty)), filled[order].argmax(1)]
        least[empty] = least[donor]
    # leading zeros by the exponent of a float; mantissa from the bits after the leading one
    value = np.maximum(least, np.uint64(1))
    exact = np.frexp((value >> np.uint64(11)).astype(np.float64))[1] + 11
    zeros = np.minimum(64 - exact, MOST_ZEROS)
    after = (value << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | after.astype(np.uint16)


def band_keys(r: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, from a matrix of registers (a row for each document)."""
    parts = r[:, : BANDS * ROWS].reshape(len(r), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _scramble(key * _C1 + parts[:, :, k] + np.uint64(1))
    return key.view(np.int64)


@lru_cache(4096)
def chance_collision(log_a: int, log_b: int) -> float:
    """Chance that a register of two unrelated sets of about 2^(log/2) shingles has equal values."""
    edges = np.array([2.0 ** -(z + 1) * (1 + k / 2**MANTISSA) for z in range(40) for k in range(2**MANTISSA)] + [0.0])
    low = np.concatenate([edges[:-1], [0.0]])
    width = np.concatenate([np.repeat([2.0 ** -(z + 1 + MANTISSA) for z in range(40)], 2**MANTISSA), [2.0**-40]])
    low[-1] = 0.0

    def mass(n: float) -> np.ndarray:
        load = max(n / M, 1.0)  # an empty register borrows from one that holds a value
        return (1 - low) ** load - np.maximum(1 - low - width, 0) ** load

    return float((mass(2 ** (log_a / 2)) * mass(2 ** (log_b / 2))).sum())


def estimate(matches: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates from the share of equal registers."""
    log_a, log_b = (np.rint(2 * np.log2(np.maximum(n, 1))).astype(int) for n in (n_a, n_b))
    pairs, back = np.unique(np.stack([log_a, log_b]), axis=1, return_inverse=True)
    chance = np.array([chance_collision(int(a), int(b)) for a, b in pairs.T])[back.ravel()]
    return (matches / M - chance) / (1 - chance)


def least_matches(n: np.ndarray, threshold: float) -> np.ndarray:
    """Equal registers below which no pair passes whose smaller set has n shingles.

    Correcting for chance only lowers an estimate. A set fills a share f of the registers, and those that borrow repeat a
    sample, so that M registers tell as much as M f / (1 + f (1 - f)) samples of the union.
    """
    f = -np.expm1(np.asarray(n, float) * np.log1p(-1 / M))
    error = np.sqrt(threshold * (1 - threshold) * (1 + f * (1 - f)) / np.maximum(M * f, 1e-9))
    return M * (threshold - SLACK * error)


def passes(matches: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs worth an exact check."""
    small = np.minimum(n_a, n_b)
    fits = 100 * small >= round(100 * threshold) * np.maximum(n_a, n_b)
    return fits & (M * estimate(matches, n_a, n_b) >= least_matches(small, threshold) - 1e-6)


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_key (digest of the set; null if empty) and registers of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, regs = [], [], []
        for s in shingle_sets(b.column(1), words):
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["id", "n_shingles", "set_key", "registers"])

    rows = docs.select(F.col(id_col).alias("id"), word_hashes(text_or_empty(text_col)).alias("w"))
    return arrow_map(rows, one, f"id {kind}, n_shingles bigint, set_key binary, registers binary")


def _sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, s) with the full shingle sets of the texts (node, text) of the ids (node). One shuffle of texts, at any size."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = list(shingle_sets(b.column(1), words))
        at = np.concatenate([[0], np.cumsum([len(s) for s in found])])
        s = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
        return pa.RecordBatch.from_arrays([b.column(0), s], ["node", "s"])

    asked = texts.join(ids.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node", "text"])
    return arrow_map(asked.select("node", word_hashes(F.col("text")).alias("w")), one, "node bigint, s array<bigint>")


def _bands(sketches: DataFrame) -> DataFrame:
    """(node, band, key): a row for each band of each distinct set."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        r = np.stack([np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()])
        keys = band_keys(r)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(r))), pa.array(keys.ravel())], ["node", "band", "key"])

    return arrow_map(sketches.select("node", "registers"), one, "node bigint, band int, key bigint", batch_bytes=4 << 20)


def _star(bands: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's pivot, where they are in different components."""
    member = bands.select("key", "node", F.col("node").alias("comp")) if labels is None else bands.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    pivot = member.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "comp")).alias("p"))
    return member.join(pivot, "key").where("comp <> p.comp").select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose registers pass the estimate."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        t = b.to_pydict()
        ra, rb = (np.stack([np.frombuffer(x, np.uint16) for x in t[k]]) for k in ("r_a", "r_b"))
        ok = passes((ra == rb).sum(1), np.array(t["n_a"]), np.array(t["n_b"]), threshold)
        return b.select(["a", "b"]).filter(pa.array(ok))

    return arrow_map(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b"), one, "a bigint, b bigint", batch_bytes=4 << 20)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold; sets has node and s."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), (F.size("sa") + F.size("sb")).cast("long").alias("sizes"))
    return counted.where(100 * F.col("shared") >= round(100 * threshold) * (F.col("sizes") - F.col("shared"))).select("a", "b").distinct()


def components(edges: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(node, comp) for the nodes of undirected edges (a, b); comp is the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of that label, so long chains halve.
    """
    work = work or Scratch(edges.sparkSession)
    both = work.table(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    labels = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = step.select(F.col("node").alias("j"), F.col("comp").alias("jc"))
        new = work.table(step.join(jump, step.comp == jump.j, "left").select("node", F.least("comp", F.coalesce("jc", "comp")).alias("comp"), "old"), "labels")
        labels = new.select("node", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels


def _packed(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row of each block and `other` block it meets: by (own and others among them), other, members (a list of structs of the columns)."""
    blocks = rows.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("members"))
    return blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))


def _unpacked(blocks: pa.Table) -> pa.Table:
    """A row of each member of the blocks, with the blocks' other columns."""
    members = blocks["members"].combine_chunks()
    of = np.repeat(np.arange(len(blocks)), members.value_lengths().to_numpy(zero_copy_only=False))
    t, flat = blocks.drop_columns("members").take(of), members.flatten()
    for k in range(flat.type.num_fields):
        t = t.append_column(flat.type.field(k).name, flat.field(k))
    return t


def _across(bands: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float, work: Scratch) -> DataFrame:
    """(key, node, comp, n_shingles): members of buckets of three and more with a partner in another component that passes the estimate.

    Each pair counts in its first common bucket only, and a member is told once a bucket.
    """
    member = bands.join(labels, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = member.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("n > 2 and lo < hi").select("key", "n")
    member = work.table(member.join(mixed, "key"), "mixed")
    counts = member.groupBy("key", "comp").count()
    largest = counts.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("top")).select("key", F.col("top.comp").alias("top"), F.col("top.count").alias("n_top"))
    rows = member.join(largest, "key").select(
        "key", "band", "node", "comp", (F.col("comp") != F.col("top")).alias("minor"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("n_top")) / BLOCK).cast("int").alias("minor_blocks"),
    ).join(nodes.select("node", "n_shingles", "registers"), "node")
    side = lambda is_left, own, others: F.struct(F.lit(is_left).alias("is_left"), F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias("own"), F.col(others).alias("others"))
    left, right = side(True, "minor_blocks", "all_blocks"), side(False, "all_blocks", "minor_blocks")
    sides = rows.select("*", F.explode(F.when(F.col("minor"), F.array(left, right)).otherwise(F.array(right))).alias("at")).select("*", "at.*")
    blocks = _packed(sides, ["key", "band", "is_left", "own", "others"], ["node", "comp", "n_shingles", "registers", "minor"])
    dealt = blocks.select("key", "band", "is_left", "members", F.when(F.col("is_left"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("is_left"), F.col("other")).otherwise(F.col("own")).alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        t = _unpacked(t)
        is_left = t["is_left"].to_numpy()
        x, y = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        r = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint16).reshape(-1, M)
        key, node, comp, n, band, minor = (t[k].to_numpy() for k in ("key", "node", "comp", "n_shingles", "band", "minor"))
        cut = least_matches(n, threshold)
        told = np.zeros(len(r), bool)
        step = max(1, PAIRS_AT_ONCE // max(len(y), 1))
        for k in range(0, len(x), step):
            p, q = (v.ravel() for v in np.meshgrid(x[k : k + step], y, indexing="ij"))
            # two members outside the largest component meet twice in the bucket; they count once
            ok = (comp[p] != comp[q]) & (~minor[q] | (node[p] < node[q]))
            p, q = p[ok], q[ok]
            same = r[p] == r[q]
            matches = same.sum(1)
            ok = np.flatnonzero(matches >= np.minimum(cut[p], cut[q]) - 1e-6)
            ok = ok[passes(matches[ok], n[p[ok]], n[q[ok]], threshold)] if len(ok) else ok
            # a pair is told by its first bucket only
            ok = ok[same[ok, : BANDS * ROWS].reshape(len(ok), BANDS, ROWS).all(2).argmax(1) == band[p[ok]]]
            told[p[ok]] = told[q[ok]] = True
        return pa.table({"key": key[told], "node": node[told], "comp": comp[told], "n_shingles": n[told]})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "key bigint, node bigint, comp bigint, n_shingles bigint").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the left sets has in common with each of the right ones."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, held = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    shared = held[at] > 1
    owner, column = owner[shared], (np.cumsum(held > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, (start, start + COLUMNS_AT_ONCE))
        x = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _gathered(flagged: DataFrame, work: Scratch) -> DataFrame:
    """(key, node, comp, n_shingles): flagged members, those of buckets that share members under one key where that makes fewer pairs.

    Buckets of like texts have almost the same members, up to once a band. Where buckets chain more than they overlap,
    their own keys stay. Members of a bucket stay together either way, so no pair is lost.
    """
    first = flagged.groupBy("key").agg(F.min("node").alias("a"), F.count("*").cast("double").alias("n"))
    chained = components(flagged.join(first, "key").select("a", F.col("node").alias("b")), work).select("node", F.col("comp").alias("chain"))
    by_bucket = first.join(chained, first.a == chained.node).groupBy("chain").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    at_once = chained.groupBy("chain").agg(F.count("*").cast("double").alias("n")).join(by_bucket, "chain").where("n * n <= pairs").select("chain", F.lit(True).alias("whole"))
    groups = chained.join(at_once, "chain", "left")
    return flagged.join(groups, "node", "left").withColumn("key", F.when(F.col("whole"), F.xxhash64(F.lit("chain"), "chain")).otherwise(F.col("key"))).select("key", "node", "comp", "n_shingles").distinct()


def _forest(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components that join all members of a bucket that full sets link, a tree a block.

    rows has key, node, comp and n_shingles, as _gathered makes them.
    """
    load = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n_shingles") / SHINGLE_BLOCK)).cast("int").alias("others"))
    own = F.pmod(F.xxhash64("node"), F.col("others")).cast("int")
    blocks = _packed(rows.join(load, "key").withColumn("own", own).join(sets, "node"), ["key", "own", "others"], ["node", "comp", "s"])
    dealt = blocks.select("key", "own", "members", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        t = _unpacked(t)
        own, i, j, node, label = (t[k].to_numpy() for k in ("own", "i", "j", "node", "comp"))
        label = label.copy()
        values, at = _lists(t["s"].combine_chunks())
        sets = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        size = np.array([len(s) for s in sets], np.int64)
        shared = intersections([sets[k] for k in x], [sets[k] for k in y])
        linked = 100 * shared >= round(100 * threshold) * (size[x][:, None] + size[y][None, :] - shared)
        a, b = [], []
        for row, p in zip(linked, x, strict=True):
            new = y[row]
            while len(new := new[label[new] != label[p]]):
                a.append(node[p])
                b.append(node[new[0]])
                label[label == label[new[0]]] = label[p]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Words are runs other than [\\x20\\x09-\\x0D], A-Z lower-cased. A text of fewer words than a shingle is one shingle;
    one without words (or null) has none, is linked with nothing and is its own component. Rows with
    100 * |A and B| >= 100 * threshold * |A or B| are linked; component_id is the smallest id reachable. Rows that repeat
    an id count as one document with several texts: what any of them is linked with, the id is. A null id can't be
    compared: such a row has a null component, is linked with nothing and stays. Other columns are not read. Ids must be
    integers; others raise a TypeError.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"near-duplicate groups need integer ids, not {docs.schema[id_col].dataType.simpleString()}")
    work = Scratch(docs.sparkSession)
    rows = materialize(sketch(docs, words, id_col, text_col).withColumn("doc", F.col("id").cast("bigint")), "near-rows")
    named = rows.where("doc is not null and set_key is not null")
    best = materialize(named.groupBy("set_key").agg(F.min("doc").alias("node")), "near-sets-of-one")
    nodes = work.table(named.select(F.col("doc").alias("node"), "set_key", "n_shingles", "registers").join(best, ["set_key", "node"], "left_semi").dropDuplicates(["set_key", "node"]), "nodes")
    bands = work.table(_bands(nodes), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bands = work.table(bands.join(shared, "key", "left_semi"), "shared-bands", instead_of=bands)
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), text_or_empty(text_col).alias("text"))
    sets = work.table(_sets(texts, bands.select("node").distinct(), words), "sets")

    # rows that repeat an id with other texts tie their texts together
    texts_of = rows.where("doc is not null").groupBy("doc").agg(F.min(F.xxhash64("set_key")).alias("lo"), F.max(F.xxhash64("set_key")).alias("hi")).where("lo < hi").select("doc")
    ties = named.join(texts_of, "doc", "left_semi").join(best, "set_key").select(F.col("doc").alias("a"), F.col("node").alias("b")).distinct()
    links = work.table(ties, "links")

    def linked(pairs: DataFrame) -> DataFrame:
        return links.union(work.table(_verified(work.table(pairs, "pairs"), sets, threshold), "links"))

    links = linked(_estimated(_star(bands.where(F.col("band") < FIRST_BANDS), None), nodes, threshold))
    links = linked(_estimated(_star(bands, components(links, work)), nodes, threshold))
    labels = components(links, work)
    flagged = work.table(_across(bands, labels, nodes, threshold, work), "flagged")
    links = links.union(work.table(_forest(work.table(_gathered(flagged, work), "gathered"), sets, threshold), "links"))
    labels = materialize(components(links, work), "near-labels")
    work.remove()

    by_set = best.join(labels, "node", "left").select("set_key", F.coalesce("comp", "node").alias("by_set"))
    by_id = labels.join(texts_of, labels.node == texts_of.doc, "left_semi").select(F.col("node").alias("doc"), F.col("comp").alias("by_id"))
    out = rows.select("id", "doc", "n_shingles", "set_key").join(by_set, "set_key", "left").join(by_id, "doc", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("by_id", "by_set", "doc"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def drop_near(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, with one document (the smallest id) of each group of near-duplicates.

    Rows that repeat an id count as one document: all stay or none. Rows of a null id or without words stay, and ids must
    be integers.
    """
    groups = near_groups(docs, words, threshold, id_col, text_col)
    gone = groups.where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return without_ids(docs, materialize(gone, "near-gone"), id_col)
