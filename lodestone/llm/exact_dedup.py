"""Exact duplicates over immutable snapshots that arrive one after another.

A snapshot's rows are stored once, laid out by hash buckets, with static binary-fuse filters over their digests, one for
each bucket. What arrives later is screened by the filters of the snapshots before it: 64 bits of each digest meet the
filters of their bucket, and only positives go on to an exact join with the stored rows of that bucket, texts included.
Duplicates inside a new batch are found by grouping that batch alone. What is found twice is then compared byte for byte.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialize, text_or_empty, without_ids

#: Digests that one filter holds on average.
BUCKET_KEYS = 1 << 16
SALTS = 16
#: Filter buckets of a stored snapshot that share a folder of rows.
FOLDER_BUCKETS = 64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's three cells, in three segments that follow one another, and its 16-bit fingerprint."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
    mask = np.uint64(segment - 1)
    at = [first + k * segment + ((h >> np.uint64(s)) & mask).astype(np.int64) for k, s in enumerate((0, 11, 22))]
    return np.stack(at), (_mix(h, 1) & np.uint64(0xFFFF)).astype(np.uint16)


def build_fuse_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, cells) of a static filter that holds the distinct uint64 keys."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    segments = max(1, -(-int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) + 8) // segment))
    for seed in range(1, 200):
        at, print_ = _slots(keys, seed, segment, segments)
        cells = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=cells)
        xored = np.zeros(cells, np.int64)
        for row in at:
            np.bitwise_xor.at(xored, row, np.arange(n))
        order, left = [], n
        while left:
            cell = np.flatnonzero(count == 1)
            if not len(cell):
                break
            key, pick = np.unique(xored[cell], return_index=True)
            order.append((key, cell[pick]))
            for row in at:
                np.subtract.at(count, row[key], 1)
                np.bitwise_xor.at(xored, row[key], key)
            left -= len(key)
        if not left:
            out = np.zeros(cells, np.uint16)
            for key, cell in reversed(order):
                a = at[:, key]
                out[cell] = print_[key] ^ out[a[0]] ^ out[a[1]] ^ out[a[2]]
            return seed, segment, segments, out.tobytes()
        if seed % 20 == 19:
            segments += segments // 4 + 1
    raise RuntimeError("no seed peels these keys")


def fuse_contains(filter_: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, segment, segments, cells = filter_
    at, print_ = _slots(keys, seed, segment, segments)
    b = np.frombuffer(cells, np.uint16)
    return (b[at[0]] ^ b[at[1]] ^ b[at[2]]) == print_


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, segments, cells = build_fuse_filter(pdf["key64"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"snapshot": [pdf["snapshot"].iloc[0]], "bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "cells": [cells]})


def _probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The keys of rows (key64, snapshot) that a filter of an earlier snapshot may hold, with that snapshot as at."""
    keys, at = rows["key64"].to_numpy(np.int64).view(np.uint64), rows["snapshot"].to_numpy()
    found = [rows.iloc[:0][["key64"]].assign(at=np.int32(0))]
    for f in filters.itertuples():
        later = np.flatnonzero(at > f.snapshot)
        if len(later):
            hit = later[fuse_contains((f.seed, f.segment, f.segments, f.cells), keys[later])]
            found.append(rows.iloc[hit][["key64"]].assign(at=np.int32(f.snapshot)))
    return pd.concat(found)


def _filters(keyed: DataFrame) -> DataFrame:
    """A filter for each snapshot and bucket of rows (snapshot, bucket, key64)."""
    return keyed.select("snapshot", "bucket", "key64").groupBy("snapshot", "bucket").applyInPandas(_build, "snapshot int, bucket int, seed int, segment int, segments int, cells binary")


def _positives(keyed: DataFrame, filters: DataFrame) -> DataFrame:
    """(key64, at): the keys of rows (snapshot, buckets, bucket, key64) that pass a filter of an earlier snapshot, at."""
    by = lambda df: df.groupBy("buckets", "bucket")
    return by(keyed.select("snapshot", "key64", "buckets", "bucket")).cogroup(by(filters)).applyInPandas(_probe, "key64 bigint, at int")


def _screened(keyed: DataFrame, filters: DataFrame) -> DataFrame:
    """The distinct keys of rows (snapshot, bucket, key64) that pass a filter of an earlier snapshot."""
    one = F.lit(1).alias("buckets")
    return _positives(keyed.select("*", one), filters.select("*", one)).select("key64").distinct()


def normalized(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(normalized(text).cast("binary"), 256))


def _best(id_col: str) -> Column:
    """What the row that stays has least of: most code points, then the smallest id, nulls last."""
    return F.struct((-F.col("n_chars")).alias("n"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def store_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes a snapshot's rows and the filters over them below path, in a folder each; both are read, never changed.

    Texts that the snapshot repeats are stored once, as the text without white space and the row that stays. Buckets are as
    many (a power of two) as the snapshot's size asks for; FOLDER_BUCKETS of them share a folder of rows, sorted by key. An
    empty snapshot has no rows in either.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col), F.length(text).alias("n_chars"), text_digest(text).alias("digest"), normalized(text).alias("norm"))
    # copies fold before they are shuffled; a digest with two texts has two rows here, which tells them apart for good
    kept = rows.groupBy("digest", "norm").agg(F.min(_best(id_col)).alias("best"))
    kept = materialize(kept.withColumn("key64", F.xxhash64("digest")), "exact-snapshot")
    buckets = 1 << max(3, (kept.count() // BUCKET_KEYS).bit_length())
    inside = kept.select("digest", "norm", "best", "key64", F.lit(buckets).alias("buckets"), F.pmod("key64", F.lit(buckets)).cast("int").alias("bucket"), F.lit(0).alias("snapshot"))
    inside = inside.withColumn("folder", F.floor(F.col("bucket") / FOLDER_BUCKETS).cast("int"))
    inside.repartition("folder", "bucket").sortWithinPartitions("folder", "key64").write.partitionBy("folder").parquet(f"{path}/rows")
    stored = inside.sparkSession.read.schema(inside.schema).parquet(f"{path}/rows")
    _filters(stored).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def screen_batch(spark: SparkSession, batch: DataFrame, snapshots: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of batch: id, known_id, batch_id, is_new.

    known_id is the row that stays of an equal text in the first of the stored snapshots that has one, else null; batch_id
    the row that stays among the equal texts of the batch. is_new tells the rows to add: those that stay in the batch and
    are in no snapshot. Rows that repeat id and text of one that stays are new together. The filters of all snapshots are
    probed in one pass, whatever their numbers of buckets; what passes one is joined with the stored rows of its bucket and
    its text compared with theirs, byte by byte, so that equal digests of different texts are not taken for copies.
    """
    text = text_or_empty(text_col)
    base = materialize(batch.select(F.col(id_col), F.length(text).alias("n_chars"), text_digest(text).alias("digest"), normalized(text).alias("norm")), "exact-batch")
    whose = F.struct("digest", F.sha2("norm", 512)).alias("whose")  # stands for a text where its bytes were compared
    inside = base.groupBy("digest", "norm").agg(F.min(_best(id_col)).alias("best"))
    inside = materialize(inside.select("*", F.xxhash64("digest").alias("key64"), whose), "exact-inside")
    kind = batch.schema[id_col].dataType.simpleString()
    asked = ["buckets", "bucket", "key64", "at"]
    known = spark.createDataFrame([], f"whose struct<digest: binary, col2: string>, first struct<at: int, id: {kind}>")
    if snapshots:
        filters = [spark.read.parquet(f"{path}/filters").withColumn("snapshot", F.lit(k)) for k, path in enumerate(snapshots)]
        filters = reduce(DataFrame.unionByName, filters)
        sizes = [r["buckets"] for r in filters.select("buckets").distinct().collect()]  # powers of two, so a few
        keyed = inside.select("key64", F.lit(len(snapshots)).alias("snapshot"), F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("buckets"))
        passed = materialize(_positives(keyed.withColumn("bucket", F.pmod("key64", "buckets").cast("int")), filters).distinct(), "exact-passed")
        where = filters.select(F.col("snapshot").alias("at"), "buckets").distinct()  # a row a snapshot
        asked_rows = passed.join(F.broadcast(where), "at").withColumn("bucket", F.pmod("key64", "buckets").cast("int"))
        asked_rows = asked_rows.withColumn("folder", F.floor(F.col("bucket") / FOLDER_BUCKETS).cast("int"))
        stored_kind = f"digest binary, norm string, best struct<n: int, none: boolean, id: {kind}>, key64 bigint, buckets int, bucket int, snapshot int, folder int"
        stored = reduce(DataFrame.unionByName, [spark.read.schema(stored_kind).parquet(f"{path}/rows").withColumn("at", F.lit(k)) for k, path in enumerate(snapshots)])
        met = stored.join(asked_rows, ["folder", *asked]).select("digest", F.col("norm").alias("stored"), "at", "best")
        # the byte check: what the buckets hold under a digest is the batch's text itself
        same = inside.select("digest", "norm", "whose").join(met, "digest").where(F.col("norm") == F.col("stored"))
        known = same.groupBy("whose").agg(F.min(F.struct("at", F.col("best.id").alias("id"))).alias("first"))
    # a text that a third of the batch repeats is dealt to SALTS parts
    told = inside.join(known, "whose", "left").select("whose", "best", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    stays = F.col("first").isNull() & F.col(id_col).eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.n"))
    rows = base.select(id_col, "n_chars", whose, F.pmod(F.xxhash64(id_col, "n_chars"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(told, ["whose", "salt"]).select(id_col, F.col("first.id").alias("known_id"), F.col("best.id").alias("batch_id"), stays.alias("is_new"))


def exact_groups(docs: DataFrame, snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without white space; null counts as empty. snapshot is the number of the snapshot
    that a row came with (int; by default a hash of the id deals rows into four). Of equal texts the one with the most
    code points stays, then the smallest id (nulls last). Rows that repeat both id and text of the one that stays are
    all marked kept. A byte check that finds different texts under one digest raises. Other columns are not read.
    """
    snapshot = F.pmod(F.xxhash64(id_col), F.lit(4)) if snapshot is None else snapshot
    text = text_or_empty(text_col)
    digest = text_digest(text)
    base = materialize(docs.select(F.col(id_col), snapshot.cast("int").alias("snapshot"), F.length(text).alias("n_chars"), digest.alias("digest")), "exact-rows")

    inside = materialize(base.groupBy("snapshot", "digest").agg(F.count("*").alias("n_rows"), F.min(_best(id_col)).alias("best")).withColumn("key64", F.xxhash64("digest")), "exact-inside")
    n, newest = inside.agg(F.count("*"), F.max("snapshot")).first()
    keyed = inside.select("snapshot", "key64", F.pmod("key64", F.lit(max(8, n // BUCKET_KEYS))).cast("int").alias("bucket"))
    filters = materialize(_filters(keyed.where(F.col("snapshot") < F.lit(newest))), "exact-filters")
    seen = _screened(keyed, filters).withColumn("seen", F.lit(True))
    # the exact join of buckets has the positives of all snapshots; what a snapshot repeats is known without it
    candidates = inside.join(seen, "key64", "left").where("seen or n_rows > 1")
    groups = materialize(
        candidates.groupBy("digest").agg(F.sum("n_rows").alias("group_size"), F.min("best").alias("best"))
        .where("group_size > 1").select("digest", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars")),
        "exact-groups",
    )

    # byte check: the same digest must mean the same text; copies fold into one before they are shuffled a second time
    salt = F.pmod(F.xxhash64(id_col, F.length(text)), F.lit(SALTS)).cast("int")
    rows = docs.select(digest.alias("digest"), salt.alias("salt"), normalized(text).alias("norm"))
    salted = groups.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = rows.join(salted.hint("shuffle_hash"), ["digest", "salt"], "left_semi")
    texts = asked.groupBy("digest", "norm").count().groupBy("digest").agg(F.count("*").alias("texts"))
    checked = groups.join(texts, "digest").withColumn(
        "group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts under one digest")).cast("long"))
    )
    # rows of a digest that a third of the table shares are dealt to SALTS parts, and its one judgement to each of them
    told = checked.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    return base.withColumn("part", F.pmod(F.xxhash64(id_col, "n_chars"), F.lit(SALTS)).cast("int")).join(told, ["digest", "part"], "left").select(
        id_col,
        F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the copies that exact_groups() doesn't keep.

    Of rows that repeat both id and text, one stays. Where each id has one row, the ids decide; else id and text do. Names
    of columns are free: what is added on the way has names of its own.
    """
    groups = materialize(exact_groups(docs, None, id_col, text_col).select(F.col(id_col).alias("id"), F.col("n_chars").cast("int").alias("n"), F.col("text_sha256").alias("sha"), "kept"), "exact-kept")
    if not groups.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        return without_ids(docs, materialize(groups.where("not kept").select(F.col("id").alias("_gone")), "exact-gone"), id_col)
    n, sha = (f"_{name}_{uuid.uuid4().hex}" for name in ("chars", "sha"))
    text = text_or_empty(text_col)
    rows = docs.withColumns({n: F.length(text), sha: F.sha2(normalized(text).cast("binary"), 256)})
    gone = groups.where("not kept")
    same = rows[id_col].eqNullSafe(gone["id"]) & (rows[n] == gone["n"]) & (rows[sha] == gone["sha"])
    rows = rows.join(gone, same, "left_anti")
    if groups.where("kept").groupBy("id", "n", "sha").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates([id_col, n, sha])
    return rows.drop(n, sha)
