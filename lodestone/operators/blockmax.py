"""A stored inverted index for BM25 in segments: postings in blocks by term bucket, and exact top-k search that skips blocks.

A folder holds, for each segment, `forward` (a row a chunk: its number, length and term counts) and `blocks` (postings of a
term, of one level of impact and one range of chunk numbers, with the largest impact among them), the blocks in folders by
a hash of the term. New documents are a segment more, deletions are a list of dead chunk numbers, and merge() writes what
lives as one segment. Each change ends with a new generation: statistics of all terms, and a manifest that names what
belongs to it; readers of an older generation keep what they read.

A search has two passes. The first adds up what chunks have of a query's rarest terms, scores the best of them whole, and
so knows a score that the k-th hit reaches at least. For the second, a query's terms are ordered by what each can add at
most. A chunk whose strongest term is t scores no more than t's impact there and all that weaker terms can add; a block for
which that sum stays below a SHARE of the first pass's score is not read for the query, and counts in the bounds of what
other blocks hold. What blocks hold is added up range by range of chunk numbers: blocks are shuffled, not scores, and a
task lets out those chunks of its range whose bound reaches the score. These few are scored whole from `forward`, so no
hit is lost. Queries go to the tasks in sets of QUERIES.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.plugins import TERMS, Tokenizer
from ..sources.tables import store
from .retrieval import K1, B, top_k

KEY = ["doc_id", "chunk_index"]
#: Chunk numbers hold a segment, a file's number and a place in it.
SEGMENT_BITS, FILE_BITS = 50, 28
#: Levels of impact to 1; chunk numbers of a range as a power of two.
LEVELS, CELL_BITS = 8, 11
#: Buckets of a new index, where none are given.
BUCKETS = 16
#: Chunks that the first pass scores whole, and postings that it reads for them, in multiples of k.
SCORED, PROBED = 4, 200
#: Scores are compared to six digits of the best, so bounds give way by a little more than that.
SLACK = 2e-6
#: Of the score to reach, what weak terms may add together without being read; queries that go out at a time.
SHARE, QUERIES = 0.1, 1024


@dataclass(frozen=True)
class Manifest:
    """What belongs to a generation of an index."""

    path: str
    generation: int
    buckets: int
    segments: list[int]
    n_chunks: int
    n_terms: int
    deletions: list[str]
    tokenizer: str = "terms"
    lengths: dict[str, float] = field(default_factory=dict)  # mean chunk length when a segment's blocks were made

    @property
    def avgdl(self) -> float:
        return self.n_terms / self.n_chunks if self.n_chunks else 0.0


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commit(spark: SparkSession, m: Manifest) -> Manifest:
    """Writes the statistics of a generation, then its manifest, which makes it the current one."""
    deltas = spark.read.parquet(*[f"{m.path}/terms/segment={s}" for s in m.segments], *[f"{m.path}/gone/{d}/terms" for d in m.deletions]) if m.segments else None
    if deltas is not None:
        df = deltas.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top")).where("df > 0")
        n = F.lit(float(m.n_chunks))
        raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw")).first()[0]
        idf = F.when(F.col("raw") < 0, 0.25 * F.lit(mean)).otherwise(F.col("raw"))
        raw.select("bucket", "term", "df", idf.alias("idf"), "top").repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{m.path}/stats/{m.generation:08d}")
    fs, at = _fs(spark, f"{m.path}/generations/{m.generation:08d}.json")
    out = fs.create(at, False)
    out.write(json.dumps(asdict(m)).encode())
    out.close()
    return m


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The current generation of an index; None where there is no index."""
    fs, at = _fs(spark, f"{path}/generations")
    if not fs.exists(at):
        return None
    last = max(str(s.getPath()) for s in fs.listStatus(at) if str(s.getPath()).endswith(".json"))
    return Manifest(**json.loads("\n".join(r.value for r in spark.read.text(last).collect())))


def impact(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl or 1.0)))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def count_terms(rows: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, tf, dl) of rows (doc_id, chunk_index, terms): each chunk's terms counted in its own row, batch by batch."""
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(b["terms"]), 0), dtype=np.int64)
            words = b["terms"].flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            codes, tf = np.unique(np.repeat(np.arange(b.num_rows), lengths) * n + np.asarray(words.indices, dtype=np.int64), return_counts=True)
            cuts = np.searchsorted(codes, np.arange(b.num_rows + 1) * n)
            pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(codes % n)), pa.array(tf.astype(np.int32))], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in KEY), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs), pa.array(lengths)], [*KEY, "tf", "dl"])

    return rows.mapInArrow(run, ", ".join([*kinds, "tf array<struct<term:string,tf:int>>", "dl bigint"]))


def add_segment(chunks: DataFrame, path: str, tokenizer: Tokenizer = TERMS, buckets: int = BUCKETS) -> Manifest:
    """Writes chunks (doc_id, chunk_index, text) as a new segment of the index at path, or of a new index.

    Term counts are made inside each chunk's row and blocks inside each range of chunk numbers, so no posting is shuffled.
    """
    spark = chunks.sparkSession
    old = manifest(spark, path) or Manifest(path, 0, buckets, [], 0, 0, [], tokenizer.name)
    if old.tokenizer != tokenizer.name:
        raise ValueError(f"the index has terms of {old.tokenizer!r}, not of {tokenizer.name!r}")
    segment = max(old.segments, default=0) + 1
    if segment >= 1 << (63 - SEGMENT_BITS):
        raise ValueError("too many segments: merge them")
    mine = F.monotonically_increasing_id()
    number = F.lit(segment << SEGMENT_BITS) + F.shiftleft(F.shiftright(mine, 33), FILE_BITS) + mine.bitwiseAND((1 << 33) - 1)
    rows = count_terms(chunks.select(*KEY, tokenizer(F.col("text")).alias("terms"))).withColumn("no", number)
    rows.write.mode("overwrite").parquet(f"{path}/forward/segment={segment}")
    forward = spark.read.parquet(f"{path}/forward/segment={segment}")
    size = forward.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    n_chunks, n_terms = old.n_chunks + size["n"], old.n_terms + size["dl"]
    m = Manifest(path, old.generation + 1, old.buckets, [*old.segments, segment], n_chunks, n_terms, old.deletions, tokenizer.name, old.lengths | {str(segment): n_terms / n_chunks if n_chunks else 0.0})
    _write_blocks(forward, m, segment)
    return _commit(spark, m)


def _packed_blocks(forward: DataFrame, avgdl: float) -> DataFrame:
    """(term, cell, bound, n, slots, tfs, dls): postings of chunks (no, dl, tf) in blocks, made batch by batch where the chunks are.

    Chunk numbers follow their place in a file, so a range's chunks lie together and no posting is shuffled; where a batch ends
    inside a range, a term has a block more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, counts = b["tf"].flatten().flatten()
            if not len(terms):
                continue
            row = np.repeat(np.arange(b.num_rows), np.asarray(b["tf"].value_lengths(), dtype=np.int64))
            coded = terms.dictionary_encode()
            no, dl, tf = b["no"].to_numpy()[row], b["dl"].to_numpy()[row], counts.to_numpy()
            reached = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (avgdl or 1.0)))
            cells, cell = np.unique(no >> CELL_BITS, return_inverse=True)
            levels = int((K1 + 1) * LEVELS) + 1
            group = (cell * len(coded.dictionary) + np.asarray(coded.indices, dtype=np.int64)) * levels + np.floor(reached * LEVELS).astype(np.int64)
            order = np.lexsort((no, group))
            group, reached = group[order], reached[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            cuts = pa.array(np.append(first, len(group)), pa.int32())
            place, code = np.divmod(group[first] // levels, len(coded.dictionary))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order].astype(kind))) for x, kind in ((no & ((1 << CELL_BITS) - 1), np.int16), (tf, np.int32), (dl, np.int32))]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code)), pa.array(cells[place]), pa.array(np.maximum.reduceat(reached, first)), pa.array(np.diff(np.append(first, len(group))).astype(np.int32)), *lists], ["term", "cell", "bound", "n", "slots", "tfs", "dls"])

    return forward.select("no", "dl", "tf").mapInArrow(run, "term string, cell bigint, bound double, n int, slots array<smallint>, tfs array<int>, dls array<int>")


def _write_blocks(forward: DataFrame, m: Manifest, segment: int) -> None:
    packed = _packed_blocks(forward, m.avgdl).withColumn("bucket", _bucket("term", m.buckets))
    packed.sortWithinPartitions("bucket", "term", F.desc("bound")).write.partitionBy("bucket").mode("overwrite").parquet(f"{m.path}/blocks/segment={segment}")
    blocks = forward.sparkSession.read.schema("bucket int, term string, n int, bound double").parquet(f"{m.path}/blocks/segment={segment}")
    blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("bound").alias("top")).write.mode("overwrite").parquet(f"{m.path}/terms/segment={segment}")


def delete_documents(spark: SparkSession, path: str, ids: DataFrame) -> Manifest:
    """Takes the documents (doc_id) out: their chunks' numbers are listed as dead, their terms are counted off."""
    m = manifest(spark, path)
    name = f"g{m.generation + 1}-{uuid.uuid4().hex[:8]}"
    own = _live(spark, m).select("doc_id", "no").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    own.groupBy(F.shiftright("no", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(no & 63 as int)))").alias("bits")).write.parquet(f"{path}/gone/{name}/chunks")
    gone = _at_bits(_forward(spark, m), spark.read.parquet(f"{path}/gone/{name}/chunks"), 1)
    counts = gone.select(F.explode("tf.term").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
    counts.select(_bucket("term", m.buckets).alias("bucket"), "term", "df", F.lit(None).cast("double").alias("top")).write.parquet(f"{path}/gone/{name}/terms")
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    return _commit(spark, Manifest(path, m.generation + 1, m.buckets, m.segments, m.n_chunks - size["n"], m.n_terms - size["dl"], [*m.deletions, name], m.tokenizer, m.lengths))


def _forward(spark: SparkSession, m: Manifest) -> DataFrame:
    return spark.read.parquet(*[f"{m.path}/forward/segment={s}" for s in m.segments])


def _dead(spark: SparkSession, m: Manifest) -> DataFrame | None:
    """(word, bits): which of each 64 chunk numbers are deleted."""
    if not m.deletions:
        return None
    return spark.read.parquet(*[f"{m.path}/gone/{d}/chunks" for d in m.deletions]).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _at_bits(rows: DataFrame, words: DataFrame, bit: int) -> DataFrame:
    """rows whose chunk number's bit is so. A bit a chunk number goes to the tasks, so that term counts aren't shuffled."""
    met = rows.join(F.broadcast(words), F.shiftright("no", 6) == F.col("word"), "left")
    return met.where(f"coalesce(shiftrightunsigned(bits, cast(no & 63 as int)) & 1L, 0L) = {bit}").drop("word", "bits")


def _live(spark: SparkSession, m: Manifest) -> DataFrame:
    return _without_dead(_forward(spark, m), _dead(spark, m))


def _without_dead(forward: DataFrame, dead: DataFrame | None) -> DataFrame:
    return forward if dead is None else _at_bits(forward, dead, 0)


def merge(spark: SparkSession, path: str) -> Manifest:
    """One segment of all live chunks, and a new generation of it alone; texts are not read again."""
    m = manifest(spark, path)
    segment = max(m.segments) + 1
    mine = F.monotonically_increasing_id()
    number = F.lit(segment << SEGMENT_BITS) + F.shiftleft(F.shiftright(mine, 33), FILE_BITS) + mine.bitwiseAND((1 << 33) - 1)
    _live(spark, m).select(*KEY, "tf", "dl").withColumn("no", number).write.mode("overwrite").parquet(f"{path}/forward/segment={segment}")
    one = Manifest(path, m.generation + 1, m.buckets, [segment], m.n_chunks, m.n_terms, [], m.tokenizer, {str(segment): m.avgdl})
    _write_blocks(spark.read.parquet(f"{path}/forward/segment={segment}"), one, segment)
    return _commit(spark, one)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes what the current generation doesn't read; those who still read an older one can't any longer."""
    m = manifest(spark, path)
    segments = {f"segment={s}" for s in m.segments}
    for folder, kept in (("forward", segments), ("blocks", segments), ("terms", segments), ("gone", set(m.deletions)), ("stats", {f"{m.generation:08d}"}), ("generations", {f"{m.generation:08d}.json"})):
        fs, at = _fs(spark, f"{path}/{folder}")
        for entry in fs.listStatus(at) if fs.exists(at) else ():
            if entry.getPath().getName() not in kept:
                fs.delete(entry.getPath(), True)


# ---- search


@dataclass(frozen=True)
class BlockIndex:
    """A generation of an index as tables: forward, blocks with their bounds at today's mean length, and term statistics."""

    manifest: Manifest
    forward: DataFrame
    blocks: DataFrame
    stats: DataFrame
    dead: DataFrame | None

    def in_buckets(self, table: DataFrame, buckets: list[int]) -> DataFrame:
        """Only folders of those buckets are read."""
        return table.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))


def open_index(spark: SparkSession, path: str, tokenizer: Tokenizer = TERMS) -> BlockIndex:
    """The current generation; raises where its terms are not the tokenizer's."""
    m = manifest(spark, path)
    if m is None:
        raise FileNotFoundError(f"no index at {path}")
    if m.tokenizer != tokenizer.name:
        raise ValueError(f"the index has terms of {m.tokenizer!r}, not of {tokenizer.name!r}")
    kinds = "term string, cell bigint, bound double, n int, slots array<smallint>, tfs array<int>, dls array<int>, segment int, bucket int"
    blocks = spark.read.schema(kinds).option("basePath", f"{path}/blocks").parquet(*[f"{path}/blocks/segment={s}" for s in m.segments])
    # a longer mean raises impacts by no more than its own ratio
    grown = F.lit(1.0)
    for s, mean in m.lengths.items():
        if mean and m.avgdl > mean:
            grown = F.when(F.col("segment") == int(s), m.avgdl / mean).otherwise(grown)
    dead = _dead(spark, m)
    stats = spark.read.schema("term string, df bigint, idf double, top double, bucket int").parquet(f"{path}/stats/{m.generation:08d}")
    most = max([1.0, *(m.avgdl / mean for mean in m.lengths.values() if mean)])
    return BlockIndex(m, _forward(spark, m), blocks.withColumn("bound", F.col("bound") * grown), stats.withColumn("top", F.col("top") * most), dead)


def _asked(queries: DataFrame, index: BlockIndex, tokenizer: Tokenizer) -> pd.DataFrame:
    """(query_id, term, bucket, w, df, most) of one set of queries: what each term weighs, and the most that it adds to a score."""
    spark = queries.sparkSession
    terms = queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = terms.withColumn("bucket", _bucket("term", index.manifest.buckets)).toPandas()
    buckets = sorted(int(b) for b in terms["bucket"].unique())
    words = terms[["bucket", "term"]].drop_duplicates()
    if words.empty:
        return terms.assign(w=0.0, df=0, most=0.0)
    known = index.in_buckets(index.stats, buckets).join(spark.createDataFrame(words, "bucket int, term string"), ["bucket", "term"]).toPandas()
    found = terms.merge(known, on=["bucket", "term"])
    w = found["qtf"] * found["idf"]
    return found.assign(w=w, most=np.maximum(0.0, w * found["top"]))[["query_id", "term", "bucket", "w", "df", "most"]]


def _by_range(asked: pd.DataFrame, index: BlockIndex, k: int, only: bool = False) -> DataFrame:
    """(query_id, no, part): what asked (query_id, term, bucket, w, needs, spare, spares, reach, slack) finds, added up range by range.

    A block is read where w times its bound reaches needs. A chunk's part is the sum of w times impact less spare, and no
    more than its score. With `only`, the k highest parts of each range come out; else all whose part and the query's
    spares reach `reach`, and the k-th part of the range less slack.
    """
    spark, avgdl = index.forward.sparkSession, index.manifest.avgdl or 1.0
    ids = asked["query_id"].unique()
    place = {q: n for n, q in enumerate(ids)}
    limits = asked.groupby("query_id")[["spares", "reach", "slack"]].first().loc[ids].to_numpy()
    terms: dict[str, list[tuple[int, float, float, float]]] = {}
    for q, t, *numbers in asked[["query_id", "term", "w", "needs", "spare"]].itertuples(index=False):
        terms.setdefault(t, []).append((place[q], *numbers))
    sent = spark.sparkContext.broadcast((ids, limits, terms))
    all_live = index.dead is None

    def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
        ids, limits, terms = sent.value
        at, sums, hits = None, {}, {}

        def ended() -> pa.RecordBatch:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for n, total in sums.items():
                held = np.flatnonzero(hits[n])
                value = total[held]
                spares, reach, slack = limits[n]
                if len(value) > k:
                    kth = np.partition(value, -k)[-k]
                    # a range's highest parts may be those of deleted chunks
                    kept = value >= kth if only else value + spares >= (max(reach, kth - slack) if all_live else reach)
                else:
                    kept = value + spares >= reach
                held, value = held[kept], value[kept]
                found.append((np.full(len(held), ids[n]), held + (at << CELL_BITS), value))
            sums.clear()
            hits.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["query_id", "no", "part"])

        for b in batches:
            bounds, cells, names = b["bound"].to_numpy(), b["cell"].to_numpy(), b["term"].to_pylist()
            cuts = b["slots"].offsets.to_numpy()
            places, tfs, dls = (b[c].values.to_numpy() for c in ("slots", "tfs", "dls"))
            impacts = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * dls / avgdl))
            for r, name in enumerate(names):
                if at != cells[r]:
                    if sums:
                        yield ended()
                    at = int(cells[r])
                slots, impact = places[cuts[r] : cuts[r + 1]], impacts[cuts[r] : cuts[r + 1]]
                for n, w, needs, spare in terms[name]:
                    if w * bounds[r] >= needs:
                        if n not in sums:
                            sums[n], hits[n] = np.zeros(1 << CELL_BITS), np.zeros(1 << CELL_BITS, dtype=bool)
                        # a chunk is in one block of a term, once
                        sums[n][slots] += w * impact - spare
                        hits[n][slots] = True
        if sums:
            yield ended()

    # what no query of the set needs isn't read: weights are positive where needs is
    low = np.where(asked["needs"] > 0, asked["needs"] / np.maximum(asked["w"], 1e-300) * (1 - 1e-12), -np.inf)
    least = asked.assign(least=low).groupby(["bucket", "term"], as_index=False)["least"].min()
    wanted = spark.createDataFrame(least, "bucket int, term string, least double")
    met = index.in_buckets(index.blocks, sorted(int(b) for b in least["bucket"].unique())).join(F.broadcast(wanted), ["bucket", "term"]).where(F.col("bound") >= F.col("least"))
    return met.select("cell", "term", "bound", "slots", "tfs", "dls").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "query_id bigint, no bigint, part double")


def _whole(found: DataFrame, asked: pd.DataFrame, index: BlockIndex) -> DataFrame:
    """(query_id, doc_id, chunk_index, raw): the whole scores of found (query_id, no), from the chunks' own term counts."""
    # stored, so that Spark knows whether they are few enough to be sent to the chunks
    found = store({"found": found.select("query_id", "no")})["found"]
    rows = _without_dead(found.join(index.forward.select(*KEY, "no", "dl", "tf"), "no"), index.dead)
    terms = rows.select("query_id", *KEY, "no", "dl", F.inline("tf")).join(found.sparkSession.createDataFrame(asked[["query_id", "term", "w"]], "query_id bigint, term string, w double"), ["query_id", "term"])
    return terms.groupBy("query_id", *KEY, "no").agg(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"), index.manifest.avgdl)).alias("raw")).drop("no")


def _bounded(queries: DataFrame, index: BlockIndex, k: int, tokenizer: Tokenizer) -> pd.DataFrame:
    """_asked() with what a block's own bound must reach to be read (needs), what the term may add in blocks that are not
    read (spare, and spares of all), what a chunk's score must reach (reach), and what rounding may hide (slack)."""
    asked = _asked(queries, index, tokenizer)
    if asked.empty:
        return asked
    asked = asked.sort_values(["query_id", "most", "term"], ascending=[True, False, True], ignore_index=True)
    by = asked.groupby("query_id")
    probed = asked[by["df"].cumsum() - asked["df"] < PROBED * k].assign(needs=-np.inf, spare=0.0, spares=0.0, reach=-1e300, slack=0.0)
    best = top_k(_by_range(probed, index, SCORED * k, True), SCORED * k, F.desc("part"), "no")
    least = top_k(_whole(best, asked, index), k, F.desc("raw")).where(F.col("rank") == k).select("query_id", F.col("raw").alias("least")).toPandas()
    # weaker terms come behind
    before = by["most"].transform("sum") - by["most"].cumsum()
    # where a weight is below zero, parts are no lower bounds and every block is read
    slack = np.where(by["w"].transform("min") >= 0, by["most"].transform("sum") * SLACK, np.inf)
    reach = np.maximum(asked[["query_id"]].merge(least, on="query_id", how="left")["least"].fillna(-1e300).to_numpy() - slack, -1e300)
    needs = SHARE * reach - before
    told = asked.assign(slack=slack, reach=reach, needs=needs, spare=np.minimum(asked["most"], np.maximum(0.0, needs)))
    return told.assign(spares=told.groupby("query_id")["spare"].transform("sum"))


def _reaching(found: DataFrame, told: pd.DataFrame, k: int) -> DataFrame:
    """Of found (query_id, no, part) what can reach the k-th part of all ranges: a score is its part at least, and no more than that and the query's spares."""
    limits = told.groupby("query_id", as_index=False).agg(give=("spares", "first"), slack=("slack", "first"))
    limits["give"] += limits.pop("slack")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"))))
    kth = F.max(F.when(F.col("place") == k, F.col("part"))).over(Window.partitionBy("query_id"))
    near = ranked.withColumn("kth", kth).join(found.sparkSession.createDataFrame(limits, "query_id bigint, give double"), "query_id")
    return near.where(F.col("kth").isNull() | (F.col("part") + F.col("give") >= F.col("kth"))).select("query_id", "no", "part")


def _sets(queries: DataFrame) -> list[DataFrame]:
    """Queries in sets of about QUERIES, by a hash of their ids."""
    sets = max(1, -(-queries.count() // QUERIES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == n) if sets > 1 else queries for n in range(sets)]


def search(queries: DataFrame, index: BlockIndex, k: int = 20, tokenizer: Tokenizer = TERMS) -> DataFrame:
    """(query_id, doc_id, chunk_index, score, rank) of the k best, exact, scaled to each query's best; ties by key.

    queries has query_id and query. Queries without any term of the index have no hits.
    """
    spark, out = queries.sparkSession, []
    if tokenizer.name != index.manifest.tokenizer:
        raise ValueError(f"the index has terms of {index.manifest.tokenizer!r}, not of {tokenizer.name!r}")
    for own in _sets(queries):
        told = _bounded(own, index, k, tokenizer)
        if told.empty:
            continue
        found = _reaching(_without_dead(_by_range(told[told["most"] >= told["needs"]], index, k), index.dead), told, k)
        reach = spark.createDataFrame(told[["query_id", "reach"]].drop_duplicates("query_id"), "query_id bigint, reach double")
        scored = _whole(found, told, index).join(reach, "query_id").where(F.col("raw") >= F.col("reach"))
        best = F.max("raw").over(Window.partitionBy("query_id"))
        scaled = scored.withColumn("best", best).select("query_id", *KEY, T.fixed(F.col("raw") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)).alias("score"))
        out.append(top_k(scaled, k, F.desc("score"), *KEY))
    kinds = ", ".join(f"{c} {index.forward.schema[c].dataType.simpleString()}" for c in KEY)
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], f"query_id bigint, {kinds}, score double, rank int")


def blocks_read(queries: DataFrame, index: BlockIndex, k: int = 20, tokenizer: Tokenizer = TERMS) -> DataFrame:
    """(query_id, blocks, blocks_read, postings, postings_read) of the second pass, for a set of up to QUERIES queries."""
    told = _bounded(queries, index, k, tokenizer)
    rows = queries.sparkSession.createDataFrame(told[["query_id", "bucket", "term", "w", "needs"]], "query_id bigint, bucket int, term string, w double, needs double")
    met = rows.join(index.in_buckets(index.blocks, sorted(int(b) for b in told["bucket"].unique())).select("bucket", "term", "bound", "n"), ["bucket", "term"])
    is_read = (F.col("w") * F.col("bound") >= F.col("needs")).cast("bigint")
    return met.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum(is_read).alias("blocks_read"), F.sum("n").alias("postings"), F.sum(is_read * F.col("n")).alias("postings_read"))
