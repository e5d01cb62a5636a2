"""Rankings of chunks for whole tables of queries: BM25, exact vector search, fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.plugins import HASHED, TERMS, Encoder, Tokenizer, check
from ..sources.tables import store
from . import graph
from .index import KEY, _one_row, embed_text

K1, B = 1.5, 0.75
#: Queries that are sent to the executors at a time.
QUERY_BLOCK = 4096
#: Vectors of a packed block, and numbers in it (1 MB); blocks of queries whose best a task holds.
BLOCK_ROWS, BLOCK_NUMBERS, HELD_BLOCKS = 2048, 1 << 17, 32


def top_k(scored: DataFrame, k: int, *order: Column | str, by: list[str] | None = None) -> DataFrame:
    """The k first rows of each query with their rank; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_scores(queries: DataFrame, index: dict[str, DataFrame], key: list[str] = KEY, by: list[str] | None = None, tokenizer: Tokenizer = TERMS) -> DataFrame:
    """(query_id, key, score) of all chunks that share a term with the query, scaled to the query's best.

    Query terms that repeat count as often. This scores and shuffles every chunk that a query's terms hit, for any grouping
    of chunks; searches of a stored index for the first k go by blockmax, which shuffles only what can be among them.
    """
    by = by or []
    asked = queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    lengths = index["chunk_len"]
    hit = index["postings"].join(asked, "term").join(index["term_stats"].select(*by, "term", "idf"), [*by, "term"]).join(lengths, key)
    hit = _one_row(hit, index["corpus_stats"], by)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    raw = hit.groupBy("query_id", *key).agg(F.sum(part).alias("raw"))
    best = raw.groupBy("query_id", *by).agg(F.max("raw").alias("best"))
    scale = F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)
    return raw.join(best, ["query_id", *by]).select("query_id", *key, T.fixed(F.col("raw") / scale).alias("score"))


def bm25_search(queries: DataFrame, index: dict[str, DataFrame], k: int = 20, key: list[str] = KEY, by: list[str] | None = None, tokenizer: Tokenizer = TERMS) -> DataFrame:
    """(query_id, key, score, rank); ties by key. An index with `sparse` (blockmax.BlockIndex) is searched by blocks, one of
    plain tables whole; where there are chunks without postings, these are counted and scored in a scan."""
    if "sparse" in index and not by:
        from .blockmax import search

        return search(queries, index["sparse"], k, tokenizer)
    if "postings" not in index and not by:
        from . import scan

        return scan.search(queries, index["chunks"], k, tokenizer)
    return top_k(bm25_scores(queries, index, key, by, tokenizer), k, F.desc("score"), *key, by=["query_id", *(by or [])])


def pad_to_k(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, key: list[str] = KEY) -> DataFrame:
    """hits filled up to k for each query with the first chunks by key that it hasn't, at score 0."""
    # k chunks more than any list holds are enough to fill every one
    first = chunks.select(*key).orderBy(*key).limit(2 * k)
    n = queries.select("query_id").distinct().join(hits.groupBy("query_id").count(), "query_id", "left").select("query_id", F.coalesce("count", F.lit(0)).alias("n")).where(F.col("n") < k)
    wanted = n.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one").drop("_one").join(hits, ["query_id", *key], "left_anti")
    filled = top_k(wanted, k, *key).where(F.col("rank") + F.col("n") <= k).select("query_id", *key, F.lit(0.0).alias("score"), (F.col("rank") + F.col("n")).cast("int").alias("rank"))
    return hits.select("query_id", *key, "score", "rank").union(filled)


def _packed(vectors: DataFrame, key: list[str]) -> DataFrame:
    """Rows of many vectors: the key columns as arrays (k0, k1, ...), and `m`, their numbers as doubles one after the other.

    A row holds up to BLOCK_ROWS vectors and BLOCK_NUMBERS numbers (one vector at least); null vectors are left out.
    """
    types = [vectors.schema[c].dataType for c in key]
    arrays = [pa.list_(to_arrow_type(t)) for t in types]
    names = [f"k{i}" for i in range(len(key))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(key))
            dim = len(lists[0]) if b.num_rows else 0
            for at in range(0, b.num_rows, size := max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(dim, 1)))):
                own = b.slice(at, size)
                m = own.column(len(key)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(m) != own.num_rows * dim:
                    raise ValueError("vectors differ in length")
                yield pa.RecordBatch.from_arrays([*(pa.array([own.column(i).to_pylist()], t) for i, t in enumerate(arrays)), pa.array([m.tobytes()], pa.binary())], [*names, "m"])

    schema = ", ".join([*(f"{n} array<{t.simpleString()}>" for n, t in zip(names, types, strict=True)), "m binary"])
    return vectors.where("embedding is not null").select(*key, "embedding").mapInArrow(pack, schema)


class _Nearest:
    """The k vectors of the highest rounded score for each query of a block, ties by key, as blocks of vectors pass."""

    def __init__(self, q_ids: np.ndarray, k: int, key: list[str]):
        self.q_ids, self.k, self.key = q_ids, k, key
        self.least = np.full(len(q_ids), -np.inf)  # the k-th score so far, in millionths
        self.rows: list[pa.Table] = []
        self.size = self.kept = 0
        self.last: tuple | None = None

    def add(self, scores: np.ndarray, keys: list[pa.Array]) -> None:
        """scores of vectors (rows, in the order of their keys) by query."""
        first, last = (tuple(c[n].as_py() for c in keys) for n in (0, len(scores) - 1))
        bare = None in (*first, *last, *(self.last or ()))
        later = not bare and (self.last is None or first > self.last)
        self.last = (None,) if bare else last if later else max(self.last, last)
        begin = 0
        while begin < len(scores):
            # few at first, so that the k-th score is known before many are looked at
            end = min(len(scores), begin + max(4 * self.k, 3 * begin)) if self.least.min() == -np.inf else len(scores)
            own = scores[begin:end]
            # behind what has passed, a tie with the k-th isn't among the best
            cells = np.flatnonzero(own >= (self.least + (0.5 if later else -0.5)) / 1e6 - 1e-12)
            row, query = np.divmod(cells, own.shape[1])
            s = np.floor(own.ravel()[cells] * 1e6 + 0.5)
            on = s > self.least[query] if later else s >= self.least[query]
            row, query, s = row[on] + begin, query[on], s[on]
            self.rows.append(pa.table([pa.array(query), pa.array(s), *(c.take(pa.array(row)) for c in keys)], ["query", "s", *self.key]))
            self.size += len(s)
            if self.size - self.kept >= self.k * len(self.q_ids) // 2:
                self.out()
            begin = end

    def out(self) -> pa.Table:
        rows = pa.concat_tables(self.rows).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("s", "descending"), *((c, "ascending") for c in self.key)]))
        query = rows["query"].to_numpy()
        first = np.searchsorted(query, np.arange(len(self.q_ids)))
        rows = rows.filter(pa.array(np.arange(len(query)) - first[query] < self.k))
        n = np.bincount(rows["query"].to_numpy(), minlength=len(self.q_ids))
        full = np.flatnonzero(n == self.k)
        self.least[full] = rows["s"].to_numpy()[np.cumsum(n)[full] - 1]
        self.rows, self.size = [rows], len(rows)
        self.kept = self.size
        return rows


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 20, key: list[str] = KEY) -> DataFrame:
    """Exact inner-product top k: (query_id, key, score, rank), ties by key.

    Queries (query_id, embedding) with the same vector are searched once. These and the vectors, in the order of their keys,
    are packed in blocks of bounded size, and each block of queries meets each block of vectors as one row. Where Spark's own
    size check lets it broadcast the queries, vectors are scanned once for any number of them, else once for each partition
    of queries. A task holds the k best of up to HELD_BLOCKS blocks of queries and looks closer at higher scores only. A null
    vector is never found.
    """
    rows = queries.where("query_id is not null and embedding is not null").select("query_id", "embedding")
    same = store({"same": rows.groupBy("embedding").agg(F.min("query_id").alias("first"))})["same"]
    first = same.select(F.col("first").alias("query_id"), "embedding")
    asked = _packed(first.repartition(1 + first.count() // BLOCK_ROWS), ["query_id"]).select(F.col("k0").alias("q_ids"), F.col("m").alias("q"))
    kinds = [vectors.schema[c].dataType for c in key]
    types = [to_arrow_type(t) for t in kinds]
    width, held = len(key), HELD_BLOCKS
    schema = ", ".join(["first bigint", *(f"{c} {t.simpleString()}" for c, t in zip(key, kinds, strict=True)), "score double"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[bytes, _Nearest] = {}

        def sent(own: _Nearest) -> Iterator[pa.RecordBatch]:
            for b in own.out().to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(own.q_ids[b["query"].to_numpy()]), *(b[c].cast(t) for c, t in zip(own.key, types, strict=True)), pa.array(b["s"].to_numpy() / 1e6)], ["first", *key, "score"])

        for b in batches:
            for row in range(b.num_rows):
                q_ids = b.column(width + 1)[row].values.to_numpy().astype(np.int64)
                name = q_ids.tobytes()
                if name not in near:
                    if len(near) >= held:
                        yield from sent(near.pop(next(iter(near))))
                    near[name] = _Nearest(q_ids, k, [f"k{i}" for i in range(width)])
                q = np.frombuffer(b.column(width + 2)[row].as_py(), dtype=np.float64).reshape(len(q_ids), -1)
                keys = [b.column(i)[row].values for i in range(width)]
                v = np.frombuffer(b.column(width)[row].as_py(), dtype=np.float64).reshape(len(keys[0]), -1)
                near[name].add(v @ q.T, keys)
        for own in near.values():
            yield from sent(own)

    pairs = _packed(vectors.sortWithinPartitions(*key), key).crossJoin(asked)
    best = top_k(pairs.mapInArrow(search, schema), k, F.desc("score"), *key, by=["first"])
    return best.join(rows.join(same, "embedding").select("query_id", "first"), "first").select("query_id", *key, "score", "rank")


def dedupe_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct queries with the smallest id of each text, map query_id -> that id): score the first, join by the second."""
    first = queries.groupBy("query").agg(F.min("query_id").alias("first_id"))
    return first.select(F.col("first_id").alias("query_id"), "query"), queries.join(first, "query").select("query_id", "first_id")


def rrf_fuse(dense: DataFrame, sparse: DataFrame, rrf_k: int = 60, k: int = 10, key: list[str] = KEY) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, key, score, dense_rank, sparse_rank, rank); ties by dense, then sparse rank."""
    a = dense.select("query_id", *key, F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", *key, F.col("rank").alias("sparse_rank"))
    share = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", *key], "full_outer").withColumn("score", T.fixed(share("dense_rank") + share("sparse_rank"), 9))
    return top_k(both, k, F.desc("score"), F.asc_nulls_last("dense_rank"), "sparse_rank")


def term_share(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds."""
    q = F.array_distinct(T.terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.terms(text))) / F.size(q)).otherwise(0.0)


def rerank(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 10, scorer=term_share, key: list[str] = KEY) -> DataFrame:
    """hits (query_id, key, rank) scored anew by query and text; ties keep the order of before."""
    pairs = hits.select("query_id", *key, F.col("rank").alias("before")).join(queries.select("query_id", "query"), "query_id").join(chunks.select(*key, "text"), key)
    return top_k(pairs.withColumn("score", T.fixed(scorer(F.col("query"), F.col("text")))), k, F.desc("score"), "before").select("query_id", *key, "score", "rank")


@dataclass(frozen=True)
class Settings:
    """What a retrieval takes; the defaults are those of the reference's configuration."""

    dense_k: int = 20
    sparse_k: int = 20
    rrf_k: int = 60
    rerank_k: int = 10
    scorer: Callable[[Column, Column], Column] = term_share
    decay: float = 0.7
    min_path: float = 0.1
    max_expanded: int = 5
    tokenizer: Tokenizer = TERMS
    encoder: Encoder = HASHED


def retrieve_stages(queries: DataFrame, index: dict, top_k: int = 5, enable_graph_expansion: bool = True, max_hops: int = 2, settings: Settings | None = None) -> dict[str, DataFrame]:
    """The stages of a retrieval: fused (hybrid ten), ranked (reranked), paths (walks from the first top_k along the graph
    of the indexed chunks; none without a graph), evidence (query_id, key, score, expanded_via_graph, rank), and counts
    (query_id, hybrid_retrieval_count, reranked_count, graph_expanded_count).

    queries has query_id and query; index is that of index.build_index, or a stored one, built with the settings' tokenizer
    and encoder: any other raises.
    """
    s = settings or Settings()
    check(index.get("meta"), s.tokenizer, s.encoder)
    vectors = embed_text(queries.select("query_id", F.col("query").alias("text")), ["query_id"], s.encoder).select("query_id", "embedding")
    fused = rrf_fuse(dense_search(vectors, index["vectors"], s.dense_k), bm25_search(queries, index, s.sparse_k, tokenizer=s.tokenizer), s.rrf_k, s.rerank_k)
    # read again by each step along the graph, so it is stored
    ranked = store({"ranked": rerank(fused, queries, index["chunks"], s.rerank_k, s.scorer)})["ranked"]
    plain = ranked.where(F.col("rank") <= top_k).select("query_id", *KEY, "score", F.lit(False).alias("expanded_via_graph"), "rank")
    evidence, paths = plain, None
    if enable_graph_expansion and "nodes" in index:
        whole = ranked.join(index["chunks"].select(*KEY, "text"), KEY)
        paths = graph.graph_paths(whole.where(F.col("rank") <= top_k), index["nodes"], index["edges"], max_hops, s.decay, s.min_path)
        new = graph.expanded_chunks(paths, index["nodes"], whole, s.max_expanded)
        evidence = graph.merge_expanded(whole, new, index["nodes"]).where(F.col("rank") <= top_k).select("query_id", *KEY, "score", "expanded_via_graph", "rank")
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    walks = count(paths, "graph_expanded_count") if paths is not None else queries.select("query_id", F.lit(0).cast("bigint").alias("graph_expanded_count"))
    counts = queries.select("query_id").join(count(fused, "hybrid_retrieval_count"), "query_id", "left").join(count(ranked, "reranked_count"), "query_id", "left").join(walks, "query_id", "left").na.fill(0)
    return {"fused": fused, "ranked": ranked, "evidence": evidence, "counts": counts} | ({"paths": paths} if paths is not None else {})


def retrieve_batch(queries: DataFrame, index: dict, top_k: int = 5, enable_graph_expansion: bool = True, max_hops: int = 2, settings: Settings | None = None) -> DataFrame:
    """(query_id, key, score, expanded_via_graph, rank): the evidence of retrieve_stages()."""
    return retrieve_stages(queries, index, top_k, enable_graph_expansion, max_hops, settings)["evidence"]


def line_match(queries: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The line of all documents that holds most of a query's words as substrings: (query_id, n_words, line).

    A query is cut at white space, without question marks; a line is cut to 200 characters. The first line by key wins; a
    query without any match has 0 and an empty line. Queries go out in blocks; one automaton of a block's words reads each
    line once, and a task keeps its best line for each query.
    """
    spark = docs.sparkSession
    words = queries.select("query_id", F.array_distinct(F.filter(F.split(F.regexp_replace("query", "[？?]", ""), "(?U)\\s+"), lambda w: w != "")).alias("words"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"query_id bigint, n_words int, {key} {kind}, pos int, line string"
    out = spark.createDataFrame([], schema)
    blocks = max(1, -(-words.count() // QUERY_BLOCK))
    for block in range(blocks):
        own = words.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        sent = spark.sparkContext.broadcast([(int(q), list(w)) for q, w in zip(own["query_id"], own["words"], strict=True)])

        def match(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            owners: dict[str, list[int]] = {}
            for q, ws in sent.value:
                for w in ws:
                    owners.setdefault(w, []).append(q)
            machine = ahocorasick.Automaton()
            for w in owners:
                machine.add_word(w, w)
            machine.make_automaton()
            best: dict[int, tuple] = {}
            for rows in batches if owners else ():
                for k, text in zip(rows[key], rows["text"], strict=True):
                    for pos, line in enumerate((text or "").split("\n")):
                        count: dict[int, int] = {}
                        for w in {w for _, w in machine.iter(line)}:
                            for q in owners[w]:
                                count[q] = count.get(q, 0) + 1
                        for q, n in count.items():
                            if q not in best or (-n, k, pos) < best[q][:3]:
                                best[q] = (-n, k, pos, line[:200])
            yield pd.DataFrame([(q, -n, k, pos, line) for q, (n, k, pos, line) in best.items()], columns=["query_id", "n_words", key, "pos", "line"])

        out = out.union(docs.select(key, "text").where(f"{key} is not null").mapInPandas(match, schema))
    first = top_k(out, 1, F.desc("n_words"), key, "pos").select("query_id", "n_words", "line")
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("line", F.lit("")).alias("line"))
