"""Index tables: postings, lengths, term statistics and vectors. `key` names a chunk; it may hold a grouping column too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plugins import HASHED, TERMS, Encoder, Tokenizer, named
from . import graph

KEY = ["doc_id", "chunk_index"]


def tokenize_terms(chunks: DataFrame, key: list[str] = KEY, tokenizer: Tokenizer = TERMS) -> DataFrame:
    return chunks.select(*key, F.explode(tokenizer(F.col("text"))).alias("term"))


def postings(chunks: DataFrame, key: list[str] = KEY, tokenizer: Tokenizer = TERMS) -> DataFrame:
    """(term, key, tf)"""
    return tokenize_terms(chunks, key, tokenizer).groupBy("term", *key).agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame, key: list[str] = KEY, tokenizer: Tokenizer = TERMS) -> DataFrame:
    """(key, dl); 0 for a chunk without terms."""
    return chunks.select(*key, F.size(tokenizer(F.col("text"))).cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n_chunks, avgdl), a row for each value of `by` if given."""
    return lengths.groupBy(*(by or [])).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def _one_row(rows: DataFrame, stats: DataFrame, by: list[str] | None) -> DataFrame:
    """rows with the statistics of their group; one row of statistics for all if there are no groups."""
    return rows.join(F.broadcast(stats), by) if by else rows.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one").drop("_one")


def term_stats(post: DataFrame, stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(term, df, idf); a negative idf becomes a quarter of the mean idf over the vocabulary, negatives included."""
    df = post.groupBy(*(by or []), "term").agg(F.count("*").alias("df"))
    raw = _one_row(df, stats, by).withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*(by or [])).agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw"))
    return _one_row(raw, mean, by).select(*(by or []), "term", "df", idf.alias("idf"))


def embed_text(rows: DataFrame, key: list[str], encoder: Encoder = HASHED) -> DataFrame:
    """rows with `embedding`, as the encoder makes it of `text`."""
    return encoder.embed(rows, key)


def normalize_vectors(rows: DataFrame, col: str = "embedding") -> DataFrame:
    """Unit length; a vector of no length stays."""
    e = F.transform(F.col(col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_n", norm).withColumn(col, F.transform(e, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x))).drop("_n")


def build_index(chunks: DataFrame, key: list[str] = KEY, made: dict[str, DataFrame] | None = None, tokenizer: Tokenizer = TERMS, encoder: Encoder = HASHED) -> dict[str, DataFrame]:
    """All index tables of the chunks, by name; with the graph (nodes, edges) where chunks have the plain key, and `meta`, the names of its plug-ins.

    made may hold postings and chunk_len that are stored already; statistics then read those instead of the texts.
    """
    made = made or {}
    post, lengths = made.get("postings", postings(chunks, key, tokenizer)), made.get("chunk_len", chunk_lengths(chunks, key, tokenizer))
    stats = corpus_stats(lengths)
    nodes = dict(zip(("nodes", "edges"), graph.build_graph(chunks), strict=True)) if key == KEY else {}
    meta = chunks.sparkSession.createDataFrame([named(tokenizer, encoder)], "tokenizer string, encoder string, dim int")
    return nodes | {"meta": meta, "chunks": chunks, "postings": post, "chunk_len": lengths, "corpus_stats": stats, "term_stats": term_stats(post, stats), "vectors": embed_text(chunks, key, encoder).select(*key, "embedding")}
