"""Evaluation of retrieval and answers: hits, precision and recall by bucket, error categories, sweeps and ablations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread, store
from . import sweep

#: Error categories and what they mean.
CATEGORIES = {
    "no_evidence": "未找到相关证据",
    "wrong_evidence": "检索到错误证据",
    "generation_error": "生成过程出错",
    "low_confidence": "置信度过低",
    "correct": "回答正确",
}


def _texts(hits: DataFrame, k: int, by: list[str], cut: int | None = None) -> DataFrame:
    """The first k texts of each query in rank order, joined with a space."""
    text = F.substring("text", 1, cut) if cut else F.col("text")
    listed = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return hits.where(F.col("rank") <= k).groupBy(*by).agg(F.array_join(F.transform(listed, lambda h: h["text"]), " ").alias("found"))


def hit_at_k(hits: DataFrame, queries: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """(by, is_hit): whether the first 30 characters of the answer, stripped, are in the first k texts."""
    by = by or ["query_id"]
    key = T.strip(F.substring("answer", 1, 30))
    j = queries.select(*by, "answer").join(_texts(hits, k, by), by, "left")
    return j.select(*by, ((key != "") & F.coalesce(F.contains(F.col("found"), key), F.lit(False))).alias("is_hit"))


def answer_words(answer: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.substring(answer, 1, 50), "(?U)\\s+"), lambda w: w != ""))


def keyword_hit(hits: DataFrame, queries: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """(by, is_hit): whether a word of the first 50 characters of the answer is in the first 100 of one of the k texts."""
    by = by or ["query_id"]
    j = queries.select(*by, "answer").join(_texts(hits, k, by, 100), by, "left")
    return j.select(*by, F.coalesce(F.exists(answer_words(F.col("answer")), lambda w: F.contains(F.col("found"), w)), F.lit(False)).alias("is_hit"))


def answer_hit(results: DataFrame) -> DataFrame:
    """results (predicted_answer, reference) with is_hit."""
    key = T.strip(F.substring("reference", 1, 30))
    return results.withColumn("is_hit", (key != "") & F.contains(F.coalesce("predicted_answer", F.lit("")), key))


def run_summary(results: DataFrame) -> DataFrame:
    """One row: total, hit_rate, avg_confidence, avg_latency_ms; zeros without results."""
    mean = lambda c, n: T.fixed(F.coalesce(F.avg(c), F.lit(0.0)), n)
    return results.agg(F.count("*").alias("total"), mean(F.col("is_hit").cast("double"), 4).alias("hit_rate"), mean("confidence", 4).alias("avg_confidence"), mean("latency_ms", 2).alias("avg_latency_ms"))


def eval_rows(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """A result row for each query; queries without an answer have zeros and empty fields.

    Hits are judged on whole answers; what is shown of answers and references is cut to 200 characters.
    """
    j = queries.join(answers.select("query_id", "predicted_answer", "confidence", "latency_ms", "cited"), "query_id", "left")
    rows = j.select(
        "query_id", "query", F.col("answer").alias("reference"), F.coalesce("predicted_answer", F.lit("")).alias("predicted_answer"),
        T.fixed(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"), T.fixed(F.coalesce("latency_ms", F.lit(0.0)), 2).alias("latency_ms"),
        F.coalesce(F.array_join("cited", "|"), F.lit("")).alias("cited_chunks"), "difficulty",
    )
    return answer_hit(rows).withColumns({c: F.substring(c, 1, 200) for c in ("reference", "predicted_answer")})


def token_prf(rows: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """rows with precision, recall and exact over distinct tokens; both empty: 1 and 1, one empty: 0 and 0."""
    p, r = (F.array_distinct(T.terms(F.coalesce(c, F.lit("")))) for c in (pred, ref))
    j = rows.withColumns({"_p": p, "_r": r}).withColumn("_c", F.size(F.array_intersect("_p", "_r")))
    share = lambda side: F.when((F.size("_p") == 0) & (F.size("_r") == 0), 1.0).when((F.size("_p") == 0) | (F.size("_r") == 0), 0.0).otherwise(F.col("_c") / F.size(side))
    exact = T.strip(F.coalesce(pred, F.lit(""))) == T.strip(F.coalesce(ref, F.lit("")))
    return j.withColumns({"precision": share("_p"), "recall": share("_r"), "exact": exact}).drop("_p", "_r", "_c")


def bucket_metrics(rows: DataFrame) -> DataFrame:
    """(bucket, n, precision, recall, f1, exact_match) of each difficulty and overall; F1 is that of the means."""
    grouped = rows.rollup("difficulty").agg(F.grouping("difficulty").alias("all"), F.count("*").alias("n"), F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg(F.col("exact").cast("double")).alias("e"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    name = F.when(F.col("all") == 1, "overall").otherwise(F.col("difficulty"))
    return grouped.select(name.alias("bucket"), "n", *(T.fixed(c, 4).alias(a) for c, a in ((F.col("p"), "precision"), (F.col("r"), "recall"), (f1, "f1"), (F.col("e"), "exact_match"))))


def bucket_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("difficulty").agg(F.count("*").alias("n"))


def error_category(rows: DataFrame) -> DataFrame:
    """rows (predicted, reference, n_hits, confidence) with category."""
    chars = lambda c, n: F.array_distinct(F.filter(F.split(F.substring(F.coalesce(c, F.lit("")), 1, n), ""), lambda x: x != ""))
    ref = chars("reference", 50)
    share = F.when(F.size(ref) > 0, F.size(F.array_intersect(ref, chars("predicted", 100))) / F.size(ref)).otherwise(0.0)
    short = F.length(F.coalesce("predicted", F.lit(""))) < 5
    return rows.withColumn("category", F.when(short, "generation_error").when(F.col("n_hits") == 0, "no_evidence").when(F.col("confidence") < 0.3, "low_confidence").when(share < 0.3, "wrong_evidence").otherwise("correct"))


def error_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, query, reference, predicted, difficulty, tags, n_hits, avg_score, confidence, category, description).

    The best text, cut to 200, is the answer; texts are shown up to 100 characters, tags joined. queries has query_id,
    query, answer, difficulty and tags.
    """
    agg = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.avg("score").alias("avg"), F.min_by(F.substring("text", 1, 200), "rank").alias("predicted"), F.min_by("score", "rank").alias("confidence"))
    j = queries.select("query_id", "query", F.col("answer").alias("reference"), "difficulty", F.array_join("tags", "|").alias("tags")).join(agg, "query_id", "left")
    j = j.withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "predicted": F.coalesce("predicted", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "avg_score": T.fixed(F.coalesce("avg", F.lit(0.0)), 4)})
    told = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))[F.col("category")]
    shown = [F.substring(c, 1, 100).alias(c) for c in ("query", "reference", "predicted")]
    return error_category(j).select("query_id", *shown, "difficulty", "tags", "n_hits", "avg_score", T.fixed(F.col("confidence"), 4).alias("confidence"), "category", told.alias("description"))


def error_summary(rows: DataFrame) -> DataFrame:
    """(category, n, percent) of every category, those without rows too, and the total."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counted = rows.groupBy("category").agg(F.count("*").alias("c"))
    j = names.join(counted, "category", "left").select("category", F.coalesce("c", F.lit(0)).alias("n"))
    total = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("category"), "n")
    both = j.union(total).withColumn("_one", F.lit(1))
    whole = total.select(F.col("n").alias("all"), F.lit(1).alias("_one"))
    return both.join(F.broadcast(whole), "_one").select("category", "n", T.fixed(F.when(F.col("all") > 0, 100.0 * F.col("n") / F.col("all")).otherwise(0.0), 2).alias("percent"))


def grid_search(docs: DataFrame, queries: DataFrame, sizes: list[int], overlaps: list[int], ks: list[int]) -> DataFrame:
    """(config, chunk_size, overlap, top_k, hit_rate, avg_score, n_chunks) of every size, overlap < size and k.

    Documents are read and cut into terms once; all settings are counted and ranked from the places of these terms.
    """
    pairs = [(s, o) for s in sizes for o in overlaps if o < s]
    placed = store({"placed": sweep.placed_terms(spread(docs.select("doc_id", "text")))})["placed"]
    counts = sweep.counted(placed, pairs)
    weighed, lengths = sweep.weights(counts, queries)
    hits = sweep.ranked(placed, pairs, weighed, lengths, max(ks))
    spark = docs.sparkSession
    grid = spark.createDataFrame([(n, s, o, k) for n, (s, o) in enumerate(pairs) for k in ks], "pair int, chunk_size int, overlap int, top_k int")
    ranked = hits.join(F.broadcast(grid.select("pair", "top_k")), "pair").where(F.col("rank") <= F.col("top_k"))
    words = queries.select("query_id", answer_words(F.col("answer")).alias("words"))
    told = ranked.join(words, "query_id").select("pair", "top_k", "query_id", F.exists("words", lambda w: F.contains(F.col("text"), w)).alias("hit"), F.when(F.col("rank") == 1, F.col("score")).alias("top"))
    per = told.groupBy("pair", "top_k", "query_id").agg(F.max(F.col("hit").cast("int")).alias("hit"), F.max("top").alias("top")).groupBy("pair", "top_k").agg(F.sum("hit").alias("hits"), F.sum("top").alias("tops"))
    n_queries = queries.select("query_id").agg(F.count("*").alias("n_queries"), F.lit(1).alias("_one"))
    out = grid.join(per, ["pair", "top_k"], "left").join(counts.where("term is null").select("pair", F.col("n").alias("n_chunks")), "pair", "left").withColumn("_one", F.lit(1)).join(F.broadcast(n_queries), "_one")
    rate = lambda c: T.fixed(F.coalesce(F.col(c) / F.col("n_queries"), F.lit(0.0)), 4)
    config = F.concat_ws("_", "chunk_size", "overlap", "top_k")
    return out.select(config.alias("config"), "chunk_size", "overlap", "top_k", rate("hits").alias("hit_rate"), rate("tops").alias("avg_score"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def best_config(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("hit_rate"), "chunk_size", "overlap", "top_k").limit(1)


def ablation(queries: DataFrame, rankings: dict[str, DataFrame], chunks: DataFrame, k: int = 5) -> DataFrame:
    """(config, hit_rate, avg_top_score, n_queries) of several rankings (query_id, doc_id, chunk_index, score, rank)."""
    tagged = reduce(DataFrame.unionByName, [h.where(F.col("rank") <= k).select(F.lit(n).alias("config"), "query_id", "doc_id", "chunk_index", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank")) for n, h in rankings.items()])
    names = queries.sparkSession.createDataFrame([(n,) for n in rankings], "config string").withColumn("_one", F.lit(1))
    asked = queries.select("query_id", "answer", F.lit(1).alias("_one")).join(F.broadcast(names), "_one").drop("_one")
    texts = tagged.join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    told = hit_at_k(texts, asked, k, ["config", "query_id"])
    top = tagged.where("rank = 1").select("config", "query_id", "score")
    return told.join(top, ["config", "query_id"], "left").groupBy("config").agg(T.fixed(F.avg(F.col("is_hit").cast("double")), 4).alias("hit_rate"), T.fixed(F.avg(F.coalesce("score", F.lit(0.0))), 4).alias("avg_top_score"), F.count("*").alias("n_queries"))
