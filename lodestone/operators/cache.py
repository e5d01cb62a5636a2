"""Search results that are kept between runs, by query text, number of hits and version of the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import store
from .index import KEY
from .retrieval import dedupe_queries


def _table(spark, path: str, at: str, schema: str) -> DataFrame:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{at}")
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    return spark.read.schema(schema).parquet(f"{path}/{at}") if there else spark.createDataFrame([], schema)


def cached_search(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, version: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits of all queries: query_id, key, score, rank; the queries that had to be scored: query_id, query).

    search takes distinct queries (query_id, query) and gives their first k hits. What it gives is stored under path, by
    version and k, with a row of rank 0 for each query that was asked, so that one without hits isn't asked again. Texts
    are told apart whole; a new version of the index has a folder of its own and scores everything.
    """
    spark = queries.sparkSession
    at = f"version={version}/k={k}"
    kinds = "query string, doc_id bigint, chunk_index int, score double, rank int"
    first, _ = dedupe_queries(queries.select("query_id", "query"))
    asked_before = _table(spark, path, at, kinds).where("rank = 0").select("query").distinct()
    # stored before the cache grows, since it is read from there
    new = store({"new": first.join(asked_before, "query", "left_anti").select("query_id", "query")})["new"]
    if new.head(1):
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("chunk_index", "int"), ("score", "double"))]
        found = search(new).join(new, "query_id").select("query", *KEY, "score", F.col("rank").cast("int").alias("rank"))
        found.union(new.select("query", *none, F.lit(0).alias("rank"))).write.mode("append").parquet(f"{path}/{at}")
    kept = _table(spark, path, at, kinds).where("rank > 0").dropDuplicates(["query", "rank"])  # two runs at once may both have asked
    return queries.select("query_id", "query").join(kept, "query").select("query_id", *KEY, "score", "rank"), new
