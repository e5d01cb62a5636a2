"""Reading corpora and query sets; writing index tables, graphs and results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_TABLES = ("chunks", "postings", "chunk_len", "corpus_stats", "term_stats", "vectors", "nodes", "edges", "meta")
_CLEARED: set[str] = set()
QUERY_SCHEMA = "query string, answer string, reasoning_chain array<string>, difficulty string, tags array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of few files dealt over all cores; what comes in many parts already stays as it is, unshuffled."""
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, doc_id, text): each file is one document, an empty one none; doc_id is a hash of its path."""
    files = spark.read.text(path, wholetext=True)
    source = F.col("_metadata.file_path")
    return files.select(source.alias("source"), F.xxhash64(source).alias("doc_id"), F.col("value").alias("text"))


def read_queries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON lines; blank lines are skipped, missing fields are empty and the difficulty unknown."""
    rows = spark.read.schema(QUERY_SCHEMA).json(paths).where("query is not null or answer is not null")
    none = F.array().cast("array<string>")
    return rows.select(F.coalesce("query", F.lit("")).alias("query"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("reasoning_chain", none).alias("reasoning_chain"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("tags", none).alias("tags"))


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table for each. Postings are rows here, dealt as they were counted; blockmax keeps them in blocks by term bucket."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else what setCheckpointDir() was given.

    Where the session names none, a local master gets a temporary folder by setCheckpointDir(); any other raises.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        at = sc.getCheckpointDir()
    return at


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, for all that its jobs store; deleted when the application ends, or by clear_work()."""
    app = spark.sparkContext.applicationId
    if app not in _CLEARED:
        _CLEARED.add(app)
        atexit.register(_clear_at_end, spark, app)
    return f"{shared_dir(spark)}/lodestone-{app}"


def _clear_at_end(spark: SparkSession, app: str) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        clear_work(spark)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_work(spark: SparkSession) -> None:
    """Deletes what this application's jobs have stored; DataFrames that read it can't be read any longer."""
    delete(spark, work_dir(spark))


def store(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables written to a new folder of the shared one, and read again from there: built once, used often."""
    spark = next(iter(tables.values())).sparkSession
    path = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    write_index(tables, path)
    return {n: spark.read.schema(df.schema).parquet(f"{path}/{n}") for n, df in tables.items()}


def load_index(spark: SparkSession, path: str, names: tuple[str, ...] = INDEX_TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


#: How CSV is written and read: every value in quotes, doubled inside, white space and line feeds kept; null is \N, so that
#: an empty text stays one (a text that is \N itself reads as null).
_CSV = {"header": True, "nullValue": "\\N", "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables as CSV, with arrays as JSON text."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        write_results_csv(df.withColumn("ord", F.to_json("ord")), f"{path}/{name}")


def write_results_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def read_results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_results_csv() has written."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True, lineSep="\n").csv(path)
