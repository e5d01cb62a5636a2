"""What the operators share: written cut points, table reading, word arrays and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete, table, work_dir  # noqa: F401  table: for the queries and the pipeline

#: Fixed value: the white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch between Spark and Python.
ARROW_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read again from there."""
    return _write(df, f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Cut points that one job needs until it is done, in a folder of its own that remove() deletes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, f"{work_dir(spark)}/work-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
        """The rows as a table, read again from there; the table that it stands instead of is deleted."""
        path = f"{self.path}/{name}-{len(self.tables)}"
        out = _write(df, path)
        self.tables[path] = out
        for p, t in self.tables.items():
            if t is instead_of:
                delete(self.spark, p)
        return out

    def remove(self) -> None:
        delete(self.spark, self.path)


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is among gone, a written table with the single column _gone.

    Rows and ids meet by one shuffle on the id, whatever their number; null ids stay.
    """
    return docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone["_gone"], "left_anti")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def words_of(col: Column) -> Column:
    """The runs of characters other than SPACES, in order; an empty array where there are none."""
    return F.filter(F.split(col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def arrow_map(df: DataFrame, fn, schema: str, *, batch_bytes: int = 16 << 20) -> DataFrame:
    """mapInArrow with batches cut by bytes, so that very long texts cannot pile up in one batch.

    fn takes and returns a pyarrow.RecordBatch. Batches are bounded by ARROW_BYTES on Spark's side too, by a setting that
    the session keeps, as rows are read when the caller asks for them. What pyarrow kept for reuse goes back at the end
    of a task, as workers live on for other stages.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in split_batch(b, batch_bytes):
                out = fn(part)
                if out is not None:
                    yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= most:
        if n:
            yield batch
        return
    yield from split_batch(batch.slice(0, n // 2), most)
    yield from split_batch(batch.slice(n // 2), most)
