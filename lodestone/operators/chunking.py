"""Chunks of documents: character and token windows, sentences, and segments of similar sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources.tables import store


def _indexed(docs: DataFrame, key: list[str], pieces: Column) -> DataFrame:
    """Explodes non-blank pieces (structs with text); blank ones take no index."""
    kept = F.filter(pieces, lambda p: ~T.is_blank(p["text"]))
    rows = docs.select(*key, F.posexplode(kept).alias("chunk_index", "p"))
    return rows.select(*key, "chunk_index", F.format_string("chunk_%04d", "chunk_index").alias("chunk_id"), "p.*")


def chunk_chars(docs: DataFrame, size: int = 512, overlap: int = 64, key: list[str] | None = None) -> DataFrame:
    """Windows of `size` characters: key, chunk_index, chunk_id, text, start_char, end_char. Blank and null texts have none."""
    T.check_window(size, overlap)
    return _indexed(docs.where(~T.is_blank(F.col("text"))), key or ["doc_id"], T.char_windows(F.col("text"), size, overlap))


#: Tokens of a batch that goes back to Spark.
TOKEN_ROWS = 1 << 16
#: Chunks of a batch that goes back to Spark.
FOLD_ROWS = 1 << 12


def tokenize_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, token, start, end: tokens with their places in code points. A text streams through in batches of tokens, whatever its length."""
    find = re.compile(T.TOKEN.replace("x{4e00}", "u4e00").replace("x{9fff}", "u9fff")).finditer
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, ...] = ([], [], [], [], [])

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32())], [key, "pos", "token", "start", "end"])
            for r in rows:
                r.clear()
            return made

        for b in batches:
            keys = b.column(0)
            for n in range(b.num_rows):
                for pos, m in enumerate(find(b.column(1)[n].as_py() or "")):
                    for r, v in zip(rows, (n, pos, m.group(), m.start(), m.end()), strict=True):
                        r.append(v)
                    if len(rows[0]) >= TOKEN_ROWS:
                        yield sent()
            if rows[0]:
                yield sent()

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, pos int, token string, start int, end int")


def chunk_tokens(docs: DataFrame, size: int = 512, overlap: int = 64, key: str = "doc_id") -> DataFrame:
    """Windows of `size` tokens; a chunk's text is the slice of the document from its first token to its last."""
    T.check_window(size, overlap, "token")
    return _indexed(docs.where(~T.is_blank(F.col("text"))), [key], T.token_windows(F.col("text"), size, overlap))


def split_sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, text."""
    return docs.select(key, F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


#: Sentences of a block. A document's sentences are dealt by block, so that a long one takes many tasks.
BLOCK = 4096


def adjacent_similarity(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """sentences (key, pos, embedding ...) with similarity to the next one; null at the last.

    pos counts a document's sentences from 0 without gaps. Each block also gets the next block's first sentence, so that
    no window spans a document.
    """
    block = F.floor(F.col("pos") / BLOCK)
    blocks = F.when((F.col("pos") % BLOCK == 0) & (F.col("pos") > 0), F.array(block, block - 1)).otherwise(F.array(block))
    own = Window.partitionBy(key, "_b").orderBy("pos")
    both = sentences.select("*", F.explode(blocks).alias("_b"))
    similarity = F.when(F.lead("pos").over(own).isNotNull(), T.fixed(cosine(F.col("embedding"), F.lead("embedding").over(own))))
    return both.withColumn("similarity", similarity).where(F.col("_b") == block).drop("_b")


def semantic_segments(sentences: DataFrame, threshold: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Runs of sentences (key, pos, text, embedding) between drops of similarity: key, segment, text.

    Drops are counted block by block; what earlier blocks of a document count is added to each, one row a block. Sentences
    and drops are stored once, so that no embedding is made twice.
    """
    ends = adjacent_similarity(sentences, key).select(key, "pos", "text", F.floor(F.col("pos") / BLOCK).alias("_b"), F.coalesce((F.col("similarity") < threshold).cast("int"), F.lit(0)).alias("ends"))
    ends = store({"ends": ends})["ends"]
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = ends.groupBy(key, "_b").agg(F.sum("ends").alias("n")).select(F.col(key).alias("_k"), F.col("_b").alias("_o"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(key, "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = ends.withColumn("inside", F.coalesce(F.sum("ends").over(inside), F.lit(0)))
    marked = marked.join(offset, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_o"))).withColumn("segment", F.col("offset") + F.col("inside"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]))
    return marked.groupBy(key, "segment").agg(T.strip(joined).alias("text"))


def fold_stream(segments: Iterable[str], smallest: int, largest: int) -> Iterator[str]:
    """Segments joined until they have `smallest` characters, and cut into pieces of `largest`; blank ones are left out.

    Holds what is not settled yet and the chunk before it, which a short rest is joined to; never a whole document.
    """
    held = ""
    last: str | None = None

    def settle(text: str) -> tuple[list[str], str]:
        cuts = max(-(-len(text) // largest) - 1, 0)
        return [text[k * largest : (k + 1) * largest] for k in range(cuts)], text[cuts * largest :]

    for s in segments:
        full = len(held) >= smallest
        done, rest = settle(s if full else held + s)
        for d in ([held] if full else []) + done:
            if last is not None and last.strip():
                yield last
            last = d
        held = rest
    end = [held] if held else []
    if held and len(held) < smallest and last is not None:
        done, rest = settle(last + held)
        last, end = None, [*done, rest]
    for d in ([] if last is None else [last]) + end:
        if d.strip():
            yield d


def fold_sizes(segments: list[str], smallest: int, largest: int) -> list[str]:
    """fold_stream() of a list."""
    return list(fold_stream(segments, smallest, largest))


def enforce_chunk_sizes(segments: DataFrame, smallest: int = 100, largest: int = 1024, key: str = "doc_id") -> DataFrame:
    """Segments (key, segment, text) folded in order: key, chunk_index, chunk_id, text. Empty and null segments count nothing.

    Sorted by key and segment, they stream through the fold, which goes on from one Arrow batch to the next; no task
    holds a document's segments at once.
    """
    kind = segments.schema[key].dataType.simpleString()
    types = (to_arrow_type(segments.schema[key].dataType), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
        made: list[tuple] = []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], [key, "chunk_index", "text"])
            made.clear()
            return out

        for k, own in groupby(rows, lambda r: r[0]):
            for n, text in enumerate(fold_stream((t for _, t in own if t), smallest, largest)):
                made.append((k, n, text))
                if len(made) >= FOLD_ROWS:
                    yield sent()
        if made:
            yield sent()

    ordered = segments.select(key, "segment", "text").repartition(key).sortWithinPartitions(key, "segment")
    rows = ordered.mapInArrow(run, f"`{key}` {kind}, chunk_index int, text string")
    return rows.select(key, "chunk_index", F.format_string("chunk_%04d", "chunk_index").alias("chunk_id"), "text")


def chunk_semantic(docs: DataFrame, embed, threshold: float = 0.5, smallest: int = 100, largest: int = 1024, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, chunk_id, text, sentence_count, char_count.

    A text of one sentence or of up to `smallest` characters is one chunk, with its number of sentences. embed adds an
    embedding to rows (key, pos, text).
    """
    rows = docs.where(~T.is_blank(F.col("text"))).select(key, "text", F.size(T.sentences(F.col("text"))).alias("n"))
    short = (F.col("n") <= 1) | (F.length("text") <= smallest)
    whole = rows.where(short).select(key, F.lit(0).alias("chunk_index"), F.lit("chunk_0000").alias("chunk_id"), T.strip(F.col("text")).alias("text"), F.col("n").alias("sentence_count"), F.lit(None).cast("int").alias("char_count"))
    parts = enforce_chunk_sizes(semantic_segments(embed(split_sentences(rows.where(~short), key)), threshold, key), smallest, largest, key)
    return whole.unionByName(parts.select("*", F.lit(None).cast("int").alias("sentence_count"), F.length("text").alias("char_count")))
