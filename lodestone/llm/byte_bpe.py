"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Every UTF-8 byte stands as one printable character in the vocabulary. Ids are decoded by mapping each token's characters
back to bytes and joining the bytes, so characters that are split over tokens come out whole.
"""

from __future__ import annotations

import json
import os
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty


#: Pieces whose ids a worker remembers (about 60 MB), and the longest of them in code points.
MOST_PIECES, PIECE_CHARS = 200_000, 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def _split(ids: list[int], at: int) -> Iterator[list[int]]:
    start = 0
    for k, x in enumerate(ids):
        if x == at:
            yield ids[start:k]
            start = k + 1
    yield ids[start:]


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        back = {c: b for b, c in enumerate(byte_characters())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        import public_tokenizers

        self.pieces = regex.compile(public_tokenizers.PATTERN).findall  # covers every character of a text
        self.known: dict[str, list[int]] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes: list[bytes | None] = [None] * size
        for token, k in spec["model"]["vocab"].items():
            self.bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for t in spec.get("added_tokens", []):
            self.bytes[t["id"]] = t["content"].encode()

    def encode(self, texts: list[str], offsets: bool) -> list[tuple[list[int], list[tuple[int, int]] | None]]:
        batch = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        return [(e.ids, e.offsets if offsets else None) for e in batch(texts, add_special_tokens=False)]

    def encode_pieces(self, text: str) -> list[int]:
        """The ids of a text, each piece between the vocabulary's split points encoded by the library once.

        Merges never cross pieces, and a piece alone splits as it does in its text.
        """
        pieces, known = self.pieces(text), self.known
        if len(known) > MOST_PIECES:
            known.clear()
        new = [p for p in set(pieces) if p not in known]
        own = known
        if new:
            # words go in one text with a line feed, always a piece of its own there, between them; others go alone
            words = [p for p in new if p.lstrip(" ").isalpha()]
            others = [p for p in new if not p.lstrip(" ").isalpha()]
            line_feed, *batch = self.tokenizer.encode_batch_fast(["\n", *others, "\n".join(words)], add_special_tokens=False)
            got = dict(zip(others, (e.ids for e in batch), strict=False))
            if words:
                got.update((p, ids) for p, ids in zip(words, _split(batch[-1].ids, line_feed.ids[0]), strict=True))
            known.update((p, ids) for p, ids in got.items() if len(p) <= PIECE_CHARS)
            if any(len(p) > PIECE_CHARS for p in new):
                own = ChainMap(known, got)
        return list(chain.from_iterable(map(own.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes
        return b"".join([table[k] for k in ids])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, vocabulary: str | None = None, *, offsets: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids, and starts and ends of tokens in code points (null without offsets).

    A token that is part of a split character has that character's span. Null counts as empty and has no tokens. Only the
    two named columns are read. vocabulary is a path that every executor can read.
    """
    path, kind = vocabulary or default_vocabulary(), docs.schema[id_col].dataType.simpleString()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        got = codec(path).encode(b.column(1).to_pylist(), offsets)
        ints = pa.list_(pa.int32())
        spans = [pa.array([[o[k] for o in g[1]] if offsets else None for g in got], ints) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], ints), *spans], [id_col, "ids", "starts", "ends"])

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, one, f"{id_col} {kind}, ids array<int>, starts array<int>, ends array<int>", batch_bytes=2 << 20)


def decode_ids(encoded: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, decoded (bytes). Null ids decode to no bytes; an unknown id raises."""
    path, kind = vocabulary or default_vocabulary(), encoded.schema[id_col].dataType.simpleString()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], [id_col, "decoded"])

    return arrow_map(encoded.select(id_col, ids_col), one, f"{id_col} {kind}, decoded binary", batch_bytes=2 << 20)


def round_trip(docs: DataFrame, vocabulary: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids, decoded: encodes and decodes in one pass, so rows cross to Python once."""
    path, kind = vocabulary or default_vocabulary(), docs.schema[id_col].dataType.simpleString()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode_pieces(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], [id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return arrow_map(rows, one, f"{id_col} {kind}, ids array<int>, decoded binary", batch_bytes=2 << 20)
