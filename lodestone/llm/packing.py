"""Packing of documents into sequences of a fixed number of tokens: best fit, then local search by moves and swaps.

A document's ids, with an end id behind them, are one piece; only longer ones are cut, into full pieces and a rest. Full
pieces are sequences of their own. The others are dealt at random to blocks of about BLOCK pieces, so that a task holds a
bounded number whatever their texts or ids are. A block is packed by best fit, longest first, and searched: pieces of an
emptier sequence move into fuller ones, one for none, one for one, or two for one, each step raising the sum of squared
fills, until sequences are empty. What each block has least filled, up to a quarter of its pieces, meets that of other
blocks in a next round of a quarter as many blocks; the last round has one block.

Null texts count as empty and give one piece, the end id. Repeated rows and ids, null ids and ties each are documents of
their own; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import schema_text
from .common import SPACES, arrow_map, materialize, text_or_empty

SIZE, END = 2048, 0
#: Pieces of a block; the share of them that meets others again; rounds of local search over a block's sequences.
BLOCK, SHARE, PASSES = 8192, 4, 8
#: Words whose ids a worker keeps, the longest of them, and words that the library encodes at a time.
KNOWN, LONGEST, TOGETHER = 800_000, 64, 4096
#: Letters that have one lower-case form and never join what stands before or behind them, and signs that end words.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


# ---- ids


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and matches nothing across it, so each word is encoded once.

    It also drops case, and signs behind a word's letters are apart from them, so words are encoded without both.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids; many go as one text, a line feed between them, and offsets tell whose a token is."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            got = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in some)])
            cuts = 4 * np.searchsorted([o[0] for o in got.offsets], starts) if got.ids else 0 * starts
            ids = np.array(got.ids, dtype="<u4").tobytes()
            yield from ((w, ids[a:b]) for w, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of 32 bits."""
        words = []
        for t in texts:
            for space in SPACES[1:]:
                t = t.replace(space, " ")
            words.append(t.split(" "))
        if len(self.known) > KNOWN:
            self.known = {}
        known: dict[str, bytes] | ChainMap = self.known
        new = set().union(*words).difference(known)
        parts = {w: (m[1].lower(), m[2]) if (m := _WORD.fullmatch(w)) else (w, "") for w in new}
        found = dict(self.words(list(set().union(*parts.values()).difference(known))))
        if max(map(len, found), default=0) > LONGEST:
            known.update((w, i) for w, i in found.items() if len(w) <= LONGEST)
            known = ChainMap({w: i for w, i in found.items() if len(w) > LONGEST}, known)
        else:
            known.update(found)
        for w, (letters, signs) in parts.items():
            known[w] = known[letters] + known[signs]
        return [b"".join(map(known.__getitem__, ws)) for ws in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of each document with the digest of their ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        at, rows, last = [], [], np.array([end], dtype="<u4").tobytes()
        for n, ids in enumerate(encoder(path).texts(b["_text"].to_pylist())):
            ids += last
            for piece, start in enumerate(range(0, len(ids), 4 * size)):
                part = ids[start : start + 4 * size]
                at.append(n)
                rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
        piece, start, length, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([b[id_col].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], [id_col, "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col(id_col), text_or_empty(col).alias("_text")), cut, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---- one block


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the bin that it leaves the least room in."""
    bins, free_bins, open_rooms, made = np.empty(len(lengths), dtype=np.int64), [[] for _ in range(size + 1)], 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        fits = open_rooms >> length
        if fits:  # the lowest bit is the smallest room that fits
            room = length + (fits & -fits).bit_length() - 1
            b = free_bins[room].pop()
            if not free_bins[room]:
                open_rooms ^= 1 << room
        else:
            room, b, made = size, made, made + 1
        bins[i], room = b, room - length
        if room:
            free_bins[room].append(b)
            open_rooms |= 1 << room
    return bins


def fewest(lengths: np.ndarray, size: int) -> int:
    """No packing has fewer bins: all tokens must fit, and no two pieces longer than half share one."""
    return max(-(-int(lengths.sum()) // size), int((2 * lengths > size).sum()))


class Search:
    """Local search over the bins of a block."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, size: int):
        self.size, self.lengths, self.bins = size, lengths, bins.copy()
        self.fill = np.bincount(bins, weights=lengths).astype(np.int64)

    def step(self, giver: int) -> bool:
        """The exchange with giver that raises the sum of squared fills most, made; False where none does.

        It gives one piece or two together; the other bin gives none or one that is shorter by no more than its room.
        """
        own = np.flatnonzero(self.bins == giver)
        if not len(own):
            return False
        size, filled = self.size, int(self.fill[giver])
        ones = dict(zip(self.lengths[own].tolist(), ((int(i),) for i in own), strict=True))
        order = own[np.argsort(self.lengths[own], kind="stable")]
        # of equal lengths, two are enough to make every sum of two
        few = [int(i) for k, i in enumerate(order) if k < 2 or self.lengths[order[k - 2]] != self.lengths[i]]
        twos = {int(self.lengths[i] + self.lengths[j]): (i, j) for k, i in enumerate(few) for j in few[k + 1 :] if self.lengths[i] + self.lengths[j] <= size}
        given = twos | ones
        offers = np.array(sorted(given), dtype=np.int64)
        others = np.flatnonzero((self.fill < size) & (self.fill > 0))
        others = others[others != giver]
        back = np.flatnonzero((self.fill[self.bins] < size) & (self.bins != giver))
        to = np.concatenate([others, self.bins[back]])
        returned = np.concatenate([np.zeros(len(others), dtype=np.int64), self.lengths[back]])
        if not len(to):
            return False
        at = np.searchsorted(offers, returned + size - self.fill[to], side="right") - 1
        gain = np.where(at >= 0, offers[at] - returned, 0)
        raised = np.where(gain > 0, gain * (self.fill[to] + gain - filled), 0)
        best = int(np.argmax(raised))
        if raised[best] <= 0:
            return False
        self.bins[list(given[int(offers[at[best]])])] = to[best]
        if best >= len(others):
            self.bins[back[best - len(others)]] = giver
        self.fill[to[best]] += gain[best]
        self.fill[giver] -= gain[best]
        return True

    def run(self, passes: int) -> np.ndarray:
        """Bins after up to `passes` rounds, each from the emptiest bin up; it ends where no fewer bins are possible or a round frees none."""
        least = fewest(self.lengths, self.size)
        for _ in range(passes):
            before = int((self.fill > 0).sum())
            if before <= least:
                break
            for giver in np.argsort(self.fill, kind="stable"):
                if 0 < self.fill[giver] < self.size:
                    while self.fill[giver] and self.step(int(giver)):
                        pass
                    if not self.fill[giver] and int((self.fill > 0).sum()) <= least:
                        break
            if int((self.fill > 0).sum()) == before:
                break
        return self.bins


def pack_block(lengths: np.ndarray, size: int = SIZE, passes: int = PASSES) -> np.ndarray:
    """The bin of each piece, bins numbered from 0 without gaps."""
    bins = Search(lengths, best_fit(lengths, size), size).run(passes)
    return np.unique(bins, return_inverse=True)[1].reshape(-1)


def hand_on(lengths: np.ndarray, bins: np.ndarray, size: int, most: int) -> np.ndarray:
    """Which pieces meet others again: those of the least filled bins, emptiest first, while they are no more than `most`; full bins stay."""
    fill, count = np.bincount(bins, weights=lengths), np.bincount(bins)
    order = np.argsort(fill, kind="stable")
    chosen = order[(np.cumsum(count[order]) <= most) & (fill[order] < size)]
    return np.isin(bins, chosen)


# ---- all blocks


def _pack_blocks(rows: DataFrame, size: int, share: int, passes: int) -> DataFrame:
    """rows (block, row, length ...) with the bin of each in its block, its place there, and whether it meets others again; blocks of share 1 keep all."""
    schema = schema_text(rows, "bin bigint", "offset bigint", "again boolean")

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("row", ignore_index=True)
        lengths = b["length"].to_numpy()
        bins = pack_block(lengths, size, passes)
        again = hand_on(lengths, bins, size, len(b) // share) if share > 1 else np.zeros(len(b), dtype=bool)
        order = np.argsort(bins, kind="stable")
        before = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        first = np.searchsorted(bins[order], bins[order], side="left")
        offset = np.empty(len(b), dtype=np.int64)
        offset[order] = before - before[first]
        return b.assign(bin=bins, offset=offset, again=again)

    return rows.groupBy("block").applyInPandas(pack, schema)


def pack_pieces(pieces: DataFrame, size: int = SIZE, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """pieces (length up to size) with sequence_id and offset. Each round's rows are stored, so a lost executor costs one round's tasks."""
    own = [c for c in pieces.columns]
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done = [rows.where(F.col("length") >= size).select(*own, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    part = rows.where(F.col("length") < size)
    blocks = max(1, -(-part.count() // block))
    turn = 0
    while True:
        dealt = part.withColumn("block", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(blocks)))
        packed = materialize(_pack_blocks(dealt, size, SHARE if blocks > 1 else 1, passes), f"packed-{turn}")
        # bins are fewer than 2^15 a block, turns fewer than 2^6
        sequence = (F.col("block") * (1 << 15) + F.col("bin")) * (1 << 6) + turn
        done.append(packed.where(~F.col("again")).select(*own, sequence.alias("sequence_id"), "offset"))
        if blocks == 1:
            return reduce(DataFrame.unionByName, done)
        part, blocks, turn = packed.where("again").select(*own, "row"), -(-blocks // SHARE), turn + 1


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece; path is a file of the tokenizers library."""
    return pack_pieces(cut_pieces(docs, path, size, end, id_col, col), size)
