"""Quality of whole texts by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector w over hashed text features, shared by all grades, and
ordered thresholds t_1 < t_2 < ... From it come the expected grade and the tail probability by which texts are selected.

Features are hashed counts of byte n-grams of the text and of its shape (letters by case, digits, other signs), and how
often a word repeats the one before it, all computed with numpy over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty

#: Hash buckets of shape n-grams and of byte n-grams, and the numbers after them.
SHAPES, GRAMS, EXTRA = 1024, 2048, 6
DIM = SHAPES + GRAMS + EXTRA
#: A text is read in windows of so many bytes, so that memory doesn't follow its length.
WINDOW = 1 << 20
MOST_GRADES = 100
_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _classes() -> np.ndarray:
    c = np.arange(256, dtype=np.uint8)
    c[ord("A") : ord("Z") + 1] = ord("A")
    c[ord("a") : ord("z") + 1] = ord("a")
    c[ord("0") : ord("9") + 1] = ord("0")
    c[128:] = ord("a")
    c[[9, 10, 11, 12, 13]] = 32
    return c


_CLASS, _LOWER = _classes(), np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashed(b: np.ndarray, n: int, dim: int, out: np.ndarray) -> None:
    if len(b) < n:
        return
    h = np.zeros(len(b) - n + 1, np.uint32)
    for k in range(n):
        h += b[k : len(b) - n + 1 + k] * _P[k]
    h ^= h >> np.uint32(15)
    h *= _P[0]
    out += np.bincount(h >> np.uint32(32 - int(dim).bit_length() + 1), minlength=dim)


def features(text: bytes) -> np.ndarray:
    """float32 vector of DIM features; all zero but the length's for an empty text.

    Windows end before a word, and n-grams and neighbours reach over their edges, so they don't show in the features; but
    a word longer than a window counts as several.
    """
    shapes, grams = np.zeros(SHAPES), np.zeros(GRAMS)
    extra = np.zeros(EXTRA, np.float32)
    again = words = letters = upper = runs = 0
    last_runs, last_word, start = np.zeros(0, np.uint32), np.zeros(0, np.uint32), 0
    while start < len(text):
        b = np.frombuffer(text, np.uint8, min(WINDOW, len(text) - start), start)
        c = _CLASS[b]
        if start + len(b) < len(text):
            inside = np.flatnonzero((c[:-1] == 32) & (c[1:] != 32))
            if len(inside):
                b, c = b[: inside[-1] + 1], c[: inside[-1] + 1]
        edge = np.flatnonzero(np.diff(c) != 0)
        run = c[np.concatenate([edge, [len(c) - 1]])].astype(np.uint32)
        runs += len(run)
        run = np.concatenate([last_runs, run])
        _hashed(run, 3, SHAPES, shapes)
        last_runs = run[-2:]
        # n-grams that begin in the two bytes before
        back = min(2, start)
        _hashed(_LOWER[np.frombuffer(text, np.uint8, len(b) + back, start - back)].astype(np.uint32), 3, GRAMS, grams)
        start += len(b)
        low = _LOWER[b].astype(np.uint32)
        letters += int((c == 97).sum() + (c == 65).sum())
        upper += int((c == 65).sum())
        # words by a hash of their bytes: how many equal the one before
        space = c == 32
        begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(begin):
            offset = np.arange(len(low)) - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.append(begin, len(low))))])
            mixed = (low + np.uint32(1)) * (offset.astype(np.uint32) * _P[1] + _P[2])
            mixed[space] = 0
            word = np.add.reduceat(mixed, begin)
            words += len(word)
            word = np.concatenate([last_word, word])
            again += int((word[1:] == word[:-1]).sum())
            last_word = word[-1:]
    norm = lambda v: np.sqrt(v / max(v.sum(), 1.0))
    extra[:] = [again / max(words - 1, 1), float(again > 0.1 * max(words, 10)), upper / max(letters, 1), np.log1p(len(text)) / 10, letters / max(len(text), 1), words / max(runs, 1)]
    return np.concatenate([norm(shapes), norm(grams), extra]).astype(np.float32)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 ..., a column each."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -40, 40)))

    def expected(self, x: np.ndarray) -> np.ndarray:
        return self.tails(x).sum(1)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, *, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam; thresholds stay ordered as a first one and log gaps.

    Rows of each grade weigh the same in sum.
    """
    cuts = grades - 1
    w, first, gaps = np.zeros(x.shape[1]), np.array([0.0]), np.zeros(max(cuts - 1, 0))
    weigh = (1 / np.maximum(np.bincount(grade, minlength=grades), 1))[grade]
    weigh /= weigh.sum()
    params, m, v = [w, first, gaps], None, None
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    rows = np.arange(len(x))
    single = x.dtype  # products stay in the features' type, else numpy widens the whole matrix in each step
    for step in range(1, steps + 1):
        t = params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))])
        tail = np.concatenate([np.ones((len(x), 1)), sigmoid((x @ params[0].astype(single))[:, None] - t), np.zeros((len(x), 1))], 1)
        slope = tail * (1 - tail)
        p = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-9)
        g_hi, g_lo = slope[rows, grade] / p * weigh, slope[rows, grade + 1] / p * weigh
        g_t = np.array([-g_hi[grade == k + 1].sum() + g_lo[grade == k].sum() for k in range(cuts)])
        ascent = [(g_hi - g_lo).astype(single) @ x - decay * params[0], np.array([g_t.sum()]), np.array([g_t[k + 1 :].sum() for k in range(max(cuts - 1, 0))]) * np.exp(params[2])]
        for k, g in enumerate(ascent):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(params[0].astype(np.float32), params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))]))


def train(docs: DataFrame, ratings: DataFrame, *, grade_col: str = "quality", most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel | None:
    """Fits on at most `most` rated rows of each grade, the first by a hash of the id; None without two grades.

    ratings has the id and an integer grade from 0, of at most MOST_GRADES different ones, else ValueError; null and
    negative grades and null ids are left out. Whole texts are read; only features (DIM numbers a row) come to the driver.
    """
    rated = ratings.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("grade")).where("_id is not null and grade >= 0")
    ranked = rated.groupBy("grade").count().orderBy("grade").limit(MOST_GRADES + 1).collect()
    if len(ranked) < 2:
        return None
    if len(ranked) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} different grades: bin them first")
    grades = {r["grade"]: k for k, r in enumerate(ranked)}
    share = F.lit(0.0)
    for r in ranked:
        share = F.when(F.col("grade") == r["grade"], F.lit(min(1.0, most / r["count"]))).otherwise(share)
    picked = rated.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1_000_000)) < share * 1_000_000)
    # about most * grades rows of two numbers, whatever the size of the tables
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked), "_id").select("grade", "text")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t.as_buffer().to_pybytes()).astype(np.float16).tobytes() for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["grade", "x"])

    got = arrow_map(rows, one, "grade int, x binary").toArrow()
    if got.num_rows == 0:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in got.column(1).to_pylist()]).astype(np.float32)
    y = np.array([grades[g] for g in got.column(0).to_pylist()])
    order = np.lexsort((x[:, :64].sum(1), y))  # the same model whatever order rows arrive in
    return fit_ordinal(x[order], y[order], len(grades)) if len(set(y.tolist())) > 1 else None


def rate(docs: DataFrame, model: OrdinalModel | None, *, accept: float = 0.5, tail: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, expected_grade, tail_probability, accepted.

    tail_probability is P(grade >= tail); texts at or above `accept` are accepted. A null text counts as the empty one,
    which is scored like any other. Without a model (no ratings to learn from) all is accepted and scores are null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, expected_grade double, tail_probability double, accepted boolean"
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    if model is None:
        return rows.select(id_col, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("accepted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t.as_buffer().to_pybytes()) for t in b.column(1)])
        p = sent.value.tails(x).astype(np.float64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(p[:, tail - 1]), pa.array(p[:, tail - 1] >= accept)], [id_col, "expected_grade", "tail_probability", "accepted"])

    return arrow_map(rows, one, schema, batch_bytes=1 << 20)


def accept_rows(docs: DataFrame, model: OrdinalModel | None, *, accept: float = 0.5, tail: int = 1, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows whose text the model rejects; decided where the row is, unshuffled."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(at)])
        return b.filter(pa.array(sent.value.tails(x)[:, tail - 1] >= accept))

    return arrow_map(docs, one, docs.schema, batch_bytes=1 << 20)
