"""Many chunkings of a corpus, ranked by BM25, from one table of terms with their places.

Documents are read and cut into terms once. Which windows of a setting hold a term follows from its place; where a window's
edge cuts a run of letters, what is left of it on either side is a term of its own. A first pass counts, for each setting,
in how many windows each term is and how long windows are; a second scores the windows for a set of queries at a time, and
lets out each query's best of a task, so that scores don't meet but in the last ranking.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import store
from .retrieval import top_k
from .scoring import Best, Held, norms

#: Queries whose weights go out together; terms whose windows are told together, and words that a task counts before it lets them out.
QUERIES, TERMS, WORDS = 256, 100_000, 500_000
_HAN = "一-鿿"
_IS_WHITE = np.isin(np.arange(max(map(ord, T.WHITE)) + 2), [ord(c) for c in T.WHITE])


def _runs():
    import regex

    return regex.compile(f"[{_HAN}]+|[[\\p{{L}}\\p{{N}}]--[{_HAN}]]+", regex.V1)


def run_terms(run: str, runs) -> list[str]:
    """The terms of a run of letters and digits, or of Han, as functions.text.terms has them."""
    out = []
    for r in runs.findall(run.lower()):
        out += [r[i : i + 2] for i in range(max(1, len(r) - 1))] if _HAN[0] <= r[0] <= _HAN[-1] else [r]
    return out


def placed_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, text, terms, starts, ends): each document's terms with the places of the runs that they come from."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs()
        known: dict[str, list[str]] = {}  # runs that come again aren't cut again
        for b in batches:
            done = 0
            cuts: list[int] = [0]
            terms: list[str] = []
            starts: list[int] = []
            ends: list[int] = []

            def sent(docs: pa.RecordBatch) -> pa.RecordBatch:
                at = pa.array(cuts, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((terms, pa.string()), (starts, pa.int32()), (ends, pa.int32()))]
                return pa.RecordBatch.from_arrays([docs["doc_id"], docs["text"], *lists], ["doc_id", "text", "terms", "starts", "ends"])

            for number in range(b.num_rows):
                text = b["text"][number].as_py()
                for m in runs.finditer(text):
                    part = m.group()
                    if (own := known.get(part)) is None:
                        own = run_terms(part, runs)
                        if len(known) < WORDS:
                            known[part] = own
                    start, end = m.span()
                    for t in own:
                        terms.append(t)
                        starts.append(start)
                        ends.append(end)
                cuts.append(len(terms))
                if len(terms) > TERMS or number + 1 == b.num_rows:
                    yield sent(b.slice(done, number + 1 - done))
                    done, cuts, terms, starts, ends = number + 1, [0], [], [], []

    own = docs.where(~T.is_blank(F.col("text"))).select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {kind}, text string, terms array<string>, starts array<int>, ends array<int>")


class Placed:
    """Some documents of a batch: their terms as numbers with places, and which windows of a setting hold them."""

    def __init__(self, b: pa.RecordBatch, runs):
        coded = b["terms"].flatten().dictionary_encode()
        texts = b["text"].to_pylist()
        self.names: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.known = len(self.names)
        self.codes = np.asarray(coded.indices, dtype=np.int64)
        self.doc = np.repeat(np.arange(b.num_rows), np.asarray(b["terms"].value_lengths(), dtype=np.int64))
        self.text, self.runs = "".join(texts), runs
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        starts, ends = (b[c].flatten().to_numpy().astype(np.int64) for c in ("starts", "ends"))
        self.starts, self.ends = starts, ends
        self.first, self.past = starts + self.begin[self.doc], ends + self.begin[self.doc]  # places among all texts
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        #: how many characters that aren't white space come before each place
        self.solid = np.concatenate([[0], np.cumsum(~_IS_WHITE[np.minimum(points, len(_IS_WHITE) - 1)])])
        self.numbers: dict[str, int] = {}
        self.cut: dict[str, list[int]] = {}

    def number(self, word: str) -> int:
        if not self.numbers:
            self.numbers = {w: n for n, w in enumerate(self.names)}
        if word not in self.numbers:
            self.numbers[word] = len(self.names)
            self.names.append(word)
        return self.numbers[word]

    def pieces(self, part: str) -> list[int]:
        """Numbers of the terms of a part of a run; parts that come again aren't cut again."""
        if part not in self.cut:
            self.cut[part] = [self.number(t) for t in run_terms(part, self.runs)]
        return self.cut[part]

    def windows(self, size: int, overlap: int) -> Windows:
        step = size - overlap
        many = np.maximum(-(-(self.length - size) // step), 0) + 1
        base = np.cumsum(many) - many
        doc = np.repeat(np.arange(len(many)), many)
        index = np.arange(len(doc)) - base[doc]
        a = index * step + self.begin[doc]
        b = np.minimum(index * step + size, self.length[doc]) + self.begin[doc]
        first = np.maximum(0, -((size - self.ends) // step))
        last = np.minimum(many[self.doc] - 1, self.starts // step)
        cut: list[tuple[int, int, int]] = []
        if len(self.first):
            left, right = np.searchsorted(self.first, a, side="left") - 1, np.searchsorted(self.first, b, side="left") - 1
            at = np.flatnonzero((left >= 0) & (self.first[left] >= self.begin[doc]) & (self.past[left] > a))
            cut += zip(at.tolist(), a[at].tolist(), np.minimum(self.past[left[at]], b[at]).tolist(), strict=True)
            at = np.flatnonzero((right >= 0) & (self.past[right] > b) & (self.first[right] >= a))
            cut += zip(at.tolist(), self.first[right[at]].tolist(), b[at].tolist(), strict=True)
        text, pieces = self.text, self.pieces
        more = [(i, t) for i, x, y in cut for t in pieces(text[x:y])]
        rest = np.array(more, dtype=np.int64).reshape(-1, 2)
        rest = rest[np.argsort(rest[:, 0], kind="stable")]
        return Windows(doc, index, a, b, self.solid[b] > self.solid[a], first + base[self.doc], last + base[self.doc], rest[:, 0], rest[:, 1])


@dataclass(frozen=True)
class Windows:
    """Windows of a setting: their documents, numbers there, places, and whether they hold more than white space; the first and
    last window that holds each term whole (none where the last comes before the first); and windows and terms of cut runs."""

    doc: np.ndarray
    index: np.ndarray
    a: np.ndarray
    b: np.ndarray
    kept: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rest: np.ndarray
    rest_terms: np.ndarray

    def lengths(self) -> np.ndarray:
        """How many terms each window holds."""
        n, held = len(self.doc), self.first <= self.last
        whole = np.cumsum(np.bincount(self.first[held], minlength=n + 1) - np.bincount(self.last[held] + 1, minlength=n + 1))[:n]
        return whole + np.bincount(self.rest, minlength=n)


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's documents with about TERMS terms and as many characters tenfold, so that what is made of them stays small."""
    if not b.num_rows:
        return
    n = np.asarray(b["terms"].value_lengths(), dtype=np.int64) + np.asarray(pa.compute.utf8_length(b["text"]), dtype=np.int64) // 10
    at = np.cumsum(n) // TERMS
    for begin, end in zip((cuts := np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])), cuts[1:], strict=False):
        yield b.slice(begin, end - begin)


def counted(placed: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """(pair, term, n, total): for each setting the number of windows that hold each term; and, with a null term, their number and total length. Sums are stored.

    A term's windows follow from its places in a document, each time it stands there those after the time before; none are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs()
        numbers: dict[str, int] = {}
        totals = np.zeros((len(settings), 1 << 12), dtype=np.int64)
        sizes = np.zeros((len(settings), 2), dtype=np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            names = list(numbers)
            for begin in range(0, len(names), 1 << 16):
                own = names[begin : begin + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(np.zeros(len(own), dtype=np.int32)), *(pa.array(t[begin : begin + len(own)]) for t in totals)], ["term", "what", *columns])
            numbers.clear()
            totals[:] = 0

        for b in (x for batch in batches for x in slices(batch)):
            s = Placed(b, runs)
            reach = int(s.length.max(initial=0)) + 2
            group = s.doc * s.known + s.codes
            order = np.argsort(group, kind="stable")  # places of a document's terms are in order already
            sorted_group, term = group[order], s.codes[order]
            again = np.r_[False, sorted_group[1:] == sorted_group[:-1]]
            places, past = sorted_group * reach + s.starts[order], s.past[order]
            found = []
            for p, (size, overlap) in enumerate(settings):
                w = s.windows(size, overlap)
                first, last = w.first[order], w.last[order]
                before = np.where(again, np.r_[-1, last[:-1]], -1) if len(last) else last
                new = np.maximum(0, last - np.maximum(first, before + 1) + 1)
                window, extra = np.divmod(np.unique(w.rest * len(s.names) + w.rest_terms), max(1, len(s.names)))
                # a cut run's term that its window also holds whole is there already
                if len(places) and len(extra):
                    own = np.minimum(extra, s.known - 1)
                    asked = w.doc[window] * s.known + own
                    at = np.searchsorted(places, asked * reach + (w.a[window] - s.begin[w.doc[window]]))
                    near = np.minimum(at, len(places) - 1)
                    there = (extra < s.known) & (at < len(places)) & (sorted_group[near] == asked) & (past[near] <= w.b[window])
                    extra = extra[~there]
                found.append((np.bincount(term, weights=new, minlength=1), extra))
                sizes[p] += int(w.kept.sum()), int(w.lengths().sum())
            ids = np.array([numbers.setdefault(x, len(numbers)) for x in s.names], dtype=np.int64)
            if len(numbers) > totals.shape[1]:
                totals = np.concatenate([totals, np.zeros((len(settings), max(totals.shape[1], len(numbers) - totals.shape[1])), dtype=np.int64)], axis=1)
            for p, (whole, extra) in enumerate(found):
                if len(s.names):
                    n = np.bincount(extra, minlength=len(s.names))
                    n[: len(whole)] += whole.astype(np.int64)[: len(n)]
                    totals[p, ids] += n
            if len(numbers) > WORDS:
                yield from sent()
        yield from sent()
        yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.string()), pa.array([0, 1], pa.int32()), *(pa.array(x) for x in sizes)], ["term", "what", *columns])

    # a row a term with a column for each setting, so that terms are shuffled once for all settings
    columns = [f"n{p}" for p in range(len(settings))]
    own = placed.mapInArrow(run, ", ".join(["term string, what int", *(f"{c} bigint" for c in columns)]))
    summed = store({"summed": own.groupBy("term", "what").agg(*(F.sum(c).alias(c) for c in columns))})["summed"]
    each = summed.select("term", "what", F.posexplode(F.array(*columns)).alias("pair", "n"))
    of = lambda what: F.sum(F.when(F.col("what") == what, F.col("n"))).alias("n" if what == 0 else "total")
    terms = each.where("term is not null and n > 0").select("pair", "term", "n", F.lit(0).cast("bigint").alias("total"))
    return terms.union(each.where("term is null").groupBy("pair").agg(of(0), of(1)).select("pair", F.lit(None).cast("string").alias("term"), "n", "total"))


def weights(counts: DataFrame, queries: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """(pair, query_id, term, w) of the asked terms, and for each setting the number of windows and their mean length."""
    sizes = {r["pair"]: (r["n"], r["total"] / r["n"] if r["n"] else 0.0) for r in counts.where("term is null").collect()}
    spark = counts.sparkSession
    n_chunks = spark.createDataFrame([(p, n) for p, (n, _) in sizes.items()], "pair int, n_chunks bigint")
    raw = counts.where("term is not null").join(F.broadcast(n_chunks), "pair").withColumn("raw", F.log(F.col("n_chunks") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = raw.groupBy("pair").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw"))
    asked = queries.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return raw.join(asked, "term").join(F.broadcast(mean), "pair").select("pair", "query_id", "term", (F.col("qtf") * idf).alias("w")), sizes


def ranked(placed: DataFrame, settings: list[tuple[int, int]], weighed: DataFrame, sizes: dict[int, tuple[int, float]], k: int) -> DataFrame:
    """(pair, query_id, doc_id, chunk_index, score, text, rank): each query's best k windows of each setting, with their first 100 characters."""
    spark = placed.sparkSession
    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = f"pair int, query_id bigint, doc_id {kind}, chunk_index int, raw double, text string"
    sets = max(1, -(-weighed.select("query_id").distinct().count() // QUERIES))
    out = []
    for number in range(sets):
        rows = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == number).toPandas()
        ids = np.sort(rows["query_id"].unique())
        names = {t: n for n, t in enumerate(sorted(rows["term"].unique()))}
        tables = []
        for p in range(len(settings)):
            own = rows[rows["pair"] == p]
            w = np.full((len(names), len(ids)), np.nan)
            w[own["term"].map(names).to_numpy(dtype=int), np.searchsorted(ids, own["query_id"])] = own["w"]
            tables.append(w)
        sent = spark.sparkContext.broadcast((ids, names, tables))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, names, tables = sent.value
            runs = _runs()
            bests = [Best(w, k) for w in tables]
            held = [Held(best, ["doc_id", "chunk_index"]) for best in bests]
            for b in (x for batch in batches for x in slices(batch)) if names else ():
                s = Placed(b, runs)
                asked = np.array([names.get(x, -1) for x in s.names], dtype=np.int64)  # the numbers of the documents' words among the asked
                mine = np.flatnonzero(asked[s.codes] >= 0) if len(s.codes) else np.zeros(0, dtype=np.int64)
                term = asked[s.codes[mine]] if len(mine) else mine
                for p, (size, overlap) in enumerate(settings):
                    w = s.windows(size, overlap)
                    first, last = w.first[mine], w.last[mine]
                    # a term's first windows, second ones, and so on are each in order
                    parts = [(first[on := np.flatnonzero(first + n <= last)] + n, term[on], None) for n in range(int((last - first).max(initial=-1)) + 1)]
                    if len(s.names) > len(asked):
                        asked = np.append(asked, [names.get(x, -1) for x in s.names[len(asked) :]]).astype(np.int64)
                    if len(w.rest):
                        own = asked[w.rest_terms]
                        parts.append((w.rest[own >= 0], own[own >= 0], None))
                    if not parts:
                        continue
                    (window, query, raw), _ = bests[p].add(len(w.doc), parts, norms(w.lengths(), sizes[p][1]))
                    if not len(window):
                        continue
                    a, end = w.a[window], np.minimum(w.b[window], w.a[window] + 100)
                    texts = [s.text[x:y] for x, y in zip(a.tolist(), end.tolist(), strict=True)]
                    held[p].add(pa.table([pa.array(query), pa.array(raw), b["doc_id"].take(pa.array(w.doc[window])), pa.array(w.index[window].astype(np.int32)), pa.array(texts, pa.string())], ["column", "raw", "doc_id", "chunk_index", "text"]))
            for p, own in enumerate(held):
                if (rows := own.out()) is not None:
                    for r in rows.to_batches():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(r.num_rows, p, dtype=np.int32)), pa.array(ids[r["column"].to_numpy()]), r["doc_id"], r["chunk_index"], r["raw"], r["text"]], ["pair", "query_id", "doc_id", "chunk_index", "raw", "text"])

        out.append(placed.mapInArrow(run, schema))
    found = reduce(DataFrame.union, out)
    # rounded scores tie, so what rounding may bring up stays until scores are rounded
    best = F.max("raw").over(Window.partitionBy("pair", "query_id"))
    near = store({f"near-{uuid.uuid4().hex[:6]}": found})
    scored = next(iter(near.values())).withColumn("best", best).withColumn("score", T.fixed(F.col("raw") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)))
    return top_k(scored.drop("raw", "best"), k, F.desc("score"), "doc_id", "chunk_index", by=["pair", "query_id"])
