"""BM25 scores of batches of windows for many queries at a time, and each query's best of what has passed.

A few windows at a time meet the weights as one matrix product in single precision; what can be among the best, as far as
its rounding may hide, is scored again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .retrieval import K1, B

#: Windows of a product, and what a score's rounding may hide, of the most that a query can score.
ROWS, SLACK = 32, 2e-6
#: Rows that are held until they are settled.
HELD = 200_000


def norms(dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What BM25 adds to a term's count in a window of so many terms."""
    return K1 * (1 - B + B * dl / (avgdl or 1.0))


class Best:
    """The k best windows of each column of w, weights of terms (rows) by query (columns), NaN where a query doesn't ask for the term."""

    def __init__(self, w: np.ndarray, k: int, most: np.ndarray | None = None):
        has = ~np.isnan(w)
        self.w, self.k = np.nan_to_num(w), k
        self.low = self.w.astype(np.float32)
        # weights that are no more than zero hide what holds a term
        self.has = has.astype(np.float32) if (has & (self.w <= 0)).any() else None
        cap = np.abs(self.w).sum(axis=0) * (K1 + 1)
        #: what rounded scores may hide, of the most that a query scores
        self.give = np.maximum(cap, 0.0 if most is None else most) * SLACK
        self.error = 2 * (has.sum(axis=0) + 8) * 2.0**-24 * cap
        # where all weights are above zero, so is the score of whatever holds a term
        none = -np.inf if self.has is not None else 0.0
        self.top = np.full((w.shape[1], k), none, dtype=np.float32)
        self.least = np.full(w.shape[1], np.nextafter(np.float32(none), np.float32(1)), dtype=np.float32)
        self.floor = self.least.copy()
        self.places = np.zeros(len(w), dtype=np.int64)

    def _exact(self, tf: np.ndarray, norm: np.ndarray, own: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        part = tf * (K1 + 1) / (tf + norm[:, None])
        if 4 * len(row) > part.shape[0] * self.w.shape[1]:
            return (part @ self.w[own])[row, column]
        return np.einsum("ij,ji->i", part[row], self.w[own[:, None], column])

    def add(self, n: int, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], norm: np.ndarray, also: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """((window, column, score) of what may be among the best; scores of the windows and columns in `also`).

        pieces hold windows, in order, the numbers of terms in them and their counts there (None: one each). also is in order too.
        """
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        told = np.zeros(len(also[0]) if also else 0)
        edges = np.arange(0, n + ROWS, ROWS)
        cuts = [np.searchsorted(window, edges) for window, _, _ in pieces]
        asked = np.searchsorted(also[0], edges) if also else np.zeros(len(edges), dtype=np.int64)
        for s, begin in enumerate(edges[:-1].tolist()):
            rows = min(begin + ROWS, n) - begin
            at = np.concatenate([term[c[s] : c[s + 1]] for (_, term, _), c in zip(pieces, cuts, strict=True)])
            if not len(at):
                continue
            row = np.concatenate([window[c[s] : c[s + 1]] for (window, _, _), c in zip(pieces, cuts, strict=True)]) - begin
            many = [None if count is None else count[c[s] : c[s + 1]] for (_, _, count), c in zip(pieces, cuts, strict=True)]
            weight = None if all(m is None for m in many) else np.concatenate([np.ones(c[s + 1] - c[s]) if m is None else m for m, c in zip(many, cuts, strict=True)])
            own = np.flatnonzero(np.bincount(at, minlength=len(self.w)))
            self.places[own] = np.arange(len(own))
            tf = np.bincount(row * len(own) + self.places[at], weights=weight, minlength=rows * len(own)).reshape(rows, len(own))
            low = tf.astype(np.float32)
            raw = (low * np.float32(K1 + 1) / (low + norm[begin : begin + rows, None].astype(np.float32))) @ self.low[own]
            if self.has is not None:
                raw[(low > 0).astype(np.float32) @ self.has[own] == 0] = -np.inf
            if asked[s] < asked[s + 1]:
                of = slice(asked[s], asked[s + 1])
                told[of] = self._exact(tf, norm[begin : begin + rows], own, also[0][of] - begin, also[1][of])
            if len(grown := np.flatnonzero((raw > self.top[:, 0]).any(axis=0))):
                both = np.concatenate([self.top[grown], raw.T[grown]], axis=1)
                both.partition(rows, axis=1)  # the first of the last k is the least of them
                self.top[grown] = both[:, rows:]
                self.least[grown] = np.maximum(self.floor[grown], np.nextafter((self.top[grown, 0] - self.error[grown] - self.give[grown]).astype(np.float32), np.float32(-np.inf)))
            if len(cells := np.flatnonzero(raw >= self.least)):
                window, column = np.divmod(cells, raw.shape[1])
                found.append((window + begin, column, self._exact(tf, norm[begin : begin + rows], own, window, column)))
        return tuple(np.concatenate([f[c] for f in found]) for c in range(3)), told


def settled(rows: pa.Table, k: int, give: np.ndarray, keys: list[str]) -> pa.Table:
    """Of rows (column, raw, keys, ...) those that can be among a column's k best by rounded score, then keys."""
    if not len(rows):
        return rows
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("column", "ascending"), ("raw", "descending"), *((c, "ascending") for c in keys)]))
    column, raw = rows["column"].to_numpy(), rows["raw"].to_numpy()
    at = np.arange(len(column))
    new = np.r_[True, column[1:] != column[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(column)])
    kth = np.where(size >= k, raw[np.minimum(first + k - 1, len(raw) - 1)], -np.inf)
    # of equal scores the first k by key are enough
    place = at - np.maximum.accumulate(np.where(np.r_[True, new[1:] | (raw[1:] != raw[:-1])], at, 0))
    return rows.filter(pa.array((raw >= np.repeat(kth, size) - give[column]) & (place < k)))


class Held:
    """Rows of candidates, settled now and then."""

    def __init__(self, best: Best, keys: list[str]):
        self.best, self.keys, self.rows, self.size = best, keys, [], 0
        self.limit = max(HELD, 4 * best.top.size)

    def add(self, rows: pa.Table) -> None:
        self.rows.append(rows)
        self.size += len(rows)
        if self.size > self.limit:
            self.rows = [self.out()]
            self.size = len(self.rows[0])
            self.limit = max(self.limit, 2 * self.size)

    def out(self) -> pa.Table | None:
        return settled(pa.concat_tables(self.rows).combine_chunks(), self.best.k, self.best.give, self.keys) if self.rows else None
