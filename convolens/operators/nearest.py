"""The nearest vectors of many queries in a stream of vectors: matrix products pick candidates, exact sums rank them.

A product of single precision, of a chunk of vectors with a block of queries, is off by no more than a known
slack. What comes within it of a query's k best so far is scored again by the sums that ``retrieval.cosine``
makes, in the same order and precision, so that scores and ties are those of a scan with that expression.

Defined cases: a vector that is null, has a null element or another length than the query scores 0, as one
without length does. Ties go to the smaller vec_id, a null first. A score that is no number is above all. Of equal vectors
in a chunk only the ``k`` smallest vec_ids are scored: the others cannot be among the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vectors and queries of one product, and candidates that are scored together.
VECTORS, QUERIES, CANDIDATES = 4096, 1024, 65_536
#: Lengths outside of this range leave products of squares inexact: their vectors are always candidates.
_SHORT, _LONG = 1e-140, 1e140


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``width`` numbers, which have no cosine: null, of another length or with a null; these are zeros)."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if not flat.null_count and (lengths == width).all():
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), width), np.zeros(len(column), bool)
    out, odd = np.zeros((len(column), width)), np.ones(len(column), bool)
    for k, row in enumerate(column.to_pylist()):
        if row is not None and len(row) == width and None not in row:
            out[k], odd[k] = row, False
    return out, odd


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up from the first element to the last."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
    return total


def _units(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision; zeros for those without length, no numbers for those out of range."""
    safe = (norms > _SHORT) & (norms < _LONG)
    divisor = np.where(safe, norms, np.where(norms == 0, 1.0, np.nan))
    return (rows / divisor[:, None]).astype(np.float32)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether known) of vec_ids, values in an array that sorts as Spark does."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array([x or "" for x in column.to_pylist()], dtype=str), known
    return column.fill_null(0).to_numpy(zero_copy_only=False), known


class Nearest:
    """The ``k`` best vectors so far of every query, all queries of one width."""

    def __init__(self, queries: np.ndarray, k: int, odd: np.ndarray | None = None, least: np.ndarray | None = None):
        self.queries, self.k, n = queries, k, len(queries)
        self.odd = np.zeros(n, bool) if odd is None else odd
        self.norms = np.sqrt(dots(queries, queries))
        self.units = _units(queries, self.norms)
        self.slack = (queries.shape[1] + 8) * 2.0**-23
        self.score, self.held = np.full((n, k), -np.inf), np.zeros((n, k), bool)
        self.ids: np.ndarray | None = None
        self.known = np.zeros((n, k), bool)
        #: a query's k-th score, or one known before; nothing below it counts
        self.least = np.full(n, -np.inf) if least is None else least.copy()

    def add(self, ids: pa.Array, vectors: np.ndarray, odd: np.ndarray | None = None, among: np.ndarray | None = None) -> None:
        """Meet vectors with all queries, or with those at the positions ``among``; ``odd`` ones have no cosine."""
        odd = np.zeros(len(vectors), bool) if odd is None else odd
        among = np.arange(len(self.queries)) if among is None else among
        values, known = _ids(ids)
        for at in range(0, len(values) if len(among) else 0, VECTORS):
            self._chunk(*(x[at : at + VECTORS] for x in (values, known, vectors, odd)), among)

    def _chunk(self, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, odd: np.ndarray, among: np.ndarray) -> None:
        vectors = np.ascontiguousarray(vectors)
        if vectors.shape[1]:
            _, same = np.unique(vectors.view(f"V{vectors.shape[1] * 8}").reshape(-1), return_inverse=True)
        else:
            same = np.zeros(len(vectors), int)
        same = 2 * same + odd
        order = np.lexsort((ids, known, same))
        kept = np.sort(order[_rank(same[order]) < self.k])
        ids, known, vectors, odd = ids[kept], known[kept], vectors[kept], odd[kept]
        norms = np.sqrt(dots(vectors, vectors))
        units = _units(vectors, norms)
        numbers = bool(np.isfinite(units).all() and np.isfinite(self.units).all())
        for at in range(0, len(among), QUERIES):
            part = among[at : at + QUERIES]
            near = self.units[part] @ units.T
            if not numbers:
                near[np.isnan(near)] = np.inf
            bound = (self.least[part] - 2 * self.slack).astype(np.float32)
            hit = near >= bound[:, None]
            if numbers and near.shape[1] > self.k:
                many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * self.k + 16)
                if len(many):
                    kth = np.partition(near[many], -self.k, axis=1)[:, -self.k] - np.float32(4 * self.slack)
                    hit[many] = near[many] >= np.maximum(bound[many], kth)[:, None]
            row, col = np.nonzero(hit)
            if len(row):
                self._merge(part[row], self._exact(part[row], vectors, norms, odd, col), ids[col], known[col])

    def _exact(self, row: np.ndarray, vectors: np.ndarray, norms: np.ndarray, odd: np.ndarray, col: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row))
        for at in range(0, len(row), CANDIDATES):
            q, v = row[at : at + CANDIDATES], col[at : at + CANDIDATES]
            with np.errstate(all="ignore"):
                length = norms[v] * self.norms[q]
                out[at : at + CANDIDATES] = np.where((length == 0) | odd[v] | self.odd[q], 0.0, dots(vectors[v], self.queries[q]) / length)
        return out

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if self.ids is None:
            self.ids = np.zeros(self.score.shape, ids.dtype)
        met = np.unique(row)
        old = self.held[met]
        rows = np.concatenate((np.repeat(met, self.k)[old.reshape(-1)], row))
        scores = np.concatenate((self.score[met][old], score))
        values = np.concatenate((self.ids[met][old], ids))
        flags = np.concatenate((self.known[met][old], known))
        key = np.where(np.isnan(scores), np.inf, scores)
        order = np.lexsort((values, flags, -key, rows))
        rank = _rank(rows[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.ids = self.ids.astype(np.result_type(self.ids, values), copy=False)
        to = rows[order], rank
        self.held[to], self.score[to], self.ids[to], self.known[to] = True, scores[order], values[order], flags[order]
        full = rank == self.k - 1
        self.least[rows[order][full]] = np.maximum(self.least[rows[order][full]], key[order][full])

    def rows(self, kind: pa.DataType) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(positions of queries, vec_ids, scores) of the best."""
        at, rank = np.nonzero(self.held)
        if self.ids is None:
            return at, pa.array([], kind), np.zeros(0)
        values = self.ids[at, rank]
        return at, pa.array(values if values.dtype.kind != "U" else values.tolist(), mask=~self.known[at, rank]).cast(kind), self.score[at, rank]


def _rank(groups: np.ndarray) -> np.ndarray:
    """Each row's number within its group; groups lie together."""
    starts = np.concatenate(([True], groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, bool)
    return np.arange(len(groups)) - np.maximum.accumulate(np.where(starts, np.arange(len(groups)), 0)) if len(groups) else np.zeros(0, int)


class ByWidth:
    """``Nearest`` for the queries of each length of a table (query_id, query); a null query has length 0."""

    def __init__(self, queries: pa.Table, k: int):
        asked = queries.combine_chunks()
        column = asked["query"].combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.float64()))
        widths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        self.names = asked["query_id"].combine_chunks() if asked.num_rows else None
        self.groups = []
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            rows, odd = matrix(column.take(pa.array(at)), int(width))
            self.groups.append((at, Nearest(rows, k, odd)))

    def add(self, batch: pa.RecordBatch) -> None:
        """Meet a batch of (vec_id, embedding)."""
        for _, group in self.groups:
            group.add(batch.column(0), *matrix(batch.column(1), group.queries.shape[1]))

    def batches(self, kind: pa.DataType, names: list[str]):
        """The best as record batches (query_id, vec_id, score)."""
        for at, group in self.groups:
            found, ids, scores = group.rows(kind)
            if len(found):
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(at[found])), ids, pa.array(scores, pa.float64())], names=names)
