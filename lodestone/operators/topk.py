"""Top k of each query on NumPy arrays, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def stack(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1 if n else 0).astype(dtype, copy=False)


def normalise_rows(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


#: Queries, and sums, of a tile of products: 2 MB.
TILE, SUMS = 1024, 1 << 18


def lengths(columns: np.ndarray) -> np.ndarray:
    """Of the vectors whose first elements are ``columns[0]`` and so on, each summed in order of the elements."""
    total = np.zeros(columns.shape[1])
    for x in columns:
        total += np.square(x, dtype=np.float64)
    return np.sqrt(total)


def column_products(q: np.ndarray, columns: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """All inner products of ``q`` with vectors that stand as columns, divided by their ``scale``; each is summed in order of the elements.

    Equal vectors so have equal products wherever they stand, which ties need and a matrix product does not promise.
    """
    n = columns.shape[1]
    out, step = np.zeros((len(q), n)), max(256, SUMS // max(1, min(TILE, len(q))))
    for b in range(0, n, step):
        for d, x in enumerate(columns[:, b : b + step]):
            x = x if scale is None else x / scale[b : b + step]
            for a in range(0, len(q), TILE):
                out[a : a + TILE, b : b + step] += q[a : a + TILE, d, None] * x
    return out


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """All inner products, summed as ``column_products`` does."""
    return column_products(q, np.ascontiguousarray(m.T))


def ranking(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places by score descending, then id. Ids are looked at where scores tie."""
    order = np.argsort(-scores)
    same = scores[order[1:]] == scores[order[:-1]]
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        run = np.cumsum(np.append(True, ~same))[tied]
        order[tied] = order[tied][np.lexsort((ids[order[tied]], run))]
    return order


def paired_products(q: np.ndarray, m: np.ndarray, who: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Those of the pairs q[who], m[which]."""
    out = np.zeros(len(who))
    for d in range(q.shape[1]):
        out += q[who, d] * m[which, d]
    return out


#: Scores that ``nearest`` holds: 8 MB.
NEAREST = 1 << 20


def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, product) of each row's nearest centroid, the lowest number on ties."""
    best, score = np.empty(len(m), np.int64), np.empty(len(m))
    step = max(1, NEAREST // max(1, len(centroids)))
    for at in range(0, len(m), step):
        s = m[at : at + step] @ centroids.T
        best[at : at + step] = number = np.argmax(s, axis=1)
        score[at : at + step] = np.take_along_axis(s, number[:, None], 1)[:, 0]
    return best, score


class RunningTop:
    """The best k rows of each query so far, ordered by similarity, then row id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, 0), -np.inf)
        self.ids = np.zeros((queries, 0), np.int64)

    @classmethod
    def empty(cls, queries: int, k: int) -> RunningTop:
        """All k places, at -inf."""
        top = cls(queries, k)
        top.scores, top.ids = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)
        return top

    def merge_some(self, who: np.ndarray, found: RunningTop) -> None:
        """Merge what was found for the queries ``who`` of an ``empty`` start."""
        some = RunningTop(len(who), self.k)
        some.scores, some.ids = self.scores[who], self.ids[who]
        some.merge(found.scores, found.ids)
        self.scores[who], self.ids[who] = some.scores, some.ids

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: queries by rows; ``ids``: of the rows."""
        self.merge(scores, np.broadcast_to(ids, scores.shape))

    def bar(self) -> np.ndarray:
        """The score of each query's k-th row; -inf while it has fewer."""
        return self.scores[:, self.k - 1] if self.scores.shape[1] >= self.k else np.full(len(self.scores), -np.inf)

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.shape[1] > self.k:  # each query's scores from the k-th on, ties at it included
            cut = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            width = int((scores >= cut[:, None]).sum(axis=1).max(initial=0))
            if width < scores.shape[1]:
                keep = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
        all_scores, all_ids = np.hstack([self.scores, scores]), np.hstack([self.ids, ids])
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
