"""Operator 9: approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are projected to PROJECTED dimensions by Gaussian (2-stable) weights made orthogonal, scaled so that the squared
projected distance of a pair at distance d is d**2 times a variable with a chi-square's mean; being orthogonal, it
strays less than a chi-square of PROJECTED degrees, so the test below errs to the safe side. Shards are table rows, each
with a kd-tree of its projections. A query goes through a shard's projected neighbours in ascending projected distance:
tree leaves are opened in order of their distance, and a point's turn comes when no unopened leaf can hold a nearer
one. Each is verified by its true distance until the chi-square test holds: a vector nearer than the k-th found
would, with probability CERTAIN, have been met by now. The k-th distance found in a first shard serves all others
from their start. The test allows for the rounding of projections, which differs with the shapes multiplied, so that
copies of a query are met at a k-th distance of 0. The projection does not depend on the data, and every row is indexed. Vectors spread evenly over all
their dimensions, as those of the test tables are, have near neighbours hardly nearer than others, so a projection must
keep much of them: CERTAIN and PROJECTED were chosen by measured recall and share of verified vectors (see README).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .vectors import best, build_shards, search, taking_part

PROJECTED = 32
CERTAIN = 0.85
SHARD_ROWS = 8192
LEAF = 64
READ = 32  # neighbours verified between two tests


def chi_square(x: float, degrees: int = PROJECTED) -> float:
    """P(chi-square <= x)."""
    if x <= 0:
        return 0.0
    if x > 1400:
        return 1.0
    p, half = (math.erf(math.sqrt(x / 2)), 0.5) if degrees % 2 else (1 - math.exp(-x / 2), 1.0)
    while 2 * half < degrees:  # two degrees more
        p -= math.exp(half * math.log(x / 2) - x / 2 - math.lgamma(half + 1))
        half += 1
    return p


def chi_square_bound(p: float = CERTAIN, degrees: int = PROJECTED) -> float:
    """The x at which chi_square reaches p."""
    low, high = 0.0, 1400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def projection(dims: int, seed: int = 11) -> np.ndarray:
    """dims x min(dims, PROJECTED) orthogonal columns of squared length dims; the sign and order of a Gaussian matrix's."""
    g = np.random.default_rng(seed).standard_normal((dims, min(dims, PROJECTED)))
    q, r = np.linalg.qr(g)
    return q * np.sign(np.diag(r)) * math.sqrt(dims)


class KdTree:
    """Leaves of at most LEAF points, split at the median of the widest dimension; nodes keep their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.children, self.span = [], [], [], []
        if len(points):
            self._grow(0, len(points))

    def _grow(self, a: int, b: int) -> int:
        p = self.points[self.order[a:b]]
        low, high = p.min(axis=0), p.max(axis=0)
        me = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.children.append(None)
        if b - a > LEAF and (high > low).any():
            m = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, int(np.argmax(high - low))], m)]
            self.children[me] = (self._grow(a, a + m), self._grow(a + m, b))
        return me

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, span) of all leaves."""
        at = [i for i, c in enumerate(self.children) if c is None]
        return np.array([self.low[i] for i in at]), np.array([self.high[i] for i in at]), np.array([self.span[i] for i in at])


def tree_columns(ids: np.ndarray, vectors: np.ndarray) -> dict[str, bytes]:
    """A shard's index: ids, vectors and their projections in the kd-tree's order; low, high and span of its leaves."""
    points = vectors @ projection(vectors.shape[1])
    tree = KdTree(points)
    low, high, span = tree.leaves()
    return {"ids": ids[tree.order].astype("<i8").tobytes(), "vectors": vectors[tree.order].tobytes(), "points": points[tree.order].tobytes(), "low": low.tobytes(), "high": high.tobytes(), "span": span.astype("<i8").tobytes()}


def open_tree(row: dict[str, bytes]) -> tuple[np.ndarray, ...]:
    """(ids, vectors, points, low, high, span) of a shard's row."""
    ids, span = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["span"], "<i8").reshape(-1, 2)
    vectors, points = (np.frombuffer(row[c]).reshape(len(ids), -1) for c in ("vectors", "points"))
    return ids, vectors, points, *(np.frombuffer(row[c]).reshape(len(span), -1) for c in ("low", "high")), span


def neighbours(points: np.ndarray, low: np.ndarray, high: np.ndarray, span: np.ndarray, near: np.ndarray, within):
    """Batches of (places, squared projected distances) in ascending distance from `near`; within() gives the distance beyond which none is needed."""
    gap = np.maximum(np.maximum(low - near, near - high), 0)
    gap = np.einsum("ij,ij->i", gap, gap)
    order = np.argsort(gap, kind="stable")
    at, width, waiting, dist = 0, 8, np.zeros(0, np.int64), np.zeros(0)
    while True:
        most = within()
        if at < len(order) and gap[order[at]] <= most:
            leaves = order[at : at + width]
            leaves = leaves[gap[leaves] <= most]
            at, width = at + len(leaves), 2 * width
            own = np.concatenate([np.arange(a, b) for a, b in span[leaves].tolist()])
            diff = points[own] - near
            d = np.einsum("ij,ij->i", diff, diff)
            waiting, dist = np.concatenate((waiting, own[d <= most])), np.concatenate((dist, d[d <= most]))
            by = np.argsort(dist, kind="stable")
            waiting, dist = waiting[by], dist[by]
        edge = gap[order[at]] if at < len(order) else math.inf
        ready = int(np.searchsorted(dist, min(edge, most), side="right"))
        if ready:
            ready = min(ready, READ)
            yield waiting[:ready], dist[:ready]
            waiting, dist = waiting[ready:], dist[ready:]
        elif at >= len(order) or edge > most:
            return


def search_shard(shard: tuple[np.ndarray, ...], query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, vector ids, distances) of the k nearest found in a shard, and how many vectors were verified.

    bounds: distances that a query's k nearest found do not exceed (not a number: not known).
    """
    ids, vectors, points, low, high, span = shard
    weights = projection(vectors.shape[1])
    root = math.sqrt(chi_square_bound(CERTAIN, weights.shape[1]))
    # how far two projections of one vector may lie apart by rounding
    stray = 2 * np.finfo(float).eps * math.sqrt(weights.shape[1]) * vectors.shape[1] ** 1.5 * np.linalg.norm(queries, axis=1)
    out: list[list[np.ndarray]] = [[], [], []]
    read, near = 0, queries @ weights
    for i in range(len(queries)):
        dist, found = np.zeros(0), np.zeros(0, np.int64)
        kth, own = math.inf if bounds is None or np.isnan(bounds[i]) else float(bounds[i]), float(stray[i])
        for places, _ in neighbours(points, low, high, span, near[i], lambda: (root * kth + own) * (root * kth + own)):  # noqa: B023  the chi-square test
            places = places[ids[places] != query_ids[i]]
            diff = vectors[places] - queries[i]
            read += len(places)
            dist, found = np.concatenate((dist, np.sqrt(np.einsum("ij,ij->i", diff, diff)))), np.concatenate((found, ids[places]))
            if len(dist) >= k:
                at = best(dist, found, k, False)
                dist, found = dist[at], found[at]
                kth = min(kth, float(dist[-1]))
        for column, v in zip(out, (np.full(len(dist), query_ids[i]), found, dist), strict=True):
            column.append(v)
    return *(np.concatenate(c) if c else np.zeros(0) for c in out), read


def nearest(table: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest found.

    Queries: rows for which is_query(Column of ids) holds; candidates: every row but the query's own id (ties to the
    smaller id). Null ids, null, empty or all-zero vectors, and vectors with a null or non-finite component or of
    another length than most take no part. Repeated ids as in the exact search. No rows give no rows.
    """
    ship(table.sparkSession)
    rows = taking_part(table, id_col, vector_col, zero=False)
    shards, n = build_shards(rows, rows.count(), SHARD_ROWS, tree_columns, "kd-trees")

    def find(shard, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray):
        return search_shard(shard, query_ids, queries, k, bounds)[:3]

    return search(rows, is_query(F.col("vec_id")), shards, n, SHARD_ROWS * 800, open_tree, find, k, "double", False)
