"""Operator 5: exact top-k search with vector-approximation files.

Each vector is approximated by a cell number per component (CELL_BITS bits between the component's extremes); the
approximations of a shard are one packed matrix next to the exact vectors. A query scans all cells first: with the
cell's middle and half width it bounds every inner product from both sides. Vectors whose upper bound is below the
k-th largest lower bound are out; the exact vectors of the others are read in order of their upper bound, until the
k-th best exact score is above the next bound. Scores are exact integers. The k-th best score found in a first shard
bounds the queries everywhere else.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .vectors import best, build_shards, search, taking_part

CELL_BITS = 6
SHARD_ROWS = 8192
SCALE = 1024
LARGEST = 65_536.0  # of a component; inner products of up to 2,047 such components fit a long
READ = 64  # exact vectors read at a time


def va_columns(ids: np.ndarray, vectors: np.ndarray) -> dict[str, bytes]:
    """A shard's file: ids, low and width of each component's cells, cells (bytes), exact (integers)."""
    exact = np.floor(vectors * SCALE)
    low, high = exact.min(axis=0), exact.max(axis=0)
    width = np.maximum((high - low) / (1 << CELL_BITS), 1e-9)
    cells = np.minimum((exact - low) // width, (1 << CELL_BITS) - 1).astype(np.uint8)
    return {"ids": ids.astype("<i8").tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": cells.tobytes(), "exact": exact.astype("<i8").tobytes()}


def open_va(row: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, low, width, cells, exact) of a shard's row."""
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["low"]), np.frombuffer(row["width"]), np.frombuffer(row["cells"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["exact"], "<i8").reshape(len(ids), -1)


def scan_shard(ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, exact: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, vector ids, scores) of a shard's k best for every query, and how many exact vectors were read.

    bounds: scores that a query's k best of all reach at least (not a number: not known); what is below does not count.
    """
    middle = low + (cells + 0.5) * width
    out: list[list[np.ndarray]] = [[], [], []]
    read = 0
    for a in range(0, len(queries), 128):
        q = queries[a : a + 128]
        centre, half = q @ middle.T, np.abs(q) @ (width / 2) + 1e-6 * (1 + np.abs(q) @ (np.abs(low) + width * (1 << CELL_BITS)))
        for i in range(len(q)):
            upper = centre[i] + half[i]
            others = np.flatnonzero(ids != query_ids[a + i])
            if not len(others):
                continue
            kth = min(k, len(others))
            floor = np.partition(centre[i][others], len(others) - kth)[len(others) - kth] - half[i]
            if bounds is not None and not np.isnan(bounds[a + i]):
                floor = max(floor, bounds[a + i])
            others = others[upper[others] >= floor]
            others = others[np.argsort(-upper[others], kind="stable")]
            whole, got, scores = q[i].astype(np.int64), 0, np.zeros(0, np.int64)
            while got < len(others):
                if got >= kth and np.partition(scores, got - kth)[got - kth] > upper[others[got]]:
                    break
                scores = np.concatenate((scores, exact[others[got : got + READ]] @ whole))
                got = min(got + READ, len(others))
            read += got
            at = best(scores, ids[others[:got]], kth, True) if got else others
            for column, v in zip(out, (np.full(len(at), query_ids[a + i]), ids[others[:got]][at], scores[at]), strict=True):
                column.append(v)
    return *(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out), read


def exact_top_k(table: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest integer inner products of floor(1024 * x) vectors.

    Queries: rows for which is_query(Column of ids) holds; candidates: every row but the query's own id (ties to the
    smaller id). Null ids, null or empty vectors, and vectors with a null or non-finite component, a component beyond
    LARGEST (scores would not fit a long) or of another length than most take no part. A row that repeats an id is a
    candidate of its own, and its id is not a candidate of itself; a repeated query id is answered once per distinct
    vector, ranked together. No rows give no rows.
    """
    ship(table.sparkSession)
    rows = taking_part(table, id_col, vector_col, largest=LARGEST)
    shards, n = build_shards(rows, rows.count(), SHARD_ROWS, va_columns, "va-file")

    def find(shard, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray):
        return scan_shard(*shard, query_ids, np.floor(queries * SCALE), k, bounds)[:3]

    return search(rows, is_query(F.col("vec_id")), shards, n, SHARD_ROWS * 600, open_va, find, k, "long", True)


def exact_top_k_sql(every: int = 100, k: int = 10) -> str:
    """The same in DuckDB SQL."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
