"""Connected components of a table of links, by contraction within parts.

Links are cut into parts of at most PART_BYTES. A part joins its links by union-find and tells of each of its nodes
only the root it got; roots follow a hashed order, so chains of rising ids shrink too. Nodes that parts gave different
roots leave links between those roots: a smaller problem of the same kind, at the nodes' bins. A node travels once a
part, however many links it has, so the centre of a star is no hot key. Levels follow until no link is left; then the
labels go back level by level. Nothing but a count a level comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bins_for, by_bin, materialise, mix64, ship

PART_BYTES = 4 << 20  # of links in a part
_LINK = np.dtype([("a", "<i8"), ("b", "<i8")])
_HELD = np.dtype([("node", "<i8"), ("root", "<i8"), ("least", "<i8")])


def joined(a: np.ndarray, b: np.ndarray, level: int = 0) -> np.ndarray:
    """Per node of the links: node, root (first of its component in the level's hashed order) and least node, as _HELD records."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    rank = np.empty(len(nodes), np.int64)
    order = np.argsort(mix64(nodes.view(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    rank[order] = np.arange(len(nodes))
    parent = list(range(len(nodes)))  # by rank
    for x, y in zip(rank[at[: len(a)]].tolist(), rank[at[len(a) :]].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    for i, p in enumerate(parent):  # parents come before
        parent[i] = parent[p]
    root = np.array(parent, np.int64)[rank]
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, root, nodes)
    out = np.empty(len(nodes), _HELD)
    out["node"], out["root"], out["least"] = nodes, nodes[order][root], least[root]
    return out


def _packed(blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["held"])


def _parts(links: DataFrame, n: int, level: int) -> DataFrame:
    """(held): the joined nodes of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, PART_BYTES // _LINK.itemsize):
                some = batch.slice(at, PART_BYTES // _LINK.itemsize)
                if size and (size + some.num_rows) * _LINK.itemsize > PART_BYTES:
                    yield _packed([joined(*(np.concatenate([k[c] for k in kept]) for c in "ab"), level).tobytes()])
                    kept, size = [], 0
                part = np.empty(some.num_rows, _LINK)
                part["a"], part["b"] = np.asarray(some.column(0)), np.asarray(some.column(1))
                kept.append(part)
                size += len(part)
        if size:
            yield _packed([joined(*(np.concatenate([k[c] for k in kept]) for c in "ab"), level).tobytes()])

    return materialise(links.coalesce(bins_for(n * _LINK.itemsize, PART_BYTES, 1)).mapInArrow(run, "held binary"), "parts")


def _between(parts: DataFrame, bins: int) -> DataFrame:
    """Links (a, b) between the roots that parts gave the same node."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held = np.frombuffer(blob, _HELD)
                to = (mix64(held["node"].view(np.uint64) + np.uint64(7)) >> np.uint64(32)) % np.uint64(bins)
                order = np.argsort(to, kind="stable")
                to, out = to[order], np.empty(len(held), _LINK)
                out["a"], out["b"] = held["node"][order], held["root"][order]
                cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]))
                yield pa.RecordBatch.from_pydict({"bin": to[cuts[:-1]].astype(np.int32), "pairs": pa.array([out[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        pairs = np.unique(np.frombuffer(b"".join(table.column("pairs").to_pylist()), _LINK))
        first = np.flatnonzero(np.concatenate(([True], pairs["a"][1:] != pairs["a"][:-1])))
        one = np.repeat(pairs["b"][first], np.diff(np.append(first, len(pairs))))
        out = np.empty(len(pairs), _LINK)
        out["a"], out["b"] = one, pairs["b"]
        out = np.unique(out[out["a"] != out["b"]])
        return pa.table({"a": out["a"], "b": out["b"]})

    return by_bin(parts.mapInArrow(send, "bin int, pairs binary"), "bin", bins).groupBy("bin").applyInArrow(meet, "a long, b long")


def _labels(links: DataFrame, level: int) -> DataFrame:
    """(node, root, least) of every node of the links; root is one of the component's nodes, least its smallest."""
    spark, n = links.sparkSession, links.count()
    parts = _parts(links, n, level)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held = np.frombuffer(blob, _HELD)
                yield pa.RecordBatch.from_arrays([pa.array(held[c]) for c in _HELD.names], names=list(_HELD.names))

    held = parts.mapInArrow(rows, "node long, root long, least long")
    if parts.count() < 2:  # one part has no other to meet
        return held
    left = materialise(_between(parts, bins_for(n * _HELD.itemsize, PART_BYTES)), "links")
    above = _labels(left, level + 1) if left.count() else spark.createDataFrame([], "node long, root long, least long")
    above = above.select(F.col("node").alias("root"), F.col("root").alias("above"))
    found = held.join(above, "root", "left").groupBy("node").agg(F.first(F.coalesce("above", "root")).alias("root"), F.min("least").alias("least"))
    found = materialise(found, "labels")
    return found.drop("least").join(found.groupBy("root").agg(F.min("least").alias("least")), "root").select("node", "root", "least")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b longs): component is the smallest node reachable. Self links and repeats do no harm; no links give no rows."""
    ship(links.sparkSession)
    return _labels(links.select("a", "b").where("a <> b"), 0).select("node", F.col("least").alias("component"))
