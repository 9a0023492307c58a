"""Operator 7: near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 2**32 shingle hashes are enough for all coordinates: sigma scatters the shingles, and
coordinate k is the smallest value of pi, shifted circularly by k, over a document's shingles. Bands of coordinates make
candidates; their number and width follow from the similarity asked for, so that a pair exactly at it is missed with
probability MISS at most (51 bands of 6 at 0.80, 40 of 7 at 0.85). Exact copies of a shingle set are merged first; a
set is a node with a number of its own, so ids may be any longs or null. Links of different sets come about in three steps:

1. Buckets. Sets that share a band are searched breadth-first on 1-bit sketches: a bucket gives a forest of likely
   links (at most its size), never all pairs. Sets of a slice of the table that share a band are joined before they
   travel, and the first goes for all: a very large bucket sends one record a slice. A bucket with such records is
   joined whole, since those left at home may be like any of it. The components of the forests are clusters.
2. Clusters. Full shingle sets meet in their cluster, in blocks of at most BLOCK sets, together with the cluster's
   best-linked sets; a breadth-first search with exact intersections finds the components of each block.
3. Clusters of more than one block. Sets that are not yet in their cluster's largest component, the outsiders, meet
   every block of it, up to BLOCK outsiders at once: a block travels once for so many outsiders, not once a block. All
   pairs of a cluster that could join two components have then been compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bins_for, by_bin, dealt, materialise, mix64, rows_of, ship, tasks_for, word_hashes
from .components import components, joined

SHINGLE = 5
PERCENT = 80  # 100 * intersection >= PERCENT * union
MISS = 2e-7  # probability that a pair exactly at the similarity shares no band
COORDINATES = 320  # bands * rows at most, where rows of more than 1 allow it
SKETCH_BITS = 128
BLOCK = 1000  # sets in a block
BLOCK_SHINGLES = 2_000_000  # or shingles
HUBS = 8
BIN_BYTES = 8 << 20
SLICE_SETS = 2000  # whose common bands are found before they travel
_BUCKET = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<u4"), ("sketch", "<u8", (2,))])


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles (lower-cased words; fewer words than `size`: one shingle of all)."""
    h, counts = word_hashes(texts, lower=True)
    step = np.uint64(0x9E3779B97F4A7C15)
    mixed = np.zeros(len(h), np.uint64)
    for j in range(size):
        mixed[: max(len(h) - j, 0)] = mix64(mixed[: max(len(h) - j, 0)] * step + h[j:])
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(mixed[at : at + n - size + 1]))
        else:
            whole = np.array([n] * bool(n), np.uint64)
            for j in range(at, at + n):
                whole = mix64(whole * step + h[j : j + 1])
            out.append(whole)
        at += n
    return out


@cache
def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of a band): the widest bands within COORDINATES that miss a pair at `percent` with probability MISS at most."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent {percent} is not in 1 to 100")
    if percent == 100:
        return 1, COORDINATES

    def bands(rows: int) -> int:
        return ceil(log(MISS) / log1p(-((percent / 100) ** rows)))

    rows = 1
    while bands(rows + 1) * (rows + 1) <= COORDINATES:
        rows += 1
    return bands(rows), rows


def coordinates_for(percent: int) -> int:
    """Coordinates that the bands and the sketch need."""
    bands, rows = banding(percent)
    return max(bands * rows, SKETCH_BITS)


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash: coordinate k is the minimum of pi(sigma(shingle) + k)."""
    sigma = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts, best = np.arange(coordinates, dtype=np.uint32), np.full(coordinates, 0xFFFFFFFF, np.uint32)
    width = max(1, 60_000 // coordinates)
    for a in range(0, len(sigma), width):
        np.minimum(best, _pi(np.add.outer(sigma[a : a + width], shifts)).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    bands, rows = banding(percent)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for column in sig[: bands * rows].reshape(bands, rows).T:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first SKETCH_BITS coordinates."""
    return np.packbits((mix64(sig[:SKETCH_BITS].astype(np.uint64)) >> np.uint64(40) & np.uint64(1)).astype(bool)).view("<u8")


def least_agreement(percent: int) -> int:
    """Bits in which the sketches of a linked pair agree, less six deviations."""
    p = (1 + percent / 100) / 2
    return int(SKETCH_BITS * p - 6 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def bucket_forest(n: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members whose sketches and sizes allow the similarity."""
    agree, rest, links = least_agreement(percent), np.arange(len(n)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop(0)
            same = SKETCH_BITS - np.bitwise_count(sketches[rest] ^ sketches[p]).sum(axis=1, dtype=np.int64)
            ok = (same >= agree) & (np.minimum(n[rest], n[p]) * 100 >= percent * np.maximum(n[rest], n[p]))
            found = rest[ok].tolist()
            links += [(p, x) for x in found]
            queue += found
            rest = rest[~ok]
    return links


def exact_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph whose edges are exactly the pairs of sets at the similarity or above."""
    n = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    ids = [x.astype(np.int32) for x in np.split(ids, np.cumsum(n)[:-1])] if sets else []
    mark, links = np.zeros(max((int(x.max()) for x in ids if len(x)), default=0) + 1, bool), []
    rest = np.flatnonzero(n > 0)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop(0)
            fit = np.minimum(n[rest], n[p]) * 100 >= percent * np.maximum(n[rest], n[p])
            near = rest[fit]
            if not len(near):
                continue
            mark[ids[p]] = True
            both = np.add.reduceat(mark[np.concatenate([ids[i] for i in near.tolist()])], np.concatenate(([0], np.cumsum(n[near])))[:-1], dtype=np.int64)
            mark[ids[p]] = False
            ok = 100 * both >= percent * (n[near] + n[p] - both)
            found = near[ok].tolist()
            links += [(p, x) for x in found]
            queue += found
            fit[fit] = ok
            rest = rest[~fit]
    return links


def _profiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, row_key, text -> doc_id, row_key, n, two halves of the set's 128-bit fingerprint, band keys, sketch."""
    for part, texts in rows_of(batches):
        out: list[list] = [[], [], [], [], []]
        seen: dict[bytes, tuple] = {}
        for s in shingle_sets(texts):
            if not len(s):
                row = (0, None, None, None, None)
            else:
                raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if raw not in seen:
                    sig = signature(s, coordinates_for(percent))
                    f1, f2 = np.frombuffer(raw, "<i8").tolist()
                    seen[raw] = (len(s), f1, f2, band_keys(sig, percent).tobytes(), sketch(sig).tobytes())
                row = seen[raw]
            for column, v in zip(out, row, strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))], names=["doc_id", "row_key", "n", "f1", "f2", "bands", "sketch"])


def _likely(sets: DataFrame, bins: int, percent: int) -> DataFrame:
    """Likely links (a, b) of nodes, from the forests of all buckets; a pair may come from several buckets.

    A record with n = 0 stands for several sets of a slice. Negative bins hold links that slices found.
    """
    bands, _ = banding(percent)

    def packed(to: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(to, kind="stable")
        to, records = to[order], records[order]
        cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]))
        return pa.RecordBatch.from_pydict({"bin": to[cuts[:-1]].astype(np.int32), "members": pa.array([records[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_SETS):
                part = batch.slice(at, SLICE_SETS)
                out = np.empty((part.num_rows, bands), _BUCKET)
                out["key"] = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u8").reshape(-1, bands)
                out["node"], out["n"] = np.asarray(part.column(0))[:, None], np.asarray(part.column(1))[:, None]
                out["sketch"] = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u8").reshape(-1, 1, 2)
                out = out.ravel()
                order = np.argsort(out["key"], kind="stable")
                key, node = out["key"][order], out["node"][order]
                first = np.concatenate(([True], key[1:] != key[:-1]))
                rep = np.flatnonzero(first)[np.cumsum(first) - 1]
                if not first.all():
                    links = joined(node[rep[~first]], node[~first])
                    links = links[links["node"] != links["least"]]
                    pairs = np.stack((links["node"], links["least"]), axis=1)
                    yield packed(-1 - pairs[:, 0] % bins, pairs)
                several = np.zeros(len(out), bool)
                several[rep[~first]] = True
                out = out[order[first]]
                out["n"][several[first]] = 0
                yield packed(((out["key"] >> np.uint64(32)) % np.uint64(bins)).astype(np.int64), out)

    def meet(table: pa.Table) -> pa.Table:
        raw = b"".join(table.column("members").to_pylist())
        if table.num_rows and table.column("bin")[0].as_py() < 0:
            links = np.unique(np.frombuffer(raw, "<i8").reshape(-1, 2), axis=0)
            return pa.table({"a": links[:, 0], "b": links[:, 1]})
        m = np.frombuffer(raw, _BUCKET)
        m = m[np.argsort(m["key"], kind="stable")]
        cuts = np.concatenate(([0], np.flatnonzero(m["key"][1:] != m["key"][:-1]) + 1, [len(m)]))
        big = np.flatnonzero(np.diff(cuts) > 1)
        links = set()
        for a, b in zip(cuts[big].tolist(), cuts[big + 1].tolist(), strict=True):
            part = np.sort(m[a:b], order="node")
            node = part["node"].tolist()
            if not part["n"].all():
                links.update((x, node[0]) for x in node[1:])
                continue
            links.update((node[x], node[p]) if node[x] > node[p] else (node[p], node[x]) for p, x in bucket_forest(part["n"].astype(np.int64), part["sketch"], percent))
        links = np.array(sorted(links), np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    sent = sets.select("node", "n", "bands", "sketch").mapInArrow(send, "bin int, members binary")
    return by_bin(sent, "bin", bins).groupBy("bin").applyInArrow(meet, "a long, b long")


def _block_links(table: pa.Table, percent: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(nodes of a block, links between their places); a set that came twice is there once."""
    nodes, first = np.unique(np.asarray(table.column("node")), return_index=True)
    texts = table.column("text").take(pa.array(first)).to_pylist()
    return nodes.tolist(), exact_forest(shingle_sets([t.encode() for t in texts]), percent)


def _verified(members: DataFrame, tasks: int, percent: int) -> DataFrame:
    """members: cluster, part, node, text. Links (a, b) within each (cluster, part), exact."""

    def meet(table: pa.Table) -> pa.Table:
        nodes, links = _block_links(table, percent)
        return pa.table({"a": pa.array([nodes[p] for p, _ in links], pa.int64()), "b": pa.array([nodes[x] for _, x in links], pa.int64())})

    return dealt(members.select("cluster", "part", "node", "text"), ["cluster", "part"], tasks).groupBy("cluster", "part").applyInArrow(meet, "a long, b long")


def _whole(members: DataFrame, tasks: int, percent: int) -> DataFrame:
    """members: cluster, node, text; clusters of one block. (node, component) of every node."""

    def meet(table: pa.Table) -> pa.Table:
        nodes, links = _block_links(table, percent)
        root = list(range(len(nodes)))
        for p, x in links:  # a forest in breadth-first order: p has its root
            root[x] = root[p]
        least: dict[int, int] = {}
        for node, r in zip(nodes, root, strict=True):
            least[r] = min(node, least.get(r, node))
        return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([least[r] for r in root], pa.int64())})

    return dealt(members.select("cluster", "node", "text"), "cluster", tasks).groupBy("cluster").applyInArrow(meet, "node long, component long")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose node (the first column) the task has not met before."""
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        fresh = [i for i, x in enumerate(nodes) if not (x in seen or seen.add(x))]
        yield batch.take(pa.array(fresh, pa.int64()))


def _large(large: DataFrame, likely: DataFrame, tasks: int, percent: int) -> DataFrame:
    """large: cluster, part, blocks, node, text of clusters of several blocks. (node, component) of their linked nodes."""
    places = large.select("cluster", "blocks", "node").distinct()
    degree = likely.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    order = Window.partitionBy("cluster").orderBy(F.desc("count"), "node")
    hubs = places.join(degree, "node").withColumn("r", F.row_number().over(order)).where(F.col("r") <= HUBS).select("node")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    hubs = large.join(hubs, "node", "left_semi").withColumn("part", every)
    first = components(materialise(_verified(large.unionByName(hubs), tasks, percent), "verified"))
    first = materialise(first, "first")
    held = places.join(first, "node", "left").withColumn("c", F.coalesce("component", "node"))
    main = held.groupBy("cluster", "c").count().groupBy("cluster").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    outside = held.join(main, "cluster").where("c <> main").select("cluster", "node")
    rounds = outside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rounds"))
    # every block meets up to about BLOCK outsiders at a time
    outside = materialise(outside.join(rounds, "cluster").select("node", "rounds", F.pmod(F.xxhash64("node", F.lit(1)), "rounds").cast("int").alias("turn")), "outside")
    meeting = (F.col("turn") * F.col("blocks") + F.col("part")).alias("part")
    left = large.drop("part").join(outside, "node").withColumn("part", every).select("cluster", meeting, "node", "text")
    turns = outside.join(places, "node").select("cluster", "rounds").distinct()
    right = large.join(turns, "cluster").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).select("cluster", meeting, "node", "text")
    links = _verified(left.unionByName(right), tasks, percent).unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(materialise(links, "verified"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept, row_key.

    Links: 100 * intersection >= percent * union of the sets of 5-word shingles. kept: the document's id is its
    component's. Null, empty and blank texts have an empty set and no links: they are kept. Rows with equal ids are
    documents of their own. A null id is no smallest id; where a component has no other, its component_id is null and
    the documents of one of its sets are kept. row_key is the hash of id and text. No rows give no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("row_key"), text.alias("text"))
    held = materialise(rows.mapInArrow(lambda batches: _profiles(batches, percent), "doc_id long, row_key long, n long, f1 long, f2 long, bands binary, sketch binary"), "profiles")
    sets = held.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")  # the numbers hold from here on
    likely = materialise(_likely(sets, bins_for(sets.count() * banding(percent)[0] * _BUCKET.itemsize, BIN_BYTES), percent), "likely")
    members = components(likely).join(sets.select("node", "row_key", "n"), "node")
    members = materialise(members.withColumnRenamed("component", "cluster"), "clusters")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(members.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").select("row_key", "node", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("part"))
    # the texts of all documents, by key, meet the members: the same join at every size
    tasks = tasks_for(8 * (held.agg(F.sum("n")).first()[0] or 0))
    texts = dealt(rows.where("text is not null"), "row_key", tasks).hint("merge").join(dealt(placed, "row_key", tasks), "row_key").select("node", "cluster", "blocks", "part", "text")
    texts = materialise(texts.mapInArrow(_once, texts.schema), "members")

    tasks = tasks_for(8 * (members.agg(F.sum("n")).first()[0] or 0))
    found = _whole(texts.where("blocks = 1"), tasks, percent)
    large = texts.where("blocks > 1")
    if not large.isEmpty():
        found = found.unionByName(_large(large, likely, tasks, percent))
    found = materialise(found, "found")
    ids = found.join(sets.select("node", "id"), "node")
    least = ids.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = sets.select("f1", "f2", "node", "id").join(found.join(least, "component"), "node", "left")
    classes = classes.select("f1", "f2", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("component", "node") == F.col("node")).alias("first"))
    out = held.select("doc_id", "row_key", "n", "f1", "f2").join(classes, ["f1", "f2"], "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.when(F.col("n") == 0, True).when(F.col("component_id").isNull(), F.col("first")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "row_key")


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns; rows that repeat both id and text stay once. Edge cases as in `near_duplicates`."""
    kept = near_duplicates(docs, percent, id_col, text_col).where("kept").select("row_key")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row_key"))
    return held.join(materialise(kept.distinct(), "kept"), "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")
