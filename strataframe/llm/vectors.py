"""What the two vector searches share: which rows take part, shards as table rows, and blocks of queries that meet them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bins_for, dealt, materialise

QUERY_BLOCK = 1024  # queries in a block
GROUP_BYTES = 64 << 20  # of shards that a copy of the queries is dealt to
FIRST = 16  # one shard of so many gives the queries a first bound


def taking_part(table: DataFrame, id_col: str, vector_col: str, zero: bool = True, largest: float = float("inf")) -> DataFrame:
    """(vec_id, v array<double>) of rows with an id and a vector of finite components up to `largest`; of the most frequent length (ties: the longer)."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    small = (lambda x: F.abs(x) <= F.lit(largest)) if largest < float("inf") else (lambda x: F.abs(x) < F.lit(largest))
    good = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & small(x), F.lit(False))))
    if not zero:
        good = good.where(F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return good.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def build_shards(rows: DataFrame, n: int, shard_rows: int, columns: Callable, label: str) -> tuple[DataFrame, int]:
    """(a table of one row a shard: shard and binary columns, number of shards). columns(ids, vectors) gives the binaries by name."""
    shards = bins_for(n, shard_rows, 1)
    names = sorted(columns(np.zeros(1, np.int64), np.ones((1, 1))))

    def build(table: pa.Table) -> pa.Table:
        made = columns(np.asarray(table.column("vec_id")), matrix(table.column("v")))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), **{c: pa.array([made[c]], pa.binary()) for c in names}})

    held = dealt(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))), "shard", bins_for(shards, 4, 1))
    return materialise(held.groupBy("shard").applyInArrow(build, ", ".join(["shard long", *(f"{c} binary" for c in names)])), label), shards


def _blocks(queries: DataFrame, n: int) -> DataFrame:
    """queries: vec_id, v, bound (double, may be null). (ids, q, bounds) binaries of about QUERY_BLOCK queries."""
    blocks = bins_for(n, QUERY_BLOCK, 1)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        bounds = np.array([np.nan if x is None else x for x in table.column("bound").to_pylist()], np.float64)
        made = {"ids": np.asarray(table.column("vec_id")).tobytes(), "q": matrix(table.column("v")).astype(np.float64).tobytes(), "bounds": bounds.tobytes()}
        return pa.table({k: pa.array([v], pa.binary()) for k, v in made.items()})

    held = dealt(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "block", bins_for(blocks, 8, 1))
    return held.groupBy("block").applyInArrow(pack, "ids binary, q binary, bounds binary")


def _answers(shards: DataFrame, n_shards: int, shard_bytes: int, blocks: DataFrame, open_shard: Callable, find: Callable, score_type: str) -> DataFrame:
    """(query_id, vec_id, score): what find(open shard, ids, queries, bounds) gives for every shard and block.

    Shards lie in groups; each group gets a copy of the query blocks, and they meet row by row, so that a task holds
    one shard and one block. Queries travel once a group, shards once.
    """
    groups = min(n_shards, bins_for(n_shards * shard_bytes, GROUP_BYTES, 64))
    kind = pa.int64() if score_type == "long" else pa.float64()
    names = [c for c in shards.columns if c != "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(["shard", "ids_q", "q", "bounds"])}
                if row["shard"] != last:
                    last, opened = row["shard"], open_shard({c: batch.column(4 + k)[i].as_py() for k, c in enumerate(names)})
                ids = np.frombuffer(row["ids_q"], "<i8")
                a, c, s = find(opened, ids, np.frombuffer(row["q"]).reshape(len(ids), -1), np.frombuffer(row["bounds"]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, kind)], names=["query_id", "vec_id", "score"])

    left = dealt(shards.withColumn("grp", F.pmod("shard", F.lit(groups))), "grp", groups)
    right = dealt(blocks.select(F.col("ids").alias("ids_q"), "q", "bounds", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp")), "grp", groups)
    pairs = left.hint("merge").join(right, "grp").select("shard", "ids_q", "q", "bounds", *names)
    return pairs.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")


def search(rows: DataFrame, is_query, shards: DataFrame, n_shards: int, shard_bytes: int, open_shard: Callable, find: Callable, k: int, score_type: str, largest: bool) -> DataFrame:
    """The k best of every query over all shards: query_id, rank, vec_id, score.

    Queries are rows, packed in blocks; none passes the driver. With several shards, one of FIRST answers alone at
    first; the k-th best score there bounds the k-th best of all, and every other shard gets it as the query's bound.
    The first answers stay, so that a bound never leaves a query with fewer than k. A shard answers with at most k rows
    a query, and the answers are ranked by query.
    """
    queries = materialise(rows.where(is_query).dropDuplicates(), "queries")
    n = queries.count()
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.col("score"), "vec_id")
    bounded, first = queries.withColumn("bound", F.lit(None).cast("double")), None
    if n_shards > 1:
        is_first, n_first = F.pmod("shard", F.lit(FIRST)) == 0, bins_for(n_shards, FIRST, 1)
        first = materialise(_answers(shards.where(is_first), n_first, shard_bytes, _blocks(bounded, n), open_shard, find, score_type), "first-answers")
        kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
        bounded, shards, n_shards = queries.join(kth, "vec_id", "left"), shards.where(~is_first), n_shards - n_first
    found = _answers(shards, n_shards, shard_bytes, materialise(_blocks(bounded, n), "blocks"), open_shard, find, score_type)
    found = found if first is None else first.unionByName(found)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    key = -scores if largest else scores
    if len(key) > 4 * k:
        cut = np.partition(key, k - 1)[k - 1]
        at = np.flatnonzero(key <= cut)
    else:
        at = np.arange(len(key))
    return at[np.lexsort((ids[at], key[at]))][:k]
