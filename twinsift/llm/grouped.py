"""Work on groups of rows without a call per group, and connected components over edges of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


def map_sorted_groups(df: DataFrame, key: str, order: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Gathers rows by key and calls work with tables of whole groups, sorted by key and order.

    A table holds many small groups, or one large one. Callers keep groups bounded. The last group of a batch waits for the
    next batch, as it may go on there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            last = int(runs(keys)[-2])
            if wait and (last or keys[0] != wait[-1].column(b.schema.get_field_index(key))[-1].as_py()):
                yield from emit(wait + ([b.slice(0, last)] if last else []))
                wait = []
            elif last:
                yield from emit([b.slice(0, last)])
            wait.append(b.slice(last))
        if wait:
            yield from emit(wait)

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work(pa.Table.from_batches(parts).combine_chunks())
        if out is not None and out.num_rows:
            yield from out.to_batches(max_chunksize=50_000)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id in edges (u, v), ascending, and the least id reachable from it."""
    ids, label = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = label[: len(u)], label[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, rounds: int = 50, few: int = 0) -> DataFrame:
    """node and component (the least id reachable) of every id in edges (u, v); ids without an edge aren't returned.

    Up to ``few`` distinct edges are settled by one task: the rounds cost the driver as much for few edges as for many.

    Alternates the large-star and small-star steps until the edges are stars around each component's least id. Each round is
    cut off by a table in the shared folder. Neighbours are reduced by aggregation, from partial results, and the least ones are a
    table of their own before they are joined: this join shuffles both sides, so that Spark can split a hub's edges.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if few and now.count() <= few:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(held["u"].to_numpy(), held["v"].to_numpy())], ["node", "component"])

        return now.coalesce(1).mapInArrow(run, "node long, component long")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = first = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        discard(old, large, first, least)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
