"""Connected components by alternating large-star and small-star steps, each a partial minimum and a join in which the
rows of a hub are not dealt to one task. Few edges, counted first, are joined up by one task, with the same result.
Nodes are longs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, stored

#: Edges, of 16 bytes, that one task may hold.
ONE_TASK = 200_000


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node points to one centre and no centre points further."""
    nodes = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    centres = edges.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(True))
    return nodes.join(centres, "u", "left").where("n > 1 OR centre").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return lookup(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    moved = lookup(edges, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _step(edges: DataFrame) -> DataFrame:
    between = stored(_large_star(edges), "edges")
    after = stored(_small_star(between), "edges")
    discard(between)
    return after


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Edges (u, v), a bounded number, to (id, component)."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
        if parts:
            ids, pairs = np.unique(np.concatenate(parts), return_inverse=True)  # numbered in the order of ids
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[spanning(len(ids), pairs.reshape(-1, 2))])], names=["id", "component"])

    return edges.repartition(1).mapInArrow(span, "id long, component long")


def spanning(n: int, edges: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index reachable by edges."""
    label = np.arange(n)
    while len(edges):
        least = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        before = label.copy()
        np.minimum.at(label, edges[:, 0], least)
        np.minimum.at(label, edges[:, 1], least)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    return label


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every node of an edge that joins two nodes: the smallest id reachable. Rows with nulls and loops are left out."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    e = stored(e.where("ok AND u <> v").select("u", "v").distinct(), "edges")
    if e.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return _in_one_task(e)
    while not _is_forest_of_stars(e):
        before, e = e, _step(e)
        discard(before)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
