"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are scaled to length 1, on which cosine >= c is distance <= sqrt(2 - 2c). Equal scaled vectors of a label are one
point with a count. A label's points are dealt to cells around pivots, and cells to blocks of bounded size; pairs of
cells whose pivots are further apart than the sum of their radii and the threshold are pruned, and every other pair of
blocks is one task, so no task holds a label; but for the pivots, a bounded number, no vector leaves the executors. A task
builds a cover tree for each block (nested levels of halving radii: a node's points lie within its level's radius, and
the children of one node are further apart than theirs), descends both trees together, prunes node pairs by their
covering radii, and compares the leaves' vectors that remain.

Links are counted, not listed: each point gets its number of linked vectors and a spanning set of edges.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing; so do vectors of different lengths. Repeated rows and equal vectors link with one another, rows of one
id included. Null ids link with nothing: such a row has a null component and is kept, as nothing it could repeat is
known. Other columns are not touched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, few, lookup, runs, sliced, stored
from .components import components, spanning

#: Points of a block at most, about; a task holds two blocks.
BLOCK = 3000
#: Pivots of a label at most, and points of a label for each pivot about.
MAX_PIVOTS, CELL = 256, 1500
#: Room for rounding where bounds decide; whatever is nearer to the threshold is compared by its cosine.
SLACK = 1e-7


class CoverTree:
    """Levels of nodes over unit vectors: a node is within its level's radius of all points below it, each level halves it.

    `order` lists the points so that a node's points are order[start:stop], at every level; its children are the nodes
    first_child[k] to first_child[k + 1] of the next level. Nodes of few points aren't split further.
    """

    LEAST, FEW, BLOCK = 2.0**-7, 8, 256

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order = np.arange(n)
        self.centres, self.starts, self.first_child, self.radius = [], [], [], []
        centres, starts, radius = np.array([0]), np.array([0, n]), 2.0
        self._level(points, centres, starts)
        while radius > self.LEAST and (np.diff(starts) > self.FEW).any():
            radius /= 2
            new_centres, new_starts, first = [], [0], [0]
            for k in range(len(centres)):
                mine = self.order[starts[k] : starts[k + 1]]
                if len(mine) <= self.FEW:
                    new_centres.append(centres[k])
                    new_starts.append(starts[k + 1])
                else:
                    owner, found = self._split(points, mine, centres[k], radius)
                    by = np.argsort(owner, kind="stable")
                    self.order[starts[k] : starts[k + 1]] = mine[by]
                    new_centres += found
                    new_starts += (starts[k] + np.cumsum(np.bincount(owner, minlength=len(found)))).tolist()
                first.append(len(new_centres))
            self.first_child.append(np.array(first))
            centres, starts = np.array(new_centres), np.array(new_starts)
            self._level(points, centres, starts)

    def _level(self, points: np.ndarray, centres: np.ndarray, starts: np.ndarray) -> None:
        """Keeps a level, with each node's true covering radius."""
        own = np.repeat(centres, np.diff(starts))
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", points[own], points[self.order])))
        self.centres.append(centres)
        self.starts.append(starts)
        self.radius.append(np.maximum.reduceat(d, starts[:-1]))

    def _split(self, points: np.ndarray, mine: np.ndarray, first: int, radius: float) -> tuple[np.ndarray, list[int]]:
        """Greedy centres, the parent's first: a point goes to the first centre within the radius."""
        owner, found = np.full(len(mine), -1), []
        rest = np.concatenate([np.flatnonzero(mine == first), np.flatnonzero(mine != first)])
        while len(rest):
            near = distances(points[mine[rest[: self.BLOCK]]], points[mine[rest]]) <= radius
            free = np.ones(len(rest), bool)
            for i in range(len(near)):
                if free[i]:
                    got = near[i] & free
                    got[i] = True
                    owner[rest[got]] = len(found)
                    found.append(int(mine[rest[i]]))
                    free &= ~got
            rest = rest[free]
        return owner, found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Joined:
    """Links between the points of two sets by dual traversal; `same` where both are one set, whose pairs count once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, weights: tuple[np.ndarray, np.ndarray], cosine: float, same: bool):
        self.a, self.b, self.same, self.cosine = left, right, same, cosine
        self.t = float(np.sqrt(2 - 2 * cosine))
        self.wa, self.wb = weights
        self.links_a, self.links_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        self.edges: list[np.ndarray] = []
        if len(left) and len(right):
            ta = CoverTree(left)
            tb = ta if same else CoverTree(right)
            self._descend(ta, tb)

    def _descend(self, ta: CoverTree, tb: CoverTree) -> None:
        """Level by level all pairs of nodes that the bounds leave; both trees go down together."""
        pa, pb = np.zeros(1, np.int64), np.zeros(1, np.int64)
        deepest = max(len(ta.centres), len(tb.centres)) - 1
        for level in range(deepest + 1):
            la, lb = min(level, len(ta.centres) - 1), min(level, len(tb.centres) - 1)
            pa, pb = self._pruned(ta, tb, la, lb, pa, pb)
            if level < deepest:
                if la < len(ta.first_child):
                    pa, pb = _spread(ta.first_child[la], pa, pb)
                if lb < len(tb.first_child):
                    pb, pa = _spread(tb.first_child[lb], pb, pa)
                if self.same:
                    once = pa <= pb
                    pa, pb = pa[once], pb[once]
        if self.same:
            more = (pa != pb) | (np.diff(ta.starts[-1])[pa] > 1)
            pa, pb = pa[more], pb[more]
        self._leaves(ta, tb, pa, pb)

    def _pruned(self, ta, tb, la, lb, pa, pb):
        """The pairs of nodes whose points can be within the threshold."""
        ca, cb = self.a[ta.centres[la]], self.b[tb.centres[lb]]
        by = np.argsort(pa, kind="stable")
        pa, pb = pa[by], pb[by]
        keep = np.zeros(len(pa), bool)
        for at in range(0, len(ca), 512):
            begin, end = np.searchsorted(pa, [at, at + 512])
            i, j = pa[begin:end], pb[begin:end]
            if 32 * len(i) > min(512, len(ca) - at) * len(cb):
                dots = (ca[at : at + 512] @ cb.T)[i - at, j]
            else:
                dots = np.einsum("ij,ij->i", ca[i], cb[j])
            keep[begin:end] = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= self.t + ta.radius[la][i] + tb.radius[lb][j] + SLACK
        return pa[keep], pb[keep]

    def _leaves(self, ta, tb, pa, pb) -> None:
        """Cosines of all points of the pairs of leaves, one leaf of the left tree at a time."""
        by = np.argsort(pa, kind="stable")
        pa, pb = pa[by], pb[by]
        cuts = np.flatnonzero(np.concatenate([[True], pa[1:] != pa[:-1], [True]])) if len(pa) else np.zeros(1, np.int64)
        sa, sb = ta.starts[-1], tb.starts[-1]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            leaf, others = pa[begin], pb[begin:end]
            i = ta.order[sa[leaf] : sa[leaf + 1]]
            sizes = sb[others + 1] - sb[others]
            j = tb.order[np.repeat(sb[others] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            inner = np.repeat(others == leaf, sizes)
            for at in range(0, len(i), 512):
                rows = i[at : at + 512]
                hit = self.a[rows] @ self.b[j].T >= self.cosine
                if self.same:
                    hit &= ~inner[None, :] | (rows[:, None] < j[None, :])
                if not hit.any():
                    continue
                self.links_a[rows] += hit @ self.wb[j]
                self.links_b[j] += self.wa[rows] @ hit
                r, c = np.nonzero(hit)
                if len(r) > 4 * sum(hit.shape):  # a spanning forest is enough
                    label = spanning(len(rows) + len(j), np.stack([r, len(rows) + c], 1))
                    ids = np.concatenate([rows, j + len(self.a)])
                    self.edges.append(np.stack([ids, ids[label]], 1)[label != np.arange(len(label))])
                else:
                    self.edges.append(np.stack([rows[r], j[c] + len(self.a)], 1))

    def roots(self) -> np.ndarray:
        """For each point of left, then of right, the first point that links lead to."""
        edges = [np.stack([np.arange(len(self.b)), np.arange(len(self.b)) + len(self.a)], 1)] if self.same else []
        every = np.concatenate(edges + self.edges) if edges or self.edges else np.zeros((0, 2), np.int64)
        return spanning(len(self.a) + len(self.b), every)


def _spread(first_child: np.ndarray, parents: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of parents, each with its parent's other."""
    count = first_child[parents + 1] - first_child[parents]
    return np.repeat(first_child[parents] - np.cumsum(count) + count, count) + np.arange(count.sum()), np.repeat(others, count)


def _unit(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _valid(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


#: Pivots in all, at most about.
ALL_PIVOTS = 16_384


def _cells(reps: DataFrame, t: float) -> tuple[DataFrame, DataFrame | None]:
    """reps with cell and sub, and, for labels of several blocks, (label, dim, cell, sub) with the tasks that need them."""
    spark, group = reps.sparkSession, ["label", "dim"]
    sizes = stored(reps.groupBy(*group).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "labels")
    pivots_of = F.least(F.lit(MAX_PIVOTS), F.expr(f"m div {CELL}"))
    total = sizes.agg(F.sum(pivots_of)).first()[0]
    if total is None:
        return reps.withColumns({"cell": F.lit(0), "sub": F.lit(0)}), None
    # Pivots: the points of least hash among twice as many drawn.
    wanted = F.greatest(F.lit(1), F.floor(pivots_of * F.lit(min(1.0, ALL_PIVOTS / max(1, total))))).cast("int")
    rates = sizes.select(*group, "m", wanted.alias("wanted")).withColumn("rate", 2.0 * F.col("wanted") / F.col("m"))
    drawn = reps.join(few(rates.drop("m")), group).where(bucket("rep", buckets=1 << 30) < F.col("rate") * (1 << 30)).select(*group, "rep", "wanted", "vector").orderBy(*group, "rep").collect()
    pivots: dict[tuple, np.ndarray] = {}
    for r in drawn:
        have = pivots.setdefault((r["label"], r["dim"]), [])
        if len(have) < r["wanted"]:
            have.append(np.array(r["vector"], np.float64) / np.linalg.norm(r["vector"]))
    pivots = {k: np.array(v) for k, v in pivots.items()}
    shared = spark.sparkContext.broadcast(pivots)
    schema = T.StructType([*reps.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            cell, far = np.zeros(len(keys), np.int32), np.zeros(len(keys))
            for key in set(keys) & set(shared.value):
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                d = distances(_unit(batch.column("vector").take(pa.array(rows)), key[1]), shared.value[key])
                cell[rows], far[rows] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = stored(reps.mapInArrow(nearest, schema), "cells")
    found = placed.join(few(sizes.select(*group)), group, "left_semi").groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("far"))
    found = stored(found.select(*group, "cell", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("subs"), "far"), "cell-sizes")
    other = found.select(*group, F.col("cell").alias("d"), F.col("subs").alias("dn"), F.col("far").alias("far_d"))
    pairs = found.select(*group, F.col("cell").alias("c"), F.col("subs").alias("cn"), F.col("far").alias("far_c")).join(other, group).where("c <= d")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of cells that the bounds leave."""
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            c, d, reach = batch.column("c").to_numpy(), batch.column("d").to_numpy(), batch.column("far_c").to_numpy() + batch.column("far_d").to_numpy()
            keep = np.ones(len(keys), bool)
            for key in set(keys) & set(shared.value):
                rows, p = np.array([i for i, k in enumerate(keys) if k == key]), shared.value[key]
                apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", p[c[rows]], p[d[rows]])))
                keep[rows] = apart <= reach[rows] + t + SLACK
            yield batch.filter(pa.array(keep))

    pairs = stored(pairs.mapInArrow(near, pairs.schema), "cell-pairs")
    pairs = pairs.withColumn("cs", F.explode(F.sequence(F.lit(0), F.col("cn") - 1))).withColumn("ds", F.explode(F.sequence(F.lit(0), F.col("dn") - 1)))
    pairs = pairs.where("c <> d OR cs <= ds").withColumn("task", F.concat_ws(",", "c", "cs", "d", "ds"))
    left = pairs.select(*group, F.col("c").alias("cell"), F.col("cs").alias("sub"), "task", F.lit(0).alias("side"))
    right = pairs.where("c <> d OR cs <> ds").select(*group, F.col("d").alias("cell"), F.col("ds").alias("sub"), "task", F.lit(1).alias("side"))
    placed = placed.join(few(found.select(*group, "cell", "subs")), [*group, "cell"], "left").withColumn("sub", F.when(F.col("subs") > 1, bucket("rep", buckets=1 << 20, salt=3) % F.col("subs")).otherwise(0).cast("int"))
    return placed.drop("far", "subs"), left.unionAll(right)


def links(vectors: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    if not 0.5 <= cosine < 1:
        raise ValueError("cosine must be from 0.5 to 1")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _valid("vector"))
    reps = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("vector"))
    reps = stored(reps.select("label", "dim", "rep", "n", "vector"), "vectors")
    placed, tasks = _cells(reps, float(np.sqrt(2 - 2 * cosine)))
    if tasks is None:
        dealt = placed.withColumns({"task": F.lit("0,0,0,0"), "side": F.lit(0)})
    else:
        dealt = placed.join(few(tasks), ["label", "dim", "cell", "sub"], "left").withColumns({"task": F.coalesce("task", F.lit("0,0,0,0")), "side": F.coalesce("side", F.lit(0))})
    keys = ["label", "dim", "task"]
    dealt = dealt.select(*keys, "side", "rep", "n", "vector").repartition(*keys).sortWithinPartitions(*keys, "side", "rep")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, _), rows in runs(batches, keys):
            ids, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
            unit, left = _unit(rows["vector"], dim), int((rows["side"].to_numpy() == 0).sum())
            if left == len(ids):
                done = Joined(unit, unit, (n, n), cosine, True)
                count, root = done.links_a + done.links_b, done.roots()[: len(ids)]
            else:
                done = Joined(unit[:left], unit[left:], (n[:left], n[left:]), cosine, False)
                count, root = np.concatenate([done.links_a, done.links_b]), done.roots()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(ids[root])], names=["rep", "links", "root"])

    counted = stored(dealt.mapInArrow(join, "rep long, links long, root long").where("links > 0"), "links")
    degree = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(counted, "rep", "root").withColumnRenamed("id", "rep")
    known = stored(reps.select("label", "vector", "rep", "n").join(degree, "rep", "left").join(parts, "rep", "left"), "known")
    out = lookup(rows, known, ["label", "vector"], "n").withColumn("own", F.col("rep").isNotNull() & F.col("vec_id").isNotNull())
    component = F.when(F.col("own"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("own"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      AND list_dot_product(a.e, b.e) >= 0.93 * a.norm * b.norm),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
