"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word target; the mix first repeats a source's documents in complete epochs, then takes a fraction by
weighted sampling without replacement: each document has the key -ln(u) / quality, with u from a hash of its id, and the
documents with the smallest keys are taken until the remaining budget is spent, the last one in part.

The prefix sums are made in two levels so that no task holds a whole source: sizes are summed by (source, key slot),
the slots' sums are accumulated, and rows are only ordered inside a slot.

Defined results: null texts have size 0 and take 0; the null source is a source of its own, the last; null or
non-positive quality counts as the default; repeated rows each count, ties are ordered by id, then by a hash of the text.
An empty table gives an empty result. A source whose words are all zero has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A word, for sizes: a run of anything but blank and the ASCII controls 9 to 13.
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
#: The most sources for which the targets are sent to every task; beyond, they are joined by key.
BROADCAST_SOURCES = 20_000
#: Rows that a slot holds about.
SLOT_ROWS = 5_000
DEFAULT_QUALITY = 0.5
U = 2**52


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column) -> Column:
    """A number between 0 and 1, both excluded, from the digest of a value."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(U))


def targets(totals: DataFrame, cycle: int = 3, cap: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target; the table has one row for each source.

    With the sources in order of cap * size / weight those that reach their cap come first, so the level of the others
    follows from sums over the sources before and after each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("double"))
    w = w.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    w = w.withColumn("open", F.col("most") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(every)["level"]
    return w.withColumn("target", F.round(F.when(level.isNull(), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("weight"))), 6)).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", ratings: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, epochs, taken. ratings: (doc_id, quality)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("tie"))
    if ratings is None:
        rows = rows.withColumn("quality", F.lit(DEFAULT_QUALITY))
    else:  # only ids and sizes are joined, never texts
        rated = ratings.groupBy(F.col("doc_id").alias("rated_id")).agg(F.max("quality").cast("double").alias("quality"))
        rows = rows.join(rated, F.col("doc_id") == F.col("rated_id"), "left").drop("rated_id")
        rows = rows.withColumn("quality", F.when(F.col("quality") > 0, F.col("quality")).otherwise(DEFAULT_QUALITY))
    rows = rows.withColumn("draw", -F.log(uniform(F.col("doc_id"))) / F.col("quality"))
    rows = stored(rows, "mix")  # texts are read and counted once
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(totals.select("source", "source_size"))
    n = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("sources")).first()
    slots = max(256, n["rows"] // SLOT_ROWS)
    # Slots follow the order of the draws and spread them, whatever the quality.
    rows = rows.withColumn("slot", F.floor(F.col("draw") / (1 + F.col("draw")) * slots).cast("int"))
    parts = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    run = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("slots_before", F.coalesce(F.sum("slot_size").over(run), F.lit(0)))
    small = F.broadcast if n["sources"] <= BROADCAST_SOURCES else (lambda x: x)
    few = F.broadcast if n["sources"] * slots <= 8 * BROADCAST_SOURCES else (lambda x: x)
    p, t = parts.alias("p"), plan.alias("t")
    inside = Window.partitionBy("source", "slot").orderBy("draw", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("slot_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
    joined = r.join(few(p), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slot") == F.col("p.slot"))).join(small(t), F.col("r.source").eqNullSafe(F.col("t.source")))
    words = F.round(F.col("t.target")).cast("long")
    epochs = F.when(F.col("t.source_size") > 0, F.expr("CAST(round(t.target) AS BIGINT) div greatest(t.source_size, 1)")).otherwise(0)
    left = words - epochs * F.col("t.source_size") - F.col("p.slots_before") - F.col("r.slot_before")
    part = F.greatest(F.lit(0), F.least(F.col("r.size"), left))
    return joined.select(F.col("r.doc_id").alias("doc_id"), F.col("r.source").alias("source"), F.col("r.size").alias("size"), F.col("t.source_size").alias("source_size"), F.col("t.target").alias("target"), epochs.cast("long").alias("epochs"), (epochs * F.col("r.size") + part).cast("long").alias("taken"))


#: The mix of `documents` by DuckDB; quality weights as in registry.ratings.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN q.quality IS NULL THEN 0.5 WHEN q.quality > 0 THEN 1.0 ELSE 0.25 END AS quality,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY (most > level * weight) DESC, most / weight, source NULLS LAST) AS k FROM l),
t AS (SELECT source, source_size,
        round(CASE WHEN NOT (SELECT bool_or(most > level * weight) FROM o) THEN most
              ELSE least(most, (SELECT level FROM o WHERE k = 1) * weight) END, 6) AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM r
"""
