"""Reductions: histograms, equalisation, comparison of images, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions.numeric import SPARK
from .geometry import channels


#: Parts that the pixels of an image are dealt to where something of the image is joined to them.
PARTS = 32


def by_image(px: DataFrame, rows: DataFrame) -> DataFrame:
    """px joined with one row for each image, the pixels of an image in PARTS parts by their line."""
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return px.withColumn("part", F.col("y") % PARTS).join(rows, ["image_id", "part"]).drop("part")


def histogram(px: DataFrame) -> DataFrame:
    """(image_id, v, n) of a grey relation."""
    return px.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def equalise(px: DataFrame) -> DataFrame:
    """Histogram equalisation of a grey relation: counts, running sum in each image's at most 256 bins, which go back to its pixels as one map. A constant image becomes 0."""
    run = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("image_id")
    bins = histogram(px).withColumns({"cdf": F.sum("n").over(run), "total": F.sum("n").over(every)}).withColumn("least", F.min("cdf").over(every))
    d = SPARK
    mapped = f"CASE WHEN total = least THEN 0 ELSE {d.byte(d.div(f'{d.f("cdf - least")} * {d.f(255)}', d.f('total - least')))} END"
    curve = bins.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("v", F.expr(mapped).alias("mapped")))).alias("curve"))
    return by_image(px, curve).select("image_id", "x", "y", F.element_at("curve", F.col("v")).alias("v"))


def compare(left: DataFrame, right: DataFrame, rename: str = "image_id") -> DataFrame:
    """(image_id, avg_diff, max_diff, different_pixels, similarity) of images of one id and size."""
    names = channels(left)
    s, t = left.alias("s"), right.alias("t")
    per = s.join(t, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in ("image_id", "x", "y")]).select(F.col("s.image_id").alias("image_id"), sum((F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")) for c in names), F.lit(0)).alias("total"), F.greatest(F.lit(0), *[F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")) for c in names]).alias("most"))
    got = per.groupBy("image_id").agg(F.sum("total").alias("total"), F.max("most").alias("max_diff"), F.count_if(F.col("total") > 0).alias("different_pixels"), F.count(F.lit(1)).alias("n"))
    d = SPARK
    return got.select("image_id", F.expr(d.div(d.f("total"), d.f(f"n * {len(names)}"))).alias("avg_diff"), "max_diff", "different_pixels", F.expr(f"{d.f(100)} * {d.div(d.f('n - different_pixels'), d.f('n'))}").alias("similarity"))


def triangle(d, points: tuple) -> str:
    x1, y1, x2, y2, x3, y3 = (d.f(p) for p in points)
    return f"abs({d.div(f'{x1} * ({y2} - {y3}) + {x2} * ({y3} - {y1}) + {x3} * ({y1} - {y2})', d.f(2))})"


def profiles(spark) -> DataFrame:
    """The colour profiles as a table of seven rows."""
    rows = [(k, v[0], float(v[1]), *fm.PROFILE_WHITE, *v[2]) for k, v in fm.PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, name string, gamma float, white_x float, white_y float, red_x float, red_y float, green_x float, green_y float, blue_x float, blue_y float")


def gamut_coverage(spark) -> DataFrame:
    """(source, target, coverage) of every ordered pair of the seven profiles."""
    area = SPARK.div("red_x * (green_y - blue_y) + green_x * (blue_y - red_y) + blue_x * (red_y - green_y)", SPARK.f(2))
    p = profiles(spark).select("profile", F.expr(f"abs({area})").alias("area"))
    return p.select(F.col("profile").alias("source"), F.col("area").alias("a")).crossJoin(p.select(F.col("profile").alias("target"), F.col("area").alias("b"))).select("source", "target", F.expr(f"least({SPARK.f(1)}, {SPARK.div('b', 'a')})").alias("coverage"))


def batch_counters(results: DataFrame) -> DataFrame:
    """Totals of a batch by its rows' status: processed, failed or skipped."""
    return results.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "failed", "skipped")])


def memory_statistics(events: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """Running current, total and peak of allocations (positive) and releases (negative), by key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumns({"current": F.sum(delta).over(w), "allocated": F.sum(F.greatest(F.col(delta), F.lit(0))).over(w)})
    return run.withColumn("peak", F.max("current").over(w)).select(key, order, "current", "allocated", "peak")
