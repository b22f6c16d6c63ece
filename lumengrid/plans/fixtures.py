"""Images derived from the driver's tables, in Spark and as SQL: 8 x 8 pixels from each embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    return e.select("vec_id", (F.col("p") % SIDE).alias("x"), F.floor(F.col("p") / SIDE).cast("int").alias("y"), "e")


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, v)"""
    v = F.expr("CAST(greatest(0, least(255, floor((e + 1.0D) * 127.5D))) AS INT)")
    return _cells(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "x", "y", v.alias("v"))


def _triples(cells: DataFrame, value: F.Column, kind: str, names: tuple[str, str, str]) -> DataFrame:
    """Three consecutive images as the channels of one; an incomplete last triple is dropped."""
    c = cells.select(F.floor(F.col("vec_id") / 3).cast("int").alias("image_id"), (F.col("vec_id") % 3).alias("c"), "x", "y", value.cast(kind).alias("value"))
    picked = [F.max(F.when(F.col("c") == k, F.col("value"))).alias(n) for k, n in enumerate(names)]
    return c.groupBy("image_id", "x", "y").agg(*picked, F.count(F.lit(1)).alias("n")).where("n = 3").drop("n")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b)"""
    return _triples(_cells(spark, sf_dir), F.expr("greatest(0, least(255, floor((e + 1.0D) * 127.5D)))"), "int", ("r", "g", "b"))


def hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, c0, c1, c2) of light"""
    return _triples(_cells(spark, sf_dir), F.expr("greatest(CAST(e AS FLOAT), CAST(0 AS FLOAT)) * CAST(4 AS FLOAT)"), "float", ("c0", "c1", "c2"))


def bayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, v) of 16 bits"""
    return _cells(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "x", "y", F.expr("CAST(floor((e + 1.0D) * 32767.0D) AS INT)").alias("v"))


CELLS_SQL = "cells AS (SELECT vec_id, (p % 8)::INT AS x, (p // 8)::INT AS y, e FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS p FROM embeddings))"
GREY_SQL = f"{CELLS_SQL}, grey AS (SELECT vec_id AS image_id, x, y, CAST(greatest(0, least(255, floor((e::DOUBLE + 1.0) * 127.5))) AS INT) AS v FROM cells)"
RGB_SQL = (
    f"{GREY_SQL}, rgb AS (SELECT (a.image_id // 3)::INT AS image_id, a.x, a.y, a.v AS r, b.v AS g, c.v AS b FROM grey a JOIN grey b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y "
    "JOIN grey c ON c.image_id = a.image_id + 2 AND a.x = c.x AND a.y = c.y WHERE a.image_id % 3 = 0)"
)
HDR_SQL = (
    f"{CELLS_SQL}, light AS (SELECT vec_id, x, y, greatest(e::FLOAT, 0::FLOAT) * 4::FLOAT AS v FROM cells), "
    "hdr AS (SELECT (a.vec_id // 3)::INT AS image_id, a.x, a.y, a.v AS c0, b.v AS c1, c.v AS c2 FROM light a JOIN light b ON b.vec_id = a.vec_id + 1 AND a.x = b.x AND a.y = b.y "
    "JOIN light c ON c.vec_id = a.vec_id + 2 AND a.x = c.x AND a.y = c.y WHERE a.vec_id % 3 = 0)"
)
BAYER_SQL = f"{CELLS_SQL}, bayer AS (SELECT vec_id AS image_id, x, y, CAST(floor((e::DOUBLE + 1.0) * 32767.0) AS INT) AS v FROM cells)"
