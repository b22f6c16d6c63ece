"""Bayer mosaics: colour of a place, and demosaicing by scattering to neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERNS = ("rggb", "bggr", "grbg", "gbrg")
#: Fixed offsets whose samples a missing channel is the mean of: for red and blue, and for green.
DIAGONAL = [(-1, -1), (-1, 1), (1, -1), (1, 1), (-2, 0), (2, 0), (0, -2), (0, 2)]
ADJACENT = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def colour_at(pattern: str, x: str = "x", y: str = "y") -> str:
    """SQL of the colour at a place: the pattern's four letters are those of even and odd columns of even, then odd rows."""
    if pattern not in PATTERNS:
        raise ValueError(f"UnsupportedBayerPattern: {pattern}")
    a, b, c, e = pattern
    return f"CASE WHEN {y} % 2 = 0 THEN CASE WHEN {x} % 2 = 0 THEN '{a}' ELSE '{b}' END ELSE CASE WHEN {x} % 2 = 0 THEN '{c}' ELSE '{e}' END END"


def demosaic(px: DataFrame, pattern: str = "rggb") -> DataFrame:
    """(image_id, x, y, v) of 16 bits to samples r, g, b. A missing channel without a sample of its colour near is 0."""
    own = px.select("image_id", "x", "y", F.expr("CAST(least(255, v div 256) AS INT)").alias("v"), F.expr("v div 256").alias("full"), F.expr(colour_at(pattern)).alias("colour"))
    offsets = lambda taps: F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), *taps]])
    spread = own.select("image_id", "x", "y", "v", "full", "colour", F.explode(F.when(F.col("colour") == "g", offsets(ADJACENT)).otherwise(offsets(DIAGONAL))).alias("t"))
    spread = spread.select("image_id", (F.col("x") + F.col("t.dx")).alias("x"), (F.col("y") + F.col("t.dy")).alias("y"), "v", "full", "colour", ((F.col("t.dx") == 0) & (F.col("t.dy") == 0)).alias("own"))
    mean = lambda c: F.coalesce(F.max(F.when(F.col("own") & (F.col("colour") == c), F.col("v"))), F.expr(f"CAST(least(255, sum(CASE WHEN NOT own AND colour = '{c}' THEN full END) div nullif(count(CASE WHEN NOT own AND colour = '{c}' THEN 1 END), 0)) AS INT)"), F.lit(0))
    return spread.groupBy("image_id", "x", "y").agg(*[mean(c).alias(c) for c in "rgb"], F.bool_or("own").alias("there")).where("there").drop("there")


#: Signatures of camera formats: (format, hex of the first bytes); the first that fits is taken.
SIGNATURES = [("cr2", "49492A00", "4352"), ("nef", "49492A00", ""), ("nef", "4D4D002A", ""), ("arw", "534F4E59", ""), ("raf", "46554A4946494C4D", ""), ("orf", "4F4C594D50", ""), ("rw2", "50414E41", "")]


def raw_format(content: str = "content") -> F.Column:
    """The camera format of file bytes, null where there is none; the second mark stands at byte 8."""
    out = None
    for name, first, at8 in SIGNATURES:
        hit = F.hex(F.substring(content, 1, len(first) // 2)) == first
        if at8:
            hit = hit & (F.hex(F.substring(content, 9, len(at8) // 2)) == at8)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
