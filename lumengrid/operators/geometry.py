"""Geometry: projections where pixels only move, and warps as a small table of taps.

A warp computes, for every target pixel, the source pixels it reads and their offsets. That table depends on the sizes
alone, so it is joined to the pixels by place, and one aggregation by target pixel puts the taps together: one shuffle,
with partial aggregation before it, in place of a join for each tap. It is broadcast while its size, known from the
target's dimensions, is under BROADCAST_TAPS rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import SPARK, Dialect

BROADCAST_TAPS = 1 << 20
LARGEST = 65535


class InvalidDimensions(ValueError):
    pass


class DimensionsTooLarge(ValueError):
    pass


class CropOutOfBounds(ValueError):
    pass


def check_dimensions(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise InvalidDimensions(f"{width} x {height}")
    if width > LARGEST or height > LARGEST:
        raise DimensionsTooLarge(f"{width} x {height}")


def channels(px: DataFrame) -> list[str]:
    return [c for c in px.columns if c not in ("image_id", "x", "y")]


def moved(px: DataFrame, x: str, y: str) -> DataFrame:
    return px.select("image_id", F.expr(f"CAST({x} AS INT)").alias("x"), F.expr(f"CAST({y} AS INT)").alias("y"), *channels(px))


def filled(spark, image_id: int, width: int, height: int, value: int = 0) -> DataFrame:
    """A grey image of one value."""
    check_dimensions(width, height)
    return spark.range(width * height).select(F.lit(image_id).cast("long").alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.expr(f"CAST(id div {width} AS INT)").alias("y"), F.lit(value).alias("v"))


def crop(px: DataFrame, x: int, y: int, width: int, height: int, source_width: int, source_height: int) -> DataFrame:
    if width <= 0 or height <= 0:
        raise InvalidDimensions(f"{width} x {height}")
    if x + width > source_width or y + height > source_height:
        raise CropOutOfBounds(f"{x},{y} {width} x {height}")
    return moved(px.where(f"x >= {x} AND x < {x + width} AND y >= {y} AND y < {y + height}"), f"x - {x}", f"y - {y}")


sub_view = crop


def rotate90(px: DataFrame, height: int) -> DataFrame:
    """Clockwise."""
    return moved(px, f"{height - 1} - y", "x")


def rotate180(px: DataFrame, width: int, height: int) -> DataFrame:
    return moved(px, f"{width - 1} - x", f"{height - 1} - y")


def flip_horizontal(px: DataFrame, width: int) -> DataFrame:
    return moved(px, f"{width - 1} - x", "y")


def flip_vertical(px: DataFrame, height: int) -> DataFrame:
    return moved(px, "x", f"{height - 1} - y")


def copy_rect(target: DataFrame, source: DataFrame, from_x: int, from_y: int, width: int, height: int, to_x: int, to_y: int) -> DataFrame:
    """target with a rectangle of source of the same image laid over it."""
    patch = moved(source.where(f"x >= {from_x} AND x < {from_x + width} AND y >= {from_y} AND y < {from_y + height}"), f"x - {from_x} + {to_x}", f"y - {from_y} + {to_y}")
    names = channels(target)
    patch = patch.select("image_id", "x", "y", *[F.col(c).alias(f"new_{c}") for c in names])
    return target.join(patch, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(f"new_{c}", c).alias(c) for c in names])


def get_row(px: DataFrame, y: int) -> DataFrame:
    return px.where(F.col("y") == y)


def set_pixel(px: DataFrame, x: int, y: int, values: dict[str, int]) -> DataFrame:
    here = (F.col("x") == x) & (F.col("y") == y)
    return px.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


# --- warps -----------------------------------------------------------------------------------------------------------
def resize_source(d: Dialect, width: int, height: int, to_width: int, to_height: int) -> tuple[str, str]:
    """Source place of a target pixel (x, y), in FLOAT."""
    return f"{d.f('x')} * {d.div(d.f(width), d.f(to_width))}", f"{d.f('y')} * {d.div(d.f(height), d.f(to_height))}"


def _f32(x: float) -> float:
    import numpy as np

    return float(np.float32(x))


def rotated_size(width: int, height: int, degrees: float) -> tuple[int, int, float, float]:
    """(width, height, cosine, sine) of a rotated canvas, in 32-bit arithmetic."""
    import numpy as np

    f = np.float32
    angle = f(degrees) * f(math.pi) / f(180)
    cos, sin = f(np.cos(angle)), f(np.sin(angle))
    corners = [(f(x), f(y)) for x, y in ((0, 0), (width, 0), (width, height), (0, height))]
    xs, ys = [x * cos - y * sin for x, y in corners], [x * sin + y * cos for x, y in corners]
    return int(max(xs) - min(xs) + f(1)), int(max(ys) - min(ys) + f(1)), float(cos), float(sin)


def rotation_source(d: Dialect, width: int, height: int, degrees: float) -> tuple[str, str, int, int]:
    to_width, to_height, cos, sin = rotated_size(width, height, degrees)
    fx, fy = f"({d.f('x')} - {d.f(to_width / 2)})", f"({d.f('y')} - {d.f(to_height / 2)})"
    c, s = d.f(repr(cos)), d.f(repr(sin))
    return f"{fx} * {c} + {fy} * {s} + {d.f(width / 2)}", f"-{fx} * {s} + {fy} * {c} + {d.f(height / 2)}", to_width, to_height


def perspective_source(d: Dialect, width: int, height: int, corners: list[tuple[float, float]]) -> tuple[str, str, int, int]:
    """By the box around the corners."""
    xs, ys = [_f32(x) for x, _ in corners], [_f32(y) for _, y in corners]
    u = d.div(f"{d.f('x')} + {d.f(min(xs))}", f"{d.f(max(xs))} - {d.f(min(xs))}")
    v = d.div(f"{d.f('y')} + {d.f(min(ys))}", f"{d.f(max(ys))} - {d.f(min(ys))}")
    return f"{u} * {d.f(width)}", f"{v} * {d.f(height)}", int(_f32(max(xs) - min(xs)) + 1), int(_f32(max(ys) - min(ys)) + 1)


def barrel_source(d: Dialect, width: int, height: int, strength: float) -> tuple[str, str]:
    """The centre itself reads from nowhere."""
    cx, cy = _f32(width / 2), _f32(height / 2)
    most = d.sqrt(f"{d.f(cx)} * {d.f(cx)} + {d.f(cy)} * {d.f(cy)}")
    dx, dy = f"({d.f('x')} - {d.f(cx)})", f"({d.f('y')} - {d.f(cy)})"
    radius = d.sqrt(f"{dx} * {dx} + {dy} * {dy}")
    part = d.div(radius, most)
    factor = f"({d.f(1)} + {d.f(strength)} * ({part} * {part}))"
    inside = lambda e: f"CASE WHEN {radius} > {d.f(0)} THEN {e} ELSE {d.f(-1)} END"
    return inside(f"{d.f(cx)} + {d.div(dx, factor)}"), inside(f"{d.f(cy)} + {d.div(dy, factor)}")


def corner_box(rows: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """rows with the box around their corners: left, top, box_width and box_height, truncated sides and one."""
    d = SPARK
    low, high = (lambda cs: f"least({', '.join(d.f(c) for c in cs)})"), (lambda cs: f"greatest({', '.join(d.f(c) for c in cs)})")
    side = lambda cs: F.expr(f"CAST({high(cs)} - {low(cs)} + {d.f(1)} AS INT)")
    return rows.withColumns({"left": F.expr(low(xs)), "top": F.expr(low(ys)), "box_width": side(xs), "box_height": side(ys)})


def mix4(d: Dialect, a: str, b: str, c: str, e: str, dx: str, dy: str) -> str:
    """Bilinear mean of upper left, upper right, lower left, lower right."""
    ix, iy = f"({d.f(1)} - {dx})", f"({d.f(1)} - {dy})"
    return f"{d.f(a)} * {ix} * {iy} + {d.f(b)} * {dx} * {iy} + {d.f(c)} * {ix} * {dy} + {d.f(e)} * {dx} * {dy}"


def _warp(px: DataFrame, sx: str, sy: str, width: int, height: int, to_width: int, to_height: int, clamp: bool) -> DataFrame:
    """Bilinear reading at (sx, sy); beyond the last full cell it is black, or clamped."""
    check_dimensions(to_width, to_height)
    d = SPARK
    grid = px.sparkSession.range(to_width * to_height).selectExpr(f"CAST(id % {to_width} AS INT) AS x", f"CAST(id div {to_width} AS INT) AS y")
    grid = grid.selectExpr("x AS tx", "y AS ty", f"{sx} AS sx", f"{sy} AS sy")
    inside = "true" if clamp else f"sx >= 0 AND sx < {d.f(width - 1)} AND sy >= 0 AND sy < {d.f(height - 1)}"
    grid = grid.selectExpr("tx", "ty", f"{inside} AS inside", "CAST(floor(sx) AS INT) AS x1", "CAST(floor(sy) AS INT) AS y1", "sx - floor(sx) AS dx0", "sx", "sy")
    grid = grid.selectExpr("tx", "ty", "inside", "x1", "y1", f"least(x1 + 1, {width - 1}) AS x2", f"least(y1 + 1, {height - 1}) AS y2", f"sx - {d.f('x1')} AS dx", f"sy - {d.f('y1')} AS dy")
    taps = "array(struct(0 AS tap, x1 AS sx, y1 AS sy), struct(1 AS tap, x2 AS sx, y1 AS sy), struct(2 AS tap, x1 AS sx, y2 AS sy), struct(3 AS tap, x2 AS sx, y2 AS sy))"
    taps = grid.where("inside").select("tx", "ty", "dx", "dy", F.explode(F.expr(taps)).alias("t")).selectExpr("tx", "ty", "dx", "dy", "t.tap AS tap", "t.sx AS x", "t.sy AS y")
    if 4 * to_width * to_height <= BROADCAST_TAPS:
        taps = F.broadcast(taps)
    names = channels(px)
    got = px.join(taps, ["x", "y"]).groupBy("image_id", "tx", "ty").agg(F.max("dx").alias("dx"), F.max("dy").alias("dy"), *[F.max(F.when(F.col("tap") == k, F.col(c))).alias(f"{c}_{k}") for c in names for k in range(4)])
    read = got.select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *[F.expr(f"coalesce({d.byte(mix4(d, *(f'{c}_{k}' for k in range(4)), 'dx', 'dy'))}, 0)").alias(c) for c in names])
    if clamp:
        return read
    # A target pixel that reads nothing is black: made row by row of the target, for each image's first pixel.
    lines = px.where("x = 0 AND y = 0").select("image_id", F.explode(F.sequence(F.lit(0), F.lit(to_height - 1))).alias("y")).repartition("image_id", "y")
    places = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to_width - 1)))).selectExpr("image_id", "x", "y", f"{sx} AS sx", f"{sy} AS sy")
    return read.unionByName(places.where(f"NOT ({inside})").select("image_id", "x", "y", *[F.lit(0).alias(c) for c in names]))


def resize(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    check_dimensions(to_width, to_height)
    return _warp(px, *resize_source(SPARK, width, height, to_width, to_height), width, height, to_width, to_height, True)


def resize_nearest(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    check_dimensions(to_width, to_height)
    grid = px.sparkSession.range(to_width * to_height).selectExpr(f"CAST(id % {to_width} AS INT) AS tx", f"CAST(id div {to_width} AS INT) AS ty")
    grid = grid.selectExpr("tx", "ty", f"CAST((CAST(tx AS BIGINT) * {width}) div {to_width} AS INT) AS x", f"CAST((CAST(ty AS BIGINT) * {height}) div {to_height} AS INT) AS y")
    grid = F.broadcast(grid) if to_width * to_height <= BROADCAST_TAPS else grid
    return px.join(grid, ["x", "y"]).select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *channels(px))


def rotate(px: DataFrame, width: int, height: int, degrees: float) -> DataFrame:
    sx, sy, to_width, to_height = rotation_source(SPARK, width, height, degrees)
    return _warp(px, sx, sy, width, height, to_width, to_height, False)


def perspective(px: DataFrame, width: int, height: int, corners: list[tuple[float, float]]) -> DataFrame:
    sx, sy, to_width, to_height = perspective_source(SPARK, width, height, corners)
    return _warp(px, sx, sy, width, height, to_width, to_height, False)


def correct_barrel(px: DataFrame, width: int, height: int, strength: float) -> DataFrame:
    if strength == 0:
        return px
    return _warp(px, *barrel_source(SPARK, width, height, strength), width, height, width, height, False)


def correct_pincushion(px: DataFrame, width: int, height: int, strength: float) -> DataFrame:
    return correct_barrel(px, width, height, -strength)
