"""Neighbourhood filters over pixel relations of known size.

The separable blurs, box and Gaussian, are two RANGE windows, by row and by column of an image: two shuffles, so that no
task holds a whole image, however large one is, and rows are never multiplied. Other kernels scatter: each pixel gives its
weighted value to the target pixels around it, by exploding a constant array of offsets, and one aggregation by target
pixel, partial first, adds them up. No join is made, and the sums are of integers (weights are in fixed point), so they
do not depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import channels

#: Fixed point of kernel weights, and of the weights along one axis, whose products they are.
ONE = 1 << 52
AXIS_ONE = 1 << 26
SHARPEN = [(0, -1, -1), (-1, 0, -1), (0, 0, 5), (1, 0, -1), (0, 1, -1)]
SOBEL_X = [(-1, -1, -1), (1, -1, 1), (-1, 0, -2), (1, 0, 2), (-1, 1, -1), (1, 1, 1)]
SOBEL_Y = [(-1, -1, -1), (0, -1, -2), (1, -1, -1), (-1, 1, 1), (0, 1, 2), (1, 1, 1)]


class InvalidKernel(ValueError):
    pass


def box_blur(px: DataFrame, radius: int) -> DataFrame:
    """Horizontal, then vertical mean over the part of the window inside the image, truncated after each."""
    if radius == 0:
        return px
    names = channels(px)
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("image_id", other).orderBy(axis).rangeBetween(-radius, radius)
        sums = px.withColumns({f"sum_{c}": F.sum(c).over(w) for c in names} | {"n": F.count(F.lit(1)).over(w)})
        px = sums.select("image_id", "x", "y", *[F.expr(f"CAST(sum_{c} div n AS INT)").alias(c) for c in names])
    return px


def _scatter(px: DataFrame, taps: list[tuple[int, int, dict[str, int]]], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums by target pixel. taps: (dx, dy, weights) of the source as seen from the target; sums: name -> (channel, weight)."""
    kinds = sorted({w for _, _, ws in taps for w in ws})
    table = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), *[F.lit(ws.get(k, 0)).cast("long").alias(k) for k in kinds]) for dx, dy, ws in taps])
    names = channels(px)
    spread = px.select("image_id", "x", "y", *names, F.explode(table).alias("t")).select("image_id", (F.col("x") + F.col("t.dx")).alias("x"), (F.col("y") + F.col("t.dy")).alias("y"), F.when((F.col("t.dx") == 0) & (F.col("t.dy") == 0), F.struct(*names)).alias("own"), *[(F.col(c) * F.col(f"t.{k}")).alias(n) for n, (c, k) in sums.items()])
    # Targets outside the image get no value of their own and go.
    return spread.groupBy("image_id", "x", "y").agg(F.max("own").alias("own"), *[F.sum(n).alias(n) for n in sums]).where("own IS NOT NULL")


def interior(width: int, height: int, margin: int = 1) -> str:
    return f"x >= {margin} AND x < {width - margin} AND y >= {margin} AND y < {height - margin}"


def _with_centre(taps: dict) -> list:
    taps.setdefault((0, 0), {})
    return [(dx, dy, ws) for (dx, dy), ws in sorted(taps.items())]


def convolve(px: DataFrame, kernel: list[tuple[int, int, float]], width: int, height: int) -> DataFrame:
    """A weighted sum (dx, dy, weight) inside the margin that the kernel needs, clamped and truncated; the border stays."""
    if not kernel:
        raise InvalidKernel("empty")
    whole = all(float(w).is_integer() for _, _, w in kernel)
    scale = 1 if whole else 1 << 30
    fixed = {}
    for dx, dy, w in kernel:
        fixed[dx, dy] = {"w": fixed.get((dx, dy), {}).get("w", 0) + round(w * scale)}
    margin = max(max(abs(dx), abs(dy)) for dx, dy, _ in kernel)
    names = channels(px)
    got = _scatter(px, _with_centre(fixed), {f"s_{c}": (c, "w") for c in names})
    inner = interior(width, height, margin)
    return got.select("image_id", "x", "y", *[F.expr(f"CASE WHEN {inner} THEN CAST(least(255, greatest(0, s_{c} div {scale})) AS INT) ELSE own.{c} END").alias(c) for c in names])


def sharpen(px: DataFrame, width: int, height: int) -> DataFrame:
    return convolve(px, SHARPEN, width, height)


def sobel(px: DataFrame, width: int, height: int) -> DataFrame:
    """Gradient size of a grey relation; the border keeps its values."""
    taps: dict = {}
    for kernel, name in ((SOBEL_X, "gx"), (SOBEL_Y, "gy")):
        for dx, dy, w in kernel:
            taps.setdefault((dx, dy), {})[name] = w
    got = _scatter(px, _with_centre(taps), {"gx": ("v", "gx"), "gy": ("v", "gy")})
    return got.select("image_id", "x", "y", F.expr(f"CASE WHEN {interior(width, height)} THEN CAST(least(255.0D, sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS INT) ELSE own.v END").alias("v"))


def axis_weights(sigma: float, radius: int) -> list[int]:
    """Weights from -radius to radius along one axis, in fixed point, which sum to AXIS_ONE."""
    if sigma <= 0:
        raise InvalidKernel(f"sigma {sigma}")
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    fixed = [round(w / sum(raw) * AXIS_ONE) for w in raw]
    fixed[radius] += AXIS_ONE - sum(fixed)
    return fixed


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[tuple[int, int, int]]:
    """The two-dimensional weights, products of the axes', which sum to ONE."""
    radius = math.ceil(3 * sigma) if radius is None else radius
    axis = axis_weights(sigma, radius)
    return [(i - radius, j - radius, axis[i] * axis[j]) for j in range(2 * radius + 1) for i in range(2 * radius + 1)]


def _along(px: DataFrame, names: list[str], axis: str, other: str, weights: list[int], last: int | None = None) -> DataFrame:
    """Weighted sums along one axis. With `last`, places beyond 0 and last read the pixel at the edge."""
    r = len(weights) // 2
    line = Window.partitionBy("image_id", other)
    order = line.orderBy(axis)
    sums = {}
    for c in names:
        parts = [F.coalesce(F.sum(F.col(c).cast("long")).over(order.rangeBetween(k, k)), F.lit(0)) * F.lit(w) for k, w in zip(range(-r, r + 1), weights, strict=True)]
        if last is not None:
            before = F.array(*[F.lit(sum(weights[: r - at])).cast("long") for at in range(r + 1)])  # of what lies before 0, by place
            edge = lambda at: F.max(F.when(F.col(axis) == at, F.col(c).cast("long"))).over(line)  # noqa: B023, E731
            parts.append(edge(0) * F.get(before, F.least(F.col(axis), F.lit(r))))
            parts.append(edge(last) * F.get(before, F.least(F.lit(last) - F.col(axis), F.lit(r))))
        sums[c] = sum(parts[1:], parts[0])
    return px.withColumns({f"s_{c}": v for c, v in sums.items()})


def _blurred(px: DataFrame, weights: list[int], width: int, height: int, clamp: bool) -> DataFrame:
    """px with s_ columns: the sums by both axes, in ONE."""
    names = channels(px)
    px = _along(px, names, "x", "y", weights, width - 1 if clamp else None)
    px = px.select("image_id", "x", "y", *[F.col(c).alias(f"own_{c}") for c in names], *[F.col(f"s_{c}").alias(c) for c in names])
    return _along(px, names, "y", "x", weights, height - 1 if clamp else None)


def gaussian_blur(px: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """Interior only, the border of the kernel's radius stays."""
    margin = math.ceil(3 * sigma)
    got = _blurred(px, axis_weights(sigma, margin), width, height, False)
    return got.select("image_id", "x", "y", *[F.expr(f"CASE WHEN {interior(width, height, margin)} THEN CAST(s_{c} div {ONE} AS INT) ELSE own_{c} END").alias(c) for c in channels(px)])


def device_weights(radius: float) -> list[int]:
    """The Gaussian of the device blur: 2 * radius + 1 wide, sigma a half of the radius."""
    return axis_weights(max(radius / 2, 0.5), math.ceil(radius))


def device_kernel(radius: float) -> list[tuple[int, int, int]]:
    return gaussian_kernel(max(radius / 2, 0.5), math.ceil(radius))


def device_blur(px: DataFrame, radius: float, width: int, height: int) -> DataFrame:
    """Gaussian with places clamped to the edge: a border pixel gives all the weight that falls beyond it."""
    got = _blurred(px, device_weights(radius), width, height, True)
    return got.select("image_id", "x", "y", *[F.expr(f"CAST(s_{c} div {ONE} AS INT)").alias(c) for c in channels(px)])
