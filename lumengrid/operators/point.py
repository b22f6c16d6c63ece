"""Point and colour operators: projections over pixel relations, which Catalyst fuses into one stage.

Grey relations have (image_id, x, y, v); colour relations (image_id, x, y, r, g, b); light (image_id, x, y, c0, c1, c2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fm
from .stats import by_image
from ..functions.numeric import SPARK

RGB = ("r", "g", "b")


class InvalidContrastFactor(ValueError):
    pass


class InvalidGamma(ValueError):
    pass


class UnsupportedColorSpaceConversion(ValueError):
    pass


def _channels(px: DataFrame) -> tuple[str, ...]:
    return ("v",) if "v" in px.columns else RGB


def _each(px: DataFrame, formula) -> DataFrame:
    return px.withColumns({c: F.expr(formula(c)) for c in _channels(px)})


def _wide(px: DataFrame, expressions: list[str]) -> DataFrame:
    return px.withColumns({c: F.expr(e) for c, e in zip(RGB, expressions, strict=True)})


def adjust_brightness(px: DataFrame, amount: int) -> DataFrame:
    return _each(px, lambda c: fm.brightness(SPARK, c, amount))


def adjust_contrast(px: DataFrame, factor: float) -> DataFrame:
    if factor < 0:
        raise InvalidContrastFactor(factor)
    return _each(px, lambda c: fm.contrast(SPARK, c, factor))


def view_contrast(px: DataFrame, factor: float) -> DataFrame:
    return _each(px, lambda c: fm.view_contrast(SPARK, c, factor))


def white_balance(px: DataFrame, temperature: float, tint: float) -> DataFrame:
    return _wide(px, fm.white_balance(SPARK, temperature, tint))


def gamma_table(px: DataFrame, gamma: float) -> DataFrame:
    """The 256 rows of a gamma look-up table."""
    if gamma <= 0:
        raise InvalidGamma(gamma)
    return px.sparkSession.range(256).select(F.col("id").cast("int").alias("code"), F.expr(fm.gamma(SPARK, "CAST(id AS INT)", gamma)).alias("mapped"))


def gamma_correction(px: DataFrame, gamma: float) -> DataFrame:
    if gamma <= 0:
        raise InvalidGamma(gamma)
    return _each(px, lambda c: fm.gamma(SPARK, c, gamma))


def to_grey(px: DataFrame, weights: list[float] = fm.BT709) -> DataFrame:
    """BT.709 luma; a grey relation stays as it is."""
    if "v" in px.columns:
        return px
    return px.select("image_id", "x", "y", F.expr(fm.grey(SPARK, weights)).alias("v"))


def grey_to_rgb(px: DataFrame) -> DataFrame:
    return px.select("image_id", "x", "y", *[F.col("v").alias(c) for c in RGB])


def sepia(px: DataFrame) -> DataFrame:
    return _wide(px, fm.sepia(SPARK))


def blend(source: DataFrame, target: DataFrame, alpha: float) -> DataFrame:
    """source over target where both have a pixel."""
    s, t = source.alias("s"), target.alias("t")
    cols = [F.expr(fm.blend(SPARK, f"s.{c}", f"t.{c}", alpha)).alias(c) for c in _channels(source)]
    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in ("image_id", "x", "y")]
    return s.join(t, on).select("s.image_id", "s.x", "s.y", *cols)


def convert_colorspace(px: DataFrame, source: str, target: str) -> DataFrame:
    """rgb to and from hsv, yuv and grayscale; anything else is refused before a job runs."""
    if source == target:
        return px
    known = {("rgb", "hsv"): lambda p: _wide(p, fm.rgb_to_hsv(SPARK)), ("hsv", "rgb"): lambda p: _wide(p, fm.hsv_to_rgb(SPARK)), ("rgb", "yuv"): lambda p: _wide(p, fm.rgb_to_yuv(SPARK)), ("yuv", "rgb"): yuv_to_rgb, ("rgb", "grayscale"): lambda p: to_grey(p, fm.BT601), ("grayscale", "rgb"): grey_to_rgb}
    if (source, target) not in known:
        raise UnsupportedColorSpaceConversion(f"{source} to {target}")
    return known[source, target](px)


def yuv_to_rgb(px: DataFrame, variant: str = "plain") -> DataFrame:
    return _wide(px, fm.yuv_to_rgb(SPARK, variant))


# --- device-independent colour ---------------------------------------------------------------------------------------
def _stage(px: DataFrame, names: tuple[str, ...], expressions: list[str]) -> DataFrame:
    return px.withColumns({n: F.expr(e) for n, e in zip(names, expressions, strict=True)})


def rgb_to_xyz(px: DataFrame, space: str = "srgb") -> DataFrame:
    """Adds cx, cy, cz on the scale of 100 from samples of 8 bits."""
    profile = fm.WORKING_SPACES[space]
    unit = [SPARK.clamp(SPARK.div(SPARK.f(c), SPARK.f(255)), 0, 1) for c in RGB]
    px = _stage(px, ("l0", "l1", "l2"), [fm.to_linear(SPARK, u, profile) for u in unit])
    px = _stage(px, ("cx", "cy", "cz"), [f"{m} * {SPARK.f(100)}" for m in fm.matrix(SPARK, fm.PROFILES[profile][3], ["l0", "l1", "l2"])])
    return px.drop("l0", "l1", "l2")


def xyz_to_rgb(px: DataFrame, space: str = "srgb") -> DataFrame:
    """r, g, b samples of cx, cy, cz."""
    profile = fm.WORKING_SPACES[space]
    unit = [SPARK.div(c, SPARK.f(100)) for c in ("cx", "cy", "cz")]
    px = _stage(px, ("l0", "l1", "l2"), fm.matrix(SPARK, fm.PROFILES[profile][4], unit))
    compressed = [SPARK.clamp(fm.from_linear(SPARK, SPARK.clamp(c, 0, 1), profile), 0, 1) for c in ("l0", "l1", "l2")]
    return _wide(px, [SPARK.byte(f"({c}) * {SPARK.f(255)}") for c in compressed]).drop("l0", "l1", "l2")


def xyz_to_lab(px: DataFrame, illuminant: str = "d65") -> DataFrame:
    w = fm.WHITE_POINTS[illuminant]
    px = _stage(px, ("f0", "f1", "f2"), [fm.lab_f(SPARK, SPARK.div(c, SPARK.f(v))) for c, v in zip(("cx", "cy", "cz"), w, strict=True)])
    f = SPARK.f
    return _stage(px, ("lab_l", "lab_a", "lab_b"), [f"{f(116)} * f1 - {f(16)}", f"{f(500)} * (f0 - f1)", f"{f(200)} * (f1 - f2)"]).drop("f0", "f1", "f2")


def lab_to_xyz(px: DataFrame, illuminant: str = "d65") -> DataFrame:
    w, f = fm.WHITE_POINTS[illuminant], SPARK.f
    px = _stage(px, ("f1",), [SPARK.div(f"lab_l + {f(16)}", f(116))])
    px = _stage(px, ("f0", "f2"), [f"{SPARK.div('lab_a', f(500))} + f1", f"f1 - {SPARK.div('lab_b', f(200))}"])
    return _stage(px, ("cx", "cy", "cz"), [f"({fm.lab_f_inverse(SPARK, c)}) * {f(v)}" for c, v in zip(("f0", "f1", "f2"), w, strict=True)]).drop("f0", "f1", "f2")


def rgb_to_lab(px: DataFrame, space: str = "srgb", illuminant: str = "d65") -> DataFrame:
    return xyz_to_lab(rgb_to_xyz(px, space), illuminant).drop("cx", "cy", "cz")


def lab_to_rgb(px: DataFrame, space: str = "srgb", illuminant: str = "d65") -> DataFrame:
    return xyz_to_rgb(lab_to_xyz(px, illuminant), space).drop("cx", "cy", "cz")


def adjust_saturation(px: DataFrame, factor: float) -> DataFrame:
    return _stage(px, ("lab_a", "lab_b"), [f"{c} * {SPARK.f(factor)}" for c in ("lab_a", "lab_b")])


def adjust_lightness(px: DataFrame, amount: float) -> DataFrame:
    return _stage(px, ("lab_l",), [SPARK.clamp(f"lab_l + {SPARK.f(amount)}", 0, 100)])


def delta_e(left: DataFrame, right: DataFrame, formula: str = "76") -> DataFrame:
    """Colour difference of equal places of two LAB relations."""
    s = left.alias("s").join(right.alias("t"), [F.col(f"s.{k}") == F.col(f"t.{k}") for k in ("image_id", "x", "y")])
    s = s.select("s.image_id", "s.x", "s.y", *[F.expr(f"s.lab_{c} - t.lab_{c}").alias(f"d{c}") for c in "lab"], F.expr(SPARK.sqrt("s.lab_a * s.lab_a + s.lab_b * s.lab_b")).alias("c1"), F.expr(SPARK.sqrt("t.lab_a * t.lab_a + t.lab_b * t.lab_b")).alias("c2"))
    return s.select("image_id", "x", "y", F.expr(delta_formula(SPARK, formula)).alias("delta"))


def delta_formula(d, formula: str) -> str:
    """Over dl, da, db, c1, c2."""
    if formula == "76":
        return d.sqrt("dl * dl + da * da + db * db")
    hue = f"greatest({d.f(0)}, da * da + db * db - (c1 - c2) * (c1 - c2))"
    c = d.div("c1 - c2", f"{d.f(1)} + {d.f(0.045)} * c1")
    h = d.div(d.sqrt(hue), f"{d.f(1)} + {d.f(0.015)} * c1")
    return d.sqrt(f"dl * dl + {c} * {c} + {h} * {h}")


def convert_profile(px: DataFrame, source: str, target: str) -> DataFrame:
    """Samples of one colour profile as samples of another."""
    if source == target:
        return px
    unit = [SPARK.div(SPARK.f(c), SPARK.f(255)) for c in RGB]
    px = _stage(px, ("l0", "l1", "l2"), [fm.to_linear(SPARK, u, source) for u in unit])
    px = _stage(px, ("cx", "cy", "cz"), fm.matrix(SPARK, fm.PROFILES[source][3], ["l0", "l1", "l2"]))
    px = _stage(px, ("l0", "l1", "l2"), [SPARK.clamp(m, 0, 1) for m in fm.matrix(SPARK, fm.PROFILES[target][4], ["cx", "cy", "cz"])])
    return _wide(px, [SPARK.byte(f"({fm.from_linear(SPARK, c, target)}) * {SPARK.f(255)}") for c in ("l0", "l1", "l2")]).drop("l0", "l1", "l2", "cx", "cy", "cz")


# --- light -----------------------------------------------------------------------------------------------------------
def u16_to_light(px: DataFrame, most: int = 65535) -> DataFrame:
    return px.withColumn("light", F.expr(f"{SPARK.f('v')} * {SPARK.div(SPARK.f(1), SPARK.f(most))}"))


def rgb_to_light(px: DataFrame) -> DataFrame:
    return px.select("image_id", "x", "y", *[F.expr(SPARK.pow(SPARK.div(SPARK.f(c), SPARK.f(255)), 2.2)).alias(f"c{k}") for k, c in enumerate(RGB)])


def light_statistics(px: DataFrame) -> DataFrame:
    """(image_id, avg_lum, max_lum, exposure): over pixels with light; the average is rounded so that it does not depend on the order of the sum."""
    lum = px.select("image_id", F.expr(fm.luminance(SPARK)).alias("lum"))
    stats = lum.groupBy("image_id").agg(F.expr("round(avg(CASE WHEN lum > 0 THEN ln(CAST(lum AS DOUBLE) + 0.001D) END), 9)").alias("mean_log"), F.expr("max(CASE WHEN lum > 0 THEN lum END)").alias("max_lum"))
    average = "CAST(coalesce(exp(mean_log), 0.0D) AS FLOAT)"
    return stats.select("image_id", F.expr(average).alias("avg_lum"), F.expr("coalesce(max_lum, CAST(0 AS FLOAT))").alias("max_lum"), F.expr(f"CASE WHEN mean_log IS NULL THEN {SPARK.f(1)} ELSE {SPARK.div(SPARK.f(0.18), f'{average} + {SPARK.f(0.001)}')} END").alias("exposure"))


def tone_map(px: DataFrame, operator: str = "reinhard", exposure: float = 1.0, gamma: float = 2.2, key: float = 0.18, white: float = 1.0) -> DataFrame:
    """Light to samples. Only the Reinhard operators need the image's average: one aggregate, joined back by image and line."""
    if operator.startswith("reinhard"):
        px = by_image(px, light_statistics(px).select("image_id", "avg_lum"))
    px = px.withColumn("lum", F.expr(fm.luminance(SPARK, exposure)))
    exposed = [f"(c{k} * {SPARK.f(exposure)})" for k in range(3)]
    px = _stage(px, ("t0", "t1", "t2"), [fm.tone(SPARK, c, operator, key=key, white=white) for c in exposed])
    return px.select("image_id", "x", "y", *[F.expr(fm.display(SPARK, f"t{k}", gamma)).alias(c) for k, c in enumerate(RGB)])
