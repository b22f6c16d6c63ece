"""The registered queries of the image operators, each beside the SQL that DuckDB runs for it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions.numeric import DUCK as D
from ..operators import filters, geometry, point, raw, stats
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
S = fx.SIDE
RGB = ["r", "g", "b"]


def query(name: str, build: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLES[name] = oracle


def grey_query(name: str, operator: Callable[[DataFrame], DataFrame], value: str) -> None:
    """A grey point operator; value is its SQL over v."""
    query(name, lambda s, d: operator(fx.grey(s, d)), f"WITH {fx.GREY_SQL} SELECT image_id, x, y, {value} AS v FROM grey")


def rgb_query(name: str, operator: Callable[[DataFrame], DataFrame], values: list[str]) -> None:
    cols = ", ".join(f"{e} AS {c}" for e, c in zip(values, RGB, strict=True))
    query(name, lambda s, d: operator(fx.rgb(s, d)), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, {cols} FROM rgb")


# --- point operators -------------------------------------------------------------------------------------------------
grey_query("p01_brightness", lambda p: point.adjust_brightness(p, 30), "least(255, greatest(0, v + 30))")
rgb_query("p01_brightness_rgb", lambda p: point.adjust_brightness(p, -40), [f"least(255, greatest(0, {c} - 40))" for c in RGB])
grey_query("p02_contrast", lambda p: point.adjust_contrast(p, 1.5), fm.contrast(D, "v", 1.5))
rgb_query("p03_white_balance", lambda p: point.white_balance(p, 25.0, -15.0), fm.white_balance(D, 25.0, -15.0))
grey_query("p04_gamma", lambda p: point.gamma_correction(p, 2.2), fm.gamma(D, "v", 2.2))
query("p04_gamma_table", lambda s, d: point.gamma_table(s.range(1), 1.8), f"SELECT i::INT AS code, {fm.gamma(D, 'i', 1.8)} AS mapped FROM range(256) t(i)")
query("p05_grey_bt709", lambda s, d: point.to_grey(fx.rgb(s, d)), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, {fm.grey(D, fm.BT709)} AS v FROM rgb")
grey_query("p06_view_brightness", lambda p: point.adjust_brightness(p, -300), "least(255, greatest(0, v - 300))")
grey_query("p06_view_contrast", lambda p: point.view_contrast(p, 1.3), fm.view_contrast(D, "v", 1.3))
query("p06_view_grey", lambda s, d: fx.rgb(s, d).withColumn("r", F.expr(fm.grey(point.SPARK, fm.BT601))), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, {fm.grey(D, fm.BT601)} AS r, g, b FROM rgb")


def shifted(px: DataFrame, by: int = 1) -> DataFrame:
    """The next image's pixels under this one's id."""
    return px.withColumn("image_id", F.col("image_id") - by)


query("p07_blend", lambda s, d: point.blend(shifted(fx.grey(s, d)), fx.grey(s, d), 0.3), f"WITH {fx.GREY_SQL} SELECT t.image_id, t.x, t.y, {fm.blend(D, 's.v', 't.v', 0.3)} AS v FROM grey s JOIN grey t ON s.image_id = t.image_id + 1 AND s.x = t.x AND s.y = t.y")
rgb_query("p08_sepia", point.sepia, fm.sepia(D))

# --- colour spaces ---------------------------------------------------------------------------------------------------
rgb_query("c02_rgb_to_hsv", lambda p: point.convert_colorspace(p, "rgb", "hsv"), fm.rgb_to_hsv(D))
rgb_query("c03_hsv_to_rgb", lambda p: point.convert_colorspace(p, "hsv", "rgb"), fm.hsv_to_rgb(D))
rgb_query("c04_rgb_to_yuv", lambda p: point.convert_colorspace(p, "rgb", "yuv"), fm.rgb_to_yuv(D))
rgb_query("c05_yuv_to_rgb", lambda p: point.convert_colorspace(p, "yuv", "rgb"), fm.yuv_to_rgb(D))
rgb_query("c06_yuv_to_rgb_shader", lambda p: point.yuv_to_rgb(p, "shader"), fm.yuv_to_rgb(D, "shader"))
rgb_query("c09_device_yuv", lambda p: point.yuv_to_rgb(p, "shader"), fm.yuv_to_rgb(D, "shader"))
rgb_query("c10_device_rgb_to_yuv", lambda p: point.convert_colorspace(p, "rgb", "yuv"), fm.rgb_to_yuv(D))
rgb_query("s04e_jfif_colour", lambda p: point.yuv_to_rgb(p, "jfif"), fm.yuv_to_rgb(D, "jfif"))
query("c07_grey_bt601", lambda s, d: point.convert_colorspace(fx.rgb(s, d), "rgb", "grayscale"), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, {fm.grey(D, fm.BT601)} AS v FROM rgb")
query("c08_grey_to_rgb", lambda s, d: point.convert_colorspace(fx.grey(s, d), "grayscale", "rgb"), f"WITH {fx.GREY_SQL} SELECT image_id, x, y, v AS r, v AS g, v AS b FROM grey")
_yuv, _back = fm.rgb_to_yuv(D), fm.yuv_to_rgb(D)
query("c01_yuv_round_trip", lambda s, d: point.convert_colorspace(point.convert_colorspace(fx.rgb(s, d), "rgb", "yuv"), "yuv", "rgb"), f"WITH {fx.RGB_SQL}, yuv AS (SELECT image_id, x, y, {_yuv[0]} AS r, {_yuv[1]} AS g, {_yuv[2]} AS b FROM rgb) SELECT image_id, x, y, {_back[0]} AS r, {_back[1]} AS g, {_back[2]} AS b FROM yuv")


def rounded(px: DataFrame, names: list[str], digits: int = 3) -> DataFrame:
    return px.select("image_id", "x", "y", *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in names])


def stages(start: str, *steps: list[tuple[str, str]]) -> str:
    """Nested selects that add columns step by step."""
    sql = start
    for k, step in enumerate(steps):
        sql = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step)} FROM ({sql}) q{k}"
    return sql


def xyz_steps(space: str, source: list[str] = RGB) -> list[list[tuple[str, str]]]:
    profile = fm.WORKING_SPACES[space]
    lin = [(f"l{k}", fm.to_linear(D, D.clamp(D.div(D.f(c), D.f(255)), 0, 1), profile)) for k, c in enumerate(source)]
    xyz = [(n, f"{m} * {D.f(100)}") for n, m in zip(("cx", "cy", "cz"), fm.matrix(D, fm.PROFILES[profile][3], ["l0", "l1", "l2"]), strict=True)]
    return [lin, xyz]


def lab_steps(illuminant: str = "d65") -> list[list[tuple[str, str]]]:
    w = fm.WHITE_POINTS[illuminant]
    fs = [(f"f{k}", fm.lab_f(D, D.div(c, D.f(v)))) for k, (c, v) in enumerate(zip(("cx", "cy", "cz"), w, strict=True))]
    return [fs, [("lab_l", f"{D.f(116)} * f1 - {D.f(16)}"), ("lab_a", f"{D.f(500)} * (f0 - f1)"), ("lab_b", f"{D.f(200)} * (f1 - f2)")]]


def rounding(names: list[str], digits: int = 3) -> str:
    return ", ".join(f"round({n}::DOUBLE, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


XYZ, LAB = ["cx", "cy", "cz"], ["lab_l", "lab_a", "lab_b"]
for _space in fm.WORKING_SPACES:
    query(f"c11_rgb_to_xyz_{_space}", lambda s, d, sp=_space: rounded(point.rgb_to_xyz(fx.rgb(s, d), sp), XYZ), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, {rounding(XYZ)} FROM ({stages('SELECT * FROM rgb', *xyz_steps(_space))})")
for _light in fm.WHITE_POINTS:
    query(f"c12_rgb_to_lab_{_light}", lambda s, d, li=_light: rounded(point.rgb_to_lab(fx.rgb(s, d), "srgb", li), LAB), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, {rounding(LAB)} FROM ({stages('SELECT * FROM rgb', *xyz_steps('srgb'), *lab_steps(_light))})")


def from_lab(space: str = "srgb", illuminant: str = "d65") -> list[list[tuple[str, str]]]:
    w, f, profile = fm.WHITE_POINTS[illuminant], D.f, fm.WORKING_SPACES[space]
    back = [[("i1", D.div(f"lab_l + {f(16)}", f(116)))], [("i0", f"{D.div('lab_a', f(500))} + i1"), ("i2", f"i1 - {D.div('lab_b', f(200))}")], [(f"z{k}", f"({fm.lab_f_inverse(D, f'i{k}')}) * {f(v)}") for k, v in enumerate(w)]]
    lin = [(f"m{k}", e) for k, e in enumerate(fm.matrix(D, fm.PROFILES[profile][4], [D.div(f"z{k}", f(100)) for k in range(3)]))]
    out = [(f"o{k}", D.byte(f"({D.clamp(fm.from_linear(D, D.clamp(f'm{k}', 0, 1), profile), 0, 1)}) * {f(255)}")) for k in range(3)]
    return [*back, lin, out]


query("c14_lab_round_trip", lambda s, d: point.lab_to_rgb(point.rgb_to_lab(fx.rgb(s, d))).select("image_id", "x", "y", *RGB), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, o0 AS r, o1 AS g, o2 AS b FROM ({stages('SELECT * FROM rgb', *xyz_steps('srgb'), *lab_steps(), *from_lab())})")
_adjusted = [[("lab_a2", f"lab_a * {D.f(1.4)}"), ("lab_b2", f"lab_b * {D.f(1.4)}"), ("lab_l2", D.clamp(f"lab_l + {D.f(12)}", 0, 100))]]
query("c16_adjust_lab", lambda s, d: rounded(point.adjust_lightness(point.adjust_saturation(point.rgb_to_lab(fx.rgb(s, d)), 1.4), 12.0), LAB), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, round(lab_l2::DOUBLE, 3) + 0.0::DOUBLE AS lab_l, round(lab_a2::DOUBLE, 3) + 0.0::DOUBLE AS lab_a, round(lab_b2::DOUBLE, 3) + 0.0::DOUBLE AS lab_b FROM ({stages('SELECT * FROM rgb', *xyz_steps('srgb'), *lab_steps(), *_adjusted)})")


def _delta(s: SparkSession, d: str, formula: str) -> DataFrame:
    lab = point.rgb_to_lab(fx.rgb(s, d))
    return point.delta_e(lab, shifted(lab), formula).select("image_id", "x", "y", F.round(F.col("delta").cast("double"), 3).alias("delta"))


for _formula in ("76", "94"):
    query(
        f"c15_delta_e{_formula}",
        lambda s, d, fo=_formula: _delta(s, d, fo),
        f"WITH {fx.RGB_SQL}, lab AS ({stages('SELECT * FROM rgb', *xyz_steps('srgb'), *lab_steps())}), pair AS (SELECT s.image_id, s.x, s.y, s.lab_l - t.lab_l AS dl, s.lab_a - t.lab_a AS da, s.lab_b - t.lab_b AS db, "
        f"{D.sqrt('s.lab_a * s.lab_a + s.lab_b * s.lab_b')} AS c1, {D.sqrt('t.lab_a * t.lab_a + t.lab_b * t.lab_b')} AS c2 FROM lab s JOIN lab t ON t.image_id = s.image_id + 1 AND s.x = t.x AND s.y = t.y) "
        f"SELECT image_id, x, y, round(({point.delta_formula(D, _formula)})::DOUBLE, 3) AS delta FROM pair",
    )


def profile_steps(source: str, target: str) -> list[list[tuple[str, str]]]:
    lin = [(f"l{k}", fm.to_linear(D, D.div(D.f(c), D.f(255)), source)) for k, c in enumerate(RGB)]
    xyz = list(zip(XYZ, fm.matrix(D, fm.PROFILES[source][3], ["l0", "l1", "l2"]), strict=True))
    back = [(f"m{k}", D.clamp(e, 0, 1)) for k, e in enumerate(fm.matrix(D, fm.PROFILES[target][4], XYZ))]
    return [lin, xyz, back, [(f"o{k}", D.byte(f"({fm.from_linear(D, f'm{k}', target)}) * {D.f(255)}")) for k in range(3)]]


for _from, _to in (("srgb", "adobe_rgb_1998"), ("srgb", "display_p3"), ("adobe_rgb_1998", "srgb"), ("srgb", "linear_rgb"), ("pro_photo_rgb", "rec2020"), ("rec709", "srgb")):
    query(f"c17_profile_{_from}_to_{_to}", lambda s, d, a=_from, b=_to: point.convert_profile(fx.rgb(s, d), a, b).select("image_id", "x", "y", *RGB), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, o0 AS r, o1 AS g, o2 AS b FROM ({stages('SELECT * FROM rgb', *profile_steps(_from, _to))})")


def _curves(s: SparkSession, formula: Callable) -> DataFrame:
    codes = s.range(256).select(F.col("id").cast("int").alias("code"), F.expr(point.SPARK.div(point.SPARK.f("id"), point.SPARK.f(255))).alias("u"))
    return codes.select("code", *[F.expr(f"round(CAST({formula(point.SPARK, 'u', p)} AS DOUBLE), 5)").alias(p) for p in fm.PROFILES])


for _name, _curve in (("linear", fm.to_linear), ("companded", fm.from_linear)):
    query(f"c18_curves_{_name}", lambda s, d, cu=_curve: _curves(s, cu), "SELECT code::INT AS code, " + ", ".join(f"round(({_curve(D, 'u', p)})::DOUBLE, 5) AS {p}" for p in fm.PROFILES) + f" FROM (SELECT i AS code, {D.div(D.f('i'), D.f(255))} AS u FROM range(256) t(i))")
_profile_rows = ", ".join(f"('{k}', '{v[0]}', {', '.join(f'{float(x)}::DOUBLE' for x in (v[1], *fm.PROFILE_WHITE, *v[2]))})" for k, v in fm.PROFILES.items())
_profile_names = "profile, name, gamma, white_x, white_y, red_x, red_y, green_x, green_y, blue_x, blue_y"
query("c19_profiles", lambda s, d: stats.profiles(s).selectExpr("profile", "name", *[f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in _profile_names.split(", ")[2:]]), f"SELECT * FROM (VALUES {_profile_rows}) t({_profile_names})")
_area = D.div("red_x * (green_y - blue_y) + green_x * (blue_y - red_y) + blue_x * (red_y - green_y)", D.f(2))
query(
    "h06_gamut_coverage",
    lambda s, d: stats.gamut_coverage(s).select("source", "target", F.round(F.col("coverage").cast("double"), 5).alias("coverage")),
    f"WITH p AS (SELECT profile, abs({_area}) AS area FROM (SELECT profile, {', '.join(f'{c}::FLOAT AS {c}' for c in _profile_names.split(', ')[5:])} FROM (VALUES {_profile_rows}) t({_profile_names}))) "
    f"SELECT s.profile AS source, t.profile AS target, round(least({D.f(1)}, {D.div('t.area', 's.area')})::DOUBLE, 5) AS coverage FROM p s, p t",
)

# --- light -----------------------------------------------------------------------------------------------------------
_lum = fm.luminance(D)
STATS_SQL = (
    f"lum AS (SELECT image_id, {_lum} AS lum FROM hdr), logs AS (SELECT image_id, round(avg(ln(lum::DOUBLE + 0.001)) FILTER (WHERE lum > 0), 9) AS mean_log, max(lum) FILTER (WHERE lum > 0) AS top FROM lum GROUP BY image_id), "
    f"stat AS (SELECT image_id, CAST(coalesce(exp(mean_log), 0.0) AS FLOAT) AS avg_lum, coalesce(top, 0::FLOAT) AS max_lum, mean_log FROM logs)"
)
query("h05_light_statistics", lambda s, d: point.light_statistics(fx.hdr(s, d)).selectExpr("image_id", "round(CAST(avg_lum AS DOUBLE), 5) AS avg_lum", "round(CAST(max_lum AS DOUBLE), 5) AS max_lum"), f"WITH {fx.HDR_SQL}, {STATS_SQL} SELECT image_id, round(avg_lum::DOUBLE, 5) AS avg_lum, round(max_lum::DOUBLE, 5) AS max_lum FROM stat")
query("h04_auto_exposure", lambda s, d: point.light_statistics(fx.hdr(s, d)).selectExpr("image_id", "round(CAST(exposure AS DOUBLE), 4) AS exposure"), f"WITH {fx.HDR_SQL}, {STATS_SQL} SELECT image_id, round((CASE WHEN mean_log IS NULL THEN 1::FLOAT ELSE {D.div(D.f(0.18), f'avg_lum + {D.f(0.001)}')} END)::DOUBLE, 4) AS exposure FROM stat")
for _op in fm.TONE_OPERATORS:
    _exposed = [f"(c{k} * {D.f(1.5)})" for k in range(3)]
    query(
        f"t01_tone_{_op}",
        lambda s, d, op=_op: point.tone_map(fx.hdr(s, d), op, exposure=1.5),
        f"WITH {fx.HDR_SQL}, {STATS_SQL}, px AS (SELECT hdr.*, avg_lum, {fm.luminance(D, 1.5)} AS lum FROM hdr JOIN stat USING (image_id)), tone AS (SELECT image_id, x, y, {', '.join(f'{fm.tone(D, c, _op)} AS t{k}' for k, c in enumerate(_exposed))} FROM px) "
        f"SELECT image_id, x, y, {', '.join(f'{fm.display(D, f"t{k}")} AS {c}' for k, c in enumerate(RGB))} FROM tone",
    )
query("t08_luminance", lambda s, d: fx.hdr(s, d).selectExpr("image_id", "x", "y", f"round(CAST({fm.luminance(point.SPARK)} AS DOUBLE), 5) AS lum"), f"WITH {fx.HDR_SQL} SELECT image_id, x, y, round(({_lum})::DOUBLE, 5) AS lum FROM hdr")
query("t09_u16_to_light", lambda s, d: point.u16_to_light(fx.bayer(s, d)).selectExpr("image_id", "x", "y", "round(CAST(light AS DOUBLE), 6) AS light"), f"WITH {fx.BAYER_SQL} SELECT image_id, x, y, round(({D.f('v')} * {D.div(D.f(1), D.f(65535))})::DOUBLE, 6) AS light FROM bayer")
query("t09_rgb_to_light", lambda s, d: point.rgb_to_light(fx.rgb(s, d)).selectExpr("image_id", "x", "y", *[f"round(CAST(c{k} AS DOUBLE), 5) AS c{k}" for k in range(3)]), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, {', '.join(f'round(({D.pow(D.div(D.f(c), D.f(255)), 2.2)})::DOUBLE, 5) AS c{k}' for k, c in enumerate(RGB))} FROM rgb")


# --- geometry --------------------------------------------------------------------------------------------------------
def moved_query(name: str, operator: Callable[[DataFrame], DataFrame], x: str, y: str, where: str = "true") -> None:
    query(name, lambda s, d: operator(fx.grey(s, d)), f"WITH {fx.GREY_SQL} SELECT image_id, ({x})::INT AS x, ({y})::INT AS y, v FROM grey WHERE {where}")


moved_query("g04_crop", lambda p: geometry.crop(p, 2, 1, 5, 4, S, S), "x - 2", "y - 1", "x >= 2 AND x < 7 AND y >= 1 AND y < 5")
moved_query("g05_rotate90", lambda p: geometry.rotate90(p, S), "7 - y", "x")
moved_query("g06_flip_horizontal", lambda p: geometry.flip_horizontal(p, S), "7 - x", "y")
moved_query("g06_flip_vertical", lambda p: geometry.flip_vertical(p, S), "x", "7 - y")
moved_query("g11_rotate180", lambda p: geometry.rotate180(p, S, S), "7 - x", "7 - y")
moved_query("g12_view_flip", lambda p: geometry.flip_horizontal(geometry.sub_view(p, 0, 0, 4, 8, S, S), 4), "3 - x", "y", "x < 4")
moved_query("g13_sub_view", lambda p: geometry.sub_view(p, 3, 3, 4, 4, S, S), "x - 3", "y - 3", "x BETWEEN 3 AND 6 AND y BETWEEN 3 AND 6")
moved_query("g15_get_row", lambda p: geometry.get_row(p, 3), "x", "y", "y = 3")
grey_query("g15_set_pixel", lambda p: geometry.set_pixel(p, 2, 5, {"v": 99}), "CASE WHEN x = 2 AND y = 5 THEN 99 ELSE v END")
query("g14_copy_rect", lambda s, d: geometry.copy_rect(fx.grey(s, d), shifted(fx.grey(s, d)), 1, 1, 3, 4, 4, 2), f"WITH {fx.GREY_SQL} SELECT t.image_id, t.x, t.y, coalesce(s.v, t.v) AS v FROM grey t LEFT JOIN grey s ON s.image_id = t.image_id + 1 AND s.x = t.x - 3 AND s.y = t.y - 1 AND s.x BETWEEN 1 AND 3 AND s.y BETWEEN 1 AND 4")
query("s17_filled", lambda s, d: geometry.filled(s, 7, 20, 10, 5), "SELECT 7::BIGINT AS image_id, (i % 20)::INT AS x, (i // 20)::INT AS y, 5 AS v FROM range(200) t(i)")


def warp_sql(sx: str, sy: str, to_width: int, to_height: int, clamp: bool = False, relation: str = "grey", names: tuple[str, ...] = ("v",)) -> str:
    inside = "true" if clamp else f"sx >= 0 AND sx < {D.f(S - 1)} AND sy >= 0 AND sy < {D.f(S - 1)}"
    joins = " ".join(f"LEFT JOIN {relation} {a} ON {a}.image_id = i.image_id AND {a}.x = c.{x} AND {a}.y = c.{y}" for a, x, y in (("p", "x1", "y1"), ("q", "x2", "y1"), ("r", "x1", "y2"), ("s", "x2", "y2")))
    cols = ", ".join(f"CASE WHEN inside THEN {D.byte(geometry.mix4(D, f'p.{n}', f'q.{n}', f'r.{n}', f's.{n}', 'dx', 'dy'))} ELSE 0 END AS {n}" for n in names)
    base = fx.GREY_SQL if relation == "grey" else fx.RGB_SQL
    return (
        f"WITH {base}, grid AS (SELECT (k % {to_width})::INT AS x, (k // {to_width})::INT AS y FROM range({to_width * to_height}) t(k)), src AS (SELECT x, y, {sx} AS sx, {sy} AS sy FROM grid), "
        f"c AS (SELECT x, y, {inside} AS inside, CAST(floor(sx) AS INT) AS x1, CAST(floor(sy) AS INT) AS y1, least(CAST(floor(sx) AS INT) + 1, {S - 1}) AS x2, least(CAST(floor(sy) AS INT) + 1, {S - 1}) AS y2, sx - CAST(floor(sx) AS FLOAT) AS dx, sy - CAST(floor(sy) AS FLOAT) AS dy FROM src), "
        f"i AS (SELECT DISTINCT image_id FROM {relation}) SELECT i.image_id, c.x, c.y, {cols} FROM i CROSS JOIN c {joins}"
    )


query("g01_resize_down", lambda s, d: geometry.resize(fx.grey(s, d), S, S, 5, 5), warp_sql(*geometry.resize_source(D, S, S, 5, 5), 5, 5, True))
query("g01_resize_up_rgb", lambda s, d: geometry.resize(fx.rgb(s, d), S, S, 12, 10), warp_sql(*geometry.resize_source(D, S, S, 12, 10), 12, 10, True, "rgb", ("r", "g", "b")))
query("d01_device_resize", lambda s, d: geometry.resize(fx.grey(s, d), S, S, 16, 4), warp_sql(*geometry.resize_source(D, S, S, 16, 4), 16, 4, True))
query("g02_resize_nearest", lambda s, d: geometry.resize_nearest(fx.grey(s, d), S, S, 6, 5), f"WITH {fx.GREY_SQL}, grid AS (SELECT (k % 6)::INT AS tx, (k // 6)::INT AS ty FROM range(30) t(k)) SELECT image_id, tx AS x, ty AS y, v FROM grid JOIN grey ON x = tx * 8 // 6 AND y = ty * 8 // 5")
for _angle in (30.0, 90.0, 200.0):
    _sx, _sy, _w, _h = geometry.rotation_source(D, S, S, _angle)
    query(f"g07_rotate_{_angle:.0f}", lambda s, d, a=_angle: geometry.rotate(fx.grey(s, d), S, S, a), warp_sql(_sx, _sy, _w, _h))
_corners = [(1.0, 0.5), (9.0, 1.0), (8.0, 8.0), (0.5, 7.5)]
_sx, _sy, _w, _h = geometry.perspective_source(D, S, S, _corners)
query("g08_perspective", lambda s, d: geometry.perspective(fx.grey(s, d), S, S, _corners), warp_sql(_sx, _sy, _w, _h))
query("g09_barrel", lambda s, d: geometry.correct_barrel(fx.grey(s, d), S, S, 0.3), warp_sql(*geometry.barrel_source(D, S, S, 0.3), S, S))
query("g10_pincushion", lambda s, d: geometry.correct_pincushion(fx.rgb(s, d), S, S, 0.2), warp_sql(*geometry.barrel_source(D, S, S, -0.2), S, S, False, "rgb", ("r", "g", "b")))


# --- filters ---------------------------------------------------------------------------------------------------------
def blur_sql(radius: int) -> str:
    w = f"RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"{fx.GREY_SQL}, across AS (SELECT image_id, x, y, (sum(v) OVER h // count(*) OVER h)::INT AS v FROM grey WINDOW h AS (PARTITION BY image_id, y ORDER BY x {w})), blurred AS (SELECT image_id, x, y, (sum(v) OVER w // count(*) OVER w)::INT AS v FROM across WINDOW w AS (PARTITION BY image_id, x ORDER BY y {w}))"


query("f01_box_blur", lambda s, d: filters.box_blur(fx.grey(s, d), 2), f"WITH {blur_sql(2)} SELECT image_id, x, y, v FROM blurred")
query("f06_device_box_blur", lambda s, d: filters.box_blur(fx.grey(s, d), 3), f"WITH {blur_sql(3)} SELECT image_id, x, y, v FROM blurred")
query("f01_blur_histogram", lambda s, d: stats.histogram(filters.box_blur(fx.grey(s, d), 2)).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_levels"), F.max("n").alias("largest_bin"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("mean")), f"WITH {blur_sql(2)}, h AS (SELECT image_id, v, count(*) AS n FROM blurred GROUP BY image_id, v) SELECT image_id, count(*) AS n_levels, max(n) AS largest_bin, round(sum(v * n)::DOUBLE / sum(n)::DOUBLE, 6) AS mean FROM h GROUP BY image_id")


def inner_sql(margin: int) -> str:
    return f"x BETWEEN {margin} AND {S - 1 - margin} AND y BETWEEN {margin} AND {S - 1 - margin}"


def kernel_sql(kernel: list, value: str, margin: int, more: str = "") -> str:
    rows = ", ".join(f"({dx}, {dy}, {w}::BIGINT)" for dx, dy, w in kernel)
    return (
        f"WITH {fx.GREY_SQL}, k(dx, dy, w) AS (VALUES {rows}), total AS (SELECT t.image_id, t.x, t.y, any_value(t.v) AS own, sum(s.v * k.w)::BIGINT AS s FROM grey t CROSS JOIN k JOIN grey s ON s.image_id = t.image_id AND s.x = t.x + k.dx AND s.y = t.y + k.dy GROUP BY t.image_id, t.x, t.y) "
        f"SELECT image_id, x, y, CASE WHEN {inner_sql(margin)} THEN ({value})::INT ELSE own END AS v FROM total"
    )


query("f02_sharpen", lambda s, d: filters.sharpen(fx.grey(s, d), S, S), kernel_sql(filters.SHARPEN, "least(255, greatest(0, s))", 1))
_five = [(dx, dy, 1) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) != (0, 0)] + [(0, 0, -23)]
query("f07_convolve5", lambda s, d: filters.convolve(fx.grey(s, d), _five, S, S), kernel_sql(_five, "least(255, greatest(0, s))", 2))
_gauss = filters.gaussian_kernel(0.8)
query("f04_gaussian_blur", lambda s, d: filters.gaussian_blur(fx.grey(s, d), 0.8, S, S), kernel_sql(_gauss, f"s // {filters.ONE}", math.ceil(2.4)))
_grad = "VALUES " + ", ".join(f"({dx}, {dy}, {next((w for a, b, w in filters.SOBEL_X if (a, b) == (dx, dy)), 0)}, {next((w for a, b, w in filters.SOBEL_Y if (a, b) == (dx, dy)), 0)})" for dx in (-1, 0, 1) for dy in (-1, 0, 1))
query("f03_sobel", lambda s, d: filters.sobel(fx.grey(s, d), S, S), f"WITH {fx.GREY_SQL}, k(dx, dy, kx, ky) AS ({_grad}), total AS (SELECT t.image_id, t.x, t.y, any_value(t.v) AS own, sum(s.v * kx)::DOUBLE AS gx, sum(s.v * ky)::DOUBLE AS gy FROM grey t CROSS JOIN k JOIN grey s ON s.image_id = t.image_id AND s.x = t.x + k.dx AND s.y = t.y + k.dy GROUP BY t.image_id, t.x, t.y) SELECT image_id, x, y, CASE WHEN {inner_sql(1)} THEN CAST(trunc(least(255.0, sqrt(gx * gx + gy * gy))) AS INT) ELSE own END AS v FROM total")
_device = ", ".join(f"({dx}, {dy}, {w}::BIGINT)" for dx, dy, w in filters.device_kernel(1.5))
query("f05_device_blur", lambda s, d: filters.device_blur(fx.grey(s, d), 1.5, S, S), f"WITH {fx.GREY_SQL}, k(dx, dy, w) AS (VALUES {_device}) SELECT t.image_id, t.x, t.y, (sum(s.v * k.w) // {filters.ONE})::INT AS v FROM grey t CROSS JOIN k JOIN grey s ON s.image_id = t.image_id AND s.x = least({S - 1}, greatest(0, t.x + k.dx)) AND s.y = least({S - 1}, greatest(0, t.y + k.dy)) GROUP BY t.image_id, t.x, t.y")

# --- reductions ------------------------------------------------------------------------------------------------------
query("h01_histogram", lambda s, d: stats.histogram(fx.grey(s, d)), f"WITH {fx.GREY_SQL} SELECT image_id, v, count(*) AS n FROM grey GROUP BY image_id, v")
query(
    "h02_equalise",
    lambda s, d: stats.equalise(fx.grey(s, d)),
    f"WITH {fx.GREY_SQL}, h AS (SELECT image_id, v, count(*) AS n FROM grey GROUP BY image_id, v), c AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v)::BIGINT AS cdf, sum(n) OVER (PARTITION BY image_id)::BIGINT AS total FROM h), "
    f"m AS (SELECT *, min(cdf) OVER (PARTITION BY image_id) AS least_cdf FROM c) SELECT grey.image_id, x, y, CASE WHEN total = least_cdf THEN 0 ELSE {D.byte(D.div(f'{D.f("cdf - least_cdf")} * {D.f(255)}', D.f('total - least_cdf')))} END AS v FROM grey JOIN m ON m.image_id = grey.image_id AND m.v = grey.v",
)
query(
    "h03_compare",
    lambda s, d: stats.compare(fx.rgb(s, d), shifted(fx.rgb(s, d))).selectExpr("image_id", "round(CAST(avg_diff AS DOUBLE), 4) AS avg_diff", "max_diff", "different_pixels", "round(CAST(similarity AS DOUBLE), 4) AS similarity"),
    f"WITH {fx.RGB_SQL}, d AS (SELECT s.image_id, abs(s.r - t.r) + abs(s.g - t.g) + abs(s.b - t.b) AS total, greatest(abs(s.r - t.r), abs(s.g - t.g), abs(s.b - t.b)) AS most FROM rgb s JOIN rgb t ON t.image_id = s.image_id + 1 AND s.x = t.x AND s.y = t.y) "
    f"SELECT image_id, round(({D.div(D.f('sum(total)'), D.f('count(*) * 3'))})::DOUBLE, 4) AS avg_diff, max(most) AS max_diff, count(*) FILTER (total > 0) AS different_pixels, round(({D.f(100)} * {D.div(D.f('count(*) FILTER (total = 0)'), D.f('count(*)'))})::DOUBLE, 4) AS similarity FROM d GROUP BY image_id",
)
_box_corners = {"x0": "p_partkey % 17", "y0": "p_size % 11", "x1": "p_partkey * 3 % 29 + 0.25", "y1": "p_size % 7", "x2": "p_partkey % 31", "y2": "p_size * 5 % 23 + 0.5", "x3": "p_size % 13", "y3": "p_partkey * 7 % 19"}
query(
    "h07_corner_box",
    lambda s, d: geometry.corner_box(fx.table(s, d, "part").selectExpr("p_partkey", *[f"CAST({e} AS FLOAT) AS {c}" for c, e in _box_corners.items()]), ["x0", "x1", "x2", "x3"], ["y0", "y1", "y2", "y3"]).select("p_partkey", "left", "top", "box_width", "box_height"),
    "SELECT p_partkey, least(x0, x1, x2, x3) AS left, least(y0, y1, y2, y3) AS top, trunc(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3) + 1::FLOAT)::INT AS box_width, trunc(greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) + 1::FLOAT)::INT AS box_height FROM (SELECT p_partkey, " + ", ".join(f"({e})::FLOAT AS {c}" for c, e in _box_corners.items()) + " FROM part)",
)
query(
    "h09_memory_statistics",
    lambda s, d: stats.memory_statistics(fx.table(s, d, "lineitem").selectExpr("l_suppkey AS pool", "l_orderkey * 10 + l_linenumber AS step", "CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS delta").groupBy("pool", "step").agg(F.sum("delta").alias("delta")), "pool", "step", "delta"),
    "WITH e AS (SELECT l_suppkey AS pool, l_orderkey * 10 + l_linenumber AS step, sum(CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT))::BIGINT AS delta FROM lineitem GROUP BY 1, 2), "
    "r AS (SELECT pool, step, sum(delta) OVER w AS current, sum(greatest(delta, 0)) OVER w AS allocated FROM e WINDOW w AS (PARTITION BY pool ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT pool, step, current::BIGINT AS current, allocated::BIGINT AS allocated, (max(current) OVER (PARTITION BY pool ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS peak FROM r",
)

# --- mosaics ---------------------------------------------------------------------------------------------------------
for _pattern in raw.PATTERNS:
    _mine, _near = raw.colour_at(_pattern, "t.x", "t.y"), raw.colour_at(_pattern, "s.x", "s.y")
    _taps = {"r": raw.DIAGONAL, "b": raw.DIAGONAL, "g": raw.ADJACENT}
    _picks = ", ".join(f"CASE WHEN any_value({_mine}) = '{c}' THEN any_value(least(255, t.v // 256)) ELSE coalesce(least(255, sum(CASE WHEN {_near} = '{c}' AND k.c = '{'g' if c == 'g' else 'd'}' THEN s.v // 256 END) // nullif(count(CASE WHEN {_near} = '{c}' AND k.c = '{'g' if c == 'g' else 'd'}' THEN 1 END), 0)), 0) END::INT AS {c}" for c in RGB)
    _offsets = ", ".join([f"('d', {dx}, {dy})" for dx, dy in raw.DIAGONAL] + [f"('g', {dx}, {dy})" for dx, dy in raw.ADJACENT])
    query(f"r03_demosaic_{_pattern}", lambda s, d, p=_pattern: raw.demosaic(fx.bayer(s, d), p), f"WITH {fx.BAYER_SQL}, k(c, dx, dy) AS (VALUES {_offsets}) SELECT t.image_id, t.x, t.y, {_picks} FROM bayer t CROSS JOIN k JOIN bayer s ON s.image_id = t.image_id AND s.x = t.x + k.dx AND s.y = t.y + k.dy GROUP BY t.image_id, t.x, t.y")
query("r04_bayer_colour", lambda s, d: fx.bayer(s, d).selectExpr("image_id", "x", "y", *[f"{raw.colour_at(p)} AS {p}" for p in raw.PATTERNS]), f"WITH {fx.BAYER_SQL} SELECT image_id, x, y, " + ", ".join(f"'{p}'[(y % 2) * 2 + x % 2 + 1] AS {p}" for p in raw.PATTERNS) + " FROM bayer")
