"""Vector shapes: parsing of markup lines and rasterising by range.

A shape only meets the pixels of its box: the box's columns and rows are exploded from the shape, so the pixels made are
those that it covers, not shapes x canvas; the painter's order is the largest sequence number at each pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import SPARK

#: The colours known by name, as (r, g, b).
COLOURS = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255)}


def attribute(line: Column, name: str) -> Column:
    """The value of an attribute, whole names only; null where it is absent."""
    found = F.regexp_extract(line, rf'(?:^|[\s<]){name}="([^"]*)"', 1)
    return F.when(F.regexp_like(line, F.lit(rf'(?:^|[\s<]){name}="')), found)


def number(line: Column, name: str, default: float) -> Column:
    return F.coalesce(attribute(line, name).try_cast("float"), F.lit(default).cast("float"))


def colour(line: Column, name: str, default: tuple[int, int, int] | None) -> Column:
    """Packed 0xRRGGBB, null for transparent."""
    value = attribute(line, name)
    hexed = F.conv(F.substring(value, 2, 6), 16, 10).cast("int")
    fallback = F.lit(None if default is None else (default[0] << 16) + (default[1] << 8) + default[2]).cast("int")
    out = F.when(value == "none", F.lit(None).cast("int"))
    for known, (r, g, b) in COLOURS.items():
        out = out.when(value == known, (r << 16) + (g << 8) + b)
    return out.when(value.startswith("#") & (F.length(value) >= 7), hexed).otherwise(fallback)


KINDS = ("svg", "rect", "circle", "line", "path")


def parse(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, seq, kind, line) of the lines that begin with a known tag; one element a line."""
    lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(content, "\n")).alias("seq", "line")).withColumn("line", F.trim("line"))
    kind = F.regexp_extract("line", r"^<(svg|rect|circle|line|path)\b", 1)
    return lines.withColumn("kind", kind).where("kind <> ''")


def shapes(lines: DataFrame) -> DataFrame:
    """Typed columns of parsed lines, with the defaults of each kind."""
    line = F.col("line")
    return lines.select(
        "doc_id", "seq", "kind",
        number(line, "x", 0).alias("x"), number(line, "y", 0).alias("y"), number(line, "width", 10).alias("width"), number(line, "height", 10).alias("height"),
        number(line, "cx", 0).alias("cx"), number(line, "cy", 0).alias("cy"), number(line, "r", 5).alias("r"),
        number(line, "x1", 0).alias("x1"), number(line, "y1", 0).alias("y1"), number(line, "x2", 10).alias("x2"), number(line, "y2", 10).alias("y2"),
        colour(line, "fill", (0, 0, 0)).alias("fill"), F.when(F.col("kind") == "line", colour(line, "stroke", (0, 0, 0))).otherwise(colour(line, "stroke", None)).alias("stroke"), number(line, "stroke-width", 1).alias("stroke_width"),
    )


def view_box(lines: DataFrame) -> DataFrame:
    """(doc_id, width, height) of the view boxes; 100 x 100 where the tag gives none."""
    parts = F.split(attribute(F.col("line"), "viewBox"), " ")
    side = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("float"), F.lit(100).cast("float"))
    return lines.where("kind = 'svg'").select("doc_id", side(2).alias("view_width"), side(3).alias("view_height"))


def _box(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Explodes bx1..bx2, by1..by2, cut to the canvas."""
    rows = rows.selectExpr("*", "greatest(bx1, 0) AS ax1", f"least(bx2, {width - 1}) AS ax2", "greatest(by1, 0) AS ay1", f"least(by2, {height - 1}) AS ay2").where("ax1 <= ax2 AND ay1 <= ay2")
    return rows.selectExpr("*", "explode(sequence(ax1, ax2)) AS px").selectExpr("*", "explode(sequence(ay1, ay2)) AS py")


def raster_rects(shapes_: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, seq, px, py, colour): the fill, then the stroke inside the edges over it."""
    d = SPARK
    rows = shapes_.selectExpr("doc_id", "seq", "fill", "stroke", f"{d.trunc('x * sx')} AS bx1", f"{d.trunc('y * sy')} AS by1", f"least({width - 1}, {d.trunc('(x + width) * sx')}) AS bx2", f"least({height - 1}, {d.trunc('(y + height) * sy')}) AS by2", f"CASE WHEN stroke IS NULL OR stroke_width <= 0 THEN 0 ELSE {d.trunc('stroke_width * sx')} END AS edge")
    inside = _box(rows, width, height)
    on_edge = "edge > 0 AND (py < by1 + edge OR py > by2 - edge OR px < bx1 + edge OR px > bx2 - edge)"
    return inside.selectExpr("doc_id", "seq", "px", "py", f"CASE WHEN {on_edge} THEN stroke ELSE fill END AS colour").where("colour IS NOT NULL")


def raster_circles(shapes_: DataFrame, width: int, height: int) -> DataFrame:
    """The disc; its stroke only where nothing fills it."""
    d = SPARK
    rows = shapes_.selectExpr("doc_id", "seq", "fill", "stroke", "stroke_width * least(sx, sy) AS ring", "cx * sx AS kx", "cy * sy AS ky", "r * least(sx, sy) AS kr")
    rows = rows.selectExpr("*", f"{d.trunc(f'greatest({d.f(0)}, kx - kr)')} AS bx1", f"{d.trunc(f'greatest({d.f(0)}, ky - kr)')} AS by1", f"{d.trunc(f'least({d.f(width - 1)}, kx + kr)')} AS bx2", f"{d.trunc(f'least({d.f(height - 1)}, ky + kr)')} AS by2")
    near = _box(rows, width, height).selectExpr("*", f"{d.sqrt(f'({d.f("px")} - kx) * ({d.f("px")} - kx) + ({d.f("py")} - ky) * ({d.f("py")} - ky)')} AS far").where("far <= kr")
    return near.selectExpr("doc_id", "seq", "px", "py", "CASE WHEN fill IS NOT NULL THEN fill WHEN far >= kr - ring THEN stroke END AS colour").where("colour IS NOT NULL")


def line_steps(prefix: str = "") -> tuple[str, str]:
    """Places of Bresenham's line at step k of max(dx, dy), in closed form: the error decides the minor step by halves.

    A line of no length has one step, in place."""
    dx, dy = "abs(ex - bx)", "abs(ey - by)"
    x = f"bx + CASE WHEN bx < ex THEN 1 ELSE -1 END * CASE WHEN {dx} >= {dy} THEN k ELSE CAST((2 * k * CAST({dx} AS BIGINT) + {dy} - 1) div greatest(1, 2 * {dy}) AS INT) END"
    y = f"by + CASE WHEN by < ey THEN 1 ELSE -1 END * CASE WHEN {dx} >= {dy} THEN CAST((2 * k * CAST({dy} AS BIGINT) + greatest(0, {dx} - 1)) div greatest(1, 2 * {dx}) AS INT) ELSE k END"
    return x, y


def raster_lines(shapes_: DataFrame, width: int, height: int) -> DataFrame:
    """One pixel wide, whatever the stroke width."""
    d = SPARK
    rows = shapes_.where("stroke IS NOT NULL").selectExpr("doc_id", "seq", "stroke AS colour", f"{d.trunc('x1 * sx')} AS bx", f"{d.trunc('y1 * sy')} AS by", f"{d.trunc('x2 * sx')} AS ex", f"{d.trunc('y2 * sy')} AS ey")
    steps = rows.selectExpr("*", "explode(sequence(0, greatest(abs(ex - bx), abs(ey - by)))) AS k")
    x, y = line_steps()
    return steps.selectExpr("doc_id", "seq", f"{x} AS px", f"{y} AS py", "colour").where(f"px BETWEEN 0 AND {width - 1} AND py BETWEEN 0 AND {height - 1}")


def rasterise(docs: DataFrame, width: int, height: int, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, x, y, r, g, b) of whole canvases of markup documents: white, and what the shapes paint on it."""
    lines = parse(docs, key, content)
    white = docs.selectExpr(f"{key} AS doc_id", f"explode(sequence(0, {width - 1})) AS x").selectExpr("doc_id", "x", f"explode(sequence(0, {height - 1})) AS y")
    painted = render(shapes(lines.where("kind <> 'svg'")), view_box(lines), width, height)
    both = white.selectExpr("doc_id", "x", "y", "-1 AS r", "-1 AS g", "-1 AS b").unionByName(painted)
    top = both.groupBy("doc_id", "x", "y").agg(*[F.max(c).alias(c) for c in "rgb"])
    return top.select("doc_id", "x", "y", *[F.when(F.col(c) < 0, 255).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"])


def render(shapes_: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(doc_id, x, y, r, g, b) of the pixels that any shape paints."""
    d = SPARK
    scaled = shapes_.join(boxes, "doc_id").selectExpr("*", f"{d.div(d.f(width), 'view_width')} AS sx", f"{d.div(d.f(height), 'view_height')} AS sy")
    painted = raster_rects(scaled.where("kind = 'rect'"), width, height)
    for kind, raster in (("circle", raster_circles), ("line", raster_lines)):
        painted = painted.unionByName(raster(scaled.where(f"kind = '{kind}'"), width, height))
    top = painted.groupBy("doc_id", "px", "py").agg(F.max(F.struct("seq", "colour"))["colour"].alias("colour"))
    return top.selectExpr("doc_id", "px AS x", "py AS y", "CAST(colour div 65536 AS INT) AS r", "CAST((colour div 256) % 256 AS INT) AS g", "colour % 256 AS b")
