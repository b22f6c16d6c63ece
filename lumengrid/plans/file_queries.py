"""The registered queries over files, scripts, shapes, metadata and tiles, each beside the SQL that DuckDB runs for it."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions import kernels
from ..functions.numeric import DUCK as D
from ..operators import filters, geometry, point, raw, stats, vector
from ..sources import codecs, images, metadata
from ..sources.jpeg import DCT
from ..streaming import ingest
from . import fixtures as fx
from . import image_queries, steps
from .image_queries import RGB, S

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, build, oracle: str | None = None) -> None:
    QUERIES[name] = build
    if oracle is not None:
        ORACLES[name] = oracle


# --- paths and formats, from documents -------------------------------------------------------------------------------
EXTENSIONS = ["png", "JPG", "bmp", "gif", "webp", "Tiff", "dat"]
_ext_sql = "['" + "', '".join(EXTENSIONS) + "'][doc_id % 7 + 1]"
PATH_SQL = f"'/data/' || lang || '/' || source || '/img_' || doc_id || '.' || {_ext_sql}"


def paths(s: SparkSession, d: str) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 7).cast("int"))
    return fx.table(s, d, "documents").select("doc_id", "n_chars", F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/img_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))


_marks = [codecs.SIGNATURES[k] for k in (0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11)]


def _sniffed(s: SparkSession, d: str) -> DataFrame:
    head = lambda name, at, mark: (b"RIFF1234" if name == "webp" else b"\0\0\0\x1c" if at == 4 else b"") + mark
    prefix = F.get(F.array(*[F.lit(bytearray(head(*m))) for m in _marks], F.lit(bytearray(b"??"))), (F.col("doc_id") % (len(_marks) + 1)).cast("int"))
    return fx.table(s, d, "documents").select("doc_id", images.format_of(F.concat(prefix, F.encode("text", "UTF-8"))).alias("format"))


query("s01_sniff", _sniffed, "SELECT doc_id, [" + ", ".join(f"'{m[0]}'" for m in _marks) + f", NULL][doc_id % {len(_marks) + 1} + 1] AS format FROM documents")
query("s13_match_pattern", lambda s, d: paths(s, d).select("doc_id", steps.matches(F.regexp_extract("path", r"([^/]*)$", 1), "img_1*.png").alias("hit")), "SELECT doc_id, doc_id::VARCHAR LIKE '1%' AND doc_id % 7 = 0 AS hit FROM documents")
query(
    "k08_planned_format",
    lambda s, d: paths(s, d).select("doc_id", steps.format_by_path(F.col("path")).alias("own"), steps.planned_format(F.col("path"), F.when(F.col("doc_id") % 5 == 0, "bmp")).alias("planned")),
    "SELECT doc_id, ['png', 'jpeg', 'bmp', 'gif', 'webp', NULL, NULL][doc_id % 7 + 1] AS own, CASE WHEN doc_id % 5 = 0 THEN 'bmp' ELSE ['png', 'jpeg', 'bmp', 'png', 'webp', 'png', 'png'][doc_id % 7 + 1] END AS planned FROM documents",
)
query(
    "k09_output_path",
    lambda s, d: paths(s, d).select("doc_id", steps.output_path(F.col("path"), F.lit("/out"), F.lit("/data"), steps.planned_format(F.col("path"), F.lit(None).cast("string")), True).alias("nested"), steps.output_path(F.col("path"), F.lit("/out"), F.lit("/data"), F.lit("jpeg"), False).alias("flat")),
    "SELECT doc_id, '/out/' || lang || '/' || source || '/img_' || doc_id || '.' || ['png', 'jpg', 'bmp', 'png', 'webp', 'png', 'png'][doc_id % 7 + 1] AS nested, '/out/img_' || doc_id || '.jpg' AS flat FROM documents",
)
_size_error = "CASE WHEN w <= 0 OR h <= 0 THEN 'InvalidDimensions' WHEN w > 65535 OR h > 65535 THEN 'DimensionsTooLarge' WHEN n <> w * h * 3 THEN 'InvalidDimensions' END"


def _checked(s: SparkSession, d: str) -> DataFrame:
    """codecs.check() and the size test of codecs.encode(), on sizes and numbers of bytes."""

    @F.arrow_udf("string")
    def error(width, height, size):
        import pyarrow as pa

        out = []
        for w, h, n in zip(width.to_pylist(), height.to_pylist(), size.to_pylist(), strict=True):
            try:
                codecs.check(w, h)
                codecs.check_size(codecs.Image(w, h, "rgb", b""), n)
                out.append(None)
            except codecs.CodecError as bad:
                out.append(bad.code)
        return pa.array(out, pa.string())

    sizes = fx.table(s, d, "documents").selectExpr("doc_id", "n_chars - 30 AS w", "doc_id * 97 AS h", "(n_chars - 30) * (doc_id * 97) * 3 + CAST(doc_id % 2 AS BIGINT) AS n")
    return sizes.select("doc_id", error("w", "h", "n").alias("error"))


query("k01_validate", _checked, f"SELECT doc_id, {_size_error} AS error FROM (SELECT doc_id, n_chars - 30 AS w, doc_id * 97 AS h, (n_chars - 30) * (doc_id * 97) * 3 + doc_id % 2 AS n FROM documents)")
query(
    "p09_size_metrics",
    lambda s, d: images.size_metrics(fx.table(s, d, "part").selectExpr("p_partkey", "p_size * 31 AS width", "p_size * 17 AS height", "element_at(array('rgb', 'rgba', 'yuv', 'hsv', 'cmyk', 'grayscale'), CAST(p_partkey % 6 AS INT) + 1) AS format")).selectExpr("p_partkey", "pixel_count", "bits_per_pixel", "memory_bytes", "memory_kb", "memory_mb"),
    "SELECT p_partkey, n AS pixel_count, b * 8 AS bits_per_pixel, n * b AS memory_bytes, (n * b)::DOUBLE / 1024.0::DOUBLE AS memory_kb, (n * b)::DOUBLE / 1048576.0::DOUBLE AS memory_mb FROM (SELECT p_partkey, (p_size * 31)::BIGINT * (p_size * 17) AS n, [3, 4, 3, 3, 4, 1][p_partkey % 6 + 1] AS b FROM part)",
)

# --- generated patterns ----------------------------------------------------------------------------------------------
def _avif(width: int, height: int) -> bytes:
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    return box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", box(b"ispe", b"\0" * 4 + struct.pack(">II", width, height)) + box(b"av1C", bytes([0x81, 0, 0x4C, 0])))))


def _stand_in(s: SparkSession, content: bytes) -> DataFrame:
    """The documented gradient of a file whose pixels are not decoded, through the decoder."""
    image = images.decode(s.createDataFrame([("1", bytearray(content))], "path string, content binary"), synthetic=True)
    return images.explode_pixels(image.withColumn("image_id", F.col("path").cast("long"))).select("image_id", "x", "y", F.col("g").alias("v"))


_grey = codecs.Image(16, 12, "grayscale", bytes(192))
for _name, _w, _h, _content in (("s05_webp_gradient", 16, 12, codecs.encode_webp(_grey)), ("s09b_avif_gradient", 24, 9, _avif(24, 9))):
    query(_name, lambda s, d, c=_content: _stand_in(s, c), f"SELECT 1::BIGINT AS image_id, (i % {_w})::INT AS x, (i // {_w})::INT AS y, ((i % {_w} + i // {_w}) * 255 // {_w + _h})::INT AS v FROM range({_w * _h}) t(i)")


def _headers(s: SparkSession, d: str) -> DataFrame:
    """Sizes of containers by part, written and read again: WebP by the encoder, AVIF by its boxes."""

    @F.arrow_udf("struct<webp:string,avif:string>")
    def read(width, height):
        import pyarrow as pa

        sizes = list(zip(width.to_pylist(), height.to_pylist(), strict=True))
        webp = [codecs.webp_header(codecs.encode_webp(codecs.Image(w, h, "grayscale", bytes(w * h)))) for w, h in sizes]
        avif = [codecs.avif_header(_avif(w * 100, h)) for w, h in sizes]
        return pa.StructArray.from_arrays([pa.array([f"{w}x{h}" for w, h, _ in webp]), pa.array([f"{w}x{h} {n} {c}" for w, h, n, c in avif])], ["webp", "avif"])

    rows = fx.table(s, d, "part").selectExpr("p_partkey", "CAST(p_size AS INT) AS w", "CAST(p_partkey % 9 + 1 AS INT) AS h")
    return rows.select("p_partkey", read("w", "h").alias("r")).select("p_partkey", "r.webp", "r.avif")


query("s09a_k05_headers", _headers, "SELECT p_partkey, p_size || 'x' || (p_partkey % 9 + 1) AS webp, p_size * 100 || 'x' || (p_partkey % 9 + 1) || ' 10 420' AS avif FROM part")
query("s11_raw_stand_in", lambda s, d: point.grey_to_rgb(geometry.filled(s, 1, 10, 6, 128)), "SELECT 1::BIGINT AS image_id, (i % 10)::INT AS x, (i // 10)::INT AS y, 128 AS r, 128 AS g, 128 AS b FROM range(60) t(i)")


def _chroma(s: SparkSession, d: str) -> DataFrame:
    """Luma of an image, chroma of the two after it at half size."""
    g = fx.grey(s, d)
    half = lambda by: g.where("x < 4 AND y < 4").select((F.col("image_id") - by).alias("image_id"), F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("v").alias(f"c{by}"))
    up = g.withColumns({"hx": F.expr("CAST(x div 2 AS INT)"), "hy": F.expr("CAST(y div 2 AS INT)")}).join(half(1), ["image_id", "hx", "hy"]).join(half(2), ["image_id", "hx", "hy"])
    return point.yuv_to_rgb(up.select("image_id", "x", "y", F.col("v").alias("r"), F.col("c1").alias("g"), F.col("c2").alias("b")))


_up = fm.yuv_to_rgb(D, "plain", ("a.v", "b.v", "c.v"))
query("s09c_planar_420", _chroma, f"WITH {fx.GREY_SQL} SELECT a.image_id, a.x, a.y, {_up[0]} AS r, {_up[1]} AS g, {_up[2]} AS b FROM grey a JOIN grey b ON b.image_id = a.image_id + 1 AND b.x = a.x // 2 AND b.y = a.y // 2 JOIN grey c ON c.image_id = a.image_id + 2 AND c.x = a.x // 2 AND c.y = a.y // 2")

# --- block transforms as joins and sums ------------------------------------------------------------------------------
_fixed = np.rint(DCT * (1 << 14)).astype(int)


def _transform(s: SparkSession, d: str, inverse: bool) -> DataFrame:
    """Two passes of a fixed-point 8-point cosine transform: place -> weights by an array, summed by target."""
    px = fx.grey(s, d)
    weight = lambda place, to: int(_fixed[place][to] if inverse else _fixed[to][place])
    table = F.array(*[F.array(*[F.lit(weight(p, t)).cast("long") for t in range(8)]) for p in range(8)])
    for axis, other in (("x", "y"), ("y", "x")):
        spread = px.select("image_id", other, F.col("v").cast("long").alias("v"), F.posexplode(F.get(table, F.col(axis))).alias("to", "w"))
        px = spread.groupBy("image_id", other, F.col("to").alias(axis)).agg(F.expr("CAST(floor((sum(v * w) + 8192) / 16384) AS BIGINT)").alias("v"))
    return px.select("image_id", "x", "y", "v")


for _name, _inv in (("s04d_inverse_cosine", True), ("k04a_forward_cosine", False)):
    _rows = ", ".join(f"({p}, {t}, {int(_fixed[p][t] if _inv else _fixed[t][p])}::BIGINT)" for p in range(8) for t in range(8))
    query(
        _name,
        lambda s, d, i=_inv: _transform(s, d, i),
        f"WITH {fx.GREY_SQL}, m(p, t, w) AS (VALUES {_rows}), a AS (SELECT image_id, y, t AS x, floor((sum(v * w)::BIGINT + 8192) / 16384)::BIGINT AS v FROM grey JOIN m ON p = x GROUP BY image_id, y, t) "
        "SELECT image_id, x, t AS y, floor((sum(v * w)::BIGINT + 8192) / 16384)::BIGINT AS v FROM a JOIN m ON p = y GROUP BY image_id, x, t",
    )


# --- codecs ----------------------------------------------------------------------------------------------------------
def _files(s: SparkSession, d: str, kind: str) -> DataFrame:
    made = images.assemble_pixels(fx.rgb(s, d)).withColumn("path", F.col("image_id").cast("string"))
    return images.encode(made, kind)


def _round_trip(s: SparkSession, d: str, kind: str) -> DataFrame:
    back = images.decode(_files(s, d, kind)).where("error IS NULL").withColumn("image_id", F.col("path").cast("long"))
    return images.explode_pixels(back).select(F.col("image_id").cast("int").alias("image_id"), "x", "y", *RGB)


for _name, _kind in (("s02_k02_bmp_round_trip", "bmp"), ("s03_k03_png_round_trip", "png")):
    query(_name, lambda s, d, k=_kind: _round_trip(s, d, k), f"WITH {fx.RGB_SQL} SELECT image_id, x, y, r, g, b FROM rgb")


def _smooth(s: SparkSession, d: str) -> DataFrame:
    """Pictures of 11 x 9 pixels from part: two ramps of their own slope and a flat channel."""
    cells = s.range(99).selectExpr("CAST(id % 11 AS INT) AS x", "CAST(id div 11 AS INT) AS y")
    rows = fx.table(s, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 20).alias("slope")).join(F.broadcast(cells))
    return rows.selectExpr("image_id", "x", "y", "CAST(x * slope AS INT) AS r", "CAST(255 - y * slope AS INT) AS g", "CAST(image_id % 200 AS INT) AS b")


def _jpeg(s: SparkSession, d: str) -> DataFrame:
    """How many bytes of each picture come back within 20, and the bytes' number."""
    px = _smooth(s, d)
    files = images.encode(images.assemble_pixels(px).withColumn("path", F.col("image_id").cast("string")), "jpeg")
    back = images.explode_pixels(images.decode(files).where("error IS NULL").withColumn("image_id", F.col("path").cast("long")))
    near = sum((F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")) <= 20).cast("int") for c in RGB)
    pairs = px.alias("s").join(back.alias("t"), ["image_id", "x", "y"])
    return pairs.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum(near).alias("n_near"))


query("s04_k04_jpeg_round_trip", _jpeg, "SELECT p_partkey AS image_id, 99::BIGINT AS n_pixels, 297::BIGINT AS n_near FROM part")


def _made(s: SparkSession, d: str, write, *names: str) -> DataFrame:
    """(path, content) of the grey pictures of the fixture, as write(width, height, data) makes them."""

    def work(batches):
        import pyarrow as pa

        rows = ((str(image_id), write(width, height, data)) for image_id, width, height, data in images.each(batches, "image_id", "width", "height", "data"))
        yield from images.emitted(rows, ["path", "content"], [pa.string(), pa.binary()])

    return images.assemble_pixels(fx.grey(s, d)).mapInArrow(work, "path string, content binary")


def _pixels(files: DataFrame) -> DataFrame:
    back = images.decode(files).where("error IS NULL").withColumn("image_id", F.col("path").cast("long"))
    return images.explode_pixels(back).select("image_id", "x", "y", F.col("r").alias("v"))


def _tiff(width: int, height: int, data: bytes) -> bytes:
    """A grey picture in two strips, most significant byte first."""
    half = width * (height // 2)
    fields = [(256, width), (257, height), (258, 8), (259, 1), (277, 1)]
    body = b"".join(struct.pack(">HHIHH", tag, 3, 1, v, 0) for tag, v in fields[:4])
    at = 8 + 2 + 12 * 7 + 4
    body += struct.pack(">HHII", 273, 4, 2, at) + struct.pack(">HHIHH", 277, 3, 1, 1, 0) + struct.pack(">HHII", 279, 4, 2, at + 8)
    return b"MM\0*" + struct.pack(">IH", 8, 7) + body + bytes(4) + struct.pack(">IIII", at + 16, at + 16 + half, half, len(data) - half) + data


def _filtered_png(width: int, height: int, data: bytes) -> bytes:
    """A grey picture whose lines go through the five filters in turn."""
    px = np.frombuffer(data, np.uint8).reshape(height, width).astype(int)
    lines = b""
    for y in range(height):
        left, up = np.append(0, px[y, :-1]), px[y - 1] if y else np.zeros(width, int)
        corner = np.append(0, up[:-1])
        guess = left + up - corner
        near = np.stack([abs(guess - left), abs(guess - up), abs(guess - corner)])
        paeth = np.choose(near.argmin(0), [left, up, corner])
        lines += bytes([y % 5]) + ((px[y] - [0 * left, left, up, (left + up) // 2, paeth][y % 5]) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _gif(width: int, height: int, data: bytes) -> bytes:
    return codecs.encode_gif(codecs.Animation([codecs.Image(width, height, "grayscale", data)]))


for _name, _write in (("s06_tiff", _tiff), ("s03c_png_filters", _filtered_png), ("s07_gif_pixels", _gif)):
    query(_name, lambda s, d, w=_write: _pixels(_made(s, d, w)), f"WITH {fx.GREY_SQL} SELECT image_id, x, y, v FROM grey")


def _exif_file(width: int, height: int, data: bytes) -> bytes:
    """A JPEG head whose EXIF holds a text, a fraction and a number from the first pixels."""
    tags = [(0x010F, 2, 8, 100), (0x829A, 5, 1, 120), (0x0112, 3, 1, data[2])]
    tiff = (b"II*\0" + struct.pack("<IH", 8, 3) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)).ljust(100, b"\0") + b"Maker%02d\0" % (data[0] % 100)
    app = b"Exif\0\0" + tiff.ljust(120, b"\0") + struct.pack("<II", data[1], 200)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xd9"


_exif_sql = f"""WITH {fx.GREY_SQL}, p AS (SELECT image_id, max(v) FILTER (x = 0) AS a, max(v) FILTER (x = 1) AS b, max(v) FILTER (x = 2) AS c FROM grey WHERE y = 0 GROUP BY image_id)
SELECT image_id, 'make' AS name, NULL::DOUBLE AS number, 'Maker' || lpad((a % 100)::VARCHAR, 2, '0') AS text FROM p UNION ALL
SELECT image_id, 'exposure_time', b::DOUBLE / 200.0::DOUBLE, NULL FROM p UNION ALL SELECT image_id, 'orientation', c::DOUBLE, NULL FROM p"""
query("m01_exif", lambda s, d: metadata.exif(_made(s, d, _exif_file)).select(F.col("path").cast("long").alias("image_id"), "name", "number", "text"), _exif_sql)
query("m08_extract", lambda s, d: metadata.extract(_made(s, d, _exif_file).withColumn("path", F.concat("path", F.lit(".JPG")))).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("image_id"), "name", "number", "text"), _exif_sql)


def _camera_file(width: int, height: int, data: bytes) -> bytes:
    """By the first pixel: makers' marks, or a TIFF-based file with its size."""
    if data[0] % 5 < 4:
        return (b"SONY", b"FUJIFILM", b"OLYMP", b"PANA")[data[0] % 5] + bytes(20)
    fields = struct.pack("<HHII", 256, 4, 1, 1000 + data[1]) + struct.pack("<HHII", 257, 4, 1, 500 + data[2]) + struct.pack("<HHII", 258, 3, 1, 14)
    return b"II*\0" + struct.pack("<IH", 8, 3) + fields + bytes(4)


query(
    "r02_camera_files",
    lambda s, d: metadata.camera_files(_made(s, d, _camera_file)).select(F.col("path").cast("long").alias("image_id"), "format", "width", "height", "bits", "make", "pattern", "error"),
    f"""WITH {fx.GREY_SQL}, p AS (SELECT image_id, max(v) FILTER (x = 0) % 5 AS k, max(v) FILTER (x = 1) AS b, max(v) FILTER (x = 2) AS c FROM grey WHERE y = 0 GROUP BY image_id)
SELECT image_id, ['arw', 'raf', 'orf', 'rw2', 'nef'][k + 1] AS format, CASE WHEN k = 4 THEN 1000 + b ELSE 0 END::INT AS width, CASE WHEN k = 4 THEN 500 + c ELSE 0 END::INT AS height, CASE WHEN k = 4 THEN 14 ELSE 16 END::INT AS bits, ['Sony', 'Fujifilm', 'Olympus', 'Panasonic', ''][k + 1] AS make, 'rggb' AS pattern, NULL::VARCHAR AS error FROM p""",
)


def _kernel(s: SparkSession, d: str, operation) -> DataFrame:
    """What batches of files run: decoded from PNG bytes, one numpy kernel an image."""
    images_ = images.map_images(images.decode(_made(s, d, lambda w, h, data: codecs.encode(codecs.Image(w, h, "grayscale", data), "png"))), operation)
    return images.explode_pixels(images_.withColumn("image_id", F.col("path").cast("long"))).select("image_id", "x", "y", F.col("r").alias("v"))


for _name, _operation, _like in (
    ("g01_resize_files", lambda px: kernels.resize(px, 5, 5), "g01_resize_down"), ("f01_blur_files", lambda px: kernels.blur(px, 2), "f01_box_blur"), ("p01_brightness_files", lambda px: kernels.brightness(px, 30), "p01_brightness"),
):
    if _like in image_queries.ORACLES:
        query(_name, lambda s, d, o=_operation: _kernel(s, d, o), image_queries.ORACLES[_like])
query("s15_rows", lambda s, d: fx.grey(s, d).groupBy("image_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: F.lpad(F.hex(c["v"]), 2, "0")), "").alias("bytes")), f"WITH {fx.GREY_SQL} SELECT image_id, y, string_agg(printf('%02X', v), '' ORDER BY x) AS bytes FROM grey GROUP BY image_id, y")


def _animation(s: SparkSession, d: str) -> DataFrame:
    """Animations of up to four images each, encoded, decoded and taken apart again."""
    import pandas as pd

    made = images.assemble_pixels(fx.grey(s, d)).withColumn("path", F.floor(F.col("image_id") / 4).cast("string"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("image_id")
        a = codecs.Animation([codecs.Image(r.width, r.height, r.format, r.data) for r in group.itertuples()], [5 + k for k in range(len(group))], 0)
        return pd.DataFrame({"path": [group.path.iloc[0]], "content": [codecs.encode_gif(a)]})

    files = made.groupBy("path").applyInPandas(join, "path string, content binary")
    return images.frames(files).select(F.col("path").cast("long").alias("animation"), "frame", "delay_cs", "loops", "width", "height", "data")


def _frame_pixels(s: SparkSession, d: str) -> DataFrame:
    found = _animation(s, d).select((F.col("animation") * 4 + F.col("frame")).alias("image_id"), "delay_cs", "loops", "width", "height", F.lit("rgb").alias("format"), "data")
    return images.explode_pixels(found).select("image_id", "x", "y", F.col("g").alias("v"))


query("s08_k06_animation", lambda s, d: _animation(s, d).drop("data"), "SELECT vec_id // 4 AS animation, (vec_id % 4)::INT AS frame, (5 + vec_id % 4)::INT AS delay_cs, 0 AS loops, 8 AS width, 8 AS height FROM embeddings")
query("s08_frame_pixels", _frame_pixels, f"WITH {fx.GREY_SQL} SELECT image_id, x, y, v FROM grey")
query("s07_palette_lookup", lambda s, d: fx.grey(s, d).join(F.broadcast(s.range(256).selectExpr("CAST(id AS INT) AS v", "CAST((id * 7) % 256 AS INT) AS r", "CAST(255 - id AS INT) AS g")), "v").select("image_id", "x", "y", "r", "g"), f"WITH {fx.GREY_SQL} SELECT image_id, x, y, v * 7 % 256 AS r, 255 - v AS g FROM grey")

# --- shapes, from part -----------------------------------------------------------------------------------------------
SHAPES_SQL = """shape AS (SELECT p_partkey // 20 AS doc_id, (p_partkey % 20 + 1)::INT AS seq, p_partkey AS k, ['rect', 'circle', 'line', 'path'][p_partkey % 4 + 1] AS kind,
 (p_partkey * 7 % 40)::INT AS x, (p_size % 30)::INT AS y, (3 + p_partkey % 11)::INT AS width, (2 + p_size % 7)::INT AS height, (p_partkey * 5 % 40)::INT AS cx, (p_size % 40)::INT AS cy, (1 + p_size % 6)::INT AS r,
 (p_partkey * 3 % 40)::INT AS x1, (p_size % 40)::INT AS y1, (p_partkey * 11 % 40)::INT AS x2, (p_size * 7 % 40)::INT AS y2, (1 + p_partkey % 2)::INT AS stroke_width,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey * 7919 % 16777216 END::INT AS fill,
 CASE p_size % 3 WHEN 0 THEN 16711680 WHEN 1 THEN NULL ELSE CASE WHEN p_partkey % 4 = 2 THEN 0 END END::INT AS stroke FROM part)"""


def _markup(s: SparkSession, d: str) -> DataFrame:
    """One document of up to 20 lines for each 20 parts."""
    rules = {"x": "p_partkey * 7 % 40", "y": "p_size % 30", "width": "3 + p_partkey % 11", "height": "2 + p_size % 7", "cx": "p_partkey * 5 % 40", "cy": "p_size % 40", "r": "1 + p_size % 6", "x1": "p_partkey * 3 % 40", "y1": "p_size % 40", "x2": "p_partkey * 11 % 40", "y2": "p_size * 7 % 40"}
    of_kind = {"rect": ("x", "y", "width", "height"), "circle": ("cx", "cy", "r"), "line": ("x1", "y1", "x2", "y2"), "path": ()}
    attrs = lambda kind: F.concat(F.lit(f"  <{kind}"), *[F.concat(F.lit(f' {a}="'), F.expr(f"CAST({rules[a]} AS STRING)"), F.lit('"')) for a in of_kind[kind]])
    fill = F.when(F.expr("p_partkey % 5 = 0"), "none").otherwise(F.concat(F.lit("#"), F.lpad(F.hex(F.expr("p_partkey * 7919 % 16777216")), 6, "0")))
    stroke = F.expr("""CASE p_size % 3 WHEN 0 THEN ' stroke="red"' WHEN 1 THEN ' stroke="none"' ELSE '' END""")
    line = F.concat(F.coalesce(*[F.when(F.expr(f"p_partkey % 4 = {k}"), attrs(kind)) for k, kind in enumerate(of_kind)]), F.lit(' fill="'), fill, F.lit('"'), stroke, F.lit(' stroke-width="'), F.expr("CAST(1 + p_partkey % 2 AS STRING)"), F.lit('"/>'))
    lines = fx.table(s, d, "part").select(F.expr("p_partkey div 20").alias("doc_id"), "p_partkey", line.alias("line"))
    body = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("lines"))
    return body.select("doc_id", F.concat(F.lit('<svg width="32" height="32" viewBox="0 0 40 40">\n'), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n</svg>")).alias("content"))


_order = "row_number() OVER (PARTITION BY doc_id ORDER BY k)::INT"
query("v01_parse_markup", lambda s, d: vector.parse(_markup(s, d)).select("doc_id", "seq", "kind"), f"WITH {SHAPES_SQL} SELECT doc_id, {_order} AS seq, kind FROM shape UNION ALL SELECT DISTINCT doc_id, 0, 'svg' FROM shape")
query("v02_attributes", lambda s, d: fx.table(s, d, "pages").select("page_id", vector.attribute(F.col("html"), "lang").alias("lang"), vector.attribute(F.col("html"), "href").alias("href")), r"""SELECT page_id, CASE WHEN regexp_matches(html, '(^|[\s<])lang="') THEN regexp_extract(html, '(?:^|[\s<])lang="([^"]*)"', 1) END AS lang, CASE WHEN regexp_matches(html, '(^|[\s<])href="') THEN regexp_extract(html, '(?:^|[\s<])href="([^"]*)"', 1) END AS href FROM pages""")
_numbers = {"rect": ("x", "y", "width", "height"), "circle": ("cx", "cy", "r"), "line": ("x1", "y1", "x2", "y2")}
_defaults = {"x": 0, "y": 0, "width": 10, "height": 10, "cx": 0, "cy": 0, "r": 5, "x1": 0, "y1": 0, "x2": 10, "y2": 10}
query(
    "v03_shapes",
    lambda s, d: vector.shapes(vector.parse(_markup(s, d)).where("kind <> 'svg'")).selectExpr("doc_id", "seq", "kind", *[f"CAST({c} AS INT) AS {c}" for c in (*_defaults, "stroke_width")], "fill", "stroke"),
    f"WITH {SHAPES_SQL} SELECT doc_id, {_order} AS seq, kind, " + ", ".join(f"CASE WHEN kind = '{next(k for k, v in _numbers.items() if c in v)}' THEN {c} ELSE {default} END AS {c}" for c, default in _defaults.items()) + ", stroke_width, fill, stroke FROM shape",
)
_f = D.f
_scale = D.div(_f(32), _f(40))
_painted = f"""{SHAPES_SQL}, o AS (SELECT *, {_order} AS z, {_scale} AS sc FROM shape), canvas AS (SELECT (i % 32)::INT AS px, (i // 32)::INT AS py FROM range(1024) t(i)),
rects AS (SELECT doc_id, z, fill, stroke, trunc(x::FLOAT * sc)::INT AS a, trunc(y::FLOAT * sc)::INT AS b, least(31, trunc((x::FLOAT + width::FLOAT) * sc)::INT) AS c, least(31, trunc((y::FLOAT + height::FLOAT) * sc)::INT) AS e, CASE WHEN stroke IS NULL THEN 0 ELSE trunc(stroke_width::FLOAT * sc)::INT END AS edge FROM o WHERE kind = 'rect'),
rp AS (SELECT doc_id, z, px, py, CASE WHEN edge > 0 AND (py < b + edge OR py > e - edge OR px < a + edge OR px > c - edge) THEN stroke ELSE fill END AS colour FROM rects JOIN canvas ON px BETWEEN a AND c AND py BETWEEN b AND e),
discs AS (SELECT doc_id, z, fill, stroke, cx::FLOAT * sc AS kx, cy::FLOAT * sc AS ky, r::FLOAT * sc AS kr, stroke_width::FLOAT * sc AS ring FROM o WHERE kind = 'circle'),
cp AS (SELECT doc_id, z, px, py, CASE WHEN fill IS NOT NULL THEN fill WHEN far >= kr - ring THEN stroke END AS colour FROM (SELECT *, {D.sqrt('(px::FLOAT - kx) * (px::FLOAT - kx) + (py::FLOAT - ky) * (py::FLOAT - ky)')} AS far FROM discs, canvas) WHERE far <= kr),
lines AS (SELECT doc_id, z, stroke AS colour, trunc(x1::FLOAT * sc)::INT AS px, trunc(y1::FLOAT * sc)::INT AS py, trunc(x2::FLOAT * sc)::INT AS ex, trunc(y2::FLOAT * sc)::INT AS ey FROM o WHERE kind = 'line' AND stroke IS NOT NULL),
walk AS (SELECT *, abs(ex - px) AS dx, abs(ey - py) AS dy, abs(ex - px) - abs(ey - py) AS err FROM lines UNION ALL
  SELECT doc_id, z, colour, px + CASE WHEN 2 * err > -dy THEN CASE WHEN px < ex THEN 1 WHEN px > ex THEN -1 ELSE CASE WHEN dx = 0 THEN 0 ELSE 1 END END ELSE 0 END, py + CASE WHEN 2 * err < dx THEN CASE WHEN py < ey THEN 1 ELSE -1 END ELSE 0 END, ex, ey, dx, dy,
    err - CASE WHEN 2 * err > -dy THEN dy ELSE 0 END + CASE WHEN 2 * err < dx THEN dx ELSE 0 END FROM walk WHERE px <> ex OR py <> ey),
painted AS (SELECT doc_id, z, px, py, colour FROM rp WHERE colour IS NOT NULL UNION ALL SELECT doc_id, z, px, py, colour FROM cp WHERE colour IS NOT NULL UNION ALL SELECT doc_id, z, px, py, colour FROM walk WHERE px BETWEEN 0 AND 31 AND py BETWEEN 0 AND 31)"""


def _rendered(s: SparkSession, d: str, kinds: tuple[str, ...] = ("rect", "circle", "line")) -> DataFrame:
    lines = vector.parse(_markup(s, d))
    return vector.render(vector.shapes(lines.where(F.col("kind").isin(*kinds))), vector.view_box(lines), 32, 32).selectExpr("doc_id", "x", "y", "CAST(r AS INT) AS r", "CAST(g AS INT) AS g", "CAST(b AS INT) AS b")


def _top(relation: str) -> str:
    return f"SELECT doc_id, px AS x, py AS y, (colour // 65536)::INT AS r, (colour // 256 % 256)::INT AS g, (colour % 256)::INT AS b FROM (SELECT doc_id, px, py, arg_max(colour, z) AS colour FROM {relation} GROUP BY doc_id, px, py)"


query("v04_render", _rendered, f"WITH RECURSIVE {_painted} {_top('painted')}")
query(
    "s10_rasterised_markup",
    lambda s, d: vector.rasterise(_markup(s, d), 32, 32),
    f"WITH RECURSIVE {_painted}, top AS ({_top('painted')}), every AS (SELECT DISTINCT doc_id, px AS x, py AS y FROM shape, canvas) SELECT doc_id, x, y, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b FROM every LEFT JOIN top USING (doc_id, x, y)",
)
query("v05_rects", lambda s, d: _rendered(s, d, ("rect",)), f"WITH RECURSIVE {_painted} {_top('(SELECT * FROM rp WHERE colour IS NOT NULL)')}")
query("v06_circles", lambda s, d: _rendered(s, d, ("circle",)), f"WITH RECURSIVE {_painted} {_top('(SELECT * FROM cp WHERE colour IS NOT NULL)')}")
query("v07_lines", lambda s, d: _rendered(s, d, ("line",)), f"WITH RECURSIVE {_painted} {_top('(SELECT * FROM walk WHERE px BETWEEN 0 AND 31 AND py BETWEEN 0 AND 31)')}")

# --- metadata --------------------------------------------------------------------------------------------------------
query(
    "m04_exif_map",
    lambda s, d: metadata.exif_map(fx.table(s, d, "events").selectExpr("user_id % 50 AS owner", "CAST(event_id % 10 AS INT) AS tag", "value", "event_id"), "owner", "tag", "value", "event_id").select("owner", F.size("exif").alias("n"), F.try_element_at("exif", F.lit(3)).alias("third"), F.try_element_at("exif", F.lit(99)).alias("absent")),
    "SELECT owner, count(*)::INT AS n, any_value(v) FILTER (tag = 3) AS third, NULL::DOUBLE AS absent FROM (SELECT user_id % 50 AS owner, event_id % 10 AS tag, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY owner",
)
query(
    "m05_rationals",
    lambda s, d: fx.table(s, d, "events").select("event_id", F.round(metadata.rational(F.col("event_id"), F.col("user_id") % 4), 6).alias("value"), metadata.rational_from(F.col("value")).alias("numerator")),
    "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE round(event_id::DOUBLE / (user_id % 4)::DOUBLE, 6) END AS value, trunc(value * 10000)::BIGINT AS numerator FROM events",
)
_packet = "'<x:xmpmeta dc:title=\"' || p_name || '\" xmp:Rating=\"' || p_size || '\"/>'"
query("m06_xmp", lambda s, d: fx.table(s, d, "part").select("p_partkey", F.expr(_packet).alias("packet")).select("p_partkey", metadata.xmp_value(F.col("packet"), "dc", "title").alias("title"), metadata.xmp_value(F.col("packet"), "xmp", "Rating").alias("rating"), metadata.xmp_value(F.col("packet"), "dc", "format").alias("format")), "SELECT p_partkey, p_name AS title, p_size::VARCHAR AS rating, NULL::VARCHAR AS format FROM part")
query(
    "m07_iptc",
    lambda s, d: fx.table(s, d, "part").select("p_partkey", metadata.iptc_set(metadata.iptc_set(F.expr("map(105, p_name, 25, p_brand)"), 25, F.col("p_type")), 80, F.expr("CAST(p_size AS STRING)")).alias("m")).select("p_partkey", metadata.iptc_get(F.col("m"), 105).alias("headline"), metadata.iptc_get(F.col("m"), 25).alias("keywords"), metadata.iptc_get(F.col("m"), 80).alias("byline"), metadata.iptc_get(F.col("m"), 120).alias("caption")),
    "SELECT p_partkey, p_name AS headline, p_type AS keywords, p_size::VARCHAR AS byline, NULL::VARCHAR AS caption FROM part",
)
query("m08_reader", lambda s, d: paths(s, d).select("doc_id", metadata.metadata_kind(F.col("path")).alias("reader")), "SELECT doc_id, ['none', 'exif', 'none', 'none', 'none', 'tiff', 'none'][doc_id % 7 + 1] AS reader FROM documents")


def _icc(s: SparkSession, d: str) -> DataFrame:
    whole = metadata.srgb_profile()
    files = s.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[:100])), (3, bytearray(whole[:140]))], "id int, content binary")
    return metadata.icc_header(files).select("id", "error", "profile_size", "device_class", "color_space", "pcs", "platform", F.size("tags").alias("n_tags"))


query("c20_icc", _icc, "SELECT * FROM (VALUES (1, NULL, 228::BIGINT, 'mntr', 'RGB ', 'XYZ ', 'MSFT', 8), (2, 'InvalidIccProfile', NULL, NULL, NULL, NULL, NULL, NULL), (3, 'InvalidIccProfile', NULL, NULL, NULL, NULL, NULL, NULL)) t(id, error, profile_size, device_class, color_space, pcs, platform, n_tags)")
_names = list(steps.PROFILE_NAMES) + ["SRGB", "Adobe_RGB", "nothing"]
query("c21_profile_names", lambda s, d: s.createDataFrame([(n,) for n in _names], "name string").select("name", steps.profile_by_name(F.col("name")).alias("profile")), "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {repr(steps.PROFILE_NAMES.get(n.lower())).replace('None', 'NULL')})" for n in _names) + ") t(name, profile)")

# --- batches, pipelines, tiles ---------------------------------------------------------------------------------------
_status = "CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'skipped' ELSE 'processed' END AS status"
query("h08_batch_counters", lambda s, d: stats.batch_counters(fx.table(s, d, "documents").selectExpr("doc_id", _status)), f"SELECT count(*) AS total, count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM (SELECT doc_id, {_status} FROM documents)")


def _batch(s: SparkSession, d: str) -> DataFrame:
    """A batch over the PNG files of the fixture, every ninth broken, every seventh there already."""
    files = _files(s, d, "png").select(F.concat(F.lit("/in/"), "path", F.lit(".png")).alias("path"), F.when(F.col("path").cast("int") % 9 == 0, F.expr("substring(content, 1, 20)")).otherwise(F.col("content")).alias("content"))
    existing = files.where(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 7 == 0).select(F.regexp_replace("path", "^/in", "/out").alias("path"))
    job = steps.BatchJob(root="/in").set_output("/out").set_operation("resize", width=4, height=9)
    done = job.run(files, existing)
    size = images.decode(done.where("status = 'processed'").select("path", "content")).select(F.col("path").alias("p"), "width", "height")
    return done.join(size, F.col("path") == F.col("p"), "left").select("path", "output_path", "status", "error", "width", "height")


query(
    "b01_batch",
    _batch,
    f"WITH {fx.RGB_SQL}, i AS (SELECT DISTINCT image_id AS k FROM rgb), t AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'skipped' WHEN k % 9 = 0 THEN 'failed' ELSE 'processed' END AS status FROM i) "
    "SELECT '/in/' || k || '.png' AS path, '/out/' || k || '.png' AS output_path, status, CASE WHEN status = 'failed' THEN 'InvalidFileFormat' END AS error, CASE WHEN status = 'processed' THEN 4 END AS width, CASE WHEN status = 'processed' THEN 4 END AS height FROM t",
)
_ratio = D.div(_f("w"), _f("h"))
query("b03_aspect_height", lambda s, d: fx.table(s, d, "part").selectExpr("p_partkey", "p_size * 13 AS w", "CAST(p_partkey % 500 + 1 AS INT) AS h").selectExpr("p_partkey", f"greatest(1, CAST(floor({point.SPARK.div(point.SPARK.f(640), point.SPARK.div(point.SPARK.f('w'), point.SPARK.f('h')))} + CAST(0.5 AS FLOAT)) AS INT)) AS height"), f"SELECT p_partkey, greatest(1, CAST(floor({D.div(_f(640), _ratio)} + {_f(0.5)}) AS INT)) AS height FROM (SELECT p_partkey, p_size * 13 AS w, (p_partkey % 500 + 1)::INT AS h FROM part)")
_lines = [
    "job operation=resize input=/a.png output=/out width=64 height=64", "job operation=convert inputs=/a.png,/b.png output=/out format=png recursive=true", "# a comment", "job operation=brightness input=/a.png output=/out",
    "pipeline resize:2x2", "job operation=white_balance input=/a.png output=/out temperature=10 tint=-5 # warm", "JOB operation=blur output=/out radius=2", "job input=/a.png output=/out", "job operation=sparkle input=/a output=/out", "job operation=Brightness amount=3 input=/a.png",
]
_parsed = {0: ("resize", None), 1: ("convert_format", None), 3: ("adjust_brightness", "InvalidBatchSpec"), 4: (None, "UnknownCommand"), 5: ("white_balance", None), 6: ("blur", "NoInputFiles"), 7: (None, "NoOperation"), 8: (None, "InvalidBatchSpec"), 9: ("adjust_brightness", "NoOutputDirectory")}
_sql = lambda v: "NULL" if v is None else f"'{v}'"
query("b06_job_lines", lambda s, d: steps.job_lines(fx.table(s, d, "part").select(F.col("p_partkey").alias("line_no"), F.get(F.array(*map(F.lit, _lines)), (F.col("p_partkey") % 10).cast("int")).alias("value"))).select("line_no", "op", "valid", "reason"), "SELECT p_partkey AS line_no, op, reason IS NULL AS valid, reason FROM part JOIN (VALUES " + ", ".join(f"({k}, {_sql(a)}, {_sql(b)})" for k, (a, b) in _parsed.items()) + ") t(k, op, reason) ON k = p_partkey % 10")
_folded = f"""{fx.GREY_SQL}, a AS (SELECT image_id, x - 1 AS x, y - 1 AS y, least(255, v + 20) AS v FROM grey WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6), b AS (SELECT image_id, x, y, {fm.contrast(D, 'v', 1.2)} AS v FROM a),
c AS (SELECT image_id, x, y, (sum(v) OVER w // count(*) OVER w)::INT AS v FROM b WINDOW w AS (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)), e AS (SELECT image_id, x, y, (sum(v) OVER w // count(*) OVER w)::INT AS v FROM c WINDOW w AS (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
query("b08_pipeline", lambda s, d: steps.Frame(fx.grey(s, d), S, S).run(["crop:1,1,6,6", "brightness:20", "contrast:1.2", "blur:1", "flip:v", "flip:v", "flip:h", "save:out.png"]).px, f"WITH {_folded} SELECT image_id, 5 - x AS x, y, v FROM e")
query("b10_values", lambda s, d: fx.table(s, d, "part").select("p_partkey", F.expr("try_cast(p_name AS INT)").alias("as_int"), F.expr("try_cast(CAST(p_size AS STRING) AS FLOAT)").cast("double").alias("as_float"), F.lower(F.get(F.array(F.lit("TRUE"), F.lit("off"), F.lit("Yes")), (F.col("p_partkey") % 3).cast("int"))).isin("true", "yes", "1", "on").alias("as_bool")), "SELECT p_partkey, NULL::INT AS as_int, p_size::DOUBLE AS as_float, p_partkey % 3 <> 1 AS as_bool FROM part")


def _brighter(frame):
    frame["v"] = np.clip(frame["v"] + 10 * (frame["tile_x"] + frame["tile_y"]), 0, 255)
    return frame


query("x01_tiles", lambda s, d: images.map_tiles(fx.grey(s, d), 3, 3, _brighter).select("image_id", "x", "y", "v"), f"WITH {fx.GREY_SQL} SELECT image_id, x, y, least(255, v + 10 * (x // 3 + y // 3)) AS v FROM grey")
query("x02_tile_progress", lambda s, d: images.tile_progress(fx.grey(s, d), 3, 3), f"WITH {fx.GREY_SQL} SELECT image_id, (x // 3)::INT AS tile_x, (y // 3)::INT AS tile_y, count(*) AS n_pixels, (y // 3 * 3 + x // 3 + 1)::INT AS current, 9::BIGINT AS total FROM grey GROUP BY image_id, x // 3, y // 3")
query("x03_strips", lambda s, d: images.tiles(fx.grey(s, d), S, 3).groupBy("image_id", "tile_y").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), f"WITH {fx.GREY_SQL} SELECT image_id, (y // 3)::INT AS tile_y, count(*) AS n, sum(v)::BIGINT AS total FROM grey GROUP BY image_id, y // 3")


def _user_image(s: SparkSession, d: str) -> DataFrame:
    made = images.assemble_pixels(fx.rgb(s, d)).select(F.col("image_id").cast("string").alias("path"), "width", "height", "format", "data", F.lit(None).cast("string").alias("error"))
    turned = images.map_images(made, lambda px: 255 - px).withColumn("image_id", F.col("path").cast("long"))
    return images.explode_pixels(turned).select(F.col("image_id").cast("int").alias("image_id"), "x", "y", *RGB)


query("u01_image_function", _user_image, f"WITH {fx.RGB_SQL} SELECT image_id, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM rgb")
query("u02_tile_function", lambda s, d: images.map_tiles(fx.grey(s, d), 4, 8, lambda f: f.assign(v=f["v"].max())).select("image_id", "x", "y", "v"), f"WITH {fx.GREY_SQL} SELECT image_id, x, y, max(v) OVER (PARTITION BY image_id, x // 4) AS v FROM grey")
query("u03_rows_of_images", lambda s, d: images.explode_pixels(images.assemble_pixels(fx.grey(s, d))).select("image_id", "x", "y", F.col("r").alias("v")), f"WITH {fx.GREY_SQL} SELECT image_id, x, y, v FROM grey")
query("d05_add", lambda s, d: fx.table(s, d, "nation").select("n_name", (F.col("n_nationkey") + F.col("n_regionkey")).alias("total")), "SELECT n_name, n_nationkey + n_regionkey AS total FROM nation")
for _name, _slide in (("x05_tumbling_windows", None), ("x05_sliding_windows", "30 minutes")):
    _buckets = "time_bucket(INTERVAL 1 hour, ts)" if _slide is None else "unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes])"
    query(_name, lambda s, d, sl=_slide: ingest.windowed_counts(fx.table(s, d, "events"), "1 hour", sl).select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "event_type", "n", F.round("total", 4).alias("total")), f"SELECT start, start + INTERVAL 1 hour AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT {_buckets} AS start, event_type, value FROM events) GROUP BY start, event_type")
query("r01_raw_format", lambda s, d: fx.table(s, d, "documents").withColumn("content", F.concat(F.get(F.array(*[F.lit(bytearray(b)) for b in (b"II*\0\0\0\0\0CR", b"II*\0\x08\0\0\0xx", b"MM\0*", b"SONY", b"FUJIFILM", b"OLYMP", b"PANA", b"none")]), (F.col("doc_id") % 8).cast("int")), F.encode("text", "UTF-8"))).select("doc_id", raw.raw_format("content").alias("format")), "SELECT doc_id, ['cr2', 'nef', 'nef', 'arw', 'raf', 'orf', 'rw2', NULL][doc_id % 8 + 1] AS format FROM documents")
