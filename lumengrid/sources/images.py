"""Image relations: one row an image, and the ways to pixels and back, to files and from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import codecs

IMAGE = "path string, width int, height int, format string, data binary, error string"
PIXELS = "image_id long, x int, y int, r int, g int, b int"


def bytes_per_pixel(fmt: Column) -> Column:
    return F.when(fmt.isin("rgba", "cmyk"), 4).when(fmt.isin("rgb", "yuv", "hsv"), 3).when(fmt == "grayscale", 1)


def size_metrics(images: DataFrame) -> DataFrame:
    """Counts and sizes from the dimensions alone."""
    bpp = bytes_per_pixel(F.col("format"))
    pixels = F.col("width").cast("long") * F.col("height")
    return images.withColumns({"pixel_count": pixels, "bits_per_pixel": bpp * 8, "memory_bytes": pixels * bpp, "memory_kb": (pixels * bpp).cast("double") / 1024.0, "memory_mb": (pixels * bpp).cast("double") / (1024.0 * 1024.0)})


def format_of(content: Column) -> Column:
    """The file format by its first bytes, in the order of the signatures; null where none fits."""
    out = None
    for name, at, mark in codecs.SIGNATURES:
        hit = F.substring(content, at + 1, len(mark)) == F.lit(mark)
        if name == "webp":
            hit = hit & (F.substring(content, 1, 4) == F.lit(b"RIFF"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def scan(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, content) of the files of a folder, by Spark's own reader."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "content")


#: Bytes of pixels or files that one outgoing batch holds about; a batch of small files may hold very many pixels.
BATCH_BYTES = 32 << 20


def emitted(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size, as they come."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=names)


def each(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The values of the named columns, a row at a time, so that one file's bytes are copied at a time."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def decode(files: DataFrame, synthetic: bool = False) -> DataFrame:
    """Images of (path, content); what cannot be decoded is a row with an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, content in each(batches, "path", "content"):
                try:
                    i = codecs.decode(content or b"", synthetic)
                    yield path, i.width, i.height, i.format, i.data, None
                except codecs.CodecError as bad:
                    yield path, None, None, None, None, bad.code

        yield from emitted(rows(), ["path", "width", "height", "format", "data", "error"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()])

    return files.select("path", "content").mapInArrow(read, IMAGE)


def encode(images: DataFrame, kind: str) -> DataFrame:
    """(path, content, error) of images as files of a kind."""

    images = images if "error" in images.columns else images.withColumn("error", F.lit(None).cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, width, height, fmt, data, error in each(batches, "path", "width", "height", "format", "data", "error"):
                if error is not None:
                    yield path, None, error
                    continue
                try:
                    yield path, codecs.encode(codecs.Image(width, height, fmt, data), kind), None
                except codecs.CodecError as bad:
                    yield path, None, bad.code

        yield from emitted(rows(), ["path", "content", "error"], [pa.string(), pa.binary(), pa.string()])

    return images.select("path", "width", "height", "format", "data", "error").mapInArrow(write, "path string, content binary, error string")


def frames(files: DataFrame) -> DataFrame:
    """(path, frame, delay_cs, loops, width, height, data) of animations: one row a frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, content in each(batches, "path", "content"):
                try:
                    a = codecs.decode_gif_animation(content or b"")
                except (codecs.CodecError, IndexError, ValueError) as bad:
                    yield path, None, None, None, None, None, None, getattr(bad, "code", "InvalidGIF")
                    continue
                for k, (i, d) in enumerate(zip(a.frames, a.delays, strict=True)):
                    yield path, k, d, a.loops, i.width, i.height, i.data, None

        yield from emitted(rows(), ["path", "frame", "delay_cs", "loops", "width", "height", "data", "error"], [pa.string(), *[pa.int32()] * 5, pa.binary(), pa.string()])

    return files.select("path", "content").mapInArrow(read, "path string, frame int, delay_cs int, loops int, width int, height int, data binary, error string")


def explode_pixels(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(image_id, x, y, r, g, b) of rgb images, and (…, v) rows of grey ones as equal channels, some rows of an image at a time."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, width, height, fmt, data in each(batches, key, "width", "height", "format", "data"):
            n = codecs.BYTES_PER_PIXEL[fmt]
            px = np.frombuffer(data, np.uint8).reshape(height, width, n)
            step = max(1, (1 << 18) // width)
            for top in range(0, height, step):
                part = px[top : top + step].astype(np.int32)
                y, x = np.mgrid[top : top + part.shape[0], 0:width].astype(np.int32)
                chans = [part[:, :, min(c, n - 1) if n != 4 else c].ravel() for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, name, np.int64)), pa.array(x.ravel()), pa.array(y.ravel()), *map(pa.array, chans)], names=["image_id", "x", "y", "r", "g", "b"])

    return images.select(key, "width", "height", "format", "data").mapInArrow(spread, PIXELS)


def assemble_pixels(px: DataFrame) -> DataFrame:
    """(image_id, width, height, format, data) of grey or rgb pixel relations: rows of an image meet, as its bytes do."""
    names = [c for c in px.columns if c not in ("image_id", "x", "y")]
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    row = px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.concat(*[two(F.col(c)) for c in names]).alias("h")))).alias("cells"))
    row = row.select("image_id", "y", F.size("cells").alias("width"), F.array_join(F.transform("cells", lambda c: c["h"]), "").alias("h"))
    whole = row.groupBy("image_id").agg(F.max("width").alias("width"), F.count(F.lit(1)).cast("int").alias("height"), F.array_sort(F.collect_list(F.struct("y", "h"))).alias("rows"))
    return whole.select("image_id", "width", "height", F.lit("grayscale" if len(names) == 1 else "rgb").alias("format"), F.unhex(F.array_join(F.transform("rows", lambda r: r["h"]), "")).alias("data"))


# --- tiles -----------------------------------------------------------------------------------------------------------
def tiles(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels with the tile they are in and their place in it; strips are tiles as wide as the image."""
    return px.withColumns({"tile_x": F.expr(f"CAST(x div {width} AS INT)"), "tile_y": F.expr(f"CAST(y div {height} AS INT)"), "in_x": F.col("x") % width, "in_y": F.col("y") % height})


def tile_progress(px: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, tile_x, tile_y, n_pixels, current, total): the order of the tiles of each image."""
    from pyspark.sql import Window

    t = tiles(px, width, height).groupBy("image_id", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n_pixels"))
    by_image = Window.partitionBy("image_id")
    return t.withColumns({"current": F.row_number().over(by_image.orderBy("tile_y", "tile_x")), "total": F.count(F.lit(1)).over(by_image)})


def map_tiles(px: DataFrame, width: int, height: int, operation, schema: str | None = None) -> DataFrame:
    """operation(pandas frame of one tile) -> frame of the same columns; a tile is all that a task holds."""
    t = tiles(px, width, height)
    return t.groupBy("image_id", "tile_x", "tile_y").applyInPandas(operation, schema or t.schema)


def map_images(images: DataFrame, operation) -> DataFrame:
    """operation(pixels: numpy array) -> pixels, for every decoded image; the others pass with their error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                fields = [batch.column(n) for n in ("path", "width", "height", "format", "error")]
                for k, data in enumerate(batch.column("data")):  # pixels are read where they are in the batch
                    path, width, height, fmt, error = (f[k].as_py() for f in fields)
                    if error is not None:
                        yield path, width, height, fmt, data.as_py(), error
                        continue
                    i = codecs.Image.of(operation(codecs.Image(width, height, fmt, data.as_buffer()).pixels))
                    yield path, i.width, i.height, i.format, i.data, None

        yield from emitted(rows(), ["path", "width", "height", "format", "data", "error"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()])

    return images.select("path", "width", "height", "format", "data", "error").mapInArrow(work, IMAGE)


# --- files by name -----------------------------------------------------------------------------------------------------
def check_path(path: str) -> str:
    """A local path that can be read, or the stable code of what is wrong with it."""
    import os

    if not path:
        raise codecs.CodecError("EmptyPath")
    if len(path) > 4096:
        raise codecs.CodecError("PathTooLong")
    if not os.path.exists(path):
        raise codecs.CodecError("FileNotFound")
    if os.path.isdir(path):
        raise codecs.CodecError("PathIsDirectory")
    if not os.access(path, os.R_OK):
        raise codecs.CodecError("AccessDenied")
    return path


def inputs(spark: SparkSession, tokens: list[str], recursive: bool = False) -> DataFrame:
    """(path, content) of files, folders and globs; a file named twice comes once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(tokens).select(F.regexp_replace("path", "^file:", "").alias("path"), "content").dropDuplicates(["path"])


def write_files(files: DataFrame, path: str = "output_path", content: str = "content") -> None:
    """Writes each row's bytes to its path, in a folder that every executor sees; a file is complete or absent."""

    def write(rows) -> None:
        import os

        for r in rows:
            if r[content] is not None:
                os.makedirs(os.path.dirname(r[path]) or ".", exist_ok=True)
                with open(f"{r[path]}.part", "wb") as f:
                    f.write(bytes(r[content]))
                os.replace(f"{r[path]}.part", r[path])

    files.select(path, content).foreachPartition(write)


class Pictures:
    """Fluent operators over decoded images of any size; each is one Arrow stage, lazy until written."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def map(self, operation) -> Pictures:
        return Pictures(map_images(self.frame, operation))

    def _kernel(self, name: str, *values) -> Pictures:
        from ..functions import kernels

        return self.map(lambda px: getattr(kernels, name)(px, *values))

    def resize(self, width: int, height: int) -> Pictures:
        return self._kernel("resize", width, height)

    def crop(self, x: int, y: int, width: int, height: int) -> Pictures:
        return self._kernel("crop", x, y, width, height)

    def blur(self, radius: int) -> Pictures:
        return self._kernel("blur", radius)

    def gaussian_blur(self, sigma: float) -> Pictures:
        return self._kernel("gaussian", sigma)

    def sharpen(self) -> Pictures:
        return self._kernel("sharpen")

    def sobel(self) -> Pictures:
        return self._kernel("sobel")

    def equalise(self) -> Pictures:
        return self._kernel("equalise")

    def brightness(self, amount: int) -> Pictures:
        return self._kernel("brightness", amount)

    def contrast(self, factor: float) -> Pictures:
        return self._kernel("contrast", factor)

    def gamma(self, value: float) -> Pictures:
        return self._kernel("gamma", value)

    def white_balance(self, temperature: float, tint: float) -> Pictures:
        return self._kernel("white_balance", temperature, tint)

    def grayscale(self) -> Pictures:
        return self._kernel("grey")

    def rotate90(self) -> Pictures:
        return self._kernel("rotate90")

    def rotate(self, degrees: float) -> Pictures:
        return self._kernel("rotate", degrees)

    def flip_horizontal(self) -> Pictures:
        return self.map(lambda px: px[:, ::-1])

    def flip_vertical(self) -> Pictures:
        return self.map(lambda px: px[::-1])

    def encode(self, kind: str) -> DataFrame:
        return encode(self.frame, kind)


# --- data source -----------------------------------------------------------------------------------------------------
class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(f"{self.folder}/**/*.*", recursive=True))]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            content = f.read()
        try:
            i = codecs.decode(content)
            yield partition.path, i.width, i.height, i.format, i.data, None
        except codecs.CodecError as bad:
            yield partition.path, None, None, None, None, bad.code


class ImageFiles(DataSource):
    """format("image_files"): decoded images of a folder that every executor sees. scan() and decode() need no such folder."""

    @classmethod
    def name(cls):
        return "image_files"

    def schema(self):
        return IMAGE

    def reader(self, schema):
        return _Reader(self.options["path"])
