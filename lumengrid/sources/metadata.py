"""Metadata of image files: EXIF, XMP, IPTC and ICC. Byte parsers work on offsets in memory and raise CodecError."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import CodecError, tiff_fields
from .images import each, emitted

EXIF_DIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
#: Names of the EXIF tags most asked for.
EXIF_TAGS = {
    0x0100: "image_width", 0x0101: "image_height", 0x010E: "image_description", 0x010F: "make", 0x0110: "model", 0x0112: "orientation",
    0x011A: "x_resolution", 0x011B: "y_resolution", 0x0131: "software", 0x0132: "date_time", 0x013B: "artist", 0x8298: "copyright",
    0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9003: "date_time_original", 0x920A: "focal_length", 0xA002: "pixel_x", 0xA003: "pixel_y",
}
EXIF_SCHEMA = "path string, tag int, name string, number double, text string, error string"


def rational(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator.cast("double") / F.when(denominator != 0, denominator.cast("double")))


def rational_from(value: Column) -> Column:
    """numerator of a value over 10000, truncated."""
    return (value * 10000).cast("long")


def parse_exif(content: bytes, base: int = 0) -> dict[int, list]:
    """Tags of the first directory, of EXIF and of GPS; later directories win."""
    try:
        out, _, _ = tiff_fields(content, None, base)
        for pointer in (EXIF_DIRECTORY, GPS_DIRECTORY):
            if pointer in out:
                out |= tiff_fields(content, base + out[pointer][0], base)[0]
        return out
    except (struct.error, IndexError, CodecError) as bad:
        raise CodecError("InvalidExifData") from bad


def exif_of_jpeg(content: bytes) -> dict[int, list]:
    """Empty where a JPEG holds none."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
        size, = struct.unpack_from(">H", content, at + 2)
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return parse_exif(content[at + 10 : at + 2 + size])
        at += 2 + max(size, 2)
    return {}


def exif_rows(content: bytes) -> Iterator[tuple[int, str | None, float | None, str | None]]:
    return tag_rows(exif_of_jpeg(content))


def tag_rows(tags: dict[int, list]) -> Iterator[tuple[int, str | None, float | None, str | None]]:
    """(tag, name, number, text) of each tag's first value."""
    for tag, values in sorted(tags.items()):
        v = values[0] if values else None
        if isinstance(v, bytes):
            yield tag, EXIF_TAGS.get(tag), None, v.split(b"\0")[0].decode("latin-1")
        elif isinstance(v, tuple):
            yield tag, EXIF_TAGS.get(tag), v[0] / v[1] if v[1] else 0.0, None
        else:
            yield tag, EXIF_TAGS.get(tag), None if v is None else float(v), None


def exif(files: DataFrame) -> DataFrame:
    """Long table of the tags of (path, content); a file that cannot be read gives one row with its error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, *r, None) for r in exif_rows(content or b"")]
                except (CodecError, struct.error) as bad:
                    rows.append((path, None, None, None, None, getattr(bad, "code", "InvalidExifData")))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["path", "tag", "name", "number", "text", "error"])

    return files.select("path", "content").mapInArrow(read, EXIF_SCHEMA)


def exif_map(rows: DataFrame, key: str, tag: str, value: str, order: str) -> DataFrame:
    """One map for each key; of repeated tags the last by order holds."""
    last = rows.groupBy(key, tag).agg(F.max_by(value, order).alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(tag).alias("tag"), "value")))).alias("exif"))


def xmp_value(packet: Column, namespace: str, name: str) -> Column:
    """The value of an attribute namespace:name, null where it is absent."""
    pattern = rf'{namespace}:{name}="([^"]*)"'
    return F.when(F.regexp_like(packet, F.lit(pattern)), F.regexp_extract(packet, pattern, 1))


def iptc_get(entries: Column, tag: int) -> Column:
    return F.try_element_at(entries, F.lit(tag))


def iptc_set(entries: Column, tag: int, value: Column) -> Column:
    """The map with one entry put, or put anew."""
    kept = F.map_filter(entries, lambda k, v: k != tag)
    return F.map_concat(kept, F.create_map(F.lit(tag), value))


# --- ICC -------------------------------------------------------------------------------------------------------------
def _u32(content: str, at: int) -> str:
    return f"CAST(conv(hex(substring({content}, {at + 1}, 4)), 16, 10) AS BIGINT)"


def _text(content: str, at: int, n: int = 4) -> str:
    return f"decode(substring({content}, {at + 1}, {n}), 'ISO-8859-1')"


def icc_header(files: DataFrame, content: str = "content") -> DataFrame:
    """The fields of an ICC header and its tag table, by expressions over the bytes; error InvalidIccProfile where it is too short."""
    c = content
    n = f"CASE WHEN length({c}) >= 132 THEN {_u32(c, 128)} ELSE -1 END"
    rows = files.withColumn("n_tags", F.expr(n)).withColumn("error", F.expr(f"CASE WHEN n_tags < 0 OR length({c}) < 132 + n_tags * 12 THEN 'InvalidIccProfile' END"))
    tag = f"named_struct('signature', decode(substring({c}, CAST(133 + k * 12 AS INT), 4), 'ISO-8859-1'), 'offset', CAST(conv(hex(substring({c}, CAST(137 + k * 12 AS INT), 4)), 16, 10) AS BIGINT), 'size', CAST(conv(hex(substring({c}, CAST(141 + k * 12 AS INT), 4)), 16, 10) AS BIGINT))"
    fields = {"profile_size": _u32(c, 0), "version": _u32(c, 8), "device_class": _text(c, 12), "color_space": _text(c, 16), "pcs": _text(c, 20), "platform": _text(c, 40), "flags": _u32(c, 44), "manufacturer": _text(c, 48), "model": _text(c, 52), "rendering_intent": _u32(c, 64), "creator": _text(c, 80)}
    keep = [x for x in rows.columns if x not in (content, "n_tags", "error")]
    tags = f"CASE WHEN error IS NULL THEN CASE WHEN n_tags = 0 THEN array() ELSE transform(sequence(CAST(0 AS BIGINT), n_tags - 1), k -> {tag}) END END AS tags"
    return rows.selectExpr(*keep, "error", *[f"CASE WHEN error IS NULL THEN {e} END AS {k}" for k, e in fields.items()], tags)


def srgb_profile() -> bytes:
    """A minimal profile with eight empty tags."""
    head = struct.pack(">I4sI4s4s4s12s4s4sI4s4sQI12s4s44x", 132 + 96, b"lcms", 0x02100000, b"mntr", b"RGB ", b"XYZ ", b"\0" * 12, b"acsp", b"MSFT", 0, b"IEC ", b"sRGB", 0, 0, b"\0" * 12, b"lcms")
    return head[:128] + struct.pack(">I", 8) + b"\0" * 96


# --- camera files ----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class RawInfo:
    """Defaults hold where a format's header is not read."""

    format: str
    width: int = 0
    height: int = 0
    bits: int = 16
    make: str = ""
    pattern: str = "rggb"


MAKERS = {"arw": ("Sony", "rggb"), "raf": ("Fujifilm", "rggb"), "orf": ("Olympus", "rggb"), "rw2": ("Panasonic", "rggb")}


def raw_info(content: bytes) -> RawInfo:
    for name, mark in (("arw", b"SONY"), ("raf", b"FUJIFILM"), ("orf", b"OLYMP"), ("rw2", b"PANA")):
        if content.startswith(mark):
            make, pattern = MAKERS[name]
            return RawInfo(name, make=make, pattern=pattern)
    if content[:4] in (b"II*\0", b"MM\0*"):
        f, _, _ = tiff_fields(content)
        kind = "cr2" if content[8:10] == b"CR" else "dng" if 0xC612 in f else "nef"
        make = f.get(0x010F, [b""])[0]
        return RawInfo(kind, f.get(256, [0])[0], f.get(257, [0])[0], f.get(258, [16])[0], make.split(b"\0")[0].decode("latin-1") if isinstance(make, bytes) else "")
    raise CodecError("UnsupportedRawFormat")


def metadata_kind(path: Column) -> Column:
    """The reader for a path's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "exif").when(ext.isin("tif", "tiff"), "tiff").otherwise("none")


def camera_files(files: DataFrame) -> DataFrame:
    """(path, format, width, height, bits, make, pattern, error) of camera files (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, content in each(batches, "path", "content"):
                try:
                    i = raw_info(content or b"")
                    yield path, i.format, i.width, i.height, i.bits, i.make, i.pattern, None
                except (CodecError, struct.error) as bad:
                    yield path, None, None, None, None, None, None, getattr(bad, "code", "UnsupportedRawFormat")

        yield from emitted(rows(), ["path", "format", "width", "height", "bits", "make", "pattern", "error"], [pa.string(), pa.string(), *[pa.int32()] * 3, *[pa.string()] * 3])

    return files.select("path", "content").mapInArrow(read, "path string, format string, width int, height int, bits int, make string, pattern string, error string")


def extract(files: DataFrame) -> DataFrame:
    """The tags of every file that the reader for its extension finds, as exif() gives them; files of other kinds have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, kind, content in each(batches, "path", "kind", "content"):
                try:
                    tags = exif_rows(content or b"") if kind == "exif" else tag_rows(parse_exif(content or b""))
                    for row in list(tags):
                        yield path, *row, None
                except (CodecError, struct.error) as bad:
                    yield path, None, None, None, None, getattr(bad, "code", "InvalidExifData")

        yield from emitted(rows(), ["path", "tag", "name", "number", "text", "error"], [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()])

    return files.select("path", metadata_kind(F.col("path")).alias("kind"), "content").where("kind <> 'none'").mapInArrow(read, EXIF_SCHEMA)
