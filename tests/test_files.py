"""Codecs, metadata, scripts and streams."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lumengrid.plans import steps
from lumengrid.sources import codecs, images, metadata
from lumengrid.sources.codecs import CodecError, Image
from lumengrid.streaming import ingest

RNG = np.random.default_rng(9)


def picture(width: int, height: int, channels: int) -> Image:
    return Image.of(RNG.integers(0, 256, (height, width, channels)).astype(np.uint8))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.sampled_from([1, 3]), st.sampled_from(["bmp", "png"]))
def test_lossless_round_trip(width, height, channels, kind):
    image = picture(width, height, channels)
    back = codecs.decode(codecs.encode(image, kind))
    expected = image.pixels if back.format == image.format else image.pixels.repeat(3, 2)
    assert np.array_equal(back.pixels, expected)


def test_png_with_alpha():
    image = picture(5, 4, 4)
    assert codecs.decode(codecs.encode(image, "png")).data == image.data


def test_png_filters():
    """Rows filtered by every kind come back as they were."""
    import zlib

    px = RNG.integers(0, 256, (5, 6, 3)).astype(np.int32)
    rows, above = [], np.zeros(18, np.int32)
    for kind in range(5):
        line = px[kind].ravel()
        left = np.concatenate([np.zeros(3, np.int32), line[:-3]])
        corner = np.concatenate([np.zeros(3, np.int32), above[:-3]])
        guess = left + above - corner
        nearest = np.where((abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - above) <= abs(guess - corner), above, corner))
        rows.append(bytes([kind]) + ((line - [0, left, above, (left + above) // 2, nearest][kind]) % 256).astype(np.uint8).tobytes())
        above = line
    head = struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert np.array_equal(codecs.decode(content).pixels, px)


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_webp_stream(channels):
    """Header, code tables and literals, read by the format's rules for such streams."""
    image = picture(13, 6, channels)
    content = codecs.encode(image, "webp")
    assert codecs.webp_header(content) == (13, 6, True)
    bits = np.unpackbits(np.frombuffer(content, np.uint8, offset=20), bitorder="little")
    alpha = channels == 4
    table = 1 + 4 + 36 + 1
    at = 8 + 14 + 14 + 1 + 3 + 3 + table + 280 + table * (2 + alpha) + (0 if alpha else 11) + 4
    n = 4 if alpha else 3
    px = np.packbits(bits[at : at + 8 * n * 13 * 6]).reshape(6, 13, n)
    px = px[:, :, [1, 0, 2, 3] if alpha else [1, 0, 2]]
    assert np.array_equal(px, image.pixels if channels > 1 else image.pixels.repeat(3, 2))


def test_jpeg_round_trip():
    y, x = np.mgrid[0:8, 0:8]
    image = Image.of(np.stack([x * 255 // 7, y * 255 // 7, np.full_like(x, 128)], 2))
    back = codecs.decode(codecs.encode(image, "jpeg"))
    assert np.abs(back.pixels.astype(int) - image.pixels).max() <= 20


def test_gif_round_trip():
    frames = [picture(31, 17, 1), picture(31, 17, 1)]
    back = codecs.decode_gif_animation(codecs.encode_gif(codecs.Animation(frames, [7, 9], 3)))
    assert [f.pixels[:, :, 0].tolist() for f in back.frames] == [f.pixels[:, :, 0].tolist() for f in frames]
    assert back.delays == [7, 9] and back.loops == 3


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff(order):
    px = RNG.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    fields = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 3, 200), (259, 3, 1, 1), (273, 4, 1, 300), (277, 3, 1, 3), (279, 4, 1, 36)]
    body = b"".join(struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", v, 0) if kind == 3 and n == 1 else struct.pack(order + "I", v)) for tag, kind, n, v in fields)
    content = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", len(fields)) + body + b"\0" * 4
    content = content.ljust(200, b"\0") + struct.pack(order + "HHH", 8, 8, 8)
    content = content.ljust(300, b"\0") + px.tobytes()
    assert np.array_equal(codecs.decode(content).pixels, px)


def test_headers():
    webp = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8L" + struct.pack("<I", 10) + b"\x2f" + struct.pack("<I", 99 | 49 << 14) + b"\0" * 8
    assert codecs.webp_header(webp) == (100, 50, True)
    box = lambda k, b: struct.pack(">I4s", 8 + len(b), k) + b
    avif = box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", box(b"ispe", b"\0" * 4 + struct.pack(">II", 640, 480)) + box(b"av1C", bytes([0x81, 0, 0x4C, 0])))))
    assert codecs.avif_header(avif) == (640, 480, 10, "420")
    assert codecs.decode(avif, synthetic=True).width == 640
    with pytest.raises(CodecError, match="UnsupportedFormat"):
        codecs.decode(avif)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["bmp", "png", "jpeg", "gif"]), st.integers(0, 400), st.integers(0, 255), st.integers(1, 400))
def test_malformed_bytes_only_raise_codec_errors(kind, at, value, keep):
    image = picture(9, 7, 3)
    content = bytearray(codecs.encode_gif(codecs.Animation([image])) if kind == "gif" else codecs.encode(image, kind))
    content[at % len(content)] = value
    for broken in (bytes(content), bytes(content[:keep])):
        try:
            codecs.decode(broken)
        except CodecError as bad:
            assert bad.code


def test_errors_become_rows(spark):
    files = spark.createDataFrame([("a", bytearray(b"")), ("b", bytearray(b"hello")), ("c", None), ("d", bytearray(codecs.encode(picture(2, 2, 3), "png")))], "path string, content binary")
    got = {r["path"]: r["error"] for r in images.decode(files).collect()}
    assert got == {"a": "EmptyFile", "b": "UnknownFormat", "c": "EmptyFile", "d": None}


def test_exif(spark):
    tags = [(0x010F, 2, 6, 100), (0x829A, 5, 1, 120), (0x0112, 3, 1, 6)]
    body = b"".join(struct.pack("<HHII", *t) for t in tags)
    tiff = (b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + body + b"\0" * 4).ljust(100, b"\0") + b"Maker\0"
    tiff = tiff.ljust(120, b"\0") + struct.pack("<II", 1, 125)
    app1 = b"Exif\0\0" + tiff
    content = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"
    rows = {r["name"]: (r["number"], r["text"]) for r in metadata.exif(spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"\xff\xd8"))], "path string, content binary")).collect()}
    assert rows == {"make": (None, "Maker"), "exposure_time": (1 / 125, None), "orientation": (6.0, None)}


def test_raw_info():
    assert metadata.raw_info(b"FUJIFILMCCD").make == "Fujifilm"
    with pytest.raises(CodecError, match="UnsupportedRawFormat"):
        metadata.raw_info(b"nothing")


def test_pipeline_fails_before_it_runs(spark):
    with pytest.raises(steps.InvalidPipelineStep):
        steps.parse_pipeline(["blur:1", "sparkle:9"])
    assert steps.parse_pipeline(["convert:grayscale", "--format=PNG", "write:/x.png"]) == [steps.Step("grayscale"), steps.Step("format", ("png",)), steps.Step("save", ("/x.png",))]
    assert steps.parse_pipeline(["flip:h", "flip:h", "rotate:90"]) == [steps.Step("rotate", (90.0,))]


def test_pipeline_kernels_equal_relational(spark):
    from test_operators import array, frame

    script = ["crop:1,1,6,5", "resize:4x4", "brightness:12", "rotate:90", "blur:1"]
    px = RNG.integers(0, 256, (8, 9)).astype(np.uint8)
    relational = steps.Frame(frame(spark, px), 9, 8).run(script)
    assert np.array_equal(array(relational.px), steps.run_kernels(px[:, :, None], steps.parse_pipeline(script)))


def test_batch_needs_output_and_operation(spark):
    with pytest.raises(steps.InvalidBatchSpec, match="NoOutputDirectory"):
        steps.BatchJob().set_operation("blur", radius=1).build()
    with pytest.raises(steps.InvalidBatchSpec, match="NoOperation"):
        steps.BatchJob().set_output("/out").build()
    with pytest.raises(steps.InvalidBatchSpec, match="radius"):
        steps.BatchJob().set_operation("blur")


def test_files_on_disk(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.png").write_bytes(codecs.encode(picture(3 + k, 2, 3), "png"))
    (tmp_path / "broken.bmp").write_bytes(b"BM")
    got = images.decode(images.scan(spark, str(tmp_path)))
    assert {(r["width"], r["error"]) for r in got.collect()} == {(3, None), (4, None), (5, None), (None, "InvalidFileFormat")}
    spark.dataSource.register(images.ImageFiles)
    assert spark.read.format("image_files").option("path", str(tmp_path)).load().where("error IS NULL").count() == 3
    stream = ingest.image_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("arrived").count() == 4


def test_command_line(spark, tmp_path, capsys):
    from lumengrid.__main__ import main

    source = tmp_path / "in.bmp"
    source.write_bytes(codecs.encode(picture(4, 4, 3), "bmp"))
    assert main(["pipeline", str(source), "resize:2x2", "format:bmp", f"save:{tmp_path}/small.bmp"]) == 0
    assert codecs.decode((tmp_path / "small.bmp").read_bytes()).width == 2
    assert main(["convert", str(source), str(tmp_path / "out.png")]) == 0
    assert codecs.sniff((tmp_path / "out.png").read_bytes()) == "png"
    script = tmp_path / "jobs.txt"
    script.write_text(f"# jobs\njob operation=blur radius=1 input={source} output={tmp_path}/done\njob operation=sparkle input=/a output=/b\n")
    assert main(["batch", str(script)]) == 1
    assert (tmp_path / "done" / "in.bmp").exists()
    assert main(["pipeline", str(source), "sparkle:1"]) == 2
    assert main(["convert", str(source), "-"]) == 2
    out = capsys.readouterr().err
    assert "InvalidPipelineStep" in out and "MissingFormatForStdout" in out and "InvalidBatchSpec" in out


def test_path_errors(tmp_path):
    for path, code in (("", "EmptyPath"), ("x" * 5000, "PathTooLong"), (str(tmp_path / "none.png"), "FileNotFound"), (str(tmp_path), "PathIsDirectory")):
        with pytest.raises(CodecError, match=code):
            images.check_path(path)


def test_fluent_images(spark):
    made = spark.createDataFrame([("a", bytearray(codecs.encode(picture(6, 4, 3), "png"))), ("b", bytearray(b"?"))], "path string, content binary")
    done = images.Pictures(images.decode(made)).resize(3, 2).blur(1).grayscale().brightness(5).encode("png")
    rows = {r["path"]: r for r in done.collect()}
    small = codecs.decode(bytes(rows["a"]["content"]))
    assert (small.width, small.height, small.format) == (3, 2, "grayscale") and rows["b"]["error"] == "UnknownFormat"


def test_pixels_round_trip(spark):
    px = RNG.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    made = spark.createDataFrame([(1, 5, 4, "rgb", bytearray(px.tobytes()))], "image_id long, width int, height int, format string, data binary")
    back = images.assemble_pixels(images.explode_pixels(made)).first()
    assert bytes(back["data"]) == px.tobytes() and (back["width"], back["height"]) == (5, 4)


def test_jpeg_restart_intervals():
    """The same scan with a marker after each unit, where predictions begin anew, decodes to the same pixels."""
    from lumengrid.sources import jpeg

    image = picture(8, 8, 1)
    whole = codecs.encode(image, "jpeg")
    scan = whole.index(b"\xff\xda")
    head, stream = whole[:scan], whole[scan + 2 + struct.unpack_from(">H", whole, scan + 2)[0] : -2]
    size = head.index(b"\xff\xc0") + 5
    two = head[:size] + struct.pack(">HH", 8, 16) + head[size + 4 :] + b"\xff\xdd\x00\x04\x00\x01" + whole[scan : scan + 2 + struct.unpack_from(">H", whole, scan + 2)[0]] + stream + b"\xff\xd0" + stream + b"\xff\xd9"
    back = codecs.decode(two).pixels
    assert back.shape == (8, 16, 1) and np.array_equal(back[:, :8], codecs.decode(whole).pixels) and np.array_equal(back[:, 8:], back[:, :8])
    assert len(jpeg.LUMA_AC) == sum(jpeg.LUMA_AC_LENGTHS) == len(set(jpeg.CHROMA_AC)) == 162


def test_small_files_of_many_pixels(spark):
    """Files of few bytes and many pixels leave in batches of bounded size."""
    content = bytearray(codecs.encode(Image.of(np.zeros((2000, 2000, 3), np.uint8)), "png"))
    files = spark.range(40).selectExpr("CAST(id AS STRING) AS path").repartition(1).withColumn("content", F.lit(content))
    assert images.decode(files).where("error IS NULL").selectExpr("sum(length(data)) AS n").first()["n"] == 40 * 12_000_000
    job = steps.BatchJob(root="/in").set_output("/out").set_operation("resize", width=4, height=4)
    assert job.run(files).where("status = 'processed'").count() == 40
