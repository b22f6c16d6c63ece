"""File codecs over bytes, in numpy and the standard library: what sequential bit streams need and SQL cannot say.

decode(bytes) gives an Image; malformed bytes raise CodecError with a stable code, never anything else. The codecs follow
the file formats' specifications: rows of BMP are padded and bottom-up, PNG is inflated and every filter undone, LZW
tables grow as the standard says, TIFF fields honour their type.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

LARGEST, MAX_BYTES = 65535, 100 << 20
BYTES_PER_PIXEL = {"rgb": 3, "rgba": 4, "yuv": 3, "hsv": 3, "cmyk": 4, "grayscale": 1}


class CodecError(ValueError):
    """code is one of the stable error names."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Image:
    width: int
    height: int
    format: str
    data: bytes

    @property
    def pixels(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8).reshape(self.height, self.width, BYTES_PER_PIXEL[self.format])

    @staticmethod
    def of(pixels: np.ndarray) -> Image:
        kind = {1: "grayscale", 3: "rgb", 4: "rgba"}[pixels.shape[2]]
        return Image(pixels.shape[1], pixels.shape[0], kind, np.ascontiguousarray(pixels, np.uint8).tobytes())


@dataclass
class Animation:
    frames: list[Image]
    delays: list[int] = field(default_factory=list)
    loops: int = 0


#: Fixed signatures: format, offset, bytes.
SIGNATURES = [("png", 0, b"\x89PNG\r\n\x1a\n"), ("jpeg", 0, b"\xff\xd8"), ("webp", 8, b"WEBP"), ("tiff", 0, b"II*\x00"), ("tiff", 0, b"MM\x00*"), ("gif", 0, b"GIF87a"), ("gif", 0, b"GIF89a"), ("avif", 4, b"ftypavif"), ("avif", 4, b"ftypavis"), ("svg", 0, b"<?xml"), ("svg", 0, b"<svg"), ("bmp", 0, b"BM")]


def sniff(content: bytes) -> str:
    if not content:
        raise CodecError("EmptyFile")
    if len(content) > MAX_BYTES:
        raise CodecError("FileTooLarge")
    for name, at, mark in SIGNATURES:
        if content[at : at + len(mark)] == mark and (name != "webp" or content[:4] == b"RIFF"):
            return name
    raise CodecError("UnknownFormat")


def check(width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise CodecError("InvalidDimensions")
    if width > LARGEST or height > LARGEST:
        raise CodecError("DimensionsTooLarge")


# --- BMP -------------------------------------------------------------------------------------------------------------
def decode_bmp(content: bytes) -> Image:
    if content[:2] != b"BM":
        raise CodecError("NotBMP")
    start, = struct.unpack_from("<I", content, 10)
    width, height, _, bits = struct.unpack_from("<iiHH", content, 18)
    if bits not in (24, 32):
        raise CodecError("UnsupportedBPP")
    check(width, abs(height))
    row = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, row * abs(height), start).reshape(abs(height), row)
    px = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return Image.of(px[::-1] if height > 0 else px)


def encode_bmp(image: Image) -> bytes:
    px = image.pixels
    if image.format not in ("rgb", "grayscale"):
        raise CodecError("UnsupportedFormatConversion")
    px = np.repeat(px, 3, 2) if px.shape[2] == 1 else px
    row = (image.width * 3 + 3) // 4 * 4
    rows = np.zeros((image.height, row), np.uint8)
    rows[:, : image.width * 3] = px[::-1, :, ::-1].reshape(image.height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, image.width, image.height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


# --- PNG -------------------------------------------------------------------------------------------------------------
def _unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.int32)
    for y, row in enumerate(rows):
        kind, line = int(row[0]), row[1:].astype(np.int32)
        if kind == 1:
            for c in range(bpp):
                line[c::bpp] = np.cumsum(line[c::bpp]) & 255
        elif kind == 2:
            line = line + above & 255
        elif kind in (3, 4):
            for i in range(len(line)):
                a, b, c = (line[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[i] = line[i] + guess & 255
        elif kind:
            raise CodecError("UnsupportedPNGFormat")
        out[y], above = line, line
    return out


def decode_png(content: bytes) -> Image:
    at, data, head = 8, [], None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise CodecError("UnsupportedPNGFormat")
    if not data:
        raise CodecError("NoPNGImageData")
    width, height, bpp = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    check(width, height)
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) < height * (width * bpp + 1):
        raise CodecError("NoPNGImageData")
    rows = raw[: height * (width * bpp + 1)].reshape(height, width * bpp + 1)
    return Image.of(_unfilter(rows, bpp).reshape(height, width, bpp))


def encode_png(image: Image) -> bytes:
    px = image.pixels
    kind = {1: 0, 3: 2, 4: 6}[px.shape[2]]
    rows = np.concatenate([np.zeros((image.height, 1), np.uint8), px.reshape(image.height, -1)], 1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.width, image.height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


# --- TIFF ------------------------------------------------------------------------------------------------------------
_TIFF_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}


def tiff_fields(content: bytes, at: int | None = None, base: int = 0) -> tuple[dict[int, list], str, int]:
    """(tag -> values, byte order, offset of the next directory) of a TIFF directory; rationals are pairs, text is bytes."""
    order = {b"II": "<", b"MM": ">"}.get(content[base : base + 2])
    if order is None:
        raise CodecError("InvalidTIFF")
    at = base + struct.unpack_from(order + "I", content, base + 4)[0] if at is None else at
    count, = struct.unpack_from(order + "H", content, at)
    out = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
        if kind not in _TIFF_TYPES or n > len(content):
            continue
        code, size = _TIFF_TYPES[kind]
        place = at + 10 + 12 * k
        if size * n > 4:
            place = base + struct.unpack_from(order + "I", content, place)[0]
        if place + size * n > len(content):
            continue
        if code == "s":
            out[tag] = [content[place : place + n]]
        else:
            flat = struct.unpack_from(order + code * n, content, place)
            out[tag] = list(zip(flat[::2], flat[1::2], strict=True)) if len(code) == 2 else list(flat)
    following = at + 2 + 12 * count
    return out, order, struct.unpack_from(order + "I", content, following)[0] if following + 4 <= len(content) else 0


def decode_tiff(content: bytes) -> Image:
    f, _, _ = tiff_fields(content)
    if 256 not in f or 257 not in f or 273 not in f:
        raise CodecError("InvalidTIFF")
    width, height, spp = f[256][0], f[257][0], f.get(277, [1])[0]
    if f.get(259, [1])[0] != 1:
        raise CodecError("UnsupportedTIFFCompression")
    if set(f.get(258, [8])) != {8} or spp not in (1, 3, 4):
        raise CodecError("InvalidTIFF")
    check(width, height)
    strips = f[273]
    sizes = f.get(279, [width * height * spp])
    data = b"".join(content[a : a + n] for a, n in zip(strips, sizes, strict=False))
    if len(data) < width * height * spp:
        raise CodecError("InvalidTIFF")
    return Image.of(np.frombuffer(data, np.uint8, width * height * spp).reshape(height, width, spp))


# --- GIF -------------------------------------------------------------------------------------------------------------
def _lzw_decode(data: bytes, least: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, width, bits, held, last = [], least + 1, 0, 0, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & (1 << width) - 1
            held >>= width
            bits -= width
            if code == clear:
                del table[end + 1 :]
                width, last = least + 1, None
                continue
            if code == end:
                return b"".join(out)
            if last is None:
                entry = table[code] if code < len(table) else None
            elif code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                entry = None
            if entry is None:
                raise CodecError("InvalidGIF")
            out.append(entry)
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return b"".join(out)


def _lzw_encode(data: bytes, least: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    out, held, bits, width = bytearray(), 0, 0, least + 1
    table = {bytes([i]): i for i in range(clear)}
    following = end + 1

    def put(code: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(clear)
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        if following < 4096:
            table[longer] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        else:
            put(clear)
            table = {bytes([i]): i for i in range(clear)}
            following, width = end + 1, least + 1
        word = data[k : k + 1]
    if word:
        put(table[word])
    put(end)
    if bits:
        out.append(held & 255)
    return bytes(out)


def _blocks(content: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(content) and content[at]:
        parts.append(content[at + 1 : at + 1 + content[at]])
        at += 1 + content[at]
    return b"".join(parts), at + 1


def decode_gif_animation(content: bytes) -> Animation:
    if content[:3] != b"GIF" or len(content) < 13:
        raise CodecError("InvalidGIF")
    flags, at = content[10], 13
    common = None
    if flags & 128:
        n = 3 << (flags & 7) + 1
        common = np.frombuffer(content, np.uint8, n, at).reshape(-1, 3)
        at += n
    out, delay = Animation([], [], 1), 10
    while at < len(content):
        mark = content[at]
        if mark == 0x21:
            label = content[at + 1]
            body, after = _blocks(content, at + 2)
            if label == 0xF9 and len(body) >= 4:
                delay = struct.unpack_from("<H", body, 1)[0] or 10
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                out.loops = struct.unpack_from("<H", body, 12)[0]
            at = after
        elif mark == 0x2C:
            _, _, width, height, local = struct.unpack_from("<HHHHB", content, at + 1)
            at += 10
            palette = common
            if local & 128:
                n = 3 << (local & 7) + 1
                palette = np.frombuffer(content, np.uint8, n, at).reshape(-1, 3)
                at += n
            least = content[at]
            data, at = _blocks(content, at + 1)
            check(width, height)
            index = np.frombuffer(_lzw_decode(data, least), np.uint8)
            if palette is None or len(index) < width * height or index[: width * height].max(initial=0) >= len(palette):
                raise CodecError("InvalidGIF")
            px = index[: width * height].reshape(height, width)
            if local & 64:
                order = np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                px = px[np.argsort(order)]
            out.frames.append(Image.of(palette[px]))
            out.delays.append(delay)
        else:
            break
    if not out.frames:
        raise CodecError("NoGIFFrames")
    return out


def decode_gif(content: bytes) -> Image:
    return decode_gif_animation(content).frames[0]


def encode_gif(animation: Animation) -> bytes:
    """Grey levels by BT.601."""
    if not animation.frames:
        raise CodecError("NoFramesToSave")
    first = animation.frames[0]
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", first.width, first.height, 0xF7, 0, 0))
    out += np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    if animation.loops != 1:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", animation.loops) + b"\x00"
    for k, frame in enumerate(animation.frames):
        px = frame.pixels.astype(np.float32)
        grey = px[:, :, 0] if px.shape[2] == 1 else px[:, :, 0] * np.float32(0.299) + px[:, :, 1] * np.float32(0.587) + px[:, :, 2] * np.float32(0.114)
        delay = animation.delays[k] if k < len(animation.delays) else 10
        out += b"\x21\xf9\x04\x00" + struct.pack("<H", delay) + b"\x00\x00"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, frame.width, frame.height, 0) + b"\x08"
        data = _lzw_encode(grey.astype(np.uint8).tobytes(), 8)
        for at in range(0, len(data), 255):
            out += bytes([len(data[at : at + 255])]) + data[at : at + 255]
        out += b"\x00"
    return bytes(out + b"\x3b")


# --- containers of which only headers are read -----------------------------------------------------------------------
def webp_header(content: bytes) -> tuple[int, int, bool]:
    """(width, height, lossless)."""
    if sniff(content) != "webp":
        raise CodecError("InvalidFileFormat")
    at = 12
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if kind == b"VP8 ":
            w, h = struct.unpack_from("<HH", content, at + 14)
            return w & 0x3FFF, h & 0x3FFF, False
        if kind == b"VP8L":
            bits, = struct.unpack_from("<I", content, at + 9)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, True
        at += 8 + size + (size & 1)
    raise CodecError("InvalidFileFormat")


def avif_header(content: bytes) -> tuple[int, int, int, str]:
    """(width, height, bit depth, chroma): from the ispe and av1C boxes; 512 x 512, 8 bits and 420 where there are none."""
    found = [512, 512, 8, "420"]

    def walk(start: int, stop: int) -> None:
        at = start
        while at + 8 <= stop:
            size, kind = struct.unpack_from(">I4s", content, at)
            size = size or stop - at
            if size < 8 or at + size > stop:
                return
            if kind == b"meta":
                walk(at + 12, at + size)
            elif kind in (b"iprp", b"ipco"):
                walk(at + 8, at + size)
            elif kind == b"ispe" and size >= 20:
                found[:2] = struct.unpack_from(">II", content, at + 12)
            elif kind == b"av1C" and size >= 12:
                b = content[at + 10]
                found[2] = (12 if b & 32 else 10) if b & 64 else 8
                found[3] = "400" if b & 16 else {12: "420", 8: "422", 0: "444"}.get(b & 12, "420")
            at += size

    walk(0, len(content))
    return tuple(found)


def luma_gradient(width: int, height: int) -> Image:
    """The documented stand-in for streams that are not decoded: luma rises along the diagonal."""
    y, x = np.mgrid[0:height, 0:width]
    return Image.of(((x + y) * 255 // (width + height)).astype(np.uint8)[:, :, None].repeat(3, 2))


def encode_webp(image: Image) -> bytes:
    """A lossless stream of literals: every channel has a flat code of eight bits, an opaque alpha a code of none."""
    px = image.pixels
    px = np.repeat(px, 3, 2) if px.shape[2] == 1 else px
    bits: list[np.ndarray] = []

    def put(value: int, n: int) -> None:
        bits.append(np.array([value >> k & 1 for k in range(n)], np.uint8))

    def lengths(used: dict[int, int]) -> None:
        """The code of code lengths; its symbols come in the format's order, of which the first twelve hold 0 and 8."""
        put(0, 1)
        put(12 - 4, 4)
        for symbol in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8):
            put(used.get(symbol, 0), 3)
        put(0, 1)

    alpha = px.shape[2] == 4
    for value, n in ((0x2F, 8), (image.width - 1, 14), (image.height - 1, 14), (int(alpha), 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        put(value, n)
    lengths({0: 1, 8: 1})  # green: 256 literals of 8 bits, 24 unused copies
    bits.append(np.repeat(np.array([1, 0], np.uint8), [256, 24]))
    for _ in range(2 + alpha):
        lengths({8: 1})  # the only symbol takes no bits
    if not alpha:
        for value, n in ((1, 1), (0, 1), (1, 1), (255, 8)):
            put(value, n)
    for value in (1, 0, 0, 0):  # distance: one symbol, 0
        put(value, 1)
    order = [1, 0, 2, 3] if alpha else [1, 0, 2]
    bits.append(np.unpackbits(np.ascontiguousarray(px[:, :, order])))  # codes stand highest bit first
    stream = np.packbits(np.concatenate(bits), bitorder="little").tobytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


from .jpeg import decode_jpeg, encode_jpeg  # noqa: E402

DECODERS = {"bmp": decode_bmp, "png": decode_png, "jpeg": decode_jpeg, "tiff": decode_tiff, "gif": decode_gif}
ENCODERS = {"bmp": encode_bmp, "png": encode_png, "jpeg": encode_jpeg, "webp": encode_webp}


def decode(content: bytes, synthetic: bool = False) -> Image:
    """An image of file bytes; CodecError for whatever is wrong with them."""
    kind = sniff(content)
    try:
        if kind in DECODERS:
            return DECODERS[kind](content)
        if kind in ("webp", "avif") and synthetic:
            head = webp_header(content) if kind == "webp" else avif_header(content)
            check(head[0], head[1])
            return luma_gradient(head[0], head[1])
    except CodecError:
        raise
    except (struct.error, ValueError, IndexError, KeyError, zlib.error, OverflowError) as bad:
        raise CodecError("InvalidFileFormat") from bad
    raise CodecError("UnsupportedFormat")


def check_size(image: Image, size: int) -> None:
    """Whether so many bytes are those of an image of its size."""
    if size != image.width * image.height * BYTES_PER_PIXEL[image.format]:
        raise CodecError("InvalidDimensions")


def encode(image: Image, kind: str) -> bytes:
    check(image.width, image.height)
    check_size(image, len(image.data))
    if kind not in ENCODERS:
        raise CodecError("UnsupportedFormat")
    return ENCODERS[kind](image)
