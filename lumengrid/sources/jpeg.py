"""Baseline JPEG: Huffman streams in Python, transforms of all blocks at once in numpy."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the standard: the zigzag, and the quantisation and Huffman tables of its annex.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
LUMA_QUANT = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
CHROMA_QUANT = np.array([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32)
LUMA_DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
CHROMA_DC_LENGTHS = [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
LUMA_AC_LENGTHS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
LUMA_AC = bytes.fromhex(
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a "
    "83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa"
)
CHROMA_AC_LENGTHS = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
CHROMA_AC = bytes.fromhex(
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a "
    "82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa"
)
QUALITY = 75
#: The cosine transform: row u, column x.
DCT = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _error(code: str):
    from .codecs import CodecError

    return CodecError(code)


def huffman(lengths: list[int], values: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> value, codes counted up through the lengths."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = values[k]
            code += 1
            k += 1
        code <<= 1
    return out


def by_bits(codes: dict[tuple[int, int], int]) -> list[int]:
    """The next 16 bits -> length and value of the code they begin with, as length << 8 | value; 0 where there is none."""
    out = [0] * 65536
    for (n, code), value in codes.items():
        first = code << 16 - n
        out[first : first + (1 << 16 - n)] = [n << 8 | value] * (1 << 16 - n)
    return out


class _Bits:
    """Bits of an entropy-coded segment, highest first, stuffing taken out."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if self.at > len(self.data) + 64:
                raise _error("InvalidJPEG")
            self.at += 1
            self.held = (self.held << 8 | byte) & 0xFFFFFFFFFF
            self.n += 8
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def symbol(self, table: list[int]) -> int:
        found = table[self.take(16)]
        if not found:
            raise _error("InvalidHuffmanCode")
        self.n += 16 - (found >> 8)  # what the code does not use is put back
        return found & 255

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >= 1 << n - 1 else v - (1 << n) + 1


def decode_jpeg(content: bytes):
    from .codecs import Image, check

    if content[:2] != b"\xff\xd8":
        raise _error("InvalidJPEG")
    at, quant, tables, frame, interval = 2, {}, {}, None, 0
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise _error("InvalidJPEG")
        mark = content[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size, = struct.unpack_from(">H", content, at + 2)
        body = content[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif mark == 0xC4:
            while body:
                lengths = list(body[1:17])
                n = sum(lengths)
                tables[body[0]] = by_bits(huffman(lengths, list(body[17 : 17 + n])))
                body = body[17 + n :]
        elif mark == 0xC2:
            raise _error("UnsupportedProgressiveJPEG")
        elif mark == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            check(width, height)
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif mark == 0xDD:
            interval, = struct.unpack_from(">H", body)
        elif mark == 0xDA:
            if frame is None:
                raise _error("InvalidJPEG")
            n = body[0]
            scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(n)}
            stop = at + 2 + size
            parts, begin = [], stop
            while stop + 1 < len(content):
                if content[stop] == 0xFF and content[stop + 1] not in (0, 0xFF):
                    if not 0xD0 <= content[stop + 1] <= 0xD7:
                        break
                    parts.append(content[begin:stop])  # up to a restart marker
                    begin = stop = stop + 2
                    continue
                stop += 1
            parts.append(content[begin:stop])
            planes = _scan([p.replace(b"\xff\x00", b"\xff") for p in parts], interval, frame, scan, quant, tables, width, height)
            return Image.of(_colour(planes, frame, width, height))
        at += 2 + size
    raise _error("InvalidJPEG")


def _scan(parts: list[bytes], interval: int, frame: list, scan: dict, quant: dict, tables: dict, width: int, height: int) -> list[np.ndarray]:
    """The planes of a scan; every `interval` units, if not 0, the next part begins and the predictions anew."""
    bits, hmax, vmax = _Bits(parts[0]), max(f[1] for f in frame), max(f[2] for f in frame)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    blocks = [np.zeros((down * f[2], across * f[1], 64)) for f in frame]
    last = [0] * len(frame)
    for my in range(down):
        for mx in range(across):
            unit = my * across + mx
            if interval and unit and unit % interval == 0:
                if unit // interval >= len(parts):
                    raise _error("InvalidJPEG")
                bits, last = _Bits(parts[unit // interval]), [0] * len(frame)
            for k, (name, h, v, _) in enumerate(frame):
                dc, ac = tables[scan[name] >> 4], tables[16 | scan[name] & 15]
                for y in range(v):
                    for x in range(h):
                        block = blocks[k][my * v + y, mx * h + x]
                        last[k] += bits.signed(bits.symbol(dc))
                        block[0] = last[k]
                        i = 1
                        while i < 64:
                            symbol = bits.symbol(ac)
                            if not symbol & 15:
                                if symbol != 0xF0:
                                    break
                                i += 16
                                continue
                            i += symbol >> 4
                            if i > 63:
                                raise _error("InvalidJPEG")
                            block[i] = bits.signed(symbol & 15)
                            i += 1
    planes = []
    for (_, _, _, q), b in zip(frame, blocks, strict=True):
        natural = np.zeros_like(b)
        natural[:, :, ZIGZAG] = b * quant[q]
        square = natural.reshape(*b.shape[:2], 8, 8)
        samples = np.clip(np.rint(DCT.T @ square @ DCT) + 128, 0, 255)
        planes.append(samples.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8))
    return planes


def _colour(planes: list[np.ndarray], frame: list, width: int, height: int) -> np.ndarray:
    hmax, vmax = max(f[1] for f in frame), max(f[2] for f in frame)
    y, x = np.arange(height)[:, None], np.arange(width)[None, :]
    full = [p[y * f[2] // vmax, x * f[1] // hmax].astype(np.float32) for p, f in zip(planes, frame, strict=True)]
    if len(full) == 1:
        return full[0][:, :, None]
    luma, cb, cr = full[0], full[1] - np.float32(128), full[2] - np.float32(128)
    rgb = [luma + np.float32(1.402) * cr, luma - np.float32(0.344136) * cb - np.float32(0.714136) * cr, luma + np.float32(1.772) * cb]
    return np.clip(np.stack(rgb, 2), 0, 255).astype(np.uint8)


def quality_table(table: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((table * scale + 50) // 100, 1, 255)


def encode_jpeg(image) -> bytes:
    """4:4:4, or grey; alpha is dropped; edges are repeated to whole blocks."""
    px = image.pixels[:, :, :3].astype(np.float64)
    if px.shape[2] == 1:
        planes = [px[:, :, 0]]
    else:
        r, g, b = px[:, :, 0], px[:, :, 1], px[:, :, 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    quants = [quality_table(LUMA_QUANT), quality_table(CHROMA_QUANT)]
    kinds = [(LUMA_DC_LENGTHS, bytes(range(12)), LUMA_AC_LENGTHS, LUMA_AC), (CHROMA_DC_LENGTHS, bytes(range(12)), CHROMA_AC_LENGTHS, CHROMA_AC)][: len(planes)]
    codes = [[{v: k for k, v in huffman(lengths, list(values)).items()} for lengths, values in (kind[:2], kind[2:])] for kind in kinds]
    coded = []
    for k, plane in enumerate(planes):
        p = np.pad(plane, ((0, -plane.shape[0] % 8), (0, -plane.shape[1] % 8)), "edge") - 128
        square = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        flat = (DCT @ square @ DCT.T).reshape(-1, 64) / quants[min(k, 1)]
        coded.append(np.rint(flat)[:, ZIGZAG].astype(np.int64))
    word: list[str] = []

    def put(table: dict, symbol: int, value: int, size: int) -> None:
        n, code = table[symbol]
        word.append(format(code, f"0{n}b"))
        if size:
            word.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))

    last = [0] * len(coded)
    for i in range(len(coded[0])):
        for k, blocks in enumerate(coded):
            block, (dc, ac) = blocks[i], codes[min(k, 1)]
            difference, last[k] = int(block[0]) - last[k], int(block[0])
            size = abs(difference).bit_length()
            put(dc, size, difference, size)
            run = 0
            filled = np.flatnonzero(block[1:])
            for at in range(1, (int(filled[-1]) if len(filled) else -1) + 2):
                v = int(block[at])
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(ac, 0xF0, 0, 0)
                    run -= 16
                size = abs(v).bit_length()
                put(ac, run << 4 | size, v, size)
                run = 0
            if not len(filled) or filled[-1] < 62:
                put(ac, 0, 0, 0)
    text = "".join(word)
    text += "1" * (-len(text) % 8)
    stream = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")

    def segment(mark: int, body: bytes) -> bytes:
        return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body

    n = len(coded)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    for k in range(min(n, 2)):
        out += segment(0xDB, bytes([k]) + quants[k][ZIGZAG].astype(np.uint8).tobytes())
    out += segment(0xC0, struct.pack(">BHHB", 8, image.height, image.width, n) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(n)))
    for k, (dc_lengths, dc_values, ac_lengths, ac_values) in enumerate(kinds):
        out += segment(0xC4, bytes([k]) + bytes(dc_lengths) + dc_values) + segment(0xC4, bytes([16 | k]) + bytes(ac_lengths) + ac_values)
    out += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(n)) + b"\x00\x3f\x00")
    return out + stream + b"\xff\xd9"
