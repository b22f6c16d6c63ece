"""The operators as numpy kernels over one image's pixels (height, width, channels), in 32-bit arithmetic.

Batches of files of any size run these inside one Arrow stage, between decoding and encoding; the relational operators
are their specification, and tests hold the two against each other.
"""

from __future__ import annotations

import math

import numpy as np

from ..operators import filters, geometry
from .formulas import PROFILES
from ..operators.geometry import CropOutOfBounds, InvalidDimensions, check_dimensions
from ..operators.point import InvalidContrastFactor, InvalidGamma

f = np.float32


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(x, f(0), f(255)).astype(np.uint8)


def brightness(px: np.ndarray, amount: int) -> np.ndarray:
    return np.clip(np.arange(256) + amount, 0, 255).astype(np.uint8)[px]  # by a table of the 256 samples


def contrast(px: np.ndarray, factor: float) -> np.ndarray:
    if factor < 0:
        raise InvalidContrastFactor(factor)
    return _bytes((np.arange(256, dtype=f) - f(128)) * f(factor) + f(128))[px]


def white_balance(px: np.ndarray, temperature: float, tint: float) -> np.ndarray:
    t, n, one = f(temperature) / f(100), f(tint) / f(100), f(1)
    gains = [(one + t * f(0.5), one + n * f(0.3)), (one - abs(t) * f(0.1), one - n * f(0.3)), (one - t * f(0.5), one)]
    out = px.copy()
    for c, (a, b) in enumerate(gains):
        out[:, :, c] = _bytes(px[:, :, c].astype(f) * a * b)
    return out


def gamma(px: np.ndarray, value: float) -> np.ndarray:
    if value <= 0:
        raise InvalidGamma(value)
    table = (np.power((np.arange(256, dtype=f) / f(255)).astype(np.float64), float(f(1) / f(value))).astype(f) * f(255)).astype(np.uint8)
    return table[px]


def grey(px: np.ndarray, weights=(0.2126, 0.7152, 0.0722)) -> np.ndarray:
    if px.shape[2] == 1:
        return px
    r, g, b = (px[:, :, k].astype(f) for k in range(3))
    return (f(weights[0]) * r + f(weights[1]) * g + f(weights[2]) * b).astype(np.uint8)[:, :, None]


def crop(px: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    if width <= 0 or height <= 0:
        raise InvalidDimensions(f"{width} x {height}")
    if x + width > px.shape[1] or y + height > px.shape[0]:
        raise CropOutOfBounds(f"{x},{y} {width} x {height}")
    return px[y : y + height, x : x + width]


def rotate90(px: np.ndarray) -> np.ndarray:
    return np.rot90(px, -1)


def _read(px: np.ndarray, sx: np.ndarray, sy: np.ndarray, clamp: bool) -> np.ndarray:
    """Bilinear samples, some rows of the target at a time, so that what is worked on stays in the cache."""
    height, width = px.shape[:2]
    out = np.zeros((*sx.shape, px.shape[2]), np.uint8)
    planes = [np.ascontiguousarray(px[:, :, c]).ravel().astype(f) for c in range(px.shape[2])]
    step = max(1, (1 << 15) // sx.shape[1])
    for top in range(0, sx.shape[0], step):
        x, y = sx[top : top + step], sy[top : top + step]
        inside = None if clamp else (x >= 0) & (x < width - 1) & (y >= 0) & (y < height - 1)
        if inside is not None:
            x, y = np.where(inside, x, 0).astype(f), np.where(inside, y, 0).astype(f)
        x1, y1 = np.floor(x).astype(np.int32), np.floor(y).astype(np.int32)
        x2, y2 = np.minimum(x1 + 1, width - 1), np.minimum(y1 + 1, height - 1)
        dx, dy = x - x1, y - y1
        dx, dy = dx.astype(f), dy.astype(f)
        ix, iy = f(1) - dx, f(1) - dy
        y1, y2 = y1 * width, y2 * width
        taps = [y1 + x1, y1 + x2, y2 + x1, y2 + x2]
        for c, flat in enumerate(planes):
            v = flat[taps[0]] * ix * iy + flat[taps[1]] * dx * iy + flat[taps[2]] * ix * dy + flat[taps[3]] * dx * dy
            got = _bytes(v)
            out[top : top + step, :, c] = got if inside is None else np.where(inside, got, 0)
    return out


def _grid(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[0:height, 0:width]
    return x.astype(f), y.astype(f)


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    check_dimensions(width, height)
    x, y = _grid(width, height)
    return _read(px, x * (f(px.shape[1]) / f(width)), y * (f(px.shape[0]) / f(height)), True)


def rotate(px: np.ndarray, degrees: float) -> np.ndarray:
    height, width = px.shape[:2]
    to_width, to_height, cos, sin = geometry.rotated_size(width, height, degrees)
    x, y = _grid(to_width, to_height)
    fx, fy, c, s = x - f(to_width / 2), y - f(to_height / 2), f(cos), f(sin)
    return _read(px, fx * c + fy * s + f(width / 2), -fx * s + fy * c + f(height / 2), False)


def _box(px: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Means of a running window, from a running sum; 32 bits hold the sums of any side up to 65,535."""
    n = px.shape[axis]
    total = np.zeros([n + 1 if k == axis else size for k, size in enumerate(px.shape)], np.uint32)
    np.cumsum(px, axis, np.uint32, total[(slice(None),) * axis + (slice(1, None),)])
    low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
    shape = [1, 1, 1]
    shape[axis] = n
    return ((np.take(total, high, axis) - np.take(total, low, axis)) // (high - low).astype(np.uint32).reshape(shape)).astype(np.uint8)


def blur(px: np.ndarray, radius: int) -> np.ndarray:
    return px if radius == 0 else _box(_box(px, radius, 1), radius, 0)


def convolve(px: np.ndarray, kernel: list[tuple[int, int, int]], scale: int = 1) -> np.ndarray:
    """Whole-number weights; the border of the kernel's reach stays."""
    margin = max(max(abs(dx), abs(dy)) for dx, dy, _ in kernel)
    height, width = px.shape[:2]
    if height <= 2 * margin or width <= 2 * margin:
        return px
    total = sum(w * px[margin + dy : height - margin + dy, margin + dx : width - margin + dx].astype(np.int64) for dx, dy, w in kernel)
    out = px.copy()
    out[margin : height - margin, margin : width - margin] = np.clip(np.trunc(total / scale) if scale == 1 else total // scale, 0, 255)
    return out


def sharpen(px: np.ndarray) -> np.ndarray:
    return convolve(px, filters.SHARPEN)


def gaussian(px: np.ndarray, sigma: float) -> np.ndarray:
    return convolve(px, filters.gaussian_kernel(sigma), filters.ONE)


def sobel(px: np.ndarray) -> np.ndarray:
    height, width = px.shape[:2]
    if height < 3 or width < 3:
        return px
    gx, gy = (sum(w * px[1 + dy : height - 1 + dy, 1 + dx : width - 1 + dx, 0].astype(np.int64) for dx, dy, w in k) for k in (filters.SOBEL_X, filters.SOBEL_Y))
    out = px.copy()
    out[1:-1, 1:-1, 0] = np.minimum(255, np.sqrt((gx * gx + gy * gy).astype(np.float64))).astype(np.uint8)
    return out


def equalise(px: np.ndarray) -> np.ndarray:
    n = np.bincount(px.ravel(), minlength=256)
    cdf = n.cumsum()
    least, total = cdf[np.flatnonzero(n)[0]], px.size
    if total == least:
        return np.zeros_like(px)
    return _bytes((cdf - least).astype(f) * f(255) / f(total - least))[px]


def _power(x: np.ndarray, exponent: np.float32) -> np.ndarray:
    return np.power(x.astype(np.float64), float(exponent)).astype(f)


def _linear(x: np.ndarray, profile: str) -> np.ndarray:
    if profile == "linear_rgb":
        return x
    if profile != "srgb":
        return _power(np.maximum(f(0), x), f(PROFILES[profile][1]))
    return np.where(x <= f(0.04045), x / f(12.92), _power((x + f(0.055)) / f(1.055), f(2.4)))


def _companded(x: np.ndarray, profile: str) -> np.ndarray:
    if profile == "linear_rgb":
        return x
    if profile != "srgb":
        return _power(np.maximum(f(0), x), f(1) / f(PROFILES[profile][1]))
    return np.where(x <= f(0.0031308), x * f(12.92), f(1.055) * _power(x, f(1) / f(2.4)) - f(0.055))


def convert_profile(px: np.ndarray, source: str, target: str) -> np.ndarray:
    """The first three channels of one colour profile as those of another."""
    if source == target or px.shape[2] < 3:
        return px

    def times(matrix: tuple, c: list[np.ndarray]) -> list[np.ndarray]:
        return [f(matrix[3 * k]) * c[0] + f(matrix[3 * k + 1]) * c[1] + f(matrix[3 * k + 2]) * c[2] for k in range(3)]

    light = [_linear(px[:, :, k].astype(f) / f(255), source) for k in range(3)]
    back = [np.clip(c, f(0), f(1)) for c in times(PROFILES[target][4], times(PROFILES[source][3], light))]
    out = px.copy()
    for k in range(3):
        out[:, :, k] = _bytes(_companded(back[k], target) * f(255))
    return out


def aspect_height(px: np.ndarray, width: int) -> int:
    """The height that keeps the proportions at a new width."""
    ratio = f(px.shape[1]) / f(px.shape[0])
    return max(1, math.floor(float(f(width) / ratio) + 0.5))
