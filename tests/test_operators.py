"""Operators against values worked out by hand, numpy kernels, and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumengrid.functions import kernels
from lumengrid.operators import filters, geometry, point, stats
from lumengrid.operators.geometry import CropOutOfBounds, DimensionsTooLarge, InvalidDimensions


def frame(spark, px: np.ndarray, image_id: int = 0):
    """A pixel relation of an array (height, width[, 3])."""
    rows = [(image_id, x, y, *map(int, np.atleast_1d(px[y, x]))) for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, " + ("v int" if px.ndim == 2 else "r int, g int, b int"))


def array(df, channels=("v",)) -> np.ndarray:
    rows = df.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1, len(channels)), -1)
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in channels]
    return out


RNG = np.random.default_rng(4)
GREY = RNG.integers(0, 256, (9, 11)).astype(np.uint8)
COLOUR = RNG.integers(0, 256, (7, 6, 3)).astype(np.uint8)


def test_brightness_by_hand(spark):
    assert array(point.adjust_brightness(frame(spark, np.array([[100, 200], [50, 250]])), 30)).ravel().tolist() == [130, 230, 80, 255]


def test_contrast_by_hand(spark):
    got = array(point.adjust_contrast(frame(spark, np.array([[128, 178], [78, 200]])), 1.5)).ravel().tolist()
    assert got[0] == 128 and got[1] > 178 and got[2] < 78


def test_contrast_refuses_negative(spark):
    with pytest.raises(point.InvalidContrastFactor):
        point.adjust_contrast(frame(spark, GREY), -1)


def test_grey_by_hand(spark):
    got = array(point.to_grey(frame(spark, np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [128, 128, 128]]])))).ravel().tolist()
    assert got[0] > 50 and got[1] > 180 and got[2] < 30 and got[3] == 128


def test_flips_by_hand(spark):
    assert array(geometry.flip_horizontal(frame(spark, np.array([[1, 2, 3]])), 3)).ravel().tolist() == [3, 2, 1]
    assert array(geometry.flip_vertical(frame(spark, np.array([[1], [2], [3]])), 3)).ravel().tolist() == [3, 2, 1]


def test_sizes_are_checked(spark):
    px = frame(spark, GREY)
    with pytest.raises(InvalidDimensions):
        geometry.resize(px, 11, 9, 0, 8)
    with pytest.raises(DimensionsTooLarge):
        geometry.resize(px, 11, 9, 100000, 100000)
    with pytest.raises(CropOutOfBounds):
        geometry.crop(px, 9, 5, 5, 2, 11, 9)
    with pytest.raises(InvalidDimensions):
        geometry.crop(px, 5, 5, 0, 2, 11, 9)


@pytest.mark.parametrize(
    ("relational", "kernel"),
    [
        (lambda p: point.adjust_contrast(p, 1.7), lambda a: kernels.contrast(a, 1.7)),
        (lambda p: point.gamma_correction(p, 2.2), lambda a: kernels.gamma(a, 2.2)),
        (lambda p: geometry.resize(p, 11, 9, 7, 13), lambda a: kernels.resize(a, 7, 13)),
        (lambda p: geometry.rotate(p, 11, 9, 33.0), lambda a: kernels.rotate(a, 33.0)),
        (lambda p: geometry.rotate90(p, 9), kernels.rotate90),
        (lambda p: geometry.crop(p, 3, 2, 5, 6, 11, 9), lambda a: kernels.crop(a, 3, 2, 5, 6)),
        (lambda p: filters.box_blur(p, 2), lambda a: kernels.blur(a, 2)),
        (lambda p: filters.sharpen(p, 11, 9), kernels.sharpen),
        (lambda p: filters.sobel(p, 11, 9), kernels.sobel),
        (lambda p: filters.gaussian_blur(p, 0.9, 11, 9), lambda a: kernels.gaussian(a, 0.9)),
        (stats.equalise, kernels.equalise),
    ],
)
def test_relational_form_equals_kernel(spark, relational, kernel):
    assert np.array_equal(array(relational(frame(spark, GREY))), kernel(GREY[:, :, None]))


def test_white_balance_equals_kernel(spark):
    assert np.array_equal(array(point.white_balance(frame(spark, COLOUR), 40.0, -20.0), "rgb"), kernels.white_balance(COLOUR, 40.0, -20.0))


@pytest.mark.parametrize(("source", "target"), [("srgb", "display_p3"), ("srgb", "linear_rgb"), ("adobe_rgb_1998", "srgb"), ("srgb", "rec2020")])
def test_profile_equals_kernel(spark, source, target):
    assert np.array_equal(array(point.convert_profile(frame(spark, COLOUR), source, target), "rgb"), kernels.convert_profile(COLOUR, source, target))


def test_constant_image_equalises_to_zero(spark):
    assert set(array(stats.equalise(frame(spark, np.full((3, 3), 7)))).ravel()) == {0}


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_kernel_invariants(width, height, seed):
    px = np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)
    turned = px
    for _ in range(4):
        turned = kernels.rotate90(turned)
    assert np.array_equal(turned, px)
    assert np.array_equal(kernels.resize(px, width, height), px)
    assert np.array_equal(kernels.blur(np.full_like(px, 9), 2), np.full_like(px, 9))
    assert np.array_equal(kernels.brightness(kernels.brightness(px, 0), 0), px)
