"""Shapes against values worked out by hand."""

from __future__ import annotations

import pytest

from lumengrid.operators import vector

#: A line of no length at (1, 2), one that the scale of a half shortens to none at (3, 0), and one of three pixels.
DOTS = '<svg viewBox="0 0 8 8">\n<line x1="2" y1="4" x2="2" y2="4" stroke="red"/>\n<line x1="6" y1="0" x2="7" y2="1" stroke="blue"/>\n<line x1="0" y1="6" x2="4" y2="6" stroke="green"/>\n</svg>'
PIXELS = {(1, 2): (255, 0, 0), (3, 0): (0, 0, 255), (0, 3): (0, 255, 0), (1, 3): (0, 255, 0), (2, 3): (0, 255, 0)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, DOTS)], "doc_id long, content string")


def painted(df) -> dict:
    return {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in df.collect()}


def test_lines_of_no_length_are_one_pixel_in_place(spark):
    rows = spark.createDataFrame([(k, 1, 7, float(x), float(y), float(x), float(y), 1.0, 1.0) for k, (x, y) in enumerate([(0, 0), (8, 16), (31, 31)])], "doc_id long, seq int, stroke int, x1 float, y1 float, x2 float, y2 float, sx float, sy float")
    assert {(r["doc_id"], r["px"], r["py"]) for r in vector.raster_lines(rows, 32, 32).collect()} == {(0, 0, 0), (1, 8, 16), (2, 31, 31)}


def test_render_paints_lines_of_no_length_in_place(docs):
    lines = vector.parse(docs)
    assert painted(vector.render(vector.shapes(lines.where("kind <> 'svg'")), vector.view_box(lines), 4, 4)) == PIXELS


def test_canvas_holds_lines_of_no_length_in_place(docs):
    white = {(x, y): (255, 255, 255) for x in range(4) for y in range(4)}
    assert painted(vector.rasterise(docs, 4, 4)) == white | PIXELS
