"""Components of masks of any size against a plain walk."""
import random

import pytest
from pyspark.sql import functions as F

from pixtables.operators import components as cc

C = F.col


def walked(pixels):
    """(image, y, x) -> first pixel of its component."""
    out = {}
    for p in sorted(pixels):
        if p in out:
            continue
        stack = [p]
        out[p] = p
        while stack:
            i, y, x = stack.pop()
            for q in ((i, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if q in pixels and q not in out:
                    out[q] = p
                    stack.append(q)
    return out


def spiral(side):
    """A winding line of one pixel with gaps of one pixel: over 2,000 pixels for a side of 64."""
    y = x = 0
    dy, dx, seen = 0, 1, {(0, 0)}
    def free(b, a):
        return 0 <= b < side and 0 <= a < side and (b, a) not in seen
    while True:
        ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if free(ny, nx) and (fy, fx) not in seen:
            y, x = ny, nx
            seen.add((y, x))
            continue
        dy, dx = dx, -dy
        if not free(y + dy, x + dx) or (y + 2 * dy, x + 2 * dx) in seen:
            return seen


@pytest.mark.parametrize("tile", [256, 8, 5])
def test_labels(spark, tile):
    rnd = random.Random(tile)
    mask = {("s", y, x) for y, x in spiral(64)}
    assert len(mask) > 2000
    mask |= {("n", y, x) for y in range(40) for x in range(23) if rnd.random() < 0.4}
    mask |= {(None, y, x) for y in range(17) for x in range(33) if (y + x) % 2}
    mask |= {("line", 7, x) for x in range(300)} | {("diag", i, 99 - i) for i in range(100)} | {("dot", 3, 3)}
    widths = {"s": 64, "n": 23, None: 33, "line": 300, "diag": 100, "dot": 9}
    rows = [(i, y, x, True, widths[i], f"{y}") for i, y, x in mask] + [("n", 50, 50, None, 23, ""), ("off", 0, 0, False, 1, "")]
    rnd.shuffle(rows)
    grid = spark.createDataFrame(rows, "image_id string, y int, x int, on boolean, w int, c string").repartition(5)
    got = cc.connected_components(grid, ["image_id"], C("on"), C("w"), {"c": C("c")}, tile)
    assert got.schema["label"].dataType.simpleString() == "int"
    ref = walked({(i or "", y, x) for i, y, x in mask})
    want = {(i, y, x, ref[i or "", y, x][1] * widths[i] + ref[i or "", y, x][2], f"{y}") for i, y, x in mask}
    # a null image is joined with nothing across tiles, like any null key of a join
    keep = (lambda r: True) if tile == 256 else (lambda r: r[0] is not None)
    assert {r for r in map(tuple, got.select("image_id", "y", "x", "label", "c").collect()) if keep(r)} == {r for r in want if keep(r)}
    assert cc.connected_components(grid.where("false"), ["image_id"], C("on"), C("w"), tile=tile).count() == 0


def test_edge_fill_of_images_of_mixed_sizes(spark):
    rows = [(1, 0, 2, 9, 5), (1, 1, 2, 9, 5), (1, 4, 2, 9, 5), (1, 3, 4, 9, 5), (2, 4, 4, 6, 5 + 1), (2, 3, 3, 6, 6), (3, 2, 2, 3, 9), (3, 1, 7, 3, 9)]
    grid = spark.createDataFrame(rows, "image_id long, y int, x int, h int, w int")
    got = cc.edge_fill(grid, ["image_id"], F.lit(True), C("h"), C("w")).collect()
    assert {tuple(r) for r in got} == {(1, 0, 2), (1, 1, 2), (1, 3, 4), (3, 2, 2)}


def test_labels_beyond_a_tile_meet_only_at_borders():
    import numpy as np

    assert cc.joined(6, np.array([5, 1, 2]), np.array([4, 2, 5])).tolist() == [0, 1, 1, 3, 1, 1]
    assert cc.tile_roots(np.array([0, 0, 1]), np.array([0, 0, 0]), np.array([0, 1, 0])).tolist() == [0, 0, 2]
