"""Field rotation on images of real size: wedges in four corners, one kind of noise alone, one noisy band."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixtables.operators import coverage as cov

H, W_ = 288, 384


def image(seed, wedge=None, grey=None):
    rng = np.random.default_rng(seed)
    a = 0.02 + rng.normal(0, 0.001, (H, W_, 3))
    for mask, channels in ((wedge, 3), (grey, 1)):
        if mask is not None:
            a[mask] += rng.normal(0, 0.006, (int(mask.sum()), channels))
    return np.clip(a, 0, 1)


@pytest.fixture(scope="module")
def pixels(spark):
    yy, xx = np.mgrid[:H, :W_]
    wedges = (xx + yy < 96) | (W_ - 1 - xx + yy < 96) | (xx + H - 1 - yy < 96) | (W_ - 1 - xx + H - 1 - yy < 96)
    band = yy < 48
    made = {1: image(1, wedges), 2: image(2, grey=wedges), 3: image(3, band), 4: image(4), 5: image(5)[:100], 6: np.zeros((H, W_, 3))}
    import pandas as pd

    frames = []
    for i, a in made.items():
        y, x = np.mgrid[: a.shape[0], : a.shape[1]]
        frames.append(pd.DataFrame({"image_id": i, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), **{c: a[:, :, k].ravel() for k, c in enumerate("rgb")}}))
    df = spark.createDataFrame(pd.concat(frames))
    return df.withColumn("l", 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")).repartition("image_id"), wedges


def test_crops(pixels):
    df, wedges = pixels
    got = {r.image_id: r for r in cov.rotation_crop(cov.coverage_tiles(df)).collect()}
    assert {i: r.reason for i, r in got.items()} == {
        1: "edge_connected_field_rotation_confirmed", 2: "no_significant_edge_connected_coverage_anomaly", 3: "edge_connected_anomaly_lacks_corner_wedge_geometry",
        4: "no_significant_edge_connected_coverage_anomaly", 5: "image_too_small_for_coverage_grid", 6: "coverage_reference_unavailable"}
    r = got[1]
    assert r.accepted and r.corners == 4 and r.sides == 4 and r.connected_tiles > 0.1 * 12 * 16
    assert not wedges[r.y : r.y + r.height, r.x : r.x + r.width].any() and r.kept > 0.3
    assert (r.x % 2, r.y % 2, r.width % 2, r.height % 2) == (0, 0, 0, 0)
    assert all(v.x is None and v.kept is None for i, v in got.items() if i != 1)


def test_tiles_end_at_the_last_pixel(spark):
    df = spark.createDataFrame([(1, y, x) for y in range(200) for x in (0, 249)], "image_id long, y int, x int")
    assert cov.tile_sizes(df).first()[1:] == (200, 250, 8, 10)
