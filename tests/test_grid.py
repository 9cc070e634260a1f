"""Numpy twins of the grid operators and the fits."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixtables.operators import background, components, grid, noise
from pixtables.session import declare_image_size

C = F.col


@pytest.fixture(scope="module")
def image(spark):
    declare_image_size(spark, 256)
    a = np.random.default_rng(1).random((12, 16))
    df = spark.createDataFrame([(1, y, x, 12, 16, float(a[y, x])) for y in range(12) for x in range(16)], "image_id long, y int, x int, h int, w int, l double")
    return a, df.repartition("image_id").cache()


def blur(a, r):
    p = np.pad(a, r, mode="reflect")
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)) / (2 * r + 1) ** 2


def back(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", col).collect():
        out[r["y"], r["x"]] = r[col]
    return out


@pytest.mark.parametrize("r", [1, 2, 4, 8])
def test_box_blur(image, r):
    a, df = image
    np.testing.assert_allclose(back(grid.box_blur(df, {"l": "s"}, r), "s", a.shape), blur(a, r), atol=1e-12)


def test_morphology(image):
    a, df = image
    m = a > 0.8
    out = grid.morph(df.withColumn("m", (C("l") > 0.8).cast("int")), {"m": "d"}, 1, True)
    p = np.pad(m, 1)
    want = np.logical_or.reduce([p[i : i + 12, j : j + 16] for i in range(3) for j in range(3)])
    assert (back(out, "d", a.shape) == want).all()


def test_gradient(image):
    a, df = image
    g = np.zeros_like(a)
    g[:, 1:] += abs(a[:, 1:] - a[:, :-1])
    g[1:] += abs(a[1:] - a[:-1])
    np.testing.assert_allclose(back(grid.abs_gradient(df, "l", "g"), "g", a.shape), g, atol=1e-12)


def test_mad_sigma(image):
    a, df = image
    s = noise.robust_sigma(df, ["image_id"], {"l": C("l")}).first()
    assert s["l_sigma"] == pytest.approx(1.4826 * np.median(abs(a - np.median(a))))


def test_plane_fit(image):
    a, df = image
    y, x = np.mgrid[:12, :16]
    v = 0.3 + 0.02 * x - 0.01 * y + 0.001 * a
    df = df.withColumn("v", F.lit(0.3) + F.lit(0.02) * C("x") - F.lit(0.01) * C("y") + F.lit(0.001) * C("l"))
    out = background.plane_fit(df, ["image_id"], C("x"), C("y"), C("v")).first()
    design = np.column_stack([np.ones(a.size), x.ravel(), y.ravel()])
    c, *_ = np.linalg.lstsq(design, v.ravel(), rcond=None)
    res = v.ravel() - design @ c
    cov = (res**2).sum() / (a.size - 3) * np.linalg.pinv(design.T @ design)
    assert (out["level"], out["slope_x"], out["slope_y"]) == pytest.approx(tuple(c), rel=1e-7)
    assert out["rms"] == pytest.approx(np.sqrt((res**2).mean()), rel=1e-6)
    assert out["sigma"] == pytest.approx(np.hypot(c[1], c[2]) / np.sqrt(cov[1, 1] + cov[2, 2]), rel=1e-6)


def test_spiral_component(spark):
    """A long winding component is one label, a diagonal touch connects, a gap does not."""
    pic = ["#########", "........#", "#######.#", "#.....#.#", "#.###.#.#", "#.#...#.#", "#.#####.#", "#.......#", "#########", ".........", "#.#......", ".#......#"]
    data = [(1, y, x, pic[y][x] == "#") for y in range(12) for x in range(9)]
    df = spark.createDataFrame(data, "image_id long, y int, x int, on boolean").repartition("image_id")
    a = components.areas(components.connected_components(df, ["image_id"], C("on"), 9, tile=4), ["image_id"])
    assert sorted(r["area"] for r in a.collect()) == [1, 3, sum(row.count("#") for row in pic[:9])]


@pytest.mark.parametrize("size", [256, None])
def test_repeated_blur_equals_as_many_box_blurs(spark, size):
    """Full, gapped, one-line and null-holding images, in the form of arrays (256) and of windows."""
    a = np.random.default_rng(5).random((9, 7))
    rows = [(1, y, x, 9, 7, float(a[y, x])) for y in range(9) for x in range(7)]
    rows += [(2, y, x, 9, 7, float(a[y, x])) for y in range(9) for x in range(7) if (y * 7 + x) % 5]
    rows += [(3, y, x, 9, 7, None if (y + x) % 4 == 0 else float(a[y, x])) for y in range(9) for x in range(7)]
    rows += [(4, 0, x, 1, 7, float(a[0, x])) for x in range(7)] + [(None, 0, 0, 1, 1, 0.5)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, h int, w int, l double")
    declare_image_size(spark, size or 10**9)
    got = grid.repeated_blur(df, "l", {1: "a", 3: "b"})
    assert got.columns == [*df.columns, "a", "b"]
    want, cur = df, "l"
    for name in ("a", "_2", "b"):
        want, cur = grid.box_blur(want, {cur: name}, 1), name
    key = lambda r: (r.image_id or 0, r.y, r.x)
    got, want = (sorted(t.select("image_id", "y", "x", "l", "a", "b").collect(), key=key) for t in (got, want.select(*got.columns)))
    declare_image_size(spark, 256)
    assert got == want and len(got) == len(rows)


def test_blurred_measures_sort_an_image_a_few_times(spark):
    """Before, each pass over a small image took two windows, and each window sorted all rows of a task."""
    from pixtables.operators import pairs

    declare_image_size(spark, 256)
    df = spark.range(256).select(F.lit(1).cast("long").alias("image_id"), F.floor(C("id") / 16).cast("int").alias("y"), (C("id") % 16).cast("int").alias("x"), F.lit(16).alias("h"), F.lit(16).alias("w"), (C("id") % 37 / 37).alias("l"))
    g = df.select("*", C("l").alias("r"), C("l").alias("g"), C("l").alias("b"))
    windows = lambda t: t._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(pairs.target_local(g.select("*", *[C(c).alias(f"{c}2") for c in "rgbl"]))) <= 1
    # the plan reads the grid in two branches, each with the chroma pass and the quantile of the sky
    assert windows(background.background_quality(g, 4)) <= 8


def test_tables_of_several_branches_are_computed_once(spark):
    """Every branch of a measure reads the kept table; before, each one repeated all passes below it."""
    from pixtables.operators import pairs

    declare_image_size(spark, 256)
    df = spark.range(256).select(F.lit(1).cast("long").alias("image_id"), F.floor(C("id") / 16).cast("int").alias("y"), (C("id") % 16).cast("int").alias("x"), F.lit(16).alias("h"), F.lit(16).alias("w"), (C("id") % 37 / 37).alias("l"))
    g = df.select("*", C("l").alias("r"), C("l").alias("g"), C("l").alias("b"), F.lit(1.0).alias("subject"), F.lit(1.0).alias("background"))
    two = g.select("*", *[C(c).alias(f"{c}2") for c in "rgbl"])
    points = g.where("y % 4 = 2 and x % 4 = 2").select("image_id", (C("y") * 16 + C("x")).alias("point_id"), F.lit("fit").alias("split"), "y", "x")
    patches = background.patch_stats(background.patch_join(points, g.select("image_id", "y", "x", "l"), 2), 2)
    for out in (background.pattern_noise(g), pairs.reference_metrics(g), pairs.colour_report(two, ["subject"]), background.model_compare(patches, 16)):
        plan = out._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan
