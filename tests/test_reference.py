"""Automatic reference on fields of stars: stars, rectangles, gains and verdicts against a plain numpy reading."""
import numpy as np
import pytest

from pixtables.operators import reference as ref
from pixtables.session import declare_image_size

SIDE, R = 96, 4


def field(seed, tint=(0.03, 0.0, 0.015), gain=(1.08, 1.0, 0.95), stars=36):
    """Sky with a colour cast, a soft subject and stars of one colour; spots that are no stars."""
    rng = np.random.default_rng(seed)
    img = 0.05 + rng.normal(0, 0.0008, (SIDE, SIDE, 3)) + np.array(tint)
    yy, xx = np.mgrid[:SIDE, :SIDE]
    img += (0.08 * np.exp(-((yy - 48) ** 2 + (xx - 48) ** 2) / 60.0))[..., None]
    places = [(8 + 15 * i, 8 + 15 * j) for i in range(6) for j in range(6) if not (30 < 8 + 15 * i < 66 and 30 < 8 + 15 * j < 66)]
    for y, x in places[:stars]:
        img[y : y + 2, x : x + 2] += rng.uniform(0.3, 0.6) * np.array(gain)
    img[0:2, 40:42] += 0.5  # at the edge
    img[88, 20:28] += 0.5  # a trail
    img[78:80, 90] = 1.0  # saturated
    img[60:62, 76:78] = 1.0  # saturated
    return img


def spark_grid(spark, images):
    rows = [(i, y, x, SIDE, SIDE, *map(float, img[y, x])) for i, img in images.items() for y in range(SIDE) for x in range(SIDE)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, h int, w int, r double, g double, b double").repartition(4, "image_id").cache()


def point_rows():
    at = [(y, x) for y in (5, 25, 70, 92) for x in (3, 16, 30, 62, 77, 94)]
    return [(y * SIDE + x, "validation" if (k % 4) == 1 or k in (3, 22) else "fit", y, x) for k, (y, x) in enumerate(at)]


def lum(a):
    return a @ np.array([0.2126, 0.7152, 0.0722])


def measure(img, y, x):
    p = img[max(0, y - R) : y + R + 1, max(0, x - R) : x + R + 1]
    l, m = lum(p), np.median(p, axis=(0, 1))
    return m, (np.median(abs(np.diff(l, axis=1))) + np.median(abs(np.diff(l, axis=0)))) / 2, np.median(abs(l - np.median(l)))


def best_patch(img, points):
    m = [(*measure(img, y, x), y, x) for _, s, y, x in points if s == "fit"]
    cols = [np.array([lum(a[0]) for a in m]), np.array([a[1] for a in m]), np.array([a[2] for a in m])]
    score = sum((c - c.min()) / np.ptp(c) for c in cols)
    return m[int(np.argmin(score))]


@pytest.fixture(scope="module")
def images():
    flat = field(3, tint=(0, 0, 0))
    return {1: field(1), 2: flat, 3: field(4, tint=(0.013, 0, 0.006), stars=6)}


@pytest.fixture(scope="module")
def tables(spark, images):
    declare_image_size(spark, SIDE * SIDE)
    pts = spark.createDataFrame([(i, *p) for i in images for p in point_rows()], "image_id long, point_id long, split string, y int, x int")
    return spark_grid(spark, images), pts


def test_background_and_stars(spark, images, tables):
    pix, pts = tables
    base = ref.background_reference(pix, pts, R).cache()
    rows = {r.image_id: r for r in base.collect()}
    for i, img in images.items():
        m, _, _, y, x = best_patch(img, point_rows())
        assert (rows[i].bg_y, rows[i].bg_x) == (y, x)
        off = m - m.min()
        assert np.allclose([rows[i].off_r, rows[i].off_g, rows[i].off_b], off)
        new = np.maximum(img - off, 0)
        held = [(measure(img, y, x), measure(new, y, x)) for _, s, y, x in point_rows() if s == "validation"]
        e1, e2 = (np.array([np.ptp(h[k][0]) for h in held]) for k in (0, 1))
        assert np.allclose([rows[i].error_before, rows[i].error_after, rows[i].p90_before, rows[i].p90_after], [np.median(e1), np.median(e2), np.quantile(e1, 0.9), np.quantile(e2, 0.9)])
        assert rows[i].improved_fraction == np.mean(e2 < e1 - 1e-12) and rows[i].held_samples == len(held)
    assert rows[1].reasons == [] and "background_color_error_below_action_threshold" in rows[2].reasons
    stars, feet, why = ref.star_objects(pix, base)
    n = {r.image_id: r["count"] for r in stars.groupBy("image_id").count().collect()}
    assert n == {1: 32, 2: 32, 3: 6}
    told = {r.reason: r["count"] for r in why.where("image_id = 1").collect()}
    assert told["saturated"] == 2 and told["edge_component"] == 1 and told["non_compact_or_asymmetric"] == 1
    s = stars.where("image_id = 1 and x < 10 and y < 10").first()
    img, own = images[1], {(r.y, r.x): r.core for r in feet.where(f"image_id = 1 and star_id = {s.star_id}").collect()}
    ring = np.median([img[p] for p, core in own.items() if not core], axis=0)
    flux = sum(np.maximum(img[p] - ring, 0) for p, core in own.items() if core)
    assert (s.x, s.y, s.area, s.quadrant) == (8.5, 8.5, 4, 0) and np.allclose([s.r, s.g, s.b], flux) and len(own) == 100


def test_gains_and_methods(tables):
    pix, pts = tables
    got = {r.image_id: r for r in ref.auto_reference(pix, pts, R).collect()}
    one = got[1]
    assert (one.status, one.method, one.white_reasons) == ("accepted", "AUTO_BACKGROUND_WHITE_REGION", []) and (one.white_side, one.white_objects) == (72, 21)
    assert abs(one.gain_r * 1.08 - one.gain_g) < 0.01 and abs(one.gain_b * 0.95 - one.gain_g) < 0.01 and one.after_error < one.before_error / 5
    assert (got[2].status, got[2].method, got[2].white_reasons) == ("rejected", "PRESERVE_INPUT", None)
    assert (got[3].method, got[3].reasons) == ("AUTO_BACKGROUND_NEUTRALIZATION", []) and "insufficient_independent_star_objects" in got[3].white_reasons


def test_white_rectangle_is_the_smallest_that_holds_enough(spark):
    """Squares of all stars counted one by one, on images of different size, with stars on one place."""
    rng = np.random.default_rng(5)
    size = {1: (60, 90), 2: (128, 64), 3: (20, 20), 4: (40, 40)}
    stars = [(i, k, float(rng.uniform(0, w - 1)), float(rng.uniform(0, h - 1)), float(rng.integers(1, 9)), float(rng.integers(1, 5)), 0.0) for i, (h, w) in size.items() if i < 4 for k in range(60)]
    stars += [(1, 99, stars[0][2], stars[0][3], 2.0, 1.0, 0.0), (4, 0, 5.0, 5.0, 1.0, 1.0, 0.0)]
    s = spark.createDataFrame(stars, "image_id long, star_id long, x double, y double, flux double, compactness double, saturation_fraction double")
    z = spark.createDataFrame([(i, h, w) for i, (h, w) in size.items()], "image_id long, h int, w int")
    got = {r.image_id: (r.side, r.objects, r.x0, r.y0, r.flux) for r in ref.white_rectangle(s, z, 12).collect()}
    want = {}
    for i, (h, w) in size.items():
        own, short = [t for t in stars if t[0] == i], min(h, w)
        for side in sorted({max(32, min(short, round(short * f))) for f in ref.SIDES}):
            found = []
            for t in own:
                x0, y0 = max(0, min(w - side, round(t[2]) - side // 2)), max(0, min(h - side, round(t[3]) - side // 2))
                inside = [u for u in own if x0 <= u[2] < min(w, x0 + side) and y0 <= u[3] < min(h, y0 + side)]
                if len(inside) >= 12:
                    found.append((len(inside), sum(u[4] for u in inside), float(np.median([u[5] for u in inside])), -y0, -x0))
            if found:
                n, f, _, y, x = max(found)
                want[i] = (side, n, -x, -y, f)
                break
    assert got == want and set(got) == {1, 2, 3}


def test_edge_rows(spark):
    none = spark.createDataFrame([], "image_id long, y int, x int, h int, w int, r double, g double, b double")
    pts = spark.createDataFrame([], "image_id long, point_id long, split string, y int, x int")
    assert ref.auto_reference(none, pts, R).count() == 0
    bad = spark.createDataFrame([(1, y, x, 8, 8, float("nan") if (y, x) == (2, 2) else 0.1, 0.1, None if (y, x) == (6, 6) else 0.1) for y in range(8) for x in range(8)], none.schema)
    p = spark.createDataFrame([(1, k, "fit", *a) for k, a in enumerate([(1, 1), (6, 6), (1, 6), (0, 7)])], pts.schema)
    assert [r.point_id for r in ref.patch_measures(p, bad, 1).collect()] == [2]
