"""Both physical forms of the grouped statistics give the same values; order and partitioning do not matter."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixtables.operators import noise, pairs, quantiles as qt, ranks, selection, stars
from pixtables.session import IMAGE_PIXELS, declare_image_size
from pixtables.sources import fixtures as fx

C = F.col


def rows(df):
    key = lambda v: (v is None, str(type(v)), v if v is not None else 0)
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=lambda r: [key(v) for v in r])


@pytest.fixture
def spread(spark):
    """Session without a declared image size: statistics take the spread form."""
    old = spark.conf.get(IMAGE_PIXELS, None)
    spark.conf.unset(IMAGE_PIXELS)
    yield
    if old:
        spark.conf.set(IMAGE_PIXELS, old)


@pytest.fixture(scope="module")
def frame(spark):
    g = np.random.default_rng(7)
    n = 4000
    key = np.where(g.random(n) < 0.4, 1, g.integers(2, 30, n))  # one hot key
    v = np.where(g.random(n) < 0.2, 0.25, g.normal(0, 3, n))  # repeated value, both signs
    return spark.createDataFrame([(int(k), float(x), float(abs(w))) for k, x, w in zip(key, v, g.normal(1, 1, n))], "k long, v double, w double").cache()


def test_quantiles_match_numpy(frame):
    out = {r["k"]: r for r in qt.quantiles(frame, ["k"], [(C("v"), {"a": 0.0, "b": 0.35, "c": 0.5, "d": 0.999, "e": 1.0})], whole=False).collect()}
    for k, part in frame.toPandas().groupby("k"):
        for name, q in (("a", 0), ("b", 0.35), ("c", 0.5), ("d", 0.999), ("e", 1.0)):
            assert out[k][name] == pytest.approx(np.quantile(part.v, q), abs=1e-12)
        assert out[k]["n_a"] == len(part)


def test_spread_equals_whole(frame):
    spec = [(C("v"), {"p10": 0.1, "p90": 0.9}), (F.when(C("w") > 1, C("v")), {"m": 0.5})]
    assert rows(qt.quantiles(frame, ["k"], spec, whole=True)) == rows(qt.quantiles(frame, ["k"], spec, whole=False))
    assert rows(qt.robust_sigma(frame, ["k"], {"v": C("v")}, whole=True)) == rows(qt.robust_sigma(frame, ["k"], {"v": C("v")}, whole=False))
    a, b = (qt.with_quantiles(frame, ["k"], spec, whole=w).select("k", "v", "p10", "p90", "m") for w in (True, False))
    assert rows(a) == rows(b)
    a, b = (qt.with_stats(frame, ["k"], {"s": F.max("v")}, whole=w) for w in (True, False))
    assert rows(a) == rows(b)


def test_percent_rank(frame):
    from pyspark.sql import Window as W

    want = frame.select("k", "v", F.percent_rank().over(W.partitionBy("k").orderBy("v")).alias("r"))
    assert rows(want) == rows(qt.with_percent_rank(frame, ["k"], C("v"), "r").select("k", "v", "r"))


def test_weighted_quantiles(frame):
    out = {r["k"]: r for r in qt.weighted_quantiles(frame, ["k"], C("v"), C("w"), {"p50": 0.5}).collect()}
    for k, part in frame.toPandas().groupby("k"):
        part = part[part.w > 1e-6].sort_values("v")
        if len(part) < 16:
            assert out[k]["p50"] is None
            continue
        cum = part.w.cumsum().to_numpy()
        assert out[k]["p50"] == pytest.approx(part.v.to_numpy()[np.searchsorted(cum, 0.5 * cum[-1])])


def test_noise_report_in_both_forms(spark, sf):
    base = fx.px(spark, sf).cache()
    want = rows(noise.noise_report(base))
    spark.conf.unset(IMAGE_PIXELS)
    try:
        assert rows(noise.noise_report(base)) == want
    finally:
        declare_image_size(spark, 256)


def test_preservation_in_both_forms(spark, sf):
    p = fx.pair(spark, sf).withColumn("l2", F.lit(0.2126) * C("r2") + F.lit(0.7152) * C("g2") + F.lit(0.0722) * C("b2")).cache()
    want = rows(pairs.signal_preservation(p, 16))
    spark.conf.unset(IMAGE_PIXELS)
    try:
        assert rows(pairs.signal_preservation(p, 16)) == want
    finally:
        declare_image_size(spark, 256)


def test_star_selection_in_both_forms(spark):
    g = np.random.default_rng(3)
    data = [(i % 2, i, float(g.random() * 100), float(g.random() * 80), int(g.integers(0, 4)), float(g.random()), 1 + float(g.random()), float(g.random())) for i in range(80)]
    df = spark.createDataFrame(data, "image_id long, star_id long, x double, y double, quadrant int, saturation_fraction double, aspect_ratio double, compactness double").cache()
    declare_image_size(spark, 256)
    a = rows(selection.star_record_selection(df, 8))
    spark.conf.unset(IMAGE_PIXELS)
    try:
        assert rows(selection.star_record_selection(df.repartition(5), 8)) == a and len(a) == 16
    finally:
        declare_image_size(spark, 256)


def test_points_are_taken_in_one_pass_where_images_are_small(spark, monkeypatch):
    g = np.random.default_rng(5)
    data = [(i % 3, i if i % 19 else i - 3, float(g.integers(0, 9)), float(g.integers(0, 9)), int(g.integers(0, 4)), float(g.random()), 1 + float(g.random()), float(g.random())) for i in range(240)]
    data += [(4, 500 + i, float(i), None if i == 7 else 2.0, i % 4, 0.1, 1.0, 1.0) for i in range(20)] + [(5, 700, 1.0, 1.0, 0, 0.1, 1.0, 1.0)]
    df = spark.createDataFrame(data, "image_id long, star_id long, x double, y double, quadrant int, saturation_fraction double, aspect_ratio double, compactness double").cache()
    pts = df.select("image_id", F.col("star_id").alias("point_id"), "x", "y", "quadrant")
    declare_image_size(spark, 256)
    with monkeypatch.context() as m:
        m.setattr(selection, "cut", None)  # nothing is written in between
        a, b = rows(selection.star_record_selection(df, 24)), rows(selection.farthest_point_split(pts))
    spark.conf.unset(IMAGE_PIXELS)
    try:
        assert rows(selection.star_record_selection(df, 24)) == a and rows(selection.farthest_point_split(pts)) == b
    finally:
        declare_image_size(spark, 256)
    assert len(b) == 261 and {r[-1] for r in b} == {"fit", "validation", "insufficient"}
    assert selection.star_record_selection(df.where("false"), 24).count() == 0 and selection.farthest_point_split(pts.where("false")).count() == 0


def greedy(a, b, r):
    pairs_ = sorted((float(np.hypot(ax - bx, ay - by)), i, j) for i, ax, ay in a for j, bx, by in b if np.hypot(ax - bx, ay - by) <= r)
    us, ut, out = set(), set(), []
    for d, i, j in pairs_:
        if i not in us and j not in ut:
            us.add(i), ut.add(j), out.append((i, j))
    return sorted(out)


def test_crossmatch_is_the_greedy_order(spark):
    g = np.random.default_rng(11)
    # a third of all stars share one position, the rest is dense
    a = [(i, 5.0, 5.0) if i % 3 == 0 else (i, round(float(g.random() * 20), 1), round(float(g.random() * 20), 1)) for i in range(90)]
    b = [(i, 5.0, 5.0) if i % 4 == 0 else (i, round(float(g.random() * 20), 1), round(float(g.random() * 20), 1)) for i in range(80)]
    out = stars.star_crossmatch(spark.createDataFrame(a, "sid long, x double, y double").repartition(7), spark.createDataFrame(b, "tid long, x double, y double"), 1.5)
    got = sorted((r["sid"], r["tid"]) for r in out.collect())
    assert got == greedy(a, b, 1.5)


def test_sky_match_near_pole_and_wrap(spark):
    sky = spark.createDataFrame([(1, "polar", 10.0, 89.5, 60.0), (2, "wrap", 359.8, 0.0, 60.0), (3, "far", 180.0, -89.9, 120.0)], "sky_id long, name string, ra_deg double, dec_deg double, size_arcmin double")
    fr = spark.createDataFrame([(1, 190.0, 89.9), (2, 0.3, 0.2), (3, 2.0, -89.5), (4, 90.0, 40.0)], "frame_id long, ra_deg double, dec_deg double")
    got = {r["frame_id"]: r["sky_id"] for r in stars.sky_match(sky, fr).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_pareto_order_does_not_depend_on_partitions(spark, sf):
    from pixtables.plans.ranks import candidates

    c = candidates(spark, sf).cache()
    assert rows(ranks.pareto_dense_rank(c, ["image_id"])) == rows(ranks.pareto_dense_rank(c.repartition(13), ["image_id"]))


def test_sky_match_in_a_dense_catalogue(spark):
    from pixtables.operators import stars

    g = np.random.default_rng(11)
    sky = [(i, f"s{i}", float(g.random() * 360), float(g.random() * 12 + (78 if i % 2 else -6)), float(20 + i % 170)) for i in range(20_000)]
    frames = [(i if i % 40 else None, float(g.random() * 360), float(g.random() * 14 + (76 if i % 2 else -7))) for i in range(400)] + [(1000 + i, s[2], s[3]) for i, s in enumerate(sky[:20])] + [(2000, None, 1.0), (2001, 10.0, 45.0)]
    got = {r.frame_id: (r.sky_id, round(r.score, 9)) for r in stars.sky_match(
        spark.createDataFrame(sky, "sky_id long, name string, ra_deg double, dec_deg double, size_arcmin double"), spark.createDataFrame(frames, "frame_id long, ra_deg double, dec_deg double")).collect()}
    ra, dec, tol = np.radians([s[2] for s in sky]), np.radians([s[3] for s in sky]), np.maximum(1.2, np.array([s[4] for s in sky]) / 120.0 * 1.35 + 0.35)
    want = {}
    for i, a, d in frames:
        if a is None:
            continue
        a, d = np.radians(a), np.radians(d)
        dist = np.degrees(np.arccos(np.clip(np.sin(d) * np.sin(dec) + np.cos(d) * np.cos(dec) * np.cos(a - ra), -1, 1)))
        score = np.where(dist <= tol, 0.98 - dist / tol * 0.18, -1)
        k = int(np.argmax(score))
        if score[k] > 0 and (i not in want or score[k] > want[i][1]):
            want[i] = (k, score[k])
    assert got == {i: (k, round(float(s), 9)) for i, (k, s) in want.items()}
    pairs = stars._sky_pairs(spark.createDataFrame(sky, "sky_id long, name string, ra_deg double, dec_deg double, size_arcmin double").withColumn("_tol", F.lit(1.2)), spark.createDataFrame(frames, "frame_id long, ra_deg double, dec_deg double"), 0.16)
    assert pairs.count() < 10 * len(frames)
