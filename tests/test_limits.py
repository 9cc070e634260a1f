"""Nothing is cut at a fixed size: long headers, many cards, many candidates, long objects."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pixtables.operators import evidence, ranks, selection
from pixtables.sources import headers
from pixtables.streaming import events


def card(text):
    return text.ljust(80).encode("latin-1")


def test_header_over_128_blocks_and_bytes_that_are_no_text(spark):
    head = card("SIMPLE  =                    T") + card("HISTORY 20° dark") + b"".join(card(f"HISTORY step {i}") for i in range(6000)) + card("NAXIS1  =                 1000") + card("END")
    body = head + b"\xff\x00" * 500 + card("NAXIS1  =                    7")
    given = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b"")), (3, None), (4, bytearray(card("A       = 1")))], "frame_id long, content binary")
    cards = headers.header_cards(given)
    assert {r.frame_id: r.n for r in cards.groupBy("frame_id").agg(F.count("*").alias("n")).collect()} == {1: 6003, 4: 1}
    assert cards.where("frame_id = 1 and pos = 6002").first().key == "NAXIS1" and cards.where("pos = 1").first().card.strip() == "HISTORY 20° dark"
    text = headers.history_text(cards).where("frame_id = 1").first().text
    assert "step 5999" in text
    told = {r.frame_id: (r.status, r.width, r.fields) for r in headers.header_summary(given).collect()}
    assert told == {1: ("ready", 1000, 2), 2: ("unavailable", None, 0), 3: ("unavailable", None, 0), 4: ("unavailable", None, 1)}


def test_seventy_candidates_and_repeated_entries(spark):
    rows = [(1, i, "c%d" % i, 0, False, *[float(100 - i)] * 7, 0.0) for i in range(70)] + [(1, 69, "twin", 0, False, *[31.0] * 7, 1.0)]
    c = spark.createDataFrame(rows, "image_id long, chain_index int, label string, tier int, hard_rejected boolean, " + ", ".join(f"{x} double" for x in ranks.PARETO) + ", score double")
    got = {(r.chain_index, r.label): (r.position, r.pareto_front) for r in ranks.pareto_dense_rank(c, ["image_id"]).collect()}
    assert len(got) == 71 and got[(69, "c69")] == (1, True) and got[(69, "twin")] == (2, True) and got[(0, "c0")] == (71, False)


def lines(spark, texts):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(1, t0 + timedelta(seconds=i), i, t) for i, t in enumerate(texts)], "run_id long, ts timestamp, event_id long, line string")


def test_braces_in_strings_and_long_objects(spark):
    long = '{"a": "' + "y" * 100_000 + '"}'
    texts = [
        events.PREVIEW + '{"a": "x}",', 'log: "b": "\\"{"}', events.PREVIEW + long, events.PREVIEW + '{"s": "open', 'log: }", "t": 1', "log: }", "log: after",
        events.PREVIEW + '{"lost": 1,', "other", "log: }", events.PREVIEW + '{"e": "\\', 'log: "}"}', events.PREVIEW + "no object",
    ]
    got = [r.payload for r in events.json_reassembly(lines(spark, texts)).orderBy("ts").collect()]
    assert got == ['{"a": "x}","b": "\\"{"}', long, '{"s": "open}", "t": 1}', '{"e": "\\"}"}']
    pending, seen = "", []
    for piece in ('{"a": "x}",', '"b": "\\"{"}'):
        pending += piece
        seen.append(events._closed(pending))
    assert seen == [False, True]


def test_instruments_of_the_reference_table(spark):
    want = {
        "ZWO Seestar S30 Pro": (160.0, 2.9), "Seestar S30": (150.0, 2.9), "S50": (250.0, 2.9), "s50 tele": (250.0, 2.9), "my s50": None, "DWARF 2": (100.0, 1.45),
        "dwarf mini": (150.0, 2.9), "DwarfLab Dwarf-III": (150.0, 2.0), "Vespera": None, "Seestar S50 wide angle": None, "": None, None: None,
    }
    names = list(want)
    f = spark.createDataFrame([(i, n, 250.0) for i, n in enumerate(names)], "frame_id long, identity string, focal double")
    got = {names[r.frame_id]: (r.focal_mm, r.pixel_um) for r in evidence.device_profile_match(f).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_star_selection_takes_the_farthest_next(spark):
    # seeds by shape: stars 0 and 3; then the star farthest from both in units of the extent
    rows = [(1, i, x, y, q, s, 1.0, 1.0) for i, (x, y, q, s) in enumerate([(0.0, 0.0, 0, 0.0), (1.0, 0.0, 0, 0.5), (4.0, 0.0, 0, 0.5), (10.0, 10.0, 1, 0.0), (9.0, 10.0, 1, 0.5), (10.0, 2.0, 1, 0.5), (0.0, 9.0, 0, 0.5)])]
    rows += [(2, i, float(i), 0.0, 0, 0.0, 1.0, 1.0) for i in range(3)]
    s = spark.createDataFrame(rows, "image_id long, star_id long, x double, y double, quadrant int, saturation_fraction double, aspect_ratio double, compactness double")
    got = sorted((r.image_id, r.star_id) for r in selection.star_record_selection(s, 4).collect())
    assert got == [(1, 0), (1, 3), (1, 5), (1, 6), (2, 0), (2, 1), (2, 2)]


def test_split_of_over_256_points(spark):
    pts = [(1, i, float(i % 20), float(i // 20), (i % 20 >= 10) + 2 * (i // 20 >= 10)) for i in range(20)] + [(2, i, float(i % 20), float(i // 20), (i % 20 >= 10) + 2 * (i // 20 >= 10)) for i in range(300)]
    got = selection.farthest_point_split(spark.createDataFrame(pts, "image_id long, point_id long, x double, y double, quadrant int"), ratio=0.02)
    n = {(r.image_id, r.split): r.n for r in got.groupBy("image_id", "split").agg(F.count("*").alias("n")).collect()}
    assert n == {(1, "insufficient"): 20, (2, "validation"): 6, (2, "fit"): 294}


def test_stack_keeps_targets_apart(spark):
    from pixtables.operators import pairs

    rows = [(t, f, y, x, 10.0 * t + f + 0.1 * ((x * 7 + y * 3 + f) % 5)) for t in (1, 2) for f in range(6) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(rows, "target long, frame_id long, y int, x int, v double")
    both = pairs.sigma_rejection_stack(df, target="target")
    for t in (1, 2):
        one = pairs.sigma_rejection_stack(df.where(F.col("target") == t).drop("target"))
        key = lambda d: sorted((r.y, r.x, round(r.value, 9), r.frames, r.rejected) for r in d.collect())
        assert key(both.where(F.col("target") == t)) == key(one)


def test_correlation_of_a_side_that_does_not_vary(spark):
    from pixtables.operators.quantiles import correlation

    rows = [(1, float(i), 2.0 * i) for i in range(5)] + [(2, 3.0, float(i)) for i in range(5)] + [(3, 1.0, 2.0), (4, None, 1.0), (5, 1.0, 5.0), (5, 2.0, None), (5, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, a double, b double")
    got = {r.g: r.c for r in df.groupBy("g").agg(correlation(F.col("a"), F.col("b")).alias("c")).collect()}
    assert abs(got.pop(1) - 1.0) < 1e-12 and abs(got.pop(5) + 1.0) < 1e-12 and got == {2: None, 3: None, 4: None}


def test_slope_of_held_out_points_that_are_all_alike(spark):
    points = [(1, i, "fit", i // 4, i % 4, 0.5, 0.01 * (i % 4)) for i in range(16)] + [(1, 20 + i, "validation", i, 2, 0.5, 0.02) for i in range(4)]
    patches = spark.createDataFrame(points, "image_id long, point_id long, split string, py int, px int, rg double, bg double")
    pix = spark.createDataFrame([(1, 0, 0, 0.5, 0.4, 0.3)], "image_id long, y int, x int, r double, g double, b double")
    got = selection.opponent_slope(patches, pix, 16).first()
    assert (got.r, got.rg_selected, got.bg_selected) == (0.5, False, False)


def test_slope_of_fit_points_on_one_line(spark):
    """Before, points that span no plane, and groups without any value, were a division by zero."""
    from pixtables.operators import background

    held = [("validation", i, 3 * i) for i in range(4)]
    fits = {1: [("fit", 2, 2)], 2: [("fit", 2, 2), ("fit", 2, 10)], 3: [("fit", 2, 2), ("fit", 6, 2), ("fit", 10, 2)], 4: [("fit", i, j) for i in (2, 6, 10) for j in (2, 7, 10)]}
    points = [(m, i, s, y, x, 0.5 + 0.02 * x, 0.01 * y) for m, given in fits.items() for i, (s, y, x) in enumerate(given + held)]
    patches = spark.createDataFrame(points, "image_id long, point_id long, split string, py int, px int, rg double, bg double")
    pix = spark.createDataFrame([(m, 0, 15, 0.5, 0.4, 0.3) for m in fits], "image_id long, y int, x int, r double, g double, b double")
    got = {r.image_id: (round(r.r, 6), r.rg_selected, r.bg_selected) for r in selection.opponent_slope(patches, pix, 16).collect()}
    assert {got.pop(m) for m in (1, 2, 3)} == {(0.5, False, False)} and got[4][1:] == (True, True)
    rows = [(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, None), (2, 1.0, 0.0, None), (2, 0.0, 1.0, None)]
    fit = background.plane_fit(spark.createDataFrame(rows, "image_id long, x double, y double, v double"), ["image_id"], F.col("x"), F.col("y"), F.col("v"))
    assert {r.image_id: (r.samples, r.rank, r.slope_x, r.sigma, r.rms, r.unit_x) for r in fit.collect()} == {1: (1, 2, None, None, 0.0, None), 2: (0, 3, None, None, None, None)}


def test_tables_of_pixels_are_not_broadcast_by_their_file_size(spark, sf):
    from pixtables import session
    from pixtables.operators import background
    from pixtables.sources import fixtures as fx

    many = spark.range(1, 3 * session._TASK_ROWS)
    assert (session.tasks_for(many), session.tasks_for(many.limit(0)), session.tasks_for(many.limit(9))) == (3, 1, 1)
    cells = background.patch_join(fx.points(spark, sf), fx.dlum(spark, sf), 3)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    session.configure(spark)
    assert "BroadcastExchange" not in plan and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_scans_make_tasks_for_their_rows(spark, tmp_path):
    """Before, files were read in as many tasks as there are cores, whatever their rows."""
    from pixtables import session
    from pixtables.sources import fixtures

    d = str(tmp_path)
    spark.range(400_000).select((F.col("id") % 50).alias("l_suppkey"), F.col("id").alias("l_orderkey"), (F.col("id") % 9).alias("l_partkey"), *[F.col("id").cast("double").alias(f"l_{c}") for c in ("quantity", "extendedprice", "discount")]).repartition(40).write.parquet(f"{d}/lineitem.parquet")
    cores = spark.sparkContext.defaultParallelism
    try:
        session.scan_tasks(spark, 40)
        assert spark.read.parquet(f"{d}/lineitem.parquet").rdd.getNumPartitions() == 40 > cores
        fixtures.px(spark, d)
        assert spark.conf.get("spark.sql.files.minPartitionNum") == str(max(cores, 3))
    finally:
        session.configure(spark)
    assert spark.read.parquet(f"{d}/lineitem.parquet").rdd.getNumPartitions() < 40


def test_safe_background_samples_broadcast_nothing(spark, sf, monkeypatch):
    """Before, each of some thirty joins with one row an image was sent through the driver."""
    from pixtables import session
    from pixtables.operators import sampling
    from pixtables.plans import QUERIES

    sizes = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")

    def met(pix, **limits):
        raise LookupError(*[spark.conf.get(k) for k in sizes])

    monkeypatch.setattr(sampling, "safe_background_samples", met)
    try:
        with pytest.raises(LookupError) as e:
            QUERIES["safe_background_samples"](spark, sf)
        assert e.value.args == ("-1", "-1")
    finally:
        session.configure(spark)
    assert "-1" not in [spark.conf.get(k) for k in sizes]
