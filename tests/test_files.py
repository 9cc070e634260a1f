"""Real files: header blocks, listings, documents, sinks."""
import json
import os

from pyspark.sql import functions as F

from pixtables.sources import files as op, headers

C = F.col


def card(text):
    return text.ljust(80).encode()


def test_headers_and_listing(spark, tmp_path):
    cards = [card("SIMPLE  =                    T / ok"), card("BITPIX  =                   16"), card("NAXIS1  =                 1024"), card("NAXIS2  =                  768"),
             card("OBJECT  = 'O''Neil / x '    / named"), card("EXPTIME =               1.5D+01"), card("HISTORY  Stacked twice"), card("END"), card("FILTER  = 'after END'")]
    for rel, parts in {"night/lights/a.fit": cards, "Light_b.fits": cards[:4], "darks/Light_c.fit": cards, ".x/Light_d.fit": cards, "process/Light_e.fit": cards, "flat_f.fit": cards, "notes.txt": cards}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        body = b"".join(parts)
        p.write_bytes(body.ljust(-(-len(body) // 2880) * 2880))
    found = op.frame_scan(op.list_files(spark, str(tmp_path)))
    assert sorted(r["path"] for r in found.collect()) == ["Light_b.fits", "night/lights/a.fit"]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "night")).select(F.lit(1).alias("frame_id"), "content")
    cards_ = headers.header_cards(raw)
    typed = {r["key"]: r for r in headers.typed_cards(cards_).collect()}
    assert typed["OBJECT"]["v_str"] == "O'Neil / x" and typed["EXPTIME"]["v_num"] == 15.0 and typed["SIMPLE"]["v_bool"] is True and "FILTER" not in typed
    s = headers.header_summary(raw).first()
    assert (s["width"], s["height"], s["dtype"], s["exposure"], s["filter"]) == (1024, 768, "uint16", 15.0, None)
    assert "history stacked twice" in headers.history_text(cards_).first()["text"]
    # no END: all cards up to the end of the file
    raw = spark.read.format("binaryFile").load(str(tmp_path / "Light_b.fits")).select(F.lit(1).alias("frame_id"), "content")
    assert headers.typed_cards(headers.header_cards(raw)).count() == 4


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": "v1", "n": 3}))
    (tmp_path / "b.json").write_text('{"schema": "v1", ')
    (tmp_path / "c.json").write_text("[1, 2]")
    got = op.read_json_documents(spark, str(tmp_path), "schema string, n int").collect()
    assert [r["doc"]["n"] for r in got] == [3]


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"name": "M 31", "aliases": ["NGC 224"], "type": "galaxy", "ra_deg": 10.7, "dec_deg": 41.3, "size_arcmin": [190, 60], "features": [], "policy": "p"}]))
    r = op.read_catalog(spark, str(tmp_path / "c.json")).first()
    assert r["name"] == "M 31" and r["size_arcmin"] == [190.0, 60.0]


def test_metric_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.25), (2, 1, 0.75)], "run_id long, stage int, m double")
    op.append_metrics(op.metric_records(df, ["stage"]), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted(json.loads(r["value"])["seq"] for r in back) == [1, 1, 2] and sorted(os.listdir(tmp_path / "out"))[-1] == "run_id=2"


def test_probe(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000100000001010020000")
    f = spark.createDataFrame([(1, "a.png", bytearray(png)), (1, "b.fit", bytearray(b"SIMPLE  = T")), (1, "c", bytearray(b"zz"))], "run_id long, path string, content binary")
    got = {r["path"]: (r["format"], r["bit_depth"], r["colour_type"]) for r in op.container_probe(f).collect()}
    assert got == {"a.png": ("png", 16, 2), "b.fit": ("fit", None, None), "c": ("unknown", None, None)}


def test_header_source_stops_at_end(spark, tmp_path):
    """A large frame costs as much as a small one: bytes behind END are not read."""
    cards = [card("SIMPLE  =                    T"), card("NAXIS1  =                 1024"), card("NAXIS2  =                   16"), card("OBJECT  = 'M  31'")] + [card(f"HISTORY {i}") for i in range(90)] + [card("END")]
    head = b"".join(cards).ljust(3 * 2880)
    (tmp_path / "M 42" / "Lights").mkdir(parents=True)
    (tmp_path / "a.fits").write_bytes(head + b"\xff\x00END     " * 100)
    with open(tmp_path / "M 42" / "Lights" / "light_LP_1.FIT", "wb") as f:
        f.write(b"".join([*cards[:3], card("END")]).ljust(2880))
        f.truncate(300 << 20)  # a sparse file: 300 MB of pixels
    (tmp_path / "M 42" / "Lights" / "b.txt").write_bytes(b"no")
    (tmp_path / "M 42" / "empty.fts").write_bytes(b"")
    got = headers.read_headers(spark, str(tmp_path), filesPerPartition="1")
    sizes = {r.path: (r.bytes, len(r.content)) for r in got.collect()}
    assert sizes == {"a.fits": (len(head) + 1000, len(head)), "M 42/Lights/light_LP_1.FIT": (300 << 20, 2880), "M 42/empty.fts": (0, 0)}
    summary = {r.path: r for r in headers.header_summary(got, "path").collect()}
    assert summary["a.fits"].object == "M 31" and summary["a.fits"].width == 1024 and summary["M 42/Lights/light_LP_1.FIT"].object is None and summary["M 42/empty.fts"].status == "unavailable"
    lights = headers.light_identity(got, "night 1", "path")
    named = {r.path: (r.target, r.filter, r.camera, r.geometry) for r in lights.collect()}
    assert named == {"a.fits": ("M 31", "unknown", "unknown", "1024x16@1x1"), "M 42/Lights/light_LP_1.FIT": ("M 42", "Seestar LP", "unknown", "1024x16@1x1"), "M 42/empty.fts": ("night 1", "unknown", "unknown", "unknown")}
    assert headers.light_group_files(lights).select("group_key").distinct().count() == 3
    assert headers.read_headers(spark, str(tmp_path), suffixes=".xyz").count() == 0


def test_header_values(spark):
    cards = b"".join([card("SIMPLE  = T"), card("FILTER  = 'Ha'"), card("FILTER1 = 'HA '"), card("FILTER2 = 3"), card("INSTRUME= ''"), card("CAMERA  = 'c'"), card("EXPOSURE= '12.5'"), card("STACKCNT= 2.5"), card("BINNING = 2"), card("GAIN    = 'low'"), card("EGAIN   = 1.0D0"), card("NAXIS1  = -4"), card("RA      = '05 35 17'"), card("XPIXSZ  = .5"), card("END")])
    r = headers.header_summary(spark.createDataFrame([(1, bytearray(cards))], "frame_id long, content binary")).first()
    assert (r.filter, r.device, r.exposure, r.stack_count, r.per_frame, r.bin_x, r.bin_y, r.gain, r.width, r.ra, r.pixel_x_um, r.fields) == ("Ha · 3", "c", 12.5, None, False, 2, 2, None, None, "05 35 17", 0.5, 14)
