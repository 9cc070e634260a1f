"""Queries over listings, headers and documents; texts are written from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as op
from ..sources import fixtures as fx, headers
from .registry import query, r6, with_views

C = F.col
_DIRS = ["night/lights", "darks", "night/process", ".cache", "m31", "Light", "flats/lights"]


def listing(spark, d):
    f = fx.frames(spark, d)
    i = C("frame_id")
    dirs = F.element_at(F.array(*[F.lit(x) for x in _DIRS]), (i % 7 + 1).cast("int"))
    name = F.when(i % 5 == 0, F.concat(F.lit("img_"), i.cast("string"), F.lit(".fits"))).when(i % 5 == 1, F.concat(F.lit("Flat_"), i.cast("string"), F.lit(".fit"))).when(i % 5 == 2, F.concat(F.lit("light_"), i.cast("string"), F.lit(".png"))).otherwise(C("name"))
    return f.select("frame_id", F.concat_ws("/", dirs, name).alias("path"), "bytes")


_LST = f"SELECT frame_id, concat(list_extract({_DIRS!r}, CAST(frame_id%7+1 AS INT)), '/', CASE frame_id%5 WHEN 0 THEN concat('img_',frame_id,'.fits') WHEN 1 THEN concat('Flat_',frame_id,'.fit') WHEN 2 THEN concat('light_',frame_id,'.png') ELSE name END) AS path, bytes FROM frames"


@query("frame_scan", with_views("frames", "SELECT * FROM ls WHERE regexp_matches(lower(path),'\\.(fit|fits|fts)$') AND NOT regexp_matches(path,'(^|/)\\.') AND NOT regexp_matches(lower(path),'(^|/)(darks|flats|process)/') AND NOT regexp_matches(lower(path),'/(flat_|dark_)[^/]*$') AND (regexp_matches(lower(path),'/light_[^/]*$') OR regexp_matches(lower(path),'(^|/)lights?/'))", ls=_LST))
def frame_scan(spark, d):
    return op.frame_scan(listing(spark, d))


def header_files(spark, d):
    """Header blocks written from frame rows: quotes, D exponents, comments, END in most."""
    f = fx.frames(spark, d)
    i = C("frame_id")
    s = lambda c: c.cast("string")
    pad = lambda c: F.rpad(c, 80, " ")
    val = lambda k, v: pad(F.concat(F.rpad(F.lit(k), 8, " "), F.lit("= "), v))
    cards = F.array(
        val("SIMPLE", F.lit("T / standard")), val("BITPIX", F.when(i % 2 == 0, "16").otherwise("-32")), val("NAXIS1", s(1000 + i % 7)), val("NAXIS2", F.lit("800 / rows")),
        val("OBJECT", F.concat(F.lit("'Bob''s "), C("target"), F.lit(" ' / name"))), val("FILTER", F.concat(F.lit("'"), C("filter"), F.lit("'"))), val("EXPTIME", F.concat(s(i % 9 + 1), F.lit(".5D1"))),
        val("STACKCNT", s(i % 4)), pad(F.concat(F.lit("HISTORY  step "), s(i % 3))), pad(F.lit("COMMENT  made by Tool")), F.when(i % 10 == 0, pad(F.lit("GAIN    = 7"))).otherwise(pad(F.lit("END"))), val("INSTRUME", F.lit("'late'")))
    return f.select("frame_id", F.rpad(F.array_join(cards, ""), 2880, " ").cast("binary").alias("content"))


_HC = """SELECT frame_id, pos, key, v_str, CAST(v_num AS DOUBLE) AS v_num, v_bool FROM (SELECT frame_id, target, filter, unnest([
  {'pos':0,'key':'SIMPLE','v_str':NULL,'v_num':NULL,'v_bool':true},{'pos':1,'key':'BITPIX','v_str':NULL,'v_num':CASE WHEN frame_id%2=0 THEN 16 ELSE -32 END,'v_bool':NULL},{'pos':2,'key':'NAXIS1','v_str':NULL,'v_num':1000+frame_id%7,'v_bool':NULL},{'pos':3,'key':'NAXIS2','v_str':NULL,'v_num':800,'v_bool':NULL},
  {'pos':4,'key':'OBJECT','v_str':concat('Bob''s ',target),'v_num':NULL,'v_bool':NULL},{'pos':5,'key':'FILTER','v_str':filter,'v_num':NULL,'v_bool':NULL},{'pos':6,'key':'EXPTIME','v_str':NULL,'v_num':(frame_id%9+1.5)*10,'v_bool':NULL},{'pos':7,'key':'STACKCNT','v_str':NULL,'v_num':frame_id%4,'v_bool':NULL},
  {'pos':10,'key':CASE WHEN frame_id%10=0 THEN 'GAIN' END,'v_str':NULL,'v_num':7,'v_bool':NULL},{'pos':11,'key':CASE WHEN frame_id%10=0 THEN 'INSTRUME' END,'v_str':'late','v_num':NULL,'v_bool':NULL}], recursive:=true) FROM frames) WHERE key IS NOT NULL"""


@query("header_cards", with_views("frames", "SELECT frame_id, CAST(pos AS INT) AS pos, key, v_str, v_num, v_bool FROM hc", hc=_HC))
def header_cards(spark, d):
    return headers.typed_cards(headers.header_cards(header_files(spark, d)))


@query("history_text", with_views("frames", "SELECT frame_id, lower(concat('SIMPLE T BITPIX ', CASE WHEN frame_id%2=0 THEN '16' ELSE '-32' END, ' NAXIS1 ', 1000+frame_id%7, ' NAXIS2 800 OBJECT ''Bob''''s ', target, ' '' FILTER ''', filter, ''' EXPTIME ', frame_id%9+1, '.5D1 STACKCNT ', frame_id%4, ' HISTORY step ', frame_id%3, ' COMMENT made by Tool', CASE WHEN frame_id%10=0 THEN ' GAIN 7 INSTRUME ''late''' ELSE '' END)) AS text FROM frames"))
def history_text(spark, d):
    return headers.history_text(headers.header_cards(header_files(spark, d)))


_HS = """SELECT frame_id, CASE WHEN frame_id%11=0 THEN 'unavailable' ELSE 'ready' END AS status, CAST(CASE WHEN frame_id%11=0 THEN 17 ELSE 18 END AS INT) AS fields,
  CAST(1000+frame_id%7 AS INT) AS width, 800 AS height, CAST(CASE WHEN frame_id%3=0 THEN 3 ELSE 1 END AS INT) AS channels, CASE WHEN frame_id%2=0 THEN 'uint16' ELSE 'float32' END AS dtype,
  CAST((frame_id%9+1.5)*10 AS DOUBLE) AS exposure, CASE WHEN frame_id%4>0 THEN CAST(frame_id%4 AS INT) END AS stack_count, frame_id%4>1 AS per_frame,
  CASE WHEN filter<>'' THEN concat(filter, CASE WHEN filter='LP' THEN '' ELSE ' · LP' END) ELSE 'LP' END AS filter, concat('Scope ', frame_id%2, ' · CAM') AS device, concat('sens', frame_id%5) AS sensor0,
  CAST(CASE WHEN frame_id%6>0 THEN frame_id%6 END AS INT) AS bin_x, CAST(CASE WHEN frame_id%6>0 THEN frame_id%6 END AS INT) AS bin_y, 7e0 AS gain, CAST(-(frame_id%20) AS DOUBLE)-0.5e0 AS sensor_celsius,
  CAST(NULL AS DOUBLE) AS focal_mm, CAST(NULL AS DOUBLE) AS pixel_x_um, CAST(NULL AS DOUBLE) AS pixel_y_um, concat('Bob''s ',target) AS object, CAST(NULL AS VARCHAR) AS observed, CAST(NULL AS VARCHAR) AS image_type,
  CAST(NULL AS VARCHAR) AS ra, CAST(NULL AS VARCHAR) AS dec, 'GRBG' AS bayer, CAST(NULL AS VARCHAR) AS software FROM frames"""


@query("header_summary", with_views("frames", "SELECT * EXCLUDE (sensor0, device), sensor0 AS sensor, concat(device, ' · ', sensor0) AS device FROM hs", hs=_HS))
def header_summary(spark, d):
    """Two blocks of cards, names under several keys, a key given twice, sizes and temperatures, and pixels behind END."""
    f = fx.frames(spark, d)
    i = C("frame_id")
    s = lambda c: c.cast("string")
    pad = lambda c: F.rpad(c, 80, " ")
    val = lambda k, v: pad(F.concat(F.rpad(F.lit(k), 8, " "), F.lit("= "), v))
    text = lambda *c: F.concat(F.lit("'"), *c, F.lit("' / x"))
    cards = F.array(
        F.when(i % 11 == 0, pad(F.lit("COMMENT"))).otherwise(val("SIMPLE", F.lit("T"))), val("BITPIX", F.when(i % 2 == 0, "16").otherwise("-32")), val("NAXIS1", F.lit("5")), val("NAXIS1", s(1000 + i % 7)), val("NAXIS2", F.lit("800 / rows")),
        F.when(i % 3 == 0, val("NAXIS3", F.lit("3"))).otherwise(pad(F.lit("HISTORY = none"))), val("OBJECT", text(F.lit("  "))), val("OBJNAME", text(F.lit("Bob''s   "), C("target"))), val("FILTER", text("filter")), val("FILTER1", text(F.lit("LP"))),
        val("EXPTIME", F.concat(s(i % 9 + 1), F.lit(".5D1"))), val("STACKCNT", s(i % 4)), val("TELESCOP", text(F.lit("Scope "), s(i % 2))), val("INSTRUME", text(F.lit("CAM"))), val("DETECTOR", text(F.lit("sens"), s(i % 5))),
        val("XBINNING", s(i % 6)), val("GAIN", F.lit("7")), val("CCD-TEMP", F.concat(F.lit("-"), s(i % 20), F.lit(".5"))), val("BAYERPAT", text(F.lit("GRBG"))), *[pad(F.lit("COMMENT  line"))] * 20, pad(F.lit("END")))
    head = F.rpad(F.array_join(cards, ""), 5760, " ")
    files = f.select("frame_id", F.concat(head.cast("binary"), F.unhex(F.repeat(F.lit("FF00A5"), 2000))).alias("content"))
    return headers.header_summary(files)


@query("json_scan", with_views("", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events WHERE event_id%5<>0 AND event_id%7<>0"))
def json_scan(spark, d):
    e = fx.table(spark, d, "events")
    text = F.when(C("event_id") % 5 == 0, F.substring("props", 1, 4)).when(C("event_id") % 7 == 0, "[1, 2]").otherwise(C("props"))
    return op.json_objects(e.select("event_id", text.alias("t")), "t", "k long").select("event_id", C("doc.k").alias("k"))


@query("catalog_scan", with_views("sky", "SELECT name, CAST(pos AS INT) AS pos, alias, 'galaxy' AS type, ra_deg, dec_deg, size_arcmin, CAST(2 AS INT) AS features, 'default' AS policy FROM (SELECT *, unnest([{'pos':0,'alias':name},{'pos':1,'alias':concat('NGC ',sky_id)}], recursive:=true) FROM sky)"))
def catalog_scan(spark, d):
    s = fx.sky(spark, d)
    doc = F.to_json(F.struct("name", F.array(F.concat(F.lit("NGC "), C("sky_id").cast("string"))).alias("aliases"), F.lit("galaxy").alias("type"), "ra_deg", "dec_deg", F.array(C("size_arcmin"), C("size_arcmin") / 2).alias("size_arcmin"), F.array(F.lit("a"), F.lit("b")).alias("features"), F.lit("default").alias("policy")))
    return op.catalog_rows(s.select(doc.alias("t")), "t")


@query("metric_jsonl_sink", with_views("", "SELECT run_id, seq, concat('{\"seq\":', seq, ',\"pixels\":', p, ',\"stage\":', stage, '}') AS record FROM (SELECT run_id, stage, p, CAST(row_number() OVER (PARTITION BY run_id ORDER BY stage) AS INT) AS seq FROM (SELECT l_orderkey AS run_id, l_linenumber AS stage, max(l_partkey) AS p FROM lineitem GROUP BY ALL))"))
def metric_jsonl_sink(spark, d):
    m = fx.table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("run_id"), C("l_linenumber").alias("stage")).agg(F.max("l_partkey").alias("pixels"))
    return op.metric_records(m, ["stage"])


_NM = ["result_final.png", "Target_1.tif", "target.fit", "processing-plan.json", "notes.txt", "other_2.png", "result_linear.fit"]
_OF = f"SELECT l_orderkey AS run_id, concat('out/', list_extract({_NM!r}, l_linenumber)) AS path, CAST(max(l_quantity) AS BIGINT) AS size, max(l_shipdate) AS mtime FROM lineitem GROUP BY l_orderkey, l_linenumber"


def out_files(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("run_id"), "l_linenumber").agg(F.max("l_quantity").cast("long").alias("size"), F.max("l_shipdate").alias("mtime"))
    return li.select("run_id", F.concat(F.lit("out/"), F.element_at(F.array(*[F.lit(x) for x in _NM]), C("l_linenumber"))).alias("path"), "size", "mtime")


@query("output_inventory", with_views("", "SELECT run_id, path, size, CASE WHEN path IN ('out/processing-plan.json','out/result_linear.fit') THEN 'durable' WHEN path LIKE 'out/result_%' THEN 'result' ELSE 'basename' END AS reason FROM f WHERE path IN ('out/processing-plan.json','out/result_linear.fit') OR (mtime>=TIMESTAMP '1999-01-01 00:00:00'-INTERVAL 1 SECOND AND (path='out/result_final.png' OR (lower(path) LIKE 'out/target%' AND run_id%2=0) OR (path='out/other_2.png' AND run_id%2=1)))", f=_OF))
def output_inventory(spark, d):
    o = fx.table(spark, d, "orders").select(C("o_orderkey").alias("run_id"), F.when(C("o_orderkey") % 2 == 0, " TARGET").otherwise("other").alias("base"))
    f = out_files(spark, d)
    start = F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00"))
    return op.output_inventory(f, start, o, ["processing-plan.json", "result_linear.fit"])


@query("diagnostic_archive_list", with_views("", "SELECT run_id, path, size, (path LIKE '%.json' OR path LIKE '%.txt') AND size<=30 AS include FROM f", f=_OF))
def diagnostic_archive_list(spark, d):
    return op.diagnostic_archive_list(out_files(spark, d), 30)


@query("container_probe_join", with_views("", "SELECT q.run_id, q.format, p.path, p.bit_depth, CASE WHEN p.path IS NULL THEN 'missing' WHEN q.format='png' AND p.bit_depth<>16 THEN 'wrong_depth_or_colour' ELSE 'ok' END AS status FROM (SELECT DISTINCT l_orderkey AS run_id, f.format FROM lineitem, (VALUES ('png'),('tif'),('fit')) f(format)) q LEFT JOIN (SELECT run_id, format, min(path) path, max(bd) AS bit_depth FROM (SELECT run_id, path, CASE CAST(size AS INT)%4 WHEN 0 THEN 'png' WHEN 1 THEN 'tif' WHEN 2 THEN 'fit' ELSE 'unknown' END AS format, CASE WHEN size%4=0 THEN CASE WHEN run_id%3=0 THEN 8 ELSE 16 END END AS bd FROM f) GROUP BY run_id, format) p ON p.run_id=q.run_id AND p.format=q.format", f=_OF))
def container_probe_join(spark, d):
    k = C("size") % 4
    png = F.concat(F.lit("89504E470D0A1A0A0000000D494844520000001000000010"), F.when(C("run_id") % 3 == 0, "08").otherwise("10"), F.lit("020000"))
    content = F.unhex(F.when(k == 0, png).when(k == 1, "49492A0008000000").when(k == 2, "53494D504C452020").otherwise("00"))
    f = out_files(spark, d).withColumn("content", content)
    req = f.select("run_id").distinct().select("run_id", F.explode(F.array(F.lit("png"), F.lit("tif"), F.lit("fit"))).alias("format"))
    return op.output_manifest(req, op.container_probe(f.select("run_id", "path", "content")))
