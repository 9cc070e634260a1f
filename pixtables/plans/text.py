"""Queries over header text, settings, policies and digests."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import audit
from ..operators import settings as st
from ..sources import fixtures as fx
from .colour import rsel
from .noise import rounded
from .registry import query, r6, with_views

C = F.col


def angle_text(spark, d):
    p = fx.pointing(spark, d)
    i = C("frame_id")
    h = F.floor(C("ra_deg") / 15)
    m = F.floor((C("ra_deg") / 15 - h) * 60)
    s = lambda c: c.cast("string")
    ra = F.when(i % 4 == 0, F.concat(s(h), F.lit("h"), s(m), F.lit("m30s"))).when(i % 4 == 1, F.concat(F.lit("'"), s(h), F.lit(":"), s(m), F.lit("'"))).when(i % 4 == 2, s(h)).otherwise("n/a")
    deg = F.floor(F.abs(C("dec_deg")))
    dec = F.when(i % 3 == 0, F.concat(F.when(C("dec_deg") < 0, "-").otherwise("+"), s(deg), F.lit(" 12 06"))).when(i % 3 == 1, F.concat(F.lit("-"), s(deg), F.lit(":30"))).otherwise("")
    return p.select("frame_id", ra.alias("ra"), dec.alias("dec"))


@query("parse_angle", with_views("pointing", f"""SELECT frame_id, {r6('CASE frame_id%4 WHEN 0 THEN (h+m/60e0+30e0/3600e0)*15e0 WHEN 1 THEN (h+m/60e0)*15e0 WHEN 2 THEN h*15e0 END')} AS ra_deg,
  {r6('CASE frame_id%3 WHEN 0 THEN CASE WHEN dec_deg<0 THEN -(dg+12e0/60e0+6e0/3600e0) ELSE dg+12e0/60e0+6e0/3600e0 END WHEN 1 THEN -(dg+30e0/60e0) END')} AS dec_deg
  FROM (SELECT *, floor(ra_deg/15) AS h, floor((ra_deg/15-floor(ra_deg/15))*60) AS m, floor(abs(dec_deg)) AS dg FROM pointing)"""))
def parse_angle(spark, d):
    a = angle_text(spark, d).select("frame_id", fn.parse_angle(C("ra"), True).alias("ra_deg"), fn.parse_angle(C("dec"), False).alias("dec_deg"))
    return rounded(a, "ra_deg", "dec_deg")


_RADIUS = "0.5e0*sqrt(pow(4000e0*sx,2)+pow(3000e0*sy,2))"


@query("plate_scale", with_views("pointing", f"""SELECT frame_id, {r6('sc')} AS scale, {r6(f'CASE WHEN sx BETWEEN 1e-7 AND 0.1e0 AND sy BETWEEN 1e-7 AND 0.1e0 AND {_RADIUS} BETWEEN 0.05e0 AND 10e0 THEN {_RADIUS} END')} AS field_radius FROM (
  SELECT frame_id, CASE frame_id%5 WHEN 0 THEN 1.5e0 WHEN 1 THEN (sqrt(pow(a,2)+pow(a/2,2))*3600e0+sqrt(pow(a/3,2)+pow(a,2))*3600e0)/2e0 WHEN 2 THEN (CASE WHEN frame_id%2=0 THEN abs(-a)*3600e0 ELSE (a*3600e0+a*1.5e0*3600e0)/2e0 END) WHEN 3 THEN 206.264806e0*3.76e0/(400e0+ra_deg) END AS sc,
  CASE frame_id%5 WHEN 1 THEN sqrt(pow(a,2)+pow(a/2,2)) WHEN 2 THEN a WHEN 3 THEN 206.264806e0*3.76e0/(400e0+ra_deg)/3600e0 END AS sx,
  CASE frame_id%5 WHEN 1 THEN sqrt(pow(a/3,2)+pow(a,2)) WHEN 2 THEN (CASE WHEN frame_id%2=0 THEN 0e0 ELSE a*1.5e0 END) WHEN 3 THEN 206.264806e0*3e0/(400e0+ra_deg)/3600e0 END AS sy
  FROM (SELECT *, 0.0001e0+abs(dec_deg)*1e-6 AS a FROM pointing))"""))
def plate_scale(spark, d):
    i, a = C("frame_id") % 5, F.lit(0.0001) + F.abs(C("dec_deg")) * 1e-6
    on = lambda k, e: F.when(i == k, e)
    h = {"SECPIX": on(0, F.lit(1.5)), "PIXSCALE": F.lit(None).cast("double"), "CD1_1": on(1, a), "CD2_1": on(1, a / 2), "CD1_2": on(1, a / 3), "CD2_2": on(1, a),
         "CDELT1": on(2, -a), "CDELT2": on(2, F.when(C("frame_id") % 2 == 0, 0.0).otherwise(a * 1.5)), "XPIXSZ": on(3, F.lit(3.76)), "YPIXSZ": on(3, F.lit(3.0)), "FOCALLEN": on(3, F.lit(400.0) + C("ra_deg"))}
    sx, sy = fn.axis_scales(h)
    p = fx.pointing(spark, d).withColumns({"scale": fn.plate_scale(h), "sx": sx, "sy": sy})
    p = p.select("frame_id", "scale", fn.field_radius(F.lit(4000.0), F.lit(3000.0), C("sx"), C("sy")).alias("field_radius"))
    return rounded(p, "scale", "field_radius")


_CAT = """CASE WHEN t='' THEN 'unknown' WHEN regexp_matches(replace(t,' ',''),'sii|6724') OR regexp_matches(t,'(^| )s2( |$)') OR regexp_matches(concat(' ',t,' '),' (tri band|triband|quad band|quadband|multi band|multiband) ') THEN 'conflicting_lines'
  WHEN regexp_matches(concat(' ',t,' '),' (no filter|no lp|without lp|lp off|ircut|ir cut|uv ir|uv ir cut|uv ir block|astro|vis|clear|broadband|astro filter) ') THEN 'broadband'
  WHEN ({ha} AND {o3}) OR contains(concat(' ',t,' '),' hoo ') THEN 'explicit_hoo' WHEN regexp_matches(concat(' ',t,' '),' (zwo duo band|zwo dual band|l extreme|lextreme|l ultimate|lultimate|l para|lpara|nbz|nbzii|sv220) ') THEN 'verified_filter'
  WHEN {ha} OR {o3} THEN 'single_line' WHEN t IN ('lp','lp starless') THEN 'authoritative_lp' WHEN regexp_matches(concat(' ',t,' '),' (dual band|dualband|duo band|duoband) ') THEN 'generic_dualband' ELSE 'unknown' END""".format(
    ha="(regexp_matches(t,'(^| )ha( |$)') OR regexp_matches(replace(t,' ',''),'halpha|6563|65628'))", o3="(regexp_matches(replace(t,' ',''),'oiii|5007') OR regexp_matches(t,'(^| )o3( |$)'))")
_FT = ["", "LP", "Ha", "L-eXtreme", "Duo-Band", "SII 6724", "O3", "UV/IR Cut", "HOO mix"]
_FTEXT = "concat(filter, CASE WHEN frame_id%9=0 THEN '' ELSE concat(' ', list_extract({}, CAST(frame_id%9+1 AS INT))) END)".format(repr(_FT))
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def ftext():
    return F.concat(C("filter"), F.when(C("frame_id") % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in _FT]), (C("frame_id") % 9 + 1).cast("int")))))


@query("filter_category", with_views("frames", f"SELECT frame_id, t AS norm, {_CAT} AS category FROM (SELECT frame_id, {_NORM.format(_FTEXT)} AS t FROM frames)"))
def filter_category(spark, d):
    f = fx.frames(spark, d).select("frame_id", fn.normal_filter(ftext()).alias("norm"))
    return f.withColumn("category", fn.filter_category(C("norm")))


def filter_cards(spark, d):
    """FILTER plus up to two supplemental cards per frame."""
    f = fx.frames(spark, d)
    i = C("frame_id")
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in _FT]), ((F.floor(i / k)) % 9 + 1).cast("int"))
    cards = F.array(F.struct(F.lit("FILTER").alias("key"), C("filter").alias("value")), F.struct(F.lit("FILTER1").alias("key"), pick(1).alias("value")), F.struct(F.lit("FILTER2").alias("key"), pick(3).alias("value")))
    return f.select("frame_id", F.explode(cards).alias("c")).select("frame_id", "c.*")


_CARDS = f"""SELECT frame_id, key, t, {_CAT} AS category FROM (SELECT frame_id, key, {_NORM.format('value')} AS t FROM (SELECT frame_id, 'FILTER' AS key, filter AS value FROM frames
  UNION ALL SELECT frame_id, 'FILTER1', list_extract({_FT!r}, CAST(frame_id%9+1 AS INT)) FROM frames UNION ALL SELECT frame_id, 'FILTER2', list_extract({_FT!r}, CAST((frame_id//3)%9+1 AS INT)) FROM frames)) WHERE t<>''"""
_AUTH = """SELECT *, CASE WHEN au THEN key='FILTER' ELSE key<>'FILTER' AND category<>'unknown' END AS sel FROM (SELECT *, coalesce(max(CASE WHEN key='FILTER' THEN category END) OVER (PARTITION BY frame_id)<>'unknown', false) AS au FROM cards)"""


@query("filter_authority", with_views("frames", """SELECT frame_id, CASE WHEN bool_or(au) THEN 'authoritative_filter' WHEN bool_or(sel) THEN 'supplemental_fallback' ELSE 'none' END AS source, coalesce(string_agg(concat(key,':',category),',' ORDER BY key) FILTER (sel),'') AS selected,
  coalesce(string_agg(concat(key,':',CASE WHEN au THEN 'authoritative_filter_selected' WHEN key='FILTER' THEN 'unrecognized_primary_filter' ELSE 'unrecognized_supplemental_filter' END),',' ORDER BY key) FILTER (NOT sel),'') AS ignored FROM auth GROUP BY frame_id""", cards=_CARDS, auth=_AUTH))
def filter_authority(spark, d):
    return fn.filter_authority(filter_cards(spark, d)).select("frame_id", "source", "selected", "ignored")


@query("narrowband_mapping", with_views("frames", """SELECT frame_id, CASE WHEN ev IN ('explicit_lines','verified_filter_profile','authoritative_lp') THEN 'Ha=R;OIII=G+B' ELSE 'unknown' END AS mapping,
  CASE ev WHEN 'explicit_lines' THEN 0.98e0 WHEN 'verified_filter_profile' THEN 0.95e0 WHEN 'authoritative_lp' THEN 0.8e0 ELSE 0e0 END AS confidence, ev AS evidence FROM (
  SELECT frame_id, CASE WHEN cc THEN 'conflicting_filter_lines' WHEN bb AND nb THEN 'conflicting_filter_fields' WHEN bb THEN 'explicit_broadband_filter' WHEN hoo OR (ha AND o3) THEN 'explicit_lines' WHEN vf THEN 'verified_filter_profile' WHEN sl THEN 'incomplete_lines'
   WHEN lp THEN 'authoritative_lp' WHEN gd THEN 'generic_dualband' ELSE 'no_filter_evidence' END AS ev FROM (SELECT frame_id, coalesce(bool_or(category='conflicting_lines') FILTER (sel),false) cc, coalesce(bool_or(category='broadband') FILTER (sel),false) bb,
   coalesce(bool_or(category NOT IN ('broadband','unknown')) FILTER (sel),false) nb, coalesce(bool_or(category='explicit_hoo') FILTER (sel),false) hoo, coalesce(bool_or(category='verified_filter') FILTER (sel),false) vf, coalesce(bool_or(category='single_line') FILTER (sel),false) sl,
   coalesce(bool_or(category='authoritative_lp') FILTER (sel),false) lp, coalesce(bool_or(category='generic_dualband') FILTER (sel),false) gd,
   coalesce(bool_or(regexp_matches(t,'(^| )ha( |$)')) FILTER (sel),false) ha, coalesce(bool_or(contains(t,'oiii') OR regexp_matches(t,'(^| )o3( |$)')) FILTER (sel),false) o3 FROM auth GROUP BY frame_id))""", cards=_CARDS, auth=_AUTH))
def narrowband_mapping(spark, d):
    return fn.narrowband_mapping(fn.filter_authority(filter_cards(spark, d)))


@query("task_slug", with_views("", "SELECT doc_id, CASE WHEN s='' THEN 'task' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(substring(array_to_string(regexp_extract_all(lower(text),'[a-z0-9]+'),'-'),1,48),'^-+|-+$','','g') AS s FROM documents)"))
def task_slug(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", fn.task_slug(C("text")).alias("slug"))


@query("output_name", with_views("frames pointing", """SELECT c_custkey AS frame_id, CASE WHEN c_custkey%10<>0 THEN concat_ws('_', regexp_replace(c_name,'[^A-Za-z0-9._-]+','_','g'), CASE WHEN c_custkey%3<>0 THEN concat(c_custkey%50+1,'x') END,
  CASE WHEN c_custkey%4=1 THEN '30sec' WHEN c_custkey%4=2 THEN '2p50sec' END, CASE WHEN c_custkey%5=0 THEN '20240102_030405' WHEN c_custkey%5=1 THEN '20240102' END, 'processed', CASE WHEN c_custkey%2=0 THEN 'linear' END) END AS name FROM customer"""))
def output_name(spark, d):
    c = C("c_custkey")
    name = fn.output_name(
        F.when(c % 10 != 0, C("c_name")), F.when(c % 3 != 0, (c % 50 + 1).cast("string")).otherwise("x"), F.when(c % 4 == 1, "30.0").when(c % 4 == 2, "2.5").otherwise("-1"),
        F.when(c % 5 == 0, "2024-01-02T03:04:05").when(c % 5 == 1, "2024-01-02").otherwise("2024"), c % 2 == 0)
    return fx.table(spark, d, "customer").select(c.alias("frame_id"), name.alias("name"))


@query("canonical_hash", with_views("", "SELECT o_orderkey AS id, sha256(concat('{\"custkey\":',o_custkey,',\"priority\":\"',o_orderpriority,'\",\"status\":\"',o_orderstatus,'\"}')) AS digest FROM orders"))
def canonical_hash(spark, d):
    o = fx.table(spark, d, "orders")
    f = [("status", audit.json_text(C("o_orderstatus"))), ("priority", audit.json_text(C("o_orderpriority"))), ("custkey", C("o_custkey").cast("string"))]
    return o.select(C("o_orderkey").alias("id"), audit.canonical_hash(f).alias("digest"))


@query("redact", with_views("", "SELECT event_id, concat('k=', json_extract_string(props,'$.k'), ';user.api_key=', CASE WHEN event_type='view' THEN '' ELSE '<redacted>' END, ';Token=<redacted>') AS text FROM events"))
def redact(spark, d):
    e = fx.table(spark, d, "events")
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user.api_key"), F.when(C("event_type") == "view", "").otherwise(C("event_type")), F.lit("Token"), C("user_id").cast("string"))
    r = fn.redact(m)
    text = F.array_join(F.transform(F.map_entries(r), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return e.select("event_id", text.alias("text"))


@query("pixel_digest", with_views("px", """SELECT image_id, sha256(concat('16x16|', string_agg(td, ',' ORDER BY ty, tx))) AS digest FROM (SELECT image_id, y//8 ty, x//8 tx, sha256(string_agg(concat(y,':',x,':',CAST(floor(r*1e6) AS BIGINT),':',CAST(floor(g*1e6) AS BIGINT),':',CAST(floor(b*1e6) AS BIGINT)), ';' ORDER BY y, x)) td FROM px GROUP BY ALL) GROUP BY image_id"""))
def pixel_digest(spark, d):
    return st.pixel_digest(fx.px(spark, d), 8, 16, 16)


# ---- settings and policies --------------------------------------------------
@query("policy_overlay_join", with_views("", """SELECT task_id, policy, path, CASE WHEN path='stretch.limit' THEN coalesce(ov, df) ELSE coalesce(ov, df) END AS value, ov IS NOT NULL AS overridden FROM (SELECT c_custkey AS task_id, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN c_mktsegment ELSE 'default' END AS policy, p.path, p.df,
  CASE WHEN c_mktsegment='BUILDING' AND p.path='stretch.limit' THEN '0.9' WHEN c_mktsegment='BUILDING' AND p.path='noise.mode' THEN 'full' WHEN c_mktsegment='MACHINERY' AND p.path='stretch.limit' THEN '0.7' END AS ov
  FROM customer, (VALUES ('stretch.limit','0.8'),('noise.mode','chroma'),('stars.keep','true')) p(path, df))"""))
def policy_overlay_join(spark, d):
    tasks = fx.table(spark, d, "customer").select(C("c_custkey").alias("task_id"), C("c_mktsegment").alias("policy"))
    return st.policy_overlay(tasks, st.POLICY_DEFAULT, {"BUILDING": {"stretch.limit": "0.9", "noise.mode": "full"}, "MACHINERY": {"stretch.limit": "0.7"}})


_SPECS = [("bg_samples", "int", 5.0, 60.0, False, "20"), ("window", "int", 3.0, 31.0, True, "9"), ("strength", "float", 0.0, 1.0, False, "0.5"), ("enabled", "bool", None, None, False, "true")]


def raw_settings(spark, d):
    c = C("c_custkey")
    field = F.element_at(F.array(*[F.lit(x) for x in ("bg_samples", "window", "strength", "enabled", "unknown_key")]), (c % 5 + 1).cast("int"))
    value = (
        F.when(c % 5 == 3, F.when(c % 2 == 0, "Yes").when(c % 3 == 0, "maybe").otherwise("off"))
        .when(c % 11 == 0, "abc").when(c % 5 == 2, (C("c_acctbal") / 5000).cast("string")).otherwise(F.floor(C("c_acctbal") / 100).cast("string")))
    return fx.table(spark, d, "customer").select(c.alias("task_id"), field.alias("field"), value.alias("value"))


@query("parameter_spec_join", with_views("", f"""SELECT task_id, field, status, {r6('eff')} AS effective, reason FROM (SELECT task_id, field, CASE WHEN field='unknown_key' THEN 'unknown_field' WHEN num IS NULL THEN 'invalid' WHEN eff<>num THEN 'adjusted' ELSE 'ok' END AS status,
   CASE WHEN field<>'unknown_key' AND num IS NOT NULL THEN eff END AS eff, CASE WHEN field<>'unknown_key' AND eff<>num THEN CASE WHEN field='window' THEN 'safe_clamp_or_odd' ELSE 'safe_clamp' END END AS reason FROM (
   SELECT *, CASE field WHEN 'bg_samples' THEN least(greatest(num,5),60) WHEN 'window' THEN CASE WHEN least(greatest(num,3),31)%2=0 THEN least(greatest(num,3),31)+1 ELSE least(greatest(num,3),31) END WHEN 'strength' THEN least(greatest(num,0),1) ELSE num END AS eff FROM (
   SELECT task_id, field, CASE WHEN field='enabled' THEN CASE WHEN task_id%2=0 THEN 1e0 WHEN task_id%3=0 THEN NULL ELSE 0e0 END WHEN task_id%11=0 THEN NULL WHEN field='strength' THEN bal/5000 WHEN field='unknown_key' THEN NULL ELSE floor(bal/100) END AS num FROM (
   SELECT c_custkey AS task_id, list_extract(['bg_samples','window','strength','enabled','unknown_key'], CAST(c_custkey%5+1 AS INT)) AS field, c_acctbal AS bal FROM customer))))"""))
def parameter_spec_join(spark, d):
    return rounded(st.apply_specs(raw_settings(spark, d), _SPECS), "effective")


@query("gate_profile_scale", with_views("", f"""SELECT task_id, metric, profile, {r6('rq')} AS requested, {r6('least(greatest(rq,lo),hi)')} AS effective, least(greatest(rq,lo),hi)<>rq AS clamped FROM (SELECT c_custkey AS task_id, metric, lo, hi, CASE c_custkey%3 WHEN 0 THEN 'standard' WHEN 1 THEN 'relaxed' ELSE 'unlimited' END AS profile,
  CASE dir WHEN 'upper' THEN CASE WHEN ii THEN ceil(base*f) ELSE base*f END WHEN 'lower' THEN CASE WHEN ii THEN floor(base/f) ELSE base/f END WHEN 'upper_from_one' THEN 1e0+(base-1e0)*f ELSE base END AS rq FROM (SELECT *, CASE c_custkey%3 WHEN 0 THEN 1e0 WHEN 1 THEN 3e0 ELSE 10e0 END AS f FROM customer),
  (VALUES ('span','upper',1.5e0,false,0e0,4e0),('samples','lower',25e0,true,4e0,100e0),('growth','upper_from_one',1.25e0,false,1e0,3e0),('fixed','none',0.5e0,false,0e0,1e0)) s(metric,dir,base,ii,lo,hi))"""))
def gate_profile_scale(spark, d):
    c = C("c_custkey")
    t = fx.table(spark, d, "customer").select(c.alias("task_id"), F.when(c % 3 == 0, "standard").when(c % 3 == 1, "relaxed").otherwise("unlimited").alias("profile"))
    specs = [("span", "upper", 1.5, False, 0.0, 4.0), ("samples", "lower", 25.0, True, 4.0, 100.0), ("growth", "upper_from_one", 1.25, False, 1.0, 3.0), ("fixed", "none", 0.5, False, 0.0, 1.0)]
    return rounded(st.scale_limits(t, specs), "requested", "effective")


@query("settings_table", with_views("", """SELECT task_id, field, value, source FROM (SELECT *, row_number() OVER (PARTITION BY task_id, field ORDER BY pr DESC) rn FROM (
  SELECT c_custkey AS task_id, f AS field, v AS value, 'default' AS source, 0 AS pr FROM customer, (VALUES ('bg_samples','20'),('window','9'),('strength','0.5'),('enabled','true')) d(f,v)
  UNION ALL SELECT c_custkey, 'window', '11', 'environment', 1 FROM customer WHERE c_custkey%4=0 UNION ALL SELECT c_custkey, 'strength', '0.7', 'gate_profile', 2 FROM customer WHERE c_custkey%3=1
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey%2=0 THEN 'window' ELSE 'strength' END, CAST(c_nationkey AS VARCHAR), 'task', 3 FROM customer WHERE c_custkey%5=0)) WHERE rn=1"""))
def settings_table(spark, d):
    c = fx.table(spark, d, "customer").withColumn("task_id", C("c_custkey"))
    i = C("task_id")
    layer = lambda cond, f, v, s: c.where(cond).select("task_id", f.alias("field"), v.alias("value"), F.lit(s).alias("source"))
    lit = F.lit
    extra = [layer(i % 4 == 0, lit("window"), lit("11"), "environment"), layer(i % 3 == 1, lit("strength"), lit("0.7"), "gate_profile"),
             layer(i % 5 == 0, F.when(i % 2 == 0, "window").otherwise("strength"), C("c_nationkey").cast("string"), "task")]
    return st.settings_table(c.select("task_id"), {s[0]: s[5] for s in _SPECS}, extra)
