"""Queries over star and sky catalogues."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pixel import luminance
from ..operators import stars as op
from ..operators.grid import box_blur
from ..sources import fixtures as fx
from .colour import rsel
from .features import recursive
from .noise import mad_sql, rounded
from .registry import blur_sql, lum3, query, r6, with_views

C = F.col


def greedy_ctes(a: str, b: str, r: float, p: str = "") -> dict[str, str]:
    """Sorted greedy walk over all pairs within r, one pair per step."""
    return {
        f"{p}prs": f"SELECT row_number() OVER (ORDER BY d, sid, tid) AS k, * FROM (SELECT a.star_id sid, b.star_id tid, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) d FROM {a} a JOIN {b} b ON abs(a.x-b.x)<={r} AND abs(a.y-b.y)<={r}) WHERE d<={r}",
        f"{p}gw(k, us, ut, label)": f"SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], false UNION ALL SELECT p.k, CASE WHEN ok THEN list_append(us, sid) ELSE us END, CASE WHEN ok THEN list_append(ut, tid) ELSE ut END, ok FROM (SELECT p.*, g.us, g.ut, NOT list_contains(g.us, p.sid) AND NOT list_contains(g.ut, p.tid) AS ok FROM {p}gw g JOIN {p}prs p ON p.k=g.k+1) p",
        f"{p}mt": f"SELECT sid, tid, d FROM {p}prs p JOIN {p}gw g ON g.k=p.k AND g.label",
    }


def rec2(sql: str) -> str:
    return recursive(sql)


def roles(spark, d):
    return fx.stars(spark, d)


@query("star_crossmatch", rec2(with_views("stars", f"SELECT sid, tid, {r6('d')} AS dist FROM mt", o="SELECT * FROM stars WHERE role='O'", c="SELECT * FROM stars WHERE role='C'", **greedy_ctes("o", "c", 2.0))))
def star_crossmatch(spark, d):
    s = roles(spark, d)
    a = s.where(C("role") == "O").select(C("star_id").alias("sid"), "x", "y")
    b = s.where(C("role") == "C").select(C("star_id").alias("tid"), "x", "y")
    return rounded(op.star_crossmatch(a, b, 2.0), "dist")


_FORMAL = "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY flux DESC, star_id) rn, count(*) OVER () n FROM stars WHERE role='C') WHERE rn<=greatest(16, ceil(n*0.2e0))"
_TR = "SELECT '{p}' AS pair, (SELECT count(*) FROM {a}) AS sources, count(d) AS matches, count(d)/(SELECT count(*) FROM {a})::DOUBLE AS ratio, median(d) AS p50, quantile_cont(d,0.95) AS p95 FROM {m}"


@query("three_role_crossmatch", rec2(with_views("stars", f"SELECT pair, sources, matches, {rsel('ratio p50 p95','ratio dist_p50 dist_p95')}, coalesce(CASE WHEN pair='formal_C_to_O' THEN ratio>=0.75 AND p50<=0.75 AND p95<=1.5 WHEN pair='O_to_C' THEN ratio>=0.3 AND sources>=32 ELSE true END, false) AS passed FROM ("
       + " UNION ALL ".join(_TR.format(p=p, a=a, m=m) for p, a, m in (("formal_C_to_O", "fc", "f_mt"), ("O_to_C", "o", "o_mt"), ("O_to_B", "o", "b_mt"))) + ")",
       o="SELECT * FROM stars WHERE role='O'", c="SELECT * FROM stars WHERE role='C'", b="SELECT * FROM stars WHERE role='B'", fc=_FORMAL, **greedy_ctes("fc", "o", 2.0, "f_"), **greedy_ctes("o", "c", 2.0, "o_"), **greedy_ctes("o", "b", 2.0, "b_"))))
def three_role_crossmatch(spark, d):
    return rounded(op.three_role(roles(spark, d), 2.0), "ratio", "dist_p50", "dist_p95")


@query("triple_star_join", with_views("stars", f"SELECT o.star_id, {rsel('b.flux/o.flux c.flux/o.flux','flux_ratio_b flux_ratio_c')}, {r6('sqrt(pow(c.x-o.x,2)+pow(c.y-o.y,2))')} AS shift_c FROM (SELECT * FROM stars WHERE role='O') o JOIN (SELECT * FROM stars WHERE role='B') b USING (star_id) JOIN (SELECT * FROM stars WHERE role='C') c USING (star_id)"))
def triple_star_join(spark, d):
    t = op.triple_join(roles(spark, d))
    t = t.select("star_id", (C("flux_b") / C("flux_o")).alias("flux_ratio_b"), (C("flux_c") / C("flux_o")).alias("flux_ratio_c"), F.hypot(C("x_c") - C("x_o"), C("y_c") - C("y_o")).alias("shift_c"))
    return rounded(t, "flux_ratio_b", "flux_ratio_c", "shift_c")


_AP = "SELECT p.image_id, p.point_id, p.y AS py, p.x AS px, d.y, d.x, {c} sqrt(CAST((d.y-p.y)*(d.y-p.y)+(d.x-p.x)*(d.x-p.x) AS DOUBLE)) AS dd FROM points p JOIN {s} d ON d.image_id=p.image_id AND (d.y-p.y)*(d.y-p.y)+(d.x-p.x)*(d.x-p.x)<={r2}"


@query("aperture_join", with_views("points lum", f"SELECT image_id, point_id, count(*) AS pixels, {r6('sum(l)',4)} AS flux, {r6('max(dd)')} AS reach, (SELECT count(*) FROM lum q WHERE q.image_id=ap.image_id AND NOT EXISTS (SELECT 1 FROM ap z WHERE z.image_id=q.image_id AND z.y=q.y AND z.x=q.x)) AS outside FROM ap GROUP BY image_id, point_id", ap=_AP.format(c="d.l,", s="lum", r2=9)))
def aperture_join(spark, d):
    pix, st = fx.lum(spark, d), fx.points(spark, d)
    fwhm = F.lit(1.2)
    j = op.aperture_join(st, pix, F.greatest(F.lit(3.0), F.least(F.lit(32.0), F.lit(2.0) * fwhm)), 32)
    out = op.outside_apertures(pix, j).groupBy("image_id").agg(F.count("*").alias("outside"))
    s = j.groupBy("image_id", "point_id").agg(F.count("*").alias("pixels"), F.sum("l").alias("flux"), F.max("d").alias("reach")).join(out, "image_id", "left").fillna(0, ["outside"])
    return rounded(rounded(s, "flux", digits=4), "reach")


@query("star_scale_resolution", with_views("px", f"""SELECT image_id, source, {r6('fwhm')} AS fwhm, samples, priority>0 AS review, CAST(ceil(fwhm*1.5e0) AS INT) AS inner_radius, CAST(ceil(fwhm*3e0) AS INT) AS outer_radius FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY priority) rn FROM (
  SELECT image_id, priority, concat('s',priority) AS source, median(1.3e0+r*2e0) AS fwhm, count(r) AS samples FROM (SELECT image_id, CAST((x+y)%3 AS INT) AS priority, CASE WHEN r>0.85 AND (x+y)%3<>0 OR r>0.985 THEN r END AS r FROM px) GROUP BY image_id, priority HAVING count(r)>=4)) WHERE rn=1"""))
def star_scale_resolution(spark, d):
    p = fx.px(spark, d).withColumn("priority", (C("x") + C("y")) % 3)
    measured = ((C("r") > 0.85) & (C("priority") != 0)) | (C("r") > 0.985)  # other stars have no width
    s = p.select("image_id", "priority", F.concat(F.lit("s"), C("priority").cast("string")).alias("source"), F.when(measured, F.lit(1.3) + C("r") * 2.0).alias("fwhm"))
    return rounded(op.scale_resolution(s), "fwhm")


_PSF = "SELECT star_id, o.flux, 2e0+(star_id%7)*0.1e0 AS f0, (2e0+(star_id%7)*0.1e0)*(0.9e0+0.02e0*(star_id%11)) AS f1, 1 AS g FROM (SELECT * FROM stars WHERE role='O') o JOIN (SELECT star_id FROM stars WHERE role='C') c USING (star_id)"


@query("psf_closure", with_views("stars", f"SELECT 1 AS field, grp, r_n AS stars, {r6('r_med')} AS ratio, {r6('1.96e0*1.858e0/1.4826e0*r_sigma/sqrt(r_n)')} AS u95, CASE WHEN NOT (r_med BETWEEN 0.93 AND 1.1) THEN 'hard_failed' WHEN NOT (r_med BETWEEN 0.97 AND 1.05) THEN 'soft_warning' ELSE 'ok' END AS status FROM meds JOIN sigs USING (grp) JOIN (SELECT grp, count(*) r_n FROM pr GROUP BY grp) USING (grp)",
    p0=_PSF, pm="SELECT median(flux) m FROM p0", pr="SELECT 'all' AS grp, f1/f0 AS rt FROM p0 UNION ALL SELECT CASE WHEN flux<m THEN 'weak' ELSE 'bright' END, f1/f0 FROM p0, pm", **mad_sql("pr", "grp", {"r": "rt"}, 1)))
def psf_closure(spark, d):
    s = roles(spark, d)
    i = C("star_id")
    o = s.where(C("role") == "O").join(s.where(C("role") == "C").select("star_id"), "star_id").select(
        F.lit(1).alias("field"), "flux", (F.lit(2.0) + (i % 7) * 0.1).alias("fwhm0"), ((F.lit(2.0) + (i % 7) * 0.1) * (F.lit(0.9) + F.lit(0.02) * (i % 11))).alias("fwhm1"))
    return rounded(op.psf_closure(o, ["field"]), "ratio", "u95")


_VIS = "SELECT p.image_id, p.point_id, greatest(abs(d.y-p.y),abs(d.x-p.x))<=1 AS inn, d.l, d.l2 FROM points p JOIN pl d ON d.image_id=p.image_id AND abs(d.y-p.y)<=3 AND abs(d.x-p.x)<=3"
_PL = f"SELECT *, {lum3('2')} AS l2 FROM pair"


@query("star_visibility", with_views("points pair", f"""SELECT image_id, count(*) AS stars, {r6('avg(CASE WHEN c1>=c0*0.5e0 THEN 1 ELSE 0 END)')} AS visible, {r6('avg(CASE WHEN c1>=c0*0.5e0 THEN 1 ELSE 0 END) FILTER (c0<=m)')} AS weak_visible FROM (SELECT *, median(c0) OVER (PARTITION BY image_id) m FROM (
  SELECT image_id, point_id, max(l) FILTER (inn)-median(l) FILTER (NOT inn) c0, max(l2) FILTER (inn)-median(l2) FILTER (NOT inn) c1 FROM vs GROUP BY ALL) WHERE c0>0) GROUP BY image_id""", pl=_PL, vs=_VIS))
def star_visibility(spark, d):
    p = fx.pair(spark, d).withColumn("l2", luminance(C("r2"), C("g2"), C("b2")))
    return rounded(op.star_visibility(fx.points(spark, d), p, 1, 3), "visible", "weak_visible")


@query("halfmax_fwhm", recursive(with_views("points dlum", f"""SELECT image_id, point_id, py AS peak_y, px AS peak_x, {r6('signal')} AS signal, st AS status, CASE WHEN st='ok' THEN {r6('2e0*sqrt(area/pi())')} END AS fwhm FROM (
  SELECT bx.*, area, CASE WHEN NOT ok THEN 'signal_insufficient' WHEN area IS NULL THEN 'core_absent' WHEN y0=by0 OR y1=by1 OR x0=bx0 OR x1=bx1 THEN 'touches_boundary' ELSE 'ok' END AS st FROM bx LEFT JOIN ar USING (image_id, point_id))""",
  pk="SELECT * FROM (SELECT p.image_id, p.point_id, d.y AS py, d.x AS px, d.l AS peak, row_number() OVER (PARTITION BY p.image_id, p.point_id ORDER BY d.l DESC, d.y, d.x) rn FROM points p JOIN dlum d ON d.image_id=p.image_id AND abs(d.y-p.y)<=1 AND abs(d.x-p.x)<=1) WHERE rn=1",
  sq="SELECT p.*, d.y, d.x, d.l, sqrt(CAST((d.y-p.py)*(d.y-p.py)+(d.x-p.px)*(d.x-p.px) AS DOUBLE)) dd FROM pk p JOIN dlum d ON d.image_id=p.image_id AND abs(d.y-p.py)<=3 AND abs(d.x-p.px)<=3",
  bg="SELECT image_id, point_id, median(l) FILTER (dd>=2 AND dd<=3) bg FROM sq GROUP BY ALL", bm="SELECT image_id, point_id, any_value(bg) bg, median(abs(l-bg)) FILTER (dd>=2 AND dd<=3) mad FROM sq JOIN bg USING (image_id, point_id) GROUP BY ALL",
  s2="SELECT sq.*, bg, peak-bg AS signal, peak-bg>greatest(4e0*1.4826e0*mad,4e-7,1e-6) AS ok FROM sq JOIN bm USING (image_id, point_id)",
  hm="SELECT image_id, point_id, y, x, py, px FROM s2 WHERE ok AND l>=bg+signal*0.5e0",
  **{"hw(image_id, point_id, y, x, label)": "SELECT image_id, point_id, py, px, 0 FROM (SELECT DISTINCT image_id, point_id, py, px FROM hm) UNION SELECT m.image_id, m.point_id, m.y, m.x, 0 FROM hw w JOIN hm m ON m.image_id=w.image_id AND m.point_id=w.point_id AND abs(m.y-w.y)<=1 AND abs(m.x-w.x)<=1"},
  ar="SELECT image_id, point_id, count(*) area, min(y) y0, max(y) y1, min(x) x0, max(x) x1 FROM hw GROUP BY ALL",
  bx="SELECT image_id, point_id, any_value(py) py, any_value(px) px, min(y) by0, max(y) by1, min(x) bx0, max(x) bx1, bool_or(ok) ok, max(signal) signal FROM s2 GROUP BY image_id, point_id")))
def halfmax_fwhm(spark, d):
    return rounded(op.halfmax_fwhm(fx.points(spark, d), fx.dlum(spark, d), 1, 3, 16), "signal", "fwhm")


_HZ = {
    "tb": blur_sql("dlum", "l", 1), "tx": "SELECT d.*, abs(d.l-tb.l) AS texture, greatest(r,g,b)-least(r,g,b) AS chroma FROM dlum d JOIN tb USING (image_id,y,x)",
    "hz": "SELECT *, CASE WHEN dd<=3.5 THEN 'ring' ELSE 'control' END AS zone FROM (" + _AP.format(c="d.texture, d.chroma,", s="tx", r2=25) + ") WHERE dd>1.5",
    "ct": "SELECT * FROM hz WHERE zone='control'", **mad_sql("ct", "image_id, point_id", {"t": "texture", "c": "chroma"}, 1),
    "cn": "SELECT image_id, point_id, count(*) FILTER (zone='control') nc, count(*) FILTER (zone='ring') nr, median(texture) FILTER (zone='ring') tr, median(chroma) FILTER (zone='ring') cr FROM hz GROUP BY ALL",
    "sc": "SELECT image_id, point_id, sector, median(texture) st, median(chroma) sc FROM (SELECT *, least(floor((atan2(CAST(y-py AS DOUBLE),CAST(x-px AS DOUBLE))+pi())/(pi()/4e0)),7) AS sector FROM hz WHERE zone='ring') GROUP BY ALL HAVING count(*)>=2",
    "co": "SELECT image_id, point_id, count(*) FILTER (st>t_med+3e0*greatest(t_sigma,1e-6) OR sc>c_med+3e0*greatest(c_sigma,1e-6))/count(*)::DOUBLE AS coh FROM sc JOIN meds USING (image_id, point_id) JOIN sigs USING (image_id, point_id) GROUP BY ALL",
}


@query("halo_ring_audit", with_views("points dlum", f"SELECT image_id, point_id, {rsel('tz cz coalesce(coh,0)','texture_z chroma_z coherence')}, greatest(tz,cz)>3 AND coalesce(coh,0)>=0.5 AS hard_anomaly FROM (SELECT *, (tr-t_med)/greatest(t_sigma,1e-6) tz, (cr-c_med)/greatest(c_sigma,1e-6) cz FROM cn JOIN meds USING (image_id, point_id) JOIN sigs USING (image_id, point_id) LEFT JOIN co USING (image_id, point_id) WHERE nr>=8 AND nc>=8)", **_HZ))
def halo_ring_audit(spark, d):
    g = box_blur(fx.dlum(spark, d), {"l": "_b"}, 1).withColumns({"texture": F.abs(C("l") - C("_b")), "chroma": F.greatest("r", "g", "b") - F.least("r", "g", "b")})
    return rounded(op.halo_ring_audit(fx.points(spark, d), g, 1.5, 3.5, 5.0), "texture_z", "chroma_z", "coherence")


@query("local_star_guard", with_views("points pair", f"""SELECT image_id, count(*) AS stars, {r6('avg(CASE WHEN p95>0.05e0 OR p05< -0.15e0 OR sh>0.1e0 THEN 1 ELSE 0 END)')} AS failing_share, {r6('max(sh)')} AS max_shift, {r6('max(o95)')} AS outer_p95 FROM (SELECT image_id, point_id, quantile_cont(l2-l,0.05) FILTER (dd>1.5 AND dd<=3) p05, quantile_cont(l2-l,0.95) FILTER (dd>1.5 AND dd<=3) p95, quantile_cont(abs(l2-l),0.95) FILTER (dd>3) o95,
  sqrt(pow(sum(y*l) FILTER (dd<=3)/sum(l) FILTER (dd<=3)-sum(y*l2) FILTER (dd<=3)/sum(l2) FILTER (dd<=3),2)+pow(sum(x*l) FILTER (dd<=3)/sum(l) FILTER (dd<=3)-sum(x*l2) FILTER (dd<=3)/sum(l2) FILTER (dd<=3),2)) sh FROM ap GROUP BY ALL) GROUP BY image_id""", pl=_PL, ap=_AP.format(c="d.l, d.l2,", s="pl", r2=25)))
def local_star_guard(spark, d):
    p = fx.pair(spark, d).withColumn("l2", luminance(C("r2"), C("g2"), C("b2"))).select("image_id", "y", "x", "l", "l2")
    return rounded(op.local_star_guard(fx.points(spark, d), p), "failing_share", "max_shift", "outer_p95")


_RT = "SELECT image_id, y, x, ln(r/g) AS rg, ln(b/g) AS bg FROM px WHERE r>0 AND g>0 AND b>0"


@query("star_ratio_stats", with_views("px", f"SELECT image_id, n AS samples, {rsel('rg_med bg_med d1 d2 greatest(d1,d2) ne','center_rg center_bg mad_rg mad_bg max_mad neutral_error')} FROM (SELECT image_id, count(*) n, any_value(rg_med) rg_med, any_value(bg_med) bg_med, median(abs(rg-rg_med)) d1, median(abs(bg-bg_med)) d2, median(sqrt(rg*rg+bg*bg)) ne FROM rt JOIN (SELECT image_id, median(rg) rg_med, median(bg) bg_med FROM rt GROUP BY image_id) USING (image_id) GROUP BY image_id)", rt=_RT))
def star_ratio_stats(spark, d):
    return rounded(op.star_ratio_stats(fx.px(spark, d), ["image_id"]), "center_rg", "center_bg", "mad_rg", "mad_bg", "max_mad", "neutral_error")


def _clip_sql(i: int) -> dict[str, str]:
    src = "rt0" if i == 0 else f"k{i-1}"
    return {
        f"m{i}": f"SELECT image_id, median(rg) FILTER (i) mr, median(bg) FILTER (i) mb, count(*) FILTER (i) n FROM {src} GROUP BY image_id",
        f"s{i}": f"SELECT image_id, any_value(mr) mr, any_value(mb) mb, any_value(n) n, greatest(1.4826e0*median(abs(rg-mr)) FILTER (i),0.01e0) sr, greatest(1.4826e0*median(abs(bg-mb)) FILTER (i),0.01e0) sb FROM {src} JOIN m{i} USING (image_id) GROUP BY image_id",
        f"k{i}": f"SELECT image_id, y, x, rg, bg, i AND (n<12 OR (abs(rg-mr)<=2.5e0*sr AND abs(bg-mb)<=2.5e0*sb)) AS i FROM {src} JOIN s{i} USING (image_id)",
    }


@query("sigma_clip", with_views("px", 'SELECT image_id, y, x, i AS "in" FROM k2', rt0="SELECT *, true AS i FROM (" + _RT + ")", **_clip_sql(0), **_clip_sql(1), **_clip_sql(2)))
def sigma_clip(spark, d):
    p = fx.px(spark, d).where((C("r") > 0) & (C("g") > 0) & (C("b") > 0)).select("image_id", "y", "x", F.ln(C("r") / C("g")).alias("rg"), F.ln(C("b") / C("g")).alias("bg"))
    return op.sigma_clip(p, ["image_id"]).select("image_id", "y", "x", "in")


_SKYM = """SELECT frame_id, sky_id, name, score, distance FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, sky_id) rn FROM (SELECT *, greatest(0.78e0, least(0.98e0, 0.98e0-distance/greatest(tol,1e-6)*0.18e0)) AS score FROM (
  SELECT f.frame_id, s.sky_id, s.name, greatest(1.2e0, size_arcmin/120e0*1.35e0+0.35e0) AS tol, degrees(acos(least(greatest(sin(radians(f.dec_deg))*sin(radians(s.dec_deg))+cos(radians(f.dec_deg))*cos(radians(s.dec_deg))*cos(radians(f.ra_deg)-radians(s.ra_deg)),-1e0),1e0))) AS distance FROM pointing f, sky s) WHERE distance<=tol)) WHERE rn=1"""


@query("catalog_sky_join", with_views("sky pointing", f"SELECT frame_id, sky_id, name, {r6('score')} AS score, {r6('distance',5)} AS distance FROM sm", sm=_SKYM))
def catalog_sky_join(spark, d):
    m = op.sky_match(fx.sky(spark, d), fx.pointing(spark, d))
    return rounded(rounded(m, "score"), "distance", digits=5)


def named_sky(spark, d):
    return fx.sky(spark, d).withColumn("names", F.array(C("name"), F.concat(F.lit("NGC "), C("sky_id").cast("string"))))


def texts(spark, d):
    i = C("frame_id")
    t = (
        F.when(i % 4 == 0, F.concat(F.lit("Obs ngc-"), (i % 150).cast("string"), F.lit(" field")))
        .when(i % 4 == 1, F.concat(F.lit("target supplier#"), F.lpad((i % 150).cast("string"), 9, "0"), F.lit(" night")))
        .when(i % 4 == 2, F.concat(F.lit("Supplier "), F.lpad((i % 150).cast("string"), 9, "0"), F.lit(" x"))).otherwise(C("text")))
    return fx.pointing(spark, d).withColumn("text", t)


_TX = "SELECT frame_id, ra_deg, dec_deg, CASE frame_id%4 WHEN 0 THEN concat('Obs ngc-', frame_id%150, ' field') WHEN 1 THEN concat('target supplier#', lpad(CAST(frame_id%150 AS VARCHAR),9,'0'), ' night') WHEN 2 THEN concat('Supplier ', lpad(CAST(frame_id%150 AS VARCHAR),9,'0'), ' x') ELSE text END AS text FROM pointing"
_NMM = """SELECT frame_id, sky_id, score FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, sky_id) rn FROM (
  SELECT t.frame_id, s.sky_id, greatest(CASE WHEN regexp_matches(lower(t.text), concat('(^|[^a-z0-9])ngc[ _-]*', s.sky_id, '($|[^a-z0-9])')) THEN 0.94e0 ELSE 0 END, CASE WHEN contains(lower(t.text), lower(s.name)) THEN 0.9e0 ELSE 0 END,
   CASE WHEN regexp_replace(lower(s.name),'[^a-z0-9]','','g')=tn THEN 0.95e0 WHEN contains(tn, regexp_replace(lower(s.name),'[^a-z0-9]','','g')) THEN least(0.88e0, 0.55e0+length(regexp_replace(lower(s.name),'[^a-z0-9]','','g'))/length(tn)::DOUBLE) ELSE 0 END) AS score
  FROM (SELECT *, regexp_replace(lower(text),'[^a-z0-9]','','g') AS tn FROM tx) t, sky s) WHERE score>0) WHERE rn=1"""


@query("catalog_name_join", with_views("sky pointing", f"SELECT frame_id, sky_id, {r6('score')} AS score FROM nm", tx=_TX, nm=_NMM))
def catalog_name_join(spark, d):
    return rounded(op.name_match(named_sky(spark, d), texts(spark, d)), "score")


@query("identity_resolution", with_views("sky pointing", """SELECT frame_id, st AS status, CASE WHEN st IN ('corroborated','composite_resolved','name_resolved') THEN nid WHEN st='coordinate_resolved' THEN cid END AS sky_id FROM (SELECT *, CASE WHEN nid=cid THEN 'corroborated' WHEN nid IS NOT NULL AND cid IS NOT NULL AND nd<=fr*1.05e0 AND distance<=fr*1.05e0 AND nid%3=cid%3 THEN 'composite_resolved'
  WHEN nid IS NOT NULL AND cid IS NOT NULL AND ns>=0.9 THEN 'conflict' WHEN nid IS NOT NULL AND cid IS NOT NULL THEN 'coordinate_resolved' WHEN nid IS NOT NULL THEN 'name_resolved' WHEN cid IS NOT NULL THEN 'coordinate_resolved' ELSE 'visual_fallback' END AS st FROM (
  SELECT t.frame_id, nm.sky_id nid, nm.score ns, sm.sky_id cid, sm.distance, CASE WHEN t.frame_id%7<>0 THEN 30e0-(t.frame_id%3)*10e0 END AS fr, degrees(acos(least(greatest(sin(radians(t.dec_deg))*sin(radians(a.dec_deg))+cos(radians(t.dec_deg))*cos(radians(a.dec_deg))*cos(radians(t.ra_deg)-radians(a.ra_deg)),-1e0),1e0))) nd
  FROM tx t LEFT JOIN nm USING (frame_id) LEFT JOIN sm USING (frame_id) LEFT JOIN sky a ON a.sky_id=nm.sky_id))""", tx=_TX, nm=_NMM, sm=_SKYM))
def identity_resolution(spark, d):
    sk, t = named_sky(spark, d), texts(spark, d)
    kind = F.element_at(F.array(F.lit("galaxy"), F.lit("Nebula "), F.lit("cluster")), (C("sky_id") % 3 + 1).cast("int"))
    radius = F.when(C("frame_id") % 7 != 0, F.lit(30.0) - C("frame_id") % 3 * 10.0)
    return op.identity(t.withColumn("field_radius", radius), op.name_match(sk, t), op.sky_match(fx.sky(spark, d), t), sk.withColumn("type", kind))
