"""Queries over baseline/candidate measures and their gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as px
from ..functions.pixel import luminance
from ..operators import coverage as cov, pairs as op
from ..operators.colour import before_after
from ..operators.quantiles import weighted_quantiles
from ..session import shared
from ..sources import fixtures as fx
from .background import plane_ctes
from .colour import rsel
from .noise import mad_sql, rounded
from .registry import blur_sql, cl, lum3, query, r6, with_views

C = F.col


def lpair(spark, d, k: int = 2):
    return fx.pair(spark, d, k).withColumn("l2", luminance(C("r2"), C("g2"), C("b2")))


def dpair(spark, d, k: int = 2):
    return fx.with_candidate(fx.dmasked(spark, d), k).withColumn("l2", luminance(C("r2"), C("g2"), C("b2")))


LP = {"lp": f"SELECT *, {lum3('2')} AS l2 FROM pair"}
DP = {"dp": f"SELECT *, {lum3('2')} AS l2 FROM dpair"}
_SAT = lambda s: f"(greatest(r{s},g{s},b{s})-least(r{s},g{s},b{s}))/greatest(greatest(r{s},g{s},b{s}),1e-6)"
_OP = lambda s: f"(pow(r{s}-g{s},2)+pow(b{s}-g{s},2))"
_XY = lambda c, s: f"(greatest({c}{s},0e0)/greatest(greatest(r{s},0e0)+greatest(g{s},0e0)+greatest(b{s},0e0),1e-6))"

_RN = "subject bg span sat50 sat95 opp micro subject2 bg2 span2 sat502 sat952 opp2 micro2 sat50_ratio sat95_ratio opp_ratio micro_ratio opp_direction visibility"
RD = {
    **DP, "db": blur_sql("dp", "l l2", 1),
    "rd0": f"""SELECT d.image_id, count(*) FILTER (subject>0.5) subject_pixels, {', '.join(f"median(d.l{s}) FILTER (subject>0.5) subject{s}, quantile_cont(d.l{s},0.95) FILTER (subject>0.5)-quantile_cont(d.l{s},0.05) FILTER (subject>0.5) span{s}, median(d.l{s}) FILTER (background>0.5) bg{s}, median({_SAT(s)}) FILTER (subject>0.5) sat50{s}, quantile_cont({_SAT(s)},0.95) FILTER (subject>0.5) sat95{s}, median(abs(d.l{s}-db.l{s})) FILTER (subject>0.5) micro{s}, sqrt(avg({_OP(s)}) FILTER (subject>0.5)) opp{s}, sum({_OP(s)}) FILTER (subject>0.5) e{s}" for s in ('', '2'))},
      sum((r-g)*(r2-g2)+(b-g)*(b2-g2)) FILTER (subject>0.5) dt FROM dp d JOIN db USING (image_id,y,x) GROUP BY d.image_id""",
    "rd": """SELECT *, sat502/greatest(sat50,1e-9) sat50_ratio, sat952/greatest(sat95,1e-9) sat95_ratio, opp2/greatest(opp,1e-9) opp_ratio, micro2/greatest(micro,1e-9) micro_ratio, dt/greatest(sqrt(e*e2),1e-12) opp_direction, (subject2-bg2)/greatest(subject-bg,1e-9) visibility FROM rd0""",
}


@query("rendition_metrics", with_views("dpair", f"SELECT image_id, subject_pixels, {rsel(_RN)} FROM rd", **RD))
def rendition_metrics(spark, d):
    return rounded(op.rendition(dpair(spark, d)), *_RN.split())


_CNT = lambda s, t: "+".join(f"CAST({c}{s}{t} AS INT)" for c in "rgb")


@query("transform_loss", with_views("pair", f"""SELECT image_id, coalesce(region,'all') AS region, CAST(sum({_CNT('','<=0')}) AS BIGINT) AS low_before, CAST(sum({_CNT('2','<=0')}) AS BIGINT) AS low_after, CAST(sum({_CNT('','>=1')}) AS BIGINT) AS high_before, CAST(sum({_CNT('2','>=1')}) AS BIGINT) AS high_after, count(*) AS pixels
  FROM (SELECT *, CASE WHEN background>0.5 THEN 'background' ELSE 'other' END AS region FROM pair) GROUP BY GROUPING SETS ((image_id, region), (image_id))"""))
def transform_loss(spark, d):
    return op.transform_loss(fx.pair(spark, d))


def wq_sql(src: str, keys: str, v: str, w: str, q: float) -> str:
    return (f"SELECT {keys}, min(v) AS q FROM (SELECT {keys}, v, sum(w) OVER (PARTITION BY {keys} ORDER BY v) cum, sum(w) OVER (PARTITION BY {keys}) tot FROM (SELECT {keys}, {v} AS v, {w} AS w FROM {src}) WHERE w>1e-6) "
            f"WHERE cum>={q}*tot*(1-1e-12) GROUP BY {keys}")


@query("weighted_quantile_mean", with_views("msk", f"SELECT image_id, n AS samples, {rsel('ws wm a.q b.q','weight_sum wmean p50 p95')} FROM (SELECT image_id, count(*) n, sum(subject) ws, sum(l*subject)/sum(subject) wm FROM msk WHERE subject>1e-6 GROUP BY image_id) JOIN a USING (image_id) JOIN b USING (image_id)",
    a=wq_sql("msk", "image_id", "l", "subject", 0.5), b=wq_sql("msk", "image_id", "l", "subject", 0.95)))
def weighted_quantile_mean(spark, d):
    return rounded(weighted_quantiles(fx.masked(spark, d), ["image_id"], C("l"), C("subject"), {"p50": 0.5, "p95": 0.95}), "weight_sum", "wmean", "p50", "p95")


_CRX = {
    **LP,
    "cr0": "SELECT image_id, abs(l2-l) dl, sqrt(pow({0},2)+pow({1},2)+pow({2},2)) dc, abs(atan2(sin(h2-h1),cos(h2-h1))) dh, least(greatest(least(s1,s2)/0.08e0,0e0),1e0) hs, CASE WHEN greatest(abs(r2-r),abs(g2-g),abs(b2-b))>1e-4 THEN 1e0 ELSE 0e0 END ch, subject, background FROM (SELECT *, atan2({b}-{g},{r}-{g}) h1, atan2({b2}-{g2},{r2}-{g2}) h2, sqrt(pow({r}-{g},2)+pow({b}-{g},2)) s1, sqrt(pow({r2}-{g2},2)+pow({b2}-{g2},2)) s2 FROM lp)".format(
        *[f"{_XY(c, '2')}-{_XY(c, '')}" for c in "rgb"], **{c: _XY(c, "") for c in "rgb"}, **{f"{c}2": _XY(c, "2") for c in "rgb"}),
    "cr": "SELECT image_id, 'subject' AS roi, dl, dc, dh, hs, ch, subject AS w FROM cr0 UNION ALL SELECT image_id, 'background', dl, dc, dh, hs, ch, background FROM cr0",
}


@query("colour_report", with_views("pair", f"SELECT image_id, roi, n AS samples, {rsel('ws a.q b.q c.q e.q cs','weight_sum luma_p50 luma_p95 chroma_p50 chroma_p95 changed_share')}, {r6('CASE WHEN hn>=16 THEN degrees(h.q) END',4)} AS hue_p50 FROM (SELECT image_id, roi, count(*) n, sum(w) ws, sum(ch*w)/sum(w) cs FROM cr WHERE w>1e-6 GROUP BY ALL) JOIN a USING (image_id, roi) JOIN b USING (image_id, roi) JOIN c USING (image_id, roi) JOIN e USING (image_id, roi) LEFT JOIN h USING (image_id, roi) LEFT JOIN (SELECT image_id, roi, count(*) hn FROM cr WHERE w*hs>1e-6 GROUP BY ALL) USING (image_id, roi)",
    **_CRX, a=wq_sql("cr", "image_id, roi", "dl", "w", 0.5), b=wq_sql("cr", "image_id, roi", "dl", "w", 0.95), c=wq_sql("cr", "image_id, roi", "dc", "w", 0.5), e=wq_sql("cr", "image_id, roi", "dc", "w", 0.95), h=wq_sql("cr", "image_id, roi", "dh", "w*hs", 0.5)))
def colour_report(spark, d):
    r = op.colour_report(lpair(spark, d), ["subject", "background"])
    return rounded(rounded(r, "weight_sum", "luma_p50", "luma_p95", "chroma_p50", "chroma_p95", "changed_share"), "hue_p50", digits=4)


_CL = {"o0": "SELECT image_id, y, x, subject, r-g AS a, b-g AS b_, r2-g2 AS c, b2-g2 AS e FROM dpair", **{f"o{i}": blur_sql(f"o{i-1}", "a b_ c e", 1) for i in (1, 2, 3, 4)}}


@query("subject_chroma_lineage", with_views("dpair", "SELECT image_id, " + ", ".join(r6(f"r{i}") + f" AS retention_{i}" for i in (1, 2, 4)) + f", {rsel('sb sa','sat_before sat_after')} FROM (SELECT o0.image_id, "
    + ", ".join(f"sqrt(avg(o{i}.c*o{i}.c+o{i}.e*o{i}.e) FILTER (o0.subject>0.5))/greatest(sqrt(avg(o{i}.a*o{i}.a+o{i}.b_*o{i}.b_) FILTER (o0.subject>0.5)),1e-9) AS r{i}" for i in (1, 2, 4))
    + f" FROM o0 JOIN o1 USING (image_id,y,x) JOIN o2 USING (image_id,y,x) JOIN o4 USING (image_id,y,x) GROUP BY o0.image_id) JOIN (SELECT image_id, median({_SAT('')}) FILTER (subject>0.5) sb, median({_SAT('2')}) FILTER (subject>0.5) sa FROM dpair GROUP BY image_id) USING (image_id)", **_CL))
def subject_chroma_lineage(spark, d):
    return rounded(op.chroma_lineage(dpair(spark, d)), "retention_1", "retention_2", "retention_4", "sat_before", "sat_after")


@query("weak_chroma_evidence", with_views("dmsk", f"SELECT image_id, support, cells, quadrants, {rsel('er (ms-mb)/greatest(sg,1e-9) sc','energy_ratio snr scale_corr')}, support>=16 AND cells>=3 AND quadrants>=2 AND er>=1.2 AND sc>=0.5 AS evident FROM (SELECT image_id, count(*) FILTER (s) support, CAST(count(DISTINCT CASE WHEN s THEN (y*4//16)*4+x*4//16 END) AS INT) cells, CAST(count(DISTINCT CASE WHEN s THEN (y*2//16)*2+x*2//16 END) AS INT) quadrants, "
    "avg(o1*o1) FILTER (s)/greatest(avg(o1*o1) FILTER (bg),1e-12) er, corr(o1,o2) FILTER (s) sc, avg(o1) FILTER (s) ms, avg(o1) FILTER (bg) mb FROM wc GROUP BY image_id) JOIN (SELECT image_id, n_sigma sg FROM sigs) USING (image_id)",
    w0="SELECT *, sqrt(pow(r-g,2)+pow(b-g,2)) AS o FROM dmsk", w1=blur_sql("w0", "o", 1), w2=blur_sql("w1", "o", 2),
    wc="SELECT w0.*, w1.o AS o1, w2.o AS o2, subject>0.25 AS s, background>0.5 AS bg FROM w0 JOIN w1 USING (image_id,y,x) JOIN w2 USING (image_id,y,x)", wb="SELECT * FROM wc WHERE bg", **mad_sql("wb", "image_id", {"n": "o-o1"}, 1)))
def weak_chroma_evidence(spark, d):
    return rounded(op.weak_chroma(fx.dmasked(spark, d), 16), "energy_ratio", "snr", "scale_corr")


_NG = {**DP, "n0": "SELECT *, sqrt(l) AS tone FROM dp", "n1": blur_sql("n0", "l l2 tone", 1), "nb": "SELECT n0.image_id, n0.l-n1.l AS a, n0.l2-n1.l2 AS b, n0.tone-n1.tone AS c FROM n0 JOIN n1 USING (image_id,y,x) WHERE background>0.5", **mad_sql("nb", "image_id", {"a": "a", "b": "b", "c": "c"})}


@query("luma_noise_growth", with_views("dpair", f"SELECT image_id, {rsel('a_sigma b_sigma c_sigma b_sigma/greatest(c_sigma,1e-9)','before_sigma after_sigma expected_sigma growth')}, b_sigma/greatest(c_sigma,1e-9)<=1.25 AS accepted FROM sigs", **_NG))
def luma_noise_growth(spark, d):
    return rounded(op.noise_growth(dpair(spark, d).withColumn("tone", F.sqrt("l"))), "before_sigma", "after_sigma", "expected_sigma", "growth")


@query("multiscale_contrast", with_views("dpair", "SELECT dp.image_id, " + ", ".join(r6(f"avg(abs(dp.l2-c{r}.l2))/greatest(avg(abs(dp.l-c{r}.l)),1e-9)") + f" AS transfer_{r}" for r in (1, 2, 4)) + " FROM dp JOIN c1 USING (image_id,y,x) JOIN c2 USING (image_id,y,x) JOIN c4 USING (image_id,y,x) GROUP BY dp.image_id",
    **DP, **{f"c{r}": blur_sql("dp", "l l2", r) for r in (1, 2, 4)}))
def multiscale_contrast(spark, d):
    return rounded(op.multiscale_contrast(dpair(spark, d)), "transfer_1", "transfer_2", "transfer_4")


@query("colour_vector_drift", with_views("pair", f"SELECT image_id, {r6('median(a)',3)} AS angle_p50, {r6('quantile_cont(a,0.95)',3)} AS angle_p95, {r6('quantile_cont(d,0.95)')} AS l1_p95 FROM (SELECT image_id, degrees(acos({cl('(r*r2+g*g2+b*b2)/greatest(sqrt(r*r+g*g+b*b)*sqrt(r2*r2+g2*g2+b2*b2),1e-12)','-1e0')})) a, ({'+'.join(f'abs({_XY(c,str())}-{_XY(c,str(2))})' for c in 'rgb')})*0.5e0 d FROM pair) GROUP BY image_id"))
def colour_vector_drift(spark, d):
    return rounded(rounded(op.vector_drift(lpair(spark, d)), "angle_p50", "angle_p95", digits=3), "l1_p95")


_TLN = "level level2 contrast contrast2 clip2"


@query("target_local_quality", with_views("dpair", f"SELECT image_id, region, count(*) AS pixels, {rsel('avg(l) avg(l2) stddev_pop(l) stddev_pop(l2)', 'level level2 contrast contrast2')}, {r6('avg(CASE WHEN greatest(r2,g2,b2)>=1 THEN 1 ELSE 0 END)')} AS clip2 FROM (SELECT dp.*, CASE WHEN f4.l<=q[1] THEN 'background' WHEN f4.l<=q[2] THEN 'dark' WHEN f4.l<=q[3] THEN 'faint' WHEN f4.l>q[4] THEN 'core' ELSE 'bright' END AS region FROM dp JOIN f4 USING (image_id,y,x) JOIN fq USING (image_id)) WHERE l<0.985 GROUP BY image_id, region",
    **DP, f1=blur_sql("dp", "l", 1), f2=blur_sql("f1", "l", 1), f3=blur_sql("f2", "l", 1), f4=blur_sql("f3", "l", 1), fq="SELECT image_id, quantile_cont(l,[0.35,0.55,0.9,0.99]) q FROM f4 GROUP BY image_id"))
def target_local_quality(spark, d):
    return rounded(op.target_local(dpair(spark, d)), *_TLN.split())


@query("structure_correlation", with_views("dpair", f"SELECT dp.image_id, count(*) AS pixels, {r6('corr(dp.l-s2.l,dp.l2-s2.l2)')} AS correlation FROM dp JOIN s2 USING (image_id,y,x) WHERE subject>0.25 GROUP BY dp.image_id", **DP, s2=blur_sql("dp", "l l2", 2)))
def structure_correlation(spark, d):
    return rounded(op.structure_correlation(dpair(spark, d)), "correlation")


_RFN = "saturation contrast fine_sigma coarse_sigma black_share highlight_share extreme_saturation_share"


def rf_ctes(src: str, p: str = "") -> dict[str, str]:
    return {
        f"{p}r1": blur_sql(src, "l", 1), f"{p}r4": blur_sql(f"{p}r1" if False else src, "l", 4),
        f"{p}rb": f"SELECT d.image_id, d.l-a.l AS fine, b4.l AS coarse FROM {src} d JOIN {p}r1 a USING (image_id,y,x) JOIN {p}r4 b4 USING (image_id,y,x) WHERE background>0.5",
        **{f"{p}{k}": v.replace("JOIN meds", f"JOIN {p}meds") for k, v in mad_sql(f"{p}rb", "image_id", {"fine": "fine", "coarse": "coarse"}).items()},
        f"{p}rf": f"SELECT image_id, saturation, contrast, fine_sigma, coarse_sigma, black_share, highlight_share, extreme_saturation_share FROM (SELECT image_id, median({_SAT('')}) FILTER (subject>0.25) saturation, quantile_cont(l,0.95)-quantile_cont(l,0.05) contrast, avg(CASE WHEN l<=0.01 THEN 1 ELSE 0 END) black_share, avg(CASE WHEN l>=0.985 THEN 1 ELSE 0 END) highlight_share, avg(CASE WHEN {_SAT('')}>=0.95 THEN 1 ELSE 0 END) extreme_saturation_share FROM {src} GROUP BY image_id) JOIN {p}sigs USING (image_id)",
    }


@query("reference_image_metrics", with_views("dmsk", f"SELECT image_id, {rsel(_RFN)} FROM rf", **rf_ctes("dmsk")))
def reference_image_metrics(spark, d):
    return rounded(op.reference_metrics(fx.dmasked(spark, d)), *_RFN.split())


def shown_as(p, k: int):
    """Candidate k shown as an image of its own, on the baseline's masks."""
    return fx.with_candidate(p, k).select("image_id", "y", "x", "h", "w", C("r2").alias("r"), C("g2").alias("g"), C("b2").alias("b"), luminance(C("r2"), C("g2"), C("b2")).alias("l"), "subject", "background", "core")


def _cand_sql(k: int) -> str:
    return f"SELECT image_id, y, x, subject, background, core, r, g, b, {lum3()} AS l FROM (SELECT image_id, y, x, subject, background, core, r*(1e0-0.1e0*{k})+0.02e0*{k} AS r, g*(1e0-0.05e0*{k}) AS g, b*(1e0-0.1e0*{k})+0.01e0*x*{k}/16 AS b FROM dmsk)"


_DIM = ["saturation", "contrast", "fine_sigma", "coarse_sigma"]


@query("reference_qa", with_views("dmsk", f"""SELECT image_id, improved, {r6('shrink')} AS saturation_shrink, artifact, CASE WHEN artifact THEN 'artifact' WHEN improved>=2 AND shrink>=0.5 THEN 'accepted' ELSE 'rejected' END AS status FROM (SELECT image_id, CAST({'+'.join(f'(abs(o.{c}/greatest(x.{c},1e-9)-1e0)<abs(b.{c}/greatest(x.{c},1e-9)-1e0))::INT' for c in _DIM)} AS INT) AS improved,
  CASE WHEN abs(b.saturation/greatest(x.saturation,1e-9)-1e0)>1e-9 THEN (abs(b.saturation/greatest(x.saturation,1e-9)-1e0)-abs(o.saturation/greatest(x.saturation,1e-9)-1e0))/abs(b.saturation/greatest(x.saturation,1e-9)-1e0) END AS shrink,
  o.black_share>greatest(1.1e0*b.black_share,b.black_share+0.005e0) OR o.highlight_share>greatest(1.1e0*b.highlight_share,b.highlight_share+0.002e0) OR o.extreme_saturation_share>greatest(1.1e0*b.extreme_saturation_share,b.extreme_saturation_share+0.01e0) AS artifact FROM b_rf b JOIN o_rf o USING (image_id) JOIN x_rf x USING (image_id))""",
  bs=_cand_sql(4), op_=_cand_sql(2), **rf_ctes("bs", "b_"), **rf_ctes("op_", "o_"), **rf_ctes("dmsk", "x_")))
def reference_qa(spark, d):
    p = shared(fx.dmasked(spark, d))
    m = {n: op.reference_metrics(t).select("image_id", *[C(c).alias(f"{n}_{c}") for c in _RFN.split()]) for n, t in (("b", shown_as(p, 4)), ("o", shown_as(p, 2)), ("x", p))}
    j = m["b"].join(m["o"], "image_id").join(m["x"], "image_id")
    gap = lambda n, c: F.abs(C(f"{n}_{c}") / F.greatest(C(f"x_{c}"), F.lit(1e-9)) - 1.0)
    better = sum(((gap("o", c) < gap("b", c)).cast("int") for c in _DIM), F.lit(0))
    shrink = F.when(gap("b", "saturation") > 1e-9, (gap("b", "saturation") - gap("o", "saturation")) / gap("b", "saturation"))
    art = F.lit(False)
    for c, a in (("black_share", 0.005), ("highlight_share", 0.002), ("extreme_saturation_share", 0.010)):
        art = art | (C(f"o_{c}") > F.greatest(C(f"b_{c}") * 1.1, C(f"b_{c}") + a))
    out = j.select("image_id", better.alias("improved"), shrink.alias("saturation_shrink"), art.alias("artifact"))
    status = F.when(C("artifact"), "artifact").when((C("improved") >= 2) & (C("saturation_shrink") >= 0.5), "accepted").otherwise("rejected")
    return rounded(out.withColumn("status", status), "saturation_shrink")


_WEDGE = {
    "tl": "SELECT image_id, y//2 AS ty, x//2 AS tx, y, x, l, sqrt((r-g)*(r-g)+(b-g)*(b-g)) AS c FROM dlum",
    "dv": "SELECT a.image_id, a.ty, a.tx, b.l-a.l AS v FROM tl a JOIN tl b ON a.image_id=b.image_id AND a.ty=b.ty AND a.tx=b.tx AND ((b.y=a.y AND b.x=a.x+1) OR (b.x=a.x AND b.y=a.y+1))",
    "dm": "SELECT image_id, ty, tx, median(v) AS m FROM dv GROUP BY ALL",
    "dn": "SELECT image_id, ty, tx, median(abs(v-m))/(0.6745e0*sqrt(2e0)) AS noise FROM dv JOIN dm USING (image_id, ty, tx) GROUP BY ALL",
    "dc": "SELECT image_id, ty, tx, median(c) AS chroma FROM tl GROUP BY ALL",
    "rf": "SELECT image_id, median(noise) AS rn, median(chroma) AS rc FROM dn JOIN dc USING (image_id, ty, tx) WHERE ty BETWEEN 2 AND 5 AND tx BETWEEN 2 AND 5 GROUP BY image_id",
    "rt": "SELECT image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, rn>1e-8 AND rc>1e-8 AS fit, CASE WHEN fit THEN noise/rn END AS nr, CASE WHEN fit THEN chroma/rc END AS cr FROM dn JOIN dc USING (image_id, ty, tx) JOIN rf USING (image_id)",
    "hg": "SELECT *, coalesce(nr>=1.35e0 AND cr>=1.2e0, false) AS hard, coalesce(nr>=1e0+(1.35e0-1e0)*0.34e0 AND cr>=1e0+(1.2e0-1e0)*0.4e0, false) AS grow FROM rt",
    "fw(image_id, ty, tx)": "SELECT image_id, ty, tx FROM hg WHERE hard AND (ty IN (0,7) OR tx IN (0,7)) UNION SELECT g.image_id, g.ty, g.tx FROM fw f JOIN hg g ON g.image_id=f.image_id AND abs(g.ty-f.ty)+abs(g.tx-f.tx)=1 WHERE g.grow",
    "cn": "SELECT hg.*, fw.ty IS NOT NULL AS connected FROM hg LEFT JOIN fw USING (image_id, ty, tx)",
}


def _flood(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("fw(image_id, ty, tx) AS MATERIALIZED", "fw(image_id, ty, tx) AS")


def coverage(spark, d):
    return cov.coverage_tiles(fx.dlum(spark, d), tile=2, least_side=16, least_tiles=8, least_differences=4)


@query("field_coverage_grid", _flood(with_views("dlum", f"SELECT image_id, ty, tx, {rsel('nr cr','noise_ratio chroma_ratio')}, hard, grow, connected FROM cn", **_WEDGE)))
def field_coverage_grid(spark, d):
    return rounded(coverage(spark, d).select("image_id", "ty", "tx", "noise_ratio", "chroma_ratio", "hard", "grow", "connected"), "noise_ratio", "chroma_ratio")


@query("field_rotation_crop", _flood(with_views("dlum", f"""SELECT image_id, reason, reason LIKE '%confirmed' AS accepted, CASE WHEN accepted THEN CAST(2*x0 AS INT) END AS x, CASE WHEN accepted THEN CAST(2*y0 AS INT) END AS y, CASE WHEN accepted THEN CAST(2*rw AS INT) END AS width, CASE WHEN accepted THEN CAST(2*rh AS INT) END AS height,
  CASE WHEN accepted THEN {r6('rw*rh/64e0')} END AS kept, hard_tiles, connected_tiles, corners, sides, {rsel('n90 c90','noise_p90 chroma_p90')} FROM (SELECT *, CASE WHEN NOT fit THEN 'coverage_reference_unavailable' WHEN connected_tiles<4 THEN 'no_significant_edge_connected_coverage_anomaly'
  WHEN corners<3 OR sides<3 THEN 'edge_connected_anomaly_lacks_corner_wedge_geometry' WHEN rw IS NULL THEN 'no_coverage_interior_rectangle' ELSE 'edge_connected_field_rotation_confirmed' END AS reason
  FROM (SELECT image_id, bool_and(fit) AS fit, count(*) FILTER (hard) AS hard_tiles, count(*) FILTER (connected) AS connected_tiles,
    CAST(bool_or(connected AND ty<2 AND tx<2)::INT+bool_or(connected AND ty<2 AND tx>5)::INT+bool_or(connected AND ty>5 AND tx<2)::INT+bool_or(connected AND ty>5 AND tx>5)::INT AS INT) AS corners,
    CAST(bool_or(connected AND ty=0)::INT+bool_or(connected AND ty=7)::INT+bool_or(connected AND tx=0)::INT+bool_or(connected AND tx=7)::INT AS INT) AS sides FROM cn GROUP BY image_id)
  LEFT JOIN bd USING (image_id) LEFT JOIN best USING (image_id))""", **_WEDGE,
  bd="SELECT image_id, quantile_cont(nr,0.9) AS n90, quantile_cont(cr,0.9) AS c90 FROM (SELECT image_id, nr, cr FROM cn WHERE ty IN (0,7) UNION ALL SELECT image_id, nr, cr FROM cn WHERE tx IN (0,7)) GROUP BY image_id",
  rc="SELECT i.image_id, x0, y0, x1-x0+1 AS rw, y1-y0+1 AS rh FROM (SELECT DISTINCT image_id FROM cn) i, range(8) a(y0), range(8) b(y1), range(8) c(x0), range(8) e(x1) WHERE y0<=y1 AND x0<=x1",
  best="SELECT image_id, x0, y0, rw, rh FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rw*rh DESC, x0, y0, rw, rh) AS rank FROM rc WHERE NOT EXISTS (SELECT 1 FROM cn WHERE cn.image_id=rc.image_id AND connected AND ty BETWEEN y0 AND y0+rh-1 AND tx BETWEEN x0 AND x0+rw-1)) WHERE rank=1")))
def field_rotation_crop(spark, d):
    return rounded(cov.rotation_crop(coverage(spark, d)), "kept", "noise_p90", "chroma_p90")


@query("crop_area_limit", with_views("px", f"SELECT image_id, x0, y0, x1-x0 AS w, y1-y0 AS h, {r6('(x1-x0)*(y1-y0)/256e0')} AS area_share, lim AS limited FROM (SELECT image_id, least(a,1) x0, least(b,1) y0, greatest(c,15) x1, greatest(e,15) y1, a>1 OR b>1 OR c<15 OR e<15 AS lim FROM (SELECT image_id, max(x) a, max(y) b, min(x+w) c, min(y+h) e FROM cp GROUP BY image_id))",
    cp="SELECT image_id, CAST(y%3 AS BIGINT) AS x, CAST(x%2 AS BIGINT) AS y, CAST(16-image_id%3-y%3 AS BIGINT) AS w, CAST(15-x%2+image_id%2 AS BIGINT) AS h FROM px"))
def crop_area_limit(spark, d):
    p = fx.px(spark, d)
    i = C("image_id")
    c = p.select("image_id", (C("y") % 3).cast("long").alias("x"), (C("x") % 2).cast("long").alias("y"), (16 - i % 3 - C("y") % 3).cast("long").alias("w"), (15 - C("x") % 2 + i % 2).cast("long").alias("h"), F.lit(16).alias("width"), F.lit(16).alias("height"))
    return rounded(op.crop_area_limit(c), "area_share")


_SPN = "flux core nebula morphology centroid flux_sigma structure"
SP = {
    **LP, "sq": "SELECT image_id, quantile_cont(l,0.35) p35, quantile_cont(l,0.7) p70, quantile_cont(l,0.97) p97 FROM lp GROUP BY image_id",
    "sb": "SELECT image_id, any_value(p70) p70, any_value(p97) p97, avg(l) FILTER (l<=p35) b0, avg(l2) FILTER (l<=p35) b1, stddev_pop(l2-l) FILTER (l<=p35) sd FROM lp JOIN sq USING (image_id) GROUP BY image_id",
    "sx": "SELECT image_id, count(*) pixels, sum(f0) f0, sum(f1) f1, sum(f0) FILTER (l>p97) c0, sum(f1) FILTER (l>p97) c1, sum(f0) FILTER (l<=p97) n0, sum(f1) FILTER (l<=p97) n1, corr(l,l2) morphology, stddev_pop(f1-f0) st, any_value(sd) sd, sum(f0*x) x0, sum(f1*x) x1, sum(f0*y) y0, sum(f1*y) y1 FROM (SELECT *, l-b0 AS f0, l2-b1 AS f1 FROM lp JOIN sb USING (image_id) WHERE l>p70) GROUP BY image_id",
    "sp": "SELECT image_id, pixels, f1/greatest(f0,1e-9) flux, c1/greatest(c0,1e-9) core, n1/greatest(n0,1e-9) nebula, morphology, sqrt(pow(x1/f1-x0/f0,2)+pow(y1/f1-y0/f0,2))/16e0 centroid, (f1-f0)/(greatest(sd,1e-9)*sqrt(pixels)) flux_sigma, st/greatest(sd,1e-9) AS structure FROM sx",
}


@query("signal_preservation", with_views("pair", f"SELECT image_id, pixels, {rsel(_SPN)} FROM sp", **SP))
def signal_preservation(spark, d):
    return rounded(op.signal_preservation(lpair(spark, d), 16), *_SPN.split())


@query("sigma_rejection_stack", with_views("frame_stack", f"SELECT y, x, {r6('avg(n)',4)} AS value, any_value(c) AS frames, any_value(c)-count(*) AS rejected FROM (SELECT *, avg(n) OVER w m, stddev_pop(n) OVER w s, count(*) OVER w c FROM nn WINDOW w AS (PARTITION BY y, x)) WHERE n BETWEEN m-2.5e0*s AND m+2.5e0*s GROUP BY y, x",
    **mad_sql("frame_stack", "frame_id", {"v": "v"}, 1), st="SELECT frame_id, v_med AS loc, greatest(v_sigma,1e-9) AS sc FROM meds JOIN sigs USING (frame_id)",
    rf="SELECT median(sc) sm, median(loc) lm FROM st", rg="SELECT any_value(sm) sm, any_value(lm) lm, 1.4826e0*median(abs(sc-sm)) ss FROM st, rf",
    nn="SELECT y, x, (v-loc)/sc*sm+lm AS n FROM frame_stack JOIN st USING (frame_id), rg WHERE abs(sc-sm)<=greatest(ss*2e0,1e-9)"))
def sigma_rejection_stack(spark, d):
    return rounded(op.sigma_rejection_stack(fx.frame_stack(spark, d), 2.5, 2.5, 2.0), "value", digits=4)


@query("before_after_join", with_views("pair", "SELECT image_id, count(*) FILTER (NOT ins) AS outside, coalesce(max(greatest(abs(r2-r),abs(g2-g),abs(b2-b))) FILTER (NOT ins),0) AS max_change, count(*) FILTER (r IS NULL OR r2 IS NULL) AS shape_mismatch, coalesce(max(greatest(abs(r2-r),abs(g2-g),abs(b2-b))) FILTER (NOT ins),0)<=0 AND count(*) FILTER (r IS NULL OR r2 IS NULL)=0 AS identical FROM bj GROUP BY image_id",
    bj="SELECT a.image_id, a.r, a.g, a.b, coalesce(subject>0.05,false) AS ins, CASE WHEN a.image_id%4=0 AND a.x=3 AND a.y=3 THEN NULL WHEN subject>0.05 OR a.image_id%5=0 THEN r2 ELSE r END AS r2, CASE WHEN a.image_id%4=0 AND a.x=3 AND a.y=3 THEN NULL WHEN subject>0.05 OR a.image_id%5=0 THEN g2 ELSE g END AS g2, CASE WHEN a.image_id%4=0 AND a.x=3 AND a.y=3 THEN NULL WHEN subject>0.05 OR a.image_id%5=0 THEN b2 ELSE b END AS b2 FROM pair a"))
def before_after_join(spark, d):
    m = fx.masked(spark, d)
    p = fx.pair(spark, d)
    cand = p.where(~((C("image_id") % 4 == 0) & (C("x") == 3) & (C("y") == 3)))
    use = (C("subject") > 0.05) | (C("image_id") % 5 == 0)
    cand = cand.select("image_id", "y", "x", *[F.when(use, C(f"{c}2")).otherwise(C(c)).alias(c) for c in "rgb"])
    return op.outside_identity(before_after(m, cand), [C("subject") > 0.05])


@query("mutation_union_identity", with_views("pair", "SELECT image_id, count(*) FILTER (NOT ins) AS outside, coalesce(max(ch) FILTER (NOT ins),0) AS max_change, 0::BIGINT AS shape_mismatch, coalesce(max(ch) FILTER (NOT ins),0)<=0 AS identical FROM (SELECT image_id, subject>0.05 OR core>0.5 OR background>0.9 AS ins, CASE WHEN subject>0.05 OR background>0.9-0.1*(image_id%2) THEN greatest(abs(r2-r),abs(g2-g),abs(b2-b)) ELSE 0 END AS ch FROM pair) GROUP BY image_id"))
def mutation_union_identity(spark, d):
    p = fx.pair(spark, d)
    hit = (C("subject") > 0.05) | (C("background") > F.lit(0.9) - F.lit(0.1) * (C("image_id") % 2))
    p = p.withColumns({f"{c}2": F.when(hit, C(f"{c}2")).otherwise(C(c)) for c in "rgb"})
    return op.outside_identity(p, [C("subject") > 0.05, C("core") > 0.5, C("background") > 0.9])


_DNN = "sigma_before sigma_after noise_reduction detail_retention median_drift spread_growth chroma_growth clip_growth"
DN = {
    **DP, "dq": "SELECT image_id, quantile_cont(l,0.005) q0, quantile_cont(l,0.45) q1, quantile_cont(l,0.7) q2, quantile_cont(l,0.97) q3, quantile_cont(l,0.99) q4 FROM dp GROUP BY image_id",
    "dc": "SELECT *, ((r-g)+(b-g))*0.5e0 AS c, ((r2-g2)+(b2-g2))*0.5e0 AS c2 FROM dp JOIN dq USING (image_id)", "e1": blur_sql("dc", "l l2 c c2", 1), "e2": blur_sql("dc", "l l2", 2), "e8": blur_sql("dc", "l l2", 8),
    "dm": "SELECT dc.*, dc.l>=q0 AND dc.l<=q1 AS bg, dc.l>=q2 AND dc.l<=q3 AS sg, dc.l-e1.l n0, dc.l2-e1.l2 n1, dc.c-e1.c k0, dc.c2-e1.c2 k1, abs(e2.l-e8.l) s0, abs(e2.l2-e8.l2) s1 FROM dc JOIN e1 USING (image_id,y,x) JOIN e2 USING (image_id,y,x) JOIN e8 USING (image_id,y,x)",
    "dg": "SELECT * FROM dm WHERE bg", **mad_sql("dg", "image_id", {"n0": "n0", "n1": "n1", "k0": "k0", "k1": "k1"}),
    "dn": f"""SELECT image_id, n0_sigma sigma_before, n1_sigma sigma_after, 1e0-n1_sigma/greatest(n0_sigma,1e-9) noise_reduction, e1/greatest(e0,1e-9) detail_retention, abs(b1-b0) median_drift, r1/greatest(r0,1e-9)-1e0 spread_growth, CASE WHEN k0_sigma<=1e-9 THEN CASE WHEN k1_sigma<=1e-9 THEN 1e0 ELSE 1e9 END ELSE k1_sigma/k0_sigma END chroma_growth, cg clip_growth
      FROM (SELECT image_id, avg(s0) FILTER (sg) e0, avg(s1) FILTER (sg) e1, median(l) FILTER (bg) b0, median(l2) FILTER (bg) b1, avg(CASE WHEN l>=q4 THEN 1 ELSE 0 END) r0, avg(CASE WHEN l2>=q4 THEN 1 ELSE 0 END) r1, avg(({'+'.join(f'({c}2<=0 OR {c}2>=1)::INT' for c in 'rgb')})/3e0)-avg(({'+'.join(f'({c}<=0 OR {c}>=1)::INT' for c in 'rgb')})/3e0) cg FROM dm GROUP BY image_id) JOIN sigs USING (image_id)""",
}


@query("denoise_metrics", with_views("dpair", f"SELECT image_id, {rsel(_DNN)} FROM dn", **DN))
def denoise_metrics(spark, d):
    return rounded(op.denoise_metrics(dpair(spark, d)), *_DNN.split())


_ST = {
    "t0": "SELECT *, r-g AS rg, b-g AS bg FROM dlum", "t1": blur_sql("t0", "l rg bg", 1), "t2": blur_sql("t1", "l rg bg", 2),
    "tq": "SELECT image_id, quantile_cont(l,0.45) q45, quantile_cont(l,0.95) q95 FROM dlum GROUP BY image_id",
    "tn": "SELECT image_id, y, x, l, rg, bg, 0.72e0*(1e0-0.92e0*{w}) AS bl, {lx} AS ln, {rx} AS rn, {bx} AS bn FROM (SELECT t0.image_id, t0.y, t0.x, t0.l, t0.rg, t0.bg, q45, q95, {d} FROM t0 JOIN t1 USING (image_id,y,x) JOIN t2 USING (image_id,y,x) JOIN tq USING (image_id))".format(
        w=cl("(l-q45)/greatest(q95-q45,1e-6)"), d=", ".join(f"t0.{p}-t1.{p} AS {p}1, t1.{p}-t2.{p} AS {p}2, t2.{p} AS {p}s" for p in ("l", "rg", "bg")),
        **{n: f"{p}s" + "".join(f"+sign({p}{i})*greatest(abs({p}{i})-{s}*({k}*0.72e0),0e0)" for i, s in ((1, s1), (2, s2))) for n, p, k, s1, s2 in (("lx", "l", "1.35e0", "0.02e0", "0.01e0"), ("rx", "rg", "1.9e0", "0.03e0", "0.015e0"), ("bx", "bg", "1.9e0", "0.04e0", "0.02e0"))}),
    "tm": "SELECT image_id, y, x, l+(ln-l)*bl AS ll, rg+(rn-rg)*bl AS rr, bg+(bn-bg)*bl AS bb FROM tn",
}


@query("soft_threshold_denoise", with_views("dlum", f"SELECT image_id, y, x, {rsel('gg+rr gg gg+bb','r g b')} FROM (SELECT *, ll-0.2126e0*rr-0.0722e0*bb AS gg FROM tm)", **_ST))
def soft_threshold_denoise(spark, d):
    g = fx.dlum(spark, d)
    sig = g.groupBy("image_id").agg(*[F.lit(v).alias(n) for n, v in (("l_sig_1", 0.02), ("l_sig_2", 0.01), ("rg_sig_1", 0.03), ("rg_sig_2", 0.015), ("bg_sig_1", 0.04), ("bg_sig_2", 0.02))])
    return rounded(op.soft_threshold(g, sig, (1, 2), 0.72), "r", "g", "b")


@query("star_structure_growth", with_views("pair", f"SELECT image_id, count(*) AS pixels, {r6('quantile_cont(abs(d),0.95)')} AS abs_p95, {r6('median(d)')} AS median FROM (SELECT image_id, core, percent_rank() OVER (PARTITION BY image_id ORDER BY l2)-percent_rank() OVER (PARTITION BY image_id ORDER BY l) AS d FROM lp) WHERE core>0.5 GROUP BY image_id", **LP))
def star_structure_growth(spark, d):
    return rounded(op.structure_growth(lpair(spark, d)), "abs_p95", "median")


_BS = {**DP, "z0": "SELECT *, l2-l AS dl, sqrt(pow(r2-r-(l2-l),2)+pow(b2-b-(l2-l),2)) AS dc FROM dp", "z1": blur_sql("z0", "dl dc", 1), "z2": blur_sql("z1", "dl dc", 1), "z3": blur_sql("z2", "dl dc", 1),
       "bs": "SELECT image_id, count(*) FILTER (e) ne, count(*) FILTER (c) nc, quantile_cont(rl,0.95) FILTER (e) le, quantile_cont(rl,0.95) FILTER (c) lc, quantile_cont(rc,0.95) FILTER (e) ce, quantile_cont(rc,0.95) FILTER (c) cc FROM (SELECT z0.image_id, abs(z0.dl-z3.dl) rl, abs(z0.dc-z3.dc) rc, subject>0.05 AND subject<0.8 AS e, subject>=0.8 AS c FROM z0 JOIN z3 USING (image_id,y,x)) GROUP BY image_id"}


@query("boundary_seam", with_views("dpair", f"SELECT image_id, ne AS edge_pixels, nc AS core_pixels, {rsel('le ce le/greatest(lc,1e-9) ce/greatest(cc,1e-9)','luma_edge chroma_edge luma_ratio chroma_ratio')}, CASE WHEN ne<16 OR nc<16 THEN 'unavailable' WHEN (le>0.0035 AND le/greatest(lc,1e-9)>1.6) OR (ce>0.002 AND ce/greatest(cc,1e-9)>1.6) THEN 'seam' ELSE 'ok' END AS status FROM bs", **_BS))
def boundary_seam(spark, d):
    return rounded(op.boundary_seam(dpair(spark, d)), "luma_edge", "chroma_edge", "luma_ratio", "chroma_ratio")


_TB = {**DP, "u0": "SELECT a.image_id, a.y, a.x, abs(a.l2-b.l2) AS step, a.x%8=0 AS seam FROM dp a JOIN dp b ON b.image_id=a.image_id AND b.y=a.y AND b.x=a.x-1 JOIN (SELECT image_id, quantile_cont(l,0.7) p70 FROM dp GROUP BY image_id) q ON q.image_id=a.image_id WHERE a.l<=p70",
       "u1": "SELECT image_id, median(step) FILTER (seam) sp, median(step) FILTER (NOT seam) cp FROM u0 GROUP BY image_id", "u2": "SELECT image_id, 1.4826e0*median(abs(step-cp)) cs FROM u0 JOIN u1 USING (image_id) WHERE NOT seam GROUP BY image_id",
       "u3": "SELECT image_id, avg(step) m FROM u0 GROUP BY image_id, y//4, x//4", "u4": "SELECT image_id, avg(CASE WHEN m>bm*1.35e0 THEN 1 ELSE 0 END) sh FROM u3 JOIN (SELECT image_id, median(m) bm FROM u3 GROUP BY image_id) USING (image_id) GROUP BY image_id"}


@query("tile_border_artifact", with_views("dpair", f"SELECT image_id, {rsel('sp/greatest(cp,1e-9) (sp-cp)/greatest(cs,1e-9) sh','ratio sigma affected_share')}, sp/greatest(cp,1e-9)>1.35 AND (sp-cp)/greatest(cs,1e-9)>3 AS artifact FROM u1 JOIN u2 USING (image_id) JOIN u4 USING (image_id)", **_TB))
def tile_border_artifact(spark, d):
    return rounded(op.tile_border(dpair(spark, d), 8, 4, 1.35), "ratio", "sigma", "affected_share")


@query("dilate_erode", with_views("dmsk", "SELECT d.image_id, d.y, d.x, max(CASE WHEN s.core>0 THEN 1 ELSE 0 END) AS dilated, min(CASE WHEN s.core>0 THEN 1 ELSE 0 END) AS eroded FROM dmsk d JOIN dmsk s ON s.image_id=d.image_id AND abs(s.y-d.y)<=2 AND abs(s.x-d.x)<=2 GROUP BY ALL"))
def dilate_erode(spark, d):
    from ..operators.grid import morph
    g = fx.dmasked(spark, d).withColumn("m", (C("core") > 0).cast("int"))
    return morph(morph(g, {"m": "dilated"}, 2, True), {"m": "eroded"}, 2, False).select("image_id", "y", "x", "dilated", "eroded")
