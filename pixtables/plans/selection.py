"""Queries over evidence, sample selection, searched curves and grouped kernels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pixel import luminance
from ..operators import background as bg
from ..operators import colour as col
from ..operators import evidence as ev
from ..operators import sampling
from ..operators import selection as op
from ..operators.quantiles import quantiles
from ..session import broadcast_nothing
from ..sources import fixtures as fx
from .background import _PTS, patch_ctes, plane_ctes, pts
from .colour import _CV, _PTS as CURVE, K3, rsel
from .noise import mad_sql, rounded
from .pairs import DP, dpair
from .registry import blur_sql, cl, lum3, query, r6, with_views

C = F.col


def evidence_rows(spark, d):
    i = C("frame_id")
    b = lambda k, r: F.when(i % k == r, F.lit(True))
    return fx.frames(spark, d).select(
        "frame_id", F.when(i % 23 == 0, "light_preprocess").otherwise("single").alias("mode"), F.when(i % 29 == 0, "nonlinear").alias("verified_state"),
        F.when(i % 5 == 0, i % 2 == 0).alias("linear_flag"), F.when(i % 7 == 0, i % 3 == 0).alias("stretched_flag"), b(31, 0).alias("nonlinear_flag"), F.when(i % 11 == 0, "None").when(i % 13 == 0, "asinh").alias("stretch"),
        b(17, 0).alias("says_stretched"), b(19, 0).alias("says_linear"), (i % 4 == 1).alias("acquisition_linear"), ((i % 10) / 100.0).alias("p50"), ((C("bytes") % 100) / 100.0).alias("p99"), ((i % 6) / 100.0).alias("black_ratio"), F.lit(0.001).alias("highlight_ratio"))


_IS = """SELECT frame_id, CASE WHEN md THEN 'linear' WHEN vs THEN 'nonlinear' WHEN cf<>'' THEN 'unknown' WHEN n THEN 'nonlinear' WHEN l THEN 'linear' WHEN a THEN 'linear' WHEN b THEN 'nonlinear' WHEN dm THEN 'linear' ELSE 'unknown' END AS state, CASE WHEN md THEN 1e0 WHEN vs THEN 0.99e0 WHEN cf<>'' THEN 0.2e0 WHEN n OR l THEN 0.96e0 WHEN a THEN 0.88e0 WHEN b THEN 0.8e0 WHEN dm THEN 0.68e0 ELSE 0e0 END AS confidence,
  CASE WHEN md THEN 'current_run_light_stack' WHEN vs THEN 'verified_manifest' WHEN cf<>'' THEN 'conflicting_evidence' WHEN n OR l THEN 'fits_processing_metadata' WHEN a THEN 'acquisition_metadata' WHEN b OR dm THEN 'pixel_distribution' ELSE 'insufficient_evidence' END AS source, CASE WHEN NOT md AND NOT vs THEN cf ELSE '' END AS conflicts FROM (SELECT *, concat_ws(',', CASE WHEN l AND n THEN 'header_both_claims' END, CASE WHEN l AND b THEN 'linear_header_bright_pixels' END, CASE WHEN n AND a THEN 'stretch_history_raw_keys' END, CASE WHEN a AND b AND NOT l THEN 'raw_keys_bright_pixels' END) AS cf FROM (
  SELECT frame_id, frame_id%23=0 md, frame_id%29=0 vs, (frame_id%5=0 AND frame_id%2=0) OR (frame_id%7=0 AND frame_id%3<>0) OR frame_id%11=0 OR frame_id%19=0 AS l, (frame_id%5=0 AND frame_id%2<>0) OR (frame_id%7=0 AND frame_id%3=0) OR frame_id%31=0 OR (frame_id%13=0 AND frame_id%11<>0) OR frame_id%17=0 AS n, frame_id%4=1 AS a,
   (p50>=0.075 AND p99>=0.3) OR (p50>=0.035 AND br>=0.025) AS b, p50<=0.03 AND p99<=0.55 AND NOT ((p50>=0.075 AND p99>=0.3) OR (p50>=0.035 AND br>=0.025)) AS dm FROM (SELECT frame_id, (frame_id%10)/100e0 p50, (bytes%100)/100e0 p99, (frame_id%6)/100e0 br FROM frames)))"""


@query("input_state", with_views("frames", _IS))
def input_state(spark, d):
    return ev.input_state(evidence_rows(spark, d))


@query("channel_semantics", with_views("frames", """SELECT frame_id, CASE ch WHEN 1 THEN 'mono' WHEN 3 THEN 'rgb' WHEN 4 THEN 'multichannel' ELSE 'unknown' END AS layout, CASE WHEN ch=0 THEN 'unknown' WHEN nb THEN 'narrowband' ELSE 'broadband' END AS spectral, CASE WHEN ch=3 AND nb THEN 'composite' WHEN ch=1 THEN 'single' WHEN ch=3 THEN 'osc_or_rgb' ELSE 'unknown' END AS composition, state AS transfer,
  CASE WHEN ch=1 THEN 'mono' WHEN ch>3 THEN 'unknown' WHEN state='nonlinear' THEN 'nonlinear_color' WHEN ch<3 OR state<>'linear' THEN 'unknown' WHEN nb THEN 'narrowband_composite' ELSE 'broadband_rgb_osc' END AS kind, CASE WHEN ch=1 THEN 'skip_color_calibration' WHEN ch>3 THEN 'preserve_input_review' WHEN state='nonlinear' THEN 'preserve_input' WHEN ch<3 OR state<>'linear' THEN 'preserve_input_review' WHEN nb THEN 'narrowband_calibration' ELSE 'broadband_calibration' END AS action,
  concat_ws(',', CASE WHEN ch>3 THEN 'multichannel_layout_requires_explicit_channel_roles' END, CASE WHEN ch IN (0,2) THEN 'unsupported_or_unknown_channel_layout' END, CASE WHEN state='unknown' THEN 'transfer_state_unconfirmed' END) AS unsupported FROM (SELECT s.frame_id, CAST(CASE WHEN s.frame_id%3=0 THEN s.frame_id%5 ELSE 3 END AS INT) AS ch, filter='Ha OIII' AS nb, state FROM st s JOIN frames f ON f.frame_id=s.frame_id)""", st=_IS))
def channel_semantics(spark, d):
    s = ev.input_state(evidence_rows(spark, d)).select("frame_id", "state")
    i = C("frame_id")
    f = fx.frames(spark, d).join(s, "frame_id").select("frame_id", "state", F.when(i % 3 == 0, i % 5).otherwise(3).cast("int").alias("channels"), (C("filter") == "Ha OIII").alias("narrowband"))
    return ev.channel_semantics(f)


_DV = """SELECT frame_id, q AS quantity, s AS source, p AS priority, c AS confidence, v AS value FROM pointing, LATERAL (VALUES ('focal','header',2,0.9e0,250e0+(frame_id%3)*10),('focal','profile',CASE WHEN frame_id%4=0 THEN 3 ELSE 1 END,0.95e0,250e0),('focal','wcs',1,CASE WHEN frame_id%2=0 THEN 0.4e0 ELSE 0.7e0 END,250e0+(frame_id%7)*4),('pixel','header',2,0.92e0,2.9e0),('pixel','profile',2,0.92e0,2.9e0+(frame_id%2)*0.01)) t(q,s,p,c,v)"""


@query("device_evidence", with_views("pointing", f"SELECT frame_id, quantity, source, {r6('value')} AS value, confidence, candidates, conflict, NOT conflict AND confidence>=0.9 AS applied FROM (SELECT b.*, n AS candidates, coalesce(abs(hi-value)>abs(value)*0.05e0 OR abs(lo-value)>abs(value)*0.05e0,false) AS conflict FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, quantity ORDER BY priority DESC, confidence DESC, value, source DESC) rn FROM dv) b JOIN (SELECT frame_id, quantity, count(*) n, max(value) FILTER (confidence>=0.5) hi, min(value) FILTER (confidence>=0.5) lo FROM dv GROUP BY ALL) g ON g.frame_id=b.frame_id AND g.quantity=b.quantity WHERE rn=1)", dv=_DV))
def device_evidence(spark, d):
    i = C("frame_id")
    row = lambda q, s, p, c, v: F.struct(F.lit(q).alias("quantity"), F.lit(s).alias("source"), p.alias("priority"), c.alias("confidence"), v.cast("double").alias("value"))
    L = F.lit
    vals = F.array(row("focal", "header", L(2), L(0.9), L(250.0) + (i % 3) * 10), row("focal", "profile", F.when(i % 4 == 0, 3).otherwise(1), L(0.95), L(250.0)), row("focal", "wcs", L(1), F.when(i % 2 == 0, 0.4).otherwise(L(0.7)), L(250.0) + (i % 7) * 4),
                   row("pixel", "header", L(2), L(0.92), L(2.9)), row("pixel", "profile", L(2), L(0.92), L(2.9) + (i % 2) * 0.01))
    v = fx.pointing(spark, d).select("frame_id", F.explode(vals).alias("v")).select("frame_id", "v.*")
    return rounded(ev.device_evidence(v), "value")


_DN = ["Seestar S50", "SEESTAR-S30 tele", "Dwarf III", "Seestar S50 Wide-Angle", "Newton 200", "Vespera Pro", "ZWO Seestar S30 Pro", "dwarf mini", "DWARF 2", "S50", "my s50", "S30 x Pro"]


@query("device_profile_match", with_views("frames", "SELECT frame_id, list_extract(['seestar_s50_imx462','seestar_s30_imx662','dwarflab_dwarf_3_imx678',NULL,NULL,NULL,'seestar_s30_pro_imx585','dwarflab_dwarf_mini_imx662','dwarflab_dwarf_2_imx415','seestar_s50_imx462'], k) AS profile, list_extract([250e0,150e0,150e0,NULL,NULL,NULL,160e0,150e0,100e0,250e0], k) AS focal_mm, list_extract([2.9e0,2.9e0,2e0,NULL,NULL,NULL,2.9e0,2.9e0,1.45e0,2.9e0], k) AS pixel_um FROM (SELECT frame_id, CAST(frame_id%12+1 AS INT) AS k FROM frames WHERE frame_id%12 NOT IN (3,4,5,10,11) AND frame_id%7<>0)"))
def device_profile_match(spark, d):
    i = C("frame_id")
    f = fx.frames(spark, d).select("frame_id", F.element_at(F.array(*[F.lit(x) for x in _DN]), (i % 12 + 1).cast("int")).alias("identity"), F.when(i % 7 == 0, 12.0).otherwise(F.lit(250.0)).alias("focal"))
    return ev.device_profile_match(f)


def star_rows(spark, d):
    """Pixels of each image as star records."""
    p = fx.px(spark, d)
    y, x = C("y"), C("x")
    return p.select("image_id", (y * 16 + x).alias("star_id"), x.cast("double").alias("x"), y.cast("double").alias("y"), (F.floor(y / 8) * 2 + F.floor(x / 8)).cast("int").alias("quadrant"),
                    (C("b") / 10).alias("saturation_fraction"), (F.lit(1.0) + C("g") / 5).alias("aspect_ratio"), C("r").alias("compactness"))


@query("star_record_selection")
def star_record_selection(spark, d):
    return op.star_record_selection(star_rows(spark, d), 32)


@query("farthest_point_split")
def farthest_point_split(spark, d):
    s = op.star_record_selection(star_rows(spark, d), 48)
    return op.farthest_point_split(s.withColumnRenamed("star_id", "point_id"))


@query("safe_sample_selection", with_views("points dlum", f"""SELECT image_id, point_id, cell, quadrant, {r6('score')} AS score, cells, quadrants, samples, CASE WHEN samples>=4 AND quadrants>=3 THEN 'ready' ELSE 'insufficient' END AS status FROM ss JOIN (SELECT image_id, count(DISTINCT cell) cells, count(DISTINCT quadrant) quadrants, count(*) samples FROM ss GROUP BY image_id) USING (image_id)""",
  pt="SELECT * FROM points", **patch_ctes(2),
  ss="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cell ORDER BY score, point_id) rn FROM (SELECT image_id, point_id, CAST((py*4//16)*4+px*4//16 AS INT) AS cell, CAST((py*2//16)*2+px*2//16 AS INT) AS quadrant, median-lo_+mad*2e0 AS score FROM pst JOIN (SELECT image_id, quantile_cont(median,0.6) bq, quantile_cont(mad,0.7) tq, min(median) lo_ FROM pst GROUP BY image_id) USING (image_id) WHERE median<=bq AND mad<=tq)) WHERE rn<=1"))
def safe_sample_selection(spark, d):
    p = bg.patch_stats(bg.patch_join(fx.points(spark, d), fx.dlum(spark, d), 2), 2)
    return rounded(op.safe_samples(p, 16), "score")


@query("asinh_anchor_stretch")
def asinh_anchor_stretch(spark, d):
    return op.asinh_anchor_stretch(fx.px(spark, d), 0.9, 0.1)


@query("ghs_and_masked_mtf_curves")
def ghs_and_masked_mtf_curves(spark, d):
    prof = quantiles(fx.lum(spark, d), ["image_id"], [(C("l"), {"black": 0.01, "p50": 0.5})])
    return op.masked_mtf_curves(prof.select("image_id", "black", "p50"), 0.25)


@query("peak_catalog")
def peak_catalog(spark, d):
    return op.peak_catalog(fx.dlum(spark, d))


@query("galaxy_ellipse")
def galaxy_ellipse(spark, d):
    return op.galaxy_ellipse(fx.dlum(spark, d))


@query("bright_core_roi", with_views("dpair", f"SELECT image_id, support, support>=2 AS available, {r6('o/greatest(support,1)::DOUBLE')} AS overshoot_share, {r6('lr')} AS level_ratio, holes, support>=2 AND (o/greatest(support,1)::DOUBLE>0.35 OR holes>0) AS hard_failed FROM (SELECT image_id, count(*) FILTER (roi) support, count(*) FILTER (roi AND (r2-r>0.01 OR g2-g>0.01 OR b2-b>0.01)) o, avg(l2) FILTER (roi)/greatest(avg(l) FILTER (roi),1e-9) lr, count(*) FILTER (roi AND l2<l*0.5e0) holes FROM (SELECT dp.*, f4.l>=t AND coalesce(ex,0)=0 AS roi FROM dp JOIN f4 USING (image_id,y,x) JOIN (SELECT image_id, quantile_cont(l,0.9) t FROM f4 GROUP BY image_id) USING (image_id) LEFT JOIN ex USING (image_id,y,x)) GROUP BY image_id)",
    **DP, f1=blur_sql("dp", "l", 1), f2=blur_sql("f1", "l", 1), f3=blur_sql("f2", "l", 1), f4=blur_sql("f3", "l", 1), ex="SELECT DISTINCT d.image_id, d.y, d.x, 1 AS ex FROM dp d JOIN dp s ON s.image_id=d.image_id AND abs(s.y-d.y)<=1 AND abs(s.x-d.x)<=1 AND s.core>0 AND s.r>0.97"))
def bright_core_roi(spark, d):
    return rounded(op.bright_core_roi(dpair(spark, d), (C("core") > 0) & (C("r") > 0.97), q=0.9), "overshoot_share", "level_ratio")


_AR = {
    "a1": "SELECT *, " + ", ".join(f"{c}*(1e0-subject*0.6e0)+{c}*(({_CV})/greatest(l,1e-7))*(subject*0.6e0) AS {c}1" for c in "rgb") + " FROM msk",
    "a2": "SELECT *, " + ", ".join(f"{cl(f'{lum3(str(1))}+({c}1-{lum3(str(1))})*(1e0-0.4e0*background)')} AS {c}9" for c in "rgb") + " FROM a1",
    "a3": f"SELECT image_id, avg(CASE WHEN greatest(r9,g9,b9)>=1 THEN 1 ELSE 0 END-CASE WHEN greatest(r,g,b)>=1 THEN 1 ELSE 0 END)<=0.03 AND abs(median({lum3('9')})-median(l))<=0.0005 AS ok FROM a2 GROUP BY image_id",
}


@query("adjustment_recipe", with_views("msk", f"SELECT image_id, y, x, {', '.join(f'{r6(f"CASE WHEN ok THEN {c}9 ELSE {c} END")} AS {c}' for c in 'rgb')}, ok AS accepted FROM a2 JOIN a3 USING (image_id)", **_AR))
def adjustment_recipe(spark, d):
    steps = [lambda p: col.curve_masked(p, CURVE, 0.6), lambda p: col.chroma_rescue(p, F.lit(1.0) - F.lit(0.4) * C("background"))]
    return rounded(op.adjustment_recipe(fx.masked(spark, d), steps, 0.03, 0.0005), "r", "g", "b")


_OS = {
    "q0": "SELECT p.image_id, p.point_id, p.split, p.y AS py, p.x AS px, median(d.r-d.g+0.3e0*(p.x/15e0-0.5e0)*(p.image_id%3)) AS rg, median(d.b-d.g) AS bg FROM points p JOIN dlum d ON d.image_id=p.image_id AND d.y BETWEEN p.y-1 AND p.y+1 AND d.x BETWEEN p.x-1 AND p.x+1 GROUP BY p.image_id, p.point_id, p.split, p.y, p.x",
    "qf": "SELECT * FROM q0 WHERE split='fit'",
    **{k: v for c in ("rg", "bg") for k, v in {**plane_ctes("qf", "image_id", "px/15e0-0.5e0", "py/15e0-0.5e0", c, c),
       f"{c}h": f"SELECT image_id, corr(p, v) r, stddev_pop(v) s0, stddev_pop(v-p) s1 FROM (SELECT q.image_id, q.{c} AS v, f.bx*(px/15e0-0.5e0)+f.by_*(py/15e0-0.5e0) AS p FROM q0 q JOIN {c}pl f ON f.image_id=q.image_id WHERE split='validation') GROUP BY image_id",
       f"{c}s": f"SELECT f.image_id, coalesce(sigma>3 AND r>=0.7 AND s1<=s0*0.85e0, false) AS ok, bx, by_ FROM {c}pl f LEFT JOIN {c}h h ON h.image_id=f.image_id"}.items()},
    "od": "SELECT d.image_id, d.y, d.x, d.r, d.g, d.b, a.ok AS ao, b2.ok AS bo, CASE WHEN a.ok THEN a.bx*(d.x/15e0-0.5e0)+a.by_*(d.y/15e0-0.5e0) ELSE 0e0 END AS drg, CASE WHEN b2.ok THEN b2.bx*(d.x/15e0-0.5e0)+b2.by_*(d.y/15e0-0.5e0) ELSE 0e0 END AS dbg FROM dlum d JOIN rgs a ON a.image_id=d.image_id JOIN bgs b2 ON b2.image_id=d.image_id",
}


@query("opponent_slope_projection", with_views("points dlum", f"SELECT image_id, y, x, {rsel('r-drg+dg g+dg b-dbg+dg','r g b')}, ao AS rg_selected, bo AS bg_selected FROM (SELECT *, 0.2126e0*drg+0.0722e0*dbg AS dg FROM od)", **_OS))
def opponent_slope_projection(spark, d):
    g = fx.dlum(spark, d)
    pp = bg.patch_join(fx.points(spark, d), g, 1)
    tilt = F.lit(0.3) * (C("px") / 15.0 - 0.5) * (C("image_id") % 3)
    k = ["image_id", "point_id", "split", "py", "px"]
    m = quantiles(pp, k, [(C("r") - C("g") + tilt, {"rg": 0.5}), (C("b") - C("g"), {"bg": 0.5})], whole=True)
    return rounded(op.opponent_slope(m, g, 16), "r", "g", "b")


@query("grouped_kernels", with_views("lum", f"SELECT image_id, {r6('l_sigma')} AS sigma, 3::BIGINT AS segments FROM sigs", **mad_sql("lum", "image_id", {"l": "l"})))
def grouped_kernels(spark, d):
    op.register_functions(spark)
    fx.lum(spark, d).createOrReplaceTempView("pixtables_lum")
    s = spark.sql("SELECT image_id, robust_sigma(l) AS sigma FROM pixtables_lum GROUP BY image_id")
    seg = spark.sql("SELECT count(*) AS segments, 1 AS one FROM curve_segments(array(0D, 0.3D, 0.7D, 1D), array(0D, 0.2D, 0.8D, 1D))")
    return rounded(s.withColumn("one", F.lit(1)).join(seg, "one").drop("one"), "sigma")


@query("safe_background_samples")
def safe_background_samples(spark, d):
    # images of 16 x 16 pixels: patches of 2 pixels to each side, and as few samples as the rule allows
    pix = fx.dlum(broadcast_nothing(spark), d)
    chosen, report = sampling.safe_background_samples(pix, target=16, least=12, radius=2, least_radius=2)
    # each image has a row, those without a sample too
    out = report.withColumnRenamed("refined", "may_walk").join(chosen, "image_id", "left")
    return rounded(out, "median", "texture", "star_excess", "residual", "risk", "x_span", "y_span", "usable_sky", "source_share", "star_share", "low_limit", "bright_limit", "residual_low", "residual_high", "texture_limit", "star_limit")
