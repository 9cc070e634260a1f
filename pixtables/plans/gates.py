"""Queries over quality gates and verdicts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as px
from ..functions.pixel import luminance
from ..operators import background as bg
from ..operators import gates as op
from ..operators import pairs as pr
from ..operators.gates import Limit
from ..operators.quantiles import quantiles, with_quantiles
from ..sources import fixtures as fx
from .background import BQ, MODEL, _PTS, held_cte, patch_ctes, plane_ctes, pts, spatial_ctes
from .colour import rsel
from .noise import rounded
from .pairs import DN, DP, LP, RD, SP, _SAT, dpair, lpair, shown_as
from .registry import blur_sql, cl, lum3, query, r6, with_views

C = F.col


def gate_sql(src: str, limits: list[tuple[str, str, str, str, bool]], key: str = "image_id") -> str:
    """SQL twin of gates.verdict: (name, metric, op, limit, hard)."""
    f = lambda hard: "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({m} {o} {v}, false) THEN '{n}' END" for n, m, o, v, h in limits if h == hard) + ")"
    hard, soft = f(True), f(False) if any(not l[4] for l in limits) else "''"
    return f"SELECT {key}, CASE WHEN {hard}<>'' THEN 'rejected' WHEN {soft}<>'' THEN 'warning' ELSE 'accepted' END AS status, {hard} AS hard_issues, {soft} AS warnings FROM {src}"


def limits_of(spec: list[tuple[str, str, str, str, bool]]) -> list[Limit]:
    return [Limit(n, m, o, F.expr(v.replace("e0", "D").replace("eps", "1e-6D")) if not v.replace(".", "").replace("e0", "").replace("-", "").isdigit() else float(v.replace("e0", "")), h) for n, m, o, v, h in spec]


PROFILE = "CASE image_id%3 WHEN 0 THEN 'output_first' WHEN 1 THEN 'balanced' ELSE 'strict' END"


def profile():
    i = C("image_id") % 3
    return F.when(i == 0, "output_first").when(i == 1, "balanced").otherwise("strict")


_LIM = lambda n: "CASE profile WHEN 'strict' THEN {2!r}::DOUBLE WHEN 'balanced' THEN {1!r}::DOUBLE ELSE {0!r}::DOUBLE END".format(*op.BACKGROUND[n])


def graded(src: str, warn: list[tuple[str, str]], hard: list[tuple[str, str]]) -> str:
    j = lambda xs: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in xs) + ")"
    return (f"SELECT image_id, profile, CASE WHEN CASE WHEN profile='strict' THEN wn<>'' ELSE hd<>'' END THEN 'hard_rejected' WHEN wn<>'' THEN 'warning' ELSE 'normal' END AS severity, CASE WHEN profile='strict' THEN wn ELSE hd END AS hard_issues, CASE WHEN profile='strict' THEN '' ELSE wn END AS warnings "
            f"FROM (SELECT *, {j(warn)} AS wn, {j(hard)} AS hd FROM {src})")


@query("denoise_gate", with_views("dpair", "SELECT image_id, CASE WHEN bad='' AND NOT q THEN 'accepted' WHEN q THEN 'skipped_low_noise' ELSE 'rejected' END AS status, bad AS issues FROM (SELECT image_id, sigma_before<=1e-5 AS q, concat_ws(',', CASE WHEN NOT clip_growth<=0.001 THEN 'clip_growth' END, CASE WHEN NOT median_drift<=0.003 THEN 'background_median_drift' END, CASE WHEN NOT detail_retention>=0.9 THEN 'signal_detail_retention' END, "
       "CASE WHEN NOT spread_growth<=0.03 THEN 'bright_spread_growth' END, CASE WHEN NOT chroma_growth<=1.05 THEN 'background_chroma_noise_growth' END, CASE WHEN NOT sigma_before<=1e-5 AND noise_reduction<0.12 THEN 'insufficient_noise_reduction' END) AS bad FROM dn)", **DN))
def denoise_gate(spark, d):
    return op.denoise_gate(pr.denoise_metrics(dpair(spark, d)), ["image_id"])


def heldouts(spark, d):
    g = fx.dlum(spark, d)
    h = lambda t: bg.heldout(bg.patch_stats(bg.patch_join(pts(spark, d), t, 2), 2))
    c = fx.with_candidate(g, 3)
    after = c.select("image_id", "y", "x", luminance(C("r2"), C("g2"), C("b2")).alias("l"))
    pick = lambda t, n: t.select("image_id", C("robust_span").alias(f"span{n}"), C("patch_mad_median").alias(f"noise{n}"), C("span_se").alias(f"se{n}"))
    return pick(h(g), 0).join(pick(h(after), 1), "image_id")


_C3 = "SELECT image_id, y, x, r, g, b, {l} AS l FROM (SELECT image_id, y, x, r*(1e0-0.1e0*3)+0.02e0*3 AS r, g*(1e0-0.05e0*3) AS g, b*(1e0-0.1e0*3)+0.01e0*x*3/16 AS b FROM dense)".format(l=lum3())
_HB = {"pt": _PTS, "c3": _C3, **patch_ctes(2, p="a"), "ah": held_cte("a"), **patch_ctes(2, src="c3", p="b"), "bh": held_cte("b"),
       "hb": f"SELECT ah.image_id, {PROFILE.replace('image_id', 'ah.image_id')} AS profile, ah.span s0, bh.span s1, ah.pmm n0, bh.pmm n1, greatest(3e0*sqrt(ah.se*ah.se+bh.se*bh.se),1e-12) AS t FROM ah JOIN bh ON bh.image_id=ah.image_id"}
_U = "greatest(t/3e0,1e-12)"


@query("background_gate", with_views("points dlum", graded("hb", [("span_worsened", "NOT s1<=s0+t"), ("improvement_below_uncertainty", "NOT s0-s1>t"), ("rms_increased", "NOT n1<=n0+t")],
       [("span_excessive", f"s1/greatest(s0,1e-12)>{_LIM('span_ratio')} AND greatest(0e0,s1-s0)/{_U}>{_LIM('hard_sigma')}"), ("rms_excessive", f"n1/greatest(n0,1e-12)>{_LIM('rms_ratio')} AND greatest(0e0,n1-n0)/{_U}>{_LIM('hard_sigma')}")]), **_HB))
def background_gate(spark, d):
    return op.background_gate(heldouts(spark, d).withColumn("profile", profile()), ["image_id"])


@query("noop_proof", with_views("points dlum pair", "SELECT hb.image_id, s0-s1<=t AS no_gain, mx=0 AS identical, s0-s1<=t AND mx=0 AS proven FROM hb JOIN (SELECT image_id, max(CASE WHEN image_id%2=0 THEN 0 ELSE greatest(abs(r2-r),abs(g2-g),abs(b2-b)) END) mx FROM pair GROUP BY image_id) m ON m.image_id=hb.image_id", **_HB))
def noop_proof(spark, d):
    h = heldouts(spark, d)
    t = F.greatest(F.lit(3.0) * F.sqrt(C("se0") * C("se0") + C("se1") * C("se1")), F.lit(1e-12))
    gain = h.groupBy("image_id").agg(F.bool_and(C("span0") - C("span1") <= t).alias("no_gain"))
    ch = F.greatest(*[F.abs(C(f"{c}2") - C(c)) for c in "rgb"])
    ident = fx.pair(spark, d).groupBy("image_id").agg((F.max(F.when(C("image_id") % 2 == 0, F.lit(0.0)).otherwise(ch)) == 0).alias("identical"))
    return gain.join(ident, "image_id").withColumn("proven", C("no_gain") & C("identical"))




@query("fidelity_gate", with_views("pair", graded(f"(SELECT *, {PROFILE} AS profile FROM fd)", [
    ("flux_sigma_unavailable", "flux_sigma IS NULL"), ("flux_unavailable", "flux IS NULL"), ("flux_loss", "flux_sigma< -3"), ("flux_growth", "flux_sigma>3 AND profile<>'strict'"),
    ("flux_range", f"profile<>'strict' AND (flux<{_LIM('flux_soft_min')} OR flux>{_LIM('flux_soft_max')})"), ("morphology_unavailable", "morphology IS NULL"), ("morphology_low", f"profile<>'strict' AND morphology<{_LIM('morph_soft')}"),
    ("structure_unavailable", "structure IS NULL"), ("structure_introduced", "structure>3"), ("centroid_unavailable", "profile<>'strict' AND centroid IS NULL"), ("centroid_elevated", f"profile<>'strict' AND centroid>{_LIM('centroid_soft')}")],
    [("flux_loss_excessive", f"flux<{_LIM('flux_hard_min')} AND flux_sigma< -{_LIM('hard_sigma').replace('CASE', '(CASE') + ')'}"), ("flux_growth_excessive", f"flux>{_LIM('flux_hard_max')} AND flux_sigma>{_LIM('hard_sigma')}"), ("morphology_excessive", f"morphology<{_LIM('morph_hard')}"),
     ("structure_excessive", f"structure>{_LIM('structure_hard')}"), ("centroid_excessive", f"centroid>{_LIM('centroid_hard')}")]), **SP,
    fd="SELECT image_id, flux, CASE WHEN image_id%13<>0 THEN flux_sigma/(1+image_id%9) END AS flux_sigma, morphology, CASE WHEN image_id%17<>0 THEN centroid END AS centroid, structure FROM sp"))
def fidelity_gate(spark, d):
    m = pr.signal_preservation(lpair(spark, d), 16)
    i = C("image_id")
    m = m.withColumns({"flux_sigma": F.when(i % 13 != 0, C("flux_sigma") / (1 + i % 9)), "centroid": F.when(i % 17 != 0, C("centroid")), "profile": profile()})
    return op.fidelity_gate(m, ["image_id"])


@query("pattern_gate", with_views("msk", graded(f"(SELECT *, {PROFILE} AS profile FROM pg)", [("pattern_worsened", "(s1>=0.55 AND NOT s0>=0.55) OR (s1-s0>0.12 AND s1>=0.55)")], [("pattern_excessive", f"s1>{_LIM('pattern_score')} AND s1-s0>{_LIM('pattern_growth')}")]),
    pg="SELECT image_id, least(max(l),1e0)*0.7e0 AS s0, least(max(l)*(0.6e0+0.1e0*(image_id%7)),1e0) AS s1 FROM msk GROUP BY image_id"))
def pattern_gate(spark, d):
    m = fx.masked(spark, d).groupBy("image_id").agg(F.max("l").alias("m"))
    m = m.select("image_id", (F.least("m", F.lit(1.0)) * 0.7).alias("score0"), F.least(C("m") * (F.lit(0.6) + F.lit(0.1) * (C("image_id") % 7)), F.lit(1.0)).alias("score1"))
    return op.pattern_gate(m.withColumns({"found0": C("score0") >= 0.55, "found1": C("score1") >= 0.55, "profile": profile()}), ["image_id"])


_DG = {**LP, **plane_ctes("lp", "image_id", "x/15e0", "y/15e0", "l", "a"), **plane_ctes("lp", "image_id", "x/15e0", "y/15e0", "l3", "b")}
_DG["lp"] = f"SELECT *, l+(0.02e0*(image_id%5))*x/15e0-(0.03e0*(image_id%4))*y/15e0 AS l3 FROM pair"
_SE = lambda a: f"{a}.ux*sqrt({a}.rss/greatest({a}.n-3,1)) ex, {a}.uy*sqrt({a}.rss/greatest({a}.n-3,1)) ey, {a}.bx gx, {a}.by_ gy"


@query("direction_gate", with_views("pair", """SELECT image_id, iss='' AS accepted, iss AS issues FROM (SELECT a.image_id, concat_ws(',', CASE WHEN a.gx*b.gx<0 AND abs(a.gx)>a.ex*1.5e0 AND abs(b.gx)>b.ex*1.5e0 THEN 'x_reversed' END, CASE WHEN a.gy*b.gy<0 AND abs(a.gy)>a.ey*1.5e0 AND abs(b.gy)>b.ey*1.5e0 THEN 'y_reversed' END,
  CASE WHEN a.gx*b.gx+a.gy*b.gy<0 AND sqrt(a.gx*a.gx+a.gy*a.gy)>sqrt(a.ex*a.ex+a.ey*a.ey)*1.5e0 AND sqrt(b.gx*b.gx+b.gy*b.gy)>sqrt(b.ex*b.ex+b.ey*b.ey)*1.5e0 THEN 'direction_reversed' END) AS iss FROM ga a JOIN gb b ON b.image_id=a.image_id)""",
  **_DG, ga=f"SELECT image_id, {_SE('apl')} FROM apl", gb=f"SELECT image_id, {_SE('bpl')} FROM bpl"))
def direction_gate(spark, d):
    i = C("image_id")
    p = fx.masked(spark, d).withColumn("l3", C("l") + (F.lit(0.02) * (i % 5)) * C("x") / 15.0 - (F.lit(0.03) * (i % 4)) * C("y") / 15.0)
    f = lambda v, n: bg.plane_fit(p, ["image_id"], C("x") / 15.0, C("y") / 15.0, C(v)).select(
        "image_id", C("slope_x").alias(f"gx{n}"), C("slope_y").alias(f"gy{n}"), *[(C(f"unit_{a}") * F.sqrt(C("rss") / F.greatest(C("samples") - 3, F.lit(1)))).alias(f"e{a}{n}") for a in "xy"])
    return op.direction_gate(f("l", 0).join(f("l3", 1), "image_id"), ["image_id"], sigma=1.5)


@query("spatial_chroma_gate", with_views("points dlum", """SELECT a.image_id, a.component, CASE WHEN b.sigma>3 AND NOT a.sigma>3 AND b.span>0.002 THEN 'new_component' WHEN b.sigma>3 AND a.sigma>3 AND b.span>1.25*a.span THEN 'slope_growth' ELSE 'ok' END AS status,
  NOT ((b.sigma>3 AND NOT a.sigma>3 AND b.span>0.002) OR (b.sigma>3 AND a.sigma>3 AND b.span>1.25*a.span)) AS accepted FROM apl a JOIN bpl b ON b.image_id=a.image_id AND b.component=a.component""", pt=_PTS, c3=_C3, **spatial_ctes("dlum", "a"), **spatial_ctes("c3", "b")))
def spatial_chroma_gate(spark, d):
    g = fx.dlum(spark, d)
    c = fx.with_candidate(g, 3).select("image_id", "y", "x", C("r2").alias("r"), C("g2").alias("g"), C("b2").alias("b"), luminance(C("r2"), C("g2"), C("b2")).alias("l"))
    f = lambda t, n: bg.spatial_planes(pts(spark, d), t, 2, 16).select("image_id", "component", C("sigma").alias(f"sigma{n}"), C("span").alias(f"span{n}"))
    return op.spatial_chroma_gate(f(g, 0).join(f(c, 1), ["image_id", "component"]), ["image_id", "component"])


@query("background_authorisation", with_views("points dlum", """SELECT image_id, CASE WHEN NOT sr THEN 'target_signal_or_sky_limited' WHEN pat AND NOT varies THEN 'directional_pattern_or_walking_noise' WHEN radial THEN 'radial_low_frequency_gradient_ambiguous' WHEN varies THEN 'additive_low_frequency_gradient' ELSE 'no_measurable_low_frequency_gradient' END AS mechanism,
  CASE WHEN NOT sr THEN 'preserve_and_review' WHEN pat AND NOT varies THEN 'defer_to_calibration_or_stacking' WHEN radial THEN 'subtract_with_master_flat_advisory' WHEN varies THEN 'subtract' ELSE 'preserve' END AS mode, CASE WHEN pat AND varies THEN 'mixed' WHEN pat THEN 'pattern' WHEN varies OR radial THEN 'gradient' ELSE 'none' END AS route, hb AS hard_blocks,
  image_id%4=0 OR sf<0.5 AS low_complexity, sr AND NOT (pat AND NOT varies) AND (radial OR varies) AND hb='' AS should_evaluate FROM (SELECT *, concat_ws(',', CASE WHEN NOT lin THEN 'input_linearity_not_confirmed' END, CASE WHEN NOT sr THEN 'insufficient_source_masked_true_sky_support' END, CASE WHEN sr AND pat AND NOT varies THEN 'directional_noise_is_not_a_sky_gradient' END) AS hb
  FROM (SELECT mc.image_id, varies, radial, image_id%3=0 AS pat, image_id%7<>0 AS lin, mc.nn>=4 AND image_id%11<>0 AS sr, 0.3e0+(image_id%6)*0.1e0 AS sf FROM mc))""", pt=_PTS, **patch_ctes(2), **MODEL))
def background_authorisation(spark, d):
    m = bg.model_compare(bg.patch_stats(bg.patch_join(pts(spark, d), fx.dlum(spark, d), 2), 2), 16)
    i = C("image_id")
    m = m.select("image_id", C("spatial_variation").alias("varies"), C("radial_preferred").alias("radial"), (i % 3 == 0).alias("pattern"), (i % 7 != 0).alias("linear"), ((C("samples") >= 4) & (i % 11 != 0)).alias("sky_ready"),
                 (F.lit(0.3) + (i % 6) * 0.1).alias("sky_fraction"), (i % 4 == 0).alias("diffuse"))
    return op.background_authorisation(m, ["image_id"])


_SBG = [("chroma_noise", "chroma_noise", "<=", "1.0", True), ("mottling", "mottling", "<=", "0.9", False), ("dirty", "dirty_score", "<=", "0.5", False), ("chroma_load", "chroma_load", "<=", "1.0", True)]


@query("stretch_background_gate", with_views("dlum", gate_sql("bq", _SBG), **BQ))
def stretch_background_gate(spark, d):
    return op.verdict(bg.background_quality(fx.dlum(spark, d), 4), limits_of(_SBG), ["image_id"])


_FQ = [("chroma", "chroma_noise", "<=", "0.42", False), ("mottling", "mottling", "<=", "0.55", False), ("artifact", "artifact", "<=", "0.62", True), ("outlier", "outlier_score", "<=", "4.0", True), ("core_clip", "core_clip", "<=", "0.012", True), ("load", "chroma_load", "<=", "0.8", False)]


@query("final_quality", with_views("dlum", gate_sql("bq", _FQ), **BQ))
def final_quality(spark, d):
    return op.verdict(bg.background_quality(fx.dlum(spark, d), 4), limits_of(_FQ), ["image_id"])


@query("denoise_plan", with_views("dlum", "SELECT image_id, md AS mode, CASE md WHEN 'skip' THEN 'none' WHEN 'chroma' THEN 'full' ELSE md END AS tool_mode FROM (SELECT image_id, CASE WHEN image_id%10=0 THEN 'full' WHEN image_id%9=0 THEN 'full' WHEN chroma_noise>=0.9 THEN 'separate' WHEN chroma_noise>=0.5 THEN CASE WHEN std>=0.1 OR mottling>=0.7 THEN 'full' ELSE 'chroma' END WHEN std>=0.1 OR mottling>=0.7 THEN 'full' ELSE 'skip' END AS md FROM bq)", **BQ))
def denoise_plan(spark, d):
    q = bg.background_quality(fx.dlum(spark, d), 4)
    q = q.withColumns({"colour": C("image_id") % 10 != 0, "chroma_noise": F.when(C("image_id") % 9 != 0, C("chroma_noise"))})
    return op.denoise_plan(q, ["image_id"], focus=0.5, separate=0.9, std=0.1, mottling=0.7)


# presentation, brightness, enhancement and remix gates read the frozen-region measures
_PG = [("saturation_p50", "sat50_ratio", ">=", "0.35", True), ("saturation_p95", "sat95_ratio", ">=", "0.50", True), ("opponent_energy", "opp_ratio", ">=", "0.40", True), ("opponent_direction", "opp_direction", ">=", "0.70", True),
       ("visibility", "visibility", ">=", "0.60", True), ("microdetail_low", "micro_ratio", ">=", "0.70", False), ("microdetail_high", "micro_ratio", "<=", "1.60", False)]


@query("presentation_gate", with_views("dpair", "SELECT g.*, rd.sat50<0.02 AND rd.opp<0.0001 AS not_applicable FROM (" + gate_sql("rd", _PG) + ") g JOIN rd ON rd.image_id=g.image_id", **RD))
def presentation_gate(spark, d):
    m = pr.rendition(dpair(spark, d))
    return op.verdict(m, limits_of(_PG), ["image_id", "sat50", "opp"]).select("image_id", "status", "hard_issues", "warnings", ((C("sat50") < 0.02) & (C("opp") < 0.0001)).alias("not_applicable"))


@query("brightness_selection", with_views("dpair", f"SELECT image_id, floor_ok AS floor_passed, goals, {r6('ut')} AS utility FROM (SELECT *, (lift>=0.02) AND lr>=fl AND subject2>=pf AS floor_ok, (lr>=gl)::INT+(subject2>=gp)::INT AS goals, {cl('0.5e0*least(lr/gl,1e0)+0.5e0*least(subject2/gp,1e0)')} AS ut FROM (SELECT *, subject2-bg2 AS lift, (subject2-bg2)/greatest(subject-bg,1e-9) AS lr, CASE image_id%2 WHEN 0 THEN 0.5e0 ELSE 0.4e0 END AS fl, CASE image_id%2 WHEN 0 THEN 0.6e0 ELSE 0.45e0 END AS pf, CASE image_id%2 WHEN 0 THEN 0.75e0 ELSE 0.55e0 END AS gl, CASE image_id%2 WHEN 0 THEN 0.8e0 ELSE 0.6e0 END AS gp FROM rd))", **RD))
def brightness_selection(spark, d):
    m = pr.rendition(dpair(spark, d))
    even = C("image_id") % 2 == 0
    pick = lambda a, b: F.when(even, a).otherwise(F.lit(b))
    lift, lr = C("subject2") - C("bg2"), C("visibility")
    gl, gp = pick(0.75, 0.55), pick(0.8, 0.6)
    ok = (lift >= 0.02) & (lr >= pick(0.5, 0.4)) & (C("subject2") >= pick(0.6, 0.45))
    ut = F.least(F.greatest(F.lit(0.5) * F.least(lr / gl, F.lit(1.0)) + F.lit(0.5) * F.least(C("subject2") / gp, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    out = m.select("image_id", ok.alias("floor_passed"), ((lr >= gl).cast("int") + (C("subject2") >= gp).cast("int")).alias("goals"), ut.alias("utility"))
    return rounded(out, "utility")


_EG = [("micro_growth", "micro_ratio", "<=", "1.50", True), ("saturation_growth", "sat95_ratio", "<=", "1.25", False), ("span_kept", "span2", ">=", "0.5*span", True), ("background_lift", "bg2", "<=", "bg+0.02", False)]


@query("enhancement_gate", with_views("dpair", gate_sql("rd", _EG), **RD))
def enhancement_gate(spark, d):
    lim = [Limit("micro_growth", "micro_ratio", "<=", 1.50), Limit("saturation_growth", "sat95_ratio", "<=", 1.25, False), Limit("span_kept", "span2", ">=", C("span") * 0.5), Limit("background_lift", "bg2", "<=", C("bg") + 0.02, False)]
    return op.verdict(pr.rendition(dpair(spark, d)), lim, ["image_id"])


_CSQ = {**LP, "cs": f"SELECT image_id, median(r2) FILTER (background>0.5)/greatest(median(g2) FILTER (background>0.5),1e-6) AS rg, median(b2) FILTER (background>0.5)/greatest(median(g2) FILTER (background>0.5),1e-6) AS bg_, avg(CASE WHEN greatest(r2,g2,b2)>=1 THEN 1 ELSE 0 END)-avg(CASE WHEN greatest(r,g,b)>=1 THEN 1 ELSE 0 END) AS clip, abs(median({_SAT('2')}) FILTER (subject>0.5)-median({_SAT('')}) FILTER (subject>0.5)) AS drift FROM lp GROUP BY image_id"}
_CS = [("red_ratio_high", "rg", "<=", "1.25", True), ("red_ratio_low", "rg", ">=", "0.80", True), ("blue_ratio_high", "bg_", "<=", "1.25", True), ("blue_ratio_low", "bg_", ">=", "0.80", True), ("clip_growth", "clip", "<=", "0.002", True), ("subject_drift", "drift", "<=", "0.08", False)]


@query("colour_safety", with_views("pair", gate_sql("cs", _CS), **_CSQ))
def colour_safety(spark, d):
    p = lpair(spark, d)
    sub, b = C("subject") > 0.5, C("background") > 0.5
    q = quantiles(p, ["image_id"], [(F.when(b, C(f"{c}2")), {f"m{c}": 0.5}) for c in "rgb"] + [(F.when(sub, px.saturation_hsv(C("r2"), C("g2"), C("b2"))), {"s2": 0.5}), (F.when(sub, px.saturation_hsv(C("r"), C("g"), C("b"))), {"s1": 0.5})])
    hi = lambda s: F.avg((F.greatest(f"r{s}", f"g{s}", f"b{s}") >= 1.0).cast("int"))
    a = p.groupBy("image_id").agg((hi("2") - hi("")).alias("clip"))
    m = q.join(a, "image_id").withColumns({"rg": C("mr") / F.greatest("mg", F.lit(1e-6)), "bg_": C("mb") / F.greatest("mg", F.lit(1e-6)), "drift": F.abs(C("s2") - C("s1"))})
    return op.verdict(m, limits_of(_CS), ["image_id"])


_SEP = {**DP, "sb": blur_sql("dp", "l l2", 1),
        "sep": f"SELECT image_id, {cl('1e0-res/0.25e0')} AS s_res, {cl('1e0-abs(cov-0.08e0)/0.2e0')} AS s_cov, {cl('corr_')} AS s_str, res, cov FROM (SELECT dp.image_id, avg(abs(dp.l2-sb.l2)) FILTER (core>0.5) res, avg(CASE WHEN dp.l-dp.l2>0.05 THEN 1 ELSE 0 END) cov, coalesce(corr(sb.l,sb.l2),0) corr_ FROM dp JOIN sb USING (image_id,y,x) GROUP BY dp.image_id)"}


@query("separation_quality", with_views("dpair", f"SELECT image_id, {rsel('res cov','core_residual star_coverage')}, {r6('0.4e0*s_res+0.2e0*s_cov+0.4e0*s_str')} AS score, CASE WHEN 0.4e0*s_res+0.2e0*s_cov+0.4e0*s_str>=0.7 THEN 'ok' WHEN 0.4e0*s_res+0.2e0*s_cov+0.4e0*s_str>=0.5 THEN 'repair' ELSE 'review' END AS decision, res>0.15 AS repair_core FROM sep", **_SEP))
def separation_quality(spark, d):
    from ..operators.grid import box_blur
    from ..functions.fixed import clamp
    from ..operators.quantiles import correlation
    p = box_blur(dpair(spark, d), {"l": "_s", "l2": "_s2"}, 1)
    m = p.groupBy("image_id").agg(F.avg(F.when(C("core") > 0.5, F.abs(C("l2") - C("_s2")))).alias("core_residual"), F.avg((C("l") - C("l2") > 0.05).cast("int")).alias("star_coverage"), F.coalesce(correlation(C("_s"), C("_s2")), F.lit(0.0)).alias("c"))
    s = F.lit(0.4) * clamp(F.lit(1.0) - C("core_residual") / 0.25) + F.lit(0.2) * clamp(F.lit(1.0) - F.abs(C("star_coverage") - 0.08) / 0.2) + F.lit(0.4) * clamp(C("c"))
    out = m.select("image_id", "core_residual", "star_coverage", s.alias("score"), F.when(s >= 0.7, "ok").when(s >= 0.5, "repair").otherwise("review").alias("decision"), (C("core_residual") > 0.15).alias("repair_core"))
    return rounded(out, "core_residual", "star_coverage", "score")


_RM = [("recovery", "recovery", ">=", "0.30", True), ("colour", "hue_drift", "<=", "0.12", False), ("halo", "halo", "<=", "0.06", False), ("hollow", "hollow", "<=", "0.10", True), ("clip", "clip", "<=", "0.02", True)]
_RMX = {**LP, "rx": f"SELECT image_id, avg(CASE WHEN l2>=0.8e0*l THEN 1 ELSE 0 END) FILTER (core>0.5) AS recovery, avg(abs({_SAT('2')}-{_SAT('')})) FILTER (core>0.5) AS hue_drift, avg(greatest(l2-l,0)) FILTER (subject>0.2 AND core<0.5) AS halo, avg(CASE WHEN l2<0.5e0*l THEN 1 ELSE 0 END) FILTER (core>0.5) AS hollow, avg(CASE WHEN greatest(r2,g2,b2)>=1 THEN 1 ELSE 0 END) AS clip FROM lp GROUP BY image_id"}


@query("remix_gate", with_views("pair", gate_sql("rx", _RM), **_RMX))
def remix_gate(spark, d):
    p = lpair(spark, d)
    core = C("core") > 0.5
    sat = lambda s: px.saturation_hsv(C(f"r{s}"), C(f"g{s}"), C(f"b{s}"))
    one = lambda m, c: F.avg(F.when(m, c.cast("int")))
    m = p.groupBy("image_id").agg(
        one(core, C("l2") >= C("l") * 0.8).alias("recovery"), F.avg(F.when(core, F.abs(sat("2") - sat("")))).alias("hue_drift"), F.avg(F.when((C("subject") > 0.2) & ~core, F.greatest(C("l2") - C("l"), F.lit(0.0)))).alias("halo"),
        one(core, C("l2") < C("l") * 0.5).alias("hollow"), F.avg((F.greatest("r2", "g2", "b2") >= 1.0).cast("int")).alias("clip"))
    return op.verdict(m, limits_of(_RM), ["image_id"])


@query("candidate_nonregression", with_views("msk", f"""SELECT image_id, {rsel('m3 m1','mae_baseline mae_candidate')}, m3-m1>=0.005 AND (m3-m1)/greatest(m3,1e-9)>=0.1 AS gain, c1<=c3+0.001 AS no_regression, m3-m1>=0.005 AND (m3-m1)/greatest(m3,1e-9)>=0.1 AND c1<=c3+0.001 AS selected FROM (SELECT image_id, {', '.join(f"avg((abs(r*(1e0-0.1e0*{k})+0.02e0*{k}-r)+abs(g*(1e0-0.05e0*{k})-g)+abs(b*(1e0-0.1e0*{k})+0.01e0*x*{k}/16-b))/3e0) AS m{k}, avg(CASE WHEN greatest(r*(1e0-0.1e0*{k})+0.02e0*{k},g*(1e0-0.05e0*{k}),b*(1e0-0.1e0*{k})+0.01e0*x*{k}/16)>=1 THEN 1 ELSE 0 END) AS c{k}" for k in (1, 3))} FROM msk GROUP BY image_id)"""))
def candidate_nonregression(spark, d):
    base = fx.px(spark, d)
    c = fx.cand(spark, d).where(C("k").isin(1, 3)).select("image_id", "y", "x", "k", *[C(n).alias(f"{n}2") for n in "rgb"])
    j = c.join(base, ["image_id", "y", "x"])
    err = (F.abs(C("r2") - C("r")) + F.abs(C("g2") - C("g")) + F.abs(C("b2") - C("b"))) / 3.0
    clip = (F.greatest("r2", "g2", "b2") >= 1.0).cast("int")
    on = lambda k, e: F.avg(F.when(C("k") == k, e))
    m = j.groupBy("image_id").agg(on(3, err).alias("mae_baseline"), on(1, err).alias("mae_candidate"), on(3, clip).alias("c3"), on(1, clip).alias("c1"))
    g = C("mae_baseline") - C("mae_candidate")
    gain = (g >= 0.005) & (g / F.greatest("mae_baseline", F.lit(1e-9)) >= 0.10)
    ok = C("c1") <= C("c3") + 0.001
    return rounded(m.select("image_id", "mae_baseline", "mae_candidate", gain.alias("gain"), ok.alias("no_regression"), (gain & ok).alias("selected")), "mae_baseline", "mae_candidate")


@query("visibility_audit", with_views("lum", f"""SELECT image_id, {rsel('p99 p50','p99 p50')}, extended_tiles, CASE WHEN p99<0.5 THEN 'too_dark' WHEN extended_tiles<3 THEN 'not_extended' ELSE 'visible' END AS status FROM (SELECT image_id, quantile_cont(l,0.99) p99, median(l) p50 FROM lum GROUP BY image_id) JOIN (SELECT image_id, count(*) FILTER (m>0.62) AS extended_tiles FROM (SELECT image_id, avg(l) m FROM lum GROUP BY image_id, y//4, x//4) GROUP BY image_id) USING (image_id)"""))
def visibility_audit(spark, d):
    p = fx.lum(spark, d)
    q = quantiles(p, ["image_id"], [(C("l"), {"p99": 0.99, "p50": 0.5})])
    t = p.groupBy("image_id", F.floor(C("y") / 4).alias("ty"), F.floor(C("x") / 4).alias("tx")).agg(F.avg("l").alias("m")).groupBy("image_id").agg(F.count_if(C("m") > 0.62).alias("extended_tiles"))
    o = q.join(t, "image_id")
    st = F.when(C("p99") < 0.5, "too_dark").when(C("extended_tiles") < 3, "not_extended").otherwise("visible")
    return rounded(o.select("image_id", "p99", "p50", "extended_tiles", st.alias("status")), "p99", "p50")


@query("gate_rows", with_views("dpair", "SELECT image_id, gate, metric, " + r6("value") + " AS value, op, CAST(\"limit\" AS DOUBLE) AS \"limit\", passed, severity FROM (" + " UNION ALL ".join(f"SELECT image_id, '{n}' AS gate, '{m}' AS metric, {m} AS value, '{o}' AS op, {v}e0 AS \"limit\", {m} {o} {v} AS passed, '{'hard' if h else 'soft'}' AS severity FROM rd" for n, m, o, v, h in _PG) + ")", **RD))
def gate_rows(spark, d):
    return rounded(op.gate_rows(pr.rendition(dpair(spark, d)), limits_of(_PG), ["image_id"]), "value")
