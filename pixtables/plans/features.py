"""Queries over image features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import fixed
from ..operators import components as cc
from ..operators import features as op
from ..sources import fixtures as fx
from .colour import rsel
from .noise import rounded
from .registry import blur_sql, cl, query, r6, with_views

C = F.col


def comp_ctes(src: str, on: str, name: str = "lb", keys: str = "image_id") -> dict[str, str]:
    """Labels by a recursive walk over 8-neighbours from every mask pixel."""
    ks = [k.strip() for k in keys.split(",")]
    eq = lambda a, b: " AND ".join(f"{a}.{k}={b}.{k}" for k in ks)
    return {
        f"{name}m": f"SELECT {keys}, y, x FROM {src} WHERE {on}",
        f"{name}w(" + keys + ", y, x, label)": f"SELECT {keys}, y, x, y*16+x FROM {name}m UNION SELECT {', '.join('m.'+k for k in ks)}, m.y, m.x, w.label FROM {name}w w JOIN {name}m m ON {eq('m','w')} AND abs(m.y-w.y)<=1 AND abs(m.x-w.x)<=1",
        name: f"SELECT {keys}, y, x, CAST(min(label) AS INT) AS label FROM {name}w GROUP BY {keys}, y, x",
    }


def recursive(sql: str) -> str:
    import re
    sql = sql.replace("WITH ", "WITH RECURSIVE ", 1)
    return re.sub(r"(\w+w\([^)]*label\)) AS MATERIALIZED", r"\1 AS", sql)


@query("connected_components", recursive(with_views("dlum", "SELECT image_id, label, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lb GROUP BY image_id, label", **comp_ctes("dlum", "l>0.75"))))
def connected_components(spark, d):
    return cc.areas(cc.connected_components(fx.dlum(spark, d), ["image_id"], C("l") > 0.75, 16), ["image_id"])


_EDGE = "SELECT image_id, y, x FROM lb JOIN (SELECT image_id, label FROM lb GROUP BY image_id, label HAVING min(y)=0 OR min(x)=0 OR max(y)=15 OR max(x)=15) USING (image_id, label)"


@query("edge_fill", recursive(with_views("dlum", _EDGE, **comp_ctes("dlum", "l<=0.5"))))
def edge_fill(spark, d):
    return cc.edge_fill(fx.dlum(spark, d), ["image_id"], C("l") <= 0.5, 16, 16)


@query("valid_and_saturation_masks", recursive(with_views("dlum", "SELECT d.image_id, d.y, d.x, ef.y IS NULL AS valid, CAST((r>=0.98)::INT + 2*(g>=0.9)::INT + 4*(b>=0.98)::INT AS INT) AS saturated FROM dlum d LEFT JOIN ef ON ef.image_id=d.image_id AND ef.y=d.y AND ef.x=d.x", **comp_ctes("dlum", "l<=0.5"), ef=_EDGE)))
def valid_and_saturation_masks(spark, d):
    g = fx.dlum(spark, d)
    filled = cc.edge_fill(g, ["image_id"], C("l") <= 0.5, 16, 16).withColumn("_f", F.lit(True))
    bit = lambda c, t, k: F.shiftleft((C(c) >= t).cast("int"), k)
    return g.join(filled, ["image_id", "y", "x"], "left").select("image_id", "y", "x", C("_f").isNull().alias("valid"), bit("r", 0.98, 0).bitwiseOR(bit("g", 0.9, 1)).bitwiseOR(bit("b", 0.98, 2)).alias("saturated"))


def sky_sql(q: float, wide: float, minimum: int, p: str = "") -> dict[str, str]:
    return {
        f"{p}k0": f"SELECT image_id, quantile_cont(l,{q}) q, quantile_cont(l,{wide}) qw FROM dlum GROUP BY image_id",
        f"{p}k1": f"SELECT image_id, CASE WHEN count(*) FILTER (l<=q)<{minimum} THEN any_value(qw) ELSE any_value(q) END AS th FROM dlum JOIN {p}k0 USING (image_id) GROUP BY image_id",
        f"{p}k2": f"SELECT image_id, any_value(th) th, median(l) bg_median, stddev_pop(l) bg_std FROM dlum JOIN {p}k1 USING (image_id) WHERE l<=th GROUP BY image_id",
        f"{p}sk": f"SELECT image_id, any_value(k2.th) th, any_value(bg_median) bg_median, any_value(bg_std) bg_std, median(abs(l-bg_median)) bg_mad FROM dlum JOIN {p}k2 k2 USING (image_id) WHERE l<=k2.th GROUP BY image_id",
    }


_FL = lambda d, a, b, c: f"least({d}, greatest(bg_mad*{a}, bg_median*{b}, {c}))"
_DT = "greatest(1e-6, least(0.002e0, bg_median*0.45e0, bg_median-8e0*bg_mad))"
_IMF = {
    **sky_sql(0.22, 0.30, 64),
    "fq": "SELECT image_id, quantile_cont(l,0.5) q50, quantile_cont(l,0.55) q55, quantile_cont(l,0.7) q70, quantile_cont(l,0.985) q985, quantile_cont(l,0.992) q992 FROM dlum GROUP BY image_id",
    "f0": f"SELECT *, l>greatest(q55,bg_median+1.2e0*bg_std) AS sig0, l>greatest(q70,bg_median+greatest(1.8e0*bg_std,{_FL('0.02e0','6e0','0.08e0','0.00015e0')})) AS obj, l>greatest(q992,bg_median+greatest(6e0*bg_std,0.08e0)) AS core, l>greatest(q985,bg_median+greatest(4e0*bg_std,0.05e0)) AS star, CASE WHEN l<={_DT} THEN 1 ELSE 0 END AS dark FROM dlum JOIN fq USING (image_id) JOIN sk USING (image_id)",
    "f1": "SELECT f0.*, CASE WHEN ns<128 THEN l>q50 ELSE sig0 END AS sig, (CASE WHEN y<2 OR y>=14 THEN 1 ELSE 0 END)+(CASE WHEN x<2 OR x>=14 THEN 1 ELSE 0 END) AS tw FROM f0 JOIN (SELECT image_id, count(*) FILTER (sig0) ns FROM f0 GROUP BY image_id) USING (image_id)",
    **comp_ctes("f1", "obj", "lo"), **comp_ctes("f1", "star", "ls"),
    "oa": "SELECT image_id, sum(a) AS dif FROM (SELECT image_id, label, count(*) a FROM lo GROUP BY ALL HAVING count(*)>=24) GROUP BY image_id",
    "sa": "SELECT image_id, count(*) n, median(a) m FROM (SELECT image_id, label, count(*) a FROM ls GROUP BY ALL HAVING count(*)<=4) GROUP BY image_id",
    "ft": f"""SELECT image_id, {cl('bg_median')} AS bg_median, {cl('bg_std')} AS bg_std, {cl('coalesce(red,1e0)','0.2e0','4e0')} AS red_dominance, {cl('coalesce(blue,1e0)','0.2e0','4e0')} AS blue_dominance, {cl('coalesce(n/256e0,0e0)','0e0','0.2e0')} AS star_density,
      {cl('coalesce(2e0*sqrt(m/pi()),1e0)','0.2e0','64e0')} AS median_star_size, {cl('no/256e0')} AS object_area_ratio, {cl('CASE WHEN no>0 THEN coalesce(dif/no,0e0) ELSE 0e0 END')} AS diffuse_ratio, {cl('CASE WHEN no>0 THEN nco/no::DOUBLE ELSE nc/256e0 END')} AS core_brightness_ratio, {cl('edge')} AS edge_black_ratio, {cl('dk')} AS global_dark_ratio
      FROM (SELECT image_id, any_value(bg_median) bg_median, any_value(bg_std) bg_std, median((r+1e-6)/(g+1e-6)) FILTER (sig) red, median((b+1e-6)/(g+1e-6)) FILTER (sig) blue, count(*) FILTER (obj) no, count(*) FILTER (obj AND core) nco, count(*) FILTER (core) nc, avg(dark) dk, sum(dark*tw)/sum(tw)::DOUBLE edge FROM f1 GROUP BY image_id)
      LEFT JOIN oa USING (image_id) LEFT JOIN sa USING (image_id)""",
}
_IMN = "bg_median bg_std red_dominance blue_dominance star_density median_star_size object_area_ratio diffuse_ratio core_brightness_ratio edge_black_ratio global_dark_ratio"


@query("image_features", recursive(with_views("dlum", f"SELECT image_id, {rsel(_IMN)} FROM ft", **_IMF)))
def image_features(spark, d):
    return rounded(op.image_features(fx.dlum(spark, d), 16), *_IMN.split())


@query("target_type_rules", recursive(with_views("dlum", """SELECT image_id, CASE WHEN edge_black_ratio<0.04 AND bg_median>0.25 AND object_area_ratio>0.7 AND star_density<0.003 THEN 'planetary' WHEN diffuse_ratio>0.5 AND object_area_ratio>0.18 AND red_dominance>1.12 THEN 'emission_nebula'
  WHEN diffuse_ratio>0.5 AND object_area_ratio>0.18 AND blue_dominance>1.12 THEN 'reflection_nebula' WHEN object_area_ratio BETWEEN 0.08 AND 0.45 AND core_brightness_ratio>0.05 AND diffuse_ratio>0.3 AND star_density<0.004 THEN 'galaxy'
  WHEN object_area_ratio<0.2 AND core_brightness_ratio>0.08 AND diffuse_ratio<0.55 AND (red_dominance>1.1 OR blue_dominance>1.1) THEN 'planetary_nebula' WHEN star_density>0.0045 AND diffuse_ratio<0.22 THEN CASE WHEN object_area_ratio<0.22 THEN 'cluster' ELSE 'widefield' END
  WHEN star_density>0.003 AND diffuse_ratio<0.3 THEN 'widefield' ELSE 'unknown' END AS target_type FROM ft""", **_IMF)))
def target_type_rules(spark, d):
    f = op.image_features(fx.dlum(spark, d), 16)
    return f.select("image_id", op.target_type_rules(f).alias("target_type"))


_S = {k: cl(v) for k, v in {"n": "(bg_std-0.015e0)/0.07e0", "s": "star_density/0.01e0", "di": "diffuse_ratio", "co": "(core_brightness_ratio-0.01e0)/0.14e0", "ed": "(edge_black_ratio-0.05e0)/0.5e0", "re": "(red_dominance-1e0)/0.5e0", "bl": "(blue_dominance-1e0)/0.5e0", "ob": "object_area_ratio"}.items()}
_TUNE = {
    "stage2_base_crop_margin": "0.01e0+0.03e0*ed", "bg_samples": "round_even(30e0-10e0*ob-6e0*s+4e0*n,0)", "bg_tolerance": "0.75e0+0.5e0*(1e0-di)-0.15e0*s", "bg_smooth": "0.45e0+0.35e0*ob+0.2e0*n", "denoise_mod": "0.24e0+0.22e0*n-0.06e0*co",
    "asinh_stretch": "2.05e0+0.9e0*di-0.55e0*n-0.45e0*co", "asinh_offset": "0.0009e0+0.0011e0*co+0.0006e0*re", "ghs_shadowsclip": "-3.2e0+0.8e0*co+0.3e0*n", "ghs_stretchamount": "2.3e0-0.55e0*co-0.35e0*n",
    "nebula_saturation": "0.16e0+0.27e0*di-0.12e0*s-0.18e0*re+0.08e0*bl", "star_intensity": "1.08e0-0.17e0*s-0.08e0*di+0.05e0*co", "stage9_fallback_intensity_cap": "1.08e0-0.17e0*s-0.08e0*di+0.05e0*co-0.06e0", "final_saturation": "0.07e0+0.12e0*di-0.07e0*s-0.1e0*re+0.05e0*bl"}
_DEF = {"bg_samples": 20.0, "bg_tolerance": 1.0, "asinh_stretch": 2.5}


@query("auto_tune", recursive(with_views("dlum", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT image_id, '{k}' AS parameter, {_DEF.get(k, 0.0)!r}::DOUBLE AS \"default\", {r6(v)} AS value FROM sc WHERE {v}<>{_DEF.get(k, 0.0)!r}::DOUBLE" for k, v in _TUNE.items()) + ")",
    **_IMF, sc="SELECT image_id, " + ", ".join(f"{v} AS {k}" for k, v in _S.items()) + " FROM ft")))
def auto_tune(spark, d):
    return rounded(op.auto_tune(op.image_features(fx.dlum(spark, d), 16), _DEF), "value")


_QMN = "bg_median black_pixel_ratio highlight_clip_ratio star_density median_star_size star_coverage_ratio star_energy_ratio saturation_median saturation_p95 microcontrast blue_excess"
_QMS = {
    **sky_sql(0.22, 0.30, 64), "qq": "SELECT image_id, quantile_cont(l,0.5) q50, quantile_cont(l,0.985) q985 FROM dlum GROUP BY image_id", "qb": blur_sql("dlum", "l", 1),
    "q0": "SELECT d.*, qb.l AS bl, sk.bg_median, d.l>greatest(q985,bg_median+greatest(4e0*bg_std,0.05e0)) AS star, d.l>greatest(q50,bg_median+0.02e0) AS sig, greatest(d.l-bg_median,0e0) AS up, (greatest(r,g,b)-least(r,g,b))/greatest(greatest(r,g,b),1e-6) AS sat FROM dlum d JOIN qb USING (image_id,y,x) JOIN qq USING (image_id) JOIN sk USING (image_id)",
    **comp_ctes("q0", "star", "ls"),
    "sa": "SELECT image_id, count(*) n, median(a) m, sum(a) cov FROM (SELECT image_id, label, count(*) a FROM ls GROUP BY ALL HAVING count(*)<=4) GROUP BY image_id",
    "qm": f"""SELECT image_id, bg_median, black_pixel_ratio, highlight_clip_ratio, {cl('coalesce(n/256e0,0e0)','0e0','0.2e0')} AS star_density, {cl('coalesce(2e0*sqrt(m/pi()),0e0)','0e0','64e0')} AS median_star_size, coalesce(cov/256e0,0e0) AS star_coverage_ratio, CASE WHEN m IS NULL THEN 0e0 ELSE {cl('st/greatest(tot,1e-6)')} END AS star_energy_ratio,
      saturation_median, saturation_p95, microcontrast, greatest(0e0, blue-greatest(1.08e0,red+0.12e0)) AS blue_excess FROM (SELECT image_id, any_value(bg_median) bg_median, avg(CASE WHEN l<=0.01 THEN 1 ELSE 0 END) black_pixel_ratio, avg(CASE WHEN l>=0.985 OR greatest(r,g,b)>=0.995 THEN 1 ELSE 0 END) highlight_clip_ratio, avg(abs(l-bl)) FILTER (sig) microcontrast,
      sum(up) tot, sum(up) FILTER (star) st, median(sat) FILTER (sig) saturation_median, quantile_cont(sat,0.95) FILTER (sig) saturation_p95, median((r+1e-6)/(g+1e-6)) FILTER (sig) red, median((b+1e-6)/(g+1e-6)) FILTER (sig) blue FROM q0 GROUP BY image_id) LEFT JOIN sa USING (image_id)""",
}


@query("quality_metrics", recursive(with_views("dlum", f"SELECT image_id, {rsel(_QMN)} FROM qm", **_QMS)))
def quality_metrics(spark, d):
    return rounded(op.quality_metrics(fx.dlum(spark, d), 16), *_QMN.split())


_ADN = "bg_median bg_std gradient_score dirty_background_score chroma_noise_score object_area_ratio bright_core_score core_peak_ratio core_clip_ratio nebulosity_area_ratio faint_structure_score symmetry_score elongation_score compactness_score star_density star_bloat_score halo_risk_score dense_star_field_score red_dominance blue_dominance green_cast color_balance_score blue_excess_score low_snr_score"
_AD = {
    **sky_sql(0.35, 0.35, 0), "s1": blur_sql("dlum", "l", 1), "s2": blur_sql("dlum", "l", 2),
    "a0": "SELECT d.*, d.l-s1.l AS loc, abs(d.l-s2.l) AS tex FROM dlum d JOIN s1 USING (image_id,y,x) JOIN s2 USING (image_id,y,x)",
    "aq": "SELECT image_id, quantile_cont(l,0.72) q72, quantile_cont(l,0.985) q985, quantile_cont(l,0.58) q58, quantile_cont(loc,0.992) q992, stddev_pop(loc) ls FROM a0 GROUP BY image_id",
    "a1": f"SELECT *, greatest(q72,bg_median+greatest(bg_std*2e0,{_FL('0.015e0','6e0','0.08e0','0.00015e0')})) AS thr, greatest(q58,bg_median+greatest(bg_std*1.1e0,{_FL('0.008e0','3e0','0.05e0','0.00008e0')})) AS fth, CASE WHEN l>greatest(q985,bg_median+greatest(bg_std*6e0,0.08e0)) THEN 1e0 ELSE 0e0 END AS bright, CASE WHEN loc>greatest(q992,ls*3e0) THEN 1e0 ELSE 0e0 END AS star FROM a0 JOIN aq USING (image_id) JOIN sk USING (image_id)",
    "b3": blur_sql("a1", "bright", 3), "st1": blur_sql("a1", "star", 1),
    "a2": "SELECT a1.*, b3.bright AS bb, st1.star AS sb, a1.l>thr AS obj, a1.l>fth AND a1.bright=0 AS faint, count(*) FILTER (l>fth) OVER (PARTITION BY image_id) AS nsig, (r+g+b)/3e0-l AS cm FROM a1 JOIN b3 USING (image_id,y,x) JOIN st1 USING (image_id,y,x)",
    "a3": """SELECT image_id, any_value(bg_median) bg_median, any_value(bg_std) bg_std, any_value(thr) thr, median(l) FILTER (y<2) t, median(l) FILTER (y>=14) bt, median(l) FILTER (x<2) lf, median(l) FILTER (x>=14) rt,
      median(sqrt((pow(r-l-cm,2)+pow(g-l-cm,2)+pow(b-l-cm,2))/3e0)) FILTER (l<=th) chroma, median(tex) FILTER (faint) tex, median(r) FILTER (l>fth OR nsig<32) rm, median(g) FILTER (l>fth OR nsig<32) gm, median(b) FILTER (l>fth OR nsig<32) bm,
      avg(CASE WHEN obj THEN 1 ELSE 0 END) oar, avg(bright) ba, max(l) mx, avg(CASE WHEN l>=0.985 THEN 1 ELSE 0 END) ccr, avg(CASE WHEN faint THEN 1 ELSE 0 END) neb, avg(star) sd, avg(CASE WHEN bb>0.01 THEN 1 ELSE 0 END) halo, avg(CASE WHEN sb>0.15 THEN 1 ELSE 0 END) bloat,
      max(x) FILTER (obj)-min(x) FILTER (obj)+1 AS xs, max(y) FILTER (obj)-min(y) FILTER (obj)+1 AS ys, count(*) FILTER (obj AND x<8) lm, count(*) FILTER (obj AND x>=8) rmass FROM a2 GROUP BY image_id""",
    "a4": f"SELECT *, {cl('(greatest(t,bt,lf,rt)-least(t,bt,lf,rt))/greatest(bg_std*6e0,0.01e0)')} AS gs, {cl('chroma/greatest(bg_std*2e0,0.01e0)')} AS cns, {cl('(mx-bg_median)/greatest(1e0-bg_median,1e-4)')} AS cpr, (rm+1e-6)/(gm+1e-6) AS rd, (bm+1e-6)/(gm+1e-6) AS bd, (gm+1e-6)/greatest((rm+bm+2e-6)*0.5e0,1e-6) AS gc FROM a3",
    "ad": f"""SELECT image_id, bg_median, bg_std, gs AS gradient_score, {cl(f"0.4e0*{cl('bg_std/greatest(bg_median,0.015e0)')}+0.35e0*gs+0.25e0*cns")} AS dirty_background_score, cns AS chroma_noise_score, oar AS object_area_ratio, {cl('cpr*0.7e0+least(ba*30e0,1e0)*0.3e0')} AS bright_core_score, cpr AS core_peak_ratio, ccr AS core_clip_ratio, neb AS nebulosity_area_ratio,
      CASE WHEN tex IS NULL THEN 0e0 ELSE {cl('neb*2.2e0+tex/greatest(bg_std*3e0,0.01e0)')} END AS faint_structure_score, CASE WHEN xs IS NULL THEN 0e0 ELSE 1e0-{cl('abs(lm-rmass)/greatest(lm+rmass,1)::DOUBLE')} END AS symmetry_score, CASE WHEN xs IS NULL THEN 0e0 ELSE {cl('abs(xs-ys)/greatest(xs,ys)::DOUBLE')} END AS elongation_score,
      CASE WHEN xs IS NULL THEN 0e0 ELSE {cl('oar/greatest(xs*ys/256e0,1e-6)')} END AS compactness_score, sd AS star_density, {cl('bloat*9e0')} AS star_bloat_score, {cl('halo*12e0')} AS halo_risk_score, {cl('sd/0.018e0')} AS dense_star_field_score, rd AS red_dominance, bd AS blue_dominance, gc AS green_cast,
      1e0-{cl('(abs(rd-1e0)+abs(bd-1e0)+abs(gc-1e0))/2.5e0')} AS color_balance_score, {cl('bd-greatest(1.1e0,rd+0.1e0)')} AS blue_excess_score, {cl('bg_std/greatest(thr-bg_median,0.01e0)')} AS low_snr_score FROM a4""",
}


@query("adaptive_features", with_views("dlum", f"SELECT image_id, {rsel(_ADN)} FROM ad", **_AD))
def adaptive_features(spark, d):
    return rounded(op.adaptive_features(fx.dlum(spark, d), 16), *_ADN.split())


_LVL = lambda v, m, h: f"CASE WHEN {v}>={h} THEN 'high' WHEN {v}>={m} THEN 'medium' ELSE 'low' END"
_FLG = {"bright_core": "bright_core_score>0.45 OR core_peak_ratio>0.7", "large_nebulosity": "nebulosity_area_ratio>0.18", "faint_outer_cloud": "faint_structure_score>0.3", "dense_star_field": "dense_star_field_score>0.35", "reflection_blue": "blue_dominance>1.12", "emission_red": "red_dominance>1.08",
        "small_galaxy": "object_area_ratio<0.12 AND elongation_score>0.2", "star_cluster_dominant": "dense_star_field_score>0.55 AND nebulosity_area_ratio<0.2"}


@query("feature_flags_risks", with_views("dlum", "SELECT image_id, " + ", ".join(f"({v}) AS {k}" for k, v in _FLG.items()) + f""", {_LVL('greatest(bright_core_score,core_clip_ratio*20e0)',0.4,0.7)} AS core_blowout, {_LVL('dirty_background_score',0.28,0.45)} AS dirty_background, {_LVL('blue_excess_score',0.08,0.18)} AS blue_excess,
  {_LVL('greatest(halo_risk_score,star_bloat_score)',0.35,0.62)} AS star_removal_residue, {_LVL('greatest(low_snr_score,dirty_background_score)',0.35,0.55)} AS overstretch, {_LVL('halo_risk_score',0.3,0.6)} AS halo_risk FROM ad""", **_AD))
def feature_flags_risks(spark, d):
    f = op.adaptive_features(fx.dlum(spark, d), 16)
    return f.select("image_id", *[c.alias(n) for n, c in {**op.flags(), **op.risks()}.items()])


@query("visual_target_type", with_views("dlum", f"""SELECT image_id, CASE WHEN image_id%10=0 THEN 'large_galaxy' WHEN image_id%10=1 THEN 'dark_nebula_low_contrast' ELSE tt END AS target_type, CAST(cf AS DOUBLE) AS confidence FROM (SELECT *, CASE WHEN low_snr_score>0.75 OR dirty_background_score>0.72 THEN 'generic_low_snr_safe' WHEN scd AND compactness_score>0.25 AND bright_core_score>0.35 THEN 'globular_cluster' WHEN scd THEN 'open_cluster'
  WHEN bc AND ln AND rb AND er THEN 'bright_emission_reflection_nebula' WHEN rb AND halo_risk_score>0.35 THEN 'reflection_nebula_cluster' WHEN er AND ln THEN 'emission_nebula_widefield' WHEN elongation_score>0.25 AND bright_core_score>0.3 AND nebulosity_area_ratio<0.28 THEN CASE WHEN object_area_ratio<0.11 THEN 'small_galaxy' ELSE 'large_galaxy' END
  WHEN faint_structure_score>0.3 AND color_balance_score>0.7 AND bright_core_score<0.35 THEN 'dark_nebula_low_contrast' ELSE 'generic_low_snr_safe' END AS tt, CASE WHEN low_snr_score>0.75 OR dirty_background_score>0.72 THEN 0.56e0 WHEN scd AND compactness_score>0.25 AND bright_core_score>0.35 THEN 0.7e0 WHEN scd THEN 0.64e0
  WHEN bc AND ln AND rb AND er THEN 0.74e0 WHEN rb AND halo_risk_score>0.35 THEN 0.68e0 WHEN er AND ln THEN 0.66e0 WHEN elongation_score>0.25 AND bright_core_score>0.3 AND nebulosity_area_ratio<0.28 THEN CASE WHEN object_area_ratio<0.11 THEN 0.62e0 ELSE 0.66e0 END WHEN faint_structure_score>0.3 AND color_balance_score>0.7 AND bright_core_score<0.35 THEN 0.58e0 ELSE 0.5e0 END AS cf
  FROM (SELECT *, {_FLG['star_cluster_dominant']} AS scd, {_FLG['bright_core']} AS bc, {_FLG['large_nebulosity']} AS ln, {_FLG['reflection_blue']} AS rb, {_FLG['emission_red']} AS er FROM ad))""", **_AD))
def visual_target_type(spark, d):
    f = op.adaptive_features(fx.dlum(spark, d), 16)
    i = C("image_id") % 10
    return op.visual_type(f, F.when(i == 0, "Galaxy").when(i == 1, "dark nebula").otherwise("none"))
