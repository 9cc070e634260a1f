"""Image features and quality metrics used for routing, flags and risks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixel as px
from ..functions.fixed import clamp
from .components import areas, connected_components
from .grid import box_blur
from .quantiles import quantiles, with_quantiles, with_stats

C = F.col


def _dark_threshold(med: str, mad: str) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(0.002), C(med) * 0.45, C(med) - F.lit(8.0) * C(mad)))


def _floor(med: str, mad: str, default: float, k_mad: float, k_med: float, low: float) -> Column:
    return F.least(F.lit(default), F.greatest(C(mad) * k_mad, C(med) * k_med, F.lit(low)))


def sky_stats(d: DataFrame, q: float, wide: float, minimum: int, key: str = "image_id") -> DataFrame:
    """Adds sky level, population std and MAD (``bg_median``, ``bg_std``, ``bg_mad``) of the darkest pixels."""
    d = with_quantiles(d, [key], [(C("l"), {"_q": q, "_qw": wide})])
    d = with_stats(d, [key], {"_nb": F.count_if(C("l") <= C("_q"))})
    d = d.withColumn("_sky", C("l") <= F.when(C("_nb") < minimum, C("_qw")).otherwise(C("_q")))
    v = F.when(C("_sky"), C("l"))
    d = with_quantiles(d, [key], [(v, {"bg_median": 0.5})])
    d = with_stats(d, [key], {"bg_std": F.stddev_pop(v)})
    d = with_quantiles(d, [key], [(F.abs(v - C("bg_median")), {"bg_mad": 0.5})])
    return d.drop("_q", "_qw", "n__q", "_nb", "n_bg_median", "n_bg_mad")


def image_features(grid: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Eleven features of each image, clamped (expects ``l`` on a full grid)."""
    area = side * side
    d = sky_stats(grid, 0.22, 0.30, 64, key)
    d = with_quantiles(d, [key], [(C("l"), {"q50": 0.50, "q55": 0.55, "q70": 0.70, "q985": 0.985, "q992": 0.992})])
    d = d.withColumns({
        "_sig": C("l") > F.greatest(C("q55"), C("bg_median") + F.lit(1.2) * C("bg_std")),
        "obj": C("l") > F.greatest(C("q70"), C("bg_median") + F.greatest(F.lit(1.8) * C("bg_std"), _floor("bg_median", "bg_mad", 0.020, 6.0, 0.08, 0.00015))),
        "core": C("l") > F.greatest(C("q992"), C("bg_median") + F.greatest(F.lit(6.0) * C("bg_std"), F.lit(0.08))),
        "star": C("l") > F.greatest(C("q985"), C("bg_median") + F.greatest(F.lit(4.0) * C("bg_std"), F.lit(0.05))),
    })
    d = with_stats(d, [key], {"_ns": F.count_if("_sig")})
    sig = F.when(C("_ns") < 128, C("l") > C("q50")).otherwise(C("_sig"))
    e = 1e-6
    edge = max(2, int(side * 0.05))
    border = (C("y") < edge) | (C("y") >= side - edge) | (C("x") < edge) | (C("x") >= side - edge)
    corner = ((C("y") < edge) | (C("y") >= side - edge)) & ((C("x") < edge) | (C("x") >= side - edge))
    twice = F.when(corner, 2).when(border, 1).otherwise(0)  # the four bands overlap in the corners
    dark = (C("l") <= _dark_threshold("bg_median", "bg_mad")).cast("int")
    q = quantiles(d, [key], [(F.when(sig, (C("r") + e) / (C("g") + e)), {"red": 0.5}), (F.when(sig, (C("b") + e) / (C("g") + e)), {"blue": 0.5})])
    m = d.groupBy(key).agg(
        F.max("bg_median").alias("bg_median"), F.max("bg_std").alias("bg_std"), F.count_if("obj").alias("_no"), F.count_if(C("obj") & C("core")).alias("_nco"),
        F.count_if("core").alias("_nc"), F.avg(dark).alias("dark"), (F.sum(dark * twice) / F.sum(twice)).alias("edge"))
    both = d.withColumn("m", F.explode(F.array(F.struct(F.lit("obj").alias("mask"), C("obj").alias("on")), F.struct(F.lit("star").alias("mask"), C("star").alias("on")))))
    both = both.select(key, C("m.mask").alias("mask"), "y", "x", C("m.on").alias("on"))
    a = areas(connected_components(both, [key, "mask"], C("on"), side), [key, "mask"])
    diffuse = a.where((C("mask") == "obj") & (C("area") >= max(24, int(area * 0.0015)))).groupBy(key).agg(F.sum("area").alias("_diff"))
    small = a.where((C("mask") == "star") & (C("area") <= max(4, int(area * 0.0006))))
    stars = quantiles(small, [key], [(C("area"), {"_sa": 0.5})])
    out = m.join(q, key, "left").join(diffuse, key, "left").join(stars, key, "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        key, clamp(C("bg_median")).alias("bg_median"), clamp(C("bg_std")).alias("bg_std"),
        clamp(F.coalesce("red", F.lit(1.0)), 0.2, 4.0).alias("red_dominance"), clamp(F.coalesce("blue", F.lit(1.0)), 0.2, 4.0).alias("blue_dominance"),
        clamp(z(C("n__sa") / float(area)), 0.0, 0.2).alias("star_density"),
        clamp(F.coalesce(F.lit(2.0) * F.sqrt(C("_sa") / F.pi()), F.lit(1.0)), 0.2, 64.0).alias("median_star_size"),
        clamp(C("_no") / float(area)).alias("object_area_ratio"), clamp(F.when(C("_no") > 0, z(C("_diff") / C("_no"))).otherwise(F.lit(0.0))).alias("diffuse_ratio"),
        clamp(F.when(C("_no") > 0, C("_nco") / C("_no")).otherwise(C("_nc") / float(area))).alias("core_brightness_ratio"),
        clamp(C("edge")).alias("edge_black_ratio"), clamp(C("dark")).alias("global_dark_ratio"))


def quality_metrics(grid: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Clip shares, star coverage and energy, saturation, microcontrast and blue excess."""
    area = side * side
    d = sky_stats(grid, 0.22, 0.30, 64, key)
    d = with_quantiles(d, [key], [(C("l"), {"q50": 0.50, "q985": 0.985})])
    d = box_blur(d, {"l": "_s"}, 1, [key])
    d = d.withColumns({
        "star": C("l") > F.greatest(C("q985"), C("bg_median") + F.greatest(F.lit(4.0) * C("bg_std"), F.lit(0.05))),
        "sig": C("l") > F.greatest(C("q50"), C("bg_median") + 0.02), "_up": F.greatest(C("l") - C("bg_median"), F.lit(0.0)),
        "_sat": px.saturation_hsv(C("r"), C("g"), C("b"))})
    e = 1e-6
    on = C("sig")
    q = quantiles(d, [key], [(F.when(on, C("_sat")), {"sat50": 0.5, "sat95": 0.95}), (F.when(on, (C("r") + e) / (C("g") + e)), {"red": 0.5}), (F.when(on, (C("b") + e) / (C("g") + e)), {"blue": 0.5})])
    m = d.groupBy(key).agg(
        F.max("bg_median").alias("bg_median"), F.avg((C("l") <= 0.010).cast("int")).alias("black_pixel_ratio"),
        F.avg(((C("l") >= 0.985) | (F.greatest("r", "g", "b") >= 0.995)).cast("int")).alias("highlight_clip_ratio"),
        F.avg(F.when(on, F.abs(C("l") - C("_s")))).alias("microcontrast"), F.sum("_up").alias("_tot"), F.sum(F.when(C("star"), C("_up"))).alias("_st"))
    a = areas(connected_components(d, [key], C("star"), side), [key]).where(C("area") <= max(4, int(area * 0.0008)))
    stars = quantiles(a, [key], [(C("area"), {"_sa": 0.5})]).join(a.groupBy(key).agg(F.sum("area").alias("_cov")), key)
    out = m.join(q, key, "left").join(stars, key, "left")
    has = C("_sa").isNotNull()
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        key, "bg_median", "black_pixel_ratio", "highlight_clip_ratio", clamp(z(C("n__sa") / float(area)), 0.0, 0.2).alias("star_density"),
        clamp(z(F.lit(2.0) * F.sqrt(C("_sa") / F.pi())), 0.0, 64.0).alias("median_star_size"), z(C("_cov") / float(area)).alias("star_coverage_ratio"),
        clamp(F.when(has, C("_st") / F.greatest("_tot", F.lit(e))).otherwise(F.lit(0.0))).alias("star_energy_ratio"), z(C("sat50")).alias("saturation_median"), z(C("sat95")).alias("saturation_p95"),
        z(C("microcontrast")).alias("microcontrast"), F.greatest(F.lit(0.0), C("blue") - F.greatest(F.lit(1.08), C("red") + 0.12)).alias("blue_excess"))


def adaptive_features(grid: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Routing scores of each image (expects ``l`` on a full grid)."""
    d = sky_stats(grid, 0.35, 0.35, 0, key)
    d = box_blur(d, {"l": "_s2"}, 2, [key])
    d = box_blur(d, {"l": "_s1"}, 1, [key])
    d = with_quantiles(d, [key], [(C("l"), {"q72": 0.72, "q985": 0.985, "q58": 0.58}), (C("l") - C("_s1"), {"q992": 0.992})])
    d = with_stats(d, [key], {"_ls": F.stddev_pop(C("l") - C("_s1"))})
    d = d.withColumns({
        "thr": F.greatest(C("q72"), C("bg_median") + F.greatest(C("bg_std") * 2.0, _floor("bg_median", "bg_mad", 0.015, 6.0, 0.08, 0.00015))),
        "_faint_t": F.greatest(C("q58"), C("bg_median") + F.greatest(C("bg_std") * 1.1, _floor("bg_median", "bg_mad", 0.008, 3.0, 0.05, 0.00008))),
        "bright": C("l") > F.greatest(C("q985"), C("bg_median") + F.greatest(C("bg_std") * 6.0, F.lit(0.08))),
        "star": C("l") - C("_s1") > F.greatest(C("q992"), C("_ls") * 3.0)})
    d = d.withColumns({"obj": C("l") > C("thr"), "faint": (C("l") > C("_faint_t")) & ~C("bright"), "_b": C("bright").cast("double"), "_st": C("star").cast("double")})
    d = box_blur(d, {"_b": "_b3"}, 3, [key])
    d = box_blur(d, {"_st": "_st1"}, 1, [key])
    d = with_stats(d, [key], {"_nsig": F.count_if(C("l") > C("_faint_t"))})
    sig = (C("l") > C("_faint_t")) | (C("_nsig") < 32)
    n8 = max(1, side // 8)
    cr = [C(c) - C("l") for c in "rgb"]
    cm = (cr[0] + cr[1] + cr[2]) / 3.0
    chroma = F.sqrt(((cr[0] - cm) * (cr[0] - cm) + (cr[1] - cm) * (cr[1] - cm) + (cr[2] - cm) * (cr[2] - cm)) / 3.0)
    q = quantiles(d, [key], [
        (F.when(C("y") < n8, C("l")), {"top": 0.5}), (F.when(C("y") >= side - n8, C("l")), {"bottom": 0.5}), (F.when(C("x") < n8, C("l")), {"left": 0.5}), (F.when(C("x") >= side - n8, C("l")), {"right": 0.5}),
        (F.when(C("_sky"), chroma), {"chroma": 0.5}), (F.when(C("faint"), F.abs(C("l") - C("_s2"))), {"texture": 0.5}),
        (F.when(sig, C("r")), {"rm": 0.5}), (F.when(sig, C("g")), {"gm": 0.5}), (F.when(sig, C("b")), {"bm": 0.5})])
    one = lambda c: F.avg(c.cast("int"))
    on = C("obj")
    m = d.groupBy(key).agg(
        F.max("bg_median").alias("bg_median"), F.max("bg_std").alias("bg_std"), F.max("thr").alias("thr"), one(on).alias("object_area_ratio"), one(C("bright")).alias("_ba"), F.max("l").alias("_mx"),
        one(C("l") >= 0.985).alias("core_clip_ratio"), one(C("faint")).alias("nebulosity_area_ratio"), one(C("star")).alias("star_density"), one(C("_b3") > 0.010).alias("_halo"), one(C("_st1") > 0.15).alias("_bloat"),
        F.min(F.when(on, C("x"))).alias("_x0"), F.max(F.when(on, C("x"))).alias("_x1"), F.min(F.when(on, C("y"))).alias("_y0"), F.max(F.when(on, C("y"))).alias("_y1"),
        F.count_if(on & (C("x") < side // 2)).alias("_lm"), F.count_if(on & (C("x") >= side // 2)).alias("_rm"))
    o = m.join(q, key)
    e = 1e-6
    xs, ys = C("_x1") - C("_x0") + 1, C("_y1") - C("_y0") + 1
    o = o.withColumns({
        "gradient_score": clamp((F.greatest("top", "bottom", "left", "right") - F.least("top", "bottom", "left", "right")) / F.greatest(C("bg_std") * 6.0, F.lit(0.01))),
        "chroma_noise_score": clamp(C("chroma") / F.greatest(C("bg_std") * 2.0, F.lit(0.01))),
        "core_peak_ratio": clamp((C("_mx") - C("bg_median")) / F.greatest(F.lit(1.0) - C("bg_median"), F.lit(1e-4))),
        "red_dominance": (C("rm") + e) / (C("gm") + e), "blue_dominance": (C("bm") + e) / (C("gm") + e),
        "green_cast": (C("gm") + e) / F.greatest((C("rm") + C("bm") + 2 * e) * 0.5, F.lit(e)),
        "has": C("_x0").isNotNull()})
    zero = F.lit(0.0)
    return o.select(
        key, "bg_median", "bg_std", "gradient_score",
        clamp(F.lit(0.40) * clamp(C("bg_std") / F.greatest("bg_median", F.lit(0.015))) + F.lit(0.35) * C("gradient_score") + F.lit(0.25) * C("chroma_noise_score")).alias("dirty_background_score"),
        "chroma_noise_score", "object_area_ratio", clamp(C("core_peak_ratio") * 0.7 + F.least(C("_ba") * 30.0, F.lit(1.0)) * 0.3).alias("bright_core_score"), "core_peak_ratio", "core_clip_ratio", "nebulosity_area_ratio",
        F.when(C("texture").isNotNull(), clamp(C("nebulosity_area_ratio") * 2.2 + C("texture") / F.greatest(C("bg_std") * 3.0, F.lit(0.01)))).otherwise(zero).alias("faint_structure_score"),
        F.when(C("has"), F.lit(1.0) - clamp(F.abs(C("_lm") - C("_rm")) / F.greatest(C("_lm") + C("_rm"), F.lit(1)))).otherwise(zero).alias("symmetry_score"),
        F.when(C("has"), clamp(F.abs(xs - ys) / F.greatest(xs, ys))).otherwise(zero).alias("elongation_score"),
        F.when(C("has"), clamp(C("object_area_ratio") / F.greatest(xs * ys / float(side * side), F.lit(1e-6)))).otherwise(zero).alias("compactness_score"),
        "star_density", clamp(C("_bloat") * 9.0).alias("star_bloat_score"), clamp(C("_halo") * 12.0).alias("halo_risk_score"), clamp(C("star_density") / 0.018).alias("dense_star_field_score"),
        "red_dominance", "blue_dominance", "green_cast",
        (F.lit(1.0) - clamp((F.abs(C("red_dominance") - 1.0) + F.abs(C("blue_dominance") - 1.0) + F.abs(C("green_cast") - 1.0)) / 2.5)).alias("color_balance_score"),
        clamp(C("blue_dominance") - F.greatest(F.lit(1.10), C("red_dominance") + 0.10)).alias("blue_excess_score"),
        clamp(C("bg_std") / F.greatest(C("thr") - C("bg_median"), F.lit(0.01))).alias("low_snr_score"))




def flags() -> dict[str, Column]:
    return {
        "bright_core": (C("bright_core_score") > 0.45) | (C("core_peak_ratio") > 0.70), "large_nebulosity": C("nebulosity_area_ratio") > 0.18,
        "faint_outer_cloud": C("faint_structure_score") > 0.30, "dense_star_field": C("dense_star_field_score") > 0.35, "reflection_blue": C("blue_dominance") > 1.12,
        "emission_red": C("red_dominance") > 1.08, "small_galaxy": (C("object_area_ratio") < 0.12) & (C("elongation_score") > 0.20),
        "star_cluster_dominant": (C("dense_star_field_score") > 0.55) & (C("nebulosity_area_ratio") < 0.20)}


def risks() -> dict[str, Column]:
    lv = lambda v, m, h: F.when(v >= h, "high").when(v >= m, "medium").otherwise("low")
    g = F.greatest
    return {
        "core_blowout": lv(g(C("bright_core_score"), C("core_clip_ratio") * 20.0), 0.40, 0.70), "dirty_background": lv(C("dirty_background_score"), 0.28, 0.45),
        "blue_excess": lv(C("blue_excess_score"), 0.08, 0.18), "star_removal_residue": lv(g(C("halo_risk_score"), C("star_bloat_score")), 0.35, 0.62),
        "overstretch": lv(g(C("low_snr_score"), C("dirty_background_score")), 0.35, 0.55), "halo_risk": lv(C("halo_risk_score"), 0.30, 0.60)}


def visual_type(f: DataFrame, hint: Column | None = None) -> DataFrame:
    """Target type and confidence by ordered rules; a text hint overrides."""
    fl = flags()
    rules = [
        ((C("low_snr_score") > 0.75) | (C("dirty_background_score") > 0.72), "generic_low_snr_safe", 0.56),
        (fl["star_cluster_dominant"] & (C("compactness_score") > 0.25) & (C("bright_core_score") > 0.35), "globular_cluster", 0.70),
        (fl["star_cluster_dominant"], "open_cluster", 0.64),
        (fl["bright_core"] & fl["large_nebulosity"] & fl["reflection_blue"] & fl["emission_red"], "bright_emission_reflection_nebula", 0.74),
        (fl["reflection_blue"] & (C("halo_risk_score") > 0.35), "reflection_nebula_cluster", 0.68),
        (fl["emission_red"] & fl["large_nebulosity"], "emission_nebula_widefield", 0.66),
        ((C("elongation_score") > 0.25) & (C("bright_core_score") > 0.30) & (C("nebulosity_area_ratio") < 0.28) & (C("object_area_ratio") < 0.11), "small_galaxy", 0.62),
        ((C("elongation_score") > 0.25) & (C("bright_core_score") > 0.30) & (C("nebulosity_area_ratio") < 0.28), "large_galaxy", 0.66),
        ((C("faint_structure_score") > 0.30) & (C("color_balance_score") > 0.70) & (C("bright_core_score") < 0.35), "dark_nebula_low_contrast", 0.58)]
    kind, conf = F.lit("generic_low_snr_safe"), F.lit(0.50)
    for cond, k, c in reversed(rules):
        kind, conf = F.when(cond, k).otherwise(kind), F.when(cond, c).otherwise(conf)
    if hint is not None:
        h = F.lower(hint)
        told = (
            F.when(h.contains("dark") & h.contains("nebula"), "dark_nebula_low_contrast").when(h.contains("emission"), "bright_emission_reflection_nebula")
            .when(h.contains("reflection"), "reflection_nebula_cluster").when(h.contains("nebula"), "bright_emission_reflection_nebula")
            .when(h.contains("galaxy"), "large_galaxy").when(h.contains("cluster"), "open_cluster"))
        kind = F.coalesce(told, kind)
    return f.select("image_id", kind.alias("target_type"), conf.alias("confidence"))


def target_type_rules(f: DataFrame) -> Column:
    """Target type from the eleven features by ordered thresholds."""
    c = C
    return (
        F.when((c("edge_black_ratio") < 0.04) & (c("bg_median") > 0.25) & (c("object_area_ratio") > 0.70) & (c("star_density") < 0.003), "planetary")
        .when((c("diffuse_ratio") > 0.50) & (c("object_area_ratio") > 0.18) & (c("red_dominance") > 1.12), "emission_nebula")
        .when((c("diffuse_ratio") > 0.50) & (c("object_area_ratio") > 0.18) & (c("blue_dominance") > 1.12), "reflection_nebula")
        .when(c("object_area_ratio").between(0.08, 0.45) & (c("core_brightness_ratio") > 0.05) & (c("diffuse_ratio") > 0.30) & (c("star_density") < 0.004), "galaxy")
        .when((c("object_area_ratio") < 0.20) & (c("core_brightness_ratio") > 0.08) & (c("diffuse_ratio") < 0.55) & ((c("red_dominance") > 1.10) | (c("blue_dominance") > 1.10)), "planetary_nebula")
        .when((c("star_density") > 0.0045) & (c("diffuse_ratio") < 0.22), F.when(c("object_area_ratio") < 0.22, "cluster").otherwise("widefield"))
        .when((c("star_density") > 0.0030) & (c("diffuse_ratio") < 0.30), "widefield").otherwise("unknown"))


def auto_tune(f: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Changed parameters from feature formulas: one row per parameter that leaves its default."""
    n = clamp((C("bg_std") - 0.015) / 0.070)
    s = clamp(C("star_density") / 0.010)
    di = clamp(C("diffuse_ratio"))
    co = clamp((C("core_brightness_ratio") - 0.01) / 0.14)
    ed = clamp((C("edge_black_ratio") - 0.05) / 0.50)
    re = clamp((C("red_dominance") - 1.0) / 0.5)
    bl = clamp((C("blue_dominance") - 1.0) / 0.5)
    ob = clamp(C("object_area_ratio"))
    f = f.withColumns({"_n": n, "_s": s, "_d": di, "_c": co, "_e": ed, "_r": re, "_b": bl, "_o": ob})
    n, s, di, co, ed, re, bl, ob = (C(c) for c in ("_n", "_s", "_d", "_c", "_e", "_r", "_b", "_o"))
    lit = F.lit
    star = lit(1.08) - lit(0.17) * s - lit(0.08) * di + lit(0.05) * co
    formulas = {
        "stage2_base_crop_margin": lit(0.01) + lit(0.03) * ed, "bg_samples": F.rint(lit(30.0) - lit(10.0) * ob - lit(6.0) * s + lit(4.0) * n),
        "bg_tolerance": lit(0.75) + lit(0.5) * (lit(1.0) - di) - lit(0.15) * s, "bg_smooth": lit(0.45) + lit(0.35) * ob + lit(0.20) * n,
        "denoise_mod": lit(0.24) + lit(0.22) * n - lit(0.06) * co, "asinh_stretch": lit(2.05) + lit(0.9) * di - lit(0.55) * n - lit(0.45) * co,
        "asinh_offset": lit(0.0009) + lit(0.0011) * co + lit(0.0006) * re, "ghs_shadowsclip": lit(-3.2) + lit(0.8) * co + lit(0.3) * n,
        "ghs_stretchamount": lit(2.3) - lit(0.55) * co - lit(0.35) * n, "nebula_saturation": lit(0.16) + lit(0.27) * di - lit(0.12) * s - lit(0.18) * re + lit(0.08) * bl,
        "star_intensity": star, "stage9_fallback_intensity_cap": star - 0.06, "final_saturation": lit(0.07) + lit(0.12) * di - lit(0.07) * s - lit(0.10) * re + lit(0.05) * bl}
    rows = F.array(*[F.struct(lit(k).alias("parameter"), lit(float(defaults.get(k, 0.0))).alias("default"), v.alias("value")) for k, v in formulas.items()])
    return f.select("image_id", F.explode(rows).alias("p")).select("image_id", "p.*").where(C("value") != C("default"))
