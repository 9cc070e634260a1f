"""Baseline against candidate: measures on frozen regions, growth and retention ratios.

A pair table has r,g,b,l (baseline), r2,g2,b2,l2 (candidate) and soft masks per pixel.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import pixel as px
from ..functions.fixed import clamp
from ..session import shared
from .grid import box_blur, repeated_blur
from .quantiles import correlation, quantiles, robust_sigma, weighted_quantiles, with_quantiles, with_stats

C = F.col


def _opp(s: str = "") -> tuple[Column, Column]:
    return C(f"r{s}") - C(f"g{s}"), C(f"b{s}") - C(f"g{s}")


def rendition(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Subject and background luminance, span, saturation, opponent energy and microcontrast of both images."""
    d = box_blur(pair, {"l": "_s", "l2": "_s2"}, 1, [key])
    sub, bg = C("subject") > 0.5, C("background") > 0.5
    specs = []
    for s, sm in (("", "_s"), ("2", "_s2")):
        l = C(f"l{s}")
        sat = px.saturation_hsv(C(f"r{s}"), C(f"g{s}"), C(f"b{s}"))
        specs += [
            (F.when(sub, l), {f"subject{s}": 0.5, f"_p05{s}": 0.05, f"_p95{s}": 0.95}), (F.when(bg, l), {f"bg{s}": 0.5}),
            (F.when(sub, sat), {f"sat50{s}": 0.5, f"sat95{s}": 0.95}), (F.when(sub, F.abs(l - C(sm))), {f"micro{s}": 0.5})]
    q = quantiles(d, [key], specs)
    (rg, bgc), (rg2, bg2) = _opp(), _opp("2")
    on = lambda c: F.when(sub, c)
    a = d.groupBy(key).agg(
        F.sqrt(F.avg(on(rg * rg + bgc * bgc))).alias("opp"), F.sqrt(F.avg(on(rg2 * rg2 + bg2 * bg2))).alias("opp2"), F.sum(on(rg * rg2 + bgc * bg2)).alias("_dot"),
        F.sum(on(rg * rg + bgc * bgc)).alias("_a"), F.sum(on(rg2 * rg2 + bg2 * bg2)).alias("_b"), F.count_if(sub).alias("subject_pixels"))
    o = q.join(a, key)
    ratio = lambda a_, b_: C(a_) / F.greatest(C(b_), F.lit(1e-9))
    return o.select(
        key, "subject_pixels", "subject", "bg", (C("_p95") - C("_p05")).alias("span"), "sat50", "sat95", "opp", "micro", C("subject2").alias("subject2"), "bg2",
        (C("_p952") - C("_p052")).alias("span2"), "sat502", "sat952", "opp2", "micro2",
        ratio("sat502", "sat50").alias("sat50_ratio"), ratio("sat952", "sat95").alias("sat95_ratio"), ratio("opp2", "opp").alias("opp_ratio"), ratio("micro2", "micro").alias("micro_ratio"),
        (C("_dot") / F.greatest(F.sqrt(C("_a") * C("_b")), F.lit(1e-12))).alias("opp_direction"),
        (((C("subject2") - C("bg2")) / F.greatest(C("subject") - C("bg"), F.lit(1e-9)))).alias("visibility"))


def transform_loss(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Exact clip counts before and after for background and the whole image (grouping sets)."""
    low = lambda s: sum(((C(f"{c}{s}") <= 0.0).cast("int") for c in "rgb"), F.lit(0))
    high = lambda s: sum(((C(f"{c}{s}") >= 1.0).cast("int") for c in "rgb"), F.lit(0))
    d = pair.select(key, F.when(C("background") > 0.5, "background").otherwise("other").alias("region"), low("").alias("l0"), low("2").alias("l1"), high("").alias("h0"), high("2").alias("h1"))
    g = d.rollup(key, "region").agg(F.sum("l0").alias("low_before"), F.sum("l1").alias("low_after"), F.sum("h0").alias("high_before"), F.sum("h1").alias("high_after"), F.count("*").alias("pixels"))
    return g.where(C(key).isNotNull()).withColumn("region", F.coalesce("region", F.lit("all")))


def colour_report(pair: DataFrame, rois: list[str], key: str = "image_id") -> DataFrame:
    """Weighted colour deltas per region: luminance, chromaticity distance, hue drift, changed share."""
    xy, xy2 = px.chromaticity(C("r"), C("g"), C("b")), px.chromaticity(C("r2"), C("g2"), C("b2"))
    (h, s), (h2, s2) = px.opponent_hue(*xy), px.opponent_hue(*xy2)
    dist = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(xy2, xy)), F.lit(0.0)))
    d = pair.withColumns({
        "_dl": F.abs(C("l2") - C("l")), "_dc": dist, "_dh": px.circular_delta(h2, h), "_hs": clamp(F.least(s, s2) / 0.08),
        "_ch": (F.greatest(*[F.abs(C(f"{c}2") - C(c)) for c in "rgb"]) > 1e-4).cast("double")})
    roi = F.explode(F.array(*[F.struct(F.lit(n).alias("roi"), C(n).alias("w")) for n in rois]))
    d = d.select(key, "_dl", "_dc", "_dh", "_hs", "_ch", roi.alias("m")).select(key, "_dl", "_dc", "_dh", "_hs", "_ch", C("m.roi").alias("roi"), clamp(C("m.w")).alias("w"))
    d = shared(d)
    k = [key, "roi"]
    out = weighted_quantiles(d, k, C("_dl"), C("w"), {"luma_p50": 0.5, "luma_p95": 0.95}).drop("wmean")
    out = out.join(weighted_quantiles(d, k, C("_dc"), C("w"), {"chroma_p50": 0.5, "chroma_p95": 0.95}).drop("samples", "weight_sum", "wmean"), k, "left")
    hue = weighted_quantiles(d, k, C("_dh"), C("w") * C("_hs"), {"hue_p50": 0.5}).drop("samples", "weight_sum", "wmean")
    ch = d.where(C("w") > 1e-6).groupBy(*k).agg((F.sum(C("_ch") * C("w")) / F.sum("w")).alias("changed_share"))
    return out.join(hue.withColumn("hue_p50", F.degrees("hue_p50")), k, "left").join(ch, k, "left")


def chroma_lineage(pair: DataFrame, passes: tuple[int, ...] = (1, 2, 4), key: str = "image_id") -> DataFrame:
    """Low-frequency opponent energy retained by the candidate in the subject after n 3x3 passes."""
    (rg, bg), (rg2, bg2) = _opp(), _opp("2")
    d = pair.withColumns({"_a": rg, "_b": bg, "_c": rg2, "_e": bg2})
    outs = []
    for n in range(1, max(passes) + 1):
        src = (lambda c: c) if n == 1 else (lambda c: f"{c}{n - 1}")
        d = box_blur(d, {src(c): f"{c}{n}" for c in ("_a", "_b", "_c", "_e")}, 1, [key])
        if n in passes:
            outs.append(n)
    on = C("subject") > 0.5
    e = lambda a, b: F.sqrt(F.avg(F.when(on, C(a) * C(a) + C(b) * C(b))))
    agg = d.groupBy(key).agg(*[(e(f"_c{n}", f"_e{n}") / F.greatest(e(f"_a{n}", f"_b{n}"), F.lit(1e-9))).alias(f"retention_{n}") for n in outs])
    q = quantiles(pair, [key], [(F.when(on, px.saturation_hsv(C("r"), C("g"), C("b"))), {"sat_before": 0.5}), (F.when(on, px.saturation_hsv(C("r2"), C("g2"), C("b2"))), {"sat_after": 0.5})])
    return agg.join(q.select(key, "sat_before", "sat_after"), key)


def weak_chroma(grid: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Support, cell and quadrant coverage, energy ratio, SNR and scale correlation of subject chroma."""
    d = grid.withColumn("_o", F.sqrt((C("r") - C("g")) * (C("r") - C("g")) + (C("b") - C("g")) * (C("b") - C("g"))))
    d = box_blur(d, {"_o": "_o1"}, 1, [key])
    d = box_blur(d, {"_o1": "_o2"}, 2, [key])
    sub, bg = C("subject") > 0.25, C("background") > 0.5
    cell = F.floor(C("y") * 4 / side) * 4 + F.floor(C("x") * 4 / side)
    quad = F.floor(C("y") * 2 / side) * 2 + F.floor(C("x") * 2 / side)
    # at most 16 cells and 4 quadrants exist, so the bit masks stand for exact distinct counts
    bits = lambda c: F.bit_count(F.bit_or(F.when(sub, F.pow(F.lit(2.0), c).cast("int")).otherwise(F.lit(0))))
    a = d.groupBy(key).agg(
        F.count_if(sub).alias("support"), bits(cell).alias("cells"), bits(quad).alias("quadrants"),
        (F.avg(F.when(sub, C("_o1") * C("_o1"))) / F.greatest(F.avg(F.when(bg, C("_o1") * C("_o1"))), F.lit(1e-12))).alias("energy_ratio"),
        correlation(F.when(sub, C("_o1")), F.when(sub, C("_o2"))).alias("scale_corr"), F.avg(F.when(sub, C("_o1"))).alias("_ms"), F.avg(F.when(bg, C("_o1"))).alias("_mb"))
    s = robust_sigma(d, [key], {"bg": F.when(bg, C("_o") - C("_o1"))}, minimum=1)
    o = a.join(s, key).withColumn("snr", (C("_ms") - C("_mb")) / F.greatest(C("bg_sigma"), F.lit(1e-9)))
    ok = (C("support") >= 16) & (C("cells") >= 3) & (C("quadrants") >= 2) & (C("energy_ratio") >= 1.2) & (C("scale_corr") >= 0.5)
    return o.select(key, "support", C("cells").cast("int").alias("cells"), C("quadrants").cast("int").alias("quadrants"), "energy_ratio", "snr", "scale_corr", ok.alias("evident"))


def noise_growth(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Sky noise of the candidate over the noise the same tone map gives to the source (column ``tone``)."""
    d = box_blur(pair, {"l": "_s", "l2": "_s2", "tone": "_st"}, 1, [key])
    bg = C("background") > 0.5
    s = robust_sigma(d, [key], {"before": F.when(bg, C("l") - C("_s")), "after": F.when(bg, C("l2") - C("_s2")), "expected": F.when(bg, C("tone") - C("_st"))})
    g = C("after_sigma") / F.greatest("expected_sigma", F.lit(1e-9))
    return s.select(key, "before_sigma", "after_sigma", "expected_sigma", g.alias("growth"), (g <= 1.25).alias("accepted"))


def multiscale_contrast(pair: DataFrame, radii: tuple[int, ...] = (1, 2, 4), key: str = "image_id") -> DataFrame:
    """Contrast transfer |band of candidate| / |band of baseline| at fixed scales."""
    d = pair
    for r in radii:
        d = box_blur(d, {"l": f"_a{r}", "l2": f"_b{r}"}, r, [key])
    agg = []
    for r in radii:
        agg.append((F.avg(F.abs(C("l2") - C(f"_b{r}"))) / F.greatest(F.avg(F.abs(C("l") - C(f"_a{r}"))), F.lit(1e-9))).alias(f"transfer_{r}"))
    return d.groupBy(key).agg(*agg)


def vector_drift(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Angle in degrees between RGB directions and half the L1 chromaticity distance."""
    dot = C("r") * C("r2") + C("g") * C("g2") + C("b") * C("b2")
    n = lambda s: F.sqrt(C(f"r{s}") * C(f"r{s}") + C(f"g{s}") * C(f"g{s}") + C(f"b{s}") * C(f"b{s}"))
    ang = F.degrees(F.acos(clamp(dot / F.greatest(n("") * n("2"), F.lit(1e-12)), -1.0, 1.0)))
    xy, xy2 = px.chromaticity(C("r"), C("g"), C("b")), px.chromaticity(C("r2"), C("g2"), C("b2"))
    l1 = sum((F.abs(a - b) for a, b in zip(xy, xy2)), F.lit(0.0)) * 0.5
    q = quantiles(pair, [key], [(ang, {"angle_p50": 0.5, "angle_p95": 0.95}), (l1, {"l1_p95": 0.95})])
    return q.select(key, "angle_p50", "angle_p95", "l1_p95")


def target_local(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Contrast and clip per luminance region of a four-times blurred source, before and after."""
    cur = "_f4"
    d = repeated_blur(pair, "l", {4: cur}, [key])
    d = with_quantiles(d, [key], [(C(cur), {"p35": 0.35, "p55": 0.55, "p90": 0.90, "p99": 0.99})])
    v = C(cur)
    region = F.when(v <= C("p35"), "background").when(v <= C("p55"), "dark").when(v <= C("p90"), "faint").when(v > C("p99"), "core").otherwise("bright")
    d = d.withColumn("region", region).where(C("l") < 0.985)
    return d.groupBy(key, "region").agg(
        F.count("*").alias("pixels"), F.avg("l").alias("level"), F.avg("l2").alias("level2"), F.stddev_pop("l").alias("contrast"), F.stddev_pop("l2").alias("contrast2"),
        F.avg((F.greatest("r2", "g2", "b2") >= 1.0).cast("int")).alias("clip2"))


def structure_correlation(pair: DataFrame, key: str = "image_id") -> DataFrame:
    d = box_blur(pair, {"l": "_s", "l2": "_s2"}, 2, [key]).where(C("subject") > 0.25)
    return d.groupBy(key).agg(F.count("*").alias("pixels"), correlation(C("l") - C("_s"), C("l2") - C("_s2")).alias("correlation"))


def reference_metrics(grid: DataFrame, key: str = "image_id") -> DataFrame:
    """Saturation, fine and coarse sigma, contrast and shares of extreme pixels."""
    d = box_blur(grid, {"l": "_s1"}, 1, [key])
    d = shared(box_blur(d, {"l": "_s4"}, 4, [key]))
    sat = px.saturation_hsv(C("r"), C("g"), C("b"))
    q = quantiles(d, [key], [(F.when(C("subject") > 0.25, sat), {"saturation": 0.5}), (C("l"), {"_p05": 0.05, "_p95": 0.95})])
    s = robust_sigma(d, [key], {"fine": F.when(C("background") > 0.5, C("l") - C("_s1")), "coarse": F.when(C("background") > 0.5, C("_s4"))})
    share = lambda c: F.avg(c.cast("int"))
    a = d.groupBy(key).agg(share(C("l") <= 0.01).alias("black_share"), share(C("l") >= 0.985).alias("highlight_share"), share(sat >= 0.95).alias("extreme_saturation_share"))
    return q.join(s, key).join(a, key).select(key, "saturation", (C("_p95") - C("_p05")).alias("contrast"), "fine_sigma", "coarse_sigma", "black_share", "highlight_share", "extreme_saturation_share")


def crop_area_limit(crops: DataFrame, keep_share: float = 0.64, key: str = "image_id") -> DataFrame:
    """Union of crop proposals (x, y, w, h), pulled back to the centred area that must stay.

    The kept rectangle is the intersection of the proposals; where it would cut into
    the protected centre, its bounds give way to the centre.
    """
    u = crops.groupBy(key).agg(F.max("x").alias("x0"), F.max("y").alias("y0"), F.min(C("x") + C("w")).alias("x1"), F.min(C("y") + C("h")).alias("y1"), F.max("width").alias("width"), F.max("height").alias("height"))
    m = (1.0 - keep_share**0.5) / 2.0
    cx0, cy0 = F.floor(C("width") * m), F.floor(C("height") * m)
    b = u.select(key, "width", "height", F.least("x0", cx0).alias("x0"), F.least("y0", cy0).alias("y0"), F.greatest("x1", C("width") - cx0).alias("x1"), F.greatest("y1", C("height") - cy0).alias("y1"),
                 ((C("x0") > cx0) | (C("y0") > cy0) | (C("x1") < C("width") - cx0) | (C("y1") < C("height") - cy0)).alias("limited"))
    area = (C("x1") - C("x0")) * (C("y1") - C("y0")) / (C("width") * C("height"))
    return b.select(key, "x0", "y0", (C("x1") - C("x0")).alias("w"), (C("y1") - C("y0")).alias("h"), area.alias("area_share"), "limited")


def signal_preservation(pair: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Flux, core and nebula retention, morphology and centroid shift on coordinates frozen on the baseline."""
    d = with_quantiles(pair, [key], [(C("l"), {"p35": 0.35, "p70": 0.70, "p97": 0.97})])
    d = with_stats(d, [key], {"_b0": F.avg(F.when(C("l") <= C("p35"), C("l"))), "_b1": F.avg(F.when(C("l") <= C("p35"), C("l2"))), "_sd": F.stddev_pop(F.when(C("l") <= C("p35"), C("l2") - C("l")))})
    tgt, core = C("l") > C("p70"), C("l") > C("p97")
    f0, f1 = C("l") - C("_b0"), C("l2") - C("_b1")
    s = lambda m, e: F.sum(F.when(m, e))
    a = d.groupBy(key).agg(
        F.count_if(tgt).alias("pixels"), s(tgt, f0).alias("_f0"), s(tgt, f1).alias("_f1"), s(core, f0).alias("_c0"), s(core, f1).alias("_c1"), s(tgt & ~core, f0).alias("_n0"), s(tgt & ~core, f1).alias("_n1"),
        correlation(F.when(tgt, C("l")), F.when(tgt, C("l2"))).alias("morphology"), F.stddev_pop(F.when(tgt, f1 - f0)).alias("_st"), F.max("_sd").alias("_sd"),
        s(tgt, f0 * C("x")).alias("_x0"), s(tgt, f1 * C("x")).alias("_x1"), s(tgt, f0 * C("y")).alias("_y0"), s(tgt, f1 * C("y")).alias("_y1"))
    r = lambda a_, b_: C(b_) / F.greatest(C(a_), F.lit(1e-9))
    dx, dy = C("_x1") / C("_f1") - C("_x0") / C("_f0"), C("_y1") / C("_f1") - C("_y0") / C("_f0")
    noise = F.greatest(C("_sd"), F.lit(1e-9))
    return a.select(
        key, "pixels", r("_f0", "_f1").alias("flux"), r("_c0", "_c1").alias("core"), r("_n0", "_n1").alias("nebula"), "morphology", (F.sqrt(dx * dx + dy * dy) / float(side)).alias("centroid"),
        ((C("_f1") - C("_f0")) / (noise * F.sqrt("pixels"))).alias("flux_sigma"), (C("_st") / noise).alias("structure"))


def sigma_rejection_stack(frames: DataFrame, low: float = 3.0, high: float = 3.0, frame_k: float = 3.0, target: str | None = None) -> DataFrame:
    """Mean of aligned frames per pixel after additive+scale normalisation and sigma rejection.

    With ``target`` the frames of each target are stacked by themselves. Frame level: median and
    MAD give location and scale; frames whose scale lies outside ``frame_k`` robust sigmas of the
    target's frames are left out. The pixel step is one aggregate per pixel for mean and deviation
    and one filtered aggregate, both with map-side combine; the frame statistics are joined back
    by frame.
    """
    key = [target] if target else ["_all"]
    frames = frames if target else frames.withColumn("_all", F.lit(1))
    st = robust_sigma(frames, [*key, "frame_id"], {"v": C("v")}, minimum=1)
    # one row per frame, then one per target
    st = st.select(*key, "frame_id", C("v_med").alias("loc"), F.greatest("v_sigma", F.lit(1e-9)).alias("scale"))
    ref = robust_sigma(st, key, {"s": C("scale"), "m": C("loc")}, minimum=1, whole=False)
    st = st.join(ref, key)
    st = st.withColumn("used", F.abs(C("scale") - C("s_med")) <= F.greatest(C("s_sigma") * frame_k, F.lit(1e-9)))
    good = frames.join(st.where("used").select(*key, "frame_id", "loc", "scale", "s_med", "m_med"), [*key, "frame_id"])
    n = good.select(*key, "y", "x", ((C("v") - C("loc")) / C("scale") * C("s_med") + C("m_med")).alias("n"))
    m = n.groupBy(*key, "y", "x").agg(F.avg("n").alias("_m"), F.stddev_pop("n").alias("_s"), F.count("*").alias("frames"))
    keep = n.join(m, [*key, "y", "x"]).where((C("n") >= C("_m") - C("_s") * low) & (C("n") <= C("_m") + C("_s") * high))
    out = keep.groupBy(*key, "y", "x").agg(F.avg("n").alias("value"), F.count("*").alias("kept"), F.max("frames").alias("frames"))
    return out.select(*([target] if target else []), "y", "x", "value", "frames", (C("frames") - C("kept")).alias("rejected"))


def outside_identity(pair: DataFrame, masks: list[Column], key: str = "image_id") -> DataFrame:
    """Pixels outside the union of the allowed masks must be unchanged; missing pixels are a shape mismatch."""
    inside = F.lit(False)
    for m in masks:
        inside = inside | F.coalesce(m, F.lit(False))
    hole = C("r").isNull() | C("r2").isNull()
    change = F.greatest(*[F.abs(C(f"{c}2") - C(c)) for c in "rgb"])
    return pair.groupBy(key).agg(
        F.count_if(~inside).alias("outside"), F.coalesce(F.max(F.when(~inside, change)), F.lit(0.0)).alias("max_change"), F.count_if(hole).alias("shape_mismatch")
    ).withColumn("identical", (C("max_change") <= 0.0) & (C("shape_mismatch") == 0))


def denoise_metrics(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Metrics of a denoise candidate on the baseline's sky and signal (radii 1, 2 and the wide 8 or less)."""
    d = with_quantiles(pair, [key], [(C("l"), {"q005": 0.005, "q45": 0.45, "q70": 0.70, "q97": 0.97, "q99": 0.99})])
    ch = lambda s: ((C(f"r{s}") - C(f"g{s}")) + (C(f"b{s}") - C(f"g{s}"))) * 0.5
    d = d.withColumns({"_c": ch(""), "_c2": ch("2")})
    d = box_blur(d, {"l": "_l1", "l2": "_m1", "_c": "_k1", "_c2": "_k2"}, 1, [key])
    d = box_blur(d, {"l": "_l2", "l2": "_m2"}, 2, [key])
    d = box_blur(d, {"l": "_l8", "l2": "_m8"}, 8, [key])
    bg = (C("l") >= C("q005")) & (C("l") <= C("q45"))
    sig = (C("l") >= C("q70")) & (C("l") <= C("q97"))
    s = robust_sigma(d, [key], {"n0": F.when(bg, C("l") - C("_l1")), "n1": F.when(bg, C("l2") - C("_m1")), "c0": F.when(bg, C("_c") - C("_k1")), "c1": F.when(bg, C("_c2") - C("_k2"))})
    q = quantiles(d, [key], [(F.when(bg, C("l")), {"b0": 0.5}), (F.when(bg, C("l2")), {"b1": 0.5})])
    clip = lambda x: (sum((((C(f"{c}{x}") <= 0) | (C(f"{c}{x}") >= 1)).cast("int") for c in "rgb"), F.lit(0))) / 3.0
    a = d.groupBy(key).agg(
        F.avg(F.when(sig, F.abs(C("_l2") - C("_l8")))).alias("_e0"), F.avg(F.when(sig, F.abs(C("_m2") - C("_m8")))).alias("_e1"),
        F.avg((C("l") >= C("q99")).cast("int")).alias("_r0"), F.avg((C("l2") >= C("q99")).cast("int")).alias("_r1"), (F.avg(clip("2")) - F.avg(clip(""))).alias("clip_growth"))
    o = s.join(q, key).join(a, key)
    g = lambda a_, b_: C(b_) / F.greatest(C(a_), F.lit(1e-9))
    growth = F.when(C("c0_sigma") <= 1e-9, F.when(C("c1_sigma") <= 1e-9, 1.0).otherwise(F.lit(1e9))).otherwise(C("c1_sigma") / C("c0_sigma"))
    return o.select(key, C("n0_sigma").alias("sigma_before"), C("n1_sigma").alias("sigma_after"), (F.lit(1.0) - g("n0_sigma", "n1_sigma")).alias("noise_reduction"), g("_e0", "_e1").alias("detail_retention"),
                    F.abs(C("b1") - C("b0")).alias("median_drift"), (g("_r0", "_r1") - 1.0).alias("spread_growth"), growth.alias("chroma_growth"), "clip_growth")


def soft_threshold(grid: DataFrame, sigmas: DataFrame, radii: tuple[int, ...], strength: float, luma_k: float = 1.35, chroma_k: float = 1.90, key: str = "image_id") -> DataFrame:
    """Shrinks luminance and opponent detail per scale, blended by the signal weight.

    ``sigmas`` has l_<r>, rg_<r>, bg_<r> per image (from the noise model).
    """
    d = with_quantiles(grid, [key], [(C("l"), {"_q45": 0.45, "_q95": 0.95})])
    d = d.withColumns({"rg": C("r") - C("g"), "bg": C("b") - C("g"), "_sw": clamp((C("l") - C("_q45")) / F.greatest(C("_q95") - C("_q45"), F.lit(1e-6)))})
    d = d.withColumn("_bl", F.lit(max(0.1, min(1.0, strength))) * (F.lit(1.0) - F.lit(0.92) * C("_sw")))
    planes = ("l", "rg", "bg")
    cur = {p: p for p in planes}
    for r in radii:
        nxt = {p: f"{p}_s{r}" for p in planes}
        d = box_blur(d, {cur[p]: nxt[p] for p in planes}, r, [key])
        d = d.withColumns({f"{p}_d{r}": C(cur[p]) - C(nxt[p]) for p in planes})
        cur = nxt
    d = d.join(sigmas, key)
    new = {}
    for p in planes:
        k = luma_k if p == "l" else chroma_k
        total = C(cur[p])
        for r in radii:
            t = C(f"{p}_sig_{r}") * F.lit(k * strength)
            dd = C(f"{p}_d{r}")
            total = total + F.signum(dd) * F.greatest(F.abs(dd) - t, F.lit(0.0))
        new[p] = total
    d = d.withColumns({f"_{p}n": e for p, e in new.items()})
    mix = lambda p: C(p) + (C(f"_{p}n") - C(p)) * C("_bl")
    d = d.withColumns({"_L": mix("l"), "_RG": mix("rg"), "_BG": mix("bg")})
    # luminance and the two opponent planes determine the channels
    g = C("_L") - F.lit(0.2126) * C("_RG") - F.lit(0.0722) * C("_BG")
    return d.select(key, "y", "x", (g + C("_RG")).alias("r"), g.alias("g"), (g + C("_BG")).alias("b"))


def structure_growth(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Change of luminance rank inside the star support, so that a monotone stretch does not count."""
    from .quantiles import with_percent_rank
    d = with_percent_rank(pair, [key], C("l"), "_p0")
    d = with_percent_rank(d, [key], C("l2"), "_p1")
    d = d.withColumn("_d", C("_p1") - C("_p0")).where(C("core") > 0.5)
    q = quantiles(d, [key], [(F.abs("_d"), {"abs_p95": 0.95}), (C("_d"), {"median": 0.5})])
    return q.select(key, C("n_abs_p95").alias("pixels"), "abs_p95", "median")


def boundary_seam(pair: DataFrame, minimum: int = 16, key: str = "image_id") -> DataFrame:
    """Residual of the smoothed change at the subject boundary against the interior."""
    dl = C("l2") - C("l")
    dc = F.sqrt((C("r2") - C("r") - dl) * (C("r2") - C("r") - dl) + (C("b2") - C("b") - dl) * (C("b2") - C("b") - dl))
    d = pair.withColumns({"_dl": dl, "_dc": dc})
    for i in range(3):
        s = "" if i == 0 else str(i)
        d = box_blur(d, {f"_dl{s}": f"_dl{i + 1}", f"_dc{s}": f"_dc{i + 1}"}, 1, [key])
    w = C("subject")
    edge, core = (w > 0.05) & (w < 0.80), w >= 0.80
    rl, rc = F.abs(C("_dl") - C("_dl3")), F.abs(C("_dc") - C("_dc3"))
    q = quantiles(d, [key], [(F.when(edge, rl), {"luma_edge": 0.95}), (F.when(core, rl), {"luma_core": 0.95}), (F.when(edge, rc), {"chroma_edge": 0.95}), (F.when(core, rc), {"chroma_core": 0.95})])
    few = (C("n_luma_edge") < minimum) | (C("n_luma_core") < minimum)
    lr, cr = C("luma_edge") / F.greatest("luma_core", F.lit(1e-9)), C("chroma_edge") / F.greatest("chroma_core", F.lit(1e-9))
    seam = ((C("luma_edge") > 0.0035) & (lr > 1.60)) | ((C("chroma_edge") > 0.0020) & (cr > 1.60))
    return q.select(key, C("n_luma_edge").alias("edge_pixels"), C("n_luma_core").alias("core_pixels"), "luma_edge", "chroma_edge", lr.alias("luma_ratio"), cr.alias("chroma_ratio"),
                    F.when(few, "unavailable").when(seam, "seam").otherwise("ok").alias("status"))


def tile_border(pair: DataFrame, tile: int, block: int, ratio_max: float, key: str = "image_id") -> DataFrame:
    """Texture of the candidate at tile seams against controls, and the share of affected blocks."""
    w = W.partitionBy(key, "y").orderBy("x").rangeBetween(-1, -1)
    step = F.abs(C("l2") - F.max("l2").over(w))
    d = with_quantiles(pair, [key], [(C("l"), {"p70": 0.70})]).withColumn("step", step).where((C("l") <= C("p70")) & C("step").isNotNull())
    d = d.withColumn("seam", (C("x") % tile == 0) & (C("x") > 0))
    q = quantiles(d, [key], [(F.when(C("seam"), C("step")), {"seam_p50": 0.5}), (F.when(~C("seam"), C("step")), {"control_p50": 0.5})])
    s = robust_sigma(d, [key], {"c": F.when(~C("seam"), C("step"))}, minimum=1)
    b = d.groupBy(key, F.floor(C("y") / block).alias("by"), F.floor(C("x") / block).alias("bx")).agg(F.avg("step").alias("m"))
    b = with_quantiles(b, [key], [(C("m"), {"_bm": 0.5})])
    share = b.groupBy(key).agg(F.avg((C("m") > C("_bm") * ratio_max).cast("int")).alias("affected_share"))
    ratio = C("seam_p50") / F.greatest("control_p50", F.lit(1e-9))
    z = (C("seam_p50") - C("control_p50")) / F.greatest("c_sigma", F.lit(1e-9))
    return q.join(s, key).join(share, key).select(key, ratio.alias("ratio"), z.alias("sigma"), "affected_share", ((ratio > ratio_max) & (z > 3.0)).alias("artifact"))
