"""Tone and colour operators: per-image parameters next to pixels, then one projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixel as px
from ..functions.fixed import clamp, smoothstep
from .grid import box_blur
from .quantiles import quantiles, with_quantiles, with_stats

RGB = ("r", "g", "b")
C = F.col


def rgb(suffix: str = "") -> tuple[Column, ...]:
    return tuple(C(c + suffix) for c in RGB)


def before_after(base: DataFrame, cand: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixel join of baseline (r,g,b) and candidate (r2,g2,b2); unmatched pixels keep nulls."""
    c = cand.select(key, "y", "x", *[C(k).alias(f"{k}2") for k in RGB])
    return base.join(c, [key, "y", "x"], "full")


def domain_normalise(raw: DataFrame, key: str = "image_id") -> DataFrame:
    """Integers by full scale, declared scale otherwise; non-finite values become the channel median.

    raw has ``dtype`` (uint8, uint16 or float) and ``scale`` per row of an image.
    """
    full = F.when(C("dtype") == "uint8", 255.0).when(C("dtype") == "uint16", 65535.0).otherwise(C("scale"))
    bad = lambda c: C(c).isNull() | F.isnan(c) | (F.abs(C(c)) == float("inf"))
    out = raw.select(key, "y", "x", *[F.when(~bad(c), C(c) / full).alias(c) for c in RGB])
    out = with_quantiles(out, [key], [(C(c), {f"m_{c}": 0.5}) for c in RGB])
    filled = [F.coalesce(C(c), C(f"m_{c}"), F.lit(0.0)) for c in RGB]
    lost = F.array_contains(F.array(*[C(c).isNull() for c in RGB]), True)
    outside = F.array_contains(F.array(*[~f.between(0.0, 1.0) for f in filled]), True)
    return out.select(key, "y", "x", *[clamp(f).alias(c) for f, c in zip(filled, RGB)], lost.alias("replaced"), outside.alias("out_of_range"))


def grid_downsample(pix: DataFrame, limit: int, key: str = "image_id") -> DataFrame:
    """Every step-th row and column, step = ceil(longest side / limit)."""
    sized = with_stats(pix, [key], {"_h": F.max("y"), "_w": F.max("x")})
    step = F.greatest(F.lit(1), F.ceil((F.greatest("_h", "_w") + 1) / F.lit(float(limit)))).cast("int")
    out = sized.withColumn("step", step)
    return out.where((C("y") % C("step") == 0) & (C("x") % C("step") == 0)).drop("_h", "_w")


def statistical_mtf(pix: DataFrame, target: float, sigma: float = 5.0, key: str = "image_id") -> DataFrame:
    """Shadow and midtone of a linked stretch from the recentred lower-half MAD of all channel values."""
    vals = pix.select(key, F.explode(F.array(*rgb())).alias("v"))
    vals = with_quantiles(vals, [key], [(C("v"), {"p50": 0.5, "p99": 0.99, "p0": 0.0})])
    low = F.when(C("v") <= C("p50"), C("v"))
    vals = with_quantiles(vals, [key], [(low, {"low_center": 0.5})])
    lower_dev = F.abs(low - C("low_center"))
    agg = quantiles(vals, [key], [
        (lower_dev, {"lower_mad": 0.5}), (F.abs(C("v") - C("p50")), {"full_mad": 0.5}),
        (C("p50"), {"source_p50": 0.0}), (C("p99"), {"source_p99": 0.0}), (C("p0"), {"source_min": 0.0}),
    ])
    mad = F.when(C("n_lower_mad") < 16, C("full_mad")).otherwise(C("lower_mad"))
    black = F.least(F.greatest(C("source_min"), C("source_p50") - F.lit(sigma * 1.4826) * mad), F.lit(0.99))
    out = agg.withColumn("blackpoint", black)
    ok = (C("blackpoint") < C("source_p50")) & (C("source_p50") < 1.0)
    n50 = (C("source_p50") - C("blackpoint")) / F.greatest(F.lit(1.0) - C("blackpoint"), F.lit(1e-12))
    out = out.withColumn("midtones", F.when(ok, px.mtf_midpoint(n50, target)))
    one = F.lit(1.0)
    return out.select(
        key, "source_p50", "source_p99", "blackpoint", "midtones",
        px.mtf(C("source_p50"), C("blackpoint"), C("midtones"), one).alias("predicted_p50"),
        px.mtf(C("source_p99"), C("blackpoint"), C("midtones"), one).alias("predicted_p99"),
        F.when(ok, "available").otherwise("unavailable").alias("status"),
    )


def quantile_curve(pix: DataFrame, levels: list[float], targets: list[float], max_slope: float = 1000.0, key: str = "image_id") -> DataFrame:
    """Linked piecewise-linear curve through measured luminance quantiles, applied to every pixel.

    Images whose anchors do not rise strictly or whose slope exceeds the cap keep their pixels.
    """
    out = with_quantiles(pix, [key], [(C("l"), {f"q{i}": q for i, q in enumerate(levels)})])
    pts = F.array(*[F.struct(C(f"q{i}").alias("x"), F.lit(float(t)).alias("y")) for i, t in enumerate(targets)])
    steps = [(C(f"q{i+1}") - C(f"q{i}"), targets[i + 1] - targets[i]) for i in range(len(levels) - 1)]
    ok = F.lit(True)
    slope = F.lit(0.0)
    for dx, dy in steps:
        ok = ok & (dx > 0)
        slope = F.greatest(slope, F.when(dx > 0, F.lit(dy) / dx).otherwise(F.lit(float("inf"))))
    ok = ok & (slope <= max_slope)
    mapped = F.when(ok, F.least(px.piecewise(C("l"), pts), F.lit(0.995))).otherwise(C("l"))
    return out.select(key, "y", "x", "l", mapped.alias("mapped"), ok.alias("curve_ok"))


def display_lut(pix: DataFrame, nodes: int, black_q: float, strength: float, key: str = "image_id") -> DataFrame:
    """Display curve as a short LUT from a measured black level; luminance mapped, RGB by one safe gain."""
    out = with_quantiles(pix, [key], [(C("l"), {"black": black_q, "mid": 0.5})])
    grid = [i / (nodes - 1) for i in range(nodes)]
    # arcsinh curve above the black level, sampled on the nodes
    def y(g: float) -> Column:
        n = clamp((F.lit(g) - C("black")) / F.greatest(F.lit(1.0) - C("black"), F.lit(1e-12)))
        return F.asinh(n * F.lit(strength)) / F.asinh(F.lit(strength))
    pts = F.array(*[F.struct(F.lit(g).alias("x"), y(g).alias("y")) for g in grid])
    out = out.withColumn("lut", pts)
    mapped = px.piecewise(clamp(C("l")), C("lut"))
    return out.withColumn("mapped", mapped).select(
        key, "y", "x", "l", "mapped", *[e.alias(c) for e, c in zip(px.safe_gain(rgb(), C("mapped")), RGB)]
    )


def two_step_tone(displayed: DataFrame, target_background: float, key: str = "image_id") -> DataFrame:
    """Linked luminance power after a display curve so that the background falls to the target."""
    lum = displayed.withColumn("l1", px.luminance(*rgb()))
    out = with_quantiles(lum, [key], [(C("l1"), {"_bg": 0.25})])
    source = clamp(C("_bg"), 0.02, 0.80)
    target = F.least(F.greatest(F.lit(target_background), F.lit(0.04)), source)
    gamma = clamp(F.ln(target) / F.ln(source), 1.0, 1.65)
    out = out.withColumn("gamma", gamma)
    mapped = F.pow(clamp(C("l1")), C("gamma"))
    return out.select(key, "y", "x", "gamma", *[e.alias(c) for e, c in zip(px.safe_gain(rgb(), mapped), RGB)])


def local_masks(grid: DataFrame, key: str = "image_id") -> DataFrame:
    """Background, subject, faint, core, detail and chroma weights of every pixel (expects ``l``)."""
    out = box_blur(grid, {"l": "_s1"}, 1, [key])
    out = box_blur(out, {"_s1": "_s2"}, 1, [key])
    out = out.withColumn("_d", F.abs(C("l") - C("_s2")))
    out = with_quantiles(out, [key], [
        (C("l"), {"q10": 0.10, "q35": 0.35, "q55": 0.55, "q75": 0.75, "q92": 0.92, "q995": 0.995}), (C("_d"), {"_ds": 0.98})])
    out = out.withColumn("detail", clamp(C("_d") / F.greatest(C("_ds"), F.lit(1e-7))))
    out = out.withColumn("_c0", smoothstep(C("l"), C("q92"), C("q995")))
    out = box_blur(out, {"_c0": "_c1"}, 1, [key])
    core = clamp(C("_c1"))
    subject = smoothstep(C("l"), C("q55"), C("q92")) * (F.lit(1.0) - F.lit(0.92) * core) * (F.lit(1.0) - F.lit(0.30) * C("detail"))
    faint = smoothstep(C("l"), C("q35"), C("q75")) * (F.lit(1.0) - smoothstep(C("l"), C("q75"), C("q92"))) * (F.lit(1.0) - F.lit(0.75) * core)
    back = (F.lit(1.0) - smoothstep(C("l"), C("q10"), C("q55"))) * (F.lit(1.0) - F.lit(0.60) * C("detail"))
    chroma = (F.greatest(*rgb()) - F.least(*rgb())) / F.greatest(C("l"), F.lit(1e-5))
    return out.select(
        key, "y", "x", "h", "w", *RGB, "l", clamp(back).alias("background"), clamp(subject).alias("subject"), clamp(faint).alias("faint"),
        core.alias("core"), "detail", clamp(chroma).alias("chroma"),
    )


def curve_masked(pix: DataFrame, points: list[tuple[float, float]], opacity: float, mask: str = "subject") -> DataFrame:
    """User curve on luminance, blended by mask*opacity; an invalid curve changes nothing."""
    pts = px.curve(points)
    mapped = px.piecewise(C("l"), pts)
    gain = mapped / F.greatest(C("l"), F.lit(1e-7))
    w = F.when(px.valid_curve(pts), clamp(C(mask)) * F.lit(max(0.0, min(1.0, opacity)))).otherwise(F.lit(0.0))
    out = pix
    for c in RGB:
        out = out.withColumn(c, C(c) * (F.lit(1.0) - w) + C(c) * gain * w)
    return out


def hue_selective_saturation(bands: list[dict], mask: Column) -> list[Column]:
    """Chroma scaled inside hue bands, protected in grey, dark and bright pixels."""
    sat, luma, hue = px.saturation_hsl(*rgb()), px.luminance(*rgb()), px.hue_degrees(*rgb())
    keep = smoothstep(sat, 0.03, 0.18) * smoothstep(luma, 0.02, 0.12) * (F.lit(1.0) - smoothstep(luma, 0.85, 0.98))
    total = F.lit(0.0)
    for b in bands:
        total = total + F.lit(max(-0.15, min(0.15, b["amount"]))) * px.hue_mask(hue, b["center"], b["width"], b["feather"])
    weight = clamp(total, -0.15, 0.15) * keep * mask
    return [luma + (c - luma) * (F.lit(1.0) + weight) for c in rgb()]


def linear_decomposition(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Error summary of O = B + (O - B) over all channels."""
    err = F.explode(F.array(*[F.abs(C(f"{c}2") + (C(c) - C(f"{c}2")) - C(c)) for c in RGB]))
    e = pair.select(key, err.alias("e"))
    out = with_quantiles(e, [key], [(C("e"), {"p95": 0.95})])
    return out.groupBy(key).agg((F.count("*") / 3).cast("long").alias("pixels"), F.avg("e").alias("mae"), F.max("p95").alias("p95"), F.max("e").alias("max_error"))


def unscreen_layer(trio: DataFrame, floor: float = 0.08, reliable_min: float = 0.80, peak_max: float = 0.95, key: str = "image_id") -> DataFrame:
    """Star amplitude from original (r,g,b) and starless (r2,g2,b2) with the proportions of trusted stars (r3,g3,b3).

    ``support`` marks compact star pixels. One row per pixel with the recovered peak.
    """
    res = [C(c) - C(f"{c}2") for c in RGB]
    den = [F.lit(1.0) - C(f"{c}2") for c in RGB]
    out = trio.withColumn("_out", F.explode(F.array(*res)))
    center = with_quantiles(out.select(key, F.when(~C("support"), C("_out")).alias("v")), [key], [(C("v"), {"_c": 0.5})])
    noise = quantiles(center, [key], [(F.abs(C("v") - C("_c")), {"residual_mad": 0.5})])
    rows = trio.join(noise, key, "left")
    tol = F.when(C("n_residual_mad") > 0, clamp(C("residual_mad") * (3.0 * 1.4826), 2e-6, 0.002)).otherwise(F.lit(0.002))
    trusted = F.greatest(C("r3"), C("g3"), C("b3"))
    ok = C("support") & (F.least(*den) >= floor) & (F.greatest(*rgb()) < 0.995) & (F.least(*res) >= -tol) & (trusted > 1e-7)
    raw_peak = F.greatest(*[clamp(r / F.greatest(d, F.lit(floor))) for r, d in zip(res, den)])
    peak = F.when(ok, F.greatest(trusted, F.least(raw_peak, F.lit(peak_max)))).otherwise(trusted)
    gain = F.when(trusted > 1e-7, peak / trusted).otherwise(F.lit(0.0))
    layer = [clamp(C(f"{c}3") * gain).alias(f"layer_{c}") for c in RGB]
    rows = rows.select(key, "y", "x", "support", ok.alias("reliable"), *layer)
    rows = with_stats(rows, [key], {"_s": F.count_if("support"), "_r": F.count_if("reliable")})
    ratio = C("_r") / F.greatest(C("_s"), F.lit(1))
    return rows.select(key, "y", "x", "reliable", "layer_r", "layer_g", "layer_b", (ratio >= reliable_min).alias("available"))


def palette_map(pix: DataFrame, palette: str, names: tuple[str, ...]) -> DataFrame:
    """Palette channels at the luminance of the pixel, chroma shrunk into gamut, as ``names``.

    Written in steps: each step names what the next one uses several times.
    """
    ch = px.dualband_channels(*rgb())
    out = pix.withColumns({f"_m{i}": ch[c] for i, c in enumerate(px.PALETTES[palette])})
    m = [C(f"_m{i}") for i in range(3)]
    out = out.withColumns({"_t": px.luminance(*rgb()), "_have": px.luminance(*m)})
    out = out.withColumns({f"_p{i}": c * (C("_t") / C("_have")) - C("_t") for i, c in enumerate(m)})
    p = [C(f"_p{i}") for i in range(3)]
    out = out.withColumn("_s", clamp(F.least(*[px.room(C("_t"), c, F.lit(1.0)) for c in p]) * 0.995))
    ok = C("_have") > 1e-6
    out = out.withColumns({n: F.when(ok, clamp(C("_t") + c * C("_s"))).otherwise(clamp(C(b))) for n, c, b in zip(names, p, RGB)})
    return out.drop("_m0", "_m1", "_m2", "_t", "_have", "_p0", "_p1", "_p2", "_s")


def chroma_scale(pix: DataFrame, names: tuple[str, ...], scale: float) -> DataFrame:
    """Larger chroma of the named channels at equal luminance, limited by gamut."""
    most = F.lit(max(1.0, min(1.40, float(scale))))
    out = pix.withColumn("_t", px.luminance(*[C(n) for n in names]))
    parts = [C(n) - C("_t") for n in names]
    limit = F.least(*[px.room(C("_t"), p, most) for p in parts]) * 0.995
    out = out.withColumn("_s", F.least(F.greatest(limit, F.lit(0.0)), most))
    return out.withColumns({n: clamp(C("_t") + (C(n) - C("_t")) * C("_s")) for n in names}).drop("_t", "_s")


def palette_candidate(pix: DataFrame, palette: str, scale: float, mask: str = "subject") -> DataFrame:
    """Luminance-preserving palette inside the mask; baseline kept in r,g,b, result in r2,g2,b2."""
    names = ("r2", "g2", "b2")
    out = chroma_scale(palette_map(pix, palette, names), names, scale)
    w = clamp(C(mask))
    return out.withColumns({n: C(c) + (C(n) - C(c)) * w for c, n in zip(RGB, names)})


def palette_quality(pair: DataFrame, luma_limit: float = 0.005, clip_limit: float = 0.002, tolerance: float = 0.5, mask: str = "subject", key: str = "image_id") -> DataFrame:
    """Drift and clip metrics of a palette candidate with the normal / warning / reject bands."""
    drift = F.abs(px.luminance(*rgb("2")) - px.luminance(*rgb()))
    change = F.greatest(*[F.abs(C(f"{c}2") - C(c)) for c in RGB])
    clip = lambda s: F.array_contains(F.array(*[(C(c + s) <= 0) | (C(c + s) >= 1) for c in RGB]), True).cast("int")
    rows = pair.select(key, mask, drift.alias("d"), change.alias("c"), clip("").alias("k1"), clip("2").alias("k2"))
    rows = with_quantiles(rows, [key], [(C("d"), {"p95": 0.95})])
    m = rows.groupBy(key).agg(
        F.max("p95").alias("luma_drift_p95"), (F.avg("k2") - F.avg("k1")).alias("clip_growth"),
        F.coalesce(F.max(F.when(C(mask) <= 0, C("c"))), F.lit(0.0)).alias("outside_change"),
    )
    hard_l, hard_c = luma_limit * (1 + tolerance), clip_limit * (1 + tolerance)
    issues = F.array_compact(F.array(
        F.when(C("luma_drift_p95") > hard_l, "luminance_drift"), F.when(C("clip_growth") > hard_c, "clip_growth"),
        F.when(C("outside_change") > 1e-6, "outside_subject_change")))
    warn = (C("luma_drift_p95") > luma_limit) | (C("clip_growth") > clip_limit)
    status = F.when(F.size(issues) > 0, "rejected").when(warn, "accepted_with_warning").otherwise("accepted")
    return m.select("*", status.alias("status"), F.array_join(issues, ",").alias("issues"))


def subject_chroma_boost(pix: DataFrame, budget: float, mask: str = "subject", key: str = "image_id") -> DataFrame:
    """Raises RGB-Y inside the mask at fixed luminance; the factor follows the saturation budget."""
    on = C(mask) > 0.05
    out = with_quantiles(pix, [key], [(F.when(on, px.saturation_hsv(*rgb())), {"s50": 0.5, "s95": 0.95})])
    absolute = C("s50")
    raw = F.when(absolute > 1e-6, clamp(F.lit(1.0) + F.lit(2.0) * F.greatest(F.lit(0.30) / absolute - 1.0, F.lit(0.0)), 1.12, 4.0)).otherwise(F.lit(1.12))
    scale = max(0.0, min(1.0, max(0.0, min(0.65, budget)) / 0.40))
    out = out.withColumn("factor", clamp(F.lit(1.0) + (raw - 1.0) * F.lit(scale), 1.0, 4.0))
    l = px.luminance(*rgb())
    gain = F.lit(1.0) + (C("factor") - 1.0) * clamp(C(mask))
    parts = [(C(c) - l) * gain for c in RGB]
    one = F.lit(1.0)
    room = F.least(*[px.room(l, p, one) for p in parts])
    return out.select(key, "y", "x", "factor", *[clamp(l + p * room).alias(c) for p, c in zip(parts, RGB)])


def luminance_only(pair: DataFrame) -> DataFrame:
    """Keeps the linked-luminance part of a candidate inside the subject, outside background and core."""
    l, l2 = px.luminance(*rgb()), px.luminance(*rgb("2"))
    gain = clamp(F.when(l > 1e-5, l2 / l).otherwise(F.lit(1.0)), 0.5, 1.5)
    restore = (C("subject") <= 1e-6) | (C("background") >= 0.5) | (C("core") >= 0.5)
    out = {c: F.when(restore, clamp(C(c))).otherwise(clamp(C(c) + (clamp(C(c) * gain) - C(c)) * C("subject"))) for c in RGB}
    return pair.select("image_id", "y", "x", *[e.alias(c) for c, e in out.items()], restore.alias("restored"))


def colour_only(pair: DataFrame, budget: float) -> DataFrame:
    """Keeps the chroma of a candidate at the baseline's luminance inside the subject."""
    l, l2 = px.luminance(*rgb()), px.luminance(*rgb("2"))
    blend = max(0.0, min(1.0, budget / 0.40))
    restore = (C("subject") <= 1e-6) | (C("background") >= 0.5) | (C("core") >= 0.5)
    out = {c: F.when(restore, clamp(C(c))).otherwise(clamp(C(c) + (clamp(l + C(f"{c}2") - l2) - C(c)) * C("subject") * F.lit(blend))) for c in RGB}
    return pair.select("image_id", "y", "x", *[e.alias(c) for c, e in out.items()], restore.alias("restored"))


def chroma_rescue(pix: DataFrame, keep: Column) -> DataFrame:
    l = px.luminance(*rgb())
    return pix.withColumns({c: clamp(l + (C(c) - l) * keep) for c in RGB})


def neutral_axis(pair: DataFrame, key: str = "image_id") -> DataFrame:
    """Only the centred luminance part of a proposed change is added, equally to all channels."""
    delta = pair.withColumn("_d", px.luminance(*rgb("2")) - px.luminance(*rgb()))
    out = with_stats(delta, [key], {"_m": F.avg("_d")}).withColumn("_d", C("_d") - C("_m"))
    out = out.select(key, "y", "x", *[C(c).alias(f"{c}0") for c in RGB], *[(C(c) + C("_d")).alias(c) for c in RGB])
    inv = F.greatest(F.abs((C("r") - C("g")) - (C("r0") - C("g0"))), F.abs((C("b") - C("g")) - (C("b0") - C("g0"))))
    return out.select(key, "y", "x", *RGB, (inv < 1e-9).alias("opponent_unchanged"))


def subtract_to_lowest(pix: DataFrame, on: Column, key: str = "image_id") -> DataFrame:
    """Channels whose background median exceeds the lowest one are lowered by the difference."""
    out = with_quantiles(pix, [key], [(F.when(on, C(c)), {f"m_{c}": 0.5}) for c in RGB])
    low = F.least("m_r", "m_g", "m_b")
    cols = [F.greatest(C(c) - F.greatest(C(f"m_{c}") - low, F.lit(0.0)), F.lit(0.0)).alias(c) for c in RGB]
    return out.select(key, "y", "x", *cols)


def star_layer_cleanup(layer: DataFrame, key: str = "image_id") -> DataFrame:
    """Removes the diffuse part of a star layer; compact cores keep their colour ratios."""
    peak = layer.withColumn("p", F.greatest(*rgb()))
    peak = with_quantiles(peak, [key], [(C("p"), {"p_med": 0.5})])
    peak = with_quantiles(peak, [key], [(F.abs(C("p") - C("p_med")), {"p_mad": 0.5})])
    peak = box_blur(peak, {"p": "p_soft"}, 2, [key])
    floor = C("p_med") + F.lit(3.0 * 1.4826) * C("p_mad")
    diffuse = F.least(C("p_soft"), C("p"))
    compact = F.greatest(C("p") - diffuse, F.lit(0.0))
    core = C("p") >= floor
    keep = F.when(core, F.lit(1.0)).otherwise(smoothstep(compact, F.lit(0.0), F.greatest(floor - C("p_med"), F.lit(1e-6))))
    return peak.select(key, "y", "x", core.alias("core"), keep.alias("keep"), *[(C(c) * keep).alias(c) for c in RGB])


def star_colour_repair(pair: DataFrame, strength: float, key: str = "image_id") -> DataFrame:
    """Star chroma moved toward the reference (r2,g2,b2) inside ``support``; accepted per image on its error."""
    s0, s1 = C("r") + C("g") + C("b"), C("r2") + C("g2") + C("b2")
    rows = with_quantiles(pair, [key], [(s0, {"_q0": 0.75}), (s1, {"_q1": 0.75})])
    valid = C("support") & (s0 > F.greatest(C("_q0"), F.lit(1e-6))) & (s1 > F.greatest(C("_q1"), F.lit(1e-7)))
    luma = px.luminance(*rgb())
    ref = [C(f"{c}2") / F.greatest(s1, F.lit(1e-7)) for c in RGB]
    unit = px.luminance(*ref)
    blend = F.when(valid, F.lit(max(0.2, min(0.9, strength)))).otherwise(F.lit(0.0))
    out = rows.withColumns({f"{c}3": clamp(C(c) * (F.lit(1.0) - blend) + t * (luma / F.greatest(unit, F.lit(1e-7))) * blend) for c, t in zip(RGB, ref)}).withColumn("_v", valid)
    tot = lambda s: F.greatest(C(f"r{s}") + C(f"g{s}") + C(f"b{s}"), F.lit(1e-7))
    err = lambda s: F.greatest(*[F.abs(C(f"{c}{s}") / tot(s) - t) for c, t in zip(RGB, ref)])
    m = quantiles(out, [key], [(F.when(C("_v"), err("")), {"error_before": 0.5}), (F.when(C("_v"), err("3")), {"error_after": 0.5})])
    flux = out.groupBy(key).agg(
        F.sum(F.when(C("support"), px.luminance(*rgb("3")))).alias("_f3"), F.sum(F.when(C("support"), luma)).alias("_f0"))
    m = m.join(flux, key, "left").withColumn("flux_drift", F.abs(C("_f3") / F.greatest(C("_f0"), F.lit(1e-7)) - 1.0))
    gain = C("error_before") - C("error_after")
    return m.select(key, F.col("n_error_before").alias("samples"), "error_before", "error_after", "flux_drift",
                    ((gain >= 0.02) & (C("flux_drift") <= 0.03) & (C("n_error_before") >= 8)).alias("accepted"))


def halo_guard(masks: DataFrame, names: list[str], guard: str = "guard") -> DataFrame:
    return masks.withColumns({n: clamp(C(n) * clamp(F.lit(1.0) - C(guard))) for n in names})


def halo_guard_verdict(pair: DataFrame, guard: str = "guard", key: str = "image_id") -> DataFrame:
    """Texture and chroma growth inside the guard between baseline and candidate (dense pair)."""
    t = pair.withColumns({"_l": px.luminance(*rgb()), "_l2": px.luminance(*rgb("2"))})
    t = box_blur(t, {"_l": "_s", "_l2": "_s2"}, 1, [key])
    on = C(guard) > 0.05
    t0, t1 = F.abs(C("_l") - C("_s")), F.abs(C("_l2") - C("_s2"))
    ch = lambda s: F.greatest(*rgb(s)) - F.least(*rgb(s))
    q = quantiles(t, [key], [
        (F.when(on, t1 - t0), {"texture_delta": 0.5}), (F.when(on, t0), {"_t0": 0.5}), (F.when(on, t1), {"_t1": 0.5}),
        (F.when(on, ch("2") - ch("")), {"chroma_delta_p95": 0.95})])
    growth = C("_t1") / F.greatest(C("_t0"), F.lit(1e-6))
    few = C("n_texture_delta") < 8
    return q.select(
        key, C("n_texture_delta").alias("support"), growth.alias("texture_growth"), "texture_delta", "chroma_delta_p95",
        (~few & (growth > 1.05) & (C("texture_delta") > 0.00075)).alias("texture_failed"), (~few & (C("chroma_delta_p95") > 0.006)).alias("chroma_failed"))


LADDER = (1.0, 0.75, 0.5, 0.25)


def boundary_retained(pair: DataFrame, seam: DataFrame, key: str = "image_id") -> DataFrame:
    """Candidate deltas scaled by each step of the ladder, more strongly at the subject boundary.

    seam carries ``luma_residual``, ``chroma_residual``, ``luma_ratio``, ``chroma_ratio`` per image.
    The ladder is exploded from a literal, so every pixel gives four rows and nothing is joined.
    """
    lims = {"luma_residual": 0.0035, "chroma_residual": 0.0020, "luma_ratio": 1.60, "chroma_ratio": 1.60}
    cap = F.least(F.lit(1.0), *[F.when((C(c) > v) & (C(c) > 1e-12), F.lit(v) / C(c)).otherwise(F.lit(1.0)) for c, v in lims.items()])
    s = seam.select(key, clamp(cap * 0.98, 0.02, 1.0).alias("cap"))
    rows = pair.join(s, key).withColumn("retained", F.explode(F.array(*[F.lit(v) for v in LADDER])))
    w = clamp(C("subject"))
    scale = F.when(w <= 0.05, F.lit(0.0)).when(w < 0.80, C("cap") * C("retained")).otherwise(C("retained"))
    rows = rows.withColumn("_raw", scale)
    for i in range(3):
        rows = box_blur(rows, {"_raw" if i == 0 else f"_b{i-1}": f"_b{i}"}, 1, [key, "retained"])
    k = F.when(w <= 0.05, F.lit(0.0)).otherwise(F.least(F.greatest(C("_b2"), F.lit(0.0)), C("retained")))
    return rows.select(key, "retained", "y", "x", k.alias("scale"), *[(C(c) + (C(f"{c}2") - C(c)) * k).alias(c) for c in RGB])


def core_clamp(pair: DataFrame, over: float = 0.01, core: str = "core") -> DataFrame:
    """Channels of a candidate that overshoot the source inside the core go back to the source."""
    hit = lambda c: C(core) & (C(f"{c}2") - C(c) > over)
    return pair.select("image_id", "y", "x", *[F.when(hit(c), C(c)).otherwise(C(f"{c}2")).alias(c) for c in RGB],
                       F.array_contains(F.array(*[hit(c) for c in RGB]), True).alias("repaired"))
