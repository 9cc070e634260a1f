"""Automatic colour reference: an empty-sky rectangle, a rectangle of usable stars, gains, and gates on held-out data.

Each step is one table: measures of patches, one background row per image, star objects, white
rectangles, judged candidates. Pixels are read through equi joins on (image, y, x); images may
differ in size (``h`` and ``w`` of the grid).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import fixed
from ..functions.pixel import luminance
from ..session import saved, shared
from .background import patch_join, plane_fit
from .components import connected_components
from .grid import step_back
from .quantiles import quantiles, with_quantiles
from .selection import farthest_point_split, star_record_selection
from .stars import sigma_clip

C = F.col
RGB = ("r", "g", "b")

# fixed values: limits of the gates
ERROR_MIN, ABSOLUTE_MIN, RELATIVE_MIN = 0.01, 0.002, 0.10
P90_GROWTH, IMPROVED_MIN, CHROMA_GROWTH, CHROMA_TOLERANCE = 1.05, 0.75, 1.05, 0.0005
HIGHLIGHT_GROWTH, BLACK_GROWTH, GRADIENT_GROWTH, TEXTURE_GROWTH, DRIFT_MAX = 0.002, 0.002, 1.05, 1.10, 0.08
STAR_SATURATION, RATIO_MAD, GAIN_LIMIT, STAR_IMPROVEMENT = 0.10, 0.12, 1.10, 0.10
SIDES = (0.25, 0.375, 0.50, 0.75, 1.0)


def patch_measures(points: DataFrame, pix: DataFrame, r: int, key: str = "image_id") -> DataFrame:
    """Channel medians, level, gradient and texture of the patch of each point.

    A patch at the border is measured on the pixels it has; one of under three rows or columns, or
    with a pixel that is null or not finite, gives no row. The gradient is the mean of the median
    steps to the left and upper neighbour inside the patch, the texture the MAD of its luminance.
    """
    d = pix.select(key, "y", "x", *RGB, luminance(*[C(c) for c in RGB]).alias("l"))
    d = d.withColumn("_gx", F.abs(C("l") - step_back(d, "l", "x", [key]))).withColumn("_gy", F.abs(C("l") - step_back(d, "l", "y", [key])))
    g = [key, "point_id", "split", "py", "px"]
    p = shared(with_quantiles(patch_join(points, d, r, key), g, [(C("l"), {"_lm": 0.5})], whole=True))
    q = quantiles(p, g, [
        *[(C(c), {f"m{c}": 0.5}) for c in RGB], (F.when(C("bx") > 0, C("_gx")), {"gx": 0.5}), (F.when(C("by") > 0, C("_gy")), {"gy": 0.5}), (F.abs(C("l") - C("_lm")), {"texture": 0.5})], whole=True)
    sound = F.bool_and(C("l").isNotNull() & ~F.isnan("l") & (F.abs("l") < float("inf")))
    ext = p.groupBy(*g).agg(sound.alias("_ok"), (F.max("y") - F.min("y")).alias("_dy"), (F.max("x") - F.min("x")).alias("_dx"))
    q = q.join(ext.where(C("_ok") & (C("_dy") >= 2) & (C("_dx") >= 2)).select(*g), g, "left_semi")
    m = [C(f"m{c}") for c in RGB]
    return q.select(*g, *m, luminance(*m).alias("level"), (F.greatest(*m) - F.least(*m)).alias("error"), ((C("gx") + C("gy")) * 0.5).alias("gradient"), "texture")


def background_rectangle(measures: DataFrame, key: str = "image_id") -> DataFrame:
    """The fit patch of each image with the least level + gradient + texture, each scaled to its range in the image.

    Channel balance takes no part. Equal scores go to the lower, then the left patch.
    """
    names = ("level", "gradient", "texture")
    f = measures.where(C("split") == "fit")
    ends = f.groupBy(key).agg(*[e for n in names for e in (F.min(n).alias(f"_lo_{n}"), F.max(n).alias(f"_hi_{n}"))])
    f = f.join(ends, key)
    part = [F.when(C(f"_hi_{n}") - C(f"_lo_{n}") > 1e-12, (C(n) - C(f"_lo_{n}")) / (C(f"_hi_{n}") - C(f"_lo_{n}"))).otherwise(F.lit(0.0)) for n in names]
    best = F.min(F.struct(fixed(part[0] + part[1] + part[2], 9).alias("score"), (-C("py")).alias("o"), C("px").alias("bg_x"), *[C(f"m{c}") for c in RGB], "level", "gradient", "texture"))
    b = f.groupBy(key).agg(best.alias("b"), F.count("*").alias("bg_candidates"))
    low = F.least(*[C(f"b.m{c}") for c in RGB])
    return b.select(
        key, (-C("b.o")).alias("bg_y"), C("b.bg_x").alias("bg_x"), "bg_candidates", C("b.score").alias("bg_score"), C("b.level").alias("bg_level"), C("b.texture").alias("bg_texture"),
        *[(C(f"b.m{c}") - low).alias(f"off_{c}") for c in RGB])


def _growth(after: str, before: str) -> Column:
    return F.when(C(before) <= 1e-12, F.when(C(after) <= 1e-12, 1.0).otherwise(float("inf"))).otherwise(C(after) / C(before))


def _reasons(*told: tuple[Column, str]) -> Column:
    return F.sort_array(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for c, n in told])))


def _chroma_slope(m: DataFrame, name: str, key: str) -> DataFrame:
    """Length of the slopes of r-g and b-g over the held-out points, null where they do not span a plane."""
    ends = m.groupBy(key).agg(F.min("py").alias("_y0"), F.max("py").alias("_y1"), F.min("px").alias("_x0"), F.max("px").alias("_x1"), F.count("*").alias("_k"))
    m = m.join(ends.where((C("_y1") > C("_y0")) & (C("_x1") > C("_x0")) & (C("_k") >= 4)), key)
    x, y = (C("px") - C("_x0")) / (C("_x1") - C("_x0")), (C("py") - C("_y0")) / (C("_y1") - C("_y0"))
    one, two = (plane_fit(m, [key], x, y, C(a) - C("mg"), p).where(C(f"{p}rank") == 3) for a, p in (("mr", "u_"), ("mb", "v_")))
    square = lambda p: C(f"{p}slope_x") * C(f"{p}slope_x") + C(f"{p}slope_y") * C(f"{p}slope_y")
    return one.join(two, key).select(key, F.sqrt(square("u_") + square("v_")).alias(name))


def judged(pix: DataFrame, held: DataFrame, back: DataFrame, r: int, key: str = "image_id") -> DataFrame:
    """Metrics of a candidate (r2, g2, b2 beside r, g, b) against its source, with the reasons that speak against it as to safety.

    held are the measures of the held-out points on the source; back has bg_level of each image.
    """
    new = patch_measures(held.select(key, "point_id", "split", C("py").alias("y"), C("px").alias("x")), pix.select(key, "y", "x", *[C(f"{c}2").alias(c) for c in RGB]), r, key)
    new = saved(new, "candidate")
    both = held.select(key, "point_id", C("error").alias("e1"), C("gradient").alias("g1"), C("texture").alias("t1")).join(new.select(key, "point_id", C("error").alias("e2"), C("gradient").alias("g2"), C("texture").alias("t2")), [key, "point_id"])
    better = F.when(C("e2") < C("e1") - 1e-12, 1.0).otherwise(0.0)
    tail = quantiles(both, [key], [
        (C("e1"), {"error_before": 0.5, "p90_before": 0.9}), (C("e2"), {"error_after": 0.5, "p90_after": 0.9}), (C("g1"), {"_g1": 0.5}), (C("g2"), {"_g2": 0.5}), (C("t1"), {"_t1": 0.5}), (C("t2"), {"_t2": 0.5})], whole=True)
    share = both.groupBy(key).agg(F.avg(better).alias("improved_fraction"))
    slopes = _chroma_slope(held, "chroma_before", key).join(_chroma_slope(new, "chroma_after", key), key)
    l = luminance(*[C(c) for c in RGB])
    p = with_quantiles(pix.withColumn("l", l), [key], [(C("l"), {"_q98": 0.98, "_q995": 0.995})]).join(back.select(key, "bg_level"), key)
    star = F.greatest("_q98", C("bg_level") + 0.002)
    subject = (C("l") >= C("bg_level") + F.greatest(F.lit(0.1) * F.greatest(C("_q995") - C("bg_level"), F.lit(0.0)), F.lit(0.002))) & (C("l") < star)
    pos = lambda c: F.greatest(C(c), F.lit(0.0))
    p = p.withColumn("_on", subject).withColumn("_s1", pos("r") + pos("g") + pos("b")).withColumn("_s2", pos("r2") + pos("g2") + pos("b2"))
    valid = C("_on") & (C("_s1") > 1e-8) & (C("_s2") > 1e-8)
    far = [pos(f"{c}2") / C("_s2") - pos(c) / C("_s1") for c in RGB]
    p = shared(p.withColumn("_far", F.when(valid, F.sqrt(far[0] * far[0] + far[1] * far[1] + far[2] * far[2]))))
    hot = lambda s: F.avg((F.greatest(*[C(f"{c}{s}") for c in RGB]) >= 0.999).cast("int"))
    dark = lambda s: F.avg((F.least(*[C(f"{c}{s}") for c in RGB]) <= 1.0 / 65535.0).cast("int"))
    clip = p.groupBy(key).agg((hot("2") - hot("")).alias("highlight_growth"), (dark("2") - dark("")).alias("black_growth"), F.count_if("_on").alias("_mask"), F.first("_q98").alias("_q98"))
    drift = quantiles(p, [key], [(C("_far"), {"_drift": 0.95})])
    d = clip.join(drift, key).join(back, key).join(tail, key, "left").join(share, key, "left").join(slopes, key, "left")
    d = d.withColumns({
        "drift": F.when((C("_mask") >= 64) & (C("n__drift") >= 64), C("_drift")), "gradient_ratio": _growth("_g2", "_g1"), "texture_ratio": _growth("_t2", "_t1"),
        "separation": C("_q98") - C("bg_level"), "held_samples": F.coalesce("n_error_before", F.lit(0))})
    safety = _reasons(
        (C("highlight_growth") > HIGHLIGHT_GROWTH, "highlight_clip_growth_exceeded"), (C("black_growth") > BLACK_GROWTH, "black_clip_growth_exceeded"),
        (C("gradient_ratio") > GRADIENT_GROWTH, "heldout_gradient_growth_exceeded"), (C("texture_ratio") > TEXTURE_GROWTH, "heldout_texture_growth_exceeded"),
        (F.coalesce(C("drift") > DRIFT_MAX, F.lit(False)), "subject_chromaticity_drift_exceeded"))
    return d.select(
        *back.columns, "held_samples", "separation", "error_before", "error_after", "p90_before", "p90_after", "improved_fraction", "chroma_before", "chroma_after",
        "highlight_growth", "black_growth", "gradient_ratio", "texture_ratio", "drift", safety.alias("safety"))


def lowered(pix: DataFrame, back: DataFrame, key: str = "image_id") -> DataFrame:
    """The grid with r2, g2, b2: each channel lowered by its offset, never below zero, never lifted."""
    return pix.join(back.select(key, *[f"off_{c}" for c in RGB]), key).withColumns({f"{c}2": F.greatest(C(c) - C(f"off_{c}"), F.lit(0.0)) for c in RGB}).drop(*[f"off_{c}" for c in RGB])


def background_reference(pix: DataFrame, points: DataFrame, r: int, key: str = "image_id", measures: DataFrame | None = None) -> DataFrame:
    """Background neutralisation of each image with its held-out metrics and the reasons against it; none: accepted.

    pix(key, y, x, r, g, b); points(key, point_id, split, y, x). Images without a measurable fit
    patch give no row; fewer than four measurable held-out patches are a reason of their own.
    """
    m = saved(patch_measures(points, pix, r, key), "measures") if measures is None else measures
    back = saved(background_rectangle(m, key), "back")
    j = judged(lowered(pix, back, key), m.where(C("split") == "validation"), back, r, key)
    gain = C("error_before") - C("error_after")
    few = C("held_samples") < 4
    told = [
        (few, "background_patch_measurement_failed"), (C("separation") < 0.005, "insufficient_background_subject_separation"), (C("error_before") < ERROR_MIN, "background_color_error_below_action_threshold"),
        (gain < ABSOLUTE_MIN, "heldout_background_absolute_improvement_insufficient"), (gain / F.greatest("error_before", F.lit(1e-12)) < RELATIVE_MIN, "heldout_background_relative_improvement_insufficient"),
        (C("p90_after") > C("p90_before") * P90_GROWTH + 1e-8, "heldout_background_p90_regressed"), (C("improved_fraction") < IMPROVED_MIN, "heldout_background_improved_fraction_insufficient"),
        (C("chroma_before").isNull() | C("chroma_after").isNull(), "heldout_background_spatial_chroma_gradient_unavailable"),
        (F.coalesce(C("chroma_after") > C("chroma_before") * CHROMA_GROWTH + CHROMA_TOLERANCE, F.lit(False)), "heldout_background_spatial_chroma_gradient_growth_exceeded")]
    return j.withColumn("reasons", F.sort_array(F.array_union(_reasons(*told), "safety"))).drop("safety")


def star_objects(pix: DataFrame, back: DataFrame, key: str = "image_id", margin: int = 3, ring: int = 4, smallest: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, footprints, rejections): compact bright components with a quiet surrounding.

    objects: key, star_id, x, y, quadrant, area, aspect_ratio, compactness, saturation_fraction, r, g, b (flux).
    footprints: key, star_id, y, x, core (true: of the star, false: of its surrounding). rejections: key,
    reason, count. Each component is told its first reason only.
    """
    p = pix.select(key, "y", "x", "h", "w", *RGB, luminance(*[C(c) for c in RGB]).alias("l"))
    p = with_quantiles(p, [key], [(C("l"), {"_q98": 0.98, "_q995": 0.995})]).join(back.select(key, "bg_level", "bg_texture"), key)
    top = F.greatest("_q98", C("bg_level") + 0.002)
    subject = (C("l") >= C("bg_level") + F.greatest(F.lit(0.1) * F.greatest(C("_q995") - C("bg_level"), F.lit(0.0)), F.lit(0.002))) & (C("l") < top)
    p = saved(p.withColumns({"_on": C("l") >= top, "_subject": subject}).drop("_q98", "_q995"), "detect")
    # a subject of under 64 pixels is none
    masked = p.groupBy(key).agg((F.count_if("_subject") >= 64).alias("_real"))
    labels = saved(connected_components(p, [key], C("_on"), C("w"), {"h": C("h"), "w": C("w"), "bg_level": C("bg_level"), "bg_texture": C("bg_texture"), **{c: C(c) for c in RGB}}), "labels").withColumnRenamed("label", "star_id")
    o = labels.groupBy(key, "star_id").agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.avg((F.greatest(*RGB) >= 0.98).cast("int")).alias("saturation_fraction"), *[F.first(c).alias(c) for c in ("h", "w", "bg_level", "bg_texture")])
    bh, bw = C("y1") - C("y0") + 1, C("x1") - C("x0") + 1
    o = o.withColumns({"aspect_ratio": F.greatest(bh, bw) / F.least(bh, bw), "compactness": C("area") / (bh * bw)})
    largest = F.greatest(F.lit(8), F.least(F.lit(256), F.bround(C("h") * C("w") * 0.0008)))
    early = (
        F.when((C("area") < smallest) | (C("area") > largest), "component_area").when((C("aspect_ratio") > 2.5) | (C("compactness") < 0.15), "non_compact_or_asymmetric")
        .when((C("x0") < margin) | (C("y0") < margin) | (C("x1") >= C("w") - margin) | (C("y1") >= C("h") - margin), "edge_component").when(C("saturation_fraction") > STAR_SATURATION, "saturated"))
    o = saved(o.withColumn("reason", early), "objects")
    # the box around an object is bounded by the limits on area, aspect and compactness
    box = o.where(C("reason").isNull()).select(key, "star_id", F.explode(F.sequence(F.greatest(C("y0") - ring, F.lit(0)), F.least(C("y1") + ring, C("h") - 1))).alias("y"), "x0", "x1", "w")
    box = box.select(key, "star_id", "y", F.explode(F.sequence(F.greatest(C("x0") - ring, F.lit(0)), F.least(C("x1") + ring, C("w") - 1))).alias("x"))
    around = box.join(p.select(key, "y", "x", *RGB, "l", "_on", "_subject"), [key, "y", "x"]).join(masked, key).withColumn("_subject", C("_subject") & C("_real"))
    feet = around.where(~C("_on")).select(key, "star_id", "y", "x", F.lit(False).alias("core")).unionByName(labels.join(o.where(C("reason").isNull()).select(key, "star_id"), [key, "star_id"]).select(key, "star_id", "y", "x", F.lit(True).alias("core")))
    feet = saved(feet, "feet")
    g = [key, "star_id"]
    calm = with_quantiles(around.where(~C("_on")), g, [(C("l"), {"_lb": 0.5})], whole=True)
    calm = quantiles(calm, g, [(C("_lb"), {"local": 0.5}), (F.abs(C("l") - C("_lb")), {"local_texture": 0.5})], whole=True)
    told = o.join(calm, g, "left").join(around.groupBy(*g).agg(F.avg(C("_subject").cast("int")).alias("subject_share")), g, "left").join(star_flux(pix, feet, key), g, "left")
    late = (
        F.when(F.coalesce("n_local", F.lit(0)) < 8, "annulus_unavailable").when(C("local") > C("bg_level") + 0.01, "bright_extended_background")
        .when(C("local_texture") > F.greatest(C("bg_texture") * 4.0, F.lit(0.01)), "structured_annulus").when(C("subject_share") > 0.25, "subject_contamination").when(C("r").isNull(), "invalid_background_subtracted_flux"))
    told = saved(told.withColumn("reason", F.coalesce("reason", late)), "told")
    quadrant = (C("cx") >= C("w") / 2).cast("int") + (C("cy") >= C("h") / 2).cast("int") * 2
    good = told.where(C("reason").isNull()).select(key, "star_id", C("cx").alias("x"), C("cy").alias("y"), quadrant.alias("quadrant"), "area", "aspect_ratio", "compactness", "saturation_fraction", *RGB)
    return good, feet, told.where(C("reason").isNotNull()).groupBy(key, "reason").agg(F.count("*").alias("count"))


def star_flux(pix: DataFrame, feet: DataFrame, key: str = "image_id") -> DataFrame:
    """key, star_id, r, g, b: light of the core pixels above the median of the surrounding; only stars with light in all channels and eight surrounding pixels."""
    g = [key, "star_id"]
    d = feet.join(pix.select(key, "y", "x", *RGB), [key, "y", "x"])
    d = with_quantiles(d, g, [(F.when(~C("core"), C(c)), {f"_{c}": 0.5}) for c in RGB], whole=True)
    s = d.where("core").groupBy(*g).agg(*[F.sum(F.greatest(C(c) - C(f"_{c}"), F.lit(0.0))).alias(c) for c in RGB], F.first("n__r").alias("_n"))
    return s.where((C("_n") >= 8) & (F.least(*RGB) > 1e-10)).drop("_n")


def white_rectangle(stars: DataFrame, size: DataFrame, minimum: int = 16, fractions: Sequence[float] = SIDES, shortest: int = 32, key: str = "image_id") -> DataFrame:
    """The smallest square around a star that holds ``minimum`` stars, of equal ones that with most stars, then light.

    stars(key, x, y, flux, compactness, saturation_fraction), size(key, h, w). Counts and light of every
    square come from integral images (two running sums), four look-ups each. Squares equal in both
    are told by median compactness, median saturation, then the upper left one. Images where no
    square holds enough give no row. Colour takes no part.
    """
    sz = size.select(key, "h", "w")
    cells = stars.groupBy(key, F.floor("y").cast("int").alias("y"), F.floor("x").cast("int").alias("x")).agg(F.count("*").alias("_n"), F.sum("flux").alias("_f"))
    some = sz.join(stars.select(key).distinct(), key, "left_semi")
    rows = some.withColumn("y", F.explode(F.sequence(F.lit(0), C("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), C("w") - 1)))
    run = lambda part, order: W.partitionBy(key, part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sat = rows.select(key, "y", "x").join(cells, [key, "y", "x"], "left")
    for part, order in (("y", "x"), ("x", "y")):
        sat = sat.withColumns({c: F.sum(F.coalesce(C(c), F.lit(0))).over(run(part, order)) for c in ("_n", "_f")})
    short = F.least("h", "w")
    side = F.explode(F.array_distinct(F.array(*[F.greatest(F.lit(shortest), F.least(short, F.bround(short * f).cast("int"))) for f in fractions])))
    centre = stars.select(key, F.bround("x").cast("int").alias("cx"), F.bround("y").cast("int").alias("cy")).distinct()
    p = centre.join(sz, key).select("*", side.alias("side"))
    low = lambda c, n: F.greatest(F.lit(0), F.least(C(n) - C("side"), C(c) - F.floor(C("side") / 2))).cast("int")
    p = p.select(key, "side", low("cx", "w").alias("x0"), low("cy", "h").alias("y0"), "h", "w").distinct()
    p = p.withColumns({"x1": F.least(C("w"), C("x0") + C("side")), "y1": F.least(C("h"), C("y0") + C("side"))})
    corner = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), (C(y) - 1).alias("y"), (C(x) - 1).alias("x")) for s, y, x in ((1, "y1", "x1"), (-1, "y0", "x1"), (-1, "y1", "x0"), (1, "y0", "x0"))]))
    ask = p.select(key, "side", "x0", "y0", "x1", "y1", corner.alias("c")).select(key, "side", "x0", "y0", "x1", "y1", "c.*")
    held = ask.join(sat, [key, "y", "x"], "left").groupBy(key, "side", "x0", "y0", "x1", "y1").agg(F.sum(C("s") * F.coalesce("_n", F.lit(0))).alias("objects"), fixed(F.sum(C("s") * F.coalesce("_f", F.lit(0.0)))).alias("flux"))
    held = saved(held.where(C("objects") >= minimum), "squares")
    best = held.groupBy(key).agg(F.min(F.struct("side", (-C("objects")).alias("o"), (-C("flux")).alias("f"))).alias("b")).select(key, C("b.side").alias("side"), (-C("b.o")).alias("objects"), (-C("b.f")).alias("flux"))
    tied = held.join(best, [key, "side", "objects", "flux"])
    inside = (C("x") >= C("x0")) & (C("x") < C("x1")) & (C("y") >= C("y0")) & (C("y") < C("y1"))
    of = [key, "side", "x0", "y0", "x1", "y1", "objects", "flux"]
    m = quantiles(tied.join(stars.select(key, "x", "y", "compactness", "saturation_fraction"), key).where(inside), of, [(C("compactness"), {"compactness": 0.5}), (C("saturation_fraction"), {"saturation_fraction": 0.5})], whole=True)
    one = m.groupBy(key).agg(F.min(F.struct((-C("compactness")).alias("c"), "saturation_fraction", "y0", "x0", "side", "y1", "x1", "objects", "flux")).alias("b"))
    return one.select(key, *[C(f"b.{n}").alias(n) for n in ("x0", "y0", "x1", "y1", "side", "objects", "flux")], (-C("b.c")).alias("compactness"), C("b.saturation_fraction").alias("saturation_fraction"))


def _ratios(flux: DataFrame, name: str, key: str) -> DataFrame:
    """Median neutral error and largest MAD of the log ratios of stars."""
    s = flux.withColumns({"rg": F.ln(C("r") / C("g")), "bg": F.ln(C("b") / C("g"))})
    s = with_quantiles(s, [key], [(C("rg"), {"_u": 0.5}), (C("bg"), {"_v": 0.5})], whole=True)
    q = quantiles(s, [key], [(F.abs(C("rg") - C("_u")), {"_a": 0.5}), (F.abs(C("bg") - C("_v")), {"_b": 0.5}), (F.sqrt(C("rg") * C("rg") + C("bg") * C("bg")), {f"{name}_error": 0.5})], whole=True)
    return q.select(key, C("n__a").alias(f"{name}_stars"), F.greatest("_a", "_b").alias(f"{name}_mad"), f"{name}_error")


def auto_reference(pix: DataFrame, points: DataFrame, r: int, minimum: int = 16, shortest: int = 32, cap: int = 256, key: str = "image_id", objects: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per image: method, background and white rectangle, gains, second offsets, and the reasons of both verdicts.

    An image whose background is not accepted keeps its input (``PRESERVE_INPUT``) and its stars are not looked at
    (white_reasons null). Where the white rectangle is not accepted, the background stays. At most
    ``cap`` stars of an image are analysed, as the rule demands, so its stars are one small group.
    """
    pix = shared(pix)
    m = saved(patch_measures(points, pix, r, key), "measures")
    base = saved(background_reference(pix, points, r, key, m), "base")
    on = base.where(F.size("reasons") == 0)
    seen = pix.join(on.select(key), key, "left_semi")
    stars, feet, _ = star_objects(seen, on, key) if objects is None else objects
    few = star_record_selection(stars, cap, key).select(key, "star_id")
    stars = saved(stars.join(few, [key, "star_id"], "left_semi").withColumn("flux", C("r") + C("g") + C("b")), "stars")
    size = seen.groupBy(key).agg(F.first("h").alias("h"), F.first("w").alias("w"))
    rect = saved(white_rectangle(stars, size, minimum, shortest=shortest, key=key), "rect")
    inside = (C("x") >= C("x0")) & (C("x") < C("x1")) & (C("y") >= C("y0")) & (C("y") < C("y1"))
    quadrant = (C("x") >= (C("x0") + C("x1")) / 2).cast("int") + (C("y") >= (C("y0") + C("y1")) / 2).cast("int") * 2
    s = stars.join(rect.select(key, "x0", "y0", "x1", "y1"), key).where(inside).withColumn("quadrant", quadrant).drop("x0", "y0", "x1", "y1")
    split = farthest_point_split(s.withColumnRenamed("star_id", "point_id"), key=key)
    s = saved(s.join(split.select(key, C("point_id").alias("star_id"), "split"), [key, "star_id"]), "split")
    fit = sigma_clip(s.where(C("split") == "fit").withColumns({"rg": F.ln(C("r") / C("g")), "bg": F.ln(C("b") / C("g"))}), [key], whole=True).where("in")
    fit = saved(fit.select(key, "star_id", *RGB), "fit")
    held = s.where(C("split") == "validation").select(key, "star_id", *RGB)
    meds = quantiles(fit, [key], [(C(c), {f"f_{c}": 0.5}) for c in RGB], whole=True)
    middle = F.array_sort(F.array(*[C(f"f_{c}") for c in RGB]))[1]
    gains = meds.select(key, *[F.least(F.greatest(middle / C(f"f_{c}"), F.lit(1.0 / GAIN_LIMIT)), F.lit(GAIN_LIMIT)).alias(f"gain_{c}") for c in RGB])
    gains = saved(gains, "gains")
    # the gains act on the lowered image; the same background patch then gives the second offsets
    raised = lowered(seen, on, key).join(gains, key).select(*seen.columns, *[F.greatest(C(f"{c}2") * C(f"gain_{c}"), F.lit(0.0)).alias(f"{c}2") for c in RGB])
    raised = saved(raised, "raised")
    patch = on.select(key, F.lit(0).alias("point_id"), F.lit("fit").alias("split"), C("bg_y").alias("y"), C("bg_x").alias("x"))
    again = patch_measures(patch, raised.select(key, "y", "x", *[C(f"{c}2").alias(c) for c in RGB]), r, key)
    second = saved(again.select(key, *[(C(f"m{c}") - F.least("mr", "mg", "mb")).alias(f"second_{c}") for c in RGB]), "second")
    final = raised.join(second, key).select(*seen.columns, *[F.greatest(C(f"{c}2") - C(f"second_{c}"), F.lit(0.0)).alias(f"{c}2") for c in RGB])
    final = saved(final, "final")
    j = judged(final, m.where(C("split") == "validation"), on.select(key, "bg_level"), r, key).select(key, "safety", C("error_after").alias("white_background_error"))
    after = star_flux(final.select(key, "y", "x", *[C(f"{c}2").alias(c) for c in RGB]), feet.join(held.select(key, "star_id"), [key, "star_id"], "left_semi"), key)
    cover = s.groupBy(key).agg(F.count_distinct("quadrant").alias("_quadrants"), F.max((C("split") != "insufficient").cast("int")).alias("_ready"))
    d = on.select(key, C("error_after").alias("_first_error")).join(rect.select(key, C("x0").alias("white_x"), C("y0").alias("white_y"), C("side").alias("white_side"), C("objects").alias("white_objects")), key, "left")
    for t in (cover, gains, second, j, _ratios(fit, "fit", key), _ratios(held, "before", key), _ratios(after, "after", key)):
        d = d.join(t, key, "left")
    improved = (C("before_error") - C("after_error")) / F.greatest("before_error", F.lit(1e-12))
    pre = _reasons(
        (C("white_objects") < minimum, "insufficient_independent_star_objects"), (C("_quadrants") < 3, "insufficient_star_quadrant_coverage"), (C("_ready") == 0, "star_fit_holdout_split_unavailable"),
        (C("fit_stars") < 12, "insufficient_star_fit_objects_after_clipping"), (C("fit_mad") > RATIO_MAD, "star_color_ratio_dispersion_exceeded"))
    post = F.array_union(_reasons(
        (improved < STAR_IMPROVEMENT, "heldout_star_neutral_error_improvement_insufficient"), (C("after_mad") > C("before_mad") * 1.05 + 1e-8, "heldout_star_ratio_dispersion_growth_exceeded"),
        (C("white_background_error") > C("_first_error") * 1.05 + 0.0005, "background_regressed_after_pseudo_white_reference")), F.coalesce("safety", F.array().cast("array<string>")))
    d = d.withColumn("_pre", pre).withColumn("white_reasons", F.when(F.size("_pre") > 0, C("_pre")).otherwise(F.sort_array(post)))
    told = [key, "white_x", "white_y", "white_side", "white_objects", *[f"gain_{c}" for c in RGB], *[f"second_{c}" for c in RGB], "before_error", "after_error", "white_reasons"]
    out = base.select(key, "bg_y", "bg_x", *[f"off_{c}" for c in RGB], "reasons").join(d.select(*told), key, "left")
    method = F.when(F.size("reasons") > 0, "PRESERVE_INPUT").when(F.size("white_reasons") == 0, "AUTO_BACKGROUND_WHITE_REGION").otherwise("AUTO_BACKGROUND_NEUTRALIZATION")
    return out.withColumns({"method": method, "status": F.when(F.size("reasons") > 0, "rejected").otherwise("accepted")})
