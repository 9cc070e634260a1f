"""Background measurement: patches around points, plane fits, spatial models, patterns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import clamp
from ..session import shared
from .grid import box_blur, repeated_blur
from .quantiles import correlation, quantiles, robust_sigma, with_quantiles, with_stats

C = F.col
EPS = 2.220446049250313e-16


def patch_join(points: DataFrame, pix: DataFrame, r: int, key: str = "image_id") -> DataFrame:
    """Pixels of the (2r+1)^2 square around each point.

    A point is exploded into the pixel positions it needs, so the range condition
    becomes an equi join on (image, y, x).
    """
    off = F.sequence(F.lit(-r), F.lit(r))
    cells = points.select(key, "point_id", "split", C("y").alias("py"), C("x").alias("px"), F.explode(off).alias("_dy"))
    cells = cells.select("*", F.explode(off).alias("_dx")).withColumns({"y": C("py") + C("_dy"), "x": C("px") + C("_dx")})
    return cells.join(pix, [key, "y", "x"]).withColumns({"by": C("_dy") + r, "bx": C("_dx") + r}).drop("_dy", "_dx")


def patch_stats(patch: DataFrame, r: int, value: str = "l", key: str = "image_id") -> DataFrame:
    """Median, MAD, clip counts and median uncertainty of each patch; at most (2r+1)^2 rows a group.

    The uncertainty is the larger of the pixel standard error and the standard error
    of non-overlapping block medians, the latter with at least six blocks.
    """
    g = [key, "point_id", "split", "py", "px"]
    v = C(value)
    side = max(2, (2 * r + 1) // 5)
    patch = shared(patch)
    p = with_quantiles(patch, g, [(v, {"med": 0.5})], whole=True)
    pix = quantiles(p, g, [(F.abs(v - C("med")), {"mad": 0.5}), (C("med"), {"median": 0.0})], whole=True)
    ext = patch.groupBy(*g).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(v <= 0).alias("low_clip"), F.count_if(v >= 1).alias("high_clip"))
    b = patch.withColumn("_b", F.floor(C("by") / side) * 1000 + F.floor(C("bx") / side))
    blocks = quantiles(b, [*g, "_b"], [(v, {"bm": 0.5})], whole=True).where(C("n_bm") >= max(4, side * side // 2))
    bs = robust_sigma(blocks, g, {"blk": C("bm")}, minimum=1, whole=True)
    out = pix.join(ext, g).join(bs, g, "left")
    pixel_se = F.lit(1.2533 * 1.4826) * C("mad") / F.sqrt(C("n_mad"))
    block_se = F.lit(1.2533) * C("blk_sigma") / F.sqrt(C("blk_n"))
    unc = F.greatest(F.when(C("blk_n") >= 6, F.greatest(pixel_se, block_se)).otherwise(pixel_se), F.lit(EPS))
    return out.select(*g, C("n_mad").alias("pixels"), "median", "mad", "lo", "hi", "low_clip", "high_clip",
                      F.coalesce("blk_n", F.lit(0)).alias("blocks"), F.when(C("n_mad") >= 16, unc).alias("uncertainty"))


def heldout(patches: DataFrame, minimum: int = 4, key: str = "image_id") -> DataFrame:
    """Span, level and noise of the held-out patches of each image."""
    v = patches.where(C("split") == "validation")
    q = quantiles(v, [key], [
        (C("median"), {"center": 0.5, "p10": 0.1, "p90": 0.9}), (C("mad"), {"patch_mad_median": 0.5}), (C("uncertainty"), {"uncertainty_median": 0.5})])
    clip = v.groupBy(key).agg(F.sum("low_clip").alias("low_clip"), F.sum("high_clip").alias("high_clip"), F.sum("pixels").alias("pixels"))
    out = q.join(clip, key)
    return out.select(
        key, C("n_center").alias("samples"), "pixels", C("center").alias("median"), "p10", "p90",
        F.greatest(F.lit(0.0), C("p90") - C("p10")).alias("robust_span"), "patch_mad_median", "uncertainty_median",
        (F.lit(2.0**0.5) * F.greatest(C("uncertainty_median"), F.lit(EPS))).alias("span_se"), "low_clip", "high_clip",
        F.when(C("n_center") >= minimum, "ready").otherwise("unavailable").alias("status"),
    )


def plane_fit(df: DataFrame, keys: list[str], x: Column, y: Column, v: Column, p: str = "") -> DataFrame:
    """Least squares v ~ 1 + x + y from one pass of centred second moments.

    One aggregate with map-side combine; the normal equations are solved in closed form. Points on one line or in one
    place span no plane (rank 2): they have no slopes, level and sigma, and a group without any value no rms either.
    """
    d = df.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y"), v.cast("double").alias("_v"))
    s = d.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.avg("_v").alias("_mv"),
        F.var_pop("_x").alias("_xx"), F.var_pop("_y").alias("_yy"), F.covar_pop("_x", "_y").alias("_xy"),
        F.covar_pop("_x", "_v").alias("_xv"), F.covar_pop("_y", "_v").alias("_yv"), F.var_pop("_v").alias("_vv"),
    )
    s = s.withColumn("_det", C("_xx") * C("_yy") - C("_xy") * C("_xy"))
    ok = C("_det") > 1e-15
    s = s.withColumns({
        "_bx": F.when(ok, (C("_xv") * C("_yy") - C("_yv") * C("_xy")) / C("_det")),
        "_by": F.when(ok, (C("_yv") * C("_xx") - C("_xv") * C("_xy")) / C("_det")),
    })
    s = s.withColumn("_rss", F.greatest((C("_vv") - C("_bx") * C("_xv") - C("_by") * C("_yv")) * C("_n"), F.lit(0.0)))
    dof, det, n = F.greatest(C("_n") - 3, F.lit(1)), F.nullif("_det", F.lit(0.0)), F.nullif("_n", F.lit(0))
    var = F.greatest(C("_rss") / dof * (C("_xx") + C("_yy")) / (det * n), F.lit(1e-30))
    return s.select(
        *keys, C("_n").alias(f"{p}samples"), F.when(ok, 3).otherwise(F.lit(2)).alias(f"{p}rank"),
        (C("_mv") - C("_bx") * C("_mx") - C("_by") * C("_my")).alias(f"{p}level"), C("_bx").alias(f"{p}slope_x"), C("_by").alias(f"{p}slope_y"),
        F.sqrt(C("_rss") / n).alias(f"{p}rms"), (F.abs("_bx") + F.abs("_by")).alias(f"{p}span"),
        (F.sqrt(C("_bx") * C("_bx") + C("_by") * C("_by")) / F.sqrt(var)).alias(f"{p}sigma"),
        C("_rss").alias(f"{p}rss"), F.sqrt(C("_yy") / det / n).alias(f"{p}unit_x"), F.sqrt(C("_xx") / det / n).alias(f"{p}unit_y"),
    )


def norm_xy(side: int) -> tuple[Column, Column]:
    return C("px") / F.lit(float(side - 1)), C("py") / F.lit(float(side - 1))


def spatial_planes(points: DataFrame, pix: DataFrame, r: int, side: int, key: str = "image_id") -> DataFrame:
    """Planes of luminance, R-G and B-G patch medians, normalised by the luminance level of the image."""
    pp = patch_join(points, pix, r, key)
    comp = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), e.alias("v")) for n, e in
                               (("luma", C("l")), ("rg", C("r") - C("g")), ("bg", C("b") - C("g")))]))
    long = pp.select(key, "point_id", "split", "py", "px", comp.alias("s"), "l").select(key, "point_id", "split", "py", "px", "s.*")
    med = quantiles(long, [key, "component", "point_id", "split", "py", "px"], [(C("v"), {"m": 0.5})], whole=True)
    lum = F.when(C("component") == "luma", C("m"))
    scaled = with_quantiles(med, [key], [(lum, {"_lvl": 0.5})])
    x, y = norm_xy(side)
    out = plane_fit(scaled, [key, "component"], x - 0.5, y - 0.5, C("m") / F.greatest(C("_lvl"), F.lit(1e-6)))
    return out.drop("rss", "unit_x", "unit_y")


def model_compare(patches: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Plane (1,x,y) against radial (1,r^2) on patch medians by BIC."""
    x, y = norm_xy(side)
    d = shared(patches.withColumns({"_cx": x - 0.5, "_cy": y - 0.5}).withColumn("_r2", C("_cx") * C("_cx") + C("_cy") * C("_cy")))
    plane = plane_fit(d, [key], C("_cx"), C("_cy"), C("median")).select(key, C("samples").alias("n"), C("rss").alias("plane_rss"))
    rad = d.groupBy(key).agg(F.covar_pop("_r2", "median").alias("_c"), F.var_pop("_r2").alias("_v"), F.avg("_r2").alias("_mr"), F.avg("median").alias("_mm"), F.var_pop("median").alias("_vv"))
    rad = rad.withColumn("radial_slope", C("_c") / C("_v")).withColumn("radial_level", C("_mm") - C("radial_slope") * C("_mr"))
    res = d.join(rad, key).withColumn("_res", C("median") - C("radial_level") - C("radial_slope") * C("_r2"))
    sig = robust_sigma(res, [key], {"radial": C("_res")}, minimum=1)
    q = quantiles(d, [key], [(C("median"), {"p10": 0.1, "p90": 0.9}), (C("uncertainty"), {"_u": 0.5})])
    out = plane.join(rad, key).join(sig, key).join(q, key)
    n = C("n")
    out = out.withColumn("radial_rss", F.greatest((C("_vv") - C("radial_slope") * C("_c")) * n, F.lit(0.0)))
    bic = lambda rss, k: n * F.ln(F.greatest(rss, F.lit(1e-300)) / n) + F.lit(float(k)) * F.ln(n)
    lim = F.greatest(F.lit(3.0 * 2.0**0.5) * C("_u"), F.lit(1e-12))
    out = out.withColumns({"plane_bic": bic(C("plane_rss"), 3), "radial_bic": bic(C("radial_rss"), 2), "span": F.greatest(C("p90") - C("p10"), F.lit(0.0)), "limit": lim})
    varies = C("span") > C("limit")
    edge = C("radial_slope") * 0.5
    radial = varies & (edge < -C("limit")) & (C("radial_bic") + 6.0 < C("plane_bic")) & (C("radial_sigma") <= F.greatest(C("span") * 0.40, C("limit")))
    return out.select(key, C("n").alias("samples"), "plane_bic", "radial_bic", "radial_sigma", edge.alias("edge_delta"), "span", "limit",
                      varies.alias("spatial_variation"), radial.alias("radial_preferred"))


DIRECTIONS = {"horizontal": (1, 0), "vertical": (0, 1), "diagonal_down": (1, 1), "diagonal_up": (1, -1)}


def shift_correlation(df: DataFrame, value: str, mask: str, minimum: int = 128, key: str = "image_id") -> DataFrame:
    """Pearson correlation of masked pixels with their neighbour in four directions.

    Every pixel is sent once to each neighbour position (four struct rows), then one
    equi join on (image, y, x) pairs them; no pair search.
    """
    on = df.where(C(mask)).select(key, "y", "x", C(value).alias("a"))
    sent = on.select(
        key, "a", "y", "x",
        F.explode(F.array(*[F.struct(F.lit(n).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for n, (dx, dy) in DIRECTIONS.items()])).alias("s"))
    sent = sent.select(key, C("a").alias("left"), C("s.d").alias("direction"), (C("y") + C("s.dy")).alias("y"), (C("x") + C("s.dx")).alias("x"))
    pairs = sent.join(on.withColumnRenamed("a", "right"), [key, "y", "x"])
    c = pairs.groupBy(key, "direction").agg(F.count("*").alias("pairs"), correlation(C("left"), C("right")).alias("_c"))
    return c.select(key, "direction", "pairs", F.when(C("pairs") >= minimum, F.coalesce(F.when(~F.isnan("_c"), C("_c")), F.lit(0.0))).otherwise(F.lit(0.0)).alias("corr"))


def pattern_noise(grid: DataFrame, minimum: int = 512, pairs: int = 128, key: str = "image_id") -> DataFrame:
    """Row and column banding, diagonal walking noise, kind and orientation per image (expects ``l``)."""
    d = with_quantiles(grid, [key], [(C("l"), {"_lim": 0.6})]).withColumn("_bg", C("l") <= C("_lim"))
    d = repeated_blur(d.select(key, "y", "x", "h", "w", "l", "_bg"), "l", {4: "_s4", 12: "_s12"}, [key])
    d = shared(d.select(key, "y", "x", "_bg", (C("l") - C("_s4")).alias("_res"), (C("l") - C("_s12")).alias("_broad")))
    sig = robust_sigma(d, [key], {"res": F.when(C("_bg"), C("_res"))}, minimum=1)
    count = d.groupBy(key).agg(F.count_if("_bg").alias("sky"))

    def band(line: str, name: str) -> DataFrame:
        prof = quantiles(d, [key, line], [(C("_broad"), {"m": 0.5})], whole=None)
        from pyspark.sql import Window as W
        w = W.partitionBy(key).orderBy(line)
        # 5-point mean with the end values repeated
        near = [F.coalesce(F.lag("m", k).over(w) if k > 0 else F.lead("m", -k).over(w), F.first("m").over(w) if k > 0 else F.last("m").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))) for k in (1, 2, -1, -2)]
        prof = prof.withColumn("_sm", (near[0] + near[1] + C("m") + near[2] + near[3]) / 5.0)
        return robust_sigma(prof, [key], {name: C("m") - C("_sm")}, minimum=1).select(key, f"{name}_sigma")

    cor = shift_correlation(d, "_res", "_bg", pairs, key)
    wide = cor.groupBy(key).agg(*[F.coalesce(F.max(F.when(C("direction") == n, C("corr"))), F.lit(0.0)).alias(n) for n in DIRECTIONS])
    out = sig.join(count, key).join(band("y", "row"), key).join(band("x", "col"), key).join(wide, key)
    rs = F.greatest(C("res_sigma"), F.lit(1e-8))
    out = out.withColumns({"row_score": clamp((C("row_sigma") / rs - 0.04) / 0.30), "col_score": clamp((C("col_sigma") / rs - 0.04) / 0.30)})
    pos = {n: F.greatest(C(n), F.lit(0.0)) for n in DIRECTIONS}
    srt = F.sort_array(F.array(*pos.values()), asc=False)
    diag_name = F.when(C("diagonal_down") >= C("diagonal_up"), "diagonal_down").otherwise("diagonal_up")
    out = out.withColumns({
        "stripe": F.greatest("row_score", "col_score"),
        "walking": clamp((F.greatest(pos["diagonal_down"], pos["diagonal_up"]) - F.greatest(pos["horizontal"], pos["vertical"]) - 0.04) / 0.25),
        "directional": clamp((F.greatest(srt[0] - srt[2], F.lit(0.0)) - 0.08) / 0.30),
    }).withColumn("score", F.greatest("stripe", "walking", "directional"))
    found = (C("score") >= 0.55) | (C("walking") >= 0.50)
    best = F.lit(None).cast("string")
    top = F.greatest(*[C(n) for n in DIRECTIONS])
    for n in reversed(list(DIRECTIONS)):
        best = F.when(C(n) == top, n).otherwise(best)
    kind = (
        F.when(~found, "none").when(C("walking") >= 0.50, "diagonal_walking_noise")
        .when((C("row_score") >= C("col_score")) & (C("stripe") >= C("directional")), "horizontal_banding")
        .when((C("col_score") > C("row_score")) & (C("stripe") >= C("directional")), "vertical_banding").otherwise("directional_pattern_noise")
    )
    orient = F.when(kind == "none", None).when(kind == "diagonal_walking_noise", diag_name).when(kind == "horizontal_banding", "horizontal").when(kind == "vertical_banding", "vertical").otherwise(best)
    few = C("sky") < minimum
    return out.select(key, "sky", F.when(few, "unavailable").otherwise("ok").alias("status"), (found & ~few).alias("detected"), "score", "stripe", "walking", "directional",
                      F.when(few, "none").otherwise(kind).alias("kind"), F.when(~few, orient).alias("orientation"))


def background_quality(grid: DataFrame, tile: int, key: str = "image_id") -> DataFrame:
    """Weighted sky statistics, mottling, and tile residual RMS with its outlier share (expects ``l``)."""
    d = with_quantiles(grid, [key], [(C("l"), {"_c": 0.35})]).withColumn("_w", (C("l") <= C("_c")).cast("double"))
    d = d.withColumns({"_rg": C("r") - C("g"), "_bg": C("b") - C("g")})
    d = box_blur(d, {"l": "_b1", "_rg": "_rgs", "_bg": "_bgs"}, 1, [key])
    d = repeated_blur(d, "_b1", {2: "_b3"}, [key])
    rgn, bgn = C("_rg") - C("_rgs"), C("_bg") - C("_bgs")
    mean3 = (C("r") + C("g") + C("b")) / 3.0
    bias = F.sqrt(((C("r") - mean3) * (C("r") - mean3) + (C("g") - mean3) * (C("g") - mean3) + (C("b") - mean3) * (C("b") - mean3)) / 3.0)
    d = d.withColumns({"_cn": F.sqrt((rgn * rgn + bgn * bgn) * 0.5), "_tx": F.abs(C("l") - C("_b1")), "_mo": F.abs(C("_b1") - C("_b3")), "_bi": bias, "_tr": C("l") - C("_b1")})
    tot = F.sum("_w")
    wm = lambda c: F.sum(c * C("_w")) / tot
    base = d.groupBy(key).agg(
        wm(C("l")).alias("level"), wm(C("l") * C("l")).alias("_l2"), wm(C("r")).alias("red"), wm(C("g")).alias("green"), wm(C("b")).alias("blue"),
        wm(C("_cn")).alias("_cn"), wm(C("_mo")).alias("_mo"), wm(C("_tx")).alias("_tx"), wm(C("_bi")).alias("_bi"), F.avg((C("l") >= 0.985).cast("int")).alias("core_clip"))
    t = d.groupBy(key, F.floor(C("y") / tile).alias("ty"), F.floor(C("x") / tile).alias("tx")).agg(
        F.avg("_w").alias("_mw"), F.var_pop("l").alias("var"), (F.sum(C("_tr") * C("_w")) / tot).alias("_m"), (F.sum(C("_tr") * C("_tr") * C("_w")) / tot).alias("_m2"))
    t = t.where(C("_mw") > 0.30).withColumn("rms", F.sqrt(F.greatest(C("_m2") - C("_m") * C("_m"), F.lit(0.0))))
    t = with_quantiles(t, [key], [(C("rms"), {"_rm": 0.5})])
    t = with_quantiles(t, [key], [(F.abs(C("rms") - C("_rm")), {"_mad": 0.5})])
    z = F.greatest(F.lit(0.0), (C("rms") - C("_rm")) / F.greatest(F.lit(1.4826) * C("_mad"), C("_rm") * 0.15, F.lit(1e-6)))
    tq = quantiles(t.withColumn("_z", z), [key], [(C("var"), {"patch_variance": 0.5}), (C("rms"), {"residual_median": 0.5, "residual_p90": 0.9}), (C("_z"), {"outlier_score": 0.9})])
    out = base.join(tq, key, "left")
    std = F.sqrt(F.greatest(C("_l2") - C("level") * C("level"), F.lit(0.0)))
    out = out.withColumn("std", std)
    z0 = lambda c: F.coalesce(C(c), F.lit(0.0)).alias(c)
    return out.select(
        key, "level", "std", clamp(C("std") / F.greatest(C("level"), F.lit(0.015)), 0.0, 2.0).alias("dirty_score"),
        clamp(C("_cn") / F.greatest(C("std") * 2.0, F.lit(0.01)), 0.0, 2.0).alias("chroma_noise"),
        clamp(C("_mo") / F.greatest(C("std") * 2.0, F.lit(0.006)), 0.0, 2.0).alias("mottling"),
        clamp(C("_tx") / F.greatest(C("std") * 3.0, F.lit(0.006)), 0.0, 2.0).alias("artifact"),
        (C("_bi") / F.greatest(C("level"), F.lit(1e-4))).alias("chroma_load"), "red", "green", "blue", "core_clip",
        F.coalesce("n_patch_variance", F.lit(0)).alias("tiles"), z0("patch_variance"), z0("residual_median"), z0("residual_p90"), z0("outlier_score"))
