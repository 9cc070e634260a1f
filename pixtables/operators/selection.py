"""Sample selection and grouped kernels: the few steps that are sequential within one image."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import pixel as px
from ..functions.fixed import clamp
from ..session import cut, images_fit
from .background import plane_fit
from .grid import box_blur, morph
from .quantiles import correlation, quantiles, robust_sigma, with_quantiles, with_stats
from .stars import aperture_join

C = F.col


# ---- spread of points ---------------------------------------------------------
# The greedy rules below take one point of an image after the other. Where the session declares that an image is small
# (see quantiles), its points are one row of arrays and nothing is written; otherwise every image takes one point per
# round: an argmax per image as an aggregate, then one distance update, as many rounds as the largest image takes points.
def _lists(a: pa.Array) -> list[np.ndarray]:
    """The lists of an array as numpy arrays, null as NaN."""
    ends = np.cumsum(a.value_lengths().to_numpy())
    return np.split(a.flatten().to_numpy(zero_copy_only=False), ends)[: len(a)]


def _same(a: pa.Array) -> pa.Array:
    """Lists of identities as lists of numbers, equal where the identities are; null: -1."""
    codes = a.flatten().dictionary_encode().indices.fill_null(-1).cast(pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy())]).astype(np.int32)), codes)


def _flags(found: list[np.ndarray]) -> pa.Array:
    return pa.array([f.tolist() for f in found], pa.list_(pa.bool_()))


def _farthest(cap: int):
    def taken(it: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, us, vs, nears, ins in it:
            found = []
            for i, u, v, near, held in zip(_lists(_same(ids)), _lists(us), _lists(vs), _lists(nears), _lists(ins)):
                near, held = near.astype(float), held.astype(bool)
                while held.sum() < cap and not held.all():
                    # unknown distances come first, as nulls do in an order; equal ones by place in the list
                    b = np.argmax(np.where(held, -np.inf, np.where(np.isnan(near), np.inf, near)))
                    far = (u - u[b]) * (u - u[b]) + (v - v[b]) * (v - v[b])
                    now, closer = held | ((i == i[b]) & (i[b] >= 0)), np.fmin(near, far)
                    if (now == held).all() and np.array_equal(closer, near, equal_nan=True):
                        break
                    near, held = closer, now
                found.append(held)
            yield _flags(found)

    return F.arrow_udf(taken, "array<boolean>")


def _held_out(it: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for ids, xs, ys, quadrants, sizes, wants in it:
        found = []
        for i, x, y, q, size, want in zip(_lists(_same(ids)), _lists(xs), _lists(ys), _lists(quadrants), _lists(sizes), wants.to_numpy(zero_copy_only=False)):
            _, q = np.unique(q, return_inverse=True)
            held, near = np.zeros(len(i), bool), np.full(len(i), np.inf)
            while held.sum() < want:
                used = np.bincount(q, held)[q]
                free = ~held & (used < size - 1)
                if not free.any():
                    break
                free &= (used > 0) == (used[free] > 0).min()
                b = np.argmax(np.where(free, near, -np.inf))
                far = np.sqrt((x - x[b]) * (x - x[b]) + (y - y[b]) * (y - y[b]))
                now, closer = held | ((i == i[b]) & (i[b] >= 0)), np.fmin(near, far)
                if (now == held).all() and np.array_equal(closer, near):
                    break
                held, near = now, closer
            found.append(held)
        yield _flags(found)


def star_record_selection(stars: DataFrame, cap: int, key: str = "image_id") -> DataFrame:
    """Best shape per quadrant first, then the star farthest from all taken, up to ``cap`` stars per image.

    stars(key, star_id, x, y, quadrant, saturation_fraction, aspect_ratio, compactness). Distances
    are in units of the image's extent on each axis; equal ones go to the smaller star_id. Images
    of at most ``cap`` stars keep all.
    """
    w = {"_x0": F.min("x"), "_x1": F.max("x"), "_y0": F.min("y"), "_y1": F.max("y"), "_n": F.count("*")}
    s = with_stats(stars, [key], w)
    span = lambda a: F.greatest(C(f"_{a}1") - C(f"_{a}0"), F.lit(1.0))
    s = s.withColumns({"_u": (C("x") - C("_x0")) / span("x"), "_v": (C("y") - C("_y0")) / span("y")})
    shape = F.struct("saturation_fraction", F.abs(C("aspect_ratio") - 1.0).alias("a"), (-C("compactness")).alias("c"), "y", "x", "star_id")
    seeds = s.groupBy(key, "quadrant").agg(F.min(shape).alias("m")).select(key, C("m.star_id").alias("star_id"), F.lit(True).alias("_seed"))
    s = s.join(seeds, [key, "star_id"], "left").withColumn("_in", F.coalesce("_seed", F.lit(False)) | (C("_n") <= cap))
    taken = s.where("_seed").groupBy(key).agg(F.collect_list(F.struct("_u", "_v")).alias("_t"))  # at most one per quadrant
    square = lambda u, v: (C("_u") - u) * (C("_u") - u) + (C("_v") - v) * (C("_v") - v)
    s = s.join(taken, key).withColumn("_near", F.array_min(F.transform("_t", lambda t: square(t["_u"], t["_v"])))).drop("_t", "_seed")
    if images_fit(s.sparkSession):
        told = ["star_id", "_u", "_v", "_near", "_in"]
        a = s.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*told, "x", "y", "quadrant"))).alias("_a"))
        a = a.select(key, F.filter(F.arrays_zip("_a", _farthest(cap)(*[C("_a")[n] for n in told]).alias("_k")), lambda e: e["_k"]).alias("_a"))
        return a.select(key, F.explode("_a._a").alias("s")).select(key, *[C(f"s.{n}") for n in ("star_id", "x", "y", "quadrant")])
    s = cut(s)
    rounds = s.groupBy(key).agg((F.least(F.lit(cap), F.count("*")) - F.count_if("_in")).alias("r")).agg(F.max("r")).first()[0] or 0
    for _ in range(rounds):
        free = F.when(~C("_in"), F.struct((-C("_near")).alias("d"), "star_id", "_u", "_v"))
        best = s.groupBy(key).agg(F.count_if("_in").alias("_k"), F.min(free).alias("_b")).where(C("_k") < cap).select(key, "_b")
        s = s.join(best, key, "left")
        near = F.least("_near", F.coalesce(square(C("_b._u"), C("_b._v")), C("_near")))
        s = cut(s.withColumns({"_in": C("_in") | F.coalesce(C("star_id") == C("_b.star_id"), F.lit(False)), "_near": near}).drop("_b"))
    return s.where("_in").select(key, "star_id", "x", "y", "quadrant")


def farthest_point_split(points: DataFrame, ratio: float = 0.25, key: str = "image_id") -> DataFrame:
    """Fit / held-out split of each image's points.

    A quarter (``ratio``, at least four, twelve left to fit) is held out, one after the other: a
    point of a quadrant without a held-out point first, then the farthest from all held-out ones,
    then the upper left one; each quadrant keeps one point to fit. Images of under 16 points, or
    without three quadrants on both sides, are ``insufficient``.
    """
    p = points.select(key, C("point_id").cast("long").alias("point_id"), C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), C("quadrant").cast("int").alias("quadrant"))
    n = p.groupBy(key).agg(F.count("*").alias("_n"))
    want = F.when(C("_n") < 16, 0).otherwise(F.least(F.greatest(F.lit(4), F.ceil(C("_n") * ratio)), C("_n") - 12)).cast("int")
    size = p.groupBy(key, "quadrant").agg(F.count("*").alias("_size"))
    p = p.join(n.select(key, "_n", want.alias("_want")), key).join(size, [key, "quadrant"])
    if images_fit(p.sparkSession):
        a = p.groupBy(key, "_n", "_want").agg(F.sort_array(F.collect_list(F.struct("y", "x", "point_id", "quadrant", "_size"))).alias("_a"))
        held = F.arrow_udf(_held_out, "array<boolean>")(*[C("_a")[c] for c in ("point_id", "x", "y", "quadrant", "_size")], "_want")
        a = a.select(key, "_n", F.explode(F.arrays_zip("_a", held.alias("_held"))).alias("e"))
        return _split(a.select(key, "_n", C("e._a").alias("s"), C("e._held").alias("_held")).select(key, "_n", "s.*", "_held"), key)
    p = cut(p.withColumns({"_held": F.lit(False), "_near": F.lit(float("inf"))}))
    rounds = p.agg(F.max("_want")).first()[0] or 0
    for _ in range(rounds):
        used = p.groupBy(key, "quadrant").agg(F.count_if("_held").alias("_used"))
        open_ = p.join(used, [key, "quadrant"]).where(~C("_held") & (C("_used") < C("_size") - 1))
        first = F.min(F.struct((C("_used") > 0).alias("q"), (-C("_near")).alias("d"), "y", "x", "point_id")).alias("_b")
        short = p.groupBy(key).agg(F.count_if("_held").alias("_k"), F.max("_want").alias("_w")).where(C("_k") < C("_w")).select(key)
        best = open_.join(short, key, "left_semi").groupBy(key).agg(first)
        p = p.join(best, key, "left")
        far = F.sqrt((C("x") - C("_b.x")) * (C("x") - C("_b.x")) + (C("y") - C("_b.y")) * (C("y") - C("_b.y")))
        p = cut(p.withColumns({"_held": C("_held") | F.coalesce(C("point_id") == C("_b.point_id"), F.lit(False)), "_near": F.least("_near", F.coalesce(far, C("_near")))}).drop("_b"))
    return _split(p, key)


def _split(p: DataFrame, key: str) -> DataFrame:
    p = with_stats(p, [key], {
        "_h": F.count_if("_held"), "_f": F.count_if(~C("_held")),
        "_hq": F.collect_set(F.when(C("_held"), C("quadrant"))), "_fq": F.collect_set(F.when(~C("_held"), C("quadrant")))})
    ok = (C("_n") >= 16) & (C("_h") >= 4) & (C("_f") >= 12) & (F.size("_hq") >= 3) & (F.size("_fq") >= 3)
    return p.select(key, "point_id", "x", "y", "quadrant", F.when(~ok, "insufficient").when(C("_held"), "validation").otherwise("fit").alias("split"))


def safe_samples(patches: DataFrame, side: int, per_cell: int = 1, bright_q: float = 0.60, texture_q: float = 0.70, key: str = "image_id") -> DataFrame:
    """Patches under the brightness and texture quantiles, the best of each grid cell by score.

    patches(key, point_id, py, px, median, mad). Adds the number of covered cells and quadrants.
    """
    p = with_quantiles(patches, [key], [(C("median"), {"_bq": bright_q}), (C("mad"), {"_tq": texture_q}), (C("median"), {"_lo": 0.0})])
    p = p.where((C("median") <= C("_bq")) & (C("mad") <= C("_tq")))
    cell = F.floor(C("py") * 4 / side) * 4 + F.floor(C("px") * 4 / side)
    quad = F.floor(C("py") * 2 / side) * 2 + F.floor(C("px") * 2 / side)
    score = (C("median") - C("_lo")) + C("mad") * 2.0
    p = p.select(key, "point_id", cell.cast("int").alias("cell"), quad.cast("int").alias("quadrant"), score.alias("score"))
    w = W.partitionBy(key, "cell").orderBy("score", "point_id")
    p = p.withColumn("_r", F.row_number().over(w)).where(C("_r") <= per_cell).drop("_r")
    n = p.groupBy(key).agg(F.countDistinct("cell").alias("cells"), F.countDistinct("quadrant").alias("quadrants"), F.count("*").alias("samples"))
    return p.join(n, key).withColumn("status", F.when((C("samples") >= 4) & (C("quadrants") >= 3), "ready").otherwise("insufficient"))


# ---- curves that need a search ---------------------------------------------------
def _bisect(v: pd.Series, target: pd.Series, top: pd.Series) -> pd.Series:
    """Largest strength in (0, top] whose arcsinh curve maps v to at most target."""
    lo, hi = np.full(len(v), 1e-6), top.to_numpy(dtype=float).copy()
    x, t = v.to_numpy(dtype=float), target.to_numpy(dtype=float)
    f = lambda k: np.arcsinh(k * x) / np.arcsinh(k)
    done = f(hi) <= t
    for _ in range(40):
        mid = (lo + hi) / 2
        good = f(mid) <= t
        lo, hi = np.where(good, mid, lo), np.where(good, hi, mid)
    return pd.Series(np.where(done, top, lo))


def asinh_anchor_stretch(layer: DataFrame, delta: float, coverage: float, key: str = "image_id") -> DataFrame:
    """Star layer stretched by an arcsinh curve: strength from the anchors, lowered until the share of
    pixels above ``delta`` stays within ``coverage``.

    The share stays within the limit exactly when the curve maps the (1 - coverage)
    percentile to at most delta, so the search runs on one row per image.
    """
    d = layer.withColumn("p", F.greatest("r", "g", "b"))
    a = quantiles(d, [key], [(C("p"), {"p50": 0.5, "p90": 0.9, "p99": 0.99, "edge": 1.0 - coverage})])
    nominal = clamp(F.lit(0.5) / F.greatest(C("p50"), F.lit(0.02)) * 10.0, 1.0, 100.0)
    a = a.withColumn("strength", F.pandas_udf(_bisect, "double")("edge", F.greatest(C("edge"), F.lit(delta)), nominal))
    j = d.join(a.select(key, "strength"), key)
    gain = F.asinh(C("p") * C("strength")) / F.asinh(C("strength")) / F.greatest(C("p"), F.lit(1e-9))
    return j.select(key, "y", "x", "strength", *[clamp(C(c) * gain).alias(c) for c in "rgb"])


def masked_mtf_curves(profile: DataFrame, target: float, iterations: int = 4, nodes: int = 33, key: str = "image_id") -> DataFrame:
    """LUT of an iterated midtone stretch toward the target background, then one arcsinh stage.

    profile(key, black, p50). Works on one row per image: the level is followed through
    the iterations as a column, the LUT as an array.
    """
    d = profile.withColumns({"_lvl": clamp((C("p50") - C("black")) / F.greatest(F.lit(1.0) - C("black"), F.lit(1e-9)), 1e-6, 0.999999)})
    grid = F.array(*[F.lit(i / (nodes - 1)) for i in range(nodes)])
    d = d.withColumn("_y", F.transform(grid, lambda x: F.least(F.greatest((x - C("black")) / F.greatest(F.lit(1.0) - C("black"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))))
    for i in range(iterations):
        step = C("_lvl") + (F.lit(target) - C("_lvl")) / float(iterations - i)
        m = C("_lvl") * (F.lit(1.0) - step) / (C("_lvl") * (F.lit(1.0) - F.lit(2.0) * step) + step)
        d = d.withColumns({"_m": clamp(m, 1e-4, 0.9999), "_next": step})
        curve = lambda v: (C("_m") - 1.0) * v / ((F.lit(2.0) * C("_m") - 1.0) * v - C("_m"))
        d = d.withColumns({"_y": F.transform("_y", lambda v: F.when(v <= 0, F.lit(0.0)).when(v >= 1, F.lit(1.0)).otherwise(curve(v))), "_lvl": C("_next")})
    ghs = F.transform("_y", lambda v: F.asinh(v * 2.0) / F.asinh(F.lit(2.0)))
    return d.select(key, F.posexplode(ghs).alias("node", "y")).withColumn("x", C("node") / float(nodes - 1))


# ---- measures reimplemented from moments ---------------------------------------------
def peak_catalog(grid: DataFrame, q: float = 0.90, k_sigma: float = 1.0, radius: int = 3, key: str = "image_id") -> DataFrame:
    """Local maxima above quantile and noise limits with flux, FWHM and axis ratio from second moments."""
    d = with_quantiles(grid, [key], [(C("l"), {"_q": q, "_med": 0.5})])
    d = with_quantiles(d, [key], [(F.abs(C("l") - C("_med")), {"_mad": 0.5})])
    wx = W.partitionBy(key, "y").orderBy("x").rangeBetween(-1, 1)
    wy = W.partitionBy(key, "x").orderBy("y").rangeBetween(-1, 1)
    d = d.withColumn("_h", F.max("l").over(wx)).withColumn("_top", F.max("_h").over(wy))
    is_peak = (C("l") >= C("_top")) & (C("l") >= C("_q")) & (C("l") >= C("_med") + F.lit(k_sigma * 1.4826) * C("_mad"))
    peaks = d.where(is_peak).select(key, (C("y") * 100000 + C("x")).alias("point_id"), "y", "x", C("l").alias("peak"))
    j = aperture_join(peaks, d.select(key, "y", "x", "l", "_med"), F.lit(float(radius)), radius, key)
    f = F.greatest(C("l") - C("_med"), F.lit(0.0))
    g = [key, "point_id"]
    dy, dx = C("y") - C("py"), C("x") - C("px")
    m = j.groupBy(*g).agg(F.sum(f).alias("flux"), F.sum(f * dx).alias("sx"), F.sum(f * dy).alias("sy"), F.sum(f * dx * dx).alias("xx"), F.sum(f * dy * dy).alias("yy"), F.sum(f * dx * dy).alias("xy"), F.count("*").alias("npix"))
    s = m.join(peaks, g)
    n = F.greatest("flux", F.lit(1e-12))
    s = s.withColumns({"cx": C("sx") / n, "cy": C("sy") / n})
    s = s.withColumns({"a_": C("xx") / n - C("cx") * C("cx"), "b_": C("yy") / n - C("cy") * C("cy"), "c_": C("xy") / n - C("cx") * C("cy")})
    root = F.sqrt((C("a_") - C("b_")) * (C("a_") - C("b_")) / 4.0 + C("c_") * C("c_"))
    big, small = (C("a_") + C("b_")) / 2.0 + root, F.greatest((C("a_") + C("b_")) / 2.0 - root, F.lit(1e-12))
    s = s.withColumns({"fwhm": F.lit(2.3548) * F.sqrt(F.greatest((C("a_") + C("b_")) / 2.0, F.lit(0.0))), "axis_ratio": F.sqrt(F.greatest(big, F.lit(1e-12)) / small)})
    why = F.when(C("npix") < 5, "edge").when(C("fwhm") < 0.5, "too_sharp").when(C("axis_ratio") > 3.0, "elongated").otherwise("accepted")
    w = W.partitionBy(key).orderBy(F.desc("flux"), "y", "x")
    return s.select(key, F.row_number().over(w).alias("star_no"), (C("x") + C("cx")).alias("x"), (C("y") + C("cy")).alias("y"), "peak", "flux", "fwhm", "axis_ratio", why.alias("reason"))


def galaxy_ellipse(grid: DataFrame, key: str = "image_id") -> DataFrame:
    """Elliptic disk and core weights from low-frequency moments of the light above the sky."""
    d = box_blur(grid, {"l": "_s"}, 2, [key])
    d = with_quantiles(d, [key], [(C("_s"), {"_sky": 0.5})])
    f = F.greatest(C("_s") - C("_sky"), F.lit(0.0))
    m = {"_f": F.sum(f), "_fx": F.sum(f * C("x")), "_fy": F.sum(f * C("y")), "_xx": F.sum(f * C("x") * C("x")), "_yy": F.sum(f * C("y") * C("y")), "_xy": F.sum(f * C("x") * C("y"))}
    d = with_stats(d, [key], m)
    n = F.greatest("_f", F.lit(1e-12))
    d = d.withColumns({"cx": C("_fx") / n, "cy": C("_fy") / n})
    d = d.withColumns({"a_": F.greatest(C("_xx") / n - C("cx") * C("cx"), F.lit(1e-6)), "b_": F.greatest(C("_yy") / n - C("cy") * C("cy"), F.lit(1e-6)), "c_": C("_xy") / n - C("cx") * C("cy")})
    det = F.greatest(C("a_") * C("b_") - C("c_") * C("c_"), F.lit(1e-9))
    dx, dy = C("x") - C("cx"), C("y") - C("cy")
    r = F.sqrt(F.greatest((C("b_") * dx * dx - F.lit(2.0) * C("c_") * dx * dy + C("a_") * dy * dy) / det, F.lit(0.0)))
    step = lambda a, b: F.lit(1.0) - clamp((r - a) / (b - a))
    return d.select(key, "y", "x", r.alias("radius"), step(1.5, 2.5).alias("disk"), step(0.4, 0.8).alias("core_weight"))


def bright_core_roi(pair: DataFrame, star: Column, q: float = 0.99, minimum: int = 2, grow: int = 1, key: str = "image_id") -> DataFrame:
    """Core region of a four-times blurred source outside grown star pixels, and overshoot inside it."""
    d = pair.withColumn("_st", star.cast("int"))
    cur = "l"
    for i in range(1, 5):
        d = box_blur(d, {cur: f"_f{i}"}, 1, [key])
        cur = f"_f{i}"
    d = morph(d, {"_st": "_ex"}, grow, True, [key])
    d = with_quantiles(d, [key], [(C(cur), {"_t": q})])
    roi = (C(cur) >= C("_t")) & (C("_ex") == 0)
    over = F.array(*[(C(f"{c}2") - C(c) > 0.01) for c in "rgb"])
    a = d.groupBy(key).agg(
        F.count_if(roi).alias("support"), F.count_if(roi & F.array_contains(over, True)).alias("_o"),
        (F.avg(F.when(roi, C("l2"))) / F.greatest(F.avg(F.when(roi, C("l"))), F.lit(1e-9))).alias("level_ratio"), F.count_if(roi & (C("l2") < C("l") * 0.5)).alias("holes"))
    share = C("_o") / F.greatest("support", F.lit(1))
    return a.select(key, "support", (C("support") >= minimum).alias("available"), share.alias("overshoot_share"), "level_ratio", "holes", ((C("support") >= minimum) & ((share > 0.35) | (C("holes") > 0))).alias("hard_failed"))


def adjustment_recipe(pix: DataFrame, steps: list, clip_limit: float, drift_limit: float, key: str = "image_id") -> DataFrame:
    """Masked adjustments folded into one candidate; an image keeps its input if a safety limit fails.

    ``steps`` are functions of a frame with r, g, b, l and masks that return such a frame.
    """
    src = pix.withColumns({f"{c}0": C(c) for c in "rgb"}).withColumn("l0", C("l"))
    out = src
    for s in steps:
        out = s(out).withColumn("l", px.luminance(C("r"), C("g"), C("b")))
    hi = lambda s: (F.greatest(f"r{s}", f"g{s}", f"b{s}") >= 1.0).cast("int")
    out = with_quantiles(out, [key], [(C("l0"), {"_m0": 0.5}), (C("l"), {"_m1": 0.5})])
    out = with_stats(out, [key], {"_c": F.avg(hi("") - hi("0"))})
    ok = (C("_c") <= clip_limit) & (F.abs(C("_m1") - C("_m0")) <= drift_limit)
    return out.select(key, "y", "x", *[F.when(ok, C(c)).otherwise(C(f"{c}0")).alias(c) for c in "rgb"], ok.alias("accepted"))


def opponent_slope(patches: DataFrame, pix: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Removes the R-G and B-G slopes that pass 3 sigma on the fit points and prove themselves on held-out ones.

    patches(key, point_id, split, py, px, rg, bg). Luminance stays as it is.
    """
    x, y = C("px") / float(side - 1) - 0.5, C("py") / float(side - 1) - 0.5
    parts = None
    for c in ("rg", "bg"):
        fit = plane_fit(patches.where(C("split") == "fit"), [key], x, y, C(c), f"{c}_")
        fit = fit.select(key, *[C(f"{c}_{n}") for n in ("level", "slope_x", "slope_y", "sigma")])
        held = patches.where(C("split") == "validation").join(fit, key)
        pred = C(f"{c}_slope_x") * x + C(f"{c}_slope_y") * y
        h = held.withColumns({"_p": pred, "_v": C(c)}).groupBy(key).agg(correlation(C("_p"), C("_v")).alias("_r"), F.stddev_pop("_v").alias("_s0"), F.stddev_pop(C("_v") - C("_p")).alias("_s1"))
        ok = (C(f"{c}_sigma") > 3.0) & (C("_r") >= 0.70) & (C("_s1") <= C("_s0") * 0.85)
        sel = fit.join(h, key, "left").select(key, *[F.when(F.coalesce(ok, F.lit(False)), C(f"{c}_{n}")).otherwise(F.lit(0.0)).alias(f"{c}_{n}") for n in ("slope_x", "slope_y")], F.coalesce(ok, F.lit(False)).alias(f"{c}_selected"))
        parts = sel if parts is None else parts.join(sel, key)
    d = pix.join(parts, key)
    gx, gy = C("x") / float(side - 1) - 0.5, C("y") / float(side - 1) - 0.5
    drg, dbg = C("rg_slope_x") * gx + C("rg_slope_y") * gy, C("bg_slope_x") * gx + C("bg_slope_y") * gy
    # with R = G + rg and B = G + bg the luminance is G + 0.2126 rg + 0.0722 bg
    dg = F.lit(0.2126) * drg + F.lit(0.0722) * dbg
    return d.select(key, "y", "x", (C("r") - drg + dg).alias("r"), (C("g") + dg).alias("g"), (C("b") - dbg + dg).alias("b"), "rg_selected", "bg_selected")


# ---- functions for SQL users -------------------------------------------------------------
def register_functions(spark: SparkSession) -> None:
    """SQL names: robust_sigma(x) for small groups and curve_segments(xs, ys) as a table function."""

    @F.pandas_udf("double")
    def robust_sigma_agg(v: pd.Series) -> float:
        x = v.dropna().to_numpy()
        return 0.0 if len(x) < 16 else float(1.4826 * np.median(np.abs(x - np.median(x))))

    @F.udtf(returnType="x0 double, y0 double, x1 double, y1 double")
    class CurveSegments:
        def eval(self, xs: list, ys: list):
            for i in range(len(xs) - 1):
                yield xs[i], ys[i], xs[i + 1], ys[i + 1]

    spark.udf.register("robust_sigma", robust_sigma_agg)
    spark.udtf.register("curve_segments", CurveSegments)
