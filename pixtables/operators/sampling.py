"""Safe background samples: quiet, dark, empty patches of an image, spread over its area.

Candidates stand on a grid; limits of brightness, texture and star excess are learned from the grid alone. Each candidate
may then walk to darker patches nearby under the same limits. The chosen ones keep a distance and cover sparse cells first.

Patches are read from tables of small blocks of pixels, so a round of the walk joins a few blocks for each position and
never the pixels one by one. All candidates of all images take a step of their walk at once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import saved
from .grid import box_blur, morph, step_back
from .quantiles import quantiles, with_quantiles

C = F.col
BLOCK = 32  # side of a block of pixels
LAYERS = ("covered", "compact", "extended", "core", "dark", "halo")

# fixed values: limits of the rule
ANALYSIS_SIDE, LEAST_PIXELS, LEAST_FIT = 512, 256, 64
USABLE_SKY, SOURCE_SHARE, QUADRANTS, CELLS, SPAN, DENSE_STARS = 0.50, 0.50, 3, 8, 0.55, 0.15
REASONS = ("shared_invalid_region", "shared_saturated", "shared_catalog_star", "exclusion_masked", "clipped_or_too_dark", "too_bright", "structured", "star_contaminated")

_TERMS = [(a, b) for n in range(3) for a, b in ((n - k, k) for k in range(n + 1))]
_SUMS = [(a, b) for n in range(5) for a, b in ((n - k, k) for k in range(n + 1))]


def _monomial(a: int, b: int) -> Column:
    out = F.lit(1.0)
    for name, n in (("nx", a), ("ny", b)):
        for _ in range(n):
            out = out * C(name)
    return out


def _solved(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Coefficients of a quadratic surface from the sums of its normal equations."""
    place = [[_SUMS.index((a + c, b + d)) for c, d in _TERMS] for a, b in _TERMS]
    for sums, right in it:
        yield pa.array([np.linalg.lstsq(np.array(s)[place], np.array(r), rcond=None)[0].tolist() for s, r in zip(sums.to_pylist(), right.to_pylist())], pa.list_(pa.float64()))


def surface(coef: str = "coef") -> Column:
    """Value at (nx, ny) of the surface that clipped_surface fitted; 0 where there was too little to fit."""
    return F.coalesce(sum((C(coef)[i] * _monomial(a, b) for i, (a, b) in enumerate(_TERMS)), F.lit(0.0)), F.lit(0.0))


def clipped_surface(rows: DataFrame, rounds: int, low: float, high: float, least: int, key: str = "image_id") -> DataFrame:
    """key, coef of a quadratic surface over rows (key, nx, ny, v, use, floor), fitted again without what lies outside.

    After each fit, the rows that may be used and lie from ``low`` robust deviations below the median residual to ``high``
    above it make the next one; a deviation is ``floor`` at least. Fewer than ``least`` rows leave the last fit as it is.
    One row for each image is written between the rounds.
    """
    state = None
    for i in range(rounds):
        d = rows.where("use")
        if state is not None:
            d = d.join(state, key).where((C("v") - surface()).between(C("_lo"), C("_hi"))).drop("coef", "_lo", "_hi")
        sums = d.groupBy(key).agg(
            F.count("*").alias("_n"), F.array(*[F.sum(_monomial(a, b)) for a, b in _SUMS]).alias("_s"), F.array(*[F.sum(C("v") * _monomial(a, b)) for a, b in _TERMS]).alias("_r"))
        fit = sums.where(C("_n") >= least).select(key, F.arrow_udf(_solved, "array<double>")("_s", "_r").alias("coef"))
        if i + 1 < rounds:
            r = d.join(fit, key).select(key, "floor", (C("v") - surface()).alias("_e"))
            r = with_quantiles(r, [key], [(C("_e"), {"_m": 0.5})])
            r = quantiles(r, [key], [(F.abs(C("_e") - C("_m")), {"_mad": 0.5}), (C("_m"), {"_c": 0.0}), (C("floor"), {"_f": 0.0})])
            sigma = F.greatest(1.4826 * C("_mad"), C("_f"))
            fit = fit.join(r.select(key, (C("_c") - low * sigma).alias("_lo"), (C("_c") + high * sigma).alias("_hi")), key)
        if state is not None:
            names = [c for c in fit.columns if c != key]
            old = state.select(key, *[C(c).alias(f"{c}_o") for c in names])
            fit = old.join(fit, key, "left").select(key, *[F.coalesce(c, f"{c}_o").alias(c) for c in names])
        state = saved(fit, "surface")
    return state.select(key, "coef")


def normalised(pix: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(pixels with l from 0 to 1 between the quantiles 0.005 and 0.995, one row of limits for each image).

    A pixel whose l is null or not finite is 0. Images with under 256 finite pixels or without range have no pixels in the
    first table; ``available`` tells them in the second.
    """
    l = F.when(F.abs("l") < float("inf"), C("l").cast("double"))  # noqa: E741
    q = quantiles(pix.select(key, "h", "w", l.alias("l")), [key], [(C("l"), {"_a": 0.005, "_b": 0.015, "_c": 0.90, "_d": 0.98, "_e": 0.995}), (C("h"), {"_h": 0.0}), (C("w"), {"_w": 0.0})])
    span = C("_e") - C("_a")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - C("_a")) / span))
    q = q.select(key, C("_h").cast("int").alias("h"), C("_w").cast("int").alias("w"), "_a", "_e", ((C("n__a") >= LEAST_PIXELS) & (span > 1e-12)).alias("_ok"),
                 *[F.when(span > 1e-12, unit(C(c))).alias(n) for c, n in (("_b", "low_limit"), ("_c", "bright_limit"), ("_d", "_top"))])
    limits = saved(q.select("*", F.coalesce("_ok", F.lit(False)).alias("available"), F.greatest(C("_top") - C("low_limit"), F.lit(1e-8)).alias("dynamic")).drop("_ok", "_top"), "limits")
    p = pix.join(limits.where("available").select(key, "_a", "_e"), key)
    return p.withColumn("l", F.coalesce(F.when(F.isnan(l), 0.0).otherwise(unit(l)), F.lit(0.0))).drop("_a", "_e"), limits.drop("_a", "_e")


def sky_masks(pix: DataFrame, key: str = "image_id") -> DataFrame:
    """key, my, mx, stride and the six LAYERS and ``source`` of an analysis grid of at most 512 x 512 pixels of an image.

    pix: dense (key, y, x, h, w, l) with l from normalised(). covered: a floor that at least 0.2% of the pixels repeat.
    compact: 4 deviations above its surroundings, grown by 1. extended, dark: coherent residuals above and below a quadratic
    sky, grown by 2 and 1. core: the very bright part of extended. halo: the weaker surroundings, grown by 3.
    """
    stride = F.greatest(F.lit(1), F.ceil(F.greatest("h", "w") / ANALYSIS_SIDE)).cast("int")
    b = pix.select(key, "y", "x", "h", "w", "l", stride.alias("stride")).where((C("y") % C("stride") == 0) & (C("x") % C("stride") == 0))
    b = b.select(key, "stride", *[F.floor(C(a) / C("stride")).cast("int").alias(a) for a in "yx"], *[F.ceil(C(a) / C("stride")).cast("int").alias(a) for a in "hw"], "l")
    q = quantiles(b, [key], [(C("l"), {"_lo": 0.005, "q995": 0.995, "_min": 0.0})]).where(C("n__lo") >= LEAST_PIXELS)
    b = b.join(q.select(key, "q995", "_min", F.greatest(C("q995") - C("_lo"), F.lit(1e-8)).alias("dynamic")), key)
    b = b.withColumn("_floor", C("l") - C("_min") <= F.greatest(C("dynamic") * 1e-7, F.lit(64 * 2.220446049250313e-16)))
    share = b.groupBy(key).agg((F.avg(C("_floor").cast("double")) >= 0.002).alias("_many"))
    at = lambda a, n: C(a) / F.greatest(C(n) - 1, F.lit(1))
    b = saved(b.join(share, key).select(key, "stride", "y", "x", "h", "w", "l", "q995", "dynamic", (C("_floor") & C("_many")).alias("covered"), at("x", "w").alias("nx"), at("y", "h").alias("ny")), "analysis")
    coef = clipped_surface(b.select(key, "nx", "ny", C("l").alias("v"), (~C("covered")).alias("use"), (C("dynamic") * 1e-4).alias("floor")), 5, 3.5, 1.6, LEAST_FIT, key)
    free = ~C("covered")
    d = b.join(coef, key, "left").withColumn("res", C("l") - surface()).drop("coef", "nx", "ny")

    def spread(d: DataFrame, value: str, name: str) -> DataFrame:
        d = with_quantiles(d, [key], [(F.when(free, C(value)), {f"{name}_c": 0.5})])
        d = with_quantiles(d, [key], [(F.when(free, F.abs(C(value) - C(f"{name}_c"))), {"_mad": 0.5})])
        return d.withColumn(f"{name}_s", F.greatest(1.4826 * C("_mad"), C("dynamic") * 1e-4)).drop("_mad", "n__mad", f"n_{name}_c")

    d = spread(d, "res", "r")
    above = lambda k: C("res") > C("r_c") + k * C("r_s")
    below = lambda k: C("res") < C("r_c") - k * C("r_s")
    d = d.withColumns({"_up": above(1.5).cast("double"), "_dn": below(1.5).cast("double")})
    d = box_blur(box_blur(d, {"_up": "_up1", "_dn": "_dn1", "l": "_l1"}, 1, [key]), {"_up1": "_up2", "_dn1": "_dn2", "_l1": "_l2"}, 1, [key])
    d = spread(d.withColumn("_hf", C("l") - C("_l2")), "_hf", "f")
    d = d.withColumns({
        "_compact": (C("_hf") > 4.0 * C("f_s")) & free, "_extended": (C("_up2") >= 0.70) & above(0.5) & free,
        "_dark": (C("_dn2") >= 0.70) & below(0.5) & free, "_halo": (C("_up2") >= 0.55) & above(0.35) & free})
    for name, n in (("compact", 1), ("extended", 2), ("dark", 1), ("halo", 3)):
        d = morph(d, {f"_{name}": name}, n, True, [key])
    d = d.withColumn("core", (above(5.0) | (C("l") >= C("q995"))) & free & C("extended"))
    return d.select(key, C("y").alias("my"), C("x").alias("mx"), "stride", *LAYERS, ((C("compact") | C("extended") | C("core")) & free).alias("source"))


def _blocks(pix: DataFrame, key: str) -> DataFrame:
    """key, by, bx, px: the pixels (y, x, l, steps to the left and upper pixel, flags) of squares of BLOCK pixels."""
    p = pix.withColumns({"sx": F.abs(C("l") - step_back(pix, "l", "x", [key])), "sy": F.abs(C("l") - step_back(pix, "l", "y", [key]))})
    px = F.collect_list(F.struct("y", "x", "l", "sx", "sy", "excluded", "valid", "saturated", "star"))
    return saved(p.groupBy(key, F.floor(C("y") / BLOCK).alias("by"), F.floor(C("x") / BLOCK).alias("bx")).agg(px.alias("px")), "blocks")


def _measured(at: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, cy, cx and the measures of the patch of r pixels around each position (key, cy, cx, r)."""
    reach = lambda a: F.sequence(F.floor((C(a) - C("r")) / BLOCK), F.floor((C(a) + C("r")) / BLOCK))
    a = at.select(key, "cy", "cx", "r", F.explode(reach("cy")).alias("by")).select("*", F.explode(reach("cx")).alias("bx"))
    inside = lambda p: (F.abs(p["y"] - C("cy")) <= C("r")) & (F.abs(p["x"] - C("cx")) <= C("r"))
    p = a.join(blocks, [key, "by", "bx"]).select(key, "cy", "cx", "r", F.explode(F.filter("px", inside)).alias("p")).select(key, "cy", "cx", "r", "p.*")
    share = lambda c: F.avg(C(c).cast("double")).alias(c)
    m = p.groupBy(key, "cy", "cx").agg(
        F.percentile("l", F.array(F.lit(0.5), F.lit(0.95))).alias("_q"), F.median(F.when(C("x") > C("cx") - C("r"), C("sx"))).alias("_gx"),
        F.median(F.when(C("y") > C("cy") - C("r"), C("sy"))).alias("_gy"), *[share(c) for c in ("excluded", "valid", "saturated", "star")])
    return m.select(key, "cy", "cx", C("_q")[0].alias("median"), ((C("_gx") + C("_gy")) * 0.5).alias("texture"), F.greatest(F.lit(0.0), C("_q")[1] - C("_q")[0]).alias("star_excess"), "excluded", "valid", "saturated", "star")


def _audited(m: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Measures with residual, the first reason against the patch (null: none) and its risk."""
    at = lambda a, n: C(a) / F.greatest(C(n) - 1, F.lit(1))
    d = m.join(limits.select(key, "h", "w", "coef", "low_limit", "bright_limit", "residual_low", "residual_high", "texture_limit", "star_limit"), key)
    d = d.withColumns({"nx": at("cx", "w"), "ny": at("cy", "h")}).withColumn("residual", C("median") - surface())
    res = C("residual")
    tests = (C("valid") < 0.999, C("saturated") > 0, C("star") > 0, C("excluded") > 0, C("median") <= C("low_limit"), (C("median") > C("bright_limit")) | (res > C("residual_high")))
    reason = F.lit(None).cast("string")
    for test, name in reversed([*zip(tests, REASONS), (res < C("residual_low"), REASONS[4]), (C("texture") > C("texture_limit"), REASONS[6]), (C("star_excess") > C("star_limit"), REASONS[7])]):
        reason = F.when(test, name).otherwise(reason)
    low = lambda c: F.greatest(c, F.lit(1e-8))
    risk = 0.45 * (res - C("residual_low")) / low(C("residual_high") - C("residual_low")) + 0.35 * C("texture") / low(C("texture_limit")) + 0.20 * C("star_excess") / low(C("star_limit"))
    return d.select(key, "cy", "cx", "median", "texture", "star_excess", "residual", reason.alias("reason"), risk.alias("risk"))


def _walked(grid: DataFrame, blocks: DataFrame, limits: DataFrame, steps: int, key: str) -> DataFrame:
    """The candidates that found a better patch: key, id of the seed and the patch where it ended.

    A candidate looks at its eight neighbours at a distance, goes to the least risk that is under its own (or any sound
    one, where it is not sound itself), and halves the distance where there is none.
    """
    size = limits.where("refine").select(key, "h", "w", "r", "margin", F.greatest("r", F.bround(F.least("h", "w") * 0.018, 0).cast("int")).alias("step"), F.greatest(F.lit(2), F.floor(C("r") / 2).cast("int")).alias("_least"))
    best = "struct<risk:double,y:int,x:int,median:double,texture:double,star_excess:double,residual:double>"
    own = F.when(C("reason").isNull(), C("risk"))
    state = saved(grid.join(size, key).select(key, "id", C("cy").alias("y"), C("cx").alias("x"), own.alias("risk"), "h", "w", "r", "margin", "step", "_least", F.lit(0).alias("used"), F.lit(None).cast(best).alias("at")), "walk")
    going = (C("step") >= C("_least")) & (C("used") < steps)
    while not state.where(going).isEmpty():
        turn = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
        ways = state.where(going).select("*", F.explode(turn).alias("d")).withColumns({"cy": C("y") + C("d.a") * C("step"), "cx": C("x") + C("d.b") * C("step")})
        ways = ways.where((C("cy") >= C("margin")) & (C("cx") >= C("margin")) & (C("cy") < C("h") - C("margin")) & (C("cx") < C("w") - C("margin"))).select(key, "id", "cy", "cx", "r")
        sound = _audited(_measured(ways.select(key, "cy", "cx", "r").distinct(), blocks, key), limits, key).where("reason is null")
        found = ways.join(sound, [key, "cy", "cx"]).groupBy(key, "id").agg(
            F.min(F.struct("risk", C("cy").alias("y"), C("cx").alias("x"), "median", "texture", "star_excess", "residual")).cast(best).alias("new"))
        moved = going & C("new").isNotNull() & (C("risk").isNull() | (C("new.risk") + 1e-12 < C("risk")))
        s = state.join(found, [key, "id"], "left").withColumn("_m", F.coalesce(moved, F.lit(False)))
        pick = lambda c: F.when(C("_m"), C(f"new.{c}")).otherwise(C(c)).alias(c)
        state = saved(s.select(
            key, "id", pick("y"), pick("x"), pick("risk"), "h", "w", "r", "margin", F.when(~C("_m") & going, F.floor(C("step") / 2).cast("int")).otherwise(C("step")).alias("step"), "_least",
            (C("used") + C("_m").cast("int")).alias("used"), F.when(C("_m"), C("new")).otherwise(C("at")).alias("at")), "walk")
    return state.where("used > 0").select(key, "id", "at.*").withColumnsRenamed({"y": "cy", "x": "cx"})


def _chosen(safe: DataFrame, target: int, keep_grid: bool, key: str) -> DataFrame:
    """key, id of the samples: one of each cell first, sparse cells before others, then the least risk; all at a distance.

    An image has as many candidates as its grid, twice at most, whatever its size; they are one sorted array.
    """
    w = W.partitionBy(key, "cell")
    grid_only = F.when(~C("refined"), True)
    d = safe.withColumns({"_c": F.count("*").over(w), "_b": F.min("risk").over(w), "_cg": F.count(grid_only).over(w), "_bg": F.min(F.when(grid_only, C("risk"))).over(w)})
    zero, flag = F.lit(0).cast("long"), C("refined").cast("long")
    row = lambda phase, n, b, e1, e2: F.struct(F.lit(phase).alias("phase"), n.alias("n"), b.alias("b"), (C("cell") if phase < 2 else F.lit(0)).alias("cell"), "risk", e1.alias("e1"), e2.alias("e2"), "cy", "cx", "id", "spacing")
    y, x = C("cy").cast("long"), C("cx").cast("long")
    rows = [row(1, C("_c"), C("_b"), y, x), row(2, zero, F.lit(0.0), flag, C("id"))]
    if keep_grid:
        rows.append(F.when(~C("refined"), row(0, C("_cg"), C("_bg"), y, x)))
    a = d.select(key, F.explode(F.array_compact(F.array(*rows))).alias("e")).groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("a"))
    none = F.struct(F.lit(None).cast("array<struct<cy:int,cx:int,id:bigint>>").alias("got"), F.lit(-1).alias("phase"), F.lit(-1).alias("cell"))
    none = none.withField("got", F.array().cast("array<struct<cy:int,cx:int,id:bigint>>"))

    def take(acc: Column, e: Column) -> Column:
        done = (e["phase"] < 2) & (acc["phase"] == e["phase"]) & (acc["cell"] == e["cell"])
        near = F.exists(acc["got"], lambda g: F.hypot((g["cy"] - e["cy"]).cast("double"), (g["cx"] - e["cx"]).cast("double")) < e["spacing"])
        more = F.struct(F.concat(acc["got"], F.array(F.struct(e["cy"].alias("cy"), e["cx"].alias("cx"), e["id"].alias("id")))).alias("got"), e["phase"].alias("phase"), e["cell"].alias("cell"))
        return F.when((F.size(acc["got"]) < target) & ~done & ~near, more).otherwise(acc)

    return a.select(key, F.explode(F.aggregate("a", none, take, lambda acc: acc["got"])).alias("g")).select(key, "g.id")


def safe_background_samples(pix: DataFrame, target: int = 40, least: int = 16, radius: int = 12, brightness: float = 0.70, texture: float = 0.55, refine: bool = True,
                            keep_grid: bool = False, steps: int = 8, halo: bool = False, least_radius: int = 4, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(samples, report) of dense images pix (key, y, x, h, w, l and, where known, booleans valid, saturated, star).

    samples: key, id, y, x (rows from the top), source, cell_y, cell_x, median, texture, star_excess, residual, risk; given
    for images that are not ready as well. report: one row for each image: status (ready, insufficient_safe_coverage,
    unavailable), counts of candidates, coverage, limits and reasons.

    ``halo`` also keeps away from outer halos. On images of over 512 pixels a side the masks are those of an analysis
    grid, each of whose pixels stands for a square. l null or not finite counts as 0; an empty table gives empty ones.
    """
    target = max(16, min(64, target))
    least, steps = max(12, min(target, least)), max(0, min(12, steps))
    brightness, texture = min(max(brightness, 0.50), 0.85), min(max(texture, 0.25), 0.75)
    known = {"valid": True, "saturated": False, "star": False}
    has_star = "star" in pix.columns
    p = pix.select(key, "y", "x", "h", "w", "l", *[F.coalesce(C(c), F.lit(v)).alias(c) if c in pix.columns else F.lit(v).alias(c) for c, v in known.items()])
    p, limits = normalised(p, key)
    p = saved(p, "pixels")
    short = F.least("h", "w")
    r = F.greatest(F.lit(least_radius), F.least(F.lit(radius), F.lit(24), F.greatest(F.lit(least_radius), F.floor(short / 12).cast("int"))))
    limits = limits.withColumn("r", r).withColumn("margin", F.greatest(C("r") + 2, F.bround(short * 0.04, 0).cast("int")))
    limits = limits.withColumn("available", C("available") & (short > C("margin") * 2 + 4))

    m = saved(sky_masks(p, key), "masks")
    layers = [c for c in LAYERS if halo or c != "halo"]
    mask = F.lit(False)
    for c in layers:
        mask = mask | C(c)
    stride = F.greatest(F.lit(1), F.ceil(F.greatest("h", "w") / ANALYSIS_SIDE)).cast("int")
    p = p.withColumns({"my": F.floor(C("y") / stride).cast("int"), "mx": F.floor(C("x") / stride).cast("int")})
    p = p.join(m.select(key, "my", "mx", "stride", "source", mask.alias("excluded")), [key, "my", "mx"])
    corner = (C("y") == C("my") * C("stride")) & (C("x") == C("mx") * C("stride"))
    part = lambda c: F.avg(F.when(corner, c.cast("double")))
    shares = p.groupBy(key).agg((1.0 - part(C("excluded") | C("star"))).alias("usable_sky"), part(C("source")).alias("source_share"), F.avg(C("star").cast("double")).alias("star_share"))
    blocks = _blocks(p.select(key, "y", "x", "l", "excluded", "valid", "saturated", "star"), key)
    limits = saved(limits.join(shares, key, "left").withColumn("available", C("available") & C("usable_sky").isNotNull()), "limits")

    budget = target * F.when(F.lit(has_star) & (C("star_share") >= DENSE_STARS), 6).otherwise(4)
    g = limits.where("available").withColumn("_cols", F.greatest(F.lit(8), F.bround(F.sqrt(budget * C("w") / C("h")), 0).cast("int")))
    g = g.withColumn("_rows", F.greatest(F.lit(6), F.ceil(budget / C("_cols")).cast("int")))
    spot = lambda i, n, a: F.bround(C("margin") + C(i) * ((C(a) - 2 * C("margin") - 1) / (C(n) - 1)), 0).cast("int")
    g = g.select(key, "h", "w", "r", "dynamic", "_cols", "_rows", "margin", F.explode(F.sequence(F.lit(0), C("_rows") - 1)).alias("_i")).select("*", F.explode(F.sequence(F.lit(0), C("_cols") - 1)).alias("_j"))
    g = g.select(key, "h", "w", "r", "dynamic", (C("_i") * C("_cols") + C("_j")).cast("long").alias("id"), spot("_i", "_rows", "h").alias("cy"), spot("_j", "_cols", "w").alias("cx"))
    grid = saved(g.join(_measured(g.select(key, "cy", "cx", "r").distinct(), blocks, key), [key, "cy", "cx"]), "grid")

    at = lambda a, n: C(a) / F.greatest(C(n) - 1, F.lit(1))
    flat = grid.select(key, at("cx", "w").alias("nx"), at("cy", "h").alias("ny"), C("median").alias("v"), F.lit(True).alias("use"), (C("dynamic") * 0.003).alias("floor"), "texture", "star_excess", "dynamic")
    coef = clipped_surface(flat, 3, 2.5, 1.5, 12, key)
    q = quantiles(flat.join(coef, key, "left").withColumn("_e", C("v") - surface()), [key], [(C("_e"), {"residual_low": 0.10, "residual_high": brightness}), (C("texture"), {"_t": texture}), (C("star_excess"), {"_s": 0.60})], whole=True)
    q = q.select(key, "residual_low", "residual_high", "_t", "_s", C("n_residual_low").alias("base_candidates"))
    limits = saved(limits.join(q, key, "left").join(coef, key, "left").withColumns({
        "texture_limit": F.greatest("_t", C("dynamic") * 1e-5), "star_limit": F.greatest("_s", C("dynamic") * 0.003),
        "refine": F.lit(refine and steps > 0) & C("available") & (C("usable_sky") >= USABLE_SKY) & (C("source_share") <= SOURCE_SHARE)}).drop("_t", "_s"), "limits")

    names = [key, "id", "cy", "cx", "median", "texture", "star_excess", "residual", "reason", "risk"]
    judged = saved(_audited(grid.select(key, "cy", "cx", "median", "texture", "star_excess", "excluded", "valid", "saturated", "star").distinct(), limits, key).join(grid.select(key, "id", "cy", "cx"), [key, "cy", "cx"]).select(names), "judged")
    new = _walked(judged, blocks, limits, steps, key).join(judged.select(key, "cy", "cx").distinct(), [key, "cy", "cx"], "left_anti")
    new = new.groupBy(key, "cy", "cx").agg(F.min(F.struct("id", "risk", "median", "texture", "star_excess", "residual")).alias("s")).select(key, "cy", "cx", "s.*").join(limits.select(key, "base_candidates"), key)
    new = new.withColumns({"id": C("id") + C("base_candidates"), "reason": F.lit(None).cast("string")}).select(names)
    both = saved(judged.withColumn("refined", F.lit(False)).unionByName(new.withColumn("refined", F.lit(True))), "candidates")

    spacing = F.greatest(C("r") * 2, F.bround(short * 0.035, 0).cast("int"))
    cell = lambda a, n: F.least(F.lit(3), F.floor(C(a) * 4 / C(n)).cast("int"))
    safe = both.where("reason is null").join(limits.select(key, "h", "w", spacing.alias("spacing")), key).withColumns({"cell_y": cell("cy", "h"), "cell_x": cell("cx", "w")}).withColumn("cell", C("cell_y") * 4 + C("cell_x"))
    samples = saved(safe.join(_chosen(safe, target, keep_grid, key), [key, "id"]), "samples")

    counts = both.groupBy(key).agg(F.count("*").alias("candidates"), F.count_if(C("reason").isNull()).alias("safe_candidates"), F.count_if(C("refined")).alias("refined_candidates"), *[F.count_if(C("reason") == n).alias(n) for n in REASONS])
    span = lambda a, n: ((F.max(a) - F.min(a)) / F.greatest(F.max(n) - 1, F.lit(1)))
    quadrant = (C("cy") >= C("h") / 2).cast("int") * 2 + (C("cx") >= C("w") / 2).cast("int")
    cover = samples.groupBy(key).agg(F.count("*").alias("selected"), F.count_if(C("refined")).alias("selected_refined"), F.countDistinct(quadrant).alias("quadrants"), F.countDistinct("cell").alias("cells"), span("cx", "w").alias("x_span"), span("cy", "h").alias("y_span"))
    rep = limits.join(counts, key, "left").join(cover, key, "left")
    zero = ["base_candidates", "candidates", "safe_candidates", "refined_candidates", "selected", "selected_refined", "quadrants", "cells", *REASONS]
    rep = rep.withColumns({**{c: F.coalesce(C(c), F.lit(0)).cast("long") for c in zero}, **{c: F.coalesce(c, F.lit(0.0)) for c in ("x_span", "y_span")}})
    ready = (C("selected") >= least) & (C("usable_sky") >= USABLE_SKY) & (C("quadrants") >= QUADRANTS) & (C("cells") >= CELLS) & (C("x_span") >= SPAN) & (C("y_span") >= SPAN)
    status = F.when(~C("available") | (C("candidates") == 0), "unavailable").when(ready, "ready").otherwise("insufficient_safe_coverage")
    report = rep.select(key, status.alias("status"), F.coalesce("refine", F.lit(False)).alias("refined"), "r", "margin", *zero, "x_span", "y_span", "usable_sky", "source_share", "star_share",
                        "low_limit", "bright_limit", "residual_low", "residual_high", "texture_limit", "star_limit")
    source = F.when(C("refined"), "dark_patch_refinement").otherwise("regular_grid")
    return samples.select(key, "id", C("cy").alias("y"), C("cx").alias("x"), source.alias("source"), "cell_y", "cell_x", "median", "texture", "star_excess", "residual", "risk"), report
