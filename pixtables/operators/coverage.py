"""Field rotation: wedges of low coverage at the border of an image, and the rectangle inside them.

Images that were turned while they were stacked have fewer frames in their outer wedges, which shows as more
noise and more colour noise there. Tiles that show both and are reached from the border are such a wedge;
a crop is proposed only when wedges lie in three corners and on three sides.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import saved
from .components import connected_components
from .quantiles import quantiles, with_quantiles
from .ranks import largest_rectangle

C = F.col


def tile_sizes(pix: DataFrame, tile: int | None = None, key: str = "image_id") -> DataFrame:
    """key, h, w, rows, columns: images cut into tiles of about a 36th of their short side, of equal width up to the last pixel."""
    s = pix.groupBy(key).agg((F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
    short = F.least("h", "w")
    size = F.lit(tile) if tile else F.greatest(F.lit(8), F.floor(F.greatest(F.lit(24), F.bround(short / 36.0, 0)) / 4) * 4)
    return s.select(key, "h", "w", *[F.bround(C(a) / size, 0).cast("int").alias(n) for a, n in (("h", "rows"), ("w", "columns"))])


def coverage_tiles(pix: DataFrame, noise_ratio: float = 1.35, chroma_ratio: float = 1.20, tile: int | None = None, least_side: int = 192, least_tiles: int = 12, least_differences: int = 64, key: str = "image_id") -> DataFrame:
    """One row per tile of dense images (y, x, r, g, b, l): ratios to the central tiles, hard, grow, connected, and the image's sizes.

    ``connected`` tiles show both kinds of noise and are joined side by side with a hard tile at the border. Where the
    image is too small or its centre holds no noise, ratios are null and nothing is connected.
    """
    noise_ratio, chroma_ratio = min(max(noise_ratio, 1.15), 3.0), min(max(chroma_ratio, 1.10), 3.0)
    g = [key, "ty", "tx"]
    size = ["h", "w", "rows", "columns"]
    d = pix.select(key, "y", "x", "r", "g", "b", "l").join(tile_sizes(pix, tile, key), key)
    at = lambda a, n, m: (((C(a) + 1) * C(n) - 1) / C(m)).cast("int")  # noqa: E731  edges are the whole parts of equal steps
    d = d.withColumns({"ty": at("y", "rows", "h"), "tx": at("x", "columns", "w")})

    def step(line: str, axis: str, t: str) -> Column:
        w = W.partitionBy(key, line).orderBy(axis)
        near = (F.lead(axis).over(w) == C(axis) + 1) & (F.lead(t).over(w) == C(t))
        return F.when(near, F.lead("l").over(w) - C("l"))

    d = d.withColumns({"_across": step("y", "x", "tx"), "_down": step("x", "y", "ty")})
    steps = d.select(*g, F.explode(F.array("_across", "_down")).alias("v")).where(C("v").isNotNull())
    steps = with_quantiles(steps, g, [(C("v"), {"_m": 0.5})], whole=True)
    noise = quantiles(steps, g, [(F.abs(C("v") - C("_m")), {"mad": 0.5})], whole=True)
    colour = F.sqrt((C("r") - C("g")) * (C("r") - C("g")) + (C("b") - C("g")) * (C("b") - C("g")))
    t = quantiles(d.select(*g, colour.alias("_c")), g, [(C("_c"), {"chroma": 0.5})], whole=True).select(*g, "chroma").join(noise.select(*g, "mad", "n_mad"), g, "left")
    sigma = F.when(C("n_mad") >= least_differences, C("mad") / (0.6745 * 2.0**0.5)).otherwise(F.lit(0.0))
    t = t.select(*g, sigma.alias("noise"), "chroma").join(tile_sizes(pix, tile, key), key)
    central = lambda a, n: (C(a) >= F.greatest(F.lit(2), F.floor(C(n) / 4))) & (C(a) < C(n) - F.greatest(F.lit(2), F.floor(C(n) / 4)))
    inner = central("ty", "rows") & central("tx", "columns")
    t = with_quantiles(t, [key], [(F.when(inner, C("noise")), {"_rn": 0.5}), (F.when(inner, C("chroma")), {"_rc": 0.5})], whole=True)
    fit = F.when(F.least("h", "w") < least_side, "image_too_small_for_coverage_grid").when(F.least("rows", "columns") < least_tiles, "coverage_grid_too_small").when(~((C("_rn") > 1e-8) & (C("_rc") > 1e-8)), "coverage_reference_unavailable")
    t = t.withColumn("refused", F.coalesce(fit, F.when(C("_rn").isNull() | C("_rc").isNull(), "coverage_reference_unavailable")))
    t = t.withColumns({"noise_ratio": F.when(C("refused").isNull(), C("noise") / C("_rn")), "chroma_ratio": F.when(C("refused").isNull(), C("chroma") / C("_rc"))})
    both = lambda n, c: F.coalesce((C("noise_ratio") >= n) & (C("chroma_ratio") >= c), F.lit(False))
    t = t.withColumns({"hard": both(noise_ratio, chroma_ratio), "grow": both(1.0 + (noise_ratio - 1.0) * 0.34, 1.0 + (chroma_ratio - 1.0) * 0.40)})
    t = saved(t.select(*g, *size, "refused", "noise_ratio", "chroma_ratio", "hard", "grow"), "coverage")  # pixels are read once
    grid = t.where("grow").select(key, C("ty").alias("y"), C("tx").alias("x"), "rows", "columns", "hard")
    seed = C("hard") & ((C("y") == 0) | (C("x") == 0) | (C("y") == C("rows") - 1) | (C("x") == C("columns") - 1))
    parts = connected_components(grid, [key], F.lit(True), C("columns"), {"_seed": seed}, corners=False)
    reached = parts.where("_seed").select(key, "label").distinct()
    joined = parts.join(reached, [key, "label"], "left_semi").select(key, C("y").alias("ty"), C("x").alias("tx"), F.lit(True).alias("connected"))
    return t.join(joined, g, "left").withColumn("connected", F.coalesce("connected", F.lit(False)))


def rotation_crop(tiles: DataFrame, key: str = "image_id") -> DataFrame:
    """The crop of each image of ``coverage_tiles``, or why there is none: key, reason, accepted, x, y, width, height, kept and evidence."""
    top, left = C("ty") == 0, C("tx") == 0
    bottom, right = C("ty") == C("rows") - 1, C("tx") == C("columns") - 1
    # the rows and columns of the border are measured one after another, so a corner counts twice
    times = (top | bottom).cast("int") + (left | right).cast("int")
    border = tiles.where(times > 0).select(key, "noise_ratio", "chroma_ratio", F.explode(F.sequence(F.lit(1), times)))
    edge = quantiles(border, [key], [(C("noise_ratio"), {"noise_p90": 0.9}), (C("chroma_ratio"), {"chroma_p90": 0.9})], whole=True).select(key, "noise_p90", "chroma_p90")
    cr, cc = F.greatest(F.lit(2), F.floor(C("rows") / 8)), F.greatest(F.lit(2), F.floor(C("columns") / 8))
    near = (C("ty") < cr, C("ty") >= C("rows") - cr, C("tx") < cc, C("tx") >= C("columns") - cc)
    hit = lambda c: F.max((C("connected") & c).cast("int"))
    corners = hit(near[0] & near[2]) + hit(near[0] & near[3]) + hit(near[1] & near[2]) + hit(near[1] & near[3])
    sides = hit(top) + hit(bottom) + hit(left) + hit(right)
    s = tiles.groupBy(key).agg(
        F.first("refused").alias("refused"), *[F.first(c).alias(c) for c in ("h", "w", "rows", "columns")],
        F.count_if("hard").alias("hard_tiles"), F.count_if("connected").alias("connected_tiles"), corners.alias("corners"), sides.alias("sides"))
    free = largest_rectangle(tiles.select(key, C("ty").alias("y"), C("tx").alias("x"), (~C("connected")).alias("valid")), key)
    s = s.join(edge, key, "left").join(free.select(key, C("x0").alias("_tx"), C("y0").alias("_ty"), C("width").alias("_tw"), C("height").alias("_th")), key, "left")
    cut = lambda k, n, m: F.floor(k * C(m) / C(n)).cast("int")
    even = lambda lo, hi: (lo + lo % 2, hi - (hi - lo - lo % 2) % 2)  # noqa: E731  even corners and sizes keep the colour pattern
    x0, x1 = even(cut(C("_tx"), "columns", "w"), cut(C("_tx") + C("_tw"), "columns", "w"))
    y0, y1 = even(cut(C("_ty"), "rows", "h"), cut(C("_ty") + C("_th"), "rows", "h"))
    few = C("connected_tiles") < F.greatest(F.lit(4), F.ceil(C("rows") * C("columns") * 0.01))
    reason = F.coalesce(
        C("refused"), F.when(few, "no_significant_edge_connected_coverage_anomaly"), F.when((C("corners") < 3) | (C("sides") < 3), "edge_connected_anomaly_lacks_corner_wedge_geometry"),
        F.when(C("_tw").isNull(), "no_coverage_interior_rectangle"), F.when((x1 <= x0) | (y1 <= y0), "invalid_coverage_rectangle"), F.lit("edge_connected_field_rotation_confirmed"))
    s = s.withColumn("reason", reason).withColumn("accepted", C("reason") == "edge_connected_field_rotation_confirmed")
    rect = {n: F.when(C("accepted"), c) for n, c in (("x", x0), ("y", y0), ("width", x1 - x0), ("height", y1 - y0), ("kept", (x1 - x0) * (y1 - y0) / (C("w") * C("h"))))}
    return s.select(key, "reason", "accepted", *[c.alias(n) for n, c in rect.items()], "hard_tiles", "connected_tiles", "corners", "sides", "noise_p90", "chroma_p90")
