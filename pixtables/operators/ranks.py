"""Choosing among candidates: Pareto order, lexicographic keys, ladders, profiles of lines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quantiles import quantiles

C = F.col

PARETO = ("soft_warnings", "span_sigma", "flux_deviation", "morphology_loss", "centroid_shift", "structure_sigma", "pattern_penalty")


def pareto_dense_rank(cands: DataFrame, key: Sequence[str], criteria: Sequence[str] = PARETO, chain: str = "chain_index") -> DataFrame:
    """Hard-rejected dropped, best tier kept, dense ranks summed, front first among equals.

    All candidates of a subject count, repeated chain entries too. Who is dominated is found by an
    anti join of the distinct rank vectors within a subject: nothing is gathered, no pair is returned.
    """
    key = list(key)
    ok = cands.where(~C("hard_rejected"))
    tier = W.partitionBy(*key)
    ok = ok.withColumn("_best", F.min("tier").over(tier)).where(C("tier") == C("_best"))
    for c in criteria:
        ok = ok.withColumn(f"_r_{c}", F.dense_rank().over(W.partitionBy(*key).orderBy(c)) - 1)
    ok = ok.withColumn("rank_sum", sum((C(f"_r_{c}") for c in criteria), F.lit(0)))
    ranks = [f"_r_{c}" for c in criteria]
    mine = ok.select(*key, *ranks).distinct()
    other = mine.select(*[C(k).alias(f"_k_{k}") for k in key], *[C(r).alias(f"_o{r}") for r in ranks])
    same = _all(*[C(k).eqNullSafe(C(f"_k_{k}")) for k in key])
    better = _all(*[C(f"_o{r}") <= C(r) for r in ranks]) & _any(*[C(f"_o{r}") < C(r) for r in ranks])
    front = mine.join(other, same & better, "left_anti").withColumn("pareto_front", F.lit(True))
    # rank vectors have no nulls; a key may
    front = front.select(*[C(k).alias(f"_k_{k}") for k in key], *[C(r).alias(f"_o{r}") for r in ranks], "pareto_front")
    ok = ok.join(front, same & _all(*[C(f"_o{r}") == C(r) for r in ranks]), "left").withColumn("pareto_front", F.coalesce("pareto_front", F.lit(False)))
    order = W.partitionBy(*key).orderBy("rank_sum", C("pareto_front").cast("int").desc(), "span_sigma", "score", chain, "label")
    return ok.withColumn("position", F.row_number().over(order)).select(*key, chain, "label", "tier", "rank_sum", "pareto_front", "position")


def _all(*cols: Column) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out


def _any(*cols: Column) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[tuple[str, bool]], value: Sequence[str]) -> DataFrame:
    """First row per key by a lexicographic order, as an aggregate with map-side combine.

    ``order`` lists (numeric column, descending); the last entry may be text, ascending.
    """
    parts = [(-C(c) if desc else C(c)).alias(f"_o{i}") for i, (c, desc) in enumerate(order)]
    best = F.min(F.struct(*parts, F.struct(*[C(v) for v in value]).alias("v")))
    return df.groupBy(*key).agg(best.alias("b")).select(*key, "b.v.*")


def presentation_score(safety_terms: Sequence[tuple[str, float, float]], presentation: str = "presentation") -> Column:
    """0.70 presentation + 0.30 mean safety; a term is 1 at its ideal and 0 at its hard limit."""
    terms = []
    for m, ideal, hard in safety_terms:
        t = F.least(F.greatest((C(m) - ideal) / (hard - ideal), F.lit(0.0)), F.lit(1.0))
        terms.append(F.when(C(m).isNull(), F.lit(0.50)).otherwise(F.lit(1.0) - t))
    return F.lit(0.70) * C(presentation) + F.lit(0.30) * (sum(terms[1:], terms[0]) / float(len(terms)))


def sufficiency(cands: DataFrame, key: Sequence[str], chain: str = "chain_index") -> DataFrame:
    """Attempts up to and including the first sufficient one of each chain.

    The stopping position is one aggregate per chain, joined back.
    """
    stop = cands.groupBy(*key).agg(F.min(F.when(C("sufficient"), C(chain))).alias("stop_at"))
    out = cands.join(stop, list(key))
    return out.where(C("stop_at").isNull() | (C(chain) <= C("stop_at")))


def rolling_profile(grid: DataFrame, axis: str, half: int = 2, key: str = "image_id") -> DataFrame:
    """Per-line black share, level and cast with rolling medians (end lines repeated) and bad-line votes.

    Lines of an image are bounded by its side. Expects ``l``, ``r``, ``g``, ``b``.
    """
    excess = F.greatest(C("b") - F.greatest("r", "g"), C("r") - F.greatest("g", "b"), F.lit(0.0))
    cast = (F.abs(C("r") - C("l")) + F.abs(C("g") - C("l")) + F.abs(C("b") - C("l"))) / 3.0 + F.lit(0.65) * excess
    q = quantiles(grid, [key, axis], [(C("l"), {"level": 0.5}), (cast, {"cast": 0.5})])
    black = grid.groupBy(key, axis).agg(F.avg((C("l") <= 0.25).cast("double")).alias("black"))
    lines = q.join(black, [key, axis]).select(key, C(axis).alias("line"), "level", "cast", "black")
    ends = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.last("line").over(ends)
    lines = lines.withColumn("_last", last)
    copies = F.array_compact(F.array(
        C("line"), *[F.when(C("line") == 0, F.lit(-k)) for k in range(1, half + 1)], *[F.when(C("line") == C("_last"), C("_last") + k) for k in range(1, half + 1)]))
    wide = lines.withColumn("_p", F.explode(copies))
    w = W.partitionBy(key).orderBy("_p").rowsBetween(-half, half)
    wide = wide.withColumns({"level_roll": F.percentile("level", F.lit(0.5)).over(w), "cast_roll": F.percentile("cast", F.lit(0.5)).over(w)})
    out = wide.where((C("_p") >= 0) & (C("_p") <= C("_last")))
    soft = (C("level") < C("level_roll") * 0.9).cast("int") + (F.abs(C("cast") - C("cast_roll")) > 0.05).cast("int") + (C("black") > 0.15).cast("int")
    bad = (C("black") > 0.5) | (soft >= 2)
    return out.select(key, "line", "level", "cast", "black", "level_roll", "cast_roll", bad.alias("bad"))


def stable_start(profile: DataFrame, run: int, key: str = "image_id") -> DataFrame:
    """First line from which ``run`` lines in a row are good; trim of that edge."""
    w = W.partitionBy(key).orderBy("line").rowsBetween(0, run - 1)
    p = profile.withColumns({"_bad": F.sum(C("bad").cast("int")).over(w), "_n": F.count("*").over(w)})
    good = (C("_bad") == 0) & (C("_n") == run)
    trim = F.coalesce(F.min(F.when(good, C("line"))), F.max(F.when(C("bad"), C("line"))) + 1, F.lit(0))
    return p.groupBy(key).agg(trim.alias("trim"), F.count_if("bad").alias("bad_lines"))


def largest_rectangle(mask: DataFrame, key: str = "image_id") -> DataFrame:
    """Largest all-valid rectangle of a coverage grid (at most 64 x 64), ties by the lowest rectangle.

    Run heights come from a window down each column. For every column the heights of a
    row extend left and right to the first smaller one; a rectangle is limited by its
    lowest column, so each cell yields exactly one candidate.
    """
    col = W.partitionBy(key, "x").orderBy("y")
    m = mask.withColumn("_brk", F.max(F.when(~C("valid"), C("y"))).over(col.rowsBetween(W.unboundedPreceding, 0)))
    m = m.withColumn("h", C("y") - F.coalesce("_brk", F.lit(-1)))
    row = W.partitionBy(key, "y").orderBy("x")
    m = m.withColumns({
        "_hs": F.collect_list(F.struct("x", "h")).over(row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    left = F.aggregate("_hs", F.lit(-1), lambda a, s: F.when((s["x"] < C("x")) & (s["h"] < C("h")), F.greatest(a, s["x"])).otherwise(a))
    width = F.aggregate("_hs", F.lit(-1), lambda a, s: F.greatest(a, s["x"]))
    right = F.aggregate("_hs", width + 1, lambda a, s: F.when((s["x"] > C("x")) & (s["h"] < C("h")), F.least(a, s["x"])).otherwise(a))
    c = m.where(C("h") > 0).select(key, "y", "h", left.alias("_l"), right.alias("_r"))
    c = c.select(key, (C("_l") + 1).alias("x0"), (C("y") - C("h") + 1).alias("y0"), (C("_r") - C("_l") - 1).alias("width"), C("h").alias("height"))
    best = F.max(F.struct((C("width") * C("height")).alias("area"), (-C("x0")).alias("nx"), (-C("y0")).alias("ny"), (-C("width")).alias("nw"), "height"))
    return c.groupBy(key).agg(best.alias("b")).select(key, "b.area", (-C("b.ny")).alias("y0"), (-C("b.nx")).alias("x0"), (-C("b.nw")).alias("width"), "b.height")
