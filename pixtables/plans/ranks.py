"""Queries over candidate choice and line profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks as op
from ..sources import fixtures as fx
from .colour import rsel
from .noise import rounded
from .registry import cl, lum3, query, r6, with_views

C = F.col


def candidates(spark, d):
    """Four chain entries per image with measured criteria."""
    c = fx.cand(spark, d).withColumn("l", F.lit(0.2126) * C("r") + F.lit(0.7152) * C("g") + F.lit(0.0722) * C("b"))
    i, k = C("image_id"), C("k")
    m = c.groupBy("image_id", "k").agg(F.max("r").alias("mr"), F.min("l").alias("ml"), F.max("b").alias("mb"), F.max("g").alias("mg"))
    return m.select(
        "image_id", (k - 1).alias("chain_index"), F.concat(F.lit("c"), k.cast("string")).alias("label"), ((i + k) % 7 == 0).alias("hard_rejected"),
        ((i * k) % 3 == 1).cast("int").alias("tier"), ((i + k) % 3).alias("soft_warnings"), C("ml").alias("span_sigma"), F.abs(C("mr") - 1).alias("flux_deviation"),
        (F.lit(1.0) - C("mg")).alias("morphology_loss"), ((i + 2 * k) % 4 / 10.0).alias("centroid_shift"), C("mb").alias("structure_sigma"),
        ((i * k) % 5 / 4.0).alias("pattern_penalty"), C("mg").alias("score"), ((i + k) % 5 == 0).alias("sufficient"))


_CAND = """SELECT image_id, k-1 AS chain_index, concat('c',k) AS label, (image_id+k)%7=0 AS hard_rejected, CAST((image_id*k)%3=1 AS INT) AS tier, (image_id+k)%3 AS soft_warnings, ml AS span_sigma, abs(mr-1) AS flux_deviation,
 1e0-mg AS morphology_loss, (image_id+2*k)%4/10e0 AS centroid_shift, mb AS structure_sigma, (image_id*k)%5/4e0 AS pattern_penalty, mg AS score, (image_id+k)%5=0 AS sufficient
 FROM (SELECT image_id, k, max(r) mr, min({l}) ml, max(b) mb, max(g) mg FROM cand GROUP BY image_id, k)""".format(l=lum3())
_CR = op.PARETO


@query("pareto_dense_rank", with_views("cand", f"""SELECT image_id, chain_index, label, tier, rank_sum, pf AS pareto_front, CAST(row_number() OVER (PARTITION BY image_id ORDER BY rank_sum, pf DESC, span_sigma, score, chain_index) AS INT) AS position FROM (
  SELECT *, CAST({'+'.join(f'dense_rank() OVER (PARTITION BY image_id ORDER BY {c})-1' for c in _CR)} AS INT) AS rank_sum, NOT EXISTS (SELECT 1 FROM el o WHERE o.image_id=el.image_id AND {' AND '.join(f'o.{c}<=el.{c}' for c in _CR)} AND ({' OR '.join(f'o.{c}<el.{c}' for c in _CR)})) AS pf FROM el)""",
  ca=_CAND, el="SELECT * FROM ca WHERE NOT hard_rejected AND tier=(SELECT min(tier) FROM ca b WHERE b.image_id=ca.image_id AND NOT b.hard_rejected)"))
def pareto_dense_rank(spark, d):
    return op.pareto_dense_rank(candidates(spark, d), ["image_id"])


@query("candidate_sufficiency", with_views("cand", "SELECT image_id, chain_index, label, stop_at FROM (SELECT *, min(chain_index) FILTER (sufficient) OVER (PARTITION BY image_id) AS stop_at FROM ca) WHERE stop_at IS NULL OR chain_index<=stop_at", ca=_CAND))
def candidate_sufficiency(spark, d):
    return op.sufficiency(candidates(spark, d), ["image_id"]).select("image_id", "chain_index", "label", "stop_at")


_T = [("span_sigma", 0.1, 0.6), ("structure_sigma", 0.2, 1.0)]


@query("stretch_candidate_rank", with_views("cand", f"""SELECT image_id, label, {r6('sc')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CAST(hard_rejected AS INT), tier, -rs, -(image_id+chain_index)%4, label) rn FROM
  (SELECT *, {r6('sc')} AS rs FROM (SELECT *, 0.7e0*(1e0-morphology_loss)+0.3e0*((1e0-{cl('(span_sigma-0.1e0)/(0.6e0-0.1e0)')}+1e0-{cl('(structure_sigma-0.2e0)/(1e0-0.2e0)')})/2e0) AS sc FROM ca))) WHERE rn=1""", ca=_CAND))
def stretch_candidate_rank(spark, d):
    c = candidates(spark, d).withColumn("presentation", F.lit(1.0) - C("morphology_loss"))
    c = c.withColumn("sc", op.presentation_score(_T))
    c = rounded(c, "sc").withColumns({"status": C("hard_rejected").cast("int"), "goals": -((-(C("image_id") + C("chain_index"))) % 4), "name": C("label")})
    return op.first_by(c, ["image_id"], [("status", False), ("tier", False), ("sc", True), ("goals", True), ("chain_index", False)], ["label", "sc"]).withColumnRenamed("sc", "score")


@query("forced_candidate_rank", with_views("cand", f"""SELECT image_id, label, {r6('sev')} AS severity, failed FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tier, failed, {r6('sev')}, chain_index) rn FROM (SELECT *, CAST(span_sigma>0.3 AS INT)+CAST(structure_sigma>0.8 AS INT) AS failed,
  greatest(span_sigma/0.3e0-1e0,0e0)+greatest(structure_sigma/0.8e0-1e0,0e0) AS sev FROM ca)) WHERE rn=1""", ca=_CAND))
def forced_candidate_rank(spark, d):
    ex = lambda m, lim: F.greatest(C(m) / lim - 1.0, F.lit(0.0))
    c = candidates(spark, d).withColumns({
        "failed": (C("span_sigma") > 0.3).cast("int") + (C("structure_sigma") > 0.8).cast("int"), "severity": ex("span_sigma", 0.3) + ex("structure_sigma", 0.8)})
    c = rounded(c, "severity")
    return op.first_by(c, ["image_id"], [("tier", False), ("failed", False), ("severity", False), ("chain_index", False)], ["label", "severity", "failed"])


@query("weakest_passing_strength", with_views("cand", "SELECT image_id, min(st) FILTER (NOT hard_rejected AND morphology_loss<=0.25e0) AS strength, count(*) AS tried FROM (SELECT *, [0.60e0,0.72e0,0.84e0,0.96e0][chain_index+1] AS st FROM ca) GROUP BY image_id", ca=_CAND))
def weakest_passing_strength(spark, d):
    st = F.array(F.lit(0.60), F.lit(0.72), F.lit(0.84), F.lit(0.96))[C("chain_index")]
    c = candidates(spark, d).withColumn("st", st)
    ok = ~C("hard_rejected") & (C("morphology_loss") <= 0.25)
    return c.groupBy("image_id").agg(F.min(F.when(ok, C("st"))).alias("strength"), F.count("*").alias("tried"))


_EX = "(abs(r-l)+abs(g-l)+abs(b-l))/3e0+0.65e0*greatest(b-greatest(r,g),r-greatest(g,b),0e0)"
_PROF = {
    "ln": f"SELECT image_id, y AS line, median(l) AS level, median({_EX}) AS cst, avg(CASE WHEN l<=0.25 THEN 1e0 ELSE 0e0 END) AS black FROM dlum GROUP BY image_id, y",
    "rl": "SELECT a.image_id, a.line, median(b.level) AS lr, median(b.cst) AS cr FROM (SELECT image_id, line, least(greatest(line+o,0),15) AS src FROM ln, (VALUES (-2),(-1),(0),(1),(2)) t(o)) a JOIN ln b ON b.image_id=a.image_id AND b.line=a.src GROUP BY a.image_id, a.line",
    "pf": "SELECT ln.*, lr, cr, black>0.5 OR CAST(level<lr*0.9e0 AS INT)+CAST(abs(cst-cr)>0.05e0 AS INT)+CAST(black>0.15 AS INT)>=2 AS bad FROM ln JOIN rl USING (image_id, line)",
}


@query("rolling_median_profile", with_views("dlum", f"SELECT image_id, line, {rsel('level cst black lr cr','level cast black level_roll cast_roll')}, bad FROM pf", **_PROF))
def rolling_median_profile(spark, d):
    return rounded(op.rolling_profile(fx.dlum(spark, d), "y"), "level", "cast", "black", "level_roll", "cast_roll")


@query("edge_trim", with_views("dlum", "SELECT image_id, CAST(coalesce((SELECT min(s) FROM range(0,14) t(s) WHERE NOT EXISTS (SELECT 1 FROM pf q WHERE q.image_id=i.image_id AND q.bad AND q.line BETWEEN s AND s+2)), mb+1, 0) AS INT) AS trim, nb AS bad_lines FROM (SELECT image_id, max(line) FILTER (bad) mb, count(*) FILTER (bad) nb FROM pf GROUP BY image_id) i", **_PROF))
def edge_trim(spark, d):
    return op.stable_start(op.rolling_profile(fx.dlum(spark, d), "y"), 3)


@query("largest_rectangle", with_views("dlum", """SELECT image_id, area, y0, x0, width, height FROM (SELECT r.image_id, CAST((y1-y0+1)*(x1-x0+1) AS INT) AS area, CAST(y0 AS INT) y0, CAST(x0 AS INT) x0, CAST(x1-x0+1 AS INT) width, CAST(y1-y0+1 AS INT) height, row_number() OVER (PARTITION BY r.image_id ORDER BY (y1-y0+1)*(x1-x0+1) DESC, x0, y0, x1) rn FROM
  (SELECT i.image_id, ya.y y0, yb.y y1, xa.x x0, xb.x x1 FROM (SELECT DISTINCT image_id FROM ps) i, range(16) ya(y), range(16) yb(y), range(16) xa(x), range(16) xb(x) WHERE ya.y<=yb.y AND xa.x<=xb.x) r
  JOIN ps a ON a.image_id=r.image_id AND a.y=r.y1 AND a.x=r.x1 LEFT JOIN ps b ON b.image_id=r.image_id AND b.y=r.y0-1 AND b.x=r.x1 LEFT JOIN ps c ON c.image_id=r.image_id AND c.y=r.y1 AND c.x=r.x0-1
  LEFT JOIN ps e ON e.image_id=r.image_id AND e.y=r.y0-1 AND e.x=r.x0-1 WHERE a.s-coalesce(b.s,0)-coalesce(c.s,0)+coalesce(e.s,0)=(y1-y0+1)*(x1-x0+1)) WHERE rn=1""",
  ps="SELECT a.image_id, a.y, a.x, (SELECT count(*) FROM dlum b WHERE b.image_id=a.image_id AND b.y<=a.y AND b.x<=a.x AND b.l>=0.55) AS s FROM dlum a"))
def largest_rectangle(spark, d):
    return op.largest_rectangle(fx.dlum(spark, d).select("image_id", "y", "x", (C("l") >= 0.55).alias("valid")))
