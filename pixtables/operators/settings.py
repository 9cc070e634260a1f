"""Settings, policies and content digests as tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import PROFILE_FACTOR, scaled_limit

C = F.col

POLICY_DEFAULT = {"stretch.limit": "0.8", "noise.mode": "chroma", "stars.keep": "true"}


def policy_overlay(tasks: DataFrame, default: dict[str, str], overlays: dict[str, dict[str, str]]) -> DataFrame:
    """Every path of the default policy with the task's overlay on top; unknown policies fall back.

    Policies are small literals, so they travel in the projection instead of a join.
    """
    known = F.when(C("policy").isin(*overlays), C("policy")).otherwise("default")
    rows = []
    for path in sorted({*default, *[p for o in overlays.values() for p in o]}):
        over = F.lit(None).cast("string")
        for name, o in overlays.items():
            if path in o:
                over = F.when(C("policy") == name, o[path]).otherwise(over)
        rows.append(F.struct(F.lit(path).alias("path"), F.lit(default.get(path)).cast("string").alias("base"), over.alias("over")))
    out = tasks.select("task_id", known.alias("policy"), F.explode(F.array(*rows)).alias("r"))
    out = out.where(C("r.base").isNotNull() | C("r.over").isNotNull())
    return out.select("task_id", "policy", C("r.path").alias("path"), F.coalesce("r.over", "r.base").alias("value"), C("r.over").isNotNull().alias("overridden"))


def apply_specs(settings: DataFrame, specs: Sequence[tuple]) -> DataFrame:
    """settings(task_id, field, value text) against specs (field, kind, min, max, odd, default).

    Type coercion, clamp and odd rule; unknown fields and unreadable values are named.
    """
    spark = settings.sparkSession
    table = spark.createDataFrame([(*s[:5],) for s in specs], "field string, kind string, lo double, hi double, odd boolean")
    rows = settings.join(F.broadcast(table), "field", "left")  # the specs are a literal list
    v = F.lower(F.trim("value"))
    number = F.trim("value").try_cast("double")
    num = (
        F.when(C("kind") == "bool", F.when(v.isin("1", "true", "yes", "on"), 1.0).when(v.isin("0", "false", "no", "off"), 0.0))
        .when(C("kind") == "int", F.when(number == F.floor(number), number)).when(C("kind") == "float", F.when(~F.isnan(number) & (F.abs(number) < 1e300), number)))
    rows = rows.withColumn("_n", num)
    low = F.when(C("lo").isNotNull() & (C("_n") < C("lo")), C("lo")).otherwise(C("_n"))
    lim = F.when(C("hi").isNotNull() & (low > C("hi")), C("hi")).otherwise(low)
    even = C("odd") & (lim % 2 == 0)
    eff = F.when(even & C("hi").isNotNull() & (lim + 1 > C("hi")), lim - 1).when(even, lim + 1).otherwise(lim)
    rows = rows.withColumn("effective", eff)
    status = F.when(C("kind").isNull(), "unknown_field").when(C("_n").isNull(), "invalid").when(C("effective") != C("_n"), "adjusted").otherwise("ok")
    return rows.select("task_id", "field", status.alias("status"), "effective", F.when(C("effective") != C("_n"), F.when(C("odd"), "safe_clamp_or_odd").otherwise("safe_clamp")).alias("reason"))


def scale_limits(tasks: DataFrame, specs: Sequence[tuple]) -> DataFrame:
    """Limits of each task's gate profile: (metric, direction, base, is_int, min, max) scaled and clamped."""
    items = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(d).alias("dir"), F.lit(float(b)).alias("base"), F.lit(i).alias("ii"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
        for m, d, b, i, lo, hi in specs])
    factor = F.lit(None).cast("double")
    for name, f in PROFILE_FACTOR.items():
        factor = F.when(C("profile") == name, f).otherwise(factor)
    rows = tasks.select("task_id", "profile", factor.alias("_f"), F.explode(items).alias("s")).select("*", "s.*").drop("s")
    rows = rows.withColumn("requested", scaled_limit(C("base"), C("dir"), C("ii"), C("_f")))
    eff = F.least(F.greatest("requested", "lo"), "hi")
    return rows.select("task_id", "metric", "profile", "requested", eff.alias("effective"), (eff != C("requested")).alias("clamped"))


def settings_table(tasks: DataFrame, defaults: dict[str, str], layers: Sequence[DataFrame]) -> DataFrame:
    """Value of each setting from defaults and later layers (the last layer wins), with its source."""
    base = tasks.select("task_id", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lit(v).alias("value")) for k, v in defaults.items()])).alias("s"))
    rows = base.select("task_id", "s.field", "s.value", F.lit("default").alias("source"), F.lit(0).alias("_p"))
    for i, layer in enumerate(layers, 1):
        rows = rows.unionByName(layer.withColumn("_p", F.lit(i)))
    best = F.max(F.struct("_p", "value", "source")).alias("b")
    return rows.groupBy("task_id", "field").agg(best).select("task_id", "field", "b.value", "b.source")


def pixel_digest(px: DataFrame, tile: int, height: int, width: int, key: str = "image_id") -> DataFrame:
    """Digest of an image: each tile hashes its pixels in order, the image hashes its tiles in order.

    A tile is bounded by tile^2 pixels, an image by its number of tiles, so no group
    holds all pixels of a large image.
    """
    unit = lambda c: F.floor(C(c) * 1e6).cast("long").cast("string")
    text = F.concat_ws(":", C("y").cast("string"), C("x").cast("string"), unit("r"), unit("g"), unit("b"))
    tiles = px.groupBy(key, F.floor(C("y") / tile).alias("ty"), F.floor(C("x") / tile).alias("tx")).agg(F.array_sort(F.collect_list(F.struct("y", "x", text.alias("t")))).alias("p"))
    tiles = tiles.select(key, "ty", "tx", F.sha2(F.array_join(F.transform("p", lambda s: s["t"]), ";"), 256).alias("d"))
    img = tiles.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ty", "tx", "d"))).alias("t"))
    return img.select(key, F.sha2(F.concat(F.lit(f"{height}x{width}|"), F.array_join(F.transform("t", lambda s: s["d"]), ",")), 256).alias("digest"))
