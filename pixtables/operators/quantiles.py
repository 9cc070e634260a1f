"""Exact grouped quantiles and robust spreads, in two physical forms with equal results.

*Whole groups.* Where the session declares the size of the largest image (see
``session.declare_image_size``) and it is small, an image is one group: built-in
``percentile``, and statistics are put next to the rows with a window over the
image. A table hash-partitioned by image then needs no further shuffle.

*Spread groups.* Where the size is unknown or large, no group is gathered in one
task: ``percentile`` would keep every distinct value of a group in the memory of
one reducer. Each value first falls into a bucket by a fixed, order-preserving
function. Bucket counts (partial aggregation, a few thousand rows per group
whatever its size) say which bucket holds the wanted ranks; only the rows of that
bucket are counted by value and ordered. A hot image is therefore spread over its
buckets, and repeated values collapse in the map-side combine.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import images_fit, shared

_BUCKETS_PER_E = 512.0
_LINEAR_FROM = float(2**20)


def _bucket(v: Column) -> Column:
    # log1p is monotone, so the bucket number follows the order of the values
    return (F.signum(v) * F.floor(F.log1p(F.abs(v) * F.lit(_LINEAR_FROM)) * F.lit(_BUCKETS_PER_E))).cast("int")


Specs = Sequence[tuple[Column, dict[str, float]]]


def _percentiles(specs: Specs) -> list[tuple[str, Column, Column]]:
    """(first name, array of percentiles, number of values) for every value column."""
    out = []
    for c, qs in specs:
        v = c.cast("double")
        v = F.when(~F.isnan(v), v)
        out.append((next(iter(qs)), F.percentile(v, F.array(*[F.lit(float(q)) for q in qs.values()])), F.count(v)))
    return out


def _unpack(specs: Specs) -> list[Column]:
    return [F.col(f"_{next(iter(qs))}")[j].alias(n) for _, qs in specs for j, n in enumerate(qs)]


def quantiles(df: DataFrame, keys: Sequence[str], specs: Specs, whole: bool | None = None) -> DataFrame:
    """One row per key with linearly interpolated quantiles (numpy's default).

    ``specs`` is a list of ``(value column, {output name: q})``; null and NaN
    values take no part. Each value column also yields ``n_<first output>``.
    ``whole`` overrides the choice of the form, for groups that are not images.
    """
    keys = list(keys)
    if images_fit(df.sparkSession) if whole is None else whole:
        aggs = [e for n, p, c in _percentiles(specs) for e in (p.alias(f"_{n}"), c.alias(f"n_{n}"))]
        return df.groupBy(*keys).agg(*aggs).select(*keys, *_unpack(specs), *[f"n_{next(iter(q))}" for _, q in specs])
    return _spread_quantiles(df, keys, specs)


def with_quantiles(df: DataFrame, keys: Sequence[str], specs: Specs, whole: bool | None = None) -> DataFrame:
    """The rows of ``df`` with the quantiles of their group next to them."""
    keys = list(keys)
    if images_fit(df.sparkSession) if whole is None else whole:
        w = W.partitionBy(*keys)
        parts = [e for n, p, c in _percentiles(specs) for e in (p.over(w).alias(f"_{n}"), c.over(w).alias(f"n_{n}"))]
        out = df.select("*", *parts)
        return out.select(*df.columns, *_unpack(specs), *[f"n_{next(iter(q))}" for _, q in specs])
    base = shared(df)
    return attach(base, _spread_quantiles(base, keys, specs), keys)


def with_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], whole: bool | None = None) -> DataFrame:
    """The rows of ``df`` with aggregates of their group next to them."""
    keys = list(keys)
    if images_fit(df.sparkSession) if whole is None else whole:
        w = W.partitionBy(*keys)
        return df.select("*", *[c.over(w).alias(n) for n, c in stats.items()])
    base = shared(df)
    return attach(base, base.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def _spread_quantiles(df: DataFrame, keys: list[str], specs: Specs) -> DataFrame:
    if len(specs) == 1:
        long = df.select(*keys, F.lit(0).alias("_m"), specs[0][0].cast("double").alias("_v"))
    else:
        items = [F.struct(F.lit(i).alias("_m"), c.cast("double").alias("_v")) for i, (c, _) in enumerate(specs)]
        long = df.select(*keys, F.explode(F.array(*items)).alias("_e")).select(*keys, "_e._m", "_e._v")
    long = long.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", _bucket(F.col("_v")))

    group = [*keys, "_m"]
    hist = long.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    by_bucket = W.partitionBy(*group).orderBy("_b")
    hist = (
        hist.withColumn("_cum", F.sum("_n").over(by_bucket))
        .withColumn("_total", F.sum("_n").over(W.partitionBy(*group)))
        .withColumn("_before", F.col("_cum") - F.col("_n"))
    )
    wanted = F.lit(None)
    for i, (_, qs) in enumerate(specs):
        arr = F.array(*[F.struct(F.lit(j).alias("_q"), F.lit(float(q)).alias("_p")) for j, q in enumerate(qs.values())])
        wanted = F.when(F.col("_m") == i, arr) if i == 0 else wanted.when(F.col("_m") == i, arr)
    pos = F.col("_w._p") * (F.col("_total") - 1)
    target = (
        hist.select("*", F.explode(wanted).alias("_w"))
        .withColumn("_lo", F.floor(pos).cast("long"))
        .withColumn("_hi", F.ceil(pos).cast("long"))
        .withColumn("_f", pos - F.floor(pos))
        .where(
            ((F.col("_before") <= F.col("_lo")) & (F.col("_lo") < F.col("_cum")))
            | ((F.col("_before") <= F.col("_hi")) & (F.col("_hi") < F.col("_cum")))
        )
        .select(*group, "_b", "_before", "_total", F.col("_w._q").alias("_q"), "_lo", "_hi", "_f")
    )
    hit = (
        long.join(target, [*group, "_b"])
        .groupBy(*group, "_b", "_q", "_before", "_total", "_lo", "_hi", "_f", "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_in", F.sum("_c").over(W.partitionBy(*group, "_b", "_q").orderBy("_v")))
    )
    end = F.col("_before") + F.col("_in")
    start = end - F.col("_c")
    values, counts = [], []
    for i, (_, qs) in enumerate(specs):
        for j, name in enumerate(qs):
            mine = (F.col("_m") == i) & (F.col("_q") == j)
            lo = F.max(F.when(mine & (start <= F.col("_lo")) & (F.col("_lo") < end), F.col("_v")))
            hi = F.max(F.when(mine & (start <= F.col("_hi")) & (F.col("_hi") < end), F.col("_v")))
            frac = F.max(F.when(mine, F.col("_f")))
            values.append((lo + (hi - lo) * frac).alias(name))
        counts.append(F.max(F.when(F.col("_m") == i, F.col("_total"))).alias(f"n_{next(iter(qs))}"))
    found = hit.groupBy(*keys).agg(*values, *counts)
    # groups without any value keep their row, as with the built-in aggregate
    out = df.select(*keys).distinct().join(found, keys, "left")
    return out.fillna(0, [f"n_{next(iter(qs))}" for _, qs in specs])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one-row-per-key statistics back onto rows.

    The statistics are broadcast when Spark sees that they are small; beyond that
    the sort-merge join splits hot keys at run time (see ``session.configure``).
    """
    return df.join(stats, list(keys), "left")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the pairs without null; null where one side does not vary (``corr`` divides by zero there)."""
    a, b = F.when(b.isNotNull(), a).cast("double"), F.when(a.isNotNull(), b).cast("double")
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))


def robust_sigma(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    minimum: int = 16,
    whole: bool | None = None,
) -> DataFrame:
    """Median ``<name>_med``, ``1.4826 * MAD`` as ``<name>_sigma`` (0 under ``minimum`` values), ``<name>_n``."""
    keys = list(keys)
    base = df.select(*keys, *[c.cast("double").alias(n) for n, c in values.items()])
    dev = with_quantiles(base, keys, [(F.col(n), {f"{n}_med": 0.5}) for n in values], whole)
    mads = [(F.abs(F.col(n) - F.col(f"{n}_med")), {f"{n}_mad": 0.5}) for n in values]
    # the median is constant within the group, so any quantile of it returns it
    meds = [(F.col(f"{n}_med"), {f"_{n}": 0.0}) for n in values]
    out = quantiles(dev, keys, mads + meds, whole)
    cols = []
    for n in values:
        sigma = F.when(F.col(f"n_{n}_mad") >= minimum, F.lit(1.4826) * F.col(f"{n}_mad")).otherwise(F.lit(0.0))
        cols += [F.col(f"_{n}").alias(f"{n}_med"), sigma.alias(f"{n}_sigma"), F.col(f"n_{n}_mad").alias(f"{n}_n")]
    return out.select(*keys, *cols)


def with_percent_rank(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds (rank - 1) / (n - 1) of a value within its group, spread over value buckets.

    Bucket counts give the number of smaller values below a bucket, a window inside
    the bucket the rest, so the rows of a large image are ranked in many tasks.
    """
    keys = list(keys)
    d = df.withColumn("_pv", value.cast("double")).withColumn("_pb", _bucket(F.col("_pv")))
    hist = d.groupBy(*keys, "_pb").agg(F.count("*").alias("_pc"))
    upto = W.partitionBy(*keys).orderBy("_pb")
    hist = hist.select(*keys, "_pb", (F.sum("_pc").over(upto) - F.col("_pc")).alias("_pl"), F.sum("_pc").over(W.partitionBy(*keys)).alias("_pn"))
    d = d.join(hist, [*keys, "_pb"])
    rank = F.rank().over(W.partitionBy(*keys, "_pb").orderBy("_pv")) - 1 + F.col("_pl")
    return d.withColumn(out, rank / F.greatest(F.col("_pn") - 1, F.lit(1))).drop("_pv", "_pb", "_pl", "_pn")


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, qs: dict[str, float], minimum: int = 16) -> DataFrame:
    """Smallest value whose cumulative weight reaches q of the total; null under ``minimum`` values.

    Same two steps as the spread quantiles: bucket weights first, then only the bucket
    that holds the target is ordered. Adds ``weight_sum``, ``samples`` and ``wmean``.
    """
    keys = list(keys)
    d = df.select(*keys, value.cast("double").alias("_v"), weight.cast("double").alias("_w")).where("_w > 1e-6 AND _v IS NOT NULL").withColumn("_b", _bucket(F.col("_v")))
    hist = d.groupBy(*keys, "_b").agg(F.sum("_w").alias("_hw"), F.count("*").alias("_hn"), F.sum(F.col("_v") * F.col("_w")).alias("_hv"))
    w, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_b")
    hist = hist.select(
        *keys, "_b", F.sum("_hw").over(upto).alias("_cum"), (F.sum("_hw").over(upto) - F.col("_hw")).alias("_before"),
        F.sum("_hw").over(w).alias("_tw"), F.sum("_hn").over(w).alias("_tn"), F.sum("_hv").over(w).alias("_tv"))
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs.values())])
    t = hist.select("*", F.explode(arr).alias("_q")).withColumn("_t", F.col("_q.q") * F.col("_tw"))
    # the last bucket also takes a target that rounding puts past the total
    t = t.where((F.col("_before") < F.col("_t")) & ((F.col("_cum") >= F.col("_t")) | (F.col("_cum") >= F.col("_tw"))))
    hit = d.join(t, [*keys, "_b"]).select(*keys, "_v", "_w", "_tw", "_tn", "_tv", F.col("_q.i").alias("_i"), "_before", "_t")
    run = W.partitionBy(*keys, "_i").orderBy("_v").rangeBetween(W.unboundedPreceding, 0)
    hit = hit.withColumn("_in", F.sum("_w").over(run) + F.col("_before"))
    out = hit.groupBy(*keys).agg(
        F.max("_tn").alias("samples"), F.max("_tw").alias("weight_sum"), (F.max("_tv") / F.max("_tw")).alias("wmean"),
        *[F.coalesce(F.min(F.when((F.col("_i") == i) & (F.col("_in") >= F.col("_t") * (1 - 1e-12)), F.col("_v"))), F.max(F.when(F.col("_i") == i, F.col("_v")))).alias(n) for i, n in enumerate(qs)])
    few = F.col("samples") < minimum
    return out.select(*keys, "samples", "weight_sum", *[F.when(~few, F.col(n)).alias(n) for n in ["wmean", *qs]])
