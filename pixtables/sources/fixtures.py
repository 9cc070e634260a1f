"""Image, catalogue, run and event tables derived from the given parquet tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed import smoothstep
from ..functions.pixel import luminance
from ..operators.grid import dense_grid
from ..operators.quantiles import quantiles, with_quantiles
from ..session import broadcast_measured, declare_image_size, scan_tasks, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return broadcast_measured(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark, sf_dir) -> DataFrame:
    """16 x 16 pixels per image; by construction no image has more than 256 rows."""
    declare_image_size(spark, 256)
    li = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(li)
    scan_tasks(spark, tasks)
    out = li.groupBy(
        F.col("l_suppkey").alias("image_id"),
        (F.col("l_orderkey") % 16).cast("int").alias("y"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
    ).agg(
        (F.max("l_quantity") / 50.0).alias("r"),
        (F.max("l_extendedprice") / 105000.0).alias("g"),
        (F.max("l_discount") * 10.0).alias("b"),
    )
    # busy suppliers are already collapsed to 256 cells, so whole images spread evenly
    return out.repartition(tasks, "image_id")


def dense(spark, sf_dir) -> DataFrame:
    """``px`` on the full 16 x 16 grid, gaps filled with the channel median of the image."""
    p = px(spark, sf_dir)
    med = quantiles(p, ["image_id"], [(F.col(c), {f"m_{c}": 0.5}) for c in "rgb"])
    size = med.select("image_id", F.lit(16).alias("h"), F.lit(16).alias("w"), "m_r", "m_g", "m_b")
    return dense_grid(p, size, {c: F.col(f"m_{c}") for c in "rgb"})


def cand(spark, sf_dir) -> DataFrame:
    k, x = F.col("k"), F.col("x")
    return (
        px(spark, sf_dir)
        .withColumn("k", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
        .select(
            "image_id", "y", "x", "k",
            (F.col("r") * (F.lit(1.0) - F.lit(0.1) * k) + F.lit(0.02) * k).alias("r"),
            (F.col("g") * (F.lit(1.0) - F.lit(0.05) * k)).alias("g"),
            (F.col("b") * (F.lit(1.0) - F.lit(0.1) * k) + F.lit(0.01) * x * k / 16).alias("b"),
        )
    )


def frame_stack(spark, sf_dir) -> DataFrame:
    """Aligned frames of at most 256 pixels each (see ``px``)."""
    declare_image_size(spark, 256)
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("frame_id"),
        (F.col("l_orderkey") % 16).cast("int").alias("y"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
    ).agg(F.max("l_extendedprice").alias("v"))


def points(spark, sf_dir) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    return (
        px(spark, sf_dir)
        .where((y % 4 == 2) & (x % 4 == 2))
        .select("image_id", (y * 16 + x).alias("point_id"), "y", "x",
                F.when((y + x) % 8 == 0, "validation").otherwise("fit").alias("split"))
    )


def frames(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("frame_id"),
        F.col("source").alias("target"),
        F.when(F.col("lang") == "en", "LP").when(F.col("lang") == "fr", "Ha OIII").when(F.col("lang") == "de", "No Filter").otherwise("").alias("filter"),
        F.concat(F.when(F.col("doc_id") % 7 == 0, "dark_").otherwise("Light_"), F.col("doc_id").cast("string"), F.lit(".fit")).alias("name"),
        F.col("n_chars").alias("bytes"),
    )


def sky(spark, sf_dir) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("sky_id"), F.col("s_name").alias("name"),
        ((s * 137) % 360).cast("double").alias("ra_deg"),
        ((s * 61) % 161 - 80).cast("double").alias("dec_deg"),
        (F.lit(20) + s % 170).cast("double").alias("size_arcmin"),
    )


def pointing(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("frame_id"),
        (((c * 97) % 3600).cast("double") / 10).alias("ra_deg"),
        (((c * 61) % 1610).cast("double") / 10 - 80).alias("dec_deg"),
        F.col("c_name").alias("text"),
    )


def stars(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = lambda i: F.col("embedding")[i].cast("double")
    rows = [
        ("O", F.lit(True), v(0) * 400, v(1) * 400, F.abs(v(2)) * 1000 + 1),
        ("B", F.col("vec_id") % 3 != 0, v(0) * 400 + v(3) * 8, v(1) * 400 + v(4) * 8, F.abs(v(2)) * 500 + 1),
        ("C", F.col("vec_id") % 11 != 0, v(0) * 400 + v(5) * 4, v(1) * 400 + v(6) * 4, F.abs(v(2)) * 900 + 1),
    ]
    structs = [
        F.when(keep, F.struct(F.lit(role).alias("role"), F.col("vec_id").alias("star_id"), x.alias("x"), y.alias("y"), f.alias("flux")))
        for role, keep, x, y, f in rows
    ]
    return e.select(F.explode(F.array_compact(F.array(*structs))).alias("s")).select("s.*")


def steps(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_quantity") > 48, "failed").otherwise("degraded")).otherwise("ok").alias("status"),
        (F.col("l_tax") > 0.07).alias("fallback_used"), F.col("l_quantity").alias("duration"),
    )


def reviews(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_discount") > 0.09).select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage"),
        F.concat(F.lit("code_"), (F.col("l_suppkey") % 5).cast("string")).alias("code"),
    )


def runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "running").otherwise("preparing").alias("status"),
        F.col("o_orderpriority").alias("owner_session"),
    )


def run_events(spark, sf_dir) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("run_id"),
        F.when(t.isin("view", "click"), "progress").when(t == "signup", "stage_start").when(t == "purchase", "stage_result").otherwise("error").alias("kind"),
        "value", F.col("props").alias("payload"),
    )


def lum(spark, sf_dir) -> DataFrame:
    return px(spark, sf_dir).withColumn("l", luminance(F.col("r"), F.col("g"), F.col("b")))


def dlum(spark, sf_dir) -> DataFrame:
    return dense(spark, sf_dir).withColumn("l", luminance(F.col("r"), F.col("g"), F.col("b")))


def with_masks(pix: DataFrame) -> DataFrame:
    """Soft subject, background and core weights from luminance quantiles of the image."""
    out = with_quantiles(pix, ["image_id"], [(F.col("l"), {"q10": 0.10, "q55": 0.55, "q92": 0.92})])
    l = F.col("l")
    out = out.withColumns({
        "subject": smoothstep(l, F.col("q55"), F.col("q92")),
        "background": F.lit(1.0) - smoothstep(l, F.col("q10"), F.col("q55")),
        "core": (l >= F.col("q92")).cast("double"),
    })
    return out.drop("q10", "q55", "q92", "n_q10")


def masked(spark, sf_dir) -> DataFrame:
    return with_masks(lum(spark, sf_dir))


def with_candidate(pix: DataFrame, k: int) -> DataFrame:
    """Candidate k of ``cand`` next to the baseline, for operators on full grids."""
    return pix.withColumns({
        "r2": F.col("r") * (F.lit(1.0) - F.lit(0.1) * k) + F.lit(0.02) * k,
        "g2": F.col("g") * (F.lit(1.0) - F.lit(0.05) * k),
        "b2": F.col("b") * (F.lit(1.0) - F.lit(0.1) * k) + F.lit(0.01) * F.col("x") * k / 16,
    })


def dmasked(spark, sf_dir) -> DataFrame:
    return with_masks(dlum(spark, sf_dir))


def pair(spark, sf_dir, k: int = 2) -> DataFrame:
    """Baseline with masks joined to candidate ``k`` of the same image."""
    c = cand(spark, sf_dir).where(F.col("k") == k).select("image_id", "y", "x", *[F.col(n).alias(f"{n}2") for n in "rgb"])
    return masked(spark, sf_dir).join(c, ["image_id", "y", "x"])
