"""Noise measurement and multiscale denoising of pixel tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.pixel import luminance
from ..session import shared
from .grid import abs_gradient, box_blur
from .quantiles import quantiles, robust_sigma, with_quantiles, with_stats

COMPONENTS = ("l", "r", "g", "b", "rg", "bg")


def with_luminance(px: DataFrame) -> DataFrame:
    return px.withColumn("l", luminance(F.col("r"), F.col("g"), F.col("b")))


def background_mask(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Pixels with ``sky`` (low signal, low gradient) and ``sky_fallback`` per image.

    The gradient test is dropped, and the signal limit raised to P55, for images in
    which fewer than max(128, 1%) pixels pass. Expects ``l``.
    """
    base = abs_gradient(px, "l", "grad", [key])
    tagged = with_quantiles(base, [key], [(F.col("l"), {"l_low": 0.005, "l_high": 0.45, "l_wide": 0.55}), (F.col("grad"), {"grad_max": 0.65})])
    low = F.col("l") >= F.col("l_low")
    strict = low & (F.col("l") <= F.col("l_high")) & (F.col("grad") <= F.col("grad_max"))
    out = with_stats(tagged, [key], {"_pass": F.count_if(strict)})
    short = F.col("_pass") < F.greatest(F.lit(128), F.floor(F.col("n_l_low") * 0.01))
    sky = F.when(short, low & (F.col("l") <= F.col("l_wide"))).otherwise(strict)
    return out.select(*px.columns, "grad", short.alias("sky_fallback"), sky.alias("sky"))


def noise_report(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Sky coverage, robust sigma of luminance, channels and opponent planes per image."""
    sky = shared(background_mask(with_luminance(px), key))
    on = F.col("sky")
    values = {
        "luma": F.when(on, F.col("l")), "red": F.when(on, F.col("r")), "green": F.when(on, F.col("g")), "blue": F.when(on, F.col("b")),
        "r_g": F.when(on, F.col("r") - F.col("g")), "b_g": F.when(on, F.col("b") - F.col("g")),
    }
    sig = robust_sigma(sky, [key], values)
    cover = sky.groupBy(key).agg(
        F.count_if(on).alias("sky_pixels"), F.avg(on.cast("int")).alias("coverage"), F.bool_or("sky_fallback").alias("sky_fallback")
    )
    out = cover.join(sig, key, "left")
    strongest = F.greatest("r_g_sigma", "b_g_sigma")
    mode = F.when(strongest > F.greatest(F.col("luma_sigma") * 1.25, F.lit(1e-8)), "chroma_first").otherwise("luma_chroma_balanced")
    return out.select(key, "sky_pixels", "coverage", "sky_fallback", F.col("luma_med").alias("sky_level"), *[f"{n}_sigma" for n in values], mode.alias("mode"))


def cascade(px: DataFrame, radii: tuple[int, ...], planes: tuple[str, ...], key: str = "image_id") -> DataFrame:
    """Details ``<plane>_d<r> = s - blur(s)`` of a smoothing cascade, ``<plane>_s`` the rest."""
    out = px
    current = {p: p for p in planes}
    for r in radii:
        nxt = {p: f"{p}_s{r}" for p in planes}
        out = box_blur(out, {current[p]: nxt[p] for p in planes}, r, [key])
        for p in planes:
            out = out.withColumn(f"{p}_d{r}", F.col(current[p]) - F.col(nxt[p]))
        # the planes are carried on; earlier smooth copies are not needed any more
        out = out.drop(*[c for p, c in current.items() if c != p])
        current = nxt
    return out.withColumnsRenamed({current[p]: f"{p}_s" for p in planes})


def noise_model(grid: DataFrame, radii: tuple[int, ...] = (1, 2, 4), key: str = "image_id") -> DataFrame:
    """Per image and scale: robust sigma of luminance, channel and opponent detail on the sky."""
    sky = background_mask(with_luminance(grid), key)
    casc = shared(cascade(sky, radii, ("l", "r", "g", "b"), key))
    on = F.col("sky")
    rows = F.explode(
        F.array(*[
            F.struct(
                F.lit(r).alias("radius"),
                *[F.col(f"{p}_d{r}").alias(p) for p in ("l", "r", "g", "b")],
                (F.col(f"r_d{r}") - F.col(f"g_d{r}")).alias("rg"),
                (F.col(f"b_d{r}") - F.col(f"g_d{r}")).alias("bg"),
            )
            for r in radii
        ])
    )
    long = shared(casc.where(on).select(key, rows.alias("s")).select(key, "s.*"))
    sig = robust_sigma(long, [key, "radius"], {c: F.col(c) for c in COMPONENTS})
    energy = long.groupBy(key, "radius").agg(F.avg(F.col("l") * F.col("l")).alias("detail_energy"), F.count("*").alias("sky_pixels"))
    return energy.join(sig, [key, "radius"]).select(key, "radius", "sky_pixels", *[f"{c}_sigma" for c in COMPONENTS], "detail_energy")


def signal_noise_curve(grid: DataFrame, key: str = "image_id", bins: int = 5) -> DataFrame:
    """Robust sigma of the first-scale luminance detail in equal-count signal bins."""
    lum = shared(box_blur(with_luminance(grid), {"l": "_s"}, 1, [key]).select(key, "l", (F.col("l") - F.col("_s")).alias("d")))
    specs = [(F.col("l"), {f"e{i}": i / bins for i in range(bins + 1)})]
    tagged = with_quantiles(lum, [key], specs)
    number = F.lit(bins - 1)
    for i in reversed(range(bins - 1)):
        number = F.when(F.col("l") < F.col(f"e{i + 1}"), i).otherwise(number)
    tagged = tagged.select(key, "l", "d", number.alias("bin"))
    lim = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"e{i}").alias("signal_min"), F.col(f"e{i+1}").alias("signal_max")) for i in range(bins)])
    limits = quantiles(lum, [key], specs).select(key, F.explode(lim).alias("s")).select(key, "s.*")
    counts = tagged.groupBy(key, "bin").agg(F.count("*").alias("samples"))
    sig = robust_sigma(tagged, [key, "bin"], {"noise": F.col("d")})
    return (
        limits.join(counts, [key, "bin"], "left").join(sig, [key, "bin"], "left")
        .select(key, "bin", "signal_min", "signal_max", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("noise_sigma", F.lit(0.0)).alias("noise_sigma"))
    )


def sky_covariance(px: DataFrame, key: str = "image_id") -> DataFrame:
    """Sample covariance of the channels on the sky."""
    sky = background_mask(with_luminance(px), key).where("sky")
    pairs = [("r", "r"), ("r", "g"), ("r", "b"), ("g", "g"), ("g", "b"), ("b", "b")]
    return sky.groupBy(key).agg(*[F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs])
