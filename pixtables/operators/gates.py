"""Gate engine: limits on a wide metric row, verdicts without any shuffle.

A gate is a list of ``Limit``. Metrics of one subject (an image, a candidate) lie in
one row, so a verdict is a projection; ``gate_rows`` unpivots it for audit tables.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

C = F.col


@dataclass(frozen=True)
class Limit:
    """``metric op limit`` must hold; ``limit`` may be a number or a column."""

    name: str
    metric: str
    op: str
    limit: float | Column
    hard: bool = True

    def value(self) -> Column:
        return self.limit if isinstance(self.limit, Column) else F.lit(float(self.limit))

    def passed(self) -> Column:
        m, v = C(self.metric), self.value()
        return {"<=": m <= v, "<": m < v, ">=": m >= v, ">": m > v, "=": m == v}[self.op]


def issues(limits: Sequence[Limit], missing_fails: bool = True, hard: bool | None = None) -> Column:
    """Comma list of the limits that do not hold, in the order of the gate."""
    names = []
    for lim in limits:
        if hard is None or lim.hard == hard:
            names.append(F.when(~F.coalesce(lim.passed(), F.lit(not missing_fails)), lim.name))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def verdict(df: DataFrame, limits: Sequence[Limit], keep: Sequence[str], missing_fails: bool = True) -> DataFrame:
    """status accepted / warning / rejected with the failing limits of each severity."""
    hard, soft = issues(limits, missing_fails, True), issues(limits, missing_fails, False)
    status = F.when(F.size(hard) > 0, "rejected").when(F.size(soft) > 0, "warning").otherwise("accepted")
    return df.select(*keep, status.alias("status"), F.array_join(hard, ",").alias("hard_issues"), F.array_join(soft, ",").alias("warnings"))


def gate_rows(df: DataFrame, limits: Sequence[Limit], keep: Sequence[str], missing_fails: bool = True) -> DataFrame:
    """One row per subject and limit: metric, value, limit, op, passed, severity."""
    rows = [
        F.struct(
            F.lit(x.name).alias("gate"), F.lit(x.metric).alias("metric"), C(x.metric).cast("double").alias("value"), F.lit(x.op).alias("op"),
            x.value().cast("double").alias("limit"), F.coalesce(x.passed(), F.lit(not missing_fails)).alias("passed"), F.lit("hard" if x.hard else "soft").alias("severity"))
        for x in limits
    ]
    return df.select(*keep, F.explode(F.array(*rows)).alias("g")).select(*keep, "g.*")


# Background profiles (fixed values).
PROFILES = ("output_first", "balanced", "strict")
BACKGROUND = {
    "flux_soft_min": (0.65, 0.75, 0.75), "flux_soft_max": (1.50, 1.25, 1.25), "flux_hard_min": (0.20, 0.40, 0.40), "flux_hard_max": (3.00, 2.00, 2.00),
    "morph_soft": (0.85, 0.90, 0.90), "morph_hard": (0.40, 0.60, 0.60), "centroid_soft": (0.05, 0.03, 0.03), "centroid_hard": (0.15, 0.10, 0.10),
    "structure_hard": (20.0, 12.0, 3.0), "span_ratio": (2.00, 1.50, 1.50), "rms_ratio": (1.75, 1.35, 1.35), "pattern_score": (0.90, 0.85, 0.85),
    "pattern_growth": (0.35, 0.25, 0.25), "hard_sigma": (6.0, 6.0, 3.0), "sufficient_score": (0.65, 0.50, 0.34), "dirty": (0.55, 0.40, 0.32),
    "std_growth": (1.25, 1.15, 1.08), "colour": (0.30, 0.24, 0.18),
}


def limit_of(name: str, profile: str = "profile") -> Column:
    """Limit of the row's profile from the fixed table."""
    v = BACKGROUND[name]
    return F.when(C(profile) == "strict", v[2]).when(C(profile) == "balanced", v[1]).otherwise(F.lit(v[0]))


def _graded(keep: Sequence[str], df: DataFrame, warnings: list[Column], hard: list[Column]) -> DataFrame:
    """Warnings and hard issues; the strict profile turns every warning into a rejection."""
    w, h = F.array_compact(F.array(*warnings)), F.array_compact(F.array(*hard))
    strict = C("profile") == "strict"
    df = df.withColumns({"_w": w, "_h": h})
    bad = F.when(strict, F.size("_w") > 0).otherwise(F.size("_h") > 0)
    status = F.when(bad, "hard_rejected").when(F.size("_w") > 0, "warning").otherwise("normal")
    issues_ = F.when(strict, C("_w")).otherwise(C("_h"))
    warns = F.when(strict, F.array().cast("array<string>")).otherwise(C("_w"))
    return df.select(*keep, "profile", status.alias("severity"), F.array_join(issues_, ",").alias("hard_issues"), F.array_join(warns, ",").alias("warnings"))


def background_gate(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """3-sigma span and RMS tests on span0/span1, noise0/noise1, se0/se1 of baseline and candidate."""
    df = df.withColumn("_t", F.greatest(F.lit(3.0) * F.sqrt(C("se0") * C("se0") + C("se1") * C("se1")), F.lit(1e-12)))
    unit = F.greatest(C("_t") / 3.0, F.lit(1e-12))
    warn = [
        F.when(~(C("span1") <= C("span0") + C("_t")), "span_worsened"), F.when(~(C("span0") - C("span1") > C("_t")), "improvement_below_uncertainty"),
        F.when(~(C("noise1") <= C("noise0") + C("_t")), "rms_increased")]
    over = lambda a, b: F.greatest(F.lit(0.0), C(a) - C(b)) / unit > limit_of("hard_sigma")
    hard = [
        F.when((C("span1") / F.greatest("span0", F.lit(1e-12)) > limit_of("span_ratio")) & over("span1", "span0"), "span_excessive"),
        F.when((C("noise1") / F.greatest("noise0", F.lit(1e-12)) > limit_of("rms_ratio")) & over("noise1", "noise0"), "rms_excessive")]
    return _graded(keep, df, warn, hard)


def fidelity_gate(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Flux retention, morphology, centroid and structure of the target after a background change.

    Null metrics are missing evidence: a warning, and a rejection in the strict profile.
    """
    strict = C("profile") == "strict"
    lo = lambda m, n: C(m) < limit_of(n)
    hi = lambda m, n: C(m) > limit_of(n)
    warn = [
        F.when(C("flux_sigma").isNull(), "flux_sigma_unavailable"), F.when(C("flux").isNull(), "flux_unavailable"),
        F.when(C("flux_sigma") < -3.0, "flux_loss"), F.when((C("flux_sigma") > 3.0) & ~strict, "flux_growth"),
        F.when(~strict & (lo("flux", "flux_soft_min") | hi("flux", "flux_soft_max")), "flux_range"),
        F.when(C("morphology").isNull(), "morphology_unavailable"), F.when(~strict & lo("morphology", "morph_soft"), "morphology_low"),
        F.when(C("structure").isNull(), "structure_unavailable"), F.when(C("structure") > 3.0, "structure_introduced"),
        F.when(~strict & C("centroid").isNull(), "centroid_unavailable"), F.when(~strict & hi("centroid", "centroid_soft"), "centroid_elevated")]
    hard = [
        F.when(lo("flux", "flux_hard_min") & (C("flux_sigma") < -limit_of("hard_sigma")), "flux_loss_excessive"),
        F.when(hi("flux", "flux_hard_max") & (C("flux_sigma") > limit_of("hard_sigma")), "flux_growth_excessive"),
        F.when(lo("morphology", "morph_hard"), "morphology_excessive"), F.when(hi("structure", "structure_hard"), "structure_excessive"),
        F.when(hi("centroid", "centroid_hard"), "centroid_excessive")]
    return _graded(keep, df, warn, hard)


def pattern_gate(df: DataFrame, keep: Sequence[str], growth_max: float = 0.12) -> DataFrame:
    """Pattern noise introduced or amplified between score0/found0 and score1/found1."""
    growth = C("score1") - C("score0")
    introduced = C("found1") & ~C("found0")
    worsened = (growth > growth_max) & (C("score1") >= 0.55)
    hard = (C("score1") > limit_of("pattern_score")) & (growth > limit_of("pattern_growth"))
    return _graded(keep, df, [F.when(introduced | worsened, "pattern_worsened")], [F.when(hard, "pattern_excessive")])


def direction_gate(df: DataFrame, keep: Sequence[str], sigma: float = 3.0) -> DataFrame:
    """Gradient components, or the whole direction, that turn round significantly.

    gx/gy slopes and ex/ey standard errors of baseline (0) and candidate (1).
    """
    rev = lambda a: (C(f"g{a}0") * C(f"g{a}1") < 0) & (F.abs(f"g{a}0") > C(f"e{a}0") * sigma) & (F.abs(f"g{a}1") > C(f"e{a}1") * sigma)
    norm = lambda i: F.sqrt(C(f"gx{i}") * C(f"gx{i}") + C(f"gy{i}") * C(f"gy{i}"))
    err = lambda i: F.sqrt(C(f"ex{i}") * C(f"ex{i}") + C(f"ey{i}") * C(f"ey{i}"))
    dot = C("gx0") * C("gx1") + C("gy0") * C("gy1")
    vec = (dot < 0) & (norm(0) > err(0) * sigma) & (norm(1) > err(1) * sigma)
    bad = F.array_compact(F.array(F.when(rev("x"), "x_reversed"), F.when(rev("y"), "y_reversed"), F.when(vec, "direction_reversed")))
    return df.select(*keep, (F.size(bad) == 0).alias("accepted"), F.array_join(bad, ",").alias("issues"))


def spatial_chroma_gate(df: DataFrame, keep: Sequence[str], floor: float = 0.002) -> DataFrame:
    """A component with a new 3-sigma slope, or slope growth over 1.25x, against the reference plane."""
    new = (C("sigma1") > 3.0) & ~(C("sigma0") > 3.0) & (C("span1") > floor)
    grown = (C("sigma1") > 3.0) & (C("sigma0") > 3.0) & (C("span1") > F.lit(1.25) * C("span0"))
    return df.select(*keep, F.when(new, "new_component").when(grown, "slope_growth").otherwise("ok").alias("status"), (~(new | grown)).alias("accepted"))


def background_authorisation(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Mechanism, mode and hard blocks from joined evidence.

    Reads sky_ready, linear, pattern, radial, varies, diffuse and sky_fraction.
    """
    mech = (
        F.when(~C("sky_ready"), "target_signal_or_sky_limited").when(C("pattern") & ~C("varies"), "directional_pattern_or_walking_noise")
        .when(C("radial"), "radial_low_frequency_gradient_ambiguous").when(C("varies"), "additive_low_frequency_gradient").otherwise("no_measurable_low_frequency_gradient"))
    mode = (
        F.when(~C("sky_ready"), "preserve_and_review").when(C("pattern") & ~C("varies"), "defer_to_calibration_or_stacking")
        .when(C("radial"), "subtract_with_master_flat_advisory").when(C("varies"), "subtract").otherwise("preserve"))
    blocks = F.array_compact(F.array(
        F.when(~C("linear"), "input_linearity_not_confirmed"), F.when(~C("sky_ready"), "insufficient_source_masked_true_sky_support"),
        F.when(C("sky_ready") & C("pattern") & ~C("varies"), "directional_noise_is_not_a_sky_gradient")))
    subtract = C("sky_ready") & ~(C("pattern") & ~C("varies")) & (C("radial") | C("varies"))
    route = F.when(C("pattern") & C("varies"), "mixed").when(C("pattern"), "pattern").when(C("varies") | C("radial"), "gradient").otherwise("none")
    return df.select(
        *keep, mech.alias("mechanism"), mode.alias("mode"), route.alias("route"), F.array_join(blocks, ",").alias("hard_blocks"),
        (C("diffuse") | (C("sky_fraction") < 0.50)).alias("low_complexity"), (subtract & (F.size(blocks) == 0)).alias("should_evaluate"))


def denoise_gate(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    lim = [
        Limit("clip_growth", "clip_growth", "<=", 0.001), Limit("background_median_drift", "median_drift", "<=", 0.003),
        Limit("signal_detail_retention", "detail_retention", ">=", 0.90), Limit("bright_spread_growth", "spread_growth", "<=", 0.03),
        Limit("background_chroma_noise_growth", "chroma_growth", "<=", 1.05)]
    quiet = C("sigma_before") <= 1e-5
    bad = F.concat(issues(lim), F.when(~quiet & (C("noise_reduction") < 0.12), F.array(F.lit("insufficient_noise_reduction"))).otherwise(F.array().cast("array<string>")))
    status = F.when((F.size(bad) == 0) & ~quiet, "accepted").when(quiet, "skipped_low_noise").otherwise("rejected")
    return df.select(*keep, status.alias("status"), F.array_join(bad, ",").alias("issues"))


def denoise_plan(df: DataFrame, keep: Sequence[str], focus: float = 0.35, separate: float = 0.75, std: float = 0.012, mottling: float = 0.35) -> DataFrame:
    """full / chroma / separate / skip from background metrics; missing metrics fall back to full."""
    missing = C("chroma_noise").isNull() | C("std").isNull() | C("mottling").isNull()
    rough = (C("std") >= std) | (C("mottling") >= mottling)
    mode = (
        F.when(~C("colour"), "full").when(missing, "full").when(C("chroma_noise") >= separate, "separate")
        .when(C("chroma_noise") >= focus, F.when(rough, "full").otherwise("chroma")).when(rough, "full").otherwise("skip"))
    return df.select(*keep, mode.alias("mode"), F.when(mode == "skip", "none").when(mode == "chroma", "full").otherwise(mode).alias("tool_mode"))
