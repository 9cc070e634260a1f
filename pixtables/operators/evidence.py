"""Evidence tables: what an input is, which device took it, what its channels mean."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

C = F.col


def input_state(f: DataFrame) -> DataFrame:
    """linear / nonlinear / unknown with source, confidence and conflicts per frame.

    Reads mode, verified_state, linear_flag, stretched_flag, nonlinear_flag, stretch, says_stretched,
    says_linear, acquisition_linear, p50, p99, black_ratio, highlight_ratio (nulls = no evidence).
    """
    st = F.lower(F.trim(F.coalesce("stretch", F.lit(""))))
    on = lambda c: F.coalesce(c, F.lit(False))
    lin = on(C("linear_flag")) | on(~C("stretched_flag")) | ((st != "") & st.isin("none", "false", "0", "linear")) | on(C("says_linear"))
    non = on(~C("linear_flag")) | on(C("stretched_flag")) | on(C("nonlinear_flag")) | ((st != "") & ~st.isin("none", "false", "0", "linear")) | on(C("says_stretched"))
    bright = on(((C("p50") >= 0.075) & (C("p99") >= 0.30)) | ((C("p50") >= 0.035) & (C("black_ratio") >= 0.025)))
    dim = on((C("p50") <= 0.030) & (C("p99") <= 0.55) & (C("highlight_ratio") <= 0.002))
    f = f.withColumns({"_l": lin, "_n": non, "_b": bright, "_d": dim & ~bright, "_a": on(C("acquisition_linear"))})
    conf = F.array_compact(F.array(
        F.when(C("_l") & C("_n"), "header_both_claims"), F.when(C("_l") & C("_b"), "linear_header_bright_pixels"),
        F.when(C("_n") & C("_a"), "stretch_history_raw_keys"), F.when(C("_a") & C("_b") & ~C("_l"), "raw_keys_bright_pixels")))
    rules = [
        (C("mode") == "light_preprocess", "linear", 1.0, "current_run_light_stack"), (C("verified_state").isNotNull(), None, 0.99, "verified_manifest"),
        (F.size(conf) > 0, "unknown", 0.20, "conflicting_evidence"), (C("_n"), "nonlinear", 0.96, "fits_processing_metadata"), (C("_l"), "linear", 0.96, "fits_processing_metadata"),
        (C("_a"), "linear", 0.88, "acquisition_metadata"), (C("_b"), "nonlinear", 0.80, "pixel_distribution"), (C("_d"), "linear", 0.68, "pixel_distribution")]
    state, cf, src = F.lit("unknown"), F.lit(0.0), F.lit("insufficient_evidence")
    for cond, s, c, name in reversed(rules):
        state = F.when(cond, C("verified_state") if s is None else s).otherwise(state)
        cf, src = F.when(cond, c).otherwise(cf), F.when(cond, name).otherwise(src)
    shown = F.when(src == "conflicting_evidence", F.array_join(conf, ",")).otherwise("")
    return f.select("frame_id", state.alias("state"), cf.alias("confidence"), src.alias("source"), shown.alias("conflicts"))


def channel_semantics(f: DataFrame) -> DataFrame:
    """Layout, spectral, composition and transfer axes, kind and action from (channels, state, narrowband)."""
    ch, lin = C("channels"), C("state")
    layout = F.when(ch == 1, "mono").when(ch == 3, "rgb").when(ch > 3, "multichannel").otherwise("unknown")
    spectral = F.when(ch == 0, "unknown").when(C("narrowband"), "narrowband").otherwise("broadband")
    comp = F.when((ch == 3) & C("narrowband"), "composite").when(ch == 1, "single").when(ch == 3, "osc_or_rgb").otherwise("unknown")
    kind = (
        F.when(ch == 1, "mono").when(ch > 3, "unknown").when(lin == "nonlinear", "nonlinear_color").when((ch < 3) | (lin != "linear"), "unknown")
        .when(C("narrowband"), "narrowband_composite").otherwise("broadband_rgb_osc"))
    action = (
        F.when(ch == 1, "skip_color_calibration").when(ch > 3, "preserve_input_review").when(lin == "nonlinear", "preserve_input").when((ch < 3) | (lin != "linear"), "preserve_input_review")
        .when(C("narrowband"), "narrowband_calibration").otherwise("broadband_calibration"))
    why = F.array_compact(F.array(
        F.when(ch > 3, "multichannel_layout_requires_explicit_channel_roles"), F.when(ch.isin(0, 2), "unsupported_or_unknown_channel_layout"), F.when(~lin.isin("linear", "nonlinear"), "transfer_state_unconfirmed")))
    return f.select("frame_id", layout.alias("layout"), spectral.alias("spectral"), comp.alias("composition"), lin.alias("transfer"), kind.alias("kind"), action.alias("action"), F.array_join(why, ",").alias("unsupported"))


def device_evidence(values: DataFrame, rel_limit: float = 0.05, accept: float = 0.90) -> DataFrame:
    """Chosen value per (frame, quantity) by priority and confidence, and whether evidence conflicts.

    values(frame_id, quantity, source, priority, confidence, value). A conflict is a
    confident value that differs from the chosen one by more than the relative limit:
    it is enough to compare the largest and smallest confident value with it.
    """
    best = F.max(F.struct("priority", "confidence", F.struct((-C("value")).alias("nv"), "source", "value").alias("x"))).alias("b")
    ok = F.when(C("confidence") >= 0.5, C("value"))
    g = values.groupBy("frame_id", "quantity").agg(best, F.max(ok).alias("hi"), F.min(ok).alias("lo"), F.count("*").alias("candidates"))
    v = C("b.x.value")
    far = lambda c: F.abs(C(c) - v) > F.abs(v) * rel_limit
    g = g.select("frame_id", "quantity", C("b.x.source").alias("source"), v.alias("value"), C("b.confidence").alias("confidence"), "candidates", F.coalesce(far("hi") | far("lo"), F.lit(False)).alias("conflict"))
    return g.withColumn("applied", ~C("conflict") & (C("confidence") >= accept))


# Known instruments (fixed values): id, focal length in mm, pixel size in um, names, words that rule it out.
DEVICES = [
    ("seestar_s30_pro_imx585", 160.0, 2.9, ("zwo seestar s30 pro", "seestar s30 pro", "s30 pro"), ()),
    ("seestar_s30_imx662", 150.0, 2.9, ("zwo seestar s30", "seestar s30", "s30"), ("pro",)),
    ("seestar_s50_imx462", 250.0, 2.9, ("zwo seestar s50", "seestar s50", "s50"), ()),
    ("dwarflab_dwarf_mini_imx662", 150.0, 2.9, ("dwarflab dwarf mini", "dwarf mini", "dwarfmini"), ()),
    ("dwarflab_dwarf_3_imx678", 150.0, 2.0, ("dwarflab dwarf 3", "dwarf 3", "dwarf iii", "dwarfiii", "dwarf3"), ()),
    ("dwarflab_dwarf_2_imx415", 100.0, 1.45, ("dwarflab dwarf 2", "dwarf 2", "dwarf ii", "dwarfii", "dwarf2"), ()),
]


def device_profile_match(frames: DataFrame) -> DataFrame:
    """Known instrument of each frame from its identity text; wide-camera frames match none.

    Profiles are tried in their order and the first that fits is taken. Names of up to three
    characters have to begin the text as a word of their own, longer ones may stand anywhere.
    The list is a literal, so the match is a projection.
    """
    t = F.trim(F.regexp_replace(F.lower(F.coalesce("identity", F.lit(""))), r"[^a-z0-9]+", " "))
    wide = t.rlike("wide ?angle") | F.coalesce(C("focal") < 30.0, F.lit(False))
    named = lambda n: (t == n) | t.startswith(n + " ") if len(n) <= 3 else t.contains(n)
    hits = []
    for profile, focal, pixel, names, without in DEVICES:
        fits = F.lit(False)
        for n in names:
            fits = fits | named(n)
        for n in without:
            fits = fits & ~F.array_contains(F.split(t, " "), n)
        hits.append(F.when(fits, F.struct(F.lit(profile).alias("profile"), F.lit(focal).alias("focal_mm"), F.lit(pixel).alias("pixel_um"))))
    best = F.coalesce(*hits)
    f = frames.select("frame_id", F.when(~wide, best).alias("b"))
    return f.where(C("b").isNotNull()).select("frame_id", C("b.profile").alias("profile"), C("b.focal_mm").alias("focal_mm"), C("b.pixel_um").alias("pixel_um"))
