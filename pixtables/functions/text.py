"""Text, angle and settings expressions on header and configuration values."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

C = F.col


def parse_angle(text: Column, is_ra: bool) -> Column:
    """Degrees from a number (hours to degrees for 0..24 when RA) or a sexagesimal text; null if neither."""
    t = F.regexp_replace(F.trim(text), "^['\"]+|['\"]+$", "")
    num = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    plain = F.when(num.between(0.0, 24.0), num * 15.0).otherwise(num) if is_ra else num
    marks = F.regexp_replace(F.regexp_replace(t, "[hm]", ":"), "s", "")
    parts = F.filter(F.split(marks, r"[:\s]+"), lambda p: p != "")
    val = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    third = F.when(F.size(parts) > 2, val(2)).otherwise(F.lit(0.0))
    deg = F.abs(val(0)) + val(1) / 60.0 + third / 3600.0
    sexa = deg * 15.0 if is_ra else F.when(F.get(parts, F.lit(0)).startswith("-"), -deg).otherwise(deg)
    return F.when(t == "", None).when(num.isNotNull(), plain).when(F.size(parts) >= 2, sexa)


def angular_distance(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees."""
    d1, d2, dr = F.radians(dec1), F.radians(dec2), F.radians(ra1) - F.radians(ra2)
    cosd = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(dr)
    return F.degrees(F.acos(F.least(F.greatest(cosd, F.lit(-1.0)), F.lit(1.0))))


def plate_scale(h: dict[str, Column]) -> Column:
    """Arcsec per pixel: direct key, CD matrix, CDELT, else pixel size and focal length."""
    direct = F.coalesce(h["SECPIX"], h["PIXSCALE"])
    z = lambda c: F.coalesce(h[c], F.lit(0.0))
    a = F.when(h["CD1_1"].isNotNull() | h["CD2_1"].isNotNull(), F.hypot(z("CD1_1"), z("CD2_1")) * 3600.0)
    b = F.when(h["CD1_2"].isNotNull() | h["CD2_2"].isNotNull(), F.hypot(z("CD1_2"), z("CD2_2")) * 3600.0)
    cd = F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2.0).otherwise(F.coalesce(a, b))
    e = lambda c: F.when(h[c] != 0, F.abs(h[c]) * 3600.0)
    de = F.when(e("CDELT1").isNotNull() & e("CDELT2").isNotNull(), (e("CDELT1") + e("CDELT2")) / 2.0).otherwise(F.coalesce(e("CDELT1"), e("CDELT2")))
    opt = F.when((h["XPIXSZ"] > 0) & (h["FOCALLEN"] > 0), F.lit(206.264806) * h["XPIXSZ"] / h["FOCALLEN"])
    return F.coalesce(direct, cd, de, opt)


def axis_scales(h: dict[str, Column]) -> tuple[Column, Column]:
    """Degrees per pixel of either axis: CDELT of both, else the whole CD matrix, else pixel sizes and focal length.

    The first source that is complete is taken, plausible or not.
    """
    known = lambda *names: F.lit(True) if not names else h[names[0]].isNotNull() & known(*names[1:])
    delt, cd = known("CDELT1", "CDELT2"), known("CD1_1", "CD2_1", "CD1_2", "CD2_2")
    opt = (h["XPIXSZ"] > 0) & (h["YPIXSZ"] > 0) & (h["FOCALLEN"] > 0)
    lens = lambda c: F.lit(206.264806) * h[c] / h["FOCALLEN"] / 3600.0
    return (
        F.when(delt, F.abs(h["CDELT1"])).when(cd, F.hypot(h["CD1_1"], h["CD2_1"])).when(opt, lens("XPIXSZ")),
        F.when(delt, F.abs(h["CDELT2"])).when(cd, F.hypot(h["CD1_2"], h["CD2_2"])).when(opt, lens("YPIXSZ")),
    )


def field_radius(width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """Half diagonal of the field in degrees where size and both scales (degrees per pixel) are plausible."""
    r = F.lit(0.5) * F.hypot(width * scale_x, height * scale_y)
    return F.when((width > 0) & (height > 0) & scale_x.between(1e-7, 0.1) & scale_y.between(1e-7, 0.1) & r.between(0.05, 10.0), r)


def normal_filter(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    for a, b in (("hα", "ha"), ("oⅲ", "oiii"), ("oxygen iii", "oiii"), ("hydrogen alpha", "ha")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


# Filter phrases by class (fixed values).
MULTIBAND = ("tri band", "triband", "quad band", "quadband", "multi band", "multiband")
BROADBAND = ("no filter", "no lp", "without lp", "lp off", "ircut", "ir cut", "uv ir", "uv ir cut", "uv ir block", "astro", "vis", "clear", "broadband", "astro filter")
DUAL_GENERIC = ("dual band", "dualband", "duo band", "duoband")
VERIFIED = (
    "zwo duo band", "zwo dual band", "optolong l extreme", "l extreme", "lextreme", "optolong l ultimate", "l ultimate", "lultimate",
    "optolong l para", "l para", "lpara", "idas nbz", "idas nbz ii", "nbz", "nbz ii", "nbzii", "svbony sv220", "sv220",
)
LP_VALUES = ("lp", "lp starless")


def _phrase(t: Column, phrases: tuple[str, ...]) -> Column:
    return F.concat(F.lit(" "), t, F.lit(" ")).rlike(" (" + "|".join(phrases) + ") ")


def has_ha(t: Column) -> Column:
    c = F.replace(t, F.lit(" "), F.lit(""))
    return t.rlike("(^| )ha( |$)") | c.rlike("halpha|6563|65628")


def has_oiii(t: Column) -> Column:
    c = F.replace(t, F.lit(" "), F.lit(""))
    return c.rlike("oiii|5007|50070") | t.rlike("(^| )o3( |$)")


def has_sii(t: Column) -> Column:
    c = F.replace(t, F.lit(" "), F.lit(""))
    return c.rlike("sii|6724") | t.rlike("(^| )s2( |$)")


def filter_category(t: Column) -> Column:
    """Class of one normalised filter text; the order of the tests is the meaning."""
    ha, o3 = has_ha(t), has_oiii(t)
    return (
        F.when(t == "", "unknown").when(has_sii(t) | _phrase(t, MULTIBAND), "conflicting_lines").when(_phrase(t, BROADBAND), "broadband")
        .when((ha & o3) | _phrase(t, ("hoo",)), "explicit_hoo").when(_phrase(t, VERIFIED), "verified_filter").when(ha | o3, "single_line")
        .when(t.isin(*LP_VALUES), "authoritative_lp").when(_phrase(t, DUAL_GENERIC), "generic_dualband").otherwise("unknown")
    )


def task_slug(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    slug = F.regexp_replace(F.substring(F.array_join(words, "-"), 1, 48), "^-+|-+$", "")
    return F.when(slug == "", "task").otherwise(slug)


def safe_token(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9._-]+", "_"), "^[_.]+|[_.]+$", "")


def output_name(obj: Column, stack: Column, exposure: Column, date: Column, linear: Column) -> Column:
    """File stem from metadata; parts that do not validate are left out, no object gives null."""
    name = safe_token(obj)
    n = stack.try_cast("double")
    e = exposure.try_cast("double")
    whole = F.when(e == F.floor(e), F.floor(e).cast("string")).otherwise(F.replace(F.format_string("%.2f", e), F.lit("."), F.lit("p")))
    digits = F.regexp_replace(F.coalesce(date, F.lit("")), "[^0-9]+", "")
    day = F.when(F.length(digits) >= 14, F.concat(F.substring(digits, 1, 8), F.lit("_"), F.substring(digits, 9, 6))).when(F.length(digits) >= 8, F.substring(digits, 1, 8))
    stem = F.concat_ws(
        "_", name, F.when(n >= 1, F.concat(F.floor(n).cast("string"), F.lit("x"))), F.when(e > 0, F.concat(whole, F.lit("sec"))), day, F.lit("processed"),
        F.when(linear, F.lit("linear")))
    return F.when(name != "", stem)


SENSITIVE = "api_key|token|secret|password|credential"


def redact(pairs: Column) -> Column:
    """Values under sensitive keys of a flattened map are replaced; a key path counts as a whole."""
    return F.transform_values(pairs, lambda k, v: F.when(F.lower(k).rlike(SENSITIVE), F.when(F.coalesce(v, F.lit("")) != "", "<redacted>").otherwise("")).otherwise(v))


PROFILE_FACTOR = {"standard": 1.0, "relaxed": 3.0, "unlimited": 10.0}


def scaled_limit(base: Column, direction: Column, is_int: Column, factor: Column) -> Column:
    """Limit of a gate profile: up, down or from one; whole numbers round to the lenient side."""
    up, down, one = base * factor, base / factor, F.lit(1.0) + (base - 1.0) * factor
    raw = F.when(direction == "upper", up).when(direction == "lower", down).when(direction == "upper_from_one", one).otherwise(base)
    return F.when(is_int & (direction == "lower"), F.floor(raw).cast("double")).when(is_int & direction.isin("upper", "upper_from_one"), F.ceil(raw).cast("double")).otherwise(raw)


def filter_authority(values: DataFrame) -> DataFrame:
    """Selected and ignored filter headers per frame(frame_id, key, value): FILTER wins unless unknown.

    A frame carries a handful of filter cards at most (one row per key), so the
    array per frame is bounded by the number of known keys.
    """
    v = values.withColumn("norm", normal_filter(C("value"))).where(C("norm") != "").withColumn("category", filter_category(C("norm")))
    g = v.groupBy("frame_id").agg(
        F.max(F.when(C("key") == "FILTER", C("category"))).alias("primary_category"),
        F.array_sort(F.collect_set(F.struct("key", "norm", "category"))).alias("cards"))
    authoritative = F.coalesce(C("primary_category") != "unknown", F.lit(False))
    chosen = F.filter("cards", lambda c: F.when(authoritative, c["key"] == "FILTER").otherwise((c["key"] != "FILTER") & (c["category"] != "unknown")))
    names = lambda a: F.array_join(F.transform(a, lambda c: F.concat(c["key"], F.lit(":"), c["category"])), ",")
    g = g.withColumn("_sel", chosen)
    ignored = F.array_except(C("cards"), C("_sel"))
    why = F.transform(ignored, lambda c: F.concat(c["key"], F.lit(":"), F.when(authoritative, "authoritative_filter_selected").when(c["key"] == "FILTER", "unrecognized_primary_filter").otherwise("unrecognized_supplemental_filter")))
    source = F.when(authoritative, "authoritative_filter").when(F.size("_sel") > 0, "supplemental_fallback").otherwise("none")
    return g.select("frame_id", source.alias("source"), names(C("_sel")).alias("selected"), F.array_join(why, ",").alias("ignored"), F.transform("_sel", lambda c: c["category"]).alias("categories"),
                    F.array_join(F.transform("_sel", lambda c: c["norm"]), " ").alias("selected_text"))


def narrowband_mapping(authority: DataFrame) -> DataFrame:
    """Ha/OIII channel contract with confidence and evidence class from the selected filter headers."""
    has = lambda n: F.array_contains("categories", n)
    narrow = F.arrays_overlap("categories", F.array(*[F.lit(n) for n in ("conflicting_lines", "explicit_hoo", "verified_filter", "single_line", "authoritative_lp", "generic_dualband")]))
    t = C("selected_text")
    evidence = (
        F.when(has("conflicting_lines"), "conflicting_filter_lines").when(has("broadband") & narrow, "conflicting_filter_fields").when(has("broadband"), "explicit_broadband_filter")
        .when(has("explicit_hoo") | (has_ha(t) & has_oiii(t)), "explicit_lines").when(has("verified_filter"), "verified_filter_profile")
        .when(has("single_line"), "incomplete_lines").when(has("authoritative_lp"), "authoritative_lp").when(has("generic_dualband"), "generic_dualband").otherwise("no_filter_evidence"))
    mapped = evidence.isin("explicit_lines", "verified_filter_profile", "authoritative_lp")
    conf = F.when(evidence == "explicit_lines", 0.98).when(evidence == "verified_filter_profile", 0.95).when(evidence == "authoritative_lp", 0.80).otherwise(F.lit(0.0))
    return authority.select("frame_id", F.when(mapped, "Ha=R;OIII=G+B").otherwise("unknown").alias("mapping"), conf.alias("confidence"), evidence.alias("evidence"))
