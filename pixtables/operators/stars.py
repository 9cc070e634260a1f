"""Star catalogues: spatial matching, apertures, sizes, halos, sky catalogues."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import clamp
from ..functions.text import angular_distance
from ..session import cut, saved, tasks_for
from .components import connected_components
from .quantiles import quantiles, robust_sigma, with_quantiles

C = F.col


def radius_pairs(a: DataFrame, b: DataFrame, r: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (sid, tid, dist) of a(sid,x,y) and b(tid,x,y) within ``r``.

    Cells of side ``r`` are equi keys; the left side is sent to its 3x3 cells, so the
    radial test never becomes a nested loop.
    """
    keys = list(keys)
    cell = lambda c: F.floor(C(c) / F.lit(float(r))).cast("long")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(*keys, "sid", C("x").alias("_ax"), C("y").alias("_ay"), cell("x").alias("_i"), cell("y").alias("_j"), F.explode(near).alias("_n"))
    left = left.select(*keys, "sid", "_ax", "_ay", (C("_i") + C("_n.i")).alias("_cx"), (C("_j") + C("_n.j")).alias("_cy"))
    right = b.select(*keys, "tid", C("x").alias("_bx"), C("y").alias("_by"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    dx, dy = C("_ax") - C("_bx"), C("_ay") - C("_by")
    joined = left.join(right, [*keys, "_cx", "_cy"]).withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return joined.where(C("dist") <= r).select(*keys, "sid", "tid", "dist")


def _best(pairs: DataFrame, keys: list[str], side: str, other: str) -> DataFrame:
    return pairs.groupBy(*keys, side).agg(F.min(F.struct("dist", "sid", "tid")).alias("m")).select(*keys, C("m.dist").alias("dist"), C("m.sid").alias("sid"), C("m.tid").alias("tid"))


def star_crossmatch(a: DataFrame, b: DataFrame, r: float, keys: Sequence[str] = (), steps: Sequence[float] = (0.125, 0.5, 1.0), rounds: int = 200) -> DataFrame:
    """One-to-one matches within ``r`` in global order (distance, source id, target id).

    Three devices keep dense spots cheap without changing the result of the greedy order:

    * equal positions first: the i-th source at a position takes the i-th target there,
      which is what the order (0, sid, tid) does, so copies never form pairs;
    * the radius grows: all pairs below a smaller radius precede all others in the
      order, so they are settled first and their stars leave before cells widen;
    * in each round a pair is taken that is first for its source and for its target.
      The order is total, so these are exactly pairs the greedy walk takes.
    """
    keys = list(keys)
    w = W.partitionBy(*keys, "x", "y")
    a = a.select(*keys, "sid", "x", "y").withColumn("_rn", F.row_number().over(w.orderBy("sid")))
    b = b.select(*keys, "tid", "x", "y").withColumn("_rn", F.row_number().over(w.orderBy("tid")))
    same = a.join(b, [*keys, "x", "y", "_rn"]).select(*keys, "sid", "tid", F.lit(0.0).alias("dist"))
    done = cut(same)
    for part in steps:
        left = a.join(done, [*keys, "sid"], "left_anti")
        right = b.join(done, [*keys, "tid"], "left_anti")
        pairs = cut(radius_pairs(left, right, r * part, keys))
        for _ in range(rounds):
            s, t = _best(pairs, keys, "sid", "tid"), _best(pairs, keys, "tid", "sid")
            taken = cut(s.join(t, [*keys, "sid", "tid", "dist"]).select(*keys, "sid", "tid", "dist"))
            if taken.limit(1).count() == 0:
                break
            done = done.unionByName(taken)
            pairs = cut(pairs.join(taken.select(*keys, "sid"), [*keys, "sid"], "left_anti").join(taken.select(*keys, "tid"), [*keys, "tid"], "left_anti"))
        else:
            raise RuntimeError("matching did not settle")
        done = cut(done)
    return done


def formal_set(stars: DataFrame, share: float = 0.20, minimum: int = 16) -> DataFrame:
    """Brightest share of a catalogue, at least ``minimum`` objects, by flux then id.

    The cut flux is an exact quantile-like rank found with bucket counts; only rows
    that tie with it are ordered.
    """
    n = stars.agg(F.count("*").alias("n")).withColumn("k", F.greatest(F.lit(minimum), F.ceil(C("n") * F.lit(share))).cast("long"))
    b = stars.withColumn("_b", F.floor(F.log1p("flux") * 256.0).cast("long"))
    hist = b.groupBy("_b").agg(F.count("*").alias("_c"))
    hist = hist.withColumn("_above", F.sum("_c").over(W.orderBy(F.desc("_b"))) - C("_c"))
    rows = b.join(hist, "_b").join(n, F.lit(True)).where(C("_above") < C("k"))
    inner = F.row_number().over(W.partitionBy("_b").orderBy(F.desc("flux"), "star_id")) + C("_above")
    return rows.withColumn("_r", inner).where(C("_r") <= C("k")).drop("_b", "_c", "_above", "n", "k", "_r")


def three_role(stars: DataFrame, fwhm: float) -> DataFrame:
    """Recovery of catalogue C (formal set) in O, and of O in C, with the fixed limits."""
    r = max(2.0, min(4.0, 0.75 * fwhm))
    src = lambda role: stars.where(C("role") == role).select(C("star_id").alias("sid"), "x", "y")
    tgt = lambda role: stars.where(C("role") == role).select(C("star_id").alias("tid"), "x", "y")
    formal = formal_set(stars.where(C("role") == "C")).select(C("star_id").alias("sid"), "x", "y")
    runs = {"formal_C_to_O": (formal, tgt("O")), "O_to_C": (src("O"), tgt("C")), "O_to_B": (src("O"), tgt("B"))}
    out = None
    for name, (a, b) in runs.items():
        m = star_crossmatch(a, b, r).withColumn("pair", F.lit(name))
        q = quantiles(m, ["pair"], [(C("dist"), {"dist_p50": 0.5, "dist_p95": 0.95})], whole=False)
        row = a.agg(F.count("*").alias("sources")).withColumn("pair", F.lit(name)).join(q, "pair", "left")
        out = row if out is None else out.unionByName(row)
    ratio = F.coalesce(C("n_dist_p50"), F.lit(0)) / C("sources")
    need = F.when(C("pair") == "formal_C_to_O", (ratio >= 0.75) & (C("dist_p50") <= 0.75) & (C("dist_p95") <= 1.50)).when(C("pair") == "O_to_C", (ratio >= 0.30) & (C("sources") >= 32)).otherwise(F.lit(True))
    return out.select("pair", "sources", F.coalesce(C("n_dist_p50"), F.lit(0)).alias("matches"), ratio.alias("ratio"), "dist_p50", "dist_p95", F.coalesce(need, F.lit(False)).alias("passed"))


def triple_join(stars: DataFrame) -> DataFrame:
    """Stars present in O, B and C on one row each."""
    v = lambda role: stars.where(C("role") == role).select("star_id", *[C(c).alias(f"{c}_{role.lower()}") for c in ("x", "y", "flux")])
    return v("O").join(v("B"), "star_id").join(v("C"), "star_id")


def aperture_join(stars: DataFrame, pix: DataFrame, radius: Column, largest: int, key: str = "image_id") -> DataFrame:
    """Pixels within ``radius`` (at most ``largest``) of each star, with their distance.

    A star is exploded into the pixel positions of its bounding square.
    """
    off = F.sequence(F.lit(-largest), F.lit(largest))
    s = stars.select(key, "point_id", C("y").alias("py"), C("x").alias("px"), radius.alias("_rad"), F.explode(off).alias("_dy"))
    s = s.where(F.abs("_dy") <= C("_rad")).select("*", F.explode(off).alias("_dx"))
    s = s.withColumn("d", F.sqrt((C("_dy") * C("_dy") + C("_dx") * C("_dx")).cast("double"))).where(C("d") <= C("_rad"))
    s = s.withColumns({"y": C("py") + C("_dy"), "x": C("px") + C("_dx")})
    return s.join(pix, [key, "y", "x"]).drop("_rad")


def outside_apertures(pix: DataFrame, joined: DataFrame, key: str = "image_id") -> DataFrame:
    return pix.join(joined.select(key, "y", "x").distinct(), [key, "y", "x"], "left_anti")


def scale_resolution(samples: DataFrame, minimum: int = 4) -> DataFrame:
    """FWHM of the first source (by priority) with at least ``minimum`` samples per image."""
    g = quantiles(samples, ["image_id", "source", "priority"], [(C("fwhm"), {"fwhm": 0.5})]).where(C("n_fwhm") >= minimum)
    best = g.groupBy("image_id").agg(F.min(F.struct("priority", "source", "fwhm", "n_fwhm")).alias("b")).select("image_id", "b.*")
    return best.select("image_id", "source", "fwhm", C("n_fwhm").alias("samples"), (C("priority") > 0).alias("review"), F.ceil(C("fwhm") * 1.5).cast("int").alias("inner_radius"), F.ceil(C("fwhm") * 3.0).cast("int").alias("outer_radius"))


def psf_closure(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size ratio candidate/source (fwhm0, fwhm1, flux) for all, weak and bright stars.

    u95 joins the robust standard error of the ratios with the half-pixel error of the areas.
    """
    keys = list(keys)
    p = with_quantiles(pairs, keys, [(C("flux"), {"_f": 0.5})], whole=False)
    grp = F.explode(F.array(F.lit("all"), F.when(C("flux") < C("_f"), "weak").otherwise("bright")))
    p = p.select(*keys, grp.alias("grp"), (C("fwhm1") / C("fwhm0")).alias("ratio"))
    s = robust_sigma(p, [*keys, "grp"], {"r": C("ratio")}, minimum=1, whole=False)
    u = F.lit(1.96 * 1.858 / 1.4826) * C("r_sigma") / F.sqrt(C("r_n"))
    band = F.when(~C("r_med").between(0.93, 1.10), "hard_failed").when(~C("r_med").between(0.97, 1.05), "soft_warning").otherwise("ok")
    return s.select(*keys, "grp", C("r_n").alias("stars"), C("r_med").alias("ratio"), u.alias("u95"), band.alias("status"))


def star_visibility(stars: DataFrame, pix: DataFrame, inner: int, outer: int, key: str = "image_id") -> DataFrame:
    """Share of stars whose contrast (inner max - outer median) keeps half of the reference (l against l2)."""
    off = F.sequence(F.lit(-outer), F.lit(outer))
    s = stars.select(key, "point_id", C("y").alias("py"), C("x").alias("px"), F.explode(off).alias("_dy")).select("*", F.explode(off).alias("_dx"))
    s = s.withColumns({"y": C("py") + C("_dy"), "x": C("px") + C("_dx"), "_in": F.greatest(F.abs("_dy"), F.abs("_dx")) <= inner})
    j = s.join(pix, [key, "y", "x"])
    g = [key, "point_id"]
    q = quantiles(j, g, [(F.when(~C("_in"), C("l")), {"o0": 0.5}), (F.when(~C("_in"), C("l2")), {"o1": 0.5})], whole=True)
    m = j.groupBy(*g).agg(F.max(F.when(C("_in"), C("l"))).alias("i0"), F.max(F.when(C("_in"), C("l2"))).alias("i1"))
    c = q.join(m, g).withColumns({"c0": C("i0") - C("o0"), "c1": C("i1") - C("o1")}).where(C("c0") > 0)
    c = with_quantiles(c, [key], [(C("c0"), {"_med": 0.5})])
    seen = (C("c1") >= C("c0") * 0.5).cast("int")
    weak = C("c0") <= C("_med")
    return c.groupBy(key).agg(F.count("*").alias("stars"), F.avg(seen).alias("visible"), F.avg(F.when(weak, seen)).alias("weak_visible"))


def halfmax_fwhm(stars: DataFrame, grid: DataFrame, search: int, patch: int, width: int, key: str = "image_id") -> DataFrame:
    """Connected half-maximum area around the brightest pixel near each star; 2*sqrt(area/pi)."""
    g = [key, "point_id"]
    near = aperture_square(stars, grid, search, key)
    peak = near.groupBy(*g).agg(F.max(F.struct("l", -C("y"), -C("x"))).alias("p"), F.count("*").alias("_n"))
    peak = peak.select(*g, C("p.l").alias("peak"), (-C("p.col2")).alias("y"), (-C("p.col3")).alias("x"))
    sq = aperture_square(peak, grid, patch, key).withColumn("d", F.sqrt(((C("y") - C("py")) * (C("y") - C("py")) + (C("x") - C("px")) * (C("x") - C("px"))).cast("double")))
    sq = sq.join(peak.select(*g, "peak"), g)
    ring = F.when((C("d") >= max(1.0, patch * 2.0 / 3.0)) & (C("d") <= patch), C("l"))
    sq = with_quantiles(sq, g, [(ring, {"bg": 0.5})], whole=True)
    sq = with_quantiles(sq, g, [(F.abs(ring - C("bg")), {"mad": 0.5})], whole=True)
    sq = sq.withColumn("signal", C("peak") - C("bg"))
    sq = sq.withColumn("ok", C("signal") > F.greatest(F.lit(4.0 * 1.4826) * C("mad"), F.lit(4e-7), F.lit(1e-6)))
    lab = connected_components(sq, g, C("ok") & (C("l") >= C("bg") + C("signal") * 0.5), width)
    a = lab.groupBy(*g, "label").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    box = sq.groupBy(*g).agg(F.min("y").alias("by0"), F.max("y").alias("by1"), F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.bool_or("ok").alias("ok"), F.max("signal").alias("signal"), F.first("py").alias("py"), F.first("px").alias("px"))
    at_peak = box.join(lab, g).where((C("y") == C("py")) & (C("x") == C("px"))).select(*g, "label")
    out = box.join(at_peak, g, "left").join(a, [*g, "label"], "left")
    touch = (C("y0") == C("by0")) | (C("y1") == C("by1")) | (C("x0") == C("bx0")) | (C("x1") == C("bx1"))
    status = F.when(~C("ok"), "signal_insufficient").when(C("area").isNull(), "core_absent").when(touch, "touches_boundary").otherwise("ok")
    return out.select(*g, C("py").alias("peak_y"), C("px").alias("peak_x"), "signal", status.alias("status"), F.when(status == "ok", F.lit(2.0) * F.sqrt(C("area") / F.pi())).alias("fwhm"))


def aperture_square(stars: DataFrame, pix: DataFrame, r: int, key: str = "image_id") -> DataFrame:
    off = F.sequence(F.lit(-r), F.lit(r))
    s = stars.select(key, "point_id", C("y").alias("py"), C("x").alias("px"), F.explode(off).alias("_dy")).select("*", F.explode(off).alias("_dx"))
    s = s.withColumns({"y": C("py") + C("_dy"), "x": C("px") + C("_dx")})
    return s.join(pix, [key, "y", "x"]).drop("_dy", "_dx")


def halo_ring_audit(stars: DataFrame, pix: DataFrame, core: float, ring: float, control: float, key: str = "image_id") -> DataFrame:
    """Ring against control ring in robust sigmas for texture and chroma, with 8-sector coherence.

    pix carries ``texture`` and ``chroma``.
    """
    g = [key, "point_id"]
    j = aperture_join(stars, pix, F.lit(control), int(control), key).where(C("d") > core)
    j = j.withColumn("zone", F.when(C("d") <= ring, "ring").otherwise("control"))
    ctl = robust_sigma(j, g, {c: F.when(C("zone") == "control", C(c)) for c in ("texture", "chroma")}, minimum=1, whole=True)
    rg = quantiles(j, g, [(F.when(C("zone") == "ring", C(c)), {f"{c}_ring": 0.5}) for c in ("texture", "chroma")], whole=True)
    sector = F.least(F.floor((F.atan2((C("y") - C("py")).cast("double"), (C("x") - C("px")).cast("double")) + F.pi()) / (F.pi() / 4.0)), F.lit(7))
    sec = quantiles(j.where(C("zone") == "ring").withColumn("sector", sector), [*g, "sector"], [(C("texture"), {"st": 0.5}), (C("chroma"), {"sc": 0.5})], whole=True).where(C("n_st") >= 2)
    sec = sec.join(ctl, g)
    high = (C("st") > C("texture_med") + F.lit(3.0) * F.greatest("texture_sigma", F.lit(1e-6))) | (C("sc") > C("chroma_med") + F.lit(3.0) * F.greatest("chroma_sigma", F.lit(1e-6)))
    co = sec.groupBy(*g).agg(F.count("*").alias("sectors"), F.count_if(high).alias("high"))
    out = rg.join(ctl, g).join(co, g, "left").where((C("n_texture_ring") >= 8) & (C("texture_n") >= 8))
    z = lambda c: (C(f"{c}_ring") - C(f"{c}_med")) / F.greatest(C(f"{c}_sigma"), F.lit(1e-6))
    coh = F.coalesce(C("high") / C("sectors"), F.lit(0.0))
    return out.select(*g, z("texture").alias("texture_z"), z("chroma").alias("chroma_z"), coh.alias("coherence"), ((F.greatest(z("texture"), z("chroma")) > 3.0) & (coh >= 0.5)).alias("hard_anomaly"))


def local_star_guard(stars: DataFrame, pix: DataFrame, key: str = "image_id") -> DataFrame:
    """Core, inner and outer ring changes and centroid shift of fixed stars before (l) and after (l2)."""
    g = [key, "point_id"]
    j = aperture_join(stars, pix, F.lit(5.0), 5, key).withColumn("delta", C("l2") - C("l"))
    zone = F.when(C("d") <= 1.5, "core").when(C("d") <= 3.0, "inner").otherwise("outer")
    j = j.withColumn("zone", zone)
    q = quantiles(j, g, [
        (F.when(C("zone") == "core", C("delta")), {"core_delta": 0.5}), (F.when(C("zone") == "inner", C("delta")), {"ring_p05": 0.05, "ring_p95": 0.95}), (F.when(C("zone") == "outer", F.abs("delta")), {"outer_p95": 0.95})], whole=True)
    wsum = lambda c, v: F.sum(F.when(C("d") <= 3.0, C(c) * C(v))) / F.sum(F.when(C("d") <= 3.0, C(v)))
    cen = j.groupBy(*g).agg(*[wsum(a, v).alias(f"_{a}{v}") for a in ("y", "x") for v in ("l", "l2")])
    s = q.join(cen, g).withColumn("shift", F.sqrt((C("_yl") - C("_yl2")) * (C("_yl") - C("_yl2")) + (C("_xl") - C("_xl2")) * (C("_xl") - C("_xl2"))))
    bad = (C("ring_p95") > 0.05) | (C("ring_p05") < -0.15) | (C("shift") > 0.10)
    return s.groupBy(key).agg(F.count("*").alias("stars"), F.avg(bad.cast("int")).alias("failing_share"), F.max("shift").alias("max_shift"), F.max("outer_p95").alias("outer_p95"))


def star_ratio_stats(stars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median log ratios r/g and b/g, their MAD and the median neutral error."""
    keys = list(keys)
    s = stars.where((C("r") > 0) & (C("g") > 0) & (C("b") > 0)).select(*keys, F.ln(C("r") / C("g")).alias("rg"), F.ln(C("b") / C("g")).alias("bg"))
    d = with_quantiles(s, keys, [(C("rg"), {"rg_med": 0.5}), (C("bg"), {"bg_med": 0.5})])
    q = quantiles(d, keys, [
        (C("rg_med"), {"center_rg": 0.0}), (C("bg_med"), {"center_bg": 0.0}), (F.abs(C("rg") - C("rg_med")), {"mad_rg": 0.5}), (F.abs(C("bg") - C("bg_med")), {"mad_bg": 0.5}),
        (F.sqrt(C("rg") * C("rg") + C("bg") * C("bg")), {"neutral_error": 0.5})])
    return q.select(*keys, C("n_mad_rg").alias("samples"), "center_rg", "center_bg", "mad_rg", "mad_bg", F.greatest("mad_rg", "mad_bg").alias("max_mad"), "neutral_error")


def sigma_clip(stars: DataFrame, keys: Sequence[str], rounds: int = 3, minimum: int = 12, whole: bool | None = None) -> DataFrame:
    """Up to three rounds of 2.5 sigma on rg and bg; a group stops when stable or under ``minimum``.

    ``whole`` as in ``quantiles``, for groups of a bounded size."""
    keys = list(keys)
    d = stars.withColumn("in", F.lit(True))
    for _ in range(rounds):
        v = lambda c: F.when(C("in"), C(c))
        d = with_quantiles(d, keys, [(v("rg"), {"_mr": 0.5}), (v("bg"), {"_mb": 0.5})], whole).withColumnRenamed("n__mr", "_n").drop("n__mb")
        d = with_quantiles(d, keys, [(F.abs(v("rg") - C("_mr")), {"_sr": 0.5}), (F.abs(v("bg") - C("_mb")), {"_sb": 0.5})], whole).drop("n__sr", "n__sb")
        lim = lambda s: F.lit(2.5) * F.greatest(F.lit(1.4826) * C(s), F.lit(0.01))
        keep = (F.abs(C("rg") - C("_mr")) <= lim("_sr")) & (F.abs(C("bg") - C("_mb")) <= lim("_sb"))
        # a stable group keeps everything, so running the round again changes nothing
        d = d.withColumn("in", C("in") & (keep | (C("_n") < minimum))).drop("_mr", "_mb", "_sr", "_sb", "_n")
    return d


def _sky_pairs(sky: DataFrame, frames: DataFrame, share: float) -> DataFrame:
    """Frames with the sky objects within ``share`` of their tolerance; cells shrink with the share."""
    high, cells = 5.0 * share, round(36.0 / share)
    width = 360.0 / cells
    reach = C("_tol") * share
    top = F.least(F.abs("dec_deg") + reach, F.lit(90.0))
    wide = F.when(top >= 89.0, F.lit(180.0)).otherwise(F.least(F.degrees(F.asin(F.least(F.sin(F.radians(reach)) / F.cos(F.radians(top)), F.lit(1.0)))) + 0.01, F.lit(180.0)))
    band = lambda e: F.floor((e + 90.0) / high).cast("int")
    s = sky.withColumn("_w", wide).select("*", F.explode(F.sequence(band(C("dec_deg") - reach - 0.01), band(C("dec_deg") + reach + 0.01))).alias("_band"))
    lo, hi = F.floor((C("ra_deg") - C("_w")) / width), F.floor((C("ra_deg") + C("_w")) / width)
    s = s.select("*", F.explode(F.array_distinct(F.transform(F.sequence(lo, hi), lambda i: F.pmod(i, F.lit(cells))))).alias("_ra"))
    f = frames.select("frame_id", C("ra_deg").alias("fra"), C("dec_deg").alias("fdec"), band(C("dec_deg")).alias("_band"), F.pmod(F.floor(C("ra_deg") / width), F.lit(cells)).alias("_ra"))
    # a frame meets many objects, so tasks are sized by frames, not by the bytes before the join
    f = f.repartition(tasks_for(f, 20_000), "_band", "_ra")
    return f.join(s, ["_band", "_ra"]).withColumn("distance", angular_distance(C("fra"), C("fdec"), C("ra_deg"), C("dec_deg"))).where(C("distance") <= reach)


def sky_match(sky: DataFrame, frames: DataFrame) -> DataFrame:
    """Best catalogue object per frame by great-circle distance within its tolerance.

    Declination bands of 5 and right-ascension buckets of 10 degrees are equi keys. A
    sky object is sent to every bucket its tolerance circle can touch (all of them near
    a pole); right ascension wraps by modulo. The score falls with distance over tolerance
    alone, so where the catalogue is dense, frames are first matched within a small share
    of the tolerance over finer cells, and only those without a match there look further:
    a frame meets a few objects however long the catalogue is.
    """
    tol = F.greatest(F.lit(1.2), C("size_arcmin") / 120.0 * 1.35 + 0.35)
    sky = sky.select("sky_id", "name", "ra_deg", "dec_deg", tol.alias("_tol"))
    shares, in_cell = [1.0], sky.count() / 825.0  # objects in a cell of 50 of the 41,253 square degrees
    while in_cell > 16 and len(shares) < 8:
        shares, in_cell = [shares[0] * 0.4, *shares], in_cell * 0.16
    score = F.greatest(F.lit(0.78), F.least(F.lit(0.98), F.lit(0.98) - C("distance") / F.greatest("_tol", F.lit(1e-6)) * 0.18))
    best = F.min(F.struct((-score).alias("s"), C("sky_id"), C("name"), C("distance"))).alias("b")
    out, left = None, frames.select("frame_id", "ra_deg", "dec_deg")
    for share in shares:
        found = _sky_pairs(sky, left, share).groupBy("frame_id").agg(best).select("frame_id", C("b.sky_id").alias("sky_id"), C("b.name").alias("name"), (-C("b.s")).alias("score"), C("b.distance").alias("distance"))
        if share < 1.0:
            # whatever lies beyond the share scores less; a match at its very edge looks further
            found = saved(found.where(C("score") > 0.98 - 0.18 * (share - 1e-6)), "sky")
            done = found.select(C("frame_id").alias("_done"))
            left = left.join(done, C("frame_id").eqNullSafe(C("_done")), "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


IDENTIFIER = r"^(m|ngc|ic|caldwell|barnard)[\s_-]*(\d+)$"


def name_match(sky: DataFrame, frames: DataFrame) -> DataFrame:
    """Best catalogue name per frame text: 0.95 exact, 0.94 identifier, 0.90 contained, else by length share.

    sky(sky_id, names array). Names become lookup keys instead of a theta join: an
    identifier is found in the text by pattern and compared as ``prefix+number``; other
    names are looked up among the substrings of the text that have the length of some
    name (the distinct lengths are a short parameter list).
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    n = sky.select("sky_id", F.posexplode("names").alias("_pos", "name")).withColumns({"_low": F.lower(F.trim("name")), "_norm": norm(C("name"))}).where(C("_norm") != "")
    ident = C("_low").rlike(IDENTIFIER)
    ids = n.where(ident).select("sky_id", "_pos", F.concat(F.regexp_extract("_low", IDENTIFIER, 1), F.regexp_extract("_low", IDENTIFIER, 2)).alias("key"))
    t = frames.select("frame_id", F.lower("text").alias("_t"), norm(C("text")).alias("_tn")).where(C("_tn") != "")
    pat = r"(?<![a-z0-9])((?:m|ngc|ic|caldwell|barnard)[\s_-]*\d+)(?![a-z0-9])"
    found = t.select("frame_id", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(pat), 1))).alias("k")).select("frame_id", F.regexp_replace("k", r"[\s_-]", "").alias("key"))
    by_id = found.join(ids, "key").select("frame_id", "sky_id", "_pos", F.lit(0.94).alias("score"))
    plain = n.where(~ident)

    def contained(text: str, key: str, score: Column) -> DataFrame:
        lengths = [r[0] for r in plain.select(F.length(key)).distinct().collect()]  # a handful of numbers
        grams = F.array_distinct(F.flatten(F.array(*[
            F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(C(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>")) for k in lengths or [1]])))
        g = t.select("frame_id", F.length("_tn").alias("_len"), "_tn", F.explode(grams).alias(key))
        return g.join(plain.select("sky_id", "_pos", key), key).select("frame_id", "sky_id", "_pos", score.alias("score"))

    share = F.least(F.lit(0.88), F.lit(0.55) + F.length("_norm") / F.greatest(C("_len"), F.lit(1)))
    by_text = contained("_t", "_low", F.lit(0.90))
    by_norm = contained("_tn", "_norm", F.when(C("_norm") == C("_tn"), 0.95).otherwise(share))
    allm = by_id.unionByName(by_text).unionByName(by_norm).groupBy("frame_id", "sky_id", "_pos").agg(F.max("score").alias("score"))
    best = F.min(F.struct((-C("score")).alias("s"), "sky_id", "_pos")).alias("b")
    return allm.groupBy("frame_id").agg(best).select("frame_id", C("b.sky_id").alias("sky_id"), (-C("b.s")).alias("score"))


def identity(frames: DataFrame, by_name: DataFrame, by_sky: DataFrame, sky: DataFrame) -> DataFrame:
    """Corroborated, composite in the field, coordinate, name, conflict or visual identity per frame.

    Two different objects of one type make a composite when both lie within the frame's own
    ``field_radius`` (null: unknown, no composite); sky has a ``type`` per object.
    """
    n = by_name.select("frame_id", C("sky_id").alias("nid"), C("score").alias("ns"))
    s = by_sky.select("frame_id", C("sky_id").alias("cid"), C("score").alias("cs"), C("distance").alias("cd"))
    kindof = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    pos = sky.select(C("sky_id").alias("nid"), C("ra_deg").alias("nra"), C("dec_deg").alias("ndec"), kindof.alias("ntype"))
    kind = sky.select(C("sky_id").alias("cid"), kindof.alias("ctype"))
    j = frames.select("frame_id", "ra_deg", "dec_deg", "field_radius").join(n, "frame_id", "left").join(s, "frame_id", "left").join(pos, "nid", "left").join(kind, "cid", "left")
    nd = angular_distance(C("ra_deg"), C("dec_deg"), C("nra"), C("ndec"))
    j = j.withColumn("nd", nd)
    inside = (C("nd") <= C("field_radius") * 1.05) & (C("cd") <= C("field_radius") * 1.05) & (C("ntype") == C("ctype"))
    both = C("nid").isNotNull() & C("cid").isNotNull()
    status = (
        F.when(both & (C("nid") == C("cid")), "corroborated").when(both & inside, "composite_resolved").when(both & (C("ns") >= 0.90), "conflict")
        .when(both, "coordinate_resolved").when(C("nid").isNotNull(), "name_resolved").when(C("cid").isNotNull(), "coordinate_resolved").otherwise("visual_fallback"))
    picked = F.when(status.isin("corroborated", "composite_resolved", "name_resolved"), C("nid")).when(status == "coordinate_resolved", C("cid"))
    return j.select("frame_id", status.alias("status"), picked.alias("sky_id"))
