"""Queries over pixel noise."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import fixed
from ..operators import noise as op
from ..sources import fixtures as fx
from .registry import blur_sql, query, r6, with_views


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, fixed(F.col(c), digits))
    return df


# sky(image_id,y,x,r,g,b,l,sky,fb) from a luminance view
def sky_ctes(src: str) -> dict[str, str]:
    return {
        "gr": f"""SELECT p.*, coalesce(abs(p.l-a.l),0)+coalesce(abs(p.l-b2.l),0) AS grad FROM {src} p
          LEFT JOIN {src} a ON a.image_id=p.image_id AND a.y=p.y AND a.x=p.x-1
          LEFT JOIN {src} b2 ON b2.image_id=p.image_id AND b2.y=p.y-1 AND b2.x=p.x""",
        "lim": """SELECT image_id, quantile_cont(l,0.005) lo, quantile_cont(l,0.45) hi, quantile_cont(l,0.55) wide,
          quantile_cont(grad,0.65) gm, count(*) n FROM gr GROUP BY image_id""",
        "fb": """SELECT image_id, count(*) FILTER (l>=lo AND l<=hi AND grad<=gm) < greatest(128, floor(any_value(n)*0.01)) AS fb
          FROM gr JOIN lim USING (image_id) GROUP BY image_id""",
        "skyt": """SELECT gr.*, fb, CASE WHEN fb THEN l>=lo AND l<=wide ELSE l>=lo AND l<=hi AND grad<=gm END AS sky
          FROM gr JOIN lim USING (image_id) JOIN fb USING (image_id)""",
    }


def mad_sql(src: str, keys: str, cols: dict[str, str], minimum: int = 16) -> dict[str, str]:
    """CTEs mads (medians) and sigs (sigmas) of expressions over ``src``."""
    med = ", ".join(f"median({e}) AS {n}_med" for n, e in cols.items())
    sig = ", ".join(f"CASE WHEN count({e}) >= {minimum} THEN 1.4826e0*median(abs({e} - {n}_med)) ELSE 0e0 END AS {n}_sigma" for n, e in cols.items())
    return {
        "meds": f"SELECT {keys}, {med} FROM {src} GROUP BY {keys}",
        "sigs": f"SELECT {keys}, {sig} FROM {src} JOIN meds USING ({keys}) GROUP BY {keys}",
    }


_PLANES = {"luma": "l", "red": "r", "green": "g", "blue": "b", "r_g": "r-g", "b_g": "b-g"}


@query("luminance", with_views("lum", "SELECT image_id, y, x, l FROM lum"))
def luminance(spark, d):
    return op.with_luminance(fx.px(spark, d)).select("image_id", "y", "x", "l")


@query("background_mask", with_views("lum", f"SELECT image_id, y, x, {r6('grad')} AS grad, fb AS sky_fallback, sky FROM skyt", **sky_ctes("lum")))
def background_mask(spark, d):
    out = op.background_mask(op.with_luminance(fx.px(spark, d)))
    return rounded(out.select("image_id", "y", "x", "grad", "sky_fallback", "sky"), "grad")


@query("robust_sigma", with_views(
    "lum", f"SELECT image_id, {r6('l_med')} AS l_med, {r6('l_sigma')} AS l_sigma FROM meds JOIN sigs USING (image_id)", **mad_sql("lum", "image_id", {"l": "l"})))
def robust_sigma(spark, d):
    out = op.robust_sigma(op.with_luminance(fx.px(spark, d)), ["image_id"], {"l": F.col("l")})
    return rounded(out.select("image_id", "l_med", "l_sigma"), "l_med", "l_sigma")


@query("noise_report", with_views(
    "lum",
    "SELECT image_id, c.n AS sky_pixels, " + r6("c.cov") + " AS coverage, c.fb AS sky_fallback, " + r6("luma_med") + " AS sky_level, "
    + ", ".join(f"{r6(n + '_sigma')} AS {n}_sigma" for n in _PLANES)
    + ", CASE WHEN greatest(r_g_sigma, b_g_sigma) > greatest(luma_sigma*1.25e0, 1e-8) THEN 'chroma_first' ELSE 'luma_chroma_balanced' END AS mode "
    "FROM (SELECT image_id, count(*) FILTER (sky) n, avg(CASE WHEN sky THEN 1 ELSE 0 END) cov, any_value(fb) fb FROM skyt GROUP BY image_id) c "
    "JOIN meds USING (image_id) JOIN sigs USING (image_id)",
    **sky_ctes("lum"), onsky="SELECT * FROM skyt WHERE sky", **mad_sql("onsky", "image_id", _PLANES)))
def noise_report(spark, d):
    out = op.noise_report(fx.px(spark, d))
    return rounded(out, "coverage", "sky_level", *[f"{n}_sigma" for n in _PLANES])


@query("box_blur", with_views("dlum", f"SELECT image_id, y, x, {r6('l')} AS l_blur FROM b2", b2=blur_sql("dlum", "l", 2)))
def box_blur(spark, d):
    out = op.box_blur(op.with_luminance(fx.dense(spark, d)), {"l": "l_blur"}, 2)
    return rounded(out.select("image_id", "y", "x", "l_blur"), "l_blur")


_CASC = {
    "s1": blur_sql("dlum", "l r g b", 1), "s2": blur_sql("s1", "l r g b", 2), "s4": blur_sql("s2", "l r g b", 4),
}


@query("multiscale_detail", with_views(
    "dlum",
    f"SELECT d.image_id, d.y, d.x, {r6('d.l-s1.l')} AS l_d1, {r6('s1.l-s2.l')} AS l_d2, {r6('s2.l-s4.l')} AS l_d4, {r6('s4.l')} AS l_s "
    "FROM dlum d JOIN s1 USING (image_id,y,x) JOIN s2 USING (image_id,y,x) JOIN s4 USING (image_id,y,x)", **_CASC))
def multiscale_detail(spark, d):
    out = op.cascade(op.with_luminance(fx.dense(spark, d)).drop("r", "g", "b"), (1, 2, 4), ("l",))
    return rounded(out.select("image_id", "y", "x", "l_d1", "l_d2", "l_d4", "l_s"), "l_d1", "l_d2", "l_d4", "l_s")


_C6 = {"l": "l", "r": "r", "g": "g", "b": "b", "rg": "r-g", "bg": "b-g"}


@query("noise_model", with_views(
    "dlum",
    "SELECT image_id, radius, n AS sky_pixels, " + ", ".join(f"{r6(c + '_sigma')} AS {c}_sigma" for c in _C6) + f", {r6('e')} AS detail_energy "
    "FROM sigs JOIN (SELECT image_id, radius, count(*) n, avg(l*l) e FROM det GROUP BY ALL) USING (image_id, radius)",
    **sky_ctes("dlum"), **_CASC,
    det="SELECT s.image_id, s.y, s.x, q.radius, q.l, q.r, q.g, q.b FROM skyt s JOIN ("
        + " UNION ALL ".join(
            f"SELECT a.image_id, a.y, a.x, {r} AS radius, a.l-b.l AS l, a.r-b.r AS r, a.g-b.g AS g, a.b-b.b AS b FROM {p} a JOIN {n} b USING (image_id,y,x)"
            for r, p, n in ((1, "dlum", "s1"), (2, "s1", "s2"), (4, "s2", "s4")))
        + ") q USING (image_id, y, x) WHERE s.sky",
    **mad_sql("det", "image_id, radius", _C6)))
def noise_model(spark, d):
    out = op.noise_model(fx.dense(spark, d))
    return rounded(out, *[f"{c}_sigma" for c in op.COMPONENTS], "detail_energy")


@query("signal_noise_curve", with_views(
    "dlum",
    f"SELECT e.image_id, e.bin, {r6('e.a')} AS signal_min, {r6('e.b')} AS signal_max, coalesce(c.n,0) AS samples, {r6('coalesce(noise_sigma,0)')} AS noise_sigma "
    "FROM ed e LEFT JOIN (SELECT image_id, bin, count(*) n FROM binned GROUP BY ALL) c ON c.image_id=e.image_id AND c.bin=e.bin LEFT JOIN sigs s ON s.image_id=e.image_id AND s.bin=e.bin",
    s1=blur_sql("dlum", "l", 1),
    q="SELECT image_id, quantile_cont(l,[0,0.2,0.4,0.6,0.8,1]) q FROM dlum GROUP BY image_id",
    ed="SELECT image_id, CAST(i AS INT) AS bin, q[i+1] a, q[i+2] b FROM q, range(5) t(i)",
    binned="SELECT d.image_id, d.l-s1.l AS d, CASE WHEN d.l<q[2] THEN 0 WHEN d.l<q[3] THEN 1 WHEN d.l<q[4] THEN 2 WHEN d.l<q[5] THEN 3 ELSE 4 END AS bin "
           "FROM dlum d JOIN s1 USING (image_id,y,x) JOIN q USING (image_id)",
    **mad_sql("binned", "image_id, bin", {"noise": "d"})))
def signal_noise_curve(spark, d):
    return rounded(op.signal_noise_curve(fx.dense(spark, d)), "signal_min", "signal_max", "noise_sigma")


@query("sky_covariance", with_views(
    "lum", "SELECT image_id, " + ", ".join(f"{r6(f'covar_samp({a},{b})')} AS cov_{a}{b}" for a, b in ("rr", "rg", "rb", "gg", "gb", "bb"))
    + " FROM skyt WHERE sky GROUP BY image_id", **sky_ctes("lum")))
def sky_covariance(spark, d):
    out = op.sky_covariance(fx.px(spark, d))
    return rounded(out, *[c for c in out.columns if c != "image_id"])
