"""Queries over the automatic colour reference."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reference as op
from ..sources import fixtures as fx
from .background import plane_ctes
from .colour import rsel
from .noise import rounded
from .registry import lum3, query, r6, with_views

C = F.col
R = 2
_STEPS = "abs(l-lag(l) OVER (PARTITION BY image_id, y ORDER BY x)) AS gx, abs(l-lag(l) OVER (PARTITION BY image_id, x ORDER BY y)) AS gy"


def measure_ctes(p: str, src: str, pts: str) -> dict[str, str]:
    """Patch measures by a range join."""
    return {
        f"{p}g": f"SELECT *, {_STEPS} FROM {src}",
        f"{p}pp": f"SELECT p.image_id, p.point_id, p.split, p.y AS py, p.x AS px, d.* EXCLUDE (image_id) FROM {pts} p JOIN {p}g d ON d.image_id=p.image_id AND d.y BETWEEN p.y-{R} AND p.y+{R} AND d.x BETWEEN p.x-{R} AND p.x+{R}",
        f"{p}pm": f"SELECT image_id, point_id, split, py, px, median(r) mr, median(g) mg, median(b) mb, median(l) lm, median(gx) FILTER (x>px-{R}) mx, median(gy) FILTER (y>py-{R}) my FROM {p}pp GROUP BY ALL HAVING max(y)-min(y)>=2 AND max(x)-min(x)>=2",
        f"{p}pt": f"SELECT image_id, point_id, median(abs(l-lm)) AS texture FROM {p}pp JOIN {p}pm USING (image_id, point_id) GROUP BY ALL",
        f"{p}ms": f"SELECT *, 0.2126e0*mr+0.7152e0*mg+0.0722e0*mb AS level, greatest(mr,mg,mb)-least(mr,mg,mb) AS error, (mx+my)*0.5e0 AS gradient FROM {p}pm JOIN {p}pt USING (image_id, point_id)",
    }


def slope_ctes(p: str, src: str) -> dict[str, str]:
    x, y = "(px-x0)/(x1-x0)::DOUBLE", "(py-y0)/(y1-y0)::DOUBLE"
    return {
        f"{p}e": f"SELECT * FROM (SELECT *, min(py) OVER w y0, max(py) OVER w y1, min(px) OVER w x0, max(px) OVER w x1, count(*) OVER w k FROM {src} WINDOW w AS (PARTITION BY image_id)) WHERE y1>y0 AND x1>x0 AND k>=4",
        **plane_ctes(f"{p}e", "image_id", x, y, "mr-mg", f"{p}u"), **plane_ctes(f"{p}e", "image_id", x, y, "mb-mg", f"{p}v"),
        f"{p}s": f"SELECT image_id, sqrt(u.bx*u.bx+u.by_*u.by_+v.bx*v.bx+v.by_*v.by_) AS slope FROM {p}upl u JOIN {p}vpl v USING (image_id) WHERE u.det>1e-15 AND v.det>1e-15",
    }


def _growth(a: str, b: str) -> str:
    return f"CASE WHEN {b}<=1e-12 THEN (CASE WHEN {a}<=1e-12 THEN 1e0 ELSE 'inf'::DOUBLE END) ELSE {a}/{b} END"


def _scaled(c: str) -> str:
    return f"(CASE WHEN max({c}) OVER w-min({c}) OVER w>1e-12 THEN ({c}-min({c}) OVER w)/(max({c}) OVER w-min({c}) OVER w) ELSE 0e0 END)"


_TOLD = [
    ("held_samples<4", "background_patch_measurement_failed"), ("separation<0.005e0", "insufficient_background_subject_separation"), ("e1<0.01e0", "background_color_error_below_action_threshold"),
    ("e1-e2<0.002e0", "heldout_background_absolute_improvement_insufficient"), ("(e1-e2)/greatest(e1,1e-12)<0.1e0", "heldout_background_relative_improvement_insufficient"),
    ("p2>p1*1.05e0+1e-8", "heldout_background_p90_regressed"), ("improved<0.75e0", "heldout_background_improved_fraction_insufficient"), ("c1 IS NULL OR c2 IS NULL", "heldout_background_spatial_chroma_gradient_unavailable"),
    ("coalesce(c2>c1*1.05e0+0.0005e0,false)", "heldout_background_spatial_chroma_gradient_growth_exceeded"), ("hg>0.002e0", "highlight_clip_growth_exceeded"), ("kg>0.002e0", "black_clip_growth_exceeded"),
    ("gr>1.05e0", "heldout_gradient_growth_exceeded"), ("tr>1.1e0", "heldout_texture_growth_exceeded"), ("coalesce(drift>0.08e0,false)", "subject_chromaticity_drift_exceeded")]
_LIST = ", ".join(f"CASE WHEN coalesce({c},true) THEN '{n}' END" for c, n in _TOLD)
_BACK = {
    "pt": "SELECT * FROM points", **measure_ctes("a", "dlum", "pt"),
    "bk": f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY image_id) n, row_number() OVER (PARTITION BY image_id ORDER BY score, py DESC, px) rn FROM (SELECT *, {r6(_scaled('level')+'+'+_scaled('gradient')+'+'+_scaled('texture'), 9)} AS score FROM ams WHERE split='fit' WINDOW w AS (PARTITION BY image_id))) WHERE rn=1",
    "cd": f"SELECT *, {lum3('2')} AS l2 FROM (SELECT d.*, k.level AS bl, {', '.join(f'greatest(d.{c}-(m{c}-least(mr,mg,mb)),0e0) AS {c}2' for c in 'rgb')} FROM dlum d JOIN bk k ON k.image_id=d.image_id)",
    "c2": "SELECT image_id, y, x, r2 AS r, g2 AS g, b2 AS b, l2 AS l FROM cd",
    "hp": "SELECT image_id, point_id, split, py AS y, px AS x FROM ams WHERE split='validation'", "hb": "SELECT * FROM ams WHERE split='validation'",
    **measure_ctes("n", "c2", "hp"), **slope_ctes("sa", "hb"), **slope_ctes("sb", "nms"),
    "tl": "SELECT a.image_id, count(*) n, median(a.error) e1, median(n.error) e2, quantile_cont(a.error,0.9) p1, quantile_cont(n.error,0.9) p2, median(a.gradient) g1, median(n.gradient) g2, median(a.texture) t1, median(n.texture) t2, avg(CASE WHEN n.error<a.error-1e-12 THEN 1e0 ELSE 0e0 END) improved FROM hb a JOIN nms n USING (image_id, point_id) GROUP BY a.image_id",
    "qq": "SELECT image_id, quantile_cont(l,0.98) q98, quantile_cont(l,0.995) q995 FROM cd GROUP BY image_id",
    "sj": "SELECT *, CASE WHEN m THEN sqrt((r2/s2-r/s1)*(r2/s2-r/s1)+(g2/s2-g/s1)*(g2/s2-g/s1)+(b2/s2-b/s1)*(b2/s2-b/s1)) END AS far FROM (SELECT cd.*, q98, r+g+b AS s1, r2+g2+b2 AS s2, l>=bl+greatest(0.1e0*greatest(q995-bl,0e0),0.002e0) AND l<greatest(q98,bl+0.002e0) AS sub, sub AND r+g+b>1e-8 AND r2+g2+b2>1e-8 AS m FROM cd JOIN qq USING (image_id))",
    "cp": "SELECT image_id, any_value(q98)-any_value(bl) AS separation, avg(CASE WHEN greatest(r2,g2,b2)>=0.999e0 THEN 1 ELSE 0 END)-avg(CASE WHEN greatest(r,g,b)>=0.999e0 THEN 1 ELSE 0 END) AS hg, avg(CASE WHEN least(r2,g2,b2)<=1e0/65535e0 THEN 1 ELSE 0 END)-avg(CASE WHEN least(r,g,b)<=1e0/65535e0 THEN 1 ELSE 0 END) AS kg, CASE WHEN count(*) FILTER (sub)>=64 AND count(far)>=64 THEN quantile_cont(far,0.95) END AS drift FROM sj GROUP BY image_id",
    "al": f"SELECT bk.*, coalesce(tl.n,0) AS held_samples, e1, e2, p1, p2, improved, sa.slope c1, sb.slope c2, separation, hg, kg, {_growth('g2','g1')} AS gr, {_growth('t2','t1')} AS tr, drift FROM bk JOIN cp USING (image_id) LEFT JOIN tl USING (image_id) LEFT JOIN sas sa USING (image_id) LEFT JOIN sbs sb USING (image_id)",
}
_NAMES = "separation error_before error_after p90_before p90_after improved_fraction chroma_before chroma_after highlight_growth black_growth gradient_ratio texture_ratio drift"


@query("background_reference", with_views("points dlum", f"SELECT image_id, py AS bg_y, px AS bg_x, n AS bg_candidates, {rsel('mr-least(mr,mg,mb) mg-least(mr,mg,mb) mb-least(mr,mg,mb)', 'off_r off_g off_b')}, held_samples, {rsel('separation e1 e2 p1 p2 improved c1 c2 hg kg gr tr drift', _NAMES)}, array_to_string(list_sort(list_filter([{_LIST}], lambda x: x IS NOT NULL)), ',') AS reasons FROM al", **_BACK))
def background_reference(spark, d):
    b = op.background_reference(fx.dlum(spark, d), fx.points(spark, d), R)
    b = b.select("image_id", "bg_y", "bg_x", "bg_candidates", "off_r", "off_g", "off_b", "held_samples", *_NAMES.split(), F.array_join("reasons", ",").alias("reasons"))
    return rounded(b, "off_r", "off_g", "off_b", *_NAMES.split())


_INSIDE = "s.x>=p.x0 AND s.x<p.x1 AND s.y>=p.y0 AND s.y<p.y1"


@query("white_rectangle", with_views("px", f"SELECT image_id, x0, y0, x1, y1, side, objects, flux, {rsel('compactness saturation_fraction')} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY side, objects DESC, flux DESC, compactness DESC, saturation_fraction, y0, x0) rn FROM hd) WHERE rn=1",
    pr="SELECT DISTINCT image_id, side, CAST(greatest(0,least(16-side,x-side//2)) AS INT) x0, CAST(greatest(0,least(16-side,y-side//2)) AS INT) y0, x0+side AS x1, y0+side AS y1 FROM px CROSS JOIN (VALUES (4),(6),(8),(12),(16)) v(side)",
    hd=f"SELECT p.image_id, p.side, p.x0, p.y0, p.x1, p.y1, count(*) AS objects, {r6('sum(s.r+s.g+s.b)')} AS flux, median(s.r) AS compactness, median(s.b/10) AS saturation_fraction FROM pr p JOIN px s ON s.image_id=p.image_id AND {_INSIDE} GROUP BY ALL HAVING count(*)>=8"))
def white_rectangle(spark, d):
    p = fx.px(spark, d)
    stars = p.select("image_id", C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), (C("r") + C("g") + C("b")).alias("flux"), C("r").alias("compactness"), (C("b") / 10).alias("saturation_fraction"))
    size = p.select("image_id").distinct().select("image_id", F.lit(16).alias("h"), F.lit(16).alias("w"))
    return rounded(op.white_rectangle(stars, size, 8, shortest=4), "compactness", "saturation_fraction")


@query("auto_reference")
def auto_reference(spark, d):
    a = op.auto_reference(fx.dlum(spark, d), fx.points(spark, d), R)
    return a.withColumns({c: F.array_join(c, ",") for c in ("reasons", "white_reasons")})
