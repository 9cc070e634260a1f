"""Queries over background measurement."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background as op
from ..sources import fixtures as fx
from .colour import rsel
from .noise import mad_sql, rounded
from .registry import blur_sql, cl, query, r6, with_views

C = F.col


def pts(spark, d):
    """All points; patches at the border of an image are measured on the pixels they have."""
    return fx.points(spark, d)


_PTS = "SELECT * FROM points"


def patch_ctes(r: int, src: str = "dlum", p: str = "", pts_: str = "pt", cols: str = "d.l") -> dict[str, str]:
    side = max(2, (2 * r + 1) // 5)
    return {
        f"{p}pp": f"SELECT p.image_id, p.point_id, p.split, p.y AS py, p.x AS px, d.y-p.y+{r} AS by_, d.x-p.x+{r} AS bx, {cols} FROM {pts_} p JOIN {src} d ON d.image_id=p.image_id AND d.y BETWEEN p.y-{r} AND p.y+{r} AND d.x BETWEEN p.x-{r} AND p.x+{r}",
        f"{p}pm": f"SELECT image_id, point_id, split, py, px, median(l) AS median, count(*) n, min(l) lo, max(l) hi, count(*) FILTER (l<=0) lc, count(*) FILTER (l>=1) hc FROM {p}pp GROUP BY ALL",
        f"{p}pd": f"SELECT image_id, point_id, median(abs(l-median)) mad FROM {p}pp JOIN {p}pm USING (image_id, point_id) GROUP BY ALL",
        f"{p}bm": f"SELECT image_id, point_id, floor(by_/{side}.0) a, floor(bx/{side}.0) b, median(l) m FROM {p}pp GROUP BY ALL HAVING count(*)>={max(4, side*side//2)}",
        f"{p}b2": f"SELECT image_id, point_id, count(*) nb, median(m) mm FROM {p}bm GROUP BY ALL",
        f"{p}b3": f"SELECT image_id, point_id, any_value(nb) nb, 1.4826e0*median(abs(m-mm)) bs FROM {p}bm JOIN {p}b2 USING (image_id, point_id) GROUP BY ALL",
        f"{p}pst": f"""SELECT *, CASE WHEN n>=16 THEN greatest(CASE WHEN nb>=6 THEN greatest(1.2533e0*1.4826e0*mad/sqrt(n), 1.2533e0*bs/sqrt(nb)) ELSE 1.2533e0*1.4826e0*mad/sqrt(n) END, 2.220446049250313e-16) END AS uncertainty
           FROM {p}pm JOIN {p}pd USING (image_id, point_id) LEFT JOIN {p}b3 USING (image_id, point_id)""",
    }


def held_cte(p: str = "") -> str:
    return f"""SELECT image_id, count(*) samples, CAST(sum(n) AS BIGINT) pixels, median(median) AS med, quantile_cont(median,0.1) p10, quantile_cont(median,0.9) p90, greatest(0e0,quantile_cont(median,0.9)-quantile_cont(median,0.1)) span,
      median(mad) pmm, median(uncertainty) um, sqrt(2e0)*greatest(median(uncertainty),2.220446049250313e-16) se, CAST(sum(lc) AS BIGINT) lc, CAST(sum(hc) AS BIGINT) hc FROM {p}pst WHERE split='validation' GROUP BY image_id"""


@query("patch_join", with_views("points lum", "SELECT p.image_id, p.point_id, count(*) AS pixels, min(d.l) AS lo, max(d.l) AS hi FROM points p JOIN lum d ON d.image_id=p.image_id AND d.y BETWEEN p.y-2 AND p.y+2 AND d.x BETWEEN p.x-2 AND p.x+2 GROUP BY ALL"))
def patch_join(spark, d):
    return op.patch_join(fx.points(spark, d), fx.lum(spark, d), 2).groupBy("image_id", "point_id").agg(F.count("*").alias("pixels"), F.min("l").alias("lo"), F.max("l").alias("hi"))


@query("patch_uncertainty", with_views("points dlum", f"SELECT image_id, point_id, n AS pixels, {rsel('median mad')}, coalesce(nb,0) AS blocks, {r6('uncertainty',8)} AS uncertainty FROM pst", pt=_PTS, **patch_ctes(3)))
def patch_uncertainty(spark, d):
    s = op.patch_stats(op.patch_join(pts(spark, d), fx.dlum(spark, d), 3), 3)
    s = rounded(s, "median", "mad")
    return rounded(s, "uncertainty", digits=8).select("image_id", "point_id", "pixels", "median", "mad", "blocks", "uncertainty")


@query("heldout_background", with_views("points dlum", f"""SELECT image_id, samples, pixels, {rsel('med p10 p90 span pmm','median p10 p90 robust_span patch_mad_median')}, {r6('um',8)} AS uncertainty_median, {r6('se',8)} AS span_se, lc AS low_clip, hc AS high_clip,
  CASE WHEN samples>=4 THEN 'ready' ELSE 'unavailable' END AS status FROM h""", pt=_PTS, **patch_ctes(2), h=held_cte()))
def heldout_background(spark, d):
    h = op.heldout(op.patch_stats(op.patch_join(pts(spark, d), fx.dlum(spark, d), 2), 2))
    h = rounded(h, "median", "p10", "p90", "robust_span", "patch_mad_median")
    return rounded(h, "uncertainty_median", "span_se", digits=8)


def plane_ctes(src: str, keys: str, x: str, y: str, v: str, p: str = "") -> dict[str, str]:
    return {
        f"{p}m0": f"SELECT {keys}, count(v) n, avg(x) mx, avg(y) my, avg(v) mv, var_pop(x) xx, var_pop(y) yy, covar_pop(x,y) xy, covar_pop(x,v) xv, covar_pop(y,v) yv, var_pop(v) vv FROM (SELECT {keys}, CAST({x} AS DOUBLE) x, CAST({y} AS DOUBLE) y, {v} AS v FROM {src}) GROUP BY {keys}",
        f"{p}m1": f"SELECT *, (xv*yy-yv*xy)/det AS bx, (yv*xx-xv*xy)/det AS by_ FROM (SELECT *, xx*yy-xy*xy AS det FROM {p}m0)",
        f"{p}pl": f"SELECT *, mv-bx*mx-by_*my AS lvl, sqrt(rss/n) AS rms, abs(bx)+abs(by_) AS span, sqrt(bx*bx+by_*by_)/sqrt(greatest(rss/greatest(n-3,1)*(xx+yy)/(det*n),1e-30)) AS sigma, sqrt(yy/det/n) ux, sqrt(xx/det/n) uy FROM (SELECT *, greatest((vv-bx*xv-by_*yv)*n,0e0) AS rss FROM {p}m1)",
    }


@query("plane_fit", with_views("lum", f"SELECT image_id, n AS samples, CAST(CASE WHEN det>1e-15 THEN 3 ELSE 2 END AS INT) AS rank, {rsel('lvl bx by_ rms span sigma','level slope_x slope_y rms span sigma')} FROM pl", **plane_ctes("lum", "image_id", "x/15e0", "y/15e0", "l")))
def plane_fit(spark, d):
    f = op.plane_fit(fx.lum(spark, d), ["image_id"], C("x") / 15.0, C("y") / 15.0, C("l")).drop("rss", "unit_x", "unit_y")
    return rounded(f, "level", "slope_x", "slope_y", "rms", "span", "sigma")


def spatial_ctes(src: str = "dlum", p: str = "") -> dict[str, str]:
    return {
        f"{p}sp": f"SELECT p.image_id, p.point_id, p.y AS py, p.x AS px, unnest([{{'c':'luma','v':d.l}},{{'c':'rg','v':d.r-d.g}},{{'c':'bg','v':d.b-d.g}}]) AS s FROM pt p JOIN {src} d ON d.image_id=p.image_id AND d.y BETWEEN p.y-2 AND p.y+2 AND d.x BETWEEN p.x-2 AND p.x+2",
        f"{p}sm": f"SELECT image_id, s.c AS component, point_id, py, px, median(s.v) m FROM {p}sp GROUP BY ALL",
        f"{p}sl": f"SELECT sm.*, m/greatest(lv,1e-6) AS v FROM {p}sm sm JOIN (SELECT image_id, median(m) lv FROM {p}sm WHERE component='luma' GROUP BY image_id) USING (image_id)",
        **plane_ctes(f"{p}sl", "image_id, component", "px/15e0-0.5e0", "py/15e0-0.5e0", "v", p),
    }


@query("spatial_planes", with_views("points dlum", f"SELECT image_id, component, n AS samples, CAST(CASE WHEN det>1e-15 THEN 3 ELSE 2 END AS INT) AS rank, {rsel('lvl bx by_ rms span sigma','level slope_x slope_y rms span sigma')} FROM pl", pt=_PTS, **spatial_ctes()))
def spatial_planes(spark, d):
    f = op.spatial_planes(pts(spark, d), fx.dlum(spark, d), 2, 16)
    return rounded(f, "level", "slope_x", "slope_y", "rms", "span", "sigma")


MODEL = {
    **plane_ctes("pst", "image_id", "px/15e0-0.5e0", "py/15e0-0.5e0", "median"),
    "pr": "SELECT *, (px/15e0-0.5e0)*(px/15e0-0.5e0)+(py/15e0-0.5e0)*(py/15e0-0.5e0) AS r2 FROM pst",
    "rd": "SELECT *, c/v AS sl, mm-(c/v)*mr AS lv, greatest((vv-(c/v)*c)*nn,0e0) AS rr FROM (SELECT image_id, count(*) nn, covar_pop(r2,median) c, var_pop(r2) v, avg(r2) mr, avg(median) mm, var_pop(median) vv, greatest(quantile_cont(median,0.9)-quantile_cont(median,0.1),0e0) AS span0, greatest(3e0*sqrt(2e0)*median(uncertainty),1e-12) AS lim FROM pr GROUP BY image_id)",
    "rs": "SELECT pr.image_id, median-lv-sl*r2 AS e FROM pr JOIN rd USING (image_id)",
    "rm": "SELECT image_id, median(e) em FROM rs GROUP BY image_id",
    "rz": "SELECT image_id, 1.4826e0*median(abs(e-em)) AS sg FROM rs JOIN rm USING (image_id) GROUP BY image_id",
    "mc": """SELECT *, span0>lim AS varies, span0>lim AND sl*0.5e0< -lim AND rb+6e0<pb AND sg<=greatest(span0*0.4e0,lim) AS radial FROM (SELECT rd.*, sg, nn*ln(greatest(pl.rss,1e-300)/nn)+3e0*ln(nn) AS pb, nn*ln(greatest(rr,1e-300)/nn)+2e0*ln(nn) AS rb FROM rd JOIN pl USING (image_id) JOIN rz USING (image_id))""",
}


@query("directional_model_compare", with_views("points dlum", f"SELECT image_id, nn AS samples, {rsel('pb rb sg sl*0.5e0 span0','plane_bic radial_bic radial_sigma edge_delta span')}, {r6('lim',8)} AS \"limit\", varies AS spatial_variation, radial AS radial_preferred FROM mc", pt=_PTS, **patch_ctes(2), **MODEL))
def directional_model_compare(spark, d):
    m = op.model_compare(op.patch_stats(op.patch_join(pts(spark, d), fx.dlum(spark, d), 2), 2), 16)
    m = rounded(m, "plane_bic", "radial_bic", "radial_sigma", "edge_delta", "span")
    return rounded(m, "limit", digits=8)


@query("shift_self_join", with_views("lum", f"SELECT a.image_id, dn AS direction, count(*) AS pairs, CASE WHEN count(*)>=128 THEN {r6('corr(a.l,b.l)')} ELSE 0e0 END AS corr FROM (SELECT * FROM lum, (VALUES ('horizontal',1,0),('vertical',0,1),('diagonal_down',1,1),('diagonal_up',1,-1)) t(dn,dx,dy) WHERE l<0.8) a JOIN lum b ON b.image_id=a.image_id AND b.y=a.y+dy AND b.x=a.x+dx WHERE b.l<0.8 GROUP BY a.image_id, dn"))
def shift_self_join(spark, d):
    c = op.shift_correlation(fx.lum(spark, d).withColumn("m", C("l") < 0.8), "l", "m")
    return c.withColumn("corr", F.when(C("pairs") >= 128, F.floor(C("corr") * 1e6 + 0.5001234) / 1e6).otherwise(F.lit(0.0)))


_BL = {f"t{i}": blur_sql(f"t{i-1}" if i > 1 else "dlum", "l", 1) for i in range(1, 13)}


def pattern_ctes(src: str = "dlum") -> dict[str, str]:
    bl = dict(_BL, t1=blur_sql(src, "l", 1))
    return {
        **bl,
        "pq": f"SELECT image_id, quantile_cont(l,0.6) lm FROM {src} GROUP BY image_id",
        "pz": f"SELECT d.image_id, d.y, d.x, d.l<=lm AS bg, d.l-t4.l AS res, d.l-t12.l AS broad FROM {src} d JOIN pq USING (image_id) JOIN t4 USING (image_id,y,x) JOIN t12 USING (image_id,y,x)",
        "pz1": "SELECT image_id, median(res) m, count(*) sky FROM pz WHERE bg GROUP BY image_id",
        "pz2": "SELECT image_id, any_value(sky) sky, 1.4826e0*median(abs(res-m)) rs FROM pz JOIN pz1 USING (image_id) WHERE bg GROUP BY image_id",
        **{f"pf{k}": f"SELECT image_id, {ax} AS i, median(broad) m FROM pz GROUP BY image_id, {ax}" for k, ax in (("r", "y"), ("c", "x"))},
        **{f"ps{k}": f"SELECT image_id, m-(coalesce(lag(m,1) OVER w,first(m) OVER f)+coalesce(lag(m,2) OVER w,first(m) OVER f)+m+coalesce(lead(m,1) OVER w,last(m) OVER f)+coalesce(lead(m,2) OVER w,last(m) OVER f))/5e0 AS e FROM pf{k} WINDOW w AS (PARTITION BY image_id ORDER BY i), f AS (PARTITION BY image_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for k in "rc"},
        **{f"pg{k}": f"SELECT image_id, 1.4826e0*median(abs(e-em)) s FROM ps{k} JOIN (SELECT image_id, median(e) em FROM ps{k} GROUP BY image_id) USING (image_id) GROUP BY image_id" for k in "rc"},
        "pc": "SELECT image_id, coalesce(max(c) FILTER (dn='horizontal'),0) h, coalesce(max(c) FILTER (dn='vertical'),0) v, coalesce(max(c) FILTER (dn='diagonal_down'),0) dd, coalesce(max(c) FILTER (dn='diagonal_up'),0) du FROM (SELECT a.image_id, dn, CASE WHEN count(*)>=60 THEN corr(a.res,b.res) ELSE 0 END c FROM (SELECT * FROM pz, (VALUES ('horizontal',1,0),('vertical',0,1),('diagonal_down',1,1),('diagonal_up',1,-1)) t(dn,dx,dy) WHERE bg) a JOIN pz b ON b.image_id=a.image_id AND b.y=a.y+dy AND b.x=a.x+dx WHERE b.bg GROUP BY a.image_id, dn) GROUP BY image_id",
        "pn1": f"SELECT image_id, sky, {cl('(r.s/greatest(rs,1e-8)-0.04e0)/0.3e0')} AS row_score, {cl('(c.s/greatest(rs,1e-8)-0.04e0)/0.3e0')} AS col_score, h, v, dd, du, list_reverse_sort([greatest(h,0),greatest(v,0),greatest(dd,0),greatest(du,0)]) AS srt FROM pz2 JOIN pgr r USING (image_id) JOIN pgc c USING (image_id) JOIN pc USING (image_id)",
        "pn2": f"SELECT *, greatest(row_score,col_score) AS stripe, {cl('(greatest(dd,du,0)-greatest(h,v,0)-0.04e0)/0.25e0')} AS walking, {cl('(greatest(srt[1]-srt[3],0)-0.08e0)/0.3e0')} AS directional FROM pn1",
        "pn": """SELECT *, CASE WHEN kind='none' THEN NULL WHEN kind='diagonal_walking_noise' THEN CASE WHEN dd>=du THEN 'diagonal_down' ELSE 'diagonal_up' END WHEN kind='horizontal_banding' THEN 'horizontal' WHEN kind='vertical_banding' THEN 'vertical'
          WHEN h=greatest(h,v,dd,du) THEN 'horizontal' WHEN v=greatest(h,v,dd,du) THEN 'vertical' WHEN dd=greatest(h,v,dd,du) THEN 'diagonal_down' ELSE 'diagonal_up' END AS orientation, kind<>'none' AS detected FROM (
          SELECT *, greatest(stripe,walking,directional) AS score, CASE WHEN NOT (greatest(stripe,walking,directional)>=0.55 OR walking>=0.5) THEN 'none' WHEN walking>=0.5 THEN 'diagonal_walking_noise'
          WHEN row_score>=col_score AND stripe>=directional THEN 'horizontal_banding' WHEN col_score>row_score AND stripe>=directional THEN 'vertical_banding' ELSE 'directional_pattern_noise' END AS kind FROM pn2)""",
    }


@query("pattern_noise", with_views("dlum", f"SELECT image_id, sky, 'ok' AS status, detected, {rsel('score stripe walking directional')}, kind, orientation FROM pn", **pattern_ctes()))
def pattern_noise(spark, d):
    return rounded(op.pattern_noise(fx.dlum(spark, d), minimum=64, pairs=60), "score", "stripe", "walking", "directional")


BQ = {
    "b0": "SELECT d.*, CASE WHEN l<=c THEN 1e0 ELSE 0e0 END AS w, r-g AS rg, b-g AS bgo FROM dlum d JOIN (SELECT image_id, quantile_cont(l,0.35) c FROM dlum GROUP BY image_id) USING (image_id)",
    "b1": blur_sql("b0", "l rg bgo", 1), "b2": blur_sql("b1", "l", 1), "b3": blur_sql("b2", "l", 1),
    "bq0": "SELECT b0.*, sqrt(((b0.rg-b1.rg)*(b0.rg-b1.rg)+(b0.bgo-b1.bgo)*(b0.bgo-b1.bgo))*0.5e0) cn, abs(b0.l-b1.l) tx, b0.l-b1.l AS tr, abs(b1.l-b3.l) mo, sqrt((pow(r-(r+g+b)/3e0,2)+pow(g-(r+g+b)/3e0,2)+pow(b-(r+g+b)/3e0,2))/3e0) bi FROM b0 JOIN b1 USING (image_id,y,x) JOIN b3 USING (image_id,y,x)",
    "bqa": "SELECT image_id, sum(l*w)/sum(w) level, sqrt(greatest(sum(l*l*w)/sum(w)-pow(sum(l*w)/sum(w),2),0e0)) std, sum(cn*w)/sum(w) cn, sum(mo*w)/sum(w) mo, sum(tx*w)/sum(w) tx, sum(bi*w)/sum(w) bi, sum(r*w)/sum(w) red, sum(g*w)/sum(w) green, sum(b*w)/sum(w) blue, avg(CASE WHEN l>=0.985 THEN 1 ELSE 0 END) core_clip FROM bq0 GROUP BY image_id",
    "bqt": "SELECT * FROM (SELECT image_id, y//4 ty, x//4 tx_, avg(w) mw, var_pop(l) var, sqrt(greatest(sum(tr*tr*w)/nullif(sum(w),0)-pow(sum(tr*w)/nullif(sum(w),0),2),0e0)) rms FROM bq0 GROUP BY ALL) WHERE mw>0.3",
    "bqm": "SELECT image_id, median(rms) rm FROM bqt GROUP BY image_id", "bqd": "SELECT image_id, any_value(rm) rm, median(abs(rms-rm)) md FROM bqt JOIN bqm USING (image_id) GROUP BY image_id",
    "bqz": "SELECT image_id, count(*) tiles, median(var) pv, median(rms) rmed, quantile_cont(rms,0.9) r90, quantile_cont(greatest(0e0,(rms-rm)/greatest(1.4826e0*md,rm*0.15e0,1e-6)),0.9) oz FROM bqt JOIN bqd USING (image_id) GROUP BY image_id",
    "bq": f"""SELECT image_id, level, std, {cl('std/greatest(level,0.015e0)','0e0','2e0')} AS dirty_score, {cl('cn/greatest(std*2e0,0.01e0)','0e0','2e0')} AS chroma_noise, {cl('mo/greatest(std*2e0,0.006e0)','0e0','2e0')} AS mottling, {cl('tx/greatest(std*3e0,0.006e0)','0e0','2e0')} AS artifact,
      bi/greatest(level,1e-4) AS chroma_load, red, green, blue, core_clip, coalesce(tiles,0) AS tiles, coalesce(pv,0) AS patch_variance, coalesce(rmed,0) AS residual_median, coalesce(r90,0) AS residual_p90, coalesce(oz,0) AS outlier_score FROM bqa LEFT JOIN bqz USING (image_id)""",
}
_BQN = "level std dirty_score chroma_noise mottling artifact chroma_load red green blue core_clip patch_variance residual_median residual_p90 outlier_score"


@query("background_quality", with_views("dlum", f"SELECT image_id, tiles, {rsel(_BQN)} FROM bq", **BQ))
def background_quality(spark, d):
    return rounded(op.background_quality(fx.dlum(spark, d), 4), *_BQN.split())
