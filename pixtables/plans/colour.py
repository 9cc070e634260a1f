"""Queries over tone and colour."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel as px
from ..functions.fixed import fixed
from ..operators import colour as op
from ..sources import fixtures as fx
from .noise import rounded
from .registry import blur_sql, cl, lum3, query, r6, ss, with_views

C = F.col
K3 = ["image_id", "y", "x"]


def rsel(cols: str, names: str | None = None) -> str:
    return ", ".join(f"{r6(c)} AS {n}" for c, n in zip(cols.split(), (names or cols).split()))


def out(df, *cols, keep=()):
    return rounded(df.select(*K3, *keep, *cols), *cols)


@query("domain_normalise", with_views("px", f"""SELECT image_id, y, x, {r6(cl('coalesce(r,mr,0)'))} AS r, {r6(cl('coalesce(g,mg,0)'))} AS g, {r6(cl('coalesce(b,mb,0)'))} AS b,
  (r IS NULL OR g IS NULL OR b IS NULL) AS replaced, NOT (coalesce(r,mr,0) BETWEEN 0 AND 1 AND coalesce(g,mg,0) BETWEEN 0 AND 1 AND coalesce(b,mb,0) BETWEEN 0 AND 1) AS out_of_range
  FROM n JOIN (SELECT image_id, median(r) mr, median(g) mg, median(b) mb FROM n GROUP BY image_id) USING (image_id)""",
  n="""SELECT image_id, y, x, CASE WHEN (x+y)%7=0 THEN NULL ELSE floor(r*s)/f END AS r, floor(g*s)/f AS g, CASE WHEN x=y THEN NULL ELSE floor(b*s)/f END AS b
  FROM (SELECT *, CASE image_id%3 WHEN 0 THEN 255e0 WHEN 1 THEN 65535e0 ELSE 4000e0 END AS f, CASE image_id%3 WHEN 0 THEN 255e0 WHEN 1 THEN 65535e0 ELSE 4100e0 END AS s FROM px)"""))
def domain_normalise(spark, d):
    i = C("image_id") % 3
    s = F.when(i == 0, 255.0).when(i == 1, 65535.0).otherwise(4100.0)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    raw = fx.px(spark, d).select(
        *K3, F.when((C("x") + C("y")) % 7 == 0, nan).otherwise(F.floor(C("r") * s).cast("double")).alias("r"), F.floor(C("g") * s).cast("double").alias("g"),
        F.when(C("x") == C("y"), inf).otherwise(F.floor(C("b") * s).cast("double")).alias("b"),
        F.when(i == 0, "uint8").when(i == 1, "uint16").otherwise("float").alias("dtype"), F.lit(4000.0).alias("scale"))
    return out(op.domain_normalise(raw), "r", "g", "b", keep=("replaced", "out_of_range"))


@query("grid_downsample", with_views("px", """SELECT image_id, y, x, r, g, b, step FROM (SELECT *, CAST(ceil(greatest(max(y) OVER w, max(x) OVER w)+1)/6.0) AS INT) AS step FROM px WINDOW w AS (PARTITION BY image_id))
  WHERE x%step=0 AND y%step=0""".replace("ceil(greatest(max(y) OVER w, max(x) OVER w)+1)/6.0)", "ceil((greatest(max(y) OVER w, max(x) OVER w)+1)/6.0)")))
def grid_downsample(spark, d):
    return op.grid_downsample(fx.px(spark, d), 6)


_SAT = "(greatest(r,g,b)-least(r,g,b))/greatest(greatest(r,g,b),1e-6)"
_SUM = "greatest(r+g+b,1e-6)"


@query("saturation_chroma", with_views("px", f"""SELECT image_id, y, x, {r6(_SAT)} AS sat, {r6('(greatest(r,g,b)-least(r,g,b))/greatest((r+g+b)/3e0,0.02e0)')} AS chroma,
  {r6('r/'+_SUM)} AS cr, {r6('g/'+_SUM)} AS cg, {r6(f'atan2((b-g)/{_SUM},(r-g)/{_SUM})')} AS opp_hue, {r6('r-g')} AS rg, {r6('b-g')} AS bg FROM px"""))
def saturation_chroma(spark, d):
    rgb = op.rgb()
    ch = px.chromaticity(*rgb)
    df = fx.px(spark, d).withColumns({"sat": px.saturation_hsv(*rgb), "chroma": px.chroma_proxy(*rgb), "cr": ch[0], "cg": ch[1],
                                      "opp_hue": px.opponent_hue(*ch)[0], "rg": C("r") - C("g"), "bg": C("b") - C("g")})
    return out(df, "sat", "chroma", "cr", "cg", "opp_hue", "rg", "bg")


_HUE = """CASE WHEN greatest(r,g,b)-least(r,g,b)<=1e-7 THEN 0e0 ELSE fmod2(60e0*(CASE WHEN b=greatest(r,g,b) THEN (r-g)/(greatest(r,g,b)-least(r,g,b))+4e0
  WHEN g=greatest(r,g,b) THEN (b-r)/(greatest(r,g,b)-least(r,g,b))+2e0 ELSE fmod2((g-b)/(greatest(r,g,b)-least(r,g,b)), 6e0) END), 360e0) END"""


def _fmod(sql: str) -> str:
    import re
    while "fmod2(" in sql:
        i = sql.rindex("fmod2(")
        depth, j, comma = 0, i + 6, None
        while True:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = j
            j += 1
        a, m = sql[i + 6:comma], sql[comma + 1:j].strip()
        sql = sql[:i] + f"(({a})-floor(({a})/{m})*{m})" + sql[j + 1:]
    return sql


_HUE = _fmod(_HUE)


def _band(c, w, f):
    d0 = f"abs(hue-{c}e0)"
    d = f"least({d0},360e0-{d0})"
    inner = w * (1 - f)
    t = cl(f"(({d})-{inner!r})/{w-inner!r}")
    return f"(1e0-{t}*{t}*(3e0-2e0*{t}))"


_HSL = """CASE WHEN greatest(r,g,b)-least(r,g,b)<=1e-7 THEN 0e0 WHEN (greatest(r,g,b)+least(r,g,b))*0.5e0<=0.5e0 THEN (greatest(r,g,b)-least(r,g,b))/greatest(greatest(r,g,b)+least(r,g,b),1e-7)
  ELSE least((greatest(r,g,b)-least(r,g,b))/greatest(2e0-greatest(r,g,b)-least(r,g,b),1e-7),1e0) END"""
_BANDS = [{"center": 0.0, "width": 45.0, "feather": 0.8, "amount": 0.12}, {"center": 200.0, "width": 60.0, "feather": 0.5, "amount": -0.10}]


@query("hue_mask", with_views("px", f"""SELECT image_id, y, x, {r6('hue',4)} AS hue, {r6('m1')} AS m1, {rsel('l+(r-l)*(1e0+w) l+(g-l)*(1e0+w) l+(b-l)*(1e0+w)', 'r g b')} FROM
  (SELECT *, {cl(f'0.12e0*m1-0.1e0*m2','-0.15e0','0.15e0')}*{ss('sat','0.03e0','0.18e0')}*{ss('l','0.02e0','0.12e0')}*(1e0-{ss('l','0.85e0','0.98e0')}) AS w FROM
  (SELECT *, {_band(0,45.0,0.8)} AS m1, {_band(200,60.0,0.5)} AS m2, {lum3()} AS l, {_HSL} AS sat FROM (SELECT *, {_HUE} AS hue FROM px)))"""))
def hue_mask(spark, d):
    hue = px.hue_degrees(*op.rgb())
    b0 = _BANDS[0]
    new = op.hue_selective_saturation(_BANDS, F.lit(1.0))
    df = fx.px(spark, d).select(*K3, fixed(hue, 4).alias("hue"), px.hue_mask(hue, b0["center"], b0["width"], b0["feather"]).alias("m1"), *[e.alias(c) for e, c in zip(new, "rgb")])
    return out(df, "m1", "r", "g", "b", keep=("hue",))


@query("circular_hue_delta", with_views("pair", f"SELECT image_id, y, x, {r6('abs(atan2(sin(h2-h1),cos(h2-h1)))*180e0/pi()',4)} AS degrees FROM (SELECT *, atan2(b-g,r-g) AS h1, atan2(b2-g2,r2-g2) AS h2 FROM pair)"))
def circular_hue_delta(spark, d):
    p = fx.pair(spark, d)
    delta = px.circular_delta(px.opponent_hue(*op.rgb("2"))[0], px.opponent_hue(*op.rgb())[0])
    return p.select(*K3, fixed(delta * 180.0 / F.pi(), 4).alias("degrees"))


def _mtf(v, s, m, h="1e0"):
    n = cl(f"(({v})-{s})/greatest({h}-{s},1e-12)")
    den = f"((2e0*{m}-1e0)*{n}-{m})"
    return f"CASE WHEN {v}<={s} THEN 0e0 WHEN {v}>={h} THEN 1e0 ELSE {cl(f'({m}-1e0)*{n}/{den}')} END"


@query("mtf_stretch", with_views("px", f"SELECT image_id, y, x, {', '.join(f'{r6(_mtf(c,chr(115),chr(109)))} AS {c}' for c in 'rgb')} FROM (SELECT *, 0.02e0*(image_id%5) AS s, 0.2e0+0.05e0*(image_id%4) AS m FROM px)"))
def mtf_stretch(spark, d):
    i = C("image_id")
    s, m, h = F.lit(0.02) * (i % 5), F.lit(0.2) + F.lit(0.05) * (i % 4), F.lit(1.0)
    return out(fx.px(spark, d).withColumns({c: px.mtf(C(c), s, m, h) for c in "rgb"}), "r", "g", "b")


@query("statistical_mtf", with_views("px", f"""SELECT image_id, {rsel('p50 p99 bp','source_p50 source_p99 blackpoint')}, {r6('CASE WHEN ok THEN mid END')} AS midtones,
  {r6('CASE WHEN ok THEN '+_mtf('p50','bp','mid')+' END')} AS predicted_p50, {r6('CASE WHEN ok THEN '+_mtf('p99','bp','mid')+' END')} AS predicted_p99, CASE WHEN ok THEN 'available' ELSE 'unavailable' END AS status
  FROM (SELECT *, s*(1e0-0.25e0)/(s*(1e0-2e0*0.25e0)+0.25e0) AS mid FROM (SELECT *, bp<p50 AND p50<1 AS ok, {cl('(p50-bp)/greatest(1e0-bp,1e-12)','1e-6','0.999999e0')} AS s FROM
  (SELECT image_id, any_value(p50) p50, any_value(p99) p99, least(greatest(any_value(p0), any_value(p50)-1.0e0*1.4826e0*CASE WHEN count(lo)<16 THEN median(abs(v-p50)) ELSE median(abs(lo-lc)) END),0.99e0) AS bp FROM
  (SELECT *, CASE WHEN v<=p50 THEN v END AS lo FROM v JOIN q USING (image_id)) JOIN lc USING (image_id) GROUP BY image_id)))""",
  v="SELECT image_id, unnest([r,g,b]) AS v FROM px", q="SELECT image_id, median(v) p50, quantile_cont(v,0.99) p99, min(v) p0 FROM v GROUP BY image_id",
  lc="SELECT image_id, median(v) lc FROM v JOIN q USING (image_id) WHERE v<=p50 GROUP BY image_id"))
def statistical_mtf(spark, d):
    df = op.statistical_mtf(fx.px(spark, d), 0.25, sigma=1.0)
    return rounded(df, "source_p50", "source_p99", "blackpoint", "midtones", "predicted_p50", "predicted_p99")


_LV, _TG = [0.01, 0.35, 0.75, 0.99], [0.0, 0.2, 0.6, 0.97]
_PW = "CASE WHEN l<q[1] THEN 0e0 WHEN l<q[2] THEN 0.2e0/(q[2]-q[1])*(l-q[1]) WHEN l<q[3] THEN 0.2e0+0.4e0/(q[3]-q[2])*(l-q[2]) WHEN l<q[4] THEN 0.6e0+0.37e0/(q[4]-q[3])*(l-q[3]) ELSE 0.97e0 END"


@query("quantile_curve", with_views("lum", f"SELECT image_id, y, x, {r6('l')} AS l, {r6('CASE WHEN ok THEN '+_PW+' ELSE l END')} AS mapped, ok AS curve_ok FROM lum JOIN "
       "(SELECT *, q[2]>q[1] AND q[3]>q[2] AND q[4]>q[3] AND greatest(0.2e0/(q[2]-q[1]),0.4e0/(q[3]-q[2]),0.37e0/(q[4]-q[3]))<=3.9e0 AS ok FROM (SELECT image_id, quantile_cont(l,[0.01,0.35,0.75,0.99]) q FROM lum GROUP BY image_id)) USING (image_id)"))
def quantile_curve(spark, d):
    return out(op.quantile_curve(fx.lum(spark, d), _LV, _TG, max_slope=3.9), "l", "mapped", keep=("curve_ok",))


def _gain(m, l="l"):
    g = f"(CASE WHEN {l}>1e-12 THEN ({m})/{l} ELSE 0e0 END)"
    return ", ".join(f"{r6(f'least(greatest({c}*{g}*(CASE WHEN greatest(r*{g},g*{g},b*{g})>0.995e0 THEN 0.995e0/greatest(r*{g},g*{g},b*{g}) ELSE 1e0 END),0e0),0.995e0)')} AS {c}" for c in "rgb")


_NODES = [i / 8 for i in range(9)]
_LUTV = "SELECT image_id, black, [" + ", ".join(f"asinh({cl(f'({g!r}-black)/greatest(1e0-black,1e-12)')}*20e0)/asinh(20e0)" for g in _NODES) + "] AS t FROM (SELECT image_id, quantile_cont(l,0.05) black FROM lum GROUP BY image_id)"
_LUTM = "CASE WHEN ll>=1 THEN t[9] ELSE t[i]+(t[i+1]-t[i])/0.125e0*(ll-(i-1)*0.125e0) END"


@query("display_lut", with_views("lum", f"SELECT image_id, y, x, {r6('l')} AS l, {r6('mapped')} AS mapped, {_gain('mapped')} FROM (SELECT *, {_LUTM} AS mapped FROM (SELECT *, {cl('l')} AS ll, CAST(floor({cl('l')}*8e0) AS INT)+1 AS i FROM lum JOIN lut USING (image_id)))", lut=_LUTV))
def display_lut(spark, d):
    return out(op.display_lut(fx.lum(spark, d), 9, 0.05, 20.0), "l", "mapped", "r", "g", "b")


@query("two_step_tone", with_views("lum", f"SELECT image_id, y, x, {r6('gamma')} AS gamma, {_gain('pow('+cl('l1')+',gamma)','l1')} FROM disp JOIN (SELECT image_id, {cl('ln(least(greatest(0.11e0,0.04e0),s))/ln(s)','1e0','1.65e0')} AS gamma FROM (SELECT image_id, {cl('quantile_cont(l1,0.25)','0.02e0','0.8e0')} AS s FROM disp GROUP BY image_id)) USING (image_id)",
    lut=_LUTV, d0=f"SELECT image_id, y, x, r, g, b, l, {_LUTM} AS mapped FROM (SELECT *, {cl('l')} AS ll, CAST(floor({cl('l')}*8e0) AS INT)+1 AS i FROM lum JOIN lut USING (image_id))",
    d1="SELECT image_id, y, x, " + ", ".join(f"least(greatest({c}*g0*(CASE WHEN greatest(r,g,b)*g0>0.995e0 THEN 0.995e0/(greatest(r,g,b)*g0) ELSE 1e0 END),0e0),0.995e0) AS {c}" for c in "rgb") + " FROM (SELECT *, CASE WHEN l>1e-12 THEN mapped/l ELSE 0e0 END AS g0 FROM d0)",
    disp=f"SELECT *, {lum3()} AS l1 FROM d1"))
def two_step_tone(spark, d):
    shown = op.display_lut(fx.lum(spark, d), 9, 0.05, 20.0)
    return out(op.two_step_tone(shown, 0.11), "gamma", "r", "g", "b")


@query("local_masks", with_views("dlum", f"""SELECT image_id, y, x, {r6(cl(f"(1e0-{ss('l','q[1]','q[3]')})*(1e0-0.6e0*detail)"))} AS background,
  {r6(cl(f"{ss('l','q[3]','q[5]')}*(1e0-0.92e0*core)*(1e0-0.3e0*detail)"))} AS subject, {r6(cl(f"{ss('l','q[2]','q[4]')}*(1e0-{ss('l','q[4]','q[5]')})*(1e0-0.75e0*core)"))} AS faint,
  {r6('core')} AS core, {r6('detail')} AS detail, {r6(cl('(greatest(r,g,b)-least(r,g,b))/greatest(l,1e-5)'))} AS chroma FROM
  (SELECT dt.*, {cl('c1.c0')} AS core FROM dt JOIN c1 USING (image_id,y,x))""",
  s1=blur_sql("dlum", "l", 1), s2=blur_sql("s1", "l", 1), d0="SELECT d.*, abs(d.l-s2.l) AS dr FROM dlum d JOIN s2 USING (image_id,y,x)",
  qq="SELECT image_id, quantile_cont(l,[0.10,0.35,0.55,0.75,0.92,0.995]) q, quantile_cont(dr,0.98) ds FROM d0 GROUP BY image_id",
  dt=f"SELECT *, {cl('dr/greatest(ds,1e-7)')} AS detail, {ss('l','q[5]','q[6]')} AS c0 FROM d0 JOIN qq USING (image_id)", c1=blur_sql("dt", "c0", 1)))
def local_masks(spark, d):
    return out(op.local_masks(fx.dlum(spark, d)), "background", "subject", "faint", "core", "detail", "chroma")


_PTS = [(0.0, 0.0), (0.3, 0.2), (0.7, 0.8), (1.0, 1.0)]
_CV = "CASE WHEN l<0.3e0 THEN 0.2e0/0.3e0*l WHEN l<0.7e0 THEN 0.2e0+(0.8e0-0.2e0)/(0.7e0-0.3e0)*(l-0.3e0) WHEN l<1 THEN 0.8e0+(1e0-0.8e0)/(1e0-0.7e0)*(l-0.7e0) ELSE 1e0 END"


@query("monotonic_curve_masked", with_views("msk", f"SELECT image_id, y, x, {', '.join(f'{r6(f'{c}*(1e0-subject*0.6e0)+{c}*(({_CV})/greatest(l,1e-7))*(subject*0.6e0)')} AS {c}' for c in 'rgb')} FROM msk"))
def monotonic_curve_masked(spark, d):
    return out(op.curve_masked(fx.masked(spark, d), _PTS, 0.6), "r", "g", "b")


@query("screen_blend", with_views("pair", f"SELECT image_id, y, x, {', '.join(f'{r6(f'{c}*(1e0-subject)+(1e0-(1e0-{c})*(1e0-{cl(f'{c}2*it')}))*subject')} AS {c}' for c in 'rgb')} FROM (SELECT *, CASE WHEN core>0.5 THEN 0.8e0 WHEN background>0.5 THEN 1.1e0 ELSE 0.8e0 END AS it FROM pair)"))
def screen_blend(spark, d):
    it = F.when(C("core") > 0.5, 0.8).when(C("background") > 0.5, 1.1).otherwise(0.8)
    p = fx.pair(spark, d)
    return out(p.withColumns({c: px.screen(C(c), C(f"{c}2"), it, C("subject")) for c in "rgb"}), "r", "g", "b")


@query("linear_decomposition_audit", with_views("pair", f"SELECT image_id, count(*)//3 AS pixels, {r6('avg(e)')} AS mae, {r6('quantile_cont(e,0.95)')} AS p95, {r6('max(e)')} AS max_error FROM (SELECT image_id, unnest([abs(r2+(r-r2)-r),abs(g2+(g-g2)-g),abs(b2+(b-b2)-b)]) e FROM pair) GROUP BY image_id"))
def linear_decomposition_audit(spark, d):
    return rounded(op.linear_decomposition(fx.pair(spark, d)), "mae", "p95", "max_error")


_TR = "SELECT *, core>0.5 AS support, {} AS r3, {} AS g3, {} AS b3 FROM pair".format(*[f"greatest({c}-{c}2,0)*1.1e0" for c in "rgb"])


@query("unscreen_layer", with_views("pair", f"""SELECT image_id, y, x, reliable, {rsel('lr lg lb','layer_r layer_g layer_b')}, count(*) FILTER (reliable) OVER w / greatest(count(*) FILTER (support) OVER w, 1)::DOUBLE >= 0.5 AS available FROM (
  SELECT *, {', '.join(f'{cl(f"{c}3*(CASE WHEN tp>1e-7 THEN (CASE WHEN reliable THEN greatest(tp,least(rp,0.95e0)) ELSE tp END)/tp ELSE 0e0 END)")} AS l{c}' for c in 'rgb')} FROM (
  SELECT *, greatest(r3,g3,b3) AS tp, greatest({', '.join(cl(f'({c}-{c}2)/greatest(1e0-{c}2,0.08e0)') for c in 'rgb')}) AS rp,
  support AND least(1-r2,1-g2,1-b2)>=0.08e0 AND greatest(r,g,b)<0.995e0 AND least(r-r2,g-g2,b-b2)>=-tol AND greatest(r3,g3,b3)>1e-7 AS reliable FROM tr JOIN tl USING (image_id))) WINDOW w AS (PARTITION BY image_id)""",
  tr=_TR, res="SELECT image_id, unnest([r-r2,g-g2,b-b2]) AS v FROM tr WHERE NOT support", md="SELECT image_id, median(v) m FROM res GROUP BY image_id",
  tl="SELECT image_id, least(greatest(median(abs(v-m))*(3e0*1.4826e0),2e-6),0.002e0) AS tol FROM res JOIN md USING (image_id) GROUP BY image_id"))
def unscreen_layer(spark, d):
    p = fx.pair(spark, d).withColumn("support", C("core") > 0.5)
    p = p.withColumns({f"{c}3": F.greatest(C(c) - C(f"{c}2"), F.lit(0.0)) * 1.1 for c in "rgb"})
    return out(op.unscreen_layer(p, reliable_min=0.5), "layer_r", "layer_g", "layer_b", keep=("reliable", "available"))


def _keep(m):  # SQL of keep_luminance for mapped expressions m over r,g,b
    t = lum3()
    have = f"(0.2126e0*{m[0]}+0.7152e0*{m[1]}+0.0722e0*{m[2]})"
    return t, have


_HOS = [cl("r"), cl("(g+b)*0.5e0"), cl(f"({cl('r')}+{cl('(g+b)*0.5e0')})*0.5e0")]  # H, O, S


def _room(t, p, most="1e0"):
    return f"(CASE WHEN {p}>1e-7 THEN least({most},(1e0-{t})/{p}) WHEN {p}< -1e-7 THEN least({most},{t}/-({p})) ELSE {most} END)"


_PAL = ("SELECT *, 0.2126e0*m1+0.7152e0*m2+0.0722e0*m3 AS have FROM (SELECT *, {l} AS t, {s} AS m1, {h} AS m2, {o} AS m3 FROM msk)".format(l=lum3(), h=_HOS[0], o=_HOS[1], s=_HOS[2]))
_PAL2 = "SELECT *, " + ", ".join(f"m{i}*(t/have)-t AS p{i}" for i in (1, 2, 3)) + " FROM pal"
_PAL3 = f"SELECT *, {cl('least('+','.join(_room('t',f'p{i}') for i in (1,2,3))+')*0.995e0')} AS sc FROM pal2"
_PAL4 = "SELECT *, " + ", ".join(f"CASE WHEN have>1e-6 THEN {cl(f't+p{i}*sc')} ELSE {cl(c)} END AS k{i}" for i, c in zip((1, 2, 3), "rgb")) + " FROM pal3"
_PAL5 = "SELECT *, 0.2126e0*k1+0.7152e0*k2+0.0722e0*k3 AS t2 FROM pal4"
_PAL6 = "SELECT *, " + f"least(greatest(least({','.join(_room('t2',f'(k{i}-t2)','1.2e0') for i in (1,2,3))})*0.995e0,0e0),1.2e0) AS s2 FROM pal5"
_PAL7 = "SELECT *, " + ", ".join(f"{c}+({cl(f't2+(k{i}-t2)*s2')}-{c})*{cl('subject')} AS {c}2" for i, c in zip((1, 2, 3), "rgb")) + " FROM pal6"
_PALS = dict(pal=_PAL, pal2=_PAL2, pal3=_PAL3, pal4=_PAL4, pal5=_PAL5, pal6=_PAL6, pal7=_PAL7)


@query("palette_map", with_views("msk", f"SELECT image_id, y, x, {rsel('k1 k2 k3','r g b')} FROM pal4", **{k: _PALS[k] for k in ("pal", "pal2", "pal3", "pal4")}))
def palette_map(spark, d):
    return out(op.palette_map(fx.masked(spark, d), "SHO", ("r", "g", "b")), "r", "g", "b")


@query("palette_candidate", with_views("msk", f"""SELECT image_id, {rsel('lp cg oc','luma_drift_p95 clip_growth outside_change')}, CASE WHEN lp>0.0075e0 OR cg>0.003e0 OR oc>1e-6 THEN 'rejected' WHEN lp>0.005e0 OR cg>0.002e0 THEN 'accepted_with_warning' ELSE 'accepted' END AS status,
  concat_ws(',', CASE WHEN lp>0.0075e0 THEN 'luminance_drift' END, CASE WHEN cg>0.003e0 THEN 'clip_growth' END, CASE WHEN oc>1e-6 THEN 'outside_subject_change' END) AS issues FROM (
  SELECT image_id, quantile_cont(abs({lum3('2')}-{lum3()}),0.95) AS lp, avg(CASE WHEN least(r2,g2,b2)<=0 OR greatest(r2,g2,b2)>=1 THEN 1 ELSE 0 END)-avg(CASE WHEN least(r,g,b)<=0 OR greatest(r,g,b)>=1 THEN 1 ELSE 0 END) AS cg,
  coalesce(max(greatest(abs(r2-r),abs(g2-g),abs(b2-b))) FILTER (subject<=0),0) AS oc FROM pal7 GROUP BY image_id)""", **_PALS))
def palette_candidate(spark, d):
    q = op.palette_quality(op.palette_candidate(fx.masked(spark, d), "SHO", 1.2))
    return rounded(q, "luma_drift_p95", "clip_growth", "outside_change")


@query("subject_chroma_boost", with_views("msk", f"""SELECT image_id, y, x, {r6('factor')} AS factor, {', '.join(f'{r6(cl(f"l+p{c}*rm"))} AS {c}' for c in 'rgb')} FROM (SELECT *, least({','.join(_room('l',f'p{c}') for c in 'rgb')}) AS rm FROM (
  SELECT *, {', '.join(f'({c}-l)*(1e0+(factor-1e0)*subject) AS p{c}' for c in 'rgb')} FROM msk JOIN (SELECT image_id, {cl(f"1e0+((CASE WHEN s50>1e-6 THEN {cl('1e0+2e0*greatest(0.3e0/s50-1e0,0e0)','1.12e0','4e0')} ELSE 1.12e0 END)-1e0)*0.75e0",'1e0','4e0')} AS factor
  FROM (SELECT image_id, quantile_cont({_SAT},0.5) FILTER (subject>0.05) AS s50 FROM msk GROUP BY image_id)) USING (image_id)))"""))
def subject_chroma_boost(spark, d):
    return out(op.subject_chroma_boost(fx.masked(spark, d), 0.30), "factor", "r", "g", "b")


_RST = "(subject<=1e-6 OR background>=0.5 OR core>=0.5)"


@query("luminance_only_delta", with_views("pair", f"""SELECT image_id, y, x, {', '.join(f"{r6(f'CASE WHEN {_RST} THEN {cl(c)} ELSE {cl(f"{c}+({cl(f"{c}*gn")}-{c})*subject")} END')} AS {c}" for c in 'rgb')}, {_RST} AS restored,
  {', '.join(f"{r6(f'CASE WHEN {_RST} THEN {cl(c)} ELSE {cl(f"{c}+({cl(f"l+{c}2-l2")}-{c})*subject*0.5e0")} END')} AS {c}_colour" for c in 'rgb')} FROM (SELECT *, {lum3('2')} AS l2, {cl(f"CASE WHEN l>1e-5 THEN {lum3('2')}/l ELSE 1e0 END",'0.5e0','1.5e0')} AS gn FROM pair)"""))
def luminance_only_delta(spark, d):
    p = fx.pair(spark, d)
    lumi = op.luminance_only(p)
    col = op.colour_only(p, 0.20).select(*K3, *[C(c).alias(f"{c}_colour") for c in "rgb"])
    return out(lumi.join(col, K3), "r", "g", "b", "r_colour", "g_colour", "b_colour", keep=("restored",))


@query("background_chroma_rescue", with_views("msk", f"SELECT image_id, y, x, {', '.join(f'{r6(cl(f"l+({c}-l)*(1e0-0.6e0*background)"))} AS {c}' for c in 'rgb')} FROM msk"))
def background_chroma_rescue(spark, d):
    return out(op.chroma_rescue(fx.masked(spark, d), F.lit(1.0) - F.lit(0.6) * C("background")), "r", "g", "b")


@query("neutral_axis_projection", with_views("pair", f"SELECT image_id, y, x, {rsel('r+d g+d b+d','r g b')}, true AS opponent_unchanged FROM (SELECT *, d0-avg(d0) OVER (PARTITION BY image_id) AS d FROM (SELECT *, {lum3('2')}-l AS d0 FROM pair))"))
def neutral_axis_projection(spark, d):
    return out(op.neutral_axis(fx.pair(spark, d)), "r", "g", "b", keep=("opponent_unchanged",))


@query("subtract_to_lowest", with_views("msk", f"SELECT image_id, y, x, {', '.join(f'{r6(f"greatest({c}-greatest(m{c}-least(mr,mg,mb),0e0),0e0)")} AS {c}' for c in 'rgb')} FROM msk JOIN (SELECT image_id, median(r) mr, median(g) mg, median(b) mb FROM msk WHERE background>0.5 GROUP BY image_id) USING (image_id)"))
def subtract_to_lowest(spark, d):
    return out(op.subtract_to_lowest(fx.masked(spark, d), C("background") > 0.5), "r", "g", "b")


@query("star_layer_cleanup", with_views("dense", f"""SELECT image_id, y, x, p>=fl AS core, {r6('kp')} AS keep, {rsel('r*kp g*kp b*kp','r g b')} FROM (SELECT *, CASE WHEN p>=fl THEN 1e0 ELSE {ss('greatest(p-least(ps,p),0e0)','0e0','greatest(fl-pm,1e-6)')} END AS kp FROM (
  SELECT d.*, s.p AS ps, pm, pm+3e0*1.4826e0*pa AS fl FROM pk d JOIN soft s USING (image_id,y,x) JOIN pa USING (image_id)))""",
  pk="SELECT *, greatest(r,g,b) AS p FROM dense", soft=blur_sql("pk", "p", 2),
  pm="SELECT image_id, median(p) pm FROM pk GROUP BY image_id", pa="SELECT image_id, any_value(pm) pm, median(abs(p-pm)) pa FROM pk JOIN pm USING (image_id) GROUP BY image_id"))
def star_layer_cleanup(spark, d):
    return out(op.star_layer_cleanup(fx.dense(spark, d)), "keep", "r", "g", "b", keep=("core",))


@query("star_colour_repair", with_views("pair", f"""SELECT image_id, samples, {rsel('eb ea fd','error_before error_after flux_drift')}, (eb-ea>=0.02e0 AND fd<=0.03e0 AND samples>=8) AS accepted FROM (
  SELECT image_id, count(*) FILTER (v) AS samples, median({'greatest('+','.join(f'abs({c}/greatest(r+g+b,1e-7)-t{c})' for c in 'rgb')+')'}) FILTER (v) AS eb, median({'greatest('+','.join(f'abs({c}3/greatest(r3+g3+b3,1e-7)-t{c})' for c in 'rgb')+')'}) FILTER (v) AS ea,
  abs(sum({lum3('3')}) FILTER (support)/greatest(sum(l) FILTER (support),1e-7)-1e0) AS fd FROM (SELECT *, {', '.join(f'{cl(f"{c}*(1e0-bl)+t{c}*(l/greatest(un,1e-7))*bl")} AS {c}3' for c in 'rgb')} FROM
  (SELECT *, CASE WHEN v THEN 0.7e0 ELSE 0e0 END AS bl, 0.2126e0*tr+0.7152e0*tg+0.0722e0*tb AS un FROM (SELECT *, {', '.join(f'{c}2/greatest(s1,1e-7) AS t{c}' for c in 'rgb')}, support AND s0>greatest(q0,1e-6) AND s1>greatest(q1,1e-7) AS v FROM st JOIN sq USING (image_id)))) GROUP BY image_id)""",
  st="SELECT *, r+g+b AS s0, r2+g2+b2 AS s1, subject>0.3 AS support FROM pair", sq="SELECT image_id, quantile_cont(s0,0.75) q0, quantile_cont(s1,0.75) q1 FROM st GROUP BY image_id"))
def star_colour_repair(spark, d):
    p = fx.pair(spark, d).withColumn("support", C("subject") > 0.3)
    return rounded(op.star_colour_repair(p, 0.7), "error_before", "error_after", "flux_drift")


@query("halo_guard_apply", with_views("dpair", f"""SELECT image_id, n AS support, {rsel('t1/greatest(t0,1e-6) td cd','texture_growth texture_delta chroma_delta_p95')}, (n>=8 AND t1/greatest(t0,1e-6)>1.05e0 AND td>0.00075e0) AS texture_failed, (n>=8 AND cd>0.006e0) AS chroma_failed,
  {rsel('sg')} FROM (SELECT image_id, count(*) FILTER (gd>0.05) n, median(abs(l2-s2.l2)-abs(l-s.l)) FILTER (gd>0.05) td, median(abs(l-s.l)) FILTER (gd>0.05) t0, median(abs(l2-s2.l2)) FILTER (gd>0.05) t1,
  quantile_cont((greatest(r2,g2,b2)-least(r2,g2,b2))-(greatest(r,g,b)-least(r,g,b)),0.95) FILTER (gd>0.05) cd, avg({cl('subject*'+cl('1e0-gd'))}) sg
  FROM g0 JOIN s USING (image_id,y,x) JOIN s2 USING (image_id,y,x) GROUP BY image_id)""".replace("abs(l2-s2.l2)", "abs(g0.l2-s2.l2)").replace("abs(l-s.l)", "abs(g0.l-s.l)"),
  g0=f"SELECT *, core*0.9e0+0.02e0*(x%4) AS gd, {lum3('2')} AS l2 FROM dpair", s=blur_sql("g0", "l", 1), s2=blur_sql("g0", "l2", 1)))
def halo_guard_apply(spark, d):
    p = fx.with_candidate(fx.dmasked(spark, d), 2).withColumn("guard", C("core") * 0.9 + F.lit(0.02) * (C("x") % 4))
    v = op.halo_guard_verdict(p)
    m = op.halo_guard(p, ["subject"]).groupBy("image_id").agg(F.avg("subject").alias("sg"))
    return rounded(v.join(m, "image_id"), "texture_growth", "texture_delta", "chroma_delta_p95", "sg")


@query("boundary_retained_delta", with_views("dpair", f"""SELECT image_id, CAST(retained AS DOUBLE) AS retained, y, x, {r6('k')} AS scale, {', '.join(f'{r6(f"{c}+({c}2-{c})*k")} AS {c}' for c in 'rgb')} FROM (
  SELECT d.*, b3.retained, CASE WHEN subject<=0.05 THEN 0e0 ELSE least(greatest(b3.s,0e0),b3.retained) END AS k FROM dpair d JOIN b3 USING (image_id,y,x))""",
  cap=f"SELECT image_id, {cl('least(1e0, CASE WHEN lr>0.0035e0 THEN 0.0035e0/lr ELSE 1e0 END)*0.98e0','0.02e0','1e0')} AS cap FROM (SELECT image_id, 0.001e0*(image_id%9) AS lr FROM px GROUP BY image_id)",
  b0="SELECT d.image_id, d.y, d.x, CAST(t.retained AS DOUBLE) AS retained, CASE WHEN subject<=0.05 THEN 0e0 WHEN subject<0.8 THEN cap*t.retained ELSE t.retained END AS s FROM dpair d JOIN cap USING (image_id), (VALUES (1e0),(0.75e0),(0.5e0),(0.25e0)) t(retained)",
  b1=blur_sql("b0", "s", 1, keys="image_id, retained"), b2=blur_sql("b1", "s", 1, keys="image_id, retained"), b3=blur_sql("b2", "s", 1, keys="image_id, retained")))
def boundary_retained_delta(spark, d):
    p = fx.with_candidate(fx.dmasked(spark, d), 2)
    seam = p.groupBy("image_id").agg(F.lit(0.0).alias("chroma_residual"), F.lit(1.0).alias("luma_ratio"), F.lit(1.0).alias("chroma_ratio"))
    seam = seam.withColumn("luma_residual", F.lit(0.001) * (C("image_id") % 9))
    return out(op.boundary_retained(p, seam), "scale", "r", "g", "b", keep=("retained",))


@query("bright_core_clamp", with_views("pair", f"SELECT image_id, y, x, {', '.join(f'{r6(f"CASE WHEN core>0 AND {c}2-{c}>0.01e0 THEN {c} ELSE {c}2 END")} AS {c}' for c in 'rgb')}, core>0 AND greatest(r2-r,g2-g,b2-b)>0.01e0 AS repaired FROM pair"))
def bright_core_clamp(spark, d):
    return out(op.core_clamp(fx.pair(spark, d).withColumn("core", C("core") > 0)), "r", "g", "b", keep=("repaired",))
