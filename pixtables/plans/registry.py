"""Registry of named queries, each with its check SQL where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


# Base views for the check SQL (the same shapes as sources.fixtures).
VIEWS: dict[str, str] = {
    "px": """SELECT l_suppkey AS image_id, CAST(l_orderkey % 16 AS INT) AS y, CAST(l_partkey % 16 AS INT) AS x,
  max(l_quantity)/50.0e0 AS r, max(l_extendedprice)/105000.0e0 AS g, max(l_discount)*10.0e0 AS b
  FROM lineitem GROUP BY l_suppkey, CAST(l_orderkey % 16 AS INT), CAST(l_partkey % 16 AS INT)""",
    "dense": """SELECT i.image_id, CAST(gy.y AS INT) AS y, CAST(gx.x AS INT) AS x,
  coalesce(p.r, i.mr) AS r, coalesce(p.g, i.mg) AS g, coalesce(p.b, i.mb) AS b
  FROM (SELECT image_id, quantile_cont(r,0.5) mr, quantile_cont(g,0.5) mg, quantile_cont(b,0.5) mb FROM px GROUP BY image_id) i
  CROSS JOIN range(16) gy(y) CROSS JOIN range(16) gx(x)
  LEFT JOIN px p ON p.image_id=i.image_id AND p.y=gy.y AND p.x=gx.x""",
    "lum": "SELECT *, 0.2126e0*r+0.7152e0*g+0.0722e0*b AS l FROM px",
    "dlum": "SELECT *, 0.2126e0*r+0.7152e0*g+0.0722e0*b AS l FROM dense",
    "cand": """SELECT image_id, y, x, k, r*(1.0e0-0.1e0*k)+0.02e0*k AS r, g*(1.0e0-0.05e0*k) AS g,
  b*(1.0e0-0.1e0*k)+0.01e0*x*k/16 AS b FROM px CROSS JOIN (VALUES (1),(2),(3),(4)) c(k)""",
    "frame_stack": """SELECT l_suppkey AS frame_id, CAST(l_orderkey % 16 AS INT) AS y, CAST(l_partkey % 16 AS INT) AS x,
  max(l_extendedprice) AS v FROM lineitem GROUP BY ALL""",
    "points": """SELECT image_id, y*16+x AS point_id, y, x, CASE WHEN (y+x) % 8 = 0 THEN 'validation' ELSE 'fit' END AS split
  FROM px WHERE y % 4 = 2 AND x % 4 = 2""",
    "frames": """SELECT doc_id AS frame_id, source AS target, CASE WHEN lang='en' THEN 'LP' WHEN lang='fr' THEN 'Ha OIII'
  WHEN lang='de' THEN 'No Filter' ELSE '' END AS filter,
  concat(CASE WHEN doc_id % 7 = 0 THEN 'dark_' ELSE 'Light_' END, CAST(doc_id AS VARCHAR), '.fit') AS name, n_chars AS bytes FROM documents""",
    "sky": """SELECT s_suppkey AS sky_id, s_name AS name, CAST((s_suppkey*137) % 360 AS DOUBLE) AS ra_deg,
  CAST((s_suppkey*61) % 161 - 80 AS DOUBLE) AS dec_deg, CAST(20 + s_suppkey % 170 AS DOUBLE) AS size_arcmin FROM supplier""",
    "pointing": """SELECT c_custkey AS frame_id, CAST((c_custkey*97) % 3600 AS DOUBLE)/10 AS ra_deg,
  CAST((c_custkey*61) % 1610 AS DOUBLE)/10-80 AS dec_deg, c_name AS text FROM customer""",
    "stars": """SELECT 'O' AS role, vec_id AS star_id, CAST(embedding[1] AS DOUBLE)*400 AS x, CAST(embedding[2] AS DOUBLE)*400 AS y,
  abs(CAST(embedding[3] AS DOUBLE))*1000+1 AS flux FROM embeddings
  UNION ALL SELECT 'B', vec_id, CAST(embedding[1] AS DOUBLE)*400+CAST(embedding[4] AS DOUBLE)*8,
  CAST(embedding[2] AS DOUBLE)*400+CAST(embedding[5] AS DOUBLE)*8, abs(CAST(embedding[3] AS DOUBLE))*500+1 FROM embeddings WHERE vec_id % 3 <> 0
  UNION ALL SELECT 'C', vec_id, CAST(embedding[1] AS DOUBLE)*400+CAST(embedding[6] AS DOUBLE)*4,
  CAST(embedding[2] AS DOUBLE)*400+CAST(embedding[7] AS DOUBLE)*4, abs(CAST(embedding[3] AS DOUBLE))*900+1 FROM embeddings WHERE vec_id % 11 <> 0""",
    "steps": """SELECT l_orderkey AS run_id, l_linenumber AS stage, CASE l_returnflag WHEN 'R' THEN (CASE WHEN l_quantity > 48 THEN 'failed'
  ELSE 'degraded' END) ELSE 'ok' END AS status, l_tax > 0.07e0 AS fallback_used, l_quantity AS duration FROM lineitem""",
    "reviews": """SELECT l_orderkey AS run_id, l_linenumber AS stage, concat('code_', CAST(l_suppkey % 5 AS VARCHAR)) AS code
  FROM lineitem WHERE l_discount > 0.09e0""",
    "runs": """SELECT o_custkey AS task_id, o_orderkey AS run_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'success'
  WHEN 'P' THEN 'running' ELSE 'preparing' END AS status, o_orderpriority AS owner_session FROM orders""",
    "run_events": """SELECT event_id, ts, user_id AS run_id, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress'
  WHEN 'signup' THEN 'stage_start' WHEN 'purchase' THEN 'stage_result' ELSE 'error' END AS kind, value, props AS payload FROM events""",
}


def ss(e: str, lo: str, hi: str) -> str:
    """SQL twin of functions.fixed.smoothstep."""
    t = f"least(greatest((({e})-({lo}))/greatest(({hi})-({lo}),1e-12),0e0),1e0)"
    return f"({t}*{t}*(3e0-2e0*{t}))"


def lum3(s: str = "", p: str = "") -> str:
    return f"(0.2126e0*{p}r{s}+0.7152e0*{p}g{s}+0.0722e0*{p}b{s})"


def cl(e: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"least(greatest({e},{lo}),{hi})"


def _masks(src: str) -> str:
    return (f"SELECT p.*, {ss('l','q55','q92')} AS subject, 1e0-{ss('l','q10','q55')} AS background, CASE WHEN l>=q92 THEN 1e0 ELSE 0e0 END AS core FROM {src} p "
            f"JOIN (SELECT image_id, quantile_cont(l,0.10) q10, quantile_cont(l,0.55) q55, quantile_cont(l,0.92) q92 FROM {src} GROUP BY image_id) USING (image_id)")


_CAND2 = "r*(1e0-0.1e0*2)+0.02e0*2 AS r2, g*(1e0-0.05e0*2) AS g2, b*(1e0-0.1e0*2)+0.01e0*x*2/16 AS b2"
VIEWS["msk"] = _masks("lum")
VIEWS["dmsk"] = _masks("dlum")
VIEWS["pair"] = f"SELECT *, {_CAND2} FROM msk"
VIEWS["dpair"] = f"SELECT *, {_CAND2} FROM dmsk"
_NEEDS = {"msk": ["px", "lum"], "dmsk": ["px", "dense", "dlum"], "pair": ["px", "lum", "msk"], "dpair": ["px", "dense", "dlum", "dmsk"],
          "dense": ["px"], "lum": ["px"], "dlum": ["px", "dense"], "cand": ["px"], "points": ["px"]}


def with_views(names: str, body: str, **extra: str) -> str:
    """``WITH`` the named base views, then the extra views in order, then the body."""
    order: list[str] = []
    for n in names.split():
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order] + [f"{n} AS MATERIALIZED ({s})" for n, s in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r6(expr: str, digits: int = 6) -> str:
    """SQL twin of functions.fixed.fixed."""
    s = f"1e{digits}"
    return f"floor(({expr}) * {s} + 0.5001234e0) / {s}"


def blur_sql(src: str, cols: str, r: int, n: int = 16, keys: str = "image_id") -> str:
    """Mean over the mirrored (2r+1)^2 neighbourhood, by direct lookup."""
    ks = [k.strip() for k in keys.split(",")]
    sel = ", ".join(f"avg(s.{c}) AS {c}" for c in cols.split())
    on = " AND ".join(f"s.{k}=d.{k}" for k in ks)
    kd = ", ".join(f"d.{k}" for k in ks)
    mir = lambda e: f"(CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > {n-1} THEN {2*(n-1)}-({e}) ELSE {e} END)"
    return (
        f"SELECT {kd}, d.y, d.x, {sel} FROM (SELECT {', '.join(ks)}, y, x, {mir('y+dy')} AS sy, {mir('x+dx')} AS sx FROM {src}, "
        f"range(-{r},{r+1}) a(dy), range(-{r},{r+1}) b(dx)) d JOIN {src} s ON {on} AND s.y=d.sy AND s.x=d.sx GROUP BY {kd}, d.y, d.x"
    )
