"""Queries over run bookkeeping."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import fixed
from ..operators import audit as op
from ..sources import fixtures as fx, headers
from .registry import VIEWS, query, r6, with_views

# ---- tables of this area, derived from orders and lineitem -----------------
_PATHS = ["result_processed.png", "result_display_srgb.png", "result_review.png", "process/stage5_linear.fit", "../outside.png", "result_linear.fit", ""]


def _lines(spark, d):
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("idx")).agg(
        F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").cast("long").alias("q"))


def _hash(*parts):
    return F.sha2(F.concat_ws("-", *[p.cast("string") for p in parts]), 256)


def outputs(spark, d):
    """Declared and found files of each run: some are missing, some altered."""
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), F.col("idx"))
    li = _lines(spark, d).withColumn("path", path)
    sha = _hash(F.col("run_id"), F.col("idx"), F.col("p"))
    declared = li.select("run_id", F.concat(F.lit("out_"), F.col("idx").cast("string")).alias("name"), "path", sha.alias("sha256"), "idx", "q")
    actual = li.where(F.col("s") % 11 != 0).select(
        "run_id", "path", F.when(F.col("s") % 13 == 0, F.sha2(F.lit("altered"), 256)).otherwise(sha).alias("sha256"), (F.col("q") * 1000).alias("size"))
    return declared, actual


_V = {
    "li": "SELECT l_orderkey AS run_id, l_linenumber AS idx, max(l_partkey) p, max(l_suppkey) s, CAST(max(l_quantity) AS BIGINT) q FROM lineitem GROUP BY ALL",
    "outs": f"SELECT run_id, idx, p, s, q, list_extract({_PATHS!r}, idx) AS path, sha256(concat(run_id,'-',idx,'-',p)) AS sha, concat('out_', idx) AS name FROM li",
    "verd": """SELECT *, CASE WHEN path='' THEN 'invalid_path' WHEN path LIKE '../%' THEN 'escapes' WHEN s%11=0 THEN 'missing'
      WHEN s%13=0 THEN 'mismatch' ELSE 'verified' END AS verdict FROM outs""",
}


def v(names: str, *more: str) -> dict[str, str]:
    return {n: _V[n] for n in more}


def step_issues(spark, d):
    st, fb = F.col("status"), F.col("fallback_used")
    sev = F.when(st == "failed", "fatal").when(fb, "error").otherwise(" Warning")
    code = F.when(st == "failed", "stage_failed").when(fb, "").otherwise("quality")
    i = F.struct(F.lit(None).cast("int").alias("stage"), sev.alias("severity"), code.alias("code"), (fb & (st != "failed")).alias("recovered"), F.lit(None).cast("string").alias("message"))
    return fx.steps(spark, d).withColumn("issues", F.when((st != "ok") | fb, F.array(i)).otherwise(F.array().cast("array<struct<stage:int,severity:string,code:string,recovered:boolean,message:string>>")))


def extra_issues(spark, d):
    o = fx.runs(spark, d).where(F.col("run_id") % 9 == 0)
    return o.select("run_id", F.lit(11).alias("stage"), F.lit("error").alias("severity"), F.lit("late").alias("code"), F.lit(True).alias("recovered"), F.concat(F.lit("by "), "owner_session").alias("message"))


_ISSUES = """SELECT run_id, CAST(stage AS INT) AS stage, CASE WHEN status='failed' THEN 'fatal' WHEN fallback_used THEN 'error' ELSE 'warning' END AS severity,
  CASE WHEN status='failed' THEN 'stage_failed' WHEN fallback_used THEN 'unspecified_issue' ELSE 'quality' END AS code,
  (fallback_used AND status<>'failed') AS recovered,
  CASE WHEN status='failed' THEN 'stage_failed' WHEN fallback_used THEN 'unspecified_issue' ELSE 'quality' END AS message
  FROM steps WHERE status<>'ok' OR fallback_used
  UNION ALL SELECT run_id, 0, 'error', 'late', true, concat('by ', owner_session) FROM runs WHERE run_id%9=0"""


@query("issue_union", with_views("steps runs", _ISSUES))
def issue_union(spark, d):
    return op.issue_union(step_issues(spark, d), extra_issues(spark, d))


@query("review_dedup", with_views("reviews", "SELECT run_id, stage, code, count(*) AS occurrences FROM reviews WHERE stage BETWEEN 1 AND 10 GROUP BY ALL"))
def review_dedup(spark, d):
    return op.review_dedup(fx.reviews(spark, d))


@query("run_outcome", with_views(
    "steps runs reviews",
    """SELECT run_id, CASE WHEN fatal>0 OR failed>0 THEN 'failed' WHEN rv>0 THEN 'review_required' WHEN degraded>0 OR fb>0 OR rec>0 THEN 'partial_success' ELSE 'success' END AS status,
    (fatal>0 OR failed>0 OR err>0) AS had_errors, (fatal>0 OR failed>0) AS had_fatal_errors, rv>0 AS review_required,
    failed AS failed_stages, dst AS degraded_stages, fb AS fallback_stages, rv AS review_requirements, iss AS issues, rec AS recovered_errors
    FROM (SELECT coalesce(s.run_id,i.run_id,r.run_id) AS run_id, coalesce(failed,0) failed, coalesce(degraded,0) degraded, coalesce(dst,0) dst, coalesce(fb,0) fb,
      coalesce(fatal,0) fatal, coalesce(err,0) err, coalesce(rec,0) rec, coalesce(iss,0) iss, coalesce(rv,0) rv
      FROM (SELECT run_id, count(*) FILTER (status='failed') failed, count(*) FILTER (status='degraded' OR (fallback_used AND status='ok')) degraded,
        count(*) FILTER (status='degraded' OR fallback_used) dst, count(*) FILTER (fallback_used) fb FROM steps GROUP BY run_id) s
      FULL JOIN (SELECT run_id, count(*) iss, count(*) FILTER (severity='fatal') fatal, count(*) FILTER (severity IN ('error','fatal')) err,
        count(*) FILTER (severity='error' AND recovered) rec FROM iss GROUP BY run_id) i ON i.run_id=s.run_id
      FULL JOIN (SELECT run_id, count(DISTINCT (stage, code)) rv FROM reviews GROUP BY run_id) r ON r.run_id=coalesce(s.run_id,i.run_id))""",
    iss=_ISSUES))
def run_outcome(spark, d):
    return op.run_outcome(step_issues(spark, d), fx.reviews(spark, d), extra_issues(spark, d))


@query("stage_duration_total", with_views("", """SELECT l_orderkey AS run_id, l_linenumber AS stage, sum(l_quantity) AS duration, count(*) AS attempts,
  max(struct_pack(a:=seq, b:=st)).b AS last_status FROM (SELECT *, l_partkey*100000+l_suppkey AS seq, CASE WHEN l_returnflag='R' THEN 'degraded' ELSE 'ok' END AS st FROM lineitem) GROUP BY ALL"""))
def stage_duration_total(spark, d):
    li = fx.table(spark, d, "lineitem")
    ev = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage"), F.col("l_quantity").alias("duration"),
                   (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"), F.when(F.col("l_returnflag") == "R", "degraded").otherwise("ok").alias("status"))
    return op.stage_duration_total(ev)


@query("output_totals", with_views("", """SELECT o_custkey AS task, o_orderpriority AS grp, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS bytes, count(*) AS files,
  CAST(grouping_id(o_custkey, o_orderpriority) AS INT) AS level FROM (SELECT o_custkey, o_orderpriority, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY ROLLUP (o_custkey, o_orderpriority)"""))
def output_totals(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("grp"), F.floor("o_totalprice").alias("size"))
    return op.output_totals(o)


@query("latest_run_summary", with_views("runs", """SELECT task_id, max(t0) AS latest_activity_at, max(struct_pack(a:=t0, b:=run_id, c:=status)).c AS latest_status,
  max(struct_pack(a:=t0, b:=run_id)).b AS latest_run_id, count(*) AS runs
  FROM (SELECT *, coalesce(CASE WHEN status='success' THEN started_at + INTERVAL 3 DAY END, started_at) AS t0 FROM runs) GROUP BY task_id"""))
def latest_run_summary(spark, d):
    r = fx.runs(spark, d).withColumn("completed_at", F.when(F.col("status") == "success", F.col("started_at") + F.expr("INTERVAL 3 DAY")))
    return op.latest_run_summary(r)


@query("interrupted_marker", with_views("runs", """SELECT task_id, run_id, owner_session, CASE WHEN dead THEN 'interrupted' ELSE status END AS status, dead AS changed FROM (
  SELECT *, status IN ('preparing','running') AND owner_session NOT IN (SELECT DISTINCT owner_session FROM runs WHERE run_id % 2 = 0 AND owner_session LIKE '1%') AS dead FROM runs)"""))
def interrupted_marker(spark, d):
    r = fx.runs(spark, d)
    return op.interrupted_marker(r, r.where((F.col("run_id") % 2 == 0) & F.col("owner_session").startswith("1")))


def tasks(spark, d):
    c = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(
        c.alias("task_id"), F.when(c % 5 == 0, "nonlinear").when(c % 7 == 0, "unknown").otherwise("linear").alias("state"),
        F.when(c % 3 == 0, "verified").otherwise("inferred").alias("trust"),
        F.when(c % 12 == 0, 5).when(c % 9 == 0, 2).cast("int").alias("resume_after"))


_TASKS = """SELECT c_custkey AS task_id, CASE WHEN c_custkey%5=0 THEN 'nonlinear' WHEN c_custkey%7=0 THEN 'unknown' ELSE 'linear' END AS state,
  CASE WHEN c_custkey%3=0 THEN 'verified' ELSE 'inferred' END AS trust, CASE WHEN c_custkey%12=0 THEN 5 WHEN c_custkey%9=0 THEN 2 END AS resume_after FROM customer"""
_CONTRACT = "SELECT * FROM (VALUES " + ", ".join(f"({n},'{k}','{p}','{a}',{str(r).lower()})" for n, k, p, a, r in op.STAGES) + ") c(stage,key,phase,artifact,resume_checkpoint)"
_PLAN = """SELECT task_id, c.*, CASE WHEN stage<=coalesce(resume_after,0) THEN 'verified' WHEN state='linear' OR stage<=2 THEN 'execute' WHEN stage=10 THEN 'review_export' ELSE 'input_state_guard' END AS action,
  CASE WHEN stage<=coalesce(resume_after,0) THEN 'verified_checkpoint_chain' WHEN state='linear' THEN 'planned_processing' WHEN stage<=2 THEN 'safe_input_preparation'
  WHEN stage=10 THEN 'review_only_input_state' ELSE 'input_state_not_linear' END AS reason
  FROM tasks CROSS JOIN contract c WHERE resume_after IS NULL OR (state='linear' AND trust='verified')"""


@query("plan_steps", with_views("", _PLAN, tasks=_TASKS, contract=_CONTRACT))
def plan_steps(spark, d):
    return op.plan_steps(tasks(spark, d))


@query("plan_verify", with_views("", """SELECT task_id, count(*) FILTER (s IS NULL) AS missing, count(*) FILTER (w IS NULL) AS extra, count(*) FILTER (s<>w) AS changed,
  count(*) FILTER (s IS NULL OR w IS NULL OR s<>w) = 0 AS verified FROM (
  SELECT coalesce(a.task_id,b.task_id) AS task_id, a.action AS s, b.action AS w FROM (SELECT task_id, CASE WHEN task_id%11=0 AND stage=4 THEN 99 ELSE stage END AS stage,
   CASE WHEN task_id%13=0 AND stage=3 THEN 'skip' ELSE action END AS action FROM plan) a FULL JOIN plan b ON a.task_id=b.task_id AND a.stage=b.stage) GROUP BY task_id""",
    tasks=_TASKS, contract=_CONTRACT, plan=_PLAN))
def plan_verify(spark, d):
    t = tasks(spark, d)
    tid, st = F.col("task_id"), F.col("stage")
    stored = op.plan_steps(t).select("task_id", F.when((tid % 11 == 0) & (st == 4), 99).otherwise(st).alias("stage"),
                                     F.when((tid % 13 == 0) & (st == 3), "skip").otherwise(F.col("action")).alias("action"))
    return op.plan_verify(stored, t)


# checkpoints: task = customer, stage from the orders of the customer
def checkpoints(spark, d):
    o = fx.table(spark, d, "orders").withColumn("stage", (F.col("o_orderkey") % 6 + 1).cast("int"))
    g = o.groupBy(F.col("o_custkey").alias("task_id"), "stage").agg(F.max("o_orderkey").alias("k"))
    art = F.element_at(F.create_map(*[F.lit(x) for n, _, _, a, r in op.STAGES if n <= 6 for x in (n, a)]), F.col("stage"))
    k = F.col("k")
    return g.select(
        "task_id", "stage", "k", F.when(k % 17 == 0, "other.fit").otherwise(art).alias("artifact"), F.when(k % 19 == 0, "nonlinear").otherwise("Linear").alias("state"),
        F.when(k % 23 == 0, " ").otherwise("h").alias("run_manifest_hash"), F.when(k % 5 != 0, "ctx").alias("semantic_context"),
        F.concat(F.lit("fp"), (k % 4).cast("string")).alias("fingerprint"),
        F.when(k % 29 == 0, F.concat(F.lit("../"), art)).otherwise(F.concat(F.lit("process/"), art)).alias("path"),
        _hash(F.col("task_id"), F.col("stage")).alias("sha256"), F.when(k % 31 == 0, "x").otherwise(_hash(F.col("task_id"), F.col("stage"))).alias("actual_sha256"))


def current_fp(spark, d):
    t = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("stage"))
    return t.select("task_id", "stage", F.concat(F.lit("fp"), ((F.col("task_id") + F.col("stage")) % 4).cast("string")).alias("fingerprint"))


_CP = """SELECT o_custkey AS task_id, CAST(o_orderkey%6+1 AS INT) AS stage, max(o_orderkey) AS k FROM orders GROUP BY ALL"""
_CUR = "SELECT c_custkey AS task_id, stage, concat('fp', (c_custkey+stage)%4) AS fingerprint FROM customer, (VALUES (1),(2),(5)) s(stage)"
_CPR = """SELECT cp.task_id, cp.stage, CASE WHEN k%17=0 THEN 'artifact contract mismatch' WHEN k%19=0 THEN 'state is not linear' WHEN k%23=0 THEN 'run manifest hash is missing'
  WHEN cp.stage IN (2,5) AND k%5=0 THEN 'semantic context is missing' WHEN concat('fp',k%4) IS DISTINCT FROM fingerprint THEN 'configuration is incompatible'
  WHEN k%29=0 THEN 'path is outside task or has wrong name' WHEN k%31=0 THEN 'SHA-256 mismatch' ELSE 'verified' END AS reason
  FROM cp LEFT JOIN cur ON cur.task_id=cp.task_id AND cur.stage=cp.stage WHERE cp.stage IN (1,2,5)"""


@query("resume_join", with_views("", "SELECT cp.task_id, max(cp.stage) AS resume_after_stage FROM cp JOIN cur ON cur.task_id=cp.task_id AND cur.stage=cp.stage AND concat('fp',k%4)=fingerprint WHERE cp.stage IN (1,2,5) GROUP BY cp.task_id", cp=_CP, cur=_CUR))
def resume_join(spark, d):
    return op.resume_join(checkpoints(spark, d), current_fp(spark, d))


@query("checkpoint_compatibility", with_views("", """SELECT task_id, max(stage) FILTER (reason='verified') AS resume_after_stage, count(*) FILTER (reason<>'verified') AS refused,
  min(struct_pack(a:=-stage, b:=reason)) FILTER (reason<>'verified').b AS latest_refusal FROM cpr GROUP BY task_id""", cp=_CP, cur=_CUR, cpr=_CPR).replace(
      "min(struct_pack(a:=-stage, b:=reason)) FILTER (reason<>'verified').b", "arg_max(CASE WHEN reason<>'verified' THEN reason END, CASE WHEN reason<>'verified' THEN stage END)"))
def checkpoint_compatibility(spark, d):
    return op.checkpoint_compatibility(checkpoints(spark, d), current_fp(spark, d))


@query("unexpected_records", with_views("", "SELECT DISTINCT task_id, stage FROM cp WHERE stage NOT IN (1,2,5)", cp=_CP))
def unexpected_records(spark, d):
    return op.unexpected_records(checkpoints(spark, d))


@query("cumulative_fingerprint", with_views("", "SELECT i.task_id, n AS stage, sha256(concat('{\"contract_version\":\"1\",\"input_fingerprint\":\"', fp, '\",\"stages\":{', "
       "(SELECT string_agg(concat('\"', g.j, '\":', coalesce(c.cfg, '{}')), ',' ORDER BY g.j) FROM range(1,6) g(j) LEFT JOIN conf c ON c.task_id=i.task_id AND c.stage=g.j WHERE g.j<=n), '}}')) AS fingerprint "
       "FROM inp i, (VALUES (1),(2),(5)) t(n)",
       conf="SELECT o_custkey AS task_id, o_orderkey%5+1 AS stage, concat('{\"key\":', max(o_orderkey), '}') AS cfg FROM orders GROUP BY ALL",
       inp="SELECT c_custkey AS task_id, c_name AS fp FROM customer"))
def cumulative_fingerprint(spark, d):
    o = fx.table(spark, d, "orders")
    conf = o.groupBy(F.col("o_custkey").alias("task_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("stage")).agg(F.max("o_orderkey").alias("k"))
    conf = conf.select("task_id", "stage", F.concat(F.lit('{"key":'), F.col("k").cast("string"), F.lit("}")).alias("config"))
    return op.cumulative_fingerprint(conf, fx.table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("fingerprint")))


@query("manifest_verify_join", with_views("", "SELECT run_id, name, path, verdict, CASE WHEN verdict='verified' THEN q*1000 END AS size FROM verd", **_V))
def manifest_verify_join(spark, d):
    return op.manifest_verify(*outputs(spark, d))


def kinds(spark, d):
    dec, act = outputs(spark, d)
    ok = op.manifest_verify(dec, act).where(F.col("verdict") == "verified")
    r = fx.runs(spark, d).select("run_id", F.when(F.col("status") == "success", "success").when(F.col("run_id") % 2 == 0, "review_required").otherwise("failed").alias("status"))
    rows = ok.join(r, "run_id")
    return rows.withColumn("kind", op.output_kind(F.col("name"), F.col("path"), F.col("status"), F.col("name").isin("out_1", "out_2")))


_KIND = """SELECT verd.run_id, name, path, r.status, CASE WHEN path='result_linear.fit' THEN 'auxiliary' WHEN path LIKE '%result_review%' OR r.status='review_required' THEN 'review'
  WHEN r.status='success' AND name IN ('out_1','out_2') THEN 'formal' ELSE 'auxiliary' END AS kind FROM verd
  JOIN (SELECT run_id, CASE WHEN status='success' THEN 'success' WHEN run_id%2=0 THEN 'review_required' ELSE 'failed' END AS status FROM runs) r ON r.run_id=verd.run_id WHERE verdict='verified'"""


@query("verified_preview_pick", with_views("runs", """SELECT run_id, path AS preview FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN path LIKE '%display_srgb%' THEN 0 ELSE 1 END,
  CASE WHEN path IN ('result_processed.png','result_review.png') THEN 0 ELSE 1 END, path, name) rn FROM kinds WHERE path LIKE '%.png' AND kind = CASE status WHEN 'review_required' THEN 'review' WHEN 'success' THEN 'formal' ELSE '' END) WHERE rn=1""", **_V, kinds=_KIND))
def verified_preview_pick(spark, d):
    return op.verified_preview_pick(kinds(spark, d))


@query("output_allowlist", with_views("", """SELECT run_id, name, path FROM verd v WHERE verdict='verified' AND EXISTS (SELECT 1 FROM allowed a WHERE a.run_id=v.run_id AND a.name=v.name)
  AND v.run_id NOT IN (SELECT run_id FROM allowed GROUP BY run_id, name HAVING count(*)>1 OR bool_or(name LIKE '%/%' OR name='' OR trim(name)<>name))""", **_V,
    allowed="SELECT l_orderkey AS run_id, CASE WHEN l_linenumber=7 AND l_partkey%3=0 THEN 'sub/x' ELSE concat('out_', l_linenumber) END AS name FROM lineitem WHERE l_returnflag<>'N' OR l_linenumber=7"))
def output_allowlist(spark, d):
    dec, act = outputs(spark, d)
    ok = op.manifest_verify(dec, act).where(F.col("verdict") == "verified").select("run_id", "name", "path")
    li = fx.table(spark, d, "lineitem").where((F.col("l_returnflag") != "N") | (F.col("l_linenumber") == 7))
    allowed = li.select(F.col("l_orderkey").alias("run_id"), F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 3 == 0), "sub/x").otherwise(F.concat(F.lit("out_"), F.col("l_linenumber").cast("string"))).alias("name"))
    return op.output_allowlist(ok, allowed)


@query("retention_plan", with_views("runs", """SELECT r.task_id, r.run_id, v.path, CASE WHEN v.path LIKE 'process/%' THEN 'process_directory' ELSE 'superseded_output' END AS reason, v.q*1000 AS size
  FROM verd v JOIN runs r ON r.run_id=v.run_id WHERE r.run_id <> (SELECT max(struct_pack(a:=x.started_at, b:=x.run_id)).b FROM runs x WHERE x.task_id=r.task_id)
  AND v.path NOT IN ('processing-plan.json','result_linear.fit') AND CASE WHEN v.path LIKE 'process/%' THEN r.run_id%4<>0 ELSE verdict='verified' END""", **_V))
def retention_plan(spark, d):
    dec, act = outputs(spark, d)
    files = op.manifest_verify(dec, act).drop("size").join(dec.select("run_id", "name", "q"), ["run_id", "name"]).select(
        "run_id", "path", (F.col("verdict") == "verified").alias("verified"), (F.col("run_id") % 4 == 0).alias("keep_intermediates"), (F.col("q") * 1000).alias("size"))
    return op.retention_plan(files, fx.runs(spark, d), ["processing-plan.json", "result_linear.fit"])


@query("delivery_gates", with_views("steps runs reviews", """SELECT o.o_orderkey AS run_id, sc AS scientific, pr AS presentation, nr AS no_review, idn AS identity, (sc AND pr AND nr AND idn) AS deliverable,
  concat_ws(',', CASE WHEN NOT sc THEN 'scientific' END, CASE WHEN NOT pr THEN 'presentation' END, CASE WHEN NOT nr THEN 'review_required' END, CASE WHEN NOT idn THEN 'identity' END) AS blocked_by
  FROM (SELECT o.*, o_orderkey NOT IN (SELECT run_id FROM steps WHERE status='failed') AS sc, coalesce(o_totalprice>50000 AND o_orderkey%7<>0, false) AS pr,
   o_orderkey NOT IN (SELECT run_id FROM reviews) AS nr, coalesce(i.ok, false) AS idn FROM orders o LEFT JOIN (SELECT run_id, bool_and(verdict IN ('verified','invalid_path','escapes')) ok FROM verd GROUP BY run_id) i ON i.run_id=o.o_orderkey) o""", **_V))
def delivery_gates(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_totalprice")
    failed = fx.steps(spark, d).where(F.col("status") == "failed").select("run_id", F.lit(False).alias("bad")).distinct()
    science = o.join(failed, "run_id", "left").select("run_id", F.col("bad").isNull().alias("science_ok"))
    pres = o.where(F.col("run_id") % 7 != 0).select("run_id", (F.col("o_totalprice") > 50000).alias("presentation_ok"))
    ident = op.manifest_verify(*outputs(spark, d)).groupBy("run_id").agg(F.bool_and(F.col("verdict").isin("verified", "invalid_path", "escapes")).alias("identity_ok"))
    return op.delivery_gates(science, pres, fx.reviews(spark, d), ident)


@query("final_identity_join", with_views("", """SELECT run_id, bool_and(coalesce(d=f,false)) AS identity_ok, count(*) FILTER (d IS NULL) AS not_delivered, count(*) FILTER (f IS NULL) AS not_frozen,
  count(*) FILTER (d<>f) AS changed FROM (SELECT coalesce(a.run_id,b.run_id) run_id, a.d, b.f FROM (SELECT run_id, idx, sha256(concat(run_id,'-',CASE WHEN s%13=0 THEN 0 ELSE p END)) d FROM li WHERE s%11<>0) a
  FULL JOIN (SELECT run_id, idx, sha256(concat(run_id,'-',p)) f FROM li WHERE idx<>3) b ON a.run_id=b.run_id AND a.idx=b.idx) GROUP BY run_id""", li=_V["li"]))
def final_identity_join(spark, d):
    li = _lines(spark, d)
    role = F.col("idx").alias("role")
    delivered = li.where(F.col("s") % 11 != 0).select("run_id", role, _hash(F.col("run_id"), F.when(F.col("s") % 13 == 0, 0).otherwise(F.col("p"))).alias("digest"))
    frozen = li.where(F.col("idx") != 3).select("run_id", role, _hash(F.col("run_id"), F.col("p")).alias("digest"))
    return op.final_identity(delivered, frozen)


@query("lineage_digest", with_views("", """SELECT a.run_id, a.stage, sha256(concat('{"input":"',a.i,'","output":"',a.o,'","run_id":',a.run_id,',"stage":',a.stage,'}')) AS chain_digest,
  coalesce(b.o=a.i, true) AS linked FROM h a LEFT JOIN h b ON b.run_id=a.run_id AND b.stage=a.stage-1""", li=_V["li"],
    h="SELECT run_id, idx AS stage, sha256(concat(run_id,'-',idx)) AS o, CASE WHEN s%13=0 THEN 'x' ELSE sha256(concat(run_id,'-',idx-1)) END AS i FROM li"))
def lineage_digest(spark, d):
    li = _lines(spark, d)
    h = li.select("run_id", F.col("idx").alias("stage"), _hash(F.col("run_id"), F.col("idx")).alias("output_digest"),
                  F.when(F.col("s") % 13 == 0, "x").otherwise(_hash(F.col("run_id"), F.col("idx") - 1)).alias("input_digest"))
    return op.lineage_check(h)


@query("recent_lines", with_views("run_events", """SELECT run_id, ts, event_id, kind, CAST(rn AS INT) AS age FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) rn FROM run_events) WHERE rn<=256"""))
def recent_lines(spark, d):
    return op.recent_lines(fx.run_events(spark, d)).select("run_id", "ts", "event_id", "kind", "age")


@query("light_group_key", with_views("frames", """SELECT substring(sha256(concat(lower(target),chr(31),lower(filter),chr(31),camera,chr(31),geometry)),1,12) AS group_key, min(target) AS target, min(filter) AS filter,
  min(camera) AS camera, min(geometry) AS geometry, count(*) AS frames, CAST(sum(bytes) AS BIGINT) AS bytes, min(name) AS first_name, max(name) AS last_name
  FROM (SELECT target, CASE WHEN filter='' THEN 'unknown' ELSE filter END AS filter, CASE WHEN frame_id%3=0 THEN 'unknown' ELSE concat('cam ', frame_id%3) END AS camera,
  concat(1024*(1+frame_id%2),'x1024@1x1') AS geometry, bytes, name FROM frames) GROUP BY lower(target), lower(filter), camera, geometry"""))
def light_group_key(spark, d):
    return op.light_groups(_lights(spark, d))


@query("light_group_files", with_views("frames", """SELECT group_key, name, bytes FROM (SELECT name, bytes, substring(sha256(concat(lower(target),chr(31),lower(CASE WHEN filter='' THEN 'unknown' ELSE filter END),chr(31),
  CASE WHEN frame_id%3=0 THEN 'unknown' ELSE concat('cam ', frame_id%3) END,chr(31),concat(1024*(1+frame_id%2),'x1024@1x1'))),1,12) AS group_key FROM frames)"""))
def light_group_files(spark, d):
    return headers.light_group_files(_lights(spark, d), "name")


def _lights(spark, d):
    i = F.col("frame_id")
    f = fx.frames(spark, d).withColumn("camera", F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("cam  "), (i % 3).cast("string"))))
    return f.withColumn("geometry", F.concat((F.lit(1024) * (1 + i % 2)).cast("string"), F.lit("x1024@1x1")))
