"""Queries over the event feed (stored form of the streaming operators)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..streaming import events as op
from .noise import rounded
from .registry import query, r6, with_views

C = F.col


def lines(spark, d):
    """Log lines of the feed, written from the event rows."""
    e = fx.table(spark, d, "events")
    s = lambda c: c.cast("string")
    t = F.floor((C("value") % 101) * 10).cast("long")
    num = F.concat(s((t - t % 10) / 10).substr(F.lit(1), F.length(s((t - t % 10) / 10)) - 2), F.lit("."), s(t % 10))
    stage = s(C("event_id") % 10 + 1)
    ty = C("event_type")
    line = (
        F.when(ty.isin("view", "click"), F.concat(F.lit("progress: "), ty, F.lit(", "), num, F.lit("%")))
        .when(ty == "purchase", F.concat(F.lit("[PIPELINE_STAGE_RESULT] stage="), stage, F.lit(" status="), F.when(C("event_id") % 3 == 0, "ok").when(C("event_id") % 3 == 1, "degraded").otherwise("failed"), F.lit(" duration="), num, F.lit(" title=T "), stage))
        .when(ty == "signup", F.concat(F.lit("[PIPELINE_STAGE] stage="), stage, F.lit(" title=Start")))
        .when(C("event_id") % 4 == 0, F.concat(F.lit('[PIPELINE_STAGE_DETAIL] {"stage": '), stage, F.lit("}")))
        .when(C("event_id") % 4 == 1, F.lit("[PIPELINE_RUN_SUMMARY] failed=1 degraded=2")).when(C("event_id") % 4 == 2, F.lit("[PIPELINE_RESULT] status=success")).otherwise(F.lit("Script execution failed: code 1")))
    return e.select(C("user_id").alias("run_id"), C("ts").cast("timestamp").alias("ts"), "event_id", line.alias("line"))


_PCT = "floor((value % 101)*10)/10e0"
_EV = f"""SELECT user_id AS run_id, ts, event_id, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'stage_result' WHEN 'signup' THEN 'stage_start' ELSE list_extract(['stage_detail','run_summary','final_status','error'], CAST(event_id%4+1 AS INT)) END AS kind,
  CASE WHEN event_type IN ('purchase','signup') OR (event_type NOT IN ('view','click') AND event_id%4=0) THEN CAST(event_id%10+1 AS INT) END AS stage, CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN list_extract(['completed','degraded','failed'], CAST(event_id%3+1 AS INT)) END AS state,
  CASE WHEN event_type='purchase' THEN {_PCT} END AS duration, CASE event_type WHEN 'purchase' THEN concat('T ', event_id%10+1) WHEN 'signup' THEN 'Start' END AS title, CASE WHEN event_type IN ('view','click') THEN event_type END AS label, CASE WHEN event_type IN ('view','click') THEN {_PCT} END AS percent FROM events"""


@query("stage_event_parse", with_views("", "SELECT * FROM ev", ev=_EV))
def stage_event_parse(spark, d):
    e = op.parse_events(lines(spark, d))
    return e.withColumn("ts", C("ts").cast("timestamp_ntz"))


@query("stage_state", with_views("", f"SELECT run_id, stage, arg_max(state, struct_pack(a:=ts, b:=event_id)) AS state, {r6('coalesce(sum(duration),0)',3)} AS duration, count(*) AS events FROM ev WHERE stage IS NOT NULL AND state IS NOT NULL GROUP BY run_id, stage", ev=_EV))
def stage_state(spark, d):
    return rounded(op.stage_state(op.parse_events(lines(spark, d))), "duration", digits=3)


_PROG = "SELECT run_id, label, ts, event_id, percent, CAST(event_id%3 AS INT) AS stage FROM ev WHERE percent IS NOT NULL"


def progress(spark, d):
    return op.parse_events(lines(spark, d)).withColumn("stage", (C("event_id") % 3).cast("int"))


@query("progress_throttle", with_views("", """SELECT run_id, stage, label, ts, event_id, percent, restarted FROM (SELECT *, CASE WHEN pp IS NULL OR restarted THEN true ELSE b>pb OR (percent>=100 AND pp<100) END AS emit FROM (
  SELECT *, max(percent) OVER (PARTITION BY run_id, stage, label, seg ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pp, max(b) OVER (PARTITION BY run_id, stage, label, seg ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pb FROM (
  SELECT p.run_id, p.stage, p.label, p.ts, p.event_id, p.percent, p.rn, least(floor(p.percent/10),10) AS b, w.seg, w.restarted FROM pr p JOIN w ON w.run_id=p.run_id AND w.stage=p.stage AND w.label=p.label AND w.rn=p.rn))) WHERE emit""",
  ev=_EV, p0=_PROG, pr="SELECT *, row_number() OVER (PARTITION BY run_id, stage, label ORDER BY ts, event_id) rn FROM p0",
  **{"w(run_id, stage, label, rn, best, seg, restarted)": "SELECT run_id, stage, label, rn, percent, 0, false FROM pr WHERE rn=1 UNION ALL SELECT p.run_id, p.stage, p.label, p.rn, CASE WHEN w.best>=90 AND p.percent<=10 THEN p.percent ELSE greatest(w.best,p.percent) END, w.seg+CASE WHEN w.best>=90 AND p.percent<=10 THEN 1 ELSE 0 END, w.best>=90 AND p.percent<=10 FROM w JOIN pr p ON p.run_id=w.run_id AND p.stage=w.stage AND p.label=w.label AND p.rn=w.rn+1"}).replace("WITH ", "WITH RECURSIVE ", 1).replace("restarted) AS MATERIALIZED", "restarted) AS"))
def progress_throttle(spark, d):
    return op.progress_throttle(progress(spark, d)).withColumn("ts", C("ts").cast("timestamp_ntz"))


def preview_lines(spark, d):
    e = fx.table(spark, d, "events")
    line = (
        F.when(C("event_type") == "view", F.concat(F.lit('x [PIPELINE_PREVIEW] {"id": '), C("event_id").cast("string"), F.lit(",")))
        .when(C("event_type").isin("click", "signup"), F.concat(F.lit('log:  "v": '), (C("event_id") % 7).cast("string"), F.when(C("event_type") == "click", "}").otherwise(","))).otherwise("other"))
    return e.select(C("user_id").alias("run_id"), C("ts").cast("timestamp").alias("ts"), "event_id", line.alias("line"))


@query("json_reassembly", with_views("", """SELECT run_id, ts, concat('{"id": ', mid, ',', coalesce(txt,'')) AS payload FROM (SELECT run_id, g, min(event_id) FILTER (event_type='view') mid, min(rn) FILTER (event_type='click') c, min(rn) FILTER (event_type NOT IN ('view','click','signup')) o FROM gg WHERE g>0 GROUP BY run_id, g) h
  JOIN LATERAL (SELECT string_agg(concat(' "v": ', event_id%7, CASE event_type WHEN 'click' THEN '}' ELSE ',' END), '' ORDER BY rn) AS txt, max(ts) AS ts FROM gg WHERE gg.run_id=h.run_id AND gg.g=h.g AND gg.rn<=h.c AND gg.event_type<>'view') t ON true WHERE c IS NOT NULL AND (o IS NULL OR c<o)""",
  gg="SELECT user_id AS run_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn, sum(CASE WHEN event_type='view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM events"))
def json_reassembly(spark, d):
    return op.json_reassembly(preview_lines(spark, d)).withColumn("ts", C("ts").cast("timestamp_ntz"))


@query("idle_watchdog", with_views("", """SELECT run_id, min(ts) AS started, max(e) AS timed_out_at, count(*) AS lines FROM (SELECT *, sum(CASE WHEN pe IS NULL OR ts>=pe THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id) g FROM (
  SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM (SELECT user_id AS run_id, ts, event_id, ts+CASE WHEN event_type='purchase' THEN INTERVAL 9000 SECOND ELSE INTERVAL 36000 SECOND END AS e FROM events))) GROUP BY run_id, g"""))
def idle_watchdog(spark, d):
    e = fx.table(spark, d, "events").select(C("user_id").alias("run_id"), C("ts").cast("timestamp").alias("ts"), (C("event_type") == "purchase").alias("exporting"))
    w = op.idle_watchdog(e, 36000, 9000)
    return w.withColumns({c: C(c).cast("timestamp_ntz") for c in ("started", "timed_out_at")})


def attempts(spark, d):
    e = fx.table(spark, d, "events")
    return e.select((C("user_id") % 50).alias("session"), C("event_type").alias("route"), C("ts").cast("timestamp").alias("ts"), "event_id", (C("value") > 60).alias("failed"))


@query("failure_cache", with_views("", "SELECT session, route, event_id, failed, coalesce(bool_or(failed) OVER (PARTITION BY session, route ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS disabled FROM (SELECT user_id%50 AS session, event_type AS route, ts, event_id, value>60 AS failed FROM events)"))
def failure_cache(spark, d):
    return op.failure_cache(attempts(spark, d))


@query("retry_classifier", with_views("", "SELECT run_id, command, event_id, CAST(attempt AS INT) AS attempt, rt AS retry, CASE WHEN rt THEN attempt*1e0 END AS delay FROM (SELECT *, attempt<3 AND command NOT IN ('save','crop','stack') AND event_id%3<>2 AS rt FROM (SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'save' ELSE event_type END AS command, event_id, row_number() OVER (PARTITION BY user_id, CASE event_type WHEN 'view' THEN 'save' ELSE event_type END ORDER BY ts, event_id) AS attempt FROM events))"))
def retry_classifier(spark, d):
    e = fx.table(spark, d, "events")
    msg = F.when(C("event_id") % 3 == 0, "Read timed out").when(C("event_id") % 3 == 1, "server BUSY").otherwise("bad argument")
    a = e.select(C("user_id").alias("run_id"), F.when(C("event_type") == "view", "save").otherwise(C("event_type")).alias("command"), C("ts").cast("timestamp").alias("ts"), "event_id", msg.alias("message"))
    return op.retry_classifier(a)


@query("history_upsert", with_views("runs", """SELECT task_id, run_id, status, started_at, completed_at, changed_at FROM (SELECT *, row_number() OVER (PARTITION BY task_id, run_id ORDER BY changed_at DESC) rn FROM (
  SELECT task_id, run_id, 'preparing' AS status, started_at, CAST(NULL AS TIMESTAMP) AS completed_at, started_at AS changed_at FROM runs UNION ALL SELECT task_id, run_id, 'success', started_at, started_at+INTERVAL 2 DAY, started_at+INTERVAL 2 DAY FROM runs WHERE status='success'
  UNION ALL SELECT task_id, run_id, 'preparing', started_at+INTERVAL 9 DAY, NULL, started_at+INTERVAL 9 DAY FROM runs WHERE run_id%10=0)) WHERE rn=1"""))
def history_upsert(spark, d):
    r = fx.runs(spark, d)
    t = r.schema["started_at"].dataType
    at = lambda n: C("started_at") + F.expr(f"INTERVAL {n} DAY")
    rec = lambda df, st, s, c, ch: df.select("task_id", "run_id", F.lit(st).alias("status"), s.alias("started_at"), c.alias("completed_at"), ch.alias("changed_at"))
    none = F.lit(None).cast(t)
    cur = rec(r, "preparing", C("started_at"), none, C("started_at"))
    ch = rec(r.where(C("status") == "success"), "success", C("started_at"), at(2), at(2)).unionByName(rec(r.where(C("run_id") % 10 == 0), "preparing", at(9), none, at(9)))
    return op.merge_history(cur, ch)


@query("metric_stream", with_views("run_events", "SELECT m.run_id, m.ts AS metric_ts, m.event_id AS metric_id, m.value, s.ts AS stage_ts, s.event_id AS stage_id, s.kind FROM run_events m JOIN run_events s ON s.run_id=m.run_id AND s.ts BETWEEN m.ts-INTERVAL 60 SECOND AND m.ts+INTERVAL 3000 SECOND WHERE m.kind='progress' AND s.kind IN ('stage_start','stage_result')"))
def metric_stream(spark, d):
    e = fx.run_events(spark, d)
    return op.metric_join(e.where(C("kind") == "progress"), e.where(C("kind").isin("stage_start", "stage_result")), 60, 3000)
