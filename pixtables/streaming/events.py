"""Live event feed of running jobs.

Functions without state work on batch and streaming frames alike. Stateful ones come in
two forms with equal results: ``*_stream`` for ``readStream`` input and a window form
for stored events.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col

EVENT_SCHEMA = "run_id long, ts timestamp, event_id long, line string"


def read_lines(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Event lines as a file stream with an event-time watermark."""
    s = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return s.withWatermark("ts", "30 minutes")


STAGE = r"\[PIPELINE_STAGE\] stage=(\d+) title=(.*)$"
RESULT = r"\[PIPELINE_STAGE_RESULT\] stage=(\d+) status=(\w+) duration=([\d.]+) title=(.*)$"
DETAIL = r"\[PIPELINE_STAGE_DETAIL\] (\{.*\})$"
SUMMARY = r"\[PIPELINE_RUN_SUMMARY\] failed=(\d+) degraded=(\d+)"
FINAL = r"\[PIPELINE_RESULT\] status=(\w+)"
PROGRESS = r"^progress: ([^,]+), ([\d.]+)%$"
ERRORS = "script execution failed|error in line|unknown error|exiting batch processing|unable to spawn python"


def parse_events(lines: DataFrame) -> DataFrame:
    """Typed events of lines: stage start, result, detail, summary, final status, progress, error."""
    g = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    kind = (
        F.when(C("line").rlike(RESULT), "stage_result").when(C("line").rlike(STAGE), "stage_start").when(C("line").rlike(DETAIL), "stage_detail")
        .when(C("line").rlike(SUMMARY), "run_summary").when(C("line").rlike(FINAL), "final_status").when(C("line").rlike(PROGRESS), "progress")
        .when(F.lower("line").rlike(ERRORS), "error").otherwise("text"))
    raw = F.lower(g(RESULT, 2))
    state = F.when(raw == "ok", "completed").otherwise(raw)
    detail = F.get_json_object(g(DETAIL, 1), "$.stage")
    return lines.select(
        "run_id", "ts", "event_id", kind.alias("kind"), F.coalesce(g(RESULT, 1), g(STAGE, 1), detail).cast("int").alias("stage"),
        F.when(kind == "stage_start", "running").when(kind == "stage_result", state).alias("state"), g(RESULT, 3).cast("double").alias("duration"),
        F.coalesce(g(RESULT, 4), g(STAGE, 2)).alias("title"), g(PROGRESS, 1).alias("label"), g(PROGRESS, 2).cast("double").alias("percent"))


def stage_state(events: DataFrame) -> DataFrame:
    """Current state and accumulated duration per (run, stage); update mode on streams."""
    e = events.where(C("stage").isNotNull() & C("state").isNotNull())
    return e.groupBy("run_id", "stage").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.coalesce(F.sum("duration"), F.lit(0.0)).alias("duration"), F.count("*").alias("events"))


def _order(*keys: str):
    return W.partitionBy(*keys).orderBy("ts", "event_id")


def progress_throttle(events: DataFrame, keys: tuple[str, ...] = ("run_id", "stage", "label")) -> DataFrame:
    """Progress rows worth showing: first, restart (>= 90 then <= 10), higher tenth, or 100.

    A restart is a low row with a high row since the previous low row; between
    restarts the shown bucket only rises, so running maxima replace the state.
    """
    p = events.where(C("percent").isNotNull())
    w = _order(*keys)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("_i", F.row_number().over(w))
    low, high = C("percent") <= 10.0, C("percent") >= 90.0
    p = p.withColumns({"_ll": F.max(F.when(low, C("_i"))).over(before), "_lh": F.max(F.when(high, C("_i"))).over(before)})
    restart = low & C("_lh").isNotNull() & (C("_ll").isNull() | (C("_lh") > C("_ll")))
    p = p.withColumn("_restart", restart).withColumn("_seg", F.sum(C("_restart").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    seg = W.partitionBy(*keys, "_seg").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    bucket = F.least(F.floor(C("percent") / 10.0), F.lit(10))
    p = p.withColumns({"_b": bucket, "_pb": F.max(bucket).over(seg), "_pp": F.max("percent").over(seg)})
    emit = C("_pb").isNull() | (C("_b") > C("_pb")) | ((C("percent") >= 100.0) & (C("_pp") < 100.0))
    return p.where(emit).select(*keys, "ts", "event_id", "percent", C("_restart").alias("restarted"))


def progress_throttle_stream(events: DataFrame) -> DataFrame:
    """Streaming form of ``progress_throttle`` with per-key state (percent, bucket)."""
    out = "run_id long, stage int, label string, ts timestamp, event_id long, percent double, restarted boolean"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        best, bucket = state.get if state.exists else (None, None)
        shown = []
        for row in pdf.itertuples(index=False):
            b = min(10, int(row.percent // 10))
            again = best is not None and best >= 90.0 and row.percent <= 10.0
            if best is None or again or b > bucket or (row.percent >= 100.0 and best < 100.0):
                shown.append((row.run_id, row.stage, row.label, row.ts, row.event_id, row.percent, again))
            best, bucket = (row.percent, b) if best is None or again else (max(best, row.percent), max(bucket, b))
        state.update((float(best), int(bucket)))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame(shown, columns=["run_id", "stage", "label", "ts", "event_id", "percent", "restarted"])

    rows = events.where(C("percent").isNotNull()).select("run_id", "stage", "label", "ts", "event_id", "percent")
    return rows.groupBy("run_id", "stage", "label").applyInPandasWithState(step, out, "percent double, bucket int", "append", GroupStateTimeout.ProcessingTimeTimeout)


PREVIEW = "[PIPELINE_PREVIEW]"
CONTINUED = r"^log: (.*)$"
def _closed(text: str) -> bool:
    """No string is open, and the braces outside strings are balanced."""
    bare = re.sub(r'"[^"]*"', "", re.sub(r"(?s)\\.", "", text))
    return '"' not in bare and bare.count("{") <= bare.count("}")


def _brace_steps(parts: Column) -> Column:
    """Number of fragments up to the one that closes the object; 0 where none does.

    The state carries the depth, whether a string is open and whether the last character was a
    lone backslash, so strings and escapes may be split over lines.
    """
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        body = F.when(a["escaped"] & (F.length(x) > 0), F.substr(x, F.lit(2))).otherwise(x)
        body = F.regexp_replace(body, r"(?s)\\.", "")
        lone = body.endswith("\\")
        body = F.regexp_replace(F.when(a["quoted"], F.concat(F.lit('"'), body)).otherwise(body), '"[^"]*"', "")
        quoted = F.contains(body, F.lit('"'))
        body = F.regexp_replace(body, '(?s)".*$', "")
        many = lambda ch: F.length(body) - F.length(F.replace(body, F.lit(ch), F.lit("")))
        depth, n = a["depth"] + many("{") - many("}"), a["n"] + 1
        return F.when(a["end"] > 0, a).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), lone.alias("escaped"), n.alias("n"), F.when((depth <= 0) & ~quoted, n).otherwise(0).alias("end")))

    return F.aggregate(parts, zero, step)["end"]


def json_reassembly(lines: DataFrame) -> DataFrame:
    """JSON objects split over lines: a marker line opens, ``log:`` lines continue until braces close.

    Braces inside strings do not count. A new marker or another line before the close drops the
    object; its length is not limited. What is put together is one marker's unbroken lines.
    """
    w = _order("run_id")
    at = F.instr("line", PREVIEW)
    frag = F.when(at > 0, F.ltrim(F.substr("line", at + len(PREVIEW)))).otherwise(F.nullif(F.regexp_extract("line", CONTINUED, 1), F.lit("")))
    l = lines.withColumns({"_new": (at > 0).cast("int"), "_f": frag}).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).where(C("_g") > 0)
    g = W.partitionBy("run_id", "_g").orderBy("ts", "event_id")
    l = l.withColumns({"_broken": F.sum(C("_f").isNull().cast("int")).over(g.rowsBetween(W.unboundedPreceding, 0)), "_n": F.row_number().over(g)}).where("_broken = 0")
    p = l.groupBy("run_id", "_g").agg(F.sort_array(F.collect_list(F.struct("_n", "_f", "ts"))).alias("p"))
    p = p.select("run_id", "p", _brace_steps(C("p._f")).alias("_end")).where("_end > 0")
    out = p.select("run_id", F.get("p", C("_end") - 1)["ts"].alias("ts"), F.array_join(F.slice(C("p._f"), F.lit(1), C("_end")), "").alias("payload"))
    return out.where(C("payload").startswith("{")).select("run_id", "ts", "payload")


def json_reassembly_stream(lines: DataFrame) -> DataFrame:
    """Streaming form of ``json_reassembly`` with the pending text as state."""
    out = "run_id long, ts timestamp, payload string"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = state.get[0] if state.exists else None
        done = []
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples(index=False):
            at = row.line.find(PREVIEW)
            more = re.match(CONTINUED, row.line)
            if at >= 0:
                pending = row.line[at + len(PREVIEW):].lstrip()
            elif pending is not None and more and more.group(1):
                pending += more.group(1)
            else:
                pending = None
            if pending is not None and _closed(pending):
                if pending.startswith("{"):
                    done.append((row.run_id, row.ts, pending))
                pending = None
        state.update((pending,))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame(done, columns=["run_id", "ts", "payload"])

    return lines.select("run_id", "ts", "event_id", "line").groupBy("run_id").applyInPandasWithState(step, out, "pending string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_watchdog(events: DataFrame, idle: int = 900, export_tail: int = 120) -> DataFrame:
    """Sessions of output per run; each ends where nothing came for ``idle`` seconds,
    or for ``export_tail`` seconds after an export line. Append mode with a watermark."""
    gap = F.when(C("exporting"), f"{export_tail} seconds").otherwise(f"{idle} seconds")
    s = events.groupBy("run_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("lines"))
    return s.select("run_id", C("s.start").alias("started"), C("s.end").alias("timed_out_at"), "lines")


def failure_cache(attempts: DataFrame) -> DataFrame:
    """After a failure in a session the route is disabled for later attempts under the same key.

    Later means after the first failure, so one minimum per key says it all: the minimum is
    combined on the map side and joined back, and a busy key is never put in order.
    """
    at = F.struct("ts", "event_id")
    first = attempts.where("failed").groupBy("session", "route").agg(F.min(at).alias("_first"))
    first = first.select(C("session").alias("_s"), C("route").alias("_r"), "_first")
    joined = attempts.join(first, C("session").eqNullSafe(C("_s")) & C("route").eqNullSafe(C("_r")), "left")
    return joined.select("session", "route", "event_id", "failed", F.coalesce(at > C("_first"), F.lit(False)).alias("disabled"))


def failure_cache_stream(attempts: DataFrame) -> DataFrame:
    """Streaming form of ``failure_cache``: one flag per (session, route)."""
    out = "session long, route string, event_id long, failed boolean, disabled boolean"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        flag = bool(state.get[0]) if state.exists else False
        before = pdf["failed"].cummax().shift(1, fill_value=False).astype(bool)
        pdf["disabled"] = before | flag
        state.update((flag or bool(pdf["failed"].any()),))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pdf[["session", "route", "event_id", "failed", "disabled"]]

    rows = attempts.select("session", "route", "ts", "event_id", "failed")
    return rows.groupBy("session", "route").applyInPandasWithState(step, out, "failed boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


TRANSIENT = "timeout|timed out|temporar|busy|connection|unavailable"
NON_IDEMPOTENT = ("save", "crop", "stack")


def retry_classifier(attempts: DataFrame, max_attempts: int = 3, delay: float = 1.0) -> DataFrame:
    """Attempt number of each failed command and whether and after how long it may run again."""
    n = F.row_number().over(_order("run_id", "command"))
    a = attempts.withColumn("attempt", n)
    ok = (C("attempt") < max_attempts) & ~C("command").isin(*NON_IDEMPOTENT) & F.lower("message").rlike(TRANSIENT)
    return a.select("run_id", "command", "event_id", "attempt", ok.alias("retry"), F.when(ok, C("attempt") * delay).alias("delay"))


def merge_history(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest record per (task, run) of the stored history and a batch of changes.

    A run that is registered again starts over; a terminal status keeps its completion time.
    """
    cols = ["task_id", "run_id", "status", "started_at", "completed_at", "changed_at"]
    rows = current.select(*cols).unionByName(changes.select(*cols))
    best = F.max(F.struct("changed_at", "status", "started_at", "completed_at")).alias("b")
    return rows.groupBy("task_id", "run_id").agg(best).select("task_id", "run_id", "b.status", "b.started_at", "b.completed_at", "b.changed_at")


def history_sink(path: str):
    """foreachBatch function: merges a batch into the next version of a parquet history.

    Versions count up over all runs of the stream (``v0``, ``v1``, ...), and each holds the batch
    that made it. The newest whole version is read whatever the batch's own number, so a
    stream with a new checkpoint goes on from the stored history; a batch that is given again
    directly after itself takes its version's place, merged into the one before. A version
    without the mark of a finished write does not count.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        whole = [int(n[1:]) for n in there if re.fullmatch(r"v\d+", n) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        newest = max(whole, default=-1)
        made = f"{path}/made-{newest}"
        if newest >= 0 and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(made)):
            last = spark.read.parquet(made).first()
            if (last["query"], last["batch"]) == (query, batch_id):
                newest -= 1
        current = spark.read.parquet(f"{path}/v{newest}") if newest >= 0 else batch.limit(0)
        spark.range(1).selectExpr(f"'{query}' AS query", f"CAST({batch_id} AS BIGINT) AS batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/made-{newest + 1}")
        merge_history(current, batch).write.mode("overwrite").parquet(f"{path}/v{newest + 1}")

    return upsert


def metric_join(metrics: DataFrame, stages: DataFrame, back: int = 60, ahead: int = 300) -> DataFrame:
    """Metrics with the stage events of their run from ``back`` seconds before to ``ahead`` after.

    On streams both sides carry a watermark, so the state of the interval join is bounded.
    """
    width = back + ahead
    slot = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / width)
    first, last = slot(C("ts") - F.expr(f"INTERVAL {back} SECONDS")), slot(C("ts") + F.expr(f"INTERVAL {ahead} SECONDS"))
    # the interval touches two time slots at most; the slot is an equi key, so a busy
    # run is spread over its slots instead of pairing all of its rows
    m = metrics.select("run_id", C("ts").alias("metric_ts"), C("event_id").alias("metric_id"), "value", F.explode(F.array_distinct(F.array(first, last))).alias("_slot"))
    s = stages.select(C("run_id").alias("_run"), C("ts").alias("stage_ts"), C("event_id").alias("stage_id"), "kind", slot(C("ts")).alias("_at"))
    near = (C("stage_ts") >= C("metric_ts") - F.expr(f"INTERVAL {back} SECONDS")) & (C("stage_ts") <= C("metric_ts") + F.expr(f"INTERVAL {ahead} SECONDS"))
    return m.join(s, (C("run_id") == C("_run")) & (C("_slot") == C("_at")) & near).drop("_run", "_slot", "_at")
