"""Stored form = streaming form for every streaming operator, on a feed split over several files."""
import glob

import pytest
from pyspark.sql import functions as F

from pixtables.plans import feed
from pixtables.streaming import events as op

C = F.col


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """Lines of the feed as files in time order."""
    root = tmp_path_factory.mktemp("feed")

    def split(df, name, n=4):
        out = str(root / name)
        for i, (lo, hi) in enumerate((j / n, (j + 1) / n) for j in range(n)):
            q = df.selectExpr(f"percentile(event_id, {lo}) a", f"percentile(event_id, {hi}) b").first()
            part = df.where((C("event_id") >= q["a"]) & ((C("event_id") < q["b"]) | F.lit(i == n - 1)))
            part.coalesce(1).write.mode("append").parquet(out)
        return out

    return split


def run(spark, stream, mode, tmp_path):
    name = "out_" + str(abs(hash(str(tmp_path))))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def same(a, b, cols):
    f = lambda d: sorted((tuple(r) for r in d.select(*cols).collect()), key=str)
    assert f(a) == f(b)


def stream_of(spark, path, schema, per=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(path)


def test_parse_and_throttle(spark, sf, parts, tmp_path):
    lines = feed.lines(spark, sf)
    path = parts(lines, "lines")
    assert len(glob.glob(path + "/*.parquet")) == 4
    live = op.parse_events(stream_of(spark, path, lines.schema)).withColumn("stage", (C("event_id") % 3).cast("int"))
    out = run(spark, op.progress_throttle_stream(live), "append", tmp_path)
    same(out, op.progress_throttle(feed.progress(spark, sf)), ["run_id", "stage", "label", "event_id", "percent", "restarted"])


def test_stage_state(spark, sf, parts, tmp_path):
    lines = feed.lines(spark, sf)
    live = op.stage_state(op.parse_events(stream_of(spark, parts(lines, "state"), lines.schema)))
    out = run(spark, live, "complete", tmp_path)
    same(out.withColumn("duration", F.round("duration", 6)), op.stage_state(op.parse_events(lines)).withColumn("duration", F.round("duration", 6)), ["run_id", "stage", "state", "duration", "events"])


def test_json_reassembly(spark, sf, parts, tmp_path):
    lines = feed.preview_lines(spark, sf)
    out = run(spark, op.json_reassembly_stream(stream_of(spark, parts(lines, "json"), lines.schema)), "append", tmp_path)
    same(out, op.json_reassembly(lines), ["run_id", "payload"])


def test_failure_cache(spark, sf, parts, tmp_path):
    a = feed.attempts(spark, sf)
    out = run(spark, op.failure_cache_stream(stream_of(spark, parts(a, "fail"), a.schema)), "append", tmp_path)
    same(out, op.failure_cache(a), ["session", "route", "event_id", "failed", "disabled"])


def test_idle_watchdog(spark, sf, parts, tmp_path):
    e = feed.fx.table(spark, sf, "events").select(C("user_id").alias("run_id"), C("ts").cast("timestamp").alias("ts"), "event_id", (C("event_type") == "purchase").alias("exporting"))
    end = e.selectExpr("max(ts) + INTERVAL 400 DAYS AS ts").first()["ts"]
    closing = spark.createDataFrame([(-1, end, 10**9, False)], e.schema)  # moves the watermark past the last session
    path = parts(e.unionByName(closing), "idle")
    live = op.idle_watchdog(stream_of(spark, path, e.schema).withWatermark("ts", "1 minute"))
    out = run(spark, live, "append", tmp_path).where("run_id >= 0")
    same(out, op.idle_watchdog(e), ["run_id", "started", "timed_out_at", "lines"])


def test_metric_stream(spark, sf, parts, tmp_path):
    e = feed.fx.run_events(spark, sf).withColumn("ts", C("ts").cast("timestamp"))
    s = stream_of(spark, parts(e, "metric"), e.schema).withWatermark("ts", "1 hour")
    live = op.metric_join(s.where("kind = 'progress'"), s.where("kind IN ('stage_start', 'stage_result')"), 60, 3000)
    want = op.metric_join(e.where("kind = 'progress'"), e.where("kind IN ('stage_start', 'stage_result')"), 60, 3000)
    same(run(spark, live, "append", tmp_path), want, ["run_id", "metric_id", "stage_id", "kind"])


def test_history_sink(spark, tmp_path):
    schema = "task_id long, run_id long, status string, started_at timestamp, completed_at timestamp, changed_at timestamp"
    ts = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = lambda *r: spark.createDataFrame(r, "task_id long, run_id long, status string, a string, b string, c string").selectExpr("task_id", "run_id", "status", "to_timestamp(a) started_at", "to_timestamp(b) completed_at", "to_timestamp(c) changed_at")
    put = op.history_sink(str(tmp_path / "h"))
    put(rows((1, 1, "preparing", ts(1), None, ts(1)), (1, 2, "preparing", ts(2), None, ts(2))), 0)
    put(rows((1, 1, "success", ts(1), ts(3), ts(3))), 1)
    put(rows((1, 1, "success", ts(1), ts(3), ts(3))), 1)  # a repeated batch changes nothing
    got = {r["run_id"]: r["status"] for r in spark.read.schema(schema).parquet(str(tmp_path / "h" / "v1")).collect()}
    assert got == {1: "success", 2: "preparing"}
    # a stream with a new checkpoint begins at batch 0 again: the stored history stays
    op.history_sink(str(tmp_path / "h"))(rows((2, 9, "preparing", ts(5), None, ts(5))), 0)
    got = {r["run_id"]: r["status"] for r in spark.read.schema(schema).parquet(str(tmp_path / "h" / "v2")).collect()}
    assert got == {1: "success", 2: "preparing", 9: "preparing"}
