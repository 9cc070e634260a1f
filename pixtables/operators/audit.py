"""Run bookkeeping: outcomes, resume points, verified files, retention, history.

Every group here is a run or a task. All grouped work is built from aggregates
with map-side combine, so one very busy run does not end up in one task's memory.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Stage contracts (fixed values): number, key, phase, artifact, resume checkpoint.
STAGES = [
    (1, "input_preparation", "linear", "stage1_prepared.fit", True),
    (2, "boundary_correction", "linear", "stage2_corrected.fit", True),
    (3, "background_processing", "linear", "stage3_bgremoved.fit", False),
    (4, "color_calibration", "linear", "stage4_color.fit", False),
    (5, "linear_cleanup", "linear", "stage5_linear.fit", True),
    (6, "linear_star_separation", "linear", "stage6_starless.fit", False),
    (7, "subject_stretch", "nonlinear", "stage7_stretched.fit", False),
    (8, "starless_enhancement", "nonlinear", "stage8_enhanced.fit", False),
    (9, "star_remixing", "nonlinear", "stage9_remixed.fit", False),
    (10, "final_export", "nonlinear", "result_processed.fit", False),
]
RESUME_STAGES = (1, 2, 5)


def contract_array() -> Column:
    """The ten contracts as an array literal; exploding it needs no join."""
    return F.array(*[
        F.struct(F.lit(n).alias("stage"), F.lit(k).alias("key"), F.lit(p).alias("phase"), F.lit(a).alias("artifact"), F.lit(r).alias("resume"))
        for n, k, p, a, r in STAGES
    ])


def issue_union(steps: DataFrame, extra: DataFrame) -> DataFrame:
    """Issues of the steps and extra issues in one normalised shape."""
    own = steps.select("run_id", F.col("stage").alias("_default"), F.explode("issues").alias("i")).select("run_id", "_default", "i.*")
    allx = own.unionByName(extra.withColumn("_default", F.lit(0)), allowMissingColumns=True)
    code = F.coalesce(F.nullif(F.trim("code"), F.lit("")), F.lit("unspecified_issue"))
    stage = F.when(F.col("stage").between(1, 10), F.col("stage")).otherwise(F.col("_default"))
    return allx.select(
        "run_id", stage.cast("int").alias("stage"),
        F.coalesce(F.nullif(F.lower(F.trim("severity")), F.lit("")), F.lit("warning")).alias("severity"),
        code.alias("code"), F.coalesce("recovered", F.lit(False)).alias("recovered"),
        F.coalesce(F.nullif(F.trim("message"), F.lit("")), code).alias("message"),
    )


def review_dedup(reviews: DataFrame) -> DataFrame:
    """One row per (run, stage, code); stages outside 1..10 and blank codes are refused."""
    clean = reviews.withColumn("code", F.trim("code")).where(F.col("stage").between(1, 10) & (F.col("code") != ""))
    return clean.groupBy("run_id", "stage", "code").agg(F.count("*").alias("occurrences"))


def run_outcome(steps: DataFrame, reviews: DataFrame, extra_issues: DataFrame) -> DataFrame:
    """Status truth table: failed > review_required > partial_success > success."""
    raw = F.lower(F.trim("status"))
    zero = F.lit(0)
    marks = ["failed", "degraded", "fallback", "degraded_stage", "fatal", "error", "recovered", "issue", "review"]

    def row(df: DataFrame, **set_: Column) -> DataFrame:
        return df.select("run_id", *[set_.get(m, zero).cast("int").alias(m) for m in marks])

    fb = F.coalesce("fallback_used", F.lit(False))
    by_step = row(
        steps, failed=raw == "failed", fallback=fb,
        degraded=(raw == "degraded") | (fb & (raw == "ok")), degraded_stage=(raw == "degraded") | fb,
    )
    issues = issue_union(steps, extra_issues)
    sev = F.col("severity")
    by_issue = row(issues, issue=F.lit(1), fatal=sev == "fatal", error=sev.isin("error", "fatal"), recovered=(sev == "error") & F.col("recovered"))
    by_review = row(review_dedup(reviews), review=F.lit(1))
    # one shuffle of pre-combined counts; every input row enters once
    sums = by_step.unionByName(by_issue).unionByName(by_review).groupBy("run_id").agg(*[F.sum(m).alias(m) for m in marks])
    fatal = (F.col("fatal") > 0) | (F.col("failed") > 0)
    partial = (F.col("degraded") > 0) | (F.col("fallback") > 0) | (F.col("recovered") > 0)
    status = F.when(fatal, "failed").when(F.col("review") > 0, "review_required").when(partial, "partial_success").otherwise("success")
    return sums.select(
        "run_id", status.alias("status"), (fatal | (F.col("error") > 0)).alias("had_errors"), fatal.alias("had_fatal_errors"),
        (F.col("review") > 0).alias("review_required"), F.col("failed").alias("failed_stages"),
        F.col("degraded_stage").alias("degraded_stages"), F.col("fallback").alias("fallback_stages"),
        F.col("review").alias("review_requirements"), F.col("issue").alias("issues"), F.col("recovered").alias("recovered_errors"),
    )


def stage_duration_total(events: DataFrame) -> DataFrame:
    """Total duration, number of attempts and last status per (run, stage)."""
    return events.groupBy("run_id", "stage").agg(
        F.sum("duration").alias("duration"), F.count("*").alias("attempts"),
        F.max_by("status", F.struct("seq", "status")).alias("last_status"),
    )


def output_totals(files: DataFrame) -> DataFrame:
    """Bytes and counts per (task, group), per task, and overall."""
    return files.rollup("task", "grp").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("files"), F.grouping_id().cast("int").alias("level")
    )


def latest_run_summary(runs: DataFrame) -> DataFrame:
    """Latest activity and status of each task by completion, else start time."""
    at = F.coalesce("completed_at", "started_at")
    return runs.groupBy("task_id").agg(
        F.max(at).alias("latest_activity_at"), F.max_by("status", F.struct(at, "run_id")).alias("latest_status"),
        F.max_by("run_id", F.struct(at, "run_id")).alias("latest_run_id"), F.count("*").alias("runs"),
    )


def interrupted_marker(runs: DataFrame, live: DataFrame) -> DataFrame:
    """Active runs whose owner session is not alive become interrupted."""
    alive = live.select("owner_session", F.lit(True).alias("_alive")).dropDuplicates(["owner_session"])
    joined = runs.join(alive, "owner_session", "left")
    dead = F.col("status").isin("preparing", "running") & F.col("_alive").isNull()
    return joined.select("task_id", "run_id", "owner_session", F.when(dead, "interrupted").otherwise(F.col("status")).alias("status"), dead.alias("changed"))


def plan_steps(tasks: DataFrame) -> DataFrame:
    """Action and reason of each of the ten stages for tasks(state, trust, resume_after).

    Only a verified linear input may resume; other resume requests are refused
    (no rows), as the plan builder refuses them.
    """
    ok = F.col("resume_after").isNull() | ((F.col("state") == "linear") & (F.col("trust") == "verified"))
    rows = tasks.where(ok).withColumn("c", F.explode(contract_array())).select("*", "c.*").drop("c")
    stage, linear = F.col("stage"), F.col("state") == "linear"
    done = F.coalesce(stage <= F.col("resume_after"), F.lit(False))
    action = (
        F.when(done, "verified").when(linear, "execute").when(stage.isin(1, 2), "execute")
        .when(stage == 10, "review_export").otherwise("input_state_guard")
    )
    reason = (
        F.when(done, "verified_checkpoint_chain").when(linear, "planned_processing").when(stage.isin(1, 2), "safe_input_preparation")
        .when(stage == 10, "review_only_input_state").otherwise("input_state_not_linear")
    )
    return rows.select("task_id", "stage", "key", "phase", "artifact", F.col("resume").alias("resume_checkpoint"), action.alias("action"), reason.alias("reason"))


def plan_verify(stored: DataFrame, tasks: DataFrame) -> DataFrame:
    """Stored plan steps against the plan derived again: missing, extra and changed steps."""
    fresh = plan_steps(tasks).select("task_id", "stage", F.col("action").alias("want"), F.lit(True).alias("_w"))
    both = stored.select("task_id", "stage", "action", F.lit(True).alias("_s")).join(fresh, ["task_id", "stage"], "full")
    missing, extra = F.col("_s").isNull(), F.col("_w").isNull()
    return both.groupBy("task_id").agg(
        F.count_if(missing).alias("missing"), F.count_if(extra).alias("extra"),
        F.count_if(~missing & ~extra & (F.col("action") != F.col("want"))).alias("changed"),
    ).withColumn("verified", (F.col("missing") + F.col("extra") + F.col("changed")) == 0)


def resume_join(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Latest formal stage whose saved and current fingerprints agree, per task."""
    keep = F.col("stage").isin(*RESUME_STAGES) & (F.coalesce("fingerprint", F.lit("")) != "")
    hit = saved.where(keep).select("task_id", "stage", "fingerprint").join(current.where(keep).select("task_id", "stage", "fingerprint"), ["task_id", "stage", "fingerprint"])
    return hit.groupBy("task_id").agg(F.max("stage").alias("resume_after_stage"))


def checkpoint_reason(checkpoints: DataFrame, current: DataFrame) -> DataFrame:
    """First failing check of every checkpoint of a formal stage, ``verified`` if none fails."""
    cur = current.select("task_id", "stage", F.col("fingerprint").alias("_cur"))
    want = F.element_at(F.create_map(*[F.lit(v) for n, _, _, a, r in STAGES if r for v in (n, a)]), F.col("stage"))
    rows = checkpoints.where(F.col("stage").isin(*RESUME_STAGES)).join(cur, ["task_id", "stage"], "left").withColumn("_want", want)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(F.coalesce(F.col("artifact"), F.lit("")) != F.col("_want"), "artifact contract mismatch")
        .when(F.coalesce(F.lower("state"), F.lit("")) != "linear", "state is not linear")
        .when(blank("run_manifest_hash"), "run manifest hash is missing")
        .when(F.col("stage").isin(2, 5) & F.col("semantic_context").isNull(), "semantic context is missing")
        .when(blank("fingerprint"), "config fingerprint is missing")
        .when(F.col("_cur").isNull() | (F.col("_cur") != F.col("fingerprint")), "configuration is incompatible")
        .when(escapes_root(F.col("path")) | (F.element_at(F.split("path", "/"), -1) != F.col("_want")), "path is outside task or has wrong name")
        .when(blank("sha256") | ~F.col("sha256").eqNullSafe(F.col("actual_sha256")), "SHA-256 mismatch")
        .otherwise("verified")
    )
    return rows.select("task_id", "stage", reason.alias("reason"))


def checkpoint_compatibility(checkpoints: DataFrame, current: DataFrame) -> DataFrame:
    """Latest checkpoint that passes every check, with the number of refusals, per task."""
    ok = F.col("reason") == "verified"
    return checkpoint_reason(checkpoints, current).groupBy("task_id").agg(
        F.max(F.when(ok, F.col("stage"))).alias("resume_after_stage"),
        F.count_if(~ok).alias("refused"), F.min_by(F.when(~ok, F.col("reason")), F.when(~ok, -F.col("stage"))).alias("latest_refusal"),
    )


def canonical_json(fields: Sequence[tuple[str, Column]]) -> Column:
    """Compact JSON with sorted keys; every value is given as its JSON text column."""
    parts: list[Column] = []
    for i, (k, c) in enumerate(sorted(fields, key=lambda f: f[0])):
        parts += [F.lit(("" if i == 0 else ",") + f'"{k}":'), c]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_text(c: Column) -> Column:
    """JSON string literal of a text column (quotes and backslashes escaped)."""
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), esc, F.lit('"')), F.lit("null"))


def canonical_hash(fields: Sequence[tuple[str, Column]]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def cumulative_fingerprint(configs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Fingerprint of each resume stage over input identity and all configurations up to it.

    configs(task_id, stage 1..5, config JSON text), inputs(task_id, fingerprint);
    a stage without configuration counts as ``{}``. A task has at most five rows.
    """
    per = configs.where(F.col("stage").between(1, 5)).groupBy("task_id").agg(
        *[F.max_by("config", F.when(F.col("stage") == n, F.col("config"))).alias(f"_c{n}") for n in range(1, 6)]
    )
    rows = inputs.join(per, "task_id", "left")
    out = []
    for n in RESUME_STAGES:
        stages = canonical_json([(str(i), F.coalesce(F.col(f"_c{i}"), F.lit("{}"))) for i in range(1, n + 1)])
        digest = canonical_hash([("contract_version", F.lit('"1"')), ("input_fingerprint", json_text(F.col("fingerprint"))), ("stages", stages)])
        out.append(F.struct(F.lit(n).alias("stage"), digest.alias("fingerprint")))
    return rows.select("task_id", F.explode(F.array(*out)).alias("s")).select("task_id", "s.*")


def escapes_root(path: Column) -> Column:
    """True for blank or absolute paths and for paths that climb above their root."""
    step = lambda p: F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, p: F.struct((a["d"] + step(p)).alias("d"), F.least(a["low"], a["d"] + step(p)).alias("low")),
    )
    return F.coalesce((F.trim(path) == "") | path.startswith("/") | (depth["low"] < 0), F.lit(True))


def manifest_verify(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Verdict per declared output: invalid_path, escapes, no_hash, missing, mismatch or verified."""
    have = actual.select("run_id", "path", F.lower("sha256").alias("_actual"), F.col("size").alias("actual_size"))
    rows = declared.join(have, ["run_id", "path"], "left")
    want = F.lower(F.trim(F.coalesce("sha256", F.lit(""))))
    bad = (F.trim(F.coalesce("path", F.lit(""))) == "") | F.col("path").startswith("/")
    verdict = (
        F.when(bad, "invalid_path").when(escapes_root(F.col("path")), "escapes").when(want == "", "no_hash")
        .when(F.col("_actual").isNull(), "missing").when(F.col("_actual") != want, "mismatch").otherwise("verified")
    )
    return rows.select("run_id", "name", "path", verdict.alias("verdict"), F.when(verdict == "verified", F.col("actual_size")).alias("size"))


def output_kind(name: Column, path: Column, status: Column, formal: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    aux = base.isin("processing-plan.json", "result_linear.fit") | base.startswith("run_diagnostics") | ~base.rlike(r"\.(png|tif|tiff|fit|fits)$")
    review = F.lower(F.concat_ws(" ", name, base)).contains("result_review") | (status == "review_required")
    return F.when(aux, "auxiliary").when(review, "review").when(status.isin("success", "partial_success") & formal, "formal").otherwise("auxiliary")


def verified_preview_pick(outputs: DataFrame) -> DataFrame:
    """One preview PNG per run from verified outputs(run_id, name, path, kind, status)."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    want = F.when(F.col("status") == "review_required", "review").when(F.col("status").isin("success", "partial_success"), "formal").otherwise("")
    rank = F.struct(
        F.when(base.contains("display_srgb"), 0).otherwise(1), F.when(base.isin("result_processed.png", "result_review.png"), 0).otherwise(1), base, F.lower("name")
    )
    return outputs.where(base.endswith(".png") & (F.col("kind") == want)).groupBy("run_id").agg(F.min_by("path", rank).alias("preview"))


def output_allowlist(verified: DataFrame, allowed: DataFrame) -> DataFrame:
    """Verified files whose name the result contract lists; a contract with a blank,
    padded, nested or repeated name is no contract."""
    name = F.col("name")
    bad = (name == "") | (F.trim(name) != name) | name.contains("/")
    per = allowed.groupBy("run_id", "name").agg(F.count("*").alias("_c"), F.bool_or(bad).alias("_bad"))
    broken = per.where(F.col("_bad") | (F.col("_c") > 1)).select("run_id").distinct()
    return verified.join(per.join(broken, "run_id", "left_anti").select("run_id", "name"), ["run_id", "name"], "left_semi")


def retention_plan(files: DataFrame, runs: DataFrame, preserved: Sequence[str]) -> DataFrame:
    """Files of runs that are neither the latest of the task nor debug-kept; a plan, nothing is deleted."""
    latest = runs.groupBy("task_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    old = runs.select("task_id", "run_id").join(latest, ["task_id", "run_id"], "left_anti")
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    keep = base.isin(*[p.lower() for p in preserved])
    rows = files.join(old, "run_id").where(~keep)
    in_process = F.col("path").startswith("process/")
    return rows.where(F.when(in_process, ~F.col("keep_intermediates")).otherwise(F.col("verified"))).select(
        "task_id", "run_id", "path", F.when(in_process, "process_directory").otherwise("superseded_output").alias("reason"), "size"
    )


def unexpected_records(records: DataFrame, allowed_stages: Sequence[int] = RESUME_STAGES) -> DataFrame:
    """Distinct stages present per task that are not allowed."""
    return records.where(~F.col("stage").isin(*allowed_stages)).select("task_id", "stage").distinct()


def delivery_gates(science: DataFrame, presentation: DataFrame, reviews: DataFrame, identity: DataFrame) -> DataFrame:
    """Scientific AND presentation AND no review AND identity; a missing verdict fails closed."""
    rev = reviews.select("run_id", F.lit(True).alias("_rev")).distinct()
    rows = science.join(presentation, "run_id", "left").join(identity, "run_id", "left").join(rev, "run_id", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    no_review = F.col("_rev").isNull()
    block = F.array_compact(F.array(
        F.when(~f("science_ok"), "scientific"), F.when(~f("presentation_ok"), "presentation"),
        F.when(~no_review, "review_required"), F.when(~f("identity_ok"), "identity"),
    ))
    return rows.select(
        "run_id", f("science_ok").alias("scientific"), f("presentation_ok").alias("presentation"), no_review.alias("no_review"),
        f("identity_ok").alias("identity"), (F.size(block) == 0).alias("deliverable"), F.array_join(block, ",").alias("blocked_by"),
    )


def final_identity(delivered: DataFrame, frozen: DataFrame) -> DataFrame:
    """Per run: every frozen (role, digest) is delivered with the same digest, nothing else is."""
    f = frozen.select("run_id", "role", F.col("digest").alias("_f"))
    rows = delivered.select("run_id", "role", "digest").join(f, ["run_id", "role"], "full")
    same = F.coalesce(F.col("digest") == F.col("_f"), F.lit(False))
    return rows.groupBy("run_id").agg(
        F.bool_and(same).alias("identity_ok"), F.count_if(F.col("digest").isNull()).alias("not_delivered"),
        F.count_if(F.col("_f").isNull()).alias("not_frozen"),
        F.count_if(F.col("digest").isNotNull() & F.col("_f").isNotNull() & ~same).alias("changed"),
    )


def lineage_check(handoffs: DataFrame) -> DataFrame:
    """Each stage's input digest equals the output digest of the stage before it.

    handoffs(run_id, stage, input_digest, output_digest), one row per stage; the
    previous row comes by an equi join on stage-1, so no window over a run is needed.
    """
    prev = handoffs.select("run_id", (F.col("stage") + 1).alias("stage"), F.col("output_digest").alias("_prev"))
    rows = handoffs.join(prev, ["run_id", "stage"], "left")
    linked = F.col("_prev").isNull() | (F.col("_prev") == F.col("input_digest"))
    fields = [("run_id", F.col("run_id").cast("string")), ("stage", F.col("stage").cast("string")),
              ("input", json_text(F.col("input_digest"))), ("output", json_text(F.col("output_digest")))]
    return rows.select("run_id", "stage", canonical_hash(fields).alias("chain_digest"), linked.alias("linked"))


def recent_lines(lines: DataFrame, keep: int = 256) -> DataFrame:
    """Last ``keep`` lines of every stream; the rank limit is applied before the shuffle."""
    w = W.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return lines.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)


def with_group_key(frames: DataFrame) -> DataFrame:
    """Frames with cleaned target, filter, camera and geometry and the key of their case-folded parts."""
    parts = ["target", "filter", "camera", "geometry"]
    clean = {p: F.coalesce(F.nullif(F.trim(F.regexp_replace(p, r"\s+", " ")), F.lit("")), F.lit("unknown")) for p in parts}
    return frames.withColumns(clean).withColumn("group_key", F.substring(F.sha2(F.concat_ws("\u001f", *[F.lower(p) for p in parts]), 256), 1, 12))


def light_groups(frames: DataFrame) -> DataFrame:
    """Group frames on target, filter, camera and geometry; key from the case-folded parts."""
    parts = ["target", "filter", "camera", "geometry"]
    return with_group_key(frames).groupBy("group_key").agg(
        *[F.min(p).alias(p) for p in parts], F.count("*").alias("frames"), F.sum("bytes").alias("bytes"), F.min("name").alias("first_name"), F.max("name").alias("last_name"),
    )
