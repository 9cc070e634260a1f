"""Truth tables of the run bookkeeping."""
import pytest
from pyspark.sql import functions as F

from pixtables.functions import text
from pixtables.operators import audit, gates

C = F.col
STEP = "run_id long, stage int, status string, fallback_used boolean, issues array<struct<stage:int,severity:string,code:string,recovered:boolean,message:string>>"
ISSUE = "run_id long, stage int, severity string, code string, recovered boolean, message string"


def outcome(spark, step, reviews=(), extra=()):
    s = spark.createDataFrame([(1, *step)], STEP)
    r = spark.createDataFrame([(1, *x) for x in reviews], "run_id long, stage int, code string")
    e = spark.createDataFrame([(1, *x) for x in extra], ISSUE)
    return audit.run_outcome(s, r, e).first()


@pytest.mark.parametrize(
    "step,reviews,extra,status",
    [
        ((1, "ok", False, []), [], [], "success"),
        ((1, "ok", True, []), [], [], "partial_success"),
        ((1, "degraded", False, []), [], [], "partial_success"),
        ((1, "ok", False, []), [(3, "x")], [], "review_required"),
        ((1, "failed", False, []), [(3, "x")], [], "failed"),
        ((1, "ok", False, []), [], [(2, "error", "c", True, "m")], "partial_success"),
        ((1, "ok", False, []), [], [(2, "error", "c", False, "m")], "success"),
        ((1, "ok", False, [(None, "fatal", "c", False, "m")]), [(1, "x")], [], "failed"),
        ((1, "ok", False, []), [(11, "x"), (2, " ")], [], "success"),
    ],
)
def test_outcome(spark, step, reviews, extra, status):
    assert outcome(spark, step, reviews, extra)["status"] == status


def test_repeated_reviews_count_once(spark):
    r = outcome(spark, (1, "ok", False, []), [(3, "x"), (3, "x"), (4, "x")])
    assert r["review_requirements"] == 2


@pytest.mark.parametrize("path,bad", [("a/b.png", False), ("a/../b", False), ("../b", True), ("a/../../b", True), ("/abs", True), ("", True), (None, True), ("./x", False)])
def test_escape(spark, path, bad):
    assert spark.createDataFrame([(path,)], "p string").select(audit.escapes_root(C("p")).alias("e")).first()["e"] is bad


@pytest.mark.parametrize("t,ra,want", [("12", True, 180.0), ("25", True, 25.0), ("5h30m0s", True, 82.5), ("-0:30:00", False, -0.5), ("+10 12 06", False, 10.2016666667), ("'1:2'", False, 1.0333333333), ("x", False, None), ("", True, None)])
def test_angles(spark, t, ra, want):
    got = spark.createDataFrame([(t,)], "t string").select(text.parse_angle(C("t"), ra).alias("a")).first()["a"]
    assert got == (None if want is None else pytest.approx(want))


def test_gate_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.51), (3, None)], "id int, m double")
    got = {r["id"]: r["status"] for r in gates.verdict(df, [gates.Limit("m", "m", "<=", 0.5)], ["id"]).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "rejected"}
    soft = {r["id"]: r["status"] for r in gates.verdict(df, [gates.Limit("m", "m", "<=", 0.5, False)], ["id"], missing_fails=False).collect()}
    assert soft == {1: "accepted", 2: "warning", 3: "accepted"}


def test_tampered_hash_is_refused(spark):
    dec = spark.createDataFrame([(1, "a", "x.png", "AA"), (1, "b", "y.png", "bb"), (1, "c", "z.png", ""), (1, "d", "w.png", "dd")], "run_id long, name string, path string, sha256 string")
    act = spark.createDataFrame([(1, "x.png", "aa", 5), (1, "y.png", "zz", 5), (1, "z.png", "cc", 5)], "run_id long, path string, sha256 string, size long")
    got = {r["name"]: r["verdict"] for r in audit.manifest_verify(dec, act).collect()}
    assert got == {"a": "verified", "b": "mismatch", "c": "no_hash", "d": "missing"}
