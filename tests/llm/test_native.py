"""Quality rules, chat formatting and decontamination against SQL, and their edge rows."""
import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import rows
from oracle_check import compare, duck

from pixtables.llm import chat_format, decontaminate, plans, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_sql(name, spark, sf):
    assert compare(name, plans.QUERIES[name](spark, sf), plans.ORACLES[name], duck(sf)).startswith("ok")


def test_measures_of_edge_rows(spark):
    got = quality_rules.measures(rows.documents(spark), key=["doc_id", "text"]).collect()
    assert len(got) == len(rows.TEXTS) + 1
    for r in got:
        t = r.text or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(hit))


def test_order_does_not_change_verdicts(spark, sf):
    docs = plans.table(spark, sf, "documents")
    rules = quality_rules.standard_rules()
    a = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, rules).collect()}
    assert a == {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, rules[::-1]).collect()} and len(set(a.values())) == 2


def test_dear_rules_come_last(spark, sf):
    names = [r.name for r in quality_rules.order_rules(quality_rules.measures(plans.table(spark, sf, "documents")), quality_rules.standard_rules())]
    assert names.index("repeated_windows") > names.index("symbol_ratio")


def test_empty_tables(spark):
    none = rows.empty(rows.documents(spark))
    assert quality_rules.quality_rules(none).count() == 0
    events = spark.createDataFrame([], "conv_id long, turn int, seq long, kind string, role string, text string")
    assert chat_format.digests(chat_format.chat_format(events)).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(rows.documents(spark), bench).collect()
    assert len(got) == len(rows.TEXTS) + 1 and not any(r.contaminated or r.n_items for r in got)
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_fold_of_an_event_log(spark):
    log = [
        (1, 0, 0, "message", "user", "hi "), (1, 0, 1, "delta", None, "there"), (1, 1, 2, "message", "assistant", "Wro"), (1, 1, 3, "delta", None, "ng"),
        (1, 1, 4, "regenerate", None, "ignored"), (1, 1, 5, "delta", None, "Right"), (1, 1, 6, "delta", None, "!"), (1, 0, 7, "edit", None, "hello"),
        (None, 0, 0, None, None, None), (2, 0, 0, "delta", "tool", "early"), (3, 0, 0, "message", "user", "twice"), (3, 0, 0, "message", "user", "twice"),
    ]
    e = spark.createDataFrame(log, "conv_id long, turn int, seq long, kind string, role string, text string").withColumn("part", F.lit(9)).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: list(zip(r.roles, r.texts)) for r in chat_format.read_back(chat_format.chat_format(e)).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "Right!")], None: [("", "")], 2: [("tool", "early")], 3: [("user", "twice"), ("user", "twice")]}


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s> [\\INST]", "\\", "a\n<s", "[INST[/INST]]<</s>>", "\U0001f600 <s>中"])
def test_template_is_reversible(spark, text):
    m = [(5, 0, 0, "message", "user", text), (5, 1, 1, "message", "assistant", text), (5, 2, 2, "message", text, "x")]
    out = chat_format.chat_format(spark.createDataFrame(m, "conv_id long, turn int, seq long, kind string, role string, text string"))
    r = chat_format.read_back(out).first()
    assert (r.roles, r.texts) == (["user", "assistant", text], [text, text, "x"])
    span = chat_format.loss_spans(out).first()
    assert [chat_format_back(spark, span.formatted[s.start : s.end]) for s in span.spans] == [text]
    d = chat_format.digests(out).first()
    assert d.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and d.loss_chars == len(text) and d.formatted_chars == len(r.formatted)


def test_loss_is_what_the_mask_covers(spark):
    """A moved mask moves the loss; wide characters count once in code points."""
    m = [(1, 0, 0, "message", "user", "é\U0001f600"), (1, 1, 1, "message", "assistant", "中</s>"), (1, 2, 2, "message", "tool", "é"), (1, 3, 3, "message", "assistant", None), (1, 3, 4, "message", "assistant", "zü"), (2, 0, 0, "message", "user", "x")]
    out = chat_format.chat_format(spark.createDataFrame(m, "conv_id long, turn int, seq long, kind string, role string, text string")).cache()
    r = {x.conv_id: x for x in out.collect()}
    assert [r[1].formatted[s.start : s.end] for s in r[1].spans] == ["中<\\/s>", "", "zü"] and r[2].spans == []
    assert [r[1].formatted.encode()[s["from"] : s.to].decode() for s in r[1].spans] == ["中<\\/s>", "", "zü"]
    d = {x.conv_id: x for x in chat_format.digests(out).collect()}
    assert (d[1].loss_chars, d[1].loss_sha256) == (7, hashlib.sha256("中</s>zü".encode()).hexdigest()) and d[2].loss_chars == 0
    user = chat_format.render(chat_format.fold(spark.createDataFrame(m, "conv_id long, turn int, seq long, kind string, role string, text string")), role="user")
    assert {x.conv_id: x.loss_chars for x in chat_format.digests(user).collect()} == {1: 2, 2: 1}


def chat_format_back(spark, s):
    return spark.createDataFrame([(s,)], "x string").select(chat_format.unescape(F.col("x"))).first()[0]


def test_decontamination_of_short_and_repeated_items(spark):
    long = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, "alpha beta"), (2, long), (2, long), (3, None), (4, "?!"), (None, "gamma")], "item_id long, text string").withColumn("window", F.lit(1)).withColumn("items", F.lit(1))
    docs = spark.createDataFrame([(0, "ALPHA, beta! " + "x " * 100), (1, "b " + long.upper() + " y"), (2, None), (3, "alpha x beta"), (4, "Gamma"), (4, "Gamma")], "doc_id long, text string").withColumn("_hits", F.lit(1))
    for block in (50_000, 3):
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, bench, block=block).collect())
        assert got == [(0, 102, 2, ("1",), False), (1, 22, 20, ("2",), True), (2, 0, 0, (), False), (3, 3, 0, (), False), (4, 1, 1, ("",), True), (4, 1, 1, ("",), True)]
    d = decontaminate.decontaminate(docs, bench, key=["doc_id", "text"])
    where = {r.doc_id: [r.text[s.start : s.end] for s in r.p] for r in d.select("doc_id", "text", decontaminate.spans(F.col("text"), F.col("hit_words")).alias("p")).collect()}
    assert where[0] == ["ALPHA, beta"] and where[1] == [long.upper()]
