"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Every rule is a boolean column over cheap or dear measures of one text. A bounded sample tells
which rules reject which rows and how much work each rule does; rules are then ordered greedily:
next comes the rule that rejects most of the rows still alive per unit of new work. The chain is
one CASE expression, so a later rule is not evaluated for a row that an earlier one rejected.
The verdict does not depend on the order; only the work and the name of the first failing rule do.

Everything is DataFrame expressions over one row: no shuffle, no Python on the executors.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD_GAP = r"[ \t-\r]+"  # fixed value: words are runs of anything but U+0020 and U+0009..U+000D
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 5


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer computes each once and does not
    paste its expression into the places (lambdas above all) that read it."""
    names = list(columns)
    packed = F.explode(F.array(F.struct(*[columns[n].alias(n) for n in names])))
    return df.select("*", packed.alias("_held")).select(*[df[c] for c in df.columns], *[F.col(f"_held.{n}").alias(n) for n in names])


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the given sorted positions."""
    step = F.transform(starts, lambda s, i: F.when(i + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, i + 1) - s)).otherwise(F.lit(WINDOW)))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(docs: DataFrame, text: str = "text", key: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the key columns and n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words (all long).

    Null and empty texts have no words and zero in every column. Other columns of docs are not
    read, so they may have any name. Repeated rows give repeated results.
    """
    key = key or ["doc_id"]
    base = docs.select(*[F.col(k) for k in key], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    base = _held(base, _w=F.array_remove(F.split("_t", WORD_GAP), ""),
                 _l=F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    # 64-bit keys tell which texts have any repeated window; only these are looked at word by word
    at = lambda i, k: F.get(F.col("_w"), i + k)
    base = _held(base, _h=F.when(F.size("_w") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))))
    twice = F.size("_h") > F.size(F.array_distinct("_h"))
    base = _held(base, _s=F.when(twice, F.array_sort(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", *[at(i, k) for k in range(WINDOW)]).alias("w"), i.alias("i"))))))
    same = lambda i, j: F.col("_s")[i]["w"] == F.get(F.col("_s"), j)["w"]
    base = _held(base, _p=F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(
        F.filter(F.col("_s"), lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))), lambda x: x["i"]))))
    blank = F.length("_t") - F.length(F.translate("_t", BLANKS, ""))
    return base.select(
        *key, F.size("_w").cast("long").alias("n_words"), (F.length("_t") - blank).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_p")), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a bad row; ``reads`` names the measures it needs."""

    name: str
    rejects: Column
    reads: tuple[str, ...]


# Work to get one measure, per character, word and line of the mean text (relative units).
_WORK = {"n_words": (1.0, 0.5, 0.0), "word_chars": (0.6, 0.0, 0.0), "n_symbols": (0.6, 0.0, 0.0), "n_lines": (0.4, 0.0, 1.0), "n_dup_lines": (0.4, 0.0, 4.0), "n_repeat_words": (1.0, 12.0, 0.0)}


def standard_rules() -> list[Rule]:
    """Thresholds in whole numbers, so that SQL and Spark agree to the row. Null measures never reject."""
    c = F.col
    return [
        Rule("too_few_words", c("n_words") < 10, ("n_words",)),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 20 * c("n_words"), ("n_words", "n_repeat_words")),
        Rule("symbol_ratio", 10 * c("n_symbols") > c("n_words"), ("n_words", "n_symbols")),
        Rule("repeated_lines", 100 * c("n_dup_lines") > 30 * c("n_lines"), ("n_lines", "n_dup_lines")),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")), ("n_words", "word_chars")),
    ]


def order_rules(measured: DataFrame, rules: list[Rule], sample_rows: int = 2_000) -> list[Rule]:
    """Order by rejection per cost, seen on the first ``sample_rows`` rows that the scan gives.

    The sample steers work only, never a verdict. It is taken from the first partitions alone, and
    what reaches the driver is a few numbers for each sampled row. An empty table keeps the order.
    """
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    rows = measured.select(*flags, (F.col("word_chars") + F.col("n_words")).alias("chars"), F.col("n_words").alias("words"), F.col("n_lines").alias("lines")).take(sample_rows)
    seen = [x.asDict() | {"n": 1} for x in rows]
    total = sum(x["n"] for x in seen)
    if not total:
        return list(rules)
    mean = [sum(x[k] or 0 for x in seen) / total for k in ("chars", "words", "lines")]
    price = {m: max(1e-9, sum(a * b for a, b in zip(w, mean))) for m, w in _WORK.items()}
    left, have, out = dict(enumerate(rules)), set(), []
    while left:
        alive = [x for x in seen if not any(x[f"r{i}"] for i in range(len(rules)) if i not in left)]

        def gain(i: int) -> tuple[float, int]:
            cost = 1e-6 + sum(price.get(m, mean[0]) for m in left[i].reads if m not in have)
            return (sum(x["n"] for x in alive if x[f"r{i}"]) / total / cost, -i)

        best = max(left, key=gain)
        have |= set(left[best].reads)
        out.append(left.pop(best))
    return out


def first_failure(rules: list[Rule]) -> Column:
    """Name of the first rule in order that rejects the row; null when none does."""
    chain = F.when(F.coalesce(rules[0].rejects, F.lit(False)), rules[0].name)
    for r in rules[1:]:
        chain = chain.when(F.coalesce(r.rejects, F.lit(False)), r.name)
    return chain


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2_000) -> DataFrame:
    """doc_id, the measures, base_failed, kept and failed_rule for every row of docs.

    Empty and null texts fail ``too_few_words``; an empty table gives no rows; rows with a null
    doc_id are judged like any other.
    """
    rules = rules or standard_rules()
    measured = measures(docs)
    ordered = order_rules(measured, rules, sample_rows)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("failed_rule", first_failure(ordered)).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
