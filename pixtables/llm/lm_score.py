"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation.

Words are 64-bit numbers (equal words, equal numbers). The corpus is gathered by three
aggregations over all training texts: word counts, the counts of neighbouring words within the
model's vocabulary, and the totals. They grow with the corpus and stay distributed; only the
commonest words (``hot``, bounded) and the pair table of the model's vocabulary (at most
(vocabulary + 1)^2 cells) reach the driver.

The model: the words of a vocabulary, one end mark and one class for all other words have a
vector r and a bias b; the score of w after u is r_w . (r_u C) + b_w. Training maximises the
noise-contrastive objective over the whole pair table, with the noise expected under the unigram
distribution instead of drawn, so it is the same on every run. Scores are then normalised by
batched matrix products into a table of token log-probabilities. A word outside the vocabulary
takes its class's probability times its add-half share among such words, and all unseen words
together have the share of one, so the token probabilities sum to one.

Scoring reads each text once; common words are looked up in the task, rare ones are joined with
the word counts by a shuffle, so no table that grows with the corpus is broadcast.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pixtables.session import saved

from . import shingles

END = np.uint64(0)  # the number of the end mark; a word would have it with a probability of 2^-64
VOCABULARY, HOT, WIDTH, NOISE = 1024, 400_000, 32, 8


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text, modulo 5, is 1; rows with a null id are training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def _streams(x: pa.Array):
    """(first row, tokens of each row, all tokens) of stretches of an Arrow array; each row ends with END."""
    for at, raw, start, end, n in shingles.grouped(x):
        numbers = shingles.stretch_numbers(raw, start, end)
        numbers[numbers == END] = np.uint64(1)
        last = np.cumsum(n + 1) - 1
        tokens = np.full(len(numbers) + len(n), END, np.uint64)
        body = np.ones(len(tokens), bool)
        body[last] = False
        tokens[body] = numbers
        yield at, n + 1, tokens


def count_words(texts: DataFrame) -> DataFrame:
    """word, c over a table of one binary column; counted inside each batch before the shuffle."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t for _, _, t in _streams(batch.column(0))]
            if found:
                word, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "c"])

    return texts.mapInArrow(local, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def classes_of(tokens: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """0 for the end mark, 1.. for words of the (sorted) vocabulary, len + 1 for others."""
    at = np.searchsorted(vocabulary, tokens)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == tokens if len(vocabulary) else np.zeros(len(tokens), bool)
    return np.where(tokens == END, 0, np.where(known, at + 1, len(vocabulary) + 1))


def count_pairs(texts: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often class w follows class u; a text begins after an end mark."""
    size = len(vocabulary) + 2

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, tokens in _streams(batch.column(0)):
                c = classes_of(tokens, vocabulary)
                total += np.bincount(np.concatenate([[0], c[:-1]]) * size + c, minlength=size * size)
        some = np.flatnonzero(total)
        for i in range(0, len(some), 100_000):
            yield pa.record_batch([pa.array(some[i : i + 100_000]), pa.array(total[some[i : i + 100_000]])], names=["pair", "n"])

    # bounded: one row for each pair of classes at most
    rows = texts.mapInArrow(local, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def train(pairs: np.ndarray, width: int = WIDTH, noise: int = NOISE, rounds: int = 120, step: float = 0.03, decay: float = 30.0) -> np.ndarray:
    """log10 P(w | u) as a table, from the pair counts, by noise-contrastive estimation."""
    size = len(pairs)
    n = max(pairs.sum(), 1.0)
    q = (pairs.sum(axis=0) + 0.5) / (n + 0.5 * size)
    after = pairs.sum(axis=1)
    rng = np.random.default_rng(11)
    p = [rng.normal(0, 0.1, (size, width)), np.eye(width) + rng.normal(0, 0.01, (width, width)), np.log(q)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    shift = np.log(noise * q)
    for t in range(1, rounds + 1):
        r, c, b = p
        context = r @ c
        s = context @ r.T + b
        true = 1 / (1 + np.exp(-np.clip(s - shift, -40, 40)))
        # data pairs pull up by 1 - true, expected noise pushes down by true
        g = (pairs * (1 - true) - noise * after[:, None] * q * true) / n
        push = g @ r
        grad = [g.T @ context + push @ c.T - decay * r / n, r.T @ push, g.sum(axis=0)]
        for i, x in enumerate(grad):
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.99 * v[i] + 0.01 * x * x
            p[i] = p[i] + step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    r, c, b = p
    out = np.empty((size, size))
    for i in range(0, size, 256):
        s = (r[i : i + 256] @ c) @ r.T + b
        top = s.max(axis=1, keepdims=True)
        out[i : i + 256] = s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))
    return out / np.log(10)


@dataclass
class Model:
    """``counts`` (word, c) stays distributed; the other fields are bounded."""

    counts: DataFrame
    total: int  # N: training tokens
    distinct: int  # V: distinct training tokens
    vocabulary: np.ndarray
    other_total: int  # tokens and distinct ones outside the vocabulary
    other_distinct: int
    hot_words: np.ndarray
    hot_counts: np.ndarray
    table: np.ndarray


def fit(training: DataFrame, vocabulary: int = VOCABULARY, hot: int = HOT) -> Model:
    """Fit on all rows of training (null texts are empty). An empty table gives a uniform model."""
    texts = training.select(_text(training).alias("t"))
    counts = saved(count_words(texts), "words")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    # the commonest words by a histogram over sixteenth powers of two: no sort, no task that sees all words
    power = F.floor(F.log2("c") * 16)
    least, kept = 1 << 30, 0
    for r in sorted(counts.groupBy(power.alias("b")).count().collect(), key=lambda r: -r["b"]):
        if kept + r["count"] > hot:
            break
        least, kept = r["b"], kept + r["count"]
    common = counts.where(power >= least).toArrow()
    word, c = common.column("word").to_numpy().view(np.uint64), common.column("c").to_numpy()
    order = np.lexsort((word, -c))
    word, c = word[order], c[order]
    chosen = np.flatnonzero(word != END)[: vocabulary - 1]
    names = np.sort(word[chosen])
    ends = int(c[word == END].sum())
    by_number = np.argsort(word)
    return Model(counts, total, distinct, names, total - ends - int(c[chosen].sum()), distinct - len(chosen) - (ends > 0), word[by_number], c[by_number], train(count_pairs(texts, names)))


def _scorer(model: Model, sc):
    held = sc.broadcast((model.hot_words, model.hot_counts, model.vocabulary, model.table.astype(np.float32)))

    @F.arrow_udf("struct<n_tokens:bigint,n_hot:bigint,base:double,other:double,n_other:bigint,model:double,cold:array<struct<word:bigint,n:int>>>")
    def judge(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hot, count, vocabulary, table = held.value
        known_log = np.log10(count + 0.5)
        flat, size = table.reshape(-1), len(table)
        for x in it:
            n_rows = len(x)
            n_tokens, n_hot, n_other = (np.zeros(n_rows, np.int64) for _ in range(3))
            base, other, lbl = (np.zeros(n_rows) for _ in range(3))
            cold_row, cold_word, cold_n = [], [], []
            for at, n, tokens in _streams(x):
                end = np.cumsum(n)
                cut, rows = end - n, slice(at, at + len(n))
                uniq, back = np.unique(tokens, return_inverse=True)
                place = np.searchsorted(hot, uniq)
                place[place == len(hot)] = 0
                is_hot = hot[place] == uniq if len(hot) else np.zeros(len(uniq), bool)
                value = np.where(is_hot, known_log[place] if len(hot) else 0.0, 0.0)
                cls = classes_of(uniq, vocabulary)
                c, v, h = cls[back], value[back], is_hot[back]
                outside = c == size - 1
                n_tokens[rows], n_hot[rows] = n, np.add.reduceat(h.astype(np.int64), cut)
                base[rows], other[rows] = np.add.reduceat(v, cut), np.add.reduceat(v * outside, cut)
                n_other[rows] = np.add.reduceat(outside.astype(np.int64), cut)
                lbl[rows] = np.add.reduceat(flat[np.concatenate([[0], c[:-1]]) * size + c].astype(float), cut)
                rest = np.flatnonzero(~h)
                if len(rest):
                    row = np.repeat(np.arange(at, at + len(n)), n)[rest]
                    key = np.lexsort((tokens[rest], row))
                    row, word = row[key], tokens[rest][key]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])]))
                    cold_row.append(row[new])
                    cold_word.append(word[new])
                    cold_n.append(np.diff(np.append(new, len(row))))
            row = np.concatenate(cold_row) if cold_row else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))]).astype(np.int32)
            word = np.concatenate(cold_word).view(np.int64) if cold_row else np.empty(0, np.int64)
            times = np.concatenate(cold_n).astype(np.int32) if cold_row else np.empty(0, np.int32)
            cold = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(word), pa.array(times)], names=["word", "n"]))
            yield pa.StructArray.from_arrays([pa.array(n_tokens), pa.array(n_hot), pa.array(base), pa.array(other), pa.array(n_other), pa.array(lbl), cold], names=["n_tokens", "n_hot", "base", "other", "n_other", "model", "cold"])

    return judge


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-half unigram) and score (the model), both log10, for every row.

    Null and empty texts are one end mark. Repeated rows and null ids are scored one by one; other
    columns are not read.
    """
    judge = _scorer(model, docs.sparkSession.sparkContext)
    first = saved(docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), judge(_text(docs)).alias("s")).select("doc_id", "_row", "s.*"), "scored")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) * F.col("n")
    rare = (
        first.select("_row", F.explode("cold").alias("x")).select("_row", F.col("x.word").alias("word"), F.col("x.n").alias("n"))
        .join(model.counts, "word", "left")
        .groupBy("_row").agg(F.sum(log).alias("_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"))
    )
    n_base = float(np.log10(max(model.total + 0.5 * (model.distinct + 1), 0.5)))
    n_other = float(np.log10(max(model.other_total + 0.5 * (model.other_distinct + 1), 0.5)))
    cold = F.coalesce("_log", F.lit(0.0))
    return first.join(rare, "_row", "left").select(
        "doc_id", "n_tokens", (F.col("n_hot") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + cold - F.col("n_tokens") * F.lit(n_base)).alias("base_score"),
        # rare words are never of the vocabulary, which is a part of the hot ones
        (F.col("model") + F.col("other") + cold - F.col("n_other") * F.lit(n_other)).alias("score"),
    )


def lm_score(docs: DataFrame, vocabulary: int = VOCABULARY, hot: int = HOT) -> DataFrame:
    """Train on the rows that are not held out, score all rows (see held_out and score)."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), vocabulary, hot)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
