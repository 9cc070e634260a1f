"""Quality classifier from weak labels.

1. Heuristic labellers vote good, bad or nothing on every text, for two questions: is it prose of
   use, and is it abusive. Their votes overlap and disagree.
2. Expectation-maximisation over the counts of vote patterns of all documents estimates how often
   each labeller is right on either class, and so the posterior of each pattern. The patterns are
   at most 3^11 whatever the table holds.
3. The posteriors label a bounded sample (``sample_rows``), on which a linear scorer over hashed
   words, word beginnings and the votes themselves is trained; it then scores every whole text.

One labeller's word beginnings are learned from at most ``labelled_rows`` rows of a labels table.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import shingles

BITS = 17
GOOD, BAD, NONE = 1, 0, 2
QUALITY_VOTES, TOXIC_VOTES = 8, 3

# fixed values: function words of the four languages, and insults
STOP = frozenset(
    "the of and to in a is that for it as with was on be by at this are from or an der die und das von zu den mit ist im "
    "nicht ein eine sich des auf le la les de et un une que en dans pour est qui par sur pas au du avec el los las y se del con su al para".split()
)
INSULTS = frozenset("idiot idiots moron morons stupid trash scum loser losers pathetic worthless disgusting clown clowns imbecile dumb vermin filth jerk dimwit".split())
_STOP, _INSULTS = frozenset(w.encode() for w in STOP), frozenset(w.encode() for w in INSULTS)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_UPPER, _ALPHA = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_SYMBOL, _EDGE = b"#*$%&|<>~^{}", bytes(c for c in range(33, 127) if not chr(c).isalnum())
PREFIXES = (4, 5, 6, 7, 8)


def numbers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, and of their beginnings of 4 to 8 bytes (A-Z lower-cased)."""
    start, end = shingles.word_bounds(raw)
    found = shingles.stretch_numbers(raw, start, end, PREFIXES)
    size = end - start
    return found[0], np.concatenate([found[i + 1][size >= n] for i, n in enumerate(PREFIXES)])


class Learned:
    """A sorted set of beginnings, with a table of their first bits in front that spares most look-ups."""

    def __init__(self, found: np.ndarray) -> None:
        self.found, self.first = found, np.zeros(1 << BITS, bool)
        self.first[found >> np.uint64(64 - BITS)] = True

    def hits(self, begins: np.ndarray) -> int:
        """Distinct members among the beginnings; -1 where nothing was learned."""
        if not len(self.found):
            return -1
        some = begins[self.first[begins >> np.uint64(64 - BITS)]]
        return int(np.isin(self.found, some).sum()) if len(some) else 0


def _vote(value: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


def votes(raw: bytes, learned: Learned, begins: np.ndarray) -> list[int]:
    """Votes on one text: the first eight say good or bad prose, the last three abusive (BAD) or not."""
    low = raw.translate(_LOWER)
    words = low.split()
    n = len(words)
    if not n:
        return [NONE] * (QUALITY_VOTES + TOXIC_VOTES)
    alpha = len(raw) - len(raw.translate(None, _ALPHA))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    symbol = (len(raw) - len(raw.translate(None, _SYMBOL))) / n
    stop = sum(map(_STOP.__contains__, words)) / n
    kinds = set(words)
    distinct = len(kinds) / n
    ends = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")
    shout = raw.count(b"!!") / n
    mean = (sum(map(len, words))) / n
    again = sum(map(eq, words, words[1:])) / n
    out = [
        _vote(symbol, symbol > 0.2, symbol < 0.05),
        _vote(upper, alpha > 20 and upper > 0.3 * alpha, upper < 0.12 * alpha),
        _vote(stop, n >= 20 and stop < 0.05, n >= 20 and stop > 0.12),
        _vote(distinct, n >= 20 and distinct < 0.3, n >= 20 and distinct > 0.4),
        _vote(ends, n >= 60 and ends * 100 < n, n >= 20 and ends * 40 > n),
        _vote(shout, shout > 0.1, shout < 0.01),
        _vote(mean, mean > 12, 3 < mean < 9),
        _vote(again, n >= 10 and again > 0.2, n >= 10 and again < 0.05),
    ]
    bare = any(w.strip(_EDGE) in _INSULTS for w in kinds)
    hits = learned.hits(begins)
    out.append(BAD if bare else NONE)
    out.append(NONE if hits < 0 else BAD if hits > 0 else GOOD)
    out.append(NONE if hits < 0 or hits == 1 else BAD if hits > 1 else GOOD)
    return out


def pattern(v: list[int]) -> int:
    out = 0
    for x in v:
        out = 3 * out + x
    return out


def unpack(code: int, n: int = QUALITY_VOTES + TOXIC_VOTES) -> list[int]:
    return [code // 3 ** (n - 1 - i) % 3 for i in range(n)]


def features(found: np.ndarray, v: list[int], begins: np.ndarray) -> np.ndarray:
    """Hashed words and word beginnings of a text, as sorted distinct numbers under 2^BITS; the
    first places are kept for the votes."""
    seen = np.zeros(1 << BITS, bool)
    seen[found >> np.uint64(64 - BITS)] = True
    seen[begins >> np.uint64(64 - BITS)] = True
    kept = 3 * len(v)
    seen[:kept] = False
    return np.concatenate([np.array([3 * i + x for i, x in enumerate(v)], np.int32), np.flatnonzero(seen).astype(np.int32)])


def em(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Vote patterns (rows of GOOD, BAD, NONE) with their counts: posterior of GOOD for each pattern,
    the labellers' accuracies on good and on bad rows, and the share of good rows."""
    good, bad = (codes == GOOD).astype(float), (codes == BAD).astype(float)
    # each labeller knows one kind of bad row: it seldom errs on good rows and misses most bad ones
    right, wrong, prior = np.full(codes.shape[1], 0.998), np.full(codes.shape[1], 0.3), 0.85
    post = np.full(len(codes), prior)
    for _ in range(rounds):
        a = np.log(prior) + good @ np.log(right) + bad @ np.log(1 - right)
        b = np.log(1 - prior) + bad @ np.log(wrong) + good @ np.log(1 - wrong)
        post = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        p, q = post * counts, (1 - post) * counts
        right = np.clip((p @ good + 1) / (p @ (good + bad) + 2), 0.6, 0.999)
        wrong = np.clip((q @ bad + 1) / (q @ (good + bad) + 2), 0.05, 0.999)
        wrong = np.maximum(wrong, 1.05 - right)  # never worse than chance
        prior = float(np.clip(p.sum() / max(counts.sum(), 1), 0.01, 0.99))
    return post, right, wrong, prior


def train(rows: list[np.ndarray], target: np.ndarray, rounds: int = 12, step: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2^BITS, heads) and biases of a logistic scorer; targets are posteriors in 0..1."""
    heads = target.shape[1]
    w, b = np.zeros((1 << BITS, heads)), np.zeros(heads)
    seen, seen_b = np.full((1 << BITS, heads), 1e-6), np.full(heads, 1e-6)
    order, rng = np.arange(len(rows)), np.random.default_rng(7)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            at = np.concatenate([rows[k] for k in part])
            row = np.repeat(np.arange(len(part)), [len(rows[k]) for k in part])
            scale = np.concatenate([scales(rows[k]) for k in part])
            z = np.zeros((len(part), heads))
            np.add.at(z, row, w[at] * scale[:, None])
            g = (1 / (1 + np.exp(-np.clip(z + b, -40, 40))) - target[part]) / len(part)
            places, back = np.unique(at, return_inverse=True)
            step_w = np.zeros((len(places), heads))
            np.add.at(step_w, back, g[row] * scale[:, None])
            step_w += decay * w[places]
            seen[places] += step_w**2
            w[places] -= step * step_w / np.sqrt(seen[places])
            gb = g.sum(axis=0)
            seen_b += gb**2
            b -= step * gb / np.sqrt(seen_b)
    return w.astype(np.float32), b


def scales(f: np.ndarray) -> np.ndarray:
    """Votes count in full; hashed words share one unit of length."""
    n = QUALITY_VOTES + TOXIC_VOTES
    out = np.full(len(f), 1 / np.sqrt(max(1, len(f) - n)))
    out[:n] = 1
    return out


@dataclass
class Model:
    """``learned``: numbers of word beginnings that abusive rows have; weights and biases of the heads good and abusive."""

    learned: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    accuracy: dict


def _seen(learned: np.ndarray, with_features: bool):
    @F.arrow_udf("struct<code:int,features:binary>")
    def see(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Learned(learned)
        for x in it:
            code, f = [], []
            for raw in shingles.rows(x):
                found, begins = numbers(raw)
                v = votes(raw.tobytes(), known, begins)
                code.append(pattern(v))
                f.append(features(found, v, begins).tobytes() if with_features else None)
            yield pa.StructArray.from_arrays([pa.array(code, pa.int32()), pa.array(f, pa.binary())], names=["code", "features"])

    return see


def _share(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, at most a tenth more, chosen by a hash of the key; all where there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * rows / n)).limit(rows + rows // 10)


def learn_beginnings(docs: DataFrame, labels: DataFrame, labelled_rows: int = 8_000, most: int = 600) -> np.ndarray:
    """Word beginnings that stand in many toxic rows and hardly in others, from a bounded sample of labelled rows."""
    l = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(_share(l, "doc_id", labelled_rows), "doc_id").where(F.col("text").isNotNull())

    def begin(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in it:
            yield pa.array([np.unique(numbers(raw)[1]).view(np.int64) for raw in shingles.rows(x)], pa.list_(pa.int64()))

    f = rows.select("toxic", F.explode(F.arrow_udf(begin, "array<bigint>")(F.col("text").cast("binary"))).alias("f"))
    n = f.groupBy("f").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("t"), F.count("*").alias("n"))
    # bounded: the ``most`` beginnings with at least 4 toxic rows and 19 of 20 rows toxic
    best = n.where("t >= 4 and 20 * t >= 19 * n").orderBy(F.desc("t"), "f").limit(most).collect()
    return np.sort(np.array([r["f"] for r in best], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = 6_000, labelled_rows: int = 8_000) -> Model:
    """Fit on all documents (vote patterns) and a bounded sample (weights). Without labels the learned labellers do not vote."""
    learned = learn_beginnings(docs, labels, labelled_rows) if labels is not None else np.empty(0, np.uint64)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    counted = docs.select(_seen(learned, False)(text)["code"].alias("code")).groupBy("code").count().collect()
    codes = np.array([unpack(r["code"]) for r in counted] or np.empty((0, QUALITY_VOTES + TOXIC_VOTES)), int).reshape(-1, QUALITY_VOTES + TOXIC_VOTES)
    counts = np.array([r["count"] for r in counted], float)
    q, t = slice(0, QUALITY_VOTES), slice(QUALITY_VOTES, None)
    good, right, wrong, share = em(codes[:, q], counts)
    clean, right_t, wrong_t, share_t = em(codes[:, t], counts)
    posterior = {r["code"]: (good[i], 1 - clean[i]) for i, r in enumerate(counted)}
    rows = _share(docs.select("doc_id", "text"), "doc_id", sample_rows).select(_seen(learned, True)(text).alias("s")).select("s.*").collect()
    rows = [r for r in rows if r["code"] in posterior]
    w, b = train([np.frombuffer(r["features"], np.int32) for r in rows], np.array([posterior[r["code"]] for r in rows]).reshape(-1, 2))
    return Model(learned, w, b, {"good": (right, wrong, share), "clean": (right_t, wrong_t, share_t)})


def score(text: Column, model: Model) -> Column:
    """struct<good, abusive> in 0..1. Texts without words (null too) get good = 0."""
    learned, weights, bias = model.learned, model.weights, model.bias

    @F.arrow_udf("struct<good:double,abusive:double>")
    def judge(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Learned(learned)
        for x in it:
            out = []
            for raw in shingles.rows(x):
                found, begins = numbers(raw)
                f = features(found, votes(raw.tobytes(), known, begins), begins)
                p = 1 / (1 + np.exp(-np.clip(scales(f) @ weights[f] + bias, -40, 40)))
                out.append((float(p[0]) if len(found) else 0.0, float(p[1])))
            good, abusive = zip(*out) if out else ((), ())
            yield pa.StructArray.from_arrays([pa.array(good, pa.float64()), pa.array(abusive, pa.float64())], names=["good", "abusive"])

    return judge(F.coalesce(text, F.lit("")).cast("binary"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, good, abusive (0..1) and kept for every row; kept needs good >= 0.5 and abusive < 0.5.

    Repeated rows get equal scores, null ids stay, other columns are not read, an empty table gives no rows.
    """
    return docs.select("doc_id", score(F.col("text"), model).alias("s")).select("doc_id", "s.good", "s.abusive", ((F.col("s.good") >= 0.5) & (F.col("s.abusive") < 0.5)).alias("kept"))
