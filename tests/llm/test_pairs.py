"""Jaccard components and shared passages against brute force; the pipeline against its parts."""
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import rows

import corpus_pipeline
from pixtables.llm import jaccard_join, plans, quality_classifier, secret_scan, substring_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    """component per document and set size, by comparing all pairs of distinct sets that share anything."""
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    by_set, by_shingle = defaultdict(list), defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[s].append(d)
    for group in by_set.values():
        for d in group[1:]:
            parent[find(d)] = find(group[0])
    for s, group in by_set.items():
        for g in s:
            by_shingle[g].append(group[0])
    for s, group in by_set.items():
        for o in {o for g in s for o in by_shingle[g] if o > group[0]}:
            both = len(s & sets[o])
            if 100 * both >= 75 * (len(s) + len(sets[o]) - both):
                parent[find(o)] = find(group[0])
    low = {}
    for d in texts:
        low[find(d)] = min(low.get(find(d), d), d)
    return {d: (len(sets[d]), low[find(d)]) for d in texts}


def joined(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}


def test_join_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in plans.table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in plans.QUERIES["op9_jaccard_join"](spark, sf).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("leaf", [(24, 1024), (2, 2)])
def test_join_of_a_dense_family(spark, monkeypatch, leaf):
    """Copies of one text with few to many edits: some link with the base, some with each other only, many hardly miss."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf[0])
    monkeypatch.setattr(jaccard_join, "LATE_LEAF", leaf[1])
    rng = random.Random(9)
    base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(90)]
    texts = {}
    for d in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.4:
                w[at] = rng.choice(["new", "other", f"n{d}"])
            elif kind < 0.7:
                del w[at]
            else:
                w.insert(at, rng.choice(["more", f"m{d % 7}"]))
        texts[d] = " ".join(w[: rng.choice([90, 90, 80, 70])])
    texts |= {100 + d: " ".join(base[:30] + [f"u{d}x{k}" for k in range(20)]) for d in range(40)}
    assert joined(spark, texts) == brute(texts)


def test_join_of_sets_around_the_sketch(spark):
    """Isolated pairs of a set that fits its sketch and a larger one that does not; all link, hardly."""
    texts = {}
    for i, (n, m) in enumerate([(64, 85), (64, 84), (64, 83), (63, 84), (62, 82), (60, 80), (61, 81), (48, 64), (49, 65)] * 8):
        w = [f"p{i}w{k}" for k in range(m + 4)]
        texts |= {2 * i: " ".join(w[: n + 4]), 2 * i + 1: " ".join(w)}
    got = joined(spark, texts)
    assert got == brute(texts)
    assert all(c == d // 2 * 2 for d, (_, c) in got.items())


def test_join_of_edge_rows(spark):
    docs = rows.documents(spark)
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows.TEXTS) + 1
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(0, 0)] == 0 and by[(1, 0)] == 1 and by[(2, 0)] == 2 and by[(None, 1)] is None and by[(6, 8996)] == 5
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 1, 2, None, 4, 5, 7, 8, 9, 10]))
    assert jaccard_join.jaccard_components(rows.empty(docs)).count() == 0 and jaccard_join.keep_one(rows.empty(docs)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in jaccard_join.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_passages_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: words(r.text) for r in plans.table(spark, sf, "documents").collect()}
    got = plans.QUERIES["op8_substring_dedup"](spark, sf).collect()
    runs = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - 51):
            runs[tuple(w[i : i + 52])].add(d)
    covered = defaultdict(set)
    for r in got:
        covered[r.doc_id] |= set(range(r.start, r.end))
        assert r.doc_id != r.other_doc_id and min(r.end - r.start, r.other_end - r.other_start) >= 50
    for d, w in docs.items():
        for i in range(len(w) - 51):
            if len(runs[tuple(w[i : i + 52])]) > 1:
                assert set(range(i, i + 52)) <= covered[d]


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(120)
    edited = passage[:40] + ["x"] + passage[41:80] + fresh(3) + passage[80:]
    docs = {0: fresh(50) + passage + fresh(50), 1: fresh(10) + edited, 2: fresh(200), 3: passage[:45] + fresh(100), 4: None, 5: "", 6: passage + fresh(5), 7: passage + fresh(5)}
    table = [(d, " ".join(t) if isinstance(t, list) else t) for d, t in docs.items()]
    df = spark.createDataFrame(table + [table[2]], "doc_id long, text string").withColumn("row", F.lit(0)).withColumn("seed", F.lit(0))
    got = {(r.doc_id, r.other_doc_id): (r.start, r.end) for r in substring_dedup.shared_passages(df).collect()}
    assert {d for d, _ in got} == {0, 1, 2, 6, 7} and all(o == 2 for d, o in got if d == 2)
    assert got[(1, 0)] == (10, 133) or got[(1, 6)] == (10, 133)
    assert substring_dedup.shared_passages(rows.empty(df)).count() == 0


def test_chaining_prefers_cheap_gaps():
    import numpy as np

    seg = substring_dedup.segments(np.array([0, 7, 14, 300, 307, 20]), np.array([100, 107, 114, 400, 407, 5]))
    parts = [[tuple(seg[i][:2]) for i in c] for c in substring_dedup.chains(seg)]
    assert [(0, 100)] in parts and [(300, 400)] in parts


def test_pipeline(spark, sf, tmp_path):
    docs = plans.table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality_classifier.fit(docs, plans.table(spark, sf, "labels"))
    left = {r.doc_id for r in quality_classifier.classify(docs, model).collect() if r.kept}
    comp = brute({d: t for d, t in texts.items() if d in left})
    left = {d for d in left if comp[d][1] == d}
    left -= {r.doc_id for r in plans.QUERIES["op2_decontaminate"](spark, sf).collect() if r.contaminated}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left


def test_stages_on_edge_rows(spark, tmp_path):
    folder = str(tmp_path)
    given = rows.documents(spark)
    rows.write(spark.createDataFrame([(None, None), (1, "alpha beta")], "item_id long, text string"), folder, "benchmark")
    rows.write(spark.createDataFrame([(None, None, None), (4, 1, 0), (4, 1, 0)], "doc_id long, quality long, toxic long"), folder, "labels")
    for docs in (given, rows.empty(given)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert out.count() <= n and (n or not out.count())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == n
    secret = spark.createDataFrame([(1, "a token: abcdefgh b", 19)], "doc_id long, text string, n_chars int")
    r = corpus_pipeline.secrets_redacted(spark, secret, folder).first()
    assert r.text == "a [SECRET] b" and r.n_chars == len(r.text)


def test_join_of_texts_with_a_common_part(spark):
    """Texts that share a long part and differ elsewhere: their regions hold the whole family, their links are few."""
    rng = random.Random(12)
    part = [f"c{k}" for k in range(70)]
    texts = {}
    for d in range(120):
        own = [f"o{rng.randrange(60)}" for _ in range(rng.randrange(8, 60))]
        texts[d] = " ".join(part + own)
        if d % 10 == 0:
            texts[1000 + d] = " ".join(part + own[:-1] + ["end"])
    assert joined(spark, texts) == brute(texts)


def test_family_is_not_spread_over_pivots(spark, monkeypatch):
    """Members of one family are expanded once a member, not once for each pivot of their sketch regions."""
    seen = []
    old = jaccard_join._entries
    monkeypatch.setattr(jaccard_join, "_entries", lambda rows, first=False: seen.append(rows.count()) or old(rows, first))
    rng = random.Random(3)
    texts = {d: " ".join([f"c{k}" if rng.random() < 0.995 else f"n{d}x{k}" for k in range(70)] + [f"o{d}x{k}" for k in range(30)]) for d in range(200)}
    assert joined(spark, texts) == brute(texts)
    assert max(seen[1:]) <= sum(len(shingles(t)) for t in texts.values())


def covered_runs(docs, got, size=50):
    """(document, start) of runs of words that two documents hold and no row covers."""
    runs = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w) - size + 1):
            runs[tuple(w[i : i + size])].add(d)
    covered = defaultdict(set)
    for r in got:
        covered[r.doc_id] |= {(i, i + size) for i in range(r.start, r.end - size + 1)}
    return {(d, i) for d, w in docs.items() for i in range(len(w) - size + 1) if len(runs[tuple(w[i : i + size])]) > 1 and (i, i + size) not in covered[d]}


def test_passages_of_stock_sentences(spark):
    """Two texts share 120 words of four stock sentences, each of which many other texts hold too."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = {}
    for k in range(12):
        stock = [fresh(30) for _ in range(4)]
        for d in range(80):
            docs[1000 * k + d] = fresh(40) + stock[d % 4] + fresh(40)
        for d in (150, 151):
            docs[1000 * k + d] = fresh(60) + [w for part in stock for w in part] + fresh(60)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = substring_dedup.shared_passages(df).collect()
    assert {(r.doc_id, r.start, r.end, r.other_doc_id) for r in got} >= {(1000 * k + d, 60, 180, 1000 * k + 301 - d) for k in range(12) for d in (150, 151)}
    assert not covered_runs(docs, got)


def test_passages_mixed_of_common_lines(spark):
    """Texts made of lines that very many texts hold: each run of 50 words that two of them hold is covered."""
    rng = random.Random(5)
    lines = [[f"l{k}w{i}" for i in range(rng.randrange(9, 30))] for k in range(12)]
    docs = {d: [w for _ in range(rng.randrange(2, 9)) for w in rng.choice(lines)] for d in range(150)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    assert not covered_runs(docs, substring_dedup.shared_passages(df).collect())


def test_alignment_has_no_limits_of_length():
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.integers(0, 10**9, 3000)
    b = np.delete(a, [700, 2100])
    assert substring_dedup.common_words(a, b) == 2998
    assert substring_dedup.reach(np.arange(9000), np.arange(9000)) == (9000, 9000)
    for n, m in ((40, 25), (7, 30), (0, 5)):
        x, y = rng.integers(0, 6, n), rng.integers(0, 6, m)
        row = [0] * (m + 1)
        for v in x:
            new = [0]
            for j, w in enumerate(y):
                new.append(max(row[j + 1], new[j], row[j] + (v == w)))
            row = new
        assert substring_dedup.common_words(x, y) == row[-1]
    # a chain over a wide unequal gap falls apart into its passages
    left, right = np.arange(100), np.arange(1000, 1100)
    x, y = np.concatenate([left, np.arange(5000, 5450), right]), np.concatenate([left, np.arange(7000, 7450), right])
    assert sorted(substring_dedup.passages(x, y, [[0, 0, 100, 550, 550, 100]])) == [(0, 100, 0, 100, 100), (550, 650, 550, 650, 100)]
    assert sorted(substring_dedup.passages(x, y, [[0, 0, 650]])) == [(0, 100, 0, 100, 100), (550, 650, 550, 650, 100)]


def test_passages_of_a_text_that_repeats_itself():
    """Only the passage of the whole texts is left of the many diagonals; one that reaches outside it stays."""
    import numpy as np

    a = np.tile(np.arange(60), 20)
    diagonals = [[0, 0, 1200]] + [[60 * i, 0, 60] for i in range(1, 20)] + [[0, 60 * i, 60] for i in range(1, 20)]
    assert substring_dedup.passages(a, a, diagonals) == [(0, 1200, 0, 1200, 1200)]
    # a chain that leaves the diagonal of two equal texts and comes back to it
    assert substring_dedup.passages(a, a, [[0, 0, 300, 300, 360, 60, 420, 420, 780]]) == [(0, 1200, 0, 1200, 1200)]
    b = np.concatenate([a[:60], np.arange(9000, 9500), a[:60]])
    assert sorted(substring_dedup.passages(a[:60], b, [[0, 0, 60], [0, 560, 60]])) == [(0, 60, 0, 60, 60), (0, 60, 560, 620, 60)]


def test_segments_of_many_pairs_at_once():
    """Anchors of all pairs of a batch are merged together; before, each pair was sorted by itself."""
    import numpy as np

    r = np.random.default_rng(3)
    pair = np.repeat(np.arange(40), r.integers(2, 30, 40))
    x, y = r.integers(0, 200, len(pair)), r.integers(0, 200, len(pair))
    of, seg = substring_dedup.segments_of(pair, x, y)
    for k in range(40):
        assert (seg[of == k] == substring_dedup.segments(x[pair == k], y[pair == k])).all()
    g = r.integers(0, 3, 70_000).astype(np.uint64)  # ties: the first of equal ones, over the edge of a piece too
    assert all(at == i + int(np.argmin(g[i : i + 16])) for i, at in list(enumerate(substring_dedup.lowest(g).tolist()))[65_400:65_700])
    same = np.arange(100)
    other = np.where(np.isin(same, [3, 40, 41, 42, 43]), -1, same)
    assert substring_dedup.reach(same, other) == (40, 39) and substring_dedup.reach(same[:20], other[:20]) == (20, 19)


def test_passages_alike_of_common_sentences(spark):
    """Two texts hold three stock sentences with a word between them; many others hold two of the three, under 50 words.

    Before, each seed was joined with four documents only, so the two never met."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = {}
    for k in range(6):
        stock = [fresh(24) for _ in range(3)]
        for d in range(90):
            a, b = [(0, 1), (1, 2), (0, 2)][d % 3]
            docs[1000 * k + d] = fresh(40) + stock[a] + fresh(1) + stock[b] + fresh(40)
        for d in (17, 18):
            docs[1000 * k + d] = fresh(60) + stock[0] + fresh(1) + stock[1] + fresh(1) + stock[2] + fresh(60)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end, r.other_doc_id) for r in substring_dedup.shared_passages(df).collect()}
    assert got >= {(1000 * k + d, 60, 134, 1000 * k + 35 - d) for k in range(6) for d in (17, 18)}


def test_passages_alike_of_edited_lines(spark):
    """Texts of edited lines that many texts hold: nearly all that a comparison of all pairs finds is covered (before, 61 %)."""
    import numpy as np

    from pixtables.llm import shingles as numbers

    rng = random.Random(1)
    lines = [[f"l1k{k}w{i}" for i in range(rng.randrange(14, 30))] for k in range(10)]
    docs = {}
    for d in range(150):
        docs[d] = []
        for _ in range(rng.randrange(2, 7)):
            line = list(rng.choice(lines))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                del line[rng.randrange(len(line))]
            docs[d] += line + [f"m{rng.randrange(10**6)}"] * (rng.random() < 0.5)
    words_of = {d: numbers.word_numbers(np.frombuffer(" ".join(w).encode(), np.uint8)) for d, w in docs.items()}
    held = defaultdict(lambda: defaultdict(list))
    for d, n in words_of.items():
        for x, s in zip(*[v.tolist() for v in substring_dedup.minimizers(n)]):
            held[s][d].append(x)
    anchors = defaultdict(set)
    for h in held.values():
        for u in h:
            for v in h:
                if u < v:
                    anchors[u, v] |= {(x, y) for x in h[u] for y in h[v]}
    want, links = defaultdict(set), set()
    for (u, v), z in anchors.items():
        seg = substring_dedup.segments(*map(np.array, zip(*sorted(z))))
        chains = [seg[part, :3] for part in substring_dedup.chains(seg)]
        chains = [c.ravel().tolist() for c in chains if (c[-1, :2] + c[-1, 2] - c[0, :2]).min() >= substring_dedup.LEAST]
        for a, b, c, e, _ in substring_dedup.passages(words_of[u], words_of[v], chains) if chains else []:
            want[u] |= set(range(a, b))
            want[v] |= set(range(c, e))
            links |= {(u, v), (v, u)}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(4)
    found = defaultdict(set)
    for r in substring_dedup.shared_passages(df).collect():
        found[r.doc_id] |= set(range(r.start, r.end))
    assert len(links) > 200 and sum(len(want[d] & found[d]) for d in want) >= 0.95 * sum(map(len, want.values()))
