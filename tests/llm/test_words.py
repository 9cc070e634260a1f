"""Word BPE against the library, repair of conversations and spelling groups against brute force."""
import hashlib
import json
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import rows

from pixtables.llm import plans, spelling_groups, turn_repair, word_bpe

# ---- op11


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe.default_vocabulary())


def ids(raw):
    return np.frombuffer(bytes(raw), "<u4").tolist()


AWKWARD = ["aaaaaaaaa aaa", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|", "<|ENDOFTEXT|>", "I'LL we're 'tis '", "ΣΑΣ Ǆ İstanbul ﬁ ẛ̣ ȩ́", "é e ́", "a b　c\u0085d\x1ce\x00f", "٣٤五五 12,5 …—!?!", "👩‍👩‍👧 😀", "x" * 5000 + "\n" + "é" * 3000]


@given(st.lists(st.text(alphabet="abestnrioAÉßΣςİ'l 0９\n\t\x0b\x1c\u0085 .,!<|>中́😀", max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_merges_by_positions_give_the_librarys_ids(library, texts):
    got = word_bpe.encoder(word_bpe.default_vocabulary()).encode(t.encode() for t in texts)
    assert [ids(g) for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_bpe_of_awkward_texts(library):
    enc = word_bpe.Encoder(word_bpe.default_vocabulary())
    assert [ids(g) for g in enc.encode(t.encode() for t in AWKWARD)] == [library.encode(t, add_special_tokens=False).ids for t in AWKWARD]
    assert enc.encode([]) == [] and enc.encode([b"", b" \n"]) == [b"", b""]


def test_slices_and_a_full_memory_change_nothing(library, monkeypatch):
    text = " ".join(AWKWARD * 3)
    assert b"".join(word_bpe.slices(text.encode(), 7)) == text.encode()
    monkeypatch.setattr(word_bpe, "KNOWN", 3)
    monkeypatch.setattr(word_bpe, "GROUP", 50)
    assert ids(word_bpe.Encoder(word_bpe.default_vocabulary()).encode([text.encode()])[0]) == library.encode(text, add_special_tokens=False).ids


def test_merges_out_of_order_are_refused(tmp_path):
    p = tmp_path / "v.json"
    p.write_text(json.dumps({"added_tokens": [], "model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "end_of_word_suffix": "", "merges": [["ab", "b"], ["a", "b"]]}}))
    with pytest.raises(ValueError):
        word_bpe.merges(str(p))


def test_word_bpe_rows(spark, library):
    docs = rows.documents(spark)
    coded = word_bpe.encode(docs, key=["doc_id", "text"])
    got = coded.select("text", "n_tokens", "ids", word_bpe.decode(F.col("ids")).alias("raw")).collect()
    assert len(got) == len(rows.TEXTS) + 1
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert ids(r.ids) == want and r.n_tokens == len(want) and bytes(r.raw).decode() == library.decode(want, skip_special_tokens=False)
    assert word_bpe.encode(rows.empty(docs)).count() == 0


def test_word_bpe_query(spark, sf, library):
    got = {r.doc_id: r for r in plans.QUERIES["op11_word_bpe"](spark, sf).collect()}
    docs = plans.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, t in docs:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(want) and got[d].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


# ---- op12

SPACE = " \t\n\v\f\r"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def best_edits(rows_):
    """Least (cost, edits) by trying all edits of row after row; rows are (role, text, fault)."""
    def inserted(best):
        for _ in range(2):
            for q, (c, e, out) in list(best.items()):
                r = "a" if q == "u" else "u"
                new = (c + 5, e + "I", out + [("user" if r == "u" else "assistant", "")])
                if r not in best or new[:2] < best[r][:2]:
                    best[r] = new
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows_:
        now = {}
        for q, (c, e, out) in best.items():
            more = 5 * (fault == "truncated")
            options = [(q, (c + 2, e + "D", out))]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in AFTER[q]:
                    options.append((role[:1], (c + more, e + "K", out + [(role, text)])))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in AFTER[q]:
                        options.append((r, (c + 1 + more, e + "R", out + [(name, text)])))
            for r, new in options:
                if r not in now or new[:2] < now[r][:2]:
                    now[r] = new
        best = inserted(now)
    return min((best[q] for q in ("", "a") if q in best), key=lambda b: b[:2])


def repaired_plainly(table):
    out = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        held = out.setdefault(conv, [])
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for conv, held in out.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in held:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        cost, audit, lines = best_edits([(r, t, f) for (_, r, t), f in zip(held, faults)])
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def as_found(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@given(st.lists(st.tuples(st.sampled_from(["u", "a", "s", "t", ""]), st.sampled_from([0, 0, 0, 1, 2])), max_size=12))
@settings(max_examples=300, deadline=None)
def test_search_finds_the_least_path(made):
    names = ["", "blank", "truncated"]
    assert turn_repair.cheapest(made) == best_edits([(r, "x", names[f]) for r, f in made])[:2]


def test_awkward_conversations(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "No", "", None, " \n", "What?", "Yes. ", "é!", " "]
    table = [(rnd.choice([1, 2, 3, None, 7]), rnd.choice([None, *range(-3, 40)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "us"]), rnd.choice(texts)) for _ in range(400)]
    table += table[:20] + [(50, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(1500)] + [(50, 3, "user", "same.")] * 30
    given_ = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(7)
    given_ = given_.withColumn("times", F.lit(9)).withColumn("part", F.lit("x")).withColumn("cost", F.lit(None))
    want = repaired_plainly(table)
    assert as_found(turn_repair.repair(turn_repair.damaged(given_))) == want
    assert as_found(turn_repair.repair(turn_repair.damaged(given_), whole=8, piece=4)) == want
    assert as_found(turn_repair.repair(turn_repair.damaged(given_), whole=3, piece=1)) == want
    assert as_found(turn_repair.repair(turn_repair.damaged(rows.empty(given_)))) == {}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_repair_query(spark, folder):
    sf = f"/root/testdata/{folder}"
    table = [tuple(r) for r in plans.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_found(plans.QUERIES["op12_turn_repair"](spark, sf)) == repaired_plainly(table)


# ---- op13


def grouped_plainly(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    without = {}
    for w in words:
        for i in range(len(w)):
            without.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), same in without.items():
        for w in same:
            near[w] |= same
        if a + b in words:
            near[a + b] |= same
            for w in same:
                near[w].add(a + b)
    out, form = {}, {}
    for w in words:
        others = near[w] - {w}
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
        out[w] = len(others)
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), words[w], out[w], words.get(form.get(w))) for w in words}


def as_groups(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=9), min_size=1, max_size=40, unique=True))
@settings(max_examples=300, deadline=None)
def test_index_finds_words_at_distance_one(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    index = spelling_groups.Index(words)
    for w in words:
        assert sorted(index.near(w)) == [k for k, x in enumerate(words) if near(w, x)]


@pytest.mark.parametrize("block", [4096, 5])
def test_dense_words_and_chains(spark, block):
    rnd = random.Random(block)
    pool = ["".join(rnd.choice("abà") for _ in range(rnd.randint(5, 8))) for _ in range(600)] + ["colour", "colours", "coloured", "colourz"] + ["z" * 3000, "z" * 3001]
    docs = [(rnd.choice([None, *range(40)]), " ".join(rnd.choices(pool, [1 / (i % 17 + 1) ** 2 for i in range(len(pool))], k=400)) + "\n×÷Ÿ Ālpha_colour ") for _ in range(60)]
    docs += [(90, "colour " * 4000 + "colours " * 700 + "colourss " * 100 + "colourses " * 10 + "Ŝcolourses9"), (91, None), (92, ""), (93, "x" * 70_000 + " ")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("form", F.lit("f"))
    want = grouped_plainly(docs)
    assert want["colourses"][1] == "colour" and max(v[3] for v in want.values()) > 5
    assert as_groups(spelling_groups.spelling_groups(df, block=block, letters=200 if block == 5 else 1 << 18)) == want
    assert as_groups(spelling_groups.spelling_groups(rows.empty(df))) == {}


def test_slices_of_a_long_text(spark, monkeypatch):
    text = ("Élan vital: straße " * 50 + "İx9abcdef ").encode()
    whole = [w for part in spelling_groups.runs(text) for w in part]
    monkeypatch.setattr(spelling_groups, "SLICE", 5)
    assert [w for part in spelling_groups.runs(text) for w in part] == whole and "abcdef" in whole


def test_spelling_query(spark, sf):
    docs = [tuple(r) for r in plans.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert as_groups(plans.QUERIES["op13_spelling_groups"](spark, sf)) == grouped_plainly(docs)
