"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts and items are normalised alike: A-Z to lower case, words of ASCII letters and digits and
all characters beyond ASCII. The automaton runs over word numbers of the benchmark's own
vocabulary and reads each text once. Hits are word ranges; ``spans`` maps them to code points
of the original text.

The windows are broadcast in blocks of a fixed number, so what a task holds is bounded; a
benchmark of more windows takes more passes.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pixtables.session import saved

WINDOW = 13
BLOCK = 50_000  # windows of one automaton
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (words joined by one space), items (sorted strings): each distinct window once.

    Items of fewer words are one window, items without words (null too) none. Items with a null
    id count as item ''.
    """

    @F.arrow_udf("array<string>")
    def cut(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in it:
            out = []
            for v in x:
                w = words(v.as_buffer().to_pybytes()) if v.is_valid else []
                out.append(sorted({b" ".join(w[i : i + size]).decode("utf-8", "replace") for i in range(max(1, len(w) - size + 1))}) if w else [])
            yield pa.array(out, pa.list_(pa.string()))

    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    rows = benchmark.select(item.alias("item"), F.explode(cut(F.col("text").cast("binary"))).alias("window"))
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _scanner(held):
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("items", pa.list_(pa.string()))])))])

    @F.arrow_udf("struct<n_words:bigint,hits:array<struct<first:int,last:int,items:array<string>>>>")
    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        number: dict[bytes, int] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in held.value:
            key = tuple(number.setdefault(w, len(number) + 1) for w in window.encode().split(b" "))
            machine.add_word(key, (len(key), items))
        some = bool(number)
        if some:
            machine.make_automaton()
        for x in it:
            out = []
            for v in x:
                w = words(v.as_buffer().to_pybytes()) if v.is_valid else []
                found = machine.iter(tuple(map(number.get, w, repeat(0)))) if some and w else ()
                out.append({"n_words": len(w), "hits": [{"first": end - n + 1, "last": end, "items": items} for end, (n, items) in found]})
            yield pa.array(out, kind)

    return scan


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: list[str] | None = None, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The key columns, _n_words and _hits (word ranges with their items, repeats included)."""
    key = key or ["doc_id"]
    sc = docs.sparkSession.sparkContext
    held = windows(benchmark, size)
    blocks = max(1, -(-held.count() // block))
    df = docs.select(*[F.col(k) for k in key], F.col(text).cast("binary").alias("_text"))
    for i in range(blocks):
        # collected: one block, about ``block`` windows of at most ``size`` words
        mine = held if blocks == 1 else held.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
        scan = _scanner(sc.broadcast([(r["window"], r["items"]) for r in mine.collect()]))
        df = df.withColumn("_s", scan(F.col("_text")))
        df = df.select(*key, "_text", F.col("_s.n_words").alias("_n_words"), (F.concat("_hits", "_s.hits") if i else F.col("_s.hits")).alias("_hits"))
        if i < blocks - 1:
            df = saved(df, "scan")
    return df.select(*key, "_n_words", "_hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: list[str] | None = None, size: int = WINDOW, share: int = 20, block: int = BLOCK) -> DataFrame:
    """The key columns, n_words, n_hit, n_items, items (sorted strings), hit_words (sorted word
    numbers) and contaminated: some word is hit and ``share`` times the hit words reach the words.

    Null and empty texts have no words and are clean; an empty benchmark hits nothing. Repeated
    rows are judged one by one; other columns of both tables are not read.
    """
    found = hits(docs, benchmark, text, key, size, block)
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["first"], h["last"])))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["items"]))))
    out = found.select(*(key or ["doc_id"]), F.col("_n_words").alias("n_words"), hit.alias("hit_words"), items.alias("items"))
    n_hit = F.size("hit_words").cast("long")
    return out.select(*(key or ["doc_id"]), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_words", ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def spans(text: Column, hit_words: Column) -> Column:
    """array<struct<start, end>>: hit words as stretches of the original text, in code points."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def place(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for x, y in it:
            out = []
            for t, h in zip(x, y):
                found: list[dict] = []
                if t.is_valid and h.is_valid and len(h):
                    hit = set(h.as_py())
                    for i, m in enumerate(_WORD.finditer(t.as_py())):
                        if i in hit:
                            if found and i - 1 in hit:
                                found[-1]["end"] = m.end()
                            else:
                                found.append({"start": m.start(), "end": m.end()})
                out.append(found)
            yield pa.array(out, kind)

    return place(text, hit_words)
