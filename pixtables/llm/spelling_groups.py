"""Spelling variants by a bit-sliced position index.

Words that differ by one code point share their first or their last half. They meet by such a half; a
group that is too large for one task is parted again by halves of what is left of its words, until it is
small or its words differ in two letters at most. Groups are dealt over tasks in blocks. A block holds one
bit set for each (position, letter), a bit standing for a row. A word is looked up by walking its letters
once with four sets of rows: no error yet, one letter replaced, one inserted, one deleted; the last two read
the index one position further and one earlier. All rows of the block move on together, a machine word at a time.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_LETTERS, LEAST_COUNT, MUCH_MORE, DAMAGE = 6, 5, 5, 199
SLICE = 1 << 20  # bytes of a text read at a time
COUNTED = 300_000  # distinct words that a task counts before it hands them on
BLOCK = 4096  # rows of an index; a larger group is parted again
LETTERS = 1 << 18  # letters of all rows of an index
_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % LEAST_LETTERS)
_NOT_RUN = re.compile(rb"[^A-Za-z\x80-\xff]")


def runs(text: bytes) -> Iterator[list[str]]:
    """Maximal runs of letters of at least six code points, A-Z lower-cased; a list for each slice of the text."""
    at = 0
    while at < len(text):
        m = _NOT_RUN.search(text, at + SLICE)  # an ASCII character that is no letter ends a run
        end = m.start() if m else len(text)
        yield _RUN.findall(text[at:end].lower().decode("utf-8", "replace"))
        at = end


def misspelt(doc: bytes, run: str) -> str:
    """The run as the document holds it: where 199 divides the number of ``doc:run``, one letter is missing."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc + b":"))
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], schema=_WORDS)
        found.clear()
        return out

    crc = zlib.crc32
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            if not text.is_valid:
                continue
            seed = crc(doc.encode() + b":")
            for part in runs(text.as_buffer().to_pybytes()):
                found.update(part)
                for w in [w for w in set(part) if crc(w.encode(), seed) % DAMAGE == 0]:
                    n = part.count(w)
                    found[w] -= n
                    changed = misspelt(doc.encode(), w)
                    if len(changed) >= LEAST_LETTERS:
                        found[changed] += n
                if len(found) > COUNTED:
                    yield batch()
    yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of six letters and more that occur five times and more."""
    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("binary").alias("text"))
    counted = read.mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def part_of(word: str, path: str) -> tuple[int, int]:
    """What a path leaves of a word: it names the halves taken so far, f(ront) or b(ack) and a length, as ``f3b2``."""
    lo, hi = 0, len(word)
    for side, size in re.findall(r"([fb])(\d+)", path):
        if side == "f":
            lo += int(size)
        else:
            hi -= int(size)
    return lo, hi


def halves(word: str, path: str) -> list[tuple[str, str]]:
    """(path, key) of the groups that a word enters: it may be the longer or the shorter one of a pair."""
    lo, hi = part_of(word, path)
    size = hi - lo
    out = []
    shorter = {max(size - 1, 0) // 2} if len(word) > LEAST_LETTERS else set()  # no word is shorter than the least length
    for h in sorted({size // 2} | shorter):
        for side in "fb":
            p = f"{path}{side}{h}"
            a, b = part_of(word, p)
            out.append((p, word[:a] + "\0" + word[b:]))
    return out


def path_of(a: str, b: str, depth: int) -> str:
    """The one path on which a pair of near words is reported."""
    path = ""
    for _ in range(depth):
        (alo, ahi), (blo, bhi) = part_of(a, path), part_of(b, path)
        h = min(ahi - alo, bhi - blo) // 2
        path += f"{'f' if a[alo : alo + h] == b[blo : blo + h] else 'b'}{h}"
    return path


class Index:
    """Bit sets of rows by (position, letter) and by length."""

    def __init__(self, words: list[str]):
        self.at: list[dict[str, int]] = []
        self.long: dict[int, int] = {}
        ones: list[dict[str, list[int]]] = [{} for _ in range(max(map(len, words), default=0))]
        sizes: dict[int, list[int]] = {}
        for row, w in enumerate(words):
            sizes.setdefault(len(w), []).append(row)
            for i, c in enumerate(w):
                ones[i].setdefault(c, []).append(row)
        width = (len(words) + 7) // 8

        def bits(rows: list[int]) -> int:
            out = bytearray(width)
            for r in rows:
                out[r >> 3] |= 1 << (r & 7)
            return int.from_bytes(out, "little")

        self.at = [{c: bits(rows) for c, rows in by.items()} for by in ones]
        self.long = {n: bits(rows) for n, rows in sizes.items()}
        self.all = (1 << len(words)) - 1

    def near(self, word: str) -> list[int]:
        """Rows whose words differ from this one by exactly one letter."""
        at, n = self.at, len(self.at)
        same, replaced, inserted, deleted = self.all, 0, 0, 0
        behind = 0
        for i, c in enumerate(word):
            here = at[i].get(c, 0) if i < n else 0
            ahead = at[i + 1].get(c, 0) if i + 1 < n else 0
            inserted = (inserted | same) & ahead
            deleted = deleted & behind | same
            exact = same & here
            replaced = replaced & here | same ^ exact
            same = exact
            behind = at[i].get(word[i + 1], 0) if i < n and i + 1 < len(word) else 0
            if not (same or replaced or inserted or deleted):
                return []
        m = len(word)
        found = replaced & self.long.get(m, 0) | deleted & self.long.get(m - 1, 0) | (inserted | same) & self.long.get(m + 1, 0)
        out = []
        while found:
            low = found & -found
            out.append(low.bit_length() - 1)
            found ^= low
        return out


_NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _blocks(block: int, letters: int):
    """Rows (key, path, word, n), equal keys together -> near words. Whole groups are joined into a block while it is small."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def looked_up(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            index = Index([r[2] for r in rows])
            for key, path, word, _ in rows:
                depth = path.count("f") + path.count("b")
                for k in index.near(word):
                    other = rows[k]
                    if other[0] == key and other[1] == path and path_of(word, other[2], depth) == path:
                        out.append((word, other[2], other[3]))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((), (), ()), _NEAR.types)], schema=_NEAR)

        held, group, size = [], [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if group and group[0][0] != row[0]:
                    if held and (len(held) + len(group) > block or size > letters):
                        yield looked_up(held)
                        held, size = [], 0
                    held += group
                    size += sum(len(r[2]) for r in group)
                    group = []
                group.append(row)
        yield looked_up(held + group)

    return search


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("piece", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    for b in batches:
        rows = [(p, k, w, n) for path, w, n in zip(*[c.to_pylist() for c in b.columns]) for p, k in halves(w, path)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ((),) * 4, schema.types)], schema=schema)


def near_words(words: DataFrame, block: int = BLOCK, letters: int = LETTERS) -> DataFrame:
    """word, near, near_n: both directions of each pair of words (word, n; distinct) that differ by exactly one letter, once."""
    from pixtables.session import saved

    todo, done = words.select(F.lit("").alias("path"), "word", "n"), []
    while True:
        parts = todo.mapInArrow(_parts, "path string, piece string, word string, n long")
        parts = saved(parts.select(F.xxhash64("path", "piece").alias("key"), "path", "word", "n"), "halves")
        # a group whose words differ in two letters at most cannot be parted, nor can it be large
        large = parts.where(~F.col("path").rlike("[fb]0$")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block).select("key")
        large = saved(large, "large")
        if large.isEmpty():
            done.append(parts)
            break
        done.append(parts.join(large, "key", "left_anti"))
        todo = parts.join(large, "key", "left_semi").select("path", "word", "n")
    found: DataFrame | None = None
    for parts in done:
        hits = parts.select("key", "path", "word", "n").repartition("key").sortWithinPartitions("key").mapInArrow(_blocks(block, letters), "word string, near string, near_n long")
        found = hits if found is None else found.unionByName(hits)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms (word, form), by doubling: a form is five times as frequent, so a chain has fewer than 28 steps."""
    from pixtables.session import saved

    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = now.join(far, F.col("root") == F.col("_at"), "left")
        now = saved(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_groups(docs: DataFrame, block: int = BLOCK, letters: int = LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs`` (doc_id, text).

    Null and empty texts have no words, a null doc_id counts as an empty one, repeated rows count as often as they
    stand, other columns are not read, a table without words gives no row. Of near words of equal n the least in
    code-point order is the form.
    """
    from pixtables.session import saved

    words = saved(vocabulary(docs), "vocabulary")
    near = near_words(words, block, letters)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("_best"))
    judged = words.join(best, "word", "left")
    formed = F.coalesce(-F.col("_best.less") >= MUCH_MORE * F.col("n"), F.lit(False))
    told = saved(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("_best.near")).alias("form"), F.when(formed, -F.col("_best.less")).alias("form_n")), "forms")
    return told.join(roots(told.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
