"""HTML extraction: main text by page structure and a suffix array over each host's pages.

A page becomes a stream of blocks (the text between block-level marks). Inside menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, as element names,
roles and class names tell, blocks are chrome. The block numbers of a host's pages are
concatenated, a suffix array finds the substrings that two or more distinct pages share, and
what such long substrings cover is boilerplate: outside an article it goes, and what is left are
the page's unique runs. Inside a marked article a repeated block goes only if half of the host's
pages have it and it is less than half of that article; copies of an article are thus kept.

A host with many pages is dealt over shards by the number of its blocks, each shard with its own
suffix array, so one hot host never meets in one task. What a long substring covers is also covered
by the shortest long runs (one to three blocks) that begin or end at its blocks; the shards of a host
are merged over the numbers of those runs and the page counts of their blocks, so the verdicts
are those of one suffix array over the host. Only numbers are grouped.
"""
from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixtables.session import saved

from . import shingles

SHARD_BLOCKS = 100_000
LONG_CHARS, LONG_BLOCKS = 24, 3  # a repeated substring is long with so many characters or blocks
COMMON_PAGES = 8
SALTS = 64

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z0-9]+")
# fixed values: elements and names that hold no main text
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_CHROME = frozenset("head nav footer aside form menu dialog button select svg script style textarea title noscript template iframe".split())
_CHROME_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription comment comments reply replies respond disqus share sharing social related recommended widget toolbar login signup pagination pager complementary contentinfo search alert dialog".split())
# fixed values: what may stand beside such a name in a class name, and what turns it round
_SUFFIXES = frozenset("area section list box bar wrap wrapper container inner outer block left right top bottom content item items link links form panel row col column group slot unit title text icon icons button buttons site page main primary secondary global top1 top2 post posts body".split())
_TURNS = frozenset("no not non has have with without is hide hides hidden disable disabled skip".split())
_WHOLE = frozenset("html body main article".split())  # no class name makes these chrome
_ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
_STACKED = _BLOCK - frozenset("p li dt dd h1 h2 h3 h4 h5 h6 hr option td th tr tbody thead tfoot caption legend summary body html".split())


def chrome_name(name: str) -> bool:
    """Whether a class name, id or role as a whole is that of chrome: ``site-footer``, not ``no-footer`` or ``footer-history``."""
    parts = _PART.findall(name)
    if not parts or parts[0] in _TURNS:
        return False
    return any(x in _CHROME_NAMES for x in parts) and all(x in _CHROME_NAMES or x in _SUFFIXES or x.isdigit() for x in parts)


def header_name(name: str) -> bool:
    parts = _PART.findall(name)
    return "header" in parts and all(x == "header" or x in _SUFFIXES or x.isdigit() for x in parts)


def blocks(page: str) -> list[tuple[int, str]]:
    """(place, text) of each block in page order; place: 0 chrome, 1 body, 2 main element, 3 article."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # element, place before it
    place, text, at, n = 1, [], 0, len(page)

    def close() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                out.append((place, " ".join(words)))
            text.clear()

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                text.append(" ")
            if name == "hr":
                close()
            continue
        if m[1] or m[4]:  # closing
            if name in _BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if place != stack[i][1]:
                        close()
                    place = stack[i][1]
                    del stack[i:]
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if name in _BLOCK:
            close()
            if stack and (stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1][0] == name == "li"):
                place = stack.pop()[1]  # a chrome paragraph without an end ends where the next block starts, an item where the next one does
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        named = set()
        if attributes and "=" in attributes:
            for x in _NAMES.finditer(attributes):
                named.update((x[1] or x[2] or x[3] or "").lower().split())
        chrome = name in _CHROME
        if name == "form":  # one around the article is no form of the page
            end = page.find("</form", at)
            chrome = not _ARTICLE.search(page, at, end if end >= 0 else n)
        if name not in _WHOLE:
            chrome = chrome or any(map(chrome_name, named)) or (place < 2 and (name == "header" or any(map(header_name, named))))
        inside = 3 if name == "article" or "articlebody" in named else 2 if name == "main" or "main" in named else 1
        new = 0 if chrome or place == 0 else max(place, inside)
        # inside chrome an element of the name of an open one is held too, so that its end does not close the outer one
        if new != place or name in _STACKED or (place == 0 and any(x == name for x, _ in stack)):
            if attributes.endswith("/"):
                continue
            close()
            stack.append((name, place))
            place = new
    close()
    return out


def number(place: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{min(place, 2)}|{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def repeated(pages: np.ndarray, tokens: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which tokens lie in a long substring that also stands on another page.

    pages (ascending) and tokens run along the concatenated streams, weight is characters per
    token. The suffix array is built by doubling; the ranks of each step also give the longest
    common prefix of any two suffixes, which ends at the end of a page.
    """
    n = len(tokens)
    size = shared_sizes(pages, tokens)
    total = np.concatenate([[0], np.cumsum(weight)])
    at = np.arange(n)
    long = (size >= LONG_BLOCKS) | ((size > 0) & (total[at + size] - total[at] >= LONG_CHARS))
    return covered(n, at[long], size[long])


def covered(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n tokens lie in one of the runs."""
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, start, 1)
    np.add.at(turn, start + size, -1)
    return np.cumsum(turn)[:n] > 0


def long_runs(pages: np.ndarray, tokens: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, number) of the shortest long runs that begin or end at each token, within its page.

    A long run of neighbouring tokens is covered by those of them that lie in it.
    """
    n = len(tokens)
    start, size, number_ = [], [], []
    at, found = np.arange(n), [np.zeros(n, bool), np.zeros(n, bool)]
    for k in range(1, LONG_BLOCKS + 1):
        m = max(n - k + 1, 0)
        inside = pages[:m] == pages[k - 1 :]
        chars, value = np.zeros(m, np.int64), np.full(m, k, np.uint64)
        for j in range(k):
            chars += weight[j : m + j]
            value = shingles.mix(value * np.uint64(0x9E3779B97F4A7C15) + tokens[j : m + j].view(np.uint64))
        long = inside & ((chars >= LONG_CHARS) | (k == LONG_BLOCKS))
        new = long & ~(found[0][:m] & found[1][k - 1 :])  # no shorter one at its begin, or none at its end
        found[0][:m] |= long
        found[1][k - 1 :] |= long
        start.append(at[:m][new])
        size.append(np.full(int(new.sum()), k, np.int64))
        number_.append(value[new].view(np.int64))
    return np.concatenate(start), np.concatenate(size), np.concatenate(number_)


def shared_sizes(pages: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Length of the longest substring from each token on that also stands on another page."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    left = np.searchsorted(pages, pages, "right") - np.arange(n)  # tokens to the end of the page
    level = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    step, longest = 1, int(left.max())
    while step < longest and level[-1].max() < n - 1:
        now = level[-1]
        behind = np.full(n, -1, np.int64)
        inside = np.flatnonzero(left > step)
        behind[inside] = now[inside + step]
        # a suffix that ends within the step differs from all others by its page and length
        level.append(np.unique(now * (2 * n + 2) + np.where(left > step, behind + 1, 0), return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(level[-1], kind="stable")
    own = pages[order]
    slot = np.arange(n)
    new_run = np.concatenate([[True], own[1:] != own[:-1]])
    start = np.maximum.accumulate(np.where(new_run, slot, 0))
    last = np.concatenate([new_run[1:], [True]])
    stop = np.minimum.accumulate(np.where(last, slot, n)[::-1])[::-1]

    def common(other: np.ndarray) -> np.ndarray:
        ok = (other >= 0) & (other < n)
        a, b = order[ok].copy(), order[other[ok]].copy()
        size = np.zeros(len(a), np.int64)
        room = np.minimum(left[a], left[b])
        for k in range(len(level) - 1, -1, -1):
            can = size + (1 << k) <= room
            i, j = a + size, b + size
            same = np.zeros(len(a), bool)
            same[can] = level[k][i[can]] == level[k][j[can]]
            size += np.where(same, 1 << k, 0)
        out = np.zeros(n, np.int64)
        out[order[ok]] = size
        return out

    return np.maximum(common(start - 1), common(stop + 1))


def extract(found: list[tuple[int, str]], repeats: set[int], common: set[int]) -> str:
    """Main text of a page's blocks: its article, else its main element, else its unique runs.

    ``repeats``: numbers of the long runs that other pages of the host have too."""
    best = max((p for p, _ in found), default=0)
    if best >= 2:
        main = [(number(p, t), t) for p, t in found if p == best]
        drop = sum(len(t) for k, t in main if k in common)
        if 2 * drop < sum(len(t) for _, t in main):
            main = [(k, t) for k, t in main if k not in common]
        return "\n".join(t for _, t in main)
    tokens = np.array([number(p, t) for p, t in found], np.int64)
    start, size, runs = long_runs(np.zeros(len(found), np.int64), tokens, np.array([len(t) for _, t in found], np.int64))
    hit = np.array([k in repeats for k in runs.tolist()], bool)
    gone = covered(len(found), start[hit], size[hit])
    return "\n".join(t for (p, t), x in zip(found, gone) if p == 1 and not x)


def _texts(x: pa.Array) -> Iterator[str]:
    for v in x:
        yield v.as_buffer().to_pybytes().decode("utf-8", "replace") if v.is_valid else ""


def _stream(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in it:
        tokens, sizes = [], []
        for t in _texts(x):
            found = blocks(t)
            tokens.append([number(p, s) for p, s in found])
            sizes.append([len(s) for _, s in found])
        yield pa.StructArray.from_arrays([pa.array(tokens, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["tokens", "sizes"])


_FOUND = "host string, shard bigint, n bigint, repeats array<bigint>, common array<bigint>, runs array<struct<run:bigint,local:boolean,tokens:array<bigint>>>, held array<struct<token:bigint,pages:bigint>>"


def _boilerplate(group: pa.Table) -> pa.Table:
    """One shard: the long runs that its pages repeat, and covered block numbers on half of its pages.

    Where the host has other shards: all its long runs, and block numbers with their page counts.
    """
    lists = group.column("tokens").combine_chunks()
    tokens = lists.flatten().to_numpy()
    n = np.diff(lists.offsets.to_numpy())
    pages = np.repeat(np.arange(len(n)), n)
    weight = group.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64)
    start, size, number_ = long_runs(pages, tokens, weight)
    hit = shared_sizes(pages, tokens)[start] >= size if len(start) else np.zeros(0, bool)
    per_page = np.unique(np.stack([tokens, pages]), axis=1)[0] if len(tokens) else tokens
    held, on = np.unique(per_page, return_counts=True)
    repeats, common, runs, counts = [], [], [], []
    if group.column("shards")[0].as_py() <= 1:
        repeats = np.unique(number_[hit])
        common = np.intersect1d(held[(on >= COMMON_PAGES) & (2 * on >= len(n))], tokens[covered(len(tokens), start[hit], size[hit])])
    else:
        every, first = np.unique(number_, return_index=True)
        local = np.isin(every, number_[hit])
        runs = [{"run": k, "local": o, "tokens": tokens[start[i] : start[i] + size[i]].tolist()} for k, o, i in zip(every.tolist(), local.tolist(), first.tolist())]
        counts = [{"token": t, "pages": c} for t, c in zip(held.tolist(), on.tolist())]
    run_kind, held_kind = pa.struct([("run", pa.int64()), ("local", pa.bool_()), ("tokens", pa.list_(pa.int64()))]), pa.struct([("token", pa.int64()), ("pages", pa.int64())])
    return pa.table({
        "host": group.column("host")[:1], "shard": group.column("shard")[:1], "n": pa.array([len(n)], pa.int64()),
        "repeats": pa.array([repeats], pa.list_(pa.int64())), "common": pa.array([common], pa.list_(pa.int64())),
        "runs": pa.array([runs], pa.list_(run_kind)), "held": pa.array([counts], pa.list_(held_kind)),
    })


def _merged(known: DataFrame) -> DataFrame:
    """host, shard, repeats, common with the verdicts of whole hosts. A key has one row for each shard at most."""
    runs = known.select("host", "shard", F.explode("runs").alias("r")).select("host", "shard", "r.*")
    again = runs.groupBy("host", "run").agg(F.count("*").alias("c"), F.max("local").alias("local"), F.first("tokens").alias("tokens")).where("local or c > 1")
    repeats = runs.join(again.select("host", "run"), ["host", "run"]).groupBy("host", "shard").agg(F.collect_list("run").alias("r"))
    held = known.select("host", "shard", F.explode("held").alias("t")).select("host", "shard", "t.*")
    pages = known.where(F.size("held") > 0).select("host").distinct().join(known.groupBy("host").agg(F.sum("n").alias("n")), "host")
    on = held.groupBy("host", "token").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= COMMON_PAGES)
    on = on.join(pages, "host").where("2 * pages >= n").join(again.select("host", F.explode("tokens").alias("token")).distinct(), ["host", "token"])
    common = held.join(on.select("host", "token"), ["host", "token"]).groupBy("host", "shard").agg(F.collect_list("token").alias("c"))
    out = known.select("host", "shard", "repeats", "common").join(repeats, ["host", "shard"], "left").join(common, ["host", "shard"], "left")
    return out.select("host", "shard", F.coalesce("r", "repeats").alias("repeats"), F.coalesce("c", "common").alias("common"))


def html_extract(pages: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """page_id, url, text for every row of pages.

    Null and empty pages give an empty text; pages without a host form one host. Repeated rows are
    pages like any other. Other columns are not read; an empty table gives no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))).alias("host")
    deal = F.xxhash64("page_id", "url").alias("deal")
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    streams = saved(pages.select(host, deal, F.arrow_udf(_stream, "struct<tokens:array<bigint>,sizes:array<int>>")(raw).alias("s")).select("host", "deal", "s.*"), "streams")
    shards = streams.groupBy("host").agg(F.ceil(F.sum(F.size("tokens")) / shard_blocks).cast("long").alias("shards"))
    # one row for each of SALTS parts of a host, so that a hot host's pages are joined in many tasks
    shards = shards.select("host", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salt = F.pmod(F.shiftright("deal", 32), F.lit(SALTS)).alias("salt")
    shard = F.pmod(F.col("deal"), F.greatest("shards", F.lit(1))).alias("shard")
    dealt = streams.select("*", salt).join(shards, ["host", "salt"]).select("host", "shards", shard, "tokens", "sizes")
    known = saved(dealt.groupBy("host", "shard").applyInArrow(_boilerplate, _FOUND), "found")
    # each host's shards with what they found; pages are matched with the shard they were dealt to
    known = saved(_merged(known), "boilerplate")

    def finish(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        met: dict[tuple, tuple[set[int], set[int]]] = {}  # a shard's numbers are made into sets once, not for each of its pages
        for x, h, k, r, c in it:
            out = []
            for t, key, a, b in zip(_texts(x), zip(h.to_pylist(), k.to_pylist()), r, c):
                if key not in met:
                    if sum(map(len, map(itemgetter(0), met.values()))) > 10 * SHARD_BLOCKS:
                        met.clear()
                    met[key] = tuple(set(v.values.to_numpy().tolist()) if v.is_valid else set() for v in (a, b))
                out.append(extract(blocks(t), *met[key]))
            yield pa.array(out, pa.string())

    rows = pages.select("page_id", "url", host, deal, raw.alias("raw")).select("*", salt).join(shards, ["host", "salt"], "left").select("page_id", "url", "raw", "host", shard)
    rows = rows.join(known, ["host", "shard"], "left")
    return rows.select("page_id", "url", F.arrow_udf(finish, "string")("raw", "host", "shard", "repeats", "common").alias("text"))
