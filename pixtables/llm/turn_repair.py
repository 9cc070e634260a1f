"""Repair of conversation structure by iterative-deepening A*.

Rows of a conversation are kept, given another role, deleted, or joined by inserted empty turns, so that
the initials of the roles read ``(s?(ua)+)?``. A depth-first search tries the edits in ASCII order of their
letters (D, I, K, R) under a cost bound that grows by one; states that failed with some rest of the bound
are remembered and not searched again with as much or less. So the first accepting path is the cheapest
one and, among equals, the least in ASCII order.

Rows are dealt over ranges of (conversation, turn, role, beginning of the text), so one huge conversation is
spread over many tasks. A conversation of up to WHOLE rows inside a range is searched as it is; any other
is cut into pieces of PIECE rows. Each piece is searched once for each pair of states at its ends, the
pieces are chained by the least (cost, edits), and their texts are digested as a stream. Both ways give the
same rows. What has to fit into a task is the string of edits of a conversation, not its texts.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

WHOLE, PIECE = 256, 64
SPACE = " \t\n\v\f\r"
NONE, REMOVE, CUT = 0, 1, 2  # faults as the search sees them: fine, blank or duplicate, truncated
STATES = "nsua"  # last role so far: nothing, system, user, assistant
ACCEPT = "na"
_NEXT = {"n": "su", "s": "u", "u": "a", "a": "u"}
_ROLE = {"n": "u", "s": "u", "u": "a", "a": "u"}  # the one role that an insertion or a new role can give
_NAME = {"u": "user", "a": "assistant"}


def legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def cheapest(rows: list[tuple[str, int]], start: str = "n", ends: str = ACCEPT) -> tuple[int, str]:
    """(cost, edits) for rows of (initial, fault); ``ends`` must be reachable from ``start``."""
    n = len(rows)
    least = [0] * (n + 1)  # cost that no path from here can avoid
    forced, breaks, after = 0, 0, ""
    for i in range(n - 1, -1, -1):
        initial, fault = rows[i]
        if fault:
            forced += 2
        else:
            breaks += bool(after) and not legal(initial + after)
            after = initial or "-"
        least[i] = forced + (breaks + 1) // 2  # one edit mends two breaks at most

    def steps(i: int, q: str) -> list[tuple[str, int, str, int]]:
        """Edits in ASCII order: (letter, row, state, cost)."""
        role = _ROLE[q]
        if i == n:
            return [("I", i, role, 5)]
        initial, fault = rows[i]
        out = [("D", i + 1, q, 2), ("I", i, role, 5)]
        if fault != REMOVE:
            more = 5 if fault == CUT else 0
            if initial and initial in _NEXT[q]:
                out.append(("K", i + 1, initial, more))
            out.append(("R", i + 1, role, 1 + more))
        return out

    failed: dict[tuple[int, str], int] = {}
    bound = least[0]
    while True:
        path: list[str] = []
        stack = [(0, start, 0, iter(steps(0, start)))]
        if n == 0 and start in ends:
            return 0, ""
        while stack:
            i, q, g, left = stack[-1]
            for letter, j, p, cost in left:
                rest = bound - g - cost
                if rest < least[j] or failed.get((j, p), -1) >= rest:
                    continue
                path.append(letter)
                if j == n and p in ends:
                    return g + cost, "".join(path)
                stack.append((j, p, g + cost, iter(steps(j, p))))
                break
            else:
                stack.pop()
                failed[i, q] = max(failed.get((i, q), -1), bound - g)
                if path:
                    path.pop()
        bound += 1


def reachable(rows: list[tuple[str, int]], start: str, end: str) -> bool:
    if end in "ua":
        return True
    return end == start or (start, end) == ("n", "s") and any(i == "s" and f != REMOVE for i, f in rows)


def rendered(roles: list[str], texts: list[str], start: str, edits: str) -> list[str]:
    """Lines ``role:text`` of the repaired rows."""
    out, i, q = [], 0, start
    for e in edits:
        if e == "I":
            q = _ROLE[q]
            out.append(_NAME[q] + ":")
            continue
        if e == "K":
            q = roles[i][:1]
            out.append(f"{roles[i]}:{texts[i]}")
        elif e == "R":
            q = _ROLE[q]
            out.append(f"{_NAME[q]}:{texts[i]}")
        i += 1
    return out


_COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long"
_WHOLE = "cost long, audit string, repaired_sha256 string"
_PIECE = f"part int, seq long, {_COUNTS}, first string, last string, costs array<long>, edits array<string>, roles array<string>, texts array<string>, {_WHOLE}"
_COUNTED = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def counted(rows: list[tuple]) -> tuple[dict, list[tuple[str, int]]]:
    """Counts of rows (turn, role, text, seen earlier), and the rows as the search sees them."""
    out, search = dict.fromkeys(_COUNTED, 0) | {"n": len(rows), "lo": None, "hi": None}, []
    for turn, role, text, again in rows:
        body = text.strip(SPACE)
        if not body:
            fault, name = REMOVE, "blank"
        elif again:
            fault, name = REMOVE, "duplicate"
        elif body[-1] not in ".!?":
            fault, name = CUT, "truncated"
        else:
            fault, name = NONE, None
        if name:
            out[name] += 1
        if search and not legal(search[-1][0] + role[:1]):
            out["illegal"] += 1
        if turn is not None:
            out["turns"] += turn != out["hi"]
            out["lo"], out["hi"] = turn if out["lo"] is None else out["lo"], turn
        search.append((role[:1], fault))
    return out, search


def _whole(rows: list[tuple]) -> dict:
    out, search = counted(rows)
    cost, audit = cheapest(search)
    lines = rendered([r[1] for r in rows], [r[2] for r in rows], "n", audit)
    return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _part(rows: list[tuple]) -> dict:
    out, search = counted(rows)
    found = [cheapest(search, s, e) if reachable(search, s, e) else (None, None) for s in STATES for e in STATES]
    ends = {"first": search[0][0], "last": search[-1][0]} if search else {}
    return out | ends | {"costs": [c for c, _ in found], "edits": [e for _, e in found], "roles": [r[1] for r in rows], "texts": [r[2] for r in rows]}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batches(found: Iterator[dict], schema: pa.Schema, rows: int = 1000, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in found:
        held.append(r)
        size += sum(map(len, r.get("texts") or ()))
        if len(held) >= rows or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def _cut_rows(schema: pa.Schema, whole: int, piece: int):
    """Sorted rows (conv_id, turn, role, text, times, later) -> whole conversations, and pieces of those that are long or may go on in another range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def conversations() -> Iterator[dict]:
            conv, held, seq, before, begun, inner = None, [], 0, None, False, False

            def pieces(seq: int) -> Iterator[dict]:
                for at in range(0, max(1, len(held)), piece):
                    yield {"conv_id": conv, "part": part, "seq": seq + at} | _part(held[at : at + piece])

            for c, turn, role, text, times, later in _rows(batches):
                if not begun or c != conv:
                    if begun:
                        if inner and not seq:
                            yield {"conv_id": conv, "part": part, "seq": 0} | _whole(held)
                        else:
                            yield from pieces(seq)
                        inner = True  # only the first conversation may have begun in another range, and the last go on there
                    conv, held, seq, before, begun = c, [], 0, None, True
                for k in range(times):
                    if len(held) == whole:
                        yield from pieces(seq)
                        held, seq = [], seq + whole
                    held.append((turn, role, text, later or k > 0 or before == (turn, role, text)))
                if times:
                    before = (turn, role, text)
            if begun:
                yield from pieces(seq)

        yield from _batches(conversations(), schema)

    return cut


def before(a: tuple, b: tuple) -> bool:
    """Whether edits a come before edits b; both are chains (end of the chain before, piece) held from the back."""
    x, y = [], []
    while a is not b and (a or b):  # the common beginning is the same object
        if b is None or (a is not None and a[2] >= b[2]):
            x.append(a[1])
            a = a[0]
        else:
            y.append(b[1])
            b = b[0]
    return "".join(reversed(x)) < "".join(reversed(y))


def _chain(schema: pa.Schema):
    """Sorted pieces (conv_id, part, seq, costs, edits) -> (conv_id, part, seq, start, audit) along the cheapest chain."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen() -> Iterator[dict]:
            conv, begun, best = None, False, {}

            def finish() -> Iterator[dict]:
                end = None
                for q in ACCEPT:
                    if q in best and (end is None or best[q][0] < best[end][0] or (best[q][0] == best[end][0] and before(best[q][1], best[end][1]))):
                        end = q
                link = best[end][1]
                while link is not None:
                    yield {"conv_id": conv, "part": link[3], "seq": link[4], "start": link[5], "audit": link[1]}
                    link = link[0]

            for c, part, seq, costs, edits in _rows(batches):
                if not begun or c != conv:
                    if begun:
                        yield from finish()
                    conv, begun, best = c, True, {"n": (0, None)}
                now: dict[str, tuple] = {}
                for i, s in enumerate(STATES):
                    for j, e in enumerate(STATES):
                        cost = costs[4 * i + j]
                        if s not in best or cost is None:
                            continue
                        total, link = best[s]
                        new = (total + cost, (link, edits[4 * i + j], (link[2] if link else 0) + 1, part, seq, s))
                        if e not in now or new[0] < now[e][0] or (new[0] == now[e][0] and before(new[1], now[e][1])):
                            now[e] = new
                best = now
            if begun:
                yield from finish()

        yield from _batches(chosen(), schema)

    return chain


def _join_pieces(schema: pa.Schema):
    """Sorted pieces with their chosen edits -> one row for each conversation; texts pass through a running digest."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]

        def conversations() -> Iterator[dict]:
            conv, out, audit, sha, lines = None, None, [], None, 0

            def done() -> dict:
                return out | {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

            for r in (dict(zip(b.schema.names, v)) for b in batches for v in zip(*[c.to_pylist() for c in b.columns])):
                if out is None or r["conv_id"] != conv:
                    if out is not None:
                        yield done()
                    conv, audit, sha, lines, last = r["conv_id"], [], hashlib.sha256(), 0, None
                    out = dict.fromkeys(_COUNTED, 0) | {"lo": None, "hi": None, "cost": 0}
                for name in _COUNTED:
                    out[name] += r[name]
                if r["n"]:
                    out["illegal"] += last is not None and not legal(last + r["first"])
                    last = r["last"]
                if r["lo"] is not None:
                    out["turns"] -= r["lo"] == out["hi"]
                    out["lo"], out["hi"] = r["lo"] if out["lo"] is None else out["lo"], r["hi"]
                audit.append(r["audit"])
                out["cost"] += r["step"]
                for line in rendered(r["roles"], r["texts"], r["start"], r["audit"]):
                    sha.update((("\n" if lines else "") + line).encode())
                    lines += 1
            if out is not None:
                yield done()

        yield from _batches(({k: v for k, v in r.items() if k in names} for r in conversations()), schema)

    return join


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that the number of ``conv_id:turn`` names.

    Nulls of role and text, and in that number, are one space. ``times`` is how often a row stands: 0 for a
    dropped one, which stays as a mark that its conversation exists.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def repair(rows: DataFrame, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, times; role and text without nulls).

    Rows stand in the order of their turns (nulls first), then role, then text. Columns: conv_id, n (rows), gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null conv_id is a conversation like any
    other; a conversation without rows has zeros, no edits and the digest of the empty text; null turns do not
    count for the gaps; columns that are not named above are not read; an empty table gives no row.
    """
    from pixtables.session import saved

    if whole % piece:
        raise ValueError("whole must be a multiple of piece")
    rows = rows.select("conv_id", "turn", "role", "text", "times", F.unhex(F.sha2(F.concat("role", F.lit("\n"), "text"), 256)).alias("_same"))
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = rows.where("times > 0").groupBy("conv_id", "_same").agg(F.min(order).alias("_first"), F.max(order).alias("_last")).where("_first < _last").select(F.col("conv_id").alias("_conv"), F.col("_same").alias("_of"), "_first")
    marked = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_of")), "left").select("conv_id", "turn", "role", "text", "times", F.coalesce(order > F.col("_first"), F.lit(False)).alias("later"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = marked.repartitionByRange(*by, F.substring("text", 1, 32)).sortWithinPartitions(*by, "text", "times")
    conv = rows.schema["conv_id"].dataType
    schema = lambda ddl: T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(ddl)])
    piece_schema = schema(_PIECE)
    cut = saved(dealt.mapInArrow(_cut_rows(to_arrow_schema(piece_schema), whole, piece), piece_schema), "conversations")
    result = ["conv_id", *[n.split(" ")[0] for n in f"{_COUNTS}, {_WHOLE}".split(", ")]]
    complete = cut.where("cost is not null").select(*result)
    parts = cut.where("cost is null").drop("cost", "audit", "repaired_sha256")
    place = ["conv_id", "part", "seq"]
    steps = schema("part int, seq long, start string, audit string")
    chosen = parts.select(*place, "costs", "edits").repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_chain(to_arrow_schema(steps)), steps)
    named = chosen.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("seq").alias("_seq"), "start", "audit")
    step = F.element_at("costs", F.array_position("edits", F.col("audit")).cast("int"))
    picked = parts.join(named, parts["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq")))
    joined = schema(f"{_COUNTS}, {_WHOLE}")
    long = picked.select(*place, *_COUNTED, "lo", "hi", "first", "last", "start", "audit", "roles", "texts", step.alias("step")).repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_join_pieces(to_arrow_schema(joined)), joined)
    wide = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1 - F.col("turns")
    gaps = F.coalesce(wide, F.lit(0)).cast("long")
    return complete.unionByName(long).select("conv_id", "n", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

