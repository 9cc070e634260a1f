"""Chat formatting: conversations rebuilt from an event log, rendered, masked and read back.

The log has one row per event: ``message`` opens a message of a turn, ``delta`` appends a
streamed piece to it, ``edit`` replaces its text, ``regenerate`` throws its text away so that
later deltas build it anew. Events of a conversation are folded in the order of (turn, seq);
all of it is windows and aggregates, no Python.

Template of a turn: ``<s>[INST] role [/INST]text</s>``. A control string inside a role or a text
gets one backslash after its first character, and one that already has backslashes gets one
more; taking one away restores it. So raw control strings stand in the output only as marks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: the control strings are <s>, </s>, [INST] and [/INST]
_ANGLE, _SQUARE = r"<(\\*)(/?s>)", r"\[(\\*)(/?INST\])"
_ANGLE_BACK, _SQUARE_BACK = r"<\\(\\*)(/?s>)", r"\[\\(\\*)(/?INST\])"
TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\](.*?)</s>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _ANGLE, r"<\\$1$2"), _SQUARE, r"[\\$1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _ANGLE_BACK, "<$1$2"), _SQUARE_BACK, "[$1$2")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, text: the final messages.

    events: conv_id, turn, seq, kind, role, text. Null texts count as empty, null kinds as
    ``message``. Equal (turn, seq) are ordered by kind (message first), role and text, so repeated
    rows keep a defined order; two messages of one turn stay two (part 1, 2). A delta, edit or
    regenerate before any message of its turn belongs to an empty part 0, whose role is the first
    role named there. Other columns are not read.
    """
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    e = events.select("conv_id", "turn", "seq", F.coalesce(F.col("kind"), F.lit("message")).alias("kind"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_k", rank)
    in_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "_k", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("part", F.sum((F.col("_k") == 0).cast("long")).over(in_turn)).withColumn("_version", F.sum((F.col("_k") < 3).cast("long")).over(in_turn)).withColumn("_n", F.row_number().over(in_turn))
    piece = F.struct(F.col("_version").alias("v"), F.col("_n").alias("n"), F.when(F.col("_k") == 1, "").otherwise(F.col("text")).alias("t"))
    m = e.groupBy("conv_id", "turn", "part").agg(F.sort_array(F.collect_list(piece)).alias("_p"), F.max("_version").alias("_v"), F.min_by("role", "_n").alias("role"))
    last = F.transform(F.filter("_p", lambda x: x["v"] == F.col("_v")), lambda x: x["t"])
    return m.select("conv_id", "turn", "part", "role", F.array_join(last, "").alias("text"))


def render(messages: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans: one row per conversation, turns in the order of (turn, part). A null role is an empty one.

    spans is the loss mask: for each text of ``role`` its [start, end) in code points of formatted, and
    the same place in bytes of its UTF-8 form (from, to), an empty array where there is no such text.
    """
    m = messages.select("conv_id", "turn", "part", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    m = m.withColumn("_h", F.concat(F.lit("<s>[INST] "), escape(F.col("role")), F.lit(" [/INST]"))).withColumn("_b", escape(F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda size: F.coalesce(F.sum(size("_h") + size("_b") + 4).over(before), F.lit(0)).cast("long") + size("_h")
    m = m.withColumn("_start", at(F.length)).withColumn("_from", at(F.octet_length))
    span = F.when(F.col("role") == role, F.struct(F.col("_start").alias("start"), (F.col("_start") + F.length("_b")).alias("end"), F.col("_from").alias("from"), (F.col("_from") + F.octet_length("_b")).alias("to")))
    turn = F.struct("_start", "_h", "_b", span.alias("s"))
    whole = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_m"))
    return whole.select(
        "conv_id", F.array_join(F.transform("_m", lambda x: F.concat(x["_h"], x["_b"], F.lit("</s>"))), "").alias("formatted"),
        F.transform(F.filter("_m", lambda x: x["s"].isNotNull()), lambda x: x["s"]).alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, roles, texts: the turns found in the output by its marks alone, unescaped."""
    part = lambda g: F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(g)), unescape)
    return formatted.select("conv_id", "formatted", part(1).alias("roles"), part(2).alias("texts"))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, spans of rendered conversations."""
    return formatted.select("conv_id", "formatted", "spans")


def loss_texts() -> Column:
    """What the loss mask of a rendered conversation covers, cut from the output and unescaped, in order."""
    raw = F.col("formatted").cast("binary")
    return F.transform("spans", lambda s: unescape(F.substring(raw, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")).cast("string")))


def digests(formatted: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars per conversation.

    Turns are read back by the marks of the output, the loss by its mask.
    """
    part = lambda g: F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(g)), unescape)
    turns = F.arrays_zip(part(1).alias("r"), part(2).alias("t"))
    whole = F.array_join(F.transform("_z", lambda x: F.concat(x["r"], F.lit("\n"), x["t"], F.lit("\n"))), "")
    # the one-element generator computes each of the two texts once for its length and its digest
    row = formatted.select("conv_id", "formatted", loss_texts().alias("_l"), F.explode(F.array(turns)).alias("_z"))
    row = row.select("conv_id", F.size("_z").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.explode(F.array(F.array_join("_l", ""))).alias("_b"), F.length("formatted").cast("long").alias("formatted_chars"))
    return row.select("conv_id", "n_turns", "turns_sha256", F.length("_b").cast("long").alias("loss_chars"), F.sha2("_b", 256).alias("loss_sha256"), "formatted_chars")


def as_events(conversations: DataFrame) -> DataFrame:
    """A finished table (conv_id, turn, role, text) as a log: each row one message event."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def chat_format(events: DataFrame) -> DataFrame:
    """conv_id, formatted and its loss mask for an event log. An empty log gives no rows; null conv_ids form one conversation."""
    return render(fold(events))
