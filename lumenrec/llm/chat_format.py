"""Chat formatting with Spark expressions only.

A conversation becomes one string.  Adjacent turns of one role share a block:

    <s>[INST role]text[TURN]text[/INST]</s>

``&``, ``<``, ``[`` and ``]`` inside roles and texts are written as entities, so no
control string can arise from a text, and the reading direction is exact.
``loss`` lists the code-point spans (start, length) of assistant texts.

Turns are collected in two steps, first by stretches of ``stretch`` turn
numbers, so one task never sorts a whole hot conversation's raw rows at once.

Defined results: a null text is empty, a null role is the empty role; rows with
equal turn order by role, then text; a null turn comes first; repeated rows stay
repeated; a null conv_id is a conversation of its own; an empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, TURN, CLOSE = "<s>[INST ", "]", "[TURN]", "[/INST]</s>"


def escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for raw, entity in (("]", "&#93;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def _ordered_turns(conversations: DataFrame, stretch: int) -> DataFrame:
    turns = conversations.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        escape(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    piece = F.floor(F.col("turn") / stretch)
    pieces = turns.groupBy("conv_id", piece.alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "role", "text"))).alias("turns")
    )
    return pieces.groupBy("conv_id").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("piece").isNotNull().alias("given"), "piece", "turns"))),
                lambda p: p["turns"],
            )
        ).alias("turns")
    )


def format_conversations(conversations: DataFrame, stretch: int = 512) -> DataFrame:
    """conv_id, formatted string, loss array<struct<start bigint, length bigint>>."""
    ordered = _ordered_turns(conversations, stretch)
    # Merge neighbours of one role: a turn starts a block unless the one before has its role.
    marked = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            t["text"].alias("text"),
            ((i == 0) | (F.element_at("turns", F.greatest(i, F.lit(1)).cast("int"))["role"] != t["role"])).alias("first"),
        ),
    )
    heads = F.transform(
        "marked",
        lambda t, i: F.struct(
            F.when(
                t["first"],
                F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN), t["role"], F.lit(ROLE_END)),
            )
            .otherwise(F.lit(TURN))
            .alias("head"),
            t["text"].alias("text"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    return (
        ordered.withColumn("marked", marked)
        .withColumn("heads", heads)
        .withColumn("chunks", F.transform(_chunks(F.col("heads")), _spans))
        .select(
            "conv_id",
            F.concat(
                F.array_join(F.transform("heads", lambda h: F.concat(h["head"], h["text"])), ""), F.lit(CLOSE)
            ).alias("formatted"),
            _moved(F.col("chunks")).alias("loss"),
        )
    )


#: Turns whose spans are gathered at once: appending to a growing array copies it, so arrays grow by chunks.
_CHUNK = 256


def _chunks(items: Column) -> Column:
    """The array as an array of arrays of up to _CHUNK items; one empty one for an empty array."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / _CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * _CHUNK + 1, F.lit(_CHUNK)))


def _spans(chunk: Column) -> Column:
    """Length of the chunk's string, and its loss spans from the chunk's start."""

    def span(at: Column, h: Column) -> Column:
        return F.array(F.struct((at + F.length(h["head"])).cast("bigint").alias("start"), F.length(h["text"]).cast("bigint").alias("length")))

    return F.aggregate(
        chunk,
        F.expr("cast(named_struct('at', 0L, 'loss', array()) as struct<at:bigint,loss:array<struct<start:bigint,length:bigint>>>)"),
        lambda acc, h: F.struct(
            (acc["at"] + F.length(h["head"]) + F.length(h["text"])).cast("bigint").alias("at"),
            F.when(h["loss"], F.concat(acc["loss"], span(acc["at"], h))).otherwise(acc["loss"]).alias("loss"),
        ),
    )


def _moved(chunks: Column) -> Column:
    """All chunks' spans, moved by the lengths before them."""
    starts = F.aggregate(chunks, F.array(F.lit(0).cast("bigint")), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
    at = F.slice(starts, 1, F.size(chunks))
    moved = F.zip_with(chunks, at, lambda c, a: F.transform(c["loss"], lambda s: F.struct((s["start"] + a).alias("start"), s["length"].alias("length"))))
    return F.flatten(moved)


def read_turns(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, read back from a formatted string."""
    blocks = F.filter(F.split(formatted, r"\Q" + CLOSE + r"\E"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(  # the role is read once for all of its turns
                F.array(unescape(_role(b))),
                lambda role: F.transform(
                    F.split(_body(b), r"\Q" + TURN + r"\E"), lambda part: F.struct(role.alias("role"), unescape(part).alias("text"))
                ),
            )[0],
        )
    )


def _role(block: Column) -> Column:
    return F.regexp_extract(block, r"(?s)^<s>\[INST ([^\]]*)\]", 1)


def _body(block: Column) -> Column:
    return F.regexp_replace(block, r"(?s)^<s>\[INST [^\]]*\]", "")


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, nothing between the spans.

    Finding a place in a string means walking to it, so a chunk of spans first
    takes its own stretch of the string.
    """

    def cut(text: Column, start: Column, length: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), length.cast("int"))

    def one(spans: Column) -> Column:
        first, last = F.element_at(spans, 1)["start"], F.element_at(spans, -1)
        stretch = F.array(F.struct(cut(formatted, first, last["start"] + last["length"] - first).alias("text"), first.alias("first")))
        parts = F.transform(stretch, lambda x: F.transform(spans, lambda s: unescape(cut(x["text"], s["start"] - x["first"], s["length"]))))
        return F.array_join(parts[0], "")

    return F.array_join(F.transform(F.filter(_chunks(loss), lambda c: F.size(c) > 0), one), "")
