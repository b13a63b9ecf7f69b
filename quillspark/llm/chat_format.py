"""Chat formatting with Spark expressions only.

A conversation becomes one string::

    <|start|>ROLE<|sep|>TEXT<|join|>TEXT<|end|><|start|>ROLE<|sep|>...

Adjacent turns of one role share a block and are parted by ``<|join|>``, so the merge can be undone.
Inside roles and texts a backslash becomes two and the bar of ``<|`` gets a backslash before it; no
control string can then occur in a text, and undoing the escapes restores it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import columns_of, let

START, SEP, JOIN, END = "<|start|>", "<|sep|>", "<|join|>", "<|end|>"
CHUNK = 4096


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _cut(c: Column, mark: str) -> Column:
    return F.split(c, mark.replace("|", "\\|"))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted string, loss_spans (start and length in code points of every assistant text, escaped).

    Turns are sorted by (turn, role, text), nulls first, so ties have one order and repeated rows all
    stay. A null text or role is empty; a null conversation id is a conversation of its own. An empty
    table gives an empty table; other columns are ignored.
    """
    columns_of(turns, [conv_col, turn_col, role_col, text_col])
    blank = F.lit("")
    rows = turns.select(
        turns[conv_col].alias("conv_id"),
        F.struct(
            turns[turn_col].alias("turn"),
            F.coalesce(turns[role_col], blank).alias("role"),
            F.coalesce(turns[text_col], blank).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def piece(ts: Column, x: Column, i: Column) -> Column:
        before = F.get(ts, i - 1)["role"]
        head = F.concat(F.lit(START), escape(x["role"]), F.lit(SEP))
        opening = F.when(before.isNull(), head).when(before == x["role"], F.lit(JOIN)).otherwise(F.concat(F.lit(END), head))
        return F.struct(opening.alias("opening"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss"))

    def lay_out(pieces: Column) -> Column:
        start = F.struct(
            F.lit(0).cast("long").alias("at"),
            F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
        )

        def step(a: Column, p: Column) -> Column:
            begin, n = a["at"] + F.length(p["opening"]), F.length(p["body"])
            span = F.array(F.struct(begin.alias("start"), n.cast("long").alias("length")))
            return F.struct((begin + n).alias("at"), F.when(p["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        text = F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(p["opening"], p["body"])), ""), F.lit(END))
        return F.struct(text.alias("formatted"), F.aggregate(pieces, start, step, lambda a: a["spans"]).alias("loss_spans"))

    made = let(F.col("ts"), lambda ts: let(F.transform(ts, lambda x, i: piece(ts, x, i)), lay_out))
    return sorted_turns.select("conv_id", made.alias("m")).select("conv_id", "m.formatted", "m.loss_spans")


def read_chats(formatted: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """conv_id, formatted, the columns in ``keep``, and turns (role, text) read back from the column ``formatted``."""

    def block(b: Column) -> Column:
        return let(_cut(b, SEP), lambda two: F.transform(
            _cut(F.element_at(two, 2), JOIN),
            lambda x: F.struct(unescape(F.substr(F.element_at(two, 1), F.lit(len(START) + 1))).alias("role"), unescape(x).alias("text")),
        ))

    blocks = F.filter(_cut(F.col("formatted"), END), lambda b: b != "")
    return formatted.select("conv_id", "formatted", *(keep or []), F.flatten(F.transform(blocks, block)).alias("turns"))


def loss_texts(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``loss``: what lies under the loss mask, unescaped, a string per span.

    A formatted string is cut into stretches of ``CHUNK`` code points first, so that a span costs its own length
    and not a walk from the beginning.
    """
    stretches = F.regexp_extract_all("formatted", F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))

    def under(pieces: Column, span: Column) -> Column:
        first = F.floor(span["start"] / CHUNK).cast("int")
        last = F.floor((span["start"] + span["length"]) / CHUNK).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescape(F.substr(near, (span["start"] % CHUNK + 1).cast("int"), span["length"].cast("int")))

    return formatted.select("*", let(stretches, lambda pieces: F.transform("loss_spans", lambda span: under(pieces, span))).alias("loss"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for: turns from the formatted strings alone, loss columns from what the loss mask covers."""
    back = read_chats(loss_texts(formatted), keep=["loss"])
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("loss", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
