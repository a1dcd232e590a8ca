"""Chat formatting as relational expressions.

Rows of a conversation are collected as structs, sorted by turn, merged where
the role repeats, and joined to one string. A loss mask marks assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrays import cut, running_sum

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    """No ``<|`` is left, so no control string; :func:`unescape` undoes it."""
    return _swap(c, ("&", "&amp;"), ("<|", "&lt;|"))


def unescape(c: Column) -> Column:
    return _swap(c, ("&lt;", "<"), ("&amp;", "&"))


def _escape_role(c: Column) -> Column:
    return _swap(escape(c), ("\n", "&#10;"))


def _unescape_role(c: Column) -> Column:
    return unescape(_swap(c, ("&#10;", "\n")))


def format_chats(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``key``, ``formatted`` and ``loss_spans`` (code points of ``formatted``, end exclusive).

    A run of rows with the same role becomes one block ``START role \\n text SEP text END``. Rows are sorted by
    (turn, role, text), so ties have one result; null turns come first, null roles and texts count as empty, repeated
    rows stay. A null key is a conversation of its own. No rows give no conversations. Other columns are ignored. A conversation is one
    row here and in the result: its text has to fit in one string (2 GB) and a task's memory.
    """
    turns = rows.select(
        F.col(key).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        again = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        lead = F.when(again, F.lit(SEP)).otherwise(F.concat(F.when(i > 0, END).otherwise(""), F.lit(START), _escape_role(t["role"]), F.lit("\n")))
        return F.struct(lead.alias("lead"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss"))

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    placed = pieces.withColumn("ends", running_sum(F.transform("pieces", lambda p: F.length(p["lead"]) + F.length(p["body"]))))
    all_spans = F.zip_with("pieces", "ends", lambda p, e: F.struct((e - F.length(p["body"])).alias("start"), e.alias("end"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(all_spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return placed.select(
        F.col("conv_id").alias(key),
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END)).alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, "\\Q" + END + "\\E"), lambda b: b != "")

    def block(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = _unescape_role(F.substr(head, F.lit(len(START) + 1)))
        body = F.substr(b, F.length(head) + 2)
        return F.transform(F.split(body, "\\Q" + SEP + "\\E"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    pieces = cut(formatted, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))
    return F.array_join(F.transform(pieces, unescape), "")


def chat_digest(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Figures read back from the formatted strings."""
    back = chats.select(key, "formatted", read_chats(F.col("formatted")).alias("back"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        key,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
