"""Chat formatting with Spark expressions only.

A conversation's turns are collected, sorted and merged into blocks of one role;
each block is marked, and control strings inside texts are escaped by a backslash
that can be taken away again. parse_chats() reads a formatted string back.

A block is ``[INST]`` texts ``[/INST]`` for the user, ``[OUT]`` texts ``</s>`` for the
assistant, and ``[AS]`` role ``[:]`` texts ``</s>`` for any other role. Texts of merged
turns are parted by ``[NEXT]``. The whole begins with ``<s>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"([\[<]\\*)((?:/?INST|OUT|AS|:|NEXT)\]|/?s>)"
_ESCAPED = r"([\[<]\\*)\\((?:/?INST|OUT|AS|:|NEXT)\]|/?s>)"


def escape(text: Column) -> Column:
    """A backslash more inside each control string, escaped ones included."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _block(role: Column, texts: Column) -> Column:
    body = F.array_join(F.transform(texts, escape), "[NEXT]")
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("[OUT]"), body, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[AS]"), escape(role), F.lit("[:]"), body, F.lit("</s>")))
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One formatted string per conversation, from conv_id, turn, role and text.

    Returns conv_id, formatted. Rows are ordered by turn, then role, then text; each
    row counts, repeated ones too. A null text or role is empty, a null turn comes
    first, a null conv_id is a conversation of its own. Other columns are not looked
    at; an empty table gives an empty result.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    kept = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("one"))
    sorted_turns = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    blocks = F.transform(
        F.col("starts"),
        lambda at, k: F.slice(
            F.col("turns"), at, F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns") + 1) - at
        ),
    )
    text = F.transform(F.col("blocks"), lambda b: _block(b[0]["role"], F.transform(b, lambda t: t["text"])))
    return (
        sorted_turns.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .select("conv_id", F.concat(F.lit("<s>"), F.array_join(text, "")).alias("formatted"))
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The turns, read back from the formatted string alone: an array of role and text."""
    body = F.substring(F.col("formatted"), 4, 2_147_483_647)
    pieces = F.filter(F.split(body, r"\[/INST\]|</s>"), lambda x: x != "")

    def block(piece: Column) -> Column:
        role = (
            F.when(piece.startswith("[INST]"), F.lit("user"))
            .when(piece.startswith("[OUT]"), F.lit("assistant"))
            .otherwise(unescape(F.regexp_extract(piece, r"(?s)^\[AS\](.*?)\[:\]", 1)))
        )
        texts = F.split(F.regexp_replace(piece, r"(?s)^(?:\[INST\]|\[OUT\]|\[AS\].*?\[:\])", ""), r"\[NEXT\]", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(pieces, block)).alias("turns"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read back from them."""
    parsed = parse_chats(format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
