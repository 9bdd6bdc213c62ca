"""Chat formatting with Spark expressions only: collected turn structs are sorted, adjacent turns of one role merge, and
the blocks are concatenated into one marked-up string with a loss mask of run lengths.

A control string inside a text or role gets a backslash after its first character (one more if it has some already), so
that none occurs outside the template and the escape can be undone exactly. Other text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings by role. Any other role is named between [ROLE] and [/ROLE].
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
NEXT_TURN = "[TURN]"
_REST = "(/?s>|/?INST\\]|/?SYS\\]|/?ROLE\\]|END\\]|TURN\\])"
ESCAPE = ("([<\\[])(\\\\*)" + _REST, "$1\\\\$2$3")
UNESCAPE = ("([<\\[])\\\\(\\\\*)" + _REST, "$1$2$3")
_CLOSE = "(?<=\\[/INST\\]|</s>|\\[/SYS\\]|\\[END\\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    for name, (opening, _) in MARKS.items():
        out = F.when(role == name, F.lit(opening)).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, closing) in MARKS.items():
        out = F.when(role == name, F.lit(closing)).otherwise(out)
    return out


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, formatted, mask array<struct<length, loss>>.

    Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows come out alike each time and
    each row counts as a turn. A null text or role is empty; the rows without a conv_id form one conversation; other
    columns are ignored; an empty table gives no rows. The mask's lengths are code points of ``formatted`` and cover it;
    they are under loss where an assistant's own text stands. A conversation is one row, so its turns must fit in a task;
    conversations are spread by their id.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("said"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    firsts = sorted_turns.withColumn(
        "first",
        F.filter(
            F.sequence(F.lit(1), F.size("said")),
            lambda i: (i == 1) | (F.element_at("said", i)["role"] != F.element_at("said", F.greatest(i - 1, F.lit(1)))["role"]),
        ),
    )
    blocks = firsts.select(
        "conv_id",
        F.transform(
            "first",
            lambda at, k: F.slice("said", at, F.coalesce(F.get("first", k + 1), F.size("said") + 1) - at),
        ).alias("blocks"),
    )

    def pieces(block: Column) -> Column:
        role = F.element_at(block, 1)["role"]
        loss = role == "assistant"
        inner = F.flatten(
            F.transform(
                block,
                lambda turn, k: F.array(
                    F.struct(F.when(k > 0, F.lit(NEXT_TURN)).otherwise(F.lit("")).alias("piece"), F.lit(False).alias("loss")),
                    F.struct(escaped(turn["text"]).alias("piece"), loss.alias("loss")),
                ),
            )
        )
        mark = lambda x: F.array(F.struct(x.alias("piece"), F.lit(False).alias("loss")))
        return F.concat(mark(_opening(role)), inner, mark(_closing(role)))

    cut = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("pieces", lambda p: p["piece"] != ""),
            lambda p: F.struct(F.length(p["piece"]).cast("long").alias("length"), p["loss"].alias("loss")),
        ).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns array<struct<role, text>> that a formatted string holds."""

    def block_turns(block: Column) -> Column:
        role, start = F.lit(None).cast("string"), F.lit(1)
        for name, (opening, _) in MARKS.items():
            hit = F.startswith(block, F.lit(opening))
            role, start = F.when(hit, F.lit(name)).otherwise(role), F.when(hit, F.lit(len(opening) + 1)).otherwise(start)
        other = F.startswith(block, F.lit(OTHER[0]))
        named_end = F.locate(OTHER[1], block)
        role = F.when(other, unescaped(F.substring(block, F.lit(len(OTHER[0]) + 1), named_end - len(OTHER[0]) - 1))).otherwise(role)
        start = F.when(other, named_end + len(OTHER[1])).otherwise(start)
        tail = F.lit(len(OTHER[2]))
        for name, (_, closing) in MARKS.items():
            tail = F.when(role == name, F.lit(len(closing))).otherwise(tail)
        body = F.substring(block, start, F.length(block) - start + 1 - tail)
        return F.transform(
            F.split(body, "\\[TURN\\]", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    blocks = F.filter(F.split(formatted, _CLOSE, -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, block_turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("texts"))

    def step(acc: Column, run: Column) -> Column:
        text = unescaped(F.substring(formatted, acc["at"].cast("int"), run["length"].cast("int")))
        return F.struct(
            (acc["at"] + run["length"]).alias("at"),
            F.when(run["loss"], F.concat(acc["texts"], F.array(text))).otherwise(acc["texts"]).alias("texts"),
        )

    return F.array_join(F.aggregate(mask, start, step)["texts"], "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests per conversation, all read back from ``format_chat``'s output."""
    read = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("mask")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
