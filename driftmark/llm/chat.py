"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written as ``<s>[role]text</s>``. Inside roles and texts ``\\``, ``<``, ``[`` and ``]`` are
written as ``\\s``, ``\\l``, ``\\b`` and ``\\e``, so nothing a text says can pass for a mark, and every
text can be read back.

Prefix sums of turn tokens lay each conversation on a line that is cut into cells of what the budget
leaves beside history and system turn. Turns inside one cell form a span; a turn that crosses a border
is a span of its own. So every span is turn-aligned and within its cell, unless a single turn is longer.
Turns are never cut: a window of such a turn, or one whose system turn leaves less than a quarter of
the budget, says ``over_budget``. Each span becomes a window: the system turn, as much
history as its budget allows, then the span. Only assistant texts of the span itself are under the
loss mask, so every target counts once.

Prefix sums are taken per block of turns and then over the blocks' totals, history is found by an
equality join on cells: no task needs a whole conversation until its text is read back.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
BLOCK = 1024
_CODES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))


def escaped(text: Column) -> Column:
    for plain, code in _CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in _CODES[::-1]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """Words and single marks of a text; the cost of a turn is one more."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def _laid_out(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, role, text, start, end): turns in order on the token line of their conversation."""
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("cost", tokens("text").cast("bigint") + 1).withColumn(
        "block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("bigint"))
    totals = rows.groupBy("conv", "block").agg(F.sum("cost").alias("total"))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("conv").alias("t_conv"), F.col("block").alias("t_block"),
                           F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("cost").over(inside)).join(
        totals, F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("block") == F.col("t_block")))
    return rows.select("conv", "role", "text", (F.col("offset") + F.col("end") - F.col("cost")).alias("start"),
                       (F.col("offset") + F.col("end")).alias("end"))


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id",
              turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv, window, n_turns, n_repeated, n_tokens, over_budget, text, loss.

    ``window`` is the place of the window's own first token in the conversation and orders windows;
    ``n_repeated`` turns in front are repeated ones; ``loss`` lists (start, end) of the texts under the
    loss mask in code points of ``text``, end exclusive. Turns are ordered by (turn, role, text), null
    turns first; null roles and texts are empty; repeated rows are turns of their own; rows without a
    conversation id form one conversation. The system turn is the first of role ``system``. Other columns are not read, an empty
    table gives no rows.
    """
    turns = _laid_out(conversations, conv_col, turn_col, role_col, text_col)
    system = (turns.filter("role = 'system'").groupBy("conv")
              .agg(F.min_by(F.struct("start", "end", "role", "text"), "start").alias("system"))
              .withColumnRenamed("conv", "s_conv"))
    cell = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.end") - F.col("system.start"), F.lit(0)), F.lit(max(budget // 4, 1)))
    turns = turns.join(system, F.col("conv").eqNullSafe(F.col("s_conv")), "left").select(
        "conv", "role", "text", "start", "end", cell.alias("cell"), F.col("system.start").alias("s_start"))
    turns = turns.withColumn("low", F.floor(F.col("start") / F.col("cell"))).withColumn("high", F.floor((F.col("end") - 1) / F.col("cell")))
    own = turns.withColumn("window", F.min("start").over(W.partitionBy("conv", "low", "high")))
    spans = own.filter("start = window").select("conv", "window", "cell")
    # history: the cells before the window that its budget reaches
    reach = F.sequence(F.floor(F.greatest(F.col("window") - history, F.lit(0)) / F.col("cell")), F.floor((F.col("window") - 1) / F.col("cell")))
    asked = spans.filter("window > 0").select(F.col("conv").alias("a_conv"), F.col("window").alias("a_window"), F.explode(reach).alias("a_low"))
    past = (turns.join(asked, F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("low") == F.col("a_low")))
            .filter((F.col("start") >= F.col("a_window") - history) & (F.col("end") <= F.col("a_window"))
                    & ~F.col("start").eqNullSafe(F.col("s_start"))))
    always = spans.join(system, F.col("conv").eqNullSafe(F.col("s_conv"))).filter("window > system.start")
    # the window that holds the system turn itself does not repeat it
    home = own.filter("start = s_start").select(F.col("conv").alias("h_conv"), F.col("window").alias("h_window"))
    always = always.join(home, F.col("conv").eqNullSafe(F.col("h_conv")) & (F.col("window") == F.col("h_window")), "left_anti")
    member = ["conv", "window", "kind", "start", "end", "role", "text"]
    members = (own.withColumn("kind", F.lit(2)).select(member)
               .unionByName(past.withColumn("kind", F.lit(1)).withColumn("window", F.col("a_window")).select(member))
               .unionByName(always.select("conv", "window", "system.*").withColumn("kind", F.lit(0)).select(member)))
    parts = members.select("conv", "window", F.struct(
        "kind", "start", "end", F.concat(F.lit("<s>["), escaped(F.col("role")), F.lit("]")).alias("head"), escaped(F.col("text")).alias("body"),
        ((F.col("kind") == 2) & (F.col("role") == "assistant")).alias("target")).alias("part"))
    gathered = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list("part")).alias("parts"),
                                                   F.sum(F.col("part.end") - F.col("part.start")).alias("n_tokens"))
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def placed(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["head"])
        end = start + F.length(part["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 4).alias("at"), F.when(part["target"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"))

    loss = F.aggregate("parts", F.struct(F.lit(0).alias("at"), nothing.alias("loss")), placed)["loss"]
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), "")
    return gathered.select(
        "conv", "window", F.size("parts").alias("n_turns"), F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_repeated"),
        "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"), text.alias("text"), loss.alias("loss"))


def turns_of(windows: DataFrame) -> DataFrame:
    """(conv, window, turns, targets): what each window's text says, repeated turns left out.

    A null conversation is one like any other, an empty text an empty turn; no windows give no rows.
    """
    def turn(block: Column) -> Column:
        head = F.substring_index(block, "]", 1)
        role = F.substr(head, F.lit(len("<s>[") + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(block, F.length(head) + 2)).alias("text"))

    blocks = F.slice(F.split("text", "</s>"), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv", "window", F.transform(blocks, turn).alias("turns"), targets.alias("targets"), F.length("text").alias("chars"))


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows' texts and masks alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests need a conversation whole: its texts meet in one row. A null conversation is one like any other; no
    windows give no rows.
    """
    said = turns_of(windows).select(
        "conv", "window", F.size("turns").alias("n"), "chars", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"))
    gathered = said.groupBy("conv").agg(F.sum("n").cast("bigint").alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"),
                                        F.array_sort(F.collect_list(F.struct("window", "said", "target"))).alias("all"))
    target = F.array_join("all.target", "")
    return gathered.select("conv", "n_turns", F.sha2(F.array_join("all.said", ""), 256).alias("turns_sha256"),
                           F.length(target).cast("bigint").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")
