"""Chat formatting: budgeted, turn-aligned windows over long conversations.

Only DataFrame functions. Prefix sums of turn tokens cut a conversation into spans:
with `room` tokens left beside the system turn and the history, a turn lying inside
one cell of `room` tokens joins the other turns of that cell, and a turn that crosses
a cell's end is a span of its own. A window is one span, before it the system turn
and as many whole earlier turns as `history` tokens hold. Only the assistant turns of
the span itself are targets; repeated ones are masked, so each is learnt once.

A window is over the budget only if the system turn and one single turn alone are
longer than it (`over_budget`); nothing is ever shortened.

Defined results: null text and role are empty; rows are ordered by turn, nulls first,
then by role and text, so ties and repeated rows have one order and all are kept; a
null conversation is a conversation; an empty table gives no window; other columns are
ignored. A conversation's turns meet in one task, as its text is one sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.common import word_count

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that the marks of a turn cost.
MARKS = 4


def escape(text: Column) -> Column:
    """No `<|` is left: each run `<\\...\\|` gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles are one line: percent signs and line feeds are written as %25 and %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window of `conversations` (conv_id, turn, role, text).

    Returns conv_id, window_no, formatted, mask (array of start, end in characters of
    `formatted`), n_fresh (the last turns of the window that belong to its span),
    n_tokens and over_budget.
    """
    if budget < 1 or history < 0:
        raise ValueError("budget must be positive and history not negative")
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("tokens", word_count(F.col("text")) + MARKS)
    by_conv = Window.partitionBy("conv_id")
    in_order = by_conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(in_order))
    turns = turns.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    counted = F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens"))
    turns = turns.withColumn("until", F.sum(counted).over(by_conv.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumn("since", F.col("until") - counted)
    turns = turns.withColumn("fixed", F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(by_conv))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.col("fixed"))
    cell = F.floor(F.col("since") / room)
    crossing = F.floor((F.col("until") - 1) / room) != cell
    turns = turns.withColumn("label", F.struct(cell.alias("cell"), F.when(crossing & ~F.col("system"), F.col("pos")).otherwise(0).alias("own")))
    before = F.lag("label").over(by_conv.orderBy("pos"))
    follows = F.coalesce(F.lag("system").over(by_conv.orderBy("pos")), F.lit(True))  # the first turn, or the one after the system turn
    turns = turns.withColumn("opens", ~follows & (F.col("label") != before))
    turns = turns.withColumn("span", F.sum(F.col("opens").cast("long")).over(by_conv.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    reach = F.max(F.when(F.col("opens"), F.col("span"))).over(by_conv.orderBy("since").rangeBetween(0, history))
    turns = turns.withColumn("last", F.when(F.col("system"), F.max("span").over(by_conv)).otherwise(F.greatest("span", F.coalesce(reach, F.col("span")))))
    turns = turns.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    turns = turns.withColumn("body", escape(F.col("text")))
    copies = turns.select("conv_id", "pos", "role", "tokens", "span", "head", "body", F.explode(F.sequence("span", "last")).alias("window_no"))
    copies = copies.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    so_far = Window.partitionBy("conv_id", "window_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.withColumn("start", F.sum(F.length("piece")).over(so_far) - F.length("piece") + F.length("head"))
    fresh = F.col("span") == F.col("window_no")
    span = F.when(fresh & (F.col("role") == "assistant"), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.length("body")).cast("long").alias("end")))
    windows = copies.groupBy("conv_id", "window_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("mask"),
        F.sum(fresh.cast("long")).alias("n_fresh"),
        F.sum("tokens").alias("n_tokens"),
    )
    return windows.select(
        "conv_id", "window_no", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        "mask", "n_fresh", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read each window back: fresh (array of role, text of its span) and targets (texts under the mask)."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)  # after the last mark nothing follows
    kept = F.slice(whole, F.size(whole) - F.col("n_fresh").cast("int") + 1, F.col("n_fresh").cast("int"))

    def turn(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescape_role(F.substr(line, F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(line) + 2)).alias("text"),
        )

    under = lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    return windows.select("conv_id", "window_no", F.transform(kept, turn).alias("fresh"), F.transform("mask", under).alias("targets"), F.length("formatted").cast("long").alias("n_chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Digests of what the windows give back, per conversation."""
    read = read_windows(windows).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window_no", "fresh", "targets"))).alias("all"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    turns = F.flatten(F.transform("all", lambda w: w["fresh"]))
    learnt = F.array_join(F.flatten(F.transform("all", lambda w: w["targets"])), "")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
