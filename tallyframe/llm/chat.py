"""Chat formatting into budgeted windows, with DataFrame functions only.

A window holds whole turns. Prefix sums of turn costs give each turn its
window; the system turn opens every window, up to `history` turns of the
window before are repeated, and only assistant turns that are new in a window
are under its loss mask, so every assistant text is a target exactly once.

The budget is dealt out per conversation: first to its system turn, then up to
`history_budget` units, but at most a quarter of what is left, to repeated
turns; the rest is the room for new turns. New turns are put together by cells
of half the room, which keeps their sum within it.

Template: <|im_start|>role LF text <|im_end|> LF for every turn. In texts and
roles a "<", any number of backslashes and "|" gain one backslash, which no
marker has and which is taken off again on reading. Roles also escape
backslashes, as backslash and b, and line feeds, as backslash and n.

A turn costs one unit per `chars_per_token` code points, plus `turn_cost`.
Every window stays within the budget, or holds one new turn that is larger
than the room, after the system turn and without history. No turn is cut or
dropped; a system turn that takes the whole budget leaves one new turn to each
window.

Defined results: null text or role counts as empty; turns that tie are
ordered by role, then text; repeated rows are turns of their own; null
conversation ids are one conversation; an empty table gives no windows. A
conversation's turns are put in order, and its digest is taken, by one task:
windows repeat turns of the window before, and the digest is one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class ChatRules:
    """budget: units per window; history: turns repeated at most, within history_budget units."""

    budget: int = 2048
    history: int = 2
    history_budget: int = 512
    chars_per_token: int = 4
    turn_cost: int = 4


def escape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: F.Column) -> F.Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: F.Column) -> F.Column:
    plain = F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))
    return F.when(F.instr(role, "\\") > 0, plain).otherwise(role)


def plan_turns(turns: DataFrame, rules: ChatRules, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per (turn, window it appears in): conv, window, pos, context, role, text."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("cost", F.ceil(F.length("text") / rules.chars_per_token) + rules.turn_cost)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv")
    opening = (F.col("pos") == 1) & (F.col("role") == "system")
    placed = (
        rows.withColumn("pos", F.row_number().over(order))
        .withColumn("opening", opening)
        .withColumn("left", F.greatest(F.lit(rules.budget) - F.sum(F.when(F.col("opening"), F.col("cost")).otherwise(0)).over(whole), F.lit(0)))
        .withColumn("for_history", F.least(F.lit(rules.history_budget), F.floor(F.col("left") / 4)))
        .withColumn("room", F.col("left") - F.col("for_history"))
        .withColumn("half", F.greatest(F.floor(F.col("room") / 2), F.lit(1)))
        # the system turn has its own share of the budget
        .withColumn("paid", F.when(F.col("opening"), 0).otherwise(F.col("cost")))
        .withColumn("cell", F.floor((F.sum("paid").over(upto) - 1) / F.col("half")))
        .withColumn("large", F.col("paid") > F.col("half"))
        .withColumn("opens", F.coalesce(~F.lag("opening").over(order) & ((F.col("cell") != F.lag("cell").over(order)) | F.col("large") | F.lag("large").over(order)), F.lit(False)))
        .withColumn("window", F.sum(F.col("opens").cast("long")).over(upto))
        .withColumn("next_over", F.lead(F.col("paid") > F.col("room")).over(order))
    )
    from_end = Window.partitionBy("conv", "window").orderBy(F.col("pos").desc())
    so_far = from_end.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        placed.withColumn("from_end", F.row_number().over(from_end))
        .withColumn("tail", F.sum("paid").over(so_far))
        .withColumn("last", F.max("window").over(whole))
        # what follows the last turn of the window opens the next one
        .withColumn("next_over", F.first("next_over").over(so_far))
    )
    later = F.when(F.col("window") < F.col("last"), F.sequence(F.col("window") + 1, F.col("last"))).otherwise(F.array().cast("array<bigint>"))
    repeats = (F.col("window") < F.col("last")) & (F.col("from_end") <= rules.history) & (F.col("tail") <= F.col("for_history")) & ~F.col("next_over")
    into = F.when(F.col("opening"), later).when(repeats, F.array(F.col("window") + 1)).otherwise(F.array().cast("array<bigint>"))
    return placed.select("conv", "pos", "role", "text", "cost", F.col("window").alias("own"), F.explode(F.concat(F.array("window"), into)).alias("window")).withColumn("context", F.col("window") != F.col("own"))


def format_windows(turns: DataFrame, rules: ChatRules | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conv, window, formatted, n_context (turns repeated at its start), cost (units of all
    its turns), loss array<struct<start,length>> (code points under the loss mask, from 0)."""
    rules = rules or ChatRules()
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    shown = plan_turns(turns, rules, conv, turn, role, text).withColumn("piece", piece)
    inside = Window.partitionBy("conv", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length(escape(F.col("text")))
    start = F.sum(F.length("piece")).over(inside) - F.lit(len(END)) - length
    shown = shown.withColumn("span", F.when((F.col("role") == "assistant") & ~F.col("context"), F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))))
    pieces = F.sort_array(F.collect_list(F.struct("pos", "piece", "span")))
    return (
        shown.groupBy("conv", "window")
        .agg(pieces.alias("p"), F.count_if("context").alias("n_context"), F.sum("cost").alias("cost"))
        .select("conv", "window", F.array_join(F.col("p.piece"), "").alias("formatted"), "n_context", "cost", F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss"))
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back: conv, window, turns array<struct<role,text>> (new turns only), targets array<string>."""
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.greatest(F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1, F.lit(0)))
    new = F.slice("parts", F.col("n_context").cast("int") + 1, F.greatest(F.size("parts") - F.col("n_context").cast("int"), F.lit(0)))

    def turn(part):
        head = F.substring_index(part, "\n", 1)
        return F.struct(unescape_role(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(part, F.length(head) + 2)).alias("text"))

    return windows.withColumn("parts", parts).select(
        "conv",
        "window",
        F.transform(new, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))).alias("targets"),
        F.length("formatted").alias("chars"),
    )


def chat_digest(turns: DataFrame, rules: ChatRules | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation, from what format_windows gives: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    read = read_windows(format_windows(turns, rules, conv, turn, role, text))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    row = F.struct("window", said.alias("said"), F.array_join("targets", "").alias("target"))
    return (
        read.groupBy("conv")
        .agg(F.sort_array(F.collect_list(row)).alias("w"), F.sum(F.size("turns")).alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
        .withColumn("target", F.array_join("w.target", ""))
        .select(
            F.col("conv").alias(conv),
            "n_turns",
            F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
            F.length("target").cast("long").alias("loss_chars"),
            F.sha2("target", 256).alias("loss_sha256"),
            "formatted_chars",
            "n_windows",
        )
    )
