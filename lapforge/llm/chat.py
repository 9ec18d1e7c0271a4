r"""Chat formatting with budgeted windows.

A conversation becomes training windows of whole turns. Spans are chosen greedily from the prefix
sums of turn tokens: a window takes turns as long as the prefix sum after a turn, less the
prefix sum where the window began, fits what the budget leaves after the window's context. The
context is the system turn (if the conversation begins with one) and up to HISTORY_TURNS turns
before the window, of at most HISTORY_TOKENS tokens. A turn that doesn't fit beside its window's
context even alone still has a window, which over_budget marks: nothing is cut. Every SEGMENT
tokens the choice starts anew, so that no fold runs over a whole long conversation (one window
in 32 may be short for it). Loss falls on assistant texts, and only where they are not repeated:
each assistant text is a target once.

Template: `### role:\ntext</turn>\n` for each turn. Inside texts and roles `\`, `<` and `#`
(in roles `:` too) are written `\b`, `\l`, `\h` and `\c`, so a marker can't occur in them, and
a reader gets the exact text back. Tokens are estimated: 4 for the markers and one for every
4 characters begun.

Defined results: turns go by turn, role, text (nulls first); a null text or role is empty;
repeated rows are turns of their own; null conv_id is a conversation. An empty table gives no
window. Columns other than conv_id, turn, role and text are ignored.

Plan: one shuffle, by conversation; all windows and groupings reuse it. DataFrame functions only. A
fold holds the token counts of one segment (at most SEGMENT / 4 turns); texts stay in rows, which
Spark's windows spill. All rows of one conversation meet in one task, as their order asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
#: Budgets in a segment.
SEGMENT = 32
END = "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))
SYSTEM, HISTORY, OWN = 0, 1, 2


def escape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _spans(turns: Column) -> Column:
    """Positions of the turns of a segment that open a window, in one pass over an array of (pos,
    tok, room: what a window that it opens may hold, glued: whether it mustn't open one)."""
    start = F.struct(F.array().cast("array<int>").alias("opens"), F.lit(-1).cast("long").alias("left"))

    def step(state: Column, turn: Column) -> Column:
        opens = (F.size(state["opens"]) == 0) | ((turn["tok"] > state["left"]) & ~turn["glued"])
        return F.struct(
            F.when(opens, F.concat(state["opens"], F.array(turn["pos"]))).otherwise(state["opens"]).alias("opens"),
            (F.when(opens, turn["room"]).otherwise(state["left"]) - turn["tok"]).alias("left"),
        )

    return F.aggregate(turns, start, step, lambda state: state["opens"])


def chat_windows(
    turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS
) -> DataFrame:
    """(conv_id, window, text, n_turns, n_context, n_tokens, over_budget, loss): loss is an array
    of (start, length) in characters of text, start from 1; the first n_context turns repeat."""
    w = W.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tok", F.floor((F.length("text") + 3) / 4) + 4)
    placed = rows.select(
        "*",
        F.row_number().over(w).alias("pos"),
        (F.sum("tok").over(upto) - F.col("tok")).alias("before"),
        F.first(F.when(F.col("role") == "system", F.col("tok")).otherwise(0)).over(whole).alias("system_tok"),
    )
    retained = (F.col("pos") == 1) & (F.col("role") == "system")
    # what a window that opens here repeats: the system turn, and the history that ahead (below) gives it
    gaps = [F.when(~F.lag(retained, k).over(w), F.col("before") - F.lag("before", k).over(w)) for k in range(1, history_turns + 1)]
    context = F.col("system_tok") + F.greatest(F.lit(0), F.lit(0), *[F.when(g <= history_tokens, g) for g in gaps])
    room = F.lit(budget).cast("long") - F.when(F.col("pos") == 1, 0).otherwise(context)
    glued = F.coalesce(F.lag(retained).over(w), F.lit(False))
    placed = placed.select("*", room.alias("room"), glued.alias("glued"), F.floor(F.col("before") / (SEGMENT * budget)).alias("segment"))
    segment = W.partitionBy("conv_id", "segment").orderBy("pos")
    inside = segment.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    listed = F.collect_list(F.struct("pos", "tok", "room", "glued")).over(inside)
    placed = placed.withColumn("listed", F.when(F.row_number().over(segment) == 1, listed))
    starts = F.first(F.when(F.col("listed").isNotNull(), _spans(F.col("listed")))).over(inside)
    placed = placed.withColumn("opens", F.array_contains(starts, F.col("pos"))).drop("listed", "room", "glued", "segment")
    placed = placed.withColumn("window", F.sum(F.col("opens").cast("int")).over(upto) - 1)
    at = lambda window, kind: F.struct(window.cast("long").alias("window"), F.lit(kind).alias("kind"))
    ahead = [
        F.when(
            F.lead("opens", k).over(w) & (F.lead("before", k).over(w) - F.col("before") <= history_tokens) & ~retained,
            at(F.lead("window", k).over(w), HISTORY),
        )
        for k in range(1, history_turns + 1)
    ]
    placed = placed.select("*", F.array_compact(F.array(*ahead)).alias("ahead"), F.max("window").over(whole).alias("last"))
    later = F.when(
        retained & (F.col("last") > 0),
        F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("last"), F.lit(1))), lambda x: at(x, SYSTEM)),
    ).otherwise(F.array().cast("array<struct<window:bigint,kind:int>>"))
    copies = placed.select(
        "conv_id", "role", "text", "tok", "pos", F.explode(F.concat(F.array(at(F.col("window"), OWN)), "ahead", later)).alias("c")
    ).select(
        "conv_id", "c.*", "pos", "role", "tok",
        F.concat(F.lit("### "), escape(F.col("role"), _ROLE_ESCAPES), F.lit(":\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    inside = W.partitionBy("conv_id", "window").orderBy("kind", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.length("head") + F.length("body") + len(END)
    copies = copies.withColumn("start", F.sum(size).over(inside) - size + F.length("head") + 1)
    target = (F.col("kind") == OWN) & (F.col("role") == "assistant")
    span = F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length"))
    return (
        copies.groupBy("conv_id", "window")
        .agg(
            F.sort_array(F.collect_list(F.struct("kind", "pos", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("t"),
            F.count("*").alias("n_turns"),
            F.count_if(F.col("kind") < OWN).alias("n_context"),
            F.sum("tok").alias("n_tokens"),
            (F.sum("tok") > budget).alias("over_budget"),
            F.sort_array(F.collect_list(F.when(target, span))).alias("loss"),
        )
        .select("conv_id", "window", F.array_join("t.turn", "").alias("text"), "n_turns", "n_context", "n_tokens", "over_budget", "loss")
    )


def read_turns(text: Column, n_context: Column) -> Column:
    """The turns of a window that don't repeat, as an array of (role, text), unescaped."""
    parts = F.split(text, END)
    own = F.slice(parts, n_context.cast("int") + 1, F.size(parts) - n_context.cast("int") - 1)
    head = lambda x: F.substring_index(x, ":\n", 1)
    return F.transform(
        own,
        lambda x: F.struct(
            unescape(F.substr(head(x), F.lit(5)), _ROLE_ESCAPES).alias("role"),
            unescape(F.substr(x, F.length(head(x)) + 3)).alias("text"),
        ),
    )


def loss_texts(text: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped, as an array."""
    return F.transform(loss, lambda s: unescape(F.substr(text, s["start"], s["length"])))
