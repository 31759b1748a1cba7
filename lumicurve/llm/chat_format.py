"""Chat formatting into budgeted windows, with built-in functions only.

Prefix sums of the turns' tokens cut a conversation into spans of whole turns.
Each span is a window: the conversation's system turn and a limited history of
the span before are repeated in front of its own turns, and only assistant
texts among the own turns are under the loss mask.

A conversation of usual length is one group of one hash partitioning, which all
window functions and both groupings reuse. Longer ones are dealt by blocks of
turn numbers instead, so that no task needs a whole one: sums of the blocks in
front are added to the running sums within a block, one row per span tells where
it ends, and windows are put together by conversation and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Turn numbers to a block, within which turns are put in order.
BLOCK_TURNS = 512

# The template's control strings; a turn is
# <s>role[INST]text[/INST]</s>.
OPEN, TEXT, END_TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """The text with control strings broken by a backslash, and backslashes doubled."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"<(/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(role: Column, text: Column) -> Column:
    """A bound on the tokens of a formatted turn: its bytes. A byte-level
    tokenizer gives no more ids than that, whatever the text."""
    return F.octet_length(escape(role)) + F.octet_length(escape(text)) + len(OPEN + TEXT + END_TEXT + CLOSE)


def spans_in_one(rows: DataFrame, stride: int) -> DataFrame:
    """Add each turn's number _n and running sum _to in its conversation, its
    _span, the span's last number and sum, and the number of the last span. A
    span are the turns that end in one stride."""
    in_order = Window.partitionBy("_id").orderBy("_turn", "_role", "_text")
    rows = rows.withColumn("_n", F.row_number().over(in_order)).withColumn("_to", F.sum("_tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_stride", F.floor((F.col("_to") - 1) / stride)).withColumn("_before", F.lag("_stride").over(in_order))
    starts = F.when(F.col("_before").isNotNull() & (F.col("_before") != F.col("_stride")), 1).otherwise(0)
    rows = rows.withColumn("_span", F.sum(starts).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy("_id", "_span")
    return rows.withColumn("_last_span", F.max("_span").over(Window.partitionBy("_id"))).withColumn("_span_n", F.max("_n").over(span)).withColumn("_span_to", F.max("_to").over(span))


def spans_by_blocks(rows: DataFrame, stride: int) -> DataFrame:
    """The same as ``spans_in_one``, without a group that grows with a conversation."""
    is_number = isinstance(rows.schema["_turn"].dataType, IntegralType)
    rows = rows.withColumn("_block", F.floor(F.col("_turn") / BLOCK_TURNS).cast("long") if is_number else F.lit(0).cast("long"))
    blocks = rows.groupBy("_id", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_tokens").alias("_sum"))
    ahead = Window.partitionBy("_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c, name: F.coalesce(F.sum(c).over(ahead), F.lit(0).cast("long")).alias(name)
    blocks = blocks.select(F.col("_id").alias("_id_b"), F.col("_block").alias("_block_b"), offset("_rows", "_rows_before"), offset("_sum", "_sum_before"))
    rows = rows.join(blocks, F.col("_id").eqNullSafe(F.col("_id_b")) & F.col("_block").eqNullSafe(F.col("_block_b"))).drop("_id_b", "_block_b")
    in_order = Window.partitionBy("_id", "_block").orderBy("_turn", "_role", "_text")
    running = F.sum("_tokens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", F.col("_rows_before") + F.row_number().over(in_order)).withColumn("_to", F.col("_sum_before") + running).withColumn("_stride", F.floor((F.col("_to") - 1) / stride))
    # One row of each span says where it ends, which it is, and how many there are.
    spans = rows.groupBy("_id", "_stride").agg(F.max("_n").alias("_span_n"), F.max("_to").alias("_span_to"))
    whole = Window.partitionBy("_id")
    spans = spans.select(F.col("_id").alias("_id_s"), F.col("_stride").alias("_stride_s"), "_span_n", "_span_to", (F.row_number().over(whole.orderBy("_stride")) - 1).alias("_span"), (F.count(F.lit(1)).over(whole) - 1).alias("_last_span"))
    return rows.join(spans, F.col("_id").eqNullSafe(F.col("_id_s")) & (F.col("_stride") == F.col("_stride_s"))).drop("_id_s", "_stride_s")


def _windows(turns: DataFrame, by_blocks: bool, stride: int, budget: int, history_turns: int, history_tokens: int, tokens: Column | None, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("_id"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), text.alias("_text"))
    rows = rows.withColumn("_tokens", (turn_tokens(F.col("_role"), F.col("_text")) if tokens is None else tokens).cast("long"))
    rows = spans_by_blocks(rows, stride) if by_blocks else spans_in_one(rows, stride)
    is_system = (F.col("_n") == 1) & (F.col("_role") == "system")
    is_history = ~is_system & (F.col("_span") < F.col("_last_span")) & (F.col("_span_n") - F.col("_n") < history_turns) & (F.col("_span_to") - F.col("_to") + F.col("_tokens") <= history_tokens)
    own = F.array(F.struct(F.col("_span").cast("long").alias("window"), F.lit(False).alias("again")))
    later = F.when(is_system & (F.col("_last_span") > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.col("_last_span").cast("long")), lambda w: F.struct(w.cast("long").alias("window"), F.lit(True).alias("again"))))
    later = later.when(is_history, F.array(F.struct((F.col("_span") + 1).cast("long").alias("window"), F.lit(True).alias("again"))))
    shown = rows.select("_id", "_n", "_role", "_text", "_tokens", F.explode(F.concat(own, F.coalesce(later, F.slice(own, 1, 0)))).alias("_at"))
    head = F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(TEXT))
    body = escape(F.col("_text"))
    piece = F.struct(
        F.col("_n").alias("n"),
        F.concat(head, body, F.lit(END_TEXT + CLOSE)).alias("text"),
        F.char_length(head).alias("head"),
        F.char_length(body).alias("body"),
        F.col("_at.again").alias("again"),
        ((F.col("_role") == "assistant") & ~F.col("_at.again")).alias("loss"),
        F.col("_tokens").alias("tokens"),
    )
    windows = shown.groupBy("_id", F.col("_at.window").alias("window")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    # Where each piece begins: the lengths of those in front of it.
    length = lambda x: (x["head"] + x["body"] + F.lit(len(END_TEXT + CLOSE))).cast("long")
    ends = F.aggregate("p", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + length(x))))
    loss = F.filter(F.zip_with("p", F.slice("_starts", 1, F.size("p")), lambda x, s: F.struct((s + x["head"]).alias("start"), x["body"].cast("long").alias("length"), x["loss"].alias("loss"))), lambda x: x["loss"])
    used = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"])
    return windows.withColumn("_starts", ends).select(
        F.col("_id").alias(conv_col),
        "window",
        F.array_join(F.col("p.text"), "").alias("text"),
        F.size(F.filter("p", lambda x: x["again"])).alias("repeated"),
        F.transform(loss, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
        used.alias("n_tokens"),
        (used > budget).alias("over_budget"),
    )


def chat_windows(
    turns: DataFrame,
    budget: int = 4096,
    system_tokens: int = 1024,
    history_turns: int = 2,
    history_tokens: int = 1024,
    tokens: Column | None = None,
    most_turns: int = 65_536,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per window: id, window (from 0), text, repeated (turns in front
    that other windows have as their own), loss (start and length, in code
    points, of each assistant text under the mask), n_tokens, over_budget.

    Spans end with every stride of half of what system turn and history leave
    of the budget, so that windows stay within it unless a single turn is
    longer than a stride (or the system turn than ``system_tokens``): turns are
    never cut, and such a window is marked over_budget. History is at most
    ``history_turns`` turns of at most ``history_tokens`` tokens together.

    Turns are ordered by turn, then role and text; repeated rows are turns of
    their own. Null roles and texts are empty, a null turn comes first, rows
    with a null id are one conversation. An empty table gives no windows; other
    columns are not read. Conversations of over ``most_turns`` rows are dealt by
    blocks of turns; the windows are the same. A turn counts as the bytes of its formatted text, which
    no byte-level tokenizer exceeds; ``tokens`` overrides that with a narrower
    bound and may use the columns _role and _text.
    """
    stride = (budget - system_tokens - history_tokens) // 2
    if stride < 1:
        raise ValueError("system turn and history leave no room in the budget")
    parts = [turns]
    long = turns.groupBy(F.col(conv_col).alias("_long")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most_turns).select("_long")
    if not long.isEmpty():
        same = F.col(conv_col).eqNullSafe(F.col("_long"))
        parts = [turns.join(long, same, "left_anti"), turns.join(long, same, "left_semi")]
    made = [_windows(part, k > 0, stride, budget, history_turns, history_tokens, tokens, conv_col, turn_col, role_col, text_col) for k, part in enumerate(parts)]
    return made[0] if len(made) == 1 else made[0].union(made[1])


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the windows of each conversation say, for checks: since it digests a
    conversation's text as a whole, that text comes together here. n_turns, turns_sha256 (of
    role, line end, text, line end for each turn), loss_chars and loss_sha256
    (of the texts under the mask, unescaped), formatted_chars (of all windows)."""
    segments = F.filter(F.split(F.col("text"), CLOSE), lambda s: s != "")
    own = F.slice(segments, F.col("repeated") + 1, F.greatest(F.size(segments) - F.col("repeated"), F.lit(0)))
    pattern = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]$"
    said = F.transform(own, lambda s: F.concat(unescape(F.regexp_extract(s, pattern, 1)), F.lit("\n"), unescape(F.regexp_extract(s, pattern, 2)), F.lit("\n")))
    masked = F.transform("loss", lambda x: unescape(F.substring(F.col("text"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    each = windows.select(conv_col, "window", F.size(own).alias("turns"), F.array_join(said, "").alias("said"), F.array_join(masked, "").alias("masked"), F.char_length("text").alias("chars"))
    parts = F.array_sort(F.collect_list(F.struct("window", "said", "masked")))
    whole = each.groupBy(conv_col).agg(F.sum("turns").cast("long").alias("n_turns"), parts.alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    masked = F.array_join(F.col("w.masked"), "")
    return whole.select(
        conv_col,
        "n_turns",
        F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        "formatted_chars",
    )
