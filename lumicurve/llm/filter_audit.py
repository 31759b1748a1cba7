"""How filters interact: what each removes, alone and in every order.

Failure masks are built by column expressions inside the scan; only an id, a
digest of the text and a few flags are shuffled. Counts per part and mask (at
most 32 cells a part) then answer every order of the five filters.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicurve.session import materialise

FILTERS = "ABCDE"


def words(text: Column) -> Column:
    """Maximal runs without space and the controls from tab to carriage return."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def text_mask(text: Column, words: Column, least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5) -> Column:
    """Four bits, one for each filter that a text alone can fail: A too few
    words (1), B too few distinct ones (2), C too many capitals (4), D a symbol
    of ``#$%&*|`` (8)."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        F.size(words) < least_words,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * distinct_percent,
        capitals * 100 > F.char_length(text) * capital_percent,
        text.rlike(r"[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << bit).otherwise(0)
    return mask


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five bits, E being 16), n, good, toxic: documents of a part
    with these failures, and those of them labelled so.

    E is a copy: a text of which a smaller id exists. The least id of each
    text's digest is found by partial minima and joined back by id, so that a
    text with any number of copies makes no large group.
    """
    shown = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), shown.alias("_text"))
    rows = rows.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_text", words(F.col("_text")).alias("_words"))
    # Written, so that texts are read once: an id, a digest and a mask stand for each from here on.
    rows = materialise(rows.select("_id", "part", "_sha", text_mask(F.col("_text"), F.col("_words")).alias("_mask")), "masks")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    named = rows.where("_id IS NOT NULL").join(marks, "_id", "left").select("_id", "part", "_sha", "_mask", zero("_good").alias("_good"), zero("_toxic").alias("_toxic"))
    first = named.groupBy("_sha").agg(F.min("_id").alias("_id")).select("_id", "_sha", F.lit(True).alias("_first"))
    named = named.join(first, ["_id", "_sha"], "left").select("part", (F.col("_mask") + F.when(F.col("_first"), 0).otherwise(16)).alias("mask"), "_good", "_toxic")
    nameless = rows.where("_id IS NULL").select("part", F.col("_mask").alias("mask"), F.lit(0).cast("long").alias("_good"), F.lit(0).cast("long").alias("_toxic"))
    return named.union(nameless).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("_good").alias("good"), F.sum("_toxic").alias("toxic"))


def _steps() -> Column:
    """All orders and their steps: order, step, the step's bit, the bits in front."""
    made = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        before = 0
        for step, k in enumerate(order, 1):
            made.append(f"named_struct('o', '{name}', 's', {step}, 'b', {1 << k}, 'p', {before})")
            before |= 1 << k
    return F.expr(f"array({', '.join(made)})")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters A to E and step (from 1), whose
    filter is the order's letter there: kept (documents left after it), removed
    (by it), redundant (fail it, but were removed before), unique_fails (fail it
    alone), good_lost and toxic_lost (removed here and labelled so), shapley
    (removed by this filter, summed over all orders).

    Null and empty texts are the same text; null and empty sources are one part.
    A document without an id has no labels and is no copy, nor is a text a copy
    of its own; rows that repeat an id and its text all stand or fall together.
    A document is labelled if any of its label rows says so. Extra columns are
    not read; an empty table gives no rows.
    """
    cells = failure_cells(docs, labels)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_cells"))
    rows = parts.select("part", "_cells", F.explode(_steps()).alias("_step"))
    bit, before = F.col("_step.b"), F.col("_step.p")
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    gone = lambda x: x["mask"].bitwiseAND(before) != 0
    total = lambda f, of="n": F.aggregate(F.filter("_cells", f), F.lit(0).cast("long"), lambda acc, x: acc + x[of])
    # A document that fails k filters is removed by each of them in 120 / k orders.
    orders = F.array(*[F.lit(120 // k) for k in range(1, 6)])
    share = F.aggregate(F.filter("_cells", fails), F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * F.element_at(orders, F.bit_count(x["mask"])))
    return rows.select(
        "part",
        F.col("_step.o").alias("filter_order"),
        F.col("_step.s").cast("int").alias("step"),
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        total(lambda x: fails(x) & ~gone(x)).alias("removed"),
        total(lambda x: fails(x) & gone(x)).alias("redundant"),
        total(lambda x: x["mask"] == bit).alias("unique_fails"),
        total(lambda x: fails(x) & ~gone(x), "good").alias("good_lost"),
        total(lambda x: fails(x) & ~gone(x), "toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )
