"""Token budgets: their allocation, packing up to one, and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import count_tokens, strip, truncate_tokens


def allocate(total: int, text_share: float = 0.5, report_share: float = 0.25) -> dict[str, int]:
    """Tokens for texts, reports and the graph; shares are within 0 and 0.9 and 0.95 in sum at most."""
    total = max(256, int(total))
    text, report = (min(max(0.0, float(x)), 0.9) for x in (text_share, report_share))
    if text + report > 0.95:
        text, report = (x * 0.95 / (text + report) for x in (text, report))
    texts, reports = int(total * text), int(total * report)
    return {"total": total, "text_units": texts, "community_reports": reports, "graph": max(64, total - texts - reports)}


def batch_size(total: int, n: int, at_least: int) -> int:
    """Tokens for each batch of reports."""
    each = max(512, int(total / max(1, (n // max(1, at_least)) or 1)))
    return min(each, max(512, total // 2))


def pack(items: DataFrame, budget: int, *, text: str = "text", order: tuple[str, ...] = ("ord",), by: tuple[str, ...] = (), separator: int = 1, least: int = 24, tokenizer: str | None = None) -> DataFrame:
    """The items that fit a budget in their order, with `packed` text and `used` tokens.

    The first that doesn't fit is cut to the rest if that is `least` tokens or more, and nothing follows it. Blank items
    don't count; each but the first costs `separator` tokens more. Budgets are for each group of `by`.
    """
    window = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy(*order)
    clean = items.withColumn("packed", strip(F.coalesce(F.col(text), F.lit("")))).filter("packed <> ''")
    clean = clean.withColumn("_need", count_tokens(F.col("packed"), tokenizer) + separator)
    clean = clean.withColumn("_sum", F.sum("_need").over(window.rowsBetween(Window.unboundedPreceding, 0)) - separator)
    before = F.coalesce(F.lag("_sum").over(window), F.lit(0))
    first_over = (F.col("_sum") > budget) & (before <= budget)
    room = F.when(first_over, F.lit(budget) - before - F.when(before > 0, separator).otherwise(0))
    clean = clean.withColumn("_room", room).filter((F.col("_sum") <= budget) | (F.col("_room") >= least))
    return clean.withColumn("packed", F.when(F.col("_room").isNotNull(), truncate_tokens(F.col("packed"), F.col("_room").cast("int"), tokenizer)).otherwise(F.col("packed"))).withColumn(
        "used", F.when(F.col("_room").isNotNull(), F.lit(budget)).otherwise(F.col("_sum")).cast("long")
    ).drop("_need", "_sum", "_room")


def pack_sections(sections: DataFrame, budget: int, *, title: str = "title", body: str = "body", order: str = "ord", tokenizer: str | None = None) -> DataFrame:
    """Sections with headings up to a budget: each costs two tokens more, and a cut one keeps 32 tokens at least."""
    heading = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.lit("## "), F.col(title), F.lit("\n"))).otherwise("")
    whole = sections.withColumn("_block", strip(F.concat(heading, F.coalesce(F.col(body), F.lit(""))))).filter("_block <> ''")
    whole = whole.withColumn("_need", count_tokens(F.col("_block"), tokenizer) + 2)
    window = Window.partitionBy(F.lit(0)).orderBy(order)  # a handful of sections
    whole = whole.withColumn("_sum", F.sum(F.col("_need")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("_sum").over(window), F.lit(0))
    room = F.when((F.col("_sum") > budget) & (before <= budget), F.lit(budget) - before - count_tokens(F.concat(F.lit("## "), F.col(title), F.lit("\n")), tokenizer) - 2)
    whole = whole.withColumn("_room", room).filter((F.col("_sum") <= budget) | (F.col("_room") >= 32))
    cut = F.concat(heading, truncate_tokens(F.coalesce(F.col(body), F.lit("")), F.col("_room").cast("int"), tokenizer))
    return whole.withColumn("packed", F.when(F.col("_room").isNotNull(), cut).otherwise(F.col("_block"))).drop("_block", "_need", "_sum", "_room")


def next_fit(tokens: Column, most: int) -> Column:
    """Batch numbers for an ordered list of token counts: a batch ends before the item that would overfill it.

    One fold over the list, as the sum begins anew with every batch.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, n: Column) -> Column:
        n = F.coalesce(n, F.lit(0)).cast("long")
        new = (state["used"] + n > most) & (F.size(state["out"]) > 0) & (state["used"] > -1)
        batch = F.when(new, state["batch"] + 1).otherwise(state["batch"])
        used = F.when(new, n).otherwise(state["used"] + n)
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(state["out"], F.array(batch)).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])
