"""Mixing sources to target weights by fitting each source's token budget as a subset sum.

Documents are counted by source and exact token length. Each source first gives the same share of every length; what is left
of its budget is filled by bounded-knapsack dynamic programming over the lengths still to be had. The documents of a length
are then taken in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import bpe, scratch

SEED = 17
#: The sources that may be too small for the default budget have so much of the weight at most.
SHORT = 0.1


def knapsack(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each length to take so that the sum is the largest that isn't above `room`.

    Reachable sums are the bits of one integer; the search ends as soon as `room` itself is reached.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for i, (size, count) in enumerate(zip(lengths, counts)):
        count, some = min(count, room // size) if size else 0, 1
        while count > 0 and not reach >> room & 1:
            some = min(some, count)
            steps.append((i, some, reach))
            reach |= (reach << (size * some)) & full
            count -= some
            some *= 2
        if reach >> room & 1:
            break
    at, take = reach.bit_length() - 1, [0] * len(lengths)
    for i, some, before in reversed(steps):
        if not before >> at & 1:
            take[i] += some
            at -= lengths[i] * some
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """Numbers of documents to take by length, for `budget` tokens or nearly so, never more.

    If the rest after the common share can't be filled exactly, more and more of that share is given back to the search, up to
    64 times the greatest length, so that its sums stay small. Lengths that hardly differ and are long (10 000 and 10 001, say)
    may need more than that; the sum is then the nearest one found from below, less than one document away.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return np.zeros_like(counts)
    order = np.random.default_rng(seed).permutation(len(lengths))
    share = np.array([int(c) * budget // total for c in counts])
    room = 2 * int(lengths.max())
    best, gap = None, None
    while True:
        take = share.copy()
        left = budget - int((lengths * take).sum())
        for i in order:  # one more of a length, until the search has little to fill
            if left <= room:
                break
            more = min(int(counts[i] - take[i]), (left - room) // int(lengths[i]) + 1, 1 if left < total // 2 else 1 << 62)
            take[i] += more
            left -= more * int(lengths[i])
        for i in order:  # and give back if it has less than that
            if left >= min(room, budget):
                break
            less = min(int(take[i]), (min(room, budget) - left - 1) // int(lengths[i]) + 1)
            take[i] -= less
            left += less * int(lengths[i])
        extra = knapsack([int(lengths[i]) for i in order], [int(counts[i] - take[i]) for i in order], left)
        for i, n in zip(order, extra):
            take[i] += n
        missing = budget - int((lengths * take).sum())
        if gap is None or missing < gap:
            best, gap = take, missing
        if not gap or room >= budget or room > 64 * int(lengths.max()):
            return best
        room *= 8


def mix_sources(
    docs: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    budget: int | None = None,
    short: float = SHORT,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    ranks: str = bpe.RANKS,
) -> DataFrame:
    """Documents chosen so that each source has its weight's part of the tokens: (doc_id, source, n_tokens).

    `weights` are by default equal for all sources that occur; sources without a weight, or without tokens, get nothing, and
    the others' weights are scaled to 1. `budget`, in BPE tokens, is by default the largest that sources with all but `short` of
    the weight can fill without repeating a document, so that a stray source of few documents doesn't shrink the corpus. A source
    that can't fill its part gives all it has, and its share is then less than its weight.

    Rows with a null id or source, and null or empty texts, are never chosen. Rows that share an id are one document, of the
    least source and length. Ties of the seeded hash go by id. Other columns are not read. An empty table gives none.
    """
    counted = bpe.count_tokens(docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), F.col(text_col)), id_col, text_col, ["source"], ranks=ranks)
    counted = counted.select("key.doc_id", "key.source", "n_tokens").filter("doc_id is not null and source is not null and n_tokens > 0")
    counted = scratch.written(counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("a")).select("doc_id", "a.source", "a.n_tokens"), "lengths")
    by_length = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("docs"))
    sums = by_length.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens"))
    if weights is None:
        weighed = sums.withColumn("weight", F.lit(1.0))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items() if w > 0], "source string, weight double")
        weighed = sums.join(F.broadcast(given), "source")
    everywhere = Window.partitionBy(F.lit(0))  # one row a source
    weighed = weighed.withColumn("weight", F.col("weight") / F.sum("weight").over(everywhere))
    if budget is None:
        upto = Window.partitionBy(F.lit(0)).orderBy(F.col("tokens") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, 0)
        weighed = weighed.withColumn("weight_upto", F.sum("weight").over(upto))
    most = F.min(F.when(F.col("weight_upto") > short + 1e-9, F.col("tokens") / F.col("weight"))).over(everywhere) if budget is None else F.lit(float(budget))
    parts = weighed.withColumn("part", F.floor(most * F.col("weight") + F.lit(1e-6)).cast("long")).select("source", "part")

    def fit(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("n_tokens")
        taken = fit_budget(one["n_tokens"].to_numpy(), one["docs"].to_numpy(), int(one["part"].iloc[0]), seed)
        return one.assign(take=taken)[["source", "n_tokens", "take"]]

    takes = by_length.join(parts, "source").groupBy("source").applyInPandas(fit, "source string, n_tokens long, take long")
    takes = scratch.written(takes.filter("take > 0"), "takes")
    nth = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    return counted.withColumn("nth", nth).join(takes, ["source", "n_tokens"]).filter("nth <= take").select("doc_id", "source", "n_tokens")
