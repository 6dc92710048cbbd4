"""Toxicity classifiers by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents of the whole corpus the unlabelled ones, among which toxic ones have
the share `prior`. With the logistic loss l, the risk  prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])  is
minimised by mini-batches; where the second term would be negative, the first alone is. How often each feature occurs among
the unlabelled is counted over all documents; only the gradient steps see a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.textkernel import U, Block, blocks, span_hash, words

BITS, PREFIXES, MAX_TOXIC, MAX_UNLABELLED, SEED = 18, (4, 5, 6), 10_000, 20_000, 11
#: Feature counts travel in slices of so many features.
SLICE = 1 << 12


class Model(NamedTuple):
    """Linear weights of hashed features, the mean of some classifiers, and their common intercept."""

    weight: np.ndarray
    bias: float
    prior: float


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row, as (row, feature).

    They are words and their first bytes, at several lengths, and each of these once more if it occurs at least twice: chance
    may put one such word into a clean text, but hardly two.
    """
    w = words(block)
    found = [(w.row << BITS) | (w.hash >> U(64 - BITS)).astype(np.int64)]
    for n in PREFIXES:
        long = w.end - w.start > n
        start = w.start[long]
        found.append((w.row[long] << BITS) | (span_hash(w.prefix, start, start + n) * U(2 * n + 1) >> U(64 - BITS)).astype(np.int64))
    every = np.sort(np.concatenate(found))
    first = np.ones(len(every), bool)
    first[1:] = every[1:] != every[:-1]
    second = ~first
    second[1:] &= first[:-1]
    again, mask = every[second], (1 << BITS) - 1
    both = np.unique(np.concatenate([every[first], again & ~mask | (again * 5 + 15838) & mask]))
    return both >> BITS, both & mask


def _featurise(chosen: np.ndarray):
    """Of each text the chosen features, and whether it has any feature at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                n = len(b.offsets) - 1
                row, feature = features(b)
                some = np.bincount(row, minlength=n) > 0
                use = chosen[feature]
                row, feature = row[use], feature[use]
                offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, n), pa.array(some), lists], names=["toxic", "some", "features"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the task each feature occurs, by slices; slice -1 is the number of texts with any feature.

    Rows are (toxic, text); toxic texts count a second time, in counts of their own.
    """
    total, texts = {k: np.zeros(1 << BITS, np.int64) for k in (False, True)}, {False: 0, True: 0}
    for batch in batches:
        for b in blocks(batch.column(1)):
            n = len(b.offsets) - 1
            row, feature = features(b)
            toxic = batch.column(0).slice(b.first, n).to_numpy(zero_copy_only=False).astype(bool)
            for k, use in ((False, np.ones(len(row), bool)), (True, toxic[row])):
                if use.any():
                    total[k] += np.bincount(feature[use], minlength=1 << BITS)
                    texts[k] += len(np.unique(row[use]))
    for k in total:
        if texts[k]:
            parts = total[k].reshape(-1, SLICE)
            used = np.flatnonzero(parts.any(1))
            counts = pa.array([np.array([texts[k]]).tobytes(), *(parts[i].tobytes() for i in used)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k] * (len(used) + 1)), pa.array([-1, *used.tolist()], pa.int32()), counts], names=["toxic", "slice", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[bool, int], np.ndarray] = {}
    for batch in batches:
        for k, i, raw in zip(*(c.to_pylist() for c in batch.columns)):
            held[k, i] = held.get((k, i), 0) + np.frombuffer(raw, np.int64)
    keys = list(held)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.bool_()), pa.array([i for _, i in keys], pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["toxic", "slice", "counts"])


def document_counts(texts: DataFrame) -> dict[bool, tuple[np.ndarray, int]]:
    """In how many of all texts, at False, and of the toxic ones, at True, each feature occurs, and how many have any.

    `texts` are (toxic, text). Counts are summed by task, then by slice; what comes to the driver is 4 MB, whatever the input.
    """
    kind = "toxic boolean, slice int, counts binary"
    summed = texts.mapInArrow(_count, kind).repartition("toxic", "slice").mapInArrow(_add, kind).collect()
    found = {k: [np.zeros(1 << BITS), 0] for k in (False, True)}
    for r in summed:
        counts = np.frombuffer(bytes(r["counts"]), np.int64)
        if r["slice"] < 0:
            found[r["toxic"]][1] = int(counts[0])
        else:
            found[r["toxic"]][0][r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = counts
    return {k: (x, n) for k, (x, n) in found.items()}


def _sums(weight: np.ndarray, feature: np.ndarray, heads: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weight[feature])])
    return total[heads[1:]] - total[heads[:-1]]


def evidence(p: np.ndarray, toxic: int, u: np.ndarray, n: int, prior: float, least: float = 22.0, strong: float = 1.0, smooth: float = 0.5) -> np.ndarray:
    """The value of each feature, from the document counts p of the toxic documents and u of all n documents.

    It is the signed square of the log odds, 0 unless these are `strong` and a likelihood ratio test gives `least`. The rate
    among documents that aren't toxic is what the unlabelled rate leaves after the share of toxic ones, 0 at least.
    """
    pr, ur = p / toxic, u / n
    clean = np.maximum(0, ur - prior * pr) / (1 - prior)
    pooled = (p + u) / (toxic + n)
    ratio = np.zeros(len(p))
    for count, of in ((p, toxic), (u, n)):
        for seen, expected in ((count, pooled * of), (of - count, (1 - pooled) * of)):
            ratio += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))
    odds = np.log((pr + smooth / toxic) / (clean + smooth / toxic))
    return np.where((ratio >= least) & (np.abs(odds) >= strong), odds * np.abs(odds) / 3, 0.0)


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of scores of toxic and of unlabelled rows, and its derivatives by each."""
    sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
    negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
    value = prior * np.mean(np.logaddexp(0, -gp)) + max(0.0, negative)
    if negative >= 0:  # the derivatives of l(-g) and of l(g) differ by 1 at each toxic row
        return value, np.full(len(gp), -prior / len(gp)), su / len(gu)
    return value, -prior * (1 - sp) / len(gp), np.zeros(len(gu))


def fit_non_negative(toxic: list[np.ndarray], other: list[np.ndarray], prior: float, value: np.ndarray, *, seed: int = SEED, epochs: int = 20, batch: int = 512, rate: float = 0.03, decay: float = 0.03) -> Model:
    """One linear classifier over features of the given values, by mini-batch Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    chosen = np.flatnonzero(value)
    number = np.full(len(value), -1)
    number[chosen] = np.arange(len(chosen))
    worth, dims = value[chosen], len(chosen)
    toxic, other = ([x[x >= 0] for x in (number[y] for y in rows)] for rows in (toxic, other))
    weight, m, v = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    bias, mb, vb, t = 0.0, 0.0, 0.0, 0
    p_size, u_size = min(len(toxic), batch), min(len(other), batch)
    steps = max(1, -(-len(other) // u_size))

    def part(rows: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [rows[i] for i in which]
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])

    for _ in range(max(epochs, -(-200 // steps))):
        p_order, u_order = rng.permutation(len(toxic)), rng.permutation(len(other))
        for s in range(steps):
            pf, ph = part(toxic, np.take(p_order, range(s * p_size, (s + 1) * p_size), mode="wrap"))
            uf, uh = part(other, np.take(u_order, range(s * u_size, (s + 1) * u_size), mode="wrap"))
            own = weight * worth
            gp, gu = _sums(own, pf, ph) + bias, _sums(own, uf, uh) + bias
            _, dp, du = risk(gp, gu, prior)
            grad = np.bincount(pf, np.repeat(dp, np.diff(ph)), dims) + np.bincount(uf, np.repeat(du, np.diff(uh)), dims)
            grad = grad * worth + decay * prior * weight
            gb, t = dp.sum() + du.sum(), t + 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            weight -= step * m / (np.sqrt(v) + 1e-6)
            bias -= step * mb / (np.sqrt(vb) + 1e-6)
    full = np.zeros(len(value))
    full[chosen] = weight * worth
    return Model(full, float(bias), prior)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    prior: float | None = None,
    max_toxic: int = MAX_TOXIC,
    max_unlabelled: int = MAX_UNLABELLED,
    classifiers: int = 3,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Train on at most `max_toxic` confirmed toxic documents and `max_unlabelled` documents of the corpus, by seeded hash.

    The features' document counts are of all documents; the sample serves the gradient steps alone.

    `prior`, the share of toxic documents, is by default their share among the labelled ones, within 0.001 and 0.5. Without
    any toxic document or any text at all the model rejects nothing. Null ids, labels and texts are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    if prior is None:
        share = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0]
        prior = min(0.5, max(0.001, share or 0.0))
    by = F.xxhash64(F.lit(seed), "doc_id")
    toxic = known.filter("toxic = 1").select("doc_id").distinct().orderBy(by, "doc_id").limit(max_toxic)
    other = base.select("doc_id").distinct().orderBy(by, "doc_id").limit(max_unlabelled)
    # both lists are bounded by parameters, so they may be broadcast
    marked = base.join(F.broadcast(toxic.withColumn("toxic", F.lit(True))), "doc_id", "left").select(F.coalesce("toxic", F.lit(False)).alias("toxic"), "text")
    counts = document_counts(marked)
    if not counts[True][1]:
        return Model(np.zeros(1 << BITS), -1.0, prior)
    value = evidence(*counts[True], *counts[False], prior)
    if not value.any():
        return Model(np.zeros(1 << BITS), -1.0, prior)
    sample = toxic.withColumn("is_toxic", F.lit(True)).union(other.withColumn("is_toxic", F.lit(False)))
    # of each sampled document a few features are left
    rows = base.join(F.broadcast(sample), "doc_id").select(F.col("is_toxic").alias("toxic"), "text").mapInArrow(_featurise(value != 0), "toxic boolean, some boolean, features array<int>")
    flat = rows.filter("some").select("toxic", "features").toArrow().combine_chunks()
    sets: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    if flat.num_rows:
        lists = flat["features"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values, heads = lists.values.to_numpy(), lists.offsets.to_numpy()
        own = [values[a:b] for a, b in zip(heads[:-1], heads[1:])]
        order = sorted(range(len(own)), key=lambda i: (len(own[i]), own[i].tobytes()))  # independent of the rows' order
        marks = flat["toxic"].to_numpy()
        for i in order:
            sets[0 if marks[i] else 1].append(own[i])
    if not sets[0] or not sets[1]:
        return Model(np.zeros(1 << BITS), -1.0, prior)
    found = [fit_non_negative(*sets, prior, value, seed=seed + i) for i in range(classifiers)]
    return Model(np.mean([x.weight for x in found], 0), float(np.mean([x.bias for x in found])), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) for each row of `docs`: the decision value on the whole text, and whether it is above 0.

    Texts of any length are read whole; an empty table gives an empty result.

    A null or empty text, or one without words, has the score of the intercept alone and is never toxic. A null id stays
    null; repeated rows are scored each. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            for b in blocks(batch.column(1)):
                n = len(b.offsets) - 1
                row, feature = features(b)
                value = np.round(np.bincount(row, weight[feature].astype(float), n) + bias, 6)
                bad = (value > 0) & (np.bincount(row, minlength=n) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, n), pa.array(value), pa.array(bad)], names=["doc_id", "score", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, toxic boolean")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, that the model doesn't call toxic. Row by row, without a shuffle.

    Null and empty texts stay, whatever the other columns hold and are called; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            keep = []
            for b in blocks(batch.column(at)):
                n = len(b.offsets) - 1
                row, feature = features(b)
                value = np.round(np.bincount(row, weight[feature].astype(float), n) + bias, 6)
                keep.append((value <= 0) | (np.bincount(row, minlength=n) == 0))
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
