"""Near-duplicate groups by ProbMinHash signatures, banding and exact verification.

A document is the multiset of its word shingles, weighted by how often each occurs. The similarity is the probability
Jaccard index  J(x, y) = sum_d 1 / sum_e max(x_e / x_d, y_e / y_d)  over the elements d of both.

Texts of the same words are one node. Nodes that share a band are candidates where their signatures agree enough; each two
nodes are, in the first band they share, and none is spared for being like a third one. Nodes with candidates are put into
blocks of a bounded number of bytes by their families, and a text is sent once to each pair of blocks in which it has a
candidate, not once for each candidate. Every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.llm import scratch
from weftgraph.llm.textkernel import U, Block, blocks, mix, prefix_sums, sequence_hash, shingles, span_hash, weigh, words

#: Signatures of candidates agree in THRESHOLD - SLACK of the registers: five standard deviations of 96.
SHINGLE, BANDS, ROWS, THRESHOLD, SLACK, SEED = 5, 48, 2, 0.5, 0.26, 7
#: Members of a chunk of a bucket, and the bytes of text and the texts of a block.
BUCKET, BLOCK_BYTES, BLOCK_TEXTS = 1 << 13, 1 << 19, 256
#: A similarity that is less than the threshold by no more than this meets it: sums of fractions are rounded.
ROUNDING = 1e-12


def prob_minhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, m: int, seed: int = SEED) -> np.ndarray:
    """ProbMinHash signatures: for each row and each of m registers, the element whose arrival came first.

    Every element is a Poisson process with its weight as rate; each arrival falls into a uniformly chosen register. An
    element stops as soon as its next arrival would be later than the latest of the row's registers. Rows without elements
    have a signature of zeros.
    """
    first = np.full(n_rows * m, np.inf)
    value = np.zeros(n_rows * m, U)
    element, row, rate = element, row, weight
    time, turn = np.zeros(len(element)), 0
    state = mix(element ^ U(seed * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF))
    while len(element):
        with np.errstate(over="ignore"):
            draw = mix(state + U(turn) * U(0x9E3779B97F4A7C15))
        time = time - np.log(((draw >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate
        register = ((mix(draw) >> U(40)) * U(m)) >> U(24)
        at = row * m + register.astype(np.int64)
        better = np.flatnonzero(time < first[at])
        better = better[np.argsort(-time[better], kind="stable")]  # of several for a register, the earliest is written last
        first[at[better]] = time[better]
        value[at[better]] = element[better]
        last = first.reshape(n_rows, m).max(1)
        on = time < last[row]
        element, row, rate, time, state = element[on], row[on], rate[on], time[on], state[on]
        turn += 1
    return value.reshape(n_rows, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets given as (sorted distinct elements, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    common = b[0][at] == a[0]
    x, y = a[1][common], b[1][at[common]]
    if not len(x):
        return 0.0
    own_x, own_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # elements of at least this ratio, those of x alone among them, count by x, the others by y
    from_here = own_x + np.cumsum(x[::-1])[::-1]
    before = own_y + np.concatenate([[0.0], np.cumsum(y)])[:-1]
    head = np.searchsorted(ratio, ratio, "left")
    return float(np.sum(1.0 / (from_here[head] / x + before[head] / y)))


def alike(own: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Which of the others have an exact probability Jaccard with `own` of at least `threshold`; sets as above."""
    n, threshold = len(others), threshold - ROUNDING
    element, weight = (np.concatenate(x) for x in zip(*others))
    if not len(own[0]) or not len(element):
        return np.full(n, threshold <= 0)
    row = np.repeat(np.arange(n), [len(e) for e, _ in others])
    at = np.minimum(np.searchsorted(own[0], element), len(own[0]) - 1)
    common = np.flatnonzero(own[0][at] == element)
    x, y, of = own[1][at[common]], weight[common], row[common]
    of_x, of_y, total = np.bincount(of, x, n), np.bincount(of, y, n), np.bincount(row, weight, n)
    # where common elements weigh the same in both, the similarity is their weight over that of the union
    found = of_x / (own[1].sum() + total - of_y) >= threshold
    for i in np.flatnonzero(np.bincount(of, x != y, n)):
        # a term is at most the element's share of either set
        found[i] = min(of_x[i] / own[1].sum(), of_y[i] / total[i]) >= threshold and probability_jaccard(own, others[i]) >= threshold
    return found


def _weighted(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words(block)
    return weigh(*shingles(w.hash, w.row, len(block.offsets) - 1, k))


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bands * rows
        for batch in batches:
            for b in blocks(batch.column(2)):
                n = len(b.offsets) - 1
                w = words(b)
                sign = prob_minhash(*weigh(*shingles(w.hash, w.row, n, k)), n, m)
                h1, h2 = (sequence_hash(w.hash, w.row, n, s) for s in (1, 2))
                none = np.flatnonzero(h1 == 0)
                raw = prefix_sums(b.data)
                h2[none] = span_hash(raw, b.offsets[none], b.offsets[none + 1])
                band = np.zeros((n, bands), U)
                with np.errstate(over="ignore"):
                    for i in range(rows):
                        band = mix(band * U(0x100000001B3) + sign[:, i::rows] + np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15))
                some = h1 != 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                small = np.ascontiguousarray((mix(sign) & U(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(b.first, n),
                        batch.column(1).slice(b.first, n),
                        pa.array(np.diff(b.offsets)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array((band[some].ravel() >> U(32)).astype(np.uint32).view(np.int32))),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * m).astype(np.int32)), pa.py_buffer(small)]),
                    ],
                    names=["doc_id", "th", "size", "h1", "h2", "bands", "small"],
                )

    return run


def bucket_pairs(small: np.ndarray, before: np.ndarray, part: np.ndarray, ids: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of one bucket, or of two chunks of it, whose signatures agree in a share of at least `least`.

    Each two ids are compared, but for those that share a band of an earlier bucket (`before`), where they are compared
    already. Of equal signatures only the first is held against others: what it is paired with concerns them all. Its like
    are paired with it. Where `part` isn't negative, it is an id's chunk, and only ids of different chunks are compared.
    """
    whole = np.ascontiguousarray(np.concatenate([part.astype(np.int64)[:, None].view(np.uint8), small], axis=1))
    _, first, kind = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    lead = np.sort(first)
    if part[0] < 0:
        led = first[kind.ravel()]
        more = np.flatnonzero((led != np.arange(len(ids))) & ~(before == before[led]).any(1))
        yield ids[led[more]], ids[more]
        sides = ((i, lead[n + 1 :]) for n, i in enumerate(lead))
    else:
        here = part[lead] == part[0]
        sides = ((i, lead[~here]) for i in lead[here])
    for i, other in sides:
        other = other[~(before[other] == before[i]).any(1)]
        other = other[(small[other] == small[i]).mean(1) >= least]
        if len(other):
            yield np.full(len(other), ids[i]), ids[other]


def _pair_up(m: int, least: float):
    """Rows (cell, node, part, small, before), sorted by cell, length of `before`, node."""

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids, part = (table.column(i).to_numpy() for i in range(3))
        small = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(len(key), m)
        before = table.column(4).combine_chunks()
        at, before = before.offsets.to_numpy().astype(np.int64), before.values.to_numpy()
        length = np.diff(at)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (length[1:] != length[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(key)))
        two = head[size == 2]
        two = two[((part[two] < 0) | (part[two] != part[two + 1])) & ((small[two] == small[two + 1]).mean(1) >= least)]
        row = np.repeat(np.arange(len(two)), length[two])
        place = np.arange(len(row)) - np.repeat(np.cumsum(length[two]) - length[two], length[two])
        known = np.bincount(row, before[at[two][row] + place] == before[at[two + 1][row] + place], len(two))
        two = two[known == 0]
        held, n_held = [(ids[two], ids[two + 1])], len(two)
        for h, n in zip(head[size > 2], size[size > 2]):
            for pair in bucket_pairs(small[h : h + n], before[at[h] : at[h + n]].reshape(n, length[h]), part[h : h + n], ids[h : h + n], least):
                held.append(pair)
                n_held += len(pair[0])
                if n_held > 1 << 16:
                    yield made(held)
                    held, n_held = [], 0
        if n_held:
            yield made(held)

    def made(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0] == batch.column(0)[-1]:
                continue  # all one bucket so far
            cut = int(np.searchsorted(batch.column(0).to_numpy(), batch.column(0)[-1].as_py()))  # the last bucket may go on in the next batch
            last = batch.slice(cut)
            yield from of(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [last]
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


class _Sets:
    """The nodes of one pair of blocks, their shingles, how many links each has, and which of them are joined already."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.up: dict[int, int] = {}
        self.count: dict[int, int] = {}
        self.joins: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up.get(i, i) != i:
            i = self.up[i] = self.up.get(self.up[i], self.up[i])
        return i

    def link(self, a: int, b: int) -> None:
        for i in (a, b):
            self.count[i] = self.count.get(i, 0) + 1
        low, high = sorted((self.root(a), self.root(b)))
        if low != high:
            self.up[high] = low
            self.joins.append((a, b))


def _verify(k: int, threshold: float):
    """Rows (cell, node, partners, text), sorted by cell, then node; a partner is always a lesser node of the same cell.

    Gives of each cell links (a, b, 0) that join what isn't joined yet, and for each node with links (node, node, how many).
    """

    def told(own: _Sets) -> pa.RecordBatch:
        count = own.count.items()
        a, b = [a for a, _ in own.joins] + [i for i, _ in count], [b for _, b in own.joins] + [i for i, _ in count]
        n = [0] * len(own.joins) + [n for _, n in count]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own = None, _Sets()
        for batch in batches:
            cells, nodes, partners = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for block in blocks(batch.column(3)):
                n = len(block.offsets) - 1
                e, r, w = _weighted(block, k)
                cut = np.searchsorted(r, np.arange(n + 1))
                for i in range(n):
                    at = block.first + i
                    if cells[at] != cell:
                        if own.count:
                            yield told(own)
                        cell, own = cells[at], _Sets()
                    b = int(nodes[at])
                    if b in own.of:
                        continue  # a row that is repeated
                    own.of[b] = e[cut[i] : cut[i + 1]].copy(), w[cut[i] : cut[i + 1]].copy()
                    near = sorted(set(partners[at].as_py()))
                    if near:
                        for j in np.flatnonzero(alike(own.of[b], [own.of[a] for a in near], threshold)):
                            own.link(near[j], b)
        if own.count:
            yield told(own)

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): (node, root), root the least node; nodes without edge are absent.

    Alternating large-star and small-star steps; each step's edges are written, so lineage stays short, and those of the step
    before are deleted.
    """
    now = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        told = Observation()
        after = moved.union(least.select("u", F.col("m").alias("v"))).distinct().observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        before, now = now, scratch.written(after, "edges", free=True)
        scratch.drop(before)
        seen = tuple(told.get[x] for x in "ns")
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def candidates(nodes: DataFrame, m: int, least: float, sure: float, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, bands, small) that share a band and whose signatures agree in a share of `least`.

    Nodes of equal signatures are paired with one of them, and this one stands for all in pairs with others; `expanded` gives
    every pair. `sure` isn't read: no agreement short of equality spares a node a comparison. Bands of a single node are left
    out before signatures are sent. A bucket of more than `bucket` nodes is cut into chunks by hash, and each two of its chunks
    are held against one another, so no task holds more than two chunks and no pair is lost.
    """
    short = F.transform("bands", lambda x: F.hash(x))
    keys = F.transform(short, lambda x, i: F.xxhash64(i, x))
    keyed = nodes.select(F.explode(keys).alias("key"), "node")
    shared = keyed.withColumn("count", F.count("*").over(Window.partitionBy("key"))).filter("count > 1")
    chunks = F.ceil(F.col("count") / bucket).cast("long")
    own = F.pmod(F.xxhash64("node"), chunks)
    alone = F.lit(-1).cast("long")
    one = F.array(F.struct(F.col("key").alias("cell"), alone.alias("part")))
    several = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.struct(F.xxhash64("key", F.least(own, j), F.greatest(own, j)).alias("cell"), F.when(j == own, alone).otherwise(own).alias("part")))
    placed = shared.select("node", "key", F.explode(F.when(chunks == 1, one).otherwise(several)).alias("x")).select("node", "key", "x.*")
    return (
        placed.join(nodes.select("node", "small", short.alias("short"), keys.alias("keys")), "node")
        .select("cell", "node", "part", "small", F.slice("short", F.lit(1), (F.array_position("keys", F.col("key")) - 1).cast("int")).alias("before"))
        .repartition("cell")
        .sortWithinPartitions("cell", F.size("before"), "node")
        .mapInArrow(_pair_up(m, least), "a long, b long")
        .distinct()
    )


def expanded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """`pairs` with one for each node of equal signature (`small`) in place of the one that stands for them."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "small"), "node")
    kinds = met.groupBy("small").agg(F.min("node").alias("kind"), F.collect_list("node").alias("like")).filter(F.size("like") > 1)
    kinds = scratch.written(kinds.select("kind", "like"), "kinds", free=True)
    if kinds.isEmpty():
        return pairs
    like = kinds.select("kind", F.explode("like").alias("node"))
    for x in "ab":
        pairs = pairs.join(like.select(F.col("node").alias(x), F.col("kind").alias("kind_" + x)), x, "left")
    a, b = F.coalesce("kind_a", "a"), F.coalesce("kind_b", "b")
    pairs = pairs.select(F.least(a, b).alias("kind_a"), F.greatest(a, b).alias("kind_b")).filter("kind_a < kind_b").distinct()
    pairs = pairs.union(kinds.select("kind", "kind"))
    for x in "ab":
        pairs = pairs.join(like.select(F.col("kind").alias("kind_" + x), F.col("node").alias(x)), "kind_" + x, "left")
    a, b = F.coalesce("a", "kind_a"), F.coalesce("b", "kind_b")
    return pairs.filter((F.col("kind_a") < F.col("kind_b")) | (a < b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The pairs (a, b), all verified on the whole texts: (a, b, n), links that join what isn't joined yet within a pair of
    blocks, n being 0, and rows of which a = b with n of this node's links, to be summed.

    `nodes` are (node, doc_id, th, size), `texts` (doc_id, th, text). The family of a node is the least node it is paired with;
    families of more than `block_bytes` or BLOCK_TEXTS are cut into several blocks by hash.
    """
    family = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("f")), F.struct(F.col("b").alias("node"), F.col("a").alias("f")))).alias("x")).groupBy("x.node").agg(F.min("x.f").alias("f"))
    own = family.join(nodes, "node")
    parts = own.groupBy("f").agg(F.greatest(F.ceil(F.sum("size") / block_bytes), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("long").alias("parts"))
    place = F.xxhash64("f", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")
    placed = scratch.written(own.join(parts, "f").select("node", "doc_id", "th", place), "placed", free=True)
    met = pairs.join(placed.select(F.col("node").alias("a"), F.col("block").alias("block_a")), "a").join(placed.select(F.col("node").alias("b"), F.col("block").alias("block_b")), "b")
    met = met.select("a", "b", F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("cell"))
    none = F.lit(None).cast("long")
    both = met.select("cell", F.explode(F.array(F.struct(F.col("a").alias("node"), none.alias("a")), F.struct(F.col("b").alias("node"), F.col("a")))).alias("x"))
    wanted = both.groupBy("cell", "x.node").agg(F.collect_list("x.a").alias("partners"))
    wanted = wanted.join(placed.select("node", "doc_id", "th"), "node")
    return (
        texts.join(wanted, ["doc_id", "th"])
        .select("cell", "node", "partners", "text")
        .repartition("cell")
        .sortWithinPartitions("cell", "node")
        .mapInArrow(_verify(shingle, threshold), "a long, b long, n long")
    )


def classes(docs: DataFrame, id_col: str, text_col: str, *, shingle: int, bands: int, rows: int, threshold: float, slack: float) -> DataFrame:
    """(doc_id, th, group_id, group_th, n_links) for each row with an id and a text, th being a hash of the text.

    group_id and group_th tell the least id of a class and the text of it that stands for the class.
    """
    m = bands * rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = scratch.written(texts.mapInArrow(_sign(shingle, bands, rows), "doc_id long, th long, size long, h1 long, h2 long, bands array<int>, small binary"), "signatures")
    same = signed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "size")).alias("r"), F.first("bands").alias("bands"), F.first("small").alias("small"))
    same = scratch.written(same.select("h1", "h2", "r.*", "bands", "small"), "texts", free=True)
    # a node's number is the id, but for further texts of one id
    several = same.groupBy("doc_id").agg(F.min("th").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("doc_id", "lead")
    if several.isEmpty():
        nodes = same.withColumn("node", F.col("doc_id"))
    else:
        nodes = same.join(several, "doc_id", "left").withColumn("node", F.when(F.col("th") == F.coalesce("lead", "th"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "th"))).drop("lead")
    pairs = scratch.written(candidates(nodes.filter("h1 <> 0"), m, threshold - slack, threshold + slack), "pairs", free=True)
    pairs = scratch.written(expanded(pairs, nodes), "pairs", free=True)
    edges = scratch.written(verified(pairs, nodes.select("node", "doc_id", "th", "size"), texts, shingle, threshold), "links", free=True)
    roots = components(edges)
    links = edges.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    linked = roots.join(nodes.select("node", "doc_id", "th"), "node").join(links, "node", "left")
    leads = linked.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("lead"))
    linked = linked.join(leads, "root").select("node", "lead", "n_links")
    led = nodes.select("h1", "h2", "node", F.struct("doc_id", "th").alias("own")).join(linked, "node", "left").select("h1", "h2", F.coalesce("lead", "own").alias("lead"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return signed.select("doc_id", "th", "h1", "h2").join(led, ["h1", "h2"]).select("doc_id", "th", F.col("lead.doc_id").alias("group_id"), F.col("lead.th").alias("group_th"), "n_links")


def _settings(given: dict) -> dict:
    return {"shingle": SHINGLE, "bands": BANDS, "rows": ROWS, "threshold": THRESHOLD, "slack": SLACK} | given


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """Group documents whose probability Jaccard over word shingles is at least `threshold`, directly or by a chain.

    Returns (doc_id, group_id, n_links), one row for each distinct id; group_id is the least id of the group, so the documents
    of which group_id = doc_id are the ones to keep. n_links counts the other texts whose similarity to the document's meets the
    threshold; texts of the same word sequence are one text here, and always one group. Candidates are found by bands of
    ProbMinHash registers, and each is verified on the whole texts. `settings`: shingle, bands, rows, threshold, slack. The bands
    miss 1 in a million pairs right at the threshold, and asking for an agreement of threshold - slack of the registers costs 2 in
    10 million; both fall fast with similarity.

    Nulls: a null id is left out; a null text is a group of its own. Texts without any word, empty ones among them, are one
    group only if equal byte for byte. Texts of fewer words than a shingle are one shingle. Rows that share an id are one row
    of the result, with the least group of any of their texts and the most links. Other columns are not read. An empty table
    gives an empty result.
    """
    grouped = classes(docs, id_col, text_col, **_settings(settings)).select("doc_id", "group_id", "n_links")
    alone = docs.filter(F.col(text_col).isNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(id_col).cast("long").alias("group_id"), F.lit(0).cast("long").alias("n_links"))
    return grouped.union(alone).groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.max("n_links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """The rows of `docs`, all columns as they are, of one text of each group: that of the least id, of equal ids the least hash.

    Rows with a null id or text stay. Of rows equal in id and text one stays, the first by its other columns as JSON; rows that
    share an id but not the text are different documents. An empty table gives an empty result.
    """
    found = classes(docs, id_col, text_col, **_settings(settings))
    gone = scratch.written(found.filter("doc_id <> group_id or th <> group_th").select("doc_id", "th").distinct().select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")), "gone", free=True)
    row = docs.select(F.struct(*docs.columns).alias("row"))
    own, text = F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col).cast("string")
    kept = row.join(gone, (own == F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_th")) & text.isNotNull(), "left_anti")
    return one_per_text(kept.select("row.*"), docs, id_col, text_col)


def one_per_text(kept: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`kept` with one of the rows that are equal in id and text; texts are shuffled for it only if `docs` has repeated ids."""
    if docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col)).count().filter("count > 1").isEmpty():
        return kept
    row = kept.select(F.struct(*kept.columns).alias("row"))
    own, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    first = F.row_number().over(Window.partitionBy(own, text).orderBy(F.to_json("row")))
    return row.withColumn("nth", F.when(own.isNull() | text.isNull(), 1).otherwise(first)).filter("nth = 1").select("row.*")
