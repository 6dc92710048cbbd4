"""Exact nearest neighbours of query vectors by vector-approximation files.

Vectors lie in block files in the shared folder; beside each lies its approximation, one byte for the cell of each dimension,
with the vector's distance from the centre of its cells. A search scans approximations block by block: the distance to a
centre, less or plus that residue, bounds the true distance, and only what may still be among the k nearest is kept. Exact
vectors are then read in the order of their lower bounds until the k-th result is certain.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import scratch

BLOCK, QUERIES, TILE, LEVELS = 1 << 16, 1024, 1 << 13, 256


def _save(system: fs.FileSystem, where: str, values: np.ndarray) -> None:
    with system.open_output_stream(where) as out:
        out.write(np.ascontiguousarray(values).tobytes())


class Block:
    """One block's files, opened when needed."""

    def __init__(self, path: str, n: int, dim: int) -> None:
        self.path, self.n, self.dim = path, n, dim
        self.system, self.where = fs.FileSystem.from_uri(path)

    def _whole(self, suffix: str, dtype: type, shape: tuple) -> np.ndarray:
        with self.system.open_input_file(self.where + suffix) as f:
            return np.frombuffer(f.read(), dtype).reshape(shape)

    def ids(self) -> np.ndarray:
        return self._whole(".ids", np.int64, (self.n,))

    def codes(self) -> np.ndarray:
        return self._whole(".va", np.uint8, (self.n, self.dim))

    def residues(self) -> np.ndarray:
        return self._whole(".res", np.float32, (self.n,))

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Exact vectors of some rows, by range reads; rows that follow one another closely are one read."""
        order = np.unique(rows)
        size, found = 4 * self.dim, np.empty((len(order), self.dim), np.float32)
        with self.system.open_input_file(self.where + ".vec") as f:
            start = 0
            for stop in [*(np.flatnonzero(np.diff(order) > 16) + 1), len(order)]:
                first, last = int(order[start]), int(order[stop - 1])
                run = np.frombuffer(f.read_at((last - first + 1) * size, first * size), np.float32).reshape(-1, self.dim)
                found[start:stop] = run[order[start:stop] - first]
                start = stop
        return found[np.searchsorted(order, rows)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _bounds(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, np.inf, np.float32), np.full(dim, -np.inf, np.float32)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if np.isfinite(low).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(low.astype(float)), pa.array(high.astype(float))], names=["d", "low", "high"])

    return run


def _store(folder: str, dim: int, low: np.ndarray, step: np.ndarray, block: int):
    def put(system: fs.FileSystem, where: str, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        name = uuid.uuid4().hex  # of its own for each attempt of a task
        codes = np.clip(np.floor((x - low) / step), 0, LEVELS - 1).astype(np.uint8)
        away = x.astype(float) - (low + (codes + 0.5) * step)
        residue = np.nextafter(np.sqrt((away * away).sum(1)).astype(np.float32), np.float32(np.inf))
        for suffix, values in ((".ids", ids), (".vec", x), (".va", codes), (".res", residue)):
            _save(system, f"{where}/{name}{suffix}", values)
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(ids)], pa.int64())], names=["path", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)
        ids, xs, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids.append(part.column(0).to_numpy())
                xs.append(_matrix(part.column(1), dim))
                held += part.num_rows
                if held >= block:
                    yield put(system, where, np.concatenate(ids), np.concatenate(xs))
                    ids, xs, held = [], [], 0
        if held:
            yield put(system, where, np.concatenate(ids), np.concatenate(xs))

    return run


def nearest(queries: np.ndarray, own: np.ndarray, blocks: list[Block], k: int, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, neighbour id, distance) of the k nearest, in order, ties by id; `own` are the queries' ids.

    A vector of the query's own id isn't its neighbour.
    """
    n = len(queries)
    base = queries.astype(np.float32)
    norms = (base * base).sum(1)
    kth = np.full(n, np.inf, np.float32)
    by_id = np.argsort(own, kind="stable")
    asked = own[by_id]
    kept: list[tuple[np.ndarray, ...]] = []
    for number, block in enumerate(blocks):
        codes, residues, ids = block.codes(), block.residues(), block.ids()
        for at in range(0, block.n, TILE):
            centre = low.astype(np.float32) + (codes[at : at + TILE].astype(np.float32) + 0.5) * step.astype(np.float32)
            size = (centre * centre).sum(1)
            square = norms[:, None] + size[None] - 2 * (base @ centre.T)
            slack = 1e-5 * (norms[:, None] + size[None])  # more than single precision can be off
            residue = residues[at : at + TILE]
            lower = np.sqrt(np.maximum(square - slack, 0)) - residue
            first, last = (np.searchsorted(asked, ids[at : at + TILE], side) for side in ("left", "right"))
            for v in np.flatnonzero(first < last):
                lower[by_id[first[v] : last[v]], v] = np.inf
            if np.isinf(kth).any():
                upper = np.sqrt(np.maximum(square + slack, 0)) + residue
                upper[np.isinf(lower)] = np.inf
                if upper.shape[1] >= k:
                    kth = np.minimum(kth, np.partition(upper, k - 1, axis=1)[:, k - 1])
            q, v = np.nonzero((lower <= kth[:, None]) & np.isfinite(lower))
            above = np.sqrt(np.maximum(square[q, v] + slack[q, v], 0)) + residue[v]
            kept.append((q, np.full(len(q), number), v + at, lower[q, v], above))
        q, b, v, lo, hi = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((hi, q))
        heads = np.searchsorted(q[order], np.arange(n + 1))
        enough = np.flatnonzero(np.diff(heads) >= k)
        kth[enough] = np.minimum(kth[enough], hi[order][heads[enough] + k - 1])
        on = lo <= kth[q]
        kept = [tuple(x[on] for x in (q, b, v, lo, hi))]
    q, b, v, lo, _ = kept[0]
    order = np.lexsort((lo, q))
    q, b, v, lo = q[order], b[order], v[order], lo[order]
    heads = np.searchsorted(q, np.arange(n + 1))
    exact = np.full(len(q), np.inf)
    read = heads[:-1].copy()
    sure = np.full(n, np.inf)
    open_ = np.flatnonzero(read < heads[1:])
    while len(open_):
        stop = np.minimum(read[open_] + k, heads[open_ + 1])
        at = np.concatenate([np.arange(x, y) for x, y in zip(read[open_], stop)])
        for number in np.unique(b[at]):
            some = at[b[at] == number]
            away = blocks[number].vectors(v[some]).astype(float) - queries[q[some]].astype(float)
            exact[some] = np.sqrt((away * away).sum(1))
        for i, to in zip(open_, stop):
            if to - heads[i] >= k:
                sure[i] = np.partition(exact[heads[i] : to], k - 1)[k - 1]
        read[open_] = stop
        more = read[open_] < heads[open_ + 1]
        more[more] = lo[read[open_[more]]] <= sure[open_[more]]
        open_ = open_[more]
    done = np.flatnonzero(np.isfinite(exact))
    ids = np.zeros(len(q), np.int64)
    for number in np.unique(b[done]):
        some = done[b[done] == number]
        ids[some] = blocks[number].ids()[v[some]]
    order = done[np.lexsort((ids[done], exact[done], q[done]))]
    place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    order = order[place < k]
    return q[order], ids[order], exact[order]


def _search(listed: list[tuple[str, int]], dim: int, k: int, low: np.ndarray, step: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(path, n, dim) for path, n in listed]
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                own = part.column(0).to_numpy()
                q, near, distance = nearest(_matrix(part.column(1), dim), own, blocks, k, low, step)
                rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(rank), pa.array(near), pa.array(np.round(distance, 6))], names=["vec_id", "rank", "neighbor_id", "distance"])

    return run


def _clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).filter("vec_id is not null and size(v) > 0")
    return base.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def search(vectors: DataFrame, asked: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The k nearest of `vectors` to each row of `asked` by Euclidean distance: (vec_id, rank, neighbor_id, distance).

    Exact; for unit vectors the order is that of cosine similarity. Ties go by the neighbour's id; distances are rounded to
    six digits after ranking. A vector of the query's own id isn't its neighbour, while one of equal value may be. With fewer
    than k others, all are returned. The dimension is the most frequent one of `vectors` (the lesser of equals); vectors of
    another, and null, empty or not finite ones, as well as null ids, neither ask nor answer. Repeated rows ask and answer each.
    Columns are read by the two names given alone; an empty table on either side gives an empty result.

    Each task holds `queries` queries at most against all approximations, one block of `block` vectors at a time.
    """
    spark = vectors.sparkSession
    base = _clean(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "vec_id long, rank long, neighbor_id long, distance double")
    common = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return empty
    dim = common["dim"]
    base = base.filter(F.size("v") == dim)
    wanted = scratch.written(_clean(asked, id_col, vector_col).filter(F.size("v") == dim), "asked")
    n = wanted.count()
    limits = base.mapInArrow(_bounds(dim), "d long, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    low, high = (np.array([r[c] for r in limits]) for c in ("low", "high"))
    step = np.maximum((high - low) / LEVELS, 1e-12)
    stored = scratch.written(base.mapInArrow(_store(scratch.path(spark, "va"), dim, low, step, block), "path string, n long"), "blocks")
    listed = [(r["path"], r["n"]) for r in stored.orderBy("path").collect()]  # one short row for each block
    tasks = max(-(-n // queries), min(n, spark.sparkContext.defaultParallelism), 1)
    return wanted.repartition(tasks, "vec_id").mapInArrow(_search(listed, dim, k, low, step, queries), "vec_id long, rank long, neighbor_id long, distance double")


def all_nearest(vectors: DataFrame, k: int = 10, **options) -> DataFrame:
    """`search` with every vector as a query: work that grows with the square of the table."""
    return search(vectors, vectors, k, **options)


#: The query set of the registered query: every vector whose id is divisible by this.
EVERY = 100
#: DuckDB SQL of the registered query over the table embeddings, for k = 10.
SQL = f"""
with pairs as (
  select a.vec_id, b.vec_id as neighbor_id, list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as d
  from (select * from embeddings where vec_id % {EVERY} = 0) a join embeddings b on a.vec_id <> b.vec_id
), ranked as (
  select *, row_number() over (partition by vec_id order by d, neighbor_id) as rank from pairs
)
select vec_id, rank, neighbor_id, round(d, 6) as distance from ranked where rank <= 10
"""
