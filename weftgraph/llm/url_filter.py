"""Exact URL filters by a cascade of Bloom filters over the corpus's whole key universe.

Level 0 holds the listed keys. Level 1 holds the keys of the universe that level 0 lets through wrongly, level 2 the listed
keys that level 1 lets through, and so on, until a level lets nothing through wrongly. The first level that stops a key then
tells for certain whether it is listed. The levels are cut into shards by key hash, so that each stays small whatever the
list; a task reads the shards that its rows need from the shared folder. No row is joined to a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import scratch
from weftgraph.llm.textkernel import U, mix

BITS_PER_KEY, HASHES, SHARD_BITS, MAX_LEVELS = 10, 7, 1 << 27, 64
SPAM_HOSTS = "(casino|poker|pills|viagra|loan|xxx|porn|spam|adult)"


class Cascade(NamedTuple):
    """Where each level's words lie, how many shards there are, and for each level the bits of each shard."""

    paths: list[str]
    shards: int
    bits: list[dict[int, int]]


def url_key(url: Column) -> Column:
    """A URL without scheme, fragment and slashes at its end, the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "#.*$", ""), "/+$", "")
    return F.concat(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), F.regexp_replace(bare, "^[^/?]*", ""))


def host_key(url: Column) -> Column:
    """The host of a URL in lower case, without a port."""
    return F.regexp_replace(F.regexp_extract(url_key(url), "^[^/?]*", 0), ":[0-9]*$", "")


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, m: np.ndarray) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            yield mix(h1 + h2 * U(2 * (level * HASHES + i) + 1)) % m


_held: dict[tuple[str, int], np.ndarray] = {}


def _words(path: str, shard: int, bits: int) -> np.ndarray:
    """The words of one level's shard, from the shared folder; the process keeps the last ones."""
    if (path, shard) not in _held:
        while sum(x.nbytes for x in _held.values()) > 1 << 26:
            _held.pop(next(iter(_held)))
        system, where = fs.FileSystem.from_uri(f"{path}/shard={shard}")
        table = ds.dataset(where, filesystem=system, format="parquet").to_table(columns=["word", "bits"])
        full = np.zeros((bits + 63) // 64, U)
        full[table["word"].to_numpy()] = table["bits"].to_numpy().view(U)
        _held[path, shard] = full
    return _held[path, shard]


def _passes(h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, cascade: Cascade, level: int) -> np.ndarray:
    """Which keys a level lets through; one that holds nothing for a shard stops all of its keys."""
    out = np.zeros(len(h1), bool)
    for s in np.unique(shard):
        bits = cascade.bits[level].get(int(s), 0)
        if bits:
            at = np.flatnonzero(shard == s)
            words = _words(cascade.paths[level], int(s), bits)
            good = np.ones(len(at), bool)
            for p in _positions(h1[at], h2[at], level, U(bits)):
                good &= (words[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1
            out[at] = good
    return out


def _is_listed(h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, cascade: Cascade) -> np.ndarray:
    result, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for level in range(len(cascade.paths)):
        through = _passes(h1[open_], h2[open_], shard[open_], cascade, level)
        result[open_[~through]] = level % 2 == 1
        open_ = open_[through]
    result[open_] = len(cascade.paths) % 2 == 1
    return result


def _hashes(batch: pa.RecordBatch, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h1, h2 = (batch.column(at + i).to_numpy().view(U) for i in (0, 1))
    return h1, h2, batch.column(at + 2).to_numpy()


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    """Rows by shard, so that a task reads few; a single shard needs no shuffle."""
    return df if shards == 1 else df.repartition("shard").sortWithinPartitions("shard")


def _hashed(keys: DataFrame, shards: int) -> DataFrame:
    """Distinct keys as two 64-bit hashes and the shard that they fall in."""
    h = keys.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")).distinct()
    return h.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)).cast("int"))


def _set_bits(level: int, bits: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, shard = _hashes(batch)
            for s in np.unique(shard):
                at = shard == s
                p = np.unique(np.concatenate(list(_positions(h1[at], h2[at], level, U(bits[int(s)])))))
                word = (p >> U(6)).astype(np.int64)
                head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                value = np.bitwise_or.reduceat(U(1) << (p & U(63)), head)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), s, np.int32)), pa.array(word[head]), pa.array(value.view(np.int64))], names=["shard", "word", "bits"])

    return run


def build(listed: DataFrame, universe: DataFrame, *, shard_bits: int = SHARD_BITS) -> Cascade:
    """The cascade for `listed` that is exact for every key of `universe`; both have one string column `key`.

    Null keys are left out and repeated ones count once; an empty list gives a cascade without levels. What comes to the
    driver is one number for each shard of a level, a shard being `shard_bits` long.
    """
    spark = listed.sparkSession
    listed, universe = listed.filter("key is not null"), universe.filter("key is not null")
    shards = max(1, -(-listed.distinct().count() * BITS_PER_KEY // shard_bits))
    inside = scratch.written(_hashed(listed, shards), "listed")
    outside = scratch.written(_hashed(universe, shards).join(inside, ["h1", "h2", "shard"], "left_anti"), "unlisted")
    cascade = Cascade([], shards, [])
    held, tested = inside, outside
    for level in range(MAX_LEVELS):
        counts = {r["shard"]: r["count"] for r in held.groupBy("shard").count().collect()}
        if not counts:
            return cascade
        bits = {s: max(64, n * BITS_PER_KEY) for s, n in counts.items()}
        path = scratch.path(spark, f"bloom{level}")
        words = held.mapInArrow(_set_bits(level, bits), "shard int, word long, bits long").groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
        words.repartition("shard").write.partitionBy("shard").parquet(path)
        cascade.paths.append(path)
        cascade.bits.append(bits)

        def through(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_passes(*_hashes(batch), cascade, level)))

        wrong = scratch.written(_by_shard(tested, shards).mapInArrow(through, tested.schema), "through")
        held, tested = wrong, held
    raise ValueError(f"the cascade doesn't end within {MAX_LEVELS} levels; two keys may share both hashes")


def flag_urls(pages: DataFrame, cascade: Cascade, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host_listed, url_listed, listed) for each row: whether the page's host or URL key is on the list.

    Exact for pages of the universe that the cascade was built for. A null URL is on no list, an empty one only if the empty
    key is; repeated rows are flagged each; other columns are not read; URLs of any length are whole keys. An empty table gives
    an empty result.
    """
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    found = {"host_listed": host_key(F.col("url")), "url_listed": url_key(F.col("url"))}
    for name, key in found.items():
        hashed = keyed.select("*", F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))
        hashed = hashed.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 40), F.lit(cascade.shards)).cast("int"))
        n = len(keyed.columns)

        def run(batches: Iterator[pa.RecordBatch], n: int = n, name: str = name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(_is_listed(*_hashes(batch, n), cascade))], names=[*batch.schema.names[:n], name])

        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
        keyed = _by_shard(hashed, cascade.shards).mapInArrow(run, f"{types}, {name} boolean")
        keyed = keyed.withColumn(name, F.col(name) & F.col("url").isNotNull())
    return keyed.withColumn("listed", F.col("host_listed") | F.col("url_listed"))


def page_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The key universe of a corpus: every host and every URL key."""
    return pages.select(F.explode(F.array(host_key(F.col(url_col)), url_key(F.col(url_col)))).alias("key"))


def listed_keys(pages: DataFrame) -> DataFrame:
    """The list of the registered query: hosts that name a spam trade, and URLs that carry a referrer's tag."""
    url = F.col("url")
    hosts = pages.select(host_key(url).alias("key")).filter(F.col("key").rlike(SPAM_HOSTS))
    return hosts.union(pages.filter(F.col("url").rlike("[?&]ref=")).select(url_key(url).alias("key"))).distinct()


SQL = """
with bare as (
  select page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', ''), '/+$', '') as b from pages
), keyed as (
  select page_id, url, lower(regexp_extract(b, '^[^/?]*')) || regexp_replace(b, '^[^/?]*', '') as k from bare
), both_keys as (
  select page_id, url, k, regexp_replace(regexp_extract(k, '^[^/?]*'), ':[0-9]*$', '') as h from keyed
), list as (
  select h as key from both_keys where regexp_matches(h, '(casino|poker|pills|viagra|loan|xxx|porn|spam|adult)')
  union select k from both_keys where regexp_matches(url, '[?&]ref=')
)
select page_id, url, coalesce(h in (select key from list where key is not null), false) as host_listed,
  coalesce(k in (select key from list where key is not null), false) as url_listed,
  coalesce(h in (select key from list where key is not null), false) or coalesce(k in (select key from list where key is not null), false) as listed
from both_keys
"""
