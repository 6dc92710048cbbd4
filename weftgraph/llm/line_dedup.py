"""Removal of repeated multi-line passages by content-defined chunks of lines.

A text is cut into logical lines: at line feeds and, within a line, after sentence ends, CJK ones too. `repeated_chunks` cuts
these into chunks that don't overlap, ended by a rolling hash over the last lines; a repeated passage of a few lines often holds
no whole chunk. `repeated_runs` therefore lets a chunk end at every line: from each line on, and up to each line, the shortest
run that is long enough is a candidate, whatever stands around it. Candidates that occur more than once in the whole corpus are
removed, all but the first occurrence, once their bytes have been compared. Together they cover every repeated passage of that
length, from its first whole line to its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import scratch
from weftgraph.llm.textkernel import U, Block, blocks, mix, prefix_sums, span_hash, words

WINDOW, DIVISOR, MAX_LINES, MIN_LINES, MIN_WORDS = 2, 2, 64, 2, 12
#: A run of so many words is long enough even if it is a single line.
LONG_WORDS = 50
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_FULL_STOPS = tuple("。！？".encode()[i : i + 3] for i in (0, 3, 6))


def word_begins(block: Block) -> np.ndarray:
    """Whether a word begins at each byte, CJK characters being words of their own."""
    begins = np.zeros(len(block.data), bool)
    begins[words(block).start] = True
    return begins


def logical_lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of each logical line; the lines of a row cover its bytes without a gap."""
    data, offsets = block.data, block.offsets
    n = len(data)
    ends = np.zeros(n + 1, bool)
    ends[1:] = data == 10
    stop = (data == 46) | (data == 33) | (data == 63)
    ends[2:] |= stop[:-1] & (data[1:] == 32)
    for a, b, c in _FULL_STOPS:
        ends[3:] |= (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    ends[offsets] = True
    at = np.flatnonzero(ends)
    start, end = at[:-1], at[1:]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def chunk_bounds(line: np.ndarray, row: np.ndarray, window: int, divisor: int, max_lines: int) -> np.ndarray:
    """Numbers of the lines that end a chunk, given the lines' hashes and rows.

    A line ends one if the rolling hash over it and the lines before it is 0 modulo the divisor, unless that would leave a
    chunk of one line; also the last of a row, and each max_lines-th of a chunk that grows longer.
    """
    n = len(line)
    roll = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for t in range(window - 1, -1, -1):
            earlier = np.zeros(n, U)
            earlier[t:] = np.where(row[t:] == row[: n - t], line[: n - t], U(0))
            roll = mix(roll * U(0x100000001B3) + earlier)
    last = np.ones(n, bool)
    last[:-1] = row[1:] != row[:-1]
    first = np.ones(n, bool)
    first[1:] = last[:-1]
    cut = roll % U(divisor) == 0
    run = cut.copy()
    run[1:] &= ~cut[:-1] | first[1:]
    place = np.arange(n)
    offset = place - np.maximum.accumulate(np.where(run, place, 0))
    cut &= offset % 2 == 0
    cut |= last
    head = np.ones(n, bool)
    head[1:] = cut[:-1]
    inside = place - np.maximum.accumulate(np.where(head, place, 0))
    cut |= inside % max_lines == max_lines - 1
    return np.flatnonzero(cut)


def pack(begin: np.ndarray, stop: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A span as one number that sorts by its begin; `end` is `stop` or, after white space, one more."""
    return begin << 32 | stop << 1 | end - stop


#: The same in SQL.
BEGIN, STOP = "cast(shiftright(span, 32) as int)", "cast(shiftright(span & 4294967295, 1) as int)"
SPANS = "doc_id long, th long, span long, h long"


def _lines(b: Block) -> tuple[np.ndarray, ...]:
    """Row, begin, end without white space, end and words before each line, the last with one more for the end of all."""
    row, start, end = logical_lines(b)
    seen = np.concatenate([[0], np.cumsum(word_begins(b))])
    return row, start, end - _SPACE[b.data][end - 1], end, seen[np.append(start, len(b.data))]


def _chunks(window: int, divisor: int, max_lines: int, min_lines: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                if not len(b.data):
                    continue
                row, start, trimmed, end, seen = _lines(b)
                prefix = prefix_sums(b.data)
                last = chunk_bounds(span_hash(prefix, start, trimmed), row, window, divisor, max_lines)
                first = np.concatenate([[0], last[:-1] + 1])
                good = (last - first + 1 >= min_lines) & (seen[last + 1] - seen[first] >= min_words)
                yield _found(batch, b, prefix, row, start, trimmed, end, first[good], last[good])

    return run


def _found(batch: pa.RecordBatch, b: Block, prefix: np.ndarray, row: np.ndarray, start: np.ndarray, trimmed: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    s, e, r = start[first], trimmed[last], row[first]
    index, begin = pa.array(r + b.first), b.offsets[r]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(index), batch.column(1).take(index), pa.array(pack(s - begin, e - begin, end[last] - begin)), pa.array(span_hash(prefix, s, e).view(np.int64))], names=["doc_id", "th", "span", "h"]
    )


def _later(spans: DataFrame, base: DataFrame) -> DataFrame:
    """Later occurrences of spans (doc_id, th, span, h): (doc_id, th, begin, end, first_id).

    Hashes are counted over the whole corpus by partial sums; bytes are read for those alone that occur again. The first of
    equal bytes is found by partial minima too, and the others are joined to it by hash, a join that Spark splits where one hash
    is hot; so no task holds all occurrences of a passage.
    """
    spans = scratch.written(spans, "spans")
    twice = spans.groupBy("h").count().filter("count > 1").select("h")
    again = spans.join(twice, "h", "left_semi").groupBy("doc_id", "th").agg(F.collect_set(F.struct("span", "h")).alias("spans"))
    again = scratch.written(again, "again", free=True)
    scratch.drop(spans)
    a, t = again.alias("a"), base.select("doc_id", "th", F.col("text").cast("binary").alias("data")).alias("t")
    read = a.join(t, F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a.th") == F.col("t.th"))).select("a.doc_id", "a.th", "data", F.explode("spans").alias("s"))
    read = read.select("doc_id", "th", "s.span", "s.h", "data").select("doc_id", "th", "span", "h", F.expr(f"substring(data, {BEGIN} + 1, {STOP} - {BEGIN})").alias("bytes"))
    read = scratch.written(read, "bytes", free=True)
    firsts = read.groupBy("h", "bytes").agg(F.min(F.struct("doc_id", "th", "span")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = read.join(firsts.select("h", F.col("bytes").alias("first_bytes"), "first"), "h")
    later = later.filter("bytes = first_bytes and not (doc_id <=> first.doc_id and th = first.th and span = first.span)")
    later = scratch.written(later.selectExpr("doc_id", "th", f"{BEGIN} as begin", f"{STOP} + cast(span & 1 as int) as end", "first.doc_id as first_id"), "later", free=True)
    scratch.drop(again, read)
    return later


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return base.select("doc_id", F.xxhash64("text").alias("th"), "text")


def repeated_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, divisor: int = DIVISOR, max_lines: int = MAX_LINES, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS
) -> DataFrame:
    """Later occurrences of chunks: (doc_id, th, begin, end, first_id), byte positions in the UTF-8 text.

    th is a hash of the text, which tells rows of one id but different texts apart. The first occurrence is that of the least
    id, then th, then position. Chunks of fewer lines or words than asked for are never reported. Rows equal in id and text
    count as one. Null and empty texts have no chunks; null ids come first in the order.
    """
    base = _base(docs, id_col, text_col)
    return _later(base.mapInArrow(_chunks(window, divisor, max_lines, min_lines, min_words), SPANS), base)


def run_bounds(before: np.ndarray, row: np.ndarray, min_lines: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the shortest runs from each line on and up to each line, each run once.

    `before` holds the words before each line, and all of them at its end. A run has `min_lines` lines and `min_words` words, or
    `long_words` words, and lies within a row.
    """
    n = len(row)
    line = np.arange(n)
    last = np.maximum(np.searchsorted(before, before[:-1] + min_words) - 1, line + min_lines - 1)
    last = np.maximum(np.minimum(last, np.searchsorted(before, before[:-1] + long_words) - 1), line)
    fits = (last < n) & (row[np.minimum(last, n - 1)] == row)
    first = np.minimum(np.searchsorted(before, before[1:] - min_words, "right") - 1, line - min_lines + 1)
    first = np.minimum(np.maximum(first, np.searchsorted(before, before[1:] - long_words, "right") - 1), line)
    back = (first >= 0) & (row[np.maximum(first, 0)] == row)
    back &= ~(fits[first] & (last[first] == line))
    return np.concatenate([line[fits], first[back]]), np.concatenate([last[fits], line[back]])


def _runs(min_lines: int, min_words: int, long_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                if len(b.data):
                    row, start, trimmed, end, seen = _lines(b)
                    first, last = run_bounds(seen, row, min_lines, min_words, long_words)
                    yield _found(batch, b, prefix_sums(b.data), row, start, trimmed, end, first, last)

    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """Later occurrences of runs of lines, which may overlap: (doc_id, th, begin, end, first_id), as in `repeated_chunks`.

    Runs have `min_lines` lines and `min_words` words, or `long_words` words. All lines of a repeated passage that is such a run
    are covered, whatever stands before and after it. Hashes choose the runs whose bytes are then read and compared.
    """
    base = _base(docs, id_col, text_col)
    return _later(base.mapInArrow(_runs(min_lines, min_words, long_words), SPANS), base)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column is the text, the second and third the begins and ends to cut out, or null."""
    for batch in batches:
        texts, begins, ends = batch.column(0), batch.column(1), batch.column(2)
        done, left, gone, spans = [], [], [], []
        for b in blocks(texts):
            n = len(b.offsets) - 1
            own = begins.slice(b.first, n)
            keep = np.ones(len(b.data), bool)
            if own.null_count < n:
                count = np.nan_to_num(pa.compute.list_value_length(own).to_numpy(zero_copy_only=False)).astype(np.int64)
                base = np.repeat(b.offsets[:-1], count)
                mark = np.zeros(len(b.data) + 1, np.int32)
                np.add.at(mark, base + own.flatten().to_numpy(), 1)
                np.add.at(mark, base + ends.slice(b.first, n).flatten().to_numpy(), -1)
                keep = np.cumsum(mark[:-1]) <= 0
            space = _SPACE[b.data]
            begin_word = ~space
            begin_word[1:] &= space[:-1]
            begin_word[b.offsets[:-1][b.offsets[:-1] < len(b.data)]] = True
            begin_word &= ~space
            head = ~keep
            head[1:] &= keep[:-1]
            inner = b.offsets[:-1][b.offsets[:-1] < len(b.data)]
            head[inner] = ~keep[inner]
            for made, marks in ((left, begin_word & keep), (gone, word_begins(b) & ~keep), (spans, head)):
                made.append(np.diff(np.concatenate([[0], np.cumsum(marks)])[b.offsets]))
            kept = np.concatenate([[0], np.cumsum(keep)])[b.offsets]
            done.append(pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b.data[keep]))]).cast(pa.string()))
        text = pa.concat_arrays(done) if done else pa.array([], pa.string())
        if texts.null_count:
            text = pa.compute.if_else(pa.compute.is_valid(texts), text, pa.scalar(None, pa.string()))
        counts = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (left, gone, spans)]
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([text, *counts], names=["text", "words", "gone", "spans"]), *batch.columns[3:]], names=["cut", *batch.schema.names[3:]])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length_col: str | None = None, report: bool = False, **least: int) -> DataFrame:
    """`docs` with repeated runs of lines cut out of the texts, whole rows and all other columns kept.

    A document is dropped only if nothing but white space is left, so no text is lost that stands nowhere else. `length_col` is
    set to the new number of characters. With `report`, the result is instead (doc_id, text, removed_chunks, removed_words,
    first_ids) for every document, dropped ones having a null text; first_ids lists the documents that hold the first
    occurrences, and removed_chunks counts passages without a gap. `least` are the lengths that `repeated_runs` takes.

    Null and empty texts stay as they are; so do rows that are equal in id and text to one another, which count as one
    document. Any other columns, whatever their names, pass through. An empty table gives an empty result.
    """
    gone = repeated_runs(docs, id_col, text_col, **least)
    gone = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.sort_array(F.collect_set("first_id")).alias("first_ids"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), "th", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"), "first_ids")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row").getField(text_col)
    joined = row.join(gone, F.col("row").getField(id_col).cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text.cast("string")) == F.col("th")), "left")
    plain = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col("row").getField(c).alias(c) for c in plain]).alias("rest")
    fed = joined.select(text.cast("string").alias("text"), "begins", "ends", rest, "first_ids")
    kept_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fed.schema.fields[4:])
    rest_type = fed.schema["rest"].dataType.simpleString()
    cut = fed.mapInArrow(_cut, f"cut struct<text: string, words: bigint, gone: bigint, spans: bigint>, rest {rest_type}, {kept_types}")
    new = F.col("cut.text")
    drop = (F.col("cut.spans") > 0) & (F.col("cut.words") == 0)
    if report:
        return cut.select(
            F.col("rest").getField(id_col).cast("long").alias("doc_id"),
            F.when(~drop, new).alias("text"),
            F.col("cut.spans").alias("removed_chunks"),
            F.col("cut.gone").alias("removed_words"),
            F.coalesce("first_ids", F.array().cast("array<bigint>")).alias("first_ids"),
        )
    made = {text_col: new.cast(docs.schema[text_col].dataType)}
    if length_col and length_col in docs.columns:
        made[length_col] = F.length(new).cast(docs.schema[length_col].dataType)
    return cut.filter(~drop).select(*[made.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])
