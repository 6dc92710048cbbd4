"""Byte-level BPE encoding and decoding, exact for texts of any length.

A text of more than `part_bytes` is cut where the pre-tokeniser always cuts, and its parts are encoded in parallel. What the
pre-tokeniser would leave in one piece is halved until it fits; halves are encoded as if alone and then concatenated in a
tree. At each join the tokens around it are re-encoded in growing windows until both outer tokens of the window are again
those of the sides: as every two neighbours in the result then stand as BPE would leave them, so does the whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.textkernel import blocks

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART_BYTES = 1 << 15


class Coder(NamedTuple):
    """An encoder with its vocabulary as one byte buffer, for vectorised decoding."""

    encoding: object
    data: np.ndarray
    offsets: np.ndarray


_coders: dict[tuple[str, str], Coder] = {}


def coder(ranks: str = RANKS, pattern: str = PATTERN) -> Coder:
    """The encoder for a rank file, loaded once for each Python process."""
    if (ranks, pattern) not in _coders:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        words = [b""] * (max(table.values()) + 1)
        for word, rank in table.items():
            words[rank] = word
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        _coders[ranks, pattern] = Coder(
            tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), np.frombuffer(b"".join(words), np.uint8), offsets
        )
    return _coders[ranks, pattern]


def decode_many(tokens: np.ndarray, own: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a run of tokens, and where each token's bytes begin, with the end last."""
    size = np.diff(own.offsets)[tokens]
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) + np.repeat(own.offsets[:-1][tokens] - begin[:-1], size)
    return own.data[at], begin


def join_encoded(left: list[int], right: list[int], own: Coder) -> list[int]:
    """The encoding of two unsplit byte strings in a row, from the encodings of each."""
    if not left or not right:
        return left + right
    k = 1
    while True:
        a, b = left[-k:], right[:k]
        window = list(own.encoding._encode_single_piece(own.encoding.decode_bytes(a + b)))
        if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
            return left[:-k] + window + right[k:]
        k *= 2


def tree_join(parts: list[list[int]], own: Coder) -> list[int]:
    """The encoding of unsplit byte strings in a row: neighbours are joined, then neighbours of these, up to one."""
    while len(parts) > 1:
        parts = [join_encoded(parts[i], parts[i + 1], own) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def cut_text(text: str, most: int, pattern: str = PATTERN) -> Iterator[tuple[bytes, bool | None]]:
    """Parts of at most `most` bytes; None marks the first half of an unsplit piece, True one that continues it.

    A part ends before white space that follows something else, where every pattern match ends, or at a match of its own. A
    single match that is longer is halved until it fits.
    """
    import regex

    held: list[str] = []
    size = 0

    def halve(piece: bytes) -> Iterator[bytes]:
        if len(piece) <= most:
            yield piece
        else:
            yield from halve(piece[: len(piece) // 2])
            yield from halve(piece[len(piece) // 2 :])

    for run in regex.finditer(r"\s*\S*", text):
        word = run.group()
        length = len(word.encode())
        if size + length > most and held:
            yield "".join(held).encode(), False
            held, size = [], 0
        if length <= most:
            held.append(word)
            size += length
            continue
        for match in regex.finditer(pattern, word):
            piece = match.group().encode()
            if size + len(piece) > most and held:
                # how white space splits depends on what follows it, so at an end it is a piece of its own
                white = []
                while held and held[-1].isspace():
                    white.append(held.pop().encode())
                if held:
                    yield "".join(held).encode(), False
                for blank in reversed(white):
                    yield blank, None
                held, size = [], 0
            if len(piece) <= most:
                held.append(match.group())
                size += len(piece)
            else:
                for i, half in enumerate(halve(piece)):
                    yield half, i > 0 or None
        if held:
            yield "".join(held).encode(), False
            held, size = [], 0
    if held:
        yield "".join(held).encode(), False


def encode_text(text: str, own: Coder, most: int = PART_BYTES, pattern: str = PATTERN) -> list[int]:
    """Encode one text by parts, as `encode` does it over a cluster."""
    tokens: list[int] = []
    tree: list[list[int]] = []
    for part, joins in cut_text(text, most, pattern):
        if joins is not True and tree:
            tokens += tree_join(tree, own)
            tree = []
        if joins is False:
            tokens += own.encoding.encode_ordinary(part.decode())
        else:
            tree.append(list(own.encoding._encode_single_piece(part)))
    return tokens + tree_join(tree, own)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode_any(text: str, own: Coder, pattern: str = PATTERN) -> np.ndarray:
    """One text on one task; a long unsplit run makes it go by parts, as the encoder's time grows faster than such a run."""
    if len(text) <= PART_BYTES // 4 or max(map(len, re.findall(r"\s+|\S+", text))) <= PART_BYTES // 4:
        return own.encoding.encode_to_numpy(text)
    return np.array(encode_text(text, own, PART_BYTES, pattern), np.uint32)


def _encode_short(ranks: str, pattern: str, count_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for batch in batches:
            valid = pc.is_valid(batch.column(1))
            for b in blocks(batch.column(1)):
                n = len(b.offsets) - 1
                texts = batch.column(1).slice(b.first, n).to_pylist()
                tokens = [encode_any(t, own, pattern) if t else np.zeros(0, np.uint32) for t in texts]
                size = pa.array(np.array([len(x) for x in tokens], np.int64))
                here = valid.slice(b.first, n)
                columns = [batch.column(0).slice(b.first, n), pc.if_else(here, size, pa.scalar(None, pa.int64()))]
                if not count_only:
                    flat = np.concatenate([*tokens, np.zeros(0, np.uint32)]).astype(np.int64)
                    text, begin = decode_many(flat, own)
                    ends = begin[np.concatenate([[0], np.cumsum([len(x) for x in tokens])])]
                    same = np.array_equal(ends, b.offsets) and np.array_equal(text, b.data)
                    good = np.full(n, True) if same else np.array([bytes(text[ends[i] : ends[i + 1]]) == (texts[i] or "").encode() for i in range(n)], bool)
                    lists = _lists(tokens)
                    if not pc.all(here).as_py():
                        lists = pc.if_else(here, lists, pa.scalar(None, lists.type))
                    columns += [lists, pc.if_else(here, pa.array(good), pa.scalar(None, pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "token_ids", "round_trip"][: len(columns)])

    return run


def _cut_long(most: int, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = list(cut_text(batch.column(2)[i].as_py(), most, pattern))
                row = pa.array(np.full(len(parts), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(row) for k in (0, 1)), pa.array(np.arange(len(parts))), pa.array([j for _, j in parts], pa.bool_()), pa.array([p for p, _ in parts], pa.binary())],
                    names=["doc_id", "key", "part", "joins", "bytes"],
                )

    return run


def _encode_parts(ranks: str, pattern: str) -> Callable:
    """Sorted by key and part; a part that is there again, as its row is repeated, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = coder(ranks, pattern), None
        for batch in batches:
            keep, tokens = [], []
            for i, (key, part, joins) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                if (key, part) != before:
                    before = (key, part)
                    piece = batch.column(4)[i].as_py()
                    keep.append(i)
                    tokens.append(own.encoding.encode_to_numpy(piece.decode()) if joins is False else np.array(own.encoding._encode_single_piece(piece), np.uint32))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, _lists(tokens)], names=[*batch.schema.names, "tokens"])

    return run


def _assemble(ranks: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens: list[int] = []
                tree: list[list[int]] = []
                row = batch.column(2)[i].as_py()
                for part in row:
                    if part["joins"] is not True and tree:
                        tokens += tree_join(tree, own)
                        tree = []
                    if part["joins"] is False:
                        tokens += part["tokens"]
                    else:
                        tree.append(part["tokens"])
                tokens += tree_join(tree, own)
                good = own.encoding.decode_bytes(tokens) == b"".join(part["bytes"] for part in row)
                done = [pa.array([len(tokens)], pa.int64()), _lists([np.array(tokens, np.uint32)]), pa.array([good])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *done], names=["doc_id", "key", "n_tokens", "token_ids", "round_trip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str = RANKS, pattern: str = PATTERN, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) for each row; round_trip says that decoding gave the text back.

    Only texts of more than `part_bytes` are shuffled, cut into parts before. A null text gives null tokens, an empty one an
    empty list; null ids stay null; repeated rows are encoded each. Other columns are not read; an empty table gives an empty
    result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > part_bytes, F.lit(False))
    short = base.filter(~is_long).mapInArrow(_encode_short(ranks, pattern, False), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")
    key = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")), F.hex(F.hash("text"))).alias("key")
    long = base.filter(is_long).select("doc_id", key, "text")
    repeated = long.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1")
    parts = (
        long.mapInArrow(_cut_long(part_bytes, pattern), "doc_id long, key string, part long, joins boolean, bytes binary")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part")
        .mapInArrow(_encode_parts(ranks, pattern), "doc_id long, key string, part long, joins boolean, bytes binary, tokens array<int>")
    )
    whole = (
        parts.groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_list(F.struct("part", "joins", "bytes", "tokens"))).alias("parts"))
        .mapInArrow(_assemble(ranks, pattern), "doc_id long, key string, n_tokens long, token_ids array<int>, round_trip boolean")
    )
    whole = whole.join(repeated, "key", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return short.union(whole.select("doc_id", "n_tokens", "token_ids", "round_trip"))


def count_tokens(docs: DataFrame, id_col: str, text_col: str, carried: list[str], *, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens), key a struct of the id and the carried columns: exact numbers of BPE tokens, without a shuffle.

    Long texts are encoded by parts within their task, so a piece without any split takes no more time than its length.
    """
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in carried]).alias("key")
    fed = docs.select(key, F.col(text_col).cast("string").alias("text"))
    run = _encode_short(ranks, pattern, True)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=["key", "n_tokens"])

    return fed.mapInArrow(counted, f"key {fed.schema['key'].dataType.simpleString()}, n_tokens long")


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "token_ids", *, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) of token lists. A null list gives null; bytes that are no UTF-8 become replacement characters.

    An empty list gives an empty text, an empty table an empty result; lists of any length are decoded whole, repeated rows
    each, null ids stay null, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                texts.append(None if row is None else decode_many(np.array(row, np.int64), own)[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")
