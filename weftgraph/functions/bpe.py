"""Token counts, cuts and windows by a byte-level BPE vocabulary, given as the path of its ranks, in Arrow batches.

Without a vocabulary the expressions of `text` measure words or characters instead. What can't be encoded is measured so too.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(ranks: str) -> Any:
    """One encoder for each process and rank file; the file has to lie at the same path on every executor."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def windows(text: str | None, size: int, overlap: int, ranks: str) -> list[str]:
    """Windows of `size` tokens, each beginning `overlap` before the last one's end; a text of no more is one."""
    text = (text or "").strip()
    own = encoder(ranks)
    tokens = own.encode_ordinary(text)
    if len(tokens) <= size:
        return [text] if text else []
    step = max(1, size - max(0, min(overlap, size // 2)))
    starts = range(0, -(-(len(tokens) - size) // step) * step + 1, step)
    return [p for p in (own.decode(tokens[i : i + size]).strip() for i in starts) if p]


def count(text: str | None, ranks: str) -> int:
    return max(1, len(encoder(ranks).encode_ordinary(text))) if text else 0


def cut(text: str | None, most: int, ranks: str) -> str:
    """The first `most` tokens of a text; a sign that is cut in two becomes a replacement character."""
    if not text or most <= 0:
        return ""
    own = encoder(ranks)
    tokens = own.encode_ordinary(text)
    return text if max(1, len(tokens)) <= most else own.decode(tokens[:most])


def window_pieces(text: Column, size: int, overlap: int, ranks: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, size, overlap, ranks))

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(text)


def count_tokens(text: Column, ranks: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t, ranks)).astype("int32")

    return F.pandas_udf(run, T.IntegerType())(F.coalesce(text, F.lit("")))


def truncate_tokens(text: Column, most: Column, ranks: str) -> Column:
    def run(texts: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([cut(t, 0 if m is None or m != m else int(m), ranks) for t, m in zip(texts, limits)], dtype=object)

    return F.pandas_udf(run, T.StringType())(F.coalesce(text, F.lit("")), most)
