"""Text expressions: keys, tokens, phrases, prompts' pieces and parsers of model output."""

from __future__ import annotations

import json
import re
from collections import Counter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import bpe

CJK = r"[一-鿿]"
STOP_CJK = (
    "一个 一些 不是 什么 今天 他们 以及 但是 你们 关于 其中 其他 可以 可能 因为 如何 如果 它们 已经 应该 怎么 情况 "
    "我们 或者 所以 方面 时候 没有 然后 现在 目前 能够 自己 这个 这些 这样 进行 通过 那个 那些 那样 问题 需要"
).split()
STOP_ENGLISH = (
    "about also and are been being could for from had has have into just more most not only ours should such than that the "
    "their them then there these this those use used using via was were what when where which will with would your"
).split()
_PATTERNS = tuple(map(re.compile, (CJK + "{2,8}", r"\b(?:[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)+)\b", r"\b[A-Za-z][A-Za-z0-9_\-]{3,}\b")))
_STOP_CJK, _STOP_ENGLISH = frozenset(STOP_CJK), frozenset(STOP_ENGLISH)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def norm_title(title: Column) -> Column:
    """The key that titles are joined by: no white space, case folded."""
    return fold(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", ""))


def digest(text: Column, length: int, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text.cast("binary")), 1, length))


def unit_id(document_id: Column, chunk_index: Column, text: Column) -> Column:
    return digest(F.concat_ws("|", document_id, chunk_index.cast("string"), F.substring(text, 1, 64)), 12, "tu_")


def stable_document_id(text: Column, *given: Column) -> Column:
    """The first id that isn't blank, else one made from the text."""
    return F.coalesce(*[F.nullif(strip(g.cast("string")), F.lit("")) for g in given], digest(text, 16, "tu_"))


def entity_id(title: Column, kind: Column | None = None) -> Column:
    """From the normalised title alone, or with the type for entities that a model extracted."""
    key = norm_title(title)
    return digest(key if kind is None else F.concat(key, F.lit("|"), fold(strip(kind))), 16, "ent_")


def relation_id(a: Column, b: Column, separator: str = "|") -> Column:
    """The same for either direction."""
    a, b = norm_title(a), norm_title(b)
    return digest(F.concat(F.least(a, b), F.lit(separator), F.greatest(a, b)), 16, "rel_")


def claim_id(subject: Column, description: Column) -> Column:
    return digest(F.concat(fold(strip(subject)), F.lit("|"), fold(strip(description))), 16, "cov_")


def count_tokens(text: Column, tokenizer: str | None = None) -> Column:
    """BPE tokens by the ranks at `tokenizer`, else characters where a quarter of the text or more is CJK, else words.

    1 at least, 0 for an empty text.
    """
    if tokenizer:
        return bpe.count_tokens(text, tokenizer)
    n = F.length(text)
    cjk = n - F.length(F.regexp_replace(text, CJK, ""))
    word = F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(cjk >= F.greatest(F.lit(1), F.floor(n / 4)), n).otherwise(F.greatest(F.lit(1), word)).cast("int")


def truncate_tokens(text: Column, most: Column | int, tokenizer: str | None = None) -> Column:
    """The first `most` BPE tokens, or as much of the text as `most` tokens are of all of its tokens, by characters."""
    most = F.lit(most) if isinstance(most, int) else most
    if tokenizer:
        return F.when(most <= 0, "").otherwise(bpe.truncate_tokens(text, most, tokenizer))
    count = count_tokens(text)
    kept = F.greatest(F.lit(1), F.floor(F.length(text) * most / count).cast("int"))
    return F.when(most <= 0, "").when(count <= most, text).otherwise(F.substring(text, F.lit(1), kept))


def window_pieces(text: Column, size: int, overlap: int, most: int | None = None, tokenizer: str | None = None) -> Column:
    """Windows of `size` characters or BPE tokens of a stripped text, each beginning `overlap` before the last one's end.

    `most` windows, if that is given; else the whole text is covered.
    """
    size = max(64, size)
    if tokenizer:
        pieces = bpe.window_pieces(text, size, overlap, tokenizer)
        return F.slice(pieces, 1, most) if most else pieces
    step = max(1, size - max(0, min(overlap, size // 2)))
    n = F.length(text)
    last = F.ceil((n - size) / F.lit(step)).cast("int")
    last = F.least(last, F.lit(most - 1)) if most else last
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(F.filter(cut, lambda p: p != ""))


def phrases_of(text: str | None, most: int = 40) -> list[str]:
    """Candidate names of one text, the most frequent first, then longer ones, then earlier ones.

    CJK runs and single words that are stop words are left out. Of phrases with one normalised form the first counts.
    """
    cjk, several, single = (p.findall(text or "") for p in _PATTERNS)
    found = [p for p in cjk if p not in _STOP_CJK] + several + [p for p in single if p.lower() not in _STOP_ENGLISH]
    out: dict[str, str] = {}
    for phrase, _ in sorted(Counter(found).items(), key=lambda x: (-x[1], -len(x[0]))):
        key = "".join(phrase.split()).lower().replace("ß", "ss")
        if key and len(out) < most:
            out.setdefault(key, phrase)
    return list(out.values())


def noun_phrases(text: Column, most: int = 40) -> Column:
    """`phrases_of` for each row, by Arrow batches: as higher-order functions this is quadratic, as a join it shuffles the text."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: phrases_of(t, most))

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(F.coalesce(text, F.lit("")))


def keywords(text: Column, most: int = 12) -> Column:
    """Distinct words of two characters or more, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w{2,}"), F.lit(0))), 1, most)


def snippet(text: Column, length: int) -> Column:
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def safe_int(value: Column, default: int) -> Column:
    """A whole number; null, unreadable or 0 give the default."""
    number = F.expr("1").isNull() if value is None else F.nullif(value.try_cast("double").cast("int"), F.lit(0))
    return F.coalesce(number, F.lit(default))


def claim_status(status: Column) -> Column:
    known = F.upper(strip(F.coalesce(status, F.lit(""))))
    return F.when(known.isin("TRUE", "FALSE", "SUSPECTED"), known).otherwise("TRUE")


def strip_thinking(text: Column) -> Column:
    """Model output without its reasoning blocks."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<thinking>.*?</thinking>", ""))


def json_candidate(text: Column) -> Column:
    """The part of a model's output that is JSON: a fenced block, all, the outermost object or the outermost list."""
    raw = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    raw = F.when(fenced != "", strip(fenced)).otherwise(raw)
    tries = [raw, F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.regexp_extract(raw, r"(?s)\[.*\]", 0)]
    return F.coalesce(*[F.when((t != "") & F.try_parse_json(t).isNotNull(), t) for t in tries])


def parse_json(text: str) -> Any:
    """The same for one string on the driver; ValueError if nothing in it is JSON."""
    raw = (text or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S)
    raw = fenced.group(1).strip() if fenced else raw
    for found in (raw, *(m.group(0) for p in (r"\{.*\}", r"\[.*\]") if (m := re.search(p, raw, re.S)))):
        try:
            return json.loads(found)
        except json.JSONDecodeError:
            continue
    raise ValueError("the model's output holds no JSON")


def parse_report(text: Column) -> tuple[Column, Column]:
    """Title and body of a written report: a line  Title: …, then  Report: …  with the lines after it."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), strip), lambda x: x != "")
    head, start = r"(?i)^(?:标题|title)\s*[：:]", r"(?i)^(?:报告|report)\s*[：:]"
    titles = F.filter(lines, lambda x: x.rlike(head))
    title = strip(F.regexp_replace(F.element_at(titles, -1), head, ""))
    begin = F.array_position(F.transform(lines, lambda x: F.when(x.rlike(start), 1).otherwise(0)), 1)
    first_title = F.array_position(F.transform(lines, lambda x: F.when(x.rlike(head), 1).otherwise(0)), 1)
    # lines between a title and the word that opens the body belong to neither
    body = F.filter(lines, lambda x, i: ~x.rlike(head) & ((first_title == 0) | (i + 1 < first_title) | ((begin > 0) & (i + 1 >= begin))))
    body = F.filter(F.transform(body, lambda x: strip(F.regexp_replace(x, start, ""))), lambda x: x != "")
    full = F.array_join(body, "\n")
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Community report")), F.when(full == "", strip(F.coalesce(text, F.lit("")))).otherwise(full)


def entity_line(title: Column, kind: Column, description: Column, rank: Column | None = None) -> Column:
    if rank is None:
        return F.format_string("- %s (%s): %s", title, kind, description)
    return F.format_string("- %s (%s, rank=%.1f): %s", title, kind, rank, description)


def relation_line(source: Column, target: Column, description: Column) -> Column:
    return F.format_string("- %s -> %s: %s", source, target, description)


def claim_line(status: Column, subject: Column, description: Column, start: Column, end: Column) -> Column:
    dates = F.when((F.coalesce(start, F.lit("")) != "") | (F.coalesce(end, F.lit("")) != ""), F.format_string(" (%s~%s)", start, end)).otherwise("")
    return F.concat(F.format_string("- [%s] %s: %s", status, subject, description), dates)


def unit_line(unit: Column, title: Column, entities: Column, text: Column) -> Column:
    named = F.when(F.size(entities) > 0, F.concat(F.lit("; entities: "), F.array_join(entities, ", "))).otherwise("")
    return F.concat(F.lit("["), unit, F.lit("] document="), title, named, F.lit("\n"), text)


def history_block(history: str | None) -> str:
    told = (history or "").strip()
    return f"Conversation so far:\n{told}\n\n" if told else ""


def history_of(turns: DataFrame) -> DataFrame:
    """(conv_id, block) for each conversation: its turns in order, each as role and text, under the heading of a history."""
    line = F.concat_ws(": ", F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return told.select("conv_id", F.concat(F.lit("Conversation so far:\n"), strip(F.array_join(F.transform("t", lambda x: x["line"]), "\n")), F.lit("\n\n")).alias("block"))
