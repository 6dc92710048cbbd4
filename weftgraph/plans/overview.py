"""Global search: every report of a level is read, points are taken from them, and an answer from the best points."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import budget
from weftgraph.functions.text import count_tokens, history_block, parse_json, truncate_tokens
from weftgraph.models import ask, with_answers
from weftgraph.operators.reports import select_level
from weftgraph.plans.local import Found, _meta

POINTS = "TASK: points\n{history}List what the reports say on the question as JSON: points (description, score from 0 to 100).\nQuestion: {query}\nTEXT:\n"
RELEVANCE = "TASK: relevance\nDoes this bear on the question? JSON: relevant, score from 0 to 100.\nQuestion: {query}\nTEXT:\n"
REDUCE = "TASK: answer\n{history}Answer from the points. {outside} Form: {form}\nQuestion: {query}\nTEXT:\n{points}"

#: Reports that are put into batches together.
TOGETHER = 4096


def _whole(value: Any) -> int:
    try:
        return int(value or 0)
    except (TypeError, ValueError):
        return 0


def select_dynamically(model: dict[str, DataFrame], query: str, llm: Any, threshold: int = 50) -> DataFrame:
    """Reports met on a walk down from the roots, the deepest relevant ones of each branch.

    One pass of joins for each level: a community is asked about if all above it are relevant or without a report; a relevant
    one without any relevant one below is chosen. An answer that can't be read counts as relevant.
    """
    reports = model["reports"]
    tree = model["communities"].select("id", "level", "parent")
    asked = reports.select(F.col("community_id").alias("id"), F.concat(F.lit(RELEVANCE.format(query=query)), F.col("title"), F.lit("\n"), F.coalesce("summary", F.lit(""))).alias("prompt"))
    judged = with_answers(asked, llm)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kept = []
            for answer in part["answer"]:
                try:
                    said = parse_json(answer or "")
                    kept.append(not isinstance(said, dict) or bool(said.get("relevant")) or _whole(said.get("score")) >= threshold)
                except ValueError:
                    kept.append(True)
            yield pd.DataFrame({"id": part["id"], "relevant": kept})

    judged = judged.select("id", "answer").mapInPandas(read, "id string, relevant boolean")
    nodes = tree.join(judged, "id", "left").persist()
    depth = nodes.agg(F.max("level")).first()[0]
    if depth is None:
        return select_level(reports, 0)
    reached = nodes.filter("parent is null and not (relevant <=> false)")
    open_, all_reached = reached, reached
    for _ in range(depth):
        open_ = nodes.join(open_.select(F.col("id").alias("parent")), "parent", "left_semi").filter("not (relevant <=> false)").select(*reached.columns)
        all_reached = all_reached.union(open_)
    # up again: a node is answered for if something at or below it was chosen
    chosen = all_reached.filter("1 = 0").select("id", "parent")
    answered = chosen
    for level in range(depth, -1, -1):
        here = all_reached.filter(F.col("level") == level)
        below = answered.select(F.col("parent").alias("id")).distinct()
        new = here.filter("relevant").join(below, "id", "left_anti").select("id", "parent")
        chosen = chosen.union(new)
        answered = answered.union(new).union(here.join(below, "id", "left_semi").select("id", "parent"))
    picked = reports.join(chosen.select(F.col("id").alias("community_id")).distinct(), "community_id", "left_semi")
    return select_level(reports, 0) if picked.isEmpty() else picked


def batches(reports: DataFrame, most: int, n: int, seed: int = 42) -> DataFrame:
    """Reports with a `batch`: in the order of a seeded hash, a batch ends before the report that would overfill it.

    Of n reports, some thousands at a time are numbered together, by ids and token counts alone; batches don't cross these.
    """
    shares = F.lit(-(-n // TOGETHER) or 1)
    mixed = F.xxhash64(F.lit(seed), "id")
    sized = reports.select("id", mixed.alias("place"), F.pmod(mixed, shares).alias("share"), count_tokens(F.concat_ws("\n", "title", "summary", "full_content")).alias("tokens"))
    listed = sized.groupBy("share").agg(F.array_sort(F.collect_list(F.struct("place", "id", "tokens"))).alias("r"))
    numbers = F.arrays_zip(F.col("r").alias("r"), budget.next_fit(F.transform("r", lambda x: x["tokens"]), most).alias("batch"))
    numbered = listed.select("share", F.explode(numbers).alias("x")).select("x.r.id", "x.r.place", "x.r.tokens", (F.col("share") * TOGETHER + F.col("x.batch")).cast("long").alias("batch"))
    return reports.join(numbered, "id")


def map_points(batched: DataFrame, query: str, llm: Any, most: int, history: str | None = None) -> DataFrame:
    """(batch, place, description, score): one call for each batch; where it fails, the titles and summaries themselves."""
    text = F.concat(F.lit("# "), "title", F.format_string("\nLevel %d\n", "level"), "summary", F.lit("\n"), "full_content")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", text.alias("x")))), lambda s: s["x"])
    plain = F.array_sort(F.collect_list(F.struct("place", "id", F.concat_ws(": ", "title", "summary").alias("description"), F.greatest(F.lit(1), F.col("rank").cast("int")).alias("score"))))
    joined = batched.groupBy("batch").agg(F.array_join(lines, "\n\n").alias("x"), plain.alias("plain"))
    asked = joined.select("batch", "plain", F.concat(F.lit(POINTS.format(history=history_block(history), query=query)), truncate_tokens(F.col("x"), most)).alias("prompt"))
    told = with_answers(asked, llm)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for batch, plain, answer in zip(part["batch"], part["plain"], part["answer"]):
                try:
                    said = parse_json(answer or "")
                    found = said.get("points") if isinstance(said, dict) else None
                    points = [(str(p.get("description") or "").strip(), _whole(p.get("score"))) for p in found or [] if isinstance(p, dict)]
                except (ValueError, TypeError):
                    points = [(p["description"], int(p["score"])) for p in plain]
                rows += [(batch, i, d, s) for i, (d, s) in enumerate(points) if d]
            yield pd.DataFrame(rows, columns=["batch", "place", "description", "score"])

    return told.select("batch", "plain", "answer").mapInPandas(read, "batch long, place int, description string, score int")


def global_search(
    model: dict[str, DataFrame], query: str, llm: Any, *, level: int | None = 0, map_batch_size: int = 2, top_points: int = 20, dynamic: bool = False, max_tokens: int = 8000, history: str | None = None, form: str = "paragraphs", outside_knowledge: bool = False
) -> Found:
    if llm is None:
        raise ValueError("global search needs a language model")
    if not (query or "").strip():
        raise ValueError("the question is empty")
    reports = (select_dynamically(model, query, llm) if dynamic else select_level(model["reports"], level)).persist()
    n = reports.count()
    if not n:
        raise ValueError("there are no community reports")
    size = budget.batch_size(max_tokens, n, map_batch_size)
    batched = batches(reports, size, n).persist()
    points = map_points(batched, query, llm, size, history).orderBy(F.desc("score"), "batch", "place").limit(top_points)
    points = points.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("score"), "batch", "place"))).persist()
    if points.isEmpty():
        raise ValueError("the reports gave no points on the question")
    lines = budget.pack(points.withColumn("text", F.format_string("- (%d) %s", "score", "description")), max(256, max_tokens // 2))
    block = "\n".join(r["packed"] for r in lines.orderBy("ord").collect())
    outside = "General knowledge may be added if it is marked." if outside_knowledge else "Add nothing from elsewhere."
    answer = ask(llm, REDUCE.format(history=history_block(history), outside=outside, form=form, query=query, points=block))
    first = reports.orderBy("ord", "id").first()
    documents = reports.select("ord", F.lit("community_report").alias("kind"), "id", F.col("full_content").alias("page_content"), "title", _meta(kind=F.lit("community_report"), id=F.col("id"), community_id=F.col("community_id"), level=F.col("level")))
    meta = {"mode": "global", "selection": "dynamic" if dynamic else f"level_{first['level']}", "community_level": first["level"], "reports_used": n, "map_batches": batched.agg(F.count_distinct("batch")).first()[0], "points": points.count()}
    return Found(block, documents, meta, answer)
