"""Iterative search: reports give a first answer and questions, local searches pursue these, round by round."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import history_block, norm_title, parse_json
from weftgraph.models import ask, embed_missing
from weftgraph.operators.vectors import search_or_exact
from weftgraph.plans.local import Found, _meta, local_search
from weftgraph.sources.store import Store, report_text

PRIMER = "TASK: primer\n{history}Answer from the reports as JSON: answer, confidence from 0 to 100, follow_ups (question, score). Form: {form}\nQuestion: {query}\nTEXT:\n{reports}"
REFINE = "TASK: refine\nHow sure is this answer, and what should be asked next? JSON: confidence, follow_ups (question, score).\nQuestion: {query}\nFollow-up: {question}\nTEXT:\n{answer}"
#: What is asked with when a primer can't be read, or has no questions, and how sure an unread primer is.
AGAIN, ALONE, UNSURE = 80, 70, 40
REDUCE = "TASK: answer\n{history}Put these findings together. Form: {form}\nQuestion: {query}\nTEXT:\n{findings}"


def safe_score(value: Any, default: int = 50) -> int:
    try:
        return int(value or default)
    except (TypeError, ValueError):
        return default


def follow_ups(payload: Any, default: int = 50) -> list[dict[str, Any]]:
    """Questions and scores of a model's answer, without blank ones."""
    found = payload.get("follow_ups") if isinstance(payload, dict) else None
    rows = [f for f in found or [] if isinstance(f, dict)] if isinstance(found, list) else []
    return [{"question": str(f.get("question") or "").strip(), "score": safe_score(f.get("score"), default)} for f in rows if str(f.get("question") or "").strip()]


def next_questions(found: DataFrame, most: int, least_score: int) -> DataFrame:
    """Of questions (question, score, ord): those that score enough, the best of each wording, at most `most`."""
    best = Window.partitionBy(norm_title(F.col("question"))).orderBy(F.desc("score"), "ord")
    rows = found.filter(F.col("score") >= least_score).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return rows.orderBy(F.desc("score"), "ord").limit(max(1, most))


def distinct_documents(parts: list[DataFrame]) -> DataFrame:
    """The records of all searches, the first of each id."""
    rows = None
    for i, part in enumerate(parts):
        part = part.select(F.lit(i).alias("round"), *part.columns)
        rows = part if rows is None else rows.unionByName(part)
    first = F.row_number().over(Window.partitionBy("id").orderBy("round", "ord"))
    rows = rows.withColumn("_n", first).filter("_n = 1 or coalesce(id, '') = ''").drop("_n")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("round", "ord"))).drop("round")


def drift_search(
    store: Store, query: str, embedder: Any, llm: Any, *, depth: int = 2, top_reports: int = 5, max_follow_ups: int = 3, least_score: int = 40, history: str | None = None, form: str = "paragraphs", **local: Any
) -> Found:
    if llm is None or embedder is None:
        raise ValueError("iterative search needs a language model and an embedder")
    spark, model = store.spark, store.load()
    if model["reports"].isEmpty():
        raise ValueError("there are no community reports")
    reports = embed_missing(model["reports"], embedder, report_text(), "embedding")
    hits, how = search_or_exact(store.index("reports"), reports, embedder.embed_query(query), max(1, top_reports), metric=store.handle.metric)
    chosen = reports.join(hits, "id").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "ord", "id"))).orderBy("place").persist()
    rows = chosen.collect()  # a handful
    told = "\n\n".join(f"### {r['title']}\nSummary: {r['summary']}\n{r['full_content']}" for r in rows)
    raw = ask(llm, PRIMER.format(history=history_block(history), form=form, query=query, reports=told))
    try:
        primer = parse_json(raw)
    except ValueError:  # the answer as it is, and the question itself once more
        primer = {"answer": raw, "confidence": UNSURE, "follow_ups": [{"question": query, "score": AGAIN}]}
    primer = primer if isinstance(primer, dict) else {}
    asked = follow_ups(primer) or [{"question": query, "score": ALONE}]
    nodes = [{"phase": "primer", "answer": str(primer.get("answer") or raw).strip(), "confidence": safe_score(primer.get("confidence")), "follow_ups": asked}]
    parts = [chosen.select(F.col("place").alias("ord"), F.lit("community_report").alias("kind"), "id", F.coalesce(F.nullif("summary", F.lit("")), "full_content").alias("page_content"), "title", _meta(kind=F.lit("community_report"), id=F.col("id"), community_id=F.col("community_id"), level=F.col("level")))]
    for d in range(max(0, depth)):
        given = spark.createDataFrame([(q["question"], q["score"], i) for i, q in enumerate(asked)], "question string, score int, ord int")
        queue = next_questions(given, max_follow_ups, least_score).collect()
        asked = []
        for one in queue:
            found = local_search(store, one["question"], embedder, llm, history=history, form="short points", **local)
            parts.append(found.documents)
            try:
                refined = parse_json(ask(llm, REFINE.format(query=query, question=one["question"], answer=found.answer)))
            except ValueError:
                refined = {}
            said = refined.get("confidence") if isinstance(refined, dict) else None
            nodes.append({"phase": f"follow_up_{d + 1}", "question": one["question"], "score": one["score"], "answer": found.answer, "confidence": safe_score(said or found.meta["entities"])})
            asked += [q for q in follow_ups(refined) if q["score"] >= least_score]
        if not asked:
            break
    findings = "\n\n---\n\n".join(f"[{n['phase']}|{n.get('question', query)}|confidence={n['confidence']}]\n{n['answer']}" for n in nodes)
    answer = ask(llm, REDUCE.format(history=history_block(history), form=form, query=query, findings=findings))
    meta = {"mode": "drift", "primer_reports": len(rows), "report_ranking": how, "hierarchy": nodes, "hierarchy_nodes": len(nodes), "avg_confidence": round(sum(n["confidence"] for n in nodes) / len(nodes), 2)}
    return Found(findings, distinct_documents(parts), meta, answer)
