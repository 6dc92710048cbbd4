"""Local search: a question to the entities, relationships, reports and texts that bear on it."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import budget
from weftgraph.functions.text import claim_line, entity_line, history_block, relation_line, unit_line
from weftgraph.lineage import cut
from weftgraph.models import ask, embed_missing
from weftgraph.operators import provenance, subgraph
from weftgraph.operators.vectors import exact_top, search_or_exact
from weftgraph.sources.store import Store, entity_text

ANSWER = "TASK: answer\n{history}Answer the question from the context alone, naming the text units in brackets. Form: {form}\nQuestion: {query}\nTEXT:\n{context}"


class Found(NamedTuple):
    """A context, the records it is made of as (ord, kind, id, page_content, title, metadata), and facts about the search."""

    context: str
    documents: DataFrame
    meta: dict[str, Any]
    answer: str | None = None


def _meta(**told: F.Column) -> F.Column:
    """What a record tells besides its text; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in told.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metadata")


def _numbered(rows: DataFrame, *order: Any) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def _block(rows: DataFrame, line: F.Column, heading: str) -> str | None:
    """Few rows, each one a line, under a heading; None if there are none."""
    lines = [r[0] for r in rows.orderBy("place").select(line).collect()]
    return "\n".join([heading, *lines]) if lines else None


def _packed(spark: Any, items: list[str], tokens: int) -> str:
    if not items:
        return ""
    rows = spark.createDataFrame(list(enumerate(items)), "ord int, text string")
    return "\n\n".join(r["packed"] for r in budget.pack(rows, tokens).orderBy("ord").select("packed").collect())


def local_context(
    model: dict[str, DataFrame],
    query: str,
    embedder: Any,
    *,
    top_entities: int = 8,
    top_relationships: int = 12,
    top_units: int = 6,
    top_claims: int = 12,
    community_share: float = 0.25,
    text_share: float = 0.5,
    max_tokens: int = 8000,
    seeds: list[str] | None = None,
    ranking: str = "exact",
    query_vector: list[float] | None = None,
) -> Found:
    """Rank what is near to the question and pack it into a token budget.

    `seeds` are entity ids in order, from a vector index; without any the entities are ranked exactly. Every limit here is a
    small number, so only the chosen rows are gathered.
    """
    spark = model["entities"].sparkSession
    share = budget.allocate(max_tokens, text_share, community_share)
    vector = query_vector if query_vector is not None else embedder.embed_query(query)
    entities = model["entities"]
    chosen = None
    if seeds:
        order = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("id"))
        chosen = _numbered(subgraph.by_ids(entities, seeds), order)
        if chosen.isEmpty():
            chosen, ranking = None, "exact"
    if chosen is None:
        full = embed_missing(entities, embedder, entity_text(), "description_embedding")
        chosen = _numbered(exact_top(full, vector, top_entities, vector="description_embedding", tie=(F.desc("rank"), "ord", "id")), F.desc("score"), F.desc("rank"), "ord", "id")
    chosen = cut(chosen)  # a few rows, which everything else begins with
    if chosen.isEmpty():
        raise ValueError("no entity matches the question")
    ids = [r["id"] for r in chosen.orderBy("place").select("id").collect()]
    heaviest = (F.desc("weight"), F.desc("rank"), "ord", "id")
    relations = cut(_numbered(subgraph.touching(model["relationships"], chosen).orderBy(*heaviest).limit(top_relationships), *heaviest))
    near = _numbered(subgraph.neighbours(entities, relations, chosen).orderBy(F.desc("rank"), "ord", "id").limit(top_entities), F.desc("rank"), "ord", "id")
    held = chosen.select(F.explode("community_ids").alias("community_id")).distinct()
    reports = cut(_numbered(model["reports"].join(held, "community_id", "left_semi"), F.desc("rank"), "ord", "id"))
    unit_ids = chosen.select(F.explode("text_unit_ids").alias("id")).union(relations.select(F.explode("text_unit_ids"))).distinct()
    units = embed_missing(model["chunks"].join(unit_ids, "id", "left_semi"), embedder, F.col("text"), "embedding")
    units = cut(_numbered(exact_top(units, vector, top_units, tie=("unit_ord", "id")), F.desc("score"), "unit_ord", "id"))
    claims = _numbered(model["covariates"].join(chosen.select(F.col("norm_title").alias("norm_subject")), "norm_subject", "left_semi").orderBy("ord", "id").limit(top_claims), "ord", "id")
    col = F.col
    graph = [
        _block(chosen, entity_line(col("title"), col("type"), col("description"), col("rank")), "Entities"),
        _block(near, entity_line(col("title"), col("type"), col("description")), "Neighbouring entities"),
        _block(relations, relation_line(col("source"), col("target"), col("description")), "Relationships"),
        _block(claims, claim_line(*[col(c) for c in ("status", "subject", "description", "start_date", "end_date")]), "Claims"),
    ]
    # reports have no limit of their own, so they are packed before any of them is gathered
    told = reports.select("place", F.concat(F.lit("### "), "title", F.lit("\n"), "summary", F.lit("\n"), "full_content").alias("text"))
    packed_reports = "\n\n".join(r["packed"] for r in budget.pack(told, share["community_reports"], order=("place",)).orderBy("place").select("packed").collect())
    titled = provenance.titled(units.drop("document_title"), model["documents"])
    names = entities.select(col("id").alias("entity_id"), col("title").alias("entity_title"))
    own = titled.select("id", F.posexplode(F.slice("entity_ids", 1, 6)).alias("p", "entity_id")).join(names, "entity_id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "entity_title"))), lambda s: s["entity_title"]).alias("names"))
    lines = titled.join(own, "id", "left").select("place", unit_line(col("id"), F.coalesce("document_title", F.lit("unknown")), F.coalesce("names", F.array().cast("array<string>")), col("text")).alias("line"))
    texts = _packed(spark, [r["line"] for r in lines.orderBy("place").collect()], share["text_units"])
    sections = [_packed(spark, [g for g in graph if g], share["graph"]), packed_reports and "## Community reports\n" + packed_reports, texts and "## Sources, to be named by the id in brackets\n" + texts]
    cited = provenance.citations(model, units.select("id", "place"), ids)
    documents = chosen.select(col("place").alias("ord"), F.lit("entity").alias("kind"), "id", col("description").alias("page_content"), "title", _meta(kind=F.lit("entity"), id=col("id"), title=col("title"), type=col("type"), text_unit_ids=F.array_join("text_unit_ids", ","))).unionByName(
        units.select(
            (col("place") + len(ids)).alias("ord"), F.lit("text_unit").alias("kind"), "id", col("text").alias("page_content"), col("document_id").alias("title"), _meta(kind=F.lit("text_unit"), id=col("id"), document_id=col("document_id"))
        )
    )
    meta = {
        "mode": "local",
        "entities": len(ids),
        "relationships": relations.count(),
        "reports": reports.count(),
        "text_units": units.count(),
        "claims": claims.count(),
        "token_budget": share,
        "vector_ranking": ranking,
        "citations": [r.asDict() for r in cited.orderBy("place").collect()],
    }
    return Found("\n\n".join(s for s in sections if s), documents, meta)


def local_search(store: Store, query: str, embedder: Any, llm: Any = None, *, top_entities: int = 8, history: str | None = None, form: str = "paragraphs", **options: Any) -> Found:
    """Seeds by the vector index, the model around them, the context, and an answer if there is a language model."""
    model, vector = store.load(), embedder.embed_query(query)
    seeds, ranking = None, "exact"
    index = store.index("entities")
    if index is not None:
        hits, how = search_or_exact(index, model["entities"], vector, top_entities, vector="description_embedding", metric=store.handle.metric, fallback=store.handle.exact_fallback)
        seeds = [r["id"] for r in hits.orderBy(F.desc("score"), "id").collect()] if how == "ann" else None
        ranking = how
    if seeds:
        spark = store.spark
        model = {**model, **subgraph.slice_model(model, spark.createDataFrame([(s,) for s in seeds], "id string"))}
    found = local_context(model, query, embedder, top_entities=top_entities, seeds=seeds, ranking=ranking, query_vector=vector, **options)
    if llm is None:
        return found
    answer = ask(llm, ANSWER.format(history=history_block(history), form=form, query=query, context=found.context))
    cites = "\n".join(f"[{c['text_unit_id']}] {c['document_title']}" for c in found.meta["citations"])
    return found._replace(answer=f"{answer}\n\nSources:\n{cites}" if cites else answer)
