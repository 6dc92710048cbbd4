"""Indexing: documents to a stored knowledge model."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import cut
from weftgraph.operators import communities, fast_graph, model_graph, provenance, reports
from weftgraph.operators.merge import merge_models
from weftgraph.schema import conform, empty
from weftgraph.sources.documents import coerce_documents, compose_text_units, document_records
from weftgraph.sources.store import Store


def build_model(
    rows: DataFrame,
    llm: Any = None,
    *,
    method: str = "fast",
    chunk_size: int = 1200,
    chunk_overlap: int = 100,
    chunk_enabled: bool = True,
    max_chunks: int | None = None,
    tokenizer: str | None = None,
    most_characters: int | None = None,
    entity_types: tuple[str, ...] = model_graph.DEFAULT_TYPES,
    max_gleanings: int = 1,
    with_claims: bool = False,
    min_frequency: int = 1,
    base: dict[str, DataFrame] | None = None,
    max_cluster_size: int = 10,
    max_levels: int = 3,
    with_reports: bool = True,
) -> dict[str, DataFrame]:
    """All tables of the model of some documents, merged into `base` if one is given.

    `fast` takes noun phrases as entities, `standard` asks the language model for them. Texts are windows of characters, or of
    BPE tokens by the ranks at `tokenizer`; nothing is left out unless `max_chunks` or `most_characters` is given.
    """
    if method not in ("fast", "standard"):
        raise ValueError(f"unknown method {method}")
    if method == "standard" and llm is None:
        raise ValueError("the standard method needs a language model")
    spark = rows.sparkSession
    documents = coerce_documents(rows)
    units = cut(compose_text_units(documents, chunk_size=chunk_size, chunk_overlap=chunk_overlap, chunk_enabled=chunk_enabled, max_chunks=max_chunks, tokenizer=tokenizer))
    if units.isEmpty():
        raise ValueError("there is no text to index")
    covariates = empty(spark, "covariates")
    if method == "fast":
        entities, relations = fast_graph.extract_graph(units, min_frequency=min_frequency)
    else:
        extractions = cut(model_graph.extract_units(units, llm, entity_types, max_gleanings, most_characters))
        entities = model_graph.merge_entities(extractions, llm)
        relations = model_graph.merge_relationships(extractions, entities, llm)
        if with_claims:
            covariates = model_graph.extract_claims(units, llm, most_characters)
    model = {"documents": document_records(documents, units), "chunks": units, "entities": cut(entities), "relationships": cut(relations), "covariates": covariates}
    if model["entities"].isEmpty():
        raise ValueError("no entity was found in the documents")
    model = {name: conform(table, name) for name, table in model.items()}
    if base is not None:
        model = {name: cut(table) for name, table in merge_models(base, model).items()}
    found, members = communities.detect_communities(model["entities"], model["relationships"], max_cluster_size=max_cluster_size, max_levels=max_levels)
    if found.isEmpty():  # all is one community
        found = communities.single_community(model["entities"])
        members = found.select(F.col("id").alias("community_id"), "level", F.explode("entity_ids").alias("entity_id"), "ord")
    edges = communities.entity_graph(model["entities"], model["relationships"])
    model["entities"] = conform(communities.with_communities(communities.rank_entities(model["entities"], edges), members), "entities")
    model["communities"], model["entity_edges"] = found, communities.entity_edges(model["entities"], model["relationships"])
    model = {name: cut(rows) if name in ("chunks", "entities", "documents") else rows for name, rows in provenance.link(model).items()}
    model["reports"] = cut(reports.community_reports(model, llm)) if with_reports and llm is not None else empty(spark, "reports")
    if with_reports and llm is not None:  # a community is called as its report is
        named = model["reports"].select(F.col("community_id").alias("id"), F.col("title").alias("_t"))
        model["communities"] = model["communities"].join(named, "id", "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")
    return model


def index_documents(store: Store, rows: DataFrame, llm: Any, embedder: Any, *, append: bool = False, **options: Any) -> dict[str, Any]:
    """Build, embed and store a model; with `append` the stored one is added to. Returns counts and how the index ended."""
    store.ensure()
    base = store.load() if append and store.manifest()["status"] == "ready" else None
    model = build_model(rows, llm, base=base, **options)
    state = store.persist(model, embedder)
    counts = reports.index_stats(store.load()).first().asDict()
    return {"method": options.get("method", "fast"), "append": append, "vector_index": state, **counts}
