"""What a user calls: a knowledge base that is built, asked, looked up and maintained."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators import provenance, reports
from weftgraph.plans.drift import drift_search
from weftgraph.plans.index import index_documents
from weftgraph.plans.local import Found, local_search
from weftgraph.plans.overview import global_search
from weftgraph.sources.store import Handle, Store

MODES = ("local", "global", "drift")


def split_types(given: str | None) -> tuple[str, ...]:
    """Entity types from a list divided by commas of any kind."""
    return tuple(t.strip() for t in re.split(r"[,，、]", given or "") if t.strip())


def as_fraction(percent: float | None, default: float) -> float:
    """A share given in per cent; None is the default, 0 is 0."""
    return default if percent is None else float(percent) / 100


class KnowledgeBase:
    """A knowledge model in a folder, with the models that build and search it."""

    def __init__(self, spark: SparkSession, path: str, name: str = "model", *, llm: Any = None, embedder: Any = None, create: bool = True, **settings: Any) -> None:
        self.spark, self.llm, self.embedder = spark, llm, embedder
        self.store = Store(spark, Handle(path=path, name=name, **settings))
        self.store.ensure(create)

    def build(self, documents: DataFrame, *, append: bool = False, entity_types: str | None = None, **options: Any) -> dict[str, Any]:
        types = split_types(entity_types)
        return index_documents(self.store, documents, self.llm, self.embedder, append=append, **options, **({"entity_types": types} if types else {}))

    def retrieve(self, query: str, mode: str = "local", *, text_percent: float | None = None, community_percent: float | None = None, **options: Any) -> Found:
        """Search by mode: local, global or drift."""
        if mode not in MODES:
            raise ValueError(f"the mode is one of {', '.join(MODES)}")
        if not (query or "").strip():
            raise ValueError("the question is empty")
        if self.store.manifest()["status"] != "ready":
            raise ValueError("nothing has been indexed yet")
        if mode == "global":
            return global_search(self.store.load(), query, self.llm, **options)
        if self.embedder is None:
            raise ValueError("this mode needs an embedder")
        shares = {"text_share": as_fraction(text_percent, 0.5), "community_share": as_fraction(community_percent, 0.25)}
        if mode == "local":
            return local_search(self.store, query, self.embedder, self.llm, **shares, **options)
        return drift_search(self.store, query, self.embedder, self.llm, **shares, **options)

    def provenance(self, mode: str, key: str) -> dict[str, DataFrame]:
        """Look up an entity's sources, a text unit's graph or a document's graph; an unknown key is an error."""
        model = self.store.load()
        if mode == "entity":
            found = {"entity": provenance.resolve_entity(model["entities"], key), "sources": provenance.entity_sources(model, key), "relationships": provenance.entity_relationships(model, key)}
        elif mode == "text_unit":
            found = {"text_unit": model["chunks"].filter(model["chunks"]["id"] == key.strip()), "graph": provenance.unit_graph(model, key)}
        elif mode == "document":
            found = {"document": provenance.resolve_document(model["documents"], key), "text_units": provenance.document_units(model, key), "entities": provenance.document_entities(model, key)}
        else:
            raise ValueError("the mode is entity, text_unit or document")
        if next(iter(found.values())).isEmpty():
            raise ValueError(f"there is no {mode} {key!r}")
        return found

    def stats(self) -> DataFrame:
        return reports.index_stats(self.store.load())

    def clear(self, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("clearing has to be confirmed")
        self.store.clear()
