"""Links between entities, text units and documents, and the look-ups along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.order import UNITS
from weftgraph.functions.text import norm_title
from weftgraph.lineage import cut
from weftgraph.operators.subgraph import touching

NONE = "array<string>"


def _list(values: str, order: str = "ord") -> Column:
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, values))), lambda s: s[values]))


LISTS = {"entities": "entity_ids", "relationships": "relationship_ids", "covariates": "covariate_ids"}


def links(rows: DataFrame) -> DataFrame:
    """(id, ord, p, unit_id): each text unit that an entity, relationship or claim names, at place p of its list."""
    return rows.select("id", F.col("ord").cast("decimal(38,0)").alias("ord"), F.posexplode("text_unit_ids").alias("p", "unit_id"))


def pruned(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rows with the ids of text units that exist."""
    found = links(rows).select("id", "p", "unit_id").join(units.select(F.col("id").alias("unit_id")), "unit_id", "left_semi")
    kept = found.repartition("id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "unit_id"))), lambda s: s["unit_id"]).alias("_u"))
    return rows.join(kept, "id", "left").withColumn("text_unit_ids", F.coalesce("_u", F.array().cast(NONE))).select(*rows.columns)


def reverse_ids(rows: DataFrame, name: str) -> DataFrame:
    """(id of a text unit, `name`: the ids that name it, in their rows' order)."""
    found = links(rows).select(F.col("unit_id").alias("id"), F.col("ord").alias("_o"), F.col("id").alias("_i"))
    # shuffled before it is grouped: lists gain nothing from being begun where the rows are
    return found.repartition("id").groupBy("id").agg(_list("_i", "_o").alias(name))


def link(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The model with links in both directions; units of an unknown document get one that holds the beginning of the first.

    Nothing is computed here, and each list has a grouping of its own, so that a query makes only the links that it reads: one
    that asks for units' entities doesn't see relationships, one that asks for a unit looks for its id alone.
    """
    units = model["chunks"]
    out = dict(model)
    linked = units.drop(*LISTS.values())
    for table, name in LISTS.items():
        out[table] = pruned(model[table], units)
        linked = linked.join(reverse_ids(model[table], name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast(NONE)))
    owned = units.filter("coalesce(document_id, '') <> ''")
    orphans = owned.join(model["documents"].select(F.col("id").alias("document_id")), "document_id", "left_anti")
    shells = orphans.groupBy(F.col("document_id").alias("id")).agg(F.substring(F.min_by("text", "unit_ord"), 1, 200).alias("text"), F.min("unit_ord").alias("unit_ord"))
    shells = shells.select("id", "text", F.col("id").alias("title"), F.floor(F.col("unit_ord") / UNITS).cast("long").alias("ord"))
    listed = owned.groupBy(F.col("document_id").alias("id")).agg(_list("id", "unit_ord").alias("text_unit_ids"))
    documents = model["documents"].drop("text_unit_ids").unionByName(shells, allowMissingColumns=True).join(listed, "id", "left")
    out["documents"] = documents.withColumn("text_unit_ids", F.coalesce("text_unit_ids", F.array().cast(NONE)))
    out["chunks"] = linked
    return out


def link_stats(model: dict[str, DataFrame]) -> DataFrame:
    """One row: linked and orphaned entities and units, and documents."""
    e = model["entities"].agg(F.count_if(F.size("text_unit_ids") > 0).alias("entities_with_sources"), F.count_if(F.size("text_unit_ids") <= 0).alias("orphan_entities"))
    u = model["chunks"].agg(F.count_if(F.size("entity_ids") > 0).alias("text_units_with_entities"), F.count_if(F.size("entity_ids") <= 0).alias("orphan_text_units"))
    return e.crossJoin(u).crossJoin(model["documents"].agg(F.count("*").alias("documents")))


def resolve_entity(entities: DataFrame, key: str) -> DataFrame:
    """The entity with this id, else the first with this title; no row if there is none."""
    key = (key or "").strip()
    by_id, by_title = F.col("id") == key, F.col("norm_title") == norm_title(F.lit(key))
    return entities.filter((by_id | by_title) & F.lit(bool(key))).orderBy(by_id.desc(), "ord", "id").limit(1)


def titled(units: DataFrame, documents: DataFrame) -> DataFrame:
    """Units with the title of their document, or its id."""
    names = documents.select(F.col("id").alias("document_id"), F.col("title").alias("_title"))
    return units.join(names, "document_id", "left").withColumn("document_title", F.coalesce(F.nullif("_title", F.lit("")), "document_id")).drop("_title")


def entity_sources(model: dict[str, DataFrame], key: str) -> DataFrame:
    """The text units of an entity in order, with document and preview."""
    wanted = resolve_entity(model["entities"], key).select(F.posexplode("text_unit_ids").alias("place", "id"))
    found = titled(model["chunks"].join(wanted, "id"), model["documents"])
    return found.select("place", F.col("id").alias("text_unit_id"), "document_id", "document_title", "n_tokens", "text", F.substring("text", 1, 240).alias("preview"))


def entity_relationships(model: dict[str, DataFrame], key: str, most: int = 40) -> DataFrame:
    """Relationships at an entity or in one of its text units, the first `most` of them."""
    entity = cut(resolve_entity(model["entities"], key))  # one row, read several times
    relations = model["relationships"]
    at = touching(relations, entity).select("id")
    units = entity.select(F.explode("text_unit_ids").alias("unit_id"))
    beside = relations.select("id", F.explode("text_unit_ids").alias("unit_id")).join(units, "unit_id", "left_semi").select("id")
    return relations.join(at.union(beside).distinct(), "id", "left_semi").orderBy("ord", "id").limit(most)


def unit_graph(model: dict[str, DataFrame], unit_id: str) -> DataFrame:
    """(kind, place, id, title, description) of the entities, relationships and claims of a text unit."""
    unit = model["chunks"].filter(F.col("id") == (unit_id or "").strip())
    shown = {
        "entity": ("entities", "entity_ids", F.col("title")),
        "relationship": ("relationships", "relationship_ids", F.concat_ws(" -> ", "source", "target")),
        "covariate": ("covariates", "covariate_ids", F.col("subject")),
    }
    parts = []
    for kind, (table, ids, title) in shown.items():
        wanted = unit.select(F.posexplode(ids).alias("place", "id"))
        parts.append(model[table].join(wanted, "id").select(F.lit(kind).alias("kind"), "place", "id", title.alias("title"), "description"))
    return parts[0].union(parts[1]).union(parts[2])


def resolve_document(documents: DataFrame, key: str) -> DataFrame:
    key = (key or "").strip()
    by_id, by_title = F.col("id") == key, norm_title(F.coalesce(F.nullif("title", F.lit("")), "id")) == norm_title(F.lit(key))
    return documents.filter(by_id | by_title).orderBy(by_id.desc(), "ord", "id").limit(1)


def document_units(model: dict[str, DataFrame], key: str) -> DataFrame:
    """Units that a document lists, or that name it, in order."""
    document = resolve_document(model["documents"], key)
    listed = document.select(F.explode("text_unit_ids").alias("id"))
    units = model["chunks"]
    named = units.join(document.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
    return units.join(listed.union(named).distinct(), "id", "left_semi")


def document_entities(model: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct entities of a document's units, in the order in which they first occur."""
    seen = document_units(model, key).select("unit_ord", F.posexplode("entity_ids").alias("p", "id")).groupBy("id").agg(F.min(F.struct("unit_ord", "p")).alias("first"))
    return model["entities"].join(seen, "id").withColumn("place", F.row_number().over(Window.orderBy("first")) - 1).select("place", "id", "title", "type", "text_unit_ids")


def citations(model: dict[str, DataFrame], units: DataFrame, entity_ids: list[str]) -> DataFrame:
    """For units (id, place): document, the titles of those of `entity_ids` that they hold, and a preview."""
    asked = units.groupBy("id").agg(F.min("place").alias("place"))
    own = titled(model["chunks"].join(asked, "id"), model["documents"])
    seeds = model["entities"].filter(F.col("id").isin(entity_ids)).select(F.col("id").alias("entity_id"), F.col("title").alias("entity_title"))
    held = own.select("id", F.posexplode("entity_ids").alias("p", "entity_id")).join(seeds, "entity_id")
    held = held.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "entity_title"))), lambda s: s["entity_title"]).alias("supports"))
    return own.join(held, "id", "left").select(
        "place", F.col("id").alias("text_unit_id"), "document_id", "document_title", F.coalesce("supports", F.array().cast(NONE)).alias("supports_entities"), F.substring("text", 1, 280).alias("preview")
    )


def sources_block(model: dict[str, DataFrame], units: DataFrame, most_titles: int = 8) -> DataFrame:
    """(place, line) for units (id, place): id, document, entities and text."""
    own = titled(model["chunks"].join(units, "id"), model["documents"])
    names = model["entities"].select(F.col("id").alias("entity_id"), F.col("title").alias("entity_title"))
    held = own.select("id", F.posexplode(F.slice("entity_ids", 1, most_titles)).alias("p", "entity_id")).join(names, "entity_id")
    held = held.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "entity_title"))), lambda s: s["entity_title"]).alias("titles"))
    told = F.when(F.size("titles") > 0, F.concat(F.lit("; entities: "), F.array_join("titles", ", "))).otherwise("")
    line = F.concat(F.lit("["), F.col("id"), F.lit("] document="), F.coalesce("document_title", F.lit("unknown")), told, F.lit("\n"), F.col("text"))
    return own.join(held, "id", "left").select("place", F.col("id"), line.alias("line"))

