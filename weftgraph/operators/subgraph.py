"""The part of a knowledge model around some entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import cut


def touching(relationships: DataFrame, titles: DataFrame) -> DataFrame:
    """Relationships with an endpoint among `titles` (norm_title): endpoints are exploded, so that it is an equi-join."""
    ends = relationships.select("id", F.explode(F.array("norm_source", "norm_target")).alias("norm_title"))
    found = ends.join(titles.select("norm_title"), "norm_title", "left_semi").select("id").distinct()
    return relationships.join(found, "id", "left_semi")


def endpoint_titles(relationships: DataFrame) -> DataFrame:
    return relationships.select(F.explode(F.array("norm_source", "norm_target")).alias("norm_title")).distinct()


def neighbours(entities: DataFrame, relationships: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entities that are endpoints of `relationships`, without the seeds (id)."""
    return entities.join(endpoint_titles(relationships), "norm_title", "left_semi").join(seeds.select("id"), "id", "left_anti")


def expand(entities: DataFrame, relationships: DataFrame, seeds: DataFrame, include_neighbours: bool = True) -> tuple[DataFrame, DataFrame]:
    """Seeds (id), with their neighbours if asked for, and all relationships that touch any of these."""
    kept = entities.join(seeds.select("id"), "id", "left_semi")
    if include_neighbours:
        titles = kept.select("norm_title").union(endpoint_titles(touching(relationships, kept))).distinct()
        near = entities.join(titles, "norm_title", "left_semi").select("id")
        kept = entities.join(near.union(kept.select("id")).distinct(), "id", "left_semi")
    return kept, touching(relationships, kept)


def _ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(column).alias("id")).distinct()


def slice_model(model: dict[str, DataFrame], seeds: DataFrame, include_neighbours: bool = True) -> dict[str, DataFrame]:
    """All seven tables around the seeds (id)."""
    entities, relationships = (cut(x) for x in expand(model["entities"], model["relationships"], seeds, include_neighbours))  # all others follow from them
    units = model["chunks"].join(_ids(entities, "text_unit_ids").union(_ids(relationships, "text_unit_ids")).distinct(), "id", "left_semi")
    communities = _ids(entities, "community_ids")
    units = cut(units)
    return {
        "entities": entities,
        "relationships": relationships,
        "chunks": units,
        "communities": model["communities"].join(communities, "id", "left_semi"),
        "reports": model["reports"].join(communities.withColumnRenamed("id", "community_id"), "community_id", "left_semi"),
        "covariates": model["covariates"].join(entities.select(F.col("norm_title").alias("norm_subject")), "norm_subject", "left_semi"),
        "documents": model["documents"].join(units.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi"),
    }


def by_ids(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows with one of some ids, pushed down to the scan."""
    return rows.filter(F.col("id").isin(ids)) if ids else rows.limit(0)
