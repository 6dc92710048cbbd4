"""Entities, relationships and claims that a language model extracts from text units, and their merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.order import place_order
from weftgraph.functions.text import claim_id, claim_status, entity_id, norm_title, parse_json, relation_id, strip
from weftgraph.models import ask, with_answers
from weftgraph.operators.fast_graph import ordered_ids

DEFAULT_TYPES = ("PERSON", "ORGANIZATION", "PLACE", "PRODUCT", "EVENT", "CONCEPT")
EXTRACT = "TASK: extract\nName the entities of the types {types} in the text and how they relate, as JSON with the lists entities (title, type, description) and relationships (source, target, description, weight).\nTEXT:\n{text}"
GLEAN = "TASK: glean\nFound so far: {entities}; {relationships}. Add what was missed, in the same form.\nTEXT:\n{text}"
CLAIMS = "TASK: claims\nList the claims of the text as JSON: claims (subject, object, status, description, start_date, end_date).\nTEXT:\n{text}"
SUMMARY = "TASK: summary\nSay in one paragraph what these descriptions say.\nTEXT:\n{text}"
EXTRACTION = "unit_id string, unit_ord decimal(38,0), failed boolean, n_cut int, entities array<struct<title:string,type:string,description:string>>, relationships array<struct<source:string,target:string,description:string,weight:string>>"


def _listed(payload: Any, name: str) -> list[dict]:
    found = payload.get(name) if isinstance(payload, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def extract_from_text(model: Any, text: str, types: tuple[str, ...] = DEFAULT_TYPES, gleanings: int = 1, most_characters: int | None = None) -> tuple[list[dict], list[dict], bool]:
    """Entities, relationships and whether the first call failed; each gleaning asks for what was missed.

    The whole text is sent, or its first `most_characters`.
    """
    text = text[:most_characters]
    try:
        first = parse_json(ask(model, EXTRACT.format(types=", ".join(types), text=text)))
    except Exception:  # noqa: BLE001
        return [], [], True
    entities, relations = _listed(first, "entities"), _listed(first, "relationships")
    for _ in range(max(0, gleanings)):
        known = [e.get("title") for e in entities], [f"{r.get('source')}->{r.get('target')}" for r in relations]
        try:
            more = parse_json(ask(model, GLEAN.format(entities=known[0], relationships=known[1], text=text)))
        except Exception:  # noqa: BLE001
            break
        if not _listed(more, "entities") and not _listed(more, "relationships"):
            break
        entities, relations = entities + _listed(more, "entities"), relations + _listed(more, "relationships")
    return entities, relations, False


def extract_units(units: DataFrame, model: Any, types: tuple[str, ...] = DEFAULT_TYPES, gleanings: int = 1, most_characters: int | None = None) -> DataFrame:
    """One row of extractions for each unit; n_cut is how many characters of it the model didn't see."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for unit, order, text in zip(part["id"], part["unit_ord"], part["text"]):
                ents, rels, failed = extract_from_text(model, text or "", types, gleanings, most_characters)
                rows.append(
                    (unit, order, failed, max(0, len(text or "") - most_characters) if most_characters else 0, [{k: _text(e.get(k)) for k in ("title", "type", "description")} for e in ents], [{k: _text(r.get(k)) for k in ("source", "target", "description", "weight")} for r in rels])
                )
            yield pd.DataFrame(rows, columns=["unit_id", "unit_ord", "failed", "n_cut", "entities", "relationships"])

    return units.select("id", "unit_ord", "text").mapInPandas(run, EXTRACTION)


def _filled(value: Column, otherwise: str = "") -> Column:
    given = F.coalesce(value, F.lit(""))
    # a look at both ends is a fraction of the cost of a search through the whole value, and nearly none needs that
    plain = F.concat(F.substring(given, 1, 1), F.substring(given, -1, 1)).rlike("^[A-Za-z0-9]{2}$")
    trimmed = F.when(plain, given).otherwise(strip(given))
    return F.when(trimmed == "", otherwise).otherwise(trimmed)


def _described(rows: DataFrame, fallback: Column, model: Any) -> DataFrame:
    """description from the list `told`: a model's summary of up to 12 where there are several, else the first three."""
    told = F.when(F.size("told") == 0, F.array(fallback)).otherwise(F.col("told"))
    rows = rows.withColumn("told", told).withColumn("description", F.array_join(F.slice("told", 1, 3), "; "))
    if model is None:
        return rows.drop("told")
    several = rows.filter(F.size("told") > 1).withColumn("_p", F.concat(F.lit(SUMMARY.format(text="")), F.array_join(F.transform(F.slice("told", 1, 12), lambda d: F.concat(F.lit("- "), d)), "\n")))
    summed = with_answers(several, model, "_p", "_s").withColumn("description", F.coalesce(F.nullif(strip(F.col("_s")), F.lit("")), "description")).drop("_p", "_s")
    return rows.filter(F.size("told") <= 1).unionByName(summed).drop("told")


def _first(*columns: str) -> Column:
    """`first`: order, place and some columns of the first row."""
    return F.min_by(F.struct("unit_ord", "place", *columns), F.struct("unit_ord", "place")).alias("first")


def _ordered(value: str) -> Column:
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col(value) != "", F.struct("unit_ord", "place", value)))), lambda s: s[value])
    return told


def merge_entities(extractions: DataFrame, model: Any = None) -> DataFrame:
    """Entities by title and type: first spelling, descriptions, units in order, rank the number of units."""
    rows = extractions.select("unit_id", "unit_ord", F.posexplode("entities").alias("place", "e"))
    rows = rows.select("unit_id", "unit_ord", "place", _filled(F.col("e.title")).alias("title"), _filled(F.col("e.type"), "UNKNOWN").alias("type"), _filled(F.col("e.description")).alias("said"))
    rows = rows.filter("title <> ''").withColumn("id", entity_id(F.col("title"), F.col("type")))
    grouped = rows.groupBy("id").agg(_first("title", "type"), _ordered("said").alias("told"), ordered_ids("unit_ord", "unit_id").alias("text_unit_ids"))
    grouped = grouped.select("id", "first.title", "first.type", "told", "text_unit_ids", place_order(F.col("first.unit_ord"), F.col("first.place")).alias("ord"))
    grouped = _described(grouped, F.col("title"), model)
    return grouped.select("id", "title", "type", "description", "text_unit_ids", F.size("text_unit_ids").cast("double").alias("rank"), norm_title(F.col("title")).alias("norm_title"), "ord")


def last_titles(entities: DataFrame) -> DataFrame:
    """(norm_title, title, id) of the last entity with each normalised title."""
    return entities.groupBy("norm_title").agg(F.max_by("title", F.struct("ord", "id")).alias("canonical"), F.max_by("id", F.struct("ord", "id")).alias("entity_id"))


def merge_relationships(extractions: DataFrame, entities: DataFrame, model: Any = None) -> DataFrame:
    """Relationships of either direction as one: first direction, weights summed, endpoints named as the entities are."""
    rows = extractions.select("unit_id", "unit_ord", F.posexplode("relationships").alias("place", "r"))
    weight = F.coalesce(F.nullif(F.col("r.weight").try_cast("double"), F.lit(0.0)), F.lit(1.0))
    rows = rows.select("unit_id", "unit_ord", "place", _filled(F.col("r.source")).alias("source"), _filled(F.col("r.target")).alias("target"), _filled(F.col("r.description")).alias("said"), weight.alias("w"))
    rows = rows.filter("source <> '' and target <> ''").withColumn("id", relation_id(F.col("source"), F.col("target"), "->"))
    # shuffled before they are grouped, as nearly every pair is rare: lists would be begun, and sorted, where the rows are for nothing
    grouped = rows.repartition("id").groupBy("id").agg(_first("source", "target"), F.sum("w").alias("weight"), _ordered("said").alias("told"), ordered_ids("unit_ord", "unit_id").alias("text_unit_ids"))
    grouped = grouped.select("id", "first.source", "first.target", "weight", "told", "text_unit_ids", place_order(F.col("first.unit_ord"), F.col("first.place")).alias("ord"))
    names = last_titles(entities).select("norm_title", "canonical")
    for end in ("source", "target"):
        named = names.select(F.col("norm_title").alias(f"norm_{end}"), F.col("canonical").alias("_c"))
        grouped = grouped.withColumn(f"norm_{end}", norm_title(F.col(end))).join(named, f"norm_{end}", "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    grouped = _described(grouped, F.format_string("%s and %s are related", "source", "target"), model)
    return grouped.select("id", "source", "target", "description", "weight", "text_unit_ids", F.lit(1.0).alias("rank"), "norm_source", "norm_target", "ord")


def extraction_stats(extractions: DataFrame) -> DataFrame:
    """One row: units, those for which the model failed, and characters that it didn't see."""
    return extractions.agg(F.count("*").alias("text_units"), F.count_if("failed").alias("extraction_failures"), F.coalesce(F.sum("n_cut"), F.lit(0)).cast("long").alias("characters_cut"))


def claims_from_answers(answers: DataFrame) -> DataFrame:
    """Claims of model answers (unit_id, unit_ord, answer), one for each subject and description; the first says the rest."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for unit, order, answer in zip(part["unit_id"], part["unit_ord"], part["answer"]):
                try:
                    found = _listed(parse_json(answer or ""), "claims")
                except ValueError:
                    found = []
                rows += [(unit, order, i, json.dumps({k: _text(v) for k, v in c.items()})) for i, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=["unit_id", "unit_ord", "place", "claim"])

    rows = answers.select("unit_id", "unit_ord", "answer").mapInPandas(run, "unit_id string, unit_ord decimal(38,0), place bigint, claim string")
    fields = "subject string, object string, status string, description string, start_date string, end_date string"
    return merge_claims(rows.select("unit_id", "unit_ord", "place", F.from_json("claim", fields).alias("c")).select("unit_id", "unit_ord", "place", "c.*"))


def merge_claims(rows: DataFrame) -> DataFrame:
    """Claims (unit_id, unit_ord, place, subject, …) without repeats; rows lacking subject or description are left out."""
    rows = rows.select("unit_id", "unit_ord", "place", *[_filled(F.col(c)).alias(c) for c in ("subject", "object", "description", "start_date", "end_date")], claim_status(F.col("status")).alias("status"))
    rows = rows.filter("subject <> '' and description <> ''").withColumn("id", claim_id(F.col("subject"), F.col("description")))
    first = F.min_by(F.struct("subject", "object", "status", "description", "start_date", "end_date", "unit_ord", "place"), F.struct("unit_ord", "place")).alias("c")
    grouped = rows.groupBy("id").agg(first, ordered_ids("unit_ord", "unit_id").alias("text_unit_ids"))
    return grouped.select(
        "id", "c.subject", "c.object", F.lit("claim").alias("type"), "c.status", "c.description", "c.start_date", "c.end_date", "text_unit_ids", norm_title(F.col("c.subject")).alias("norm_subject"), place_order(F.col("c.unit_ord"), F.col("c.place")).alias("ord")
    )


def extract_claims(units: DataFrame, model: Any, most_characters: int | None = None) -> DataFrame:
    """Claims of each unit's whole text, or of its first `most_characters`."""
    text = F.substring("text", 1, most_characters) if most_characters else F.col("text")
    prompts = units.select(F.col("id").alias("unit_id"), "unit_ord", F.concat(F.lit(CLAIMS.format(text="")), text).alias("prompt"))
    return claims_from_answers(with_answers(prompts, model))
