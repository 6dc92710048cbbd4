"""Functions and operators of the knowledge model on small cases."""

import pytest
from pyspark.sql import functions as F

from weftgraph.api import as_fraction, split_types
from weftgraph.functions import budget, text, vectors
from weftgraph.models import HashEmbedder, RuleModel
from weftgraph.operators import communities, merge, model_graph, provenance, subgraph
from weftgraph.operators.vectors import ListIndex, check_dimension, exact_top
from weftgraph.schema import base_name, conform
from weftgraph.sources.documents import coerce_documents, compose_text_units
from weftgraph.sources.store import Handle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_phrases_of_two_languages():
    found = text.phrases_of("知识图谱 and Graph Store hold the Graph Store; about entities 知识图谱")
    assert found[:4] == ["Graph Store", "Graph", "Store", "知识图谱"] and "about" not in found and "entities" in found
    assert text.phrases_of(None) == [] and text.phrases_of("a b c") == []


def test_tokens_and_truncation(spark):
    assert one(spark, text.count_tokens(F.lit("one two  three"))) == 3
    assert one(spark, text.count_tokens(F.lit("知识图谱"))) == 4
    assert one(spark, text.count_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, text.truncate_tokens(F.lit("aa bb cc dd"), 2)) == "aa bb"


def test_model_output_is_parsed(spark):
    assert text.parse_json('so ```json\n{"a": 1}\n``` done') == {"a": 1}
    assert one(spark, text.json_candidate(F.lit('x [1, 2] y'))) == "[1, 2]"
    with pytest.raises(ValueError):
        text.parse_json("nothing")
    title, body = text.parse_report(F.lit("标题：甲\n报告：乙\n丙"))
    assert one(spark, title) == "甲" and one(spark, body) == "乙\n丙"


def test_budget_and_batches(spark):
    assert budget.allocate(1000) == {"total": 1000, "text_units": 500, "community_reports": 250, "graph": 250}
    items = spark.createDataFrame([(0, "a short item"), (1, "word " * 50), (2, "never")], "ord int, text string")
    assert budget.pack(items, 20).count() == 1
    packed = budget.pack(items, 40).orderBy("ord").collect()
    assert len(packed) == 2 and len(packed[1]["packed"].split()) <= 37
    assert one(spark, budget.next_fit(F.array(*[F.lit(n).cast("long") for n in (5, 5, 9, 1, 20, 1)]), 10)) == [0, 0, 1, 1, 2, 3]


def test_list_sizes_and_factories():
    assert [vectors.choose_lists(*x) for x in ((0, None), (1, None), (10, 100), (1000, 50))] == [1, 1, 10, 50]
    assert vectors.index_factory(7, "IVF9_HNSW10,Flat", 100) == "IVF7_HNSW10,Flat" and vectors.index_factory(7, "", 20) == "IVF7,Flat"
    assert vectors.metric_name("Euclidean") == "l2" and vectors.metric_name("odd") == "cosine"


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0])], "id int, embedding array<double>")
    assert [(r["id"], r["score"]) for r in exact_top(rows, [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.0), (3, -1.0), (4, -1.0), (5, -1.0)]
    assert exact_top(rows, [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        check_dimension(2, 3)


def test_list_index_recall(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = ListIndex.build(rows, f"file://{tmp_path}/index")
    hits = total = 0
    for r in rows.orderBy("id").limit(8).collect():
        exact = {str(x["id"]) for x in exact_top(rows, list(r["embedding"]), 10).collect()}
        hits += len(exact & {x["id"] for x in index.search(list(r["embedding"]), 10).collect()})
        total += 10
    assert hits / total >= 0.9


def test_documents_are_coerced(spark):
    rows = spark.createDataFrame([(" a ", None, "7"), (None, "b", None), ("  ", None, "9")], "text string, content string, doc_id string")
    found = {r["text"]: r["id"] for r in coerce_documents(rows).collect()}
    assert set(found) == {"a", "b"} and found["a"] == "7" and found["b"].startswith("tu_")


def test_chunks_overlap_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "知识图谱 graph " * 80)], "doc_id long, text string")
    units = compose_text_units(coerce_documents(rows), chunk_size=64, chunk_overlap=8)
    assert units.count() >= 2 and {r["document_id"] for r in units.collect()} == {"1"}
    assert compose_text_units(coerce_documents(rows.limit(0))).count() == 0


def test_extractions_are_merged(spark):
    given = "unit_id string, unit_ord long, entities array<struct<title:string,type:string,description:string>>, relationships array<struct<source:string,target:string,description:string,weight:string>>"
    rows = spark.createDataFrame([("u1", 1, [("Acme", "ORG", "a"), (None, "X", "y")], [("Acme", "Bob", "hires", "1"), ("", "Bob", "x", "1")]), ("u2", 2, [("ACME", "org", "b"), ("Bob", "PERSON", "c")], [("bob", "acme", "works", "2")])], given)
    entities = model_graph.merge_entities(rows)
    acme = entities.filter("norm_title = 'acme'").collect()
    assert len(acme) == 1 and acme[0]["title"] == "Acme" and acme[0]["text_unit_ids"] == ["u1", "u2"] and acme[0]["description"] == "a; b"
    relation = model_graph.merge_relationships(rows, entities).collect()
    assert len(relation) == 1 and relation[0]["weight"] == 3.0 and relation[0]["source"] == "Acme"


def test_merging_models_keeps_unchanged_vectors(spark):
    columns = "id string, description string, description_embedding array<float>, text_unit_ids array<string>, rank double"
    old = spark.createDataFrame([("e1", "a", [1.0], ["u1"], 2.0), ("e2", "b", [2.0], ["u1"], 1.0)], columns)
    new = spark.createDataFrame([("e1", "c", None, ["u2", "u1"], 1.0), ("e3", "d", None, ["u2"], 1.0)], columns)
    found = {r["id"]: r for r in merge.merge_entities(old, new).collect()}
    assert found["e1"]["description"] == "a；c" and found["e1"]["description_embedding"] is None and found["e1"]["text_unit_ids"] == ["u1", "u2"]
    assert found["e2"]["description_embedding"] == [2.0] and set(found) == {"e1", "e2", "e3"}


def test_communities_cover_all_nodes(spark):
    n = 24
    entities = conform(spark.createDataFrame([(f"e{i}", f"t{i}", f"t{i}", i) for i in range(n)], "id string, title string, norm_title string, ord long"), "entities")
    edges = [(f"r{a}-{b}", f"t{a}", f"t{b}", f"t{a}", f"t{b}", 2.0) for g in range(4) for a in range(6 * g, 6 * g + 6) for b in range(a + 1, 6 * g + 6)] + [("x", "t0", "t6", "t0", "t6", 0.5), ("loop", "t1", "t1", "t1", "t1", 9.0), ("none", "t1", "zz", "t1", "zz", 9.0)]
    relationships = conform(spark.createDataFrame(edges, "id string, source string, target string, norm_source string, norm_target string, weight double"), "relationships")
    found, members = communities.detect_communities(entities, relationships)
    assert sorted(r["entity_id"] for r in members.filter("level = 0").collect()) == sorted(f"e{i}" for i in range(n))
    rows = {r["id"]: r for r in found.collect()}
    assert all(set(r["entity_ids"]) <= set(rows[r["parent"]]["entity_ids"]) for r in rows.values() if r["parent"])
    assert sum(1 for r in rows.values() if r["level"] == 0) == 4
    assert communities.entity_graph(entities, relationships).filter("src = dst").isEmpty()
    kept, touching = subgraph.expand(entities, relationships, spark.createDataFrame([("e1",)], "id string"))
    assert kept.count() == 6 and touching.count() >= 15


def test_unknown_keys_and_handles():
    assert base_name("kb_entity_edges") == "kb" and base_name("entities") == "entities"
    handle = Handle.from_dict({"path": "/x", "name": "n", "token": "t", "odd": 1})
    assert Handle.from_dict(handle.to_dict()) == handle and "token" not in handle.public_summary()
    assert split_types("A，B、 C,") == ("A", "B", "C") and as_fraction(0, 0.5) == 0.0 and as_fraction(None, 0.5) == 0.5


def test_rule_model_and_embedder_repeat_themselves():
    assert HashEmbedder().embed_query("x") == HashEmbedder().embed_query("x")
    assert text.parse_json(RuleModel().invoke("TASK: extract\nTEXT:\nAlice meets Robert"))["entities"][0]["title"] == "Alice"


def test_resolve_prefers_ids(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("x", "y", 1), ("c", "x", 0)], "id string, norm_title string, ord int")
    assert provenance.resolve_entity(rows, "x").first()["id"] == "x" and provenance.resolve_entity(rows, "X ").first()["id"] == "c"
    assert provenance.resolve_entity(rows, "").isEmpty()
