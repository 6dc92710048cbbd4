"""What is shuffled and computed for the graph of many units: the same results as plain loops, and no step wider than it has to be."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph import catalogue
from weftgraph.operators import communities, fast_graph, modularity, provenance
from weftgraph.schema import conform, empty

TABLES = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def phrases_of(spark, units):
    rows = [(f"u{i}", i, "text", [(t, t.lower().replace(" ", "")) for t in titles]) for i, titles in enumerate(units)]
    return spark.createDataFrame(rows, "id string, unit_ord long, text string, phrases array<struct<title:string,norm_title:string>>").withColumn("unit_ord", F.col("unit_ord").cast("decimal(38,0)"))


def looped(units, kept):
    """norm_source, norm_target -> (number, units, order of the first)"""
    found, title = {}, {}
    for u, titles in enumerate(units):
        keys = list(dict.fromkeys(t.lower().replace(" ", "") for t in titles))
        place = 0
        for t in titles:
            title.setdefault(t.lower().replace(" ", ""), t)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if a in kept and b in kept:
                    n, at, first = found.get((min(a, b), max(a, b)), (0, [], u * 10**6 + place))
                    found[min(a, b), max(a, b)] = n + 1, [*at, f"u{u}"], first
                place += 1
    return {(title[a], title[b], a, b, float(n), tuple(at), first) for (a, b), (n, at, first) in found.items()}


@pytest.mark.parametrize("listed", [1, 3, 100_000])
def test_pairs_are_all_made_wherever_they_are_made(spark, listed, monkeypatch):
    """Also those of a unit of 90 phrases, more than 64 places apart, and of titles that hold the sign lists are joined by."""
    made = random.Random(1)
    names = [f"Name {i}" for i in range(90)] + ["odd\1one", "odd\2a", "odd\2"]
    units = [names] + [[x if made.random() < 0.7 else x.upper() for x in made.sample(names, made.randint(0, 6))] for _ in range(60)]
    phrases = phrases_of(spark, units)
    monkeypatch.setattr(fast_graph.cooccurrences, "__defaults__", (None, listed))
    entities = fast_graph.entities(phrases)
    kept = [r["norm_title"] for r in entities.collect()]
    columns = ("source", "target", "norm_source", "norm_target", "weight", "text_unit_ids", "ord")
    for some in (kept, kept[::2]):
        want = looped(units, set(some))
        for found in (fast_graph.relationships(phrases, entities.filter(F.col("norm_title").isin(some))), fast_graph.relationships(phrases, entities, some)):
            rows = [tuple(tuple(r[c]) if c == "text_unit_ids" else int(r[c]) if c == "ord" else r[c] for c in columns) for r in found.collect()]
            assert len(rows) == len(want) and set(rows) == want


def test_pairs_are_shuffled_once_as_lists(spark):
    """Titles are looked up before there are pairs, and no pair is joined or shuffled after it was made."""
    phrases = phrases_of(spark, [["A b", "B c", "C d"], ["A b", "C d"]])
    found = plan(fast_graph.relationships(phrases, fast_graph.entities(phrases)))
    above, _, below = found.partition("Generate posexplode(transform(split(")
    assert below.count("RepartitionByExpression [a#") == 1 and "part#" in below and below.partition("RepartitionByExpression [a#")[2].partition("\n")[0].strip().endswith(", 8")
    assert "Join" not in above and "Join" in below and above.count("Aggregate") == 1


def test_units_sharing_titles(spark):
    phrases = phrases_of(spark, [["A", "B"], ["B", "C"], ["C", "D"], ["E"]])
    near = fast_graph.sharing_units(phrases, ["a"])
    assert {r[0] for r in near.collect()} == {"a", "b"}
    assert {r[0] for r in fast_graph.sharing_units(phrases, near).collect()} == {"a", "b", "c"}
    assert fast_graph.sharing_units(phrases, []).count() == 0


def model(spark):
    entities = conform(spark.createDataFrame([("e1", "A", "a", ["u2", "u1", "gone"], 2), ("e2", "B", "b", ["u1"], 1)], "id string, title string, norm_title string, text_unit_ids array<string>, ord long"), "entities")
    relations = conform(spark.createDataFrame([("r1", "A", "B", ["u1", "gone"], 1)], "id string, source string, target string, text_unit_ids array<string>, ord long"), "relationships")
    chunks = conform(spark.createDataFrame([("u1", "one", "d1", 1), ("u2", "two", "d1", 2), ("u3", "three", "d1", 3)], "id string, text string, document_id string, unit_ord long"), "chunks")
    return {"entities": entities, "relationships": relations, "chunks": chunks, "covariates": empty(spark, "covariates"), "documents": empty(spark, "documents")}


def test_links_are_made_only_where_they_are_read(spark):
    given = model(spark)
    given["relationships"] = given["relationships"].withColumn("id", F.concat("id", F.lit("_relation")))
    linked = provenance.link(given)
    held = linked["chunks"].select("id", "entity_ids")
    assert "_relation" not in plan(held) and "_relation" in plan(linked["chunks"].select("relationship_ids"))
    assert "Join" not in plan(linked["entities"].select("id", "title"))
    assert "Generate" not in plan(linked["documents"])
    assert {r["id"]: r["entity_ids"] for r in held.collect()} == {"u1": ["e2", "e1"], "u2": ["e1"], "u3": []}
    assert {r["id"]: r["text_unit_ids"] for r in linked["entities"].collect()} == {"e1": ["u2", "u1"], "e2": ["u1"]}
    assert [r["text_unit_ids"] for r in linked["relationships"].collect()] == [["u1"]]
    assert {r["id"]: r["relationship_ids"] for r in linked["chunks"].collect()} == {"u1": ["r1_relation"], "u2": [], "u3": []}


def test_look_ups_have_a_part_of_the_whole_graph(spark):
    phrases = catalogue._phrases(spark, TABLES)
    whole = {r["id"]: r for r in catalogue._graph(spark, TABLES)[1].collect()}
    near = fast_graph.sharing_units(phrases, ["part7"])
    some = catalogue._graph_among(phrases, near)[1].collect()
    titles = {r["norm_title"] for r in near.collect()}
    assert some and all(r == whole[r["id"]] for r in some)
    assert {r["id"] for r in some} == {k for k, r in whole.items() if r["norm_source"] in titles and r["norm_target"] in titles} and len(some) < len(whole)


def test_known_ends_are_not_looked_up(spark):
    entities, relations = catalogue._known(spark, TABLES)
    looked_up = relations.drop("source_id", "target_id")
    for made in (communities.entity_graph, communities.entity_ends, communities.entity_edges):
        columns = made(entities, relations).columns
        assert plan(made(entities, looked_up)).count("Join") > plan(made(entities, relations)).count("Join")
        assert sorted(map(tuple, made(entities, relations).select(columns).collect())) == sorted(map(tuple, made(entities, looked_up).select(columns).collect()))


def test_titles_are_looked_up_as_written_first(spark):
    entities = conform(spark.createDataFrame([("e1", "ab", "ab", 1), ("e2", "A b", "ab", 2), ("e3", "C", "c", 3)], "id string, title string, norm_title string, ord long"), "entities")
    rows = [("ab", "C", "ab", "c"), ("AB", "c", "ab", "c"), ("A b", "ab", "ab", "ab"), ("gone", "C", "gone", "c"), ("C", None, "c", None)]
    relations = conform(spark.createDataFrame(rows, "source string, target string, norm_source string, norm_target string"), "relationships")
    found = sorted((r["src_id"], r["dst_id"]) for r in communities.entity_edges(entities, relations).collect())
    assert found == [("e1", "e3"), ("e2", "e1"), ("e2", "e3")]
    # two joins of the relationships, before four
    assert plan(communities.entity_edges(entities, relations)).count("LogicalRDD") <= 9
    assert [(r["src"], r["dst"], r["weight"]) for r in communities.entity_graph(entities, relations).collect()] == [("e2", "e3", 2.0)]


def test_edges_may_stay_in_blocks(spark, monkeypatch):
    """A graph of two groups and 600 nodes: the same parts in arrays and in blocks of 7 edges, whether communities are gathered or not."""
    r = np.random.default_rng(5)
    a, b = r.integers(0, 600, 2500), r.integers(0, 600, 2500)
    pairs = sorted({(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b) if x != y and x % 2 == y % 2})
    nodes = pd.DataFrame({"path": [f"p{i % 2}" for i in range(600)], "id": [f"n{i:03}" for i in range(600)]})
    edges = pd.DataFrame({"src": [f"n{x:03}" for x, _ in pairs], "dst": [f"n{y:03}" for _, y in pairs], "weight": r.integers(1, 9, len(pairs)) * 65536})
    want = modularity.split_in_arrays(nodes, edges)
    assert 4 < want["part"].nunique() < 300
    given = spark.createDataFrame(edges)
    monkeypatch.setattr(modularity, "BLOCK", 7)
    for kernel_edges in (0, 10**6):
        assert modularity.split_in_blocks(nodes, given, kernel_edges).equals(want)


def test_rows_of_blocks_end_with_a_node(monkeypatch):
    monkeypatch.setattr(modularity, "BLOCK", 3)
    u = np.array([0, 0, 1, 1, 1, 1, 1, 2, 5, 5], np.int32)
    batch = modularity.pa.record_batch({"u": u, "v": u, "w": u.astype(np.int64)})
    rows = [np.frombuffer(x["u"][0].as_py(), np.int32).tolist() for x in modularity._packed(iter([batch, batch.slice(0, 0)]))]
    assert sum(rows, []) == u.tolist() and len(rows) > 2 and all(x[-1] != y[0] for x, y in zip(rows, rows[1:]))
    assert not list(modularity._packed(iter([])))


def test_more_nodes_than_may_be_gathered(spark):
    """Beyond the nodes that may be gathered all is done as tables."""
    edges = [("a1", "a2", 1.0), ("a2", "a3", 1.0), ("a1", "a3", 1.0), ("a3", "b1", 0.5), ("b1", "b2", 2.0)]
    nodes = spark.createDataFrame([("x", n) for n in ("a1", "a2", "a3", "b1", "b2", "c1")], "path string, id string")
    given = spark.createDataFrame(edges, "src string, dst string, weight double")
    found = [sorted(tuple(r) for r in communities.split(nodes, given, *most).collect()) for most in ((10**9, 10**9), (0, 10**9), (0, 0))]
    assert found[0] == found[1] == found[2] and {part for _, _, part in found[0]} == {"a1", "b1", "c1"}
