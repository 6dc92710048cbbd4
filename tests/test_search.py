"""The store, local, global and iterative search against plain loops over the same tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from weftgraph.api import KnowledgeBase
from weftgraph.functions import bpe, budget
from weftgraph.models import HashEmbedder, RuleModel
from weftgraph.operators import fast_graph, model_graph
from weftgraph.operators.vectors import ListIndex, search_or_exact
from weftgraph.plans.drift import next_questions
from weftgraph.plans.local import local_context
from weftgraph.plans.overview import batches, select_dynamically
from weftgraph.schema import SCHEMAS, conform, empty
from weftgraph.sources.documents import coerce_documents, compose_text_units, document_records
from weftgraph.sources.store import Handle, Store
from weftgraph.streaming.append import append_stream

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CORPUS = [
    (1, "Acme Works builds Rocket Engines in Norway. Acme Works hires Alice Berg.", "web"),
    (2, "Alice Berg leads Acme Works and flies Rocket Engines.", "web"),
    (3, "Harbour Fish sells Salmon Boats. Bob Stone owns Harbour Fish.", "news"),
    (4, "Bob Stone met Alice Berg in Norway.", None),
]


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return -1.0
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norms if norms else -1.0


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    made = KnowledgeBase(spark, f"file://{tmp_path_factory.mktemp('kb')}", "small", llm=RuleModel(), embedder=HashEmbedder(16))
    told = made.build(spark.createDataFrame(CORPUS, "doc_id long, text string, source string"))
    assert told["documents"] == 4 and told["vector_index"] == "ready" and told["text_units"] == 4
    return made


@pytest.fixture(scope="module")
def tables(base):
    return {t: [r.asDict() for r in rows.collect()] for t, rows in base.store.load().items()}


def local_by_loop(t, query, top_entities, top_relationships, top_units, seeds=None):
    q = HashEmbedder(16).embed_query(query)
    ranked = sorted(t["entities"], key=lambda e: (-cosine(e["description_embedding"], q), -e["rank"], e["ord"], e["id"]))[:top_entities]
    if seeds:
        ranked = sorted((e for e in t["entities"] if e["id"] in seeds), key=lambda e: seeds.index(e["id"]))
    keys = {e["norm_title"] for e in ranked}
    rels = sorted((r for r in t["relationships"] if keys & {r["norm_source"], r["norm_target"]}), key=lambda r: (-r["weight"], -r["rank"], r["ord"], r["id"]))[:top_relationships]
    units = {u for x in (*ranked, *rels) for u in x["text_unit_ids"]}
    near = sorted((u for u in t["chunks"] if u["id"] in units), key=lambda u: (-cosine(u["embedding"], q), u["unit_ord"], u["id"]))[:top_units]
    ends = {x for r in rels for x in (r["norm_source"], r["norm_target"])} - keys
    beside = sorted((e for e in t["entities"] if e["norm_title"] in ends), key=lambda e: (-e["rank"], e["ord"], e["id"]))[:top_entities]
    return ranked, rels, near, beside


@pytest.mark.parametrize("limits", [(3, 4, 2), (50, 60, 50)])
def test_local_context_matches_a_loop(base, tables, limits):
    query = "Who builds Rocket Engines?"
    found = local_context(base.store.load(), query, base.embedder, top_entities=limits[0], top_relationships=limits[1], top_units=limits[2])
    ranked, rels, units, beside = local_by_loop(tables, query, *limits)
    got = [(r["kind"], r["id"]) for r in found.documents.orderBy("ord").collect()]
    assert got == [("entity", e["id"]) for e in ranked] + [("text_unit", u["id"]) for u in units]
    assert found.meta["relationships"] == len(rels) and found.meta["text_units"] == len(units)
    lines = ["Entities", *(f"- {e['title']} ({e['type']}, rank={e['rank']:.1f}): {e['description']}" for e in ranked)]
    assert "\n".join(lines) in found.context
    told = "\n".join(f"- {r['source']} -> {r['target']}: {r['description']}" for r in rels)
    assert told in found.context and all(f"[{u['id']}] document=" in found.context for u in units)
    assert not beside or f"- {beside[0]['title']} ({beside[0]['type']}): {beside[0]['description']}" in found.context
    assert [c["text_unit_id"] for c in found.meta["citations"]] == [u["id"] for u in units]
    meta = {r["id"]: r["metadata"] for r in found.documents.collect()}
    assert meta[units[0]["id"]]["document_id"] == units[0]["document_id"] and meta[ranked[0]["id"]]["type"] == "NOUN_PHRASE"


def test_seeds_override_the_ranking(base, tables):
    last = sorted(tables["entities"], key=lambda e: e["ord"])[-2:]
    found = local_context(base.store.load(), "Rocket", base.embedder, seeds=[e["id"] for e in last], ranking="ann")
    assert [r["id"] for r in found.documents.filter("kind = 'entity'").orderBy("ord").collect()] == [e["id"] for e in last] and found.meta["vector_ranking"] == "ann"


def test_budgets_bound_the_context(base):
    small = local_context(base.store.load(), "Acme", base.embedder, max_tokens=256)
    large = local_context(base.store.load(), "Acme", base.embedder, max_tokens=8000)
    assert len(small.context.split()) <= 256 + 30 < len(large.context.split())


def test_search_modes_and_their_errors(base):
    answer = base.retrieve("Who leads Acme Works?", "local")
    assert answer.answer and "Sources:" in answer.answer and answer.meta["vector_ranking"] == "ann"
    with pytest.raises(ValueError):
        base.retrieve("x", "odd")
    with pytest.raises(ValueError):
        base.retrieve("  ", "local")
    whole = base.retrieve("Acme", "global")
    reports = base.store.load()["reports"].filter("level = 0")
    assert whole.meta["reports_used"] == reports.count() and sorted(r["id"] for r in whole.documents.collect()) == sorted(r["id"] for r in reports.collect())
    points = [line for line in whole.context.split("\n") if line.startswith("- (")]
    scores = [int(line[3:].split(")")[0]) for line in points]
    assert scores == sorted(scores, reverse=True) and len(points) == min(20, whole.meta["points"])
    deep = base.retrieve("Who met Alice Berg?", "drift")
    phases = [n["phase"] for n in deep.meta["hierarchy"]]
    assert phases[0] == "primer" and set(phases[1:]) <= {"follow_up_1", "follow_up_2"} and deep.meta["avg_confidence"] > 0
    ids = [r["id"] for r in deep.documents.collect()]
    assert len(ids) == len(set(ids)) and [r["ord"] for r in deep.documents.orderBy("ord").collect()] == list(range(1, len(ids) + 1))


def test_hierarchy_is_pruned(spark):
    told = [("a", 0, None, "salmon"), ("b", 0, None, "rockets"), ("b1", 1, "b", "rockets too"), ("b2", 1, "b", "fish"), ("a1", 1, "a", "rockets under salmon"), ("c", 0, None, "rockets alone")]
    model = {
        "communities": conform(spark.createDataFrame([(i, level, up) for i, level, up, _ in told], "id string, level int, parent string"), "communities"),
        "reports": conform(spark.createDataFrame([(f"report_{i}", i, level, s, s, n) for n, (i, level, _, s) in enumerate(told)], "id string, community_id string, level int, title string, summary string, ord long"), "reports"),
    }
    chosen = lambda q: sorted(r["community_id"] for r in select_dynamically(model, q, RuleModel()).collect())
    assert chosen("about rockets") == ["b1", "c"] and chosen("about nothing") == ["a", "b", "c"]
    assert chosen("about rockets and salmon") == ["a1", "b1", "c"]
    unread = select_dynamically(model, "about rockets", lambda prompt: "no json").collect()
    assert sorted(r["community_id"] for r in unread) == ["a1", "b1", "b2", "c"]  # what can't be read counts as relevant


def test_batches_do_not_overfill(spark):
    rows = conform(spark.createDataFrame([(f"r{i}", "t", "s", "word " * (i % 9), i) for i in range(300)], "id string, title string, summary string, full_content string, ord long"), "reports")
    for n in (300, 9000):  # as if there were more, in several shares
        got = batches(rows, 20, n).select("id", "batch", "tokens", "place").collect()
        used = {}
        for r in got:
            used.setdefault(r["batch"], []).append(r["tokens"])
        assert len(got) == 300 and all(sum(x) <= 20 for x in used.values()) and len(used) > 60


def test_followups_are_the_best_of_each_wording(spark):
    asked = [("Why now", 50, 1), ("whynow", 70, 2), ("Who", 39, 3), ("When", 70, 4), ("Where", 70, 5)]
    rows = spark.createDataFrame(asked, "question string, score int, ord int")
    assert [r["question"] for r in next_questions(rows, 2, 40).collect()] == ["whynow", "When"]


def test_store_appends_clears_and_keeps_versions(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}", "kb_entities", llm=None, embedder=HashEmbedder(4))
    assert kb.store.handle.root.endswith("/kb") and kb.store.manifest()["status"] == "empty"
    with pytest.raises(ValueError):
        kb.retrieve("x", "local")
    first = kb.build(spark.createDataFrame(CORPUS[:2], "doc_id long, text string, source string"), with_reports=False)
    again = kb.build(spark.createDataFrame(CORPUS[1:3], "doc_id long, text string, source string"), append=True, with_reports=False)
    assert (first["documents"], again["documents"], again["text_units"]) == (2, 3, 3)
    acme = kb.store.load()["entities"].filter("norm_title = 'acmeworks'").first()
    assert len(acme["text_unit_ids"]) == 2 and "；" in acme["description"]
    assert {r["id"] for r in kb.provenance("entity", "Acme Works")["sources"].select(F.col("text_unit_id").alias("id")).collect()} == set(acme["text_unit_ids"])
    with pytest.raises(ValueError):
        kb.provenance("entity", "nobody")
    loaded = kb.store.load()
    assert set(loaded) == set(SCHEMAS) and kb.store.index("reports") is None
    with pytest.raises(ValueError):
        kb.clear()
    kb.clear(confirm=True)
    assert kb.store.manifest()["status"] == "empty" and kb.stats().first()["entities"] == 0
    with pytest.raises(FileNotFoundError):
        Store(spark, Handle(path=f"file://{tmp_path}/none")).ensure(create=False)


def test_a_stream_is_appended_once(spark, tmp_path):
    given = tmp_path / "in"
    store = Store(spark, Handle(path=f"file://{tmp_path}/kb"))
    kind = "doc_id long, text string, source string"
    for n, rows in enumerate((CORPUS[:2], CORPUS[2:])):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"file://{given}")
        stream = append_stream(spark.readStream.schema(kind).parquet(f"file://{given}"), store, None, None, f"file://{tmp_path}/at", with_reports=False)
        stream.awaitTermination(120)
        assert store.load()["documents"].count() == 2 * (n + 1) and store.manifest()["batch"] == n
    before = store.manifest()["version"]
    replay = append_stream(spark.readStream.schema(kind).parquet(f"file://{given}"), store, None, None, f"file://{tmp_path}/lost", with_reports=False)
    replay.awaitTermination(120)  # batch 0 once more, after a lost checkpoint
    assert store.manifest()["version"] == before


def test_a_lost_index_falls_back_to_exact_search(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id string, embedding array<double>")
    index = ListIndex.build(rows, f"file://{tmp_path}/index")
    near, how = search_or_exact(index, rows, [1.0, 1.0, 1.0], 5)
    assert how == "ann" and near.count() == 5
    for part in (tmp_path / "index" / "lists").rglob("*.parquet"):
        part.unlink()
    near, how = search_or_exact(index, rows, [1.0, 1.0, 1.0], 5)
    assert how == "exact" and near.count() == 5
    with pytest.raises(Exception):  # noqa: B017
        search_or_exact(index, rows, [1.0, 1.0, 1.0], 5, fallback=False)


@pytest.mark.parametrize("ids", [["doc-a", "doc-b", None], [10**15, -(10**15), 2**62], [None, None, None]])
def test_any_kind_of_id(spark, ids):
    kind = "string" if any(isinstance(i, str) for i in ids) or ids[0] is None else "long"
    rows = spark.createDataFrame([(i, f"Acme Works number{n} met Bob Stone. " * 60, "s") for n, i in enumerate(ids)], f"doc_id {kind}, text string, source string")
    documents = coerce_documents(rows)
    units = compose_text_units(documents)
    entities, relationships = fast_graph.extract_graph(units)
    assert units.count() == 3 * units.filter("document_id = '%s'" % documents.first()["id"]).count() and entities.count() > 3 and relationships.count() > 3
    orders = [r["unit_ord"] for r in units.collect()]
    assert len(set(orders)) == len(orders)
    assert all(r["metadata"]["source"] == "s" and r["metadata"]["document_id"] == r["document_id"] for r in units.collect())
    found = model_graph.merge_entities(model_graph.extract_units(units, RuleModel()))
    assert found.count() > 1 and document_records(documents, units).filter("metadata['source'] = 's'").count() == 3


def test_rows_of_one_id_are_one_record(spark):
    rows = spark.createDataFrame([(7, "second text", "b"), (7, "a first text", "a")], "doc_id long, text string, source string")
    documents = coerce_documents(rows)
    found = document_records(documents, compose_text_units(documents)).collect()
    assert len(found) == 1 and len(found[0]["text_unit_ids"]) == 2


def test_windows_of_bpe_tokens(spark):
    own = bpe.encoder(RANKS)
    for text in ("", "one", "知识图谱 graph " * 90, "word " * 500):
        tokens = own.encode_ordinary(text.strip())
        want, start = [], 0
        while start < len(tokens) or start == 0 and tokens:
            want.append(own.decode(tokens[start : start + 64]).strip())
            if start + 64 >= len(tokens):
                break
            start += 56
        assert bpe.windows(text, 64, 8, RANKS) == [w for w in want if w]
    rows = spark.createDataFrame([(1, "知识图谱 graph " * 80), (2, None), (3, " ")], "doc_id long, text string")
    units = compose_text_units(coerce_documents(rows), chunk_size=64, chunk_overlap=8, tokenizer=RANKS).orderBy("chunk_index").collect()
    assert [u["text"] for u in units] == bpe.windows("知识图谱 graph " * 80, 64, 8, RANKS) and all(u["n_tokens"] == bpe.count(u["text"], RANKS) <= 70 for u in units)
    items = spark.createDataFrame([(0, "a short item"), (1, "word " * 50), (2, "never")], "ord int, text string")
    packed = budget.pack(items, 40, tokenizer=RANKS).orderBy("ord").collect()
    assert len(packed) == 2 and bpe.count(packed[0]["packed"], RANKS) + bpe.count(packed[1]["packed"], RANKS) + 1 <= 40


def test_long_texts_have_all_their_windows(spark):
    text = "".join(f"w{i} " for i in range(30_000))
    rows = coerce_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    all_of_it = compose_text_units(rows, chunk_size=64, chunk_overlap=32)
    n = all_of_it.count()
    assert n > 5000 and all_of_it.filter("text like '%w29999'").count() >= 1
    assert compose_text_units(rows, chunk_size=64, chunk_overlap=32, max_chunks=100).count() == 100


def test_what_a_model_does_not_see_is_counted(spark):
    units = spark.createDataFrame([("u1", 1, "Alice meets Robert. " * 40), ("u2", 2, "short")], "id string, unit_ord long, text string").withColumn("unit_ord", F.col("unit_ord").cast("decimal(38,0)"))
    whole = model_graph.extraction_stats(model_graph.extract_units(units, RuleModel())).first()
    cut = model_graph.extraction_stats(model_graph.extract_units(units, RuleModel(), most_characters=100)).first()
    assert whole["characters_cut"] == 0 and cut["characters_cut"] == 700 and cut["text_units"] == 2
    broken = model_graph.extraction_stats(model_graph.extract_units(units, lambda prompt: "none")).first()
    assert broken["extraction_failures"] == 2


def test_standard_build_with_claims_and_a_failing_model(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}", llm=RuleModel(), embedder=HashEmbedder(4))
    told = kb.build(spark.createDataFrame(CORPUS, "doc_id long, text string, source string"), method="standard", with_claims=True, entity_types="NAME")
    assert told["covariates"] > 0 and told["community_reports"] == told["communities"] > 0
    reports = kb.store.load()["reports"]
    assert reports.filter("title = '' or full_content = ''").isEmpty() and json.dumps(told)
    assert empty(spark, "reports").count() == 0
