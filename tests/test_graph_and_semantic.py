import re
import json
import random

import pytest
from pyspark.sql import functions as F

from veristrata.operators import graph, semantic


def observations(spark, items):
    rows = [(r, c, p, json.dumps(x) if not isinstance(x, str) else x, "2024-01-01") for r, c, p, x in items]
    return spark.createDataFrame(rows, "run_key string, candidate_id string, provider string, payload string, observed_at string")


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(50)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(90)] + [("hub", f"x{i}") for i in range(300)] + [("solo", "solo"), (None, "a")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a string, b string")
    got, by_rounds = ({r.id: r.root for r in graph.alias_components(df, tail).collect()} for tail in (graph.TAIL_LINKS, 0))
    assert got == by_rounds
    assert got == {x: root(x) for x in list(parent)}


def test_projection_counts_repeats_and_malformed(spark):
    items = [
        ("r1", "c1", "Crossref", {"provider_id": "10.1234/a", "doi": "10.1234/A", "title": "A", "references": ["10.1234/b", "10.1234/b", {"DOI": "10.9999/zz"}, {"unstructured": "book"}, 7], "updates": None}),
        ("r1", "c2", "openalex", {"provider_id": "https://openalex.org/W5", "doi": "10.1234/b", "title": "B", "references": "none", "relations": {"is-update-of": [{"id": "10.1234/a"}]}}),
        ("r2", "c3", "openalex", {"provider_id": "https://openalex.org/W5", "title": "late", "relations": []}),
        ("r2", "c4", "x", "{broken"),
    ]
    parsed = graph.parsed_observations(observations(spark, items))
    names = graph.alias_works(parsed)
    work = {r.alias: r.work_key for r in names.collect()}
    assert work["openalex:W5"] == "doi:10.1234/b" and work["crossref:10.1234/a"] == "doi:10.1234/a"
    edges = graph.citation_edges(parsed, names)
    audit = {r.run_key: r.asDict() for r in graph.citation_audit(edges).collect()}
    assert audit["r1"] == {"run_key": "r1", "expected": 7, "malformed": 2, "indexed": 6, "unresolved": 4, "duplicates": 1}
    assert audit["r2"]["malformed"] == 1
    assert {r.relation for r in edges.collect()} == {"references", "references:unsupported", "relation:is-update-of", "relation:unsupported"}
    works = {r.work_key: r for r in graph.works(parsed, names, edges).collect()}
    assert works["doi:10.9999/zz"].external and works["doi:10.1234/b"].title == "B" and works["doi:10.1234/b"].observations == 2


def test_traverse_levels_limit_and_errors(spark):
    edges = spark.createDataFrame([(f"e{i}", s, t) for i, (s, t) in enumerate([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("a", "b")])], "edge_id string, source_work string, target_work string")
    levels = lambda **k: {r.edge_id: r.level for r in graph.traverse(edges, ["a"], **k)[0].collect()}
    assert levels(depth=2) == {"e0": 1, "e3": 1, "e4": 1, "e1": 2}
    assert levels(depth=2, direction="out") == {"e0": 1, "e4": 1, "e1": 2} and levels(depth=1, direction="in") == {"e3": 1}
    kept, nodes, cut = graph.traverse(edges, ["a"], depth=3, limit=2)
    assert cut and sorted(r.edge_id for r in kept.collect()) == ["e0", "e3"]
    assert graph.traverse(edges, ["none"])[0].count() == 0
    for bad in ({"depth": 6}, {"limit": 0}, {"direction": "up"}):
        with pytest.raises(ValueError):
            graph.traverse(edges, ["a"], **bad)


def test_typed_edges(spark):
    tables = {
        "questions": spark.sql("SELECT 'Q1' AS id, array('C1') AS claim_ids, map('breadth', named_struct('search_ids', array('X1'), 'source_ids', array('S1'))) AS coverage"),
        "claims": spark.sql("SELECT 'C1' AS id, array('Q1', 'Q9') AS question_ids, array(named_struct('source_id', 'S1', 'relation', 'supports')) AS evidence"),
        "searches": spark.sql("SELECT 'X1' AS id, array('Q1') AS question_ids, array('S1') AS source_ids"),
        "sources": spark.sql("SELECT 'S1' AS id, array('S1') AS derived_from"),
        "trace": spark.sql("SELECT 'T1' AS id, array('C1', 'T1') AS parent_ids"),
    }
    got = {(r.source_id, r.target_kind, r.target_id, r.relation, r.known) for r in graph.typed_edges(tables).collect()}
    assert ("C1", "sources", "S1", "supports", True) in got and ("C1", "questions", "Q9", "addresses", False) in got
    assert ("Q1", "searches", "X1", "covered_by:breadth", True) in got and ("T1", "claims", "C1", "parent", True) in got and ("T1", "trace", "T1", "parent", True) in got


def characters(special=2, each=1):
    return (lambda s: [i for i in range(1, len(s) + 1) for _ in range(each)]), special


def words(s):
    return [m.end() for m in re.finditer(r"\s*\S+|\s+", s)]


@pytest.mark.parametrize("tokenizer", [characters(), characters(2, 3), (words, 1)])
@pytest.mark.parametrize("text", ["", "plain words with blanks " * 40, "한글😀 " * 100, "x" * 1500, " " * 400, "a\nb " * 300])
def test_windows_cover_the_text(text, tokenizer):
    windows = semantic.windows_of(text, tokenizer, 100)
    ends = list(tokenizer[0](text))
    spots = sorted(set(ends))
    before = dict(zip(spots, [0, *spots]))  # where the tokens that end here begin
    assert windows[0][0] == 0 and windows[-1][1] == len(text) and all(t <= 100 for _, _, t in windows)
    for a, b, t in windows:  # tokens within the window, one that its end cuts included
        assert t == tokenizer[1] + sum(1 for e in ends if a < e and before[e] < b)
    for (a, b, _), (c, d, _) in zip(windows, windows[1:]):
        assert a < c <= b < d and sum(1 for e in ends if c < e <= b) <= 16


def test_windows_refuse_impossible_budgets():
    with pytest.raises(ValueError):
        semantic.windows_of("x", characters(1, 5), 4)
    with pytest.raises(ValueError):
        semantic.windows_of("x", characters(9), 4)


def test_damaged_spans_are_found(spark):
    lengths = spark.createDataFrame([(i, 10) for i in range(7)] + [(7, 0)], "k int, length int")
    good = [(0, 0, 6, 6), (0, 4, 10, 6), (7, 0, 0, 2)]
    bad = [(1, 1, 10, 9), (2, 0, 4, 4), (2, 5, 10, 5), (3, 0, 6, 99), (3, 5, 10, 5), (4, 0, 9, 9), (5, 0, 6, 6), (5, 0, 10, 9)]
    spans = spark.createDataFrame(good + bad, "k int, start int, end int, tokens int")
    got = {(r.k, r.problem) for r in semantic.span_problems(spans, ["k"], lengths, 50).collect()}
    assert got == {(1, "first"), (2, "gap"), (3, "budget"), (4, "end"), (5, "no_advance"), (6, "end")}


def test_max_similarity_takes_the_largest_window_of_ties(spark):
    windows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("c", 0, [1.0, 0.0])], "text_id string, window int, vector array<float>")
    got = semantic.max_similarity(windows, spark.createDataFrame([([1.0, 0.0],)], "vector array<float>"), limit=2).collect()
    assert [(r.text_id, r.score, r.window) for r in got] == [("a", 1.0, 1), ("c", 1.0, 0)]
    with pytest.raises(ValueError):
        semantic.max_similarity(windows, windows, limit=0)


def test_readiness_and_reuse(spark):
    texts = spark.createDataFrame([("r", "t1", "h1"), ("r", "t2", "h1"), ("r", "t3", "h3"), ("q", "t4", "h1")], "run_key string, text_id string, text_sha256 string")
    vectors = spark.createDataFrame([("t1", "b", "m", "v", [1.0], "h1", 2), ("t3", "b", "m", "v", [1.0], "old", 2)], "text_id string, backend string, model string, revision string, vector array<float>, text_sha256 string, chunk_version int")
    got = {r.run_key: (r.total, r.ready, r.status) for r in semantic.readiness(texts, vectors, "m", "v", 2).collect()}
    assert got == {"r": (3, 1, "pending"), "q": (1, 0, "pending")}
    old = texts.where("text_id IN ('t1', 't3')")
    assert [(r.text_id, r.from_text_id) for r in semantic.reusable_vectors(texts, old, vectors, 2).collect()] == [("t2", "t1")]
    assert semantic.reusable_vectors(texts, old, vectors, 3).isEmpty()


def test_provenance_counts_independent_origins(spark):
    rows = spark.createDataFrame([("r", "S2", "S1", "derived_from"), ("r", "S3", "S2", "derived_from")], "run_key string, source_id string, target_id string, relation string")
    assert {(r.source_id, r.root_id) for r in graph.provenance_roots(rows).collect()} == {("S2", "S1"), ("S3", "S1")}
    assert graph.merged_record_edges(rows.withColumns({c: F.lit("x") for c in ("source_kind", "target_kind", "evidence", "synced_at")})).count() == 2
