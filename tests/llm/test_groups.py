import json
import random

from pyspark.sql import functions as F

from veristrata.llm import groups as G


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_of_chains_hubs_and_noise(spark):
    rng = random.Random(11)
    chain = [f"c{i:04d}" for i in range(400)]
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [("hub", f"leaf{i}") for i in range(600)] + [(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(120)] + [(f"s{i:04d}", f"s{i + 1:04d}") for i in range(300)]
    rows = pairs + pairs[:50] + [(None, "x"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    for hot_rows, tail in ((G.HOT_ROWS, G.TAIL_EDGES), (G.HOT_ROWS, 0), (40, 100)):  # in one task, by rounds, and both with salted lookups
        assert {r.id: r.label for r in G.components(df, hot_rows, tail).collect()} == union_find(pairs)


def test_names_with_one_hash_stay_apart(spark):
    df = spark.createDataFrame([("aa", "bbb"), ("bb", "cccc"), ("dd", "eeeee"), ("eeeee", "ff")], "a string, b string")
    nodes, edges = G.numbered(df, code=lambda c: F.length(c).cast("long"))
    number = {r.name: r.id for r in nodes.collect()}
    assert len(set(number.values())) == len(number) == 7
    assert {(r.a, r.b) for r in edges.collect()} == {(number[r.a], number[r.b]) for r in df.collect()}


def test_payload_with_text_behind_it_gives_no_names(spark):
    obs = spark.createDataFrame([("c1", "x", '{"provider_id": "7"} trailing'), ("c2", "x", '{"provider_id": "7"}'), ("c3", "x", '{"provider_id": "7"}')], "candidate_id string, provider string, payload string")
    none = spark.createDataFrame([], "alias string, work_key string")
    assert {r.candidate_id: r.group_id for r in G.candidate_groups(obs, none).collect()} == {"c1": "c1", "c2": "c2", "c3": "c2"}


def test_empty_and_loops(spark):
    df = spark.createDataFrame([("a", "a"), (None, None)], "a string, b string")
    assert [(r.id, r.label) for r in G.components(df).collect()] == [("a", "a")]
    assert G.components(df.limit(0)).count() == 0


def test_names_of_candidates(spark):
    item = lambda **k: json.dumps(k)
    rows = [
        ("P1", " OpenAlex ", item(provider_id="https://openalex.example/W12", doi="https://doi.example/10.1234/AbC"), "wk"),
        ("P2", "crossref", item(provider_id="10.1234/abc", doi=" DOI:10.1234/ABC "), "wk"),
        ("P3", "openalex", item(provider_id="W12", doi=None), None),
        ("P4", "x", "{broken", "wk"), ("P5", "x", item(provider_id="7", doi="10.12/zz"), None), ("P6", None, None, None), (None, "x", item(provider_id="7"), None), ("P7", "y", item(provider_id="8", doi="n/a"), None),
    ]
    obs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "candidate_id string, provider string, payload string, work_key string, id string, label string")
    names = spark.createDataFrame([("X:7 ", "y:8"), ("doi:", "x:7"), (None, "x:7"), (" ", "x:7"), ("doi:none", "openalex:W12"), ("doi:none", "x:7")], "alias string, work_key string")
    got = {r.candidate_id: r.group_id for r in G.candidate_groups(obs, names).collect()}
    assert got == {"P1": "P1", "P2": "P1", "P3": "P1", "P4": "P4", "P5": "P5", "P6": "P6", "P7": "P5"}
    assert {tuple(r) for r in G.grouped_pairs(obs, names).collect()} == {("P1", "P2"), ("P1", "P3"), ("P5", "P7")}
    assert G.candidate_groups(obs.limit(0), names.limit(0)).count() == 0
