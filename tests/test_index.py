import json

import pytest

from veristrata.operators import index, search

SCHEMA = "run_key string, object_id string, locator string, text string"


def sources(spark, texts):
    return {"document": spark.createDataFrame([("r", str(i), None, t) for i, t in enumerate(texts)], SCHEMA)}


def test_refreshing_twice_changes_nothing(spark):
    first = index.desired_texts(sources(spark, ["one text", None, " ", "x " * 2000, "one text"]))
    assert first.count() == 2 + first.where("object_id = '3'").count() and first.where("object_id = '3'").count() > 1
    added, removed = index.text_changes(first, index.desired_texts(sources(spark, ["one text", None, " ", "x " * 2000, "one text"])))
    assert added.count() == removed.count() == 0
    added, removed = index.text_changes(first, index.desired_texts(sources(spark, ["changed", None, " ", "x " * 2000, "one text"])))
    assert [r.text for r in added.collect()] == ["changed"] and removed.count() == 1
    assert index.desired_texts(sources(spark, [None])).count() == 0


def test_refreshed_postings_equal_new_ones(spark):
    old, new = index.desired_texts(sources(spark, ["a b a", "c d"])), index.desired_texts(sources(spark, ["a b a", "c e e"]))
    rows = lambda df: sorted((r.term, r.text_id, r.tf, r.positions) for r in df.collect())
    assert rows(index.refreshed_postings(search.postings(old), *index.text_changes(old, new))) == rows(search.postings(new))


def test_snapshot_follows_content(spark):
    docs = spark.createDataFrame([("r", "1", "x"), ("r", "2", "y"), ("q", "1", "x")], "run_key string, id string, v string")
    one = {r.run_key: r.fingerprint for r in index.snapshot({"docs": (docs, ["id", "v"])}).collect()}
    two = {r.run_key: r.fingerprint for r in index.snapshot({"docs": (docs.where("NOT (run_key = 'r' AND id = '2')"), ["id", "v"])}).collect()}
    assert one["q"] == two["q"] and one["r"] != two["r"]


def test_graph_is_rebuilt_from_observations_alone(spark):
    row = lambda r, c, **k: (r, c, "openalex", json.dumps(k), "2024-01-01")
    schema = "run_key string, candidate_id string, provider string, payload string, observed_at string"
    both = spark.createDataFrame([row("r1", "c1", provider_id="https://openalex.org/W1", doi="10.1234/a"), row("r2", "c2", provider_id="https://openalex.org/W1", references=["10.1234/b"])], schema)
    keys = lambda df: {(r.candidate_id, r.work_key) for r in index.graph_tables(df)["identities"].collect()}
    assert keys(both) == {("c1", "doi:10.1234/a"), ("c2", "doi:10.1234/a")}
    assert keys(both.where("run_key = 'r2'")) == {("c2", "openalex:W1")}
    assert {t: df.count() for t, df in index.graph_tables(both).items()} == {"names": 3, "identities": 2, "edges": 1, "audits": 1, "works": 2}


def test_initialized_refuses_an_existing_table(spark, tmp_path):
    index.initialized(spark.range(2), str(tmp_path / "t"))
    with pytest.raises(Exception):
        index.initialized(spark.range(2), str(tmp_path / "t"))
