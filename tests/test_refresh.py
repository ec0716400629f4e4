import pytest
from pyspark.sql import functions as F

from veristrata.operators import incremental
from veristrata.operators import refresh as R

SOURCE = "run_key string, object_id string, locator string, text string"


def encoder():
    return lambda texts: [[1.0, 0.0] if "tail" in t else [0.0, 1.0] for t in texts]


def test_refresh_writes_only_what_changed(spark, tmp_path):
    store = R.Index(spark, str(tmp_path))
    notes = spark.createDataFrame([("r", "a", None, "alpha beta"), ("r", "b", None, "beta tail"), ("q", "c", None, "gamma"), ("q", "d", None, None)], SOURCE)
    seen = spark.createDataFrame([("r", "P1", "x", '{"provider_id": "7", "references": ["doi:10.1234/z"], "updates": [{"DOI": "10.1234/y"}], "relations": {"is-part-of": [{"id": "10.1234/w"}]}}', "1")], "run_key string, candidate_id string, provider string, payload string, observed_at string")
    first = store.refresh({"document": notes}, seen)
    assert set(first) == set(R.Index.TABLES) and set(first.values()) == {"committed"}
    assert store.embed(encoder, "b", "m", "1", 2) == 3 and store.embed(encoder, "b", "m", "1", 2) == 0
    files = {p for p in tmp_path.rglob("*")}
    assert set(store.refresh({"document": notes.orderBy(F.desc("object_id"))}, seen).values()) == {"unchanged"}
    assert {p for p in tmp_path.rglob("*")} == files  # the second refresh writes nothing
    assert {r.relation for r in store.table("edges").collect()} == {"references", "updates", "relation:is-part-of"}
    ids = {r.object_id: r.text_id for r in store.table("texts").collect()}
    assert [r.text_id for r in store.find(["beta"]).collect()] == sorted([ids["a"], ids["b"]])

    moved = spark.createDataFrame([("r", "b2", None, "beta tail"), ("q", "c", None, "gamma"), ("q", "e", None, "beta tail")], SOURCE)
    assert store.refresh({"document": moved}, seen) == {"texts": "committed", "postings": "committed", "vectors": "committed", **{n: "unchanged" for n in ("names", "identities", "edges", "audits", "works")}}
    now = {r.object_id: r.text_id for r in store.table("texts").collect()}
    assert set(now) == {"b2", "c", "e"}
    vectors = {r.text_id: list(r.vector) for r in store.table("vectors").collect()}
    assert vectors == {now["b2"]: [1.0, 0.0], now["c"]: [0.0, 1.0]}  # carried over within the run; run q has no such content
    assert {r.text_id for r in store.find(["tail"]).collect()} == {now["b2"], now["e"]}
    assert store.embed(encoder, "b", "m", "1", 2) == 1


def test_a_source_that_changes_meanwhile_is_not_committed(spark, tmp_path):
    store = incremental.Generations(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("r", 1)], "run_key string, v int")
    with pytest.raises(RuntimeError):
        store.commit(df, "f", guard=lambda: False)
    assert store.read() is None and store.commit(df, "f") == "committed"


def test_only_one_of_two_writers_succeeds(spark, tmp_path):
    root = str(tmp_path / "t")
    one, two = incremental.Generations(spark, root), incremental.Generations(spark, root)
    df = spark.createDataFrame([("r", 1)], "run_key string, v int")
    with pytest.raises(RuntimeError):
        one.commit(df, "a", guard=lambda: two.commit(df.unionByName(df), "b") == "committed")
    assert one.read().count() == 2
    (tmp_path / "t" / "MANIFEST-00000002.json").write_text('{"generation": 2, "fold')  # a writer died
    assert one.read().count() == 2 and one.commit(df, "c") == "committed" and two.read().count() == 1


def test_encoders_that_break_the_protocol(spark):
    texts = spark.createDataFrame([("r", "t", "h", "x")], "run_key string, text_id string, text_sha256 string, text string")
    none = spark.createDataFrame([], R.VECTORS)
    for bad in (lambda t: [], lambda t: [[1.0, 1.0]], lambda t: [[1.0]], lambda t: [[float("nan"), 0.0]]):
        with pytest.raises(Exception, match="protocol"):
            R.embedded(texts, none, lambda bad=bad: bad, "b", "m", "1", 2, 1).collect()


def test_who_may_be_read(spark):
    states = spark.createDataFrame([("a", "current"), ("b", "stale"), ("c", "current"), ("d", "current"), ("e", "missing")], "run_key string, status string")
    blocks = spark.createDataFrame([("c", "off"), ("d", "identity_conflict"), ("a", "global")], "run_key string, scope string")
    got = {r.run_key: (r.status, r.eligible) for r in R.eligible_runs(states, blocks).collect()}
    assert got == {"a": ("current", True), "b": ("stale", False), "c": ("off", False), "d": ("identity_conflict", False), "e": ("missing", False)}
    assert {r.run_key for r in R.eligible_runs(states, blocks, allow_stale=True).where("eligible").collect()} == {"a", "b"}


def test_runs_move_fork_and_change_scope(spark):
    runs = spark.createDataFrame([("a", "/a", "global", None), ("b", "/b", "global", None)], "run_key string, root string, scope string, synced_at string")
    assert {(r.run_key, r.scope) for r in R.with_scope(runs, "a", "off").collect()} == {("a", "off"), ("b", "global")}
    assert {(r.run_key, r.root) for r in R.relocated(runs, "a", "/n", lambda p: False).collect()} == {("a", "/n"), ("b", "/b")}
    for call in (lambda: R.relocated(runs, "a", "/n", lambda p: True), lambda: R.relocated(runs, "a", "/b", lambda p: False), lambda: R.forked(runs, "/a", "z", F.lit("1")), lambda: R.forked(runs, "/z", "a", F.lit("1"))):
        with pytest.raises(RuntimeError):
            call()
    with pytest.raises(ValueError):
        R.with_scope(runs, "a", "everywhere")
    assert [(r.run_key, r.root, r.scope) for r in R.forked(runs, "/z", "z", F.lit("1")).where("run_key = 'z'").collect()] == [("z", "/z", None)]


def test_pages_are_read_verified(spark):
    docs = spark.createDataFrame([("d",)], "document_id string")
    pages = spark.createDataFrame([("d", "page:1", "x"), ("d", "page:2", "y")], "document_id string, locator string, text string").withColumn("sha256", F.sha2("text", 256))
    assert [r.text for r in R.read_pages(docs, pages, "d", "page:2").collect()] == ["y"]
    with pytest.raises(RuntimeError):
        R.read_pages(docs, pages.withColumn("text", F.lit("z")), "d")
    assert R.verified(pages.withColumn("text", F.when(F.col("text") == "x", "changed").otherwise(F.col("text"))), recorded="sha256").count() == 1


def test_older_tables_are_migrated(spark):
    old = spark.createDataFrame([("t", "1")], "text_id string, ordinal string")
    new = R.migrated(old.withColumn("gone", F.lit(1)), "text_id string, ordinal int, chunk_version int, lang string", {"chunk_version": F.lit(1)})
    assert [tuple(r) for r in new.collect()] == [("t", 1, 1, None)] and dict(new.dtypes)["ordinal"] == "int"


def test_stored_windows(spark):
    rows = [("a", 0, [1.0, 0.0], 2), ("a", 1, [0.0, 1.0], 2), ("b", 0, [1.0, 0.0], 2), ("b", 2, [1.0, 0.0], 2), ("c", 0, [2.0, 0.0], 2)]
    got = {tuple(r) for r in R.windows_of_vectors(spark.createDataFrame(rows, "text_id string, window int, vector array<float>, dimension int")).collect()}
    assert got == {("b", "windows"), ("c", "not_unit")}
