import json

import pytest
from pyspark.sql import functions as F

from veristrata.operators import incremental, validation
from veristrata.sources import documents, ledger, providers
from veristrata.streaming import refresh


def test_difference_handles_null_keys(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), ("c", 3, None)], "r string, k int, v string")
    new = spark.createDataFrame([("a", 1, "x2"), (None, 2, "y"), ("c", 3, None), ("d", 4, "n")], "r string, k int, v string")
    got = {(r.r, r.k): r.change for r in incremental.difference(old, new, ["r", "k"]).collect()}
    assert got == {("a", 1): "changed", (None, 2): "unchanged", ("c", 3): "unchanged", ("d", 4): "added"}
    assert {r.k for r in incremental.reconciled(old, new, ["r", "k"]).collect()} == {1, 4}
    assert incremental.difference(old.limit(0), new.limit(0), ["r", "k"]).count() == 0
    assert {r.change for r in incremental.difference(old, new.limit(0), ["r", "k"]).collect()} == {"removed"}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    new = spark.createDataFrame([(1, None, "B"), (3, "n", None)], "k int, x string, y string")
    assert {tuple(r) for r in incremental.coalesced(old, new, ["k"]).collect()} == {(1, "a", "B"), (2, "c", None), (3, "n", None)}
    assert {tuple(r) for r in incremental.replaced(old, new, ["k"], ["y"]).collect()} == {(1, None, "B"), (2, "c", None), (3, "n", None)}
    assert {tuple(r) for r in incremental.kept_first(old, new, ["k"], ["y"]).collect()} == {(1, "a", "b"), (2, "c", None), (3, "n", None)}


def test_generations(spark, tmp_path):
    store = incremental.Generations(spark, str(tmp_path / "table"))
    assert store.read() is None
    df = spark.createDataFrame([("r", 1)], "run_key string, v int")
    assert store.commit(df, "f1") == "committed" and store.commit(df, "f1") == "unchanged"
    assert store.commit(df.unionByName(df), "f2") == "committed"
    assert store.read().count() == 2 and store.manifest()["generation"] == 2


def test_fingerprint_ignores_order_not_content(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), (None, None)], "r string, v string")
    one = {r.r: r.fingerprint for r in incremental.fingerprints(df, ["r"], ["v"]).collect()}
    two = {r.r: r.fingerprint for r in incremental.fingerprints(df.orderBy(F.desc("v")), ["r"], ["v"]).collect()}
    three = {r.r: r.fingerprint for r in incremental.fingerprints(df.where("v IS NULL OR v <> '2'"), ["r"], ["v"]).collect()}
    assert one == two and one["a"] != three["a"] and one["b"] == three["b"]


def test_rules_on_small_tables(spark):
    df = spark.createDataFrame([("1", "ok", "2024-01-01T00:00:00Z", ["a"]), (" ", None, "2024-01-01", []), ("1", " ", None, None)], "id string, t string, at string, refs array<string>")
    codes = lambda x: sorted((r.code, r.record) for r in x.collect())
    assert codes(validation.missing_ids(df, "x")) == [("MISSING_ID", " ")]
    assert codes(validation.duplicate_ids({"x": df})) == [("DUPLICATE_ID", "1")]
    assert codes(validation.required_text(df, "x", "id", ["t"])) == [("REQUIRED_TEXT", " "), ("REQUIRED_TEXT", "1")]
    assert len(codes(validation.timestamps(df, "x", "id", "at"))) == 2 and len(codes(validation.empty_references(df, "x", "id", "refs"))) == 2
    target = spark.createDataFrame([("b",)], "id string")
    assert codes(validation.unknown_references(df, "x", "id", "refs", target)) == [("UNKNOWN_REF", "1")]
    assert codes(validation.allowed_values(df, "x", "id", "t", ("ok",))) == [("INVALID_VALUE", " "), ("INVALID_VALUE", "1")]
    assert validation.report(validation.missing_ids(df.limit(0), "x"), validation.timestamps(df.limit(0), "x", "id", "at")).count() == 0


def test_cycles_are_reported(spark):
    rows = [("r", "a", "b", "parent"), ("r", "b", "a", "parent"), ("r", "c", "a", "parent")]
    got = validation.cycles(spark.createDataFrame(rows, "run_key string, source_id string, target_id string, relation string")).collect()
    assert sorted((r.code, r.record, r.detail) for r in got) == [("TRACE_CYCLE", "r/a", "a"), ("TRACE_CYCLE", "r/b", "a")]


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2", "id": "3"}\n[1]\n{"id": "4"}\n')
    good, bad = ledger.read_records(spark, str(tmp_path / "a.jsonl"), "id string")
    assert [(r.line, r.id) for r in good.orderBy("line").collect()] == [(1, "1"), (5, "4")]
    assert sorted((r.line, r.code) for r in bad.collect()) == [(2, "INVALID_JSONL"), (3, "INVALID_JSON"), (4, "INVALID_JSON")]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "b.jsonl").write_text("".join(f'{{"id": "{i}"}}\r\n' for i in range(5000)))
    (tmp_path / "many" / "c.jsonl").write_text('{"id": "x"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # many splits of one file
    try:
        lines = {(r.file, r.line): r.raw for r in ledger.jsonl_lines(spark, str(tmp_path / "many")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert lines == {**{("b.jsonl", i + 1): f'{{"id": "{i}"}}' for i in range(5000)}, ("c.jsonl", 1): '{"id": "x"}'}
    with pytest.raises(ValueError):
        ledger.contained(str(tmp_path), "../x")
    with pytest.raises(ValueError):
        ledger.contained(str(tmp_path), "/etc/passwd")
    assert ledger.contained(str(tmp_path), "a.jsonl").endswith("a.jsonl")


def test_pages_of_blobs(spark):
    blobs = spark.createDataFrame(
        [("h", bytearray(b"<html><head><style>x{}</style></head><body><p>A &amp; B</p><script>no</script><div>C</div></body></html>"), None), ("x", bytearray(b"<?xml version='1.0'?><a><front>F</front><body>B<i>i</i></body></a>"), None), ("t", bytearray("﻿plain".encode()), "text/plain"), ("p", bytearray(b"no pdf"), "application/pdf"), ("q", bytearray(b"%PDF-1.4"), None)],
        "path string, content binary, mime string",
    )
    got = {r.path: r for r in documents.pages(blobs).collect()}
    assert got["h"].text.split() == ["A", "&", "B", "C"] and got["x"].text == "F\n\nB i" and got["t"].text == "plain"
    assert got["p"].warning == "invalid_content" and got["q"].format == "pdf"
    text, rest = documents.split_evidence(spark.createDataFrame([("a", bytearray(b"fine")), ("b", bytearray(b"\xff\xfe")), ("c", bytearray(b"x\x00y"))], "path string, content binary"))
    assert [r.path for r in text.collect()] == ["a"] and sorted(r.path for r in rest.collect()) == ["b", "c"]


def test_provider_responses(spark):
    body = json.dumps({"message": {"items": [{"DOI": "10.1234/AB", "title": ["T"], "published": {"date-parts": [[2024, 3, 5]]}, "reference": [{"DOI": "10.1/x"}]}, {"title": ["no id"]}]}})
    got = providers.crossref(spark.createDataFrame([(body,), ("{broken",)], "body string")).collect()
    assert [(r.provider_id, r.work_key, r.title, r.published) for r in got] == [("10.1234/ab", "doi:10.1234/ab", "T", "2024-03-05")]
    alex = json.dumps({"results": [{"id": "https://openalex.org/W1", "doi": None, "title": None}]})
    assert [(r.title, r.work_key) for r in providers.openalex(spark.createDataFrame([(alex,)], "body string")).collect()] == [("https://openalex.org/W1", "openalex:https://openalex.org/W1")]
    with pytest.raises(ValueError):
        providers.next_page(spark.range(3), "id", None, 0)


def test_stream_of_new_rows_is_applied_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(source)
    stream = lambda: spark.readStream.schema("k string, v int").parquet(source)
    for _ in range(2):
        refresh.refresh_available(stream(), lambda df, i: seen.extend(r.k for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == ["a", "b"]
    spark.createDataFrame([("c", 3)], "k string, v int").write.mode("append").parquet(source)
    refresh.refresh_available(stream(), lambda df, i: seen.extend(r.k for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == ["a", "b", "c"]


def test_windows_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT TIMESTAMP '2024-01-01 00:20:00', 'a' UNION ALL SELECT TIMESTAMP '2024-01-01 05:00:00', 'b'")
    rows.write.parquet(source)
    counts = refresh.window_counts(spark.readStream.schema(rows.schema).parquet(source), "ts", ["k"], "1 hour", "10 minutes")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.k, r.n) for r in spark.read.parquet(out).collect()] == [("a", 2)]


HTML = {
    "<p>a</p><p>b</p>": "\na\nb",
    "caf&eacute; &#8212; &#x41; &mdash; &hellip; &amp;lt;": "café — A — … &lt;",
    "x<script>var a = '<p>';": "x",
    "x<style>p {}": "x",
    "x<!-- a > b <script> -->y": "xy",
    'x<a title="1 > 0" href=\'>\'>y</a>z': "xyz",
    "a<br>b<BR/>c<li class='q'>d": "a\nb\nc\nd",
    "<pre>keep</pre><title>T</title>": "keepT",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<SCRIPT src=x>n</Script >after<noscript>n</noscript>": "after",
    "<!doctype html><?xml version='1.0'?>t": "t",
    "": "",
}


def test_html_text(spark):
    rows = spark.createDataFrame([*HTML.items(), (None, None)], "page string, text string")
    assert [(r.page, r.got) for r in rows.select("page", "text", documents.html_text(F.col("page")).alias("got")).collect() if r.got != r.text] == []


def test_xml_text(spark):
    rows = {"<a><p>one</p><p>two</p></a>": "one two", "<r xmlns='n'><front>F<b>g</b></front><x>no</x><body>B</body></r>": "F g\n\nB", "<a>": None, "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>": None}
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", documents.xml_text("x").alias("t")).collect()
    assert {r.x: r.t for r in got} == rows


def test_tables_between_rounds(spark):
    from pathlib import Path

    from veristrata.plans.lineage import cut, release, shared_folder

    one = cut(spark.range(5))
    path = Path(one._cut_path.removeprefix("file://"))
    two = cut(one.selectExpr("id * 2 AS id"), one)
    assert not path.exists() and sorted(r.id for r in two.collect()) == [0, 2, 4, 6, 8]
    kept = Path(two._cut_path.removeprefix("file://"))
    release(two, spark.range(1))
    assert not kept.exists()
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(RuntimeError):
        shared_folder(Cluster)
    Cluster.conf.get = staticmethod(lambda key, default=None: {"spark.checkpoint.dir": "hdfs://all/x/"}.get(key, default))
    assert shared_folder(Cluster) == "hdfs://all/x"


def test_lookups_with_hot_keys(spark):
    from veristrata.plans.skew import lookup

    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 = 1 THEN NULL ELSE id END AS k")
    right = spark.range(2000).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()), key=str)
        for hot in (10_000, 500):
            assert sorted(map(tuple, lookup(left, right, "k", 3000, how, hot).select("id", "k", "v").collect()), key=str) == want
