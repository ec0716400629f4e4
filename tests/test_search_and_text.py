import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veristrata.functions import identifiers as I
from veristrata.functions import records as R
from veristrata.functions import text as T
from veristrata.functions import vectors as V
from veristrata.operators import search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_fold_case_and_accents(spark):
    assert one(spark, T.search_tokens(F.lit("Café déjà_vu ÉCOLE x² 근거입니다!"))) == ["cafe", "deja", "vu", "ecole", "x²", "근거입니다"]
    assert one(spark, T.search_tokens(F.lit("Sa̧bskaqua"))) == ["sabskaqua"]
    assert one(spark, T.search_tokens(F.lit(None).cast("string"))) is None


def test_find_ranks_by_bm25(spark):
    rows = [("a", "r", "apple pie apple"), ("b", "r", "apple tart"), ("c", "s", "plum pie and apple cake with cream"), ("d", "r", "nothing here"), ("e", "r", None)]
    texts = spark.createDataFrame(rows, "text_id string, run_key string, text string").where("text IS NOT NULL")
    got = search.find(texts, "apple", keep=("run_key",)).collect()
    n, df, lengths = 4, 3, {"a": 3, "b": 2, "c": 7, "d": 2}
    mean = sum(lengths.values()) / 4
    idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))
    score = {k: round(-idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[k] / mean)), 6) for k, f in (("a", 2), ("b", 1), ("c", 1))}
    assert [(r.text_id, r.score) for r in got] == sorted(score.items(), key=lambda x: (x[1], x[0]))
    assert got[0].snippet.count("[apple]") >= 1
    only = search.find(texts, "pie apple", keep=("run_key",), eligible=spark.createDataFrame([("s",)], "run_key string")).collect()
    assert [r.text_id for r in only] == ["c"]
    assert search.find(texts, "absent", keep=("run_key",)).count() == 0
    assert search.find(texts.limit(0), "apple", keep=("run_key",)).count() == 0


def test_phrases_and_errors(spark):
    texts = spark.createDataFrame([("a", "go to new_york now"), ("b", "york new"), ("c", "new york new york")], "text_id string, text string")
    assert sorted(r.text_id for r in search.find(texts, "new_york", keep=()).collect()) == ["a", "c"]
    for bad in ("", "  ?!"):
        with pytest.raises(ValueError):
            search.find(texts, bad, keep=())
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            search.find(texts, "new", limit=limit, keep=())


def test_snippet_is_cut_with_ellipsis(spark):
    text = " ".join(f"w{i}" for i in range(100))
    assert one(spark, T.highlighted(F.lit(text), [["w50"]])).startswith("...w30") and "[w50]" in one(spark, T.highlighted(F.lit(text), [["w50"]]))


@pytest.mark.parametrize("text", ["", "   \t ", "short", "a" * 5000, "word " * 1000, "line one. " * 400, "한글 " * 900 + "😀"])
def test_chunks_cover_and_overlap(text):
    chunks = T.chunks_of(text)
    assert all(0 < len(c) <= 1400 and c == c.strip() for c in chunks)
    assert bool(chunks) == bool(text.strip())
    if chunks:
        assert chunks[0][:5] == text.strip()[:5] and chunks[-1][-5:] == text.strip()[-5:]
    assert T.chunks_of(None) == []


def test_identifiers(spark):
    doi = lambda x: one(spark, I.normalized_doi(F.lit(x)))
    assert doi(" https://DX.doi.org/10.1234/AbC ") == "10.1234/abc" and doi("DOI:10.12345/x") == "10.12345/x"
    assert doi("10.12/x") is None and doi("10.1234/a b") is None and doi("") is None
    assert one(spark, I.openalex_alias(F.lit("https://openalex.org/w123/"))) == "openalex:W123"
    assert one(spark, I.openalex_alias(F.lit("https://openalex.org/V1"))) is None
    assert one(spark, I.redacted(F.lit("https://u:p@h.example:8443/a?Key=1&b=2#f"))) == "https://h.example/a?Key=REDACTED&b=2"
    assert one(spark, I.source_id_ok(F.lit("S-01"))) and not one(spark, I.source_id_ok(F.lit("1S")))
    assert one(spark, I.observation_aliases(F.lit("X"), F.lit("W1"), F.lit(None).cast("string"))) == ["x:W1", "openalex:W1"]


def test_records(spark):
    strict = lambda x: one(spark, R.is_strict_object(F.lit(x)))
    assert strict('{"a": 1}') and not strict('{"a": 1, "a": 2}') and not strict('{"a": NaN}') and not strict("[1]") and not strict("") and not strict(None)
    assert one(spark, R.text_of(F.lit('{"b": " x ", "a": ["y", "", {"c": "z", "query_sha256": "h"}], "n": 3}'))) == "x\ny\nz"
    assert one(spark, R.canonical_json(F.lit('{ "b": 1, "a": [1, 2] }'))) == '{"a":[1,2],"b":1}'
    assert one(spark, R.zoned_timestamp(F.lit("2024-05-01T10:00:00"))) is None and one(spark, R.zoned_timestamp(F.lit("2024-05-01T10:00:00Z"))) is not None
    assert one(spark, R.date_of_parts(F.array(F.lit(2024), F.lit(3)))) == "2024-03"
    assert [one(spark, R.problem_code(F.lit(s))) for s in (200, 401, 403, 404, 429, 500)] == ["ok", "auth_required", "blocked", "not_found", "rate_limited", "http_error"]


def test_vectors(spark):
    rows = [([1.0, 0.0], 2), ([2.0, 0.0], 2), ([1.0], 2), (None, 2), ([float("nan"), 1.0], 2), ([1.0, None], 2)]
    df = spark.createDataFrame(rows, "v array<double>, d int")
    assert [r.p for r in df.select(V.vector_problem(F.col("v"), F.col("d")).alias("p")).collect()] == [None, "not_unit", "dimension", "missing", "not_finite", "not_finite"]
    assert one(spark, V.similarity(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) == 1.0


@pytest.mark.parametrize(
    "raw", ['{"a":1} x', '{"a":1}{"b":2}', "1,2", "1], [2", '1, "b": 2', "1} x", "1] x", "", " ", "null x", '{"a":1,"a":2}', "NaN", "[1", "}", "]", '{"v":1}, {"v":2}', None]
)
def test_what_is_no_json(spark, raw):
    assert spark.createDataFrame([(raw,)], "r string").select(R.strict_json(F.col("r")).isNull()).first()[0]


@pytest.mark.parametrize("raw", ['{"a":1}', ' {"a": [1, {"b": null}]}\n', "null", "true", "-1.5e3", '"x, y"', "[]", "{}", '["]", "}"]', '{"v": {"v": 1}}'])
def test_what_is_json(spark, raw):
    got = spark.createDataFrame([(raw,)], "r string").select(F.to_json(R.strict_json(F.col("r")))).first()[0]
    assert json.loads(got) == json.loads(raw)


def test_texts_of_json_follow_the_file():
    rng = random.Random(3)

    def make(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind == 3:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        if kind > 3:
            return {rng.choice(["a", "b", "query_sha256", "input_digest", 'q"{', "x:y"]): make(depth - 1) for _ in range(rng.randrange(4))}
        return rng.choice([1, None, True, "t", ' a "b" ', "{[:", "\\", "ü\n", ""])

    def walk(v):
        if isinstance(v, str):
            return [v]
        if isinstance(v, list):
            return [t for x in v for t in walk(x)]
        return [t for k, x in v.items() if k not in R.HASH_KEYS for t in walk(x)] if isinstance(v, dict) else []

    for _ in range(3000):
        value = make(4)
        assert list(R.texts_in(json.dumps(value, ensure_ascii=rng.random() < 0.5))) == walk(value), value


def test_chunks_equal_the_rule_applied_place_by_place():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "a. ", "\n", "x" * rng.randrange(1, 30), ".", "  ", "\t"]) for _ in range(rng.randrange(60)))
        whole = re.sub(r"[ \t]+", " ", text).strip()
        want, at = [], 0
        while whole and at < len(whole):
            end = min(len(whole), at + 40)
            if end < len(whole):
                places = [c for c in range(at + 21, end + 1) if whole[c - 1] == "\n" or (c < end and whole[c - 1 : c + 1] == ". ")]
                end = max(places, default=end)
            want.append(whole[at:end].strip())
            if end == len(whole):
                break
            at = max(at + 1, end - 7)
        assert T.chunks_of(text, 40, 7) == [w for w in want if w]
