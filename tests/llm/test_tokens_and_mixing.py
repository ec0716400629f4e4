import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veristrata.llm import mixing as M
from veristrata.llm import tokens as T

PATH = f"{T.TOKENIZERS}/{T.VOCABULARY}"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefg hijk\n\t'stre 0123.,!?éüß漢字한글ไทย😀àÀ́​"), max_size=300))
def test_ids_equal_the_library(library, text):
    assert T.load(PATH).encode(text) == library(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 10_000, "ab" * 4000, "<|endoftext|>", "\n\n\n   x", "x" * 63, "ACGT" * 1500, "don't we'll", "한국어 문장입니다. " * 50])
def test_special_cases(library, text):
    assert T.load(PATH).encode(text) == library(text)


def test_rows_at_once_equal_one_by_one():
    rng = random.Random(1)
    bpe = T.load(PATH)
    pieces = [bytes(rng.choice(b"abcdefghij eiou\xc3\xa9") for _ in range(rng.randrange(1, 70))) for _ in range(2000)]
    assert bpe.encode_pieces(pieces) == [bpe.encode_one(p) if len(p) > 1 else [int(bpe.bytes[p[0]])] for p in pieces]


def test_column_with_nulls_and_clashing_names(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (4, " 　", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in T.encode_column(df).collect())
    assert got == [(1, []), (2, []), (3, library("Hello world")), (3, library("Hello world")), (4, library(" 　"))]
    assert sorted((r.doc_id, r.tokens) for r in T.count_column(df, ["doc_id"]).collect()) == [(k, len(v)) for k, v in got]
    assert T.encode_column(df.limit(0)).count() == 0


def counts(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "small").otherwise("mid").alias("source"), (F.col("id") % 97 + 1).alias("tokens")).repartition(7)


TARGETS = "mix_id string, source string, target_share double, max_repeats int, total_ratio double"


def test_targets_are_met_within_a_document(spark):
    df = counts(spark)
    every = df.agg(F.sum("tokens")).first()[0]
    targets = spark.createDataFrame([("a", "BIG ", 2.0, 3, 0.5), ("a", "mid", 1.0, 3, 0.5), ("a", "none", 1.0, 3, 0.5), ("b", "small", 1.0, 2, 0.9), ("b", None, 1.0, 2, 0.9), ("b", "mid", 0.0, 2, 0.9)], TARGETS)
    mixed = M.mix(df, targets)
    got = {(r.mix_id, r.source): r for r in M.shares(mixed, df, targets).collect()}
    for key in (("a", "big"), ("a", "mid")):
        assert abs(got[key].actual_tokens - got[key].target_tokens) < 97
    assert got["a", "big"].target_tokens == pytest.approx(every * 0.25) and got["a", "none"].actual_tokens == 0 and got["a", "none"].capped
    small = df.where("source = 'small'").agg(F.sum("tokens")).first()[0]
    assert got["b", "small"].capped and got["b", "small"].actual_tokens == 2 * small and got["b", "small"].most_copies == 2
    assert sum(r.actual_share for (m, _), r in got.items() if m == "a") == pytest.approx(1.0, abs=1e-5)
    assert mixed.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, M.mix(df, targets).collect()))


def test_expected_use_is_even(spark):
    df = counts(spark).where("source = 'big'")
    targets = spark.createDataFrame([("a", "big", 1.0, 3, 0.3)], TARGETS)
    picked = M.mix(df, targets)
    by_size = picked.groupBy((F.col("tokens") > 48).alias("large")).agg(F.sum("copies").alias("n"))
    have = {r.large: r.n for r in df.groupBy((F.col("tokens") > 48).alias("large")).agg(F.count("*").alias("n")).collect()}
    for r in by_size.collect():
        assert 0.2 < r.n / have[r.large] < 0.4


def test_dirty_rows(spark):
    df = spark.createDataFrame([(1, "s", 0), (2, None, 5), (None, "s", 5), (3, "s", 10)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", " S", 1.0, None, 1.0), ("c", "s", 1.0, 4, 1.0), ("c", "s", 1.0, 4, 1.0), (None, "s", 1.0, 4, 1.0), ("d", "s", -1.0, 4, 1.0)], TARGETS)
    assert [(r.mix_id, r.doc_id, r.copies) for r in M.mix(df, targets).collect()] in ([("c", 3, 1)], [("c", 3, 2)])
    assert M.mix(df.limit(0), targets).count() == 0 and M.mix(df, targets.limit(0)).count() == 0


def test_pivot_keeps_tokens():
    rng = random.Random(0)
    for _ in range(500):
        one, two = [1, rng.randrange(1, 90), rng.uniform(0.01, 0.99)], [2, rng.randrange(1, 90), rng.uniform(0.01, 0.99)]
        before = one[1] * one[2] + two[1] * two[2]
        M.pivot(one, two)
        assert one[1] * one[2] + two[1] * two[2] == pytest.approx(before)
        assert {one[2], two[2]} & {0.0, 1.0} and 0 <= one[2] <= 1 and 0 <= two[2] <= 1


def test_the_sample_does_not_depend_on_partitions(spark):
    df = counts(spark)
    targets = spark.createDataFrame([("a", "big", 2.0, 3, 0.4), ("a", "mid", 1.0, 3, 0.4), ("b", "big", 1.0, 3, 0.2)], TARGETS)
    for bucket_rows in (M.BUCKET_ROWS, 50):
        one, two = (sorted(map(tuple, M.mix(df.repartition(n), targets, bucket_rows=bucket_rows).collect())) for n in (2, 5))
        assert one == two and one
    a, b = ({r[2] for r in one if r[0] == m and r[1] == "big"} for m in "ab")
    assert not b <= a  # mixes draw apart
    got = {(r.mix_id, r.source): r for r in M.shares(M.mix(df, targets, bucket_rows=50), df, targets).collect()}
    assert all(abs(r.actual_tokens - r.target_tokens) < 97 for r in got.values())


def test_refill_gives_missing_tokens_to_others(spark):
    df = spark.createDataFrame([(i, s, 10) for i, s in enumerate(["x"] * 4 + ["y"] * 100 + ["z"] * 100)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", "x", 1.0, 2, 0.5), ("a", "y", 1.0, 9, 0.5), ("a", "z", 2.0, 9, 0.5), ("a", "gone", 1.0, 9, 0.5), ("b", "x", 1.0, 2, 0.9)], TARGETS)
    rate = {(r.mix_id, r.source): r.rate * r.have for r in M.rates(df, targets, refill=True).collect()}
    assert rate == pytest.approx({("a", "x"): 80.0, ("a", "y"): 940 / 3, ("a", "z"): 1880 / 3, ("a", "gone"): 0.0, ("b", "x"): 80.0})
    plain = {(r.mix_id, r.source): r.rate * r.have for r in M.rates(df, targets).collect()}
    assert plain["a", "y"] == pytest.approx(204.0) and plain["a", "x"] == 80.0
