import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veristrata.llm import pieces as P

ALPHABET = st.sampled_from(["a", "b ", "\n", "\n\n", ". ", "。", "word ", "x" * 30, "# Head\n\n", "- item\n", "\t", "！", "é", "😀", "y" * 150])


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=120))
def test_pieces_rebuild_the_text(parts):
    text = "".join(parts)
    got = P.split_text(text, 100, 20)
    whole = P.normalized(text)
    assert "".join(p[lap:] for p, _, _, lap, _ in got) == whole
    assert all(0 < len(p) <= 100 for p, *_ in got)
    assert [(a, b) for _, a, b, _, _ in got] == sorted((a, b) for _, a, b, _, _ in got)
    longest = max((len(r) for r in re.split(r"[\s。！？]", whole)), default=0)
    assert any(p[4] for p in got) == (longest > 100)
    for (_, _, b, _, _), (_, a, _, lap, _) in zip(got, got[1:]):
        assert a + lap == b and lap <= 20


def test_limits_are_exact():
    assert len(P.split_text("x" * 1400)) == 1 and not P.split_text("x" * 1400)[0][4]
    assert any(p[4] for p in P.split_text("x" * 1401))
    assert not any(p[4] for p in P.split_text("a " + "x" * 1400 + " b"))
    assert not any(p[4] for p in P.split_text("x" * 1400 + "。" + "y" * 10))
    assert P.split_text(None) == [] and P.split_text(" \t\n ") == []


def test_cuts_prefer_high_boundaries():
    paragraph = "A sentence of some length stands here. " * 20
    got = P.split_text("\n\n".join([paragraph.strip()] * 4))
    assert len(got) > 1 and all(p[lap:].startswith("A sentence") for p, _, _, lap, _ in got) and all(p.rstrip().endswith(".") for p, *_ in got)
    assert all(lap == 160 for _, _, _, lap, _ in got[1:])


SCHEMA = "text_id string, run_key string, kind string, object_id string, locator string, ordinal int, text string, synced_at string, piece string, forced string, k0 string"


def test_ordinals_count_over_the_object(spark):
    rows = [("t2", "r", "k", "o", None, 1, "b " * 900, "2"), ("t1", "r", "k", "o", None, 0, "a " * 900, "1"), ("t1", "r", "k", "o", None, 0, "a " * 900, "0"), ("t3", "r", "k", "o", "x", 0, "c", "0"), ("t4", None, None, None, None, None, None, None), (None, "r", "k", "o", None, 9, "lost", "0"), ("t5", "r", "k", "o", None, 600, "last", "0")]
    df = spark.createDataFrame([(*r, "c1", "c2", "c3") for r in rows], SCHEMA)
    got = sorted((r.locator or "", r.ordinal, r.text_id) for r in P.renumbered_pieces(df).collect())
    assert [x[1] for x in got if not x[0]] == [0, 1, 2, 3, 4] and [x[2] for x in got if not x[0]] == ["t1", "t1", "t2", "t2", "t5"]
    assert ("x", 0, "t3") in got
    assert P.renumbered_pieces(df.limit(0)).count() == 0
    assert {(r.text_id, r.cut) for r in P.oversized(df).collect()} == {("t1", "natural"), ("t2", "natural")}
    assert P.oversized(df.select("text_id", F.lit("z" * 5000).alias("text"))).where("cut = 'forced'").count() == 6


def sections(text, level):
    starts = [m.start() for m in re.finditer(rf"^#{{1,{level}}} ", text, re.M)] + [len(text)]
    return list(zip(starts, starts[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 40)), min_size=1, max_size=12))
def test_a_piece_holds_whole_sections_or_lies_in_one(shape):
    text = P.normalized("\n\n".join("#" * level + f" Head {i}\n\n" + "Some words stand here. " * n for i, (level, n) in enumerate(shape)))
    cores = [(a + lap, b) for _, a, b, lap, _ in P.split_text(text, 300, 40)]
    for level in (1, 2, 3):
        for a, b in sections(text, level):
            if b - a > 300:  # oversized: what it is cut into touches nothing else
                assert all(a <= x and y <= b for x, y in cores if x < b and a < y and not (x <= a and b <= y))
    for x, y in cores:  # no two neighbours of one section fit together
        assert y - x <= 300


def test_lists_are_cut_between_top_items_first():
    item = lambda i: f"- item {i}\n" + "".join(f"    - sub {i}.{j} with some words\n" for j in range(6))
    got = P.split_text("Intro:\n\n" + "".join(item(i) for i in range(8)), 400, 0)
    assert all(p.startswith(("Intro", "- item")) for p, *_ in got)


def test_headings_stay_with_what_follows():
    text = "\n\n".join(["# A\n\n" + "Words of a. " * 20, "Title line\n\n" + "Words of b. " * 20, "Under\n=====\n\n" + "Words of c. " * 20, "<h2>M</h2><p>" + "Words of d. " * 20 + "</p>"])
    got = [p for p, *_ in P.split_text(text, 300, 0)]
    assert [p[:5] for p in got] == ["# A\n\n", "Title", "Under", "<h2>M"]


def test_many_null_and_equal_ordinals(spark):
    rows = [(f"t{i:03d}", "r", "k", "o", None, None if i % 2 else 7, "w " * (900 if i % 5 == 0 else 3), "2") for i in range(120)]
    df = spark.createDataFrame([(*r, "c1", "c2", "c3") for r in rows], SCHEMA)
    got = [r.text_id for r in P.renumbered_pieces(df).orderBy("ordinal").collect()]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[5] is not None, r[0])) for _ in P.split_text(r[6])]
    assert got == want
