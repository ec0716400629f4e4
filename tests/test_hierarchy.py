import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.operators import hierarchy as H
from veristrata.operators.nested import NestedSets

#: Hierarchies solved in one task, by rounds of joins, and some of either.
SIZES = pytest.mark.parametrize("whole", [H.WHOLE, 0, 12])

SCHEMA = "run_key string, source_id string, target_id string, relation string, evidence string, id string, parent string"


def edges(spark, rows):
    return spark.createDataFrame([(r, s, t, rel, "x", "clash", "clash") for r, s, t, rel in rows], SCHEMA)


def brute(rows):
    """Roots by walking: (run, relation, node, root)."""
    parents = defaultdict(set)
    for r, s, t, rel in rows:
        rel, s, t = (rel or "").strip().lower(), (s or "").strip(), (t or "").strip()
        if rel in ("parent", "derived_from") and s and t:
            parents[r, rel, s].add((r, rel, t))

    def above(n):
        seen, todo = set(), list(parents.get(n, ()))
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += parents.get(m, ())
        return seen

    up = {n: above(n) for n in list(parents)}
    out = set()
    for n, reach in up.items():
        for m in reach:
            if m not in parents:
                out.add((*n, m[2]))
            elif m in up[m]:
                out.add((*n, min(x[2] for x in up[m] if m in up.get(x, ()))))
    return out


def found(spark, rows, whole=H.WHOLE):
    return {tuple(r) for r in H.roots_reached(edges(spark, rows), whole=whole).collect()}


@SIZES
def test_spelling_nulls_and_cycles(spark, whole):
    rows = [
        ("r", "b", "a", "parent"), ("r", " c ", "b", " Parent"), ("r", "b", "a", "PARENT "), ("r", None, "a", "parent"), ("r", " ", "a", "parent"), ("r", "x", None, "parent"),
        ("r", "c", "z", "parent_note"), ("r", "s", "s", "derived_from"), ("r", "t", "s", "derived_from"), ("r", "q1", "q2", "derived_from"), ("r", "q2", "q1", "derived_from"),
        ("r", "q2", "top", "derived_from"), ("r", "u", "q1", "derived_from"), (None, "b", "a2", "parent"), ("r2", "b", "other", "parent"), ("r", "n", "a", None),
    ]
    assert found(spark, rows, whole) == brute(rows)


@SIZES
def test_random_graphs_equal_brute_force(spark, whole):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        n = rng.choice([3, 8, 20])
        rows += [(f"run{k}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["parent", "derived_from"])) for _ in range(int(n * rng.choice([0.8, 1.1, 1.6])))]
    assert found(spark, rows, whole) == brute(rows)


@SIZES
def test_deep_chain_and_hot_parent(spark, whole):
    rows = [("r", f"n{i:04d}", f"n{i - 1:04d}", "parent") for i in range(1, 300)] + [("r", f"leaf{i}", "n0299", "parent") for i in range(500)]
    got = found(spark, rows, whole)
    assert len(got) == 799 and {x[3] for x in got} == {"n0000"}
    full = {r.node_id: r for r in H.full_hierarchy(edges(spark, rows), whole=whole).collect()}
    assert full["leaf7"].depth == 300 and full["n0000"].descendants == 799 and full["n0299"].descendants == 500
    assert full["leaf7"].path == [f"n{i:04d}" for i in range(300)] + ["leaf7"]
    assert len({r.pre for r in full.values()}) == 800


@SIZES
def test_ranges_hold_exactly_the_descendants(spark, whole):
    rng = random.Random(2)
    rows = [("r", f"n{i:03d}", f"n{rng.randrange(i):03d}", "parent") for i in range(1, 120)]
    parent = {s: t for _, s, t, _ in rows}
    want = set()
    for s in parent:
        t = s
        while t in parent:
            t = parent[t]
            want.add((t, s))
    assert {(r.ancestor_id, r.node_id) for r in H.descendant_pairs(edges(spark, rows), whole=whole).collect()} == want


@SIZES
def test_members_of_cycles_are_named(spark, whole):
    rows = [("r", "b", "a", "parent"), ("r", "a", "c", "parent"), ("r", "c", "b", "parent"), ("r", "d", "c", "parent"), ("r", "a", "z", "parent")]
    full = {r.node_id: r for r in H.full_hierarchy(edges(spark, rows), whole=whole).collect()}
    assert {n for n, r in full.items() if r.cycle_id} == {"a", "b", "c"} and {r.cycle_id for r in full.values() if r.cycle_id} == {"a"}
    assert full["d"].path == ["c", "d"] and full["z"].depth == 0


@SIZES
def test_empty_table(spark, whole):
    assert found(spark, [], whole) == set()
    assert H.full_hierarchy(edges(spark, []), whole=whole).count() == 0
    assert H.descendant_pairs(edges(spark, []), whole=whole).count() == 0


def test_sibling_offsets_do_not_overlap(spark):
    nodes = spark.range(200).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("p").alias("parent"), (F.col("id") % 3 + 1).alias("size"))
    spans = sorted((r.offset, r.size) for r in H.sibling_offsets(nodes).join(nodes, "id").collect())
    at = 1
    for offset, size in spans:
        assert offset == at
        at += size


def test_nested_sets_of_small_graphs_equal_walking():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 5, 8, 15])
        links = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n + 1))})
        child, parent = (np.array([x[i] for x in links], dtype=np.int64) for i in (0, 1))
        sets = NestedSets(n, child, parent)
        up = {v: {p for c, p in links if c == v} for v in range(n)}
        for _ in range(n):
            up = {v: a.union(*(up[x] for x in a)) for v, a in up.items()}
        got = [(int(a), int(d)) for above, below in sets.descendants(range(n)) for a, d in zip(above, below)]
        assert sorted(got) == sorted((a, v) for v in range(n) for a in up[v])
        assert {v for v in range(n) if sets.cycle[v] >= 0} == {v for v in range(n) if v in up[v]}


def test_cycle_records_and_ancestry(spark):
    rows = [("r", "b", "a", "parent"), ("r", "a", "b", "parent"), ("r", "c", "b", "parent"), ("r", "c", "z", "parent"), (None, "x", "x", "derived_from")]
    for whole in (H.WHOLE, 0):
        assert {tuple(r) for r in H.cycle_records(edges(spark, rows), whole=whole).collect()} == {("r", "parent", "a", "a"), ("r", "parent", "b", "a"), (None, "derived_from", "x", "x")}
        wanted = spark.createDataFrame([("r", "c"), ("r", "nobody"), (None, "x")], "run_key string, node_id string")
        assert {(r.node_id, r.ancestor_id) for r in H.ancestry(edges(spark, rows), wanted, whole=whole).collect()} == {("c", "b"), ("c", "a"), ("c", "z"), ("x", "x")}
