import random

from tests.test_hierarchy import SIZES, edges
from veristrata.operators import hierarchy as H


def closure(rows):
    """All (run, relation, ancestor, descendant) by walking over every parent link."""
    parents = {}
    for r, s, t, rel in rows:
        parents.setdefault((r, rel, s), set()).add(t)
    out = set()
    for (r, rel, s), first in parents.items():
        seen, todo = set(), list(first)
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += parents.get((r, rel, m), ())
        out |= {(r, rel, a, s) for a in seen}
    return out


def pairs(spark, rows, whole):
    got = [tuple(x) for x in H.descendant_pairs(edges(spark, rows), whole=whole).collect()]
    assert len(got) == len(set(got))
    return set(got)


@SIZES
def test_descendants_over_second_parents_and_cycles(spark, whole):
    rng = random.Random(11)
    rows = [("d", "x", "a", "parent"), ("d", "x", "b", "parent"), ("d", "y", "x", "parent"), ("d", "b", "top", "parent")]
    rows += [("c", "b", "a", "parent"), ("c", "a", "c", "parent"), ("c", "c", "b", "parent"), ("c", "d", "c", "parent"), ("c", "e", "d", "parent"), ("c", "e", "q", "parent")]
    rows += [("s", "s", "s", "derived_from"), ("s", "t", "s", "derived_from")]
    for k in range(12):
        n = rng.choice([4, 9, 20])
        rows += [(f"run{k}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["parent", "derived_from"])) for _ in range(int(n * rng.choice([0.8, 1.2, 1.7])))]
    want = closure(rows)
    assert ("d", "parent", "top", "y") in want and ("c", "parent", "a", "a") in want
    assert pairs(spark, rows, whole) == want
    counts = {(r.run_key, r.relation, r.node_id): r.descendants for r in H.full_hierarchy(edges(spark, rows), whole=whole).collect()}
    assert counts == {n: sum(1 for w in want if w[:3] == n) for n in counts} and {w[:3] for w in want} <= set(counts)
