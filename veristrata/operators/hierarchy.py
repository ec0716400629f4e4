"""Parent-child links to full hierarchies: nested-set ranges, paths, roots, descendants and cycles.

Subtree sizes are summed upward, preorder ranges given downward by prefix sums of sibling sizes, and
ancestors and descendants are read off the ranges; nodes that the pass leaves unprocessed hold the
cycles. This happens at two sizes, with the same result:

* A hierarchy (one run and relation) of at most ``WHOLE`` links is solved whole in one task
  (``operators.nested``). Links are shuffled once, by hierarchy; all rows come from there.
* A larger hierarchy is solved by rounds of joins: every node's chain of parents is walked by pointer
  doubling, so ``log2(depth)`` rounds sum sizes and offsets. A node with a single parent has the roots
  of that parent, so single-parent links form a forest that collapses to its tops; only records with
  several parents remain, and a closure among them says what they add. No step brings a hierarchy
  into one task: hot parents are prefix-summed in blocks of siblings, and rounds are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.functions.text import stripped
from veristrata.operators.nested import ROWS_AT_ONCE, NestedSets
from veristrata.plans.lineage import cut, release

#: Siblings of one parent are prefix-summed in this many blocks, so a hot parent is no single task.
SIBLING_BLOCKS = 64
#: A forest deeper than 2 ** MAX_ROUNDS is refused instead of looping for ever.
MAX_ROUNDS = 48
#: A hierarchy of at most so many links is solved in one task.
WHOLE = 200_000


def clean_edges(edges: DataFrame, relations: tuple[str, ...] = ("derived_from", "parent")) -> DataFrame:
    """Distinct (run_key, relation, child, parent) of usable hierarchy edges.

    Outer blanks of ids and relation and the case of the relation do not count; rows with a null or
    blank id, a null relation or another relation are no edge; repeated rows count once. A null
    ``run_key`` is a run of its own. Columns beside the four that are read are ignored.
    """
    relation = F.lower(stripped(F.col("relation")))
    return (
        edges.select(
            "run_key",
            relation.alias("relation"),
            stripped(F.col("source_id")).alias("child"),
            stripped(F.col("target_id")).alias("parent"),
        )
        .where(F.col("relation").isin(*relations) & (F.length("child") > 0) & (F.length("parent") > 0))
        .distinct()
    )


def _node_of(column: Column) -> Column:
    return F.substring_index(column, "\u0001", -1)


def _double(state: DataFrame, payload: dict[str, str]) -> DataFrame:
    """One round of pointer doubling: ptr and ``payload`` sums of finished and unfinished nodes.

    payload maps a column to the way it combines: "sum", "min" or "concat".
    """
    unfinished = state.where(F.col("ptr").isNotNull())
    other = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("root").alias("root2"), *[F.col(c).alias(f"{c}2") for c in payload])
    how = {"sum": lambda c: F.col(c) + F.col(f"{c}2"), "min": lambda c: F.least(c, f"{c}2"), "concat": lambda c: F.concat(c, f"{c}2")}
    moved = unfinished.join(other, "ptr").select("id", F.col("next").alias("ptr"), F.col("root2").alias("root"), *[how[k](c).alias(c) for c, k in payload.items()])
    return moved.unionByName(state.where(F.col("ptr").isNull()))


def walk_up(links: DataFrame, payload: dict[str, tuple[Column, Column, str]]) -> tuple[DataFrame, DataFrame, int]:
    """Pointer doubling over ``links`` (id, parent; null parent = root).

    payload: column -> (value of a node with a parent, value of a root, way to combine). Returns the
    nodes that reach a root (id, root, payload), the others after as many rounds (id, ptr, payload),
    and the number of rounds. A depth in [2^k, 2^(k+1)) can only occur if one in [2^(k-1), 2^k)
    does, so a round that finishes no node proves that the rest hangs on cycles.
    """
    ways = {c: how for c, (_, _, how) in payload.items()}
    is_root = F.col("parent").isNull()
    state = cut(
        links.select(
            "id",
            F.col("parent").alias("ptr"),
            F.when(is_root, F.col("id")).alias("root"),
            *[F.when(is_root, top).otherwise(inner).alias(c) for c, (inner, top, _) in payload.items()],
        )
    )
    left = state.where(F.col("ptr").isNotNull()).count()
    rounds = 0
    while left:
        if rounds == MAX_ROUNDS:
            raise RuntimeError("the hierarchy is too deep")
        state = cut(_double(state, ways), state)
        rounds += 1
        now = state.where(F.col("ptr").isNotNull()).count()
        if now == left:
            break
        left = now
    done = state.where(F.col("ptr").isNull()).drop("ptr")
    return done, state.where(F.col("ptr").isNotNull()).drop("root"), rounds


def cycle_members(links: DataFrame, unprocessed: DataFrame) -> DataFrame:
    """(id, cycle, on_cycle) of the nodes that ``walk_up`` left: the cycle's smallest id, and whether the node lies on it.

    The image of the unprocessed nodes under 2^k steps shrinks to the cycles; as it no longer
    shrinks and the minimum along 2^k steps no longer falls, both are final.
    """
    start = links.join(unprocessed.select("id"), "id", "left_semi").select("id", F.col("parent").alias("ptr"), F.col("id").alias("low"))
    state = cut(start)
    last = None
    for _ in range(MAX_ROUNDS):
        ring = state.select(F.col("ptr").alias("id")).distinct().join(state, "id")
        image, total = ring.agg(F.count("*"), F.sum(F.xxhash64("id", "low").cast("decimal(38,0)"))).first()
        if (image, total) == last or image == 0:
            break
        last = (image, total)
        other = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("low2"))
        state = cut(state.join(other, "ptr").select("id", F.col("next").alias("ptr"), F.least("low", "low2").alias("low")), state)
    else:
        raise RuntimeError("cycles did not settle")
    ring = state.select(F.col("ptr").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    lows = state.select(F.col("id").alias("ptr"), F.col("low").alias("cycle"))
    return state.select("id", "ptr").join(lows, "ptr").join(ring, "id", "left").select("id", "cycle", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def sibling_offsets(nodes: DataFrame, blocks: int = SIBLING_BLOCKS) -> DataFrame:
    """(id, offset): 1 + the sizes of the earlier siblings, in id order, from ``nodes`` (id, parent, size).

    Siblings are split into blocks by a hash (their order within a hot parent is by block, then by
    id); block sums are pre-aggregated, so no window partition holds all children of a hot parent.
    """
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    base = nodes.where(F.col("parent").isNotNull()).select("id", "parent", "size", block.alias("block"))
    sums = base.groupBy("parent", "block").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("parent", "block", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("parent", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inner = base.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(sums, ["parent", "block"]).select("id", (F.lit(1) + F.col("ahead") + F.col("inner")).alias("offset"))


def subtree_sizes(links: DataFrame, rounds: int) -> DataFrame:
    """(id, size): nodes of each subtree, summed upward; after round k a node has what lies within 2^k links below it."""
    state = cut(links.select("id", F.col("parent").alias("ptr"), F.lit(1).cast("long").alias("size")))
    for _ in range(rounds + 1):
        given = state.where(F.col("ptr").isNotNull()).groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("more"))
        hop = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        moved = state.where(F.col("ptr").isNotNull()).join(hop, "ptr").select("id", F.col("next").alias("ptr"), "size").unionByName(state.where(F.col("ptr").isNull()))
        state = cut(moved.join(given, "id", "left").select("id", "ptr", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), state)
    return state.select("id", "size")


def nested_sets(links: DataFrame) -> DataFrame:
    """Nested-set ranges of a forest with cycles.

    links: (id, parent) with one row for each node, null parent = root. Result: id, parent, root,
    depth, low (smallest id on the way to the root), pre, size, cycle, on_cycle. ``[pre, pre + size)``
    holds exactly the node and its descendants within the tree of ``root``. Nodes on a cycle or
    below one have null root, depth, low, pre and size, and name the cycle by its smallest id. An
    empty input gives an empty result.
    """
    links = cut(links.select("id", "parent"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    done, rest, rounds = walk_up(links, {"depth": (one, zero, "sum"), "low": (F.col("id"), F.col("id"), "min")})
    tree = cut(done.join(links, "id"))
    sizes = subtree_sizes(tree.select("id", "parent"), rounds)
    sized = cut(tree.join(sizes, "id"), tree)
    offsets = sibling_offsets(sized)
    placed = sized.select("id", "parent").join(offsets, "id", "left")
    pre, _, _ = walk_up(placed, {"pre": (F.col("offset"), zero, "sum")})
    none = lambda kind: F.lit(None).cast(kind)
    good = sized.join(pre.select("id", "pre"), "id").select("id", "parent", "root", "depth", "low", "pre", "size", none("string").alias("cycle"), F.lit(False).alias("on_cycle"))
    if rest.isEmpty():
        return good
    bad = cycle_members(links, rest).join(links, "id").select("id", "parent", none("string").alias("root"), none("long").alias("depth"), none("string").alias("low"), none("long").alias("pre"), none("long").alias("size"), "cycle", "on_cycle")
    return good.unionByName(bad)


def paths(links: DataFrame) -> DataFrame:
    """(id, path): ids from the root to each node of a forest (id, parent); nodes on cycles or below have none. As large as its result."""
    done, _, _ = walk_up(links.select("id", "parent"), {"up": (F.array("id"), F.array("id"), "concat")})
    return done.select("id", F.reverse("up").alias("path"))


def enclosing(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(ancestor, point) for every range of ``nodes`` that holds a point (id, root, pre), without comparing all pairs.

    Each range is cut into dyadic blocks of positions of its tree (two for each power of two at
    most), and a position meets the blocks that hold it, so the join is an equality on (root, level,
    block) and its output is the result itself. A node encloses itself.
    """
    own = nodes.where(F.col("pre").isNotNull()).select(F.col("id").alias("ancestor"), "root", "pre", "size")
    blocks = cut(own.withColumn("part", F.explode(_dyadic(F.col("pre"), F.col("pre") + F.col("size")))).select("ancestor", "root", "part.level", "part.block"))
    levels = F.broadcast(blocks.select("level").distinct())  # 64 rows at most
    at = points.where(F.col("pre").isNotNull()).select(F.col("id").alias("point"), "root", "pre").crossJoin(levels)
    return blocks.join(at.withColumn("block", F.expr("shiftright(pre, level)")), ["root", "level", "block"]).select("ancestor", "point")


def _dyadic(low: Column, high: Column) -> Column:
    """Maximal aligned blocks (level, block) that make up [low, high)."""
    start = F.struct(low.alias("lo"), high.alias("hi"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        one = F.lit(1).cast("long")
        left = (lo < hi) & (lo.bitwiseAND(one) == 1)
        lo2 = F.when(left, lo + 1).otherwise(lo)
        right = (lo2 < hi) & (hi.bitwiseAND(one) == 1)
        hi2 = F.when(right, hi - 1).otherwise(hi)
        block = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.cast("long").alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        out = F.concat(s["out"], F.when(left, block(lo)).otherwise(none), F.when(right, block(hi2)).otherwise(none))
        return F.struct(F.shiftright(lo2, 1).alias("lo"), F.shiftright(hi2, 1).alias("hi"), out.alias("out"))

    levels = F.sequence(F.lit(0), F.ceil(F.log2(high.cast("double") + 1)).cast("int"))
    return F.aggregate(levels, start, step, lambda s: s["out"])


class Hierarchy:
    """The hierarchies of an edge table; see ``Hierarchy.of``. All members are DataFrames keyed by ``id``."""

    def __init__(self, edges: DataFrame, forest: DataFrame, reach: DataFrame, above: DataFrame) -> None:
        self.edges, self.forest, self.reach, self.above = edges, forest, reach, above

    @staticmethod
    def of(edges: DataFrame) -> "Hierarchy":
        """edges: distinct (id, parent). Reduces them by nested sets over single-parent links, then closes over the rest."""
        edges = cut(edges.select("id", "parent"))
        degree = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
        tops = edges.select(F.col("parent").alias("id")).distinct().join(degree, "id", "left_anti").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("n"))
        nodes = degree.select("id", F.when(F.col("n") == 1, F.col("parent")).alias("parent"), "n").unionByName(tops)
        nodes = cut(nodes)
        forest = cut(nested_sets(nodes))
        many = nodes.where(F.col("n") > 1).select("id")
        return Hierarchy(edges, forest, *_reach(edges, forest, many))

    def roots(self) -> DataFrame:
        """(id, root_id) for each node that has a parent, together with each root or cycle it reaches."""
        top = self.forest.select("id", F.coalesce("root", "cycle").alias("top"))
        children = self.edges.select("id").distinct().join(top, "id")
        through = children.join(self.reach.select(F.col("id").alias("top"), "terminal"), "top", "left")
        return through.select("id", F.coalesce("terminal", "top").alias("root_id")).distinct()

    def cycles(self) -> DataFrame:
        """(id, cycle): every record that lies on a cycle and the smallest id of the cycle."""
        plain = self.forest.where("on_cycle").select("id", "cycle")
        knots = self.reach.where(F.col("scc").isNotNull()).select(F.col("id"), F.col("scc").alias("cycle")).distinct()
        tops = self.forest.where(F.col("root").isNotNull()).select("id", F.col("root").alias("top"), "pre")
        heads = _exits(self.edges, self.forest).join(knots.select(F.col("id").alias("from_id"), F.col("cycle").alias("c1")), "from_id").join(knots.select(F.col("id").alias("head"), F.col("cycle").alias("c2")), "head")
        ends = heads.where("c1 = c2").join(tops.select(F.col("id").alias("parent"), "pre", F.col("top").alias("root")), "parent").select(F.struct("parent", "c1").alias("id"), "root", "pre")
        between = enclosing(self.forest.where(F.col("root").isNotNull()), ends).select(F.col("ancestor").alias("id"), F.col("point.c1").alias("cycle"))
        return plain.unionByName(knots).unionByName(between).distinct()

    def pairs(self) -> DataFrame:
        """(ancestor, descendant): every pair that parent links join, over any parent; a record on a cycle is its own descendant.

        Below a record with several parents or on a cycle hangs a tree of single-parent links, whose
        own pairs come from its ranges. All of such a tree also lies below what the closure has above
        its top, so no step makes more rows than the result has, but for those reached twice.
        """
        rings = self.forest.where("on_cycle").select("id", "cycle")
        bent = self.forest.where("cycle IS NOT NULL").select("id", F.when(~F.col("on_cycle"), F.col("parent")).alias("parent"), "cycle")
        columns = ["id", "root", "pre", "size", "cycle"]
        trees = self.forest.where("cycle IS NULL").select(*columns)
        if not bent.isEmpty():
            trees = trees.unionByName(nested_sets(bent).drop("cycle").join(bent.select("id", "cycle"), "id").select(*columns))
        trees = cut(trees)
        several = self.edges.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        over = self.edges.join(several, "id", "left_semi").select(F.col("id").alias("b"), F.col("parent").alias("id")).join(trees.select("id", "root", "pre", "cycle"), "id")
        ring = rings.select(F.col("id").alias("ancestor"), "cycle")
        inside = enclosing(trees, over.select(F.col("b").alias("id"), "root", "pre")).select(F.col("point").alias("b"), "ancestor")
        first = inside.unionByName(over.join(ring, "cycle").select("b", "ancestor")).distinct()
        high = self.above.join(first, "b").select(F.col("a").alias("root"), "ancestor").unionByName(rings.withColumnRenamed("id", "root").join(ring, "cycle").select("root", "ancestor")).distinct()
        through = trees.select("root", F.col("id").alias("descendant")).join(cut(high), "root").select("ancestor", "descendant")
        within = enclosing(trees.where("size > 1"), trees).where("ancestor <> point").select("ancestor", F.col("point").alias("descendant"))
        return within.unionByName(through).distinct()


def _exits(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """(from_id, parent, head, low): links of records with several parents, led on to the top of the parent's tree, with the smallest id passed."""
    several = edges.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    top = forest.select(F.col("id").alias("parent"), F.coalesce("root", "cycle").alias("head"), "low", F.col("cycle").isNotNull().alias("to_cycle"))
    return edges.join(several, "id", "left_semi").join(top, "parent").select(F.col("id").alias("from_id"), "parent", "head", "low", "to_cycle")


def _reach(edges: DataFrame, forest: DataFrame, many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, terminal, scc) for each record with several parents: each root or cycle it reaches, and its own cycle; and (a, b), the closure among them with each record itself.

    The reduced graph holds only records with several parents and the tops they lead to. Its
    closure is squared until it no longer grows; mutual reachability gives the cycles.
    """
    exits = cut(_exits(edges, forest))
    inner = exits.join(many.select(F.col("id").alias("head")), "head", "left_semi")
    step = inner.select(F.col("from_id").alias("a"), F.col("head").alias("b")).distinct()
    closure, size = cut(step), -1
    while (now := closure.count()) != size:
        size = now
        more = closure.select("a", F.col("b").alias("m")).join(closure.select(F.col("a").alias("m"), F.col("b").alias("c")), "m").select("a", F.col("c").alias("b"))
        closure = cut(closure.unionByName(more).distinct(), closure)
    mutual = closure.join(closure.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
    knot = mutual.groupBy("a").agg(F.min("b").alias("knot"))  # smallest member among records with several parents
    knot = cut(knot)
    left, right = knot.select(F.col("a").alias("from_id"), "knot"), knot.select(F.col("a").alias("head"), F.col("knot").alias("knot2"))
    names = inner.join(left, "from_id").join(right, "head").where("knot = knot2").groupBy("knot").agg(F.least(F.min("low"), F.min("from_id")).alias("scc"))
    scc = knot.join(names, "knot").select(F.col("a").alias("id"), "scc")
    ends = exits.join(many.select(F.col("id").alias("head")), "head", "left_anti").select(F.col("from_id").alias("b"), F.col("head").alias("terminal"))
    terminals = ends.unionByName(scc.select(F.col("id").alias("b"), F.col("scc").alias("terminal")))
    self_and_above = cut(closure.unionByName(many.select(F.col("id").alias("a"), F.col("id").alias("b"))).distinct())
    found = self_and_above.join(terminals, "b").select(F.col("a").alias("id"), "terminal").distinct()
    return cut(found.join(scc, "id", "left")), self_and_above


def _split(df: DataFrame, key: str) -> list[Column]:
    """run_key and relation of a key column."""
    run = F.substring_index(F.col(key), "\u0001", 1)
    return [F.when(run.startswith("r"), F.expr(f"substring(substring_index({key}, chr(1), 1), 2)")).alias("run_key"), F.element_at(F.split(F.col(key), "\u0001"), 2).alias("relation")]


def _by_size(record_edges: DataFrame, relations: tuple[str, ...], whole: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (grp, child, parent) of hierarchies of at most ``whole`` links, and keyed links (id, parent) of larger ones, if there are any."""
    edges = clean_edges(record_edges, relations)
    grp = F.concat(F.coalesce(F.concat(F.lit("r"), "run_key"), F.lit("n")), F.lit("\u0001"), F.col("relation"))
    edges = cut(edges.select(grp.alias("grp"), "child", "parent"))
    large = cut(edges.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("grp"))
    if large.isEmpty():
        release(large)
        return edges, None
    key = lambda c: F.concat("grp", F.lit("\u0001"), F.col(c))
    rest = edges.join(large, "grp", "left_semi").select(key("child").alias("id"), key("parent").alias("parent"))
    return edges.join(large, "grp", "left_anti"), rest


def _solved(edges: DataFrame, emit: Callable[[NestedSets, np.ndarray, pa.Array, pa.Array, pa.Array], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``emit`` gives for the nested sets of whole hierarchies (grp, child, parent); hierarchies are gathered until they have ROWS_AT_ONCE links."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        grp = rows.column("grp").combine_chunks().dictionary_encode()
        ids = pa.chunked_array([*rows.column("child").chunks, *rows.column("parent").chunks]).combine_chunks().dictionary_encode()
        words = ids.dictionary
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.argsort(np.array(words.to_pylist(), dtype=object), kind="stable")] = np.arange(len(words))
        names = words.take(pa.array(np.argsort(rank)))
        code = rank[ids.indices.to_numpy()]
        of = grp.indices.to_numpy().astype(np.int64)
        nodes, number = np.unique(np.concatenate([of, of]) * len(words) + code, return_inverse=True)
        group, name = nodes // len(words), names.take(pa.array(nodes % len(words)))
        heads = [g.split("\u0001") for g in grp.dictionary.to_pylist()]
        run = pa.array([h[0][1:] if h[0].startswith("r") else None for h in heads], type=pa.string())
        relation = pa.array([h[1] for h in heads], type=pa.string())
        yield from emit(NestedSets(len(nodes), number[: len(of)], number[len(of) :]), group, name, run, relation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                rows = pa.Table.from_batches(held)
                last = rows.column("grp")[-1]
                split = pc.index(rows.column("grp"), last).as_py()
                if split:
                    yield from solve(rows.slice(0, split))
                rest = rows.slice(split).combine_chunks()
                held, size = rest.to_batches(), rest.num_rows if split else 0
        if held:
            yield from solve(pa.Table.from_batches(held))

    return edges.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, schema)


def _emit_pairs(tops: bool, names: tuple[str, str]) -> Callable:
    """Emits (run_key, relation, ancestor, descendant) of tops only, or of all nodes."""

    def emit(sets: NestedSets, group: np.ndarray, name: pa.Array, run: pa.Array, relation: pa.Array) -> Iterator[pa.RecordBatch]:
        for above, below in sets.descendants(sets.tops() if tops else range(sets.n)):
            g = pa.array(group[below])
            yield pa.RecordBatch.from_arrays([run.take(g), relation.take(g), name.take(pa.array(above)), name.take(pa.array(below))], names=["run_key", "relation", *names])

    return emit


FULL = "run_key string, relation string, node_id string, top_id string, depth bigint, path array<string>, pre bigint, last bigint, descendants bigint, cycle_id string"


def _emit_nodes(sets: NestedSets, group: np.ndarray, name: pa.Array, run: pa.Array, relation: pa.Array) -> Iterator[pa.RecordBatch]:
    """Emits a row of ``full_hierarchy`` for each node."""
    who, low, high = sets.ranges(range(sets.n))
    below = np.bincount(who, weights=high - low, minlength=sets.n).astype(np.int64)
    pos, size, top = (np.array(x, dtype=np.int64) for x in (sets.pos, sets.size, sets.top))
    pre, cycle, depth = pos - pos[top], np.array(sets.cycle), np.array(sets.depth, dtype=np.int64)
    ends = np.cumsum(depth + 1)
    start = 0
    while start < sets.n:  # as many nodes at once as their paths allow
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ROWS_AT_ONCE, side="right")))
        at = np.arange(start, end)
        steps = [sets.path(v) for v in range(start, end)]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in steps])])
        path = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), name.take(pa.array(np.concatenate(steps), type=pa.int64())))
        g = pa.array(group[at])
        ring = name.take(pa.array(cycle[at], type=pa.int64(), mask=cycle[at] < 0))
        yield pa.RecordBatch.from_arrays(
            [run.take(g), relation.take(g), name.take(pa.array(at)), name.take(pa.array(top[at])), pa.array(depth[at]), path, pa.array(pre[at]), pa.array(pre[at] + size[at] - 1), pa.array(below[at]), ring],
            names=[c.split()[0] for c in FULL.split(", ")],
        )
        start = end


def roots_reached(record_edges: DataFrame, relations: tuple[str, ...] = ("derived_from", "parent"), whole: int = WHOLE) -> DataFrame:
    """(run_key, relation, node_id, root_id): each record with a parent and every root or cycle it reaches.

    These are the ranges of the roots. Handles null and blank ids, uneven spelling, repeated edges,
    several parents, self-parents and cycles of any size; an empty table gives no rows.
    """
    small, large = _by_size(record_edges, relations, whole)
    columns = ("run_key", "relation", "node_id", "root_id")
    found = _solved(small, _emit_pairs(True, ("root_id", "node_id")), "run_key string, relation string, root_id string, node_id string").select(*columns)
    if large is None:
        return found
    more = Hierarchy.of(large).roots()
    return found.unionByName(more.select(*_split(more, "id"), _node_of(F.col("id")).alias("node_id"), _node_of(F.col("root_id")).alias("root_id")))


def descendant_pairs(record_edges: DataFrame, relations: tuple[str, ...] = ("derived_from", "parent"), whole: int = WHOLE) -> DataFrame:
    """(run_key, relation, ancestor_id, node_id): every descendant of every record, over all parents and through cycles; a record on a cycle is its own."""
    small, large = _by_size(record_edges, relations, whole)
    found = _solved(small, _emit_pairs(False, ("ancestor_id", "node_id")), "run_key string, relation string, ancestor_id string, node_id string")
    if large is None:
        return found
    more = Hierarchy.of(large).pairs()
    return found.unionByName(more.select(*_split(more, "ancestor"), _node_of(F.col("ancestor")).alias("ancestor_id"), _node_of(F.col("descendant")).alias("node_id")))


def full_hierarchy(record_edges: DataFrame, relations: tuple[str, ...] = ("derived_from", "parent"), whole: int = WHOLE) -> DataFrame:
    """One row for each record: path from its top (a list of ids), depth, top, nested-set range, number of descendants, cycle.

    A record with several parents is placed below the smallest of them (``roots_reached`` has all of
    its roots); records on a cycle stand as tops of their own and name the cycle. Range, path and depth
    are those of this placing; ``descendants`` counts the rows of ``descendant_pairs``, over all parents.
    """
    small, large = _by_size(record_edges, relations, whole)
    found = _solved(small, _emit_nodes, FULL)
    if large is None:
        return found
    hierarchy = Hierarchy.of(large)
    edges, cycles = hierarchy.edges, cut(hierarchy.cycles())
    first = edges.groupBy("id").agg(F.min("parent").alias("parent"))
    nodes = edges.select("id").unionByName(edges.select(F.col("parent").alias("id"))).distinct()
    links = cut(nodes.join(first, "id", "left").join(cycles, "id", "left").select("id", F.when(F.col("cycle").isNull(), F.col("parent")).alias("parent")))
    counts = hierarchy.pairs().groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("below"))
    forest = nested_sets(links).drop("cycle", "on_cycle").join(cycles, "id", "left").join(paths(links), "id").join(counts, "id", "left")
    more = forest.select(
        *_split(forest, "id"),
        _node_of(F.col("id")).alias("node_id"),
        _node_of(F.col("root")).alias("top_id"),
        "depth",
        F.transform("path", lambda x: _node_of(x)).alias("path"),
        "pre",
        (F.col("pre") + F.col("size") - 1).alias("last"),
        F.coalesce("below", F.lit(0)).alias("descendants"),
        _node_of(F.col("cycle")).alias("cycle_id"),
    )
    return found.unionByName(more)


def cycle_records(record_edges: DataFrame, relations: tuple[str, ...] = ("derived_from", "parent"), whole: int = WHOLE) -> DataFrame:
    """(run_key, relation, node_id, cycle_id): every record that lies on a cycle, and the smallest id of the cycle."""

    def emit(sets: NestedSets, group: np.ndarray, name: pa.Array, run: pa.Array, relation: pa.Array) -> Iterator[pa.RecordBatch]:
        cycle = np.array(sets.cycle)
        at = np.flatnonzero(cycle >= 0)
        g = pa.array(group[at])
        yield pa.RecordBatch.from_arrays([run.take(g), relation.take(g), name.take(pa.array(at)), name.take(pa.array(cycle[at]))], names=["run_key", "relation", "node_id", "cycle_id"])

    small, large = _by_size(record_edges, relations, whole)
    found = _solved(small, emit, "run_key string, relation string, node_id string, cycle_id string")
    if large is None:
        return found
    more = Hierarchy.of(large).cycles()
    return found.unionByName(more.select(*_split(more, "id"), _node_of(F.col("id")).alias("node_id"), _node_of(F.col("cycle")).alias("cycle_id")))


def ancestry(record_edges: DataFrame, wanted: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(run_key, relation, node_id, ancestor_id): all records above the ``wanted`` ones (run_key, node_id), over all parents."""
    pairs = descendant_pairs(record_edges, whole=whole)
    keys = wanted.select(F.col("run_key").alias("__r"), F.col("node_id").alias("__n")).distinct()
    return pairs.join(keys, pairs.run_key.eqNullSafe(keys["__r"]) & (pairs.node_id == keys["__n"]), "left_semi").select("run_key", "relation", "node_id", "ancestor_id")
