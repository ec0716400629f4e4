"""Consolidating pairwise matches into groups: minimum labels, pointer jumping, contraction.

Each round every node takes the smallest label among itself and its neighbours; the chains that this
makes are shortened by pointer jumping until all point to their end, in which only nodes that still
moved take part; then edges are rewritten to the ends, loops and repeated edges fall away, and what is
left goes to the next round. After two rounds every node that still has an edge has merged with
another, so the rounds are logarithmic in the number of nodes, however long the chains are. What
is left of at most ``TAIL_EDGES`` edges is finished by the same steps in one task. Nodes
without an edge take no part in later rounds: what the rounds found is composed once at the end, from
the last and smallest to the first.

Labels are 64-bit hashes of the names; names whose hashes collide get numbers of their own. Minima are
pre-aggregated, and lookups of the label that a large component shares are salted (``plans.skew``).
Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.records import strict_json
from veristrata.functions.text import stripped
from veristrata.plans.lineage import cut, release, seen
from veristrata.plans.skew import HOT_ROWS, lookup

DOI = r"^(?:doi:\s*|https://doi\.example/|http://dx\.doi\.example/)?(10\.[0-9]{4,9}/[^\s\p{Z}]+)$"
MAX_ROUNDS = 64
#: Rounds with at most so many edges are done in one task.
TAIL_EDGES = 250_000


def numbered(edges: DataFrame, code: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (a, b) by number, from edges (a, b) by name.

    The number of a name is its hash; names that share a hash are numbered apart (there are about
    n^2 / 2^65 of them, so their table is broadcast). ``code`` makes a number of a name.
    """
    names = edges.select(F.explode(F.array("a", "b")).alias("name")).select(code(F.col("name")).alias("id"), "name")
    found = cut(names.groupBy("id").agg(F.min("name").alias("name"), F.max("name").alias("last")), twice=F.count_if(F.col("name") != F.col("last")))
    twice = found.where("name <> last")
    if not seen(found, "twice"):
        return found.select("id", "name"), edges.select(*[code(F.col(c)).alias(c) for c in ("a", "b")])
    apart = names.join(F.broadcast(twice.select("id")), "id").select("name").distinct()
    apart = cut(apart.select("name", (-F.monotonically_increasing_id() - 1).alias("own")))
    used = apart.join(found, (apart.own == found.id), "left_semi")
    if not used.isEmpty():
        raise RuntimeError("numbers of colliding names are taken")
    nodes = found.join(F.broadcast(twice.select("id")), "id", "left_anti").select("id", "name").unionByName(apart.select(F.col("own").alias("id"), "name"))
    out = edges.select("a", "b")
    for c in ("a", "b"):
        own = F.broadcast(apart.select(F.col("name").alias(c), F.col("own").alias(f"{c}_own")))
        out = out.join(own, c, "left").withColumn(f"{c}_id", F.coalesce(f"{c}_own", code(F.col(c))))
    return nodes, out.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def tail_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, label) of the nodes of a bounded number of edges, by the same minimum labels and jumps in memory."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        while (low[low] != low).any():
            low = low[low]
        if (low[a] == low[b]).all():
            return ids, ids[low]
        a, b, label = low[a], low[b], low


def _tail(live: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        if rows.num_rows:
            ids, label = tail_labels(rows.column("a").to_numpy(), rows.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], names=["id", "label"])

    return live.coalesce(1).mapInArrow(run, "id bigint, label bigint")


def labelled(edges: DataFrame, hot_rows: int = HOT_ROWS, tail: int = TAIL_EDGES) -> DataFrame:
    """(id, label) of every node of ``edges`` (a, b; numbers) that has an edge to another: one node of its component, the same for all."""
    live = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found: list[tuple[DataFrame, int]] = []
    while (size := seen(live)) > tail:
        if len(found) == MAX_ROUNDS:
            raise RuntimeError("groups did not settle")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to")))
        rows = seen(point)
        point = _jumped(point, hot_rows)
        found.append((point, rows))
        ends = point.where("id <> to")
        one, two = ends.select(F.col("id").alias("a"), F.col("to").alias("a2")), ends.select(F.col("id").alias("b"), F.col("to").alias("b2"))
        moved = lookup(live, one, "a", size, "left", hot_rows).select(F.coalesce("a2", "a").alias("a"), "b")
        moved = lookup(moved, two, "b", size, "left", hot_rows).select("a", F.coalesce("b2", "b").alias("b")).where("a <> b")
        live = cut(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), live)
    labels = cut(_tail(live), live)
    while found:
        point, rows = found.pop()
        later = labels.select(F.col("id").alias("to"), "label")
        labels = cut(lookup(point, later, "to", rows, "left", hot_rows).select("id", F.coalesce("label", "to").alias("label")), labels)
    return labels


def _jumped(point: DataFrame, hot_rows: int) -> DataFrame:
    """(id, to) with every ``to`` at the end of its chain. A node that a jump does not move has arrived and jumps no more."""
    parts: list[DataFrame] = []
    moving, size = point, seen(point)
    while size:
        hop = point if not parts else moving.select("id", "to").unionByName(_all(parts))
        step = cut(lookup(moving, hop.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", size, "inner", hot_rows).select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), moved=F.count_if("moved"))
        parts.append(step.where("NOT moved").select("id", "to"))
        moving = step.where("moved").select("id", "to")
        size = seen(step, "moved")
    release(point)
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def components(edges: DataFrame, hot_rows: int = HOT_ROWS, tail: int = TAIL_EDGES) -> DataFrame:
    """(id, label) of every node of ``edges`` (a, b): the smallest node of its connected component.

    Edges with a null end are left out, loops and repeated edges are harmless; an empty table gives
    no rows.
    """
    known = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    nodes, links = numbered(known)
    return named(nodes, labelled(links, hot_rows, tail), hot_rows).select(F.col("name").alias("id"), F.col("least").alias("label"))


def named(nodes: DataFrame, labels: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(name, least): the smallest name among ``nodes`` (id, name) of the component of each; nodes without a label stand alone."""
    placed = cut(nodes.join(labels, "id", "left").select("name", F.coalesce("label", "id").alias("label")))
    least = placed.groupBy("label").agg(F.min("name").alias("least"))
    return lookup(placed, least, "label", seen(placed), "inner", hot_rows).select("name", "least")


def clean(column: Column) -> Column:
    """Without outer blanks and letter case; null if nothing is left."""
    name = F.lower(stripped(column))
    return F.when(F.length(name) > 0, name)


def doi(column: Column) -> Column:
    """The bare DOI in lower case, or null."""
    found = F.regexp_extract(clean(column), DOI, 1)
    return F.when(F.length(found) > 0, found)


def alias_name(column: Column) -> Column:
    """An alias as a name; a ``doi:`` name without a DOI is none."""
    name = clean(column)
    return F.when(name.startswith("doi:"), F.concat(F.lit("doi:"), doi(name))).otherwise(name)


def candidate_names(observations: DataFrame) -> DataFrame:
    """(candidate_id, name) of each name of each candidate.

    Names are ``provider:provider_id``, ``doi:`` and ``openalex:``; a payload that is no valid JSON
    gives none, rows without candidate_id are left out.
    """
    field = lambda name: F.expr(f"try_variant_get(v, '$.{name}', 'string')")
    rows = observations.where(F.col("candidate_id").isNotNull()).select("candidate_id", clean(F.col("provider")).alias("provider"), strict_json(F.col("payload")).alias("v"))
    rows = rows.select("candidate_id", "provider", clean(field("provider_id")).alias("pid"), doi(field("doi")).alias("doi"))
    last = F.regexp_extract("pid", r"(?:^|/)(w[0-9]+)/*$", 1)
    names = F.array(
        F.concat_ws(":", F.when(F.col("pid").isNotNull(), F.col("provider")), F.when(F.col("provider").isNotNull(), F.col("pid"))),
        F.concat(F.lit("doi:"), F.col("doi")),
        F.when(F.length(last) > 0, F.concat(F.lit("openalex:"), last)),
    )
    return rows.select("candidate_id", F.explode(names).alias("name")).where(F.length("name") > 0).distinct()


def named_groups(observations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(candidate_id, group_id) of every candidate that has a name; the group is named by its smallest candidate_id."""
    names = candidate_names(observations)
    one, two = alias_name(F.col("alias")), alias_name(F.col("work_key"))
    links = aliases.select(F.concat(F.lit("n"), one).alias("a"), F.concat(F.lit("n"), two).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    mine = names.select(F.concat(F.lit("c"), F.col("candidate_id")).alias("a"), F.concat(F.lit("n"), F.col("name")).alias("b"))
    nodes, edges = numbered(cut(mine.unionByName(links)))
    found = named(nodes.where("name LIKE 'c%'"), labelled(edges))
    return found.select(F.expr("substring(name, 2)").alias("candidate_id"), F.expr("substring(least, 2)").alias("group_id"))


def candidate_groups(observations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(candidate_id, group_id) of every candidate; the group is named by its smallest candidate_id.

    Candidates without any name stand alone. Nulls and blanks join nothing; repeated rows count once.
    """
    own = named_groups(observations, aliases)
    everyone = observations.where(F.col("candidate_id").isNotNull()).select("candidate_id").distinct()
    return everyone.join(own, "candidate_id", "left").select("candidate_id", F.coalesce("group_id", "candidate_id").alias("group_id"))


def grouped_pairs(observations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(group_id, candidate_id) of every candidate but the smallest of a group of two or more."""
    return named_groups(observations, aliases).where("group_id <> candidate_id").select("group_id", "candidate_id")
