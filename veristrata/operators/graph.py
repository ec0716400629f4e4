"""Works, citations and typed record edges as graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.identifiers import DOI_HOSTS, alias_rank, joined_sha, normalized_doi, observation_aliases, openalex_alias
from veristrata.functions.records import strict_json
from veristrata.plans.lineage import cut, seen

MAX_ROUNDS = 64
#: So many links are left to one task.
TAIL_LINKS = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each name but the smallest of its component, and the smallest, of a bounded number of links."""
    rows = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.string()), ("b", pa.string())]))
    if not rows.num_rows:
        return
    names, at = np.unique(np.array(rows.column("a").to_pylist() + rows.column("b").to_pylist(), dtype=object), return_inverse=True)
    a, b = at[: rows.num_rows], at[rows.num_rows :]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[other].tolist(), type=pa.string()), pa.array(names[label[other]].tolist(), type=pa.string())], names=["a", "b"])


def alias_components(edges: DataFrame, tail: int = TAIL_LINKS) -> DataFrame:
    """(id, root) of every name in ``edges`` (a, b): the smallest name that is linked to it, by alternating stars.

    The large star links every larger neighbour of a node to its smallest neighbour, the small star
    every smaller one; the edges of a hub are only grouped with partial minima. Ends when a round
    changes nothing; at most ``tail`` links are finished in one task. Loops make a node its own component; null ends are left out.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    nodes = cut(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct())
    links, mark = cut(links.where("a <> b")), None
    for _ in range(MAX_ROUNDS):
        if seen(links) <= tail:
            links = cut(links.coalesce(1).mapInArrow(_stars, "a string, b string"), links)
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), links, mark=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        now = seen(links), seen(links, "mark")
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("names did not settle")
    return nodes.join(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def parsed_observations(observations: DataFrame, hosts: tuple[str, ...] = DOI_HOSTS) -> DataFrame:
    """(run_key, candidate_id, provider, v, title, doi, aliases): the latest row of each candidate of a run whose payload is valid JSON.

    Rows without candidate_id, or without any name, are left out.
    """
    latest = observations.where(F.col("candidate_id").isNotNull()).groupBy("run_key", "candidate_id").agg(F.max_by(F.struct("provider", "payload"), F.struct("observed_at", "payload")).alias("r"))
    rows = latest.select("run_key", "candidate_id", F.lower(F.trim("r.provider")).alias("provider"), strict_json(F.col("r.payload")).alias("v")).where("v IS NOT NULL")
    field = lambda n: F.expr(f"try_variant_get(v, '$.{n}', 'string')")
    rows = rows.select("run_key", "candidate_id", "provider", "v", field("title").alias("title"), normalized_doi(field("doi"), hosts).alias("doi"), observation_aliases(F.col("provider"), field("provider_id"), field("doi"), hosts).alias("aliases"))
    return rows.where(F.size("aliases") > 0)


def alias_works(parsed: DataFrame) -> DataFrame:
    """(alias, work_key): every name of an observation and the preferred name of its work."""
    pairs = parsed.select(F.array_min("aliases").alias("b"), F.explode("aliases").alias("a"))
    found = cut(alias_components(pairs))
    best = found.groupBy("root").agg(F.min(F.struct(alias_rank(F.col("id")).alias("rank"), F.col("id").alias("alias"))).alias("m"))
    return found.join(best, "root").select(F.col("id").alias("alias"), F.col("m.alias").alias("work_key"))


def observation_works(parsed: DataFrame, names: DataFrame) -> DataFrame:
    """(run_key, candidate_id, work_key)."""
    first = parsed.select("run_key", "candidate_id", F.array_min("aliases").alias("alias"))
    return first.join(names, "alias").select("run_key", "candidate_id", "work_key")


def citation_items(parsed: DataFrame) -> DataFrame:
    """(run_key, candidate_id, provider, relation, evidence, malformed): one row for each listed reference, update and relation.

    A field of the wrong kind gives one malformed row ``<field>:unsupported``, an entry that is
    neither text nor object one malformed row; null and missing fields give none.
    """
    base = ["run_key", "candidate_id", "provider"]
    parts = []
    for name in ("references", "updates"):
        raw = F.expr(f"try_variant_get(v, '$.{name}', 'variant')")
        here = parsed.select(*base, raw.alias("x")).where(F.col("x").isNotNull() & ~F.is_variant_null("x"))
        listed = F.schema_of_variant("x").startswith("ARRAY")
        parts.append(here.where(listed).select(*base, F.lit(name).alias("relation"), F.explode(F.expr("try_variant_get(x, '$', 'array<variant>')")).alias("e")).withColumn("bad", F.lit(False)))
        parts.append(here.where(~listed).select(*base, F.lit(f"{name}:unsupported").alias("relation"), F.col("x").alias("e"), F.lit(True).alias("bad")))
    raw = F.expr("try_variant_get(v, '$.relations', 'variant')")
    here = parsed.select(*base, raw.alias("x")).where(F.col("x").isNotNull() & ~F.is_variant_null("x"))
    mapped = F.schema_of_variant("x").startswith("OBJECT")
    entries = here.where(mapped).select(*base, F.explode(F.expr("map_entries(try_variant_get(x, '$', 'map<string,variant>'))")).alias("m"))
    many = F.schema_of_variant("m.value").startswith("ARRAY")
    values = F.when(many, F.expr("try_variant_get(m.value, '$', 'array<variant>')")).otherwise(F.array("m.value"))
    parts.append(entries.select(*base, F.concat(F.lit("relation:"), F.col("m.key")).alias("relation"), F.explode(values).alias("e")).withColumn("bad", F.lit(False)))
    parts.append(here.where(~mapped).select(*base, F.lit("relation:unsupported").alias("relation"), F.col("x").alias("e"), F.lit(True).alias("bad")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    usable = F.schema_of_variant("e").rlike("^(STRING|OBJECT)")
    return out.select(*base, "relation", F.to_json("e").alias("evidence"), (F.col("bad") | ~F.coalesce(usable, F.lit(False))).alias("malformed"), _target("e").alias("target"))


def _target(column: str) -> Column:
    """The identifier that a reference states: the text itself, or its DOI, doi or id."""
    get = lambda n: F.nullif(F.expr(f"try_variant_get({column}, '$.{n}', 'string')"), F.lit(""))
    whole = F.when(F.schema_of_variant(column) == "STRING", F.expr(f"try_variant_get({column}, '$', 'string')"))
    return F.when(F.schema_of_variant(column).startswith("OBJECT"), F.coalesce(get("DOI"), get("doi"), get("id"))).otherwise(whole)


def citation_edges(parsed: DataFrame, names: DataFrame, hosts: tuple[str, ...] = DOI_HOSTS) -> DataFrame:
    """One row for each listed item: edge_id, source_work, target_work, relation, provider, evidence, resolution, malformed.

    The target is the work that carries the stated name, else the name itself (external_identifier),
    else a fingerprint of the reference (unresolved_metadata). Equal edges have one edge_id.
    """
    items = citation_items(parsed)
    doi = normalized_doi(F.col("target"), hosts)
    items = items.withColumn("alias", F.coalesce(F.concat(F.lit("doi:"), doi), openalex_alias(F.col("target"))))
    local = names.select("alias", F.col("work_key").alias("target_local"))
    source = observation_works(parsed, names).select("run_key", "candidate_id", F.col("work_key").alias("source_work"))
    same = (F.col("i.run_key").eqNullSafe(F.col("s.run_key"))) & (F.col("i.candidate_id") == F.col("s.candidate_id"))
    rows = items.alias("i").join(source.alias("s"), same).select("i.*", "s.source_work").join(local, "alias", "left")
    target = F.coalesce("target_local", "alias", joined_sha("unresolved:", 24, F.col("evidence")))
    state = F.when(F.col("target_local").isNotNull(), "resolved_local").when(F.col("alias").isNotNull(), "external_identifier").otherwise("unresolved_metadata")
    rows = rows.select("run_key", "source_work", target.alias("target_work"), "relation", "provider", "evidence", state.alias("resolution"), "malformed")
    return rows.withColumn("edge_id", joined_sha("cite:", 28, *[F.col(c) for c in ("run_key", "source_work", "target_work", "relation", "provider", "evidence")]))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge_id once."""
    return edges.drop("malformed").groupBy("edge_id").agg(*[F.min(c).alias(c) for c in edges.columns if c not in ("edge_id", "malformed")])


def citation_audit(edges: DataFrame) -> DataFrame:
    """(run_key, expected, malformed, indexed, unresolved, duplicates): items before and edges after repeated ones are dropped."""
    before = edges.groupBy("run_key", "edge_id").agg(F.count("*").alias("n"), F.count_if("malformed").alias("bad"), F.min("resolution").alias("resolution"))
    out = before.groupBy("run_key").agg(F.sum("n").alias("expected"), F.sum("bad").alias("malformed"), F.count("*").alias("indexed"), F.count_if(F.col("resolution") != "resolved_local").alias("unresolved"))
    return out.withColumn("duplicates", F.col("expected") - F.col("indexed"))


def works(parsed: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(work_key, title, doi, providers, observations, external): local works with the title and DOI of their first observation, and external targets."""
    own = observation_works(parsed, names)
    same = F.col("p.run_key").eqNullSafe(F.col("o.run_key")) & (F.col("p.candidate_id") == F.col("o.candidate_id"))
    rows = parsed.alias("p").join(own.alias("o"), same).select("p.run_key", "p.candidate_id", "p.provider", "p.title", "p.doi", "o.work_key")
    first = F.min_by(F.struct("title", "doi"), F.struct("run_key", "candidate_id"))
    local = rows.groupBy("work_key").agg(first.alias("f"), F.sort_array(F.collect_set("provider")).alias("providers"), F.count("*").alias("observations"))
    local = local.select("work_key", "f.title", "f.doi", "providers", "observations", F.lit(False).alias("external"))
    outside = edges.where("resolution <> 'resolved_local'").select(F.col("target_work").alias("work_key")).distinct()
    none = lambda t: F.lit(None).cast(t)
    outside = outside.select("work_key", none("string").alias("title"), F.when(F.col("work_key").startswith("doi:"), F.expr("substring(work_key, 5)")).alias("doi"), F.array().cast("array<string>").alias("providers"), F.lit(0).cast("long").alias("observations"), F.lit(True).alias("external"))
    return local.unionByName(outside)


def traverse(edges: DataFrame, start: list[str], depth: int = 1, direction: str = "both", limit: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """Edges (with level), nodes (node, level) and whether the limit cut edges off, breadth first from ``start``.

    edges: (edge_id, source_work, target_work, ..). Edges of a level are taken in edge_id order, so
    that the limit (1..1000) is deterministic; cut edges are not followed. The frontier has at most
    ``limit`` nodes, hence each level is one scan of the edges against a broadcast set.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    if not 1 <= depth <= 5 or direction not in ("in", "out", "both"):
        raise ValueError("depth must be between 1 and 5, direction in, out or both")
    spark = edges.sparkSession
    level_of = {n: 0 for n in start}
    taken: list[tuple[str, int]] = []
    used: set[str] = set()
    frontier, cut_off = list(level_of), False
    for level in range(1, depth + 1):
        at = spark.createDataFrame([(n,) for n in frontier], "node string")
        ways = []
        if direction in ("out", "both"):
            ways.append(edges.join(F.broadcast(at), edges.source_work == at.node, "left_semi"))
        if direction in ("in", "both"):
            ways.append(edges.join(F.broadcast(at), edges.target_work == at.node, "left_semi"))
        near = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
        if used:
            seen = spark.createDataFrame([(e,) for e in used], "edge_id string")
            near = near.join(F.broadcast(seen), "edge_id", "left_anti")  # at most ``limit`` rows
        rows = near.select("edge_id", "source_work", "target_work").distinct().orderBy("edge_id").limit(limit - len(taken) + 1).collect()
        cut_off |= len(rows) > limit - len(taken)
        frontier = []
        for r in rows[: limit - len(taken)]:
            taken.append((r.edge_id, level))
            used.add(r.edge_id)
            for n in (r.source_work, r.target_work):
                if n not in level_of:
                    level_of[n] = level
                    frontier.append(n)
        if not frontier or len(taken) == limit and cut_off:
            break
    kept = spark.createDataFrame(taken, "edge_id string, level int")
    return edges.join(F.broadcast(kept), "edge_id"), spark.createDataFrame(list(level_of.items()), "node string, level int"), cut_off


#: Typed edges of ledger tables as (table, field, target tables in order of preference, relation).
RECORD_RELATIONS = (
    ("sources", "derived_from", ("sources",), "derived_from"),
    ("searches", "question_ids", ("questions",), "investigates"),
    ("searches", "source_ids", ("sources",), "found_source"),
    ("claims", "question_ids", ("questions",), "addresses"),
    ("questions", "claim_ids", ("claims",), "answered_by"),
    ("leads", "question_ids", ("questions",), "concerns"),
    ("leads", "search_ids", ("searches",), "investigated_by"),
    ("leads", "source_ids", ("sources",), "resolved_with"),
    ("trace", "parent_ids", ("questions", "claims", "trace"), "parent"),
    ("reviews", "claim_ids", ("claims",), "reviews_claim"),
    ("report-map", "claim_ids", ("claims",), "maps_claim"),
)


def typed_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """(source_kind, source_id, target_kind, target_id, relation, evidence, known) from ledger tables by name.

    Listed ids of RECORD_RELATIONS, the evidence of claims (array of structs with source_id and
    relation, ``evidence`` where it is null) and the coverage of questions (map of lens to a struct
    of search_ids and source_ids). An id that no target table has is kept with ``known`` false.
    """
    parts = []
    empty = F.lit("{}")
    for kind, name, targets, relation in RECORD_RELATIONS:
        if kind in tables and name in tables[kind].columns:
            parts.append(tables[kind].select(F.lit(kind).alias("source_kind"), F.col("id").alias("source_id"), F.array(*[F.lit(t) for t in targets]).alias("wanted"), F.explode(name).alias("target_id"), F.lit(relation).alias("relation"), empty.alias("evidence")))
    if "claims" in tables and "evidence" in tables["claims"].columns:
        rows = tables["claims"].select("id", F.explode("evidence").alias("e"))
        parts.append(rows.select(F.lit("claims").alias("source_kind"), F.col("id").alias("source_id"), F.array(F.lit("sources")).alias("wanted"), F.col("e.source_id").alias("target_id"), F.coalesce("e.relation", F.lit("evidence")).alias("relation"), F.to_json("e").alias("evidence")))
    if "questions" in tables and "coverage" in tables["questions"].columns:
        rows = tables["questions"].select("id", F.explode("coverage").alias("lens", "cell"))
        for field, target, word in (("search_ids", "searches", "covered_by:"), ("source_ids", "sources", "coverage_source:")):
            parts.append(rows.select(F.lit("questions").alias("source_kind"), F.col("id").alias("source_id"), F.array(F.lit(target)).alias("wanted"), F.explode(f"cell.{field}").alias("target_id"), F.concat(F.lit(word), F.col("lens")).alias("relation"), empty.alias("evidence")))
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    ids = None
    for kind, table in tables.items():
        own = table.select(F.lit(kind).alias("kind"), F.col("id").alias("target_id")).distinct()
        ids = own if ids is None else ids.unionByName(own)
    kinds = ids.groupBy("target_id").agg(F.collect_set("kind").alias("kinds"))
    placed = edges.join(kinds, "target_id", "left").withColumn("possible", F.filter("wanted", lambda k: F.array_contains("kinds", k)))
    known = F.coalesce(F.size("possible") > 0, F.lit(False))
    return placed.select("source_kind", "source_id", F.when(known, F.element_at("possible", 1)).otherwise(F.element_at("wanted", 1)).alias("target_kind"), "target_id", "relation", "evidence", known.alias("known"))


def merged_record_edges(edges: DataFrame) -> DataFrame:
    """One row for each typed edge of a run, with all distinct evidence as a sorted list and the latest time. Null keys group together."""
    keys = ["run_key", "source_kind", "source_id", "target_kind", "target_id", "relation"]
    return edges.groupBy(*keys).agg(F.sort_array(F.collect_set("evidence")).alias("evidence"), F.max("synced_at").alias("synced_at"), F.count("*").alias("rows"))


def provenance_roots(record_edges: DataFrame) -> DataFrame:
    """(run_key, source_id, root_id) over ``derived_from``: the independent origins of every derived source."""
    from veristrata.operators.hierarchy import roots_reached

    return roots_reached(record_edges, ("derived_from",)).select("run_key", F.col("node_id").alias("source_id"), "root_id")
