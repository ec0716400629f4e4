"""Rules over record tables. Each rule is a DataFrame (code, table, record, detail); a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.functions.records import strict_json, zoned_timestamp
from veristrata.functions.text import nonempty


def _found(df: DataFrame, code: str, table: str, record: Column | str, detail: Column | str) -> DataFrame:
    record = F.col(record) if isinstance(record, str) else record
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(code).alias("code"), F.lit(table).alias("table"), record.cast("string").alias("record"), detail.cast("string").alias("detail"))


def report(*rules: DataFrame) -> DataFrame:
    """All findings of several rules."""
    return reduce(DataFrame.unionByName, rules)


def missing_ids(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    return _found(df.where(~nonempty(F.col(key).cast("string"))), "MISSING_ID", table, key, key)


def duplicate_ids(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Ids that occur more than once in all tables together; detail: how often. Pre-aggregated, so a hot id is no single task."""
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("t"), F.col(key).cast("string").alias("id")) for n, t in tables.items()])
    twice = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("t")), ",").alias("t")).where("n > 1")
    return twice.select(F.lit("DUPLICATE_ID").alias("code"), F.col("t").alias("table"), F.col("id").alias("record"), F.col("n").cast("string").alias("detail"))


def required_text(df: DataFrame, table: str, key: str, fields: list[str]) -> DataFrame:
    """Fields that are null or blank; one row for each record and field."""
    bad = F.array_compact(F.array(*[F.when(~nonempty(F.col(f)), F.lit(f)) for f in fields]))
    rows = df.select(F.col(key).alias("k"), F.explode(bad).alias("f"))
    return _found(rows, "REQUIRED_TEXT", table, "k", F.col("f"))


def allowed_values(df: DataFrame, table: str, key: str, field: str, allowed: tuple) -> DataFrame:
    return _found(df.where(~F.coalesce(F.col(field).isin(*allowed), F.lit(False))), "INVALID_VALUE", table, key, F.coalesce(F.col(field).cast("string"), F.lit("null")))


def timestamps(df: DataFrame, table: str, key: str, field: str) -> DataFrame:
    """Texts that are no ISO instant with a zone."""
    return _found(df.where(zoned_timestamp(F.col(field)).isNull()), "INVALID_TIMESTAMP", table, key, F.coalesce(F.col(field), F.lit("null")))


def empty_references(df: DataFrame, table: str, key: str, field: str) -> DataFrame:
    return _found(df.where(F.coalesce(F.size(field), F.lit(0)) <= 0), "EMPTY_REFS", table, key, field)


def unknown_references(df: DataFrame, table: str, key: str, field: str, target: DataFrame, target_key: str = "id", listed: bool = True, within: list[str] | None = None) -> DataFrame:
    """References that no target row has, by anti join; ``within`` names columns that must agree as well. Null references are no reference."""
    within = within or []
    value = F.explode(field) if listed else F.col(field)
    refs = df.select(F.col(key).alias("k"), *within, value.alias("ref")).where("ref IS NOT NULL").distinct()
    have = target.select(*within, F.col(target_key).alias("ref")).distinct()
    return _found(refs.join(have, [*within, "ref"], "left_anti"), "UNKNOWN_REF", table, "k", F.col("ref"))


def changed_content(df: DataFrame, table: str, key: str, content: Column, recorded: str) -> DataFrame:
    """Records whose content no longer has the recorded hash; a null on one side only is a change."""
    now = F.sha2(content, 256)
    return _found(df.where(~now.eqNullSafe(F.col(recorded))), "CONTENT_CHANGED", table, key, F.coalesce(now, F.lit("null")))


def one_sided_links(left: DataFrame, right: DataFrame, table: str, left_key: str, left_refs: str, right_key: str, right_refs: str) -> DataFrame:
    """Links that the left table lists and the right does not list back."""
    there = left.select(F.col(left_key).alias("a"), F.explode(left_refs).alias("b")).distinct()
    back = right.select(F.explode(right_refs).alias("a"), F.col(right_key).alias("b")).distinct()
    return _found(there.join(back, ["a", "b"], "left_anti"), "ONE_SIDED_LINK", table, "a", F.col("b"))


def uncovered(rows: DataFrame, table: str, key: str, cell: str, wanted: tuple[str, ...]) -> DataFrame:
    """Keys that lack one of the wanted cells; the cells of a key are gathered by partial aggregation."""
    have = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.collect_set(F.when(F.col(cell).isin(*wanted), F.col(cell))).alias("have"))
    lost = have.select("k", F.explode(F.array_except(F.array(*[F.lit(w) for w in wanted]), "have")).alias("cell"))
    return _found(lost, "COVERAGE_MISSING", table, "k", F.col("cell"))


def unsupported(claims: DataFrame, support: DataFrame, code: str, table: str, key: str) -> DataFrame:
    """Claims without a row of ``support`` (same key column)."""
    return _found(claims.join(support.select(key).distinct(), key, "left_anti"), code, table, key, key)


def missing_passages(passages: DataFrame, whole: DataFrame, table: str, key: str, text: str, on: str, body: str) -> DataFrame:
    """Passages that are no exact part of the text they belong to (equal ``on``), or belong to none."""
    rows = passages.join(whole.select(on, F.col(body).alias("__whole")), on, "left")
    return _found(rows.where(~F.coalesce(F.col("__whole").contains(F.col(text)), F.lit(False))), "TEXT_MISSING", table, key, on)


def subset_violations(df: DataFrame, table: str, key: str, named: Column, available: Column) -> DataFrame:
    """Records that name nothing, or something that is not available."""
    extra = F.array_except(named, available)
    bad = df.where((F.coalesce(F.size(named), F.lit(0)) <= 0) | (F.coalesce(F.size(extra), F.lit(1)) > 0))
    return _found(bad, "NOT_A_SUBSET", table, key, F.coalesce(F.array_join(extra, ","), F.lit("")))


def cycles(record_edges: DataFrame) -> DataFrame:
    """Every record on a cycle of a hierarchy (see ``operators.hierarchy``); detail: the cycle's smallest id."""
    from veristrata.operators.hierarchy import cycle_records

    rows = cycle_records(record_edges)
    return rows.select(F.when(F.col("relation") == "parent", "TRACE_CYCLE").otherwise("SOURCE_CYCLE").alias("code"), F.col("relation").alias("table"), F.concat_ws("/", "run_key", "node_id").alias("record"), F.col("cycle_id").alias("detail"))


def not_lists(df: DataFrame, table: str, key: str, field: str) -> DataFrame:
    """Records whose JSON field is no list of texts; null and broken JSON are none."""
    listed = F.try_variant_get(strict_json(F.col(field)), "$", "array<variant>")
    texts = F.forall(listed, lambda x: F.schema_of_variant(x) == "STRING")
    return _found(df.where(~F.coalesce(texts, F.lit(False))), "INVALID_LIST", table, key, F.coalesce(F.col(field), F.lit("null")))


def undated(df: DataFrame, table: str, key: str, date: Column) -> DataFrame:
    """Sources without a date of publication."""
    return _found(df.where(~nonempty(date)), "UNDATED_SOURCE", table, key, "published")


def unequal_cells(one: DataFrame, two: DataFrame, code: str, table: str, key: str, cell: str) -> DataFrame:
    """Cells (key, cell) of ``one`` that ``two`` has not."""
    return _found(one.select(key, cell).distinct().join(two.select(key, cell).distinct(), [key, cell], "left_anti"), code, table, key, F.col(cell))


def rootless(record_edges: DataFrame, wanted: str = "claims") -> DataFrame:
    """Trace items none of whose ancestors over ``parent`` is a record of the wanted kind."""
    from veristrata.operators.hierarchy import ancestry, stripped

    kind = lambda c: F.lower(stripped(F.col(c)))
    items = record_edges.where(kind("source_kind") == "trace").select("run_key", stripped(F.col("source_id")).alias("node_id")).where("length(node_id) > 0").distinct()
    goals = record_edges.where((kind("target_kind") == wanted) & (kind("relation") == "parent")).select(F.col("run_key").alias("r"), stripped(F.col("target_id")).alias("a")).distinct()
    above = ancestry(record_edges, items).where("relation = 'parent'")
    good = above.join(goals, above.run_key.eqNullSafe(goals.r) & (above.ancestor_id == goals.a), "left_semi").select(F.col("run_key").alias("r"), F.col("node_id").alias("n")).distinct()
    left = items.join(good, items.run_key.eqNullSafe(good.r) & (items.node_id == good.n), "left_anti")
    return _found(left.withColumn("k", F.concat_ws("/", "run_key", "node_id")), "TRACE_WITHOUT_CLAIM", "trace", "k", wanted)


def last_by(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The payload of the last row of each key in the given order, by partial aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("r")).select(*keys, "r.*")


def state_at(history: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Every row with the last non-null state of its key up to and including it."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("last_state", F.last(state, ignorenulls=True).over(window))


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables in one result."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()])
