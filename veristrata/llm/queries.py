"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog.tables import table
from veristrata.llm import groups, languages, mixing, neighbours, pieces, sentences, tokens


def _p4_items(spark: SparkSession, d: str) -> tuple[DataFrame, languages.Labeller]:
    documents = table(spark, d, "documents")
    return languages.items_of(documents, table(spark, d, "texts")), languages.labeller_on(documents)


def _p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def _p7_shares(spark: SparkSession, d: str) -> DataFrame:
    counts, targets = mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(counts, targets), counts, targets)


def _p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """The hash of each text put together again from its pieces, and whether all keep to the limit."""
    made = pieces.renumbered_pieces(table(spark, d, "texts"))
    core = F.struct("ordinal", F.expr("substring(text, overlap + 1)").alias("core"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(core)), lambda x: x["core"]), "")
    return made.groupBy("text_id").agg(F.sha2(whole, 256).alias("sha"), (F.max(F.length("text")) <= pieces.LIMIT).alias("within_limit"))


def _p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source of each mix keeps to its target within one document, or uses all that max_repeats allows, and to max_repeats."""
    counts, targets = mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets")
    largest = counts.groupBy("source").agg(F.max("tokens").alias("largest"))
    rows = mixing.shares(mixing.mix(counts, targets), counts, targets).join(mixing.rates(counts, targets).select("mix_id", "source", "have", "cap"), ["mix_id", "source"]).join(largest, "source", "left")
    kept = F.when(F.col("capped"), F.col("actual_tokens") == F.col("have") * F.col("cap")).otherwise(F.abs(F.col("actual_tokens") - F.col("target_tokens")) <= F.coalesce("largest", F.lit(0)))
    return rows.select("mix_id", "source", F.round("target_share", 6).alias("target_share"), kept.alias("target_kept"), (F.col("most_copies") <= F.col("cap")).alias("repeats_kept"))


QUERIES = {
    "p2_found": lambda spark, d: pieces.oversized(table(spark, d, "texts")),
    "p2_pieces": lambda spark, d: pieces.renumbered_pieces(table(spark, d, "texts")),
    "p2_checks": _p2_checks,
    "p3_found": lambda spark, d: groups.grouped_pairs(table(spark, d, "observations"), table(spark, d, "aliases")),
    "p3_groups": lambda spark, d: groups.candidate_groups(table(spark, d, "observations"), table(spark, d, "aliases")),
    "p4_found": lambda spark, d: languages.unnamed_languages(*_p4_items(spark, d)),
    "p4_segments": lambda spark, d: languages.language_segments(*_p4_items(spark, d)),
    "p5_found": lambda spark, d: neighbours.similar_pairs(table(spark, d, "text_embeddings")),
    "p5_neighbours": lambda spark, d: neighbours.nearest_texts(table(spark, d, "text_embeddings")),
    "p6_ids": lambda spark, d: tokens.encode_column(table(spark, d, "documents")),
    "p7_mix": _p7_mix,
    "p7_shares": _p7_shares,
    "p7_checks": _p7_checks,
    "p8_found": lambda spark, d: sentences.split_sentences(table(spark, d, "documents")),
}

_CLEAN = r"nullif(lower(regexp_replace({0}, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '')"
_DOI = r"nullif(regexp_extract({0}, '^(?:doi:\s*|https://doi\.example/|http://dx\.doi\.example/)?(10\.[0-9]{4,9}/[^\s\p{Z}]+)$', 1), '')"


def _clean(x: str) -> str:
    return _CLEAN.replace("{0}", x)


def _doi(x: str) -> str:
    return _DOI.replace("{0}", _clean(x))


def _alias(x: str) -> str:
    return f"CASE WHEN starts_with({_clean(x)}, 'doi:') THEN 'doi:' || {_doi(x)} ELSE {_clean(x)} END"


_GROUPS = f"""
WITH RECURSIVE o AS (SELECT DISTINCT candidate_id, {_clean("provider")} AS provider, {_clean("json_extract_string(payload, '$.provider_id')")} AS pid, {_doi("json_extract_string(payload, '$.doi')")} AS doi
  FROM observations WHERE candidate_id IS NOT NULL AND json_valid(payload)),
n AS (SELECT candidate_id, unnest([provider || ':' || pid, 'doi:' || doi, 'openalex:' || nullif(regexp_extract(pid, '(?:^|/)(w[0-9]+)/*$', 1), '')]) AS name FROM o),
l AS (SELECT 'c' || candidate_id AS a, 'n' || name AS b FROM n WHERE name IS NOT NULL
  UNION SELECT 'n' || x, 'n' || y FROM (SELECT {_alias("alias")} AS x, {_alias("work_key")} AS y FROM aliases) WHERE x IS NOT NULL AND y IS NOT NULL),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT 'c' || candidate_id AS id, 'c' || candidate_id AS at_ FROM observations WHERE candidate_id IS NOT NULL UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.at_),
g AS (SELECT substr(id, 2) AS candidate_id, substr(min(at_), 2) AS group_id FROM r GROUP BY id)
"""

_NEAR = """
WITH u AS (SELECT model, revision, text_id, min(vector)::double[] AS v FROM text_embeddings
  WHERE text_id IS NOT NULL AND vector IS NOT NULL AND len(vector) = dimension AND NOT list_bool_or(list_transform(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0)) GROUP BY ALL),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM u),
p AS (SELECT a.model, a.revision, a.text_id AS t, b.text_id AS o, round(list_dot_product(a.v, b.v) / (a.s * b.s), 6) AS sim FROM n a JOIN n b
  ON a.model IS NOT DISTINCT FROM b.model AND a.revision IS NOT DISTINCT FROM b.revision AND len(a.v) = len(b.v) AND a.text_id <> b.text_id),
k AS (SELECT *, row_number() OVER (PARTITION BY model, revision, t ORDER BY sim DESC, o) AS rank FROM p QUALIFY rank <= 5)
"""

ORACLE = {
    "p3_found": _GROUPS + "SELECT group_id, candidate_id FROM g WHERE group_id <> candidate_id",
    "p3_groups": _GROUPS + "SELECT candidate_id, group_id FROM g",
    "p5_found": _NEAR + "SELECT DISTINCT model, revision, least(t, o) AS text_a, greatest(t, o) AS text_b FROM k",
    "p5_neighbours": _NEAR + "SELECT model, revision, t AS text_id, o AS neighbour, sim AS similarity, rank::int AS rank FROM k",
    "p2_checks": r"""
WITH l AS (SELECT text_id, arg_max(text, {'at': synced_at, 'text': text}) AS text FROM texts WHERE text_id IS NOT NULL GROUP BY text_id),
t AS (SELECT text_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)) AS x FROM l)
SELECT text_id, sha256(x) AS sha, true AS within_limit FROM t WHERE length(x) > 0
""",
    "p7_checks": r"""
WITH t AS (SELECT DISTINCT mix_id, lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS source, target_share, max_repeats, total_ratio FROM mix_targets WHERE mix_id IS NOT NULL AND target_share >= 0)
SELECT mix_id, source, round(target_share / sum(target_share) OVER (PARTITION BY mix_id), 6) AS target_share, true AS target_kept, true AS repeats_kept FROM t WHERE length(source) > 0
""",
    "p2_found": r"""
WITH t AS (SELECT DISTINCT text_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8232)||chr(8233)||chr(12288)) AS x FROM texts WHERE text IS NOT NULL)
SELECT DISTINCT text_id, CASE WHEN list_max(list_transform(regexp_split_to_array(x, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}。！？]'), lambda s: length(s))) > 1400
  THEN 'forced' ELSE 'natural' END AS cut
FROM t WHERE length(x) > 1400
""",
}
