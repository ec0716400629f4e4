"""Recorded provider responses to candidates. Fetching is not part of the engine; bodies come from files or tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.functions.identifiers import DOI_HOSTS, candidate_id, normalized_doi
from veristrata.functions.records import date_of_parts, strict_json


def _get(path: str, kind: str = "string", v: str = "x") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def _items(bodies: DataFrame, path: str) -> DataFrame:
    return bodies.select(F.explode(F.expr(f"try_variant_get(try_parse_json(body), '{path}', 'array<variant>')")).alias("x"))


def _named(rows: DataFrame, provider: str, hosts: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumn("doi", normalized_doi(F.col("raw_doi"), hosts)).where("provider_id IS NOT NULL")
    return rows.select(
        candidate_id(F.lit(provider), F.col("provider_id")).alias("candidate_id"),
        work_key(F.col("doi"), F.lit(provider), F.col("provider_id")).alias("work_key"),
        F.lit(provider).alias("provider"),
        "provider_id",
        "doi",
        F.coalesce("title", "doi", "provider_id").alias("title"),
        "url",
        "published",
        "references",
    )


def work_key(doi: Column, provider: Column, provider_id: Column) -> Column:
    """The name under which observations of one work meet: its DOI, or the provider's own name."""
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat_ws(":", provider, provider_id))


def crossref(bodies: DataFrame, hosts: tuple[str, ...] = DOI_HOSTS) -> DataFrame:
    """Candidates of Crossref responses, lists of works and single works alike. ``bodies`` has the column ``body``."""
    single = bodies.select(F.expr("try_variant_get(try_parse_json(body), '$.message', 'variant')").alias("x")).where(_get("$.DOI").isNotNull())
    rows = _items(bodies, "$.message.items").unionByName(single)
    parts = F.expr("try_variant_get(x, '$.published[\"date-parts\"][0]', 'array<int>')")
    rows = rows.select(normalized_doi(_get("$.DOI"), hosts).alias("provider_id"), _get("$.DOI").alias("raw_doi"), _get("$.title[0]").alias("title"), F.coalesce(_get("$.URL"), F.concat(F.lit(f"https://{hosts[0]}/"), normalized_doi(_get("$.DOI"), hosts))).alias("url"), date_of_parts(parts).alias("published"), F.to_json(_get("$.reference", "variant")).alias("references"))
    return _named(rows, "crossref", hosts)


def openalex(bodies: DataFrame, hosts: tuple[str, ...] = DOI_HOSTS) -> DataFrame:
    rows = _items(bodies, "$.results").select(_get("$.id").alias("provider_id"), _get("$.doi").alias("raw_doi"), _get("$.title").alias("title"), F.coalesce(_get("$.doi"), _get("$.id")).alias("url"), _get("$.publication_date").alias("published"), F.to_json(_get("$.referenced_works", "variant")).alias("references"))
    return _named(rows, "openalex", hosts)


def europepmc(bodies: DataFrame, hosts: tuple[str, ...] = DOI_HOSTS) -> DataFrame:
    rows = _items(bodies, "$.resultList.result")
    rows = rows.select(F.concat(_get("$.source"), F.lit(":"), _get("$.id")).alias("provider_id"), _get("$.doi").alias("raw_doi"), _get("$.title").alias("title"), F.concat_ws("/", F.lit("https://europepmc.org/article"), _get("$.source"), _get("$.id")).alias("url"), _get("$.firstPublicationDate").alias("published"), F.lit(None).cast("string").alias("references"))
    return _named(rows, "europepmc", hosts)


def open_copies(unpaywall: DataFrame, europe: DataFrame) -> DataFrame:
    """(url, resolver, version, format): addresses of open copies from recorded responses of two resolvers, each once.

    Both inputs have (rank, body); the first by rank wins among equal (url, resolver, version).
    """
    loc = unpaywall.select("rank", F.posexplode(F.expr("try_variant_get(try_parse_json(body), '$.oa_locations', 'array<variant>')")).alias("pos", "x"))
    kinds = F.array(F.struct(_get("$.url_for_pdf").alias("url"), F.lit("pdf").alias("format")), F.struct(_get("$.url_for_landing_page").alias("url"), F.lit("landing").alias("format")))
    one = loc.select("rank", "pos", _get("$.version").alias("version"), F.posexplode(kinds).alias("k", "u")).select("rank", "pos", "k", F.lit("unpaywall").alias("resolver"), "version", "u.url", "u.format")
    res = europe.select("rank", F.posexplode(F.expr("try_variant_get(try_parse_json(body), '$.resultList.result', 'array<variant>')")).alias("pos", "x"))
    link = res.select("rank", "pos", F.posexplode(F.expr("try_variant_get(x, '$.fullTextUrlList.fullTextUrl', 'array<variant>')")).alias("k", "l"))
    two = link.where(_get("$.availabilityCode", v="l") == "OA").select("rank", "pos", "k", F.lit("europepmc").alias("resolver"), F.lit("unspecified").alias("version"), _get("$.url", v="l").alias("url"), F.coalesce(_get("$.documentStyle", v="l"), F.lit("landing")).alias("format"))
    return first_wins(one.unionByName(two).where("url IS NOT NULL"), ["url", "resolver", "version"], ["rank", "pos", "k"]).select("url", "resolver", "version", "format")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def lookup_status(attempts: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, status): candidates_found, no_candidates_in_checked_indexes if all attempts were ok, else lookup_incomplete."""
    ok = attempts.groupBy(key).agg(F.bool_and(F.col("status") == "ok").alias("ok"))
    rows = ok.join(candidates.select(key).distinct().withColumn("some", F.lit(True)), key, "left")
    return rows.select(key, F.when(F.col("some"), "candidates_found").when(F.col("ok"), "no_candidates_in_checked_indexes").otherwise("lookup_incomplete").alias("status"))


def resolved_only(requests: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose address was among the candidates of their resolution."""
    return requests.join(candidates.select(*keys).distinct(), keys, "left_semi")


def next_page(rows: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next ``size`` (1..100) rows behind the cursor ``after``, in key order."""
    if not 1 <= size <= 100:
        raise ValueError("size must be between 1 and 100")
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


def independent_works(candidates: DataFrame) -> DataFrame:
    """(work_key, observations, providers): observations stay apart, works group them."""
    return candidates.groupBy("work_key").agg(F.count_distinct("candidate_id").alias("observations"), F.array_join(F.sort_array(F.collect_set("provider")), ",").alias("providers"))


def all_candidates(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def strict_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies that are valid JSON."""
    return bodies.where(strict_json(F.col("body")).isNotNull())
