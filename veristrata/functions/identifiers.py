"""Names and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata.functions.text import stripped

DOI_HOSTS = ("doi.org", "dx.doi.org")
#: Parameters of an address whose values are never stored.
SECRET_KEYS = ("access_token", "api_key", "apikey", "email", "key", "mailto", "signature", "token")
NUL = "\u0000"


def sha(column: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(column, 256)


def joined_sha(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix + the first digits of the hash of the parts, which are separated by NUL; null parts count as empty."""
    text = F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(sha(text), 1, digits))


def text_id(run_key: Column, kind: Column, object_id: Column, locator: Column, ordinal: Column, text: Column) -> Column:
    return joined_sha("txt:", 28, run_key, kind, object_id, locator, ordinal, sha(text))


def document_id(run_key: Column, local_id: Column) -> Column:
    return joined_sha("doc:", 28, run_key, local_id)


def run_key(run_id: Column, root: Column, query_sha: Column) -> Column:
    """``run:<id>``, or for a run without id a hash of its path and query."""
    return F.coalesce(F.concat(F.lit("run:"), run_id), joined_sha("run:", 24, root, query_sha))


def candidate_id(provider: Column, provider_id: Column) -> Column:
    return F.concat(F.lit("P-"), F.substring(sha(F.concat_ws(":", provider, provider_id)), 1, 16))


def normalized_doi(column: Column, hosts: tuple[str, ...] = DOI_HOSTS) -> Column:
    """The DOI in lower case without ``doi:`` or the address of a resolver; null if it is none."""
    where = "|".join(h.replace(".", r"\.") for h in hosts)
    bare = F.regexp_replace(stripped(column), rf"(?i)^(?:doi:\s*|https?://(?:{where})/)", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.lower(bare))


def openalex_alias(column: Column) -> Column:
    """``openalex:W<n>`` if the last path segment is W and digits, else null."""
    last = F.element_at(F.split(F.regexp_replace(stripped(column), "/+$", ""), "/"), -1)
    return F.when(last.rlike(r"(?i)^w\d+$"), F.concat(F.lit("openalex:"), F.upper(last)))


def observation_aliases(provider: Column, provider_id: Column, doi: Column, hosts: tuple[str, ...] = DOI_HOSTS) -> Column:
    """The distinct names of one observation; empty if it has none."""
    own = F.concat(F.lower(stripped(provider)), F.lit(":"), stripped(provider_id))
    return F.array_distinct(F.array_compact(F.array(own, F.concat(F.lit("doi:"), normalized_doi(doi, hosts)), openalex_alias(provider_id))))


def alias_rank(alias: Column) -> Column:
    """Order in which names are preferred: DOI, OpenAlex, others."""
    return F.when(alias.startswith("doi:"), 0).when(alias.startswith("openalex:"), 1).otherwise(2)


def canonical_alias(alias: Column) -> Column:
    """Aggregate: the preferred name of a group."""
    return F.min(F.struct(alias_rank(alias).alias("rank"), alias.alias("alias")))["alias"]


def redacted(url: Column, secrets: tuple[str, ...] = SECRET_KEYS) -> Column:
    """The address without user info, port and fragment, values of secret parameters replaced; null if it has no host."""
    scheme, host = F.parse_url(url, F.lit("PROTOCOL")), F.parse_url(url, F.lit("HOST"))
    path, query = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.parse_url(url, F.lit("QUERY"))
    safe = F.transform(
        F.split(query, "&"),
        lambda p: F.when(F.lower(F.substring_index(p, "=", 1)).isin(*secrets), F.concat(F.substring_index(p, "=", 1), F.lit("=REDACTED"))).otherwise(p),
    )
    return F.concat(scheme, F.lit("://"), host, path, F.coalesce(F.concat(F.lit("?"), F.array_join(safe, "&")), F.lit("")))


def source_id_ok(column: Column) -> Column:
    return F.coalesce(column.rlike(r"^[A-Za-z][A-Za-z0-9_-]*$"), F.lit(False))
