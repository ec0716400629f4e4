"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with the target rate r is used floor(r) times, and once more with the
fractional rate as probability. These probabilities are paired: tokens move from one document to the
other until one probability is 0 or 1, in a random direction that keeps every expectation, so each
step keeps the total of tokens exactly. The documents of a mix and source lie in buckets by a hash of
mix and document; each bucket leaves one fractional document, these residuals are combined in a tree
of ever fewer buckets, and only the last one of a source is rounded by chance. The total of a source
misses its target by less than one document. Buckets, order and draws depend on mix, document and
seed only: however the input is partitioned, the same documents are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.functions.text import stripped
from veristrata.llm.tokens import TOKENIZERS, VOCABULARY, count_column
from veristrata.plans.lineage import cut, seen

SEED = 20_240_229
#: A bucket has about so many documents at most; the residuals of FAN_IN buckets meet in one bucket of the next level.
BUCKET_ROWS, FAN_IN = 20_000, 16
#: The rates (rows of the target table) are broadcast only up to so many rows.
BROADCAST_ROWS = 10_000
STATE = "mix_id string, source string, doc_id bigint, tokens bigint, base int, p double, bucket bigint, place bigint"


def source_name(column: str) -> F.Column:
    """Sources compare without letter case and outer blanks."""
    return F.lower(stripped(F.col(column)))


def uniform(*keys: int) -> float:
    """A number in [0, 1) that depends on the keys only."""
    x = SEED
    for k in keys:
        x = (x ^ (k & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
        x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
    return (x >> 11) / 9007199254740992.0


def pivot(one: list, two: list, salt: int = 0) -> None:
    """One step between two fractional documents [id, tokens, probability]; afterwards one is 0 or 1. ``salt`` sets mixes apart."""
    (i, si, pi), (j, sj, pj) = one, two
    up = min(si * (1 - pi), sj * pj)
    down = min(si * pi, sj * (1 - pj))
    if uniform(salt, i, j) * (up + down) < down:
        one[2], two[2] = (1.0 if up == si * (1 - pi) else pi + up / si), (0.0 if up == sj * pj else pj - up / sj)
    else:
        one[2], two[2] = (0.0 if down == si * pi else pi - down / si), (1.0 if down == sj * (1 - pj) else pj + down / sj)


def _salt(mix: str, source: str) -> int:
    return int.from_bytes(blake2b(f"{mix}\0{source}".encode(), digest_size=8).digest(), "big")


def _level(last: bool):
    """Pivots the fractional rows of each (bucket, mix, source), which come sorted; one of them stays open, or is rounded by chance at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in STATE.split(", ")]
        held: tuple | None = None  # key, [doc_id, tokens, p], base, place
        salt = 0

        def closed() -> tuple:
            (bucket, mix, source), item, base, place = held
            p = float(uniform(salt, item[0], item[1]) < item[2]) if last else item[2]
            return (mix, source, item[0], item[1], base, p, bucket, place)

        for batch in batches:
            done = []
            for mix, source, doc, tokens, base, p, bucket, place in batch[columns].itertuples(index=False, name=None):
                key, new = (bucket, mix, source), [doc, tokens, p]
                if held is not None and held[0] != key:
                    done.append(closed())
                    held = None
                if held is None:
                    held, salt = (key, new, base, place), _salt(mix, source)
                    continue
                _, old, old_base, old_place = held
                pivot(old, new, salt)
                held = None
                for item, b, at in ((old, old_base, old_place), (new, base, place)):
                    if 0.0 < item[2] < 1.0:
                        held = (key, item, b, at)
                    else:
                        done.append((mix, source, *item[:2], b, item[2], bucket, at))
            yield pd.DataFrame(done, columns=columns)
        if held is not None:
            yield pd.DataFrame([closed()], columns=columns)

    return run


def rates(counts: DataFrame, targets: DataFrame, refill: bool = False) -> DataFrame:
    """One row for each (mix, source): wanted share and tokens, tokens at hand, and the rate of use.

    Shares of a mix are relative to their sum; targets with a null mix, source or share, or with a
    negative share, are left out, repeated targets count once, a null max_repeats allows none. A
    source without documents has rate 0. A source whose documents do not suffice within max_repeats
    gives what it can; with ``refill`` the other sources of the mix make up for it in proportion to
    their shares, as far as they can, so that the mix keeps its total and the others exceed their own
    target; without, each keeps its own target.
    """
    wanted = (
        targets.select("mix_id", source_name("source").alias("source"), "target_share", "max_repeats", "total_ratio")
        .where(F.col("mix_id").isNotNull() & (F.length("source") > 0) & (F.col("target_share") >= 0))
        .distinct()
    )
    total = wanted.groupBy("mix_id").agg(F.sum("target_share").alias("shares"))
    have = counts.groupBy("source").agg(F.sum("tokens").alias("have"))
    every = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("every"))
    # ``every`` is a single row
    rows = (
        wanted.join(total, "mix_id")
        .join(have, "source", "left")
        .crossJoin(F.broadcast(every))
        .withColumn("share", F.when(F.col("shares") > 0, F.col("target_share") / F.col("shares")).otherwise(0.0))
        .withColumn("target_tokens", F.col("share") * F.coalesce("total_ratio", F.lit(0.0)) * F.col("every"))
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .withColumn("cap", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
        .withColumn("room", (F.col("have") * F.col("cap")).cast("double"))
    )
    given = F.least("target_tokens", "room")
    if refill:
        # sources in the order in which they run dry; the level is what a share of 1 gets once the sources before are dry
        order = Window.partitionBy("mix_id").orderBy(F.when(F.col("share") > 0, F.col("room") / F.col("share")).otherwise(F.lit(float("inf"))), "source")
        dry = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("share").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        all_wanted = F.sum("target_tokens").over(Window.partitionBy("mix_id"))
        rows = rows.withColumn("level", F.when(left > 0, F.greatest(all_wanted - dry, F.lit(0.0)) / left))
        full = F.coalesce(F.col("share") * F.col("level") <= F.col("room"), F.lit(False))
        rows = rows.withColumn("first", F.when(full, F.struct(F.row_number().over(order).alias("n"), "level")))
        rows = rows.withColumn("top", F.min("first").over(Window.partitionBy("mix_id"))["level"])
        given = F.when(F.col("top").isNull(), F.col("room")).otherwise(F.least(F.col("share") * F.col("top"), "room"))
    return rows.withColumn("rate", F.when(F.col("have") > 0, F.least(given / F.col("have"), F.col("cap").cast("double"))).otherwise(0.0)).select("mix_id", "source", "share", "target_tokens", "have", "cap", "rate")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), materialised, so that texts are encoded once."""
    named = documents.select("doc_id", source_name("source").alias("source"), "text")
    return cut(count_column(named, ["doc_id", "source"], "text", folder, vocabulary))


def mix(counts: DataFrame, targets: DataFrame, refill: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies) of every document that a mix uses.

    Documents without tokens (null and empty texts) or with a null source or id are never used. The
    result depends on the rows and the seed only, not on how they are partitioned. ``refill``: see
    ``rates``.
    """
    rate = cut(rates(counts, targets, refill).where("rate > 0").select("mix_id", "source", "rate"))
    if seen(rate) <= BROADCAST_ROWS:
        rate = F.broadcast(rate)
    used = counts.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.col("tokens") > 0)).join(rate, "source")
    whole = F.floor("rate").cast("int")
    state = used.select("mix_id", "source", "doc_id", "tokens", whole.alias("base"), (F.col("rate") - whole).alias("p"), F.xxhash64(F.lit(SEED), "mix_id", "doc_id").alias("place"))
    state = cut(state, open=F.count_if(F.col("p") > 0))
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    columns = ("mix_id", "source", "doc_id", "tokens", "base", "p")
    buckets = 1
    while buckets * bucket_rows < seen(state, "open"):
        buckets *= FAN_IN
    parts = [state.where("p = 0").select(*columns)]
    rest = state.where("p > 0").withColumn("bucket", F.pmod(F.col("place"), F.lit(buckets)))
    while True:
        order = ("bucket", "mix_id", "source", F.desc("tokens"), "place", "doc_id")  # large ones first, so what stays open is small
        spread = rest.repartition("bucket") if buckets > 1 else rest.repartition(1)
        level = cut(spread.sortWithinPartitions(*order).select(*[c.split()[0] for c in STATE.split(", ")]).mapInPandas(_level(buckets == 1), STATE))
        parts.append(level.where(~fractional).select(*columns))
        if buckets == 1:
            break
        buckets //= FAN_IN
        rest = level.where(fractional).withColumn("bucket", F.pmod(F.col("place"), F.lit(buckets)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("mix_id", "source", "doc_id", "tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and actual tokens and shares of every source of every mix; ``capped`` where max_repeats keeps a source below its target."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    all_of = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    return (
        rates(counts, targets)
        .join(got, ["mix_id", "source"], "left")
        .join(all_of, "mix_id", "left")
        .select(
            "mix_id",
            "source",
            F.col("share").alias("target_share"),
            F.round("target_tokens", 3).alias("target_tokens"),
            F.coalesce("tokens", F.lit(0)).alias("actual_tokens"),
            F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("actual_share"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            (F.col("have") * F.col("cap") < F.col("target_tokens")).alias("capped"),
        )
    )
