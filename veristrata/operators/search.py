"""Ranked full-text search: every phrase must occur, BM25 ranks, statistics cover the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.functions.text import highlighted, query_tokens, search_tokens

K1, B = 1.2, 0.75


def token_index(texts: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """(key, tokens): the tokens of each text in order; the basis of postings and of phrase search."""
    return texts.select(key, search_tokens(F.col(text)).alias("tokens"))


def postings(texts: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """(term, key, tf, positions): the inverted index. Positions count from 0."""
    words = token_index(texts, key, text).select(key, F.posexplode("tokens").alias("pos", "term"))
    return words.groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def spaced(tokens: Column) -> Column:
    """The tokens as one text with a blank before and behind each."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in spaced tokens."""
    return F.regexp_count(words, F.lit(f"(?<= ){' '.join(phrase)}(?= )"))


def find(texts: DataFrame, query: str, limit: int = 20, eligible: DataFrame | None = None, key: str = "text_id", text: str = "text", keep: tuple[str, ...] = ("run_key", "kind", "object_id", "locator")) -> DataFrame:
    """The best ``limit`` texts (1..1000) that contain all words of the query, with a snippet and a score; smaller is better.

    N, the document frequencies and the mean length are those of all of ``texts``, also where only
    runs of ``eligible`` (run_key) may be returned. One pass reads the texts and gives each its
    length and phrase counts; the statistics are one row, so nothing is shuffled but partial sums.
    Scores are rounded to six decimals, ties go by key.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    phrases = query_tokens(texts.sparkSession, query)
    counted = texts.select(key, *keep, text, spaced(search_tokens(F.col(text))).alias("__t"))
    names = [f"__f{i}" for i in range(len(phrases))]
    counted = counted.select(key, *keep, text, F.when(F.col("__t") == "  ", 0).otherwise(F.regexp_count("__t", F.lit(" ")) - 1).alias("__len"), *[phrase_count(F.col("__t"), p).alias(n) for p, n in zip(phrases, names)])
    stats = counted.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(n) > 0).alias(f"{n}_df") for n in names])
    hits = counted.where(" AND ".join(f"{n} > 0" for n in names))
    if eligible is not None:
        hits = hits.join(eligible.select("run_key").distinct(), "run_key", "left_semi")
    score = F.lit(0.0)
    for n in names:
        df = F.col(f"{n}_df")
        idf = F.ln((F.col("__n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        tf = F.col(n).cast("double")
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    ranked = hits.crossJoin(F.broadcast(stats)).select(key, *keep, text, F.round(score, 6).alias("score"))  # stats is one row
    best = ranked.orderBy("score", key).limit(limit)
    return best.select(key, *keep, highlighted(F.col(text), phrases).alias("snippet"), "score")


def find_in_postings(index: DataFrame, lengths: DataFrame, words: list[str], limit: int = 20, key: str = "text_id") -> DataFrame:
    """The same ranking for single words over a stored inverted index: reads only the postings of the words.

    index: (term, key, tf); lengths: (key, len) of all texts.
    """
    words = sorted(set(words))
    mine = index.where(F.col("term").isin(words)).select("term", key, "tf")
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = mine.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(stats))  # df has a row for each word of the query
    part = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = rows.groupBy(key).agg(F.count("*").alias("hit"), F.round(-F.sum(part), 6).alias("score")).where(F.col("hit") == len(words))
    return scored.select(key, "score").orderBy("score", key).limit(limit)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")
