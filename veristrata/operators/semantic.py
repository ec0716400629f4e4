"""Vector search over windows of texts, and the state of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.functions.vectors import similarity, vector_problem

OVERLAP_TOKENS = 16
QUERY_WINDOWS = 10_000


#: What a text consists of for a model: where each of its tokens ends, in characters, and how many tokens the model adds.
Tokenizer = tuple[Callable[[str], Sequence[int]], int]


def windows_of(text: str, tokenizer: Tokenizer, maximum: int, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, int]]:
    """Windows (start, end, tokens) that cover ``text``, none of more than ``maximum`` tokens.

    The text is tokenized once; windows are runs of its tokens. A window takes as many tokens as fit
    and ends behind the last blank or line break of its second half, if there is one. The next one
    repeats at most ``overlap`` tokens, and at most a quarter of the budget. An empty text has the
    window (0, 0). A character of more tokens than the budget has room for is an error.
    """
    tokens_of, special = tokenizer
    room = maximum - special
    if maximum < 2 or room < 0 or overlap < 0:
        raise ValueError("no room for tokens")
    if not text:
        return [(0, 0, special)]
    ends = np.asarray(tokens_of(text), dtype=np.int64)
    m, n = len(ends), len(text)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(ends, starts, side="right")  # tokens that share a character stay together
    upto = np.minimum(first + room, m)
    far = np.where(upto > 0, ends[np.maximum(upto, 1) - 1], 0)
    torn = (upto < m) & (ends[np.minimum(upto, m - 1)] == far)
    shared = np.searchsorted(ends, far, side="left")
    far = np.where(torn, np.where(shared > 0, ends[np.maximum(shared, 1) - 1], 0), far)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    natural = np.flatnonzero((code == 32) | (code == 10)) + 1
    at = np.searchsorted(natural, far, side="right")
    last = natural[np.maximum(at, 1) - 1] if len(natural) else np.zeros(m, dtype=np.int64)
    end = np.where((far < n) & (at > 0) & (last > starts + (far - starts) // 2), last, far)
    whole = np.searchsorted(ends, end, side="right")  # tokens up to the end, and one more that it cuts
    held = whole + ((whole < m) & (starts[np.minimum(whole, m - 1)] < end))
    onward = np.maximum(first + 1, held - min(overlap, room // 4))
    chosen = [0]
    while end[chosen[-1]] < n:
        if end[chosen[-1]] <= starts[chosen[-1]]:
            raise ValueError("one character exceeds the token budget")
        chosen.append(int(onward[chosen[-1]]))
    if end[chosen[-1]] <= starts[chosen[-1]]:
        raise ValueError("one character exceeds the token budget")
    return [(int(starts[i]), int(end[i]), int(held[i] - first[i]) + special) for i in chosen]


def token_windows(df: DataFrame, keys: list[str], tokenizer: Callable[[], Tokenizer], maximum: int, text: str = "text") -> DataFrame:
    """(keys.., window, start, end, tokens) of every non-null text. ``tokenizer`` is made once in each worker."""

    @F.pandas_udf("array<struct<start:int,end:int,tokens:int>>")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = tokenizer()
        for series in batches:
            yield series.map(lambda t: [dict(zip(("start", "end", "tokens"), w)) for w in windows_of(t, made, maximum)])

    rows = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(windows(F.col(text))).alias("window", "w"))
    return rows.select(*keys, "window", "w.start", "w.end", "w.tokens")


def span_problems(spans: DataFrame, keys: list[str], lengths: DataFrame, maximum: int) -> DataFrame:
    """(keys.., problem) of texts whose windows do not cover them: first, gap, no_advance, budget, empty, end.

    spans: (keys.., start, end, tokens); lengths: (keys.., length). A text without windows has the
    problem ``end``. An empty text must have the one span (0, 0).
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    rows = spans.join(lengths, keys, "right").withColumns({"ps": F.lag("start").over(order), "pe": F.lag("end").over(order), "top": F.max("end").over(Window.partitionBy(*keys))})
    problem = (
        F.when(F.col("start").isNull() | (F.col("top") != F.col("length")), "end")
        .when(F.col("ps").isNull() & (F.col("start") != 0), "first")
        .when(F.col("start") > F.col("pe"), "gap")
        .when((F.col("start") <= F.col("ps")) | (F.col("end") <= F.col("pe")), "no_advance")
        .when((F.col("tokens") > maximum) | (F.col("tokens") < 0), "budget")
        .when((F.col("start") >= F.col("end")) & (F.col("length") > 0), "empty")
    )
    return rows.select(*keys, problem.alias("problem")).where("problem IS NOT NULL").distinct()


def max_similarity(windows: DataFrame, queries: DataFrame, limit: int = 20, key: str = "text_id", eligible: DataFrame | None = None) -> DataFrame:
    """The ``limit`` (1..1000) texts with the most similar window to any query window: (key, score, window).

    windows: (key, window, vector); queries: (vector), the windows of one query. All windows are
    compared, one pass without shuffling vectors. Scores are rounded to six decimals; of equal
    windows the largest number stands, ties go by key. The windows of the query are broadcast; a query
    of more than QUERY_WINDOWS windows is refused.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    if eligible is not None:
        windows = windows.join(eligible.select("run_key").distinct(), "run_key", "left_semi")
    asked = queries.select(F.col("vector").alias("__q"))
    if asked.limit(QUERY_WINDOWS + 1).count() > QUERY_WINDOWS:
        raise ValueError("the query has too many windows")
    asked = F.broadcast(asked)
    score = F.round(similarity(F.col("vector"), F.col("__q")), 6)
    scored = windows.crossJoin(asked).select(key, F.struct(score.alias("score"), F.col("window").alias("window")).alias("s"))
    best = scored.groupBy(key).agg(F.max("s").alias("s")).select(key, "s.score", "s.window")
    return best.orderBy(F.desc("score"), key).limit(limit)


def vector_problems(embeddings: DataFrame) -> DataFrame:
    """(text_id, backend, model, revision, problem) of stored vectors that cannot be searched."""
    rows = embeddings.select("text_id", "backend", "model", "revision", vector_problem(F.col("vector"), F.col("dimension")).alias("problem"))
    return rows.where("problem IS NOT NULL")


def pending_texts(texts: DataFrame, embeddings: DataFrame, model: str, revision: str, chunk_version: int) -> DataFrame:
    """(run_key, text_id, text_sha256) of texts without a vector of this model, revision and version for their present content."""
    ready = embeddings.where((F.col("model") == model) & (F.col("revision") == revision) & (F.col("chunk_version") == chunk_version) & F.col("vector").isNotNull())
    return texts.select("run_key", "text_id", "text_sha256").distinct().join(ready.select("text_id", "text_sha256").distinct(), ["text_id", "text_sha256"], "left_anti").select("run_key", "text_id", "text_sha256")


def readiness(texts: DataFrame, embeddings: DataFrame, model: str | None, revision: str | None, chunk_version: int) -> DataFrame:
    """(run_key, total, ready, pending, status): not_configured, pending or ready for every run."""
    every = texts.select("run_key", "text_id", "text_sha256").distinct()
    if model is None:
        return every.groupBy("run_key").agg(F.count("*").alias("total")).select("run_key", "total", F.lit(0).cast("long").alias("ready"), F.col("total").alias("pending"), F.lit("not_configured").alias("status"))
    left = pending_texts(texts, embeddings, model, revision, chunk_version).groupBy("run_key").agg(F.count("*").alias("pending"))
    total = every.groupBy("run_key").agg(F.count("*").alias("total"))
    rows = total.join(left, total.run_key.eqNullSafe(left.run_key), "left").select(total.run_key, "total", F.coalesce("pending", F.lit(0)).alias("pending"))
    return rows.select("run_key", "total", (F.col("total") - F.col("pending")).alias("ready"), "pending", F.when(F.col("pending") > 0, "pending").otherwise("ready").alias("status"))


def reusable_vectors(new_texts: DataFrame, old_texts: DataFrame, embeddings: DataFrame, chunk_version: int) -> DataFrame:
    """(text_id, from_text_id, backend, model, revision): vectors of the same run, content and chunk version that new texts can take over.

    The donor is the smallest text_id, chosen before the join, so that a content that many texts
    share does not multiply. Null run keys are a run of their own.
    """
    wanted = new_texts.join(old_texts.select("text_id"), "text_id", "left_anti").select("run_key", "text_id", "text_sha256").distinct()
    stored = old_texts.select("run_key", "text_id", "text_sha256").distinct().join(embeddings.where(F.col("vector").isNotNull() & (F.col("chunk_version") == chunk_version)).select("text_id", "text_sha256", "backend", "model", "revision").distinct(), ["text_id", "text_sha256"])
    donor = stored.groupBy("run_key", "text_sha256", "backend", "model", "revision").agg(F.min("text_id").alias("from_text_id"))
    same = wanted.run_key.eqNullSafe(donor.run_key) & (wanted.text_sha256 == donor.text_sha256)
    return wanted.join(donor, same).select("text_id", "from_text_id", "backend", "model", "revision")
