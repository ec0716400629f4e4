"""Text functions: cleaning, search tokens, chunks, snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunks of a text: fixed values, as stored chunks must be reproducible.
CHUNK_CHARS, CHUNK_OVERLAP = 1400, 160
BLANK_RUN = re.compile(r"[ \t]+")
TOKEN = r"[\p{L}\p{N}]+"
SNIPPET_TOKENS = 40


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and what is left of them without."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Combining marks of Latin letters, which belong to the letter before them.
MARKS = "̀-ͯ"


#: All Unicode white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(column: Column) -> Column:
    """Without white space at both ends (all Unicode white space, not only blanks)."""
    return F.btrim(column, F.lit(WHITE))


def nonempty(column: Column) -> Column:
    """Whether there is anything but white space; false for null."""
    return F.coalesce(F.length(stripped(column)) > 0, F.lit(False))


def folded(column: Column) -> Column:
    """Lower case, Latin letters without accents: the form in which words are searched."""
    plain = F.translate(F.regexp_replace(column, f"[{MARKS}]", ""), ACCENTED, PLAIN)
    return F.lower(F.when(column.rlike(f"[{MARKS}\u00c0-\u024f\u1e00-\u1eff]"), plain).otherwise(column))  # most texts have none of these


def search_tokens(column: Column) -> Column:
    """Array of the words of a text: maximal runs of letters and digits of its folded form; null for null."""
    return F.regexp_extract_all(folded(column), F.lit(f"({TOKEN})"), F.lit(1))


def query_tokens(spark, query: str) -> list[list[str]]:
    """The phrases of a query: its words (runs of letters, digits and _), each as the search tokens it consists of.

    A query without a word is refused.
    """
    row = spark.range(1).select(F.regexp_extract_all(F.lit(query), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("w")).select(F.transform("w", search_tokens).alias("t")).first()
    phrases = [p for p in row.t if p]
    if not phrases:
        raise ValueError("the query has no word")
    return phrases


def _latest(places: np.ndarray, size: int) -> np.ndarray:
    """For each position 0..size the last of ``places`` up to it, or 0."""
    out = np.zeros(size + 1, dtype=np.int64)
    out[places] = places
    return np.maximum.accumulate(out)


def chunk_table(text: str, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position of ``text`` where a chunk that begins there ends, and where the next one begins.

    A chunk ends behind the last line break or the last ``". "`` of its second half, else after
    ``size`` characters, and the next one reaches ``overlap`` characters back.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(code)
    line = _latest(np.flatnonzero(code == 10) + 1, n)
    stop = _latest(np.flatnonzero((code[:-1] == 46) & (code[1:] == 32)) + 1, n)
    begin = np.arange(n)
    full = np.minimum(begin + size, n)
    natural = np.maximum(line[full], stop[full - 1])
    end = np.where(full == n, n, np.where(natural > begin + size // 2, natural, full))
    return end, np.maximum(begin + 1, end - overlap)


def chunks_of(text: str | None, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """The chunks of a text whose runs of blanks and tabs became one blank; stripped, without empty ones."""
    whole = BLANK_RUN.sub(" ", text or "").strip()
    if not whole:
        return []
    end, onward = chunk_table(whole, size, overlap)
    begins = [0]
    while end[begins[-1]] < len(whole):
        begins.append(int(onward[begins[-1]]))
    return [piece for b in begins if (piece := whole[b : end[b]].strip())]


def chunked(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys.., ordinal, text): the chunks of every text, numbered from 0. Null and blank texts have none."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(chunks_of)

    return df.select(*keys, F.posexplode(cut(F.col(text))).alias("ordinal", "text"))


def highlighted(column: Column, phrases: list[list[str]], width: int = SNIPPET_TOKENS) -> Column:
    """The text with matched words in brackets, cut to ``width`` words from the first match on, with ``...`` where it is cut."""
    words = "|".join(sorted({t for p in phrases for t in p}))
    pattern = rf"(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])"
    parts = F.split(F.regexp_replace(column, r"\s+", " "), " ")
    hit = F.transform(parts, lambda w: folded(w).rlike(pattern))
    first = F.coalesce(F.array_position(hit, F.lit(True)), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first - width // 2, F.size(parts) - width + 1))
    shown = F.transform(F.slice(parts, start.cast("int"), F.lit(width)), lambda w: F.when(folded(w).rlike(pattern), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(shown, " "), F.when(start + width - 1 < F.size(parts), "...").otherwise(""))


def window_snippet(text: Column, start: Column, end: Column, most: int = 500) -> Column:
    """The first ``most`` characters of text[start:end)."""
    return F.substring(text, (start + 1).cast("int"), F.least(end - start, F.lit(most)).cast("int"))


def locators(scope: Column) -> Column:
    """The places that a read scope names: ``page:<n>`` and ``document``, each once."""
    return F.array_distinct(F.regexp_extract_all(scope, F.lit(r"(\bpage:\d+\b|\bdocument\b)"), F.lit(1)))
