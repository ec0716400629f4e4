"""Splitting oversized texts at natural boundaries by packing their structure tree.

Headings with their levels, markup, paragraphs, list items by indentation, lines and sentences give
boundaries of a rank; a node of the tree is what lies between two boundaries, and its children are
what the strongest boundaries within it set apart. A node within the limit is one piece; only an
oversized one is opened. On the way back neighbouring siblings that are whole are merged up to the
limit, lowest nodes first, so no piece holds the end of an oversized section and the start of the
next one, and a heading stays with what follows. Inside a run of more than ``limit`` characters
without white space and 。！？ there is no boundary, and the cut is forced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veristrata.plans.lineage import cut, seen

LIMIT, OVERLAP = 1400, 160
BLANKS = re.compile(r"[ \t]+")
#: Ranks of boundaries: heading levels 1 to 6, titles without a mark, paragraphs, list items by depth, lines, sentences.
TITLE, PARAGRAPH, ITEM, DEEPEST, LINE, SENTENCE = 7, 8, 9, 7, 17, 18
HEADING = re.compile(r"(#{1,6})[ \t]+\S")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
LIST_ITEM = re.compile(r"(?:[-*+•‣◦·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+\S")
BARE_TITLE = re.compile(r"[^\n]{0,99}[^\s.!?。！？…,;:，；：、|]$")
MARKUP = re.compile(r"<(h[1-6]|section|article|p|div|table|ul|ol|blockquote|pre|li|tr|dt|dd|br)\b[^<>]{0,300}>", re.IGNORECASE)
MARKUP_RANK = {f"h{i}": i for i in range(1, 7)} | {"section": TITLE, "article": TITLE, "li": ITEM, "tr": ITEM, "dt": ITEM, "dd": ITEM, "br": LINE}
SENTENCE_END = re.compile(r"[.!?…]+[\"”»’)\]]*\s+|[。！？]+[」』”’）)]*\s*")
DELIMITER = re.compile(r"[\s。！？]")
SCHEMA = "piece int, text string, start_pos int, end_pos int, overlap int, forced boolean"


def normalized(text: str) -> str:
    """Each run of blanks and tabs one blank, white space at both ends dropped."""
    return BLANKS.sub(" ", text).strip()


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the normalised ``text`` where a node may begin, and their ranks; indentation is that of the text as it was."""
    whole = normalized(text)
    rank: dict[int, int] = {m.end(): SENTENCE for m in SENTENCE_END.finditer(whole)}

    def mark(at: int, r: int) -> None:
        rank[at] = min(r, rank.get(at, SENTENCE))

    for m in MARKUP.finditer(whole):
        mark(m.start(), MARKUP_RANK.get(m.group(1).lower(), PARAGRAPH))
    lines, raw = whole.split("\n"), text.strip().split("\n")
    at, blank, before = 0, True, ""  # before: what kind of line the last one with content was
    for i, line in enumerate(lines):
        bare = line.strip()
        if bare:
            following = lines[i + 1].strip() if i + 1 < len(lines) else ""
            kind, r = "text", PARAGRAPH if blank else LINE
            if m := HEADING.match(bare):
                kind, r = "heading", len(m.group(1))
            elif not LIST_ITEM.match(bare) and (m := UNDERLINE.match(following)) and len(m.group(1)) >= 3:
                kind, r = "heading", 1 if m.group(1)[0] == "=" else 2
            elif LIST_ITEM.match(bare):
                indent = len(raw[i].expandtabs(4)) - len(raw[i].expandtabs(4).lstrip())
                kind, r = "item", ITEM + min(indent // 2, DEEPEST)
                if blank and before not in ("item", "heading"):
                    r = PARAGRAPH
            elif before == "heading":
                r = LINE  # what a heading stands above stays with it
            elif blank and not following and i + 1 < len(lines) and BARE_TITLE.match(bare):
                kind, r = "heading", TITLE
            mark(at, r)
            before = kind
        blank = not bare
        at += len(line) + 1
    at = sorted(p for p in rank if 0 < p < len(whole))
    return np.array(at, dtype=np.int64), np.array([rank[p] for p in at], dtype=np.int64)


class _Packer:
    def __init__(self, text: str, limit: int, overlap: int) -> None:
        self.text, self.limit, self.room = normalized(text), limit, limit - overlap
        self.at, self.rank = boundaries(text) if len(self.text) > limit else (np.zeros(0, dtype=np.int64),) * 2
        self.forced: set[int] = set()

    def cap(self, a: int) -> int:
        """Room of a piece that begins at ``a``: only the first has no overlap before it."""
        return self.room if a else self.limit

    def pack(self, a: int, b: int, low: int, high: int) -> list[tuple[int, int]]:
        """Pieces of the node [a, b), whose inner boundaries are number low to high."""
        if b - a <= self.cap(a):
            return [(a, b)]
        if low == high:
            return self.words(a, b)
        inner = low + np.flatnonzero(self.rank[low:high] == self.rank[low:high].min())
        begins = [a, *self.at[inner].tolist()]
        ends = [*begins[1:], b]
        firsts = [low, *(inner + 1).tolist()]
        lasts = [*inner.tolist(), high]
        out: list[tuple[int, int]] = []
        open_: tuple[int, int] | None = None  # whole siblings merged so far
        for x, y, i, j in zip(begins, ends, firsts, lasts):
            if open_ and y - open_[0] <= self.cap(open_[0]):
                open_ = (open_[0], y)
                continue
            if open_:
                out.append(open_)
                open_ = None
            parts = self.pack(x, y, i, j)
            if len(parts) == 1:
                open_ = parts[0]
            else:
                out += parts
        return out + [open_] if open_ else out

    def words(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pieces of an oversized sentence, between words; a run that fits the limit alone takes room from the overlap."""
        out: list[tuple[int, int]] = []
        while b - a > self.cap(a):
            stop = a + self.cap(a)
            end = self._last(a, stop)
            if end is None:
                end = self._first(stop, min(b, a + self.limit))
            if end is None:
                if b - a <= self.limit:
                    break
                end = stop
                self.forced.add(end)
            out.append((a, end))
            a = end
        return out + [(a, b)] if a < b else out

    def _natural(self, p: int) -> bool:
        return bool(DELIMITER.match(self.text[p - 1]) or DELIMITER.match(self.text[p]))

    def _last(self, a: int, p: int) -> int | None:
        while p > a:
            if self._natural(p):
                return p
            p -= 1
        return None

    def _first(self, p: int, top: int) -> int | None:
        while p <= top:
            if p < len(self.text) and self._natural(p):
                return p
            p += 1
        return None


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int, int, bool]]:
    """Pieces (text, start, end, overlap, forced) of the normalised text.

    Pieces without their overlaps, joined, are the normalised text. Each has at most ``limit``
    characters and repeats the ``overlap`` characters before it; fewer only where an unbreakable run
    needs the room. forced: the piece ends inside a run longer than ``limit``. Null and blank texts
    have no piece.
    """
    packer = _Packer(text or "", limit, overlap)
    whole = packer.text
    if not whole:
        return []
    out = []
    for a, b in packer.pack(0, len(whole), 0, len(packer.at)):
        lap = min(overlap, limit - (b - a), a)
        out.append((whole[a - lap : b], a - lap, b, lap, b in packer.forced))
    return out


def split_column(df: DataFrame, keep: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The ``keep`` columns of each row with its pieces: piece, text, start_pos, end_pos, overlap, forced. One narrow pass."""
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, keep)) + ", " + SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch["__text"].tolist()):
                for k, piece in enumerate(split_text(t, limit, overlap)):
                    at.append(i)
                    rows.append((k, *piece))
            made = pd.DataFrame(rows, columns=["piece", "text", "start_pos", "end_pos", "overlap", "forced"])
            yield pd.concat([batch[names].iloc[at].reset_index(drop=True), made], axis=1)

    source = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("__text"))
    return source.mapInPandas(run, schema).withColumnsRenamed(dict(zip(names, keep)))


def oversized(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(text_id, cut) of every text that is longer than the limit once normalised: 'forced' if a piece of it ends in an unbreakable run."""
    long = texts.where(F.length("text") > limit).select("text_id", "text")  # normalising never lengthens
    made = split_column(long, ["text_id"], limit=limit)
    whole = made.groupBy("text_id").agg(F.max("end_pos").alias("size"), F.max(F.col("forced").cast("int")).alias("forced"))
    return whole.where(F.col("size") > limit).select("text_id", F.when(F.col("forced") == 1, "forced").otherwise("natural").alias("cut"))


#: Up to so many repeated text_ids are broadcast.
BROADCAST_IDS = 100_000


def latest_texts(texts: DataFrame) -> DataFrame:
    """Each text_id once, with its latest row (then the largest text). Only rows of repeated text_ids are shuffled, unless these are many."""
    columns = ["run_key", "kind", "object_id", "locator", "ordinal", "text"]
    rows = texts.where(F.col("text_id").isNotNull())
    again = cut(rows.groupBy("text_id").agg(F.count("*").alias("n")).where("n > 1").select("text_id"))
    ids = F.broadcast(again) if seen(again) <= BROADCAST_IDS else again
    last = rows.join(ids, "text_id", "left_semi").groupBy("text_id").agg(F.max_by(F.struct(*columns), F.struct("synced_at", "text")).alias("r")).select("text_id", "r.*")
    return rows.join(ids, "text_id", "left_anti").select("text_id", *columns).unionByName(last)


def renumbered_pieces(texts: DataFrame) -> DataFrame:
    """All texts in pieces under the limit; ``ordinal`` counts the pieces of one object and locator from 0.

    Repeated rows of one text_id count once (the latest synced_at). Objects and locators compare
    null-safely; a null ordinal comes first, ties go by text_id. Texts are split once; numbers come
    from prefix sums over ranges of (object, old ordinal, text_id) without the texts, so that a hot
    object, or one whose ordinals are all null or alike, is no single task.
    """
    owner = ["run_key", "kind", "object_id", "locator"]
    made = cut(split_column(latest_texts(texts), ["text_id", *owner, "ordinal"]))
    key = F.to_json(F.struct(*owner), {"ignoreNullFields": "false"})
    sizes = made.where("piece = 0 OR piece IS NULL").select("text_id", key.alias("owner"), F.col("ordinal").alias("old"))
    sizes = sizes.join(made.groupBy("text_id").agg(F.count("*").alias("n")), "text_id")
    ranged = cut(sizes.repartitionByRange("owner", F.col("old").asc_nulls_first(), "text_id").withColumn("part", F.spark_partition_id()))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("owner", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("owner", "part", F.coalesce(F.sum("n").over(before("owner").orderBy("part")), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n").over(before("owner", "part").orderBy(F.col("old").asc_nulls_first(), "text_id")), F.lit(0))
    first = ranged.withColumn("within", within).join(parts, ["owner", "part"]).select("text_id", (F.col("ahead") + F.col("within")).alias("first"))
    return made.join(first, "text_id").select("text_id", *owner, (F.col("first") + F.col("piece")).cast("int").alias("ordinal"), "text", "overlap", "forced")
