"""Languages of documents and of their mixed-language segments.

The script of a word narrows its candidates; words of a script that several languages share are
scored by a word model. A Viterbi pass over the words of an item, with a high penalty for a switch
inside a sentence and a low one between sentences, labels the spans. A foreign name or a quoted word
cannot pay the penalty and keeps the language of its sentence.

A script that none of the languages uses is the language ``und``, and so are sentences most of whose
words no text of the languages has.

The word model does not trust the received labels: sentences of a bounded sample that function words
identify start it, and two rounds of re-labelling the sampled sentences with it make a first model.
With that model the words of all texts are counted by language, and these counts are the model.
Han characters without kana are told apart by the characters that occur with kana and without, over
all texts.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.text import nonempty
from veristrata.plans.lineage import cut, release
from veristrata.llm.sentences import OTHER_MARKS, PARAGRAPH, SentenceModel, counts_on, fit, training_texts

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "ko", "ja", "zh", "th")
UNKNOWN = "und"
#: States of the Viterbi pass.
STATES = (*LANGUAGES, UNKNOWN)
INDEX = {x: i for i, x in enumerate(STATES)}
LATIN = ("en", "de", "fr", "es", "pt")
#: Function words that identify a language of Latin script before anything is learnt.
FUNCTION_WORDS = {
    "en": "the of and to in is was for from with by that this it as at an be are not or which",
    "de": "der die das und nicht den dem des ein eine einen ist zu von mit für im auf wird noch auch als bei",
    "fr": "la en a à n l d le les des du et est pour dans une un que qui pas sur de au aux avec ce cette ne se plus par",
    "es": "la a de el los las del y en una un por con se para no que al lo su sin es más",
    "pt": "a de o os as do da dos das e em uma um por com não para que ao na no se sem é mais",
}
#: Function words that no other of these languages has.
OWN_WORDS = {x: frozenset(words.split()).difference(*[w.split() for y, w in FUNCTION_WORDS.items() if y != x]) for x, words in FUNCTION_WORDS.items()}
#: The word model counts at most so many distinct words; rarer words are unknown.
MAX_WORDS = 60_000
SWITCH_INSIDE, SWITCH_BETWEEN = 14.0, 2.0
CLIP = 4.0

DATA = re.compile(r"[!-~]{25,}")
WORD = re.compile(r"[A-Za-zªºÀ-ɏ̀-ͯḀ-ỿ]+|[가-힣ᄀ-ᇿ]+|[฀-๿]+|[぀-ヿ㐀-鿿々ｦ-ﾟ]+|[Ѐ-ӿ]+|[^\W\d_A-Za-zªºÀ-ɏ̀-ͯḀ-ỿЀ-ӿ฀-๿぀-ヿ㐀-鿿々ｦ-ﾟ가-힣ᄀ-ᇿ]+")
#: A sentence of at least so many words may be in another language if at least this share of them is not known in any
#: language (Latin) or has letters that Russian has not (Cyrillic), unless this share is function words of its language only.
UNKNOWN_WORDS, UNKNOWN_SHARE, UNKNOWN_LETTERS, FUNCTION_SHARE = 4, 0.6, 0.3, 0.15
#: Words, and what may stand between two sentences.
WORD_OR_END = re.compile(WORD.pattern + rf"|[.!?…。！？｡．‥⁇⁈⁉‼\n{OTHER_MARKS}]+|(?<=[฀-๿])\s+|\s+(?=[฀-๿])")
#: Letters of other scripts, and the words and ends of lower-case text of Latin script.
OTHER = re.compile(r"[Ͱ-᷿ἀ-῿Ⰰ-ⷿ⺀-퟿豈-﷿ｦ-ﾟ]")
LATIN_OR_END = re.compile(r"[a-zªºß-öø-ɏ̀-ͯḁ-ỿ]+|[.!?…]+(?=[\s\"”»’)])|\n\s*\n")
#: Rough sentences, as far as counting words needs them.
ROUGH = re.compile(r"\n\s*\n|[.!?。！？…]+[\"”»’」』)]*(?:\s+|(?=[぀-ヿ㐀-鿿]))")
HAN = re.compile(r"[㐀-鿿]")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
#: A text of fewer words is always split into sentences.
LEAST_WORDS = 8
#: A sentence is counted for a language that leads by so much.
NEED = 1.0
KANA = re.compile(r"[぀-ヿｦ-ﾟ]")


def words_of(text: str) -> list[str]:
    """Words, or runs of a script without blanks; strings of data are left out."""
    return WORD.findall(DATA.sub(" ", text) if DATA.search(text) else text)


class _Index(dict):
    """Row numbers of words; a new word gets the next row."""

    def __init__(self, model: "LanguageModel") -> None:
        self.model = model

    def __missing__(self, word: str) -> int:
        rows = self.model._rows
        self[word] = number = len(self)
        rows.append(self.model.row(word))
        self.model._new.append((*[word.lower() in OWN_WORDS[x] for x in LATIN], self.model.strange(word), WORD.match(word) is None))
        return number


class LanguageModel:
    """Scores of words by language; unknown words of a shared script score 0.

    latin: word -> scores by LATIN; han: character -> how much it speaks for Japanese; cyrillic: the
    letters of the known words of Russian.
    """

    def __init__(self, latin: dict[str, list[float]], han: dict[str, float], cyrillic: frozenset[str] = frozenset()) -> None:
        self.latin, self.han, self.cyrillic = latin, han, cyrillic
        self._rows: list[list[float]] = []
        self._new: list[tuple[bool, ...]] = []
        self._index = _Index(self)
        self._matrix = np.zeros((0, len(STATES)), dtype=np.float32)
        self._strange = np.zeros((0, 7), dtype=bool)

    def row(self, word: str) -> list[float]:
        """Scores by STATES of one word; what ends sentences has none."""
        c = word[0]
        if not c.isalpha() and not "\u0300" <= c <= "\u036f":
            return [0.0] * len(STATES)
        if c < "ͰЀ"[0] or "Ḁ" <= c <= "ỿ":
            scores = self.latin.get(word.lower())
            if scores is None:
                return [0.0] * 5 + [-0.3] * 5 + [-CLIP]
            return [*scores, *[-0.3 - max(0.0, max(scores))] * 5, -CLIP]
        if "Ѐ" <= c <= "ӿ":
            return self._one("ru")
        if "฀" <= c <= "๿":
            return self._one("th")
        if "가" <= c <= "힣" or "ᄀ" <= c <= "ᇿ":
            return self._one("ko")
        if KANA.search(word):
            return self._one("ja")
        if not ("㐀" <= c <= "鿿" or c == "々"):
            return self._one(UNKNOWN)
        s = max(-CLIP, min(CLIP, sum(self.han.get(x, 0.0) for x in word)))
        out = [-CLIP] * len(STATES)
        out[INDEX["ja"]], out[INDEX["zh"]] = s / 2 + 0.5, -s / 2 + 0.5
        return out

    def strange(self, word: str) -> bool:
        """Whether a Latin or Cyrillic word is not known. Single letters say nothing."""
        c = word[0]
        if len(word) == 1:
            return False
        if "Ѐ" <= c <= "ӿ":
            return bool(self.cyrillic) and not self.cyrillic.issuperset(word.lower())
        return (c < "ͰЀ"[0] or "Ḁ" <= c <= "ỿ") and word.lower() not in self.latin

    @staticmethod
    def _one(language: str) -> list[float]:
        out = [-CLIP] * len(STATES)
        out[INDEX[language]] = 1.0
        return out

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Matrix of the scores of ``words``; and for each whether it is a function word of only each of LATIN, whether it is strange, and whether it is no word."""
        index = self._index
        if len(index) > 400_000:
            index.clear()
            self._rows, self._new = [], []
            self._matrix, self._strange = self._matrix[:0], self._strange[:0]
        ids = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self._matrix) < len(index):  # only rows of new words are made
            self._matrix = np.concatenate([self._matrix, np.array(self._rows, dtype=np.float32)])
            self._strange = np.concatenate([self._strange, np.array(self._new, dtype=bool).reshape(-1, 7)])
            self._rows, self._new = [], []
        return self._matrix[ids], self._strange[ids]

    def __getstate__(self) -> dict:
        return {"latin": self.latin, "han": self.han, "cyrillic": self.cyrillic}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["latin"], state["han"], state["cyrillic"])

    def save(self, path: str) -> None:
        """Write the model as JSON."""
        with open(path, "w", encoding="utf-8") as out:
            json.dump({"latin": self.latin, "han": self.han, "cyrillic": sorted(self.cyrillic)}, out, ensure_ascii=False)

    @staticmethod
    def load(path: str) -> "LanguageModel":
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        return LanguageModel(read["latin"], read["han"], frozenset(read["cyrillic"]))


class WordCounts:
    """Counts over rough sentences: of words by language, of Han characters with and without kana, and of Cyrillic letters.

    Words count in sentences without letters of other scripts.
    """

    def __init__(self, labels: LanguageModel) -> None:
        self.labels = labels
        self.latin: list[Counter[str]] = [Counter() for _ in LATIN]
        self.kana: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        self.cyrillic: Counter[str] = Counter()

    def add(self, texts: Iterable[str]) -> None:
        words: list[str] = []  # with what ends sentences between them
        for text in texts:
            if DATA.search(text):
                text = DATA.sub(" ", text)
            if not OTHER.search(text):
                words += LATIN_OR_END.findall(text.lower())
                words.append(".")
                continue
            for part in ROUGH.split(text):
                if not OTHER.search(part):
                    words += LATIN_OR_END.findall(part.lower())
                    words.append(".")
                elif han := HAN.findall(part):
                    self.kana[0 if KANA.search(part) else 1].update(han)
                else:
                    self.cyrillic.update(CYRILLIC.findall(part))
        if not words:
            return
        vocabulary: dict[str, int] = {}
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64)
        table = np.zeros((len(vocabulary), 5))
        ends = np.zeros(len(vocabulary), dtype=bool)
        for w, i in vocabulary.items():
            if (row := self.labels.latin.get(w)) is not None:
                table[i] = row
            ends[i] = not w[0].isalpha() and not "\u0300" <= w[0] <= "\u036f"
        stop = ends[ids]
        number = np.cumsum(stop)[~stop]  # of the sentence of each word
        ids = ids[~stop]
        if not len(ids):
            return
        begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        total = np.add.reduceat(table[ids], begin, axis=0)
        sizes = np.diff(np.append(begin, len(ids)))
        ranked = np.sort(total, axis=1)
        sure = ranked[:, -1] - ranked[:, -2] >= NEED
        label = np.where(sure, total.argmax(axis=1), 5)
        n = np.bincount(ids * 6 + np.repeat(label, sizes), minlength=6 * len(vocabulary)).reshape(-1, 6)
        names = list(vocabulary)
        for i in range(5):
            for k in np.flatnonzero(n[:, i]).tolist():
                self.latin[i][names[k]] += int(n[k, i])

    def rows(self) -> Iterator[tuple[str, str, int]]:
        """(kind, word, count)."""
        for kind, counter in [*zip(LATIN, self.latin), ("kana", self.kana[0]), ("no kana", self.kana[1]), ("ru", self.cyrillic)]:
            for word, n in counter.items():
                yield kind, word, n


def fit_languages(texts: Iterable[str], sentences: SentenceModel, rounds: int = 2) -> LanguageModel:
    """The word model of the sampled ``texts``; deterministic for the same texts."""
    seeds: dict[str, list[float]] = {}
    for i, code in enumerate(LATIN):
        for w in FUNCTION_WORDS[code].split():
            seeds.setdefault(w, [0.0] * 5)[i] = 1.0
    bags: list[Counter[str]] = []
    wholes: list[Counter[str]] = []
    with_kana: Counter[str] = Counter()
    without: Counter[str] = Counter()
    for text in texts:
        for part in PARAGRAPH.split(text):
            words = words_of(part)
            if latin := [w.lower() for w in words if w[0] < "Ͱ"]:
                if len(latin) >= 0.8 * len(words):
                    wholes.append(Counter(latin))
        for a, b in sentences.units(text):
            piece = text[a:b]
            words = words_of(piece)
            latin = [w.lower() for w in words if w[0] < "Ͱ"]
            han = [x for w in words for x in w if "㐀" <= x <= "鿿"]
            if han and 2 * sum(map(len, latin)) < 3 * len(piece):
                (with_kana if KANA.search(piece) else without).update(han)
            if latin and len(latin) >= 0.8 * len(words):
                bags.append(Counter(latin))
    table = {w: [x * 2.0 for x in s] for w, s in seeds.items()}
    need = 2.0
    for turn in range(rounds + 1):
        counts = [Counter() for _ in LATIN]
        for bag in bags if turn else wholes:  # a paragraph has more function words than a sentence
            s = [0.0] * 5
            for w, n in bag.items():
                if (row := table.get(w)) is not None:
                    for i in range(5):
                        s[i] += n * row[i]
            best = sorted(range(5), key=lambda i: -s[i])
            if s[best[0]] - s[best[1]] >= need:
                counts[best[0]].update(bag)
        total = [sum(c.values()) + 1 for c in counts]
        every: Counter[str] = Counter()
        for c in counts:
            every.update(c)
        table = _word_scores(counts, total, [(w, n) for w, n in every.most_common(MAX_WORDS) if n >= 2 or w in seeds])
        for w, s in seeds.items():
            if w not in table:
                table[w] = [2.0 * x for x in s]
        need = NEED
    return LanguageModel({w: [round(x, 3) for x in s] for w, s in table.items()}, _han_scores(with_kana, without))


def _word_scores(counts: list[Counter[str]], total: list[int], words: Iterable[tuple[str, int]]) -> dict[str, list[float]]:
    table = {}
    for w, n in words:
        logs = [math.log((c[w] + 0.05) / t) for c, t in zip(counts, total)]
        mean = sum(logs) / 5
        table[w] = [n / (n + 3.0) * max(-CLIP, min(CLIP, x - mean)) for x in logs]
    return table


def _han_scores(with_kana: Counter[str], without: Counter[str]) -> dict[str, float]:
    kt, nt = sum(with_kana.values()) + 1, sum(without.values()) + 1
    return {x: max(-2.0, min(2.0, math.log((with_kana[x] + 0.5) / kt * nt / (without[x] + 0.5)))) for x in {*with_kana, *without}}


def counted_languages(documents: DataFrame, first: LanguageModel, text: str = "text") -> LanguageModel:
    """The word model of all texts, whose rough sentences ``first`` labels: one pass with partial sums.

    Words that occur once are left out, of the others the MAX_WORDS most frequent ones are kept; a
    letter of Russian is one in a hundred thousand of its letters at least; seed words keep the scores of ``first`` where they do not occur.
    """
    shared = documents.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = WordCounts(shared.value)
            counts.add(batch["t"].tolist())
            yield pd.DataFrame(list(counts.rows()), columns=["kind", "word", "n"])

    rows = documents.where(F.length(text) > 0).select(F.col(text).alias("t")).mapInPandas(run, "kind string, word string, n bigint")
    sums = cut(rows.groupBy("kind", "word").agg(F.sum("n").alias("n")))
    totals = {r.kind: r.n for r in sums.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    script = F.when(F.col("kind").isin(*LATIN), "latin").otherwise(F.col("kind"))
    whole = sums.groupBy(script.alias("script"), "word").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("kind") == x, F.col("n"))).alias(x) for x in LATIN])
    han = whole.where("script IN ('kana', 'no kana')").collect()  # characters
    latin = whole.where("script = 'latin' AND all > 1").orderBy(F.desc("all"), "word").limit(MAX_WORDS).collect()
    cyrillic = whole.where("script = 'ru'").groupBy(F.lower("word").alias("word")).agg(F.sum("all").alias("all"))
    letters = cyrillic.collect()  # an alphabet
    floor = 1e-5 * sum(r.all for r in letters)
    counts = [Counter({r.word: r[x] or 0 for r in latin}) for x in LATIN]
    table = _word_scores(counts, [totals.get(x, 0) + 1 for x in LATIN], [(r.word, r.all) for r in latin])
    for words in FUNCTION_WORDS.values():
        for w in words.split():
            if w not in table and w in first.latin:
                table[w] = first.latin[w]
    kana = [Counter({r.word: r.all for r in han if r.script == kind}) for kind in ("kana", "no kana")]
    release(sums)
    return LanguageModel({w: [round(x, 3) for x in s] for w, s in table.items()}, _han_scores(*kana), frozenset(r.word for r in letters if r.all >= floor))


def viterbi(scores: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best language of each word of many items at once.

    scores: the words' scores, item after item; first: 1 where a word begins a sentence; lengths:
    words of each item. Items advance together, longest first, so each step is one vector operation.
    """
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    lengths, offsets = lengths[order], offsets[order]
    n, states = len(scores), scores.shape[1]
    back = np.zeros((n, states), dtype=np.int8)
    out = np.zeros(n, dtype=np.int8)
    active = int((lengths > 0).sum())
    if not active:
        return out
    best = scores[offsets[:active]].copy()
    final = np.zeros(len(lengths), dtype=np.int8)
    own = np.arange(states, dtype=np.int8)
    for t in range(1, int(lengths[0]) + 1):
        still = int(np.searchsorted(-lengths, -t, side="left"))  # items longer than t
        if still < active:
            final[still:active] = best[still:active].argmax(axis=1)
        active = still
        if not active:
            break
        at = offsets[:active] + t
        best = best[:active]
        top = best.argmax(axis=1)
        switched = best[np.arange(active), top] - np.where(first[at], SWITCH_BETWEEN, SWITCH_INSIDE).astype(np.float32)
        stay = best >= switched[:, None]
        back[at] = np.where(stay, own[None, :], top[:, None].astype(np.int8))
        best = np.where(stay, best, switched[:, None]) + scores[at]
    state = final.copy()
    for t in range(int(lengths[0]) - 1, -1, -1):
        active = int(np.searchsorted(-lengths, -t, side="left"))
        at = offsets[:active] + t
        out[at] = state[:active]
        if t:
            state[:active] = back[at, state[:active]]
    return out


def scripts_mixed(text: str) -> bool:
    """Whether a dozen places of a long text show several scripts; a guess that only decides which way is tried first."""
    n = len(text)
    if n < 240:
        return False
    kinds = set()
    for i in range(0, n - 20, n // 12):
        piece = text[i : i + 20]
        if other := OTHER.search(piece):
            c = other.group()
            kinds.add("ko" if "가" <= c <= "힣" else "th" if "฀" <= c <= "๿" else "ru" if "Ѐ" <= c <= "ӿ" else "han")
        elif sum(map(str.isalpha, piece)) > 14:
            kinds.add("latin")
        if len(kinds) > 1:
            return True
    return False


class Labeller:
    """Languages of the sentences of texts."""

    def __init__(self, sentences: SentenceModel, languages: LanguageModel) -> None:
        self.sentences, self.languages = sentences, languages

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int, str | None, float]]]:
        """For each text its sentences as (start, end, language, confidence); the language of data is null, that of other languages ``und``."""
        units = [self.sentences.units(t) for t in texts]
        words: list[str] = []
        counts: list[int] = []
        lengths = []
        for text, spans in zip(texts, units):
            before = len(words)
            split = words_of if text and DATA.search(text) else WORD.findall
            for a, b in spans:
                got = split(text[a:b])
                words += got
                counts.append(len(got))
            lengths.append(len(words) - before)
        scores, strange = self.languages.scores(words)
        n = np.array(counts, dtype=np.int64)
        at = np.cumsum(n) - n
        first = np.zeros(len(words) + 1, dtype=bool)
        first[at] = True
        path = viterbi(scores, first, np.array(lengths, dtype=np.int64))
        states = len(STATES)
        total = np.zeros((len(n), states), dtype=np.float32)
        some = n > 0
        if some.any():
            total[some] = np.add.reduceat(scores, at[some], axis=0)
        votes = np.bincount(np.repeat(np.arange(len(n)) * states, n) + path, minlength=states * len(n)).reshape(-1, states)
        winner = votes.argmax(axis=1)
        rows = np.arange(len(n))
        own, spread = total[rows, winner], np.abs(total[:, : len(LANGUAGES)]).max(axis=1, initial=0.0)
        total[rows, winner] = -np.inf
        margin = own - total.max(axis=1, initial=-np.inf)
        data = (n == 0) | (spread < 0.5 + 0.02 * n)
        conf = np.where(data, 0.0, np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))).astype(np.float64), 4)).tolist()
        shares = np.zeros((len(n), 7))
        if some.any():
            shares[some] = np.add.reduceat(strange, at[some], axis=0, dtype=np.int64) / n[some, None]
        share = shares[:, 5]
        own_words = np.where(winner < 5, shares[rows, np.minimum(winner, 4)], 0.0)
        odd = ((n >= UNKNOWN_WORDS) & (share >= np.where(winner == INDEX["ru"], UNKNOWN_LETTERS, UNKNOWN_SHARE)) & (own_words < FUNCTION_SHARE) & ~data).tolist()
        named = [None if d else STATES[w] for d, w in zip(data.tolist(), winner.tolist())]
        out, k = [], 0
        for spans in units:
            end = k + len(spans)
            if True in odd[k:end]:  # two in a row, or all
                real = [i for i in range(k, end) if named[i] is not None]
                for h, i, j in zip([None, *real], real, [*real[1:], None]):
                    if odd[i] and (len(real) == 1 or h is not None and odd[h] or j is not None and odd[j]):
                        named[i], conf[i] = UNKNOWN, round(float(share[i]), 4)
            out.append([(a, b, x, c) for (a, b), x, c in zip(spans, named[k:end], conf[k:end])])
            k = end
        return out


    def languages_in(self, texts: list[str | None]) -> list[dict[str, float]]:
        """For each text the languages that it contains (see ``contained``), with their confidence.

        A first pass lets the language switch for the price of a switch between sentences wherever one
        may end. Where even so no switch pays, none pays between the sentences that there are, and all
        of them have the one language: sentences are only looked for in the other texts. Texts that visibly
        mix scripts are not tried.
        """
        tokens: list[str] = []
        lengths = []
        for text in texts:
            got = WORD_OR_END.findall(DATA.sub("\n", text) if DATA.search(text) else text) if text and not scripts_mixed(text) else []
            tokens += got
            lengths.append(len(got))
        scores, marks = self.languages.scores(tokens)
        word = ~marks[:, 6]
        opens = np.concatenate([[True], ~word[:-1]])[: len(word)]
        ends = np.concatenate([[0], np.cumsum(word)])
        borders = np.cumsum([0, *lengths])
        n = ends[borders[1:]] - ends[borders[:-1]]
        scores, strange = scores[word], marks[word]
        path = viterbi(scores, opens[word], n)
        at = ends[borders[:-1]]
        some = np.flatnonzero(n >= LEAST_WORDS)
        found: list[dict[str, float] | None] = [None] * len(texts)
        if len(some):
            edges = np.stack([at[some], at[some] + n[some]], axis=1).ravel()
            take = slice(None, -1) if edges[-1] == len(path) else slice(None)
            over = lambda how, x: how.reduceat(x, edges[take], axis=0)[::2]
            one = over(np.minimum, path)
            total, odd = over(np.add, scores), over(np.add, strange[:, 5].astype(np.int64))
            own = total[np.arange(len(some)), one]
            share = np.where(one == INDEX["ru"], UNKNOWN_LETTERS, UNKNOWN_SHARE)
            known = (odd < 2 * UNKNOWN_WORDS * share) & (odd < share * n[some])  # too few for two strange sentences, or for one that is all
            whole = (one == over(np.maximum, path)) & (own >= 0.5 * n[some]) & known
            total[np.arange(len(some)), one] = -np.inf
            sure = np.round(1 / (1 + np.exp(-np.clip((own - total.max(axis=1)) / n[some] * LEAST_WORDS, -30, 30))).astype(np.float64), 4)
            for i in np.flatnonzero(whole).tolist():
                found[some[i]] = {STATES[one[i]]: float(sure[i])}
        rest = [i for i, x in enumerate(found) if x is None]
        for i, sentences in zip(rest, self.label([texts[i] for i in rest])):
            found[i] = contained(sentences)
        return found


def contained(sentences: list[tuple[int, int, str | None, float]]) -> dict[str, float]:
    """Languages in two or more sentences in a row or in all, with their mean confidence; data is passed over."""
    real = [(x, c) for _, _, x, c in sentences if x is not None]
    found: dict[str, list[float]] = {}
    for i, (x, c) in enumerate(real):
        if len(real) == 1 or (i and real[i - 1][0] == x) or (i + 1 < len(real) and real[i + 1][0] == x):
            found.setdefault(x, []).append(c)
    return {x: round(sum(c) / len(c), 4) for x, c in found.items()}


def segments(sentences: list[tuple[int, int, str | None, float]]) -> list[tuple[int, int, str, float]]:
    """Runs of sentences of one language; data joins the run before it."""
    out: list[list] = []
    for a, b, x, c in sentences:
        if x is None:
            if out:
                out[-1][1] = b
        elif out and out[-1][2] == x:
            out[-1][1] = b
            out[-1][3].append(c)
        else:
            out.append([a, b, x, [c]])
    return [(a, b, x, round(sum(c) / len(c), 4)) for a, b, x, c in out]


def labeller_on(documents: DataFrame) -> Labeller:
    """A labeller for ``documents.text``: corpus counts over all documents, the sentence chain and the first word model from a bounded sample."""
    texts = training_texts(documents)
    sentences = fit(texts, counted=counts_on(documents))
    return Labeller(sentences, counted_languages(documents, fit_languages(texts, sentences)))


def items_of(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """item_kind, item_id, text, label of all documents (their title where the text is null or blank) and texts."""
    blank = ~nonempty(F.col("text"))
    docs = documents.select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_id"), F.when(blank, F.col("title")).otherwise(F.col("text")).alias("text"), F.col("lang").alias("label"))
    return docs.unionByName(texts.select(F.lit("text").alias("item_kind"), F.col("text_id").alias("item_id"), "text", F.col("lang").alias("label")))


#: At most so many characters are labelled in one vector pass.
CHUNK_CHARS = 4_000_000


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


SEGMENTS = "item_kind string, item_id string, label string, lang string, lang_confidence double, segment int, start_pos int, end_pos int, segment_lang string, confidence double"
CONTAINED = "item_kind string, item_id string, label string, lang string, confidence double"


def _map(items: DataFrame, labeller: Labeller, schema: str, emit: Callable, label: Callable = Labeller.label) -> DataFrame:
    shared = items.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            texts = batch["text"].tolist()
            heads = list(zip(batch["item_kind"].tolist(), batch["item_id"].tolist(), batch["label"].tolist()))
            for a, b in _chunks(texts):
                each = list(dict.fromkeys(texts[a:b]))  # copies of a text are labelled once
                found = dict(zip(each, label(shared.value, each)))
                rows = [r for head, t in zip(heads[a:b], texts[a:b]) for r in emit(head, found[t])]
                yield pd.DataFrame(rows, columns=names)

    usable = items.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_kind", "item_id", "text", "label")
    return usable.mapInPandas(run, schema)


def language_segments(items: DataFrame, labeller: Labeller) -> DataFrame:
    """One row for each segment of each item, with the item's main language and both confidences.

    The main language has most characters. Items without text or with data only give no row;
    repeated items give repeated rows.
    """

    def emit(head: tuple, sentences: list) -> Iterator[tuple]:
        found = segments(sentences)
        size: Counter[str] = Counter()
        weight: Counter[str] = Counter()
        for a, b, x, c in found:
            size[x] += b - a
            weight[x] += c * (b - a)
        if found:
            main = min(size, key=lambda x: (-size[x], x))
            share = size[main] / sum(size.values())
            for i, (a, b, x, c) in enumerate(found):
                yield (*head, main, round(weight[main] / size[main] * share, 4), i, a, b, x, c)

    return _map(items, labeller, SEGMENTS, emit)


def languages_contained(items: DataFrame, labeller: Labeller) -> DataFrame:
    """One row for each language that an item contains (two sentences in a row, or all), with its confidence."""
    return _map(items, labeller, CONTAINED, lambda head, found: ((*head, x, c) for x, c in found.items()), Labeller.languages_in)


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, without case, region and script; other labels as they are, lower-cased."""
    return F.regexp_extract(F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"^([a-z]{2})(?:[-_].*)?$", 1)


def unnamed_languages(items: DataFrame, labeller: Labeller) -> DataFrame:
    """(item_kind, item_id, lang): each language that an item contains and its label does not name, each once."""
    found = languages_contained(items, labeller)
    return found.where((F.col("lang") != UNKNOWN) & (F.coalesce(named_language(F.col("label")), F.lit("")) != F.col("lang"))).select("item_kind", "item_id", "lang").distinct()
