"""Sentence boundaries across languages and scripts, by a linear-chain model with Viterbi decoding.

Every character of a text is tagged boundary or inside. Only characters behind an end mark, and in
scripts without end marks the blanks, can be boundaries; all others are inside with certainty, so
the chain is decoded over these candidates. A candidate's emission is a linear score of its mark,
the words or letters before it and those behind it; transitions depend on the distance to the last
candidate. A blank line always ends a unit.

The model is trained without labels:

1. Blank lines are certain boundaries. What stands at the start and at the end of paragraphs is
   compared with what stands anywhere in them, with all punctuation stripped; this gives odds that
   need no marks and serve scripts without end marks. These counts cover all texts.
2. With these odds and a prior for each mark a bounded sample of the texts is tagged.
3. A logistic model of richer features and the transitions are fitted to the tagged sample.

A model is fitted where none is given; ``SentenceModel.save`` and ``load`` keep one for other tables.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The chain is fitted on at most so many texts (those with the smallest hashes of their text) ...
TRAIN_TEXTS = 3000
#: ... of at most so many characters each.
TRAIN_CHARS = 20_000
TRAIN_SEED = 17
#: A worker remembers the scores of at most so many kinds of places.
KNOWN_PLACES = 300_000

PARAGRAPH = re.compile(r"\r?\n[^\S\n]*\n\s*")
#: Full stops, question and exclamation marks of other scripts, by the Unicode property Sentence_Terminal.
OTHER_MARKS = "՜՝՞։؝؞؟۔܀܁܂߹࠷࠹࠽࠾।॥၊။።፧፨᙮᜵᜶᠃᠉᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿⸮⸼꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"
MARKS = re.compile(rf"(?:[!?…。！？｡．‥⁇⁈⁉‼{OTHER_MARKS}]|\.(?![a-z0-9]))[.!?…。！？｡．‥⁇⁈⁉‼{OTHER_MARKS}]*")  # a point within a name, number or address is no mark
THAI = re.compile(r"[฀-๿]")
UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿ｦ-ﾟ]")
BLANK = re.compile(r"\s+")
BRACKET = re.compile(r"[“”„«»「」『』()（）\"‘’\[\]【】]")
CLOSER_OF = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "‘": "’", "[": "]", "【": "】"}
CLOSERS = set("”»」』)）]】’")
WORDISH = re.compile(r"[A-Za-z0-9À-ɏ._\-/:@#%&+=?~]+")
DIGITS = re.compile(r"\d+")
LOWER_WORD = re.compile(r"[a-zß-öø-ÿа-яё]+(?![\w.\-])")
#: Lengths of the keys in scripts without blanks.
WIDTHS = (10, 6, 4, 3, 2, 1)
#: Hashes of what stands at a place are first looked up by so many of their bits.
GRAM_BITS = 18
#: So many characters, and what is left of a paragraph, are counted at once.
GRAM_CHARS = 500_000
#: Stripped from what stands before a place, as it is at the ends of paragraphs.
TAIL = ".!?…。！？｡．\"”»」』)）“’;； \t\r\n\u00a0\u202f\u3000"
TAIL_CODES = np.array([ord(c) for c in TAIL], dtype=np.uint32)


class _Norms(dict):
    """Words with digits collapsed and edge punctuation cut; kept while there are few."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        value = "URL" if "://" in word else DIGITS.sub("0", word.strip("“”„«»「」『』()（）\"‘’[]【】,;:、，；："))
        self[word] = value
        return value


NORMS = _Norms()


def _pairs(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Matched quotations and brackets of a paragraph (outermost spans) and the positions of their closers."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in BRACKET.finditer(text, start, end):
        c, i = m.group(), m.start()
        if c == '"':
            if stack and stack[-1][0] == '"':
                spans.append((stack.pop()[1], i))
            elif any(x == '"' for x, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                spans.append((stack.pop()[1], i))
            else:
                stack.append((c, i))
        elif stack and c in CLOSER_OF.get(stack[-1][0], ""):
            spans.append((stack.pop()[1], i))
        elif c in CLOSER_OF:
            if c != "‘" or i == start or not text[i - 1].isalnum() or UNSPACED.match(text[i - 1]) or "가" <= text[i - 1] <= "힣":
                stack.append((c, i))
        elif c != "’" and any(c in CLOSER_OF.get(x, "") for x, _ in stack):
            while c not in CLOSER_OF.get(stack[-1][0], ""):
                stack.pop()
            spans.append((stack.pop()[1], i))
    closers = {j for _, j in spans}
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s in spans:
        if not outer or s[0] > outer[-1][1]:
            outer.append(s)
    return outer, closers


class Candidate:
    """A place where a unit may end: [.., end) and the next may start at nxt."""

    __slots__ = ("end", "nxt", "mark", "left", "quote")

    def __init__(self, end: int, nxt: int, mark: str, left: int, quote: str) -> None:
        self.end = end
        self.nxt = nxt
        self.mark = mark
        self.left = left
        self.quote = quote


def _mark_class(marks: str) -> str:
    c = marks[-1]
    if c in "…‥" or marks.endswith(".."):
        return "…"
    if c in "。｡．！？":
        return "。"
    return "!" if c != "." else "."


def _candidates(text: str, start: int, end: int, spaced: bool = False) -> list[Candidate]:
    """The candidates of a paragraph text[start:end) in order; its own end is none. spaced: all of it is in scripts with blanks."""
    spans, closers = _pairs(text, start, end)
    out: list[Candidate] = []
    k, n = 0, len(spans)
    done = start
    caseless = text[start:end].islower()  # no capital to tell a start by
    for m in MARKS.finditer(text, start, end):
        a, e = m.span()
        if a <= start or a < done:
            continue
        if e < end and text[e].islower() and text[a] < "\x7f":
            continue
        while e < end:
            c = text[e]
            if e in closers or c in CLOSERS:
                e += 1
            elif c in "   " and e + 1 < end and (text[e + 1] == "»" or (e + 1 in closers and text[e + 1] in "»”\"")):
                e += 2
            elif c in ".!?…。！？" and e > m.end():
                e += 1
            else:
                break
        done = e
        while k < n and spans[k][1] < e:
            k += 1
        if k < n and spans[k][0] < e - 1:
            continue  # inside a quotation or bracket
        nxt = e
        while nxt < end and text[nxt].isspace():
            nxt += 1
        if nxt >= end:
            break
        c = text[nxt]
        kind = _mark_class(m.group())
        if nxt == e:
            if kind in ".!" and text[e - 1] not in "“”»」』" and (c.islower() or c.isdigit() or not (c.isalpha() or c in "“„«「『\"¿¡‘(（")):
                continue
            if c in ",;:，、；：·、）)" or ("가" <= c <= "힣" and e > m.end()):
                continue
        elif not caseless and c.islower() and (w := LOWER_WORD.match(text, nxt, min(end, nxt + 24))) and w.end() > nxt:
            continue
        elif c in ",;:，、；：)）":
            continue
        quote = ""
        if k > 0 and spans[k - 1][1] >= a - 1 and spans[k - 1][1] < e and text[spans[k - 1][0]] not in "(（[【":
            o = spans[k - 1][0]
            before = text[max(start, o - 3) : o].rstrip()
            quote = "s" if not before or before[-1] in ".!?…。！？)）" else ":" if before[-1] in ":：" else "o"
            if before and before[-1] in ":：，," and o - start < 30:
                quote += "e"
        out.append(Candidate(e, nxt, kind, a, quote))
    if not spaced and THAI.search(text, start, end):
        taken = {c.nxt for c in out}
        k = 0
        for m in BLANK.finditer(text, start, end):
            a, e = m.span()
            while k < n and spans[k][1] < a:
                k += 1
            if a <= start or e >= end or e in taken or (k < n and spans[k][0] < a):
                continue
            if not (THAI.search(text, max(start, a - 12), a) and THAI.search(text, e, min(end, e + 12)) or THAI.match(text[a - 1]) or THAI.match(text[e])):
                continue
            out.append(Candidate(a, e, " ", a, ""))
        out.sort(key=lambda c: c.end)
    return out


def _left_side(text: str, start: int, at: int, spaced: bool = False) -> tuple[str, str]:
    """Script kind of what ends at ``at``, and as much of it as its keys depend on."""
    piece = text[max(start, at - 28) : at].rstrip(TAIL)
    if not spaced and UNSPACED.search(piece, max(0, len(piece) - 8)):
        s = WORDISH.sub("N", piece)
        return "u", ("^" + s if len(piece) < 6 else s)[-1 - WIDTHS[0] :]
    words = piece.rsplit(None, 2)
    if not words:
        return "w", "^"
    return "w", (NORMS[words[-2].rsplit(None, 1)[-1]] if len(words) > 1 else "^") + " " + NORMS[words[-1]]


def _left_keys(kind: str, side: str) -> list[str]:
    """Keys, long ones first."""
    if kind == "u":
        return [side[-k:] for k in WIDTHS if k < len(side) or k == 1]  # what is all of a paragraph so far says little about its end
    if side == "^":
        return ["^", "^", "^"]
    last = side.split(" ", 1)[1]
    return [side, last, "~" + last[-2:]]


def _right_side(text: str, at: int, end: int, spaced: bool = False) -> tuple[str, str]:
    piece = text[at : min(end, at + 28)]
    if not spaced and UNSPACED.search(piece, 0, 12):
        return "u", WORDISH.sub("N", piece.replace("\n", " "))[: WIDTHS[0]]
    words = piece.split(None, 2)
    return "w", (NORMS[words[0]] if words else "$") + " " + (NORMS[words[1]] if len(words) > 1 else "$")


def _right_keys(kind: str, side: str) -> list[str]:
    if kind == "u":
        return [side[:k] for k in WIDTHS]
    first = side.split(" ", 1)[0]
    return [side, first, _shape(first)]


def _left(text: str, start: int, at: int) -> tuple[str, list[str]]:
    """Script kind and keys, long ones first, of what ends at ``at``."""
    kind, side = _left_side(text, start, at)
    return kind, _left_keys(kind, side)


def _right(text: str, at: int, end: int) -> tuple[str, list[str]]:
    kind, side = _right_side(text, at, end)
    return kind, _right_keys(kind, side)


def _tail(word: str) -> str:
    """Shape of the word before a mark: an initial, a number, a short word or another."""
    if len(word) == 1:
        return "1" if word.isupper() else "0" if word == "0" else "l"
    return "n" if word[-1:] == "0" else "s" if len(word) < 5 else "w"


def _shape(word: str) -> str:
    if not word:
        return "~"
    c = word[0]
    if c.isupper():
        return "~X" if len(word) > 1 else "~x1"
    return "~x" if c.islower() else "~0" if c == "0" else "~h" if c.isalpha() else "~" + c


def _space(text: str, c: Candidate) -> str:
    return "0" if c.nxt == c.end else "n" if "\n" in text[c.end : c.nxt] else " "


def _features(c: Candidate, space: str, lk: str, left: list[str], rk: str, right: list[str]) -> list[str]:
    """Keys of what is seen at a candidate; they depend on the mark, the space, the quotation and the longest keys of either side."""
    mark = c.mark
    out = [f"m{mark}{space}", f"q{c.quote}{mark}", f"P{mark}{_tail(left[1]) if lk == 'w' else 'u'}{_shape(right[1]) if rk == 'w' else 'u'}"]
    out += [f"L{lk}{x}" for x in left]
    q = c.quote[:1]  # what follows a quotation is another matter than what follows a mark
    out += [f"R{q}{rk}{x}" for x in right]
    out.append(f"M{q}{mark}{right[-1]}")
    out.append(f"K{mark}{left[1] if lk == 'w' else left[0][-2:]}")
    if c.quote:
        out.append(f"Q{c.quote}{right[-1] if rk == 'w' else right[3]}")
    return out


def _gap(n: int) -> int:
    return 0 if n < 4 else 1 if n < 9 else 2 if n < 20 else 3 if n < 50 else 4


class SentenceModel:
    """Weights of the chain; ``units`` splits a text."""

    def __init__(self, weights: dict[str, float], transitions: dict[tuple[int, int], float]) -> None:
        self.weights, self.transitions = weights, transitions
        gaps = {g for _, g in transitions}
        apart = max([abs(transitions.get((1, g), 0.0) - transitions.get((0, g), 0.0)) for g in gaps], default=0.0)
        #: Beyond this score no neighbour can change a tag.
        self.sure = max([abs(t) for t in transitions.values()], default=0.0) + apart
        self._known: dict[tuple, float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}

    def save(self, path: str) -> None:
        """Write the model as JSON."""
        with open(path, "w", encoding="utf-8") as out:
            json.dump({"weights": self.weights, "transitions": [[*k, v] for k, v in self.transitions.items()]}, out, ensure_ascii=False)

    @staticmethod
    def load(path: str) -> "SentenceModel":
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        return SentenceModel(read["weights"], {(t, g): v for t, g, v in read["transitions"]})

    def _score(self, text: str, start: int, end: int, c: Candidate, spaced: bool) -> float:
        left, right = _left_side(text, start, c.left, spaced), _right_side(text, c.nxt, end, spaced)
        space = _space(text, c)
        key = (c.mark, space, c.quote, left, right)
        score = self._known.get(key)
        if score is None:
            if len(self._known) > KNOWN_PLACES:
                self._known.clear()
            get = self.weights.get
            score = self._known[key] = sum([get(f, 0.0) for f in _features(c, space, left[0], _left_keys(*left), right[0], _right_keys(*right))])
        return score

    def cuts(self, text: str, start: int, end: int) -> list[Candidate]:
        """The candidates of a paragraph that end a unit: Viterbi over the tags inside (0) and boundary (1)."""
        spaced = not UNSPACED.search(text, start, end)
        found = _candidates(text, start, end, spaced)
        if not found:
            return found
        scores = [self._score(text, start, end, c, spaced) for c in found]
        if min(map(abs, scores)) > self.sure:  # the best sequence takes each tag by its own score
            return [c for c, s in zip(found, scores) if s > 0]
        return decode(found, scores, start, self.transitions)

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """[start, end) of each sentence of ``text``; none for null or blank texts."""
        out: list[tuple[int, int]] = []
        if not text:
            return out
        at, n = 0, len(text)
        breaks = [m.span() for m in PARAGRAPH.finditer(text)] + [(n, n)]
        for stop, nxt in breaks:
            while at < stop and text[at].isspace():
                at += 1
            end = stop
            while end > at and text[end - 1].isspace():
                end -= 1
            if end > at:
                begin = at
                for c in self.cuts(text, at, end):
                    out.append((begin, c.end))
                    begin = c.nxt
                out.append((begin, end))
            at = nxt
        return out


def decode(found: list[Candidate], scores: list[float], start: int, transitions: dict[tuple[int, int], float]) -> list[Candidate]:
    """Viterbi: the best tag sequence; transitions: (tag before, gap class) -> score of a boundary."""
    inside, bound = 0.0, -math.inf
    back: list[tuple[int, int]] = []
    last = start
    get = transitions.get
    for c, s in zip(found, scores):
        g = _gap(c.end - last)
        last = c.nxt
        from0, from1 = inside + s + get((0, g), 0.0), bound + s + get((1, g), 0.0)
        stay = 0 if inside >= bound else 1
        back.append((stay, 0 if from0 >= from1 else 1))
        inside, bound = max(inside, bound), max(from0, from1)
    tag = 0 if inside >= bound else 1
    out = []
    for c, b in zip(reversed(found), reversed(back)):
        if tag:
            out.append(c)
        tag = b[tag]
    return out[::-1]


#: Prior score of a boundary behind each class of mark, before anything is learnt.
PRIOR = {".": 0.5, "!": 2.5, "。": 3.0, "…": -0.5, " ": -1.0}


def _grams(text: str | np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A 64-bit hash of the k characters from each place on, for every k up to the longest of WIDTHS; the last k - 1 places have none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") if isinstance(text, str) else text
    code = code.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(code), dtype=np.uint64)
    for k in range(1, min(WIDTHS[0], len(code)) + 1):
        out = (out[: len(code) - k + 1] + code[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        yield k, out


class EdgeCounts:
    """How often each needed key stands at an edge of a paragraph, and anywhere.

    A key is "S" or "E" (start or end), "w" or "u" (spaced or unspaced script), and what stands there;
    the key without a third part counts all places. Only the keys that a sample asks for are counted.
    """

    def __init__(self, needed: Iterable[str]) -> None:
        self.keys = sorted(needed)
        self.index = {k: i for i, k in enumerate(self.keys)}
        self.edge, self.any = np.zeros(len(self.keys) + 1, dtype=np.int64), np.zeros(len(self.keys) + 1, dtype=np.int64)  # the last place takes what is not needed
        self.heads: dict[str, int] = {}
        self.seconds: dict[str, dict[str, int]] = {"S": {}, "E": {}}
        pairs: dict[str, list[tuple[int, int, int]]] = {"S": [], "E": []}
        grams: dict[int, dict[int, dict[str, int]]] = {}
        for k, i in self.index.items():
            side, kind, what = k[0], k[1], k[2:]
            if kind == "w" and " " in what:
                head, second = what.split(" ", 1)
                pairs[side].append((self.heads.setdefault(head, len(self.heads)), self.seconds[side].setdefault(second, len(self.seconds[side])), i))
            elif kind == "u" and what:
                if len(what) in WIDTHS:
                    grams.setdefault(len(what), {}).setdefault(int([*_grams(what)][-1][1][0]), {})[side] = i
        self.pairs = {}
        for side, rows in pairs.items():
            code = np.array([h * max(1, len(self.seconds[side])) + x for h, x, _ in rows], dtype=np.int64)
            order = np.argsort(code)
            self.pairs[side] = code[order], np.array([i for _, _, i in rows], dtype=np.int64)[order]
        #: By width: the hashes in order, whether one with the same first GRAM_BITS bits is needed, and the numbers of the keys of either side.
        self.grams = {}
        for k, rows in grams.items():
            code = np.array(sorted(rows), dtype=np.uint64)
            maybe = np.zeros(1 << GRAM_BITS, dtype=bool)
            maybe[code >> np.uint64(64 - GRAM_BITS)] = True
            self.grams[k] = code, maybe, {side: np.array([rows[h].get(side, len(self.keys)) for h in code.tolist()], dtype=np.int64) for side in "SE"}
        self._clear()

    def _clear(self) -> None:
        self._rows: dict[str, int] = {}
        self._new: list[tuple[int, ...]] = []
        self._ids = np.zeros((0, 7), dtype=np.int64)

    def _row(self, word: str) -> tuple[int, ...]:
        """Where the counts of a word as written go: first, shape, last, tail; its number as head of pairs and as second of either side."""
        first, last = NORMS[word], NORMS[word.rstrip(TAIL)]
        at, none = self.index.get, len(self.keys)
        return (at("Sw" + first, none), at("Sw" + _shape(first), none), at("Ew" + last, none), at("Ew~" + last[-2:], none), self.heads.get(first, -1), self.seconds["S"].get(first, -1), self.seconds["E"].get(last, -1))

    def _put(self, prefix: str, keys: Iterable[str]) -> None:
        get, held = self.index.get, self._held
        for key in dict.fromkeys(keys):
            if (i := get(prefix + key)) is not None:
                held.append(i)
        if (i := get(prefix)) is not None:
            held.append(i)

    def add(self, texts: Iterable[str]) -> None:
        """Count all places of ``texts``."""
        words: list[str] = []
        sizes: list[int] = []
        plain: list[str] = []
        self._held: list[int] = []
        for text in texts:
            for a, b in _paragraphs(text):
                bare = b
                while bare > a and (text[bare - 1] in TAIL or text[bare - 1].isspace()):
                    bare -= 1
                if bare - a < 12:
                    continue
                kind, keys = _right(text, a, b)
                self._put("S" + kind, keys)
                kind, keys = _left(text, a, bare)
                self._put("E" + kind, keys)
                part = text[a:b]
                if UNSPACED.search(part):
                    plain.append(WORDISH.sub("N", part.replace("\n", " ")))
                else:
                    found = part.split()
                    words += found
                    sizes.append(len(found))
        self.edge += np.bincount(np.array(self._held, dtype=np.int64), minlength=len(self.edge))
        if words:
            self._add_words(words, sizes)
        some: list[str] = []
        size = 0
        for part in plain:
            some.append(part)
            if (size := size + len(part)) > GRAM_CHARS:
                self._add_grams(some)
                some, size = [], 0
        if some:
            self._add_grams(some)

    def _add_words(self, words: list[str], sizes: list[int]) -> None:
        if len(self._rows) > 400_000:
            self._clear()
        rows, new = self._rows, self._new
        for w in {*words}.difference(rows):
            rows[w] = len(rows)
            new.append(self._row(w))
        if new:
            self._ids = np.concatenate([self._ids, np.array(new, dtype=np.int64)])
            self._new = []
        at = np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))
        often = np.bincount(at, minlength=len(self._ids))
        for column in range(4):
            self.any += np.bincount(self._ids[:, column], weights=often, minlength=len(self.any)).astype(np.int64)
        for side in "SE":
            if (i := self.index.get(side + "w")) is not None:
                self.any[i] += len(words)
        inner = np.ones(len(words), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False  # the last word of a paragraph heads no pair
        inner = np.flatnonzero(inner[:-1])
        head = self._ids[:, 4][at[inner]]
        inner, head = inner[head >= 0], head[head >= 0]
        for side, column in (("S", 5), ("E", 6)):
            second = self._ids[:, column][at[inner + 1]]
            both = second >= 0
            code, place = self.pairs[side]
            self._add_found(head[both] * max(1, len(self.seconds[side])) + second[both], code, place)

    def _add_found(self, seen: np.ndarray, code: np.ndarray, place: np.ndarray) -> None:
        if len(code) and len(seen):
            k = np.minimum(np.searchsorted(code, seen), len(code) - 1)
            self.any += np.bincount(place[k[code[k] == seen]], minlength=len(self.any))

    def _add_grams(self, plain: list[str]) -> None:
        """Every place within unspaced paragraphs counts once, from the first character to the last one, which closes; beside Thai letters every blank."""
        gap = "\0" * WIDTHS[0]
        joined = gap + gap.join(plain) + gap
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        within = np.zeros(len(code), dtype=bool)
        at = len(gap)
        for text in plain:
            within[at + 1 : at + len(text) - 1] = True
            at += len(text) + len(gap)
        thai = (code >= 0x0E00) & (code <= 0x0E7F)
        blank = np.isin(code, [32, 9, 10, 13, 160, 0x3000])
        beside, behind = thai.copy(), np.zeros(len(code), dtype=bool)
        beside[1:] |= thai[:-1]
        behind[1:] = blank[:-1] & ~blank[1:]
        within &= ~beside
        starts = within | (beside & behind)
        closes = np.flatnonzero(~blank[:-1] & blank[1:] & (code[:-1] != 0)) + 1
        solid = ~np.isin(code, TAIL_CODES)
        before = np.maximum.accumulate(np.where(solid, np.arange(len(code)) + 1, 0))[closes - 1]
        ends = within + np.bincount(before[beside[before]], minlength=len(code))
        for side, places in (("S", starts), ("E", ends)):
            if (i := self.index.get(side + "u")) is not None:
                self.any[i] += int(places.sum())
        for k, seen in _grams(code):
            if k not in self.grams:
                continue
            wanted, maybe, places = self.grams[k]
            first = np.flatnonzero(maybe[seen >> np.uint64(64 - GRAM_BITS)])
            at = np.minimum(np.searchsorted(wanted, seen[first]), len(wanted) - 1)
            same = wanted[at] == seen[first]
            first, at = first[same], at[same]
            for side, weights in (("S", starts[first]), ("E", ends[np.minimum(first + k, len(code) - 1)])):
                self.any += np.bincount(places[side][at], weights=weights, minlength=len(self.any)).astype(np.int64)

    def score(self, side: str, kind: str, keys: list[str]) -> float:
        """Log odds of an edge where ``keys``, the longest first, stand; with back-off to shorter keys."""
        prefix = side + kind
        exact = 2 if kind == "u" else 1
        for i, key in enumerate(keys):
            if (at := self.index.get(prefix + key)) is None:
                continue
            e, a = int(self.edge[at]), int(self.any[at])
            if e + a >= 4:
                base = self.edge[self.index[prefix]] / max(1, self.any[self.index[prefix]])
                if not e and i < exact and a >= 24:  # a fifth of all sentences stand at an edge; a phrase that begins or ends sentences would have been seen there
                    return -min(4.0, 0.12 * a)
                if not e and base * a < 1.0:  # a word that stands in other places too is too rare to be missed at the edges
                    continue
                return max(-4.0, min(3.0, math.log((e + 0.3) / (base * a + 0.3))))
        return -0.5


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    at, n = 0, len(text)
    for stop, nxt in [m.span() for m in PARAGRAPH.finditer(text)] + [(n, n)]:
        while at < stop and text[at].isspace():
            at += 1
        end = stop
        while end > at and text[end - 1].isspace():
            end -= 1
        if end > at:
            yield at, end
        at = nxt


class _Place:
    """A candidate of the sample with what stands at its sides."""

    __slots__ = ("c", "lk", "left", "rk", "right", "space")

    def __init__(self, text: str, a: int, b: int, c: Candidate) -> None:
        self.c, self.space = c, _space(text, c)
        self.lk, self.left = _left(text, a, c.left)
        self.rk, self.right = _right(text, c.nxt, b)


def _places(texts: list[str]) -> list[tuple[int, list[_Place]]]:
    """(start, candidates) of each paragraph that has candidates."""
    out = []
    for text in texts:
        for a, b in _paragraphs(text):
            if found := _candidates(text, a, b):
                out.append((a, [_Place(text, a, b, c) for c in found]))
    return out


def keys_of(places: list[tuple[int, list[_Place]]]) -> frozenset[str]:
    """The keys whose counts the tagging of a sample asks for."""
    found = {"Sw", "Su", "Ew", "Eu"}
    for _, here in places:
        for p in here:
            found.update(["E" + p.lk + k for k in p.left])
            found.update(["S" + p.rk + k for k in p.right])
    return frozenset(found)


def fit(texts: Iterable[str], epochs: int = 6, counted: Callable[[frozenset[str]], EdgeCounts] | None = None) -> SentenceModel:
    """A model fitted on ``texts`` without labels (see the module's docstring); deterministic for the same texts in the same order.

    counted: gives the counts of all texts for the keys that these texts ask for; without it these
    texts are all there are.
    """
    texts = [t for t in dict.fromkeys(texts) if t and t.strip()]
    sample = _places(texts)
    if counted is None:
        odds = EdgeCounts(keys_of(sample))
        odds.add(texts)
    else:
        odds = counted(keys_of(sample))
    data: list[tuple[list[str], int]] = []
    gaps: Counter[tuple[int, int, int]] = Counter()
    first_trans = {(t, 0): -2.5 for t in (0, 1)} | {(t, 1): -1.0 for t in (0, 1)}
    for a, here in sample:
        scores = []
        for p in here:
            c, left, right = p.c, p.left, p.right
            z = PRIOR[c.mark] + odds.score("E", p.lk, left) + odds.score("S", p.rk, right)
            if c.quote[:1] == "s":
                z -= 3.0
            if c.mark == "." and p.lk == "w" and (len(left[1]) == 1 and left[1].isupper() or left[1][-1:] == "0" and right[1] == "0."):
                z -= 3.0  # an initial, or a number between numbers
            if c.mark == "." and c.end - a < 6:
                z -= 3.0  # a short first word
            scores.append(z)
        chosen = {id(c) for c in decode([p.c for p in here], scores, a, first_trans)}
        last, tag = a, 1
        for p in here:
            c = p.c
            y = int(id(c) in chosen)
            data.append((_features(c, p.space, p.lk, p.left, p.rk, p.right), y))
            gaps[tag, _gap(c.end - last), y] += 1
            last, tag = c.nxt, y
    seen: Counter[str] = Counter()
    for features, _ in data:
        seen.update(features)
    names = [f for f, n in seen.items() if n > 1]  # what was seen once says nothing
    number = {f: i for i, f in enumerate(names)}
    rows = [([number[f] for f in features if f in number], y) for features, y in data]
    weights = [0.0] * len(names)
    total = np.zeros(len(names))
    rounds = 0
    order = list(range(len(rows)))
    state = TRAIN_SEED
    exp = math.exp
    for epoch in range(epochs):
        for i in range(len(order) - 1, 0, -1):
            state = (state * 1103515245 + 12345) % 2147483648
            j = state % (i + 1)
            order[i], order[j] = order[j], order[i]
        rate = 0.15 / (1 + epoch)
        for i in order:
            features, y = rows[i]
            z = 0.0
            for f in features:
                z += weights[f]
            delta = rate * (y - 1 / (1 + exp(-max(-30.0, min(30.0, z)))))
            if delta > 1e-4 or delta < -1e-4:
                for f in features:
                    weights[f] += delta
        if epoch >= epochs // 2:
            rounds += 1
            total += weights
    kept = {f: w / rounds for f, w in zip(names, total.tolist()) if abs(w) > 0.01 * rounds} if rounds else {}
    n1, n0 = sum(v for (_, _, y), v in gaps.items() if y), sum(v for (_, _, y), v in gaps.items() if not y)
    transitions = {}
    for tag in (0, 1):
        for g in range(5):
            up, down = gaps[tag, g, 1] + 1.0, gaps[tag, g, 0] + 1.0
            transitions[tag, g] = max(-2.0, min(1.0, 0.5 * math.log(up / down * (n0 + 1) / (n1 + 1))))
    return SentenceModel(kept, transitions)


def training_texts(df: DataFrame, text: str = "text", bound: int = TRAIN_TEXTS) -> list[str]:
    """About ``bound`` distinct texts at most, of at most TRAIN_CHARS characters each: those with the smallest hashes.

    This sample is all that comes to the driver. A first cut by hash leaves about twice as many texts
    as are wanted, whatever the size of the table, before the smallest are taken. Copies of a text
    count once, in the cut as in the bound.
    """
    short = df.where(F.length(F.trim(text)).between(1, TRAIN_CHARS)).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    total = short.select("h").distinct().count()
    share = min(1.0, 2.0 * bound / max(1, total))
    chosen = short.where(F.pmod(F.xxhash64(F.lit(TRAIN_SEED), "h"), F.lit(1_000_000)) < int(1_000_000 * share))
    return [r.t for r in chosen.distinct().orderBy("h", "t").limit(bound).collect()]


def counts_on(df: DataFrame, text: str = "text") -> Callable[[frozenset[str]], EdgeCounts]:
    """Counts over all texts of ``df`` for given keys: one pass with partial sums, of which a row for each key is shuffled."""

    def counted(needed: frozenset[str]) -> EdgeCounts:
        out = EdgeCounts(needed)
        shared = df.sparkSession.sparkContext.broadcast(out.keys)  # the keys of the bounded sample

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = EdgeCounts(shared.value)
            for batch in batches:
                counts.add(batch["t"].tolist())
            at = np.flatnonzero((counts.edge[:-1] > 0) | (counts.any[:-1] > 0))
            yield pd.DataFrame({"k": at, "e": counts.edge[at], "a": counts.any[at]})

        rows = df.where(F.length(text) > 0).select(F.col(text).alias("t")).mapInPandas(run, "k bigint, e bigint, a bigint")
        found = rows.groupBy("k").agg(F.sum("e").alias("e"), F.sum("a").alias("a")).toPandas()  # not more than the needed keys
        at = found["k"].to_numpy(dtype=np.int64)
        out.edge[at], out.any[at] = found["e"].to_numpy(dtype=np.int64), found["a"].to_numpy(dtype=np.int64)
        return out

    return counted


def fit_on(df: DataFrame, text: str = "text") -> SentenceModel:
    """A model for ``df``: odds from all its texts, the chain from a bounded sample."""
    return fit(training_texts(df, text), counted=counts_on(df, text))


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text", model: SentenceModel | None = None) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence of every text; positions count code points.

    Null, empty and blank texts give no sentence; a text without any mark gives one for each
    paragraph; repeated rows give repeated sentences; other columns are ignored. The model is fitted
    on ``df`` unless given (``fit_on``). One narrow pass: no shuffle.
    """
    model = model or fit_on(df, text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = shared.value.units
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(batch["k"].tolist(), batch["t"].tolist()):
                if t:
                    for a, b in units(t):
                        keys.append(k)
                        starts.append(a)
                        ends.append(b)
            yield pd.DataFrame({key: pd.Series(keys, dtype=object if kind == "string" else "int64"), "start_pos": pd.Series(starts, dtype="int64"), "end_pos": pd.Series(ends, dtype="int64")})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.length("t") > 0))
    return rows.mapInPandas(run, f"`{key}` {kind}, start_pos bigint, end_pos bigint")
