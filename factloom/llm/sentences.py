"""Sentence boundaries by a hidden-event n-gram model.

Between two words there may stand a hidden boundary event. The model holds, for each word (with the mark behind it), how often the
event follows, how words are distributed behind an event, and how they follow each other without one; rare words back off to
their shape. For each text the forward-backward algorithm gives the posterior of the event at every place where it may stand, with
a transition that makes very short sentences unlikely; a posterior of a half or more is a boundary.

Places are blanks and line breaks behind an end mark, end marks without a blank before a capital, line breaks without a mark, and
every blank in scripts that do not mark sentences; between other words the event has no chance. Only blank lines, list and table
lines and turn markers settle a place. Punctuation speaks for or against the event, by WEIGHT in log odds, and the words at both
sides decide with it: a small letter, a comma or speech that goes on speaks against, an exclamation or question mark before
a capital and the end marks of scripts with full-width marks or a danda speak for; within quotations and brackets there is no place.

The model is fitted on all documents by expectation-maximisation from the places that are settled or spoken for. Places are found once and written as
numbers; every round is a pass over them. Words are hashed into tables of fixed size, so that the counts of all partitions meet in a
tree and the model is no larger for a larger corpus; what counts is rates, which the size of the corpus doesn't move.

In scripts without blanks between words, a word's last or first five letters stand for it. Null, empty and blank texts have no
sentence. Texts are read whole, in time that is linear but for a sort.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.session import spread, written

ROUNDS = 3

# Abbreviations, with how sure it is that no sentence ends there before a capital.
ABBREVIATIONS = "dr mr mrs ms prof st mt sr jr vs no nr p pp vol sec art abs fig figs approx incl cf al e.g i.e z.b d.h bzw ca vgl usw fr hr hrn bros gen col capt rev hon ph.d messrs sra srta dña pág págs p.ej núm ee uu m mm mme mlle env c.-à-d t г т ул д кв стр рис им проф руб коп мм т.е т.д म मि डॉ श्री د".split()
_ABBREVIATED = set(ABBREVIATIONS)
#: What is settled, what is open, and what punctuation speaks for or against, with how much (in log odds).
YES, NO, MAYBE, LIKELY, UNLIKELY = 1, 0, 2, 3, 4
WEIGHT = 6.0

_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x85  ])"
_PARAGRAPH = re.compile(rf"{_BREAK}[^\S\n\r\x0b\x0c\x85  ]*(?:{_BREAK}\s*)+")
_LINE = re.compile(_BREAK)
_TURN = re.compile(r"\[\d+\]\s*\w+\s*:")
_ITEM = re.compile(r"(?:[*\-•‣◦·–—+>#]+[ \t]|\||\d{1,3}[.)][ \t]|[a-z][.)][ \t]|[\[{][\"'{\[]|<[|/\w]|\[[A-Z]{2,}\])")
_MARKS = ".!?…。！？｡．؟।॥۔"
_SURE = set("。！？｡．।॥")
_CLOSERS = "\"'”’»)\\]）」』】〉》›}“‘"
_EMOJI = "[\U0001f000-\U0001faff☀-➿⬀-⯿⌚-⏿](?:[︎️‍\U0001f3fb-\U0001f3ff]|\U0001f000-\U0001faff|(?<=‍)[\U0001f000-\U0001faff☀-➿])*"
_END = re.compile(rf"[{_MARKS}]+(?:[{_CLOSERS}]|[{_MARKS}])*(?:[^\S\n\r]*(?:{_EMOJI})+)*")
# Verbs of saying, behind who said it.
_SPEECH = re.compile(r"(?:I|he|she|they|we|[A-Z]\w+(?: [A-Z]\w+)?) (?:said|says|asked|asks|replied|answered|whispered|called|cried|shouted|thought|told|wrote|added|explained|laughed|muttered)\b", re.I)
_CJK = r"぀-ヿ㐀-鿿豈-﫿"
_CJK1 = re.compile(rf"[{_CJK}]")
_THAI = re.compile(r"[฀-໿ក-៿က-႟]")
_BLANK = re.compile(r"\s+")
_PUNCT = r"\s.,;:!?…。，、；：！？؟؛،।()\[\]{}（）「」『』\"“”„«»<>|"
_WORD = re.compile(rf"[^{_PUNCT}]+(?:\.[^{_PUNCT}]+)*")
_MID = re.compile(rf"[^\s{_MARKS}{_CLOSERS}:—–-] ([^{_PUNCT}]+)")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "‚": "‘’"}
_QUOTES = re.compile("[()\\[\\]{}（）「」『』《》〈〉【】“”„«»‹›‘’‚\"']")


def _quoted(text: str) -> list[tuple[int, int]]:
    """The places of pairs of quotation marks and brackets within one paragraph."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in _QUOTES.finditer(text):
        c, i = m[0], m.start()
        if c == "'" or c == "’":
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if before.isalnum() and after.isalnum():
                continue
            if c == "'" and (not before or before.isspace() or before in "([“\"") and after.isalnum():
                stack.append((c, i))
                continue
        close = next((k for k in range(len(stack) - 1, -1, -1) if c in (_PAIRS.get(stack[k][0]) or stack[k][0])), None)
        if close is not None and not (c in "\"" and text[i - 1 : i].isspace() and text[i + 1 : i + 2].isalnum()):
            out.append((stack[close][1], i))
            del stack[close:]
        elif c in _PAIRS or c == '"':
            stack.append((c, i))
    return out


def _shape(w: str) -> str:
    if not w:
        return "<>"
    c = w[0]
    if c.isdigit():
        return "<n>"
    if c.isupper():
        return "<A>" if len(w) == 1 else "<Aa>" if len(w) < 4 else "<Aaa>"
    if c.islower():
        return "<a>" if len(w) == 1 else "<aa>" if len(w) < 4 else "<aaa>"
    return "<x>" if c.isalpha() else f"<{c}>"


_STOPS = {c for c in map(chr, range(0x3001)) if c.isspace()} | set(".,;:!?…。，、；：！？؟؛،।()[]{}（）「」『』\"“”„«»<>|")


def _before(p: str, end: int) -> str:
    """The word that ends at a place, dots within it included, or the sign there."""
    i = end
    while i and p[i - 1] not in _STOPS or 1 < i < end and p[i - 1] == "." and p[i - 2] not in _STOPS:
        i -= 1
    return p[i:end] if i < end else p[end - 1 : end]


@functools.lru_cache(1 << 16)
def _left(w: str, mark: str) -> tuple[str, str]:
    """A word before a place and its shape, each with the mark between."""
    if w[:1].isdigit():
        return f"<n{min(len(w), 4) if w.isdigit() else '.'}>|{mark}", f"<n>|{mark}"
    low = w.lower()
    return f"{w[-5:] if _THAI.search(w) else low}|{mark}", f"{'<abbr>' if low in _ABBREVIATED or len(w) == 1 and w.isalpha() else _shape(w)}|{mark}"


def _right(p: str, at: int) -> tuple[str, str]:
    """The word at a place, and its shape."""
    c = p[at : at + 1]
    if c in "¡¿":
        return _begin(c + "A")
    m = None if c in "—–-" else _WORD.match(p, at)
    if m or _THAI.search(p, at, at + 3):
        return _begin(m[0] if m else c)
    inner = _LETTER.search(p, at, at + 4)
    return _begin(c + ("A" if inner and (inner[0].isupper() or inner[0].isdigit()) else "a"))


_LETTER = re.compile(r"\w")
_TRAIL = re.compile(rf"[{_MARKS}]+[{_CLOSERS}]*$")
_START = re.compile(r"[^\W\d_]{2,}(?:[\s,;:!?’']|\.[\s.])|[^\W\d_]\s")
_ADDRESS = re.compile(r"[@/]\S*$")
_HAN = re.compile(rf"[{_CJK}]")
_INITIAL, _DOTTED, _DASHED, _NO_DOT = re.compile(r"(?<![\w.])[^\W\d_]$"), re.compile(r"[^\W\d_]\.(?=\s)"), re.compile(r"[—–-]\S"), re.compile(r"[ऀ-ॿ฀-໿]$")


@functools.lru_cache(1 << 16)
def _begin(w: str) -> tuple[str, str]:
    """A word by the group of its script; in scripts without blanks between words, its first letters."""
    thai = bool(_THAI.match(w))
    g = "t:" if thai else "o:"
    if w[:1].isdigit():
        return g + "<n>", g + "<n>"
    return g + (w[:5] if thai or _CJK1.match(w) else w), g + _shape(w)


class _Pairs:
    """Pairs of quotation marks and brackets: what lies within one."""

    def __init__(self, pairs: list[tuple[int, int]]):
        pairs = sorted(pairs)
        self.opens, self.closes = [x for x, _ in pairs], sorted(y for _, y in pairs)
        self.reach = list(accumulate((y for _, y in pairs), max))  # how far the pairs that open up to here go
        self.closing = set(self.closes)

    def inside(self, k: int) -> bool:
        i = bisect.bisect_right(self.opens, k)
        return i > 0 and self.reach[i - 1] > k

    def around(self, a: int, e: int) -> bool:
        """Whether a pair opens before a and closes at e or later."""
        i = bisect.bisect_left(self.opens, a)
        return i > 0 and self.reach[i - 1] >= e

    def closed(self, a: int, e: int) -> bool:
        """Whether one closes from a up to before e."""
        i = bisect.bisect_left(self.closes, a)
        return i < len(self.closes) and self.closes[i] < e


def places(text: str) -> list[tuple[int, int, int, tuple[str, str], tuple[str, str], int]]:
    """start of the place (where a sentence may end), where the next would begin, YES/NO/MAYBE, left, right, words before."""
    out = []
    paragraphs, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        paragraphs.append((at, m.start(), m.end()))
        at = m.end()
    paragraphs.append((at, len(text), len(text)))
    for lo, hi, nxt in paragraphs:
        p = text[lo:hi]
        n = len(p)
        thai = bool(_THAI.search(p))
        pairs = _Pairs(_quoted(p))
        starts = [m.end() for m in _LINE.finditer(p)]
        own = [bool(_ITEM.match(p, s)) and not _TURN.match(p, s) for s in [0, *starts]] if starts else []
        seen: dict[int, tuple] = {}

        def put(end: int, begin: int, what: int, mark: str, word_end: int, p=p, seen=seen) -> None:
            seen[begin] = (end, begin, what, _left(_before(p, word_end), mark), _right(p, begin))

        # Line breaks.
        for k, s in enumerate(starts):
            end, begin = s, s
            while end and p[end - 1].isspace():
                end -= 1
            while begin < n and p[begin].isspace():
                begin += 1
            if begin >= n or end == 0:
                continue
            if _TURN.match(p, begin) or own[k] or own[k + 1]:
                put(end, begin, YES, "¶", end)
            elif (not pairs.inside(end - 1) or not pairs.inside(begin)) and not _TRAIL.search(p, max(0, end - 12), end):
                t, c = p[end - 1], p[begin]
                t_thai, c_thai = bool(_THAI.match(t)), bool(_THAI.match(c))
                what = LIKELY if t_thai else UNLIKELY if c.islower() or t in ",;:-–—" else MAYBE
                if t.isalnum() and not t_thai and c_thai:
                    what = MAYBE
                put(end, begin, what, " " if t_thai or c_thai else "\n", end)
        # End marks.
        for m in _END.finditer(p):
            a, e = m.span()
            if e >= n:
                continue
            b = e
            while b < n and p[b].isspace():
                b += 1
            if b >= n or b in seen and seen[b][2] == YES:
                continue
            # Closers that open the next quotation belong to it.
            while e - 1 > a and e == b and p[e - 1] in "\"'“‘" and e - 1 not in pairs.closing:
                e -= 1
                b = e
            shuts = e - 1 in pairs.closing
            if pairs.inside(e - 1) and not shuts or pairs.inside(e) and pairs.around(a, e):
                if not (e > a + 1 and shuts) or pairs.around(a, e):
                    continue
            core = m[0].strip(_CLOSERS.replace("\\", ""))
            head = core[:1]
            closed = pairs.closed(a, e)
            c = p[b]
            sure = not _SURE.isdisjoint(core)
            dots = "…" if core.startswith(("..", "…")) else "." if head in ".۔" else head
            dots += "”" * closed
            if b - e > 1 and ("\n" in p[e:b] or "\r" in p[e:b]) or p[e] in "\n\r":
                dots = "↵" + dots
            if b == e:
                if sure or head in "!?…！？" and (_HAN.match(c) or _HAN.match(p[a - 1 : a])):
                    if not (closed or c in "，、；：,;:）」』”)"):
                        put(e, b, LIKELY, dots, a)
                elif head in ".!?" and c.isupper() and (p[a - 1 : a].isalnum() or p[a - 1 : a] in ")”\"") and _START.match(p, b) and not _ADDRESS.search(p, max(0, a - 30), a):
                    put(e, b, MAYBE if head == "." or not p[max(0, a - 3) : a].islower() else LIKELY, ".", a)
                elif head in ".!?" and c in "“„«¿¡([" and p[a - 1 : a].islower():
                    put(e, b, MAYBE if head == "." else LIKELY, ".", a)
                continue
            if closed and sure and _HAN.match(c):
                continue
            if closed and (c.isalpha() and not c.isupper() and not c.islower() or _SPEECH.match(p, b)):
                put(e, b, UNLIKELY, dots, a)  # speech within a sentence
                continue
            if c in ",;:，；：、)" or c in "—–-" and not _DASHED.match(p, b):
                put(e, b, UNLIKELY, dots, a)
                continue
            w = p[b + 1 : b + 2] if c in "—–-" else m[0] if (m := _WORD.match(p, b)) else c
            small = w[:1].islower() and not (len(w) > 1 and (w[1].isupper() or not w[1].isalpha() and w[1] not in "'’-."))
            if sure or head in "!?؟！？۔" and not small:
                put(e, b, LIKELY, dots, a)
            elif small or head == "." and _INITIAL.search(p, max(0, a - 2), a) and _DOTTED.match(p, b, b + 3):
                put(e, b, UNLIKELY, dots, a)  # a small letter, or initials
            elif head == "." and _NO_DOT.search(p, max(0, a - 1), a):
                put(e, b, UNLIKELY, dots, a)  # scripts with a danda or no marks have dots in abbreviations only
            else:
                put(e, b, LIKELY if closed else MAYBE, dots, a)
        # Blanks in scripts without marks.
        if thai:
            for m in _BLANK.finditer(p):
                e, b = m.span()
                if e == 0 or b >= n or b in seen or pairs.inside(e - 1) and pairs.inside(b) and pairs.around(e, e):
                    continue
                if _THAI.match(p[e - 1]) or _THAI.match(p[b]):
                    put(e, b, MAYBE, " ", e)
        last = 0
        for begin in sorted(seen):
            end, _, what, left, right = seen[begin]
            out.append((lo + end, lo + begin, what, left, right, max(p.count(" ", last, end) + 1, (end - last) // 8) if end - last > 3 else 0))
            last = begin
        if nxt > hi or hi < len(text):
            end = n
            while end and p[end - 1].isspace():
                end -= 1
            if end and nxt < len(text):
                out.append((lo + end, nxt, YES, _edge(p, end), _right(text, nxt), 9))
    return out


def _edge(p: str, end: int) -> tuple[str, str]:
    """The last word of a paragraph with its mark."""
    m = _TRAIL.search(p, max(0, end - 12), end)
    mark = " " if not m and _THAI.search(p, max(0, end - 20), end) else "\n" if not m else ("…" if m[0].startswith(("..", "…")) else m[0][0]) + "”" * (m[0][-1] in _CLOSERS)
    return _left(_before(p, m.start() if m else end), mark)


# --- places as numbers

WORDS, PAIRS = 1 << 18, 1 << 19
_TABLES = ("end", "all", "start", "no", "behind", "mid", "after", "on")
#: Marks by number; what a place's first chance is, before any word is known.
MARKS = [" ", "\n", "¶", *[c + q for c in ".…!?。！？｡．؟।॥" for q in ("", "”")], ""]
_FIRST = np.array([0.3, 0.15, 0.9, *[0.7 if c in ".…" else 0.9 for c in ".…!?。！？｡．؟।॥" for _ in "ab"], 0.9])
_MARK = {m: i for i, m in enumerate(MARKS)}
#: What else is known of a place: a line break in it, an abbreviation or letter before it, a script without blanks behind it, a
#: bracket or quotation behind it, and whether that goes on with a capital or number, and a number behind it.
F_LINE, F_ABBREVIATION, F_THAI, F_SIGN, F_CAPITAL, F_NUMBER = 1, 2, 4, 8, 16, 32
#: What places count as when the model is fitted, and what speaks for the event.
_KIND, _SPEAKS = np.array([NO, YES, MAYBE, YES, NO]), np.array([0.0, 0.0, 0.0, WEIGHT, -WEIGHT])
COLUMNS = ("end", "begin", "what", "left", "shape", "right", "rshape", "mark", "flags", "words")


class _Numbers(dict):
    """Hashes of words and shapes, kept for the words met, and what is known of both sides of a place."""

    def __init__(self):
        self.lefts: dict[tuple, tuple] = {}
        self.rights: dict[tuple, tuple] = {}

    def __missing__(self, key: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[key] = i = zlib.crc32(key.encode("utf-8", "ignore")) % WORDS
        return i


    def left(self, key: tuple[str, str]) -> tuple[int, int, int, int]:
        """word, shape, mark, flags of what stands before a place."""
        w, shape = key
        word, _, mark = w.rpartition("|")
        flags = F_LINE * mark.startswith("↵")
        if flags:
            mark = mark[1:]
            w, shape = f"{word}|{mark}", shape.replace("|↵", "|")
        flags |= F_ABBREVIATION * (mark.startswith(".") and (word in _ABBREVIATED or len(word) == 1 and word.isalpha()))
        return self[w], self[shape], _MARK.get(mark, len(MARKS) - 1), flags

    def right(self, key: tuple[str, str]) -> tuple[int, int, int]:
        """word, shape, flags of what stands behind a place."""
        r, shape = key
        flags = F_THAI * r.startswith("t:") | F_NUMBER * r.endswith("<n>")
        if not r[2:3].isalnum() and r[2:3] != "<":
            flags |= F_SIGN | F_CAPITAL * r.endswith("A")
        return self[r], self[shape], flags


def numbered(found: list, numbers: _Numbers) -> np.ndarray:
    """COLUMNS of places, a row each."""
    out, lefts, rights = [], numbers.lefts, numbers.rights
    for end, begin, what, left, right, words in found:
        if (x := lefts.get(left)) is None:
            if len(lefts) > 500_000:
                lefts.clear()
            x = lefts[left] = numbers.left(left)
        if (y := rights.get(right)) is None:
            if len(rights) > 500_000:
                rights.clear()
            y = rights[right] = numbers.right(right)
        out.append((end, begin, what, x[0], x[1], y[0], y[1], x[2], x[3] | y[2], words if words < 9 else 9))
    return np.array(out, np.int32).reshape(-1, len(COLUMNS))


def _pair(x: np.ndarray) -> np.ndarray:
    return (x[:, 3].astype(np.int64) * 2654435761 + x[:, 5]) % PAIRS


class Counts:
    """The tables of the model, of fixed size; added up over partitions."""

    SIZE = len(_TABLES) * WORDS + PAIRS + 6 + 2 * len(MARKS)

    def __init__(self, flat: np.ndarray | None = None):
        self.flat = np.zeros(self.SIZE) if flat is None else flat
        for i, name in enumerate(_TABLES):
            setattr(self, name, self.flat[i * WORDS : (i + 1) * WORDS])
        at = len(_TABLES) * WORDS
        self.pair = self.flat[at : at + PAIRS]
        self.sums = self.flat[at + PAIRS : at + PAIRS + 6].reshape(3, 2)  # starts, words within, continuations, by script
        self.shares = self.flat[at + PAIRS + 6 :].reshape(2, len(MARKS))  # settled and all events, by mark

    def settle(self, x: np.ndarray) -> None:
        """What settled places say."""
        what, left, shape, right, rshape, mark, thai = *x[:, [2, 3, 4, 5, 6, 7]].T, (x[:, 8] & F_THAI) // F_THAI
        what = _KIND[what]
        some, no, yes = what != NO, what == NO, (what == YES) & (mark != _MARK["¶"])
        np.add.at(self.all, np.concatenate([left[some], shape[some]]), 1)
        np.add.at(self.no, left[no], 1)
        np.add.at(self.behind, right, 1)
        np.add.at(self.end, np.concatenate([left[yes], shape[yes]]), 1)
        np.add.at(self.start, np.concatenate([right[yes], rshape[yes]]), 1)
        np.add.at(self.sums[0], thai[yes], 1)

    def within(self, texts: list[str], numbers: _Numbers) -> None:
        """All words between blanks; those behind places are taken off by the model."""
        for token, n in Counter(chain.from_iterable(map(str.split, texts))).items():
            if (m := _WORD.match(token)) and not _THAI.match(token):
                for k in _begin(m[0]):
                    self.mid[numbers[k]] += n
                self.sums[1, 0] += n

    def expect(self, x: np.ndarray, p: np.ndarray) -> None:
        """What the posteriors say of all places."""
        what, left, right, rshape, mark, thai = *x[:, [2, 3, 5, 6, 7]].T, (x[:, 8] & F_THAI) // F_THAI
        what = _KIND[what]
        np.add.at(self.shares[0], mark, what == YES)
        np.add.at(self.shares[1], mark, p)
        on = ((what == NO) | (mark == _MARK[" "])) & (p < 1)
        q = 1 - p[on]
        np.add.at(self.after, np.concatenate([right[on], rshape[on]]), np.concatenate([q, q]))
        np.add.at(self.sums[2], thai[on], q)
        np.add.at(self.on, left[on], q)
        np.add.at(self.pair, _pair(x)[on], q)


class Model:
    """Counts of the hidden-event bigrams, and the posteriors they give.

    Where an event is settled (end and start of paragraphs and of lines that stand for themselves) its words are known for sure.
    A word that always ends sentences must end settled ones as often as it occurs times the share of settled events among all,
    and its rate is its settled ends by that number; starts are counted likewise. Words that follow each other without an event are
    counted, within sentences and, by expectation, over the blanks of scripts that don't mark sentences.
    """

    BACK, MIX = 2.0, 0.7
    #: Probability of a word that was never seen, alike behind an event and within sentences: it says nothing.
    UNSEEN = 0.002

    def __init__(self, settled: Counts, expected: Counts | None = None):
        self.c = settled
        self.e = expected or Counts()
        self.share = np.clip((self.e.shares[0] + 1) / (self.e.shares[1] + 4), 0.02, 1.0) if expected else np.full(len(MARKS), 0.3)
        self.mid = np.maximum(settled.mid - settled.behind, 0)

    def _rate(self, k: np.ndarray, prior: np.ndarray | float, weight: float, share: np.ndarray) -> np.ndarray:
        seen = np.maximum(self.c.all[k] * share, self.c.end[k])
        return np.minimum((self.c.end[k] + weight * prior) / (seen + weight), 0.995)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the event at each place, given only the words at both sides."""
        c, e = self.c, self.e
        left, shape, right, mark, flags = x[:, [3, 4, 5, 7, 8]].T
        share = self.share[mark]
        blank = mark == _MARK[" "]
        thai = (flags & F_THAI) // F_THAI
        plain_rate = self._rate(left, self._rate(shape, _FIRST[mark], 4, share), self.BACK, share)
        always = (c.end[left] >= 3) & (c.no[left] < 0.02 * c.end[left])  # a word that ends sentences and is never gone on from
        plain_rate = np.where(always, np.maximum(plain_rate, np.where(blank, 0.9, 0.97)), plain_rate)
        pe = np.where(flags & F_ABBREVIATION, self._rate(left, 0.02, 6, share), plain_rate)
        pe = np.where(flags & F_LINE, 1 - (1 - pe) * 0.15, pe)
        word = lambda n, total: (n + self.UNSEEN * (total + 1)) / (total + 1)
        in_start = word(c.start[right], c.sums[0][thai])
        plain = word(e.after[right] + self.mid[right], e.sums[2][thai] + c.sums[1][thai])
        seen = e.on[left]
        bigram = np.divide(e.pair[_pair(x)], seen, out=np.zeros(len(x)), where=seen > 0)
        mix = self.MIX * seen / (seen + self.BACK)
        follow = mix * bigram + (1 - mix) * plain
        # How often a word that stands behind places does so behind settled events, against how often it would if it began sentences.
        settled = np.maximum(c.behind[right] * share, c.start[right])
        begins = np.where(flags & F_NUMBER, 0.5, np.clip((c.start[right] + 1) / (settled + 2), 0.02, 0.98))
        yes, no = pe * in_start * begins, (1 - pe) * follow * (1 - begins)
        out = yes / np.maximum(yes + no, 1e-300)
        # Scripts without marks: no words within sentences are known to be such; the next word's own rate of starting one counts.
        pr = np.minimum((c.start[right] + 0.1) / (settled + 1), 0.95)
        yes, no = pe * pr / 0.3, (1 - pe) * (1 - pr) / 0.7
        out = np.where(blank & (thai == 1), yes / (yes + no), out)
        # A bracket or a quotation: what matters is how it goes on.
        out = np.where(flags & F_SIGN, np.where(flags & F_CAPITAL, 1 - (1 - pe) * 0.25, pe * 0.5), out)
        return np.clip(out, 1e-6, 1 - 1e-6)

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Probability of the event at each place by the words at both sides and by what punctuation speaks for; settled places have 0 or 1."""
        what, p = x[:, 2], self.score(x)
        odds = p / (1 - p) * np.exp(_SPEAKS[what])
        return np.where(what == YES, 1.0, np.where(what == NO, 0.0, odds / (1 + odds)))

    def posteriors(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The posterior of the event at each place, by forward-backward over each text; first: where texts begin.

        The steps of the chain are 2 x 2 matrices, multiplied in doubling strides, forwards and backwards, over all texts at once.
        """
        n = len(x)
        if not n:
            return np.zeros(0)
        what, words = x[:, 2], x[:, 9]
        p = self.chance(x)
        short = np.where(what == YES, 1.0, np.where(words >= 2, 1.0, np.where(words == 1, 0.15, 0.02)))  # a sentence of one word, of none
        begins = np.zeros(n, bool)
        begins[first] = True
        short = np.where(begins, 1.0, short)
        # Where a place is settled, what comes before makes no difference: a chain is no longer than a run of open places.
        settled = np.flatnonzero(np.concatenate([[True], what < MAYBE, [True]]))
        longest = int(np.diff(settled).max()) + 1
        step = np.stack([1 - p, p, 1 - p, p * short])

        def scan(m: np.ndarray) -> np.ndarray:
            """The product of each step with those before it."""
            s = 1
            while s < longest:
                a, b, c, d = m[:, :-s]
                e, f, g, h = m[:, s:]
                new = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
                new /= np.maximum(new.max(0), 1e-300)
                m = np.concatenate([m[:, :s], new], axis=1)
                s *= 2
            return m

        alpha = scan(step)[:2]
        # What follows place i: the steps behind it up to the end of its text, where nothing follows.
        after = np.roll(step, -1, axis=1)
        after[:, np.append(first[1:], n) - 1] = 1.0
        a, b, c, d = scan(after[[0, 2, 1, 3], ::-1])[:, ::-1]  # transposed, to multiply from the right
        y = alpha[1] * (b + d)
        total = alpha[0] * (a + c) + y
        return np.where(what == YES, 1.0, np.where(what == NO, 0.0, np.divide(y, total, out=alpha[1].copy(), where=total > 0)))

    @staticmethod
    def fit(texts: list[str], rounds: int = ROUNDS) -> Model:
        """The model of texts in memory, as fitted() makes it of a corpus."""
        numbers, settled = _Numbers(), Counts()
        xs = [numbered(places(t), numbers) for t in texts]
        settled.within(texts, numbers)
        x = np.concatenate([*xs, np.zeros((0, len(COLUMNS)), np.int32)])
        first = np.cumsum([0, *[len(y) for y in xs if len(y)]])[:-1].astype(int)
        settled.settle(x)
        model = Model(settled)
        for _ in range(rounds):
            expected = Counts()
            expected.expect(x, model.posteriors(x, first))
            model = Model(settled, expected)
        return model


def _cut(lo: int, hi: int, x: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    """start, end of each sentence of a text that begins at lo and ends at hi, white space aside."""
    out, at = [], lo
    for end, begin in x[p >= 0.5, :2].tolist():
        if end > at:
            out.append((at, end))
            at = begin
    if hi > at:
        out.append((at, hi))
    return out


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    """start, end of each sentence."""
    if not text or text.isspace():
        return []
    x = numbered(places(text), _Numbers())
    return _cut(len(text) - len(text.lstrip()), len(text.rstrip()), x, model.posteriors(x, np.array([0])))


PLACES = "doc_id bigint, lo int, hi int, places binary, counts binary"


def found_places(documents: DataFrame) -> DataFrame:
    """PLACES: of each text its extent and its places as numbers; and of each partition, without doc_id, what its settled places count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, counts = _Numbers(), Counts()
        for b in batches:
            rows, xs = [], []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                if t and not t.isspace():
                    x = numbered(places(t), numbers)
                    xs.append(x)
                    rows.append((i, len(t) - len(t.lstrip()), len(t.rstrip()), x.tobytes(), None))
            if xs:
                counts.settle(np.concatenate(xs))
                counts.within([t for t in b["text"] if t], numbers)
            yield pd.DataFrame(rows, columns=["doc_id", "lo", "hi", "places", "counts"])
        yield pd.DataFrame({"doc_id": [None], "lo": [0], "hi": [0], "places": [None], "counts": [_packed(counts)]})

    return spread(documents.select("doc_id", "text").where("text is not null and doc_id is not null")).mapInPandas(run, PLACES)


def _packed(c: Counts) -> bytes:
    """Counts as bytes: places and values of those that are not null."""
    at = np.flatnonzero(c.flat).astype(np.int32)
    return len(at).to_bytes(8, "little") + at.tobytes() + c.flat[at].tobytes()


def _added(a: bytes, b: bytes) -> bytes:
    (at, x), (bt, y) = (((np.frombuffer(raw, np.int32, n, 8), np.frombuffer(raw[8 + 4 * n :], np.float64)) for raw in (a, b) for n in [int.from_bytes(raw[:8], "little")]))
    at, back = np.unique(np.concatenate([at, bt]), return_inverse=True)
    return len(at).to_bytes(8, "little") + at.tobytes() + np.bincount(back, np.concatenate([x, y])).tobytes()


def _total(parts: DataFrame) -> Counts:
    """The sum of the counts of all partitions, which meet in a tree; of one size whatever the corpus is."""
    rdd = parts.where("counts is not null").select("counts").rdd.map(lambda r: bytes(r[0]))
    return _unpacked(rdd.treeReduce(_added) if rdd.getNumPartitions() else _packed(Counts()))


def _unpacked(raw: bytes) -> Counts:
    n, flat = int.from_bytes(raw[:8], "little"), np.zeros(Counts.SIZE)
    flat[np.frombuffer(raw, np.int32, n, 8)] = np.frombuffer(raw[8 + 4 * n :], np.float64)
    return Counts(flat)


def _blocks(b: pa.RecordBatch, at_once: int = 2000) -> Iterator[tuple[list, list, list, list[np.ndarray], np.ndarray, np.ndarray]]:
    """doc ids, lo, hi, places of each, all places and where each text's begin."""
    cols = [b.column(c).to_pylist() for c in ("doc_id", "lo", "hi", "places")]
    for a in range(0, len(cols[0]), at_once):
        doc, lo, hi, raw = (c[a : a + at_once] for c in cols)
        xs = [np.frombuffer(r, np.int32).reshape(-1, len(COLUMNS)) for r in raw]
        yield doc, lo, hi, xs, np.concatenate(xs), np.cumsum([0, *[len(x) for x in xs if len(x)]])[:-1].astype(int)


def fitted(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all documents. found: of found_places, written."""
    texts = found.where("doc_id is not null")
    settled = _total(found)
    model = Model(settled)
    for _ in range(rounds):
        held = found.sparkSession.sparkContext.broadcast((_packed(settled), _packed(model.e)))  # of one size whatever the corpus is
        new = model.e.flat.any()

        def run(batches: Iterator[pa.RecordBatch], held=held, new=new) -> Iterator[pa.RecordBatch]:
            s, e = map(_unpacked, held.value)
            m, counts = Model(s, e if new else None), Counts()
            for b in batches:
                for *_, x, first in _blocks(b):
                    counts.expect(x, m.posteriors(x, first))
            yield pa.RecordBatch.from_arrays([pa.array([_packed(counts)], pa.binary())], ["counts"])

        model = Model(settled, _total(texts.select("doc_id", "lo", "hi", "places").mapInArrow(run, "counts binary")))
        held.unpersist()
    return model


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, start_at, end_at of each sentence, by the given model or that of all documents."""
    found = written(found_places(documents), "places")
    model = model or fitted(found)
    held = found.sparkSession.sparkContext.broadcast((_packed(model.c), _packed(model.e), bool(model.e.flat.any())))  # of one size whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, e, new = held.value
        m = Model(_unpacked(s), _unpacked(e) if new else None)
        for b in batches:
            for doc, lo, hi, xs, x, first in _blocks(b):
                p, at, rows = m.posteriors(x, first), 0, []
                for i, a, z, own in zip(doc, lo, hi, xs, strict=True):
                    rows += [(i, *c) for c in _cut(a, z, own, p[at : at + len(own)])]
                    at += len(own)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=False)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int32())], ["doc_id", "start_at", "end_at"])

    return found.where("doc_id is not null").select("doc_id", "lo", "hi", "places").mapInArrow(run, "doc_id bigint, start_at int, end_at int")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES = {"p9_found": p9_found}
