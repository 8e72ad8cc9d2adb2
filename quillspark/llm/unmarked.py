"""Sentence boundaries where no marks stand: the hidden-event n-gram model between all words.

The events of marked text are decided in sentences.py. What is left without a mark for longer than sentences of the collection ever
run has lost its punctuation. There an event stands between any two tokens (words; characters in scripts without spaces): the
boundary token <s> is a word of a trigram model, estimated on the sentences that marks did tell apart (a stretch that has lost its
marks is none of them, nor evidence of how long sentences are), and a text is a sequence of sentences, each with the probability of its words, of its end after its last words, and of its length. Forward-backward
posteriors over all segmentations decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

DENSE = "⺀-⿟぀-ヿ㐀-鿿豈-﫿가-힯"
THAI_CLUSTER = "[เ-ไ]?[ก-ฮ][ะ-ูๅ็-๎]*"
TOKEN = re.compile(rf"[{DENSE}]|{THAI_CLUSTER}|[^\W{DENSE}ก-๎]+(?:['’.-][^\W{DENSE}ก-๎]+)*")
ASCII_TOKEN = re.compile(r"\w+(?:['.-]\w+)*", re.ASCII)
SPACELESS = re.compile(rf"[{DENSE}ก-๎]")
OPENING = "“„«「『‘\"‹《([（【¿¡"
EDGE = "<s>"
#: A stretch has lost its marks if a sentence of its length or more would be rarer than this.
LOST = 1e-7
#: Trigrams seen less often are left to the bigrams.
LEAST_TRIGRAM = 2


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def count_tokens(text: str) -> int:
    return len((ASCII_TOKEN if text.isascii() else TOKEN).findall(text))


def words_of(text: str) -> list[str]:
    return [text[a:z].lower() for a, z in tokens(text)]


def grams(words: list[str]) -> tuple[zip, zip, zip]:
    """Words, bigrams and trigrams of a sentence and its boundaries."""
    seq = [EDGE, EDGE, *words, EDGE]
    return zip(seq[2:]), zip(seq[1:], seq[2:], strict=False), zip(seq, seq[1:], seq[2:], strict=False)


def needed(words: list[str]) -> set[tuple[str, ...]]:
    """All grams that NGrams.boundaries may look up for a text of these words."""
    out: set[tuple[str, ...]] = set()
    for k, w in enumerate(words):
        before, first = words[k - 1] if k else EDGE, words[k - 2] if k > 1 else EDGE
        for g in ((first, before, w), (EDGE, EDGE, w), (before, w, EDGE), (EDGE, w, words[k + 1] if k + 1 < len(words) else EDGE)):
            out.update((g, g[1:], g[2:]))
    return out


def fall(mean: float) -> float:
    """Ratio of the probabilities of a length and the one before, past the longest: a tail that falls off within a mean length."""
    return math.exp(-8.0 / mean)


def with_marks(counts: np.ndarray) -> np.ndarray:
    """Numbers of sentences by length, up to the first gap in the longest tenth that a tail of lengths can't cross.

    What stands beyond the gap has lost its marks. Its own length must not count, or no stretch of the collection would be too long.
    """
    held = np.flatnonzero(counts)
    if len(held) < 2:
        return counts
    below = np.cumsum(counts[held])
    ratio = fall((counts[held] * held).sum() / below[-1])
    gaps = np.flatnonzero((10 * below[:-1] >= 9 * below[-1]) & (ratio ** (np.diff(held) - 1.0) < LOST))
    return counts[: held[gaps[0]] + 1] if len(gaps) else counts


class Lengths:
    """Lengths of sentences in tokens, from the number of them by length: a smoothed histogram with a geometric tail."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = with_marks(counts)
        n = int(counts.sum())
        h = counts.astype(float) if n else np.zeros(2)
        width = np.ones(5) / 5
        p = np.convolve(h, width, mode="same") + 0.01
        p[0] = 0.0
        self.p = p / p.sum() * (1 - 1 / (n + 2))
        self.fall = fall((counts * np.arange(len(counts))).sum() / n if n else 10.0)
        self.last = (1 / (n + 2)) * (1 - self.fall)
        self.limit = next(n for n in range(len(self.p), 1 << 20) if self.tail(n) < LOST)

    def tail(self, n: int) -> float:
        """Probability of n tokens or more."""
        if n < len(self.p):
            return float(self.p[n:].sum()) + self.last / (1 - self.fall)
        return self.last / (1 - self.fall) * self.fall ** (n - len(self.p))

    def log(self, most: int) -> np.ndarray:
        n = np.arange(most + 1)
        tail = self.last * self.fall ** np.maximum(0, n - len(self.p)).astype(float)
        p = np.where(n < len(self.p), np.append(self.p, np.zeros(max(0, most + 1 - len(self.p))))[: most + 1], tail)
        return np.log(np.maximum(p, 1e-300))


class NGrams:
    """A trigram model with the boundary token, smoothed by interpolation (Witten-Bell), and the lengths of sentences."""

    def __init__(self, sentences: list[str]) -> None:
        one, two, three = Counter(), Counter(), Counter()
        told = [(words, bool(SPACELESS.search(s))) for s in sentences if (words := words_of(s))]
        self.lengths = tuple(Lengths(np.bincount([len(words) for words, x in told if x == spaceless], minlength=2)) for spaceless in (False, True))
        for words, spaceless in told:
            if len(words) < self.lengths[spaceless].limit:
                ones, twos, threes = grams(words)
                one.update(w for (w,) in ones)
                two.update(twos)
                three.update(threes)
        self.one, self.two, self.three = dict(one), dict(two), {k: n for k, n in three.items() if n >= LEAST_TRIGRAM}
        self.total, self.kinds = sum(one.values()), len(one) + 1
        self.after: dict = {}
        for counts in (self.two, self.three):
            for k, n in counts.items():
                h = k[:-1] if len(k) > 2 else k[0]
                total, kinds = self.after.get(h, (0, 0))
                self.after[h] = (total + n, kinds + 1)

    @classmethod
    def of(cls, one: dict, two: dict, three: dict, after: dict, total: int, kinds: int, lengths: tuple[Lengths, Lengths]) -> NGrams:
        """The model by counts made elsewhere."""
        self = cls([])
        self.one, self.two, self.three, self.after, self.total, self.kinds, self.lengths = one, two, three, after, total, kinds, lengths
        return self

    def p(self, w: str, before: str, first: str) -> float:
        """Probability of a word (or boundary) after two others."""
        p = (self.one.get(w, 0) + 1.0) / (self.total + self.kinds)
        total, kinds = self.after.get(before, (0, 0))
        p = (self.two.get((before, w), 0) + kinds * p) / (total + kinds) if total else p
        total, kinds = self.after.get((first, before), (0, 0))
        return (self.three.get((first, before, w), 0) + kinds * p) / (total + kinds) if total else p

    def lost(self, text: str) -> bool:
        """Whether a stretch is too long to be one sentence of this collection."""
        limit = self.lengths[bool(SPACELESS.search(text))].limit
        return len(text) >= limit and sum(1 for _ in TOKEN.finditer(text)) >= limit

    def boundaries(self, text: str) -> list[tuple[int, float]]:
        """Number of the token before each place, and the posterior of a boundary there."""
        words = words_of(text)
        n = len(words)
        lengths = self.lengths[bool(SPACELESS.search(text))]
        most = min(n, 3 * len(lengths.p))
        size = lengths.log(most)
        inside = np.array([math.log(self.p(w, words[k - 1] if k else EDGE, words[k - 2] if k > 1 else EDGE)) for k, w in enumerate(words)])
        sums = np.append(0.0, np.cumsum(inside))
        first = np.array([math.log(self.p(w, EDGE, EDGE)) for w in words])
        second = np.array([math.log(self.p(words[k + 1], words[k], EDGE)) if k + 1 < n else 0.0 for k in range(n)])
        base = math.log(self.one.get(EDGE, 1) / max(self.total, 1))
        end = np.array([math.log(self.p(EDGE, words[k], words[k - 1] if k else EDGE)) - base for k in range(n)])

        def segments(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Logarithm of the weight of a sentence of the tokens [i, j)."""
            rest = sums[j] - sums[np.minimum(i + 2, j)]
            return first[i] + np.where(j - i > 1, second[i], 0.0) + rest + end[j - 1] + size[j - i]

        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        for j in range(1, n + 1):
            i = np.arange(max(0, j - most), j)
            forward[j] = np.logaddexp.reduce(forward[i] + segments(i, np.full(len(i), j)))
        for i in range(n - 1, -1, -1):
            j = np.arange(i + 1, min(n, i + most) + 1)
            backward[i] = np.logaddexp.reduce(backward[j] + segments(np.full(len(j), i), j))
        return [(j - 1, float(np.exp(min(0.0, forward[j] + backward[j] - forward[n])))) for j in range(1, n)]

    def split(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Sentences of a stretch that has lost its marks; the stretch itself if no place is likelier a boundary than not."""
        part = text[start:end]
        spans, out, at = tokens(part), [], 0
        for k, y in self.boundaries(part):
            if y > 0.5:
                a, z = spans[k][1], spans[k + 1][0]
                gap = part[a:z]
                space = re.search(r"\s+", gap)
                close, to = (a + space.start(), a + space.end()) if space else (a + len(gap.rstrip(OPENING)),) * 2
                out.append((start + at, start + close))
                at = to
        out.append((start + at, end))
        return out
