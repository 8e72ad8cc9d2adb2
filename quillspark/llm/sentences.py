"""Problem 5: sentence boundaries in many languages and scripts.

A hidden-event n-gram language model. Between the words of a cell stands, at every place where a sentence could end, a hidden
event: boundary or none. The model holds the probability of a boundary after a word and its mark, the probability of the next
word given the event (after a boundary: words that begin sentences; else: words that follow that word), and the probability of
a boundary by the length of the sentence that it would close. It is trained without labels by expectation-maximisation: the
ends of cells are known boundaries, all other events are hidden. Forward-backward posteriors over the events of a cell decide.

Candidate places: after final marks with the quotes or brackets that close with them, and, in Thai, spaces. No place is a
candidate inside a quotation, inside a token (numbers, versions, file names), or before a small letter. In a stretch that has lost
its marks, for it is longer than sentences of the collection are, every place between two words is one, and the trigrams of the
sentences decide (see unmarked).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.unmarked import NGrams
from quillspark.session import load

ROUNDS = 12
#: Words that are kept as themselves; others share a class by their shape.
LEAST_COUNT = 4
#: How much the next word, and the length, may speak for or against a boundary: unbounded, a capital word seen once after an
#: abbreviation would outweigh the abbreviation, and rare languages would drift with the frequent ones.
MOST_RATIO = 5.0
LENGTHS = 6

TABLES = ("draft_sentences", "source_sentences", "claim_sentences")
IDS = {"draft_sentences": "sent_id", "source_sentences": "src_id", "claim_sentences": "claim_id"}

#: Quotations, by their pairs of marks (fixed values).
QUOTED = re.compile("„[^„“”]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|‘[^‘’]*[^\\w\\s]’|\"[^\"]*\"|‹[^‹›]*›|《[^《》]*》")
CLOSERS = "”»“」』’\"›》)\\]）】"
MARKS = ".!?…。！？।॥؟｡"
THAI = "฀-๿"
CANDIDATE = re.compile(rf"[{MARKS}]+(?:[  ]*»|[{CLOSERS}])*|(?<=[Ͱ-Ͽἀ-῿]);|(?<=[Ͱ-Ͽἀ-῿]);|(?<=[{THAI}])\s+(?=[{THAI}\d])|(?<=\d)\s+(?=[{THAI}])")
WIDE_MARK = re.compile("[。！？｡]")
OPENERS = re.compile(r"[\s“„«「『‘\"‹《(\[（【¿¡]*")
TOKEN = re.compile(r"\S+")


def stops(written: Counter, tokens: Counter, stopped: Counter) -> None:
    """Adds counts of tokens as they are written to counts of them without marks, and of those with a stop after them."""
    for x, n in written.items():
        x = x.strip("“”„«»「」『』‘’\"‹›《》()[]（）【】¿¡,;:!?")
        w = x.rstrip(".")
        tokens[w] += n
        if x.endswith("."):
            stopped[w] += n
        if "." in w:  # a stop inside a token: the part before it
            at = w.rindex(".")
            tokens[w[:at]] += n
            stopped[w[:at]] += n


class Place:
    """A candidate boundary: end of the sentence it would close, start of the next, the words on either side, words before."""

    __slots__ = ("end", "next", "before", "after", "words", "last")

    def __init__(self, end: int, next_: int, before: str, after: str, words: int, last: bool) -> None:
        self.end, self.next, self.before, self.after, self.words, self.last = end, next_, before, after, words, last


def shape(word: str) -> str:
    if not word:
        return "<none>"
    c = word[0]
    if c.isdigit():
        return "<number>"
    if c.isupper():
        return "<initial>" if len(word) == 1 else "<capital>"
    if c.islower():
        return "<small>"
    return "<caseless>" if c.isalpha() else "<other>"


def word_before(text: str, start: int, mark: str) -> str:
    """The token that ends at start, numbers by their shape, with the kind of mark after it."""
    s = start
    while s > 0 and not text[s - 1].isspace() and start - s < 40:
        s -= 1
    word = text[s:start].lstrip("“„«「『‘\"‹《([（【¿¡")
    if re.fullmatch(r"[\d.,:/-]+", word):
        word = "<number>"
    elif re.search("[⺀-鿿぀-ヿ฀-๿]", word):
        word = "<dense>"
    return word + " " + (mark[0] if mark.strip() else "space")


def places(text: str) -> list[Place]:
    """Candidate boundaries of a cell in order; the last one is its end."""
    end = len(text.rstrip())
    quotes = [(m.start(), m.end()) for m in QUOTED.finditer(text)] if re.search("[„“«「『‘\"‹《]", text) else []
    out: list[Place] = []
    since, k = len(text) - len(text.lstrip()), 0
    for m in CANDIDATE.finditer(text):
        at, to = m.start(), m.end()
        mark = m.group()
        if to >= end:
            break
        while k < len(quotes) and quotes[k][1] <= at:
            k += 1
        if k < len(quotes) and quotes[k][0] < at:
            q = quotes[k][1]
            if to == q - 1:
                to = q  # the mark that closes the quotation, where that is no closing mark elsewhere
            if to < q:
                continue  # inside the quotation
            if to > q and mark[0] not in MARKS:
                continue
        if not mark.strip():  # a space in Thai
            out.append(Place(at, to, word_before(text, at, mark), text[to : to + 4], to - since, False))
            since = to
            continue
        o = OPENERS.match(text, to)
        first = text[o.end() : o.end() + 1] if o else ""
        spaced = to < len(text) and text[to].isspace()
        if first and (first.islower() or not first.isalnum()):
            continue
        if WIDE_MARK.search(mark):
            if mark[-1] in "」』”’" and not spaced:
                continue  # the quotation goes on as part of a sentence
        else:
            dots = mark.strip(CLOSERS.replace("\\", "") + "  ")
            if not spaced:
                inner = text[to : to + 2]
                if not (inner[:1].isupper() and inner[1:2].islower() or inner[:1].isupper() and inner[1:2].isspace() or text[to] in "“„«¿¡(" or (first and not first.isdigit() and not first.isupper() and not first.isascii())):
                    continue
            if dots.startswith(("…", "..")) and not (first.isupper() and spaced):
                continue
        start = o.end() if o else to
        nxt = to
        while nxt < len(text) and text[nxt].isspace():
            nxt += 1
        t = TOKEN.match(text, start)
        after = (t.group().rstrip(",;:.!?") if t else "") + ("" if spaced else " joined")
        tail = at
        while tail > since and text[tail - 1].isspace():
            tail -= 1
        before = word_before(text, tail, mark)
        words = (at - since) // 2 if before.startswith("<dense>") else text.count(" ", since, at) + 1
        out.append(Place(to, nxt, before, after, words, False))
        since = nxt
    s = end
    while s > 0 and text[s - 1] in MARKS + "”»“」』’\"›》)]）】;;":
        s -= 1
    out.append(Place(end, len(text), word_before(text, s, text[s : s + 1] or " "), "<end>", 9, True))
    return out


class Model:
    """Counts of events and words, smoothed; see the module's text. Over tables sentence_fit does what fit and posteriors do here."""

    def __init__(self) -> None:
        self.kept_before: set[str] = set()
        self.kept_after: set[str] = set()
        self.event: dict[str, list[float]] = {}
        self.stopped: set[str] = set()
        self.starts: dict[str, float] = {}
        self.follow: dict[str, float] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        self.pair_totals: dict[str, float] = {}
        self.length = [[1.0, 1.0] for _ in range(LENGTHS + 1)]
        self.words = NGrams([])

    def before(self, w: str) -> str:
        return w if w in self.kept_before else shape(w) + " " + w[-1:]

    def after(self, w: str) -> str:
        return w if w in self.kept_after else shape(w) + (" joined" if w.endswith(" joined") else "")

    def factors(self, p: Place) -> tuple[float, float]:
        """Weights of boundary and none at a place, without the length."""
        b, a = self.before(p.before), self.after(p.after)
        yes, no = self.event.get(b, (0.0, 0.0))
        more, less = self.belief(p.before)
        prior = (yes + more) / (yes + no + more + less)
        if p.last:
            return 1.0, 0.0
        start = (self.starts.get(a, 0.0) + 0.5) / (self.starts_total + 0.5 * self.size)
        loose = (self.follow.get(a, 0.0) + 0.5) / (self.follow_total + 0.5 * self.size)
        n = self.pair_totals.get(b, 0.0)
        follow = min(max((self.pairs.get((b, a), 0.0) + 2.0 * loose) / (n + 2.0), start / MOST_RATIO), start * MOST_RATIO)
        return prior * start, (1 - prior) * follow

    def posteriors(self, cell: list[Place]) -> list[float]:
        """Probability of a boundary at each place: forward-backward over the length of the open sentence (in words)."""
        if len(cell) == 1:
            return [1.0]
        states = LENGTHS + 1
        steps = []
        for p in cell:
            yes, no = self.factors(p)
            steps.append((yes, no, min(max(p.words, 1), LENGTHS)))
        ended, went_on = (sum(x[k] for x in self.length) for k in (0, 1))
        ratio = [min(max(e / ended / (g / went_on), 1 / MOST_RATIO), MOST_RATIO) for e, g in self.length]  # of likelihoods of a length
        forward = [[1.0] + [0.0] * LENGTHS]
        for yes, no, n in steps:
            new = [0.0] * states
            for s, f in enumerate(forward[-1]):
                if f:
                    t = min(s + n, LENGTHS)
                    new[0] += f * yes * ratio[t]
                    new[t] += f * no
            total = sum(new) or 1.0
            forward.append([x / total for x in new])
        backward = [1.0] * states
        out = [0.0] * len(cell)
        for i in range(len(cell) - 1, -1, -1):
            yes, no, n = steps[i]
            new, hit, all_ = [0.0] * states, 0.0, 0.0
            for s in range(states):
                t = min(s + n, LENGTHS)
                y = yes * ratio[t] * backward[0]
                z = no * backward[t]
                new[s] = y + z
                hit += forward[i][s] * y
                all_ += forward[i][s] * (y + z)
            out[i] = hit / all_ if all_ else 1.0
            total = max(new) or 1.0
            backward = [x / total for x in new]
        return out

    def belief(self, before: str) -> tuple[float, float]:
        """Pseudo-counts of boundary and none after a word and its mark.

        A stop that is no boundary belongs to its word, so a word that mostly stands without one is followed by a boundary. Open
        are words that nearly always carry a stop, initials and numbers.
        """
        word, mark = before.rsplit(" ", 1)
        if mark == "." and (word == "<number>" or (len(word) == 1 and word.isupper()) or word in self.stopped):
            return 0.5, 2.0
        return 2000.0, 1.0

    def fit(self, cells: list[list[Place]], firsts: list[str], texts: list[str]) -> None:
        tokens, stopped = Counter(), Counter()
        stops(Counter(x for t in texts for x in t.split()), tokens, stopped)
        self.stopped = {w for w, n in tokens.items() if stopped[w] >= 0.8 * n and (n >= 10 or (n > 1 and len(w) <= 3))}
        befores = Counter(p.before for c in cells for p in c)
        afters = Counter(p.after for c in cells for p in c) + Counter(firsts)
        self.kept_before = {w for w, n in befores.items() if n >= LEAST_COUNT}
        self.kept_after = {w for w, n in afters.items() if n >= LEAST_COUNT}
        self.size = len(self.kept_after) + 12
        self.starts_total, self.follow_total = 0.0, 0.0
        belief = [[1.0 if p.last else (lambda b: b[0] / sum(b))(self.belief(p.before)) for p in c] for c in cells]
        for _ in range(ROUNDS):
            event: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
            starts, follow, pairs, totals = Counter({self.after(w): 0.0 for w in firsts}), Counter(), Counter(), Counter()
            for w in firsts:
                starts[self.after(w)] += 1.0
            length = [[1.0, 1.0] for _ in range(LENGTHS + 1)]
            for c, probabilities in zip(cells, belief, strict=True):
                open_ = 0
                for p, y in zip(c, probabilities, strict=True):
                    b, a = self.before(p.before), self.after(p.after)
                    event[b][0] += y
                    event[b][1] += 1 - y
                    open_ = min(open_ + max(p.words, 1), LENGTHS)
                    length[open_][0] += y
                    length[open_][1] += 1 - y
                    if y > 0.5:
                        open_ = 0
                    if not p.last:
                        starts[a] += y
                        follow[a] += 1 - y
                        pairs[b, a] += 1 - y
                        totals[b] += 1 - y
            self.event, self.starts, self.follow, self.pairs, self.pair_totals, self.length = dict(event), dict(starts), dict(follow), dict(pairs), dict(totals), length
            self.starts_total, self.follow_total = sum(starts.values()), sum(follow.values())
            belief = [self.posteriors(c) for c in cells]
        told = []
        for t, c, y in zip(texts, cells, belief, strict=False):
            start = len(t) - len(t.lstrip())
            for p, x in zip(c, y, strict=True):
                if x > 0.5 and p.end > start:
                    told.append(t[start : p.end])
                    start = p.next
        self.words = NGrams(told)


def split(text: str, model: Model) -> list[tuple[int, int]]:
    """Offsets of the sentences of a cell, without white space at either end; an empty or blank cell has none."""
    if not text or not text.strip():
        return []
    cell = places(text)
    start = len(text) - len(text.lstrip())
    out = []
    for p, y in zip(cell, model.posteriors(cell), strict=True):
        if y > 0.5 and p.end > start:
            out += model.words.split(text, start, p.end) if model.words.lost(text[start : p.end]) else [(start, p.end)]
            start = p.next
    return out


def first_word(text: str) -> str:
    o = OPENERS.match(text)
    t = TOKEN.match(text, o.end() if o else 0)
    return t.group().rstrip(",;:.!?") if t else ""


def all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = None
    for table in TABLES:
        part = load(spark, sf_dir, table)
        if "origin" in part.columns:
            part = part.where("origin is null or origin <> 'scan'")
        part = part.select(F.lit(table).alias("rec_table"), F.col(IDS[table]).alias("rec_id"), "text")
        df = part if df is None else df.unionByName(part)
    return df


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of every cell."""
    from quillspark.llm.sentence_fit import fitted_spans

    return fitted_spans(all_cells(spark, sf_dir))


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, with the number of the sentence in its cell and its text."""
    from pyspark.sql import Window

    from quillspark.llm.sentence_fit import fitted_spans

    cells = all_cells(spark, sf_dir)
    spans = fitted_spans(cells).dropDuplicates()
    number = F.row_number().over(Window.partitionBy("rec_table", "rec_id").orderBy("char_start"))
    text = F.expr("substring(text, char_start + 1, char_end - char_start)")
    return spans.withColumn("number", number).join(cells.dropDuplicates(["rec_table", "rec_id"]), ["rec_table", "rec_id"]).select("rec_table", "rec_id", "number", text.alias("sentence"))
