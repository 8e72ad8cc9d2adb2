"""Problem 6: noise in text from scanned pages.

Three steps a record. Furniture is found line by line: page numbers by their form, running headers by a perceptron on the shape of
the line, its place on the page, its width and its words. At every hyphen that ends a line, a perceptron predicts join or keep;
words cut in two are joined, across furniture where it stands between the halves. A character editor then repairs the words of the
running text: for every character it predicts keep, replace, delete or insert (a replacement by two characters).

All are averaged perceptrons over hashed features, trained on clean text of the same tables: the editor on its words and on
copies of them with errors drawn from the usual confusions of character recognition, the joiner on words cut in two and on pairs of
neighbouring words with a hyphen between them, the furniture model on wrapped lines and made headers, and then on those lines
of scanned pages that it is sure about.

Records are looked at by their origin: those from scanned pages and those of unknown origin. Text of known other origin is taken
for clean.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bits
from quillspark.llm.sample import bounded_texts
from quillspark.llm.spans import IDS
from quillspark.session import cut_lineage, load, spread

#: Clean rows the editor is trained on: the first of them by a hash of their text.
TRAIN_ROWS = 8_000
#: Scanned rows from which the words of headers are learned, in the same way.
TRAIN_SCANS = 8_000
EPOCHS, COPIES, BITS, PAD = 6, 10, 18, 4
#: By how much the score of an edit must exceed that of keeping the character, in units of the mean score of training words.
MARGIN = 0.0

#: (written, recognised) as character recognition confuses them (fixed values).
CONFUSIONS = (
    ("l", "1"), ("l", "|"), ("i", "1"), ("i", "!"), ("o", "0"), ("s", "5"), ("b", "6"), ("g", "9"), ("e", "c"), ("t", "f"),
    ("u", "ii"), ("m", "rn"), ("n", "ri"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("cl", "d"), ("rn", "m"),
)
#: Labels of a recognised character: what it is written as; 0 keeps it.
LABELS = ("<keep>", "", "l", "i", "o", "s", "b", "g", "e", "t", "u", "m", "n", "d", "w", "h", "cl", "rn")
NUMBER = {x: k for k, x in enumerate(LABELS)}
ALLOWED = {
    "1": ("l", "i", ""), "|": ("l",), "!": ("i",), "0": ("o",), "5": ("s",), "6": ("b",), "9": ("g",), "c": ("e", "d"), "f": ("t",),
    "i": ("u", ""), "r": ("m", "n"), "n": ("",), "l": ("", "h"), "v": ("w", ""), "d": ("cl",), "m": ("rn",),
}
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9|!]*[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ0-9|]*(?:![A-Za-zÀ-ÖØ-öø-ÿ0-9|]+)*")
#: Codes that mix letters and digits on purpose: few letters, or capitals.
CODE = re.compile(r"[A-Z]+\d[A-Z\d]*[a-z]?|[a-z]\d{1,4}|\d+[A-Za-z]{1,2}|[A-Z\d]+")
#: Recognised pairs of characters that stand for one: the first is replaced, the second deleted.
PAIRS = {"ii": "u", "rn": "m", "ri": "n", "cl": "d", "vv": "w", "li": "h"}
#: n-grams around a character, by their first and last offset.
GRAMS = ((0, 0), (-1, 0), (0, 1), (-1, 1), (-2, 0), (0, 2), (-2, 1), (-1, 2), (-2, 2), (-3, 1), (-1, 3), (-3, 0), (0, 3), (-3, 3), (-4, 1), (-1, 4))


def _mask() -> np.ndarray:
    allowed = np.zeros((128, len(LABELS)), bool)
    allowed[:, 0] = True
    for c, outs in ALLOWED.items():
        for o in outs:
            allowed[ord(c), NUMBER[o]] = True
    return allowed


ALLOWED_MASK = _mask()
OPEN = np.flatnonzero(ALLOWED_MASK.sum(1) > 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all characters that may be edited: hashed n-grams, their word, their place in it, and their code."""
    gap = "\n" * PAD
    flat = np.frombuffer((gap + gap.join(w.lower() for w in words) + gap).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w.lower()) for w in words), np.int64, len(words))
    starts = PAD + np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]])
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = starts[owner] + place
    code = flat[at]
    pick = np.isin(code, OPEN)
    owner, place, at, code = owner[pick], place[pick], at[pick], code[pick].astype(np.int64)
    out = np.empty((len(at), len(GRAMS)), np.int32)
    with np.errstate(over="ignore"):
        for k, (a, z) in enumerate(GRAMS):
            h = np.full(len(at), (k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for d in range(a, z + 1):
                h = (h ^ flat[at + d]) * np.uint64(0x100000001B3)
                h = h ^ (h >> np.uint64(29))
            out[:, k] = (h >> np.uint64(64 - BITS)).astype(np.int32)
    return out, owner, place, code


def scores(weights: np.ndarray, grams: np.ndarray, code: np.ndarray) -> np.ndarray:
    total = np.zeros((len(grams), len(LABELS)), np.float32)
    for k in range(grams.shape[1]):
        total += weights[grams[:, k]]
    total[~ALLOWED_MASK[code]] = -np.inf
    return total


def corrupt(word: str, rng: np.random.Generator) -> tuple[str, list[int]] | None:
    """A copy of a word with one or two errors, and the label of each of its characters."""
    places = [(m, a, b) for a, b in CONFUSIONS for m in range(len(word)) if word.startswith(a, m)]
    if not places:
        return None
    chosen = sorted(places[k] for k in rng.choice(len(places), size=min(len(places), 1 + int(rng.random() < 0.25)), replace=False))
    out, labels, at = "", [], 0
    for m, a, b in chosen:
        if m < at:
            continue
        out, labels = out + word[at:m] + b, labels + [0] * (m - at)
        labels += [NUMBER[a], NUMBER[""]] if len(b) == 2 else [NUMBER[a]]
        at = m + len(a)
    return out + word[at:], labels + [0] * (len(word) - at)


CLEAN_WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]{2,}"


def train(texts: list[str], seed: int = 7) -> tuple[np.ndarray, frozenset[str]]:
    """Weights of the editor, scaled so that the mean winning margin on training words is 1, and the clean words it saw."""
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    for t in texts:
        for w in re.findall(CLEAN_WORD, t):
            w = w.lower()
            seen[w] = seen.get(w, 0) + 1
    clean = sorted(w for w in seen if w.isalpha())
    words, labels = [], []
    for w in clean:
        for _ in range(2):
            words.append(w)
            labels.append([0] * len(w))
        for _ in range(COPIES):
            c = corrupt(w, rng)
            if c and c[0] not in seen:
                words.append(c[0])
                labels.append(c[1])
    weights = np.zeros((1 << BITS, len(LABELS)), np.float32)
    if not words:
        return weights, frozenset()
    grams, owner, place, code = features(words)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in labels])])
    y = np.concatenate([np.array(x, np.int64) for x in labels])[offsets[owner] + place]
    later = np.zeros_like(weights)
    step = 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(order), 2048):
            b = order[s : s + 2048]
            guess = scores(weights, grams[b], code[b]).argmax(1)
            wrong = guess != y[b]
            if wrong.any():
                g, good, bad = grams[b][wrong], y[b][wrong], guess[wrong]
                for k in range(g.shape[1]):
                    np.add.at(weights, (g[:, k], good), 1)
                    np.add.at(weights, (g[:, k], bad), -1)
                    np.add.at(later, (g[:, k], good), step)
                    np.add.at(later, (g[:, k], bad), -step)
            step += 1
    weights = weights - later / step
    final = scores(weights, grams, code)
    margin = final[np.arange(len(y)), y] - np.where(np.arange(len(LABELS)) == y[:, None], -np.inf, final).max(1)
    return (weights / max(1e-6, float(np.mean(np.abs(margin[np.isfinite(margin)]))))).astype(np.float32), frozenset(clean)


#: Words whose repair a worker remembers.
MOST_KNOWN = 500_000


class Editor:
    """Applies the weights to words, each distinct word once per worker."""

    def __init__(self, weights: np.ndarray, clean: frozenset[str], joiner: np.ndarray | None = None, furniture: tuple[np.ndarray, frozenset[str]] | None = None, held: np.ndarray | None = None) -> None:
        self.weights, self.clean, self.held = weights, clean, held
        self.furniture = furniture or (np.zeros(1 << LINE_BITS, np.float32), frozenset())
        self.joiner = np.zeros(1 << JOIN_BITS, np.float32) if joiner is None else joiner
        self.known: dict[str, str] = {}

    def is_clean(self, word: str) -> bool:
        """Whether a clean text holds a word in small letters."""
        if word in self.clean:
            return True
        return self.held is not None and bool(bits.may_hold(self.held, np.array([xxhash.xxh64_intdigest(word.encode(), 42)], np.uint64))[0])

    def learn(self, words: set[str]) -> None:
        """Decide words not met before. Words are forgotten when there are many, so a task's memory doesn't grow with its rows."""
        if len(self.known) > MOST_KNOWN:
            self.known = {}
        new = []
        for w in words:
            if w not in self.known:
                if self.is_clean(w.lower()) or len(w) < 2:
                    self.known[w] = w
                elif CODE.fullmatch(w):
                    plain = w.translate(SHORT) if w.islower() and len(w) <= 3 else w
                    self.known[w] = plain if self.is_clean(plain) else w
                else:
                    new.append(w)
        for s in range(0, len(new), 20_000):
            part = new[s : s + 20_000]
            grams, owner, place, code = features(part)
            edits: dict[int, dict[int, int]] = {}
            if len(owner):
                total = scores(self.weights, grams, code)
                gain = total - total[:, :1]
                gain[:, 0] = -np.inf
                best = gain.argmax(1)
                edit = gain[np.arange(len(best)), best] > MARGIN
                for k in np.flatnonzero(edit):
                    edits.setdefault(int(owner[k]), {})[int(place[k])] = int(best[k])
            for k, w in enumerate(part):
                self.known[w] = apply_edits(w, edits.get(k, {})) if k in edits else w


LETTERS = np.array([ord(c) for c in "abcdefghijklmnopqrstuvwxyz"])
SHORT = str.maketrans("01569", "olsbg")


def apply_edits(word: str, edits: dict[int, int]) -> str:
    """The word with its edits; of a pair of characters that stands for one, both are edited or none."""
    low = word.lower()
    out, p = "", 0
    while p < len(word):
        pair = low[p : p + 2]
        if pair in PAIRS and (LABELS[edits.get(p, 0)] == PAIRS[pair] or (edits.get(p + 1) == NUMBER[""] and p not in edits)):
            put, step = PAIRS[pair], 2
        elif p in edits:
            put, step = LABELS[edits[p]], 1
        else:
            put, step = word[p], 1
        out += put.upper() if word[p].isupper() else put
        p += step
    return out


# ---------------------------------------------------------------- furniture and lines

PAGE_NUMBER = re.compile(r"[\W_]*(?:(?:page|pag\.?|pp?\.|seite|s\.)\s*)?[\W_]*(?:\d{1,4}|[ivxl]{1,7})(?:\s*(?:/|of|von|de)\s*\d{1,4})?[\W_]*", re.IGNORECASE)
#: Size of the furniture model, rounds of its training, and shares of the lines that its second view takes for sure.
LINE_BITS, LINE_EPOCHS, SURE_HEADER, SURE_TEXT = 15, 4, 0.7, 0.95
SHAPES = str.maketrans({**{chr(c): "A" for c in range(0x41, 0x250) if chr(c).isupper()}, **{chr(c): "a" for c in range(0x61, 0x250) if chr(c).islower()}, **{str(d): "9" for d in range(10)}})
REPEATED = re.compile(r"(.)\1+")
READ_AS = str.maketrans("01|!", "olli")
NUMBERS = re.compile(r"\d+")
TOKENS = re.compile(r"[^\W_]+")
SPACED = re.compile(r"(?:[^\W\d_] ){4,}")


def line_features(line: str, first: bool, last: bool, width: float, lexical: bool) -> list[int]:
    """Hashed features of a line: its shape (runs of capitals, small letters and digits), its place on the page, its width against that
    of the record's lines, capitals and numbers; with lexical also its pairs and triples of words."""
    shapes = REPEATED.sub(r"\1", line.translate(SHAPES)).split()
    words = TOKENS.findall(line)
    long = [w for w in words if len(w) > 3 and w[0].isalpha()]
    capital = int(4 * sum(w[0].isupper() for w in long) / max(1, len(long)))
    letters = [c for c in line if c.isalpha()]
    upper, n = int(4 * sum(c.isupper() for c in letters) / max(1, len(letters))), len(shapes)
    names = [
        "bias", f"place {first} {last}", f"end {'w' if line[-1:].isalnum() else line[-1:]}", f"begin {shapes[0][0]}", f"capital {capital}", f"upper {upper}", f"n {min(n, 12)}", f"width {min(4, int(4 * len(line) / max(1, width)))}",
        f"gap {'  ' in line}", f"cn {capital} {shapes[-1][:5]} {min(n, 9) // 3}", f"cu {capital} {upper} {min(n, 9) // 3}", f"spaced {bool(SPACED.search(line))}", f"numbers {shapes[0] == '9'} {shapes[-1] == '9'} {capital}", f"cl {last} {capital}",
    ]
    around = ["<", *(x[:5] for x in shapes), ">"]
    names += [f"2 {x} {y}" for x, y in zip(around, around[1:])] + [f"3 {x} {y} {z}" for x, y, z in zip(around, around[1:], around[2:])]
    if lexical:
        low = [NUMBERS.sub("#", w.lower().translate(READ_AS)) for w in words]
        names += [f"w {x} {y}" for x, y in zip(low, low[1:])] + [f"ww {x} {y} {z}" for x, y, z in zip(low, low[1:], low[2:])]
    return list({zlib.crc32(x.encode()) & ((1 << LINE_BITS) - 1) for x in names})


def made_header(rng: np.random.Generator, words: list[str]) -> str:
    """A running header as pages have them: a title of such words with a page number, a volume, authors or a remark, in some style."""
    pick = lambda n: [words[k] for k in rng.integers(0, len(words), n)]
    title = " ".join(w.title() if k == 0 or rng.random() < 0.6 else str(rng.choice(["of", "in", "on", "and", "for", "the"])) if rng.random() < 0.5 else w for k, w in enumerate(pick(int(rng.integers(2, 7)))))
    name, number = pick(1)[0].title(), str(rng.integers(1, 400))
    who = str(rng.choice([f"{name} et al.", f"{name} and {pick(1)[0].title()}", f"{name}-{pick(1)[0]}-{rng.integers(1980, 2030)}", f"{name}-{pick(1)[0]}-{rng.integers(1980, 2030)} et al."]))
    styles = (
        f"{title} {number}", f"{title.upper()} {number}", f"{title.upper()}, {rng.choice(['VOL.', 'NO.', 'ISSUE'])} {number}", f"{title}, {rng.choice(['Vol.', 'No.', 'Issue'])} {number}", f"{who} / {title} {number}", f"{who} / {title}",
        f"{who}, {title} {number}", f"{who} – {' '.join(pick(int(rng.integers(2, 5))))}", " ".join(title.upper().replace(" ", "  ")),
    )
    header = styles[rng.integers(0, len(styles))]
    return f"{rng.integers(1, 400)}   {header}" if rng.random() < 0.25 else header


def wrapped(text: str, width: int) -> list[str]:
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return [*out, line] if line else out


def _perceptron(examples: list[tuple[list[int], int]], rng: np.random.Generator) -> np.ndarray:
    weights, later, step = np.zeros(1 << LINE_BITS), np.zeros(1 << LINE_BITS), 1
    for _ in range(LINE_EPOCHS):
        for k in rng.permutation(len(examples)):
            f, y = examples[k]
            if y * weights[f].sum() <= 0:
                weights[f] += y
                later[f] += y * step
            step += 1
    return (weights - later / step).astype(np.float32)


def page_lines(text: str) -> list[tuple[str, bool, bool, float]]:
    """Lines that may be a running header: stripped, whether first and last of the record, and the record's median width of a line."""
    lines = [x.strip() for x in text.split("\n")]
    sizes = sorted(len(x) for x in lines if x)
    width = sizes[len(sizes) // 2] if sizes else 1
    return [(x, k == 0, k == len(lines) - 1, width) for k, x in enumerate(lines) if x and len(lines) > 1]


def train_furniture(texts: list[str], scans: list[str], seed: int = 7) -> tuple[np.ndarray, frozenset[str]]:
    """Weights of the furniture model, and the kinds of character with which a header begins.

    Two views of a line train each other. Shapes and places are learned on wrapped clean texts against made headers; lines of
    scanned pages that they are sure about (the upper SURE_HEADER of the headers, the lower SURE_TEXT of the others) then take the place
    of these examples and teach the words of this collection's headers. Without clean texts no line is a header.
    """
    rng = np.random.default_rng(seed)
    words = sorted({w.lower() for t in texts[:1000] for w in re.findall(CLEAN_WORD, t) if len(w) > 3})
    begins: set[str] = set()
    examples: list[tuple[tuple[str, bool, bool, float], int]] = []
    for t in texts[:3000] if words else ():
        width = int(rng.integers(40, 95))
        examples += [(x, -1) for x in page_lines("\n".join(wrapped(t, width)))]
        parts = made_header(rng, words).split(" ")
        k = int(rng.integers(0, len(parts)))
        if rng.random() < 0.4 and parts[k].isalpha() and (c := corrupt(parts[k].lower(), rng)):
            parts[k] = c[0].title() if parts[k][0].isupper() else c[0]
        header, place = " ".join(parts), rng.random()
        begins.add(header.translate(SHAPES)[0])
        examples.append(((header, place < 0.1, place > 0.85, width), 1))
    shape = _perceptron([(line_features(*x, False), y) for x, y in examples], rng)
    lines = [x for t in scans for x in page_lines(t) if x[0].translate(SHAPES)[0] in begins and not is_page_number(x[0])]
    margin = np.array([shape[line_features(*x, False)].sum() for x in lines], np.float32)
    if (margin > 0).any() and (margin <= 0).any():
        high, low = np.quantile(margin[margin > 0], 1 - SURE_HEADER), np.quantile(margin[margin <= 0], SURE_TEXT)
        examples = [(x, 1 if m > 0 else -1) for x, m in zip(lines, margin, strict=True) if m >= high or m <= low]
    return _perceptron([(line_features(*x, True), y) for x, y in examples], rng), frozenset(begins)


def is_page_number(line: str) -> bool:
    return len(line) <= 14 and bool(PAGE_NUMBER.fullmatch(line))


CUT = re.compile(r"[^\W\d_][-‐‑¬­][ \t]*$")


def clean_lines(text: str, furniture: tuple[np.ndarray, frozenset[str]]) -> tuple[list[str], set[str]]:
    """Lines of the running text, and the kinds of furniture found."""
    weights, begins = furniture
    kinds: set[str] = set()
    lines = text.split("\n")
    if len(lines) == 1:
        return lines, kinds
    kept, width = [], 0.0
    for k, line in enumerate(lines):
        s = line.strip()
        if s:
            if is_page_number(s):
                kinds.add("page")
                continue
            if s[0].translate(SHAPES) in begins:
                if not width:
                    sizes = sorted(len(x.strip()) for x in lines if x.strip())
                    width = sizes[len(sizes) // 2]
                if weights[line_features(s, k == 0, k == len(lines) - 1, width, True)].sum() > 0:
                    kinds.add("header")
                    continue
        kept.append(line)
    return kept, kinds


def join_features(left: str, right: str, clean: frozenset[str], known: bool = True) -> list[int]:
    """Hashed features of the two sides of a hyphen at a line end.

    known: whether clean texts are asked for the left side and for both together, too; for names and rare words they don't tell.
    """
    low, r = left.lower(), right.lower()
    flags = "".join(str(int(asked and w in clean)) for w, asked in ((low + r, known), (low, known), (r, True)))
    names = (
        "bias", f"whole {r}" if len(r) < 5 else "long", f"first {r[:3]}", f"last {low[-3:]}", f"cross {low[-2:]}|{r[:2]}", f"touch {low[-1:]}|{r[:1]}", f"more {low[-3:]}|{r[:1]}", f"less {low[-1:]}|{r[:3]}",
        f"case {right[:1].isupper()} {left.isupper()}", f"sizes {min(len(low), 4)} {min(len(r), 4)}", f"flags {flags}", f"right {flags[2]} {min(len(r), 5)}",
    )
    return [_place(n) for n in names]


def _place(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << JOIN_BITS) - 1)


def train_joiner(texts: list[str], clean: frozenset[str], seed: int = 7) -> np.ndarray:
    """Weights of the joiner: an averaged perceptron on cut words (join) and on neighbouring words (keep) of clean texts."""
    rng = np.random.default_rng(seed)
    examples: list[tuple[list[int], int]] = []
    for t in texts:
        words = re.findall(CLEAN_WORD, t)
        for k in rng.permutation(len(words) - 1)[:PAIRS_A_TEXT] if len(words) > 1 else ():
            known = bool(rng.random() < 0.5)  # words of scans are often none of the clean ones
            examples.append((join_features(words[k], words[k + 1], clean, known), -1))
            w = words[k]
            if rng.random() < 0.2 and (c := corrupt(w, rng)):
                w = c[0]
            if len(w) >= 5:
                at = int(rng.integers(2, len(w) - 1))
                examples.append((join_features(w[:at], w[at:], clean, known), 1))
    weights, later, step = np.zeros(1 << JOIN_BITS), np.zeros(1 << JOIN_BITS), 1
    weights[_place("bias")] = 1.0  # without clean texts to learn from, all but capitals are joined
    weights[[_place(f"case True {x}") for x in (True, False)]] = -2.0
    for _ in range(JOIN_EPOCHS):
        for k in rng.permutation(len(examples)):
            f, y = examples[k]
            if y * weights[f].sum() <= 0:
                weights[f] += y
                later[f] += y * step
            step += 1
    return (weights - later / step).astype(np.float32)


#: Size of the joiner, rounds of its training, and pairs of words it takes of a text.
JOIN_BITS, JOIN_EPOCHS, PAIRS_A_TEXT = 16, 3, 2
RIGHT_SIDE = re.compile(r"[|!\d]?[^\W\d_]+")
LEFT_SIDE = re.compile(r"[^\W_]+$")


def join_lines(lines: list[str], joiner: np.ndarray, clean: frozenset[str] = frozenset()) -> tuple[str, bool]:
    """One paragraph of the lines, and whether a word had been cut in two at a line end."""
    parts: list[str] = []
    cut = False
    for line in lines:
        s = line.strip()
        if not s:
            continue
        if parts and CUT.search(parts[-1]):
            right, left = RIGHT_SIDE.match(s), LEFT_SIDE.search(parts[-1].rstrip()[:-1])
            if right and left and joiner[join_features(left.group(), right.group(), clean)].sum() > 0:
                parts[-1], cut = parts[-1].rstrip()[:-1], True
                parts.append(s)
                continue
        parts.append(" " + s if parts else s)
    return "".join(parts), cut


def repair_batch(texts: list[str], editor: Editor) -> Iterator[tuple[str, list[str]]]:
    """Repaired paragraph and kinds of noise of each text."""
    joined = []
    for t in texts:
        lines, kinds = clean_lines(t, editor.furniture)
        paragraph, cut = join_lines(lines, editor.joiner, editor.clean)
        if cut:
            kinds.add("hyphen")
        joined.append((paragraph, kinds))
    editor.learn({w for p, _ in joined for w in WORD.findall(p)})
    known = editor.known
    for paragraph, kinds in joined:
        new = WORD.sub(lambda m: known[m.group()], paragraph)
        if new != paragraph:
            kinds.add("misread")
        yield new, sorted(kinds)


def _repair(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = Editor(*broadcast.value)
        for b in batches:
            tables, ids = b.column("rec_table").to_pylist(), b.column("rec_id").to_pylist()
            texts, kinds = zip(*repair_batch(b.column("text").to_pylist(), editor), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(tables, pa.string()), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["rec_table", "rec_id", "paragraph", "noise"])

    return run


def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_table, rec_id, text) of records from scanned pages, or of unknown origin."""
    df = None
    for table in ("passages", "source_sentences"):
        part = load(spark, sf_dir, table).where("text is not null and (origin is null or origin = 'scan')")
        part = part.select(F.lit(table).alias("rec_table"), F.col(IDS[table]).alias("rec_id"), "text")
        df = part if df is None else df.unionByName(part)
    return df


def _doubted(broadcast):
    """Words whose reading depends on whether a clean text holds them: those that the editor changes, and plain readings of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = Editor(*broadcast.value)
        for b in batches:
            words = {w for t in b.column("text").to_pylist() for w in WORD.findall(join_lines(clean_lines(t, editor.furniture)[0], editor.joiner, editor.clean)[0])} - editor.known.keys()
            editor.learn(words)
            asked = {w.translate(SHORT) if CODE.fullmatch(w) else w.lower() for w in words if CODE.fullmatch(w) or editor.known[w] != w}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(asked - editor.clean), pa.string())], names=["word"])

    return run


def fitted(spark: SparkSession, sf_dir: str):
    """The editor's weights, as a broadcast of fixed size (2^BITS rows), and the words that clean texts hold.

    Weights are fitted on TRAIN_ROWS texts. Words of all other clean texts count as well, as far as they matter: those that the
    editor would change in a scan are joined with the vocabulary of all clean texts, and those met are told by a bit filter of
    bounded size.
    """
    df = None
    for table in ("passages", "source_sentences"):
        part = load(spark, sf_dir, table).where("origin = 'text'").select("text")
        df = part if df is None else df.unionByName(part)
    sample = bounded_texts(df, TRAIN_ROWS)
    weights, clean = train(sample)
    joiner = train_joiner(sample, clean)
    furniture = train_furniture(sample, bounded_texts(scan_records(spark, sf_dir), TRAIN_SCANS))
    model = spark.sparkContext.broadcast((weights, clean, joiner, furniture, None))
    if df.count() <= TRAIN_ROWS:
        return model
    doubted = spread(scan_records(spark, sf_dir).select("text")).mapInArrow(_doubted(model), "word string").distinct()
    every = df.select(F.explode(F.regexp_extract_all("text", F.lit(CLEAN_WORD), 0)).alias("word")).select(F.lower("word").alias("word")).distinct()
    met = cut_lineage(doubted.join(every, "word", "left_semi").select(F.xxhash64("word").alias("h")), "clean-words")
    held = bits.build(met, "h", 64 * max(met.count(), 1_000))  # sparse: a word that no clean text holds passes for one as good as never
    model.unpersist()
    return spark.sparkContext.broadcast((weights, clean, joiner, furniture, held))


def repaired(records: DataFrame, model) -> DataFrame:
    """(rec_table, rec_id, paragraph, noise): repaired text and kinds of noise of each record; null texts have none."""
    return spread(records.where("text is not null")).mapInArrow(_repair(model), "rec_table string, rec_id long, paragraph string, noise array<string>")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and kind of noise."""
    rows = repaired(scan_records(spark, sf_dir), fitted(spark, sf_dir))
    return rows.select("rec_table", "rec_id", F.explode("noise").alias("noise")).distinct()


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired paragraph of every scan record, one row per record."""
    rows = repaired(scan_records(spark, sf_dir), fitted(spark, sf_dir))
    return rows.groupBy("rec_table", "rec_id").agg(F.min(F.struct("paragraph", "noise")).alias("r")).select("rec_table", "rec_id", "r.paragraph", F.array_join("r.noise", ",").alias("noise"))
