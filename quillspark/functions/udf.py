"""Functions that built-in expressions can't express: stemming, snippets, offset-preserving masks, draft tokens.

All are pandas functions over Arrow batches; stemming runs over distinct words only and is joined back.
"""

from __future__ import annotations

import bisect
import functools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

VOWELS = "aeiou"


def _consonant(word: str, i: int) -> bool:
    c = word[i]
    if c in VOWELS:
        return False
    return c != "y" or i == 0 or not _consonant(word, i - 1)


def measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _short_end(stem: str) -> bool:
    n = len(stem)
    return n >= 3 and _consonant(stem, n - 1) and not _consonant(stem, n - 2) and _consonant(stem, n - 3) and stem[-1] not in "wxy"


# Suffixes of the classic algorithm of 1980 and their replacements.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _first_rule(word: str, rules, least: int) -> str:
    """The first rule whose suffix fits and leaves a stem of more than that measure; a rule that fits but leaves less is passed over."""
    for suffix, put in rules:
        if word.endswith(suffix) and measure(word[: len(word) - len(suffix)]) > least:
            return word[: len(word) - len(suffix)] + put
    return word


def stem(word: str) -> str:
    """Porter stem; words of at most two letters stay as they are."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _first_rule(_first_rule(w, STEP2, 0), STEP3, 0)
    if w.endswith(("sion", "tion")) and measure(w[:-3]) > 1:
        w = w[:-3]
    else:
        w = _first_rule(w, ((s, "") for s in STEP4), 1)
    if w.endswith("e"):
        base = w[:-1]
        m = measure(base)
        if m > 1 or (m == 1 and not _short_end(base)):
            w = base
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


@functools.lru_cache(100_000)
def stem_once(word: str) -> str:
    return stem(word)


def stem_udf():
    @F.pandas_udf(StringType())
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stem(w) if w is not None else None)

    return run


def stems_udf():
    """Stems of an array of words, in order; a word that comes again is not stemmed again."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: [stem_once(w) for w in ws] if ws is not None else None)

    return run


def stemmed_vocabulary(words: DataFrame, column: str) -> DataFrame:
    """(word, stem) of the distinct words of a column; joined back by the word, each word is stemmed once."""
    v = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    return v.withColumn("stem", stem_udf()("word"))


def snippet(text: str, terms: list[str], width: int = 300, most: int = 1) -> list[str]:
    """The windows of a text with most different terms, without overlap, in the order of the text; none without a term."""
    low = (text or "").lower()
    anchors = sorted({m.start() for t in set(terms) for m in list(re.finditer(re.escape(t.lower()), low))[:500]}) if low else []
    scored = []
    for a in anchors:
        s = max(0, a - width // 4)
        part = low[s : s + width]
        scored.append((-sum(t.lower() in part for t in set(terms)), s))
    chosen: list[int] = []
    for _, s in sorted(scored):
        if len(chosen) < most and all(abs(s - c) >= width for c in chosen):
            chosen.append(s)
    return [" ".join(text[s : s + width].split()) for s in sorted(chosen)]


def snippet_udf(terms: list[str], width: int = 300, most: int = 1):
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, terms, width, most))

    return run


FENCE = re.compile(r"```.*?```|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\1\}", re.DOTALL)
INLINE = re.compile(r"`[^`\n]+`")
REFERENCES = re.compile(r"^#{1,6}\s*(?:\d+(?:\.\d+)*[.)]?\s*)?References\s*$", re.IGNORECASE | re.MULTILINE)


def mask_code(text: str) -> str:
    """Code as spaces of the same length, line ends kept, so that offsets hold."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    return INLINE.sub(blank, FENCE.sub(blank, text))


def mask_for_scan(text: str) -> str:
    """As mask_code, and everything from the heading of the references on."""
    masked = mask_code(text)
    m = REFERENCES.search(masked)
    return masked if m is None else masked[: m.start()] + re.sub(r"[^\n]", " ", masked[m.start() :])


def mask_udf():
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask_for_scan(t) if t is not None else None)

    return run


QUOTE = re.compile(r'"[^"]{2,}"|“[^”]{2,}”|^>.*$', re.MULTILINE)
TOKEN = StructType([StructField("word", StringType()), StructField("paragraph", IntegerType()), StructField("quoted", IntegerType()), StructField("char", IntegerType()), StructField("char_end", IntegerType())])


def draft_tokens(text: str) -> list[tuple[str, int, int, int, int]]:
    """Words of a draft with paragraph, whether they stand in a quotation, and offsets; code and references are left out."""
    masked = mask_for_scan(text or "")
    quotes = [(m.start(), m.end()) for m in QUOTE.finditer(masked)]
    breaks = [m.end() for m in re.finditer(r"\n\s*\n", masked)]
    out, k = [], 0
    for m in re.finditer(r"[a-z0-9]+", masked.lower() if len(masked.lower()) == len(masked) else "".join(c.lower() if len(c.lower()) == 1 else c for c in masked)):
        while k < len(quotes) and quotes[k][1] <= m.start():
            k += 1
        quoted = k < len(quotes) and quotes[k][0] <= m.start()
        out.append((m.group(), bisect.bisect_right(breaks, m.start()), int(quoted), m.start(), m.end()))
    return out


def draft_tokens_udf():
    @F.pandas_udf(ArrayType(TOKEN))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(draft_tokens)

    return run
