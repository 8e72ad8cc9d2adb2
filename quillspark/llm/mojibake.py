"""Problem 9: text decoded with a wrong character encoding.

Every suspect character is mapped back to the byte it had in a legacy encoding. An automaton over the structure of UTF-8 bytes,
written per encoding as a regular expression over its characters, finds the maximal well-formed multibyte spans, and only these
spans are decoded; text around them stays as it is. Encodings of two bytes a character are mapped back run by run, and the same
structure is sought in the bytes; a span ends where characters end. A decoded span must also be plausible: letters or marks of
the scripts in use, more than one of them where the span could be an accident. Decoding goes on until no span is left.

Bytes of a single-byte encoding read with another one have no multibyte structure. Such words are recognised by what they
show, and read again with the pair of encodings that makes letters of one script and case out of them. Replacement characters
mark what can't be restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import load, spread

#: Single-byte encodings through which UTF-8 is read by mistake, and encodings of two bytes.
SINGLE = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "cp1253", "cp1254", "mac_cyrillic")
DOUBLE = ("gbk", "cp932", "big5", "euc_jp")
#: (read with, written in): single-byte encodings mistaken for each other, by script.
LATIN_PAIRS = tuple((r, w) for w in ("cp1252", "cp1250", "iso8859_2") for r in ("cp850", "cp437", "mac_roman", "cp1252", "cp1250", "cp1251", "cp1253", "cp866", "koi8_r") if r != w and not {r, w} <= {"cp1250", "iso8859_2"})
GREEK_PAIRS = tuple((r, "cp1253") for r in ("cp1252", "cp1250", "cp1251", "cp850", "cp437", "mac_roman")) + (("cp1252", "iso8859_7"),)
CYRILLIC_PAIRS = (("cp1251", "koi8_r"), ("koi8_r", "cp1251")) + tuple((r, w) for w in ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic") for r in ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1252", "cp850", "cp437", "mac_roman") if r != w and {r, w} != {"cp1251", "koi8_r"})

#: Share of the letters of Russian text, in hundredths of a percent (fixed values).
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (1097, 845, 801, 735, 670, 626, 547, 473, 454, 440, 349, 321, 298, 281, 262, 201, 190, 174, 170, 165, 159, 144, 121, 97, 94, 73, 64, 48, 36, 32, 26, 4, 4), strict=True))
CLOSING = "…’”»“‘›—–"


@lru_cache
def byte_chars(encoding: str) -> dict[int, str]:
    """Character of each byte from 0x80; bytes without one stay control characters, as common decoders leave them."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


@lru_cache
def char_bytes(encoding: str) -> dict[int, int]:
    own = {ord(c): b for b, c in byte_chars(encoding).items()}
    return own | {c: c for c in range(0x80, 0xA0) if c not in own}


def _class(encoding: str, first: int, last: int) -> str:
    chars = {c for b, c in byte_chars(encoding).items() if first <= b <= last}
    if last <= 0xBF:
        chars |= {chr(b) for b in range(max(first, 0x80), min(last, 0x9F) + 1)}
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


@lru_cache
def automaton(encoding: str) -> re.Pattern[str]:
    """Maximal runs of well-formed UTF-8 sequences of two to four bytes, seen through an encoding."""
    more = _class(encoding, 0x80, 0xBF)
    shapes = (
        _class(encoding, 0xC2, 0xDF) + more,
        _class(encoding, 0xE0, 0xE0) + _class(encoding, 0xA0, 0xBF) + more,
        _class(encoding, 0xE1, 0xEF) + more + more,
        _class(encoding, 0xF0, 0xF4) + more + more + more,
    )
    return re.compile("(?:" + "|".join(shapes) + ")+")


LONE = re.compile(r"[¡-ſ‐-‧‰-›₠-₿℀-⅏←-⋿]")
#: What a decoded span may hold; a control character only as a byte of a sequence that was wrong twice.
SCRIPTS = re.compile(r"(?:[ƒˆ-˝ -ſΆ-ώЀ-џҐ-ґ؀-ۿऀ-ॿ฀-๿Ḁ-ỿ‐-⁯⁰-⋿─-◿　-ヿ㐀-鿿가-힯＀-￯\U0001f300-\U0001faff]|(?<=[À-ÿ‚-™Œœ])[\x80-\x9f])+")


#: Encodings whose lead bytes are capitals with accents: a span of letters alone is no accident there.
LETTER_LEADS = frozenset(("cp1252", "cp1250", "cp1254", "iso8859_2"))


#: Encodings of which a span of letters alone counts once the text holds spans that are none.
SURE_AFTER = frozenset(("cp1251", "cp1253", "iso8859_7", "cp437", "cp850", "mac_roman"))


def plausible(text: str, start: int, end: int, decoded: str, encoding: str, sure: bool = False) -> bool:
    """Whether a decoded span may replace [start, end) of the text."""
    if not SCRIPTS.fullmatch(decoded):
        return False
    if encoding not in LETTER_LEADS and not sure and text[start:end].isalpha():
        return False
    if len(decoded) > 1 and end - start > 3:
        return True
    before = text[start - 1] if start else " "
    if end - start == 2 and (text[start + 1] in CLOSING) and before.isupper():
        return False  # a capital word that ends in such a letter, and the mark that closes it
    if end - start == 2 and text[start : start + 1].isupper() and before.isupper() and text[end : end + 1].isupper():
        return text[start + 1] not in CLOSING and not text[start + 1].isalpha()
    return bool(LONE.fullmatch(decoded)) or (decoded == " " and text[start] in "ÂĂ¬┬Т") or end - start > 2


def decode_single(text: str, encoding: str) -> tuple[str, int]:
    """The text with its well-formed spans decoded, and the number of spans."""
    table, spans, sure = char_bytes(encoding), 0, False

    def put(m: re.Match[str]) -> str:
        nonlocal spans
        try:
            decoded = bytes(table[ord(c)] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        if not plausible(text, m.start(), m.end(), decoded, encoding, sure):
            return m.group()
        spans += 1
        return decoded

    new = automaton(encoding).sub(put, text)
    if spans >= 2 and encoding in SURE_AFTER:
        spans, sure = 0, True
        new = automaton(encoding).sub(put, text)
    return new, spans


WIDE = re.compile(r"[^\x00-\x7f]{2,}")
DENSE = re.compile("[\u2e80-\uffef]")
#: The automaton over bytes: sequences of UTF-8, and plain bytes that are halves of a two-byte character.
SEQUENCE = rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
ONE, SPAN = re.compile(SEQUENCE + rb"|[\x20-\x7e]"), re.compile(b"(?:" + SEQUENCE + b")(?:" + SEQUENCE + rb"|[\x20-\x7e])*")
#: What a run of bytes must hold to be looked at: two long sequences in a row, or four short ones.
HINT = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}){2}|(?:[\xc2-\xdf][\x80-\xbf]){4}|[\xf0-\xf4][\x80-\xbf]{3}")
PLAIN = re.compile(rb"[\x00-\x7f]")
#: Letters of two bytes make a span only if all of them are of one script.
ONE_SCRIPT = re.compile("(?:[Ѐ-ӿ]|[ -~])+|(?:[Ͱ-Ͽ]|[ -~])+|(?:[֐-׿]|[ -~])+|(?:[؀-ۿ]|[ -~])+|(?:[À-ɏ]|[ -~])+")


def bytes_of(run: str, encoding: str) -> Iterator[tuple[int, bytes, list[int]]]:
    """Maximal parts of a run that an encoding can write: first character, their bytes, and the byte at which each character starts."""
    begin, data, starts = 0, bytearray(), []
    for k, c in enumerate(run):
        try:
            piece = c.encode(encoding)
        except UnicodeEncodeError:
            if starts:
                yield begin, bytes(data), starts
            data, starts = bytearray(), []
            continue
        if not starts:
            begin = k
        starts.append(len(data))
        data += piece
    if starts:
        yield begin, bytes(data), starts


def decode_double(text: str, encoding: str) -> tuple[str, int, int]:
    """As decode_single, for encodings of two bytes: the maximal well-formed spans whose ends are ends of characters.

    Characters around a span stay as they are, so a garbled stretch may stand within correct text. A character at the end of a run
    that belongs to a span with one of its bytes only becomes a replacement character; elsewhere such characters stay. The third
    value counts spans that lost an end in this way.
    """
    spans = cut = 0
    least = 4  # letters of two bytes that make a span: fewer once the text holds such spans

    def put(m: re.Match[str]) -> str:
        nonlocal spans, cut
        run = m.group()
        if least == 4 and not HINT.search(run.encode(encoding, "replace")):
            return run
        out, done = [], 0
        for begin, data, starts in bytes_of(run, encoding):
            character = {b: begin + k for k, b in enumerate(starts)} | {len(data): begin + len(starts)}
            for span in SPAN.finditer(data):
                edges = [span.start() + x.start() for x in ONE.finditer(span.group())] + [span.end()]
                even = [e for e in edges if e in character]
                # a character that shares its bytes with other ones is given up where nothing else follows or precedes
                a = 0 if 0 < span.start() < max(starts[:2]) else even[0] if even else span.end()
                z = len(data) if starts[-1] < span.end() < len(data) else even[-1] if even else span.start()
                if a >= z:
                    continue
                decoded = data[a:z].decode("utf-8", "replace")
                wide = [c for c in decoded if c > "\x7f" and c != "\ufffd"]
                long = sum(c > "\u07ff" for c in wide)
                if not (HINT.search(data, a, z) or (least == 2 and not PLAIN.search(data, a, z))) or not (long >= least // 2 or (len(wide) >= least and not long and ONE_SCRIPT.fullmatch(decoded))) or not SCRIPTS.fullmatch("".join(wide)):
                    continue
                out += [run[done : character[a]], decoded]
                done = character[z]
                spans += 1
                cut += any(bool(SCRIPTS.fullmatch(x.decode("utf-8", "replace"))) for x in (data[span.start() : a], data[z : span.end()]) if x)
        return "".join([*out, run[done:]])

    new = WIDE.sub(put, text)
    if spans:
        spans, cut, least = 0, 0, 2
        new = WIDE.sub(put, text)
    return new, spans, cut


#: Letters with what a mistaken encoding puts between them: a capital or a symbol where a small letter belongs.
ODD_INSIDE = re.compile(r"[a-z][À-ÖØ-ÞŠŒŽŸ](?=[a-z]|$)|[a-zß-öø-ÿ][\u0080-¿×÷ˆ-˝–-›∀-◿†‡‰€™ﬁﬂΩπ∂∑∏∫√ƒµ](?=[a-z])|[a-z][А-Яа-яЁёΑ-ω](?=[a-z]|$)|^[А-яΑ-ω][a-z]{2}|(?<![^\s])[¡-¿÷∀-◿·](?=[a-z]{3})|[a-z]{2}[²-¿÷∀-◿]$")
LATIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿĀ-ž][a-zß-öø-ÿā-ž]*")
COMMON_LATIN = frozenset("äöüßéèêëàâçîïôùûáíóúñãõąćęłńśźżåæøœÄÖÜÉÈÊÀÂÇÎÔÁÍÓÚÑÃÕĄĆĘŁŃŚŹŻ")


def reread(word: str, read: str, written: str) -> str | None:
    """The word written in one encoding and read with another, as it was written; None if its characters don't allow it."""
    table = char_bytes(read)
    try:
        return bytes(ord(c) if c < "\x80" else table[ord(c)] for c in word).decode(written)
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(maxsize=65536)
def reread_latin(word: str, read: str, written: str) -> str | None:
    """A Latin word read with one encoding and written in another, restored; None for words that this pair can't have made."""
    w = reread(word, read, written)
    return w if w and w != word and LATIN_WORD.fullmatch(w) and all(c < "\x80" or c in COMMON_LATIN for c in w) else None


@lru_cache(maxsize=65536)
def is_odd(word: str) -> bool:
    return not word.isascii() and bool(ODD_INSIDE.search(word)) and any(reread_latin(word, *p) for p in LATIN_PAIRS)


GREEK_SEEN = re.compile(r"[À-ÿ¢¸¹º¼¾¿]{3,}")
GREEK_WORD = re.compile(r"[Α-ΡΣ-ΫΆΈ-Ώά-ώ]+")
ACCENT = re.compile("[άέήίόύώΐΰΆΈΉΊΌΎΏ]")
ALPHA = re.compile(r"[^\W\d_]{2,}")
CYRILLIC_SEEN = re.compile(r"[А-Яа-яЁё]+")


def _russian(word: str) -> float:
    """Mean log-likelihood of a word's letters, by hundredths of a percent; letters outside the alphabet are very rare."""
    from math import log

    return sum(log(RUSSIAN.get(c, 1) / 10_000) for c in word.lower()) / len(word)


#: Mean gain in log-likelihood a letter from which a reading of Russian words is better than what stands there.
RUSSIAN_GAIN = 0.3
RUSSIAN_WORD = re.compile("[А-ЯЁ]?[а-яё]+")


@lru_cache(maxsize=65536)
def reread_cyrillic(word: str) -> tuple[tuple[tuple[str, str], str, float], ...]:
    """Readings of a word as a Russian one: the pair of encodings, the word in proper case, and its gain over all letters."""
    now = _russian(word) if CYRILLIC_SEEN.fullmatch(word) else -9.0
    out = []
    for pair in CYRILLIC_PAIRS:
        w = reread(word, *pair)
        if w and w != word and RUSSIAN_WORD.fullmatch(w):
            out.append((pair, w, (_russian(w) - now) * len(w)))
    return tuple(out)


def russian_words(words: set[str]) -> dict[str, str]:
    """Words of a text restored by the one pair of encodings that gains most, if it gains enough over all words it can read."""
    gains: dict[tuple[str, str], float] = {}
    letters: dict[tuple[str, str], int] = {}
    read: dict[tuple[str, str], dict[str, str]] = {}
    for word in words:
        for pair, w, gain in reread_cyrillic(word):
            gains[pair] = gains.get(pair, 0.0) + gain
            letters[pair] = letters.get(pair, 0) + len(w)
            read.setdefault(pair, {})[word] = w
    most = max(map(len, read.values()), default=0)
    good = [p for p in gains if gains[p] >= RUSSIAN_GAIN * letters[p] and len(read[p]) >= max(3, 0.6 * most)]
    best = max((gains[p] / letters[p] for p in good), default=0.0)
    return next((read[p] for p in CYRILLIC_PAIRS if p in good and gains[p] >= 0.6 * best * letters[p]), {})


@lru_cache(maxsize=65536)
def reread_greek(word: str) -> str | None:
    for read, written in GREEK_PAIRS:
        w = reread(word, read, written)
        if w and GREEK_WORD.fullmatch(w) and any("α" <= c <= "ώ" for c in w):
            return w
    return None


PIECE = re.compile(r"[^\s\x21-\x40\[-`{-\x7f]+")
RUN = re.compile(r"[^\x00-\x7f]{2,}")


def reread_words(text: str) -> tuple[str, int]:
    """Words read with a wrong single-byte encoding, restored; the number of runs of them that carry enough evidence."""
    found = 0
    pieces = {p for w in set(text.split()) if not w.isascii() for p in PIECE.findall(w) if not p.isascii()}
    odd = {w for w in pieces if is_odd(w)}
    if odd:  # one pair of encodings for the whole text: the one that reads most of the odd words
        pair = max(LATIN_PAIRS, key=lambda p: sum(reread_latin(w, *p) is not None for w in odd))
        words = {w: n for w in pieces if (n := reread_latin(w, *pair)) and (w in odd or not LATIN_WORD.fullmatch(w))}
        text = PIECE.sub(lambda m: words.get(m.group(), m.group()), text)
        found += 1
        pieces = {p for w in set(text.split()) if not w.isascii() for p in PIECE.findall(w) if not p.isascii()}
    candidates = {g for p in pieces for g in ALPHA.findall(p) if len(g) > 2}
    greek = {g: w for g in candidates if GREEK_SEEN.fullmatch(g) and (w := reread_greek(g))}
    accented = sum(len(ACCENT.findall(w)) == 1 for w in greek.values())
    if len(greek) >= 3 and accented >= 0.6 * len(greek):  # a Greek word carries one accent
        hits = greek
    else:
        hits = russian_words({g for g in candidates if CYRILLIC_SEEN.fullmatch(g) or GREEK_SEEN.fullmatch(g)})
    if hits:
        found += 1
        text = ALPHA.sub(lambda m: hits.get(m.group(), m.group()), text)
    return text, found


def repair(text: str) -> tuple[str, bool, bool]:
    """Restored text, whether the text is affected, and whether all of it could be restored."""
    if text.isascii():
        return text, False, True
    text, affected, cut = decode_spans(text)
    new, words = reread_words(text)
    if words:
        text, _, more = decode_spans(new)
        affected, cut = True, cut + more
    lost = "\ufffd" in text
    return text, affected or lost, not lost and not cut


def decode_spans(text: str) -> tuple[str, bool, int]:
    """All spans of UTF-8 read with a wrong encoding decoded, round by round, until none is left (a text may be wrong more than once).

    Each round takes the encoding that explains most bytes. Every decoding makes the text shorter in bytes, so the rounds end. Also
    whether there was a span, and the number of spans with a lost end.
    """
    affected, cut = False, 0
    while probe := " ".join(set(RUN.findall(text))):  # spans lie within runs beyond ASCII; each distinct run is looked at once
        size = len(text.encode("utf-8", "surrogatepass"))
        best, most, lost = text, 0, 0
        for encoding in SINGLE:
            if automaton(encoding).search(probe):
                new, spans = decode_single(text, encoding)
                gain = size - len(new.encode("utf-8", "surrogatepass")) if spans else 0
                if gain > most:
                    best, most, lost = new, gain, 0
        if DENSE.search(probe):
            for encoding in DOUBLE:
                new, spans, ends = decode_double(text, encoding)
                gain = size - len(new.encode("utf-8", "surrogatepass")) if spans else 0
                if gain > most:
                    best, most, lost = new, gain, ends
        if not most:
            break
        text, affected, cut = best, True, cut + lost
    return text, affected, cut


SCHEMA = "doc_id long, repaired string, restored boolean"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            new, affected, whole = repair(t)
            if affected:
                rows.append((i, new, whole))
        if rows:
            ids, texts, whole = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(whole)], names=["doc_id", "repaired", "restored"])


def repaired(documents: DataFrame) -> DataFrame:
    """Affected documents with their restored text. Null, empty and plain ASCII texts are never affected and stay in the JVM."""
    return spread(documents.select("doc_id", "text").where(F.col("text").rlike(r"[^\x00-\x7f]"))).mapInArrow(_repair, SCHEMA)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one stretch that a wrong encoding made."""
    return repaired(load(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents, their text as far as it can be restored, and whether that is all of it."""
    return repaired(load(spark, sf_dir, "documents")).dropDuplicates(["doc_id"])
