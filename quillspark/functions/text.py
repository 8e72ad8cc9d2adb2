"""Column expressions on text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop lists of ranked search and of passage scoring.
BM25_STOP = ("a", "an", "the", "of", "on", "in", "for", "and", "to", "with", "is", "are", "be", "this", "that", "as", "by", "from", "at")
PASSAGE_STOP = (*BM25_STOP, "it", "its", "can", "has", "have", "was", "were", "which", "such", "these", "those", "their", "than", "then", "but", "not", "also")
# The stop list of the skip-gram tier.
SKIP_STOP = tuple("""
a an the and or but if then else when while as of to in on at by for with about against between into through during before
after above below from up down out off over under again further once here there all any both each few more most other some such
no nor not only own same so than too very s t can will just don should now is am are was were be been being have has had having
do does did doing would could might must shall this that these those it its it's he she they we you i him her them us our your
their his ours yours theirs myself yourself himself herself itself ourselves yourselves themselves what which who whom
""".split())
# The bibliography fields that the ledger keeps.
KEPT_FIELDS = tuple("author editor journal journaltitle booktitle series volume number pages publisher institution school address location edition howpublished organization eprint eprinttype archiveprefix primaryclass".split())
CITE_MARKER = r"\[@[^\]]+\]|\\cite[tp]?\{[^}]*\}"


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def bm25_tokens(text: Column) -> Column:
    """Words of more than two letters that are not in the stop list of ranked search."""
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*BM25_STOP))


def distinctive(text: Column) -> Column:
    """Distinct words of more than two letters outside the stop list of passage scoring."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*PASSAGE_STOP)))


def ngrams(tokens: Column, n: int) -> Column:
    """Every run of n tokens joined by spaces; an empty array for fewer than n."""
    if n < 1:
        raise ValueError("n must be at least 1")
    count = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))


def ngram_hashes(tokens: Column, n: int) -> Column:
    """As ngrams, by 64-bit hashes of the runs: an eighth of the bytes, and no strings are built."""
    if n < 1:
        raise ValueError("n must be at least 1")
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: word_digest(F.slice(tokens, i, n)))).otherwise(F.array().cast("array<bigint>"))


def normal_title(title: Column) -> Column:
    """Without braces, lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.translate(title, "{}", "")), "[^a-z0-9]+", " "))


def normal_doi(doi: Column) -> Column:
    """Trimmed, lower case, without resolver address and label."""
    d = F.lower(F.trim(doi))
    d = F.regexp_replace(d, r"^https?://(dx\.)?doi\.(org|example)/", "")
    return F.trim(F.regexp_replace(d, r"^doi:", ""))


def claim_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def finding_id(*parts: Column) -> Column:
    """First twelve hexadecimal digits of the digest of the parts, joined by the zero character."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 12)


def pages(text: Column) -> Column:
    """Pages of a parsed text: control characters as spaces, cut at form feeds."""
    return F.split(F.regexp_replace(text, "[\\x00-\\x08\\x0e-\\x1f]", " "), "\f")


def page_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"\s+$", "")
    return F.length(trimmed) - F.length(F.replace(trimmed, F.lit("\f"), F.lit(""))) + 1


def alphabetic(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0)


def run_together_ratio(text: Column) -> Column:
    """Share of alphabetic tokens of more than 20 letters; null without tokens."""
    t = alphabetic(text)
    return F.size(F.filter(t, lambda x: F.length(x) > 20)) / F.nullif(F.size(t), F.lit(0))


def sentence_text(text: Column) -> Column:
    """Without citation markers, runs of spaces as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CITE_MARKER, " "), " {2,}", " "))


def cited_keys(text: Column) -> Column:
    """Citation keys of a text in order, repeats included."""
    return F.regexp_extract_all(text, F.lit("@([A-Za-z][A-Za-z0-9_-]*)"), 1)


# The heading from which on a text is back matter, and lines that are no content. The same in Java's and RE2's syntax.
BACK_MATTER = r"(?is)^(.*\n|)[ \t]*#{1,6}[ \t]*\**[ \t]*(?:references|bibliography|works cited)\b.*$"
NOISE_LINE = r"(?i)^[ \t\f]*(?:\S+@\S+\.\S+|(?:https?://|www\.|doi:|10\.[0-9]{4}/)\S*|(?:downloaded from|licensed under|all rights reserved|copyright|\(c\)[ \t]*[0-9]{4}|©).*|[0-9]{1,4})[ \t\f]*$"


def before_references(text: Column) -> Column:
    """The text before the last line that is a heading of back matter; all of it without one."""
    return F.regexp_replace(text, BACK_MATTER, "$1")


def content_text(text: Column) -> Column:
    """Without the back matter from the last heading of references on, and without lines that are an address, a notice or a page
    number."""
    return F.array_join(F.filter(F.split(before_references(text), "\n"), lambda line: ~line.rlike(NOISE_LINE)), "\n")


def word_digest(tokens: Column) -> Column:
    """A 64-bit hash of a run of words."""
    return F.xxhash64(tokens)


def chunks(tokens: Column, size: int = 200, step: int = 160) -> Column:
    """Overlapping chunks of words; the last may lie inside the one before it. No chunk without words."""
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def collection_matches(collections: Column, wanted: str) -> Column:
    """Whether a path equals the wanted one or lies below it, case ignored."""
    target = wanted.lower()
    return F.coalesce(F.exists(collections, lambda c: (F.lower(c) == target) | F.lower(c).startswith(target + " > ")), F.lit(False))


def collection_ancestors(path: Column) -> Column:
    """The path and all paths above it."""
    parts = F.split(path, " > ")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), " > "))


def severity(quoted: Column, cites_source: Column, matched_words: Column) -> Column:
    return F.when(quoted & cites_source, "quoted").when(matched_words >= 15, "long").otherwise("short")


def band(score: Column) -> Column:
    return F.when(score < 0.20, "none").when(score < 0.50, "weak").otherwise("supported")


def citekey_problem(key: Column) -> Column:
    """Why a key can't name a file, or null."""
    stem = F.upper(F.substring_index(key, ".", 1))
    return (
        F.when(key.isNull() | (F.trim(key) == ""), "empty")
        .when(key.isin(".", ".."), "reserved")
        .when(key.rlike(r'[<>:"/\\|?*\x00-\x1f]'), "illegal character")
        .when(key.rlike(r"[. ]$"), "trailing dot or space")
        .when(stem.rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), "device name")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
