"""Units of a text: sentences, blocks, paragraphs, sections, claims and the citations in them.

Everything works on (key, text) rows; a unit lies within one text, so no window or list is longer than a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# What a stop doesn't end a sentence after, and where one may follow.
ABBREVIATIONS = ("Fig.", "Sect.", "Eq.", "Ref.", "e.g.", "i.e.", "cf.")
SENTENCE_END = r"(?<!\b[A-Z]\.)" + "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')})" for a in ABBREVIATIONS) + r"(?<=[.!?])(\s+)(?=[A-Z\[(])"
# Lines that open a block of their own, lines that are one, and lines that carry no claim.
OPENS_BLOCK = r"^\s*(?:[-*+]|[0-9]+[.)])\s|^\s*\||^#{1,6}\s|^\\(?:sub)*section\b|^\\item\b"
STANDS_ALONE = r"^\s*\|.*\|\s*$|^#{1,6}\s|^\\(?:sub)*section\b"
HEADING = r"^#{1,6}\s|^\\(?:sub)*section\b"
NO_CLAIM = r"^#{1,6}\s|^\\(?:sub)*section\b|^\s*(?:\*\*)?(?:Figure|Table|Fig\.)\s+[0-9]|^\s*(?:<!--|%)"
ROW, RULE = r"^\s*\|", r"^\s*\|[\s:|-]+\|\s*$"
REFERENCE_HEADING = r"(?i)^#{1,6}\s*(?:[0-9.]+\s*)?(?:references|bibliography)\s*$"
MARKER = r"<!--\s*single-source:\s*(.*?)\s*-->"
BREAK = "\u0001"


def marked(text: Column) -> Column:
    """The text with a mark after each sentence, before the white space that follows it."""
    return F.regexp_replace(text, SENTENCE_END, BREAK + "$1")


def sentences(text: Column) -> Column:
    """Sentences of a text, white space at either end off; an empty text is one empty sentence."""
    return F.transform(F.split(marked(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))), BREAK), lambda s: F.regexp_replace(s, r"^\s+", ""))


def sentence_spans(text: Column) -> Column:
    """(start, end) of each sentence that isn't blank, as offsets into the text itself."""
    parts = F.split(marked(text), BREAK)
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p))
    lead = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))
    spans = F.transform(parts, lambda p, i: F.struct((before(i) + lead(p)).alias("start"), (before(i) + F.length(F.regexp_replace(p, r"\s+$", ""))).alias("end")))
    return F.filter(spans, lambda s: s["start"] < s["end"])


def lines(texts: DataFrame, key: str, text: str, body: bool = True) -> DataFrame:
    """(key, line, value) of every line from 1; with body only up to the heading of the references."""
    rows = texts.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "value")).select("key", (F.col("pos") + 1).alias("line"), "value")
    if not body:
        return rows
    cut = F.min(F.when(F.col("value").rlike(REFERENCE_HEADING), F.col("line"))).over(Window.partitionBy("key"))
    return rows.withColumn("cut", cut).where("cut is null or line < cut").drop("cut")


def blocks(rows: DataFrame, subdivide: bool = True) -> DataFrame:
    """(key, start, end, first, raw, text) of blocks between blank lines; with subdivide a table row, an item or a heading is its own.

    rows: (key, line, value). text is the block in one line, without its marker; first its first line.
    """
    w = Window.partitionBy("key").orderBy("line")
    blank = F.trim(F.translate("value", "\t\f\r", "   ")) == ""
    before = F.lag("value").over(w)
    opens = before.isNull() | (F.trim(F.translate(before, "\t\f\r", "   ")) == "")
    if subdivide:
        opens = opens | F.col("value").rlike(OPENS_BLOCK) | before.rlike(STANDS_ALONE)
    cut = rows.withColumn("blank", blank).withColumn("opens", (opens & ~blank).cast("int"))
    numbered = cut.withColumn("block", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not blank")
    one = F.array_sort(F.collect_list(F.struct("line", "value")))
    out = numbered.groupBy("key", "block").agg(F.min("line").alias("start"), F.max("line").alias("end"), one.alias("l"))
    return out.select("key", "start", "end", F.col("l")[0]["value"].alias("first"), F.transform("l", lambda x: x["value"]).alias("raw")).withColumn("text", block_text(F.col("raw")))


def block_text(raw: Column) -> Column:
    """A block's lines as one string: markers of items and headings off, the cells of a row joined by ' -- '."""
    joined = F.array_join(F.transform(raw, lambda v: F.trim(F.regexp_replace(v, r"[\s]+", " "))), " ")
    plain = F.regexp_replace(joined, r"^(?:[-*+]|[0-9]+[.)]|#{1,6})\s+", "")
    cells = F.filter(F.transform(F.split(joined, r"\|"), lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike("^:?-+:?$"))
    return F.when(joined.startswith("|"), F.array_join(cells, " -- ")).otherwise(plain)


def claims(rows: DataFrame) -> DataFrame:
    """(key, line, number, text, cites, block_cites) of every sentence that may carry a claim. rows: (key, line, value)."""
    b = blocks(rows)
    after = F.lead("first").over(Window.partitionBy("key").orderBy("start"))
    header = F.col("first").rlike(ROW) & F.coalesce(after.rlike(RULE), F.lit(False)) | F.col("first").rlike(RULE)
    kept = b.withColumn("header", header).where(~F.col("first").rlike(NO_CLAIM) & ~F.col("header") & (F.col("text") != ""))
    cites = lambda c: F.size(T.cited_keys(c)) > 0
    out = kept.select("key", F.col("start").alias("line"), cites(F.col("text")).alias("block_cites"), F.posexplode(sentences(F.col("text"))).alias("pos", "text"))
    return out.select("key", "line", (F.col("pos") + 1).alias("number"), "text", cites(F.col("text")).alias("cites"), "block_cites")


def unit_rows(rows: DataFrame, kind: str) -> DataFrame:
    """(key, line, keys, declared) of paragraphs, sections or the whole document; keys distinct and sorted, declared the reason that a
    marker gives for resting on one source (null without one, or if it is blank)."""
    if kind == "paragraph":
        b = blocks(rows, subdivide=False)
    else:
        w = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        section = F.sum(F.col("value").rlike(HEADING).cast("int")).over(w) if kind == "section" else F.lit(0)
        b = rows.withColumn("section", section).groupBy("key", "section").agg(F.min("line").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("raw"))
    text = F.array_join("raw", "\n")
    declared = F.nullif(F.regexp_extract(text, MARKER, 1), F.lit(""))
    prose = F.trim(F.regexp_replace(text, MARKER, ""))
    return b.where(prose != "").select("key", F.col("start").alias("line"), F.array_sort(F.array_distinct(T.cited_keys(text))).alias("keys"), declared.alias("declared"))


def citations_in_lines(rows: DataFrame) -> DataFrame:
    """(key, line, citekey): every citation with its line, repeats of a line once."""
    return rows.select("key", "line", F.explode(F.array_distinct(T.cited_keys(F.col("value")))).alias("citekey"))


def in_intervals(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (key, line, ...) with the start of the first interval (key, start, end) that holds the line, null without one."""
    i = intervals.select(F.col("key").alias("i_key"), "start", "end")
    joined = points.join(i, (points["key"] == i["i_key"]) & (points["line"] >= i["start"]) & (points["line"] <= i["end"]), "left")
    return joined.groupBy(*points.columns).agg(F.min("start").alias("start"))


def source_windows(words: Column, size: int = 20, stride: int = 10) -> Column:
    """Windows of that many words every stride words; the last words once more if the stride doesn't divide their number."""
    n = F.size(words)
    cuts = F.transform(F.sequence(F.lit(0), n - size, F.lit(stride)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    tail = F.when(n % stride != 0, F.array(F.array_join(F.slice(words, n - size + 1, size), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.array_join(words, " "))).otherwise(F.concat(cuts, tail))


def consecutive_runs(hits: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, start, end): maximal runs of consecutive places, end exclusive."""
    w = Window.partitionBy(*keys).orderBy(pos)
    rows = hits.select(*keys, pos).distinct().withColumn("island", F.col(pos) - F.row_number().over(w))
    return rows.groupBy(*keys, "island").agg(F.min(pos).cast("long").alias("start"), (F.max(pos) + 1).cast("long").alias("end")).drop("island")


def longest_key_run(rows: DataFrame, group: list[str], at: str, keys: str) -> DataFrame:
    """(group, run): longest streak of consecutive rows with the same single key; rows with none or several break it."""
    w = Window.partitionBy(*group).orderBy(at)
    one = F.when(F.size(F.array_distinct(keys)) == 1, F.element_at(keys, 1))
    r = rows.withColumn("one", one).withColumn("opened", (~F.coalesce(F.col("one") == F.lag("one").over(w), F.lit(False))).cast("int"))
    r = r.withColumn("streak", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*group, "streak").agg(F.count("one").alias("n")).groupBy(*group).agg(F.max("n").alias("run"))


# ---------------------------------------------------------------- registries, markers and scalar forms


def definitions(texts: DataFrame) -> DataFrame:
    """(key, term, kind, definition) of the bullets '- **term**: definition'; a term in code or maths is a notation."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[-*+] \*\*(.+?)\*\*\s*[:–—-]\s*(.*)$"), 0)).alias("b")
    rows = texts.select("key", found)
    term = F.regexp_extract("b", r"^[-*+] \*\*(.+?)\*\*", 1)
    kind = F.when(term.rlike(r"^[`$].*[`$]$"), "notation").otherwise("term")
    return rows.select("key", F.trim(term).alias("term"), kind.alias("kind"), F.trim(F.regexp_extract("b", r"^[-*+] \*\*.+?\*\*\s*[:–—-]\s*(.*)$", 1)).alias("definition"))


def registry_prose(text: Column) -> Column:
    """The text before its references, without bullets of definitions."""
    return F.array_join(F.filter(F.split(T.before_references(text), "\n"), lambda v: ~v.rlike(r"^[-*+] \*\*.+?\*\*\s*[:–—-]")), "\n")


def citing_claims(texts: DataFrame) -> DataFrame:
    """(key, claim, citekeys) of every sentence with a citation, paragraph by paragraph."""
    paragraphs = texts.select("key", F.explode(F.split(registry_prose(F.col("text")), r"\n\s*\n")).alias("p"))
    rows = paragraphs.select("key", F.explode(sentences(F.col("p"))).alias("s")).withColumn("citekeys", T.cited_keys(F.col("s")))
    return rows.where(F.size("citekeys") > 0).select("key", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("claim"), "citekeys")


def anchors(text: Column) -> Column:
    """Labels that a text offers, of either markup, each once."""
    return F.array_union(F.regexp_extract_all(text, F.lit(r"\{#([A-Za-z0-9][A-Za-z0-9._:-]*)\}"), 1), F.regexp_extract_all(text, F.lit(r"\\label\{([^}]+)\}"), 1))


def registry_excerpt(terms: DataFrame, unit: str) -> DataFrame:
    """Terms that other units define."""
    return terms.where(F.col("key") != unit)


def registry_coverage(units: DataFrame) -> DataFrame:
    """One row: accepted units, all units, and the skipped ones in order. units: (unit, accepted); as many as chapters of a book."""
    return units.agg(F.count_if("accepted").alias("accepted"), F.count("*").alias("units"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.col("unit")))), ", ").alias("skipped"))


def setting(text: Column, name: str) -> Column:
    """The value of a line '- name: value', null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^- {name}:[ \t]*(.*)$", 1)), F.lit(""))


def resolved(*ladder: tuple[str, Column]) -> Column:
    """struct(value, source): the first rung with a value, and its name; 'nothing' without one."""
    value = F.coalesce(*(c for _, c in ladder))
    source = F.lit("nothing")
    for name, c in reversed(ladder):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return F.struct(value.alias("value"), source.alias("source"))


def recorded_corpus(scope: Column) -> Column:
    """struct(count, digest) that a scope records as 'corpus: n keys, digest d'; null without it."""
    n, d = F.regexp_extract(scope, r"corpus: ([0-9]+) keys, digest ([0-9a-f]+)", 1), F.regexp_extract(scope, r"corpus: ([0-9]+) keys, digest ([0-9a-f]+)", 2)
    return F.when(n != "", F.struct(n.cast("int").alias("count"), d.alias("digest")))


def separated_keys(text: Column) -> Column:
    """Keys in backticks or after an at sign that hold a separator: names of entries rather than words."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[`@]([A-Za-z][A-Za-z0-9_-]*)"), 1), lambda k: k.rlike("[_-]"))


# Endings that tell British from American spelling.
DIALECTS = {"en-GB": "(?:isation|ise[sd]?|our|tre|ogue)$", "en-US": "(?:ization|ize[sd]?|or|ter|og)$"}


def _ends(pattern: str):
    return lambda w: w.rlike(pattern)


def dialect(text: Column) -> Column:
    """The dialect with more words of its spelling, null on a tie."""
    a, b = (F.size(F.filter(T.words(text), _ends(p))) for p in DIALECTS.values())
    return F.when(a > b, "en-GB").when(b > a, "en-US")


def without_rules(rules: DataFrame, unwanted: list[str]) -> DataFrame:
    return rules.where(~F.col("rule").isin(*unwanted)) if unwanted else rules


def capped_alignments(alignments: DataFrame, per_section: int = 1) -> DataFrame:
    """The strongest alignments of each section, at most per_section of a section and source, none that overlaps a stronger one.

    alignments: (section, source, score, draft_start, draft_end); a section has a few per source of its shortlist.
    """
    import pandas as pd

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for k, r in rows.sort_values(["score", "source", "draft_start"], ascending=[False, True, True]).iterrows():
            clash = any(r.draft_start < rows.loc[j].draft_end and rows.loc[j].draft_start < r.draft_end for j in kept)
            if not clash and sum(rows.loc[j].source == r.source for j in kept) < per_section:
                kept.append(k)
        return rows.loc[kept]

    return alignments.groupBy("section").applyInPandas(keep, alignments.schema)


def alignment_keys(alignments: DataFrame) -> DataFrame:
    """(section, pos, keys): sources aligned with each place of a section, the whole aligned span."""
    rows = alignments.withColumn("pos", F.explode(F.sequence("draft_start", F.col("draft_end") - 1)))
    return rows.groupBy("section", "pos").agg(F.array_sort(F.collect_set("source")).alias("keys"))
