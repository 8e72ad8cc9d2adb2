"""Operators on drafts: skip-grams, positions and their keys, contexts, allowlists, outlines, figures, acronyms, numbering."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from quillspark.functions import text as T
from quillspark.functions import udf
from quillspark.operators import overlap, topics

SKIP_N = 5
#: Ids of a section of vectors, and sources that a section is aligned with (a fixed value).
SECTION_IDS, SHORTLIST = 256, 5


def skipgrams(rows: DataFrame, key: str, text: str, n: int = SKIP_N) -> DataFrame:
    """(key, start, end, gram, size): n consecutive stems among every other word of a text.

    Families are told by the parity of the word's place in the text, before stop words leave; grams of both families share one
    space. Windows in which at least half the stems are numbers are left out. Words are stemmed once per distinct word.
    """
    words = rows.select(F.col(key).alias("key"), F.posexplode(T.words(F.col(text))).alias("pos", "word"))
    words = words.where(~F.col("word").isin(*T.SKIP_STOP))
    stems = words.join(udf.stemmed_vocabulary(words, "word"), "word")
    families = stems.groupBy("key", (F.col("pos") % 2).alias("family")).agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("s")).where(F.size("s") >= n)
    part = lambda i: F.slice("s", i, n)
    windows = F.transform(F.sequence(F.lit(1), F.size("s") - (n - 1)), lambda i: F.struct(part(i)[0]["pos"].alias("start"), (part(i)[n - 1]["pos"] + 1).alias("end"), F.transform(part(i), lambda x: x["stem"]).alias("stems")))
    out = families.select("key", F.explode(windows).alias("w")).select("key", "w.start", "w.end", "w.stems")
    return out.where(F.size(F.filter("stems", lambda x: x.rlike("^[0-9]+$"))) < n / 2).select("key", "start", "end", F.array_join("stems", " ").alias("gram"))


def skipgram_findings(drafts: DataFrame, sources: DataFrame, gap: int = 1) -> DataFrame:
    """(draft_key, key, diag, start, end, matched): spans that share skip-grams on a diagonal, merged by their greatest end.

    matched counts the different words that stand in the merged windows' families. Inputs as skipgrams gives them.
    """
    d = drafts.select(F.col("key").alias("draft_key"), "start", "end", "gram")
    s = sources.select("key", F.col("start").alias("source_start"), "gram")
    hits = d.join(s, "gram").select("draft_key", "key", (F.col("source_start") - F.col("start")).alias("diag"), "start", "end").distinct()
    spans = overlap.merge_spans(hits, ["draft_key", "key", "diag"], gap)
    at = hits.withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1, F.lit(2)))).select("draft_key", "key", "diag", "pos").distinct()
    inside = at.join(spans, ["draft_key", "key", "diag"]).where("pos >= start and pos < end")
    return inside.groupBy("draft_key", "key", "diag", "start", "end").agg(F.count("*").alias("matched"))


def position_keys(hits: DataFrame, every_word: bool, n: int = overlap.N) -> DataFrame:
    """(draft_key, pos, keys): keys that match at each position; only gram starts, or every word of a gram."""
    rows = hits.select("draft_key", "key", "pos")
    if every_word:
        rows = rows.withColumn("pos", F.explode(F.sequence("pos", F.col("pos") + (n - 1))))
    return rows.groupBy("draft_key", "pos").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def cites_source(findings: DataFrame, positions: DataFrame, cited: DataFrame) -> DataFrame:
    """findings (draft_key, start, end) with cites_source: whether any key matching in the span is one that the draft part cites.

    positions: (draft_key, pos, keys); cited: (draft_key, cited) with an array of keys.
    """
    hits = findings.join(positions, "draft_key").where("pos >= start and pos < end").join(cited, "draft_key")
    found = hits.groupBy("draft_key", "start", "end").agg(F.bool_or(F.arrays_overlap("keys", "cited")).alias("cites_source"))
    return findings.join(found, ["draft_key", "start", "end"], "left").fillna(False, ["cites_source"])


def contexts(runs: DataFrame, texts: DataFrame, around: int = 6) -> DataFrame:
    """Runs (key, start, end) with their words and up to that many words on either side. texts: (key, text)."""
    t = texts.select("key", T.words(F.col("text")).alias("w"))
    low = F.greatest(F.lit(0), F.col("start") - around).cast("int")
    high = F.least(F.size("w"), F.col("end") + around).cast("int")
    join = lambda a, b: F.array_join(F.slice("w", a + 1, b - a), " ")
    return runs.join(t, "key").select(*runs.columns, join(F.col("start").cast("int"), F.col("end").cast("int")).alias("fragment"), join(low, high).alias("context"))


def masked_words(words: list[str], phrases: list[list[str]]) -> int:
    """Number of positions that an allowed phrase covers."""
    covered: set[int] = set()
    for p in phrases:
        n = len(p)
        for i in range(len(words) - n + 1):
            if n and words[i : i + n] == p:
                covered.update(range(i, i + n))
    return len(covered)


def allowlisted(findings: DataFrame, column: str, phrases: list[list[str]], least: int = overlap.N, stemmed: bool = False) -> DataFrame:
    """Findings that keep at least that many words outside the allowed phrases; a phrase list is a small configuration."""
    listed = [[udf.stem(w) for w in p if w not in T.SKIP_STOP] for p in phrases] if stemmed else phrases

    @F.pandas_udf(IntegerType())
    def open_words(fragments: pd.Series) -> pd.Series:
        def count(text: str) -> int:
            words = re.findall("[a-z0-9]+", (text or "").lower())
            if stemmed:
                words = [udf.stem(w) for w in words if w not in T.SKIP_STOP]
            return len(words) - masked_words(words, listed)

        return fragments.map(count)

    return findings.where(open_words(F.col(column)) >= least)


def renumber(text: str, numbers: dict[str, int]) -> str:
    """Citation groups as numbers, runs of three or more contracted; groups with an unknown key stay."""

    def put(m: re.Match[str]) -> str:
        keys = re.findall(r"@([A-Za-z][A-Za-z0-9_-]*)", m.group())
        if not keys or any(k not in numbers for k in keys):
            return m.group()
        n = sorted({numbers[k] for k in keys})
        out, i = [], 0
        while i < len(n):
            j = i
            while j + 1 < len(n) and n[j + 1] == n[j] + 1:
                j += 1
            out += [f"[{n[i]}]–[{n[j]}]"] if j - i >= 2 else [f"[{x}]" for x in n[i : j + 1]]
            i = j + 1
        return ", ".join(out)

    return re.sub(r"\[@[^\]]+\]", put, text)


def renumbered(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """(key, text) with numbers for citations. numbers: (key, citekey, number), the numbering of each text."""
    maps = numbers.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("citekey", "number"))).alias("numbers"))

    @F.pandas_udf(StringType())
    def put(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([renumber(a, dict(b or {})) if a is not None else None for a, b in zip(t, m, strict=True)])

    return texts.join(maps, "key", "left").select("key", put("text", "numbers").alias("text"))


def outline(lines: DataFrame) -> DataFrame:
    """(key, line, level, id, parent, problem) of headings '## Title {#id}': the parent is the last heading of a higher level.

    lines: (key, line, value). Problems: deeper than four, no id, an id that stands twice, a level skipped.
    """
    h = lines.where(F.col("value").rlike("^#{1,6} "))
    h = h.select("key", "line", F.length(F.regexp_extract("value", "^(#+)", 1)).alias("level"), F.nullif(F.regexp_extract("value", r"\{#([\w-]+)\}", 1), F.lit("")).alias("id"))
    w = Window.partitionBy("key").orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.last(F.when(F.col("level") == n, F.struct("line", "id")), ignorenulls=True).over(before) for n in range(1, 6)]
    for n, last in enumerate(lasts, 1):
        h = h.withColumn(f"_l{n}", last)
    higher = F.array_compact(F.array(*(F.when(F.col("level") > n, F.col(f"_l{n}")) for n in range(1, 6))))
    nearest = F.element_at(F.array_sort(higher), -1)
    jump = F.col("level") > F.coalesce(F.lag("level").over(w), F.lit(0)) + 1
    twice = F.col("id").isNotNull() & (F.count("*").over(Window.partitionBy("key", "id")) > 1)
    problem = F.when(F.col("level") > 4, "too deep").when(F.col("id").isNull(), "no id").when(twice, "id repeated").when(jump, "level skipped")
    return h.select("key", "line", "level", "id", F.when(F.size(higher) > 0, nearest["id"]).alias("parent"), problem.alias("problem"))


def block_kinds(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, kind): blocks between blank lines by their first line: heading, list, table, quote or paragraph."""
    b = texts.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), r"\n[ \t]*\n")).alias("block", "value")).where(F.trim(F.translate("value", "\n\f\t", "   ")) != "")
    first = F.ltrim(F.translate(F.col("value"), "\n\f", "  "))
    kind = F.when(first.rlike("^#{1,6} "), "heading").when(first.rlike(r"^([-*+]|[0-9]+[.)]) "), "list").when(first.startswith("|"), "table").when(first.startswith(">"), "quote").otherwise("paragraph")
    return b.select("key", "block", kind.alias("kind"))


def figure_records(documents: DataFrame, key: str, pictures: str) -> DataFrame:
    """(key, figure, page, caption, cite): one row a picture; pictures: array of struct(page, caption)."""
    p = documents.select(F.col(key).alias("key"), F.posexplode(pictures).alias("pos", "p"))
    n = F.col("pos") + 1
    cite = F.when(F.col("p.page").isNull(), F.concat(F.lit("Fig. "), n)).when(F.coalesce(F.col("p.caption"), F.lit("")) == "", F.concat(F.lit("Fig. "), n, F.lit(", p. "), F.col("p.page"))).otherwise(F.concat(F.lit("Fig. "), n, F.lit(" ("), F.col("p.caption"), F.lit("), p. "), F.col("p.page")))
    return p.select("key", n.alias("figure"), F.col("p.page").alias("page"), F.col("p.caption").alias("caption"), cite.alias("cite"))


def drawing_edges(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, target): consecutive named nodes of each path of a drawing; coordinates are no nodes."""
    paths = sources.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\\(?:draw|path)\b([^;]*);"), 1)).alias("path"))
    names = paths.select("key", F.filter(F.regexp_extract_all("path", F.lit(r"\(([^()]*)\)"), 1), lambda n: n.rlike(r"^\s*[A-Za-z]")).alias("n")).where(F.size("n") > 1)
    clean = F.transform("n", lambda x: F.regexp_replace(F.trim(x), r"\..*$", ""))
    pairs = F.arrays_zip(F.slice(clean, F.lit(1), F.size("n") - 1).alias("a"), F.slice(clean, F.lit(2), F.size("n") - 1).alias("b"))
    return names.select("key", F.explode(pairs).alias("p")).select("key", F.col("p.a").alias("source"), F.col("p.b").alias("target"))


def long_nodes(sources: DataFrame, key: str, text: str, most: int = 15) -> DataFrame:
    """(key, label, words): labels of drawing nodes of more than that many words."""
    labels = sources.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\bnode\b[^{;]*\{([^{}]*)\}"), 1)).alias("label"))
    return labels.withColumn("words", F.size(F.split(F.trim("label"), r"\s+"))).where(F.col("words") > most)


def acronym(term: Column, definition: Column) -> Column:
    """struct(acronym, expansion) of a glossary entry that is one, either way round; else null."""
    short = r"^[A-Z][A-Z0-9]{1,7}$"
    inside = F.regexp_extract(term, r"^(.+?) \(([A-Z][A-Z0-9]{1,7})\)$", 2)
    return F.when(term.rlike(short), F.struct(term.alias("acronym"), definition.alias("expansion"))).when(inside != "", F.struct(inside.alias("acronym"), F.regexp_extract(term, r"^(.+?) \(", 1).alias("expansion")))


def vocabulary(vendored: DataFrame, own: DataFrame) -> DataFrame:
    """(acronym, expansion): both lists, the own one wins."""
    return vendored.withColumnRenamed("expansion", "v").join(own.withColumnRenamed("expansion", "o"), "acronym", "full_outer").select("acronym", F.coalesce("o", "v").alias("expansion"))


def acronym_findings(glossary: DataFrame, known: DataFrame) -> DataFrame:
    """(acronym, state): unknown ones to suggest, and known ones whose expansion differs after normalisation."""
    g = glossary.select("acronym", T.claim_key(F.col("expansion")).alias("g"))
    k = known.select("acronym", T.claim_key(F.col("expansion")).alias("k"))
    return g.join(k, "acronym", "left").select("acronym", F.when(F.col("k").isNull(), "suggest").when(F.col("k") != F.col("g"), "stale").alias("state")).where("state is not null")


def fuzzy_section(asked: DataFrame, sections: DataFrame) -> DataFrame:
    """(asked, section): the section of the same normalised name, else the only one that contains the name or lies in it, else null.

    Both sides are the headings of one draft: tens of rows.
    """
    a = asked.select("asked", T.claim_key(F.col("asked")).alias("a"))
    s = sections.select("section", T.claim_key(F.col("section")).alias("s"))
    near = a.join(F.broadcast(s), (F.col("a") == F.col("s")) | F.col("s").contains(F.col("a")) | F.col("a").contains(F.col("s")), "left")
    best = near.groupBy("asked").agg(F.max(F.when(F.col("a") == F.col("s"), F.col("section"))).alias("same"), F.count_distinct("section").alias("n"), F.max("section").alias("one"))
    return best.select("asked", F.coalesce("same", F.when(F.col("n") == 1, F.col("one"))).alias("section"))


def evidence_brief(requested: DataFrame, blocks: DataFrame) -> DataFrame:
    """(citekey, pos, body, missing): requested keys in order, each once, with their block."""
    r = requested.groupBy("citekey").agg(F.min("pos").alias("pos"))
    return r.join(blocks.select(F.col("name").alias("citekey"), "body"), "citekey", "left").withColumn("missing", F.col("body").isNull())


def reworded(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """Claims (id, claim, quote) whose quote's stemmed bigrams stand to at least that share in the claim."""

    @F.pandas_udf("double")
    def share(claim: pd.Series, quote: pd.Series) -> pd.Series:
        def grams(t: str) -> set[tuple[str, str]]:
            s = [udf.stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
            return set(zip(s, s[1:], strict=False))

        return pd.Series([len(q & c) / len(q) if (q := grams(b)) and (c := grams(a)) is not None else None for a, b in zip(claim, quote, strict=True)])

    return claims.withColumn("share", share("claim", "quote")).where(F.col("share") >= least)


def containment(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, bigrams, share): share of a quote's stemmed bigrams that stand in the texts of its group; null under two stems.

    quotes: (id, group, quote); texts: (group, text). Stop words leave before bigrams are built; a bigram lies in one text, and one
    that comes again counts once.
    """
    stems = lambda c: udf.stems_udf()(F.filter(T.words(F.col(c)), lambda w: ~w.isin(*T.SKIP_STOP))).alias("stems")
    grams = F.explode(F.array_distinct(T.ngrams(F.col("stems"), 2))).alias("gram")
    q = quotes.select("id", "group", stems("quote")).select("id", "group", grams)
    held = texts.select("group", stems("text")).select("group", grams).distinct().withColumn("held", F.lit(1))
    counts = q.join(held, ["group", "gram"], "left").groupBy("id").agg(F.count("*").alias("bigrams"), F.round(F.count("held") / F.count("*"), 4).alias("share"))
    return quotes.select("id").join(counts, "id", "left").select("id", F.coalesce("bigrams", F.lit(0)).alias("bigrams"), "share")


def vector_sections(vectors: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """(section, pos, vector): every row, each label cut into sections of SECTION_IDS consecutive ids."""
    section = F.concat_ws("/", F.col(label).cast("string"), F.floor(F.col(key) / SECTION_IDS).cast("string"))
    rows = vectors.where(F.col(vector).isNotNull()).select(section.alias("section"), F.col(key).alias("key"), F.col(vector).alias("vector"))
    return rows.select("section", F.row_number().over(Window.partitionBy("section").orderBy("key")).alias("pos"), "vector")


def section_shortlist(rows: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """(section, source): for each section the other sections nearest to it, by the least distance of any two of their vectors.

    rows: (section, pos, vector), which are the sources as well, bounded as vector_sections bounds them. All pairs of vectors are
    compared: sections in blocks as in topics.nearest, a source at a time.
    """
    import numpy as np

    def nearest_to(sent):
        def run(key: tuple, source: pd.DataFrame) -> pd.DataFrame:
            x, names, starts = sent.value
            y = np.stack(source["vector"].to_numpy()).astype(np.float64)
            least = ((x * x).sum(1) + (-2 * y @ x.T + (y * y).sum(1)[:, None]).min(0)).round(4)
            return pd.DataFrame({"section": names, "source": key[0], "distance": np.minimum.reduceat(least, starts)})

        return run

    out = None
    for part in topics.query_blocks(rows.select(F.col("section").alias("query_id"), F.col("vector").alias("query"))):
        asked = sorted((r["query_id"], r["query"]) for r in part.collect())
        names = sorted({n for n, _ in asked})
        if not names:
            continue
        sent = rows.sparkSession.sparkContext.broadcast((np.array([v for _, v in asked], np.float64), names, np.searchsorted([n for n, _ in asked], names)))
        found = rows.groupBy(F.col("section").alias("source")).applyInPandas(nearest_to(sent), "section string, source string, distance double").where("section != source")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select("section", F.col("section").alias("source"))
    w = Window.partitionBy("section").orderBy("distance", "source")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("section", "source")


def section_alignments(drafts: DataFrame, sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """(section, source, rank, score, draft_start, draft_end, source_start, source_end): local alignments of sentence vectors.

    drafts: (section, pos, vector); sources: (source, pos, vector); pairs: (section, source), the shortlist. Sections and
    documents are bounded by what a person writes; a pair is one task's work.
    """
    import numpy as np

    left = pairs.join(drafts, "section").select("section", "source", "pos", "vector")
    right = pairs.join(sources, "source").select(F.col("section").alias("for_section"), F.col("source").alias("of_source"), F.col("pos").alias("source_pos"), F.col("vector").alias("source_vector"))
    schema = "section string, source string, rank int, score double, draft_start int, draft_end int, source_start int, source_end int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            a, b = a.sort_values("pos"), b.sort_values("source_pos")
            cos = unit(np.stack(a["vector"].to_numpy())) @ unit(np.stack(b["source_vector"].to_numpy())).T
            for rank, (score, path) in enumerate(topics.align(cos)):
                i, j = [p for p, _ in path], [q for _, q in path]
                rows.append((key[0], key[1], rank + 1, score, min(i), max(i) + 1, min(j), max(j) + 1))
        return pd.DataFrame(rows, columns=names)

    return left.groupBy("section", "source").cogroup(right.groupBy("for_section", "of_source")).applyInPandas(run, schema)


def unit_state(units: DataFrame) -> DataFrame:
    """(unit, state) by digests (text, accepted_text, inputs, drafted_inputs; null where there is none)."""
    state = (
        F.when(F.col("text").isNull(), "unwritten")
        .when(~F.col("inputs").eqNullSafe(F.col("drafted_inputs")), "stale inputs")
        .when(F.col("accepted_text").isNull(), "drafted")
        .when(F.col("accepted_text") != F.col("text"), "stale draft")
        .otherwise("accepted")
    )
    return units.select("unit", state.alias("state"))


def membership_score(memberships: DataFrame) -> DataFrame:
    """One row: topics a document, share of documents with several, and share of the weight that the top topic holds.

    memberships: (vec_id, topic, weight).
    """
    per = memberships.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
    return per.agg(F.round(F.avg("n"), 4).alias("topics"), F.round(F.count_if(F.col("n") > 1) / F.count("*"), 4).alias("plural"), F.round(F.avg("top"), 4).alias("top_weight"))
