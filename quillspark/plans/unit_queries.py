"""Queries on units of texts: sentences, blocks, claims, sections; on findings of reviews; on stop words, requests and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udf
from quillspark.operators import corpus, overlap, topics, units
from quillspark.plans.overlap_queries import _RUNS, exact_findings
from quillspark.plans.retrieval_queries import _COVERAGE, bm25_multi_query, bm25_sql, coverage_report
from quillspark.plans.retrieval_queries import _TOPICS as _TOPICS_SQL
from quillspark.plans.review_queries import _D2, _PROVENANCE, _dot, _query_vectors, _vectors, provenance_best_passage
from quillspark.session import load


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return units.lines(load(spark, d, "documents").where("text is not null"), "doc_id", "text")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each draft cell, by digest."""
    rows = load(spark, d, "draft_sentences").select("sent_id", F.posexplode(units.sentences(F.col("text"))).alias("pos", "s"))
    return rows.select("sent_id", F.col("pos").cast("long").alias("number"), F.md5("s").alias("digest"))


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each draft cell by their offsets in it."""
    rows = load(spark, d, "draft_sentences").select("sent_id", F.explode(units.sentence_spans(F.col("text"))).alias("s"))
    return rows.select("sent_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each document: paragraphs, and rows, items and headings on their own, by the digest of their text."""
    b = units.blocks(_lines(spark, d))
    return b.select("key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("digest"))


def document_claims(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document that may carry a claim, and whether they or their block cite."""
    c = units.claims(_lines(spark, d))
    return c.select("key", F.col("line").cast("long").alias("line"), F.col("number").cast("long").alias("number"), F.md5("text").alias("digest"), "cites", "block_cites")


def document_units(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and sections of each document that cite, with their keys."""
    rows = _lines(spark, d)
    parts = [units.unit_rows(rows, k).select(F.lit(k).alias("kind"), "key", F.col("line").cast("long").alias("line"), F.array_join("keys", ",").alias("keys")) for k in ("paragraph", "section")]
    return parts[0].unionByName(parts[1]).where("keys <> ''")


def citations_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each citation of a document with the first line of the block that holds it."""
    rows = _lines(spark, d)
    found = units.in_intervals(units.citations_in_lines(rows), units.blocks(rows))
    return found.select("key", F.col("line").cast("long").alias("line"), "citekey", F.col("start").cast("long").alias("start"))


def citations_in_sections(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each document by the line of the heading they stand under (0 before the first one)."""
    rows = _lines(spark, d)
    heads = rows.where(F.col("value").rlike(units.HEADING)).select("key", F.col("line").alias("start"))
    w = Window.partitionBy("key").orderBy("start")
    sections = heads.withColumn("end", F.coalesce(F.lead("start").over(w) - 1, F.lit(1 << 30)))
    found = units.in_intervals(units.citations_in_lines(rows), sections)
    return found.groupBy("key", F.coalesce("start", F.lit(0)).cast("long").alias("section")).agg(F.count_distinct("citekey").alias("citekeys"))


def source_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the source sentences that have a page, by digest."""
    s = load(spark, d, "source_sentences").where("text is not null and page is not null")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = s.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("src_id", F.col("page").cast("long").alias("page"), F.posexplode(units.source_windows(words)).alias("pos", "w"))
    return rows.select("src_id", "page", F.col("pos").cast("long").alias("number"), F.md5("w").alias("digest"))


def provenance_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the findings of a provenance review: by key and claim."""
    rows = load(spark, d, "draft_sentences").select("sent_id", F.explode(F.array_distinct("citekeys")).alias("citekey"), "text")
    return rows.select("sent_id", "citekey", T.finding_id(F.col("citekey"), F.col("text")).alias("finding_id"))


def provenance_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of provenance findings within a source, the worst first."""
    w = Window.partitionBy("citekey").orderBy("score", "claim_id")
    return provenance_best_passage(spark, d).select("claim_id", "citekey", "score", F.row_number().over(w).cast("long").alias("place"))


def coverage_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the findings of a coverage review: by key and status."""
    return coverage_report(spark, d).select("key", "status", T.finding_id(F.col("key"), F.col("status")).alias("finding_id"))


def synthesis_findings(spark: SparkSession, d: str) -> DataFrame:
    """Sections of drafts that rest on one source, and sections of several sources with a run of three sentences on one of them."""
    s = load(spark, d, "draft_sentences").select("draft", F.coalesce("section", F.lit("")).alias("section"), "sent_id", "citekeys")
    runs = units.longest_key_run(s, ["draft", "section"], "sent_id", "citekeys")
    keys = s.select("draft", "section", F.explode("citekeys").alias("k")).groupBy("draft", "section").agg(F.count_distinct("k").alias("sources"))
    kind = F.when(F.col("sources") == 1, "single_source").when(F.col("run") >= 3, "long_run")
    rows = keys.join(runs, ["draft", "section"]).withColumn("kind", kind).where("kind is not null")
    return rows.select("draft", "section", "kind", "sources", "run", T.finding_id(F.col("kind"), F.col("draft"), F.col("section")).alias("finding_id"))


def distinct_requests(spark: SparkSession, d: str) -> DataFrame:
    """Different requests of each user, with and without their parameters, in the order of first use; markers don't count."""
    e = load(spark, d, "events").where("event_type <> 'signup'").select("user_id", "ts", "event_id", F.col("event_type").alias("query"), F.get_json_object("props", "$.k").alias("scope"))
    w = Window.partitionBy("user_id").orderBy("at", "query", "scope")
    pairs = e.groupBy("user_id", "query", "scope").agg(F.min(F.struct("ts", "event_id")).alias("at")).withColumn("place", F.row_number().over(w))
    first = pairs.groupBy("user_id", "query").agg(F.min("place").alias("first_place"), F.count("*").alias("scopes"))
    return first.withColumn("first_place", F.col("first_place").cast("long"))


def hit_runs(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of consecutive grams of a draft sentence that stand in one source."""
    drafts = overlap.positions(load(spark, d, "draft_sentences"), "sent_id", "text")
    sources = overlap.positions(load(spark, d, "source_sentences"), "src_id", "text").select(F.col("key").alias("source"), "gram").distinct()
    return units.consecutive_runs(drafts.join(sources, "gram").select("key", "source", "pos"), ["key", "source"])


def collapsed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Ranked documents collapsed to their citekeys, in the order of first appearance."""
    keys = load(spark, d, "documents").where("citekey is not null").select(F.col("doc_id").alias("key"), "citekey")
    firsts = bm25_multi_query(spark, d).join(keys, "key").groupBy("query_id", "citekey").agg(F.min("rank").alias("first_rank"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")).cast("long"))


def corpus_key(spark: SparkSession, d: str) -> DataFrame:
    """One row: the key of the whole corpus, from the keys and fingerprints of its documents."""
    pairs = load(spark, d, "documents").where("text is not null").select(F.lit("corpus").alias("scope"), F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("pair"))
    return corpus.set_digest(pairs, ["scope"], "pair").drop("first")


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pages added a day, and pages a document."""
    rows = load(spark, d, "documents").where("text is not null and added_at is not null").select(F.to_date("added_at").alias("day"), T.page_count(F.col("text")).cast("long").alias("pages"))
    return rows.groupBy("day").agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.round(F.avg("pages"), 4).alias("rate"))


def entry_counts(spark: SparkSession, d: str) -> DataFrame:
    """Headings, rows of tables, items and prose lines of each document."""
    rows = _lines(spark, d).withColumn("v", F.ltrim("value")).where(F.trim(F.translate("value", "\t\f\r", "   ")) != "")
    head, row, item = F.col("value").rlike(units.HEADING), F.col("v").startswith("|"), F.col("v").rlike(r"^(?:[-*+]|[0-9]+[.)])\s")
    return rows.groupBy("key").agg(F.count_if(head).alias("headings"), F.count_if(row).alias("rows"), F.count_if(item).alias("items"), F.count_if(~head & ~row & ~item).alias("prose"))


def outline_levels(spark: SparkSession, d: str) -> DataFrame:
    """Headings by level."""
    rows = _lines(spark, d).where(F.col("value").rlike(r"^#{1,6}\s"))
    return rows.groupBy(F.length(F.regexp_extract("value", "^(#+)", 1)).cast("long").alias("level")).agg(F.count("*").alias("headings"), F.count_distinct("key").alias("documents"))


def unlabelled_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts by whether they have findings, and claims; the labels' coverage."""
    name = lambda t: load(spark, d, t).select("draft").distinct()
    rows = name("draft_sentences").join(name("overlap_df").withColumn("f", F.lit(True)), "draft", "left").join(name("claim_sentences").withColumn("c", F.lit(True)), "draft", "left")
    return rows.groupBy(F.col("f").isNotNull().alias("findings"), F.col("c").isNotNull().alias("claims")).agg(F.count("*").alias("drafts"))


def lexical_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each draft: runs drawn from the texts, and those recorded by tier."""
    drawn = exact_findings(spark, d).groupBy("draft").agg(F.count("*").alias("n")).select("draft", F.lit("drawn").alias("tier"), "n")
    return drawn.unionByName(load(spark, d, "overlap_df").groupBy("draft", "tier").agg(F.count_distinct("id").alias("n")))


def decoded_collections(spark: SparkSession, d: str) -> DataFrame:
    """Collections of each entry read back from their JSON; what is no JSON array (here: half of the rows) counts as none."""
    r = load(spark, d, "refs").select("ref_id", F.when(F.col("ref_id") % 2 == 0, F.to_json("collections")).otherwise(F.array_join("collections", ";")).alias("stored"))
    decoded = F.coalesce(F.from_json("stored", "array<string>"), F.array().cast("array<string>"))
    return r.select("ref_id", F.size(decoded).cast("long").alias("n"), F.array_join(decoded, ";").alias("names"))


def parse_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose parsed text is there, and, if it came as layout text, their passages too."""
    docs = load(spark, d, "documents").where("citekey is not null and text is not null").groupBy("citekey").agg(F.bool_or(F.col("source") == "layout_markdown").alias("layout"))
    side = load(spark, d, "passages").where("citekey is not null").select("citekey").distinct().withColumn("sidecar", F.lit(True))
    return docs.join(side, "citekey", "left").select("citekey", (~F.coalesce("layout", F.lit(False)) | F.col("sidecar").isNotNull()).alias("present"))


def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    """What restoring the sources of the passages over those of the documents would do to each key."""
    there = load(spark, d, "documents").where("citekey is not null").select("citekey").distinct().withColumn("there", F.lit(True))
    saved = load(spark, d, "passages").where("citekey is not null").select("citekey").distinct()
    return saved.join(there, "citekey", "left").select("citekey", F.when(F.col("there"), "overwrite").otherwise("new").alias("action"))


def page_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each key from the first source that has any: the parsed text's, else those of its passages."""
    parsed = load(spark, d, "documents").where("citekey is not null and text is not null").groupBy("citekey").agg(F.max(T.page_count(F.col("text"))).alias("parsed"))
    side = load(spark, d, "passages").where("citekey is not null and page is not null").groupBy("citekey").agg(F.max("page").alias("passages"))
    rows = parsed.join(side, "citekey", "full_outer")
    return rows.select("citekey", F.coalesce("parsed", "passages").cast("long").alias("pages"), F.when(F.col("parsed").isNotNull(), "parsed").otherwise("passages").alias("source"))


def seed_topics(spark: SparkSession, d: str) -> DataFrame:
    """Names of collections as seeds: white space as one space, repeats in other case once, the first spelling kept."""
    rows = load(spark, d, "refs").select("ref_id", F.posexplode("collections").alias("pos", "c")).select("ref_id", "pos", F.trim(F.regexp_replace("c", r"\s+", " ")).alias("topic"))
    return rows.groupBy(F.lower("topic").alias("folded")).agg(F.min_by("topic", F.struct("ref_id", "pos")).alias("topic")).select("topic")


def quoted_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each draft in the order of first use, with the first of their recorded fragments."""
    used = load(spark, d, "draft_sentences").select("draft", "sent_id", F.posexplode("citekeys").alias("pos", "citekey")).groupBy("draft", "citekey").agg(F.min(F.struct("sent_id", "pos")).alias("at"))
    quotes = load(spark, d, "overlap_df").groupBy("draft", "citekey").agg(F.min("fragment").alias("quote"))
    rows = used.join(quotes, ["draft", "citekey"])
    return rows.select("draft", "citekey", "quote", F.row_number().over(Window.partitionBy("draft").orderBy("at", "citekey")).cast("long").alias("place"))


def evidence_windows(spark: SparkSession, d: str) -> DataFrame:
    """The two best windows of 600 characters of each document for two terms; none without a term (rows only)."""
    rows = load(spark, d, "documents").where("lower(text) like '%sensor%' or lower(text) like '%calibration%'")
    return rows.select("doc_id", F.posexplode(udf.snippet_udf(["sensor", "calibration"], 600, 2)("text")).alias("number", "window"))


def rank_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A cascade: 50 nearest vectors, ranked again by cosine, collapsed to their label, five of these."""
    near = topics.nearest(_query_vectors(spark, d), _vectors(spark, d), 50).select("query_id", "vec_id", "source")
    both = near.join(_query_vectors(spark, d), "query_id").join(_vectors(spark, d).select("vec_id", "embedding"), "vec_id")
    scored = both.select("query_id", "source", "vec_id", F.round(T.cosine(F.col("query"), F.col("embedding")), 6).alias("score"))
    best = scored.groupBy("query_id", "source").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source")).cast("long")
    return best.withColumn("place", place).where("place <= 5")


def topic_stop_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that name no topic: common ones, those of citations, and names of authors."""
    names = load(spark, d, "refs").select(F.explode("authors").alias("a")).select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "a.first", "a.last")), F.lit("[a-z]{3,}"), 0)).alias("word"))
    fixed = spark.createDataFrame([(w,) for w in sorted({*T.PASSAGE_STOP, *CITATION_NOISE})], "word string")
    return names.union(fixed).distinct()


#: Words of citations and captions (fixed values).
CITATION_NOISE = ("al", "doi", "eds", "et", "fig", "http", "https", "isbn", "org", "pp", "proc", "ref", "sect", "vol", "www")


def label_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of words of titles that several entries have, stop words out: the vocabulary of labels."""
    words = load(spark, d, "refs").select("ref_id", F.filter(T.words(F.col("title")), lambda w: ~w.isin(*T.PASSAGE_STOP)).alias("w"))
    terms = words.select("ref_id", F.explode(F.array_distinct(F.concat("w", T.ngrams(F.col("w"), 2)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("entries")).where("entries >= 2")


def cluster_fit(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by cluster (rows only; k-means stands in for a density-based fit)."""
    return topics.fit_clusters(load(spark, d, "embeddings"), "vec_id", "embedding")


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hashed term vectors of claims, of unit length (rows only; they stand in for a sentence encoder)."""
    return topics.hashed_vectors(load(spark, d, "claim_sentences"), "claim_id", "text")


def line_citations(spark: SparkSession, d: str) -> DataFrame:
    """Lines that cite, by the number of different keys, and by those keys that hold a separator."""
    rows = _lines(spark, d).select("key", F.array_distinct(T.cited_keys(F.col("value"))).alias("keys"), F.array_distinct(units.separated_keys(F.col("value"))).alias("separated"))
    return rows.where(F.size("keys") > 0).groupBy(F.size("keys").cast("long").alias("keys"), F.size("separated").cast("long").alias("separated")).agg(F.count("*").alias("lines"))


def dialects(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the dialect that their spelling shows (null on a tie)."""
    return load(spark, d, "documents").where("text is not null").groupBy(units.dialect(F.col("text")).alias("dialect")).agg(F.count("*").alias("documents"))


def spec_digests(spark: SparkSession, d: str) -> DataFrame:
    """Short digest of each document."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("digest"))


def job_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source in the order in which they would be parsed: the longest first."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return load(spark, d, "documents").where("source is not null and n_chars is not null").select("source", "doc_id", F.row_number().over(w).cast("long").alias("place"))


_F = (
    sentence_split, sentence_spans, document_blocks, document_claims, document_units, citations_in_blocks, citations_in_sections, source_windows, provenance_ids, provenance_order, coverage_ids, synthesis_findings,
    distinct_requests, hit_runs, collapsed_hits, corpus_key, throughput, entry_counts, outline_levels, unlabelled_drafts, lexical_findings, decoded_collections, parse_outputs, restore_plan, page_sources, seed_topics,
    quoted_evidence, evidence_windows, rank_cascade, topic_stop_words, label_terms, cluster_fit, hashed_vectors, line_citations, dialects, spec_digests, job_order,
)
QUERIES = {f.__name__: f for f in _F}

_W = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_KEYS = "regexp_extract_all({0}, '@([A-Za-z][A-Za-z0-9_-]*)', 1)"
_MARKED = "regexp_replace(regexp_replace({0}, '([.!?])(\\s+)([A-Z\\[(])', '\\1' || chr(1) || '\\2\\3', 'g'), '(\\b(?:[A-Z]|Fig|Sect|Eq|Ref|e\\.g|i\\.e|cf)\\.)' || chr(1), '\\1', 'g')"
_SENTENCES = "list_transform(string_split(" + _MARKED.format("regexp_replace({0}, '^\\s+|\\s+$', '', 'g')") + ", chr(1)), lambda s: regexp_replace(s, '^\\s+', ''))"
_BLANK = "trim(translate({0}, chr(9) || chr(12) || chr(13), '   '), ' ') = ''"
_LINES = """l0 AS (SELECT doc_id AS key, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), l1 AS (SELECT key, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS value FROM l0),
    lc AS (SELECT key, min(line) AS cut FROM l1 WHERE regexp_matches(value, '(?i)^#{1,6}\\s*(?:[0-9.]+\\s*)?(?:references|bibliography)\\s*$') GROUP BY 1), l AS (SELECT l1.* FROM l1 LEFT JOIN lc USING (key) WHERE cut IS NULL OR line < cut)"""


def _blocks_sql(subdivide: bool) -> str:
    more = f"OR regexp_matches(value, '{units.OPENS_BLOCK}') OR regexp_matches(prev, '{units.STANDS_ALONE}')" if subdivide else ""
    joined = "array_to_string(list_transform(raw, lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'), ' ')), ' ')"
    return f"""{_LINES}, p AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY line) AS prev FROM l),
    o AS (SELECT *, {_BLANK.format('value')} AS blank, CASE WHEN NOT ({_BLANK.format('value')}) AND (prev IS NULL OR {_BLANK.format('prev')} {more}) THEN 1 ELSE 0 END AS opens FROM p),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY line) AS block FROM o),
    b0 AS (SELECT key, min(line) AS start, max(line) AS "end", list(value ORDER BY line) AS raw FROM n WHERE NOT blank GROUP BY key, block), b1 AS (SELECT *, {joined} AS j FROM b0),
    b AS (SELECT key, start, "end", raw[1] AS first, raw, CASE WHEN starts_with(j, '|') THEN array_to_string(list_filter(list_transform(string_split(j, '|'), lambda c: trim(c, ' ')), lambda c: c <> '' AND NOT regexp_full_match(c, ':?-+:?')), ' -- ')
        ELSE regexp_replace(j, '^(?:[-*+]|[0-9]+[.)]|#{{1,6}})\\s+', '') END AS text FROM b1)"""


_CITES = f"c AS (SELECT DISTINCT key, line, unnest({_KEYS.format('value')}) AS citekey FROM l)"
_SRC = "trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')"
_SW = f"""w0 AS (SELECT src_id, page, string_split({_SRC}, ' ') AS w FROM source_sentences WHERE text IS NOT NULL AND page IS NOT NULL AND {_SRC} <> ''),
    w1 AS (SELECT src_id, page, CASE WHEN len(w) <= 20 THEN [array_to_string(w, ' ')] ELSE list_transform(list_concat(range(0, len(w) - 19, 10), CASE WHEN len(w) % 10 <> 0 THEN [len(w) - 20] ELSE [] END), lambda i: array_to_string(list_slice(w, i + 1, i + 20), ' ')) END AS w FROM w0)"""


def _digest_sql(value: str, table: str) -> str:
    from quillspark.plans.corpus_queries import _digest

    return _digest("scope", value, table)


SQL = {
    "sentence_split": f"WITH s AS (SELECT sent_id, {_SENTENCES.format('text')} AS s FROM draft_sentences WHERE text IS NOT NULL) SELECT sent_id, CAST(unnest(range(0, len(s))) AS BIGINT) AS number, md5(unnest(s)) AS digest FROM s",
    "sentence_spans": f"""WITH m AS (SELECT sent_id, string_split({_MARKED.format('text')}, chr(1)) AS p FROM draft_sentences WHERE text IS NOT NULL), e AS (SELECT sent_id, p, unnest(range(1, len(p) + 1)) AS i FROM m),
        r AS (SELECT sent_id, p[i] AS s, coalesce(list_sum(list_transform(list_slice(p, 1, i - 1), lambda x: length(x))), 0) AS b FROM e),
        t AS (SELECT sent_id, CAST(b + length(s) - length(regexp_replace(s, '^\\s+', '')) AS BIGINT) AS start, CAST(b + length(regexp_replace(s, '\\s+$', '')) AS BIGINT) AS "end" FROM r) SELECT * FROM t WHERE start < "end\"""",
    "document_blocks": f'WITH {_blocks_sql(True)} SELECT key, start, "end", md5(text) AS digest FROM b',
    "document_claims": f"""WITH {_blocks_sql(True)}, a AS (SELECT *, lead(first) OVER (PARTITION BY key ORDER BY start) AS after FROM b),
        k AS (SELECT * FROM a WHERE NOT regexp_matches(first, '{units.NO_CLAIM}') AND text <> '' AND NOT (regexp_matches(first, '{units.RULE}') OR (regexp_matches(first, '{units.ROW}') AND coalesce(regexp_matches(after, '{units.RULE}'), false)))),
        s AS (SELECT key, start AS line, len({_KEYS.format('text')}) > 0 AS block_cites, {_SENTENCES.format('text')} AS s FROM k), e AS (SELECT key, line, block_cites, unnest(range(1, len(s) + 1)) AS number, unnest(s) AS text FROM s)
        SELECT key, line, number, md5(text) AS digest, len({_KEYS.format('text')}) > 0 AS cites, block_cites FROM e""",
    "document_units": f"""WITH {_blocks_sql(False)}, h AS (SELECT *, sum(CASE WHEN regexp_matches(value, '{units.HEADING}') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY line) AS section FROM l),
        u AS (SELECT 'paragraph' AS kind, key, start AS line, array_to_string(raw, chr(10)) AS t FROM b UNION ALL SELECT 'section', key, min(line), string_agg(value, chr(10) ORDER BY line) FROM h GROUP BY key, section)
        SELECT kind, key, line, array_to_string(list_sort(list_distinct({_KEYS.format('t')})), ',') AS keys FROM u WHERE len({_KEYS.format('t')}) > 0""",
    "citations_in_blocks": f'WITH {_blocks_sql(True)}, {_CITES} SELECT c.key, c.line, citekey, min(start) AS start FROM c LEFT JOIN b ON b.key = c.key AND c.line BETWEEN start AND "end" GROUP BY 1, 2, 3',
    "citations_in_sections": f"""WITH {_LINES}, {_CITES}, h AS (SELECT key, line AS start FROM l WHERE regexp_matches(value, '{units.HEADING}')), s AS (SELECT c.key, c.line, citekey, coalesce(max(start), 0) AS section FROM c LEFT JOIN h ON h.key = c.key AND h.start <= c.line GROUP BY 1, 2, 3)
        SELECT key, section, count(DISTINCT citekey) AS citekeys FROM s GROUP BY 1, 2""",
    "source_windows": f"WITH {_SW} SELECT src_id, CAST(page AS BIGINT) AS page, CAST(unnest(range(0, len(w))) AS BIGINT) AS number, md5(unnest(w)) AS digest FROM w1",
    "provenance_ids": "SELECT sent_id, citekey, substr(sha256(citekey || chr(0) || text), 1, 12) AS finding_id FROM (SELECT sent_id, text, unnest(list_distinct(citekeys)) AS citekey FROM draft_sentences)",
    "provenance_order": f"WITH {_PROVENANCE} SELECT claim_id, citekey, score, CAST(row_number() OVER (PARTITION BY citekey ORDER BY score, claim_id) AS BIGINT) AS place FROM b",
    "coverage_ids": f"{_COVERAGE} SELECT key, status, substr(sha256(key || chr(0) || status), 1, 12) AS finding_id FROM report",
    "synthesis_findings": """WITH s AS (SELECT draft, coalesce(section, '') AS section, sent_id, citekeys, CASE WHEN len(list_distinct(citekeys)) = 1 THEN citekeys[1] END AS one FROM draft_sentences),
        o AS (SELECT *, CASE WHEN one IS NOT NULL AND one = lag(one) OVER (PARTITION BY draft, section ORDER BY sent_id) THEN 0 ELSE 1 END AS opened FROM s), r AS (SELECT *, sum(opened) OVER (PARTITION BY draft, section ORDER BY sent_id) AS streak FROM o),
        n AS (SELECT draft, section, max(n) AS run FROM (SELECT draft, section, streak, count(one) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2), k AS (SELECT draft, section, count(DISTINCT k) AS sources FROM (SELECT draft, section, unnest(citekeys) AS k FROM s) GROUP BY 1, 2),
        f AS (SELECT draft, section, CASE WHEN sources = 1 THEN 'single_source' WHEN run >= 3 THEN 'long_run' END AS kind, sources, run FROM k JOIN n USING (draft, section))
        SELECT *, substr(sha256(kind || chr(0) || draft || chr(0) || section), 1, 12) AS finding_id FROM f WHERE kind IS NOT NULL""",
    "distinct_requests": """WITH e AS (SELECT user_id, ts, event_id, event_type AS query, json_extract_string(props, '$.k') AS scope FROM events WHERE event_type <> 'signup'),
        p AS (SELECT user_id, query, scope, min((ts, event_id)) AS first_at FROM e GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at, query, scope) AS place FROM p)
        SELECT user_id, query, CAST(min(place) AS BIGINT) AS first_place, count(*) AS scopes FROM n GROUP BY 1, 2""",
    "hit_runs": f"""WITH {_RUNS}, u AS (SELECT DISTINCT draft_key AS key, h.key AS source, pos FROM h), v AS (SELECT *, pos - row_number() OVER (PARTITION BY key, source ORDER BY pos) AS stretch FROM u)
        SELECT key, source, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS "end" FROM v GROUP BY key, source, stretch""",
    "collapsed_hits": f"""WITH {bm25_sql(_TOPICS_SQL, 15)}, f AS (SELECT query_id, citekey, min(rank) AS first_rank FROM hits JOIN documents ON doc_id = hits.key WHERE citekey IS NOT NULL GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS BIGINT) AS place FROM f""",
    "corpus_key": _digest_sql("pair", "(SELECT 'corpus' AS scope, doc_id || ':' || sha256(text) AS pair FROM documents WHERE text IS NOT NULL)"),
    "throughput": """WITH p AS (SELECT CAST(added_at AS DATE) AS day, length(t) - length(replace(t, chr(12), '')) + 1 AS pages FROM (SELECT added_at, regexp_replace(text, '\\s+$', '') AS t FROM documents WHERE text IS NOT NULL AND added_at IS NOT NULL))
        SELECT day, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, round(avg(pages), 4) AS rate FROM p GROUP BY 1""",
    "entry_counts": f"""WITH {_LINES}, v AS (SELECT key, regexp_matches(value, '{units.HEADING}') AS h, starts_with(ltrim(value, ' '), '|') AS r, regexp_matches(ltrim(value, ' '), '^(?:[-*+]|[0-9]+[.)])\\s') AS i FROM l WHERE NOT ({_BLANK.format('value')}))
        SELECT key, count_if(h)::BIGINT AS headings, count_if(r)::BIGINT AS "rows", count_if(i)::BIGINT AS items, count_if(NOT h AND NOT r AND NOT i)::BIGINT AS prose FROM v GROUP BY 1""",
    "outline_levels": f"WITH {_LINES} SELECT CAST(length(regexp_extract(value, '^(#+)', 1)) AS BIGINT) AS level, count(*) AS headings, count(DISTINCT key) AS documents FROM l WHERE regexp_matches(value, '^#{{1,6}}\\s') GROUP BY 1",
    "unlabelled_drafts": """SELECT draft IN (SELECT draft FROM overlap_df) AS findings, draft IN (SELECT draft FROM claim_sentences) AS claims, count(*) AS drafts FROM (SELECT DISTINCT draft FROM draft_sentences) GROUP BY 1, 2""",
    "lexical_findings": f"""WITH {_RUNS} SELECT ds.draft, 'drawn' AS tier, count(*) AS n FROM r JOIN draft_sentences ds ON ds.sent_id = r.draft_key JOIN source_sentences ss ON ss.src_id = r.key GROUP BY 1
        UNION ALL SELECT draft, tier, count(DISTINCT id) FROM overlap_df GROUP BY 1, 2""",
    "decoded_collections": "SELECT ref_id, CAST(CASE WHEN ref_id % 2 = 0 THEN len(collections) ELSE 0 END AS BIGINT) AS n, CASE WHEN ref_id % 2 = 0 THEN array_to_string(collections, ';') ELSE '' END AS names FROM refs",
    "parse_outputs": "SELECT citekey, coalesce(NOT bool_or(source = 'layout_markdown'), true) OR citekey IN (SELECT citekey FROM passages WHERE citekey IS NOT NULL) AS present FROM documents WHERE citekey IS NOT NULL AND text IS NOT NULL GROUP BY 1",
    "restore_plan": "SELECT DISTINCT citekey, CASE WHEN citekey IN (SELECT citekey FROM documents WHERE citekey IS NOT NULL) THEN 'overwrite' ELSE 'new' END AS action FROM passages WHERE citekey IS NOT NULL",
    "page_sources": """WITH d AS (SELECT citekey, max(length(t) - length(replace(t, chr(12), '')) + 1) AS n FROM (SELECT citekey, regexp_replace(text, '\\s+$', '') AS t FROM documents WHERE text IS NOT NULL AND citekey IS NOT NULL) GROUP BY 1), p AS (SELECT citekey, max(page) AS n FROM passages WHERE citekey IS NOT NULL AND page IS NOT NULL GROUP BY 1)
        SELECT coalesce(d.citekey, p.citekey) AS citekey, CAST(coalesce(d.n, p.n) AS BIGINT) AS pages, CASE WHEN d.n IS NOT NULL THEN 'parsed' ELSE 'passages' END AS source FROM d FULL JOIN p ON p.citekey = d.citekey""",
    "seed_topics": "WITH c AS (SELECT ref_id, unnest(range(0, len(collections))) AS pos, trim(regexp_replace(unnest(collections), '\\s+', ' ', 'g')) AS topic FROM refs) SELECT arg_min(topic, (ref_id, pos)) AS topic FROM c GROUP BY lower(topic)",
    "quoted_evidence": """WITH u AS (SELECT draft, citekey, min((sent_id, pos)) AS first_at FROM (SELECT draft, sent_id, unnest(range(0, len(citekeys))) AS pos, unnest(citekeys) AS citekey FROM draft_sentences) GROUP BY 1, 2), q AS (SELECT draft, citekey, min(fragment) AS quote FROM overlap_df GROUP BY 1, 2)
        SELECT draft, citekey, quote, CAST(row_number() OVER (PARTITION BY draft ORDER BY first_at, citekey) AS BIGINT) AS place FROM u JOIN q USING (draft, citekey)""",
    "rank_cascade": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, b.label AS source, round({_D2}, 4) AS distance, a.embedding AS q, b.embedding AS v FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0),
        n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 50), c AS (SELECT query_id, source, max(round({_dot('q', 'v')} / (sqrt({_dot('q', 'q')}) * sqrt({_dot('v', 'v')})), 6)) AS score FROM n GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS BIGINT) AS place FROM c QUALIFY place <= 5""",
    "topic_stop_words": f"""SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', a.first, a.last)), '[a-z]{{3,}}')) AS word FROM (SELECT unnest(authors) AS a FROM refs) UNION ALL SELECT unnest({sorted({*T.PASSAGE_STOP, *CITATION_NOISE})}))""",
    "label_terms": f"""WITH w AS (SELECT ref_id, list_filter({_W.format('title')}, lambda w: NOT list_contains({list(T.PASSAGE_STOP)}, w)) AS w FROM refs WHERE title IS NOT NULL),
        t AS (SELECT ref_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM w) SELECT term, count(*) AS entries FROM t GROUP BY 1 HAVING count(*) >= 2""",
    "line_citations": f"""WITH {_LINES}, k AS (SELECT len(list_distinct({_KEYS.format('value')})) AS keys, len(list_distinct(list_filter(regexp_extract_all(value, '[`@]([A-Za-z][A-Za-z0-9_-]*)', 1), lambda k: regexp_matches(k, '[_-]')))) AS separated FROM l)
        SELECT CAST(keys AS BIGINT) AS keys, CAST(separated AS BIGINT) AS separated, count(*) AS lines FROM k WHERE keys > 0 GROUP BY 1, 2""",
    "dialects": f"""WITH n AS (SELECT len(list_filter({_W.format('text')}, lambda w: regexp_matches(w, '{units.DIALECTS['en-GB']}'))) AS a, len(list_filter({_W.format('text')}, lambda w: regexp_matches(w, '{units.DIALECTS['en-US']}'))) AS b FROM documents WHERE text IS NOT NULL)
        SELECT CASE WHEN a > b THEN 'en-GB' WHEN b > a THEN 'en-US' END AS dialect, count(*) AS documents FROM n GROUP BY 1""",
    "spec_digests": "SELECT doc_id, substr(sha256(text), 1, 12) AS digest FROM documents WHERE text IS NOT NULL",
    "job_order": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS BIGINT) AS place FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL",
}
