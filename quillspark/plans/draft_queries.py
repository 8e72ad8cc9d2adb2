"""Queries on drafts: skip-grams, positions, contexts, allowlists, blocks, numbering, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import udf
from quillspark.operators import corpus, drafts, overlap
from quillspark.plans.corpus_queries import _digest
from quillspark.plans.overlap_queries import _HITS, _RUNS, findings_latest
from quillspark.plans.review_queries import SQL as REVIEW_SQL
from quillspark.plans.review_queries import topic_membership
from quillspark.session import cut_lineage, load


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return overlap.matches(overlap.positions(load(spark, d, "draft_sentences"), "sent_id", "text"), overlap.positions(load(spark, d, "source_sentences"), "src_id", "text"))


def skipgram_keys(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed skip-grams of the source sentences (stems: rows only)."""
    return drafts.skipgrams(load(spark, d, "source_sentences"), "src_id", "text")


def skipgram_findings(spark: SparkSession, d: str) -> DataFrame:
    """Reuse that survives every other word being changed (stems: rows only)."""
    return drafts.skipgram_findings(drafts.skipgrams(load(spark, d, "draft_sentences"), "sent_id", "text"), drafts.skipgrams(load(spark, d, "source_sentences"), "src_id", "text"))


def position_keys(spark: SparkSession, d: str) -> DataFrame:
    """Sources that match at each word of a draft sentence."""
    rows = drafts.position_keys(_hits(spark, d), every_word=True)
    return rows.select("draft_key", F.col("pos").cast("long").alias("pos"), F.array_join("keys", ",").alias("keys"))


def skipgram_positions(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose skip-grams match at each word of a draft sentence (stems: rows only)."""
    spans = skipgram_findings(spark, d).withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1)))
    return spans.groupBy("draft_key", "pos").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def anchor_keys(spark: SparkSession, d: str) -> DataFrame:
    """Sources that match at the first word of a gram."""
    rows = drafts.position_keys(_hits(spark, d), every_word=False)
    return rows.select("draft_key", F.col("pos").cast("long").alias("pos"), F.array_join("keys", ",").alias("keys"))


def run_citations(spark: SparkSession, d: str) -> DataFrame:
    """Runs, and whether the sentence cites the source of any match in them."""
    hits = cut_lineage(_hits(spark, d), "hits")
    runs = overlap.islands(hits, ["draft_key", "key", "diag"]).select("draft_key", "start", "end").distinct()
    src = load(spark, d, "source_sentences").select(F.col("src_id").alias("key"), "citekey")
    named = hits.join(src, "key").select("draft_key", F.col("citekey").alias("key"), "pos")
    cited = load(spark, d, "draft_sentences").select(F.col("sent_id").alias("draft_key"), F.col("citekeys").alias("cited"))
    return drafts.cites_source(runs, drafts.position_keys(named, every_word=True), cited)


def run_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Runs with their words and six words on either side."""
    runs = overlap.islands(_hits(spark, d), ["draft_key", "key", "diag"]).select(F.col("draft_key").alias("key"), "start", "end").distinct()
    return drafts.contexts(runs, load(spark, d, "draft_sentences").select(F.col("sent_id").alias("key"), "text"))


#: Phrases that are nobody's (an example of a configuration).
STOCK_PHRASES = ("neither the", "nor the", "of the", "describes both the")


def allowlisted_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings that keep eight words outside some stock phrases."""
    phrases = [p.split() for p in STOCK_PHRASES]
    return drafts.allowlisted(load(spark, d, "overlap_df").select("id", "fragment"), "fragment", phrases).select("id").distinct()


def renumbered_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with numbers for their citation groups (rows only)."""
    docs = load(spark, d, "documents").where("text like '%[@%'").select(F.col("doc_id").alias("key"), "text")
    from quillspark.operators import review

    numbers = review.first_appearance(review.citations(docs, "key", "text").select(F.col("key").alias("group"), F.col("pos").alias("at"), "citekey"))
    return drafts.renumbered(docs, numbers.withColumnRenamed("group", "key"))


def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of each document by kind."""
    return drafts.block_kinds(load(spark, d, "documents").where("text is not null"), "doc_id", "text").groupBy("key", "kind").agg(F.count("*").alias("blocks"))


def membership_score(spark: SparkSession, d: str) -> DataFrame:
    return drafts.membership_score(topic_membership(spark, d))


def unit_states(spark: SparkSession, d: str) -> DataFrame:
    """Drafts by state: accepted where claims are recorded and unchanged, by digests of their sentences and claims."""
    digest = lambda t, c: corpus.set_digest(load(spark, d, t), ["draft"], c).select("draft", F.col("digest").alias("h"))
    units = digest("draft_sentences", "text").withColumnRenamed("h", "text").join(digest("overlap_df", "fragment").withColumnRenamed("h", "accepted_text"), "draft", "left")
    units = units.join(digest("draft_sentences", "section").withColumnRenamed("h", "inputs"), "draft", "left").withColumn("drafted_inputs", F.col("inputs")).withColumnRenamed("draft", "unit")
    return drafts.unit_state(units)


def draft_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document with paragraph and quotation flag, summed up; code and references are masked."""
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", F.explode(udf.draft_tokens_udf()("text")).alias("t"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("t.quoted").alias("quoted"), (F.max("t.paragraph") + 1).cast("long").alias("paragraphs"))


def vector_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Local alignments between sections of the labels' vectors and the five other sections nearest to each, as sources (rows only)."""
    rows = drafts.vector_sections(load(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return drafts.section_alignments(rows, rows.withColumnRenamed("section", "source"), drafts.section_shortlist(rows))


def findings_by_severity(spark: SparkSession, d: str) -> DataFrame:
    """Findings in the order of a report: long, short, quoted; longer ones first within a severity."""
    from pyspark.sql import Window

    from quillspark.functions import text as T

    f = findings_latest(spark, d).withColumn("severity", T.severity(F.col("quoted"), F.col("cites_source"), F.col("matched_words")))
    w = Window.partitionBy("severity").orderBy(F.desc("span_words"), "citekey", "line", "id")
    return f.select("id", "severity", F.row_number().over(w).cast("long").alias("place"))


_F = (skipgram_keys, skipgram_findings, skipgram_positions, position_keys, anchor_keys, run_citations, run_contexts, allowlisted_findings, renumbered_documents, block_kinds, membership_score, unit_states, draft_words, vector_alignments, findings_by_severity)
QUERIES = {f.__name__: f for f in _F}

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_SPAN = f"WITH {_RUNS}, u AS (SELECT DISTINCT draft_key, start, \"end\" FROM r)"

_PLAIN = "regexp_replace(text, '`[^`\\n]+`', ' ', 'g')"
_OPEN = f"len({_WORDS.replace('text', 'fragment')})" + "".join(f" - {len(p.split())} * len(list_filter(range(1, len(w) + 1), lambda i: array_to_string(list_slice(w, i, i + {len(p.split()) - 1}), ' ') = '{p}'))" for p in STOCK_PHRASES)

SQL = {
    "draft_words": f"""WITH t AS (SELECT doc_id, {_PLAIN} AS text FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS words, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '(?m)"[^"]{{2,}}"|“[^”]{{2,}}”|^>.*$'), lambda q: len(regexp_extract_all(lower(q), '[a-z0-9]+')))), 0) AS BIGINT) AS quoted,
            CAST(len(regexp_extract_all(regexp_extract(lower(text), '(?s)^(.*[a-z0-9])', 1), '\\n\\s*\\n')) + 1 AS BIGINT) AS paragraphs FROM t) SELECT * FROM n WHERE words > 0""",
    "allowlisted_findings": f"SELECT DISTINCT id FROM (SELECT id, fragment, {_WORDS.replace('text', 'fragment')} AS w FROM overlap_df) WHERE {_OPEN} >= 8",
    "position_keys": f"WITH {_HITS}, e AS (SELECT draft_key, key, unnest(range(pos, pos + 8)) AS pos FROM h) SELECT draft_key, CAST(pos AS BIGINT) AS pos, array_to_string(list_sort(list_distinct(list(key))), ',') AS keys FROM e GROUP BY 1, 2",
    "anchor_keys": f"WITH {_HITS} SELECT draft_key, CAST(pos AS BIGINT) AS pos, array_to_string(list_sort(list_distinct(list(key))), ',') AS keys FROM h GROUP BY 1, 2",
    "run_citations": f"""{_SPAN}, m AS (SELECT h.draft_key, ss.citekey, unnest(range(h.pos, h.pos + 8)) AS pos FROM h JOIN source_sentences ss ON ss.src_id = h.key),
        c AS (SELECT u.draft_key, u.start, u."end", bool_or(list_contains(ds.citekeys, m.citekey)) AS hit FROM u JOIN m ON m.draft_key = u.draft_key AND m.pos >= u.start AND m.pos < u."end" JOIN draft_sentences ds ON ds.sent_id = u.draft_key GROUP BY 1, 2, 3)
        SELECT draft_key, start, "end", coalesce(hit, false) AS cites_source FROM u LEFT JOIN c USING (draft_key, start, "end")""",
    "run_contexts": f"""{_SPAN} SELECT draft_key AS key, start, "end", array_to_string(list_slice({_WORDS}, start + 1, "end"), ' ') AS fragment, array_to_string(list_slice({_WORDS}, greatest(0, start - 6) + 1, least(len({_WORDS}), "end" + 6)), ' ') AS context
        FROM u JOIN draft_sentences ON sent_id = draft_key""",
    "block_kinds": """WITH b AS (SELECT doc_id AS key, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS v FROM documents WHERE text IS NOT NULL), f AS (SELECT key, ltrim(translate(v, chr(10) || chr(12), '  '), ' ') AS f FROM b WHERE trim(translate(v, chr(10) || chr(12) || chr(9), '   '), ' ') <> '')
        SELECT key, CASE WHEN regexp_matches(f, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(f, '^([-*+]|[0-9]+[.)]) ') THEN 'list' WHEN starts_with(f, '|') THEN 'table' WHEN starts_with(f, '>') THEN 'quote' ELSE 'paragraph' END AS kind, count(*) AS blocks FROM f GROUP BY 1, 2""",
    "membership_score": f"""WITH mem AS ({REVIEW_SQL['topic_membership']}), p AS (SELECT vec_id, count(*) AS n, max(weight) AS top FROM mem GROUP BY 1)
        SELECT round(avg(n), 4) AS topics, round(count_if(n > 1) / count(*)::DOUBLE, 4) AS plural, round(avg(top), 4) AS top_weight FROM p""",
    "unit_states": f"""WITH t AS ({_digest('draft', 'text', 'draft_sentences')}), a AS ({_digest('draft', 'fragment', 'overlap_df')})
        SELECT t.draft AS unit, CASE WHEN a.digest IS NULL THEN 'drafted' WHEN a.digest <> t.digest THEN 'stale draft' ELSE 'accepted' END AS state FROM t LEFT JOIN a ON a.draft = t.draft""",
    "findings_by_severity": """WITH f AS (SELECT *, CASE WHEN quoted AND cites_source THEN 'quoted' WHEN matched_words >= 15 THEN 'long' ELSE 'short' END AS sev FROM overlap_df QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)
        SELECT id, sev AS severity, CAST(row_number() OVER (PARTITION BY sev ORDER BY span_words DESC, citekey, line, id) AS BIGINT) AS place FROM f""",
}
