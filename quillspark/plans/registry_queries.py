"""Queries on references between parts, ground truths, tallies and small scalar forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import load


def tidy_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims without markers, spaces before punctuation closed, marks at either end off; by digest."""
    t = F.regexp_replace("text", T.CITE_MARKER, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([.,;:!?])", "$1"), r"[ \t\n]+", " ")
    t = F.regexp_replace(t, r"^[ ,;:]+|[ ,;:]+$", "")
    return load(spark, d, "claim_sentences").where("text is not null").select("claim_id", F.md5(t).alias("digest"))


def stripped_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Characters of layout texts without lines that are an image only, runs of blank lines as one."""
    t = F.regexp_replace("text", r"(?m)^[ \t]*!\[[^\]\n]*\]\([^)\n]*\)[ \t]*$|^[ \t]*<!-- image -->[ \t]*$", "")
    return load(spark, d, "documents").where("source = 'layout_markdown' and text is not null").select("doc_id", F.length(F.regexp_replace(t, "\n{3,}", "\n\n")).cast("long").alias("chars"))


def marker_resolution(spark: SparkSession, d: str) -> DataFrame:
    """References from documents to entries: where from, to what, and whether the target exists."""
    refs = load(spark, d, "refs").select(F.col("citekey").alias("target")).distinct().withColumn("resolves", F.lit(True))
    edges = load(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("from_doc"), F.explode(T.cited_keys(F.col("text"))).alias("target")).distinct()
    return edges.join(refs, "target", "left").select("from_doc", "target", F.coalesce("resolves", F.lit(False)).alias("resolves"))


def registry_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of three kinds: keys that several drafts use, sections that several drafts have, references that don't resolve."""
    ds = load(spark, d, "draft_sentences")
    several = lambda rows, kind: rows.groupBy("value").agg(F.count_distinct("draft").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "value", "n")
    keys = several(ds.select("draft", F.explode("citekeys").alias("value")), "key")
    sections = several(ds.where("section is not null").select("draft", F.col("section").alias("value")), "section")
    open_ = marker_resolution(spark, d).where("not resolves").groupBy(F.col("target").alias("value")).agg(F.count("*").alias("n")).select(F.lit("reference").alias("kind"), "value", "n")
    return keys.unionByName(sections).unionByName(open_)


def label_truth(spark: SparkSession, d: str) -> DataFrame:
    """Findings met with the draft sentences that cite their key: matched, or no such sentence (an error in the labels)."""
    f = load(spark, d, "overlap_df").select("id", "draft", "citekey").distinct()
    c = load(spark, d, "draft_sentences").select("draft", F.explode("citekeys").alias("citekey")).distinct().withColumn("hit", F.lit(1))
    return f.join(c, ["draft", "citekey"], "left").groupBy(F.when(F.col("hit").isNull(), "unmatched").otherwise("matched").alias("state")).agg(F.count("*").alias("n"))


def keyword_truth(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a collection that have passages: relevant keys for the collection's last part as a query."""
    r = load(spark, d, "refs").select("citekey", F.explode("collections").alias("c")).select("citekey", F.element_at(F.split("c", " > "), -1).alias("query")).distinct()
    return r.join(load(spark, d, "passages").select("citekey").distinct(), "citekey", "left_semi").groupBy("query").agg(F.count("*").alias("relevant"))


def log_truth(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth from the log: for each user's requests since a first marker, how often they were made and with how many scopes."""
    e = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").alias("scope"))
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first_at"))
    since = e.where("event_type <> 'signup'").join(first, "user_id").where(F.struct("ts", "event_id") > F.col("first_at"))
    return since.groupBy("user_id", F.col("event_type").alias("query")).agg(F.count("*").alias("requests"), F.count_distinct("scope").alias("relevant"))


def run_tally(spark: SparkSession, d: str) -> DataFrame:
    """One row: entries resolved, failed for a lasting reason, and without a file."""
    s = F.col("pdf_resolution")
    return load(spark, d, "refs").agg(F.count_if(s == "resolved").alias("resolved"), F.count_if(s.isin("malformed file field", "non-PDF attachment only")).alias("failed"), F.count_if(~s.isin("resolved", "malformed file field", "non-PDF attachment only")).alias("no_file"), F.count("*").alias("total"))


def pages_by_origin(spark: SparkSession, d: str) -> DataFrame:
    """Passages and distinct pages by origin, and passages a page."""
    p = load(spark, d, "passages").where("citekey is not null and page is not null").withColumn("origin", F.coalesce("origin", F.lit("unknown")))
    n = p.groupBy("origin", "citekey", "page").agg(F.count("*").alias("n"))
    return n.groupBy("origin").agg(F.sum("n").alias("passages"), F.count("*").alias("pages"), F.round(F.sum("n") / F.count("*"), 4).alias("per_page"))


def collection_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Short names of collections for tables: letters, digits and hyphens, at most 63."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("c"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 63)
    return load(spark, d, "refs").select(F.explode("collections").alias("c")).select("c", slug.alias("slug")).distinct().withColumnRenamed("c", "collection")


def author_initials(spark: SparkSession, d: str) -> DataFrame:
    """Initials of given names, hyphens kept, and their uses."""
    first = load(spark, d, "refs").select(F.explode("authors").alias("a")).select(F.trim(F.coalesce("a.first", F.lit(""))).alias("f")).where("f <> ''")
    i = F.regexp_replace("f", r"([A-Za-z])[A-Za-z]*", "$1.")
    return first.where("f rlike '^[A-Za-z][A-Za-z -]*$'").select(i.alias("initials")).groupBy("initials").agg(F.count("*").alias("uses"))


def claimed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the keys that findings name, and keys without an entry (null title)."""
    keys = load(spark, d, "overlap_df").select("citekey").distinct()
    return keys.join(load(spark, d, "refs").select("citekey", "title", "year"), "citekey", "left")


def evidence_by_section(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each section for which a finding is recorded, and recorded keys that no section uses."""
    sections = load(spark, d, "draft_sentences").select(F.coalesce("section", F.lit("Unassigned")).alias("section"), F.explode("citekeys").alias("citekey")).distinct()
    quoted = load(spark, d, "overlap_df").select("citekey").distinct()
    return quoted.join(sections, "citekey", "left").select(F.coalesce("section", F.lit("Unassigned")).alias("section"), "citekey").groupBy("section").agg(F.count("*").alias("keys"))


def mean_quality(spark: SparkSession, d: str) -> DataFrame:
    """One row: means of recall and gain over held-out items, and items without a relevant document."""
    from quillspark.plans.retrieval_queries import retrieval_quality

    items = load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"))
    q = items.join(retrieval_quality(spark, d), "query_id", "left")
    return q.agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("ndcg"), 3).alias("ndcg"), F.count_if(F.col("recall").isNull()).alias("missing"))


_F = (tidy_claims, stripped_markdown, marker_resolution, registry_findings, label_truth, keyword_truth, log_truth, run_tally, pages_by_origin, collection_slugs, author_initials, claimed_lookup, evidence_by_section, mean_quality)
QUERIES = {f.__name__: f for f in _F}

_KEYS = "regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9_-]*)', 1)"
_EDGES = f"e AS (SELECT DISTINCT doc_id AS from_doc, unnest({_KEYS}) AS target FROM documents WHERE text IS NOT NULL)"


def _quality_sql() -> str:
    from quillspark.plans.retrieval_queries import SQL as RETRIEVAL

    return f"WITH q AS ({RETRIEVAL['retrieval_quality']}) SELECT round(avg(recall), 4) AS recall, round(avg(ndcg), 3) AS ndcg, count_if(recall IS NULL)::BIGINT AS missing FROM eval_items LEFT JOIN q ON q.query_id = item_id"


SQL = {
    "tidy_claims": """SELECT claim_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[@[^\\]]+\\]|\\\\cite[tp]?\\{[^}]*\\}', '', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), '[ \\t\\n]+', ' ', 'g'), '^[ ,;:]+|[ ,;:]+$', '', 'g')) AS digest FROM claim_sentences WHERE text IS NOT NULL""",
    "stripped_markdown": """SELECT doc_id, CAST(length(regexp_replace(regexp_replace(text, '(?m)^[ \\t]*!\\[[^\\]\\n]*\\]\\([^)\\n]*\\)[ \\t]*$|^[ \\t]*<!-- image -->[ \\t]*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS BIGINT) AS chars FROM documents WHERE source = 'layout_markdown' AND text IS NOT NULL""",
    "marker_resolution": f"WITH {_EDGES} SELECT from_doc, target, target IN (SELECT citekey FROM refs) AS resolves FROM e",
    "registry_findings": f"""WITH {_EDGES}, k AS (SELECT draft, unnest(citekeys) AS value FROM draft_sentences)
        SELECT 'key' AS kind, value, count(DISTINCT draft) AS n FROM k GROUP BY value HAVING count(DISTINCT draft) > 1 UNION ALL SELECT 'section', section, count(DISTINCT draft) FROM draft_sentences WHERE section IS NOT NULL GROUP BY section HAVING count(DISTINCT draft) > 1
        UNION ALL SELECT 'reference', target, count(*) FROM e WHERE target NOT IN (SELECT citekey FROM refs) GROUP BY target""",
    "label_truth": """WITH f AS (SELECT DISTINCT id, draft, citekey FROM overlap_df), c AS (SELECT DISTINCT draft, unnest(citekeys) AS citekey FROM draft_sentences)
        SELECT CASE WHEN c.citekey IS NULL THEN 'unmatched' ELSE 'matched' END AS state, count(*) AS n FROM f LEFT JOIN c ON c.draft = f.draft AND c.citekey = f.citekey GROUP BY 1""",
    "keyword_truth": "SELECT query, count(*) AS relevant FROM (SELECT DISTINCT citekey, string_split(c, ' > ')[-1] AS query FROM (SELECT citekey, unnest(collections) AS c FROM refs)) WHERE citekey IN (SELECT citekey FROM passages) GROUP BY 1",
    "log_truth": """WITH f AS (SELECT user_id, min((ts, event_id)) AS first_at FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT user_id, event_type AS query, count(*) AS requests, count(DISTINCT json_extract_string(props, '$.k')) AS relevant FROM events JOIN f USING (user_id) WHERE event_type <> 'signup' AND (ts, event_id) > first_at GROUP BY 1, 2""",
    "run_tally": "SELECT count_if(pdf_resolution = 'resolved')::BIGINT AS resolved, count_if(pdf_resolution IN ('malformed file field', 'non-PDF attachment only'))::BIGINT AS failed, count_if(pdf_resolution NOT IN ('resolved', 'malformed file field', 'non-PDF attachment only'))::BIGINT AS no_file, count(*) AS total FROM refs",
    "pages_by_origin": "SELECT origin, CAST(sum(n) AS BIGINT) AS passages, count(*) AS pages, round(sum(n) / count(*)::DOUBLE, 4) AS per_page FROM (SELECT coalesce(origin, 'unknown') AS origin, citekey, page, count(*) AS n FROM passages WHERE citekey IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1",
    "collection_slugs": "SELECT DISTINCT c AS collection, substr(regexp_replace(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 63) AS slug FROM (SELECT unnest(collections) AS c FROM refs)",
    "author_initials": "WITH f AS (SELECT trim(coalesce(a.first, ''), ' ') AS f FROM (SELECT unnest(authors) AS a FROM refs)) SELECT regexp_replace(f, '([A-Za-z])[A-Za-z]*', '\\1.', 'g') AS initials, count(*) AS uses FROM f WHERE f <> '' AND regexp_matches(f, '^[A-Za-z][A-Za-z -]*$') GROUP BY 1",
    "claimed_lookup": "SELECT k.citekey, title, year FROM (SELECT DISTINCT citekey FROM overlap_df) k LEFT JOIN refs ON refs.citekey = k.citekey",
    "evidence_by_section": """WITH s AS (SELECT DISTINCT coalesce(section, 'Unassigned') AS section, unnest(citekeys) AS citekey FROM draft_sentences), q AS (SELECT DISTINCT citekey FROM overlap_df)
        SELECT coalesce(section, 'Unassigned') AS section, count(*) AS keys FROM q LEFT JOIN s ON s.citekey = q.citekey GROUP BY 1""",
    "mean_quality": _quality_sql(),
}
