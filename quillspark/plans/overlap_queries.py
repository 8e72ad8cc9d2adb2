"""Queries on text reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus, overlap
from quillspark.plans.retrieval_queries import grams_sql
from quillspark.session import load


def _hits(spark: SparkSession, d: str) -> DataFrame:
    drafts = overlap.positions(load(spark, d, "draft_sentences"), "sent_id", "text")
    sources = overlap.positions(load(spark, d, "source_sentences"), "src_id", "text")
    return overlap.matches(drafts, sources)


def exact_postings_join(spark: SparkSession, d: str) -> DataFrame:
    """Matches of 8-grams between drafts and sources by diagonal."""
    return _hits(spark, d).groupBy("draft_key", "key", "diag").agg(F.count("*").alias("grams")).withColumn("diag", F.col("diag").cast("long"))


def exact_runs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.islands(_hits(spark, d), ["draft_key", "key", "diag"]).withColumn("diag", F.col("diag").cast("long"))


def exact_findings(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the source's citekey, whether the draft cites it, and a severity."""
    runs = overlap.islands(_hits(spark, d), ["draft_key", "key", "diag"])
    src = load(spark, d, "source_sentences").select(F.col("src_id").alias("key"), "citekey", "page")
    drafts = load(spark, d, "draft_sentences").select(F.col("sent_id").alias("draft_key"), "draft", "citekeys")
    rows = runs.join(src, "key").join(drafts, "draft_key")
    cites = F.coalesce(F.array_contains("citekeys", F.col("citekey")), F.lit(False))
    return rows.select("draft", "draft_key", "citekey", "page", "start", "span_words", "matched_words", cites.alias("cites_source"), T.severity(F.lit(False), cites, F.col("matched_words")).alias("severity"))


def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content-derived ids of the recorded findings."""
    f = load(spark, d, "overlap_df")
    return f.select(F.col("id").alias("recorded"), T.finding_id(F.col("citekey"), F.col("page").cast("string"), F.col("fragment")).alias("finding_id"))


def findings_latest(spark: SparkSession, d: str) -> DataFrame:
    """Recorded findings, each id once: the latest scan."""
    f = load(spark, d, "overlap_df").select("id", "draft", "citekey", "tier", "span_words", "matched_words", "line", "cites_source", "quoted", "scanned_at")
    return corpus.latest(f, "id", "scanned_at").drop("scanned_at")


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    f = findings_latest(spark, d)
    return f.groupBy("tier", T.severity(F.col("quoted"), F.col("cites_source"), F.col("matched_words")).alias("severity")).agg(F.count("*").alias("n"))


def gram_df_profile(spark: SparkSession, d: str) -> DataFrame:
    return overlap.document_frequency(load(spark, d, "gram_postings"))


def finding_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each finding drawn anew from the postings."""
    postings = load(spark, d, "gram_postings").select(T.claim_key(F.col("gram")).alias("gram"), "citekey")
    found = load(spark, d, "overlap_df").groupBy("id").agg(F.min("fragment").alias("fragment"))
    return overlap.profile(found, overlap.document_frequency(postings))


def gate_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return overlap.threshold_sweep(findings_latest(spark, d).where("tier = 'exact' and not (quoted and cites_source)"), [8, 12, 15, 20, 25, 30])


def df_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Per limit of document frequency: findings that it suppresses and that remain."""
    profile = finding_profiles(spark, d)
    rows = profile.select(F.explode(F.array(*(F.lit(x) for x in (1, 2, 4, 8, 16, 32)))).alias("most"), "median_df")
    return rows.groupBy("most").agg(F.count_if(F.col("median_df") > F.col("most")).alias("suppressed"), F.count_if(F.col("median_df") <= F.col("most")).alias("remaining"))


def recheck_diff(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the scans up to the middle of the recorded time against those of the later ones."""
    f = load(spark, d, "overlap_df").where("scanned_at is not null").select("id", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("t"))
    cut = f.agg(((F.min("t") + F.max("t")) / 2).alias("cut"))  # one row
    f = f.crossJoin(F.broadcast(cut))
    return overlap.baseline_diff(f.where("t <= cut"), f.where("t > cut"))


def pairwise_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a draft in one source, pair by pair: the 25 longest of each."""
    f = exact_findings(spark, d).select("draft", "citekey", "draft_key", F.coalesce("page", F.lit(0)).alias("page"), "start", "span_words")
    w = Window.partitionBy("draft", "citekey").orderBy(F.desc("span_words"), "draft_key", "start", "page")
    return f.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 25")


def jaccard_shared_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return overlap.jaccard(overlap.positions(load(spark, d, "draft_sentences"), "sent_id", "text"), overlap.positions(load(spark, d, "claim_sentences"), "claim_id", "text"))


def draft_spans(spark: SparkSession, d: str) -> DataFrame:
    """Word ranges of cited sentences of a draft, merged where they touch."""
    rows = load(spark, d, "draft_sentences").where(F.size("citekeys") > 0).select("draft", F.col("word_start").alias("start"), F.col("word_end").alias("end"))
    return overlap.merge_spans(rows, ["draft"], gap=1)


def _line_spans(spark: SparkSession, d: str, where: str) -> DataFrame:
    return findings_latest(spark, d).where(where).select("id", "draft", F.col("line").alias("start"), (F.col("line") + F.col("span_words")).alias("end"))


def containment_suppression(spark: SparkSession, d: str) -> DataFrame:
    return overlap.suppress_contained(_line_spans(spark, d, "span_words < 20"), _line_spans(spark, d, "span_words >= 20"), "draft")


def intersection_suppression(spark: SparkSession, d: str) -> DataFrame:
    return overlap.suppress_touching(_line_spans(spark, d, "tier <> 'exact'"), _line_spans(spark, d, "tier = 'exact'"), "draft")


def finding_order(spark: SparkSession, d: str) -> DataFrame:
    """The 25 longest findings (a report)."""
    return findings_latest(spark, d).select("id", "citekey", "span_words", "line").orderBy(F.desc("span_words"), "citekey", "line", "id").limit(25)


QUERIES = {f.__name__: f for f in (exact_postings_join, exact_runs, exact_findings, finding_ids, findings_latest, severity_counts, gram_df_profile, finding_profiles, gate_threshold_sweep, df_threshold_sweep, recheck_diff, pairwise_runs, jaccard_shared_ngrams, draft_spans, containment_suppression, intersection_suppression, finding_order)}


def _positions(table: str, key: str) -> str:
    return f"SELECT {key} AS key, unnest({grams_sql('text')}) AS gram, unnest(range(0, len({grams_sql('text')}))) AS pos FROM {table} WHERE text IS NOT NULL"


_HITS = f"""d AS ({_positions('draft_sentences', 'sent_id')}), s AS ({_positions('source_sentences', 'src_id')}),
    h AS (SELECT DISTINCT d.key AS draft_key, s.key AS key, d.pos AS pos, s.pos - d.pos AS diag FROM d JOIN s USING (gram))"""
_RUNS = f"""{_HITS}, l AS (SELECT *, lag(pos) OVER (PARTITION BY draft_key, key, diag ORDER BY pos) AS prev FROM h),
    o AS (SELECT *, CASE WHEN prev IS NULL OR pos - prev - 8 > 1 THEN 1 ELSE 0 END AS opened, CASE WHEN prev IS NULL THEN 8 ELSE least(8, pos - prev) END AS fresh FROM l),
    i AS (SELECT *, sum(opened) OVER (PARTITION BY draft_key, key, diag ORDER BY pos) AS island FROM o),
    r AS (SELECT draft_key, key, diag, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 8 AS BIGINT) AS "end", CAST(max(pos) + 8 - min(pos) AS BIGINT) AS span_words, CAST(sum(fresh) AS BIGINT) AS matched_words FROM i GROUP BY draft_key, key, diag, island)"""
_LATEST = """f AS (SELECT id, draft, citekey, tier, span_words, matched_words, line, cites_source, quoted FROM overlap_df
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)"""
_SEVERITY = "CASE WHEN quoted AND cites_source THEN 'quoted' WHEN matched_words >= 15 THEN 'long' ELSE 'short' END"
_PROFILE = f"""p AS (SELECT trim(regexp_replace(lower(gram), '[^a-z0-9]+', ' ', 'g')) AS gram, citekey FROM gram_postings WHERE gram IS NOT NULL AND citekey IS NOT NULL),
    df AS (SELECT gram, count(DISTINCT citekey) AS df FROM p GROUP BY gram),
    g AS (SELECT id, unnest({grams_sql('fragment')}) AS gram FROM (SELECT id, min(fragment) AS fragment FROM overlap_df GROUP BY id)),
    prof AS (SELECT id, count(*) AS grams, CAST(min(coalesce(df, 0)) AS BIGINT) AS min_df, CAST(floor(median(coalesce(df, 0))) AS BIGINT) AS median_df, CAST(max(coalesce(df, 0)) AS BIGINT) AS max_df FROM g LEFT JOIN df USING (gram) GROUP BY id)"""

SQL = {
    "exact_postings_join": f"WITH {_HITS.replace('SELECT DISTINCT d.key', 'SELECT d.key')} SELECT draft_key, key, diag, count(*) AS grams FROM h GROUP BY ALL",
    "exact_runs": f'WITH {_RUNS} SELECT draft_key, key, diag, start, "end", span_words, matched_words FROM r',
    "exact_findings": f"""WITH {_RUNS}, x AS (SELECT ds.draft, draft_key, ss.citekey, page, start, span_words, matched_words, coalesce(list_contains(citekeys, ss.citekey), false) AS cites_source
        FROM r JOIN source_sentences ss ON ss.src_id = r.key JOIN draft_sentences ds ON ds.sent_id = r.draft_key)
        SELECT *, CASE WHEN matched_words >= 15 THEN 'long' ELSE 'short' END AS severity FROM x""",
    "finding_ids": "SELECT id AS recorded, substr(sha256(citekey || chr(0) || CAST(page AS VARCHAR) || chr(0) || fragment), 1, 12) AS finding_id FROM overlap_df",
    "severity_counts": f"WITH {_LATEST} SELECT tier, {_SEVERITY} AS severity, count(*) AS n FROM f GROUP BY ALL",
    "findings_latest": f"WITH {_LATEST} SELECT * FROM f",
    "gram_df_profile": "SELECT gram, count(*) AS postings, count(DISTINCT citekey) AS df FROM gram_postings WHERE gram IS NOT NULL AND citekey IS NOT NULL GROUP BY gram",
    "finding_profiles": f"WITH {_PROFILE} SELECT * FROM prof",
    "gate_threshold_sweep": f"""WITH {_LATEST}, t AS (SELECT unnest([8, 12, 15, 20, 25, 30]) AS threshold), e AS (SELECT * FROM f WHERE tier = 'exact' AND NOT (quoted AND cites_source))
        SELECT threshold, count_if(span_words >= threshold)::BIGINT AS blocked, count_if(span_words >= threshold AND cites_source)::BIGINT AS citing, count(DISTINCT CASE WHEN span_words >= threshold THEN draft END) AS drafts,
               round(count_if(span_words >= threshold AND cites_source) / nullif(count_if(span_words >= threshold), 0)::DOUBLE, 4) AS precision FROM e CROSS JOIN t GROUP BY threshold""",
    "df_threshold_sweep": f"WITH {_PROFILE}, t AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS most) SELECT most, count_if(median_df > most)::BIGINT AS suppressed, count_if(median_df <= most)::BIGINT AS remaining FROM prof CROSS JOIN t GROUP BY most",
    "recheck_diff": """WITH f AS (SELECT id, epoch_us(scanned_at) AS t FROM overlap_df WHERE scanned_at IS NOT NULL), c AS (SELECT (min(t) + max(t)) / 2.0 AS cut FROM f), b AS (SELECT DISTINCT id FROM f, c WHERE t <= cut), a AS (SELECT DISTINCT id FROM f, c WHERE t > cut)
        SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'resolved' WHEN b.id IS NULL THEN 'new' ELSE 'persisting' END AS state FROM b FULL JOIN a ON a.id = b.id""",
    "pairwise_runs": f"""WITH {_RUNS}, x AS (SELECT ds.draft, ss.citekey, draft_key, coalesce(page, 0) AS page, start, span_words FROM r JOIN source_sentences ss ON ss.src_id = r.key JOIN draft_sentences ds ON ds.sent_id = r.draft_key)
        SELECT *, CAST(row_number() OVER (PARTITION BY draft, citekey ORDER BY span_words DESC, draft_key, start, page) AS BIGINT) AS place FROM x QUALIFY place <= 25""",
    "jaccard_shared_ngrams": f"""WITH a AS (SELECT DISTINCT sent_id AS left_key, unnest({grams_sql('text')}) AS gram FROM draft_sentences WHERE text IS NOT NULL),
        b AS (SELECT DISTINCT claim_id AS right_key, unnest({grams_sql('text')}) AS gram FROM claim_sentences WHERE text IS NOT NULL),
        na AS (SELECT left_key, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT right_key, count(*) AS nb FROM b GROUP BY 1)
        SELECT left_key, right_key, count(*) AS shared, round(count(*) / (any_value(na) + any_value(nb) - count(*))::DOUBLE, 4) AS jaccard FROM a JOIN b USING (gram) JOIN na USING (left_key) JOIN nb USING (right_key) GROUP BY left_key, right_key""",
    "draft_spans": """WITH s AS (SELECT draft, word_start AS start, word_end AS "end" FROM draft_sentences WHERE len(citekeys) > 0),
        r AS (SELECT *, max("end") OVER (PARTITION BY draft ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
        o AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY draft ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM r)
        SELECT draft, min(start) AS start, max("end") AS "end" FROM o GROUP BY draft, run""",
    "containment_suppression": f"""WITH {_LATEST}, x AS (SELECT id, draft, line AS start, line + span_words AS "end", span_words FROM f)
        SELECT id, draft, start, "end" FROM x w WHERE span_words < 20 AND NOT EXISTS (SELECT 1 FROM x s WHERE s.span_words >= 20 AND s.draft = w.draft AND s.start <= w.start AND w."end" <= s."end")""",
    "intersection_suppression": f"""WITH {_LATEST}, x AS (SELECT id, draft, line AS start, line + span_words AS "end", tier FROM f)
        SELECT id, draft, start, "end" FROM x w WHERE tier <> 'exact' AND NOT EXISTS (SELECT 1 FROM x s WHERE s.tier = 'exact' AND s.draft = w.draft AND s.start < w."end" AND w.start < s."end")""",
    "finding_order": f"WITH {_LATEST} SELECT id, citekey, span_words, line FROM f ORDER BY span_words DESC, citekey, line, id LIMIT 25",
}
