"""Queries on ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import overlap, retrieval
from quillspark.plans.corpus_queries import _DELIVERY, _ledger
from quillspark.session import load

TOPICS = (
    (1, "sparse sensor calibration of the vector"),
    (2, "turbine and furnace, pump or boiler"),
    (3, "citation draft ledger claim passage"),
    (4, "robust gateway network; controller platform"),
)


def topic_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOPICS), "query_id int, query string")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_of(load(spark, d, "documents"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.topk(documents(spark, d), topic_queries(spark).where("query_id = 1"), 5)


def bm25_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.topk(documents(spark, d), topic_queries(spark), 15)


def bm25_scoped_lang(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes after scoring: statistics are those of all documents."""
    scored = retrieval.scores(documents(spark, d), topic_queries(spark))
    german = load(spark, d, "documents").where("lower(lang) = 'en'").select(F.col("doc_id").alias("key"))
    return retrieval.ranked(scored.join(german, "key", "left_semi"), 5)


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_stats(documents(spark, d))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lengths(documents(spark, d))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Citekeys of the first 15 documents of each query."""
    hits = bm25_multi_query(spark, d)
    keys = load(spark, d, "documents").where("citekey is not null").select(F.col("doc_id").alias("key"), "citekey")
    return hits.join(keys, "key").select(F.col("citekey").alias("key")).distinct()


def cited(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "draft_sentences").select(F.explode("citekeys").alias("key")).distinct()


def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.coverage(candidates(spark, d), cited(spark, d))


def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.coverage_percent(coverage_report(spark, d))


def drift_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Hits that no draft cites yet."""
    return candidates(spark, d).join(cited(spark, d), "key", "left_anti")


def drift_missing(spark: SparkSession, d: str) -> DataFrame:
    """Cited keys that the ledger as it was before doesn't hold."""
    return cited(spark, d).join(_ledger(spark, d).select(F.col("citekey").alias("key")), "key", "left_anti")


def drift_reconsider(spark: SparkSession, d: str) -> DataFrame:
    """Hits that the claims of drafts left uncited although a passage of theirs was flagged as reused."""
    flagged = load(spark, d, "overlap_df").where("not cites_source").select(F.col("citekey").alias("key")).distinct()
    return candidates(spark, d).join(flagged, "key", "left_semi").join(cited(spark, d), "key", "left_anti")


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall and gain of BM25 with held-out items as queries; relevant are documents with an 8-gram of the item."""
    items = load(spark, d, "eval_items")
    docs = load(spark, d, "documents")
    grams = overlap.positions(items, "item_id", "text").select(F.col("key").alias("query_id"), "gram").distinct()
    relevant = overlap.positions(docs, "doc_id", "text").join(grams, "gram").select("query_id", "key").distinct()
    rankings = retrieval.topk(retrieval.corpus_of(docs), items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5)
    return retrieval.quality(rankings, relevant, 5)


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_multi_query, bm25_scoped_lang, bm25_term_stats, doc_lengths, coverage_report, coverage_pct, drift_candidates, drift_missing, drift_reconsider, retrieval_quality)}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.BM25_STOP) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"


def grams_sql(text: str, n: int = 8) -> str:
    w = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' '))"


_TOPICS = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in TOPICS) + ") AS v(query_id, query)"
_IDF = "ln((n - df + 0.5e0) / (df + 0.5e0) + 1)"


def bm25_sql(queries: str, k: int | None, where: str = "") -> str:
    """Common table expressions of a ranking; queries is a relation (query_id, query)."""
    return f"""
        tok AS (SELECT doc_id AS key, {tokens_sql("coalesce(text, '')")} AS tokens FROM documents),
        st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
        qt AS (SELECT DISTINCT query_id, unnest({tokens_sql('query')}) AS term FROM {queries}),
        po AS (SELECT key, length, term, count(*) AS tf FROM (SELECT key, len(tokens) AS length, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY key, length, term),
        fr AS (SELECT term, count(*) AS df FROM po GROUP BY term),
        sc AS (SELECT query_id, key, round(sum({_IDF} * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / avgdl))), 4) AS score
               FROM po JOIN fr USING (term) CROSS JOIN st JOIN qt USING (term) GROUP BY query_id, key),
        rk AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS BIGINT) AS rank, key, score FROM sc {where}),
        hits AS (SELECT * FROM rk WHERE rank <= {k})"""


_CANDIDATES = f"WITH {bm25_sql(_TOPICS, 15)}, cand AS (SELECT DISTINCT citekey AS key FROM hits JOIN documents ON doc_id = hits.key WHERE citekey IS NOT NULL), cited AS (SELECT DISTINCT unnest(citekeys) AS key FROM draft_sentences)"
_COVERAGE = f"""{_CANDIDATES}, report AS (SELECT coalesce(cand.key, cited.key) AS key, CASE WHEN cand.key IS NOT NULL AND cited.key IS NOT NULL THEN 'covered' WHEN cand.key IS NOT NULL THEN 'missed' ELSE 'outside' END AS status
    FROM cand FULL JOIN cited ON cand.key = cited.key)"""

SQL = {
    "bm25_topk": f"WITH {bm25_sql(f'(SELECT * FROM {_TOPICS} WHERE query_id = 1)', 5)} SELECT * FROM hits",
    "bm25_multi_query": f"WITH {bm25_sql(_TOPICS, 15)} SELECT * FROM hits",
    "bm25_scoped_lang": f"WITH {bm25_sql(_TOPICS, 5, 'WHERE key IN (SELECT doc_id FROM documents WHERE lower(lang) = ' + chr(39) + 'en' + chr(39) + ')')} SELECT * FROM hits",
    "bm25_term_stats": f"""WITH tok AS (SELECT doc_id AS key, {tokens_sql("coalesce(text, '')")} AS tokens FROM documents), st AS (SELECT count(*) AS n FROM tok),
        tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(tokens) AS term FROM tok) GROUP BY key, term),
        s AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term) SELECT term, df, cf, round({_IDF}, 4) AS idf FROM s CROSS JOIN st""",
    "doc_lengths": f"""SELECT doc_id AS key, CAST(len({tokens_sql("coalesce(text, '')")}) AS BIGINT) AS length FROM documents""",
    "coverage_report": f"{_COVERAGE} SELECT key, status FROM report",
    "coverage_pct": f"""{_COVERAGE} SELECT count_if(status = 'covered')::BIGINT AS covered, count_if(status = 'missed')::BIGINT AS missed, count_if(status = 'outside')::BIGINT AS outside,
        round(100.0e0 * count_if(status = 'covered') / nullif(count_if(status <> 'outside'), 0), 4) AS percent FROM report""",
    "drift_candidates": f"{_CANDIDATES} SELECT key FROM cand WHERE key NOT IN (SELECT key FROM cited)",
    "drift_missing": f"WITH {_DELIVERY} SELECT DISTINCT key FROM (SELECT unnest(citekeys) AS key FROM draft_sentences) WHERE key NOT IN (SELECT citekey FROM lg)",
    "drift_reconsider": f"{_CANDIDATES} SELECT key FROM cand WHERE key NOT IN (SELECT key FROM cited) AND key IN (SELECT citekey FROM overlap_df WHERE NOT cites_source)",
    "retrieval_quality": f"""WITH {bm25_sql('(SELECT item_id AS query_id, text AS query FROM eval_items)', 5)},
        ig AS (SELECT DISTINCT item_id AS query_id, unnest({grams_sql('text')}) AS gram FROM eval_items),
        rel AS (SELECT DISTINCT query_id, key FROM (SELECT doc_id AS key, unnest({grams_sql('text')}) AS gram FROM documents WHERE text IS NOT NULL) JOIN ig USING (gram)),
        c AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
        g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM hits JOIN rel USING (query_id, key) GROUP BY query_id)
        SELECT query_id, CASE WHEN dcg IS NULL THEN 0.0e0 ELSE 1.0e0 END AS recall,
               round(coalesce(dcg, 0.0e0) / list_sum(list_transform(range(1, CAST(least(n, 5) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg
        FROM c LEFT JOIN g USING (query_id)""",
}
