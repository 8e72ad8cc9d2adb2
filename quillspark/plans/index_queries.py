"""Queries on the stored index of postings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import drafts, index, overlap, structure
from quillspark.plans.overlap_queries import _HITS
from quillspark.plans.retrieval_queries import grams_sql
from quillspark.session import load, shared_dir


def _refreshed(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """An index of the source sentences as of the last day but one of deliveries, brought up to date with all of them."""
    path = f"{shared_dir(spark)}/quillspark/index-{uuid.uuid4().hex}"
    rows = load(spark, d, "source_sentences")
    last = rows.agg(F.max(F.to_date("loaded_at"))).first()[0]
    texts = rows.select(F.col("src_id").alias("key"), "text", F.coalesce(F.to_date("loaded_at") < F.lit(last), F.lit(True)).alias("early"))
    index.refresh(spark, path, texts.where("early"))
    return path, index.refresh(spark, path, texts)


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """What a refresh of the index did to each source sentence."""
    return _refreshed(spark, d)[1].select(F.col("key").cast("long").alias("key"), "state")


def index_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of each source sentence in the refreshed index."""
    return index.postings(spark, _refreshed(spark, d)[0]).groupBy(F.col("key").cast("long").alias("key")).agg(F.count("*").alias("postings"))


def index_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of draft sentences with the refreshed index by diagonal."""
    stored = index.postings(spark, _refreshed(spark, d)[0]).withColumn("key", F.col("key").cast("long"))
    asked = overlap.positions(load(spark, d, "draft_sentences"), "sent_id", "text")
    return overlap.matches(asked, stored).groupBy("draft_key", "key", "diag").agg(F.count("*").alias("grams")).withColumn("diag", F.col("diag").cast("long"))


def skipgram_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the drafts' skip-grams in a stored index of the sources' skip-grams (stems: rows only)."""
    path = f"{shared_dir(spark)}/quillspark/index-{uuid.uuid4().hex}"
    index.refresh(spark, path, load(spark, d, "source_sentences").select(F.col("src_id").alias("key"), "text"), index.skip_grams)
    asked = index.skip_grams(load(spark, d, "draft_sentences").select(F.col("sent_id").alias("key"), "text"))
    return index.lookup(index.postings(spark, path), asked)


def skipgram_pages(spark: SparkSession, d: str) -> DataFrame:
    """Skip-grams of each page of the parsed documents: the page is that of the window's first word (stems: rows only)."""
    docs = load(spark, d, "documents").where("source = 'parsed_pdf' and text is not null").select("doc_id", "text")
    pages = docs.select(F.col("doc_id").alias("key"), F.posexplode(T.pages(F.col("text"))).alias("page", "text")).select("key", "page", F.size(T.words(F.col("text"))).alias("n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    marks = pages.withColumn("pos", before).groupBy("key", "pos").agg(F.max("page").alias("page"))
    grams = drafts.skipgrams(docs, "doc_id", "text").select("key", F.col("start").alias("pos"))
    return structure.asof(grams, marks, "key", "pos", "page").groupBy("key", "page").agg(F.count("*").alias("grams"))


_F = (index_refresh, index_postings, index_matches, skipgram_lookup, skipgram_pages)
QUERIES = {f.__name__: f for f in _F}

SQL = {
    "index_refresh": "SELECT src_id AS key, CASE WHEN CAST(loaded_at AS DATE) < (SELECT max(CAST(loaded_at AS DATE)) FROM source_sentences) OR loaded_at IS NULL THEN 'unchanged' ELSE 'rebuilt' END AS state FROM source_sentences",
    "index_postings": f"SELECT src_id AS key, CAST(len({grams_sql('text')}) AS BIGINT) AS postings FROM source_sentences WHERE len({grams_sql('text')}) > 0",
    "index_matches": f"WITH {_HITS.replace('SELECT DISTINCT d.key', 'SELECT d.key')} SELECT draft_key, key, diag, count(*) AS grams FROM h GROUP BY ALL",
}
