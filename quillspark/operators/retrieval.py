"""Ranked retrieval: BM25, coverage, drift and quality metrics.

A corpus is (key, text). Scores are taken over all documents before any filter; ties go to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import cut_lineage, spread

K1, B = 1.5, 0.75
#: Query terms that are held in the plan, and numbers of their matrix (terms by queries, 8 MB); beyond, documents are searched in groups.
MOST_TERMS, MATRIX_NUMBERS = 20_000, 1_000_000
#: Pairs of query and term that are sent to the documents (12 bytes each); beyond, or where all scores are asked for, joins are shuffled.
MOST_PAIRS = 8_000_000
#: Tokens of the documents that are searched at once, queries of a product there, its most terms, those in more than one of so many
#: documents, and more than what single precision may lose of a score.
TOKENS_AT_ONCE, QUERIES_AT_ONCE, COMMON_TERMS, COMMON, LOSS = 1_500_000, 256, 512, 32, 5e-3
#: Products of a batch held at once, and by how much scores may differ that are equal when rounded.
CELLS_AT_ONCE, TIED = 4_000_000, 1.1e-4


def corpus_of(documents: DataFrame, *extra: str) -> DataFrame:
    """(key, text) of the documents, and further columns by name."""
    return spread(documents.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"), *extra))


def term_frequencies(corpus: DataFrame) -> DataFrame:
    """(key, term, tf): counts combine map-side; a document without terms has no row."""
    return corpus.select("key", F.explode(T.bm25_tokens(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def lengths(corpus: DataFrame) -> DataFrame:
    """(key, length) of every document, empty ones included."""
    return corpus.select("key", F.size(T.bm25_tokens(F.col("text"))).cast("long").alias("length"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_stats(corpus: DataFrame) -> DataFrame:
    """(term, df, cf, idf) over the whole corpus. A document is a row, so its distinct terms are counted there; one shuffle of sums."""
    n = corpus.agg(F.count("*").alias("n"))  # one row
    tokens = corpus.select(T.bm25_tokens(F.col("text")).alias("tokens"))
    of = lambda words, df: F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(df).alias("df")))
    marks = F.concat(of(F.array_distinct("tokens"), 1), of(F.col("tokens"), 0))
    stats = tokens.select(F.explode(marks).alias("m")).groupBy("m.term").agg(F.sum("m.df").alias("df"), F.count_if(F.col("m.df") == 0).alias("cf"))
    return stats.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(idf(F.col("n"), F.col("df")), 4).alias("idf"))


def scores(corpus: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, key, score) of documents that hold a term of the query; with most, of each query at least the most best ones.

    queries: (query_id, query), a stated set; a term counts once per query. The corpus is read and tokenised once: of each document
    its length and its tokens that are query terms are kept, and everything else works on this small table. Where the queries' terms
    are at most MOST_TERMS and their matrix at most MATRIX_NUMBERS, the matrix is sent to the documents and a batch is one product.
    Beyond, where only the best are asked for, the queries' terms are sent (at most MOST_PAIRS) and documents are searched in groups;
    else tokens are met with the terms by shuffled joins. All give the same rows.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.bm25_tokens(F.col("query")))).alias("term")).distinct()
    known = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    few = len(known) <= MOST_TERMS
    tokens = corpus.select("key", T.bm25_tokens(F.col("text")).alias("tokens"))
    hits = F.filter("tokens", lambda w: w.isin(known)) if few else F.col("tokens")
    kept = cut_lineage(tokens.select("key", F.size("tokens").cast("long").alias("length"), hits.alias("hits")), "bm25")
    total = kept.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))  # one row
    df = kept.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if not few:
        df = df.join(terms.select("term").distinct(), "term", "left_semi")
    asked = terms.select("query_id").distinct().limit(MATRIX_NUMBERS + 1).count()
    if few and asked * max(len(known), 1) <= MATRIX_NUMBERS:
        return _products(kept.where(F.size("hits") > 0), terms, {r["term"]: r["df"] for r in df.collect()}, total.first(), most)
    if most:
        terms = cut_lineage(terms.join(df, "term"), "terms")
        if terms.count() <= MOST_PAIRS:
            return _searched(kept.where(F.size("hits") > 0), terms, total.first(), most)
        terms = terms.drop("df")
    occurrences = kept.select("key", "length", F.explode("hits").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    postings = occurrences.groupBy("key", "length", "term").agg(F.count("*").alias("tf"))
    weights = terms.join(df, "term")
    norm = F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("avgdl")
    weight = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    return postings.join(weights, "term").crossJoin(F.broadcast(total)).groupBy("query_id", "key").agg(F.sum(weight).alias("score")).where("score > 0")


def _products(kept: DataFrame, terms: DataFrame, df: dict[str, int], total, most: int | None) -> DataFrame:
    """Scores by a matrix of the terms' weights by query: documents stay where they are. At most MOST_TERMS terms, MATRIX_NUMBERS numbers."""
    rows = [r for r in terms.collect() if r["term"] in df]
    names, asked = sorted({r["term"] for r in rows}), sorted({r["query_id"] for r in rows})
    place, column = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(asked)}
    weights = np.zeros((len(names), len(asked)))
    for r in rows:
        n = df[r["term"]]
        weights[place[r["term"]], column[r["query_id"]]] = math.log((total["n"] - n + 0.5) / (n + 0.5) + 1)
    avgdl, vocabulary = total["avgdl"] or 1.0, pa.array(names, pa.string())
    kinds = dict(terms.dtypes)["query_id"], dict(kept.dtypes)["key"]
    id_type = pa.int32() if kinds[0] == "int" else pa.int64() if kinds[0] == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("hits")
            code = pc.index_in(lists.flatten(), vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pair, tf = np.unique(doc * len(names) + code, return_counts=True)
            doc, code = np.divmod(pair, len(names))
            norm = 1 - B + B * b.column("length").to_numpy() / avgdl
            gain = tf * (K1 + 1) / (tf + K1 * norm[doc])
            best = []
            step = max(1, CELLS_AT_ONCE // max(1, len(asked) * max(1, len(pair) // max(1, len(sizes)))))
            for s in range(0, len(sizes), step):
                low, high = np.searchsorted(doc, [s, s + step])
                if low == high:
                    continue
                held, starts = np.unique(doc[low:high], return_index=True)
                score = np.add.reduceat(gain[low:high, None] * weights[code[low:high]], starts, axis=0)
                if most and len(held) > most:
                    floor = np.partition(score, len(held) - most, axis=0)[len(held) - most] - TIED
                    at, of = np.nonzero((score > 0) & (score >= floor))
                else:
                    at, of = np.nonzero(score > 0)
                best.append((of, held[at], score[at, of]))
            if best:
                of, at, score = (np.concatenate(x) for x in zip(*best, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in of], id_type), b.column("key").take(pa.array(at)), pa.array(score)], names=["query_id", "key", "score"])

    return kept.mapInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, score double")


def _searched(kept: DataFrame, terms: DataFrame, total, most: int) -> DataFrame:
    """At least the most best scores of each query; terms: (query_id, term, df).

    In a group of documents the common terms' gains are one product in single precision a block of queries, those of other terms are
    added from lists. What comes within LOSS of the most-th best score found so far is scored again in double precision, so no
    document that is among the best is left out.
    """
    rows = terms.select("query_id", "term", "df").toArrow()
    kinds = dict(terms.dtypes)["query_id"], dict(kept.dtypes)["key"]
    words = pc.dictionary_encode(rows["term"].combine_chunks())
    ids = pc.dictionary_encode(rows["query_id"].combine_chunks())
    vocabulary, asked = words.dictionary, ids.dictionary
    code, query = words.indices.to_numpy(), ids.indices.to_numpy()
    order = np.argsort(query, kind="stable")
    code, query = code[order], query[order]
    starts = np.searchsorted(query, np.arange(len(asked) + 1))
    held = np.zeros(len(vocabulary))
    held[words.indices.to_numpy()] = rows["df"].to_numpy()
    weight, avgdl = np.log((total["n"] - held + 0.5) / (held + 0.5) + 1), total["avgdl"] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(len(asked))
        parts, n = [], 0
        for b in batches:
            step = max(1, b.num_rows * TOKENS_AT_ONCE // max(1, len(b.column("hits").flatten())))
            for s in range(0, b.num_rows, step):
                parts.append(b.slice(s, step))
                n += len(parts[-1].column("hits").flatten())
                if n >= TOKENS_AT_ONCE:
                    yield from search(pa.Table.from_batches(parts).combine_chunks().to_batches(), floor)
                    parts, n = [], 0
        if parts:
            yield from search(pa.Table.from_batches(parts).combine_chunks().to_batches(), floor)

    def search(group: list[pa.RecordBatch], floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in group:
            lists = b.column("hits")
            at = pc.index_in(lists.flatten(), vocabulary)
            sizes = np.diff(lists.offsets.to_numpy())
            found = at.is_valid().to_numpy(zero_copy_only=False)
            of, doc = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)[found], np.repeat(np.arange(len(sizes)), sizes)[found]
            pair, tf = np.unique(of * len(sizes) + doc, return_counts=True)
            of, doc = np.divmod(pair, max(1, len(sizes)))
            norm = 1 - B + B * b.column("length").to_numpy() / avgdl
            gain = weight[of] * (tf * (K1 + 1) / (tf + K1 * norm[doc]))
            ends = np.searchsorted(of, np.arange(len(vocabulary) + 1))
            held = np.diff(ends)
            common = np.argsort(-held, kind="stable")[:COMMON_TERMS]
            common = common[held[common] * COMMON > len(sizes)]
            row = np.full(len(vocabulary), -1)
            row[common] = np.arange(len(common))
            gains = np.zeros((len(common), len(sizes)), np.float32)
            for r, t in enumerate(common):
                gains[r, doc[ends[t] : ends[t + 1]]] = gain[ends[t] : ends[t + 1]]
            hits = []
            for first in range(0, len(asked), QUERIES_AT_ONCE):
                last = min(first + QUERIES_AT_ONCE, len(asked))
                part = slice(*np.searchsorted(query, [first, last]))
                named = row[code[part]] >= 0
                has = np.zeros((last - first, len(common)), np.float32)
                has[query[part][named] - first, row[code[part]][named]] = 1.0
                about = has @ gains
                for q in range(first, last):
                    its = code[starts[q] : starts[q + 1]]
                    its = its[held[its] > 0]
                    if not len(its):
                        continue
                    sums = about[q - first]
                    for t in its[row[its] < 0]:
                        sums[doc[ends[t] : ends[t + 1]]] += gain[ends[t] : ends[t + 1]]
                    docs = np.flatnonzero(sums >= floor[q] - LOSS) if floor[q] > LOSS else np.flatnonzero(sums)
                    if len(docs) > 2 * most:
                        s = sums[docs]
                        docs = docs[s >= np.partition(s, len(s) - most)[len(s) - most] - LOSS]
                    values = np.zeros(len(docs))
                    for t in its:
                        own = doc[ends[t] : ends[t + 1]]
                        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                        values += np.where(own[at] == docs, gain[ends[t] : ends[t + 1]][at], 0.0)
                    if len(docs) >= most:
                        floor[q] = max(floor[q], np.partition(values, len(values) - most)[len(values) - most])
                    good = (values > 0) & (values >= floor[q] - TIED)
                    if good.any():
                        hits.append((np.full(np.count_nonzero(good), q), docs[good], values[good]))
            if hits:
                q, docs, values = (np.concatenate(x) for x in zip(*hits, strict=True))
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), b.column("key").take(pa.array(docs)), pa.array(values)], names=["query_id", "key", "score"])

    return kept.mapInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, score double")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query: (query_id, rank, key, score)."""
    rounded = scored.withColumn("score", F.round("score", 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return rounded.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def topk(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    return ranked(scores(corpus, queries, k), k)


def coverage(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """(key, status): cited candidates, candidates not cited, and citations that are no candidates. Inputs have key."""
    c, h = cited.select("key").distinct().withColumn("cited", F.lit(True)), hits.select("key").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("cited") & F.col("hit"), "covered").when(F.col("hit"), "missed").otherwise("outside")
    return h.join(c, "key", "full_outer").select("key", status.alias("status"))


def coverage_percent(report: DataFrame) -> DataFrame:
    """One row: counts by status and the covered share of candidates, null without candidates."""
    covered, missed = F.count_if(F.col("status") == "covered"), F.count_if(F.col("status") == "missed")
    return report.agg(covered.alias("covered"), missed.alias("missed"), F.count_if(F.col("status") == "outside").alias("outside"), F.round(F.lit(100.0) * covered / F.nullif(covered + missed, F.lit(0)), 4).alias("percent"))


def quality(rankings: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall, ndcg) per query with relevant keys: hit in the first k, and normalised gain with binary relevance."""
    rel = relevant.select("query_id", "key").distinct()
    counts = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    gains = rankings.where(F.col("rank") <= k).join(rel, ["query_id", "key"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return counts.join(gains, "query_id", "left").select("query_id", F.when(F.col("dcg").isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 4).alias("ndcg"))
