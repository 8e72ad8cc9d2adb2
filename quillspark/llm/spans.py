"""Problem 2: long exact spans shared between records.

Content-defined chunking over words. A gear rolling hash over GEAR_WORDS words runs through every record; a cut is a place where
that hash is the least of some window of WINDOW places (a windowed minimum in place of the usual condition on the hash's bits,
for it bounds the distance of cuts). Cuts depend on the nearby words only, so chunks resist insertions and deletions. A chunk
runs from a cut to the first cut at least LEAST_GRAMS places on, as chunks of a least size do, and begins at every cut; its words
(to the last word of the gram that makes its end) are digested, and the digests counted over all records. Chunks have 8 to 10
words, few enough of which repeat by chance.

Why no shared run is missed: let a run of 12 words hold the grams 0 to 9. The least gram c of the window 0..2 is a cut in every
record that has the run. Its chunk ends at the first cut from c + 5 on. The window c+5..c+7 lies within the run; its least gram q
is a cut in all these records, so the end is at most q. Other cuts between c + 5 and q come from windows within the run, and are
the same everywhere, or from windows that reach beyond gram 9: these could only add gram 8 with q = 9, but they contain q, which
is no greater than gram 8, and of equal grams the last one counts. So the chunk is the same in every such record, and shared.
Chunks being shorter than a span, a second count verifies: of the windows of MIN_WORDS words around shared chunks only,
digests are counted in the same way. Their union per record is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared_keys import SCHEMA, Settler, shared_rows
from quillspark.llm.words import mix, prefix_polynomial, range_digest, word_hashes, words_text
from quillspark.session import cut_lineage, load

MIN_WORDS = 12
GEAR_WORDS = 3
#: Places of a window, and least grams of a chunk: two windows with that distance must fit into the grams of a span.
WINDOW = 3
LEAST_GRAMS = MIN_WORDS - GEAR_WORDS + 1 - 2 * WINDOW + 1
TABLES = ("passages", "draft_sentences", "source_sentences")
IDS = {"passages": "passage_id", "draft_sentences": "sent_id", "source_sentences": "src_id"}


def gear(hashes: np.ndarray, width: int) -> np.ndarray:
    """Gear hash at every word, over it and the width - 1 words after it: h = (h << 1) + G[word], cut off at width words."""
    h = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h << np.uint64(1)) + mix(hashes[i : i + len(h)])
    return mix(h)


def cuts(hashes: np.ndarray, offsets: np.ndarray, width: int, window: int) -> np.ndarray:
    """Word positions at which a chunk begins: grams that are the least (the last of equals) of a window inside one record."""
    n = len(hashes) - width + 1
    if n < window:
        return np.empty(0, np.int64)
    h = gear(hashes, width)
    best = np.arange(n - window + 1)
    for i in range(1, window):
        other = np.arange(i, n - window + 1 + i)
        best = np.where(h[other] <= h[best], other, best)
    record = np.searchsorted(offsets, np.arange(len(best)), side="right")
    inside = np.arange(len(best)) + window + width - 1 <= offsets[np.minimum(record, len(offsets) - 1)]
    chosen = np.zeros(n, bool)
    chosen[best[inside]] = True
    return np.flatnonzero(chosen)


def chunk_bounds(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record number, first word and end of each chunk: from every cut to the first one LEAST_GRAMS on, of the same record."""
    at = cuts(hashes, offsets, GEAR_WORDS, WINDOW)
    record = np.searchsorted(offsets, at, side="right") - 1
    end = np.searchsorted(at, at + LEAST_GRAMS)
    ok = end < len(at)
    ok[ok] = record[end[ok]] == record[ok]
    return record[ok], at[ok], at[end[ok]] + GEAR_WORDS


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Settler()
    for b in batches:
        hashes, offsets = word_hashes(b.column("words"))
        record, start, end = chunk_bounds(hashes, offsets)
        if len(record):
            sums, powers = prefix_polynomial(hashes)
            key = range_digest(sums, powers, start, end).view(np.int64)
            yield from out.add(key, b.column("rec").to_numpy()[record], start - offsets[record], end - start)
    yield from out.flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of MIN_WORDS words that contain a shared chunk."""
    out = Settler()
    for b in batches:
        hashes, offsets = word_hashes(b.column("words"))
        hits = b.column("hits")
        counts = np.diff(hits.offsets.to_numpy())
        flat = hits.flatten()
        at, size = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        record = np.repeat(np.arange(len(counts)), counts)
        length = np.diff(offsets)[record]
        low, high = np.maximum(at + size - MIN_WORDS, 0), np.minimum(at, length - MIN_WORDS)
        ok = low <= high
        low, high, base = low[ok], high[ok], offsets[:-1][record[ok]]
        mark = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(mark, base + low, 1)
        np.add.at(mark, base + high + 1, -1)
        start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        if len(start):
            sums, powers = prefix_polynomial(hashes)
            key = range_digest(sums, powers, start, start + MIN_WORDS).view(np.int64)
            record = np.searchsorted(offsets, start, side="right") - 1
            yield from out.add(key, b.column("rec").to_numpy()[record], start - offsets[record], np.full(len(start), MIN_WORDS))
    yield from out.flush()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, words) of the three tables without scan rows: rec holds id and table; one passage_id is one record."""
    parts = []
    for code, table in enumerate(TABLES):
        df = load(spark, sf_dir, table)
        if "origin" in df.columns:
            df = df.where(F.col("origin").isNull() | (F.col("origin") != "scan"))
        parts.append(df.where(F.col("text").isNotNull()).select((F.col(IDS[table]) * 4 + code).alias("rec"), words_text(F.col("text")).alias("words")))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.where((F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))) >= MIN_WORDS - 1)


def shared_windows(recs: DataFrame) -> DataFrame:
    """(rec, at): every window of MIN_WORDS words, by its first word, that also stands in another record.

    recs has rec (long, the record's identity; rows that repeat it are one record) and words (text as words_text gives it).
    Null or short texts have no window; repeated rows and ties don't change the result.
    """
    chunks = cut_lineage(shared_rows(recs.select("rec", "words").mapInArrow(_chunks, SCHEMA)), "chunks")
    hits = chunks.groupBy("rec").agg(F.collect_set(F.struct("at", "size")).alias("hits"))
    found = recs.dropDuplicates(["rec"]).join(hits, "rec").select("rec", "words", "hits")
    return shared_rows(found.mapInArrow(_windows, SCHEMA)).select("rec", "at").distinct()


def named(df: DataFrame) -> DataFrame:
    """rec_table and rec_id in place of rec."""
    table = F.element_at(F.array(*(F.lit(t) for t in TABLES)), (F.col("rec") % 4 + 1).cast("int"))
    return df.select(table.alias("rec_table"), F.floor(F.col("rec") / 4).alias("rec_id"), *(c for c in df.columns if c != "rec"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a run of MIN_WORDS words that also stands in another record."""
    return named(shared_windows(records(spark, sf_dir)).select("rec").distinct())


def shared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal shared spans of every record: windows that touch or overlap become one (gaps and islands)."""
    from pyspark.sql import Window

    w = Window.partitionBy("rec").orderBy("at")
    gap = F.col("at") > F.lag("at").over(w) + MIN_WORDS
    spans = shared_windows(records(spark, sf_dir)).withColumn("span", F.sum(F.when(gap, 1).otherwise(0)).over(w))
    return spans.groupBy("rec", "span").agg(F.min("at").alias("word_start"), (F.max("at") + MIN_WORDS).alias("word_end")).drop("span")


def p2_shared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_table, rec_id, word_start, word_end of each shared span."""
    return named(shared_spans(spark, sf_dir))


def p2_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record with a shared span: its words, how many of them are shared elsewhere, and their share."""
    spans = shared_spans(spark, sf_dir).groupBy("rec").agg(F.sum(F.col("word_end") - F.col("word_start")).alias("shared_words"), F.count("*").alias("spans"))
    sizes = records(spark, sf_dir).dropDuplicates(["rec"]).select("rec", (F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1).alias("words"))
    return named(sizes.join(spans, "rec").withColumn("share", F.round(F.col("shared_words") / F.col("words"), 6)))
