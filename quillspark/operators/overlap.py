"""Text reuse between drafts and a corpus: n-gram joins, diagonals, islands, findings and their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import spread

N = 8


def positions(rows: DataFrame, key: str, text: str, n: int = N) -> DataFrame:
    """(key, pos, gram) of every run of n words, the gram as a 64-bit hash; texts with fewer words and null texts have none.

    Words are a column of their own first: as part of the expression of the grams they would be found anew for each gram. m
    different grams give m^2 / 2^65 false matches on average.
    """
    tokens = spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", T.words(F.col("text")).alias("tokens"))
    return tokens.select("key", F.posexplode(T.ngram_hashes(F.col("tokens"), n)).alias("pos", "gram"))


def matches(drafts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(draft_key, key, pos, diag): every gram of a draft that stands in a source, with its diagonal. Inputs: (key, pos, gram).

    One equi-join on the gram. A gram that is frequent on both sides multiplies only within draft and source pairs that share it,
    which is the result asked for; the adaptive skew join splits its partition.
    """
    d = drafts.select(F.col("key").alias("draft_key"), "pos", "gram")
    c = corpus.select("key", F.col("pos").alias("source_pos"), "gram")
    return d.join(c, "gram").select("draft_key", "key", "pos", (F.col("source_pos") - F.col("pos")).alias("diag"))


def islands(hits: DataFrame, keys: list[str], n: int = N, gap: int = 1) -> DataFrame:
    """Runs of starts on a diagonal: neighbours merge when next - previous - n <= gap. Adds start, end, span and matched words."""
    w = Window.partitionBy(*keys).orderBy("pos")
    previous = F.lag("pos").over(w)
    opened = F.when(previous.isNull() | (F.col("pos") - previous - n > gap), 1).otherwise(0)
    fresh = F.when(previous.isNull(), n).otherwise(F.least(F.lit(n), F.col("pos") - previous))
    runs = hits.select(*keys, "pos").distinct().withColumn("opened", opened).withColumn("fresh", fresh)
    runs = runs.withColumn("island", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "island").agg(F.min("pos").alias("start"), (F.max("pos") + n).alias("end"), F.sum("fresh").alias("matched_words"))
    return out.drop("island").withColumn("span_words", F.col("end") - F.col("start")).select(*keys, *(F.col(c).cast("long") for c in ("start", "end", "span_words", "matched_words")))


def merge_spans(spans: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """Spans (start, end) merged when the start lies at most gap beyond the greatest end so far."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0)
    run = spans.withColumn("opened", opened).withColumn("run", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def suppress_contained(weak: DataFrame, strong: DataFrame, key: str) -> DataFrame:
    """Rows of weak that lie in no row of strong of the same key (equi-join with a range condition)."""
    s = strong.select(F.col(key).alias("s_key"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return weak.join(s, (weak[key] == s.s_key) & (s.s_start <= weak.start) & (weak.end <= s.s_end), "left_anti")


def suppress_touching(weak: DataFrame, strong: DataFrame, key: str) -> DataFrame:
    """Rows of weak that share no word with a row of strong of the same key."""
    s = strong.select(F.col(key).alias("s_key"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return weak.join(s, (weak[key] == s.s_key) & (s.s_start < weak.end) & (weak.start < s.s_end), "left_anti")


def document_frequency(postings: DataFrame) -> DataFrame:
    """(gram, postings, df) over postings (gram, citekey); rows without either don't count."""
    return postings.where("gram is not null and citekey is not null").groupBy("gram").agg(F.count("*").alias("postings"), F.count_distinct("citekey").alias("df"))


def profile(findings: DataFrame, df: DataFrame, n: int = N) -> DataFrame:
    """Per finding (id, fragment): grams and least, median and greatest document frequency of its grams; 0 for unknown ones."""
    tokens = findings.select("id", T.words(F.col("fragment")).alias("tokens"))
    grams = tokens.select("id", F.explode(T.ngrams(F.col("tokens"), n)).alias("gram"))
    counts = grams.join(df.select("gram", "df"), "gram", "left").fillna(0, ["df"])
    return counts.groupBy("id").agg(F.count("*").alias("grams"), F.min("df").alias("min_df"), F.floor(F.median("df")).cast("long").alias("median_df"), F.max("df").alias("max_df"))


def threshold_sweep(findings: DataFrame, thresholds: list[int]) -> DataFrame:
    """Per threshold of span words: findings blocked, and how many of them cite their source. A few thresholds: one pass."""
    t = F.explode(F.array(*(F.lit(x) for x in thresholds))).alias("threshold")
    hit = F.col("span_words") >= F.col("threshold")
    rows = findings.select(t, "span_words", "cites_source", "draft")
    cites = F.count_if(hit & F.col("cites_source"))
    return rows.groupBy("threshold").agg(F.count_if(hit).alias("blocked"), cites.alias("citing"), F.count_distinct(F.when(hit, F.col("draft"))).alias("drafts"), F.round(cites / F.nullif(F.count_if(hit), F.lit(0)), 4).alias("precision"))


def baseline_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, state): resolved, persisting or new, by the ids of two runs."""
    b, a = before.select("id").distinct().withColumn("b", F.lit(True)), after.select("id").distinct().withColumn("a", F.lit(True))
    return b.join(a, "id", "full_outer").select("id", F.when(F.col("a").isNull(), "resolved").when(F.col("b").isNull(), "new").otherwise("persisting").alias("state"))


def jaccard(left: DataFrame, right: DataFrame, n: int = N) -> DataFrame:
    """Per pair that shares a gram: shared grams and Jaccard similarity of the two sets. Inputs: (key, pos, gram)."""
    a = left.select(F.col("key").alias("left_key"), "gram").distinct()
    b = right.select(F.col("key").alias("right_key"), "gram").distinct()
    na, nb = a.groupBy("left_key").agg(F.count("*").alias("na")), b.groupBy("right_key").agg(F.count("*").alias("nb"))
    shared = a.join(b, "gram").groupBy("left_key", "right_key").agg(F.count("*").alias("shared"))
    return shared.join(na, "left_key").join(nb, "right_key").select("left_key", "right_key", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4).alias("jaccard"))
