"""Reviews of drafts: citation gate, provenance, synthesis, uncited claims, sections, logs and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import structure


def citations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, citekey): citations of each text in order, repeats included."""
    return rows.select(F.col(key).alias("key"), F.posexplode(T.cited_keys(F.col(text))).alias("pos", "citekey"))


def gate(cited: DataFrame, known: DataFrame) -> DataFrame:
    """Citations whose key is unknown, and where each stands first; an empty result passes the gate."""
    return cited.join(known.select("citekey").distinct(), "citekey", "left_anti").groupBy("citekey").agg(F.count("*").alias("uses"), F.min("key").alias("first_key"))


def first_appearance(cited: DataFrame) -> DataFrame:
    """(number, citekey): distinct keys numbered in the order of their first use within each group.

    cited: (group, at, citekey), at an orderable place.
    """
    firsts = cited.groupBy("group", "citekey").agg(F.min("at").alias("at"))
    return firsts.select("group", F.row_number().over(Window.partitionBy("group").orderBy("at", "citekey")).cast("long").alias("number"), "citekey")


def synthesis(units: DataFrame) -> DataFrame:
    """Per draft: citing, uncited, single- and multi-source units, and the single-source share (null if none cites). Units: (draft, citekeys)."""
    n = F.size(F.array_distinct("citekeys"))
    single, citing = F.count_if(n == 1), F.count_if(n >= 1)
    return units.groupBy("draft").agg(citing.alias("citing"), F.count_if(n == 0).alias("uncited"), single.alias("single_source"), F.count_if(n > 1).alias("multi_source"), F.round(F.lit(100.0) * single / F.nullif(citing, F.lit(0)), 4).alias("single_percent"))


def longest_single_run(units: DataFrame) -> DataFrame:
    """Per draft the longest streak of consecutive units with the same single key; units without or with several keys break it.

    units: (draft, at, citekeys). One window per draft; a draft is bounded by what a person writes.
    """
    only = F.when(F.size(F.array_distinct("citekeys")) == 1, F.element_at("citekeys", 1))
    w = Window.partitionBy("draft").orderBy("at")
    rows = units.select("draft", "at", only.alias("only"))
    rows = rows.withColumn("opened", F.when(F.col("only").eqNullSafe(F.lag("only").over(w)) & F.col("only").isNotNull(), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("only is not null")
    runs = rows.groupBy("draft", "run", "only").agg(F.count("*").alias("length"), F.min("at").alias("at"))
    return runs.groupBy("draft").agg(F.max(F.struct("length", (-F.col("at")).alias("first"), "only")).alias("r")).select("draft", F.col("r.only").alias("citekey"), F.col("r.length").alias("length"))


def uncited(claims: DataFrame) -> DataFrame:
    """Per draft: claims without a citation, those in blocks that cite (bare), and their share."""
    bare = F.count_if(~F.col("cites") & F.col("block_cites"))
    none = F.count_if(~F.col("cites"))
    return claims.groupBy("draft").agg(F.count("*").alias("claims"), none.alias("uncited"), bare.alias("bare"), F.round(none / F.count("*"), 4).alias("share"))


def provenance(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(claim_id, citekey, score, passage_id): the best passage of the cited source for each claim and key.

    The score is the share of the claim's distinctive words in the passage; the first passage wins ties, a score of 0 has none.
    claims: (claim_id, citekey, text); passages: (passage_id, citekey, text). Joined on the key, so passages of other sources
    are never compared; the best of a claim is a maximum that combines map-side.
    """
    c = claims.select("claim_id", "citekey", T.distinctive(F.col("text")).alias("claim_words"))
    p = passages.where("text is not null").select("passage_id", "citekey", T.distinctive(F.col("text")).alias("passage_words"))
    score = F.size(F.array_intersect("claim_words", "passage_words")) / F.nullif(F.size("claim_words"), F.lit(0))
    scored = c.join(p, "citekey", "left").select("claim_id", "citekey", F.round(F.coalesce(score, F.lit(0.0)), 4).alias("score"), "passage_id")
    best = scored.groupBy("claim_id", "citekey").agg(F.max(F.struct("score", (-F.col("passage_id")).alias("first"))).alias("r"))
    return best.select("claim_id", "citekey", F.col("r.score").alias("score"), F.when(F.col("r.score") > 0, -F.col("r.first")).alias("passage_id"))


def segments(log: DataFrame, group: str, slice_, order: list[str], marker, cost: str) -> DataFrame:
    """(group, segment, calls, cost): sums between markers; markers count as no call, segments without a call are left out.

    slice_: a column that follows the order (the day of a time), by which a busy group is spread.
    """
    rows = log.withColumn("is_marker", marker)
    rows = structure.running_sum(rows, group, slice_, order, F.when(F.col("is_marker"), 1).otherwise(0), "segment")
    return rows.where(~F.col("is_marker")).groupBy(group, "segment").agg(F.count("*").alias("calls"), F.round(F.sum(cost), 2).alias("cost"))


def headings(documents: DataFrame) -> DataFrame:
    """(doc_id, line, level, title, end_line): Markdown headings and the lines they govern, up to the next heading or the end."""
    lines = documents.select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("pos", "text_line"))
    h = lines.where(F.col("text_line").rlike("^#{1,6} ")).select("doc_id", (F.col("pos") + 1).alias("line"), F.length(F.regexp_extract("text_line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("text_line", "^#+", "")).alias("title"), "n")
    w = Window.partitionBy("doc_id").orderBy("line")
    return h.select("doc_id", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "title", F.coalesce(F.lead("line").over(w) - 1, F.col("n")).cast("long").alias("end_line"))


def registry_repeats(terms: DataFrame) -> DataFrame:
    """Keys that occur in more than one distinct unit. terms: (key, unit)."""
    return terms.groupBy("key").agg(F.count_distinct("unit").alias("units"), F.count("*").alias("uses")).where("units > 1")


def status_of(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(key, state) by digests: unsigned, changed or signed."""
    r, c = recorded.select("key", F.col("digest").alias("old")), current.select("key", F.col("digest").alias("new"))
    return c.join(r, "key", "left").select("key", F.when(F.col("old").isNull(), "unsigned").when(F.col("old") != F.col("new"), "changed").otherwise("signed").alias("state"))


def tukey_fence(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, fence): third quartile plus 1.5 interquartile ranges, by exclusive quantiles; null for fewer than four rows.

    The quantile at p of n sorted values stands at place p * (n + 1), interpolated. Equal values are counted first, so the window
    of a group orders its distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    r = counts.withColumn("upto", upto).join(counts.groupBy(group).agg(F.sum("c").alias("n")), group)

    def quantile(p: float):
        place = (F.col("n") + 1) * p
        low = F.floor(place)
        at = lambda i: F.min(F.when(F.col("upto") >= i, F.col("v")))
        weight = F.first(place - low)
        return at(low) * (1 - weight) + at(low + 1) * weight

    q = r.groupBy(group, "n").agg(quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    return q.select(group, "n", F.when(F.col("n") >= 4, F.round(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")), 4)).alias("fence"))
