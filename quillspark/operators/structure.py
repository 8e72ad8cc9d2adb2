"""Operators on places: pages, lines, positions, boxes, ranks, runs of numbers, windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import cut_lineage


def asof(points: DataFrame, marks: DataFrame, key: str, at: str, value: str, width: int = 10_000) -> DataFrame:
    """points with the value of the last mark at or before each, per key; null before the first. Places are whole numbers.

    A mark holds until the next one of its key; points meet it by key and a slice of width places, so the points of one key spread
    over as many tasks as it has slices. Only marks (pages, not words) are ordered in a window. Of marks at one place the
    greatest value counts.
    """
    ends = points.groupBy(key).agg(F.max(at).alias("_last"))
    m = marks.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias(value)).join(ends, key)
    m = m.withColumn("_until", F.coalesce(F.lead(at).over(Window.partitionBy(key).orderBy(at)), F.greatest(at, "_last") + 1))
    slices = F.sequence(F.floor(F.col(at) / width), F.floor((F.col("_until") - 1) / width))
    m = m.select(F.col(key).alias("_key"), F.col(at).alias("_from"), "_until", value, F.explode(slices).alias("_slice"))
    p = points.withColumn("_of", F.floor(F.col(at) / width))
    held = (p[key] == m["_key"]) & (p["_of"] == m["_slice"]) & (p[at] >= m["_from"]) & (p[at] < m["_until"])
    return p.join(m, held, "left").drop("_key", "_from", "_until", "_slice", "_of")


def running_sum(rows: DataFrame, key: str, slice_: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the running sum of value per key in order, by slices that follow the order (such as days of a time).

    Sums of slices are added up first (a row a key and slice), then each slice runs by itself from what came before, so a key that
    holds a large part of all rows is spread over its slices.
    """
    r = rows.withColumn("_slice", slice_).withColumn("_value", value)
    by = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(key, "_slice").agg(F.sum("_value").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(by), F.lit(0)))
    within = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = r.withColumn("_run", F.sum("_value").over(within)).join(sums.select(key, "_slice", "_before"), [key, "_slice"])
    return out.withColumn(name, F.col("_run") + F.col("_before")).drop("_slice", "_value", "_run", "_before")


def line_of(text: Column, offset: Column) -> Column:
    """Line (from 1) of a character offset (from 0)."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def number_runs(rows: DataFrame, key: str, number: str, least: int = 3) -> DataFrame:
    """(key, runs): distinct numbers of each key, runs of at least that many consecutive ones contracted to a–b."""
    d = rows.where(F.col(number).isNotNull()).select(key, number).distinct()
    w = Window.partitionBy(key).orderBy(number)
    runs = d.withColumn("g", F.col(number) - F.row_number().over(w)).groupBy(key, "g").agg(F.min(number).alias("a"), F.max(number).alias("z"), F.count("*").alias("n"))
    a, z = F.col("a").cast("string"), F.col("z").cast("string")
    text = F.when(F.col("n") >= least, F.concat(a, F.lit("–"), z)).when(F.col("n") == 2, F.concat(a, F.lit(", "), z)).otherwise(a)
    packed = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(packed, lambda x: x["t"]), ", ").alias("runs"))


def vertical_gaps(boxes: DataFrame, keys: list[str], share: float = 1 / 3) -> DataFrame:
    """Groups of boxes (low, high) with a vertical gap of more than that share of their height: a sweep with a running maximum."""
    w = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("gap", F.greatest(F.lit(0.0), F.col("low") - reach))
    g = rows.groupBy(*keys).agg(F.round(F.max("gap"), 4).alias("gap"), F.round(F.max("high") - F.min("low"), 4).alias("height"))
    return g.where(F.col("gap") > F.col("height") * share)


def emptiness(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the bounding box of a group that its boxes (x1, y1, x2, y2) leave empty, at least 0."""
    area = F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    frame = (F.max("x2") - F.min("x1")) * (F.max("y2") - F.min("y1"))
    return boxes.groupBy(*keys).agg(F.round(F.greatest(F.lit(0.0), 1 - area / F.nullif(frame, F.lit(0.0))), 4).alias("empty"))


def even_ranks(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows at even intervals of rank, ends included (a sampling operator); fewer where ranks coincide.

    Ranks come from a range sort with offsets by partition, so no single task orders all rows.
    """
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    sizes = parted.groupBy("_part").count().orderBy("_part").collect()  # as many rows as partitions
    total, offset, pairs = sum(r["count"] for r in sizes), 0, []
    for r in sizes:
        pairs += [F.lit(r["_part"]), F.lit(offset)]
        offset += r["count"]
    if not total:
        return rows.limit(0).withColumn("rank", F.lit(0).cast("long"))
    wanted = sorted({round(i * (total - 1) / (n - 1)) for i in range(n)}) if n > 1 else [0]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = parted.withColumn("rank", (within + F.create_map(*pairs)[F.col("_part")]).cast("long"))
    return ranked.where(F.col("rank").isin(wanted)).drop("_part")


def word_windows(tokens: Column, size: int = 20, step: int = 10) -> Column:
    """All words if at most size; else windows of size words every step words, and a last one flush with the end."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), n - size, F.lit(step))
    tail = F.when((n - size) % step != 0, F.array(n - size)).otherwise(F.array().cast("array<int>"))
    many = F.transform(F.concat(starts, tail), lambda i: F.array_join(F.slice(tokens, i + 1, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.array_join(tokens, " "))).otherwise(many)


def swap_every(tokens: Column, n: int, word: str) -> Column:
    """Every nth word replaced: a synthetic paraphrase."""
    return F.transform(tokens, lambda w, i: F.when((i + 1) % n == 0, F.lit(word)).otherwise(w))


def locate(phrases: DataFrame, pages: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(id, page, score, rank): pages of a phrase's source by the share of its words of over three letters; later pages win ties.

    phrases: (id, key, text); pages: (key, page, text), page not null. Phrases of a source with the same words are scored once. Words
    of pages that no phrase of their source has are dropped; the others meet the phrases as lists of pages, which are counted
    where the phrase is, so a source with many pages or phrases is spread over its words and phrases.
    """
    longer = lambda t: F.array_distinct(F.filter(T.words(t), lambda w: F.length(w) > 3))
    p = phrases.select("id", key, F.array_sort(longer(F.col("text"))).alias("words")).where((F.size("words") > 0) & F.col(key).isNotNull())
    p = cut_lineage(p.select("id", key, "words", F.array_join("words", " ").alias("phrase")), "locate")
    asked = p.select(key, F.explode("words").alias("word"), "phrase", F.size("words").alias("n")).distinct()
    q = pages.join(p.select(key).distinct(), key, "left_semi").select(key, "page", F.explode(longer(F.col("text"))).alias("word"))
    lists = q.join(asked.select(key, "word").distinct(), [key, "word"], "left_semi").groupBy(key, "word").agg(F.collect_set("page").alias("pages"))
    met = asked.join(lists, [key, "word"]).select(key, "phrase", "n", "pages").repartition(key, "phrase")
    scored = met.select(key, "phrase", "n", F.explode("pages").alias("page")).groupBy(key, "phrase", "page").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("page"))).cast("long")
    scored = scored.select(key, "phrase", "page", F.round(F.col("shared") / F.col("n"), 4).alias("score")).withColumn("rank", best(key, "phrase")).where(F.col("rank") <= most)
    located = p.select("id", key, "phrase").join(scored.drop("rank"), [key, "phrase"]).withColumn("rank", best("id"))
    return located.where(F.col("rank") <= most).select("id", "page", "score", "rank")


def adjusted_rand(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: agreement of two labelings, corrected for chance; from the contingency table."""
    c2 = lambda x: x * (x - 1) / 2
    cells = pairs.groupBy(left, right).agg(F.count("*").alias("n"))
    index = cells.agg(F.sum(c2(F.col("n"))).alias("i"), F.sum("n").alias("total"))
    a = cells.groupBy(left).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n"))).alias("a"))
    b = cells.groupBy(right).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n"))).alias("b"))
    every = index.crossJoin(a).crossJoin(b)  # three rows of sums
    expected = F.col("a") * F.col("b") / c2(F.col("total"))
    return every.select(F.round((F.col("i") - expected) / F.nullif((F.col("a") + F.col("b")) / 2 - expected, F.lit(0.0)), 4).alias("ari"))
