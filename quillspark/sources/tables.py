"""Text sources: pipe tables, blocks, sidecars, glossaries; and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDECAR = "array<struct<text:string,label:string,page:int,bbox:array<double>>>"
LABELS = ("text", "list_item", "section_header", "title")


def cells(line: Column) -> Column:
    """Cells of a pipe-table line, escaped pipes kept as pipes."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, value): lines of each text from 1; null texts have none."""
    rows = texts.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "value"))
    return rows.select("key", (F.col("pos") + 1).alias("line"), "value")


def pipe_rows(texts: DataFrame, key: str, text: str, columns: int) -> DataFrame:
    """(key, line, cells): rows of pipe tables with that many cells, without headers' rules; shorter rows are padded with ''."""
    rows = numbered_lines(texts, key, text).where(F.trim("value").startswith("|")).withColumn("cells", cells(F.col("value")))
    rows = rows.where(~F.exists("cells", lambda c: c.rlike("^:?-{2,}:?$")))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(columns) - F.size("cells"))))
    return rows.select("key", "line", F.slice(padded, 1, columns).alias("cells"))


def retrieval_log(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows date, mode, query, asked, results, chars, collection; rows whose chars are no number are dropped."""
    r = pipe_rows(texts, key, text, 7)
    names = ("date", "mode", "query", "asked", "results", "chars", "collection")
    r = r.select("key", "line", *(F.col("cells")[i].alias(n) for i, n in enumerate(names)))
    return r.withColumn("chars", F.try_to_number("chars", F.lit("999999999")).cast("long")).where("chars is not null")


def rejected_reasons(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, citekey, reason): three-cell rows, the last of a citekey wins."""
    r = pipe_rows(texts, key, text, 3).select("key", "line", F.regexp_replace(F.col("cells")[0], "[`@]", "").alias("citekey"), F.col("cells")[2].alias("reason"))
    return r.where("citekey <> ''").groupBy("key", "citekey").agg(F.max_by("reason", "line").alias("reason"))


def blocks(texts: DataFrame, key: str, text: str, heading: str = "^## ") -> DataFrame:
    """(key, name, body): blocks under headings, the last of a name wins; text before the first heading is left out."""
    w = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered_lines(texts, key, text).withColumn("is_head", F.col("value").rlike(heading))
    rows = rows.withColumn("block", F.sum(F.when(F.col("is_head"), 1).otherwise(0)).over(w)).where("block > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line", "value")))), lambda x: x["value"]), "\n")
    out = rows.groupBy("key", "block").agg(F.max(F.when(F.col("is_head"), F.trim(F.regexp_replace("value", heading, "")))).alias("name"), body.alias("body"))
    return out.groupBy("key", "name").agg(F.max_by("body", "block").alias("body"))


def block_fields(body: Column, names: tuple[str, ...] = ("claim", "quote", "relevance", "support")) -> Column:
    """The first value of each field of a block."""
    return F.struct(*(F.nullif(F.trim(F.regexp_extract(body, rf"(?im)^\s*-?\s*{n}:[ \t]*(.*)$", 1)), F.lit("")).alias(n) for n in names))


def glossary(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, definition): bullets of the form - **term** -- definition."""
    rows = numbered_lines(texts, key, text).where(F.col("value").rlike(r"^\s*- \*\*.+?\*\* --? "))
    return rows.select("key", F.regexp_extract("value", r"\*\*(.+?)\*\*", 1).alias("term"), F.trim(F.regexp_extract("value", r"\*\*.+?\*\* --? (.*)$", 1)).alias("definition"))


def prose_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines outside fenced blocks."""
    w = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered_lines(texts, key, text).withColumn("fence", F.col("value").startswith("```"))
    return rows.withColumn("inside", F.sum(F.when(F.col("fence"), 1).otherwise(0)).over(w) % 2 == 1).where(~F.col("fence") & ~F.col("inside")).select("key", "line", "value")


def sidecar_passages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, label, page, bbox) of JSON sidecars; malformed files and records without text are left out, bad pages null."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", SIDECAR).alias("r"))
    rows = files.select("path", F.explode("r").alias("p")).select("path", "p.*").where(F.trim("text") != "")
    return rows.where(F.col("label").isNull() | F.col("label").isin(*LABELS)).withColumn("page", F.when(F.col("page") >= 1, F.col("page")))


def passage_ladder(rungs: list[DataFrame]) -> DataFrame:
    """Rows of the first rung that has a key: a union with the rung's number and a semi-join with its minimum per key."""
    every = None
    for n, r in enumerate(rungs):
        part = r.withColumn("rung", F.lit(n))
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("citekey").agg(F.min("rung").alias("rung"))
    return every.join(first, ["citekey", "rung"], "left_semi")


def best_text(*columns: Column) -> Column:
    """The first text of a ladder that isn't blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns))


# ------------------------------------------------------------------------------------------------ sinks


def write_postings(postings: DataFrame, table: str, buckets: int, key: str = "gram") -> None:
    """Postings as a table bucketed and sorted by gram: later joins on the gram need no shuffle of this side."""
    postings.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a log; the commit protocol makes the append all or nothing."""
    rows.write.mode("append").parquet(path)


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines."""
    findings.write.mode("overwrite").json(path)
