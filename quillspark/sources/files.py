"""Sources that are files of configuration, logs and payloads, listings of folders, and sinks of tables that belong together."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "id string, citekey string, tier string, line int, span_words int"


def optional_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """Those columns of a table; None, and not an empty table, where there is none to read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path).select(*columns)


def _toml(spark: SparkSession, path: str) -> dict:
    """A configuration file, read whole: it is written by hand."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])


def seed_topics(spark: SparkSession, path: str) -> DataFrame:
    """(pos, topic) of the list topics: white space as one space, repeats in other case once, the first kept. None is an error."""
    seen: dict[str, str] = {}
    for t in _toml(spark, path).get("topics", []):
        if topic := " ".join(str(t).split()):
            seen.setdefault(topic.casefold(), topic)
    if not seen:
        raise ValueError(f"{path} names no topics")
    return spark.createDataFrame(list(enumerate(seen.values())), "pos int, topic string")


def allowed_phrases(spark: SparkSession, path: str) -> list[list[str]]:
    """Phrases of the list phrases as words, as drafts.allowlisted takes them."""
    import re

    return [w for p in _toml(spark, path).get("phrases", []) if (w := re.findall("[a-z0-9]+", str(p).lower()))]


def baseline(spark: SparkSession, path: str, version: int = 1, series: str = "scan") -> DataFrame:
    """Findings of an earlier scan's JSON payload. One that was cut by a limit, has an older version or is of another series is refused."""
    head = spark.read.schema(f"version int, series string, limit int, findings array<struct<{', '.join(f.replace(' ', ':') for f in PAYLOAD.split(', ')).replace(', ', ',')}>>").json(path, multiLine=True)
    meta = head.select("version", "series", "limit", F.col("findings").isNotNull().alias("whole")).first()
    if meta is None or meta["version"] != version:
        raise ValueError("the baseline was written by another version")
    if meta["series"] != series:
        raise ValueError("the baseline is of another series")
    if meta["limit"] is not None or not meta["whole"]:
        raise ValueError("the baseline was cut by a limit")
    return head.select(F.explode("findings").alias("f")).select("f.*")


def run_log(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A log of JSON lines: its one record of kind meta, and the rows of kind run that are ok."""
    rows = spark.read.text(path).select("value", F.get_json_object("value", "$.record").alias("record"), F.get_json_object("value", "$.ok").alias("ok"))
    meta = rows.where("record = 'meta'").select("value").head(2)
    if len(meta) != 1:
        raise ValueError("a log has exactly one meta record")
    runs = rows.where("record = 'run' and ok = 'true'").select(F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.seconds").cast("double").alias("seconds"))
    return json.loads(meta[0]["value"]), runs


def members(spark: SparkSession, folders: list[str], names: list[str]) -> DataFrame:
    """(path, size, modified) of the files below some folders whose names match one of the patterns; contents aren't read."""
    found = None
    for name in names:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folders).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def folders_of(files: DataFrame) -> DataFrame:
    """(folder): the different folders that hold a file, in order."""
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().orderBy("folder")


def figure_problems(references: DataFrame, files: DataFrame) -> DataFrame:
    """(key, target, problem) of references to figures (key, target): missing, or null where there is a file that isn't empty."""
    f = files.where("size > 0").select(F.regexp_extract("path", "([^/]+)$", 1).alias("target")).distinct().withColumn("there", F.lit(True))
    problem = F.when(F.col("there").isNull(), "missing")
    return references.join(f, "target", "left").select("key", "target", problem.alias("problem"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Tables that belong together (topics and their members, or a registry's terms, claims and references), below one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def accept(units: DataFrame, unit: str, path: str) -> DataFrame:
    """Append the record of a unit's acceptance: its digests and sorted keys. Refused without a signed outline, a draft or a passed gate.

    units: (unit, signed, text, gate_passed, citekeys).
    """
    row = units.where(F.col("unit") == unit).select("signed", F.col("text").isNotNull().alias("written"), "gate_passed").first()
    if row is None or not row["signed"]:
        raise ValueError("the outline isn't signed")
    if not row["written"]:
        raise ValueError("there is no draft")
    if not row["gate_passed"]:
        raise ValueError("the citation gate has not been passed")
    record = units.where(F.col("unit") == unit).select("unit", F.substring(F.sha2("text", 256), 1, 12).alias("digest"), F.array_sort("citekeys").alias("citekeys"))
    record.write.mode("append").parquet(path)
    return record
