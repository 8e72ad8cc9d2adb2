"""A stored index of the postings of a corpus, kept up to date by the fingerprints of its texts.

Postings lie in PARTS parts by key. A refresh compares fingerprints and writes only the parts that hold a changed, new or dropped
key, as a new version beside the old one; a manifest of PARTS rows a version says which version of each part counts. Writing the
manifest is the commit: a refresh that is lost half-way leaves the old version as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import corpus, drafts, overlap

#: Parts of an index, and pieces into which each is cut by gram, so that a hot key is no single task's work.
PARTS, PIECES = 64, 8
POSTINGS, PRINTS, MANIFEST = "key string, pos int, gram long, part int", "key string, fp string, part int", "version int, part int, held_in int"


def exact_grams(texts: DataFrame) -> DataFrame:
    return overlap.positions(texts, "key", "text")


def skip_grams(texts: DataFrame) -> DataFrame:
    return drafts.skipgrams(texts, "key", "text").select("key", F.col("start").alias("pos"), F.xxhash64("gram").alias("gram"))


def _part(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str) -> dict[int, int]:
    """Part -> version of the latest commit: at most PARTS entries."""
    if not _exists(spark, f"{path}/manifest"):
        return {}
    m = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = m.agg(F.max("version")).first()[0]
    return {r["part"]: r["held_in"] for r in m.where(F.col("version") == last).collect()}


def _read(spark: SparkSession, path: str, table: str, schema: str, parts: dict[int, int]) -> DataFrame:
    places = [p for p in (f"{path}/v{v}/{table}/part={k}" for k, v in sorted(parts.items())) if _exists(spark, p)]
    df = spark.read.schema(schema.rsplit(", ", 1)[0]).parquet(*places) if places else spark.createDataFrame([], schema.rsplit(", ", 1)[0])
    return df


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(key, pos, gram) of the latest version; empty for an index that isn't there."""
    return _read(spark, path, "postings", POSTINGS, manifest(spark, path))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "prints", PRINTS, manifest(spark, path))


def refresh(spark: SparkSession, path: str, texts: DataFrame, grams: Callable[[DataFrame], DataFrame] = exact_grams) -> DataFrame:
    """Bring the index at path up to date with texts (key, text), and return (key, state): unchanged, rebuilt or dropped.

    Keys are taken as strings and must be unique; null texts have no postings, but are in the index.
    """
    texts = texts.select(F.col("key").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text")).where("key is not null")
    parts = manifest(spark, path)
    version = max(parts.values(), default=0) + 1
    current = texts.select("key", F.sha2("text", 256).alias("fp"))
    corpus.refresh(_read(spark, path, "prints", PRINTS, parts), current).write.parquet(f"{path}/v{version}/states")
    states = spark.read.schema("key string, state string").parquet(f"{path}/v{version}/states")
    touched = [r["part"] for r in states.where("state <> 'unchanged'").select(_part("key").alias("part")).distinct().collect()]  # at most PARTS
    if touched:
        old = {k: v for k, v in parts.items() if k in touched}
        same = states.where("state = 'unchanged'").select("key")
        kept = _read(spark, path, "postings", POSTINGS, old).join(same, "key", "left_semi")
        fresh = grams(texts.join(states.where("state = 'rebuilt'").select("key"), "key", "left_semi"))
        rows = kept.unionByName(fresh.select("key", F.col("pos").cast("int").alias("pos"), "gram")).withColumn("part", _part("key"))
        rows = rows.repartition(F.col("part"), F.pmod("gram", F.lit(PIECES))).sortWithinPartitions("part", "gram")
        rows.write.partitionBy("part").parquet(f"{path}/v{version}/postings")
        current.withColumn("part", _part("key")).where(F.col("part").isin(touched)).repartition("part").write.partitionBy("part").parquet(f"{path}/v{version}/prints")
        held = parts | dict.fromkeys(touched, version)
        spark.createDataFrame([(version, k, v) for k, v in sorted(held.items())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return states


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the parts of old versions that no longer count; their paths."""
    parts = manifest(spark, path)
    held = {f"{path}/v{v}/{t}/part={k}" for k, v in parts.items() for t in ("postings", "prints")}
    gone = [p for v in range(1, max(parts.values(), default=0) + 1) for t in ("postings", "prints") for k in range(PARTS) if (p := f"{path}/v{v}/{t}/part={k}") not in held and _exists(spark, p)]
    for p in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone


def lookup(index: DataFrame, grams: DataFrame) -> DataFrame:
    """Postings of the asked grams; grams: (gram)."""
    return index.join(grams.select("gram").distinct(), "gram", "left_semi")


def stale_vectors(stored: DataFrame, texts: DataFrame, model: str) -> DataFrame:
    """Keys of texts (key, text) whose stored vector (key, fp, model) is missing, of another text or of another model."""
    good = stored.where(F.col("model") == model).select("key", "fp")
    return texts.select("key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fp")).join(good, ["key", "fp"], "left_anti").select("key")
