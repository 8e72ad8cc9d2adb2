"""The corpus ledger: ingest, reconciliation, duplicates, collections, incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def set_digest(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """(group, members, digest, first): size, order-free digest and least element of each group's set of values.

    The digest is the first twelve hexadecimal digits of the hash of two sums over the distinct values, each of 60 bits of their
    hashes. Sums combine map-side, so a group of any size is never held in one place, as sorting and joining its values would
    require; equal digests of different sets are as unlikely as the digits allow.
    """
    part = lambda at: F.sum(F.conv(F.substring("hash", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    distinct = rows.where(F.col(column).isNotNull()).select(*group, column).distinct().withColumn("hash", F.sha2(F.col(column).cast("string"), 256))
    sums = distinct.groupBy(*group).agg(F.count("*").alias("members"), F.concat_ws("-", part(1), part(16)).alias("sums"), F.min(column).alias("first"))
    return sums.select(*group, "members", F.substring(F.sha2("sums", 256), 1, 12).alias("digest"), "first")


def duplicates(refs: DataFrame) -> DataFrame:
    """(kind, value, members, first): doi and title values that several keys share; the same keys are reported once, by doi first.

    Groups are told apart by size, digest and least key, not by lists of keys; duplicate_members lists the keys.
    """
    groups = set_digest(keyed_values(refs), ["kind", "value"], "citekey").where("members >= 2")
    return groups.groupBy("members", "digest", "first").agg(F.min(F.struct("kind", "value")).alias("r")).select("r.kind", "r.value", "members", "first")


def keyed_values(refs: DataFrame) -> DataFrame:
    """(kind, value, citekey): normalised doi and title of each entry. Blank dois are left out; titles of which nothing is left are a
    group of their own."""
    pairs = F.array(F.struct(F.lit("doi").alias("kind"), T.normal_doi(F.col("doi")).alias("value")), F.struct(F.lit("title").alias("kind"), T.normal_title(F.col("title")).alias("value")))
    return refs.select("citekey", F.explode(pairs).alias("p")).select("p.kind", "p.value", "citekey").where("value is not null and (value <> '' or kind = 'title')")


def duplicate_members(refs: DataFrame) -> DataFrame:
    """(citekey, kind, value) of every entry of a reported group."""
    return keyed_values(refs).distinct().join(duplicates(refs).select("kind", "value"), ["kind", "value"], "left_semi").select("citekey", "kind", "value")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(citekey, status, failure_kind, action, parse) of a reconciled ledger: a full join of ledger (citekey, pdf_hash, status,
    failure_kind) and delivery (citekey, pdf_hash).

    New keys and changed files are discovered (no_pdf without a file). Unchanged rows keep their status, except that a failed
    parse is tried again unless its kind is deterministic. Rows that are no longer delivered are stale.
    """
    old = migrate(old, {"failure_kind": "string"})
    o = old.select("citekey", F.col("pdf_hash").alias("old_hash"), "status", "failure_kind", F.lit(True).alias("in_old"))
    n = new.select("citekey", F.col("pdf_hash").alias("new_hash"), F.lit(True).alias("in_new"))
    fresh = F.when(F.col("new_hash").isNull(), "no_pdf").otherwise("discovered")
    same = F.col("old_hash").eqNullSafe(F.col("new_hash"))
    again = same & (F.col("status") == "parse_failed") & ~F.col("failure_kind").eqNullSafe("deterministic")
    action = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "stale").when(again, "retry").when(same, "keep").otherwise("update")
    joined = o.join(n, "citekey", "full_outer").withColumn("action", action)
    stays = F.col("action").isin("keep", "stale")
    parse = F.col("action").isin("insert", "update", "retry") & F.col("new_hash").isNotNull()
    return joined.select("citekey", F.when(stays, F.col("status")).otherwise(fresh).alias("status"), F.when(stays, F.col("failure_kind")).alias("failure_kind"), "action", parse.alias("parse"))


def apply_results(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """The ledger (citekey, status, failure_kind) after the results (citekey, error, transient) of parses: parsed without an error, else
    parse_failed with the kind of the failure. Keys without a result stay; results without a key change nothing."""
    r = results.groupBy("citekey").agg(F.max(F.struct(F.col("error").isNotNull().alias("failed"), "transient")).alias("r"))
    done, failed = F.col("r").isNotNull(), F.col("r.failed")
    status = F.when(done & failed, "parse_failed").when(done, "parsed").otherwise(F.col("status"))
    kind = F.when(done & failed, F.when(F.col("r.transient"), "transient").otherwise("deterministic")).when(~done, F.col("failure_kind"))
    return ledger.join(r, "citekey", "left").select("citekey", status.alias("status"), kind.alias("failure_kind"))


def point_lookup(ledger: DataFrame, citekey: str) -> DataFrame:
    """The rows of one key: the filter reaches the scan."""
    return ledger.where(F.col("citekey") == citekey)


def migrate(ledger: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The ledger with every column of a later version that it lacks, null; columns that it has stay as they are."""
    return ledger.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in ledger.columns})


def prune(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    """Ledger rows that are still seen. Refuses to prune everything: an empty delivery is an error, not a deletion."""
    if seen.isEmpty() and not ledger.isEmpty():
        raise ValueError("nothing was seen; refusing to empty the ledger")
    return ledger.join(seen.select("citekey").distinct(), "citekey", "left_semi")


def stale(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    return ledger.join(seen.select("citekey"), "citekey", "left_anti")


def failure_counts(rows: DataFrame) -> DataFrame:
    """Counts by kind of failure; anything but deterministic, null included, is transient."""
    return rows.groupBy(F.when(F.col("failure_kind") == "deterministic", "deterministic").otherwise("transient").alias("failure_kind")).agg(F.count("*").alias("n"))


def refresh(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(key, state) of an incremental index by fingerprints (key, fp): unchanged, rebuilt or dropped."""
    p, c = previous.select("key", F.col("fp").alias("old")), current.select("key", F.col("fp").alias("new"))
    return p.join(c, "key", "full_outer").select("key", F.when(F.col("new").isNull(), "dropped").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "rebuilt").otherwise("unchanged").alias("state"))


def collection_names(refs: DataFrame) -> DataFrame:
    """(collection, entries): every collection path and every path above one, with its number of entries."""
    paths = refs.select("ref_id", F.explode("collections").alias("path"))
    return paths.select("ref_id", F.explode(T.collection_ancestors(F.col("path"))).alias("collection")).groupBy("collection").agg(F.count_distinct("ref_id").alias("entries"))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the one with the latest time: deliveries collapse to records (a map-side maximum, no window sort)."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(at), F.xxhash64(*others))).alias("r")).select(key, "r.*")
