"""Problem 1: records that differ in formatting only.

Recursive radix partitioning on canonical bytes. Every map task first collapses its own copies, so a group of copies, however
large, leaves a task as one row. The canonical keys are then partitioned by their leading bytes: a bucket that is larger than
BUCKET_KEYS is split by the bytes after the longest common prefix of its keys (the common prefix of its least and its greatest
key), again and again until each bucket fits. A bucket is counted in a trie whose terminal counters hold the number of copies
and the smallest id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.session import cut_lineage, load

#: Most keys of a bucket, and bytes by which an oversized one is split at once.
BUCKET_KEYS, SPLIT_BYTES = 10_000, 2
#: Classes that hold more than this part of all rows meet their members without a shuffle; there are fewer than that many.
HOT_PART = 1_000
#: Distinct keys a map task holds before it sends them.
FLUSH_KEYS = 500_000

_ALNUM = re.compile(r"[\W_]+")
#: Marks that choose the look of a letter only.
_VARIATION = re.compile("[\u180b-\u180f\ufe00-\ufe0f\U000e0100-\U000e01ef]")


def canonical_title(title: str) -> str:
    """Letters, marks and digits in order, after compatibility composition and case folding.

    Marks that belong to no composed letter stay (vowel signs tell words apart); those that choose a glyph don't count.
    """
    if title.isascii():
        return _ALNUM.sub("", title.lower())
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", title).casefold())
    return "".join(c for c in _VARIATION.sub("", t) if c.isalnum() or unicodedata.category(c)[0] == "M")


@F.pandas_udf(StringType())
def _canonical_title(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: canonical_title(t) if t is not None else "")


def canonical_doi(doi: Column) -> Column:
    """The identifier alone: without label, resolver address, surrounding marks and closing stop, in lower case; '' if missing."""
    d = F.lower(F.regexp_replace(F.coalesce(doi, F.lit("")), r"[\s\p{Cf}]+", ""))
    d = F.regexp_replace(d, r"""^[<>(\[{"'“”‘’]+|[<>)\]}"'“”‘’.,;]+$""", "")
    d = F.regexp_replace(d, r"^(?:https?:)?(?://)?(?:www\.|dx\.)?doi\.(?:example|org)/+", "")
    d = F.regexp_replace(d, r"^(?:urn:)?(?:info:)?doi[:/]*", "")
    d = F.regexp_replace(d, r"^(?:https?:)?(?://)?(?:www\.|dx\.)?doi\.(?:example|org)/+", "")
    return d


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query, in lower case; '' if missing."""
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s\p{Cf}]+", ""))
    u = F.regexp_replace(u, r"""^[<>(\[{"'“”‘’]+|[<>)\]}"'“”‘’.,;]+$""", "")
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    path, query = F.regexp_replace(F.substring_index(u, "?", 1), r"/+$", ""), F.regexp_extract(u, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def canonical_key(title: Column, doi: Column, url: Column) -> Column:
    """Canonical bytes of an entry: the three fields with a separator that none of them holds."""
    return F.encode(F.concat_ws("\x1f", _canonical_title(title), canonical_doi(doi), canonical_url(url)), "UTF-8")


class Trie:
    """A path-compressed byte trie with a terminal counter (copies, smallest id) at the end of each key."""

    __slots__ = ("label", "children", "copies", "first")

    def __init__(self, label: bytes = b"") -> None:
        self.label, self.children, self.copies, self.first = label, {}, 0, None

    def add(self, key: bytes, copies: int, first: int) -> None:
        node, at = self, 0
        while True:
            if at == len(key):
                node.copies += copies
                node.first = first if node.first is None else min(node.first, first)
                return
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Trie(key[at:])
                at = len(key)
            else:
                label = child.label
                if key.startswith(label, at):
                    at += len(label)
                else:
                    n = 1
                    while at + n < len(key) and key[at + n] == label[n]:
                        n += 1
                    upper = Trie(label[:n])
                    child.label = label[n:]
                    upper.children[child.label[0]] = child
                    node.children[key[at]] = child = upper
                    at += n
            node = child

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(self, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node.label
            if node.copies:
                yield prefix, node.copies, node.first
            stack.extend((c, prefix) for c in node.children.values())


def _batches(terminals: Iterator[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[bytes, int, int]] = []
    for row in terminals:
        rows.append(row)
        if len(rows) >= 20_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    key, copies, first = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(copies, pa.int64()), pa.array(first, pa.int64())], names=["key", "copies", "first"])


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a map task: one row per key and flush."""
    seen: dict[bytes, list[int]] = {}
    for b in batches:
        for key, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), strict=True):
            have = seen.get(key)
            if have is None:
                seen[key] = [1, i]
            else:
                have[0] += 1
                have[1] = min(have[1], i)
        if len(seen) >= FLUSH_KEYS:
            yield from _batches((k, n, i) for k, (n, i) in seen.items())
            seen = {}
    yield from _batches((k, n, i) for k, (n, i) in seen.items())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of the buckets of a partition, one after the other, in order of bucket."""
    trie, bucket = Trie(), None
    for b in batches:
        for g, key, n, i in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "copies", "first")), strict=True):
            if g != bucket:
                yield from _batches(trie.terminals())
                trie, bucket = Trie(), g
            trie.add(key, n, i)
    yield from _batches(trie.terminals())


def _common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def radix_buckets(keys: DataFrame, most: int = BUCKET_KEYS) -> DataFrame:
    """keys with a column bucket: their leading bytes, as many as it takes until no bucket holds more than most rows.

    Each round splits the oversized buckets by the SPLIT_BYTES bytes after the common prefix of their keys, and writes the rows of
    these buckets only. The list of oversized buckets comes to the driver: there are at most rows / most of them. A bucket of equal
    keys can't be split and needs not be, for copies are collapsed per task before.
    """
    spark = keys.sparkSession
    stats = [F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")]
    open_ = keys.withColumn("bucket", F.lit(b""))
    done, found = None, [r for r in open_.groupBy("bucket").agg(*stats).collect() if r["n"] > most and r["low"] != r["high"]]
    while found:
        plan = spark.createDataFrame([(r["bucket"], _common_prefix(bytes(r["low"]), bytes(r["high"])) + SPLIT_BYTES) for r in found], "bucket binary, size int")
        plan = F.broadcast(plan)  # bounded: see above
        closed = open_.join(plan, "bucket", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        split = open_.join(plan, "bucket").withColumn("bucket", F.substring(F.col("key"), F.lit(1), F.col("size")))
        open_ = cut_lineage(split.select("bucket", "key", "copies", "first"), "radix")
        found = open_.groupBy("bucket").agg(*stats).where((F.col("n") > most) & (F.col("low") != F.col("high"))).collect()
    columns = ["bucket", "key", "copies", "first"]
    return open_.select(columns) if done is None else done.select(columns).unionByName(open_.select(columns))


def classes(records: DataFrame, most: int = BUCKET_KEYS) -> DataFrame:
    """(key, copies, first): one row per class of records with equal canonical key. records: id (long), key (binary)."""
    local = cut_lineage(records.select("id", "key").mapInArrow(_collapse, "key binary, copies long, first long"), "collapsed")
    parted = radix_buckets(local, most).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return parted.select("bucket", "key", "copies", "first").mapInArrow(_count, "key binary, copies long, first long")


def keyed(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("ref_id").alias("id"), canonical_key(F.col("title"), F.col("doi"), F.col("url")).alias("key"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first_ref_id, ref_id) for each entry that isn't the first of its group of copies.

    Null and blank fields are missing, and agree with missing only. A repeated row is a copy of itself and has no row here.
    Classes of one entry leave before the join. Classes of more than 1 / HOT_PART of all entries (fewer than HOT_PART of them) are
    sent to their members where these stand, so that the shuffled join has no hot key.
    """
    entries = cut_lineage(keyed(load(spark, sf_dir, "refs")), "keys")
    many = cut_lineage(classes(entries).where("copies > 1").select("key", F.col("first").alias("first_ref_id"), "copies"), "classes")
    limit = entries.count() / HOT_PART
    hot, rest = F.broadcast(many.where(F.col("copies") > limit)), many.where(F.col("copies") <= limit)
    found = entries.join(hot, "key").unionByName(entries.join(hot.select("key"), "key", "left_anti").join(rest, "key"))
    return found.where(F.col("id") != F.col("first_ref_id")).select("first_ref_id", F.col("id").alias("ref_id")).distinct()


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per entry: its smallest ref_id with that row's title, doi and url, and the number of copies."""
    refs = load(spark, sf_dir, "refs")
    kept = classes(keyed(refs)).select(F.col("first").alias("ref_id"), "copies")
    return kept.join(refs.select("ref_id", "citekey", "title", "doi", "url").dropDuplicates(["ref_id"]), "ref_id")
