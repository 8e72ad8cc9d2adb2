"""Problem 3: occurrences and record frequency of every distinct term, by bitmaps in vertical layout.

Citekeys get dense numbers. Every map task keeps, per term, the set of citekey numbers it met and a counter of postings, and
sends them as containers of 2^16 numbers: a sorted array of 16-bit values, or a bitmap of 8 KB where that is smaller. Reducers
merge containers by union and add the counters; the record frequency is the cardinality of the union. Whatever the number of
postings of a term, a task sends a container of it once per flush, so no term is hot, and a container is never over 8 KB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import cut_lineage, load

RARE_BELOW, COMMON_FROM = 3, 25
FLUSH_ROWS = 1_000_000
#: Values whose numbers are broadcast (some 50 MB), and tasks over which a value is spread beyond.
BROADCAST_VALUES, SALTS = 1_000_000, 32
#: A sorted array up to this many numbers, above it a bitmap (8192 bytes, which no array has).
ARRAY_MOST = 4095
SCHEMA = "term string, high long, container binary, postings long"
COUNTS = "term string, records long, postings long"


def term(gram: Column) -> Column:
    """The runs of a-z and 0-9 of the lower-cased text, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(gram), "[^a-z0-9]+", " "))


def pack(low: np.ndarray) -> bytes:
    """A container of sorted distinct 16-bit numbers."""
    if len(low) <= ARRAY_MOST:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) == 8192:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return np.frombuffer(data, "<u2").astype(np.int64)


def union(parts: list[bytes]) -> bytes:
    """Of bitmaps a bitwise or; arrays are merged, or set in the bitmap if there is one."""
    if len(parts) == 1:
        return parts[0]
    maps = [p for p in parts if len(p) == 8192]
    arrays = [np.frombuffer(p, "<u2") for p in parts if len(p) != 8192]
    low = np.unique(np.concatenate(arrays)) if arrays else np.empty(0, np.uint16)
    if not maps:
        return pack(low)
    bits = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in maps])
    np.bitwise_or.at(bits, low >> 3, np.left_shift(1, low & 7).astype(np.uint8))
    return bits.tobytes()


def cardinality(data: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(data, np.uint64)).sum()) if len(data) == 8192 else len(data) // 2


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        parts.append(b)
        rows += b.num_rows
        if rows >= FLUSH_ROWS:
            yield from _containers(parts)
            parts, rows = [], 0
    yield from _containers(parts)


def _containers(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    coded = table.column("term").combine_chunks().dictionary_encode()
    code, number = coded.indices.to_numpy(), table.column("number").to_numpy()
    high = number >> 16
    order = np.lexsort((number, high, code))
    code, number, high = code[order], number[order], high[order]
    fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (high[1:] != high[:-1])]) if len(code) else np.empty(0, bool)
    starts = np.flatnonzero(fresh)
    postings = np.diff(np.append(starts, len(code)))
    once = fresh | np.concatenate([[True], number[1:] != number[:-1]]) if len(code) else fresh  # repeated numbers of a container
    low = (number[once] & 0xFFFF).astype("<u2")
    bounds = np.append(np.flatnonzero(fresh[once]), len(low))
    sizes = np.diff(bounds)
    if (sizes > ARRAY_MOST).any():
        packed = pa.array([pack(low[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    else:  # arrays only: the numbers are the containers' bytes as they stand
        packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(low)])
    yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[starts])), pa.array(high[starts]), packed, pa.array(postings)], names=["term", "high", "container", "postings"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the containers of a term and block, in order of both: at most one container and some parts are held."""
    held: list[bytes] = []
    now, total, out = None, 0, []

    def done() -> None:
        if now is not None:
            out.append((now[0], cardinality(union(held)), total))

    for b in batches:
        for t, h, c, n in zip(*(b.column(x).to_pylist() for x in ("term", "high", "container", "postings")), strict=True):
            if (t, h) != now:
                done()
                now, held, total = (t, h), [], 0
            held.append(c)
            total += n
            if len(held) >= 64:
                held = [union(held)]
        if len(out) >= 50_000:
            yield _counts(out)
            out = []
    done()
    if out:
        yield _counts(out)


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    t, c, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["term", "records", "postings"])


def numbered(values: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Distinct values with dense numbers from 0, and how many there are: a range sort, sizes of its partitions, and offsets."""
    parted = cut_lineage(values.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id()), "values")
    sizes = parted.groupBy("part").count().orderBy("part").collect()  # as many rows as partitions
    offset, pairs = 0, []
    for r in sizes:
        pairs += [F.lit(r["part"]), F.lit(offset)]
        offset += r["count"]
    if not pairs:
        return parted.select(column, F.lit(0).cast("long").alias("number")), 0
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return parted.select(column, (rank + F.create_map(*pairs)[F.col("part")]).cast("long").alias("number")), offset


def with_numbers(rows: DataFrame, column: str) -> DataFrame:
    """rows with the number of a value: sent to the rows if there are at most BROADCAST_VALUES, else met in a salted join.

    One value may stand in a third of the rows; the salt, taken from the term, spreads it over SALTS tasks.
    """
    numbers, n = numbered(rows, column)
    if n <= BROADCAST_VALUES:
        return rows.join(F.broadcast(numbers), column)
    salted = numbers.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, [column, "salt"])


def term_counts(postings: DataFrame, text: str, record: str) -> DataFrame:
    """Per distinct term of the column text: postings (rows), and records (distinct values of the column record).

    Rows with a null text or record don't count, nor do texts without a word; repeated rows count as postings each, and once
    as a record. An empty table gives an empty result.
    """
    rows = postings.select(term(F.col(text)).alias("term"), F.col(record).alias("record")).where("term <> '' and record is not null")
    rows = with_numbers(rows, "record").select("term", "number")
    parts = rows.mapInArrow(_build, SCHEMA).repartition(F.col("term"), F.col("high")).sortWithinPartitions("term", "high")
    merged = parts.mapInArrow(_merge, COUNTS)
    return merged.groupBy("term").agg(F.sum("records").alias("records"), F.sum("postings").alias("postings"))


def mark(records: Column) -> Column:
    return F.when(records < RARE_BELOW, "rare").when(records >= COMMON_FROM, "common")


def _distinct_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings without repeated deliveries: one row per term, citekey, page and position."""
    df = load(spark, sf_dir, "gram_postings")
    return df.withColumn("gram", term(F.col("gram"))).dropDuplicates(["gram", "citekey", "page", "position"])


def p3_term_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gram, postings (without repeated deliveries), citekeys, and mark (null between rare and common)."""
    c = term_counts(_distinct_postings(spark, sf_dir), "gram", "citekey")
    return c.select(F.col("term").alias("gram"), "postings", F.col("records").alias("citekeys"), mark(F.col("records")).alias("mark"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams that are too rare or too common."""
    c = term_counts(load(spark, sf_dir, "gram_postings"), "gram", "citekey")
    return c.select(F.col("term").alias("gram"), mark(F.col("records")).alias("mark")).where("mark is not null")


SQL = {
    "p3_found": """
        WITH g AS (SELECT trim(regexp_replace(lower(gram), '[^a-z0-9]+', ' ', 'g')) AS gram, citekey FROM gram_postings WHERE gram IS NOT NULL AND citekey IS NOT NULL),
             c AS (SELECT gram, count(DISTINCT citekey) AS n FROM g WHERE gram <> '' GROUP BY gram)
        SELECT gram, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark FROM c WHERE n < 3 OR n >= 25""",
    "p3_term_profile": """
        WITH g AS (SELECT DISTINCT trim(regexp_replace(lower(gram), '[^a-z0-9]+', ' ', 'g')) AS gram, citekey, page, position FROM gram_postings WHERE gram IS NOT NULL AND citekey IS NOT NULL)
        SELECT gram, CAST(count(*) AS BIGINT) AS postings, CAST(count(DISTINCT citekey) AS BIGINT) AS citekeys,
               CASE WHEN count(DISTINCT citekey) < 3 THEN 'rare' WHEN count(DISTINCT citekey) >= 25 THEN 'common' END AS mark
        FROM g WHERE gram <> '' GROUP BY gram""",
}
