"""Problem 7: evaluation texts inside training text.

Spaced-seed hashing. A seed is a fixed mask over consecutive words: its hash covers the words at the mask's ones and ignores
those at its zeros, so a hit survives substitutions at the ignored places. Seeds of the items are a table. Documents are read,
and of their seeds only those that may be seeds of an item (a bit filter of bounded size, see bits) are shuffled and joined
with that table; each hit is a diagonal of a document and an item. Along the diagonals the words of both are compared, which
gives the longest run of equal words and the longest overlap that tolerates substitutions.

Nothing on the driver or in a task grows with the number of items or documents but the filters, and those are bounded. A seed
that stands in a third of all documents meets one row an item; the adaptive skew join splits its rows of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bits
from quillspark.llm.words import mix, word_hashes, words_text
from quillspark.session import cut_lineage, load, spread

#: Consecutive words of an item that make a leak; shorter items must stand as a whole.
RUN_WORDS = 13
#: Masks of at most RUN_WORDS places, in order of use: any run of RUN_WORDS equal words hits each of them.
MASKS = ("1101011010111", "1110100110101", "111011101")
#: Share of equal words that a tolerant overlap must keep, at either end and as a whole.
TOLERANT_SHARE = 0.8
#: Parts over which the items met by one document are spread.
PARTS = 8

SEEDS = "seed long, own long, at int"
FOUND = "doc_id long, item_id long, item_words int, exact_words int, tolerant_words int"


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place where it fits, different for each mask; works on one flat array, so places may span two texts."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, int("1" + mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                h = h * np.uint64(0x100000001B3) + hashes[i : i + n]
    return mix(h)


def masks_for(words: int) -> tuple[str, ...]:
    """The masks of an item: those above, and for an item that is shorter than one of them a mask over all its words."""
    return MASKS if words >= RUN_WORDS else ("1" * words,)


def _inside(hashes: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all places of a mask that lie within one text: the hash, the text's number and the place in it."""
    h = seed_hashes(hashes, mask)
    text = np.searchsorted(offsets, np.arange(len(h)), side="right") - 1
    ok = np.arange(len(h)) + len(mask) <= offsets[np.minimum(text + 1, len(offsets) - 1)]
    return h[ok], text[ok], np.flatnonzero(ok) - offsets[text[ok]]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, offsets = word_hashes(b.column("words"))
        own, sizes = b.column("own").to_numpy(), np.diff(offsets)
        for mask in {m for n in set(sizes.tolist()) if n for m in masks_for(n)}:
            h, text, at = _inside(hashes, offsets, mask)
            fits = sizes[text] >= RUN_WORDS if mask in MASKS else sizes[text] == len(mask)
            if fits.any():
                yield bits.arrow("seed own at", h[fits].view(np.int64), own[text[fits]], at[fits].astype(np.int32))


def _doc_seeds(masks: list[str], words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, offsets = word_hashes(b.column("words"))
            own = b.column("own").to_numpy()
            for mask in masks:
                h = seed_hashes(hashes, mask)
                hit = np.flatnonzero(bits.may_hold(words.value, h))
                text = np.searchsorted(offsets, hit, side="right") - 1
                ok = hit + len(mask) <= offsets[np.minimum(text + 1, len(offsets) - 1)]
                hit, text = hit[ok], text[ok]
                if len(hit):
                    yield bits.arrow("seed own at", h[hit].view(np.int64), own[text], (hit - offsets[text]).astype(np.int32))

    return run


def longest_run(equal: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def tolerant_run(equal: np.ndarray) -> int:
    """Words of the longest stretch that begins and ends with an equal word and holds TOLERANT_SHARE of equal words."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0
    # an equal word gives 1 - share, another takes share: a stretch qualifies where the running sum does not fall
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - TOLERANT_SHARE, -TOLERANT_SHARE))])
    low = np.minimum.accumulate(sums[at])
    ends = sums[at + 1] + 1e-9
    first = np.searchsorted(-low, -ends, side="left")  # the earliest start from which the sum up to this end does not fall
    start = at[np.minimum(first, len(at) - 1)]
    ok = (first < len(at)) & (start <= at)
    return int((at - start + 1)[ok].max()) if ok.any() else 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact and tolerant overlap of a document and each of its items, along the diagonals on which a seed was hit."""
    for b in batches:
        hashes, offsets = word_hashes(b.column("words"))
        rows = []
        for k, (doc, items) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("items").to_pylist(), strict=True)):
            doc_words = hashes[offsets[k] : offsets[k + 1]]
            for item in items:
                item_words = np.frombuffer(item["hashes"], np.uint64)
                exact = tolerant = 0
                for g in item["diagonals"]:
                    a, z = max(0, -g), min(len(item_words), len(doc_words) - g)
                    equal = item_words[a:z] == doc_words[a + g : z + g]
                    exact, tolerant = max(exact, longest_run(equal)), max(tolerant, tolerant_run(equal))
                if tolerant:
                    rows.append((doc, item["item_id"], len(item_words), exact, tolerant))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64() if i < 2 else pa.int32()) for i in range(5)], names=[f.split()[0] for f in FOUND.split(", ")])


def _item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, offsets = word_hashes(b.column("words"))
        packed = [hashes[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("own"), b.column("item_id"), pa.array(packed, pa.binary())], names=["own", "item_id", "hashes"])


def overlaps(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item with a seed hit: words of the item, longest exact and longest tolerant overlap.

    Null and word-less texts have none; repeated rows count once, and an id that stands with several texts keeps its longest
    overlaps. Items and documents are told apart by a hash of id and text.
    """
    spark = documents.sparkSession
    asked = items.where(F.col("text").isNotNull()).select("item_id", words_text(F.col("text")).alias("words")).where("words <> ''").dropDuplicates(["item_id", "words"])
    asked = cut_lineage(asked.withColumn("own", F.xxhash64("item_id", "words")), "items")
    seeds = cut_lineage(asked.select("own", "words").mapInArrow(_item_seeds, SEEDS), "item-seeds")
    short = F.size(F.split("words", " "))
    lengths = [r["n"] for r in asked.select(short.alias("n")).where(F.col("n") < RUN_WORDS).distinct().collect()]  # fewer than RUN_WORDS
    masks = [*MASKS, *("1" * n for n in sorted(lengths) if "1" * n not in MASKS)]
    in_items = spark.sparkContext.broadcast(bits.build(seeds, "seed", seeds.count()))

    docs = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("own"))
    words = spread(docs).select("own", words_text(F.col("text")).alias("words"))
    hits = words.mapInArrow(_doc_seeds(masks, in_items), SEEDS).select("seed", F.col("own").alias("doc"), F.col("at").alias("doc_at"))
    met = hits.join(seeds, "seed").groupBy("doc", "own").agg(F.collect_set(F.col("doc_at") - F.col("at")).alias("diagonals"))
    met = cut_lineage(met, "hits")

    in_docs = spark.sparkContext.broadcast(bits.build(met, "doc", met.count()))
    item_words = asked.select("own", "item_id", "words").mapInArrow(_item_hashes, "own long, item_id long, hashes binary")
    part = F.pmod(F.xxhash64("own"), F.lit(PARTS))
    lists = met.join(item_words, "own").groupBy("doc", part.alias("part")).agg(F.collect_list(F.struct("item_id", "hashes", "diagonals")).alias("items"))
    affected = docs.where(bits.holds(in_docs, "own")).dropDuplicates(["own"]).select(F.col("own").alias("doc"), "doc_id", words_text(F.col("text")).alias("words"))
    found = affected.join(lists.drop("part"), "doc").select("doc_id", "words", "items").mapInArrow(_compare, FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("exact_words").alias("exact_words"), F.max("tolerant_words").alias("tolerant_words"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold RUN_WORDS consecutive words of an item, or all words of a shorter one."""
    return _overlaps(spark, sf_dir).where(F.col("exact_words") >= F.least(F.lit(RUN_WORDS), F.col("item_words"))).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p7_found, but also overlaps with substituted words: length of either kind, and share of the item that leaked."""
    return (
        _overlaps(spark, sf_dir)
        .where(F.col("tolerant_words") >= F.least(F.lit(RUN_WORDS), F.col("item_words")))
        .withColumn("leaked_share", F.round(F.col("tolerant_words") / F.col("item_words"), 6))
    )
