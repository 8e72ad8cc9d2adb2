"""Problem 8: a mixture of sources with target shares of all tokens.

Entropy balancing. A document i of source s gets the rate r_i that stays closest in relative entropy to 1 while the tokens of
every source meet its target: r_i = min(cap_s, exp(l_s * t_i / m_s)), t_i its tokens, m_s the mean of its source. The
multipliers l_s solve the convex dual; every Newton step is one aggregation of tokens, tilted tokens and their derivative by
source over all documents. Rates become whole copies by systematic rounding within bounded groups ordered by size, so that
sums of copies and of tokens stay within about a document of the rates' sums per group.

The total is the largest for which every source can reach its share without repeating a document more often than allowed (or
the caller's budget, if less). Sources without a target take no part; targets without documents are reported with an actual
share of 0, and the other shares are taken relative to what remains.
"""

from __future__ import annotations

import math
import os
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.session import cut_lineage, load, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public tokenizer cuts a text into pieces (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents that are rounded together.
GROUP_ROWS = 10_000
STEPS, CLOSE = 60, 1e-9
#: Starts of the systematic rounding; the one whose tokens come closest is used.
OFFSETS = [(k + 0.5) / 16 for k in range(16)]


def token_counter(name: str, pattern: str = PATTERN):
    """A scalar iterator UDF that counts the tokens of a text; the shipped vocabulary is read once per Python worker."""

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0)

    return count


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), written once; documents without source or tokens are left out, repeated ids count once."""
    df = spread(documents.where(F.col("source").isNotNull() & F.col("text").isNotNull()))
    sizes = df.select("doc_id", "source", token_counter(shipped(documents.sparkSession, tokenizer))(F.col("text")).alias("tokens")).where("tokens > 0")
    once = sizes.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("r"))  # of an id's rows the longest text counts
    return once.select("doc_id", "r.source", "r.tokens")


def shipped(spark: SparkSession, path: str) -> str:
    """The name of a vocabulary file that was sent to every worker: it need not be on their machines."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def balance(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> list[dict]:
    """Per source with a target: its tokens, mean, wanted tokens and multiplier. One row per target is collected."""
    have = {r["source"]: r for r in sizes.join(F.broadcast(targets.select("source")), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    rows = [r.asDict() for r in targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").collect()]
    live = [r for r in rows if r["source"] in have and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    whole = sum(r["target_share"] for r in live)
    for r in live:
        r |= {"tokens": have[r["source"]]["tokens"], "mean": have[r["source"]]["tokens"] / have[r["source"]]["docs"], "share": r["target_share"] / whole, "tilt": 0.0, "low": -math.inf, "high": math.inf}
    total = min([r["max_repeats"] * r["tokens"] / r["share"] for r in live] + ([budget] if budget else []), default=0.0)
    for r in live:
        r["wanted"] = r["share"] * total
    spark = sizes.sparkSession
    for _ in range(STEPS):
        rates = spark.createDataFrame([(r["source"], r["mean"], float(r["max_repeats"]), r["tilt"]) for r in live], "source string, mean double, cap double, tilt double") if live else None
        if rates is None:
            break
        x = F.col("tokens") / F.col("mean")
        tilted = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        sums = sizes.join(F.broadcast(rates), "source").groupBy("source").agg(
            F.sum(F.col("tokens") * F.least(F.col("cap"), tilted)).alias("value"),
            F.sum(F.when(tilted < F.col("cap"), F.col("tokens") * x * tilted).otherwise(0.0)).alias("slope"),
        )
        got = {r["source"]: r for r in sums.collect()}
        worst = 0.0
        for r in live:
            value, slope = got[r["source"]]["value"], got[r["source"]]["slope"]
            gap = r["wanted"] - value
            worst = max(worst, abs(gap) / r["wanted"])
            if abs(gap) <= CLOSE * r["wanted"]:
                continue
            r["low" if gap > 0 else "high"] = r["tilt"]
            step = r["tilt"] + (gap / slope if slope > 0 else math.copysign(1.0, gap))
            if math.isfinite(r["low"]) and math.isfinite(r["high"]):
                if not r["low"] < step < r["high"]:  # a Newton step that leaves the bracket becomes a bisection
                    step = (r["low"] + r["high"]) / 2
            else:
                step = min(max(step, r["tilt"] - 4), r["tilt"] + 4)
            r["tilt"] = step
            if r["tilt"] > 50 * r["mean"]:  # at the cap for every document
                r["tilt"] = 50 * r["mean"]
        if worst <= 1e-6:
            break
    else:
        warnings.warn(f"a source is still {worst:.2%} of its tokens away from its target after {STEPS} steps", stacklevel=2)
    return [r | next((x for x in live if x["source"] == r["source"]), {"tilt": None, "mean": 1.0, "tokens": have[r["source"]]["tokens"] if r["source"] in have else 0}) for r in rows]


def copies(sizes: DataFrame, solved: list[dict]) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of documents with at least one copy."""
    spark = sizes.sparkSession
    live = [(r["source"], float(r["mean"]), float(r["max_repeats"]), float(r["tilt"]), max(1, -(-int(r["tokens"] / r["mean"]) // GROUP_ROWS))) for r in solved if r["tilt"] is not None]
    rates = spark.createDataFrame(live, "source string, mean double, cap double, tilt double, groups int")
    df = sizes.join(F.broadcast(rates), "source").withColumn("rate", F.least(F.col("cap"), F.exp(F.least(F.col("tilt") * F.col("tokens") / F.col("mean"), F.lit(50.0)))))
    w = Window.partitionBy("source", F.pmod(F.xxhash64("doc_id"), F.col("groups"))).orderBy("tokens", "doc_id")
    df = df.withColumn("upto", F.sum("rate").over(w)).withColumn("before", F.coalesce(F.lag("upto").over(w), F.lit(0.0)))
    df = cut_lineage(df.select("doc_id", "source", "tokens", "rate", "upto", "before"), "rates")
    taken = [F.sum(F.col("tokens") * (F.floor(F.col("upto") + o) - F.floor(F.col("before") + o))).alias(f"o{k}") for k, o in enumerate(OFFSETS)]
    best = []
    for r in df.groupBy("source").agg(*taken).collect():  # a row per target
        wanted = next(x["wanted"] for x in solved if x["source"] == r["source"])
        best.append((r["source"], min(OFFSETS, key=lambda o: abs(r[f"o{OFFSETS.index(o)}"] - wanted))))
    df = df.join(F.broadcast(spark.createDataFrame(best, "source string, start double")), "source")
    number = F.floor(F.col("upto") + F.col("start")) - F.floor(F.col("before") + F.col("start"))
    return df.withColumn("copies", number.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), "copies")


def mixture(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER, budget: float | None = None) -> tuple[DataFrame, list[dict]]:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    targets = load(spark, sf_dir, "mix_targets")
    sizes = cut_lineage(token_sizes(docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), tokenizer), "tokens")
    solved = balance(sizes, targets, budget)
    return copies(sizes, solved), solved


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, their rate and number of copies."""
    return mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: its share, tokens and actual share in the mixture, documents used and highest number of copies."""
    picked, _ = mixture(spark, sf_dir)
    got = picked.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    df = load(spark, sf_dir, "mix_targets").join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    return df.withColumn("actual_share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))
