"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the hash threshold.
STEPS = 1 << 40


def bounded_texts(rows: DataFrame, most: int) -> list[str]:
    """At most that many texts of a column text, the first by a hash of the text: the same for the same data.

    A threshold on the hash, set by the number of rows, keeps about 1.5 times as many rows before any sort, so that what reaches
    the driver doesn't grow with the number of rows or partitions. Null and blank texts are left out.
    """
    n = rows.count()
    place = F.pmod(F.xxhash64("text"), F.lit(STEPS))
    limit = STEPS if n <= most else int(STEPS * 1.5 * most / n)
    kept = rows.where((place < limit) & (F.trim("text") != "")).select("text", place.alias("place"))
    texts = sorted(((r["place"], r["text"]) for r in kept.collect()))
    return [t for _, t in texts[:most]]
