"""Words as 64-bit hashes: the shared ground of the operators on word runs.

A word is a maximal run of letters, combining marks and digits, case ignored. Splitting happens in the JVM (one regular
expression), hashing once per distinct word of an Arrow batch, everything after that on flat numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words.
NOT_WORD = r"[^\p{L}\p{M}\p{Nd}]+"


def words_text(text: Column) -> Column:
    """Lower-cased words joined by single spaces; null for null."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the offsets of each text's words (one more than texts).

    Null and empty texts have no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = table[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.uint64)
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text splits into one empty piece
        keep = np.ones(len(hashes), bool)
        keep[offsets[:-1][empty]] = False
        sizes = np.diff(offsets)
        sizes[empty] = 0
        hashes, offsets = hashes[keep], np.concatenate([[0], np.cumsum(sizes)])
    return hashes, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads the entropy of sums and shifts over all 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def prefix_polynomial(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums S and powers for digests of any word range: see range_digest."""
    n = len(hashes)
    powers = np.empty(n + 1, np.uint64)
    base, size = np.uint64(0x9E3779B97F4A7C15 | 1), 1
    powers[0] = 1
    with np.errstate(over="ignore"):
        while size <= n:  # doubling: powers[size:2*size] = powers[:size] * base**size
            step = powers[size - 1] * base
            upto = min(size, n + 1 - size)
            powers[size : size + upto] = powers[:upto] * step
            size *= 2
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers[:n], dtype=np.uint64)])
    return sums, powers


def range_digest(sums: np.ndarray, powers: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digest of the words [start, end): equal for equal word runs wherever they stand in the batch.

    The polynomial sum over a range differs by a power of the (odd, hence invertible) base with its place; multiplying by the
    inverse power removes the place.
    """
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(0x9E3779B97F4A7C15 | 1), -1, 1 << 64))
        back = np.ones(int(start.max()) + 1 if len(start) else 1, np.uint64)
        size = 1
        while size < len(back):
            step = back[size - 1] * inverse
            upto = min(size, len(back) - size)
            back[size : size + upto] = back[:upto] * step
            size *= 2
        body = (sums[end] - sums[start]) * back[start]
        return mix(body + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
