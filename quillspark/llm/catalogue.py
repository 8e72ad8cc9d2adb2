"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import leaks, mixing, mojibake, names, oracles, radix_copies, scans, sentences, spans, term_bitmaps

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": radix_copies.p1_found,
        "p1_records": radix_copies.p1_records,
        "p2_found": spans.p2_found,
        "p2_shared_spans": spans.p2_shared_spans,
        "p2_shared_share": spans.p2_shared_share,
        "p3_found": term_bitmaps.p3_found,
        "p3_term_profile": term_bitmaps.p3_term_profile,
        "p4_found": names.p4_found,
        "p4_entities": names.p4_entities,
        "p5_found": sentences.p5_found,
        "p5_sentences": sentences.p5_sentences,
        "p6_found": scans.p6_found,
        "p6_repaired": scans.p6_repaired,
        "p7_found": leaks.p7_found,
        "p7_leaks": leaks.p7_leaks,
        "p8_mixture": mixing.p8_mixture,
        "p8_shares": mixing.p8_shares,
        "p9_found": mojibake.p9_found,
        "p9_repaired": mojibake.p9_repaired,
    }


def oracle_sql() -> dict[str, str]:
    return term_bitmaps.SQL | oracles.SQL
