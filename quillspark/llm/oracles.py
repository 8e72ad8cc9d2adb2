"""SQL for DuckDB of those queries of this subpackage that it can express on whole tables, written independently of the operators."""

from __future__ import annotations

from quillspark.llm import leaks

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_TITLE = f"regexp_replace(replace(lower(nfc_normalize(translate(coalesce(title, ''), '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}'))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_BARE = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\\s+', '', 'g'), '^[<(\\[]+|[>)\\].,;]+$', '', 'g')"
_DOI = f"regexp_replace(regexp_replace({_BARE.format('doi')}, '^(https?://)?(dx\\.)?doi\\.example/', ''), '^doi:', '')"
_URL = f"regexp_replace({_BARE.format('url')}, '^[a-z]+://', '')"
_ENTRIES = f"""u AS (SELECT ref_id, {_TITLE} AS t, {_DOI} AS d, {_URL} AS u FROM refs),
    e AS (SELECT ref_id, t, d, rtrim(split_part(u, '?', 1), '/') || '?' || array_to_string(list_sort(string_split(split_part(u, '?', 2), '&')), '&') AS u FROM u)"""
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}]+')"


def _grams(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string(list_slice({words}, i, i + {n - 1}), ' '))"


_RECORDS = f"""r AS (SELECT 'passages' AS rec_table, passage_id AS rec_id, text FROM passages WHERE origin IS NULL OR origin <> 'scan' UNION SELECT 'draft_sentences', sent_id, text FROM draft_sentences
        UNION SELECT 'source_sentences', src_id, text FROM source_sentences WHERE origin IS NULL OR origin <> 'scan'),
    w AS (SELECT rec_table, rec_id, {_WORDS} AS w FROM r WHERE text IS NOT NULL)"""
_SPANS = f"""{_RECORDS}, g AS (SELECT rec_table, rec_id, len(w) AS n, unnest(range(0, len(w) - 11)) AS p, unnest({_grams('w', 12)}) AS g FROM w WHERE len(w) >= 12),
    s AS (SELECT g FROM (SELECT DISTINCT rec_table, rec_id, g FROM g) GROUP BY g HAVING count(*) > 1), h AS (SELECT * FROM g WHERE g IN (SELECT g FROM s)),
    o AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY rec_table, rec_id ORDER BY p) + 12 THEN 1 ELSE 0 END AS opened FROM h),
    k AS (SELECT *, sum(opened) OVER (PARTITION BY rec_table, rec_id ORDER BY p) AS span FROM o),
    spans AS (SELECT rec_table, rec_id, any_value(n) AS n, CAST(min(p) AS INTEGER) AS word_start, CAST(max(p) + 12 AS INTEGER) AS word_end FROM k GROUP BY rec_table, rec_id, span)"""

def _seed_hits() -> str:
    """Common table expressions: diagonals (doc_id, item_id, g) on which a spaced seed of an item stands in a document."""
    parts = []
    for mask in leaks.MASKS:
        at = [k for k, bit in enumerate(mask) if bit == "1"]
        key = f"list_transform(range(1, len(w) - {len(mask) - 2}), lambda p: array_to_string(list_transform({at}, lambda o: w[p + o]), ' '))"
        rows = lambda t, i, where: f"(SELECT {i}, unnest(range(1, len(w) - {len(mask) - 2})) AS p, unnest({key}) AS k FROM {t} WHERE len(w) >= {where})"  # noqa: E731, B023
        parts.append(f"SELECT doc_id, item_id, a.p - b.p AS g FROM {rows('d', 'doc_id', len(mask))} a JOIN {rows('i', 'item_id', leaks.RUN_WORDS)} b USING (k)")
    short = f"SELECT doc_id, item_id, p - 1 AS g FROM (SELECT doc_id, d.w AS dw, item_id, i.w AS iw, unnest(range(1, len(d.w) - len(i.w) + 2)) AS p FROM d JOIN i ON len(i.w) BETWEEN 1 AND {leaks.RUN_WORDS - 1} AND len(d.w) >= len(i.w)) WHERE list_slice(dw, p, p + len(iw) - 1) = iw"
    return f"""i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        hit AS ({' UNION '.join(parts)} UNION {short})"""


SQL = {
    "p7_leaks": f"""WITH {_seed_hits()},
        c0 AS (SELECT doc_id, item_id, g, d.w AS dw, i.w AS iw, unnest(range(greatest(1, 1 - g), least(len(i.w), len(d.w) - g) + 1)) AS k FROM hit JOIN d USING (doc_id) JOIN i USING (item_id)),
        c AS (SELECT doc_id, item_id, g, k, len(iw) AS n, iw[k] = dw[k + g] AS eq FROM c0),
        s AS (SELECT *, sum(CASE WHEN eq THEN 1 ELSE -4 END) OVER w AS upto, sum(CASE WHEN eq THEN 0 ELSE 1 END) OVER w AS breaks FROM c WINDOW w AS (PARTITION BY doc_id, item_id, g ORDER BY k)),
        e AS (SELECT doc_id, item_id, max(len) AS exact_words FROM (SELECT doc_id, item_id, count(*) AS len FROM s WHERE eq GROUP BY doc_id, item_id, g, breaks) GROUP BY 1, 2),
        t AS (SELECT a.doc_id, a.item_id, any_value(a.n) AS n, max(b.k - a.k + 1) AS tolerant_words FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.g = b.g AND a.k <= b.k AND a.eq AND b.eq AND b.upto - a.upto + 1 >= 0 GROUP BY 1, 2)
        SELECT doc_id, item_id, CAST(n AS INTEGER) AS item_words, CAST(exact_words AS INTEGER) AS exact_words, CAST(tolerant_words AS INTEGER) AS tolerant_words, round(tolerant_words / n::DOUBLE, 6) AS leaked_share FROM t JOIN e USING (doc_id, item_id) WHERE tolerant_words >= least({leaks.RUN_WORDS}, n)""",
    "p1_found": f"WITH {_ENTRIES}, f AS (SELECT min(ref_id) OVER (PARTITION BY t, d, u) AS first_ref_id, ref_id FROM e) SELECT DISTINCT first_ref_id, ref_id FROM f WHERE ref_id <> first_ref_id",
    "p1_records": f"""WITH {_ENTRIES}, c AS (SELECT min(ref_id) AS ref_id, count(*) AS copies FROM e GROUP BY t, d, u) SELECT ref_id, copies, citekey, title, doi, url FROM c JOIN refs USING (ref_id)""",
    "p2_found": f"""WITH {_RECORDS}, g AS (SELECT DISTINCT rec_table, rec_id, unnest({_grams('w', 12)}) AS g FROM w WHERE len(w) >= 12),
        s AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1) SELECT DISTINCT rec_table, rec_id FROM g WHERE g IN (SELECT g FROM s)""",
    "p2_shared_spans": f"WITH {_SPANS} SELECT rec_table, rec_id, word_start, word_end FROM spans",
    "p2_shared_share": f"""WITH {_SPANS} SELECT rec_table, rec_id, CAST(any_value(n) AS INTEGER) AS words, CAST(sum(word_end - word_start) AS BIGINT) AS shared_words, count(*) AS spans, round(sum(word_end - word_start) / any_value(n)::DOUBLE, 6) AS share FROM spans GROUP BY 1, 2""",
    "p7_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        ig AS (SELECT DISTINCT item_id, unnest({_grams('w', 13)}) AS g FROM i WHERE len(w) >= 13), dg AS (SELECT DISTINCT doc_id, unnest({_grams('w', 13)}) AS g FROM d WHERE len(w) >= 13),
        short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM i WHERE len(w) BETWEEN 1 AND 12)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g) UNION SELECT doc_id, item_id FROM d JOIN short ON contains(' ' || array_to_string(w, ' ') || ' ', t)""",
}
