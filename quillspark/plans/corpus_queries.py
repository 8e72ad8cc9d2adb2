"""Queries on the bibliography, the ledger and the texts of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus, review
from quillspark.session import load


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicates(load(spark, d, "refs"))


def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_members(load(spark, d, "refs"))


def _delivery(spark: SparkSession, d: str) -> DataFrame:
    """What the bibliography delivers now; the entries' last sync decides which file they name."""
    return load(spark, d, "refs").select("citekey", F.sha2("pdf_path", 256).alias("pdf_hash"))


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger as it was before: of every entry synced in an odd hour the file it named then (its folder was another one) or, of
    those in an hour that three divides, the same; and a key that has since been renamed for each of the others."""
    hour = F.hour("last_synced")
    old = load(spark, d, "refs").select("citekey", "pdf_path", hour.alias("h"))
    known = F.when(F.col("h") % 3 == 0, F.col("pdf_path")).otherwise(F.concat(F.lit("old/"), F.col("pdf_path")))
    key = F.when((F.col("h") % 2 == 1) | (F.col("h") % 3 == 0), F.col("citekey")).otherwise(F.concat(F.col("citekey"), F.lit("-was")))
    rows = old.select(key.alias("citekey"), F.sha2(known, 256).alias("pdf_hash"), (F.col("h") % 5).alias("k"))
    status = F.when(F.col("pdf_hash").isNull(), "no_pdf").when(F.col("k") == 4, "parse_failed").otherwise("parsed")
    kind = F.when((F.col("k") == 4) & F.col("pdf_hash").isNotNull(), F.when(F.length("citekey") % 2 == 0, "deterministic"))
    return rows.select("citekey", "pdf_hash", status.alias("status"), kind.alias("failure_kind"))


def ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The reconciled ledger: what happens to each key, and whether its file must be parsed."""
    return corpus.upsert(_ledger(spark, d), _delivery(spark, d))


def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the ledger that the bibliography no longer delivers."""
    return corpus.stale(_ledger(spark, d), _delivery(spark, d)).select("citekey")


def ledger_pruned(spark: SparkSession, d: str) -> DataFrame:
    return corpus.prune(_ledger(spark, d), _delivery(spark, d)).select("citekey", "status")


def parse_results(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after a run over all that must be parsed: files in a folder of papers fail for good, all others are parsed."""
    work = ledger_upsert(spark, d).where("parse").join(_delivery(spark, d).groupBy("citekey").agg(F.max("pdf_hash").alias("pdf_hash")), "citekey")
    results = work.select("citekey", F.when(F.substring("pdf_hash", 1, 1) < "4", "unreadable").alias("error"), (F.substring("pdf_hash", 1, 1) < "2").alias("transient"))
    return corpus.apply_results(ledger_upsert(spark, d).select("citekey", "status", "failure_kind"), results)


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries by state of their attachment, and their total (null state)."""
    return load(spark, d, "refs").rollup("pdf_resolution").agg(F.count("*").alias("n"))


def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("pdf_resolution").isin("malformed file field", "non-PDF attachment only"), "deterministic")
    return corpus.failure_counts(load(spark, d, "refs").where("pdf_resolution <> 'resolved'").withColumn("failure_kind", kind))


def fingerprint_changes(spark: SparkSession, d: str) -> DataFrame:
    """State of an index of sources kept from the passages against one drawn from the source sentences."""

    def fp(table: str) -> DataFrame:
        return load(spark, d, table).where("citekey is not null").groupBy(F.col("citekey").alias("key")).agg(F.concat_ws("-", F.max("page"), F.min("page")).alias("fp"))

    return corpus.refresh(fp("passages"), fp("source_sentences"))


def passages_latest(spark: SparkSession, d: str) -> DataFrame:
    """One record per passage_id: the latest delivery; unknown pages and texts count as 0."""
    p = load(spark, d, "passages").select("passage_id", "citekey", "label", "page", F.length("text").cast("long").alias("chars"), "loaded_at")
    return corpus.latest(p, "passage_id", "loaded_at").drop("loaded_at").fillna(0, ["page", "chars"])


def ledger_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The entry with the first key, if its file is known, looked up by that key."""
    refs = load(spark, d, "refs")
    return corpus.point_lookup(refs.where("pdf_path is not null"), refs.where("pdf_path is not null").agg(F.min("citekey")).first()[0]).select("citekey", "title", "pdf_path")


def collection_names(spark: SparkSession, d: str) -> DataFrame:
    return corpus.collection_names(load(spark, d, "refs"))


def collection_members(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the collection Twins and of those below it."""
    return load(spark, d, "refs").where(T.collection_matches(F.col("collections"), "twins")).select("ref_id", "citekey")


def key_digests(spark: SparkSession, d: str) -> DataFrame:
    return corpus.set_digest(load(spark, d, "refs"), ["item_type"], "citekey").drop("first")


def digest_states(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the keys a draft cites against that of the keys its claims stand with."""
    recorded = corpus.set_digest(load(spark, d, "overlap_df").withColumnRenamed("draft", "key"), ["key"], "citekey")
    current = corpus.set_digest(load(spark, d, "draft_sentences").select(F.col("draft").alias("key"), F.explode("citekeys").alias("citekey")), ["key"], "citekey")
    return review.status_of(recorded, current)


def citekey_problems(spark: SparkSession, d: str) -> DataFrame:
    """Keys by what keeps them from naming a file (null: nothing)."""
    return load(spark, d, "refs").groupBy(T.citekey_problem(F.col("citekey")).alias("problem")).agg(F.count("*").alias("n"))


def kept_fields(spark: SparkSession, d: str) -> DataFrame:
    """Kept, non-blank fields of each entry as a JSON object, in order of their names; null without any."""
    kept = F.map_filter("fields", lambda k, v: k.isin(*T.KEPT_FIELDS) & (F.trim(v) != ""))
    packed = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))
    return load(spark, d, "refs").select("ref_id", F.nullif(packed, F.lit("{}")).alias("kept"))


def author_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of at least three letters in the names of authors, and their uses."""
    names = load(spark, d, "refs").select(F.explode("authors").alias("a")).select(F.lower(F.concat_ws(" ", "a.first", "a.last")).alias("name"))
    return names.select(F.explode(F.regexp_extract_all("name", F.lit("[a-z]{3,}"), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("uses"))


def author_lists(spark: SparkSession, d: str) -> DataFrame:
    """Authors of each entry as a reference prints them: initials and surname, more than six as the first and others."""
    a = F.col("authors")
    one = F.transform(a, lambda x: F.concat(F.when(F.coalesce(x["first"], F.lit("")) == "", "").otherwise(F.concat(F.substring(x["first"], 1, 1), F.lit(". "))), x["last"]))
    names = F.when(F.size(a) == 0, None).when(F.size(a) > 6, F.concat(one[0], F.lit(" et al."))).otherwise(F.array_join(one, ", "))
    return load(spark, d, "refs").select("ref_id", names.alias("authors"))


def ieee_entries(spark: SparkSession, d: str) -> DataFrame:
    """One printable line per entry: title, venue, volume, pages and year."""
    f = lambda k: F.col("fields")[k]
    parts = F.array_compact(F.array(F.concat(F.lit('"'), F.translate("title", "{}", ""), F.lit('"')), f("journal"), F.concat(F.lit("vol. "), f("volume")), F.concat(F.lit("pp. "), F.replace(f("pages"), F.lit("--"), F.lit("-"))), F.nullif("year", F.lit("n.d."))))
    return load(spark, d, "refs").select("ref_id", F.array_join(parts, ", ").alias("entry"))


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where("text is not null").select("doc_id", T.page_count(F.col("text")).cast("long").alias("pages"))


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of each page, and of all pages before it: the boundaries that place a word on its page."""
    p = load(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.pages(F.col("text"))).alias("page", "text"))
    rows = p.select("doc_id", (F.col("page") + 1).cast("long").alias("page"), F.size(T.words(F.col("text"))).cast("long").alias("words"))
    before = F.sum("words").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("words_before", F.coalesce(before, F.lit(0)))


def parse_quality(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each document, the share of them over 20 letters, and whether its words run together: of at least 200 tokens more
    than one in a hundred."""
    rows = load(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.alphabetic(F.col("text"))).cast("long").alias("tokens"), F.round(T.run_together_ratio(F.col("text")), 6).alias("ratio"))
    return rows.withColumn("poor", F.coalesce((F.col("tokens") >= 200) & (F.col("ratio") > 0.01), F.lit(False)))


def content_chars(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document without its noise lines."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.length(T.content_text(F.col("text"))).cast("long").alias("chars"))


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").where("text is not null").select("doc_id", T.words(F.col("text")).alias("w"))
    chunks = T.chunks(F.col("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.size(chunks).cast("long").alias("chunks"))


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    tokens = load(spark, d, "documents").where("text is not null").select("doc_id", T.words(F.col("text")).alias("w"))
    rows = tokens.select("doc_id", F.posexplode(T.chunks(F.col("w"))).alias("chunk", "text"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("digest"))


def headings(spark: SparkSession, d: str) -> DataFrame:
    return review.headings(load(spark, d, "documents").where("text is not null"))


def paragraph_counts(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.filter(F.split("text", "\n\n"), lambda b: F.trim(F.translate(b, "\n\f", "  ")) != "")
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.size(blocks).cast("long").alias("paragraphs"))


def text_digests(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several passages have, by digest."""
    return load(spark, d, "passages").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("passage_id").alias("first_id")).where("n > 1")


def passage_labels(spark: SparkSession, d: str) -> DataFrame:
    """Passages by label with their words; blank and page-less ones apart."""
    rows = load(spark, d, "passages").select("label", F.coalesce(F.col("page") >= 1, F.lit(False)).alias("paged"), F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)).alias("words"))
    return rows.groupBy("label", "paged").agg(F.count("*").alias("passages"), F.sum(F.greatest("words", F.lit(0))).alias("words"))


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of boxes on one page that overlap by more than a point on both axes, neither containing the other.

    An equi-join on source and page with a range condition; a page holds a bounded number of boxes.
    """
    p = load(spark, d, "passages").where("bbox is not null and page is not null and citekey is not null").groupBy("passage_id").agg(F.first("citekey").alias("citekey"), F.first("page").alias("page"), F.first("bbox").alias("b"))
    box = lambda n: p.select("citekey", "page", F.col("passage_id").alias(f"{n}_id"), *(F.element_at("b", i + 1).alias(f"{n}{c}") for i, c in enumerate(("x1", "y1", "x2", "y2"))))
    a, b = box("a"), box("b")
    overlap = "a_id < b_id and least(ax2, bx2) - greatest(ax1, bx1) > 1 and least(ay2, by2) - greatest(ay1, by1) > 1"
    inside = "(ax1 <= bx1 and ay1 <= by1 and bx2 <= ax2 and by2 <= ay2) or (bx1 <= ax1 and by1 <= ay1 and ax2 <= bx2 and ay2 <= by2)"
    return a.join(b, ["citekey", "page"]).where(overlap).where(f"not ({inside})").select("a_id", "b_id")


def fit_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares line of characters by words for each source; a slope of 0 without variance."""
    rows = load(spark, d, "documents").where("text is not null and source is not null").select("source", F.size(T.words(F.col("text"))).alias("w"), "n_chars")
    return rows.groupBy("source").agg(F.round(F.coalesce(F.regr_slope("n_chars", "w"), F.lit(0.0)), 3).alias("slope"), F.round(F.coalesce(F.regr_intercept("n_chars", "w"), F.avg("n_chars")), 2).alias("intercept"), F.count("*").alias("n"))


def length_fence(spark: SparkSession, d: str) -> DataFrame:
    return review.tukey_fence(load(spark, d, "documents").where("source is not null"), "source", "n_chars")


_F = (duplicate_groups, duplicate_members, ledger_upsert, stale_rows, ledger_pruned, status_counts, failure_counts, fingerprint_changes, passages_latest, collection_names, collection_members, key_digests, digest_states, citekey_problems, kept_fields, author_tokens, author_lists, ieee_entries, page_counts, page_words, parse_quality, content_chars, chunk_counts, chunk_texts, headings, paragraph_counts, text_digests, passage_labels, box_overlaps, fit_by_source, length_fence)
_F += (parse_results, ledger_lookup)
QUERIES = {f.__name__: f for f in _F}

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_DELIVERY = """dl AS (SELECT citekey, sha256(pdf_path) AS pdf_hash FROM refs), h AS (SELECT citekey, pdf_path, hour(last_synced) AS h FROM refs),
    lg0 AS (SELECT CASE WHEN h % 2 = 1 OR h % 3 = 0 THEN citekey ELSE citekey || '-was' END AS citekey, sha256(CASE WHEN h % 3 = 0 THEN pdf_path ELSE 'old/' || pdf_path END) AS pdf_hash, h % 5 AS k FROM h),
    lg AS (SELECT citekey, pdf_hash, CASE WHEN pdf_hash IS NULL THEN 'no_pdf' WHEN k = 4 THEN 'parse_failed' ELSE 'parsed' END AS status, CASE WHEN k = 4 AND pdf_hash IS NOT NULL AND length(citekey) % 2 = 0 THEN 'deterministic' END AS failure_kind FROM lg0)"""
_UPSERT = f"""{_DELIVERY}, j AS (SELECT coalesce(lg.citekey, dl.citekey) AS citekey, lg.citekey IS NOT NULL AS o, dl.citekey IS NOT NULL AS n, lg.pdf_hash AS oh, dl.pdf_hash AS nh, status, failure_kind FROM lg FULL JOIN dl ON lg.citekey = dl.citekey),
    a AS (SELECT *, CASE WHEN NOT o THEN 'insert' WHEN NOT n THEN 'stale' WHEN oh IS NOT DISTINCT FROM nh AND status = 'parse_failed' AND failure_kind IS DISTINCT FROM 'deterministic' THEN 'retry' WHEN oh IS NOT DISTINCT FROM nh THEN 'keep' ELSE 'update' END AS action FROM j),
    up AS (SELECT citekey, CASE WHEN action IN ('keep', 'stale') THEN status WHEN nh IS NULL THEN 'no_pdf' ELSE 'discovered' END AS status, CASE WHEN action IN ('keep', 'stale') THEN failure_kind END AS failure_kind, action, action IN ('insert', 'update', 'retry') AND nh IS NOT NULL AS parse FROM a)"""
_DOI = "trim(regexp_replace(regexp_replace(lower(trim(doi)), '^https?://(dx\\.)?doi\\.(org|example)/', ''), '^doi:', ''))"
_TITLE = "trim(regexp_replace(lower(translate(title, '{}', '')), '[^a-z0-9]+', ' ', 'g'))"
_CHUNKS = f"list_transform(range(0, len({_WORDS}), 160), lambda i: array_to_string(list_slice({_WORDS}, i + 1, i + 200), ' '))"

_DUPLICATES = f"""r AS (SELECT 'doi' AS kind, {_DOI} AS value, citekey FROM refs WHERE doi IS NOT NULL UNION ALL SELECT 'title', {_TITLE}, citekey FROM refs WHERE title IS NOT NULL),
    g AS (SELECT kind, value, array_to_string(list_sort(list_distinct(list(citekey))), ',') AS keys, count(DISTINCT citekey) AS members, min(citekey) AS first FROM r WHERE value <> '' OR kind = 'title' GROUP BY kind, value HAVING count(DISTINCT citekey) >= 2),
    d AS (SELECT kind, value, members, first FROM g QUALIFY row_number() OVER (PARTITION BY keys ORDER BY kind, value) = 1)"""


def _digest(group: str, value: str, table: str) -> str:
    part = lambda at: f"CAST(sum(CAST(CAST('0x' || substr(sha256({value}), {at}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
    return f"SELECT {group}, count(*) AS members, substr(sha256({part(1)} || '-' || {part(16)}), 1, 12) AS digest FROM (SELECT DISTINCT {group}, {value} FROM {table} WHERE {value} IS NOT NULL) GROUP BY 1"


SQL = {
    "duplicate_groups": f"WITH {_DUPLICATES} SELECT kind, value, members, first FROM d",
    "duplicate_members": f"WITH {_DUPLICATES} SELECT DISTINCT citekey, kind, value FROM r JOIN d USING (kind, value)",
    "ledger_upsert": f"WITH {_UPSERT} SELECT citekey, status, failure_kind, action, parse FROM up",
    "stale_rows": f"WITH {_DELIVERY} SELECT citekey FROM lg WHERE citekey NOT IN (SELECT citekey FROM refs)",
    "parse_results": f"""WITH {_UPSERT}, w AS (SELECT up.citekey, max(dl.pdf_hash) AS h FROM up JOIN dl USING (citekey) WHERE parse GROUP BY 1)
        SELECT up.citekey, CASE WHEN w.citekey IS NULL THEN status WHEN substr(w.h, 1, 1) < '4' THEN 'parse_failed' ELSE 'parsed' END AS status,
               CASE WHEN w.citekey IS NULL THEN failure_kind WHEN substr(w.h, 1, 1) < '2' THEN 'transient' WHEN substr(w.h, 1, 1) < '4' THEN 'deterministic' END AS failure_kind FROM up LEFT JOIN w ON w.citekey = up.citekey""",
    "ledger_lookup": "SELECT citekey, title, pdf_path FROM refs WHERE pdf_path IS NOT NULL AND citekey = (SELECT min(citekey) FROM refs WHERE pdf_path IS NOT NULL)",
    "ledger_pruned": f"WITH {_DELIVERY} SELECT citekey, status FROM lg WHERE citekey IN (SELECT citekey FROM refs)",
    "status_counts": "SELECT pdf_resolution, count(*) AS n FROM refs GROUP BY ROLLUP (pdf_resolution)",
    "failure_counts": "SELECT CASE WHEN pdf_resolution IN ('malformed file field', 'non-PDF attachment only') THEN 'deterministic' ELSE 'transient' END AS failure_kind, count(*) AS n FROM refs WHERE pdf_resolution <> 'resolved' GROUP BY 1",
    "fingerprint_changes": """WITH p AS (SELECT citekey AS key, concat_ws('-', max(page), min(page)) AS fp FROM passages WHERE citekey IS NOT NULL GROUP BY 1), c AS (SELECT citekey AS key, concat_ws('-', max(page), min(page)) AS fp FROM source_sentences WHERE citekey IS NOT NULL GROUP BY 1)
        SELECT coalesce(p.key, c.key) AS key, CASE WHEN c.key IS NULL THEN 'dropped' WHEN p.key IS NULL OR p.fp <> c.fp THEN 'rebuilt' ELSE 'unchanged' END AS state FROM p FULL JOIN c ON p.key = c.key""",
    "passages_latest": "SELECT passage_id, citekey, label, coalesce(page, 0) AS page, CAST(coalesce(length(text), 0) AS BIGINT) AS chars FROM passages QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY loaded_at DESC) = 1",
    "collection_names": """WITH p AS (SELECT ref_id, string_split(unnest(collections), ' > ') AS s FROM refs), a AS (SELECT ref_id, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(list_slice(s, 1, i), ' > '))) AS collection FROM p)
        SELECT collection, count(DISTINCT ref_id) AS entries FROM a GROUP BY 1""",
    "collection_members": "SELECT ref_id, citekey FROM refs WHERE len(list_filter(collections, lambda c: lower(c) = 'twins' OR starts_with(lower(c), 'twins > '))) > 0",
    "key_digests": _digest("item_type", "citekey", "refs"),
    "digest_states": f"""WITH r AS ({_digest('draft', 'citekey', 'overlap_df')}), c AS ({_digest('draft', 'citekey', '(SELECT draft, unnest(citekeys) AS citekey FROM draft_sentences)')})
        SELECT c.draft AS key, CASE WHEN r.digest IS NULL THEN 'unsigned' WHEN r.digest <> c.digest THEN 'changed' ELSE 'signed' END AS state FROM c LEFT JOIN r ON r.draft = c.draft""",
    "citekey_problems": """SELECT CASE WHEN citekey IS NULL OR trim(citekey) = '' THEN 'empty' WHEN citekey IN ('.', '..') THEN 'reserved' WHEN regexp_matches(citekey, '[<>:"/\\\\|?*\\x00-\\x1f]') THEN 'illegal character' WHEN regexp_matches(citekey, '[. ]$') THEN 'trailing dot or space'
        WHEN regexp_matches(upper(split_part(citekey, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN 'device name' END AS problem, count(*) AS n FROM refs GROUP BY 1""",
    "kept_fields": f"""SELECT ref_id, CASE WHEN len(e) > 0 THEN '{{' || array_to_string(list_transform(list_sort(e), lambda x: to_json(x.key) || ':' || to_json(x.value)), ',') || '}}' END AS kept
        FROM (SELECT ref_id, list_filter(map_entries(fields), lambda e: list_contains({list(T.KEPT_FIELDS)}, e.key) AND trim(e.value) <> '') AS e FROM refs)""",
    "author_tokens": "SELECT token, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(lower(concat_ws(' ', a.first, a.last)), '[a-z]{3,}')) AS token FROM (SELECT unnest(authors) AS a FROM refs)) GROUP BY 1",
    "author_lists": """WITH o AS (SELECT ref_id, authors AS a, list_transform(authors, lambda x: CASE WHEN coalesce(x.first, '') = '' THEN '' ELSE substr(x.first, 1, 1) || '. ' END || x.last) AS one FROM refs)
        SELECT ref_id, CASE WHEN len(a) = 0 THEN NULL WHEN len(a) > 6 THEN one[1] || ' et al.' ELSE array_to_string(one, ', ') END AS authors FROM o""",
    "ieee_entries": """SELECT ref_id, concat_ws(', ', '"' || translate(title, '{}', '') || '"', fields['journal'], 'vol. ' || fields['volume'], 'pp. ' || replace(fields['pages'], '--', '-'), nullif(year, 'n.d.')) AS entry FROM refs""",
    "page_counts": "SELECT doc_id, CAST(length(t) - length(replace(t, chr(12), '')) + 1 AS BIGINT) AS pages FROM (SELECT doc_id, regexp_replace(text, '\\s+$', '') AS t FROM documents WHERE text IS NOT NULL)",
    "page_words": """WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f]', ' ', 'g'), chr(12)) AS s FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS page, unnest(s) AS text FROM p),
        w AS (SELECT doc_id, page, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS words FROM q)
        SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM w""",
    "parse_quality": """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, round(len(list_filter(t, lambda x: length(x) > 20)) / nullif(len(t), 0)::DOUBLE, 6) AS ratio FROM t)
        SELECT *, coalesce(tokens >= 200 AND ratio > 0.01, false) AS poor FROM r""",
    "content_chars": f"""SELECT doc_id, CAST(length(array_to_string(list_filter(string_split(regexp_replace(text, '{T.BACK_MATTER}', '\\1'), chr(10)), lambda l: NOT regexp_matches(l, '{T.NOISE_LINE}')), chr(10))) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL""",
    "chunk_counts": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS words, CAST(len(range(0, len({_WORDS}), 160)) AS BIGINT) AS chunks FROM documents WHERE text IS NOT NULL",
    "chunk_texts": f"WITH c AS (SELECT doc_id, {_CHUNKS} AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(unnest(range(0, len(c))) AS BIGINT) AS chunk, md5(unnest(c)) AS digest FROM c",
    "headings": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM l),
        h AS (SELECT doc_id, line, length(regexp_extract(t, '^(#+)', 1)) AS level, trim(regexp_replace(t, '^#+', '')) AS title, n FROM e WHERE regexp_matches(t, '^#{1,6} '))
        SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(level AS BIGINT) AS level, title, CAST(coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, n) AS BIGINT) AS end_line FROM h""",
    "paragraph_counts": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda b: trim(translate(b, chr(10) || chr(12), '  ')) <> '')) AS BIGINT) AS paragraphs FROM documents WHERE text IS NOT NULL",
    "text_digests": "SELECT sha256(text) AS digest, count(*) AS n, min(passage_id) AS first_id FROM passages WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "passage_labels": f"SELECT label, coalesce(page >= 1, false) AS paged, count(*) AS passages, CAST(sum(coalesce(len({_WORDS}), 0)) AS BIGINT) AS words FROM passages GROUP BY ALL",
    "box_overlaps": """WITH p AS (SELECT passage_id, any_value(citekey) AS citekey, any_value(page) AS page, any_value(bbox) AS b FROM passages WHERE bbox IS NOT NULL AND page IS NOT NULL AND citekey IS NOT NULL GROUP BY 1)
        SELECT a.passage_id AS a_id, b.passage_id AS b_id FROM p a JOIN p b ON a.citekey = b.citekey AND a.page = b.page AND a.passage_id < b.passage_id
        WHERE least(a.b[3], b.b[3]) - greatest(a.b[1], b.b[1]) > 1 AND least(a.b[4], b.b[4]) - greatest(a.b[2], b.b[2]) > 1
          AND NOT ((a.b[1] <= b.b[1] AND a.b[2] <= b.b[2] AND b.b[3] <= a.b[3] AND b.b[4] <= a.b[4]) OR (b.b[1] <= a.b[1] AND b.b[2] <= a.b[2] AND a.b[3] <= b.b[3] AND a.b[4] <= b.b[4]))""",
    "fit_by_source": f"SELECT source, round(coalesce(regr_slope(n_chars, len({_WORDS})), 0.0), 3) AS slope, round(coalesce(regr_intercept(n_chars, len({_WORDS})), avg(n_chars)), 2) AS intercept, count(*) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1",
    "length_fence": """WITH r AS (SELECT source, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
        q AS (SELECT source, n, sum(CASE WHEN i = floor((n + 1) * 0.25e0) THEN v * (1 - ((n + 1) * 0.25e0 - floor((n + 1) * 0.25e0))) WHEN i = floor((n + 1) * 0.25e0) + 1 THEN v * ((n + 1) * 0.25e0 - floor((n + 1) * 0.25e0)) ELSE 0 END) AS q1,
                     sum(CASE WHEN i = floor((n + 1) * 0.75e0) THEN v * (1 - ((n + 1) * 0.75e0 - floor((n + 1) * 0.75e0))) WHEN i = floor((n + 1) * 0.75e0) + 1 THEN v * ((n + 1) * 0.75e0 - floor((n + 1) * 0.75e0)) ELSE 0 END) AS q3 FROM r GROUP BY source, n)
        SELECT source, n, CASE WHEN n >= 4 THEN round(q3 + 1.5e0 * (q3 - q1), 4) END AS fence FROM q""",
}
