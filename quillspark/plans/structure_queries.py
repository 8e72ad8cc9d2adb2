"""Queries on scans, places, windows, sets and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udf
from quillspark.operators import drafts, overlap, retrieval, structure, topics
from quillspark.plans.overlap_queries import finding_profiles, findings_latest
from quillspark.plans.retrieval_queries import bm25_sql, grams_sql
from quillspark.session import load


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "refs")


def ledger_scan(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's columns of resolved entries; the filter reaches the scan."""
    return _refs(spark, d).where("pdf_resolution = 'resolved' and pdf_path is not null").select("citekey", "item_type", "year", "pdf_path")


def corpus_projection(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).select("citekey", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"), "pdf_path")


def full_text(spark: SparkSession, d: str) -> DataFrame:
    """Title and text of each document with an entry, by digest; a missing text leaves the title."""
    docs = load(spark, d, "documents").where("citekey is not null").select("doc_id", "citekey", "text")
    return docs.join(_refs(spark, d).select("citekey", "title"), "citekey", "left").select("doc_id", F.md5(F.concat_ws("\n", "title", "text")).alias("digest"))


def text_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first rung that has a text for each key: layout text, then passages, then source sentences."""
    rungs = [load(spark, d, "documents").where("source = 'layout_markdown'"), load(spark, d, "passages"), load(spark, d, "source_sentences")]
    every = None
    for n, r in enumerate(rungs):
        part = r.where("citekey is not null and length(text) > 0").select("citekey", F.lit(n).cast("long").alias("rung"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("citekey").agg(F.min("rung").alias("rung"))


def page_word_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of each page that isn't blank: passages without quotable text."""
    p = load(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.pages(F.col("text"))).alias("pos", "text"))
    return p.where(F.trim("text") != "").select("doc_id", (F.col("pos") + 1).cast("long").alias("page"), F.size(T.distinctive(F.col("text"))).cast("long").alias("words"))


def title_index(spark: SparkSession, d: str) -> DataFrame:
    """Entries by title without braces, white space as one space, lower case, punctuation kept."""
    t = F.lower(F.trim(F.regexp_replace(F.translate("title", "{}", ""), "[ \\t\\n\\r]+", " ")))
    return _refs(spark, d).groupBy(t.alias("title")).agg(F.count("*").alias("entries"), F.min("ref_id").alias("first_id"))


def doi_index(spark: SparkSession, d: str) -> DataFrame:
    """Entries by every identifier that stands in their doi field, closing marks off."""
    found = F.explode(F.regexp_extract_all(F.lower(F.coalesce("doi", F.lit(""))), F.lit(r"10\.[0-9]{4,9}/[^\s]+"), 0)).alias("doi")
    return _refs(spark, d).select("ref_id", found).select("ref_id", F.regexp_replace("doi", r"[).,\]>]+$", "").alias("doi")).groupBy("doi").agg(F.count_distinct("ref_id").alias("entries"))


def collection_index(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).where(F.size("collections") > 0).select("ref_id", F.array_join(F.sort_array(F.array_distinct("collections")), ",").alias("collections"))


def cascading_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each entry the smallest other entry with the same doi, else url, else title; and by which."""
    r = _refs(spark, d).select("ref_id", F.nullif(T.normal_doi(F.col("doi")), F.lit("")).alias("doi"), F.nullif(F.trim(F.lower("url")), F.lit("")).alias("url"), F.nullif(T.normal_title(F.col("title")), F.lit("")).alias("title"))
    out = r
    for k in ("doi", "url", "title"):
        firsts = r.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("ref_id").alias(f"by_{k}"))
        out = out.join(firsts, k, "left")
    hit = lambda k: (F.col(f"by_{k}") < F.col("ref_id"))
    by = F.when(hit("doi"), "doi").when(hit("url"), "url").when(hit("title"), "title")
    first = F.when(hit("doi"), F.col("by_doi")).when(hit("url"), F.col("by_url")).when(hit("title"), F.col("by_title"))
    return out.select("ref_id", first.alias("first_id"), by.alias("field")).where("field is not null")


def reference_headings(spark: SparkSession, d: str) -> DataFrame:
    """Level and number of headings of each document that has some."""
    level = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6}) "), 1)
    return load(spark, d, "documents").where("text rlike '(?m)^#{1,6} '").select("doc_id", F.size(level).cast("long").alias("headings"), F.array_max(F.transform(level, F.length)).cast("long").alias("deepest"))


def claim_bearing_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document that may carry a claim: no blank ones, headings, comments, captions or table rules."""
    keep = lambda line: (F.trim(line) != "") & ~line.rlike(r"^\s*(#{1,6} |%|<!--|(Figure|Table|Fig\.) [0-9]+|[|:\-\s]+$)")
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(F.split("text", "\n"), keep)).cast("long").alias("lines"))


def quoted_spans(spark: SparkSession, d: str) -> DataFrame:
    """Quotations of each document: number and characters, marks included."""
    q = F.regexp_extract_all("text", F.lit("“[^”\n]{2,}”"), 0)
    rows = load(spark, d, "documents").where("text is not null").select("doc_id", q.alias("q")).where(F.size("q") > 0)
    return rows.select("doc_id", F.size("q").cast("long").alias("quotes"), F.length(F.array_join("q", "")).cast("long").alias("chars"))


def body_acronyms(spark: SparkSession, d: str) -> DataFrame:
    """Acronyms in brackets in the names of authors, and their uses."""
    names = _refs(spark, d).select(F.explode("authors").alias("a")).select(F.concat_ws(" ", "a.first", "a.last").alias("n"))
    return names.select(F.explode(F.regexp_extract_all("n", F.lit(r"\(([A-Z]{2,})\)"), 1)).alias("acronym")).groupBy("acronym").agg(F.count("*").alias("uses"))


def posting_pages(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pages of each gram in each source, and the first of them."""
    p = load(spark, d, "gram_postings").where("gram is not null and citekey is not null")
    return p.groupBy("gram", "citekey").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("first_page"))


def gram_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Postings of every gram of each finding: a semi-join on the gram."""
    grams = load(spark, d, "overlap_df").select(F.explode(T.ngrams(T.words(F.col("fragment")), 8)).alias("gram")).distinct()
    p = load(spark, d, "gram_postings").select(T.claim_key(F.col("gram")).alias("gram"), "citekey", "page", "position").where("citekey is not null")
    return p.join(grams, "gram", "left_semi").distinct()


def pairwise_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Different grams that a draft shares with a source, pair by pair, and whether the draft cites it."""
    ds = load(spark, d, "draft_sentences")
    own = overlap.positions(ds, "sent_id", "text").join(ds.select(F.col("sent_id").alias("key"), "draft"), "key").select("draft", "gram").distinct()
    src = load(spark, d, "source_sentences")
    grams = overlap.positions(src, "src_id", "text").join(src.select(F.col("src_id").alias("key"), "citekey"), "key").select("citekey", "gram").distinct()
    cited = ds.select("draft", F.explode("citekeys").alias("citekey")).distinct().withColumn("cites", F.lit(True))
    shared = own.join(grams, "gram").groupBy("draft", "citekey").agg(F.count("*").alias("grams"))
    return shared.join(cited, ["draft", "citekey"], "left").fillna(False, ["cites"])


def marker_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Claims by the known keys they mention in markers."""
    m = load(spark, d, "claim_sentences").select("claim_id", F.explode(T.cited_keys(F.col("text"))).alias("citekey")).distinct()
    return m.join(_refs(spark, d).select("citekey"), "citekey", "left_semi").groupBy("citekey").agg(F.count("*").alias("claims"))


def page_asof(spark: SparkSession, d: str) -> DataFrame:
    """Page of each posting by the first positions of its source's pages, where it differs from the page it was delivered with."""
    p = load(spark, d, "gram_postings").where("citekey is not null and page is not null and position is not null").select("citekey", "page", "position").distinct()
    marks = p.groupBy("citekey", "page").agg(F.min("position").alias("position")).withColumnRenamed("page", "asof_page")
    return structure.asof(p, marks, "citekey", "position", "asof_page").where("asof_page <> page").select("citekey", "position", "page", "asof_page")


def first_marker_line(spark: SparkSession, d: str) -> DataFrame:
    """Line of the first citation marker of each document."""
    docs = load(spark, d, "documents").where("text like '%[@%'")
    return docs.select("doc_id", structure.line_of(F.col("text"), F.instr("text", "[@") - 1).cast("long").alias("line"))


def scope_to_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Documents per key that drafts cite, and cited keys without a document (0)."""
    cited = load(spark, d, "draft_sentences").select(F.explode("citekeys").alias("citekey")).distinct()
    docs = load(spark, d, "documents").where("citekey is not null").groupBy("citekey").agg(F.count("*").alias("documents"))
    return cited.join(docs, "citekey", "left").fillna(0, ["documents"])


def run_compare(spark: SparkSession, d: str) -> DataFrame:
    """Each key in two runs (passages and source sentences) by its number of pages: only left, only right, equal or different, and by how much."""
    side = lambda t: load(spark, d, t).where("citekey is not null").groupBy("citekey").agg(F.count_distinct("page").alias("n"))
    a, b = side("passages").withColumnRenamed("n", "a"), side("source_sentences").withColumnRenamed("n", "b")
    state = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(F.col("a") == F.col("b"), "equal").otherwise("different")
    return a.join(b, "citekey", "full_outer").select("citekey", state.alias("state"), (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("change"))


def finding_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Findings collapsed by tier and fragment: count and first line."""
    return load(spark, d, "overlap_df").groupBy("tier", F.md5("fragment").alias("fragment")).agg(F.count("*").alias("n"), F.min("line").alias("line"))


def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Keys by the tiers that found something in them."""
    per = load(spark, d, "overlap_df").groupBy("citekey").agg(F.array_join(F.sort_array(F.collect_set("tier")), "+").alias("tiers"))
    return per.groupBy("tiers").agg(F.count("*").alias("keys"))


def df_by_severity(spark: SparkSession, d: str) -> DataFrame:
    rows = finding_profiles(spark, d).join(findings_latest(spark, d).select("id", T.severity(F.col("quoted"), F.col("cites_source"), F.col("matched_words")).alias("severity")), "id")
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.min("median_df").alias("least"), F.max("median_df").alias("most"))


def request_usage(spark: SparkSession, d: str) -> DataFrame:
    """Two levels: the highest value of each user and kind of event, summed by user."""
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.round(F.sum("v"), 2).alias("usage"), F.count("*").alias("kinds"))


def selection_ratios(spark: SparkSession, d: str) -> DataFrame:
    """One row: keys surfaced by findings, cited by drafts, both, and their ratios."""
    s = load(spark, d, "overlap_df").select(F.col("citekey").alias("k")).distinct().withColumn("s", F.lit(1))
    c = load(spark, d, "draft_sentences").select(F.explode("citekeys").alias("k")).distinct().withColumn("c", F.lit(1))
    j = s.join(c, "k", "full_outer")
    both, surfaced, cited = F.count_if(F.col("s").isNotNull() & F.col("c").isNotNull()), F.count("s"), F.count("c")
    return j.agg(surfaced.alias("surfaced"), cited.alias("cited"), both.alias("both"), F.round(both / F.nullif(surfaced, F.lit(0)), 4).alias("cited_share"))


def topic_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of the labels and the nearest centroids."""
    e = load(spark, d, "embeddings")
    cents = topics.centroids(e, "label", "embedding", centred=False).select(F.col("label").alias("near"), "centroid")
    dist = F.round(T.squared_distance(F.col("embedding"), F.col("centroid")), 6)
    near = e.crossJoin(F.broadcast(cents)).groupBy("vec_id", "label").agg(F.min_by("near", F.struct(dist, F.col("near"))).alias("near"))
    return structure.adjusted_rand(near, "label", "near")


def cluster_depth(spark: SparkSession, d: str) -> DataFrame:
    """One row: topics, vectors, share without topic, and upper median size of a topic."""
    sizes = load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    real = F.col("label") >= 0
    sorted_sizes = F.sort_array(F.collect_list(F.when(real, F.col("n"))))  # one value a topic
    return sizes.agg(F.count_if(real).alias("topics"), F.sum("n").alias("vectors"), F.round(F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) / F.sum("n"), 4).alias("outliers"), F.element_at(sorted_sizes, (F.floor(F.size(sorted_sizes) / 2) + 1).cast("int")).alias("median_size"))


def repeat_timing(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("best"), F.round(F.median("value"), 3).alias("median"), F.max("value").alias("worst"))


def page_runs(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each source with passages, runs of three or more contracted."""
    return structure.number_runs(load(spark, d, "passages").where("citekey is not null"), "citekey", "page")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "passages").where("bbox is not null and page is not null and citekey is not null").groupBy("passage_id").agg(F.first("citekey").alias("citekey"), F.first("page").alias("page"), F.first("bbox").alias("b"))
    return p.select("citekey", "page", *(F.element_at("b", i + 1).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def page_gaps(spark: SparkSession, d: str) -> DataFrame:
    return structure.vertical_gaps(_boxes(spark, d).withColumnsRenamed({"y1": "low", "y2": "high"}), ["citekey", "page"])


def page_emptiness(spark: SparkSession, d: str) -> DataFrame:
    return structure.emptiness(_boxes(spark, d), ["citekey", "page"])


def even_rank_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twelve documents at even ranks of length (a sampling operator)."""
    return structure.even_ranks(load(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 12)


def page_locate(spark: SparkSession, d: str) -> DataFrame:
    phrases = load(spark, d, "overlap_df").groupBy("id", "citekey").agg(F.min("fragment").alias("text"))
    return structure.locate(phrases, load(spark, d, "passages").where("page is not null and text is not null").select("citekey", "page", "text"), "citekey")


def number_passages(spark: SparkSession, d: str) -> DataFrame:
    """For each claim and source it cites the five passages that share most numbers with it, ties by id."""
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), 0))
    c = load(spark, d, "draft_sentences").select("sent_id", F.explode(F.array_distinct("citekeys")).alias("citekey"), F.explode(numbers(F.col("text"))).alias("number"))
    p = load(spark, d, "passages").where("text is not null").select("passage_id", "citekey", F.explode(numbers(F.col("text"))).alias("number")).distinct()
    hits = c.join(p, ["citekey", "number"]).groupBy("sent_id", "citekey", "passage_id").agg(F.count_distinct("number").alias("shared"))
    w = Window.partitionBy("sent_id", "citekey").orderBy(F.desc("shared"), "passage_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


def keys_in_use(spark: SparkSession, d: str) -> DataFrame:
    """Union of the keys of drafts, documents and findings."""
    a = load(spark, d, "draft_sentences").select(F.explode("citekeys").alias("citekey"))
    b = load(spark, d, "documents").where("text is not null").select(F.explode(T.cited_keys(F.col("text"))).alias("citekey"))
    return a.union(b).union(load(spark, d, "overlap_df").select("citekey")).where("citekey is not null").distinct()


def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 words every 10 over claims, by digest."""
    tokens = load(spark, d, "claim_sentences").where("text is not null").select("claim_id", T.words(F.col("text")).alias("w"))
    rows = tokens.select("claim_id", F.posexplode(structure.word_windows(F.col("w"))).alias("pos", "w"))
    return rows.select("claim_id", F.col("pos").cast("long").alias("window"), F.md5("w").alias("digest"))


def swapped_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims with every fourth word swapped, and the 8-grams that survive: none."""
    tokens = load(spark, d, "claim_sentences").where("text is not null").select("claim_id", T.words(F.col("text")).alias("w"))
    rows = tokens.select("claim_id", "w", structure.swap_every(F.col("w"), 4, "x").alias("s"))
    return rows.select("claim_id", F.md5(F.array_join("s", " ")).alias("digest"), F.size(F.array_intersect(T.ngrams(F.col("w"), 8), T.ngrams(F.col("s"), 8))).cast("long").alias("shared"))


def version_series(spark: SparkSession, d: str) -> DataFrame:
    """Major and minor of the versions named in claims, and their uses."""
    v = F.explode(F.regexp_extract_all("text", F.lit(r"v([0-9]+\.[0-9]+)"), 1)).alias("series")
    return load(spark, d, "claim_sentences").where("text is not null").select(v).groupBy("series").agg(F.count("*").alias("uses"))


def drift_by_draft(spark: SparkSession, d: str) -> DataFrame:
    """Documents among the first five for a sentence whose key its draft doesn't cite: one corpus scan for all sentences asked.

    The queries are the stated set of a search: every draft sentence whose id is divisible by 50.
    """
    ds = load(spark, d, "draft_sentences")
    q = ds.where("sent_id % 50 = 0").select(F.col("sent_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieval.topk(retrieval.corpus_of(load(spark, d, "documents")), q, 5)
    keys = load(spark, d, "documents").where("citekey is not null").select(F.col("doc_id").alias("key"), "citekey")
    named = hits.join(keys, "key").join(ds.select(F.col("sent_id").alias("query_id"), "draft"), "query_id")
    cited = ds.select("draft", F.explode("citekeys").alias("citekey")).distinct()
    return named.join(cited, ["draft", "citekey"], "left_anti").select("query_id", "draft", "citekey", "rank")


def embedding_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Source sentences by whether a passage of the same source already holds the same text (unchanged) or not (to embed)."""
    s = load(spark, d, "source_sentences").where("text is not null").select("src_id", "citekey", F.sha2("text", 256).alias("h"))
    p = load(spark, d, "passages").where("text is not null").select("citekey", F.sha2("text", 256).alias("h")).distinct().withColumn("known", F.lit(True))
    return s.join(p, ["citekey", "h"], "left").groupBy(F.when(F.col("known"), "unchanged").otherwise("to embed").alias("state")).agg(F.count("*").alias("n"))


def bigram_scores(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed bigram containment of each finding's fragment in the draft sentences of its draft (stems: rows only)."""
    findings = load(spark, d, "overlap_df").groupBy("id").agg(F.max(F.struct("draft", "fragment")).alias("f")).select("id", F.col("f.draft").alias("group"), F.col("f.fragment").alias("quote"))
    return drafts.containment(findings, load(spark, d, "draft_sentences").select(F.col("draft").alias("group"), "text"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The best window of each document for two terms (rows only)."""
    run = udf.snippet_udf(["sensor", "calibration"])
    rows = load(spark, d, "documents").where("lower(text) like '%sensor%' or lower(text) like '%calibration%'")
    return rows.select("doc_id", F.element_at(run("text"), 1).alias("snippet"))


_F = (ledger_scan, corpus_projection, full_text, text_ladder, page_word_sets, title_index, doi_index, collection_index, cascading_lookup, reference_headings, claim_bearing_lines, quoted_spans, body_acronyms, posting_pages, gram_lookup, pairwise_overlap, marker_mentions, page_asof, first_marker_line, scope_to_drafts, run_compare, finding_collapse, tier_histogram, df_by_severity, request_usage, selection_ratios, topic_agreement, cluster_depth, repeat_timing, page_runs, page_gaps, page_emptiness, even_rank_sample, page_locate, number_passages, keys_in_use, sentence_windows, swapped_claims, version_series, drift_by_draft, embedding_refresh, bigram_scores, snippets)
QUERIES = {f.__name__: f for f in _F}

_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.PASSAGE_STOP) + "]"
_KEYS = "regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9_-]*)', 1)"
_TITLE = "trim(regexp_replace(lower(translate(title, '{}', '')), '[^a-z0-9]+', ' ', 'g'))"
_DOI = "trim(regexp_replace(regexp_replace(lower(trim(doi)), '^https?://(dx\\.)?doi\\.(org|example)/', ''), '^doi:', ''))"
_BOXES = "bx AS (SELECT passage_id, any_value(citekey) AS citekey, any_value(page) AS page, any_value(bbox) AS b FROM passages WHERE bbox IS NOT NULL AND page IS NOT NULL AND citekey IS NOT NULL GROUP BY 1)"
_WIN = f"CASE WHEN len({_W}) = 0 THEN [] WHEN len({_W}) <= 20 THEN [array_to_string({_W}, ' ')] ELSE list_transform(list_concat(range(0, len({_W}) - 19, 10), CASE WHEN (len({_W}) - 20) % 10 <> 0 THEN [len({_W}) - 20] ELSE [] END), lambda i: array_to_string(list_slice({_W}, i + 1, i + 20), ' ')) END"
_SWAP = f"list_transform({_W}, lambda w, i: CASE WHEN i % 4 = 0 THEN 'x' ELSE w END)"
_D2 = "list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))"
_PROFILE = f"""p AS (SELECT trim(regexp_replace(lower(gram), '[^a-z0-9]+', ' ', 'g')) AS gram, citekey FROM gram_postings WHERE gram IS NOT NULL AND citekey IS NOT NULL), df AS (SELECT gram, count(DISTINCT citekey) AS df FROM p GROUP BY gram),
    g AS (SELECT id, unnest({grams_sql('fragment')}) AS gram FROM (SELECT id, min(fragment) AS fragment FROM overlap_df GROUP BY id)), prof AS (SELECT id, CAST(floor(median(coalesce(df, 0))) AS BIGINT) AS median_df FROM g LEFT JOIN df USING (gram) GROUP BY id)"""
_LONG = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 3))"
_NUM = "list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'))"

SQL = {
    "ledger_scan": "SELECT citekey, item_type, year, pdf_path FROM refs WHERE pdf_resolution = 'resolved' AND pdf_path IS NOT NULL",
    "corpus_projection": "SELECT citekey, coalesce(nullif(trim(title), ''), 'Untitled') AS title, pdf_path FROM refs",
    "full_text": "SELECT doc_id, md5(concat_ws(chr(10), title, text)) AS digest FROM documents LEFT JOIN refs USING (citekey) WHERE citekey IS NOT NULL",
    "text_ladder": "SELECT citekey, CAST(min(rung) AS BIGINT) AS rung FROM (SELECT citekey, text, 0 AS rung FROM documents WHERE source = 'layout_markdown' UNION ALL SELECT citekey, text, 1 FROM passages UNION ALL SELECT citekey, text, 2 FROM source_sentences) WHERE citekey IS NOT NULL AND length(text) > 0 GROUP BY 1",
    "page_word_sets": f"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f]', ' ', 'g'), chr(12)) AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) AS BIGINT) AS page, unnest(s) AS text FROM s)
        SELECT doc_id, page, CAST(len(list_distinct(list_filter({_W}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)))) AS BIGINT) AS words FROM e WHERE trim(text, ' ') <> ''""",
    "title_index": "SELECT lower(trim(regexp_replace(translate(title, '{}', ''), '[ \\t\\n\\r]+', ' ', 'g'))) AS title, count(*) AS entries, min(ref_id) AS first_id FROM refs GROUP BY 1",
    "doi_index": "SELECT regexp_replace(doi, '[).,\\]>]+$', '') AS doi, count(DISTINCT ref_id) AS entries FROM (SELECT ref_id, unnest(regexp_extract_all(lower(coalesce(doi, '')), '10\\.[0-9]{4,9}/[^\\s]+')) AS doi FROM refs) GROUP BY 1",
    "collection_index": "SELECT ref_id, array_to_string(list_sort(list_distinct(collections)), ',') AS collections FROM refs WHERE len(collections) > 0",
    "cascading_lookup": f"""WITH r AS (SELECT ref_id, nullif({_DOI}, '') AS doi, nullif(trim(lower(url)), '') AS url, nullif({_TITLE}, '') AS title FROM refs),
        m AS (SELECT ref_id, CASE WHEN doi IS NOT NULL THEN min(ref_id) OVER (PARTITION BY doi) END AS bd, CASE WHEN url IS NOT NULL THEN min(ref_id) OVER (PARTITION BY url) END AS bu, CASE WHEN title IS NOT NULL THEN min(ref_id) OVER (PARTITION BY title) END AS bt FROM r),
        o AS (SELECT ref_id, CASE WHEN bd < ref_id THEN bd WHEN bu < ref_id THEN bu WHEN bt < ref_id THEN bt END AS first_id, CASE WHEN bd < ref_id THEN 'doi' WHEN bu < ref_id THEN 'url' WHEN bt < ref_id THEN 'title' END AS field FROM m) SELECT * FROM o WHERE field IS NOT NULL""",
    "reference_headings": "WITH h AS (SELECT doc_id, regexp_extract_all(text, '(?m)^(#{1,6}) ', 1) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(h) AS BIGINT) AS headings, CAST(list_max(list_transform(h, lambda x: length(x))) AS BIGINT) AS deepest FROM h WHERE len(h) > 0",
    "claim_bearing_lines": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '' AND NOT regexp_matches(l, '^\\s*(#{1,6} |%|<!--|(Figure|Table|Fig\\.) [0-9]+|[|:\\-\\s]+$)'))) AS BIGINT) AS lines FROM documents WHERE text IS NOT NULL",
    "quoted_spans": "WITH q AS (SELECT doc_id, regexp_extract_all(text, '“[^”\\n]{2,}”') AS q FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(q) AS BIGINT) AS quotes, CAST(length(array_to_string(q, '')) AS BIGINT) AS chars FROM q WHERE len(q) > 0",
    "body_acronyms": "SELECT acronym, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(concat_ws(' ', a.first, a.last), '\\(([A-Z]{2,})\\)', 1)) AS acronym FROM (SELECT unnest(authors) AS a FROM refs)) GROUP BY 1",
    "posting_pages": "SELECT gram, citekey, count(DISTINCT page) AS pages, min(page) AS first_page FROM gram_postings WHERE gram IS NOT NULL AND citekey IS NOT NULL GROUP BY 1, 2",
    "gram_lookup": f"""WITH f AS (SELECT DISTINCT unnest({grams_sql('fragment')}) AS gram FROM overlap_df) SELECT DISTINCT trim(regexp_replace(lower(gram), '[^a-z0-9]+', ' ', 'g')) AS gram, citekey, page, position FROM gram_postings
        WHERE citekey IS NOT NULL AND trim(regexp_replace(lower(gram), '[^a-z0-9]+', ' ', 'g')) IN (SELECT gram FROM f)""",
    "pairwise_overlap": f"""WITH d AS (SELECT DISTINCT draft, unnest({grams_sql('text')}) AS gram FROM draft_sentences WHERE text IS NOT NULL), s AS (SELECT DISTINCT citekey, unnest({grams_sql('text')}) AS gram FROM source_sentences WHERE text IS NOT NULL),
        c AS (SELECT DISTINCT draft, unnest(citekeys) AS citekey FROM draft_sentences) SELECT draft, citekey, count(*) AS grams, EXISTS (SELECT 1 FROM c WHERE c.draft = d.draft AND c.citekey = s.citekey) AS cites FROM d JOIN s USING (gram) GROUP BY draft, citekey""",
    "marker_mentions": f"SELECT citekey, count(*) AS claims FROM (SELECT DISTINCT claim_id, unnest({_KEYS}) AS citekey FROM claim_sentences) WHERE citekey IN (SELECT citekey FROM refs) GROUP BY 1",
    "page_asof": """WITH p AS (SELECT DISTINCT citekey, page, position FROM gram_postings WHERE citekey IS NOT NULL AND page IS NOT NULL AND position IS NOT NULL), m0 AS (SELECT citekey, page, min(position) AS position FROM p GROUP BY 1, 2), m AS (SELECT citekey, position, max(page) AS asof_page FROM m0 GROUP BY 1, 2)
        SELECT p.citekey, p.position, p.page, m.asof_page FROM p ASOF JOIN m ON p.citekey = m.citekey AND p.position >= m.position WHERE m.asof_page <> p.page""",
    "first_marker_line": "SELECT doc_id, CAST(len(string_split(substr(text, 1, instr(text, '[@') - 1), chr(10))) AS BIGINT) AS line FROM documents WHERE text LIKE '%[@%'",
    "scope_to_drafts": "SELECT citekey, count(doc_id) AS documents FROM (SELECT DISTINCT unnest(citekeys) AS citekey FROM draft_sentences) LEFT JOIN documents USING (citekey) GROUP BY 1",
    "run_compare": """WITH a AS (SELECT citekey, count(DISTINCT page) AS a FROM passages WHERE citekey IS NOT NULL GROUP BY 1), b AS (SELECT citekey, count(DISTINCT page) AS b FROM source_sentences WHERE citekey IS NOT NULL GROUP BY 1)
        SELECT coalesce(a.citekey, b.citekey) AS citekey, CASE WHEN b IS NULL THEN 'left' WHEN a IS NULL THEN 'right' WHEN a = b THEN 'equal' ELSE 'different' END AS state, coalesce(b, 0) - coalesce(a, 0) AS change FROM a FULL JOIN b ON a.citekey = b.citekey""",
    "finding_collapse": "SELECT tier, md5(fragment) AS fragment, count(*) AS n, min(line) AS line FROM overlap_df GROUP BY 1, 2",
    "tier_histogram": "SELECT tiers, count(*) AS keys FROM (SELECT citekey, array_to_string(list_sort(list_distinct(list(tier))), '+') AS tiers FROM overlap_df GROUP BY 1) GROUP BY 1",
    "df_by_severity": f"""WITH {_PROFILE}, f AS (SELECT id, CASE WHEN quoted AND cites_source THEN 'quoted' WHEN matched_words >= 15 THEN 'long' ELSE 'short' END AS severity FROM overlap_df QUALIFY row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC) = 1)
        SELECT severity, count(*) AS n, min(median_df) AS least, max(median_df) AS most FROM prof JOIN f USING (id) GROUP BY 1""",
    "request_usage": "SELECT user_id, round(sum(v), 2) AS usage, count(*) AS kinds FROM (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1",
    "selection_ratios": """WITH s AS (SELECT DISTINCT citekey AS k FROM overlap_df), c AS (SELECT DISTINCT unnest(citekeys) AS k FROM draft_sentences), j AS (SELECT s.k AS sk, c.k AS ck FROM s FULL JOIN c ON s.k = c.k)
        SELECT count(sk) AS surfaced, count(ck) AS cited, count_if(sk IS NOT NULL AND ck IS NOT NULL)::BIGINT AS both, round(count_if(sk IS NOT NULL AND ck IS NOT NULL) / nullif(count(sk), 0)::DOUBLE, 4) AS cited_share FROM j""",
    "topic_agreement": f"""WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT near, list(m ORDER BY dim) AS c FROM (SELECT label AS near, dim, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1),
        n AS (SELECT vec_id, label, near FROM embeddings CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round({_D2}, 6), near) = 1), k AS (SELECT label, near, count(*)::DOUBLE AS n FROM n GROUP BY 1, 2),
        i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM k), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM k GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM k GROUP BY near))
        SELECT round((i - a * b / (t * (t - 1) / 2)) / nullif((a + b) / 2 - a * b / (t * (t - 1) / 2), 0), 4) AS ari FROM i CROSS JOIN a CROSS JOIN b""",
    "cluster_depth": """WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT list_sort(list(n)) AS l FROM s WHERE label >= 0)
        SELECT count_if(label >= 0)::BIGINT AS topics, CAST(sum(n) AS BIGINT) AS vectors, round(coalesce(sum(CASE WHEN label < 0 THEN n END), 0) / sum(n)::DOUBLE, 4) AS outliers, any_value(l[CAST(floor(len(l) / 2) AS BIGINT) + 1]) AS median_size FROM s CROSS JOIN r""",
    "repeat_timing": "SELECT event_type, min(value) AS best, round(median(value), 3) AS median, max(value) AS worst FROM events GROUP BY 1",
    "page_runs": """WITH d AS (SELECT DISTINCT citekey, page FROM passages WHERE citekey IS NOT NULL AND page IS NOT NULL), g AS (SELECT citekey, page, page - row_number() OVER (PARTITION BY citekey ORDER BY page) AS g FROM d),
        r AS (SELECT citekey, min(page) AS a, max(page) AS z, count(*) AS n FROM g GROUP BY citekey, g) SELECT citekey, string_agg(CASE WHEN n >= 3 THEN a || '–' || z WHEN n = 2 THEN a || ', ' || z ELSE CAST(a AS VARCHAR) END, ', ' ORDER BY a) AS runs FROM r GROUP BY 1""",
    "page_gaps": f"""WITH {_BOXES}, y AS (SELECT citekey, page, b[2] AS low, b[4] AS high FROM bx), r AS (SELECT *, max(high) OVER (PARTITION BY citekey, page ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM y),
        g AS (SELECT citekey, page, round(max(greatest(0.0, low - reach)), 4) AS gap, round(max(high) - min(low), 4) AS height FROM r GROUP BY 1, 2) SELECT * FROM g WHERE gap > height / 3""",
    "page_emptiness": f"WITH {_BOXES} SELECT citekey, page, round(greatest(0.0, 1 - sum((b[3] - b[1]) * (b[4] - b[2])) / nullif((max(b[3]) - min(b[1])) * (max(b[4]) - min(b[2])), 0)), 4) AS empty FROM bx GROUP BY 1, 2",
    "even_rank_sample": "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL), w AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 11.0, 0) AS BIGINT) AS rank FROM (SELECT DISTINCT n FROM r) CROSS JOIN range(0, 12) t(i)) SELECT doc_id, n_chars, CAST(rank AS BIGINT) AS rank FROM r WHERE rank IN (SELECT rank FROM w)",
    "page_locate": f"""WITH f AS (SELECT id, citekey, min(fragment) AS text FROM overlap_df GROUP BY 1, 2), p AS (SELECT id, citekey, {_LONG} AS w FROM f), e AS (SELECT DISTINCT citekey, page, unnest({_LONG}) AS word FROM passages WHERE page IS NOT NULL AND text IS NOT NULL), q AS (SELECT citekey, page, list(word) AS pw FROM e WHERE citekey IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT id, page, round(len(list_intersect(w, pw)) / nullif(len(w), 0)::DOUBLE, 4) AS score FROM p JOIN q USING (citekey)) SELECT id, page, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, page DESC) AS BIGINT) AS rank FROM s WHERE score > 0 QUALIFY rank <= 4""",
    "number_passages": f"""WITH c AS (SELECT sent_id, citekey, unnest({_NUM}) AS number FROM (SELECT sent_id, text, unnest(list_distinct(citekeys)) AS citekey FROM draft_sentences)), p AS (SELECT DISTINCT passage_id, citekey, unnest({_NUM}) AS number FROM passages WHERE text IS NOT NULL),
        h AS (SELECT sent_id, citekey, passage_id, count(DISTINCT number) AS shared FROM c JOIN p USING (citekey, number) GROUP BY 1, 2, 3) SELECT *, CAST(row_number() OVER (PARTITION BY sent_id, citekey ORDER BY shared DESC, passage_id) AS BIGINT) AS rank FROM h QUALIFY rank <= 5""",
    "keys_in_use": f"SELECT DISTINCT citekey FROM (SELECT unnest(citekeys) AS citekey FROM draft_sentences UNION ALL SELECT unnest({_KEYS}) FROM documents WHERE text IS NOT NULL UNION ALL SELECT citekey FROM overlap_df) WHERE citekey IS NOT NULL",
    "sentence_windows": f"WITH w AS (SELECT claim_id, {_WIN} AS w FROM claim_sentences WHERE text IS NOT NULL) SELECT claim_id, CAST(unnest(range(0, len(w))) AS BIGINT) AS \"window\", md5(unnest(w)) AS digest FROM w",
    "swapped_claims": f"""WITH s AS (SELECT claim_id, {_SWAP} AS s, {grams_sql('text')} AS g FROM claim_sentences WHERE text IS NOT NULL)
        SELECT claim_id, md5(array_to_string(s, ' ')) AS digest, CAST(len(list_intersect(g, list_transform(range(1, len(s) - 6), lambda i: array_to_string(list_slice(s, i, i + 7), ' ')))) AS BIGINT) AS shared FROM s""",
    "version_series": "SELECT series, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(text, 'v([0-9]+\\.[0-9]+)', 1)) AS series FROM claim_sentences WHERE text IS NOT NULL) GROUP BY 1",
    "drift_by_draft": f"""WITH {bm25_sql('(SELECT sent_id AS query_id, text AS query FROM draft_sentences WHERE sent_id % 50 = 0)', 5)}, ct AS (SELECT DISTINCT draft, unnest(citekeys) AS citekey FROM draft_sentences)
        SELECT query_id, draft, documents.citekey, rank FROM hits JOIN documents ON doc_id = hits.key JOIN draft_sentences ds ON ds.sent_id = query_id WHERE documents.citekey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.draft = ds.draft AND ct.citekey = documents.citekey)""",
    "embedding_refresh": """WITH p AS (SELECT DISTINCT citekey, sha256(text) AS h FROM passages WHERE text IS NOT NULL) SELECT CASE WHEN p.h IS NOT NULL THEN 'unchanged' ELSE 'to embed' END AS state, count(*) AS n FROM source_sentences s LEFT JOIN p ON s.citekey = p.citekey AND sha256(s.text) = p.h WHERE s.text IS NOT NULL GROUP BY 1""",
}
