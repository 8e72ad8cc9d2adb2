"""Queries on drafts, citations, logs, vectors and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import review, topics
from quillspark.plans.corpus_queries import _DELIVERY, _ledger
from quillspark.session import load


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return review.citations(load(spark, d, "documents").where("text is not null"), "doc_id", "text")


def used_keys(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each document in order."""
    return _citations(spark, d).select("key", F.col("pos").cast("long").alias("pos"), "citekey")


def citation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Citations of keys that the ledger as it was before doesn't hold."""
    return review.gate(_citations(spark, d), _ledger(spark, d))


def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each draft numbered by first use."""
    rows = load(spark, d, "draft_sentences").select(F.col("draft").alias("group"), "sent_id", F.posexplode("citekeys").alias("pos", "citekey"))
    return review.first_appearance(rows.select("group", F.struct("sent_id", "pos").alias("at"), "citekey"))


def section_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys by draft and section."""
    rows = load(spark, d, "draft_sentences").select("draft", F.coalesce("section", F.lit("Unassigned")).alias("section"), F.explode("citekeys").alias("k"))
    return rows.groupBy("draft", "section").agg(F.array_join(F.sort_array(F.collect_set("k")), ",").alias("keys"))


def synthesis_report(spark: SparkSession, d: str) -> DataFrame:
    return review.synthesis(load(spark, d, "draft_sentences"))


def longest_single_run(spark: SparkSession, d: str) -> DataFrame:
    return review.longest_single_run(load(spark, d, "draft_sentences").select("draft", F.col("sent_id").alias("at"), "citekeys"))


def uncited_claims(spark: SparkSession, d: str) -> DataFrame:
    return review.uncited(load(spark, d, "claim_sentences"))


def uncited_order(spark: SparkSession, d: str) -> DataFrame:
    """Uncited claims with their ids, those in citing blocks last."""
    c = load(spark, d, "claim_sentences").where("not cites")
    rank = F.row_number().over(Window.partitionBy("draft").orderBy("block_cites", "line", "claim_id")).cast("long")
    return c.select("draft", "claim_id", rank.alias("rank"), T.finding_id(F.col("text")).alias("finding_id"))


def claim_words(spark: SparkSession, d: str) -> DataFrame:
    """Claims without markers, by words; pointer claims of fewer than twelve words of three letters apart."""
    text = T.sentence_text(F.col("text"))
    longer = F.size(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), 0))
    return load(spark, d, "claim_sentences").where("text is not null").select("claim_id", F.size(T.words(text)).cast("long").alias("words"), (longer < 12).alias("pointer"))


def provenance_best_passage(spark: SparkSession, d: str) -> DataFrame:
    claims = load(spark, d, "draft_sentences").select(F.col("sent_id").alias("claim_id"), F.explode(F.array_distinct("citekeys")).alias("citekey"), "text")
    return review.provenance(claims, load(spark, d, "passages").dropDuplicates(["passage_id"])).fillna(0, ["passage_id"])


def provenance_bands(spark: SparkSession, d: str) -> DataFrame:
    return provenance_best_passage(spark, d).groupBy(T.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def registry_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Citekeys that several drafts rely on."""
    return review.registry_repeats(load(spark, d, "draft_sentences").select(F.explode("citekeys").alias("key"), F.col("draft").alias("unit")))


def log_cost_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """Calls and cost of each user between the events that mark a segment."""
    return review.segments(load(spark, d, "events"), "user_id", F.to_date("ts"), ["ts", "event_id"], F.col("event_type") == "signup", "value")


def longest_event_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest streak of one kind of event per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("opened", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1))
    e = e.withColumn("run", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


def first_appearance_order(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of event of each user in the order of their first appearance."""
    rows = load(spark, d, "events").select(F.col("user_id").alias("group"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("citekey"))
    return review.first_appearance(rows).withColumnRenamed("citekey", "event_type").withColumnRenamed("group", "user_id")


def interpolated_cost(spark: SparkSession, d: str) -> DataFrame:
    """The value at each marker, interpolated in time between the events before and after it; null where one side is missing."""
    marker = F.col("event_type") == "signup"
    e = load(spark, d, "events").select("user_id", "event_id", "ts", marker.alias("marker"), F.when(~marker, F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")).alias("p"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before, after = F.last("p", ignorenulls=True).over(w), F.first("p", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = e.select("user_id", "event_id", "marker", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), before.alias("b"), after.alias("a")).where("marker")
    share = (F.col("t") - F.col("b.t")) / F.nullif(F.col("a.t") - F.col("b.t"), F.lit(0))
    return rows.select("user_id", "event_id", F.round(F.col("b.value") + (F.col("a.value") - F.col("b.value")) * share, 4).alias("value"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.col("label").alias("source"), "embedding")


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated set of queries: every row whose id is divisible by 50."""
    return load(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return topics.nearest(_query_vectors(spark, d), _vectors(spark, d), 10, per_source=3)


def vector_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """As vector_topk without the cap, by an inverted index: the rows are those of exact search."""
    return topics.indexed_nearest(_query_vectors(spark, d), _vectors(spark, d), 10)


def shortlist_distances(spark: SparkSession, d: str) -> DataFrame:
    return topics.best_distances(_query_vectors(spark, d), _vectors(spark, d))


def doc_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return topics.mean_vectors(load(spark, d, "embeddings"), "label", "embedding").withColumn("dim", F.col("dim").cast("long"))


def topic_membership(spark: SparkSession, d: str) -> DataFrame:
    return topics.memberships(load(spark, d, "embeddings"), "embedding", "label", "vec_id")


def topic_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Documents near the first vector of each label."""
    e = load(spark, d, "embeddings")
    seeds = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("seed_vector")).select(F.col("label").alias("seed"), "seed_vector")
    return topics.seed_matches(seeds, e)


def topic_converged(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one naming of topics by seeds, the closest first; topics and seeds are as few as labels."""
    e = load(spark, d, "embeddings")
    cents = topics.centroids(e, "label", "embedding", centred=False).collect()
    seeds = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).collect()

    def cosine(a, b) -> float:
        ab, aa, bb = sum(x * y for x, y in zip(a, b, strict=True)), sum(x * x for x in a), sum(y * y for y in b)
        return ab / (aa * bb) ** 0.5 if aa and bb else 0.0

    pairs = topics.greedy_pairs([(cosine(s["v"], c["centroid"]), str(s["label"]), str(c["label"])) for s in seeds for c in cents], floor=0.15)
    return spark.createDataFrame([(p, t, round(x, 4)) for p, t, x in pairs], "phrase string, topic string, score double")


def converged_set(spark: SparkSession, d: str) -> DataFrame:
    """All topics with the phrase that names them, if one does, and the phrases that name none (rows only)."""
    named = topic_converged(spark, d)
    labels = load(spark, d, "embeddings").select(F.col("label").cast("string").alias("topic")).distinct()
    phrases = labels.withColumnRenamed("topic", "phrase")
    return labels.join(named, "topic", "left").select("topic", "phrase", "score").unionByName(phrases.join(named, "phrase", "left_anti").select(F.lit(None).cast("string").alias("topic"), "phrase", F.lit(None).cast("double").alias("score")))


_F = (used_keys, citation_gate, citation_numbers, section_keys, synthesis_report, longest_single_run, uncited_claims, uncited_order, claim_words, provenance_best_passage, provenance_bands, registry_repeats, log_cost_by_segment, longest_event_run, first_appearance_order, interpolated_cost, vector_topk, vector_topk_indexed, shortlist_distances, doc_mean_pool, topic_membership, topic_seeds, topic_converged, converged_set)
QUERIES = {f.__name__: f for f in _F}

_KEYS = "regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9_-]*)', 1)"
_CITED = f"c AS (SELECT doc_id AS key, unnest(range(0, len({_KEYS}))) AS pos, unnest({_KEYS}) AS citekey FROM documents WHERE text IS NOT NULL)"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.PASSAGE_STOP) + "]"
_DISTINCT = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)))"
_PROVENANCE = f"""c AS (SELECT sent_id AS claim_id, unnest(list_distinct(citekeys)) AS citekey, {_DISTINCT} AS cw FROM draft_sentences),
    p AS (SELECT passage_id, any_value(citekey) AS citekey, any_value({_DISTINCT}) AS pw FROM passages WHERE text IS NOT NULL GROUP BY 1),
    s AS (SELECT claim_id, citekey, passage_id, round(coalesce(len(list_intersect(cw, pw)) / nullif(len(cw), 0)::DOUBLE, 0.0), 4) AS score FROM c LEFT JOIN p USING (citekey)),
    b AS (SELECT claim_id, citekey, score, CASE WHEN score > 0 THEN passage_id END AS passage_id FROM s QUALIFY row_number() OVER (PARTITION BY claim_id, citekey ORDER BY score DESC, passage_id) = 1)"""
_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


SQL = {
    "used_keys": f"WITH {_CITED} SELECT key, CAST(pos AS BIGINT) AS pos, citekey FROM c",
    "citation_gate": f"WITH {_DELIVERY}, {_CITED} SELECT citekey, count(*) AS uses, min(key) AS first_key FROM c WHERE citekey NOT IN (SELECT citekey FROM lg) GROUP BY 1",
    "citation_numbers": """WITH e AS (SELECT draft, sent_id, unnest(range(0, len(citekeys))) AS pos, unnest(citekeys) AS citekey FROM draft_sentences), f AS (SELECT draft, citekey, min((sent_id, pos)) AS first_at FROM e GROUP BY 1, 2)
        SELECT draft AS "group", CAST(row_number() OVER (PARTITION BY draft ORDER BY first_at, citekey) AS BIGINT) AS number, citekey FROM f""",
    "section_keys": "SELECT draft, coalesce(section, 'Unassigned') AS section, array_to_string(list_sort(list_distinct(list(k))), ',') AS keys FROM (SELECT draft, section, unnest(citekeys) AS k FROM draft_sentences) GROUP BY 1, 2",
    "synthesis_report": """WITH u AS (SELECT draft, len(list_distinct(citekeys)) AS n FROM draft_sentences)
        SELECT draft, count_if(n >= 1)::BIGINT AS citing, count_if(n = 0)::BIGINT AS uncited, count_if(n = 1)::BIGINT AS single_source, count_if(n > 1)::BIGINT AS multi_source, round(100.0e0 * count_if(n = 1) / nullif(count_if(n >= 1), 0), 4) AS single_percent FROM u GROUP BY 1""",
    "longest_single_run": """WITH u AS (SELECT draft, sent_id AS first_at, CASE WHEN len(list_distinct(citekeys)) = 1 THEN citekeys[1] END AS one_key FROM draft_sentences),
        o AS (SELECT *, CASE WHEN one_key IS NOT NULL AND one_key = lag(one_key) OVER w THEN 0 ELSE 1 END AS opened FROM u WINDOW w AS (PARTITION BY draft ORDER BY first_at)),
        r AS (SELECT *, sum(opened) OVER (PARTITION BY draft ORDER BY first_at) AS run FROM o), g AS (SELECT draft, one_key, count(*) AS length, min(first_at) AS first_at FROM r WHERE one_key IS NOT NULL GROUP BY draft, run, one_key)
        SELECT draft, one_key AS citekey, length FROM g QUALIFY row_number() OVER (PARTITION BY draft ORDER BY length DESC, first_at) = 1""",
    "uncited_claims": "SELECT draft, count(*) AS claims, count_if(NOT cites)::BIGINT AS uncited, count_if(NOT cites AND block_cites)::BIGINT AS bare, round(count_if(NOT cites) / count(*)::DOUBLE, 4) AS share FROM claim_sentences GROUP BY 1",
    "uncited_order": "SELECT draft, claim_id, CAST(row_number() OVER (PARTITION BY draft ORDER BY block_cites, line, claim_id) AS BIGINT) AS rank, substr(sha256(text), 1, 12) AS finding_id FROM claim_sentences WHERE NOT cites",
    "claim_words": """WITH t AS (SELECT claim_id, trim(regexp_replace(regexp_replace(text, '\\[@[^\\]]+\\]|\\\\cite[tp]?\\{[^}]*\\}', ' ', 'g'), ' {2,}', ' ', 'g')) AS t FROM claim_sentences WHERE text IS NOT NULL)
        SELECT claim_id, CAST(len(regexp_extract_all(lower(t), '[a-z0-9]+')) AS BIGINT) AS words, len(regexp_extract_all(t, '[A-Za-z]{3,}')) < 12 AS pointer FROM t""",
    "provenance_best_passage": f"WITH {_PROVENANCE} SELECT claim_id, citekey, score, coalesce(passage_id, 0) AS passage_id FROM b",
    "provenance_bands": f"WITH {_PROVENANCE} SELECT CASE WHEN score < 0.20 THEN 'none' WHEN score < 0.50 THEN 'weak' ELSE 'supported' END AS band, count(*) AS n FROM b GROUP BY 1",
    "registry_repeats": "SELECT key, count(DISTINCT unit) AS units, count(*) AS uses FROM (SELECT unnest(citekeys) AS key, draft AS unit FROM draft_sentences) GROUP BY 1 HAVING count(DISTINCT unit) > 1",
    "log_cost_by_segment": """WITH s AS (SELECT user_id, event_type, value, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM events)
        SELECT user_id, segment, count(*) AS calls, round(sum(value), 2) AS cost FROM s WHERE event_type <> 'signup' GROUP BY 1, 2""",
    "longest_event_run": """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS opened FROM events),
        r AS (SELECT user_id, sum(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o), g AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2) SELECT user_id, max(n) AS longest FROM g GROUP BY 1""",
    "first_appearance_order": "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first_at FROM events GROUP BY 1, 2) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_at, event_type) AS BIGINT) AS number, event_type FROM f",
    "interpolated_cost": """WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, event_type = 'signup' AS marker, CASE WHEN event_type <> 'signup' THEN epoch_us(ts) END AS pt, CASE WHEN event_type <> 'signup' THEN value END AS pv FROM events),
        n AS (SELECT *, last_value(pt IGNORE NULLS) OVER b AS bt, last_value(pv IGNORE NULLS) OVER b AS bv, first_value(pt IGNORE NULLS) OVER a AS at_, first_value(pv IGNORE NULLS) OVER a AS av FROM e
              WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT user_id, event_id, round(bv + (av - bv) * ((t - bt) / nullif(at_ - bt, 0)::DOUBLE), 4) AS value FROM n WHERE marker""",
    "vector_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, b.label AS source, round({_D2}, 4) AS distance FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0),
        c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY distance, vec_id) <= 3)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS BIGINT) AS rank FROM c QUALIFY rank <= 10""",
    "vector_topk_indexed": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, b.label AS source, round({_D2}, 4) AS distance FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS BIGINT) AS rank FROM s QUALIFY rank <= 10""",
    "shortlist_distances": f"SELECT b.label AS source, round(min({_D2}), 4) AS distance FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0 GROUP BY 1",
    "doc_mean_pool": "WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(x), 4) AS mean FROM e GROUP BY 1, 2",
    "topic_membership": f"""WITH e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT dim, avg(x) AS m FROM e GROUP BY 1),
        mm AS (SELECT list(m ORDER BY dim) AS mean FROM m), m2 AS (SELECT dim, avg(x) AS m FROM e WHERE label >= 0 GROUP BY 1),
        c AS (SELECT label AS topic, list(v ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) - any_value(m) AS v FROM e JOIN m2 USING (dim) WHERE label >= 0 GROUP BY 1, 2) GROUP BY 1),
        v AS (SELECT vec_id, label, list_transform(list_zip(embedding, mean), lambda z: z[1]::DOUBLE - z[2]) AS v FROM embeddings CROSS JOIN mm),
        w AS (SELECT vec_id, label, CAST(topic AS VARCHAR) AS topic, round(coalesce({_dot('v', 'c')} / nullif(sqrt({_dot('v', 'v')}) * sqrt({_dot('c', 'c')}), 0), 0), 6) AS weight FROM v CROSS JOIN c),
        r AS (SELECT *, max(weight) OVER (PARTITION BY vec_id) AS best, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, topic) AS rk FROM w)
        SELECT vec_id, topic, weight FROM r WHERE (weight > 0 AND weight >= 0.5e0 * best AND rk <= 8) OR topic = CAST(label AS VARCHAR)""",
    "topic_seeds": f"""WITH s AS (SELECT label AS seed, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1),
        m AS (SELECT seed, vec_id AS key, round({_dot('v', 'embedding')} / (sqrt({_dot('v', 'v')}) * sqrt({_dot('embedding', 'embedding')})), 6) AS score FROM embeddings CROSS JOIN s),
        k AS (SELECT *, count(*) OVER (PARTITION BY seed) AS considered, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, key) AS BIGINT) AS rank FROM m WHERE score >= 0.15)
        SELECT seed, key, score, considered, rank FROM k WHERE rank <= 25""",
}
