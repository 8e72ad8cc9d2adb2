"""Operators against brute force and literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udf
from quillspark.operators import corpus, overlap, retrieval, review, topics
from quillspark.sources import bibtex
from quillspark.sources import tables as sources


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def test_ngrams_count_and_errors(spark):
    grams = one(spark, "A b-c d", lambda x: T.ngrams(T.words(x), 3))
    assert grams == ["a b c", "b c d"]
    assert one(spark, "a b", lambda x: T.ngrams(T.words(x), 3)) == []
    assert one(spark, "", lambda x: T.ngrams(T.words(x), 2)) == []
    with pytest.raises(ValueError):
        T.ngrams(F.col("x"), 0)


def test_null_texts_give_null_or_nothing(spark):
    assert one(spark, None, T.words) is None
    df = spark.createDataFrame([(1, None), (2, "")], "k int, t string")
    assert overlap.positions(df, "k", "t").count() == 0


def test_chunk_arithmetic(spark):
    words = " ".join(f"w{i}" for i in range(361))
    chunks = one(spark, words, lambda x: T.chunks(T.words(x)))
    assert len(chunks) == 3 and len(chunks[0].split()) == 200 and len(chunks[2].split()) == 41
    assert chunks[1].split()[0] == "w160"
    assert one(spark, "", lambda x: T.chunks(T.words(x))) == []


def test_normal_forms(spark):
    assert one(spark, "{A} Title: of--Things ", T.normal_title) == "a title of things"
    assert one(spark, " https://doi.org/10.1/AbC", T.normal_doi) == "10.1/abc"
    assert one(spark, "doi:10.1/x", T.normal_doi) == "10.1/x"
    assert one(spark, "a\fb\f \n", T.page_count) == 2


def test_citekey_problems(spark):
    cases = {"ok_2020": None, "": "empty", None: "empty", "..": "reserved", "a/b": "illegal character", "a.": "trailing dot or space", "con.x": "device name"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.citekey_problem(F.col("x")).alias("p")).collect()
    assert {r["x"]: r["p"] for r in rows} == cases


def test_collections(spark):
    df = spark.createDataFrame([(1, ["A > B"]), (2, ["A > Bx"]), (3, ["a > b > c"]), (4, None)], "ref_id int, collections array<string>")
    assert [r[0] for r in df.where(T.collection_matches(F.col("collections"), "A > B")).collect()] == [1, 3]
    assert {r["collection"]: r["entries"] for r in corpus.collection_names(df).collect()} == {"A": 2, "A > B": 1, "A > Bx": 1, "a": 1, "a > b": 1, "a > b > c": 1}


def brute_bm25(docs, query, k):
    toks = {key: [w for w in text.lower().split() if len(w) > 2 and w not in T.BM25_STOP] for key, text in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = []
    for key, t in toks.items():
        s = 0.0
        for w in {w for w in query.lower().split() if len(w) > 2 and w not in T.BM25_STOP}:
            df, tf = sum(w in x for x in toks.values()), t.count(w)
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            out.append((-round(s, 4), key))
    return [(key, -s) for s, key in sorted(out)[:k]]


def test_bm25_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["sensor", "pump", "twin", "ledger", "the", "of", "claim", "draft"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(40)]
    corpus_df = spark.createDataFrame(docs, "key long, text string")
    got = retrieval.topk(corpus_df, spark.createDataFrame([(1, "the sensor twin twin")], "query_id int, query string"), 7).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == brute_bm25(docs, "the sensor twin twin", 7)


def test_bm25_on_empty_corpus(spark):
    empty = spark.createDataFrame([], "key long, text string")
    assert retrieval.topk(empty, spark.createDataFrame([(1, "x sensor")], "query_id int, query string")).count() == 0


def test_ndcg_of_second_rank(spark):
    rankings = spark.createDataFrame([(1, i + 1, k) for i, k in enumerate("abc")], "query_id int, rank int, key string")
    q = retrieval.quality(rankings, spark.createDataFrame([(1, "b"), (2, "z")], "query_id int, key string")).orderBy("query_id").collect()
    assert [(r["recall"], r["ndcg"]) for r in q] == [(1.0, 0.6309), (0.0, 0.0)]


def test_coverage_is_null_without_candidates(spark):
    none = spark.createDataFrame([], "key string")
    r = retrieval.coverage_percent(retrieval.coverage(none, spark.createDataFrame([("a",)], "key string"))).first()
    assert r["percent"] is None and r["outside"] == 1


def test_islands_merge_over_one_word(spark):
    hits = spark.createDataFrame([(1, p) for p in (0, 1, 9, 10, 19, 40)], "k int, pos int")
    got = overlap.islands(hits, ["k"], n=8).orderBy("start").collect()
    assert [(r["start"], r["end"], r["span_words"], r["matched_words"]) for r in got] == [(0, 27, 27, 26), (40, 48, 8, 8)]


def test_span_merge_uses_the_greatest_end(spark):
    spans = spark.createDataFrame([("k", 0, 20), ("k", 2, 5), ("k", 21, 22), ("k", 30, 31)], "k string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in overlap.merge_spans(spans, ["k"]).collect()) == [(0, 22), (30, 31)]


def test_suppression(spark):
    weak = spark.createDataFrame([("a", 2, 4), ("a", 4, 9), ("b", 2, 4)], "k string, start int, end int")
    strong = spark.createDataFrame([("a", 0, 5)], "k string, start int, end int")
    assert sorted(tuple(r) for r in overlap.suppress_contained(weak, strong, "k").collect()) == [("a", 4, 9), ("b", 2, 4)]
    assert sorted(tuple(r) for r in overlap.suppress_touching(weak, strong, "k").collect()) == [("b", 2, 4)]


def test_duplicates_report_keys_once(spark):
    refs = spark.createDataFrame([("a", "T one", "10.1/x"), ("b", "t ONE", "doi:10.1/X"), ("c", "other", None), ("d", "Other!", "")], "citekey string, title string, doi string")
    got = sorted(tuple(r) for r in corpus.duplicates(refs).collect())
    assert got == [("doi", "10.1/x", 2, "a"), ("title", "other", 2, "c")]
    assert sorted(r["citekey"] for r in corpus.duplicate_members(refs).collect()) == ["a", "b", "c", "d"]


def test_upsert_and_prune_guard(spark):
    old = spark.createDataFrame([("a", "1", "parsed"), ("b", "1", "parsed"), ("c", "1", "parsed")], "citekey string, pdf_hash string, status string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "citekey string, pdf_hash string")
    got = {r["citekey"]: (r["status"], r["action"]) for r in corpus.upsert(old, new).collect()}
    assert got == {"a": ("parsed", "keep"), "b": ("discovered", "update"), "c": ("parsed", "stale"), "d": ("no_pdf", "insert")}
    with pytest.raises(ValueError):
        corpus.prune(old, new.limit(0))


def test_latest_delivery(spark):
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 1)], "id int, v string, at int")
    assert {r["id"]: r["v"] for r in corpus.latest(rows, "id", "at").collect()} == {1: "y", 2: None}


def test_single_source_run_breaks(spark):
    units = spark.createDataFrame([("d", i, k) for i, k in enumerate([["a"], ["a"], [], ["a"], ["b"], ["a", "b"], ["b"]])], "draft string, at int, citekeys array<string>")
    r = review.longest_single_run(units).first()
    assert (r["citekey"], r["length"]) == ("a", 2)


def test_segments_drop_empty_ones(spark):
    log = spark.createDataFrame([(1, i, m, 1.0) for i, m in enumerate([False, True, True, False, False])], "u int, at int, m boolean, c double")
    got = sorted(tuple(r) for r in review.segments(log, "u", F.floor(F.col("at") / 2), ["at"], F.col("m"), "c").collect())
    assert got == [(1, 0, 1, 1.0), (1, 2, 2, 2.0)]


def test_provenance_first_passage_wins(spark):
    claims = spark.createDataFrame([(1, "k", "sensor pump twin"), (2, "z", "sensor")], "claim_id int, citekey string, text string")
    passages = spark.createDataFrame([(7, "k", "a pump"), (5, "k", "the pump"), (6, "k", None)], "passage_id int, citekey string, text string")
    got = {r["claim_id"]: (r["score"], r["passage_id"]) for r in review.provenance(claims, passages).collect()}
    assert got == {1: (0.3333, 5), 2: (0.0, None)}


def test_fence_needs_four_rows(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 6, 7)] + [("b", 1.0)], "g string, v double")
    got = {r["g"]: r["fence"] for r in review.tukey_fence(rows, "g", "v").collect()}
    assert got == {"a": 12.0, "b": None}


def test_nearest_respects_the_cap_of_a_source(spark):
    v = spark.createDataFrame([(i, 0 if i < 5 else 1, [float(i), 0.0]) for i in range(8)], "vec_id int, source int, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id int, query array<double>")
    got = [(r["vec_id"], r["rank"]) for r in topics.nearest(q, v, 4, per_source=2).orderBy("rank").collect()]
    assert got == [(0, 1), (1, 2), (5, 3), (6, 4)]


def test_index_recall_against_exact_search(spark, monkeypatch):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(12)]
    rows = [(i, i % 3, [c + rng.gauss(0, 1) for c in centres[i % 12]]) for i in range(900)]
    v = spark.createDataFrame(rows, "vec_id int, source int, embedding array<double>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r["query_id"], r["vec_id"]) for r in topics.nearest(q, v, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in topics.indexed_nearest(q, v, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    monkeypatch.setattr(topics, "CELL_ROWS", 5)
    assert {(r["query_id"], r["vec_id"]) for r in topics.indexed_nearest(q, v, 10).collect()} == found
    monkeypatch.setattr(topics, "QUERY_BLOCK", 7)
    assert {(r["query_id"], r["vec_id"]) for r in topics.nearest(q, v, 10).collect()} == exact
    assert topics.indexed_nearest(q, v.limit(0), 10).count() == 0


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_index_finds_the_nearest_of_the_given_vectors(spark, size):
    from quillspark.plans import review_queries as plans

    d = f"/root/testdata/{size}"
    exact = {(r["query_id"], r["vec_id"]) for r in topics.nearest(plans._query_vectors(spark, d), plans._vectors(spark, d), 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in plans.vector_topk_indexed(spark, d).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and found == exact


def test_index_with_a_cap_of_a_source_and_too_few_vectors(spark):
    rng = random.Random(7)
    v = spark.createDataFrame([(i, i % 2, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)], "vec_id int, source int, embedding array<double>")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for k, cap in ((10, 3), (4, 2), (300, None)):
        exact = sorted(map(tuple, topics.nearest(q, v, k, per_source=cap).collect()))
        assert sorted(map(tuple, topics.indexed_nearest(q, v, k, probes=2, per_source=cap).collect())) == exact


def test_greedy_names_use_each_side_once():
    assert topics.greedy_pairs([(0.9, "p", "a"), (0.8, "p", "b"), (0.7, "q", "a"), (0.5, "q", "b"), (0.4, "r", "c")]) == [("p", "a", 0.9), ("q", "b", 0.5)]


def test_alignment_follows_the_diagonal():
    found = topics.align([[0.9, 0.1, 0.1], [0.1, 0.9, 0.1], [0.1, 0.1, 0.95]])
    assert found[0][1] == [(0, 0), (1, 1), (2, 2)] and len(found) == 1
    assert topics.align([]) == []


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("adjustment", "adjust"), ("controller", "control"), ("sky", "sky"), ("is", "is")])
def test_stems(word, stem):
    assert udf.stem(word) == stem


def test_masks_keep_offsets():
    text = "a `code` b\n```\nx\n```\n## References\nz"
    masked = udf.mask_for_scan(text)
    assert len(masked) == len(text) and "code" not in masked and "z" not in masked and masked.startswith("a ")
    assert [w[0] for w in udf.draft_tokens(text)] == ["a", "b"]


def test_snippet_without_a_term_is_empty():
    assert udf.snippet("some text", ["pump"]) == [] and udf.snippet("", ["pump"]) == []
    assert udf.snippet("x " * 500 + "pump", ["pump"])[0].endswith("pump")


def test_bibliography(spark, tmp_path):
    (tmp_path / "lib.bib").write_text('@article{k_1,\n title={A {B} c},\n author={Doe, Jane and Max van Dam},\n year=2020, doi="10.1/x", file={x:files/1.pdf:application/pdf}}\n@comment{x, y}\n@book{con, title={t}}\n@misc{empty,}\n')
    rows = bibtex.read_library(spark, str(tmp_path)).collect()
    assert [r["citekey"] for r in rows] == ["k_1"]
    r = rows[0]
    assert r["title"] == "A {B} c" and [(a["first"], a["last"]) for a in r["authors"]] == [("Jane", "Doe"), ("Max van", "Dam")] and r["year"] == "2020"
    a = one(spark, "n:a.txt:t;p:f.pdf:t", bibtex.attachment)
    assert (a["path"], a["resolution"]) == ("f.pdf", "resolved")
    assert one(spark, None, bibtex.attachment)["resolution"] == "no file field"


def test_pipe_tables_and_blocks(spark):
    log = "| date | mode | query | asked | results | chars | collection |\n|---|---|---|---|---|---|---|\n| 2024 | search | a \\| b | 5 | 3 | 120 |\n| 2024 | search | c | 5 | 3 | n/a | x |"
    df = spark.createDataFrame([("d", log)], "k string, t string")
    rows = sources.retrieval_log(df, "k", "t").collect()
    assert [(r["query"], r["chars"], r["collection"]) for r in rows] == [("a | b", 120, "")]
    text = "x\n## one\nclaim: C\nquote: Q\n## two\nb\n## one\nclaim: D"
    got = {r["name"]: r["body"] for r in sources.blocks(spark.createDataFrame([("d", text)], "k string, t string"), "k", "t").collect()}
    assert got == {"one": "claim: D", "two": "b"}


def test_ladder_takes_the_first_rung(spark):
    a = spark.createDataFrame([("k", 1)], "citekey string, v int")
    b = spark.createDataFrame([("k", 2), ("l", 3)], "citekey string, v int")
    assert sorted((r["citekey"], r["v"]) for r in sources.passage_ladder([a, b]).collect()) == [("k", 1), ("l", 3)]


def test_cut_lineage_and_purge(spark):
    from quillspark import session

    df = session.cut_lineage(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert session.purge(spark) and not session.purge(spark)


def test_spread_leaves_large_inputs_alone(spark):
    from quillspark.session import spread

    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 7)).rdd.getNumPartitions() == 7
