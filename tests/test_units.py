"""Units of texts, the stored index, files, and reference cases of the stemmer."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udf
from quillspark.operators import corpus, index, overlap, units
from quillspark.sources import files


@pytest.mark.parametrize(
    "word,want",
    [
        ("cats", "cat"), ("ponies", "poni"), ("agreed", "agre"), ("feed", "feed"), ("sizing", "size"), ("hopping", "hop"), ("sing", "sing"), ("relational", "relat"), ("conditional", "condit"),
        ("as", "as"), ("is", "is"), ("agreement", "agreem"), ("adoption", "adopt"), ("generalization", "gener"), ("replacement", "replac"), ("controlling", "control"),
    ],
)
def test_stems(word, want):
    assert udf.stem(word) == want


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("c")).first()["c"]


def test_sentences_and_their_spans(spark):
    text = "  See Fig. 2 and J. Smith. Next, e.g. Model. [1] follows! end? Yes  "
    assert one(spark, text, units.sentences) == ["See Fig. 2 and J. Smith.", "Next, e.g. Model.", "[1] follows! end?", "Yes"]
    spans = one(spark, text, units.sentence_spans)
    assert [text[s["start"] : s["end"]] for s in spans] == one(spark, text, units.sentences)
    assert one(spark, "", units.sentence_spans) == [] and one(spark, None, units.sentence_spans) is None


DRAFT = """# Title

Para one @a_1 says. And two.
still one.
<!-- single-source: the only one -->

- item one @b-2
- item two
| H | I |
|---|---|
| x | y @c |

Table 3: a caption

## References
[@z]"""


def test_blocks_claims_and_units(spark):
    rows = units.lines(spark.createDataFrame([(1, DRAFT), (2, ""), (3, None)], "id int, text string"), "id", "text")
    assert rows.where("key = 1").count() == 14
    b = [tuple(r) for r in units.blocks(rows).where("key = 1").orderBy("start").select("start", "end", "text").collect()]
    assert b[:5] == [(1, 1, "Title"), (3, 5, "Para one @a_1 says. And two. still one. <!-- single-source: the only one -->"), (7, 7, "item one @b-2"), (8, 8, "item two"), (9, 9, "H -- I")]
    c = [tuple(r) for r in units.claims(rows).where("key = 1").orderBy("line", "number").select("line", "number", "cites", "block_cites").collect()]
    assert c == [(3, 1, True, True), (3, 2, False, True), (7, 1, True, True), (8, 1, False, False), (11, 1, True, True)]
    u = {r["line"]: (r["keys"], r["declared"]) for r in units.unit_rows(rows, "paragraph").where("key = 1").collect()}
    assert u[3] == (["a_1"], "the only one") and u[7] == (["b-2", "c"], None)
    assert [r["keys"] for r in units.unit_rows(rows, "document").where("key = 1").collect()] == [["a_1", "b-2", "c"]]
    found = units.in_intervals(units.citations_in_lines(rows), units.blocks(rows))
    assert {(r["line"], r["citekey"], r["start"]) for r in found.collect()} == {(3, "a_1", 3), (7, "b-2", 7), (11, "c", 11)}


def test_back_matter_and_notices_are_no_content(spark):
    text = "Intro\n## References are early\nBody\n# **References**\nsee x\nmore"
    assert one(spark, text, T.before_references) == "Intro\n## References are early\nBody\n"
    assert one(spark, "no heading\nReferences in prose", T.before_references) == "no heading\nReferences in prose"
    kept = one(spark, "a\n12\nme@x.org\nhttps://x.y\nCopyright 2020 Z\nthe copyright holder\n10.1234/x\nb", T.content_text)
    assert kept == "a\nthe copyright holder\nb"


def test_source_windows(spark):
    w = lambda n: one(spark, " ".join(map(str, range(n))), lambda c: units.source_windows(F.split(c, " ")))
    assert [len(x.split()) for x in w(20)] == [20] and len(w(30)) == 2 and len(w(34)) == 3 and w(34)[-1].split()[-1] == "33"


def test_registry_forms(spark):
    text = "- **Drift**: a slow change\n- **`x_t`** - a state\nClaim @k here. No key.\n\nSee {#a1} and \\label{b}.\n# References\n@z"
    df = spark.createDataFrame([("u", text)], "key string, text string")
    assert [tuple(r)[1:] for r in units.definitions(df).orderBy("term").collect()] == [("Drift", "term", "a slow change"), ("`x_t`", "notation", "a state")]
    assert [tuple(r) for r in units.citing_claims(df).collect()] == [("u", "Claim @k here.", ["k"])]
    assert one(spark, text, units.anchors) == ["a1", "b"]
    assert units.registry_excerpt(units.definitions(df), "u").count() == 0
    assert tuple(units.registry_coverage(spark.createDataFrame([("b", False), ("a", False), ("c", True)], "unit string, accepted boolean")).first()) == (1, 3, "a, b")
    assert one(spark, "- genre: survey\n- x: ", lambda c: units.setting(c, "genre")) == "survey" and one(spark, "- genre: ", lambda c: units.setting(c, "genre")) is None
    got = one(spark, "v", lambda c: units.resolved(("flag", F.lit(None).cast("string")), ("scope", c)))
    assert tuple(got) == ("v", "scope")
    assert tuple(one(spark, "corpus: 12 keys, digest 0af3", units.recorded_corpus)) == (12, "0af3") and one(spark, "", units.recorded_corpus) is None
    assert one(spark, "colour and analyse", units.dialect) == "en-GB" and one(spark, "table", units.dialect) is None


def test_alignments_are_capped_greedily(spark):
    rows = [("s", "a", 0.9, 0, 4), ("s", "b", 0.8, 3, 6), ("s", "a", 0.7, 5, 8), ("s", "c", 0.6, 6, 9), ("t", "a", 0.1, 0, 2)]
    df = spark.createDataFrame(rows, "section string, source string, score double, draft_start int, draft_end int")
    assert {(r["section"], r["source"], r["score"]) for r in units.capped_alignments(df).collect()} == {("s", "a", 0.9), ("s", "c", 0.6), ("t", "a", 0.1)}
    assert {(r["section"], r["pos"]): r["keys"] for r in units.alignment_keys(df).collect()}["s", 3] == ["a", "b"]


def test_index_is_refreshed_by_fingerprints(spark, tmp_path):
    path = str(tmp_path / "ix")
    words = lambda a, n=12: " ".join(f"{a}{i}" for i in range(n))
    first = spark.createDataFrame([(str(k), words("abc"[k % 3] + str(k))) for k in range(30)] + [("n", None)], "key string, text string")
    assert {r["state"] for r in index.refresh(spark, path, first).collect()} == {"rebuilt"}
    assert index.postings(spark, path).count() == 30 * 5
    second = first.where("key not in ('1', '2')").withColumn("text", F.when(F.col("key") == "3", words("new", 10)).otherwise(F.col("text"))).unionByName(spark.createDataFrame([("x", words("x"))], first.schema))
    states = {r["key"]: r["state"] for r in index.refresh(spark, path, second).collect()}
    assert states["1"] == states["2"] == "dropped" and states["3"] == states["x"] == "rebuilt" and states["4"] == states["n"] == "unchanged"
    want = overlap.positions(second, "key", "text")
    got = index.postings(spark, path)
    assert sorted(map(tuple, got.select("key", "pos", "gram").collect())) == sorted(map(tuple, want.select("key", "pos", "gram").collect()))
    assert {r["state"] for r in index.refresh(spark, path, second).collect()} == {"unchanged"}
    assert index.vacuum(spark, path) and index.postings(spark, path).count() == got.count()
    assert index.lookup(got, want.where("key = 'x'")).select("key").distinct().collect()[0][0] == "x"
    assert index.postings(spark, str(tmp_path / "none")).count() == 0
    stored = spark.createDataFrame([("a", None, "m")], "key string, fp string, model string").withColumn("fp", F.sha2(F.lit("t"), 256))
    texts = spark.createDataFrame([("a", "t"), ("b", None)], "key string, text string")
    assert [r["key"] for r in index.stale_vectors(stored, texts, "m").collect()] == ["b"] and index.stale_vectors(stored, texts, "other").count() == 2


def test_ledger_states_after_parses(spark):
    old = spark.createDataFrame([("a", "1", "parse_failed", "deterministic"), ("b", "1", "parse_failed", None), ("c", "1", "parsed", None)], "citekey string, pdf_hash string, status string, failure_kind string")
    got = {r["citekey"]: (r["status"], r["action"], r["parse"]) for r in corpus.upsert(old, old.select("citekey", "pdf_hash")).collect()}
    assert got == {"a": ("parse_failed", "keep", False), "b": ("discovered", "retry", True), "c": ("parsed", "keep", False)}
    results = spark.createDataFrame([("b", "late", True), ("c", None, None), ("zz", "x", False)], "citekey string, error string, transient boolean")
    after = {r["citekey"]: (r["status"], r["failure_kind"]) for r in corpus.apply_results(old, results).collect()}
    assert after == {"a": ("parse_failed", "deterministic"), "b": ("parse_failed", "transient"), "c": ("parsed", None)}
    assert corpus.point_lookup(old, "b").count() == 1
    assert corpus.migrate(old, {"pages": "int", "status": "int"}).dtypes[-1] == ("pages", "int") and dict(corpus.migrate(old, {"status": "int"}).dtypes)["status"] == "string"


def test_files(spark, tmp_path):
    assert files.optional_table(spark, str(tmp_path / "no"), ["a"]) is None
    (tmp_path / "seeds.toml").write_text('topics = ["Sensor  drift", "sensor Drift", "", "twins"]\nphrases = ["Of the", "--"]')
    assert [r["topic"] for r in files.seed_topics(spark, str(tmp_path / "seeds.toml")).orderBy("pos").collect()] == ["Sensor drift", "twins"]
    assert files.allowed_phrases(spark, str(tmp_path / "seeds.toml")) == [["of", "the"]]
    (tmp_path / "none.toml").write_text("topics = []")
    with pytest.raises(ValueError):
        files.seed_topics(spark, str(tmp_path / "none.toml"))
    good = {"version": 1, "series": "scan", "limit": None, "findings": [{"id": "x", "citekey": "k", "tier": "exact", "line": 3, "span_words": 9}]}
    for name, change, bad in (("a", {}, False), ("b", {"limit": 5}, True), ("c", {"version": 0}, True), ("d", {"series": "other"}, True)):
        (tmp_path / f"{name}.json").write_text(json.dumps(good | change))
        if bad:
            with pytest.raises(ValueError):
                files.baseline(spark, str(tmp_path / f"{name}.json"))
        else:
            assert [tuple(r) for r in files.baseline(spark, str(tmp_path / f"{name}.json")).collect()] == [("x", "k", "exact", 3, 9)]
    (tmp_path / "log.jsonl").write_text('{"record":"meta","host":"h"}\n{"record":"run","ok":true,"name":"q","seconds":1.5}\n{"record":"run","ok":false,"name":"r","seconds":9}\n')
    meta, runs = files.run_log(spark, str(tmp_path / "log.jsonl"))
    assert meta["host"] == "h" and [tuple(r) for r in runs.collect()] == [("q", 1.5)]
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "scope.md").write_text("x")
    (tmp_path / "d" / "e" / "fig.png").write_text("x")
    found = files.members(spark, [str(tmp_path / "d")], ["*.md", "*.png"])
    assert found.count() == 2 and [r["folder"].rsplit("/", 1)[1] for r in files.folders_of(found).collect()] == ["d", "e"]
    refs = spark.createDataFrame([("k", "fig.png"), ("k", "gone.png"), ("k", "scope.md")], "key string, target string")
    assert {r["target"]: r["problem"] for r in files.figure_problems(refs, found).collect()} == {"fig.png": None, "gone.png": "missing", "scope.md": None}
    u = spark.createDataFrame([("u", True, "t", True, ["b", "a"]), ("v", False, "t", True, []), ("w", True, None, True, []), ("x", True, "t", False, [])], "unit string, signed boolean, text string, gate_passed boolean, citekeys array<string>")
    assert files.accept(u, "u", str(tmp_path / "acc")).first()["citekeys"] == ["a", "b"]
    for name in ("v", "w", "x", "none"):
        with pytest.raises(ValueError):
            files.accept(u, name, str(tmp_path / "acc"))
    files.write_tables({"terms": refs, "claims": refs}, str(tmp_path / "reg"))
    assert spark.read.parquet(str(tmp_path / "reg" / "terms")).count() == 3


def test_no_shared_folder_on_a_cluster():
    from quillspark import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}  # no setting

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_products_and_joins_give_the_same_scores(spark, monkeypatch):
    import random

    from quillspark.operators import retrieval

    rng = random.Random(5)
    words = [f"w{i:02d}x" for i in range(40)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(120)] + [(500, None), (501, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(k, " ".join(rng.choices(words, k=6))) for k in range(9)] + [(90, "zzz"), (91, None)], "query_id int, query string")
    corpus_ = retrieval.corpus_of(docs)
    one = sorted(map(tuple, retrieval.topk(corpus_, asked, 4).collect()))
    every = {(r["query_id"], r["key"]): r["score"] for r in retrieval.scores(corpus_, asked).collect()}
    monkeypatch.setattr(retrieval, "CELLS_AT_ONCE", 50)
    assert sorted(map(tuple, retrieval.topk(corpus_, asked, 4).collect())) == one
    monkeypatch.setattr(retrieval, "MATRIX_NUMBERS", 0)
    assert sorted(map(tuple, retrieval.topk(corpus_, asked, 4).collect())) == one
    joined = {(r["query_id"], r["key"]): r["score"] for r in retrieval.scores(corpus_, asked).collect()}
    assert joined.keys() == every.keys() and all(abs(joined[k] - every[k]) < 1e-9 for k in every)
    monkeypatch.setattr(retrieval, "MOST_TERMS", 3)
    assert sorted(map(tuple, retrieval.topk(corpus_, asked, 4).collect())) == one
    assert retrieval.topk(corpus_, asked.limit(0), 4).count() == 0 and retrieval.topk(corpus_.limit(0), asked, 4).count() == 0


def test_memberships_by_product_and_by_join(spark, monkeypatch):
    import random

    from quillspark.operators import topics

    rng = random.Random(6)
    rows = [(k, k % 4 - 1, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)] + [(99, 1, None)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    one = sorted(map(tuple, topics.memberships(v, "embedding", "label", "vec_id").collect()))
    monkeypatch.setattr(topics, "MATRIX_NUMBERS", 0)
    assert sorted(map(tuple, topics.memberships(v, "embedding", "label", "vec_id").collect())) == one
    assert topics.memberships(v.limit(0), "embedding", "label", "vec_id").count() == 0


def test_pages_of_phrases_are_counted_by_word(spark):
    import random
    import re

    from quillspark.operators import structure

    rng = random.Random(8)
    words = [f"word{i:02d}" for i in range(30)] + ["the", "cat"]
    phrases = [(f"p{k}", rng.choice("abc"), " ".join(rng.choices(words, k=6))) for k in range(40)] + [("x", "a", None), ("y", None, "word01"), ("z", "a", "the cat"), (None, "b", "word01 word02")]
    phrases += [(f"q{k}", "a", "word03 word04 word05") for k in range(5)] + [("q0", "b", "word03 word04 word05")]
    pages = [(rng.choice("abd"), rng.randint(1, 9), " ".join(rng.choices(words, k=8))) for _ in range(60)]
    got = structure.locate(spark.createDataFrame(phrases, "id string, citekey string, text string"), spark.createDataFrame(pages, "citekey string, page int, text string"), "citekey")
    assert "array_intersect" not in got._jdf.queryExecution().toString()  # a source's pages aren't compared with each of its phrases
    longer = lambda t: {w for w in re.findall("[a-z0-9]+", t or "") if len(w) > 3}
    held: dict = {}
    for k, page, t in pages:
        held.setdefault((k, page), set()).update(longer(t))
    want: dict = {}
    for i, k, t in phrases:
        w = longer(t)
        want.setdefault(i, []).extend((round(len(w & h) / len(w), 4), page) for (of, page), h in held.items() if of == k and w & h)
    rows_ = got.collect()
    for i, rows in want.items():
        assert [(r["score"], r["page"]) for r in sorted((r for r in rows_ if r["id"] == i), key=lambda r: r["rank"])] == sorted(rows, reverse=True)[:4]


def test_many_queries_are_ranked_without_a_join(spark, monkeypatch):
    import random

    from quillspark.operators import retrieval

    rng = random.Random(9)
    words = [f"w{i:03d}x" for i in range(200)]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.03)), 199)] for _ in range(n))
    docs = spark.createDataFrame([(k, draw(rng.randint(0, 30))) for k in range(300)] + [(k, "w000x w001x") for k in range(400, 420)], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{k}", draw(7)) for k in range(30)] + [("none", "zzz"), ("one", "w000x")], "query_id string, query string")
    corpus_ = retrieval.corpus_of(docs)
    one = sorted(map(tuple, retrieval.topk(corpus_, asked, 5).collect()))
    monkeypatch.setattr(retrieval, "MATRIX_NUMBERS", 0)
    for name, value in (("MOST_TERMS", 20_000), ("TOKENS_AT_ONCE", 300), ("QUERIES_AT_ONCE", 4), ("COMMON_TERMS", 3), ("MOST_TERMS", 5)):
        monkeypatch.setattr(retrieval, name, value)
        scored = retrieval.scores(corpus_, asked, 5)
        assert "Join" not in scored._jdf.queryExecution().toString()  # not a row for every pair of query and document that share a term
        assert sorted(map(tuple, retrieval.ranked(scored, 5).collect())) == one
