"""Operators on drafts and places against brute force and literal cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udf
from quillspark.operators import drafts, structure
from quillspark.sources import tables
from quillspark.streaming import incremental

SENTENCE = "calibration model drives turbine sensor while pump controller reports pressure values toward central gateway network without losing recorded signal history across several industrial plant sections during annual maintenance windows"


def brute_skipgrams(text, n=5):
    words = re.findall("[a-z0-9]+", text.lower())
    out = set()
    for parity in (0, 1):
        family = [(i, udf.stem(w)) for i, w in enumerate(words) if i % 2 == parity and w not in T.SKIP_STOP]
        for k in range(len(family) - n + 1):
            part = family[k : k + n]
            if sum(s.isdigit() for _, s in part) < n / 2:
                out.add((part[0][0], part[-1][0] + 1, " ".join(s for _, s in part)))
    return out


def test_skipgrams_against_brute_force(spark):
    texts = [SENTENCE, "1 2 3 4 5 6 7 8 9 10 11 12", "", None, "short text"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {k: set() for k in range(len(texts))}
    for r in drafts.skipgrams(df, "k", "t").collect():
        got[r["key"]].add((r["start"], r["end"], r["gram"]))
    assert got == {k: brute_skipgrams(t or "") for k, t in enumerate(texts)} and got[0] and not got[1]


@pytest.mark.parametrize("every", [4, 6, 8, 10])
def test_swapped_words_are_caught(spark, every):
    words = SENTENCE.split()
    swapped = " ".join("xyz" if (i + 1) % every == 0 else w for i, w in enumerate(words))
    grams = lambda t: drafts.skipgrams(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t")
    assert drafts.skipgram_findings(grams(swapped), grams(SENTENCE)).count() >= 1
    assert drafts.skipgram_findings(grams("other words entirely " * 8), grams(SENTENCE)).count() == 0


def test_cites_source_looks_at_any_key_in_the_span(spark):
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 3)], "draft_key int, key string, pos int")
    findings = spark.createDataFrame([(1, 0, 11), (1, 20, 28), (2, 0, 8)], "draft_key int, start int, end int")
    cited = spark.createDataFrame([(1, ["b"]), (2, ["b"])], "draft_key int, cited array<string>")
    got = {(r["draft_key"], r["start"]): r["cites_source"] for r in drafts.cites_source(findings, drafts.position_keys(hits, True), cited).collect()}
    assert got == {(1, 0): True, (1, 20): False, (2, 0): False}
    assert drafts.position_keys(hits, True).count() == 11 and drafts.position_keys(hits, False).count() == 2


def test_allowlist(spark):
    assert drafts.masked_words("a b c a b".split(), [["a", "b"]]) == 4
    df = spark.createDataFrame([(1, "in the sense of the word pump twin"), (2, "pump twin sensor valve grid mesh shard gate")], "id int, f string")
    assert [r["id"] for r in drafts.allowlisted(df, "f", [["in", "the", "sense", "of"]], least=5).collect()] == [2]
    assert drafts.allowlisted(df, "f", [["pumps", "twins"]], least=7, stemmed=True).count() == 0


def test_renumbering():
    numbers = {"a": 1, "b": 2, "c": 3, "d": 5}
    assert drafts.renumber("x [@c; @a; @b] y [@d] z [@a; @zz]", numbers) == "x [1]–[3] y [5] z [@a; @zz]"
    assert drafts.renumber("[@a; @b]", numbers) == "[1], [2]"


def test_outline_parents_and_problems(spark):
    text = "# A {#a}\n## B {#b}\n#### C {#c}\n## D\n### E {#b}"
    lines = tables.numbered_lines(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    got = {r["line"]: (r["parent"], r["problem"]) for r in drafts.outline(lines).collect()}
    assert got == {1: (None, None), 2: ("a", "id repeated"), 3: ("b", "level skipped"), 4: ("a", "no id"), 5: (None, "id repeated")}


def test_drawing(spark):
    src = r"\node (a) {one two}; \draw (a.east) -- (b) -- (1,2) -- (c); \node (x) at (0,0) {" + "w " * 16 + "};"
    df = spark.createDataFrame([(1, src)], "k int, t string")
    assert sorted((r["source"], r["target"]) for r in drafts.drawing_edges(df, "k", "t").collect()) == [("a", "b"), ("b", "c")]
    assert [r["words"] for r in drafts.long_nodes(df, "k", "t").collect()] == [16]


def test_acronyms(spark):
    g = spark.createDataFrame([("DT", "digital twin"), ("ML", "machine learning"), ("XX", "x x")], "acronym string, expansion string")
    k = drafts.vocabulary(spark.createDataFrame([("DT", "old"), ("ML", "Machine Learning")], "acronym string, expansion string"), spark.createDataFrame([("DT", "digital twins")], "acronym string, expansion string"))
    assert {r["acronym"]: r["state"] for r in drafts.acronym_findings(g, k).collect()} == {"DT": "stale", "XX": "suggest"}


def test_fuzzy_sections(spark):
    asked = spark.createDataFrame([("methods",), ("result",), ("nothing",), ("data",)], "asked string")
    sections = spark.createDataFrame([("Methods",), ("Methods and data",), ("Results",), ("Data set",)], "section string")
    assert {r["asked"]: r["section"] for r in drafts.fuzzy_section(asked, sections).collect()} == {"methods": "Methods", "result": "Results", "nothing": None, "data": None}


def test_reworded(spark):
    df = spark.createDataFrame([(1, "the sensors measured pressure", "sensor measures pressure"), (2, "other", "sensor measures pressure"), (3, None, "x")], "id int, claim string, quote string")
    assert [r["id"] for r in drafts.reworded(df).collect()] == [1]


def test_alignment_of_sections(spark):
    v = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    d = spark.createDataFrame([("s", i, v(i)) for i in range(3)], "section string, pos int, vector array<double>")
    s = spark.createDataFrame([("k", i + 1, v(i)) for i in range(3)], "source string, pos int, vector array<double>")
    r = drafts.section_alignments(d, s, spark.createDataFrame([("s", "k"), ("s", "none")], "section string, source string")).collect()
    assert [(x["source"], x["draft_start"], x["draft_end"], x["source_start"], x["source_end"]) for x in r] == [("k", 0, 3, 0, 3)]


def test_asof_and_lines(spark):
    points = spark.createDataFrame([("k", 0), ("k", 5), ("k", 10), ("l", 1)], "k string, at int")
    marks = spark.createDataFrame([("k", 5, 2), ("k", 9, 3)], "k string, at int, page int")
    for width in (1, 4, 1000):
        assert {(r["k"], r["at"]): r["page"] for r in structure.asof(points, marks, "k", "at", "page", width).collect()} == {("k", 0): None, ("k", 5): 2, ("k", 10): 3, ("l", 1): None}
    assert spark.createDataFrame([("a\nb\nc", 4)], "t string, o int").select(structure.line_of(F.col("t"), F.col("o"))).first()[0] == 3


def test_number_runs(spark):
    rows = spark.createDataFrame([("k", n) for n in (1, 2, 3, 5, 6, 9, 9, None)], "k string, n int")
    assert structure.number_runs(rows, "k", "n").first()["runs"] == "1–3, 5, 6, 9"


def test_word_windows(spark):
    for n, want in ((0, 0), (20, 1), (21, 2), (30, 2), (45, 4)):
        text = " ".join(f"w{i}" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string").select(T.words(F.col("t")).alias("w")).select(structure.word_windows(F.col("w")).alias("x"))
        windows = df.first()["x"]
        assert len(windows) == want and (not windows or windows[-1].split()[-1] == f"w{n - 1}")


def test_even_ranks_match_python(spark):
    rng = random.Random(3)
    values = sorted(rng.sample(range(1000), 37))
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(4)
    want = sorted({values[round(i * 36 / 6)] for i in range(7)})
    assert sorted(r["v"] for r in structure.even_ranks(df, ["v"], 7).collect()) == want
    assert structure.even_ranks(df.limit(0), ["v"], 7).count() == 0


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(30)], "a int, b string")
    assert structure.adjusted_rand(same, "a", "b").first()["ari"] == 1.0


def test_ladder_of_upserts_in_batches(spark, tmp_path):
    folder, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    spark.createDataFrame([("a", "1", "parsed")], "citekey string, pdf_hash string, status string").write.parquet(ledger)
    spark.createDataFrame([("a", "2"), ("b", "1")], "citekey string, pdf_hash string").write.parquet(folder)
    state = {"path": ledger, "n": 0}

    def write(df):
        state["n"] += 1
        df.write.parquet(f"{ledger}-{state['n']}")
        state["path"] = f"{ledger}-{state['n']}"

    deliveries = incremental.read_deliveries(spark, folder, "citekey string, pdf_hash string")
    incremental.upsert_batches(deliveries, lambda: spark.read.parquet(state["path"]), write, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(state["path"]).collect())) == [("a", "2", "discovered"), ("b", "1", "discovered")]


def test_the_core_stands_without_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quillspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "quillspark.llm" not in p.read_text()


def test_sidecars_are_read_tolerantly(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x", "label": "text", "page": 2, "bbox": [1, 2, 3, 4]}, {"text": " ", "label": "text"}, {"text": "y", "label": "footer"}, {"text": "z", "page": 0}]')
    (tmp_path / "b.json").write_text("no json")
    rows = sorted((r["text"], r["label"], r["page"]) for r in tables.sidecar_passages(spark, str(tmp_path)).collect())
    assert rows == [("x", "text", 2), ("z", None, None)]


def test_glossary_and_prose(spark):
    df = spark.createDataFrame([("d", "- **DT** -- digital twin\n```\n- **no** -- code\n```\ntext")], "k string, t string")
    assert {"DT": "digital twin"}.items() <= {r["term"]: r["definition"] for r in tables.glossary(df, "k", "t").collect()}.items()
    assert [r["value"] for r in tables.prose_lines(df, "k", "t").orderBy("line").collect()] == ["- **DT** -- digital twin", "text"]


def test_rejected_reasons_and_fields(spark):
    df = spark.createDataFrame([("d", "| key | query | reason |\n|---|---|---|\n| `a_1` | q | old |\n| `a_1` | q | new |")], "k string, t string")
    assert {r["citekey"]: r["reason"] for r in tables.rejected_reasons(df, "k", "t").collect()}["a_1"] == "new"
    f = spark.createDataFrame([("claim: C\n- quote: Q\nclaim: D",)], "b string").select(tables.block_fields(F.col("b")).alias("f")).first()["f"]
    assert (f["claim"], f["quote"], f["support"]) == ("C", "Q", None)


def test_bucketed_postings_join_without_a_shuffle(spark, tmp_path):
    spark.sql(f"create database if not exists postings location '{tmp_path}/db'")
    rows = spark.createDataFrame([(f"g{i % 7}", i) for i in range(50)], "gram string, pos int")
    tables.write_postings(rows, "postings.a", 3)
    tables.write_postings(rows, "postings.b", 3)
    a, b = spark.table("postings.a"), spark.table("postings.b").withColumnRenamed("pos", "other")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "gram")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == sum((50 // 7 + (g < 50 % 7)) ** 2 for g in range(7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database postings cascade")


def test_best_text_skips_blanks(spark):
    df = spark.createDataFrame([(" ", None, "c")], "a string, b string, c string")
    assert df.select(tables.best_text(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "c"


def test_windowed_counts_as_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.sql("select timestamp_seconds(60 * id) as ts, cast(id % 2 as string) as kind from range(10)").write.parquet(folder)
    counts = incremental.windowed_counts(incremental.read_deliveries(spark, folder, "ts timestamp, kind string"), "ts", ["kind"])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("counted").collect()) == 10


def test_vector_alignments_take_every_vector_and_other_sections(spark, tables):
    from quillspark.plans import draft_queries as plans

    rng = random.Random(3)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(32)]) for i in range(1200)]
    for n in range(4):  # vectors beyond the first of their labels, in sections of two labels
        rows[1100 + 2 * n] = (1100 + 2 * n, 0, rows[701 + 2 * n][2])
    d = tables(embeddings=spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    got = plans.vector_alignments(spark, d).collect()
    assert not [r for r in got if r["section"] == r["source"]]
    best = max((r for r in got if r["section"] == "0/4" and r["source"] == "1/2"), key=lambda r: r["score"])
    assert (best["draft_start"], best["draft_end"], best["source_start"], best["source_end"]) == (38, 42, 94, 98)
    sections = drafts.vector_sections(spark.read.parquet(f"{d}/embeddings.parquet"), "label", "vec_id", "embedding")
    assert sections.count() == 1200 and sections.groupBy("section").count().where("count > 256").count() == 0
    assert {r["n"] for r in drafts.section_shortlist(sections).groupBy("section").agg(F.count_distinct("source").alias("n")).collect()} == {5}
    assert drafts.section_shortlist(sections.limit(0)).count() == 0 and drafts.section_shortlist(sections.where("section = '0/4'")).count() == 0


def test_shortlist_is_that_of_all_pairs_in_any_blocks(spark, monkeypatch):
    from quillspark.operators import topics

    rng = random.Random(5)
    vectors = [(f"s{i % 9}", i // 9, [rng.gauss(0, 1) for _ in range(5)]) for i in range(108)]
    least = {}
    for s, _, v in vectors:
        for t, _, w in vectors:
            if s != t:
                least[s, t] = min(least.get((s, t), math.inf), sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))
    best = {(s, t) for s in {s for s, _ in least} for t in sorted((t for u, t in least if u == s), key=lambda t: least[s, t])[:5]}
    rows = spark.createDataFrame(vectors, "section string, pos int, vector array<double>")
    for block in (20_000, 30):
        monkeypatch.setattr(topics, "QUERY_BLOCK", block)
        assert {tuple(r) for r in drafts.section_shortlist(rows).collect()} == best


def test_bigram_scores_are_shares_of_the_draft(spark, tables):
    import __spark_entry__

    def grams(t):
        s = [udf.stem(w) for w in re.findall("[a-z0-9]+", t.lower()) if w not in T.SKIP_STOP]
        return set(zip(s, s[1:], strict=False))

    fragments = {"a": ("x", "the pumps were controlling the pressure of gateways"), "b": ("y", "the pumps were controlling the pressure of gateways"), "c": ("x", "of the pump"), "d": ("x", "unseen words only"), "e": ("x", None)}
    texts = [("x", "A pump controls pressure."), ("x", "gateways of the pressured"), ("y", "gateways"), ("y", None)]
    d = tables(overlap_df=spark.createDataFrame([(k, *v) for k, v in fragments.items()], "id string, draft string, fragment string"), draft_sentences=spark.createDataFrame(texts, "draft string, text string"))
    got = {r["id"]: (r["bigrams"], r["share"]) for r in __spark_entry__.queries()["bigram_scores"](spark, d).collect()}
    want = {}
    for k, (draft, f) in fragments.items():
        q, c = grams(f or ""), set().union(*(grams(t or "") for g, t in texts if g == draft))
        want[k] = (len(q), round(len(q & c) / len(q), 4) if q else None)
    assert got == want == {"a": (3, 0.6667), "b": (3, 0.0), "c": (0, None), "d": (1, 0.0), "e": (0, None)}


def test_gram_lookup_takes_every_gram_of_a_finding(spark, tables):
    import __spark_entry__

    words = SENTENCE.split()
    postings = [(" ".join(words[i : i + 8]), "k", 1, i) for i in (0, 3, len(words) - 8)] + [("Calibration, " + " ".join(words[1:8]), "k", 2, 9), (" ".join(words[:7]), "k", 3, 0), (" ".join(words[3:11]), None, 1, 0), (None, "k", 1, 1)]
    d = tables(
        overlap_df=spark.createDataFrame([("a", " ".join(words)), ("b", " ".join(words[:7])), ("c", None)], "id string, fragment string"),
        gram_postings=spark.createDataFrame(postings, "gram string, citekey string, page int, position int"),
    )
    got = sorted((r["page"], r["position"]) for r in __spark_entry__.queries()["gram_lookup"](spark, d).collect())
    assert got == [(1, 0), (1, 3), (1, len(words) - 8), (2, 9)]


def test_every_query_has_a_known_name():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120 and len(sql) > 100
