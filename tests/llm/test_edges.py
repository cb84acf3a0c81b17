"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for each operator."""

import pytest
from pyspark.sql import functions as F

from galeframe.llm import bpe, decontaminate, langid, licenses, neighbours, passages, quality, simhash, toxicity, urls

WORDS = [f"word{i}" for i in range(60)]
LONG = " ".join(f"w{i % 9973}x{i}" for i in range(60_000))
#: Columns with the names that the operators use inside.
CLASHING = ("a.b", "_key", "_url", "key", "label", "group_id", "kept", "a", "b", "keep", "probability", "_cuts", "term", "rep", "node", "n_words")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en"), (2, None, None), (3, "", "en"), (4, "   \n ", None), (None, "A text without an id.", "de"),
        (5, LONG, "en"), (6, "The quick brown fox jumps over the lazy dog and runs away from it.", "en"), (6, "The quick brown fox jumps over the lazy dog and runs away from it.", "en"),
        (7, " ".join(WORDS), "de"), (8, "Other words first. " + " ".join(WORDS) + " and others last.", "de"), (9, "日本語のテキスト 🙂 é", None), (10, "Released under the MIT License", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (99, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away from it"), (2, None), (3, ""), (None, " ".join(WORDS[:20])), (1, "quick brown fox jumps over the lazy dog and runs away from it")], "item_id long, text string")


def test_quality(docs, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got}
    assert by[2]["probability"] is None and not by[2]["keep"] and by[4]["probability"] is None and by[5]["probability"] is not None
    out = quality.reject(docs, labels)
    assert out.columns == docs.columns and all(r["text"] for r in out.collect())
    assert quality.classify(docs, labels.where("quality = 1")).where("keep").count() == 9
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_simhash(docs):
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs).collect()}
    assert got[1] == got[6] == 1 and 2 not in got and 3 not in got and None not in got
    assert got.get(7) == got.get(8) == 7
    out = simhash.clean(docs)
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 7, 9, 10] and out.columns == docs.columns
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.clean(docs.limit(0)).count() == 0
    twice = simhash.clean(docs.where("doc_id = 6"))
    assert twice.count() == 1


def test_passages(docs):
    got = [(r["doc_id"], r["first_word"], r["n_words"], r["duplicate"], r["source_doc_id"]) for r in passages.repeats(docs).collect()]
    assert sorted(got) == [(7, 0, 60, False, 7), (8, 3, 60, True, 7)]
    out = {r["doc_id"]: r for r in passages.clean(docs).collect()}
    assert passages.clean(docs).columns == docs.columns and passages.clean(docs).count() == 12
    assert out[8]["text"] == "Other words first. and others last." and out[7]["text"] == " ".join(WORDS) and out[5]["text"] == LONG and out[2]["text"] is None
    assert passages.repeats(docs.limit(0)).count() == 0 and passages.clean(docs.limit(0)).count() == 0


def test_decontaminate(docs, benchmark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.match(docs, benchmark).where("kind = 'phrase'").collect()}
    assert got == {(1, 1), (6, 1), (7, None), (8, None)}
    out = decontaminate.clean(docs, benchmark)
    assert {r["doc_id"] for r in out.collect()} == {2, 3, 4, None, 5, 9, 10} and out.columns == docs.columns
    assert decontaminate.match(docs.limit(0), benchmark).count() == 0 and decontaminate.match(docs, benchmark.limit(0)).count() == 0


def test_bpe(docs):
    got = {r["doc_id"]: r for r in bpe.encode(docs).collect()}
    assert got[2]["token_ids"] is None and got[3]["token_ids"] == [] and all(r["round_trip"] for r in got.values() if r["doc_id"] != 2)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_licenses(docs):
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert got == {(10, "MIT")} and licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs.where("doc_id = 10").union(docs.where("doc_id = 10"))).count() == 2
    mit = "Released under the MIT License"
    tied = licenses.scan(docs.sparkSession.createDataFrame([(1, mit)], "doc_id long, text string"), {("B", "x"): mit, ("A", "x"): mit})
    assert [r["license"] for r in tied.collect()] == ["A"]


def test_langid(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(got) == 11 and got[2]["predicted"] is None and got[3]["predicted"] is None and got[5]["predicted"] in ("de", "en")
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("predicted is not null").count() == 0
    assert langid.identify(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert got[2]["toxic"] is None and got[3]["toxic"] is not None and got[5]["probability"] is not None
    assert toxicity.score(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://www.cheappills.example.com/buy-now?x=1", "<p>cheap pills and cheap news now</p>"), (2, "https://spam-farm.example.org/", "<p>news</p>"), (3, None, "<b>x"), (None, "https://good-news.example.net/en/1", None),
        (5, "", ""), (6, "not a url", "<script>spam</script>text"), (7, "https://user:pw@" + "a" * 63 + ".example.com:80/" + "b" * 5000, None), (8, "https://пример.рф/", None), (9, "https://example.com/" + "longpath" * 3000, None), (2, "https://spam-farm.example.org/", "<p>news</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("word", "n", "name", "rows", "odds", "all", "words", "_url", "a.b")})
    got = urls.classify(pages).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 10 and by[1]["host_words"] == ["www", "cheap", "pills", "example", "com"] and by[1]["blocked"] and by[2]["blocked"]
    assert by[3]["host_words"] is None and not by[3]["blocked"] and by[5]["host_words"] == [] and by[None]["path_words"] == ["en", "#1"] and not by[None]["blocked"]
    assert urls.keep(pages).count() == 7 and urls.keep(pages).columns == pages.columns
    plain = urls.classify(pages.where("page_id in (6, 8)")).collect()
    assert len(plain) == 2 and all(r["log_odds"] is None and not r["blocked"] for r in plain)
    assert urls.classify(pages.limit(0)).count() == 0


def test_neighbours(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (None, [1.0, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (10, [1e30, 1e30])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "rep", "nth", "rank")})
    got = {(r["vec_id"], r["rank"]): (r["neighbour_id"], round(r["cosine"], 5)) for r in neighbours.nearest(v).collect()}
    assert got[1, 1] == (2, 1.0) and got[2, 1] == (1, 1.0) and got[1, 2] == (10, 0.70711) and got[3, 1] == (10, 0.70711)
    assert {k[0] for k in got} == {1, 2, 3, 10} and len(got) == 12
    assert neighbours.nearest(v.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<float>")
    many = neighbours.nearest(copies).toPandas()
    assert len(many) == 400 and many[many.vec_id == 5].sort_values("rank").neighbour_id.tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
