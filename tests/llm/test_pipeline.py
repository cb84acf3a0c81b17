"""The pipeline's stages on the small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from galeframe.llm import quality
from galeframe.llm.common import read, scratch, stored


def test_stages(spark, tables):
    docs = read(spark, tables, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "passages", "benchmark", "tokens"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tables), f"test-{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns or name == "tokens"
    assert kept["quality"] >= kept["near_dedup"] >= kept["passages"] >= kept["benchmark"] == kept["tokens"]
    assert docs.where("not round_trip").count() == 0 and set(columns) <= set(docs.columns)
    good = {r["doc_id"] for r in read(spark, tables, "labels").where("quality = 1").select("doc_id").collect()}
    assert len(good & kept["quality"]) > 0.95 * len(good)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert quality.Settings().least < 0.5


def test_near_dedup_holds_no_graph_of_all_nodes(spark, tables, monkeypatch):
    """A graph of all nodes is built and searched in the memory of single tasks, which grows with the table."""

    def never(*_):
        raise AssertionError("a graph of all nodes")

    monkeypatch.setattr(corpus_pipeline.simhash, "graphs", never)
    monkeypatch.setattr(corpus_pipeline.simhash, "search", never)
    docs = read(spark, tables, "documents")
    assert 0 < corpus_pipeline.near_dedup_stage(spark, docs, tables).count() < docs.count()


@pytest.fixture(scope="module")
def odd_tables(spark, tables, tmp_path_factory):
    """The small tables with nulls, empty and repeated rows, texts of one id, a very long text, and columns of many names."""
    at = str(tmp_path_factory.mktemp("odd"))
    docs = read(spark, tables, "documents")
    long = " ".join(f"w{i % 9973}x{i}" for i in range(60_000))
    words = " ".join(f"passage{i}" for i in range(70))
    rows = [(None, f"No id here. {words}"), (90_001, None), (90_002, ""), (90_003, " \n "), (90_004, long), (90_005, f"Some words. {words} And more."), (90_006, f"Other text. {words} The end of it."), (90_006, "One id and another text of quite other words.")]
    more = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    union = docs.unionByName(more.select(*(F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))).unionByName(docs.where("doc_id = 7"))
    union.withColumns({c: F.lit(i) for i, c in enumerate(("a.b", "n_tokens", "_url", "key", "_key", "kept", "label", "keep", "group_id", "term", "_kept_0", "node"))}).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(spark, tables, name).write.parquet(f"{at}/{name}.parquet")
    return at


def test_odd_rows_and_columns_go_through_all_stages(spark, odd_tables):
    docs = read(spark, odd_tables, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[1:]:  # the classifier may judge the odd texts as it likes
        docs = stored(stage(spark, docs, odd_tables), f"odd-{name}")
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert docs.columns == columns or name == "tokens"
    ids = [i for i, _ in kept["near_dedup"]]
    assert {None, 90_001, 90_002, 90_003, 90_004, 90_006} <= set(ids) and sum(i == 7 for i in ids) <= 1
    assert "One id and another text of quite other words." in [t for i, t in kept["near_dedup"] if i == 90_006]
    assert len(kept["benchmark"]) == len(kept["tokens"]) and {"a.b", "input_n_tokens", "n_tokens", "_url"} <= set(docs.columns)
    assert docs.where("not round_trip").count() == 0
    first = corpus_pipeline.quality_stage(spark, read(spark, odd_tables, "documents"), odd_tables)
    assert first.columns == columns and first.where("text is null or trim(text) = ''").count() == 0


def test_empty_tables_go_through_all_stages(spark, odd_tables):
    docs = read(spark, odd_tables, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, odd_tables), f"empty-{name}")
        assert docs.count() == 0


def test_run_leaves_only_its_result(spark, tables):
    before = scratch()
    assert corpus_pipeline.run(spark, tables).count() > 0
    assert len(scratch() - before) == 1
