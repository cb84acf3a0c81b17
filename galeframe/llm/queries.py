"""The training-data operators as queries over the input tables, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from galeframe.llm import bpe, decontaminate, langid, licenses, neighbours, passages, quality, simhash, toxicity, urls
from galeframe.llm.common import read


def op1_urls(spark, sf_dir):
    """The words and the score of every page's URL."""
    return urls.classify(read(spark, sf_dir, "pages"))


def op2_simhash(spark, sf_dir):
    """All groups of copies and near copies among the documents."""
    return simhash.groups(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    """All matches of all benchmark items in all documents."""
    return decontaminate.match(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_bpe(spark, sf_dir):
    """All documents encoded, with the round trip checked."""
    return bpe.encode(read(spark, sf_dir, "documents"))


def op5_licenses(spark, sf_dir):
    """All license spans of all documents."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_neighbours(spark, sf_dir):
    """The nearest neighbours, among all vectors, of every vector whose id is divisible by 50."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), asking=F.col("vec_id") % 50 == 0)


def op7_langid(spark, sf_dir):
    """The language of every document, from a model fitted on their own lang column."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    """The toxicity of every document."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_suffix(spark, sf_dir):
    """All passages that repeat in or across documents."""
    return passages.repeats(read(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    """The quality of every document."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_urls": op1_urls,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_neighbours": op6_neighbours,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_suffix": op9_suffix,
    "op10_quality": op10_quality,
}
#: Every window of 50 words of every document, by its words themselves; the other operators hash, fit, merge or search approximately.
OP9_SQL = """with w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w from documents where doc_id is not null and text is not null),
g as (select doc_id, i - 1 as start, array_to_string(list_slice(w, i, i + 49), ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w)),
m as (select doc_id, start, row_number() over (partition by win order by doc_id, start) > 1 as duplicate, count(*) over (partition by win) as n, min(doc_id) over (partition by win) as source from g),
s as (select *, case when start - lag(start) over (partition by doc_id, duplicate order by start) <= 50 then 0 else 1 end as fresh from m where n > 1),
k as (select *, sum(fresh) over (partition by doc_id, duplicate order by start) as span from s)
select doc_id, min(start) as first_word, max(start) + 50 - min(start) as n_words, duplicate, min(source) as source_doc_id from k group by doc_id, duplicate, span"""
ORACLES: dict[str, str] = {"op9_suffix": OP9_SQL}
