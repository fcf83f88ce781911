"""The tokenizer over Arrow batches: the same tokens as the native expression, and no shuffle of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from wordmill.engine import Engine
from wordmill.functions import pieces, tokenize
from wordmill.operators import highlight
from wordmill.operators.index import Index
from wordmill.options import SearchOptions

LETTERS = "aBz09-_. ,é北京大前门月　\xa0\U0002f800😀\x1c\x0b\n\x85ßİK"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = ["", " ", "a", "北京", "x" * 3000, "京" * 40, *("".join(rng.choices(LETTERS, k=rng.randrange(60))) for _ in range(400))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).persist()


def same(a, b):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(a) == rows(b)


def test_tables_equal_the_native_expressions(spark, odd, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 500)
    index = Index.build(odd)
    terms = odd.select("doc_id", tokenize.terms(F.col("text")).alias("t"))
    each = terms.select("doc_id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
    same(index.occurrences, each)
    same(index.lengths, terms.select("doc_id", F.size("t").alias("dl")))
    tf = each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    same(index.doc_tf, tf)
    same(index.term_stats, tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf")))
    same(index.postings, each.groupBy("term", "doc_id", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("term", "doc_id", "dl", "positions"))
    same(tokenize.count_ngrams(odd, 3), tokenize.tokenize_ngrams(odd, 3).groupBy("term").agg(F.count("*").alias("n")))
    same(tokenize.count_chars(odd), tokenize.tokenize_chars(odd).groupBy("doc_id", "kind").agg(F.count("*").alias("n")))
    cut = index.tokens.join(odd, "doc_id").withColumn("part", F.expr("decode(substring(encode(text, 'UTF-8'), start + 1, `end` - start), 'UTF-8')"))
    assert cut.where("kind <> 'English' AND part <> term OR kind = 'English' AND lower(part) <> term").isEmpty()


def test_scanned_and_saved_hits_are_the_same(spark, odd):
    scanned = Engine.from_df(odd)
    saved = Engine(spark)
    saved.index = Index(odd, scanned.index.postings, scanned.index.lengths)
    for query, options in (("a* OR 北京", SearchOptions()), ("bei", SearchOptions(use_pinyin=True)), ("jing", SearchOptions(use_pinyin=True, strict_compat=False, limit=None))):
        same(scanned.explain(query, options), saved.explain(query, options))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_not_shuffled(spark, odd):
    index = Index.build(odd.select("doc_id", "text"))
    narrow = [index.tokens, index.occurrences, index.postings, index.doc_tf, index.lengths, highlight.highlight(index.docs, ["a"]), pieces.char_counts(index.docs)]
    for df in narrow:
        assert "hashpartitioning" not in plan(df) and "Window" not in plan(df)
    engine = Engine(spark)
    engine.index = index
    for query, options in (("a b", SearchOptions(enable_cache=False)), ("bei", SearchOptions(use_pinyin=True, enable_cache=False))):
        assert "SortMergeJoin" not in plan(engine.search(query, options)) and "hashpartitioning(doc_id" not in plan(engine.search(query, options))


def test_related_terms_are_looked_up_without_a_shuffle_of_tokens(spark, odd):
    few = spark.createDataFrame([("a",), ("z",)], "term string")
    assert "SortMergeJoin" not in plan(Index.build(odd).stats_of(few))
    assert "SortMergeJoin" not in plan(Index.build(odd).remove([1, 2]).docs)


def test_ngrams_travel_in_few_rows(spark, odd):
    counted = tokenize.count_ngrams(odd, 3)
    assert "HashAggregate" not in plan(counted) and plan(counted).count("hashpartitioning") <= 2
    same(tokenize.count_ngrams(odd, 0), counted.where("false"))
    same(tokenize.count_ngrams(odd, 9), tokenize.tokenize_ngrams(odd, 8).groupBy("term").agg(F.count("*").alias("n")))
