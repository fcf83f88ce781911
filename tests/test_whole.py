"""Queries do their whole job: nothing is cut off, whatever the number of hits and the length of a text."""

import pytest
from pyspark.sql import functions as F

from wordmill import catalog, catalog_mixed  # noqa: F401  the second adds to the first
from wordmill.engine import Engine
from wordmill.options import SearchOptions
from wordmill.sources import wire


def docs(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("many")
    spark.range(100_003).select(F.col("id").alias("doc_id"), F.lit("the of and tion").alias("text")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["match_term", "match_and", "match_or", "match_mixed", "bm25", "proximity", "coverage", "combined_score"])
def test_every_hit_is_returned(spark, many, name):
    assert catalog.QUERIES[name](spark, many).count() == 100_003


def test_a_search_without_a_limit(spark):
    engine = Engine.from_df(spark.range(30).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")))
    rows = engine.search("a", SearchOptions(limit=None, explain=True)).collect()
    assert [r.doc_id for r in rows] == list(range(30)) and {tuple(r.match_positions[0]) for r in rows} == {(0, 1)}
    assert engine.breakdown(" ").count() == 0 and engine.breakdown("a").count() == 20
    given = SearchOptions(limit=None)
    assert wire.options_from_json(wire.options_to_json(given)) == given


def test_texts_without_a_token_have_no_similarity(spark, tmp_path):
    assert ids(catalog.QUERIES["jaccard_similarity"](spark, docs(spark, tmp_path, ["the x", "", " \n", "y"]))) == [0, 3]


def test_characters_are_found_behind_the_beginning_of_a_text(spark, tmp_path):
    found = catalog.QUERIES["match_characters"](spark, docs(spark, tmp_path, ["x", "a " * 300 + "th" + " a" * 310, "a " * 300 + "t" + " a" * 310]))
    assert ids(found) == [1]


def test_every_near_term_counts(spark, tmp_path):
    near = [f"thori{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    assert ids(catalog.QUERIES["match_prefix_or_fuzzy"](spark, docs(spark, tmp_path, ["idiom", *near, "other"]))) == list(range(65))
