import pytest
from pyspark.sql import functions as F

from wordmill import catalog, catalog_mixed
from wordmill.engine import Engine
from wordmill.operators.index import Index, dense_ids
from wordmill.sources.tables import attach_documents, load_index, read_documents, save_index
from wordmill.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_saved_index_gives_the_same_results(spark, tmp_path):
    built = Index.build(spark.read.parquet(f"{SF}/documents.parquet"))
    save_index(built, f"{tmp_path}/i")
    saved = load_index(spark, f"{tmp_path}/i")
    assert rows(saved.term_stats) == rows(built.term_stats) and rows(saved.corpus) == rows(built.corpus)
    a, b = Engine(spark), Engine(spark)
    a.index, b.index = built, saved
    for query in ("the of", '"of the"', "th* -of OR idiot"):
        if "*" not in query:
            assert rows(a.search(query)) == rows(b.search(query))
    gone = saved.remove([0, 1]).add(spark.createDataFrame([(999, "the new")], "doc_id long, text string"))
    want = built.remove([0, 1]).add(spark.createDataFrame([(999, "the new")], "doc_id long, text string"))
    assert rows(gone.term_stats) == rows(want.term_stats) and gone.generation == 2


def test_term_filter_reaches_the_saved_table(spark, tmp_path):
    save_index(Index.build(spark.read.parquet(f"{SF}/documents.parquet")), f"{tmp_path}/i")
    hits = load_index(spark, f"{tmp_path}/i").hits(F.col("term").isin("the", "of"))
    assert "In(term, [of,the])" in hits._jdf.queryExecution().toString()


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello world"), (2, "more text")], "doc_id long, text string")
    df.write.json(f"{tmp_path}/j")
    df.write.option("header", True).csv(f"{tmp_path}/c")
    df.select("text").coalesce(1).write.text(f"{tmp_path}/t")
    assert rows(Index.build(read_documents(spark, f"{tmp_path}/j", "json")).docs) == rows(df)
    assert rows(Index.build(read_documents(spark, f"{tmp_path}/c", "csv", header=True)).docs) == rows(df)
    lines = Index.build(read_documents(spark, f"{tmp_path}/t", "text"))
    assert sorted(r.doc_id for r in lines.docs.collect()) == [0, 1]


def test_dense_ids_follow_the_rows(spark):
    df = spark.range(100).repartition(7)
    ids = [r.doc_id for r in dense_ids(df).collect()]
    assert ids == list(range(100))


def test_structured_documents(spark):
    df = spark.createDataFrame([(7, "Title", ["x", "y"])], "doc_id long, title string, tags array<string>")
    assert Index.build(df).get_document(7) == '{"title":"Title","tags":["x","y"]}'
    joined = Index.build(df, F.concat_ws("\n", "title", F.array_join("tags", " ")))
    assert joined.get_document(7) == "Title\nx y"
    found = attach_documents(Engine.from_df(df).search("title").select("doc_id", "score"), df).first()
    assert found.item.title == "Title"


def test_null_texts_are_left_out(spark):
    index = Index.build(spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string"))
    assert index.corpus.first().asDict() == {"doc_count": 2, "total_tokens": 1, "avg_doc_length": 0.5}
    assert index.clear().corpus.first().asDict() == {"doc_count": 0, "total_tokens": 0, "avg_doc_length": 0.0}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    docs.write.parquet(f"{tmp_path}/in")
    stream = ingest.read_stream(spark, f"{tmp_path}/in", "doc_id long, text string", maxFilesPerTrigger=1)
    ingest.ingest(stream, f"{tmp_path}/i", f"{tmp_path}/log", available_now=True).awaitTermination()
    assert rows(ingest.snapshot(spark, f"{tmp_path}/i").term_stats) == rows(Index.build(docs).term_stats)


def test_windowed_counts_of_a_stream(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:10' AS ts, 'a b a' AS text UNION ALL SELECT TIMESTAMP'2024-01-01 00:01:10', 'b'")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    counts = ingest.token_counts(stream, "ts", "1 minute", "10 minutes")
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window.start.minute, r.term, r["count"]) for r in spark.table("counted").collect()) == [(0, "a", 2), (0, "b", 1), (1, "b", 1)]


MIXED = ["mixed_tokens", "search_chinese", "match_mixed_words", "search_pinyin_chinese", "match_fuzzy_term", "refused_queries", "explain_or", "index_and_remove", "read_formats", "results_as_json"]


@pytest.mark.parametrize("name", ["search", "match_mixed", "term_stats", "batch_search", "related_terms", "merged_spans", "tfidf", "search_fuzzy", *MIXED])
def test_queries_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "lineitem", "benchmark", "part", "nation"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert order(got).equals(order(want))


def test_options_and_results_as_json(spark):
    from wordmill.options import SearchOptions
    from wordmill.sources import wire

    given = wire.options_from_json('{"fuzzy": true, "maxEditDistance": 1, "usePinyin": true, "limit": 5, "other": null}')
    assert given == SearchOptions(fuzzy=True, max_edit_distance=1, use_pinyin=True, limit=5)
    assert wire.options_from_json(wire.options_to_json(given)) == given and wire.options_from_json("") == SearchOptions()
    for bad in ("[]", '{"limit": "5"}', '{"limit": -1}', '{"fuzzy": 1}'):
        with pytest.raises(ValueError):
            wire.options_from_json(bad)
    engine = Engine(spark)
    engine.index_batch(["one two", "two"])
    got = wire.results_to_json(engine.search("one", SearchOptions(explain=True))).first().json
    assert got.startswith('{"docId":0,"score":') and '"matchPositions":[{"start":0,"end":3}]' in got and '"matchReasons":[{"code":"term"' in got and "snippet" not in got


def test_the_shared_folder_must_be_named_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from wordmill import cluster

    def session(master, **conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.rsplit(".", 2)[1], default)), sparkContext=SimpleNamespace(master=master, applicationId=str(tmp_path)))

    assert cluster.shared_dir(session("yarn", checkpoint=f"{tmp_path}/")) == str(tmp_path)
    assert cluster.shared_dir(session("local[2]")) == cluster.shared_dir(session("local"))
    with pytest.raises(ValueError):
        cluster.shared_dir(session("local-cluster[2,1,1024]"))


def test_entry_without_the_training_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert catalog_mixed and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
