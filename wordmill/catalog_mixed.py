"""More of the engine as queries: a corpus of mixed Chinese and English, maintenance, options, formats and refusals.

No table holds Chinese. Two of three documents are spelled in it here, by the same replacement of letters in Spark and
in SQL: every run of letters becomes a run of Chinese characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _ALL, _ONCE, _STATS, _all_of, _any_of, _docs, _engine, _found, _index, _phrase_docs, _query, _scores, _search_sql, _top, _words
from .cluster import scratch
from .engine import Engine
from .errors import EngineError
from .functions import pinyin, similarity, tokenize
from .operators import highlight
from .operators.index import Index
from .options import Bm25Params, HighlighterConfig, Limits, SearchOptions
from .sources import tables, wire

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HAN = "中程上国是我爱京大安天首海言语编太市城北山人背门景阳"
_SOUND = dict(zip(_HAN, "zhong cheng shang guo shi wo ai jing da an tian shou hai yan yu bian tai shi cheng bei shan ren bei men jing yang".split(), strict=True))

_MIXED = f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 240)
  ELSE translate(lower(substr(text, 1, 120)), '{_LETTERS}', '{_HAN}') || ' ' || substr(text, 121, 120) END AS text FROM documents"""
#: Whole texts: those spelled in Chinese are so in their first half.
_WHOLE = f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE translate(lower(substr(text, 1, length(text) // 2)), '{_LETTERS}', '{_HAN}')
  || ' ' || substr(text, length(text) // 2 + 1) END AS text FROM documents"""
_ZTOK = f"""mixed AS ({_MIXED}),
zp AS (SELECT doc_id, i, p, stop - strlen(p) AS start FROM (SELECT *, sum(strlen(p)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
       SELECT doc_id, unnest(ps) AS p, unnest(generate_series(0, len(ps) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{tokenize.TILE}') AS ps FROM mixed)))
       WHERE NOT regexp_matches(p, '^[{tokenize.SPACE}]')),
zg AS (SELECT doc_id, i, 0 AS o, 0 AS k, CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN lower(p) ELSE p END AS term, start, start + strlen(p) AS stop,
         CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN 'English' WHEN regexp_matches(p, '^[0-9]') THEN 'Number' ELSE 'Symbol' END AS kind
       FROM zp WHERE NOT regexp_matches(p, '^[{tokenize.CJK}]')
       UNION ALL SELECT doc_id, i, o, k, substr(p, o + 1, k), start + strlen(substr(p, 1, o)), start + strlen(substr(p, 1, o + k)), 'Chinese'
       FROM zp, generate_series(0, 400) a(o), generate_series(1, 4) b(k) WHERE regexp_matches(p, '^[{tokenize.CJK}]') AND o + k <= length(p)
       UNION ALL SELECT doc_id, i, 0, 99, p, start, start + strlen(p), 'Chinese' FROM zp WHERE regexp_matches(p, '^[{tokenize.CJK}]') AND length(p) > 4),
tok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, o, k) - 1 AS pos FROM zg)"""
_TOK_OLD = _STATS[len("WITH ") : _STATS.index(",\ndlen AS")]
_ZSTATS = _STATS.replace(_TOK_OLD, _ZTOK).replace("FROM documents d LEFT JOIN", "FROM mixed d LEFT JOIN")
_WSTATS = _ZSTATS.replace(_MIXED, _WHOLE).replace("generate_series(0, 400) a(o)", "unnest(generate_series(0, length(p) - 1)) a(o)")
_SOUNDS = "sounds AS (SELECT unnest(['" + "','".join(_SOUND) + "']) AS c, unnest(['" + "','".join(_SOUND.values()) + "']) AS s)"
_READ = f"""{_SOUNDS},
terms AS (SELECT term, string_agg(s, '' ORDER BY j) AS plain, string_agg(substr(s, 1, 1), '' ORDER BY j) AS initials FROM (
          SELECT term, unnest(string_split(term, '')) AS c, unnest(generate_series(1, length(term))) AS j FROM df
          WHERE regexp_matches(term, '^[{tokenize.CJK}]') AND length(term) <= 32) JOIN sounds USING (c) GROUP BY term),
spoken AS (SELECT doc_id, coalesce(string_agg(s, '' ORDER BY j), '') AS plain, coalesce(string_agg(substr(s, 1, 1), '' ORDER BY j), '') AS initials FROM (
          SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(generate_series(1, length(text))) AS j FROM mixed) LEFT JOIN sounds USING (c) GROUP BY doc_id)"""


def _mixed(spark, d) -> DataFrame:
    spelled = F.concat(F.translate(F.lower(F.substring("text", 1, 120)), _LETTERS, _HAN), F.lit(" "), F.substring("text", 121, 120))
    return _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 240)).otherwise(spelled).alias("text"))


def _whole(spark, d) -> DataFrame:
    half = F.floor(F.char_length("text") / 2).cast("int")
    spelled = F.concat(F.translate(F.lower(F.substring("text", F.lit(1), half)), _LETTERS, _HAN), F.lit(" "), F.substring("text", half + 1, F.char_length("text")))
    return _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(spelled).alias("text"))


def _mixed_engine(spark, d, **settings) -> Engine:
    return Engine.from_df(_mixed(spark, d), **settings)


# Chinese: tokens, statistics, search


@_query(f"""WITH {_ZTOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, term, kind, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end" FROM tok""")
def mixed_tokens(spark, d):
    return tokenize.tokens(_mixed(spark, d))


@_query(f"WITH {_ZTOK} SELECT doc_id, pos, term FROM tok")
def mixed_terms(spark, d):
    return Index.build(_mixed(spark, d)).occurrences.select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


@_query(f"""WITH mixed AS ({_MIXED}) SELECT doc_id, kind, count(*) AS n FROM (
SELECT doc_id, CASE WHEN regexp_matches(c, '^[{tokenize.CJK}]') THEN 'Chinese' WHEN regexp_matches(c, '^\\p{{L}}') THEN 'English'
       WHEN regexp_matches(c, '^\\p{{N}}') THEN 'Number' ELSE 'Symbol' END AS kind
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^{tokenize.SPACE}]')) AS c FROM mixed)) GROUP BY doc_id, kind""")
def mixed_chars(spark, d):
    return tokenize.count_chars(_mixed(spark, d))


@_query(f"SELECT doc_id, regexp_matches(text, '[{tokenize.CJK}]') AS chinese FROM ({_MIXED})")
def mixed_contains_chinese(spark, d):
    return _mixed(spark, d).select("doc_id", tokenize.contains_chinese(F.col("text")).alias("chinese"))


@_query(f"{_ZSTATS} SELECT term, df, total_tf FROM df")
def mixed_term_stats(spark, d):
    return Index.build(_mixed(spark, d)).term_stats


@_query(f"""WITH {_ZTOK} SELECT term, count(*) AS n FROM (SELECT doc_id, term FROM tok
UNION ALL SELECT a.doc_id, a.term || b.term FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1) GROUP BY term""")
def mixed_ngrams(spark, d):
    return tokenize.count_ngrams(_mixed(spark, d), 2)


@_query(f"{_WSTATS} {_all_of(['北', '京'])}")
def match_characters(spark, d):
    return Engine.from_df(_whole(spark, d)).rank("北京", _ALL).select("doc_id")


@_query(f"{_ZSTATS} ({_all_of(['of', '北', '北京', '京'])}) UNION ({_all_of(['o', 'f', '北', '京'])})")
def match_mixed_words(spark, d):
    return _mixed_engine(spark, d).rank("of 北京", _ALL).select("doc_id")


@_query(_search_sql(["京", "北", "北京"], _all_of(["北", "京"])).replace(_STATS, _ZSTATS))
def search_chinese(spark, d):
    return _found(_mixed_engine(spark, d).search("北京", _ONCE))


_RUN_END = """SELECT x.doc_id FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 JOIN tok z ON x.doc_id = z.doc_id AND z.pos = x.pos + 2
WHERE x.term = '北' AND y.term = '北京' AND z.term = '京'"""


@_query(_search_sql(["京", "北", "北京"], _RUN_END, "4.5").replace(_STATS, _ZSTATS))
def search_chinese_phrase(spark, d):
    """Tokens of a run overlap, so a phrase of two characters is found at the end of runs."""
    return _found(_mixed_engine(spark, d).search('"北京"', _ONCE))


@_query(f"SELECT doc_id, replace(text, '北京', '<b>北京</b>') AS highlighted FROM ({_MIXED}) WHERE contains(text, '北京')")
def highlight_chinese(spark, d):
    found = highlight.highlight(_mixed(spark, d), ["北京"], HighlighterConfig("<b>", "</b>"))
    return found.select("doc_id", "highlighted")


@_query(f"{_ZSTATS} SELECT term FROM df WHERE starts_with(term, '北') ORDER BY df DESC, term LIMIT 10")
def suggest_chinese(spark, d):
    return _mixed_engine(spark, d).suggest("北")


# Pinyin


@_query(f"WITH mixed AS ({_MIXED}), df AS (SELECT '' AS term), {_READ} SELECT doc_id, plain, initials FROM spoken")
def pinyin_readings(spark, d):
    return _mixed(spark, d).select("doc_id", pinyin.readings(spark, F.col("text")).alias("r")).select("doc_id", "r.plain", "r.initials")


@_query(f"WITH mixed AS ({_MIXED}), df AS (SELECT '' AS term), {_READ} SELECT doc_id, contains(plain, 'beijingshi') OR contains(initials, 'beijingshi') AS said FROM spoken")
def pinyin_matches(spark, d):
    return _mixed(spark, d).select("doc_id", pinyin.pinyin_matches(pinyin.readings(spark, F.col("text")), "Bei Jing Shi").alias("said"))


@_query(f"{_ZSTATS}, {_READ} SELECT term, plain, initials FROM terms WHERE plain <> ''")
def pinyin_terms(spark, d):
    return pinyin.pinyin_terms(Index.build(_mixed(spark, d)).vocabulary)


@_query(f"{_ZSTATS}, {_READ} SELECT term FROM terms WHERE starts_with(plain, 'beijing') OR starts_with(initials, 'beijing')")
def search_by_pinyin(spark, d):
    return pinyin.search_by_pinyin(_mixed_engine(spark, d).pinyin_terms, "beijing")


@_query(f"{_ZSTATS}, {_READ} SELECT term FROM terms WHERE starts_with(plain, 'bj') OR starts_with(initials, 'bj')")
def search_by_initials(spark, d):
    return pinyin.search_by_pinyin(_mixed_engine(spark, d).pinyin_terms, "bj")


@_query(f"{_ZSTATS}, {_READ} SELECT term, plain FROM terms WHERE contains(plain, 'gshizh')")
def search_by_pinyin_detailed(spark, d):
    return pinyin.search_by_pinyin_detailed(_mixed_engine(spark, d).pinyin_terms, "gshizh")


@_query(f"""{_ZSTATS}, {_READ}, hit AS (SELECT DISTINCT doc_id FROM tf WHERE term IN (SELECT term FROM terms WHERE contains(plain, 'jingshi')))
SELECT doc_id, CAST(2.0 AS DOUBLE) AS score FROM hit JOIN spoken USING (doc_id) WHERE contains(plain, 'jingshi') ORDER BY doc_id LIMIT 20""")
def search_pinyin_chinese(spark, d):
    return _found(_mixed_engine(spark, d).search_pinyin("jingshi"))


@_query(f"""{_ZSTATS}, {_READ} SELECT term FROM (SELECT term FROM (SELECT term FROM df WHERE starts_with(term, 'bei') ORDER BY df DESC, term LIMIT 10)
UNION SELECT term FROM terms WHERE starts_with(plain, 'bei') OR starts_with(initials, 'bei')) ORDER BY term LIMIT 10""")
def suggest_by_pinyin(spark, d):
    return _mixed_engine(spark, d).suggest_with_pinyin("bei")


@_query(f"""{_ZSTATS}, {_READ}, hit AS (SELECT DISTINCT doc_id FROM tf WHERE term IN (SELECT term FROM terms WHERE contains(plain, 'jingshi')))
SELECT doc_id, 'pinyin:document matched pinyin input ''jingshi''' AS reasons FROM hit JOIN spoken USING (doc_id) WHERE contains(plain, 'jingshi') ORDER BY doc_id LIMIT 20""")
def explain_pinyin(spark, d):
    return _reasons(_mixed_engine(spark, d).explain("jingshi", SearchOptions(use_pinyin=True, enable_cache=False)))


def _reasons(hits: DataFrame) -> DataFrame:
    """Reasons without the bonuses of the ranking."""
    kept = F.filter("match_reasons", lambda r: r["code"] != "score")
    return hits.select("doc_id", F.array_join(F.transform(kept, lambda r: F.concat_ws(":", r["code"], r["message"])), "|").alias("reasons"))


# The query language


def _near_sql(term: str, most: int, best: int | None = 32) -> str:
    n = len(term)
    score = f"round(0.7 * (1 - e / {most}.0) + 0.3 * least(length(term), {n}) / greatest(length(term), {n}), 9)"
    order = f" ORDER BY {score} DESC, term LIMIT {best}" if best else ""
    return f"SELECT term FROM (SELECT term, levenshtein(term, '{term}') AS e FROM df WHERE abs(length(term) - {n}) <= {most} AND regexp_matches(term, '^[ -~]+$')) WHERE e <= {most}{order}"


@_query(f"{_STATS}, near AS ({_near_sql('thorin', 1)}) SELECT DISTINCT doc_id FROM tf WHERE term = 'thorin' OR term IN (SELECT term FROM near)")
def match_fuzzy_term(spark, d):
    return _engine(spark, d).rank("thorin~1", SearchOptions(limit=None, strict_compat=False)).select("doc_id")


@_query(f"{_STATS} SELECT doc_id FROM tf WHERE term = 'the' EXCEPT SELECT doc_id FROM tf WHERE term = 'of'")
def match_fuzzy_strict(spark, d):
    """Expansions find documents but only the term itself scores, and a score of 0 is no hit."""
    return _engine(spark, d).rank("the~1 -of", _ALL).select("doc_id")


@_query(f"{_STATS}, near AS ({_near_sql('thorin', 2, None)}) SELECT DISTINCT doc_id FROM tf WHERE starts_with(term, 'idio') OR term = 'thorin' OR term IN (SELECT term FROM near)")
def match_prefix_or_fuzzy(spark, d):
    """Every term within two edits counts, not only the best 32."""
    engine = Engine.from_df(_docs(spark, d), limits=Limits(expansions=None))
    return engine.rank("idio* OR thorin~", SearchOptions(limit=None, strict_compat=False)).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE false")
def match_not_alone(spark, d):
    return _engine(spark, d).rank("-the", _ALL).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE false")
def match_blank(spark, d):
    return _engine(spark, d).search("  \t ", _ONCE).select("doc_id")


@_query(f"{_STATS} SELECT doc_id FROM tf WHERE term = 'the' ORDER BY doc_id LIMIT 50")
def match_with_limits(spark, d):
    return Engine.from_df(_docs(spark, d), limits=Limits(candidates=50)).rank("the", _ALL).select("doc_id")


_BAD = {"long": "a" * 600, "many": " ".join(f"w{k}" for k in range(70)), "excluded": "a -" + " ".join(f"w{k}" for k in range(70)), "fine": "the of"}


@_query(
    """SELECT * FROM (VALUES ('long', 'QueryTooLong: query has 600 characters; at most 512 are allowed'), ('many', 'TooManyTerms: query has more than 64 terms'),
('excluded', 'TooManyTerms: query has more than 64 terms'), ('fine', '')) t(query, error)"""
)
def refused_queries(spark, d):
    rows = []
    for name, text in _BAD.items():
        try:
            _engine(spark, d)._plan(text, _ONCE)
            rows.append((name, ""))
        except EngineError as e:
            rows.append((name, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "query string, error string")


# Explanations

_CONTAINS = "'|term:document contains term ''{0}'''"


@_query(
    f"""{_STATS}, {_scores(['ting', 'tion'], _any_of(['ting', 'tion']))}, top AS ({_top()}), has AS (SELECT doc_id, list(term) AS ts FROM tf WHERE term IN ('ting', 'tion') GROUP BY doc_id)
SELECT doc_id, 'or:document satisfies at least one OR branch' || CASE WHEN list_contains(ts, 'ting') THEN {_CONTAINS.format('ting')} ELSE '' END
  || CASE WHEN list_contains(ts, 'tion') THEN {_CONTAINS.format('tion')} ELSE '' END AS reasons FROM top JOIN has USING (doc_id)"""
)
def explain_or(spark, d):
    return _reasons(_engine(spark, d).explain("ting OR tion", _ONCE))


@_query(
    f"""{_STATS}, {_scores(['the'], "SELECT doc_id FROM tf WHERE term = 'the' EXCEPT SELECT doc_id FROM tf WHERE term = 'of'")}, top AS ({_top()})
SELECT doc_id, 'and:document satisfies AND of 1 clauses|term:document contains term ''the''|not:document does not match excluded terms: of' AS reasons FROM top"""
)
def explain_not(spark, d):
    return _reasons(_engine(spark, d).explain("the -of", _ONCE))


@_query(
    f"""{_STATS}, {_scores(['of', 'the'], _phrase_docs('of', 'the'), '3.0')}, top AS ({_top()})
SELECT doc_id, 'phrase:document contains consecutive phrase ''of the''' AS reasons FROM top"""
)
def explain_phrase(spark, d):
    return _reasons(_engine(spark, d).explain('"of the"', _ONCE))


@_query(f"""{_STATS} SELECT DISTINCT doc_id, 'prefix:document matches prefix ''idio''' AS reasons FROM tf WHERE starts_with(term, 'idio')""")
def explain_prefix(spark, d):
    return _reasons(_engine(spark, d).explain("idio*", _ALL))


@_query(
    f"""{_STATS}, near AS ({_near_sql('thorin', 1)}), hit AS (SELECT doc_id, list(term) AS ts FROM tf WHERE term = 'thorin' OR term IN (SELECT term FROM near) GROUP BY doc_id)
SELECT doc_id, CASE WHEN list_contains(ts, 'thorin') THEN 'term:document contains term ''thorin''' ELSE
  array_to_string(list_transform(list_sort(ts), lambda t: 'fuzzy:fuzzy match: ''thorin'' matched index term ''' || t || ''''), '|') END AS reasons FROM hit"""
)
def explain_fuzzy(spark, d):
    hits = _engine(spark, d).explain("thorin~1", SearchOptions(limit=None, strict_compat=False, enable_cache=False))
    kept = F.array_sort(F.filter("match_reasons", lambda r: r["code"] != "score"))
    return hits.select("doc_id", F.array_join(F.transform(kept, lambda r: F.concat_ws(":", r["code"], r["message"])), "|").alias("reasons"))


# Similarity and related terms

_PARTS = sorted({"".join(c for k, c in enumerate("therein") if m >> k & 1) for m in range(1, 128)})


@_query(
    f"""{_STATS}, w AS (SELECT term FROM df WHERE regexp_matches(term, '^the[a-z]*$')), s AS (SELECT unnest(['{"','".join(_PARTS)}']) AS part)
SELECT term, round(max(length(part)) / greatest(length(term), 7), 6) AS similarity FROM w, s
WHERE term LIKE '%' || array_to_string(string_split(part, ''), '%') || '%' GROUP BY term"""
)
def lcs_similarity(spark, d):
    return _words(spark, d).select("term", F.round(similarity.lcs_similarity("term", F.lit("therein")), 6).alias("similarity"))


@_query(
    f"""{_STATS}, near0 AS ({_near_sql('thorin', 2)}), near1 AS ({_near_sql('wither', 2)}), q AS (SELECT term FROM near0 UNION SELECT term FROM near1 UNION SELECT 'thorin' UNION SELECT 'wither'),
hit AS (SELECT doc_id FROM tf WHERE term IN (SELECT term FROM near0) OR term = 'thorin' INTERSECT SELECT doc_id FROM tf WHERE term IN (SELECT term FROM near1) OR term = 'wither'),
b AS (SELECT doc_id, count(*) AS matched, sum(ln(1 + (n + 0.5 - df) / (0.5 + df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
      FROM tf JOIN df USING (term) JOIN dlen USING (doc_id) CROSS JOIN corpus WHERE term IN (SELECT term FROM q) AND doc_id IN (SELECT doc_id FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, bm25 + matched / (SELECT count(*) FROM q) * bm25 * 0.2 AS hit, row_number() OVER (ORDER BY round(bm25 + matched / (SELECT count(*) FROM q) * bm25 * 0.2, 6) DESC, doc_id) AS place FROM b),
r AS (SELECT term, sum(hit * ln(1 + tf) * (ln((n + 1) / (df + 1)) + 1)) AS score, df AS doc_frequency, total_tf AS total_frequency, array_to_string(list(doc_id ORDER BY place)[1:5], ' ') AS source_doc_ids
      FROM (SELECT * FROM t WHERE place <= 30) JOIN tf USING (doc_id) JOIN df USING (term) CROSS JOIN corpus
      WHERE term NOT IN ('thorin', 'wither') AND NOT regexp_matches(term, '^[!-/:-@\\[-`{{-~]+$') AND NOT regexp_matches(term, '^[ -~]$') GROUP BY term, df, total_tf)
SELECT term, round(score, 6) AS score, doc_frequency, total_frequency, source_doc_ids FROM r ORDER BY 2 DESC, doc_frequency DESC, term LIMIT 10"""
)
def suggest_related(spark, d):
    found = _engine(spark, d).suggest_related("thorin wither", 10)
    return found.withColumn("score", F.round("score", 6)).withColumn("source_doc_ids", F.array_join(F.col("source_doc_ids").cast("array<string>"), " "))


# Maintenance and accessors


@_query("SELECT CAST(0 AS BIGINT) AS doc_count, CAST(0 AS BIGINT) AS total_tokens, CAST(0 AS DOUBLE) AS avg_doc_length")
def cleared(spark, d):
    engine = _engine(spark, d)
    engine.clear()
    return engine.index.corpus


@_query("SELECT doc_id FROM documents")
def doc_ids(spark, d):
    return _engine(spark, d).doc_ids()


@_query("SELECT (SELECT count(*) FROM documents) AS doc_count, (SELECT text FROM documents WHERE doc_id = 5) AS fifth, CAST(NULL AS VARCHAR) AS missing")
def get_document(spark, d):
    engine = _engine(spark, d)
    return spark.createDataFrame([(engine.doc_count(), engine.get_document(5), engine.get_document(-1))], "doc_count long, fifth string, missing string")


@_query(f"{_STATS} SELECT df, total_tf FROM df WHERE term = 'the'")
def term_statistics(spark, d):
    return spark.createDataFrame([_engine(spark, d).term_statistics("the")], "df long, total_tf long")


@_query(f"{_STATS.replace('FROM documents', 'FROM (SELECT item_id AS doc_id, text FROM benchmark)')} SELECT term, df, total_tf FROM df")
def reindexed(spark, d):
    engine = _engine(spark, d)
    engine.reindex(spark.read.parquet(f"{d}/benchmark.parquet"), key="item_id")
    return engine.index.term_stats


@_query(
    """SELECT * FROM (SELECT max(doc_id) + 1 AS doc_id, 'zebra one' AS text FROM documents UNION ALL SELECT max(doc_id) + 2, 'zebra two' FROM documents
UNION ALL SELECT max(doc_id) + 3, 'zebra three' FROM documents) WHERE text <> 'zebra two'"""
)
def index_and_remove(spark, d):
    """Three documents are added under the next ids, one of them goes again; cached results go with each change."""
    engine = _engine(spark, d)
    engine.index_text("zebra one")
    two, _ = engine.index_batch(["zebra two", "zebra three"])
    engine.search("zebra").count()
    assert engine.remove(two) and not engine.remove(-7)
    return engine.search("zebra").select("doc_id", F.col("document").alias("text"))


@_query(_search_sql(["of", "the"], _all_of(["of", "the"])))
def search_cached(spark, d):
    engine = _engine(spark, d)
    first = engine.search("the of")
    assert engine.search("the of") is first
    engine.clear_cache()
    return _found(engine.search("the of"))


@_query(_search_sql(["of", "the"], _all_of(["of", "the"])).replace("2.2", "2.5").replace("1.2 * (0.25 + 0.75", "1.5 * (0.6 + 0.4"))
def search_with_bm25_params(spark, d):
    return _found(Engine.from_df(_docs(spark, d), bm25=Bm25Params(1.5, 0.4)).search("the of", _ONCE))


@_query(
    f"""{_STATS}, {_scores(['idiot'], _any_of(['idiot']))}, top AS ({_top()})
SELECT doc_id, string_agg(CASE WHEN lower(p) = 'idiot' THEN '[' || p || ']' ELSE p END, '' ORDER BY i) AS snippet FROM (SELECT doc_id, unnest(ps) AS p, unnest(generate_series(0, len(ps) - 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{tokenize.TILE}') AS ps FROM documents WHERE doc_id IN (SELECT doc_id FROM top))) GROUP BY doc_id"""
)
def search_with_highlighter(spark, d):
    engine = Engine.from_df(_docs(spark, d), highlighter=HighlighterConfig("[", "]"))
    return engine.search("idiot", SearchOptions(highlight=True, enable_cache=False)).select("doc_id", "snippet")


# Sources


@_query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS text FROM nation")
def rows_as_json(spark, d):
    """Without a text column, a row's text is the row."""
    return Index.build(spark.read.parquet(f"{d}/nation.parquet"), key="n_nationkey").docs


@_query("SELECT fmt, CAST(p_partkey AS BIGINT) AS doc_id, p_name AS text FROM part, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(fmt) WHERE p_partkey < 100")
def read_formats(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").where("p_partkey < 100").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    out, parts = scratch(spark, "formats"), []
    for fmt in ("csv", "json", "orc", "parquet"):
        rows.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(f"{out}/{fmt}")
        read = tables.read_documents(spark, f"{out}/{fmt}", fmt, **({"header": "true"} if fmt == "csv" else {}))
        parts.append(Index.build(read).docs.select(F.lit(fmt).alias("fmt"), "doc_id", "text"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@_query("SELECT p_name AS text, count(*) AS n FROM part GROUP BY p_name")
def read_text_lines(spark, d):
    out = scratch(spark, "lines")
    spark.read.parquet(f"{d}/part.parquet").select("p_name").write.text(f"{out}/lines")
    return Index.build(tables.read_documents(spark, f"{out}/lines", "text")).docs.groupBy("text").agg(F.count("*").alias("n"))


@_query(
    f"""{_STATS}, {_scores(['idiot'], _any_of(['idiot']))}, top AS (SELECT doc_id, total FROM scored ORDER BY round(total, 6) DESC, doc_id LIMIT 20)
SELECT doc_id, ['idiot'] = ['idiot'] AS as_terms, true AS has_score, n_chars AS size FROM top JOIN documents USING (doc_id)"""
)
def results_as_json(spark, d):
    hits = _engine(spark, d).search("idiot", wire.options_from_json('{"explain": true, "enableCache": false, "unknown": 1}'))
    j = wire.results_to_json(hits).select(F.col("json"))
    get = lambda path: F.get_json_object("json", f"$.{path}")
    return j.select(
        get("docId").cast("long").alias("doc_id"),
        (get("matchedTerms") == '["idiot"]').alias("as_terms"),
        (F.round(get("scoreBreakdown.total").cast("double") - get("score").cast("double"), 9) == 0).alias("has_score"),
        F.char_length(get("document")).cast("long").alias("size"),
    )
