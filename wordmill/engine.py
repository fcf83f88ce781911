"""The search engine over an index: boolean search, ranking, suggestions, highlighting and explanations."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import QueryTooLong, TooManyTerms
from .functions import pieces, pinyin, similarity
from .operators import highlight, rank
from .operators.index import Index
from .options import Bm25Params, HighlighterConfig, Limits, SearchOptions
from .plans import query as q
from .plans.compile import REASON, Matcher, reason

MAX_QUERY_CHARS, MAX_QUERY_TERMS, CACHED_RESULTS, CACHED_EXPANSIONS = 512, 64, 128, 256
BREAKDOWN = ("bm25", "proximity", "coverage", "phrase", "pinyin", "total")
RESULT = (
    "doc_id long, score double, document string, snippet string, match_positions array<struct<start:int,end:int>>, "
    "matched_terms array<string>, score_breakdown struct<bm25:double,proximity:double,coverage:double,phrase:double,pinyin:double,total:double>, "
    f"match_reasons {REASON}"
)
RELATED = "term string, score double, doc_frequency long, total_frequency long, source_doc_ids array<long>"


class Engine:
    """Every mutation makes a new index snapshot and forgets cached results."""

    def __init__(self, spark: SparkSession, bm25: Bm25Params = Bm25Params(), highlighter: HighlighterConfig = HighlighterConfig(), limits: Limits = Limits(), fuzzy_distance: int = 2):
        self.spark, self.bm25, self.highlighter, self.limits = spark, bm25, highlighter, limits
        self.parser = q.QueryParser(fuzzy_distance)
        self.index = Index(spark.createDataFrame([], "doc_id long, text string"))
        self._results: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._expanded: OrderedDict[tuple, list[str]] = OrderedDict()

    @classmethod
    def from_df(cls, df: DataFrame, text: str | Column | None = None, key: str = "doc_id", **settings) -> Engine:
        engine = cls(df.sparkSession, **settings)
        engine.index = Index.build(df, text, key)
        return engine

    # Maintenance

    def _set(self, index: Index) -> None:
        self.index = index
        self.clear_cache()

    def index_text(self, text: str) -> int:
        index, new = self.index.add_text(text)
        self._set(index)
        return new

    def index_batch(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        last = self.index.docs.agg(F.max("doc_id")).first()[0]
        first = 0 if last is None else last + 1
        ids = list(range(first, first + len(texts)))
        self._set(self.index.add(self.spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")))
        return ids

    def add(self, df: DataFrame, text: str | Column | None = None, key: str = "doc_id") -> None:
        self._set(self.index.add(df, text, key))

    def remove(self, doc_id: int) -> bool:
        if self.index.docs.where(F.col("doc_id") == doc_id).isEmpty():
            return False
        self._set(self.index.remove([doc_id]))
        return True

    def clear(self) -> None:
        self._set(self.index.clear())

    def reindex(self, df: DataFrame, text: str | Column | None = None, key: str = "doc_id") -> None:
        built = Index.build(df, text, key)
        built.generation = self.index.generation + 1
        self._set(built)

    def clear_cache(self) -> None:
        for df in self._results.values():
            df.unpersist()
        self._results.clear()
        self._expanded.clear()

    def doc_count(self) -> int:
        return self.index.doc_count()

    def get_document(self, doc_id: int) -> str | None:
        return self.index.get_document(doc_id)

    def doc_ids(self) -> DataFrame:
        return self.index.doc_ids()

    def term_statistics(self, term: str) -> tuple[int, int] | None:
        return self.index.term_statistics(term)

    # Search

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Rows of RESULT, best first; ties by doc_id."""
        key = (self.index.generation, query, options)
        if options.enable_cache and key in self._results:
            self._results.move_to_end(key)
            return self._results[key]
        found = self._search(query, options)
        if options.enable_cache:
            self._remember(key, found.persist())
        return found

    def _remember(self, key: tuple, table: DataFrame) -> None:
        self._results[key] = table
        if len(self._results) > CACHED_RESULTS:
            self._results.popitem(last=False)[1].unpersist()

    def rank(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Only (doc_id, score) of the search: the texts of the returned documents are not read again."""
        plan = self._plan(query, options)
        if plan is None:
            return self.spark.createDataFrame([], "doc_id long, score double")
        return self._scored(plan, self._matched([plan])).select("doc_id", "score")

    def breakdown(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """(doc_id, score_breakdown) of the search, likewise without the texts."""
        plan = self._plan(query, options)
        if plan is None:
            return self.spark.createDataFrame([], RESULT).select("doc_id", "score_breakdown")
        return self._scored(plan, self._matched([plan])).select("doc_id", _parts().alias("score_breakdown"))

    def search_pinyin(self, query: str) -> DataFrame:
        return self.search(query, SearchOptions(use_pinyin=True))

    def search_fuzzy(self, query: str, max_distance: int) -> DataFrame:
        return self.search(query, SearchOptions(fuzzy=True, max_edit_distance=max_distance))

    def search_phrase(self, phrase: str) -> DataFrame:
        return self.search(f'"{phrase}"')

    def batch_search(self, queries: list[str], options: SearchOptions = SearchOptions()) -> DataFrame:
        """(query_id, query, results' columns). All queries share one pass over the tokens: their terms are looked up
        together and each query's plan reads the same shuffle. The first refused query raises its error."""
        plans = [self._plan(x, options) for x in queries]
        live = [p for p in plans if p is not None]
        if not live:
            return self.spark.createDataFrame([], "query_id int, query string, " + RESULT)
        base = self._matched(live)
        parts = [
            self._finish(p, self._scored(p, base)).select(F.lit(k).alias("query_id"), F.lit(queries[k]).alias("query"), "*")
            for k, p in enumerate(plans)
            if p is not None
        ]
        return reduce(DataFrame.unionByName, parts)

    def _search(self, query: str, options: SearchOptions) -> DataFrame:
        plan = self._plan(query, options)
        if plan is None:
            return self.spark.createDataFrame([], RESULT)
        return self._finish(plan, self._scored(plan, self._matched([plan], True)))

    def _plan(self, query: str, options: SearchOptions) -> _Plan | None:
        """What the driver decides: the tree, its terms and their expansions. None if nothing can match."""
        if len(query) > MAX_QUERY_CHARS:
            raise QueryTooLong(MAX_QUERY_CHARS, len(query))
        parsed = self.parser.parse(query)
        expand = self._prefix_terms
        include = q.include_terms(parsed.root, expand)
        if max(len(include), len(q.exclude_terms(parsed.root, expand))) > MAX_QUERY_TERMS:
            raise TooManyTerms(MAX_QUERY_TERMS)
        use_pinyin = options.use_pinyin or parsed.use_pinyin
        if not include and not use_pinyin:
            return None
        text = query
        if not options.strict_compat and parsed.use_pinyin:
            text = query.strip().split(":", 1)[1].strip()
        wanted = []
        for leaf in _evaluated(parsed.root):
            if isinstance(leaf, q.Fuzzy):
                wanted.append((leaf.term, leaf.distance))
            elif isinstance(leaf, q.Term) and options.fuzzy:
                wanted.append((leaf.term, options.max_edit_distance))
        expansions = self._expand(wanted)
        near = sorted({t for e in expansions.values() for t in e} - set(include))
        scores = options.fuzzy or (not options.strict_compat and bool(expansions))
        scoring = include + (near if scores else [])
        names = sorted({t for leaf in q.leaves(parsed.root) for t in q._terms_of(leaf, expand, True)} | set(near) | set(include))
        prefixes = sorted({leaf.prefix for leaf in q.leaves(parsed.root) if isinstance(leaf, q.Prefix)})
        return _Plan(query, text, options, parsed.root, include, scoring, expansions, use_pinyin, names, prefixes)

    def _prefix_terms(self, prefix: str) -> list[str]:
        # one more than the limit is enough to refuse the query
        key = (self.index.generation, prefix, "prefix")
        if key not in self._expanded:
            rows = self.index.terms_with_prefix(prefix, MAX_QUERY_TERMS + 1).collect()
            self._keep(key, [r.term for r in rows])
        return self._expanded[key]

    def _expand(self, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], list[str]]:
        """Index terms near each (term, distance), the best 32: one pass over the vocabulary for each distance."""
        wanted = [k for k in dict.fromkeys(wanted) if k[1] > 0]
        lacking = [k for k in wanted if (self.index.generation, *k) not in self._expanded]
        for distance in sorted({d for _, d in lacking}):
            for term, near in self.near_terms([t for t, d in lacking if d == distance], distance, self.limits.vocabulary).items():
                self._keep((self.index.generation, term, distance), near)
        return {k: self._expanded.get((self.index.generation, *k), []) for k in wanted}

    def _keep(self, key: tuple, terms: list[str]) -> None:
        self._expanded[key] = terms
        if len(self._expanded) > CACHED_EXPANSIONS:
            self._expanded.popitem(last=False)

    def _sounding(self, plans: list[_Plan]) -> DataFrame | None:
        """(term, read): index terms whose reading holds a plan's text, and which texts: a table, joined to the tokens."""
        parts = [pinyin.search_by_pinyin_detailed(self.pinyin_terms, p.text, not p.options.strict_compat).select("term", F.lit(p.text).alias("text")) for p in plans if p.pinyin]
        if not parts:
            return None
        return reduce(DataFrame.union, parts).groupBy("term").agg(F.sort_array(F.collect_set("text")).alias("read"))

    def _hits(self, plans: list[_Plan], text: bool) -> DataFrame:
        """Documents with any relevant term: from the texts in one narrow pass, or from the saved postings."""
        if not self.index.saved:
            names, prefixes = ({x for p in plans for x in getattr(p, part)} for part in ("names", "prefixes"))
            sounds = sorted({(p.text, not p.options.strict_compat) for p in plans if p.pinyin})
            return self.index.scan(sorted(names), sorted(prefixes), sounds, text)
        hits = self.index.hits(reduce(lambda a, b: a | b, [p.relevant for p in plans]), self._sounding(plans))
        if any(p.pinyin for p in plans):
            said = self.index.docs.select("doc_id", pinyin.readings(self.spark, F.col("text")).alias("reading"))
            hits = hits.join(said, "doc_id")
        return hits

    def _matched(self, plans: list[_Plan], text: bool = False) -> DataFrame:
        """Documents with any relevant term, their entries, and the corpus figures that scores need."""
        if len(plans) > 1:
            hits = counted = self._hits(plans, False).persist()
            self._remember(("hits", *[(p.query, p.options) for p in plans]), hits)
        else:
            hits, counted = self._hits(plans, text), self._hits(plans, False)
        scoring = F.array(*map(F.lit, sorted({t for p in plans for t in p.scoring}))).cast("array<string>")
        term = F.explode(F.array_intersect("entries.term", scoring)).alias("term")
        frequencies = counted.select(term).groupBy("term").agg(F.count("*").alias("df")).agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df_of"))
        n, average = self.index.figures()
        # a one-row table
        return hits.crossJoin(F.broadcast(frequencies)).withColumns({"doc_count": F.lit(n), "avg_doc_length": F.lit(average)})

    def _scored(self, plan: _Plan, base: DataFrame) -> DataFrame:
        matcher = plan.matcher()
        root = matcher.matches(plan.root)
        by_pinyin = F.array_contains("read", plan.text) if plan.pinyin else F.lit(False)
        base = base.withColumn("names", F.col("entries.term"))
        base = base.withColumn("at_map", F.map_from_entries("entries"))
        found = base.withColumns({"by_tree": root, "by_pinyin": by_pinyin}).where("by_tree OR by_pinyin")
        if self.limits.candidates is not None:
            found = found.orderBy("doc_id").limit(self.limits.candidates)
        wanted = F.array(*map(F.lit, plan.scoring)).cast("array<string>")
        found = found.withColumn("scoring", F.filter("entries", lambda e: F.array_contains(wanted, e["term"])))
        share = lambda e: rank.bm25_part(F.size(e["positions"]), F.element_at("df_of", e["term"]), F.col("dl"), F.col("doc_count"), F.col("avg_doc_length"), self.bm25)
        found = found.withColumn("bm25", F.aggregate("scoring", F.lit(0.0), lambda a, e: a + share(e)))
        found = found.withColumn("proximity", rank.proximity(F.col("scoring"), len(plan.scoring)) * rank.proximity_weight(F.col("bm25")))
        found = found.withColumn("coverage", rank.coverage(F.size("scoring"), len(plan.scoring), F.col("bm25")))
        phrase = F.lit(0.0)
        for terms in q.phrases(plan.root):
            phrase = phrase + F.when(rank.has_phrase(matcher.at, terms), 1.5 * len(terms)).otherwise(0.0)
        said = F.lit(False)
        if plan.pinyin:
            said = F.array_contains("spoken", plan.text) if "spoken" in base.columns else pinyin.pinyin_matches(F.col("reading"), plan.text)
        found = found.withColumns({"phrase": phrase, "said": said})
        found = found.withColumn("pinyin", F.when(F.col("said"), 2.0 + F.col("bm25") * 0.1).otherwise(0.0))
        total = F.col("bm25") + F.col("proximity") + F.col("coverage") + F.col("phrase") + F.col("pinyin")
        ranked = found.withColumn("score", total).where("score > 0")
        # copies of a document tie: the order is by the score to six digits and then by doc_id
        ranked = ranked.orderBy(F.desc(F.round("score", 6)), "doc_id")
        return ranked if plan.options.limit is None else ranked.limit(plan.options.limit)

    def _finish(self, plan: _Plan, best: DataFrame) -> DataFrame:
        """Text, positions, snippet and reasons of the rows that are returned: ``limit`` of them, if there is one."""
        options = plan.options
        reasons = F.lit(None).cast(REASON)
        if options.explain:
            reasons = self._reasons(plan)
        breakdown = _parts() if options.explain else F.lit(None).cast(f"struct<{','.join(f'{c}:double' for c in BREAKDOWN)}>")
        text = ["text"] if "text" in best.columns else []
        joined = best.select("doc_id", "score", "names", breakdown.alias("score_breakdown"), reasons.alias("match_reasons"), *text)
        if not text:
            # with a limit the returned rows are the small side, whatever the size of the index
            joined = self.index.docs.join(F.broadcast(joined) if options.limit is not None else joined, "doc_id")
        near = self.near_terms(plan.scoring, plan.options.max_edit_distance) if options.fuzzy else None
        out = pieces.spans(joined, plan.scoring, near)
        wanted = F.array(*map(F.lit, plan.scoring)).cast("array<string>")
        out = out.withColumns({"positions": F.col("spans"), "matched": F.array_intersect(wanted, "names")})
        if options.fuzzy:
            # places of the expansions of those scoring terms that a document doesn't have
            out = out.withColumn("positions", F.array_sort(F.array_union("positions", "more_spans")))
            out = out.withColumn("matched", F.array_union("matched", "more_terms"))
        snippet = highlight.wrap(F.col("text"), F.col("merged"), self.highlighter) if options.highlight else F.lit(None).cast("string")
        return out.select(
            "doc_id",
            "score",
            F.col("text").alias("document"),
            snippet.alias("snippet"),
            F.col("positions").alias("match_positions"),
            F.array_sort("matched").alias("matched_terms"),
            "score_breakdown",
            "match_reasons",
        ).orderBy(F.desc(F.round("score", 6)), "doc_id")

    def near_terms(self, terms: list[str], distance: int, vocabulary: int | None = None) -> dict[str, list[str]]:
        """The best 32 index terms within the distance of each term, ties by term: one join on a band of lengths."""
        if not terms:
            return {}
        asked = self.spark.createDataFrame([(t,) for t in terms], "of string")
        most = min(distance, similarity.MOST_EDITS)
        words = self.index.vocabulary
        if vocabulary is not None:
            words = words.orderBy("term").limit(vocabulary)
        size, n = F.char_length("term"), F.char_length("of")
        # a query has at most a few hundred terms
        near = words.join(F.broadcast(asked), F.abs(size - n) <= most).withColumn("e", F.levenshtein("term", "of", most)).where("e >= 0")
        score = (1.0 - F.col("e") / F.lit(float(max(most, 1)))) * 0.7 + F.least(size, n) / F.greatest(size, n) * 0.3
        kept = near.withColumn("score", score)
        if self.limits.expansions is not None:
            by = Window.partitionBy("of").orderBy(F.desc("score"), "term")
            kept = kept.withColumn("k", F.row_number().over(by)).where(F.col("k") <= self.limits.expansions)
        found: dict[str, list[str]] = {t: [] for t in terms}
        for r in kept.select("of", "term", "score").orderBy("of", F.desc("score"), "term").collect():
            found[r.of].append(r.term)
        return found

    def _reasons(self, plan: _Plan) -> Column:
        parts = [F.when(F.col("said") | (F.col("by_pinyin") & ~F.col("by_tree")), reason("pinyin", f"document matched pinyin input '{plan.text}'", [plan.text]))]
        for name in ("phrase", "proximity", "coverage"):
            message = F.format_string(f"ranking bonus from {name}: %.4f", F.col(name))
            parts.append(F.when(F.col(name) > 0, reason("score", message, [name])))
        return F.concat(plan.matcher().reasons(plan.root), F.filter(F.array(*parts), lambda r: r.isNotNull()))

    def explain(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """The search with breakdowns and reasons."""
        return self.search(query, replace(options, explain=True))

    # Suggestions

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        """Terms with a prefix, those of most documents first."""
        p = prefix.lower()
        stats = self.index.document_frequencies(F.col("term").startswith(p))
        return stats.orderBy(F.desc("df"), "term").limit(limit).select("term")

    @property
    def pinyin_terms(self) -> DataFrame:
        return pinyin.pinyin_terms(self.index.vocabulary)

    def suggest_with_pinyin(self, prefix: str, limit: int = 10) -> DataFrame:
        """Suggestions and Chinese terms whose reading begins with the prefix, in order of the terms."""
        both = self.suggest(prefix).union(pinyin.search_by_pinyin(self.pinyin_terms, prefix))
        return both.distinct().orderBy("term").limit(limit)

    def suggest_related(self, query: str, limit: int = 8) -> DataFrame:
        """(term, score, doc_frequency, total_frequency, source_doc_ids): terms of the best documents, by the sum of
        document score x ln(1 + tf) x smoothed idf. Terms of the query itself are left out."""
        if limit == 0 or not query.strip():
            return self.spark.createDataFrame([], RELATED)
        own = set(q.include_terms(self.parser.parse(query).root, self._prefix_terms)) | set(q.query_terms(query))
        options = SearchOptions(fuzzy=True, use_pinyin=True, limit=min(max(limit * 3, 10), 50), enable_cache=False)
        best = self.rank(query, options)
        by = Window.orderBy(F.desc(F.round("score", 6)), "doc_id")  # over ``limit`` rows
        hits = best.withColumn("place", F.row_number().over(by))
        return self.related(hits, own, limit)

    def related(self, hits: DataFrame, own: set[str], limit: int) -> DataFrame:
        """Related terms of ranked ``hits(doc_id, score, place)``, 50 at most."""
        kept = is_related(F.col("term")) & ~F.col("term").isin(sorted(own))
        # only the texts of the hits are tokenized for their terms
        hits = self.spark.createDataFrame(hits.select("doc_id", "score", "place").collect(), "doc_id long, score double, place int")
        few = Index(self.index.docs.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi"))
        here = few.doc_tf.where(kept).join(F.broadcast(hits), "doc_id").select("doc_id", "term", "tf", "score", "place")
        stats = self.index.stats_of(here.select("term").distinct())
        rows = here.join(stats, "term").withColumn("doc_count", F.lit(self.index.figures()[0]))
        gain = F.col("score") * F.log1p(F.col("tf")) * (F.log((F.col("doc_count") + 1.0) / (F.greatest("df", F.lit(1)) + 1.0)) + 1.0)
        parts = F.sort_array(F.collect_list(F.struct("place", "doc_id", gain.alias("gain"))))
        found = rows.groupBy("term", "df", "total_tf").agg(parts.alias("parts"))
        total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["gain"])
        found = found.select("term", total.alias("score"), F.col("df").alias("doc_frequency"), F.col("total_tf").alias("total_frequency"), F.slice(F.col("parts.doc_id"), 1, 5).alias("source_doc_ids"))
        return found.where("score > 0").orderBy(F.desc(F.round("score", 6)), F.desc("doc_frequency"), "term").limit(limit)


def _parts() -> Column:
    return F.struct(*[F.col(c) for c in BREAKDOWN[:-1]], F.col("score").alias("total"))


def is_related(term: Column) -> Column:
    """No blank term, none of ASCII punctuation only, no single ASCII character."""
    return term.rlike(r"[^\s\p{Punct}]|[^\x00-\x7F]") & ~((F.char_length(F.trim(term)) == 1) & F.trim(term).rlike(r"^[\x00-\x7F]$"))


class _Plan:
    def __init__(self, query, text, options, root, include, scoring, expansions, use_pinyin, names, prefixes):
        self.query, self.text, self.options, self.root, self.include, self.scoring = query, text, options, root, include, scoring
        self.expansions, self.pinyin, self.names, self.prefixes = expansions, use_pinyin, names, prefixes

    @property
    def relevant(self) -> Column:
        found = F.col("term").isin(self.names) if self.names else F.lit(False)
        for prefix in self.prefixes:
            found = found | F.col("term").startswith(prefix)
        return found

    def matcher(self) -> Matcher:
        none = F.array().cast("array<int>")
        at = _Positions(lambda t: F.coalesce(F.try_element_at("at_map", F.lit(t)), none))
        return Matcher(F.col("names"), at, self.expansions, self.options.max_edit_distance if self.options.fuzzy else 0)


class _Positions(dict):
    """Positions by term, made when asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, term: str):
        return self.make(term)


def _evaluated(op):
    """Leaves that evaluation visits: under Not only beside other children of And."""
    if isinstance(op, q.And):
        for c in op.children:
            yield from _evaluated(c.child if isinstance(c, q.Not) else c)
    elif isinstance(op, q.Or):
        for c in op.children:
            if not isinstance(c, q.Not):
                yield from _evaluated(c)
    elif not isinstance(op, q.Not):
        yield op
