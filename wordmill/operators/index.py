"""The index: documents, and the postings and statistics that follow from them. Snapshots are immutable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pieces, pinyin, tokenize

_POSTING = "term string, doc_id long, dl int, positions array<int>"


def dense_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Number the rows from 0 in their order, without gaps: one count for each partition, no shuffle."""
    marked = df.withColumn("__m", F.monotonically_increasing_id())
    counts = sorted(marked.groupBy(F.shiftright("__m", 33).alias("p")).count().toLocalIterator())
    start, total = [], 0
    for p, n in counts:
        start += [F.lit(p), F.lit(total)]
        total += n
    base = F.create_map(*start)[F.shiftright("__m", 33)] if start else F.lit(0)
    return marked.withColumn(name, F.col("__m").bitwiseAND((1 << 33) - 1) + base).drop("__m")


class Index:
    """``docs(doc_id, text)`` with lazily derived tables; a saved index reads its postings from a table sorted by term.

    Null texts are left out, empty ones count with no tokens."""

    def __init__(self, docs: DataFrame, postings: DataFrame | None = None, lengths: DataFrame | None = None, generation: int = 0):
        self.docs, self._postings, self._lengths, self.generation = docs, postings, lengths, generation
        self._figures: tuple[int, float] | None = None

    @classmethod
    def build(cls, df: DataFrame, text: str | Column | None = None, key: str = "doc_id") -> Index:
        """From any DataFrame: ``text`` is a column or expression, by default the column ``text``, or else the whole
        row as JSON; rows without a key column are numbered."""
        if key not in df.columns:
            df = dense_ids(df, key)
        if text is None:
            text = "text" if "text" in df.columns else F.to_json(F.struct(*[c for c in df.columns if c != key]))
        body = F.col(text) if isinstance(text, str) else text
        return cls(df.select(F.col(key).cast("long").alias("doc_id"), body.cast("string").alias("text")).where("text IS NOT NULL"))

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    @property
    def occurrences(self) -> DataFrame:
        """(doc_id, dl, pos, term): one row a token. Narrow: the length comes with each row, so no join is needed."""
        return pieces.occurrences(self.docs)

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, dl, positions), made where the text is. A filter on term reaches the pages of the saved table."""
        return pieces.postings(self.docs) if self._postings is None else self._postings

    @property
    def saved(self) -> bool:
        return self._postings is not None

    def hits(self, relevant: Column, also: DataFrame | None = None) -> DataFrame:
        """(doc_id, dl, entries, read): each document's relevant terms with their positions, by term: one shuffle of postings.

        ``also(term, read)`` are more relevant terms with marks, which the document's ``read`` collects."""
        rows = self.postings
        none = F.array().cast("array<string>")
        if also is not None:
            rows = rows.join(also, "term", "left").where(relevant | F.col("read").isNotNull())
        else:
            rows = rows.where(relevant).withColumn("read", F.lit(None).cast("array<string>"))
        rows = rows.repartition("doc_id")
        found = rows.groupBy("doc_id", "dl").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("entries"), F.collect_list("read").alias("read"))
        return found.withColumn("read", F.coalesce(F.array_distinct(F.flatten("read")), none))

    def scan(self, names: list[str], prefixes: list[str], sounds: list[tuple[str, bool]], text: bool) -> DataFrame:
        """``hits`` from the texts, without a shuffle, with the texts if asked for; see ``pieces.hits``."""
        return pieces.hits(self.docs, names, prefixes, sounds, pinyin.letters(self.spark) if sounds else {}, text)

    @property
    def lengths(self) -> DataFrame:
        return pieces.lengths(self.docs) if self._lengths is None else self._lengths

    @property
    def doc_tf(self) -> DataFrame:
        if self._postings is not None:
            return self._postings.select("doc_id", "term", F.size("positions").cast("long").alias("tf"))
        return pieces.frequencies(self.docs)

    @property
    def term_stats(self) -> DataFrame:
        """(term, df, total_tf). Terms are counted chunk by chunk where the texts are; the sums go by term."""
        if self._postings is not None:
            return self._postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions").cast("long")).alias("total_tf"))
        return pieces.counts(self.docs).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))

    @property
    def corpus(self) -> DataFrame:
        """One row: doc_count, total_tokens, avg_doc_length."""
        total = F.coalesce(F.sum("dl"), F.lit(0)).cast("long")
        n = F.count("*")
        avg = F.when(n > 0, total / n).otherwise(F.lit(0.0))
        return self.lengths.agg(n.alias("doc_count"), total.alias("total_tokens"), avg.alias("avg_doc_length"))

    def figures(self) -> tuple[int, float]:
        """(doc_count, avg_doc_length) of this snapshot, counted once: a snapshot never changes."""
        if self._figures is None:
            row = self.corpus.first()
            self._figures = (row.doc_count, row.avg_doc_length)
        return self._figures

    @property
    def tokens(self) -> DataFrame:
        return tokenize.tokens(self.docs)

    # Maintenance: each gives a new snapshot

    def add(self, df: DataFrame, text: str | Column | None = None, key: str = "doc_id") -> Index:
        more = Index.build(df, text, key)
        parts = (None, None)
        if self._postings is not None:
            parts = (self._postings.unionByName(more.postings), self.lengths.unionByName(more.lengths))
        return Index(self.docs.unionByName(more.docs), *parts, self.generation + 1)

    def add_text(self, text: str) -> tuple[Index, int]:
        """One document under the next free id."""
        last = self.docs.agg(F.max("doc_id")).first()[0]
        new = 0 if last is None else last + 1
        return self.add(self.spark.createDataFrame([(new, text)], "doc_id long, text string")), new

    def remove(self, ids: DataFrame | list[int]) -> Index:
        if not isinstance(ids, DataFrame):
            ids = F.broadcast(self.spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        drop = lambda df: df if df is None else df.join(ids, "doc_id", "left_anti").select(df.columns)
        return Index(drop(self.docs), drop(self._postings), drop(self._lengths), self.generation + 1)

    def clear(self) -> Index:
        return Index(self.docs.limit(0), generation=self.generation + 1)

    # Accessors

    def doc_count(self) -> int:
        return self.docs.count()

    def doc_ids(self) -> DataFrame:
        return self.docs.select("doc_id").orderBy("doc_id")

    def get_document(self, doc_id: int) -> str | None:
        row = self.docs.where(F.col("doc_id") == doc_id).first()
        return row.text if row else None

    def _only(self, doc_id: int) -> Index:
        return Index(self.docs.where(F.col("doc_id") == doc_id))

    def term_statistics(self, term: str) -> tuple[int, int] | None:
        row = self.term_stats.where(F.col("term") == term).first()
        return (row.df, row.total_tf) if row else None

    def posting_list(self, term: str) -> DataFrame:
        """(doc_id, pos, kind, start, end) of a term; only documents that hold it are tokenized with offsets."""
        holders = self.postings.where(F.col("term") == term).select("doc_id").distinct()
        found = tokenize.tokens(self.docs.join(holders, "doc_id", "left_semi"))
        return found.where(F.col("term") == term).select("doc_id", "pos", "kind", "start", "end")

    def document_tokens(self, doc_id: int) -> DataFrame:
        return self._only(doc_id).tokens.orderBy("pos")

    def doc_length(self, doc_id: int) -> int:
        row = self._only(doc_id).lengths.first()
        return row.dl if row else 0

    def avg_doc_length(self) -> float:
        return self.figures()[1]

    def term_count(self) -> int:
        return self.vocabulary.count()

    def term_freq_in_doc(self, term: str, doc_id: int) -> int:
        return self._only(doc_id).occurrences.where(F.col("term") == term).count()

    def document_term_frequencies(self, doc_id: int) -> DataFrame:
        return self._only(doc_id).doc_tf.select("term", "tf")

    def document_frequencies(self, wanted: Column) -> DataFrame:
        """(term, df) of the terms that ``wanted`` selects."""
        if self._postings is not None:
            return self._postings.select("doc_id", "term").where(wanted).groupBy("term").agg(F.count("*").alias("df"))
        return pieces.counts(self.docs).where(wanted).groupBy("term").agg(F.sum("df").alias("df"))

    @property
    def _some_terms(self) -> DataFrame:
        """(term): every term, some of them more than once."""
        return pieces.vocabulary(self.docs) if self._postings is None else self._postings.select("term")

    @property
    def vocabulary(self) -> DataFrame:
        return self._some_terms.distinct()

    def stats_of(self, terms: DataFrame) -> DataFrame:
        """``term_stats`` of some terms, few enough to be broadcast: those of the returned documents."""
        few = F.broadcast(terms)
        if self._postings is not None:
            rows = self._postings.join(few, "term", "left_semi")
            return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("total_tf"))
        return pieces.counts(self.docs).join(few, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))

    def terms_with_prefix(self, prefix: str, limit: int | None = None) -> DataFrame:
        found = self._some_terms.where(F.col("term").startswith(prefix)).distinct()
        return found if limit is None else found.orderBy("term").limit(limit)

    def persist(self) -> Index:
        """Keep the postings and lengths in executor memory and disk for repeated queries."""
        return Index(self.docs, self.postings.persist(), self.lengths.persist(), self.generation)

    def unpersist(self) -> None:
        for t in (self._postings, self._lengths):
            if t is not None:
                t.unpersist()
