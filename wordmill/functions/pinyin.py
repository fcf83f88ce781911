"""Romanisation of Chinese characters, one by one, from the transliterator that Spark ships."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from .pieces import LONGEST_SAID as LONGEST
from .pieces import Letters
from .tokenize import contains_chinese

_tables: dict[str, dict[str, tuple[str, str]]] = {}
_RANGES = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x2F800, 0x2FA20))


def table(spark: SparkSession) -> dict[str, tuple[str, str]]:
    """character -> (with tone mark, plain); about 28,000 entries, made once an application."""
    app = spark.sparkContext.applicationId
    if app not in _tables:
        jvm = spark._jvm.com.ibm.icu.text.Transliterator
        chars = [chr(c) for lo, hi in _RANGES for c in range(lo, hi)]
        toned = jvm.getInstance("Han-Latin").transliterate("\n".join(chars)).split("\n")
        plain = jvm.getInstance("Latin-ASCII").transliterate("\n".join(toned)).split("\n")
        found = {}
        for c, t, p in zip(chars, toned, plain, strict=True):
            p = p.strip().lower()
            if p and p.isascii() and p.isalpha():
                found[c] = (t.strip(), p)
        _tables[app] = found
    return _tables[app]


def tokens(spark: SparkSession, text: str) -> list[dict[str, str]]:
    """full (tone mark), plain and initial of every character that has a reading."""
    t = table(spark)
    return [{"full": t[c][0], "plain": t[c][1], "initial": t[c][1][0]} for c in text if c in t]


def to_plain_pinyin(spark: SparkSession, text: str) -> str:
    return " ".join(x["plain"] for x in tokens(spark, text))


def to_full_pinyin(spark: SparkSession, text: str) -> str:
    return " ".join(x["full"] for x in tokens(spark, text))


def to_first_letters(spark: SparkSession, text: str) -> str:
    return "".join(x["initial"] for x in tokens(spark, text))


def letters(spark: SparkSession) -> dict[int, str]:
    """The plain reading by code point, for ``str.translate``."""
    return {ord(c): p for c, (_, p) in table(spark).items()}


def readings(spark: SparkSession, text: Column) -> Column:
    """struct(plain without blanks, initials) of a text; a character maps to several letters, for which no built-in
    function exists. Texts without Chinese are not sent to Python's table."""
    ship(spark)
    plain = letters(spark)

    @F.pandas_udf("plain string, initials string")
    def read(texts: pd.Series) -> pd.DataFrame:
        whole, first = Letters(plain), Letters({c: p[0] for c, p in plain.items()})
        texts = texts.fillna("")
        return pd.DataFrame({"plain": [t.translate(whole) for t in texts], "initials": [t.translate(first) for t in texts]})

    return read(F.when(contains_chinese(text), text).otherwise(F.lit("")))


def normal(query: str) -> str:
    return query.lower().replace(" ", "")


def pinyin_matches(reading: Column, query: str) -> Column:
    """Whether the query is part of a text's plain reading or initials, across words."""
    q = normal(query)
    return (reading["plain"].contains(q) | reading["initials"].contains(q)) if q else F.lit(False)


def pinyin_terms(vocabulary: DataFrame) -> DataFrame:
    """(term, plain, initials) of the Chinese terms of up to 32 characters."""
    t = vocabulary.select("term").where(F.col("term").rlike(r"^[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]") & (F.char_length("term") <= LONGEST)).distinct()
    r = t.withColumn("r", readings(vocabulary.sparkSession, F.col("term")))
    return r.select("term", "r.plain", "r.initials").where("plain <> ''")


def search_by_pinyin(terms: DataFrame, query: str) -> DataFrame:
    """Terms whose reading or initials begin with the query."""
    q = normal(query)
    hit = (F.col("plain").startswith(q) | F.col("initials").startswith(q)) if q else F.lit(False)
    return terms.where(hit).select("term").distinct().orderBy("term")


def search_by_pinyin_detailed(terms: DataFrame, query: str, initials: bool = False) -> DataFrame:
    """(term, plain) of terms whose reading contains the query; ``initials`` adds those by first letters."""
    q = normal(query)
    hit = F.col("plain").contains(q) if q else F.lit(False)
    if initials and q:
        hit = hit | F.col("initials").contains(q)
    return terms.where(hit).select("term", "plain").orderBy("term")
