"""The operators applied to their whole tables, as registered in ``__spark_entry__.py``."""

from __future__ import annotations

from . import decontaminate, licenses, media, minhash, packing, pii, sharding, substring, suffix, toxicity
from .common import table

QUERIES = {
    "op9_media_hashes": lambda spark, d: media.read_images(media.with_pictures(table(spark, d, "pages"))),
    "op3_license_texts": lambda spark, d: licenses.license_texts(table(spark, d, "documents")),
    "op10_repeated_suffixes": lambda spark, d: suffix.repeated_suffixes(table(spark, d, "documents")),
    "op7_repeated_passages": lambda spark, d: substring.repeated_passages(table(spark, d, "documents")),
    "op6_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    # the scan itself: its row numbers are the same in each pass
    "op4_shards": lambda spark, d: sharding.shards(spark.read.parquet(f"{d}/documents.parquet")),
    "op8_benchmark_leaks": lambda spark, d: decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_private_data": lambda spark, d: pii.private_spans(table(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.toxic_documents(table(spark, d, "documents"), table(spark, d, "labels")),
    "op1_minhash_near_dedup": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
}
_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"

#: Windows of 50 words compared as texts; the runs of repeated ones are found by gaps in their first words.
_PASSAGES = f"""
WITH t AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) - 1 AS i, len(w) AS n
           FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
g AS (SELECT doc_id, i, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM t),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) = 1 AS keep, count(*) OVER (PARTITION BY h) AS c
      FROM g WHERE i + 50 <= n),
m AS (SELECT doc_id, keep, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, keep ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r WHERE c > 1),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, keep ORDER BY i) AS run FROM m)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + 50 AS INTEGER) AS "end", CAST(max(i) + 50 - min(i) AS INTEGER) AS words, keep
FROM s GROUP BY doc_id, keep, run
"""

_MASKED = " UNION ALL ".join(
    f"SELECT id, i, {m} || ':' || concat_ws(' ', {', '.join(f'w{k}' for k in mask)}) AS seed FROM {{0}} WHERE w{mask[-1]} IS NOT NULL" for m, mask in enumerate(decontaminate.MASKS)
)
_AHEAD = ", ".join(f"lead(word, {k}) OVER ahead AS w{k}" for k in range(10))

#: The words under each mask as texts; then the stretch of largest sum of every alignment, for items of 14 words and more.
_LEAKS = f"""
WITH d AS (SELECT id, unnest(w) AS word, unnest(generate_series(1, len(w))) - 1 AS i FROM (SELECT DISTINCT doc_id AS id, {_WORDS} AS w FROM documents)),
b AS (SELECT id, unnest(w) AS word, unnest(generate_series(1, len(w))) - 1 AS i FROM (SELECT DISTINCT item_id AS id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 13),
dw AS (SELECT id, i, {_AHEAD} FROM d WINDOW ahead AS (PARTITION BY id ORDER BY i)), bw AS (SELECT id, i, {_AHEAD} FROM b WINDOW ahead AS (PARTITION BY id ORDER BY i)),
places AS (SELECT DISTINCT x.id AS doc_id, y.id AS item_id, x.i - y.i AS diag FROM ({_MASKED.format('dw')}) x JOIN ({_MASKED.format('bw')}) y USING (seed)),
same AS (SELECT doc_id, item_id, diag, b.i AS j, CAST(b.word = d.word AS INTEGER) AS hit FROM places JOIN b ON b.id = item_id JOIN d ON d.id = doc_id AND d.i = diag + b.i),
sums AS (SELECT doc_id, item_id, diag, j, hit, sum(hit * 4 - 3) OVER (PARTITION BY doc_id, item_id, diag ORDER BY j) AS c FROM same
         UNION ALL SELECT doc_id, item_id, diag, min(j) - 1, 0, 0 FROM same GROUP BY ALL),
low AS (SELECT *, min(c) OVER (PARTITION BY doc_id, item_id, diag ORDER BY j) AS least FROM sums),
ends AS (SELECT doc_id, item_id, diag, arg_max(j, (c - least) * 100000 - j) AS stop, arg_max(least, (c - least) * 100000 - j) AS base FROM low GROUP BY ALL),
starts AS (SELECT doc_id, item_id, diag, stop, max(j) AS start FROM low JOIN ends USING (doc_id, item_id, diag) WHERE j <= stop AND c = base GROUP BY ALL)
SELECT DISTINCT doc_id, item_id, CAST(diag + start + 1 AS INTEGER) AS doc_word, CAST(start + 1 AS INTEGER) AS item_word, CAST(stop - start AS INTEGER) AS words, CAST(matched AS INTEGER) AS matched
FROM (SELECT doc_id, item_id, diag, stop, start, sum(hit) AS matched FROM low JOIN starts USING (doc_id, item_id, diag) WHERE j > start AND j <= stop GROUP BY ALL) WHERE matched >= 13
"""

#: For tables of one range between splitters, that is up to 64 MB of text: SQL has not the hash that draws splitters.
_SHARDS = f"""
SELECT doc_id, text, lang, source, n_chars, CAST(least(floor(coalesce(sum(size) OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * cuts / total), cuts - 1) AS INTEGER) AS shard_id
FROM (SELECT *, coalesce(strlen(text), 0) AS size, sum(strlen(text)) OVER () AS total, ceil(sum(strlen(text)) OVER () / {sharding.SHARD_BYTES}.0) AS cuts FROM documents)
"""

SQL: dict[str, str] = {"op4_shards": _SHARDS, "op7_repeated_passages": _PASSAGES, "op10_repeated_suffixes": _PASSAGES, "op8_benchmark_leaks": _LEAKS}
