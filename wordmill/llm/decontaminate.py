"""Benchmark decontamination by spaced seeds (Ma, Tromp and Li, 2002), verified by ungapped extension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ids_and_text, stash
from .tokens import mix, signed, word_blocks

#: Word positions that each seed reads; it ignores those between.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 5, 6, 8), (0, 2, 4, 5, 8, 9), (0, 1, 4, 6, 7, 9), (0, 2, 3, 6, 7, 8))
#: An overlap is the stretch of largest sum of 1 a matching word and -PENALTY a substituted one; it counts from
#: MATCHED matching words on. Items of up to MATCHED words must be there as a whole, from TOLERANT words on with one
#: substitution at most. An item of under SHORTEST words is found in texts that hold nothing else.
MATCHED, PENALTY, TOLERANT, SHORTEST = 13, 3, 8, 6

#: Bits of the filter for each seed: every position of every text asks it five times or more.
SEED_BITS = 1024

_W = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def least_matches(words: int) -> int:
    """Matching words that an overlap with an item of so many words needs."""
    return words if words < TOLERANT else min(words - 1, MATCHED)


def masks_for(sizes: set[int]) -> tuple[tuple[int, ...], ...]:
    """MASKS, and for items of TOLERANT to MATCHED words the masks that ignore just one of their words, where no seed
    of MASKS fits beside it."""
    more = []
    for n in sorted(s for s in sizes if TOLERANT <= s <= MATCHED):
        for gap in range(n):
            if not any(gap - at not in mask for mask in MASKS for at in range(n - mask[-1])):
                more.append(tuple(k for k in range(n) if k != gap))
    return MASKS + tuple(more)


def seed_hashes(h: np.ndarray, off: np.ndarray, masks=MASKS):
    """For each mask, the hash at every position and whether the mask lies within the row there; at last, for rows of
    under SHORTEST words, the hash of the whole row at its first word."""
    ends = np.repeat(off[1:], np.diff(off))
    for mask in masks:
        n = len(h) - mask[-1]
        if n <= 0:
            continue
        s = np.full(n, _NAMES[mask], dtype=np.uint64)
        for k in mask:
            s += h[k : k + n] * _W[k]
        yield mix(s), np.arange(n) + mask[-1] < ends[:n]
    size = np.diff(off)
    short = np.flatnonzero((size > 0) & (size < SHORTEST))
    if len(short):
        s, ok = np.zeros(len(h), dtype=np.uint64), np.zeros(len(h), dtype=bool)
        at = off[short]
        s[at], ok[at] = size[short].astype(np.uint64) << np.uint64(32), True
        for k in range(SHORTEST - 1):
            there = size[short] > k
            s[at[there]] += h[at[there] + k] * _W[k]
        yield mix(s), ok


class _Names(dict):
    """A number for each mask, the same in every process."""

    def __missing__(self, mask):
        out = np.uint64(len(mask) << 40) + sum((np.uint64(1) << np.uint64(k) for k in mask), np.uint64(0))
        self[mask] = out
        return out


_NAMES = _Names()


def _seeds(masks):
    """Seeds of items; one of under SHORTEST words has the seed of the whole alone, and the others don't."""

    def run(batches):
        for b in batches:
            for lo, hi, h, off in word_blocks(b.column(1)):
                row = np.repeat(np.arange(lo, hi), np.diff(off))
                for s, ok in seed_hashes(h, off, masks):
                    at = np.flatnonzero(ok)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(s[at])), b.column(0).take(pa.array(row[at])), pa.array((at - off[row[at] - lo]).astype(np.int32))],
                        names=["seed", "item_id", "item_pos"],
                    )

    return run


def _words(batches):
    for b in batches:
        for lo, hi, h, off in word_blocks(b.column(1)):
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(signed(h)))],
                names=["item_id", "item_words"],
            )


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the best stretch of two aligned word sequences."""
    same = a == b
    c = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    gain = c - np.minimum.accumulate(c)
    end = int(gain.argmax())
    start = int(np.flatnonzero(c[: end + 1] == c[: end + 1].min())[-1])
    return start, end, int(same[start:end].sum())


def verify(words: np.ndarray, ref: np.ndarray, d: int) -> tuple[int, int, int] | None:
    """(first word, words, matches) of the overlap of a text with an item that begins at its word ``d``, if it counts."""
    if len(ref) <= MATCHED:
        whole = 0 <= d <= len(words) - len(ref) and (len(ref) >= SHORTEST or len(words) == len(ref))
        n = int((words[d : d + len(ref)] == ref).sum()) if whole else 0
        return (d, len(ref), n) if n and n >= least_matches(len(ref)) else None
    lo, hi = max(0, d), min(len(words), d + len(ref))
    s, e, n = overlap(words[lo:hi], ref[lo - d : hi - d]) if lo < hi else (0, 0, 0)
    return (lo + s, e - s, n) if n >= MATCHED else None


def _verify(batches):
    for b in batches:
        doc, first, item, diag = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column(4), b.column(5))]
        out = []
        for k in range(b.num_rows):
            (w, o), (x, q) = lists
            d = int(diag[k] - first[k])  # where the item begins in the region
            if found := verify(w[o[k] : o[k + 1]], x[q[k] : q[k + 1]], d):
                s, size, n = found
                out.append((doc[k], item[k], first[k] + s, s - d, size, n))
        cols = [np.array(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if i < 2 else np.int32)) for i, c in enumerate(cols)], names=_FOUND_NAMES)


_FOUND = "doc_id long, item_id long, doc_word int, item_word int, words int, matched int"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, words, matched): each overlap of a document with a benchmark item, with
    the first word in both, its length and the number of matching words.

    Hashes of five spaced seeds of six words, at every position of every document, are joined to those of the items;
    around each hit the two texts are aligned without gaps and the best stretch is kept (see ``overlap``). An item
    is found at any of its places, in part or with substitutions; of equal stretches the first counts. Items of 8 to 13
    words are found as a whole with one substitution at most, those of 6 and 7 words with none, and shorter ones, which
    any text may hold by chance, as texts that consist of nothing else.

    Null ids or texts and texts without a word take no part. Repeated rows give one row. Items with one text are each
    reported. Texts of any length are searched whole. Extra columns are never read; an empty table on either side gives
    an empty result."""
    bench = ids_and_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").distinct()
    items = stash(bench.mapInArrow(_words, "item_id long, item_words array<long>").where(F.size("item_words") > 0), "items")
    sizes = {r.n for r in items.select(F.least(F.size("item_words"), F.lit(MATCHED + 1)).alias("n")).distinct().collect()}  # MATCHED + 1 rows at most
    masks = masks_for(sizes)
    seeds = stash(bench.mapInArrow(_seeds(masks), "seed long, item_id long, item_pos int").distinct(), "seeds")
    reach = items.agg(F.max(F.size("item_words"))).first()[0] or 0
    filled = bloom.fill(seeds, F.col("seed"), SEED_BITS)

    def scan(batches):
        for b in batches:
            for lo, hi, h, off in word_blocks(b.column(1)):
                at, key = [], []
                for s, ok in seed_hashes(h, off, masks):
                    near = bloom.may_hold(filled, s, ok)
                    at.append(near)
                    key.append(s[near])
                at = np.concatenate(at) if at else np.zeros(0, np.int64)
                if not len(at):
                    continue
                key, order = np.concatenate(key), np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                row = np.searchsorted(off, at, side="right") - 1
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(at) > 2 * reach)]))
                stop = np.concatenate([new[1:], [len(at)]])
                r = row[new]
                begin = np.maximum(at[new] - reach, off[r])
                finish = np.minimum(at[stop - 1] + reach, off[r + 1])
                size = finish - begin
                flat = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
                region = h[flat]
                heads = np.cumsum(size) - size
                ids = b.column(0).take(pa.array(lo + r))
                rid = mix(np.add.reduceat(region * (np.arange(len(region)) - np.repeat(heads, size) + 1).astype(np.uint64), heads) + mix(ids.to_numpy().astype(np.uint64) * np.uint64(31) + (begin - off[r]).astype(np.uint64)))
                hits = pa.StructArray.from_arrays([pa.array(signed(key)), pa.array((at - off[row]).astype(np.int32))], names=["seed", "pos"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(rid)),
                        ids,
                        pa.array((begin - off[r]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), hits),
                        pa.ListArray.from_arrays(pa.array(np.append(heads, len(region)).astype(np.int32)), pa.array(signed(region))),
                    ],
                    names=["rid", "doc_id", "first", "hits", "words"],
                )

    regions = stash(ids_and_text(docs).mapInArrow(scan, "rid long, doc_id long, first int, hits array<struct<seed: long, pos: int>>, words array<long>"), "regions")
    hits = regions.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.seed", "hit.pos")
    places = hits.join(seeds, "seed").select("rid", "item_id", (F.col("pos") - F.col("item_pos")).alias("diag")).distinct()
    pairs = places.join(regions, "rid").join(items, "item_id").select("doc_id", "first", "item_id", "diag", "words", "item_words")
    return pairs.mapInArrow(_verify, _FOUND).distinct()


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that overlap a benchmark item; all other rows and all columns stay as they are. Rows that
    repeat a doc_id go together; null ids and texts stay; an empty table gives an empty result."""
    return bloom.without(docs, leaks(docs, benchmark).select("doc_id"))
