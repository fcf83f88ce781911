"""Repeated passages by distributed prefix doubling on the suffixes of all documents (Manber and Myers, 1990)."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import postings
from .common import drop, ids_and_text, stash
from .tokens import mix, spans

#: Words from which a common prefix of two suffixes is a repeat; words that the first ranks look at.
THRESHOLD = 50
BASE = 4


def lengths(threshold: int, base: int) -> list[tuple[int, int]]:
    """(length ranked before, offset) of each doubling; the last reaches the threshold exactly."""
    out, have = [], base
    while have < threshold:
        out.append((have, min(have, threshold - have)))
        have += out[-1][1]
    return out


def _first_keys(threshold: int, base: int, n: int):
    """Every suffix of every text that can hold a repeat, with its first ``base`` words."""

    def run(batches):
        def suffixes():
            for doc, text, h, off in postings.texts(batches, threshold):
                long = np.flatnonzero(np.diff(off) >= threshold)
                count = np.diff(off)[long] - base + 1
                at = np.arange(count.sum()) + np.repeat(off[long] - (np.cumsum(count) - count), count)
                row = np.repeat(long, count)
                yield doc[row], text[row], (at - off[row]).astype(np.int32), spans(h, base)[at]

        for doc, text, pos, key in postings.units(suffixes()):
            yield postings.pack(postings.buckets(key, n), n, doc, text, pos, [key])

    return run


def _by_text(doc: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return postings.buckets(mix(text ^ mix(doc.view(np.uint64))), n)


def _rank(dtypes: list[str], n: int):
    """New ranks of the sorted keys of a bucket: the number of the bucket and the place of the first equal key there.
    A key that occurs once has no equal at any greater length, and is dropped. Ranks go to the bucket of their text."""

    def run(batches):
        doc, text, pos, keys = postings.unpack(postings.blobs(batches).get(0, []), dtypes)
        if not len(doc):
            return
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([(k := x[order])[1:] != k[:-1] for x in keys])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        again = np.repeat(size > 1, size)
        rank, order = np.repeat(first, size)[again].astype(np.uint32), order[again]
        back = np.lexsort((pos[order], doc[order], text[order]))
        order, rank = order[back], rank[back]
        doc, text, pos = doc[order], text[order], pos[order]
        yield from _non_empty(postings.pack(_by_text(doc, text, n), n, doc, text, pos, [rank], TaskContext.get().partitionId()))

    return run


def _non_empty(*rows):
    return (r for r in rows if r is not None)


def _pairs(offset: int, n: int):
    """Rank of each suffix with that of the suffix ``offset`` words on, sent to the bucket of the first rank; suffixes
    whose partner was unique end here."""

    def run(batches):
        parts = [(k, postings.unpack(data, ["<u4"])) for k, data in sorted(postings.blobs(batches).items())]
        if not parts:
            return
        doc, text, pos = (np.concatenate([x[k] for _, x in parts]) for k in range(3))
        bucket = np.repeat([k for k, _ in parts], [len(x[0]) for _, x in parts])
        rank = np.concatenate([x[3][0] for _, x in parts])
        order = np.lexsort((pos, doc, text))
        doc, text, pos, bucket, rank = (x[order] for x in (doc, text, pos, bucket, rank))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
        place = (np.cumsum(new) << 32) + pos
        once = np.concatenate([[True], np.diff(place) != 0])  # repeated rows are one
        doc, text, pos, bucket, rank, place = (x[once] for x in (doc, text, pos, bucket, rank, place))
        to = np.searchsorted(place, place + offset)
        to[to == len(place)] = 0
        at = np.flatnonzero(place[to] == place + offset)
        two = (bucket[to[at]].astype(np.uint64) << np.uint64(32)) | rank[to[at]]
        yield from _non_empty(postings.pack(bucket[at], n, doc[at], text[at], pos[at], [rank[at], two]))

    return run


def _repeats(dtypes: list[str], n: int):
    """The suffixes whose keys occur in two places or more, and whether they are the first of theirs."""

    def run(batches):
        doc, _, pos, keys = postings.unpack(postings.blobs(batches).get(0, []), dtypes)
        order, first, size, _ = postings.groups(doc, pos, keys)
        stay, rest = order[first[size > 1]], postings.others(order, first)
        yield from _non_empty(postings.places(doc[stay], pos[stay], n, 1), postings.places(doc[rest], pos[rest], n, 0))

    return run


def repeated_suffixes(docs: DataFrame, threshold: int = THRESHOLD, base: int = BASE) -> DataFrame:
    """(doc_id, start, end, words, keep): maximal intervals of words that the suffixes with an equal prefix of
    ``threshold`` words make up. With ``keep`` false each of these suffixes has an equal one before it, by doc_id and
    position, and the interval is to be removed; with ``keep`` true they are the first ones.

    All suffixes of all texts are sorted by their first ``base`` words (as 64-bit hashes, whose order is as good as any)
    and ranked. Then, in rounds, the pairs (rank of a suffix, rank of the suffix an offset further) are sorted and ranked
    anew, by 8, 16, 32 and 50 words; a suffix that is unique drops out, and at the threshold what is left is repeated.
    Ranks between rounds are tables in the shared folder.

    Null doc_id or text and texts of under ``threshold`` words give no row. Rows that repeat a doc_id are one document:
    a suffix is no repeat of one at the same word of the same doc_id; their texts, where they differ, are ranked each.
    Ties don't arise: places differ. A text of any length is taken whole. Extra columns are never read; an empty table
    gives an empty result."""
    n, base = postings.partitions(docs), min(base, threshold)
    sent = ids_and_text(docs).mapInArrow(_first_keys(threshold, base, n), postings.ROW)
    kinds, last = ["<u8"], None
    for _, offset in lengths(threshold, base):
        ranked = stash(postings.exchange(sent, n).mapInArrow(_rank(kinds, n), postings.ROW), "ranks")
        if last is not None:
            drop(last)
        sent, kinds, last = postings.exchange(ranked, n).mapInArrow(_pairs(offset, n), postings.ROW), ["<u4", "<u8"], ranked
    found = postings.exchange(sent, n).mapInArrow(_repeats(kinds, n), postings.ROW)
    return postings.exchange(found, n).mapInArrow(postings.intervals(threshold), postings.INTERVALS)
