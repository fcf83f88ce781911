"""Repeated passages by Rabin-Karp hashes of every fixed-length window of words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import postings
from .common import ids_and_text
from .tokens import mix, spans, within

#: Words of a window.
WINDOW = 50
#: Kinds of rows in the exchange: windows to be counted, places already known to be repeats.
_COUNT, _GONE = 2, 0


def _windows(batches, window: int):
    for doc, _, h, off in postings.texts(batches, window):
        one = spans(h, window)
        at = np.flatnonzero(within(off, window)[: len(one)])
        row = np.searchsorted(off, at, side="right") - 1
        two = spans(mix(h), window)[at] >> np.uint64(48)
        yield doc[row], (at - off[row]).astype(np.int32), one[at], two.astype(np.uint16) | np.uint16(1)


def _map(window: int, n: int):
    """Hash every window; of windows equal within a unit only the first goes on, marked, and the others are repeats."""

    def run(batches):
        for k, (doc, pos, one, two) in enumerate(postings.units(_windows(batches, window))):
            order, first, size, _ = postings.groups(doc, pos, [one, two])
            two[order[first[size == 1]]] ^= np.uint16(1)  # the last bit says: found again within the unit
            keep = np.zeros(len(doc), dtype=bool)
            keep[order[first]] = True
            rest = np.sort(postings.others(order, first))
            rows = [
                postings.pack(postings.buckets(one[keep], n), n, doc[keep], None, pos[keep], [one[keep], two[keep]], _COUNT),
                postings.pack(np.full(len(rest), k % n), n, doc[rest], None, pos[rest], [], _GONE),
            ]
            yield from (r for r in rows if r is not None)

    return run


def _count(n: int):
    """Windows found in two places or more: the first of them stays, the others go; each to the bucket of its doc_id."""

    def run(batches):
        held = postings.blobs(batches)
        doc, _, pos, (one, two) = postings.unpack(held.pop(_COUNT, []), ["<u8", "<u2"])
        order, first, size, known = postings.groups(doc, pos, [one, two >> np.uint16(1)], (two & np.uint16(1)) > 0)
        again = (size > 1) | known
        stay, rest = order[first[again]], postings.others(order, first)
        old, _, at, _ = postings.unpack(held.get(_GONE, []), [])
        rows = [postings.places(doc[stay], pos[stay], n, 1), postings.places(np.concatenate([doc[rest], old]), np.concatenate([pos[rest], at]), n, 0)]
        yield from (r for r in rows if r is not None)

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, end, words, keep): maximal intervals of words, end exclusive, made of windows of ``window`` words
    that occur again, in the same or another document. Windows that overlap or touch are merged. With ``keep``
    false the interval is to be removed: each of its windows has an earlier occurrence, by doc_id and then position.
    With ``keep`` true its windows are first occurrences, which stay.

    Every window of every text is hashed and counted, by 79 bits of hash. A task sends one of the windows equal within
    a million, so a passage in a great many texts doesn't burden the bucket it is counted in.

    Null doc_id or text and texts of under ``window`` words give no row. Rows that repeat a doc_id are one document: a
    window at the same word of the same doc_id is no repeat of itself. Ties don't arise: places differ. A text of any
    length is taken whole. Extra columns are never read; an empty table gives an empty result."""
    n = postings.partitions(docs)
    counted = postings.exchange(ids_and_text(docs).mapInArrow(_map(window, n), postings.ROW), n).mapInArrow(_count(n), postings.ROW)
    return postings.exchange(counted, n).mapInArrow(postings.intervals(window), postings.INTERVALS)
