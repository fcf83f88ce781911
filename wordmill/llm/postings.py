"""Places (doc_id, text, word) with their keys, packed by numpy into one binary for each bucket of an exchange.

A place costs its keys and, mostly, one byte: places follow one another by text, as gaps. Spark moves the binaries; a
partition is packed and read by a few array operations a binary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import mix, word_blocks

#: Places that a task packs at once; it bounds the memory of the packing side.
UNIT = 1 << 20
#: Rows of an exchange: bucket, what kind of places, the binary.
ROW = "bucket int, kind int, data binary"
_TYPES = [pa.int32(), pa.int32(), pa.binary()]


def row_ids(doc: np.ndarray, h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 bits for each text, of its doc_id and all its words: tells texts of one doc_id apart, and stays the same when
    a task runs again."""
    n = np.diff(off)
    c = np.zeros(len(h) + 1, dtype=np.uint64)
    at = np.arange(len(h)) - np.repeat(off[:-1], n)
    np.cumsum(h * mix(at.astype(np.uint64)), out=c[1:])
    return mix(c[off[1:]] - c[off[:-1]] + mix(doc.astype(np.int64).view(np.uint64)) * np.uint64(3) + n.astype(np.uint64))


def texts(batches, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id and id of each text, word hashes, offsets) of the texts of ``size`` words and more, block by block."""
    for b in batches:
        ids = b.column(0).to_numpy()
        for lo, hi, h, off in word_blocks(b.column(1)):
            if (np.diff(off) >= size).any():
                yield ids[lo:hi], row_ids(ids[lo:hi], h, off), h, off


def units(parts: Iterable[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Arrays of like length, joined up to UNIT places and a block."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= UNIT:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The range of ``n`` equal ones that each 64-bit hash lies in."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def by_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return buckets(mix(doc.view(np.uint64)), n)


def pack(bucket: np.ndarray, n: int, doc: np.ndarray, text: np.ndarray | None, pos: np.ndarray, keys: list[np.ndarray], kind: int = 0) -> pa.RecordBatch | None:
    """One row for each bucket that has places. The places of one text should come in order, and close together."""
    if not len(bucket):
        return None
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    bucket, doc, pos, keys = bucket[order], doc[order], pos[order].astype(np.int64), [k[order] for k in keys]
    wide = np.uint8 if n <= 64 else np.uint16 if n <= 1 << 14 else np.uint32
    gap = np.diff(pos, prepend=0)
    new = (gap <= 0) | (gap > np.iinfo(wide).max)
    new[0] = True
    new[1:] |= (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    if text is not None:
        text = text[order]
        new[1:] |= text[1:] != text[:-1]
    run = np.flatnonzero(new)
    gap[run] = 0
    gap, size = gap.astype(wide), np.diff(np.append(run, len(bucket)))
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    redge = np.searchsorted(run, edge)
    out = []
    for a, b, ra, rb in zip(edge[:-1], edge[1:], redge[:-1], redge[1:], strict=True):
        at, long = run[ra:rb], size[ra:rb]
        narrow = np.uint16 if long.max() < 1 << 16 else np.uint32
        head = np.array([b - a, rb - ra, gap.itemsize, np.dtype(narrow).itemsize, text is not None], dtype=np.int32)
        parts = [head, doc[at], *([text[at]] if text is not None else []), pos[at].astype(np.int32), long.astype(narrow), gap[a:b], *(k[a:b] for k in keys)]
        out.append(b"".join(p.tobytes() for p in parts))
    at = edge[:-1]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int32)), pa.array(out, pa.binary())], names=["bucket", "kind", "data"])


def unpack(blobs: list, dtypes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(doc_id, text, pos, keys) of all places in the binaries; text is 0 where none was packed."""
    parts: list[list[np.ndarray]] = [[] for _ in range(5 + len(dtypes))]
    for blob in blobs:
        n, m, gaps, narrow, has = np.frombuffer(blob, np.int32, 5).tolist()
        at = 20
        layout = [("<i8", m), ("<u8", m if has else 0), ("<i4", m), (f"<u{narrow}", m), (f"<u{gaps}", n), *((d, n) for d in dtypes)]
        for k, (d, c) in enumerate(layout):
            x = np.frombuffer(blob, d, c, at)
            at += x.nbytes
            parts[k].append(x if k != 1 or has else np.zeros(m, np.uint64))
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, d) for d in dtypes]
    doc, text, first, size, gap = (np.concatenate([x.astype(t) for x in p]) for p, t in zip(parts[:5], (np.int64, np.uint64, np.int64, np.int64, np.int64), strict=True))
    pos = np.cumsum(gap)
    at = np.cumsum(size) - size
    pos += np.repeat(first - pos[at], size)
    return np.repeat(doc, size), np.repeat(text, size), pos, [np.concatenate(p) for p in parts[5:]]


def blobs(batches) -> dict[int, list]:
    """The binaries of a partition by kind."""
    out: dict[int, list] = {}
    for b in batches:
        data = b.column(2)
        for k, kind in enumerate(b.column(1).to_pylist()):
            out.setdefault(kind, []).append(data[k].as_buffer())
    return out


def exchange(rows: DataFrame, n: int) -> DataFrame:
    """Each bucket in the partition of its number."""
    return rows.repartitionById(n, F.col("bucket"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def groups(doc: np.ndarray, pos: np.ndarray, keys: list[np.ndarray], mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size, marked): places in order of the keys, then doc_id and pos, the groups of equal keys among
    them, and which groups hold a place with a mark. A place that comes more than once is left in its group once. Only
    keys that repeat are sorted by more than the first."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    order = np.argsort(keys[0])
    k = keys[0][order]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    again = np.flatnonzero(same | np.append(same[1:], False))
    part = order[again]
    order[again] = part[np.lexsort((pos[part], doc[part], *(x[part] for x in reversed(keys))))]
    new = ~same
    for x in keys[1:]:
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    marked = np.zeros(0, bool) if mark is None else np.logical_or.reduceat(mark[order], np.flatnonzero(new))
    d, p = doc[order], pos[order]
    once = new.copy()
    once[1:] |= (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    order, new = order[once], new[once]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(new))), marked


def others(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places that aren't the first of their group."""
    rest = np.ones(len(order), dtype=bool)
    rest[first] = False
    return order[rest]


def places(doc: np.ndarray, pos: np.ndarray, n: int, kind: int) -> pa.RecordBatch | None:
    """Places without keys, by doc_id."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    return pack(by_doc(doc, n), n, doc, None, pos, [], kind)


def intervals(window: int):
    """Maximal intervals of windows that overlap or touch, of places of kind 1, which stay, and 0, which go."""

    def run(batches):
        held = blobs(batches)
        for kind in (1, 0):
            doc, _, pos, _ = unpack(held.get(kind, []), [])
            if not len(doc):
                continue
            order = np.lexsort((pos, doc))
            doc, pos = doc[order], pos[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > window)]))
            end = pos[np.append(new[1:], len(pos)) - 1] + window
            start = pos[new]
            t = pa.Table.from_arrays([pa.array(doc[new]), *(pa.array(x.astype(np.int32)) for x in (start, end, end - start)), pa.array(np.full(len(new), kind == 1))], names=["doc_id", "start", "end", "words", "keep"])
            yield from t.to_batches(max_chunksize=50_000)

    return run


INTERVALS = "doc_id long, start int, end int, words int, keep boolean"
