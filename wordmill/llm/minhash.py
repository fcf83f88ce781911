"""Near duplicates: banded MinHash candidates, verified on odd sketches (Mitzenmacher, Pagh and Pham, 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import without
from .common import drop, ids_and_text, stash
from .components import connected
from .tokens import mix, signed, word_blocks

#: Words of a shingle, MinHash samples, rows of a band, bits of a sketch, Jaccard similarity from which texts are one.
SHINGLE, SAMPLES, ROWS, BITS, SIMILAR = 3, 128, 4, 512, 0.6

#: 64-bit words of a sketch.
WORDS = BITS // 64

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_C = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(h: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and how many each row has; a row of fewer words has one shingle, of all of them."""
    n = np.diff(off)
    at, end = np.arange(len(h)), np.repeat(off[1:], n)
    keep = (at + size <= end) | ((at == np.repeat(off[:-1], n)) & (np.repeat(n, n) < size))
    at, end = at[keep], end[keep]
    s = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        there = at + k < end
        s = s * np.uint64(0x9E3779B97F4A7C15) + np.where(there, h[np.minimum(at + k, len(h) - 1)], np.uint64(k + 1))
    return mix(s), np.where(n > 0, np.maximum(n - size + 1, 1), 0)


def samples(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash samples of each row that has shingles, one column per hash function."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), SAMPLES), dtype=np.uint32)
    if len(starts):
        for j in range(SAMPLES):
            out[:, j] = np.minimum.reduceat(x * _A[j] + _B[j], starts)
    return out


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity bitmap: sample j of value v toggles bit hash(j, v). XOR of two sketches keeps the differing samples."""
    bit = (mix(m.astype(np.uint64) * _C) >> np.uint64(40)).astype(np.int64) % BITS
    flat = (np.arange(len(m))[:, None] * BITS + bit).ravel()
    odd = (np.bincount(flat, minlength=len(m) * BITS) & 1).astype(np.uint8).reshape(len(m), BITS)
    return np.packbits(odd, axis=1)


def similarity(ones: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the population count of the XOR of two sketches."""
    share = np.minimum(2.0 * ones / BITS, 1 - 1e-9)
    return np.maximum(0.0, 1.0 + BITS / (4.0 * SAMPLES) * np.log1p(-share))


#: The largest population count that still means SIMILAR.
MOST_ONES = int(np.flatnonzero(similarity(np.arange(BITS // 2)) >= SIMILAR)[-1])

_SIGNED = "doc_id long, sig long, sketch array<long>, bands array<long>"


def _sign(batches):
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, h, off in word_blocks(b.column(1)):
            m = samples(*(sc := shingle_hashes(h, off)))
            if not len(m):
                continue
            v = m.astype(np.uint64).reshape(len(m), -1, ROWS)
            key = np.broadcast_to(np.arange(v.shape[1], dtype=np.uint64), v.shape[:2]).copy()
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, r])
            sig = mix((key * _C[: key.shape[1]]).sum(axis=1, dtype=np.uint64))
            sk = odd_sketch(m)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[lo:hi][sc[1] > 0]),
                    pa.array(signed(sig)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(m) * WORDS + 1, WORDS, dtype=np.int32)), pa.array(sk.view(np.int64).ravel())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, key.shape[1], dtype=np.int32)), pa.array(signed(key.ravel()))),
                ],
                names=["doc_id", "sig", "sketch", "bands"],
            )


def link_bucket(ids: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the connected components of one bucket under the verified similarity. Each member is compared with
    those not yet reached, so that a bucket of copies costs one comparison a member and none is left out."""
    edges, left = [], np.arange(len(ids))
    while len(left):
        todo, left = [left[0]], left[1:]
        root = ids[todo[0]]
        while todo and len(left):
            near = np.bitwise_count(words[left] ^ words[todo.pop()]).sum(axis=1) <= MOST_ONES
            reached, left = left[near], left[~near]
            edges.extend((int(root), int(ids[k])) for k in reached)
            todo.extend(reached.tolist())
    return edges


def _link(batches):
    for b in batches:
        lists = b.column(0)
        off = lists.offsets.to_numpy()
        flat = lists.values
        ids = flat.field(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        words = flat.field(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
        n = np.diff(off)
        two = off[:-1][n == 2]
        near = np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1) <= MOST_ONES
        u, v = [ids[two[near]]], [ids[two[near] + 1]]
        for k in np.flatnonzero(n > 2):
            if e := link_bucket(ids[off[k] : off[k + 1]], words[off[k] : off[k + 1]]):
                a = np.array(e, dtype=np.int64)
                u.append(a[:, 0])
                v.append(a[:, 1])
        u, v = np.concatenate(u), np.concatenate(v)
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _ones(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of near duplicates among ``docs(doc_id, text)``: one row (doc_id, group_id, group_size, keep) for each
    member of a group of two or more; group_id is the smallest doc_id of the group, the one that stays.

    Two texts are near when the Jaccard similarity of their sets of word 3-grams, estimated from odd sketches of 128
    MinHash samples, is 0.6 or more; a group is a connected component. Candidates share one of 32 bands of 4
    samples, which finds a pair at 0.6 with probability 0.988; the estimate then accepts about half the pairs at 0.6 and
    nearly all from 0.7 on. Documents with equal samples and sketches are joined first, by one aggregation. In a bucket,
    whatever its size, members are compared with the first one; those unlike it with all that are like it, and with
    one another. Only these last are gathered in a row.

    Null doc_id or text and texts without a word take no part. Rows that repeat a doc_id are one document: they
    share its group and its fate. Ties don't arise, the smallest doc_id stays. Texts of any length are hashed whole.
    Other columns are never read. An empty table gives an empty result."""
    signed_ = stash(ids_and_text(docs).mapInArrow(_sign, _SIGNED), "signatures")
    reps = signed_.groupBy("sig", "sketch").agg(F.min(F.struct("doc_id", "bands")).alias("r"), F.max("doc_id").alias("last"))
    many = reps.where("last > r.doc_id").select("sig", "sketch", F.col("r.doc_id").alias("v"))
    copies = signed_.select("sig", "sketch", F.col("doc_id").alias("u")).join(many, ["sig", "sketch"]).where("u != v").select("u", "v")
    reps = stash(reps.select("r.doc_id", "sig", "sketch", "r.bands"), "representatives")
    # every member of a bucket against its first one: a bucket may be of any size, its rows are never one row, and only
    # members of buckets of two or more get their sketches, by doc_id and samples, for a doc_id may have several texts
    whole = Window.partitionBy("key")
    banded = reps.select("doc_id", "sig", F.explode("bands").alias("key"))
    held = banded.withColumns({"n": F.count("*").over(whole), "v": F.min(F.struct("doc_id", "sig")).over(whole)}).where("n > 1")
    held = held.select("key", "doc_id", "sig", F.col("v.doc_id").alias("v"), F.col("v.sig").alias("v_sig"))
    firsts = reps.select(F.col("doc_id").alias("v"), F.col("sig").alias("v_sig"), F.col("sketch").alias("first"))
    held = held.join(reps.select("doc_id", "sig", "sketch"), ["doc_id", "sig"]).join(firsts, ["v", "v_sig"])
    near = _ones(F.col("sketch"), F.col("first")) <= MOST_ONES
    held = stash(held.select("key", "doc_id", "sketch", "v", near.alias("near")), "buckets")
    links = held.where("near AND doc_id != v").select(F.col("doc_id").alias("u"), "v")
    # those unlike the first: against all that are like it, and among themselves
    rest = held.where("NOT near")
    like = held.where("near").select("key", F.col("sketch").alias("other"))
    reached = rest.join(like, (rest["key"] == like["key"]) & (_ones(rest["sketch"], like["other"]) <= MOST_ONES), "left_semi").select(F.col("doc_id").alias("u"), "v")
    alone = rest.groupBy("key").agg(F.collect_list(F.struct("doc_id", "sketch")).alias("members")).where(F.size("members") > 1)
    found = connected(links.union(reached).union(alone.select("members").mapInArrow(_link, "u long, v long")).union(copies))
    for used in (signed_, reps, held):
        drop(used)
    sizes = found.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    members = found.union(sizes.select(F.col("root").alias("id"), "root"))
    return members.join(sizes, "root").select(
        F.col("id").alias("doc_id"), F.col("root").alias("group_id"), "group_size", (F.col("id") == F.col("root")).alias("keep")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the members that don't stay; all columns and all other rows, those without a doc_id, a text or a
    word among them, are left as they are. Rows that repeat a doc_id go or stay together; an empty table gives an empty
    result."""
    return without(docs, near_duplicates(docs).where("not keep").select("doc_id"))
