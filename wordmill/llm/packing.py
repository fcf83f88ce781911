"""Packing documents into training sequences by a grouping genetic algorithm (Falkenauer, 1996) on islands."""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, stash
from .tokens import word_blocks

#: Words of a sequence. A cell, one packing problem, should fill CELL_BINS sequences and has CELL_ITEMS items at most, but
#: for chance; islands of a cell, individuals of an island, generations between migrations and epochs; a bin is well
#: filled from this share on.
CAPACITY = 2048
CELL_BINS, CELL_ITEMS = 300, 2048
ISLANDS, POPULATION, GENERATIONS, EPOCHS, WELL_FILLED = 3, 16, 160, 2, 0.99


def best_fit(bins: list[list[int]], free: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put each item, in order, into the bin with the least room that takes it, or into a new one."""
    room = sorted((f, k) for k, f in enumerate(free) if f)
    for i in items:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            f, k = room.pop(at)
        else:
            f, k = capacity, len(bins)
            bins.append([])
            free.append(0)
        bins[k].append(i)
        free[k] = f - sizes[i]
        if free[k]:
            bisect.insort(room, (free[k], k))


def fitness(free: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, by the squares of their fills."""
    return -len(free), sum((1 - f / capacity) ** 2 for f in free)


def crossover(donor, other, sizes: list[int], capacity: int, rng: random.Random):
    """Inject whole well-filled bins of ``donor`` into ``other``: its bins that hold an injected item go, what else was
    in them is displaced, as are the items of its two emptiest bins, and the displaced are best-fitted, largest first."""
    good = [k for k, f in enumerate(donor[1]) if f <= (1 - WELL_FILLED) * capacity]
    pool = good or sorted(range(len(donor[1])), key=donor[1].__getitem__)[: max(1, len(donor[1]) // 4)]
    taken = rng.sample(pool, rng.randint(1, max(1, len(pool) * 2 // 3)))
    bins, free = [list(donor[0][k]) for k in taken], [donor[1][k] for k in taken]
    inside = {i for b in bins for i in b}
    loose, kept = [], []
    for k, b in enumerate(other[0]):
        if inside.isdisjoint(b):
            kept.append(k)
        else:
            loose += [i for i in b if i not in inside]
    emptiest = set(sorted(kept, key=other[1].__getitem__)[-2:])
    for k in kept:
        if k in emptiest:
            loose += other[0][k]
        else:
            bins.append(list(other[0][k]))
            free.append(other[1][k])
    loose.sort()
    loose.sort(key=sizes.__getitem__, reverse=True)  # of equal sizes the first one first, still
    best_fit(bins, free, loose, sizes, capacity)
    return bins, free


def _of(assigned: list[int], sizes: list[int], capacity: int):
    bins: list[list[int]] = [[] for _ in range(max(assigned) + 1)]
    for i, k in enumerate(assigned):
        bins[k].append(i)
    return bins, [capacity - sum(sizes[i] for i in b) for b in bins]


def _to(one, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(one[0]):
        for i in b:
            out[i] = k
    return out


def evolve(sizes: list[int], population: list[list[int]], guests: list[list[int]], capacity: int, seed: int) -> list[list[int]]:
    """GENERATIONS of one island, a child in each; individuals are the bin of each item. Without a population it begins with
    best-fit decreasing and with best fit in orders near it. The best individual comes first and never gets worse. All
    generations run: where no bin can be saved, they gather the free room in few bins."""
    rng, n = random.Random(seed), len(sizes)
    if not n:
        return [[]]
    people = [_of(a, sizes, capacity) for a in [*population, *guests]]
    while len(people) < POPULATION:
        wide = 0.3 * len(people)
        order = sorted(range(n), key=lambda i: (-sizes[i] * (1 + wide * rng.random()), i))
        one: tuple[list, list] = ([], [])
        best_fit(one[0], one[1], order, sizes, capacity)
        people.append(one)
    ranked = sorted(((fitness(p[1], capacity), p) for p in people), key=lambda r: r[0], reverse=True)
    for _ in range(GENERATIONS):
        a, b = (min(rng.sample(range(len(ranked)), 2)) for _ in range(2))
        child = crossover(ranked[a][1], ranked[b][1], sizes, capacity, rng)
        ranked.append((fitness(child[1], capacity), child))
        ranked.sort(key=lambda r: r[0], reverse=True)
        del ranked[POPULATION:]
    return [_to(p, n) for _, p in ranked[:POPULATION]]


def search(sizes: list[int], capacity: int, cell: int) -> list[int]:
    """The bin of each item in the best individual of all islands of a cell. Between epochs each island sends its best to
    the next."""
    islands: list[tuple[list, list]] = [([], [])] * ISLANDS
    for epoch in range(EPOCHS):
        people = [evolve(sizes, *p, capacity, seed=hash((cell, k, epoch))) for k, p in enumerate(islands)]
        islands = [(p, [people[k - 1][0]]) for k, p in enumerate(people)]
    best = [p[0] for p in people]
    return best[max(range(ISLANDS), key=lambda k: (fitness(_of(best[k], sizes, capacity)[1], capacity), -k))]


def _search(capacity: int):
    def run(batches):
        for b in batches:
            for one in (b.slice(k, 1) for k in range(b.num_rows)):
                sizes = [-w for w in pc.struct_field(pc.list_flatten(one.column(1)), [0]).to_pylist()]
                found = search(sizes, capacity, one.column(0)[0].as_py())
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([found], pa.list_(pa.int32()))], names=["cell", "items", "bin"])

    return run


def _count(batches):
    for b in batches:
        for lo, hi, _, off in word_blocks(b.column(1)):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(off).astype(np.int64))], names=["doc_id", "words"])


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, words, bin_id, start): the sequence that each piece of each document goes to and its first
    word there. No sequence holds more than ``capacity`` words and every word of every document is in one.

    A document of more than ``capacity`` words is cut: its full pieces are sequences of their own, the rest is packed.
    Items are spread by a hash of their row numbers over cells of about 300 sequences (of about 2048 items where they are
    short), each a packing problem of its own; a cell costs a part of a sequence at its border. Three islands evolve every
    cell from different starts; between epochs each island sends its best individual to the next; the best of all is
    the result.

    Null doc_id or text and texts without a word give no row. Repeated rows are packed each, and spread like any others.
    Items of equal size are ordered by doc_id. Very long texts are cut as above. Extra columns are never read. An empty
    table gives an empty result."""
    counts = stash(ids_and_text(docs).mapInArrow(_count, "doc_id long, words long").where("words > 0"), "lengths")
    cap = F.lit(capacity)
    full = F.floor(F.col("words") / cap)
    rest = counts.select("doc_id", full.cast("int").alias("piece"), (F.col("words") % cap).cast("int").alias("words")).where("words > 0")
    items, total = rest.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    cells = max(1, math.ceil(total / (capacity * CELL_BINS)), math.ceil(items / CELL_ITEMS))
    rest = rest.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)))
    # one cell is the unit of work: its populations stay in the worker, only the best individual becomes a row
    parts = max(1, min(10_000, cells * ISLANDS // 8))
    problem = rest.repartition(parts, "cell").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct((-F.col("words")).alias("w"), "doc_id", "piece"))).alias("items"))
    best = stash(problem.mapInArrow(_search(capacity), "cell long, items array<struct<w: int, doc_id: long, piece: int>>, bin array<int>"), "cells")
    placed = best.select("cell", F.explode(F.arrays_zip("items", "bin")).alias("x"))
    rows = placed.groupBy("cell", F.col("x.bin").alias("bin")).agg(F.sort_array(F.collect_list("x.items")).alias("items"))
    # a bin's pieces follow one another in item order
    starts = F.transform("items", lambda x, k: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), (-x["w"]).alias("words"), F.aggregate(F.slice("items", 1, k), F.lit(0), lambda s, y: s - y["w"]).alias("start")))
    packed = rows.select((F.col("cell") * F.lit(1 << 20) + F.col("bin")).alias("bin_id"), F.explode(starts).alias("i")).select("i.doc_id", "i.piece", "i.words", "bin_id", "i.start")
    whole = counts.where(full > 0).select("doc_id", F.posexplode(F.sequence(F.lit(1), full.cast("int"))).alias("piece", "_"))
    alone = whole.select("doc_id", "piece", cap.cast("int").alias("words"), (-F.monotonically_increasing_id() - 1).alias("bin_id"), F.lit(0).alias("start"))
    return packed.unionByName(alone)
