import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wordmill.llm import components, minhash, postings, substring, suffix, tokens
from wordmill.llm.common import table

SF = "/root/testdata/sf0.001"
PASSAGES = "doc_id long, text string"


def words_of(text):
    import regex

    return regex.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def test_word_hashes_agree_with_a_regular_expression():
    rng = random.Random(3)
    texts = ["", None, "A b-c É%%x9", "éa" * 5, *("".join(rng.choice("aB é9-.\n漢") for _ in range(rng.randrange(60))) for _ in range(200))]
    got = []
    for lo, hi, h, off in tokens.word_blocks(pa.array(texts)):
        got += [h[off[k] : off[k + 1]].tolist() for k in range(hi - lo)]
    want = [words_of(t or "") for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    names = {}
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert names.setdefault(b, a) == a
    assert len(set(names.values())) == len(names)


def test_long_text_is_cut_between_words(monkeypatch):
    text = " ".join(f"w{k}" for k in range(4000))
    whole = next(tokens.word_blocks(pa.array([text])))[2]
    monkeypatch.setattr(tokens, "BLOCK", 500)
    parts = next(tokens.word_blocks(pa.array([text])))[2]
    assert np.array_equal(whole, parts)


def test_span_hashes_depend_on_content_only():
    h = np.arange(1, 40, dtype=np.uint64)
    both = tokens.spans(np.concatenate([h, h]), 7)
    assert np.array_equal(both[: len(h) - 6], both[len(h) : len(h) + len(h) - 6])
    assert len(np.unique(both[: len(h)])) == len(h)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    got = components.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.id, r.root) for r in got} == want


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    for j in (0.95, 0.8, 0.6):
        same, n = int(400 * j), 400
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: int(2 * same / (1 + j) / 1)], rng.integers(0, 1 << 63, n, dtype=np.uint64)])[:n]
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        m = minhash.samples(np.concatenate([a, b]), np.array([n, n]))
        sk = minhash.odd_sketch(m)
        est = minhash.similarity(np.bitwise_count(sk[0] ^ sk[1]).sum())
        assert abs(est - true) < 0.15


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    docs = {r.doc_id: shingles(r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = minhash.near_duplicates(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    group = {r.doc_id: r.group_id for r in got}
    ids, near, hit = sorted(docs), 0, 0
    best = defaultdict(float)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = docs[a], docs[b]
            if min(len(x), len(y)) < 0.4 * max(len(x), len(y)) or not x or not y:
                continue
            j = len(x & y) / len(x | y)
            best[a], best[b] = max(best[a], j), max(best[b], j)
            if j >= minhash.SIMILAR:
                near += 1
                hit += group.get(a, -1) == group.get(b, -2)
    assert near and hit >= 0.95 * near
    assert all(best[d] >= 0.4 for d in group)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.group_id] += 1
    assert all(r.group_size == sizes[r.group_id] and r.keep == (r.doc_id == r.group_id) and r.group_size > 1 for r in got)


def test_bucket_links_leave_no_member_out():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    near = np.stack([base] * 500)
    near[np.arange(500), rng.integers(0, 8, 500)] ^= np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64)
    other = rng.integers(0, 1 << 63, (3, 8), dtype=np.uint64)
    edges = minhash.link_bucket(np.arange(503), np.concatenate([near, other]))
    assert {v for _, v in edges} == set(range(1, 500))


def test_buckets_whose_first_member_is_unlike_the_others(spark):
    """Texts that share bands with a smaller id without being near it, ids with several texts, and a null id."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1, " ".join([*base[:48], *(rng.choice(words) for _ in range(90))]))]
    for k in range(2, 40):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(w)))
    rows += [(50, rows[5][1]), (50, "another text altogether " * 3), (51, "another text altogether " * 3), (None, rows[3][1]), (60, " ".join(rng.choice(words) for _ in range(100)))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, PASSAGES)).collect()
    assert {r.doc_id: r.group_id for r in got} == {k: 2 for k in [*range(2, 40), 50, 51]}


def brute_passages(rows, size):
    """Maximal intervals of repeated windows by comparing word tuples."""
    docs = {(i, t) for i, t in rows if i is not None and t is not None}
    at = defaultdict(set)
    for i, t in docs:
        w = words_of(t)
        for k in range(len(w) - size + 1):
            at[tuple(w[k : k + size])].add((i, k))
    marks = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for p in places:
                marks[p[0], p == min(places)].add(p[1])
    out = set()
    for (i, keep), starts in marks.items():
        starts = sorted(starts)
        begin = last = starts[0]
        for s in [*starts[1:], None]:
            if s is None or s - last > size:
                out.add((i, begin, last + size, last + size - begin, keep))
                begin = s
            last = s
    return out


def passages(n, seed, alphabet=40):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(10, 60))) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(pool) if rng.random() < 0.4 else f"u{rng.randrange(10**6)} x{rng.randrange(9)}" for _ in range(rng.randrange(0, 12)))) for k in range(n)]
    return rows + [rows[3], (3, "w1 " * 70), (None, rows[5][1]), (n + 1, None), (n + 2, ""), (n + 3, "a " * 200), (n + 4, rows[4][1])]


@pytest.mark.parametrize("operator", [substring.repeated_passages, suffix.repeated_suffixes])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_against_all_windows(spark, operator, seed):
    rows = passages(40, seed)
    df = spark.createDataFrame(rows, PASSAGES)
    size = {"window": 20} if operator is substring.repeated_passages else {"threshold": 20, "base": 9}
    assert {tuple(r) for r in operator(df, **size).select("doc_id", "start", "end", "words", "keep").collect()} == brute_passages(rows, 20)


def test_suffix_rounds_grow_to_the_threshold():
    assert suffix.lengths(50, 8) == [(8, 8), (16, 16), (32, 18)]
    assert suffix.lengths(50, 1) == [(1, 1), (2, 2), (4, 4), (8, 8), (16, 16), (32, 18)]


@pytest.mark.parametrize("base", [1, 8, 64])
def test_any_first_length_gives_the_same_passages(spark, base):
    rows = passages(30, 9)
    df = spark.createDataFrame(rows, PASSAGES)
    got = suffix.repeated_suffixes(df, threshold=30, base=base).select("doc_id", "start", "end", "words", "keep")
    assert {tuple(r) for r in got.collect()} == brute_passages(rows, 30)


@pytest.mark.parametrize("operator", [substring.repeated_passages, suffix.repeated_suffixes])
def test_many_texts_of_one_id_are_told_apart(spark, operator):
    rng = random.Random(6)
    text = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    rows = [(1, text(60)) for _ in range(300)]
    rows += [(2, rows[7][1]), (3, rows[200][1] + " end")]
    got = {tuple(r) for r in operator(spark.createDataFrame(rows, PASSAGES)).collect()}
    assert got == brute_passages(rows, 50) == {(1, 0, 60, 60, True), (2, 0, 60, 60, False), (3, 0, 60, 60, False)}


@pytest.mark.parametrize("n", [1, 3, 100, 20_000])
def test_packed_places_come_back(n):
    rng = np.random.default_rng(n)
    doc, text = np.repeat(rng.integers(-5, 1 << 60, 40), 500), np.repeat(rng.integers(0, 1 << 63, 40, dtype=np.uint64), 500)
    pos = np.concatenate([np.sort(rng.choice(200_000, 500, replace=False)) for _ in range(40)])
    key, small = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), rng.integers(0, 99, 20_000).astype(np.uint16)
    bucket = postings.buckets(tokens.mix(key), n)
    b = postings.pack(bucket, n, doc, text, pos, [key, small], 4)
    back = postings.unpack(postings.blobs([b])[4], ["<u8", "<u2"])
    assert sorted(zip(*(x.tolist() for x in (doc, text, pos, key, small)))) == sorted(zip(*(x.tolist() for x in (*back[:3], *back[3]))))
    assert b.column(0).to_pylist() == sorted(set(bucket.tolist()))



@pytest.mark.parametrize("unit", [1, 300, 1 << 20])
def test_windows_counted_within_and_across_units(monkeypatch, unit):
    """The tasks by hand, with units of any size: some windows repeat within a unit, some across, some in both."""
    monkeypatch.setattr(postings, "UNIT", unit)
    rows = passages(40, 3) + [(5000 + k, "hot " * 3 + " ".join(f"h{i}" for i in range(30))) for k in range(60)]
    rows = [r for r in rows if None not in r]
    n = 3

    def exchange(parts):
        out = [[] for _ in range(n)]
        for b in parts:
            for k in range(n):
                out[k].append(b.filter(pa.array([x == k for x in b.column(0).to_pylist()])))
        return out

    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part])], names=["doc_id", "text"]) for part in (rows[:30], rows[30:])]
    counted = [b for part in exchange(substring._map(20, n)(batches)) for b in substring._count(n)(part)]
    got = {tuple(r.values()) for part in exchange(counted) for b in postings.intervals(20)(part) for r in b.to_pylist()}
    assert got == brute_passages(rows, 20)
