import random
import re

import pytest
from pyspark.sql import functions as F

from wordmill.functions import pinyin, similarity, tokenize
from wordmill.operators import highlight, rank
from wordmill.plans.query import query_terms

BORDERS = [0x33FF, 0x3400, 0x4DBF, 0x4DC0, 0x4E00, 0x9FFF, 0xA000, 0xAC00, 0xE000, 0xF8FF, 0xF900, 0xFAFF, 0xFB00, 0x2F7FF, 0x2F800, 0x2FA1F, 0x2FA20, 0x1F600, 0xA0, 0x85, 0x2000, 0x200A, 0x2028, 0x3000, 0x0B, 0x3042]


def reference_tokens(text):
    """One character after another: (start, end, term), offsets in bytes."""
    han = lambda c: any(a <= ord(c) <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))
    blank = lambda c: ord(c) in {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    size = lambda s: len(s.encode())
    out, i = [], 0
    while i < len(text):
        c, j = text[i], i + 1
        if blank(c):
            i = j
            continue
        if han(c):
            while j < len(text) and han(text[j]):
                j += 1
            grams = {(a, a + k) for a in range(i, j) for k in range(1, 5) if a + k <= j} | {(i, j)}
            out += [(size(text[:a]), size(text[:b]), text[a:b]) for a, b in sorted(grams)]
        elif c.isascii() and c.isalpha():
            j = i + re.match(r"[A-Za-z][A-Za-z0-9_-]*", text[i:]).end()
            out.append((size(text[:i]), size(text[:j]), text[i:j].lower()))
        elif c.isascii() and c.isdigit():
            j = i + re.match(r"[0-9]+", text[i:]).end()
            out.append((size(text[:i]), size(text[:j]), text[i:j]))
        else:
            out.append((size(text[:i]), size(text[:j]), c))
        i = j
    return out


def test_tokens_of_any_text(spark):
    rng = random.Random(4)
    alphabet = [*map(chr, BORDERS), *"aB1_- é,Ä\n汉字京"]
    texts = ["Rust是一门, Go", "Hello world from Rust", "", "x_y-1 2z", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in tokenize.tokens(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.term))
    for k, t in enumerate(texts):
        assert got.get(k, []) == reference_tokens(t), t
    for r in df.select("doc_id", tokenize.terms(F.col("text")).alias("t")).collect():
        assert r.t == [x[2] for x in reference_tokens(texts[r.doc_id])] == query_terms(texts[r.doc_id])


def test_kinds_and_chars(spark):
    df = spark.createDataFrame([(1, "Ab 1 汉 é, ٣")], "doc_id long, text string")
    assert [r.kind for r in tokenize.tokens(df).orderBy("pos").collect()] == ["English", "Number", "Chinese", "Symbol", "Symbol", "Symbol"]
    chars = [(r.term, r.kind) for r in tokenize.tokenize_chars(df).orderBy("pos").collect()]
    assert chars == [("a", "English"), ("b", "English"), ("1", "Number"), ("汉", "Chinese"), ("é", "English"), (",", "Symbol"), ("٣", "Number")]


def test_token_ngrams(spark):
    df = spark.createDataFrame([(1, "quick brown fox")], "doc_id long, text string")
    grams = lambda n: [r.term for r in tokenize.tokenize_ngrams(df, n).collect()]
    assert sorted(grams(2)) == ["brown", "brownfox", "fox", "quick", "quickbrown"]
    assert grams(0) == [] and len(grams(3)) == 6


@pytest.mark.parametrize(
    ("a", "b", "lev", "dam", "lcs"),
    [("hello", "hello", 0, 0, 1.0), ("hello", "hallo", 1, 1, 0.8), ("hello", "hell", 1, 1, 0.8), ("你好世界", "你好", 2, 2, 0.5), ("ca", "abc", 3, 2, 1 / 3), ("", "ab", 2, 2, 0.0), ("ab", "ba", 2, 1, 0.5)],
)
def test_distances(spark, a, b, lev, dam, lcs):
    df = similarity.register(spark.createDataFrame([(a, b)], "a string, b string"))
    x, y = F.col("a"), F.col("b")
    row = df.select(similarity.levenshtein_distance(x, y), similarity.damerau_levenshtein(x, y), similarity.lcs_similarity(x, y), similarity.is_fuzzy_match(x, y, 2)).first()
    assert row[0] == lev and row[1] == dam and row[2] == pytest.approx(lcs) and row[3] == (lev <= 2)


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(similarity.jaccard_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_fuzzy_matching(spark):
    words = spark.createDataFrame([(w,) for w in ["hello", "hallo", "help", "world", "hellos", "hell"]], "term string")
    got = similarity.fuzzy_matches(words, "hello", 2).collect()
    assert [r.term for r in got] == ["hello", "hallo", "hellos", "hell", "help"] and got[0].score == 1.0
    assert [r.term for r in similarity.fuzzy_matches_with_prefix(words, "hell", 2).collect()][:2] == ["hell", "hello"]
    assert similarity.fuzzy_matches(words, "", 2).count() == similarity.fuzzy_matches(words, "x", 2, 0).count() == 0
    assert similarity.fuzzy_matches(words, "worldabcd", 9).count() == 0


def test_pinyin(spark):
    assert pinyin.to_plain_pinyin(spark, "北京") == "bei jing" and pinyin.to_first_letters(spark, "北京 x") == "bj"
    assert pinyin.to_full_pinyin(spark, "北") != "bei"
    words = pinyin.pinyin_terms(spark.createDataFrame([("北京",), ("背景",), ("上海",), ("rust",), ("汉" * 33,)], "term string"))
    find = lambda q: [r.term for r in pinyin.search_by_pinyin(words, q).collect()]
    assert find("beijing") == ["北京", "背景"] == find("bj") and find("Shang Hai") == ["上海"] and find(" ") == []
    detail = lambda q, **k: [r.term for r in pinyin.search_by_pinyin_detailed(words, q, **k).collect()]
    assert detail("jing") == ["北京", "背景"] and detail("bj") == [] and detail("bj", initials=True) == ["北京", "背景"]
    df = spark.createDataFrame([("北京",)], "t string").withColumn("r", pinyin.readings(spark, F.col("t")))
    assert list(df.select(pinyin.pinyin_matches(F.col("r"), "bei"), pinyin.pinyin_matches(F.col("r"), "shang"), pinyin.pinyin_matches(F.col("r"), "")).first()) == [True, False, False]


def test_merged_spans(spark):
    cases = [([(1, 6), (4, 9), (11, 16)], [(1, 9), (11, 16)]), ([(0, 2), (2, 4)], [(0, 2), (2, 4)]), ([], []), ([(5, 6), (0, 9)], [(0, 9)]), ([(0, 9), (1, 2), (3, 12)], [(0, 12)])]
    df = spark.createDataFrame([(k, *s) for k, (spans, _) in enumerate(cases) for s in spans], "doc_id int, start int, end int")
    got = highlight.merge_rows(df).collect()
    assert [sorted((r.start, r.end) for r in got if r.doc_id == k) for k in range(len(cases))] == [b for _, b in cases]


def test_highlighting_runs_of_chinese(spark):
    df = spark.createDataFrame([(0, "他住北京大前门，小前门里月亮圆"), (1, "x")], "doc_id long, text string")
    row = highlight.highlight(df, ["北京", "前门"]).collect()
    assert [(r.doc_id, r.highlighted, r.start, r.end) for r in row] == [(0, "他住<em>北京</em>大<em>前门</em>，小<em>前门</em>里月亮圆", 6, 33)]


def test_proximity_is_of_the_closest_places(spark):
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(200), rng.randrange(1, 20))), sorted(rng.sample(range(200, 400), 5) if k % 2 else rng.sample(range(0, 400), 9))) for k in range(50)]
    rows = [(p, [x for x in q if x not in p] or [999]) for p, q in rows]
    df = spark.createDataFrame(rows, "p array<int>, q array<int>")
    got = [r[0] for r in df.select(rank._closest(F.col("p"), F.col("q"))).collect()]
    assert got == [min(abs(a - b) for a in p for b in q) for p, q in rows]
