import random

import pytest

from wordmill.plans.query import And, CharMatch, Fuzzy, Not, Or, Phrase, Prefix, QueryParser, Term, exclude_terms, include_terms, phrases, query_terms

T = Term
CASES = {
    "hello": T("hello"),
    "hello world": And((T("hello"), T("world"))),
    "Hello AND World": And((T("hello"), T("world"))),
    "Rust and Python": And((T("rust"), T("python"))),
    "a or b": Or((T("a"), T("b"))),
    "a OR": And((T("a"), T("or"))),
    "a AND": T("a"),
    "hello -world": And((T("hello"), Not(T("world")))),
    "hello -world foo": And((T("hello"), Not(And((T("world"), T("foo")))))),
    "-a": Not(T("a")),
    "NOT deprecated": And((T("not"), T("deprecated"))),
    "+hello +world": And((T("+"), T("hello"), T("+"), T("world"))),
    '"web worker"': Phrase(("web", "worker")),
    '"a b" AND c': Phrase(("a", "b")),
    'c AND "a b"': And((T("c"), And((T('"'), T("a"), T("b"), T('"'))))),
    'c OR "a b"': Or((T("c"), And((T('"'), T("a"), T("b"), T('"'))))),
    "(a OR b) AND c": Or((And((T("("), T("a"))), And((And((T("b"), T(")"))), T("c"))))),
    "programing~": Fuzzy("programing", 2),
    "programing~9": Fuzzy("programing", 3),
    "rust programing~1": And((Fuzzy("rust", 1), Fuzzy("programing", 1))),
    "a~b c": Fuzzy("a", 2),
    "foo bar*": And((Prefix("foo"), Prefix("bar"))),
    "*": T("*"),
    "~2": And((T("~"), T("2"))),
    "北京": Or((And((T("北"), T("北京"), T("京"))), CharMatch(("北", "京")))),
    "北": T("北"),
    "": And(),
    "well-known": T("well-known"),
    "C++": And((T("c"), T("+"), T("+"))),
    "schpfö": And((T("schpf"), T("ö"))),
    "a -b OR c -d": Or((And((T("a"), Not(T("b")))), And((T("c"), Not(T("d")))))),
}


@pytest.mark.parametrize("text", CASES)
def test_golden_trees(text):
    assert QueryParser().parse(text).root == CASES[text]


def test_mixed_chinese():
    root = QueryParser().parse("Rust 语言").root
    assert root == Or((And((T("rust"), T("语"), T("语言"), T("言"))), CharMatch(tuple("Rust语言"))))


def test_pinyin_prefix():
    for text, term in (("pinyin:beijing", "beijing"), ("py:bj", "bj")):
        parsed = QueryParser().parse(text)
        assert parsed.use_pinyin and parsed.root == T(term)
    assert not QueryParser().parse("Pinyin:x").use_pinyin
    assert QueryParser(1).parse("a~").root == Fuzzy("a", 1)


def test_collected_terms():
    root = QueryParser().parse("b a -c OR x* -d").root
    assert include_terms(root, lambda p: [p + "1", p + "2"]) == ["a", "b", "x1", "x2"]
    assert exclude_terms(root) == ["c", "d"]
    assert phrases(QueryParser().parse('"a b"').root) == [("a", "b")] and phrases(QueryParser().parse('"a"').root) == []


def test_chinese_run_lengths():
    assert [len(query_terms("汉" * n)) for n in range(1, 9)] == [1, 3, 6, 10, 15, 19, 23, 27]


def test_any_text_parses():
    rng = random.Random(1)
    for _ in range(2000):
        QueryParser().parse("".join(rng.choice('aB1 -~*"()汉 é\tORAND') for _ in range(rng.randrange(12))))
