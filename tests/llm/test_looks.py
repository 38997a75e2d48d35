import itertools
import random

import pytest

from galley.llm.looks import classes, default_form, equal_looking, look_alike_classes, representatives, rewriter, uniform

ALIKE = [("ｆｉｎｅ", "fine"), ("ﬁne", "fine"), ("ｶﾞﾗ", "ガラ"), ("ё", "ë"), ("сорок", "copok".replace("k", "к")), ("á", "а́"), ("⾥", "里"), ("가", "가"), ("a b", "a b"), ("a​b", "ab"), ("Ν", "N")]
UNLIKE = [("a", "A"), ("‒", "-"), ("e", "é"), ("x²", "x2"), ("a b", "a\nb"), ("“a”", '"a"'), ("l", "I"), ("...", "…"), ("a b", "ab")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    assert default_form()(a) == default_form()(b)


@pytest.mark.parametrize("a, b", UNLIKE)
def test_unlike(a, b):
    assert default_form()(a) != default_form()(b)


def test_classes_are_disjoint_and_frequent_members_represent():
    members = list(itertools.chain(*classes()))
    assert len(members) == len(set(members))
    assert representatives({"е": 5, "e": 3})["e"] == "е"
    to = representatives({"e": 9, "е": 3, "s": 9, "t": 9})
    assert to["е"] == "e" and rewriter(to)("ﬆе") == "ste"


def test_forms_are_stable():
    f = default_form()
    for a, b in ALIKE:
        assert f(f(a)) == f(a)


@pytest.mark.parametrize("frequency", [{}, {"а": 9, "a": 1, "і": 8, "i": 2, "口": 5, "ロ": 1, "\uff9e": 9}])
def test_every_class_has_one_form_that_settles(frequency):
    f = rewriter(representatives(frequency))
    for c in classes():
        assert len({f(x) for x in c}) == 1, c
        for x in c:
            assert f(f(x)) == f(x)
    assert f("クﾞ") == f("グ") and f("\u3164\uffa0\u1160") == "" and f("อเเอ") == f("อแอ")
    for a, b in ("ɡg", "ɑa", "ѵv", "ᎪA"):
        assert f(a) == f(b)


def test_words_told_one_by_one_make_the_form_of_the_whole():
    to = representatives({})
    f = rewriter(to)
    rnd = random.Random(5)
    signs = [x for c in classes() for x in c] + list(" \u0301\u200b\u3099เअाe") * 300
    for _ in range(3000):
        text = "".join(rnd.choices(signs, k=12))
        g = f(text)
        assert f(g) == g and f(text + " " + text) == g + " " + g


def test_many_copies_in_two_spellings_stay_rows(spark):
    df = spark.createDataFrame([("s", i, "fine" if i % 2 else "ﬁne") for i in range(400)], "src string, row_id bigint, text string")
    assert look_alike_classes(df).count() == 400


def test_pairs_match_brute_force(spark):
    rows = [("s", i, t) for i, t in enumerate([None, "", " ", "​", "fine", "ﬁne", "ｆｉｎｅ", "fine", "Fine", "5", "5", "кот", "кoт", "a b", "a b"])]
    rows += [("g", i, t) for _, i, t in rows[4:6]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "src string, row_id bigint, text string, form string")
    f = default_form()
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] and b[2] and f(a[2]).strip() and a[2] != b[2] and f(a[2]) == f(b[2])}
    got = [tuple(r) for r in equal_looking(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("s", 4, 5) in want
    forms = {(r.src, r.row_id): r.form for r in uniform(df).collect()}
    assert forms["s", 0] is None and forms["s", 4] == forms["s", 6] and forms["s", 1] == ""
    assert equal_looking(df.limit(0)).count() == 0
