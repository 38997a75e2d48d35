import random

import pytest
from pyspark.sql import functions as F

from galley.functions import rules, scripts
from galley.functions.cost import estimated_tokens, prompt_budget
from galley.operators import programs, units

TEXTS = [None, "", " ", "One. Two! Three? Four", "He paid 3.5 coins. Then left... slowly", "你好。再见！走吧", 'She said "Go." Then left.\n\nNew', "a, " * 300, "word; " * 90 + "end", "x" * 1000, "Mr. A. B", "tail  \n", "no", "！"]


def column(spark, values, expr, name="text"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_units_are_lossless(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "bc ", ". ", "! ", "... ", "9.", ", ", "; ", "。", '" ', "\n", " — "]) for _ in range(rng.randrange(400))) for _ in range(200)]
    for got, text in zip(column(spark, texts, units.units("text")), texts):
        assert "".join(got) == (text or "")
        assert all(len(u) > 0 for u in got)


def test_units_cases(spark):
    got = column(spark, ["First sentence here. Second one follows! 你好吗。 好的好的好的好的好的好的。好的"], units.units("text"))[0]
    assert got == ["First sentence here. ", "Second one follows! ", "你好吗。 ", "好的好的好的好的好的好的。好的"]
    got = column(spark, ["A long enough sentence. ok"], units.units("text"))[0]
    assert got == ["A long enough sentence. ok"]
    assert all(len(u) <= 240 for u in column(spark, ["x" * 1000], units.units("text"))[0])


def naive_absorb(spans):
    def join(xs):
        out = []
        for k, t in xs:
            if out and out[-1][0] == k:
                out[-1] = (k, out[-1][1] + t)
            else:
                out.append((k, t))
        return out

    spans = join(spans)
    while True:
        for i in range(1, len(spans) - 1):
            if spans[i][0] == "KEEP" and len(spans[i][1].strip()) < 48 and spans[i - 1][0] == spans[i + 1][0] == "REPLACE":
                spans = join([*spans[:i], ("REPLACE", spans[i][1]), *spans[i + 1 :]])
                break
        else:
            return spans


def test_absorb_is_the_fixpoint(spark):
    rng = random.Random(2)
    rows = [[(rng.choice(["KEEP", "REPLACE"]), rng.choice("ab") * rng.choice([1, 10, 47, 48, 60])) for _ in range(rng.randrange(1, 12))] for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<struct<kind:string,text:string>>")
    got = [[(x.kind, x.text) for x in r[0]] for r in df.orderBy("i").select(programs.absorb_bridges(F.col("p"))).collect()]
    assert got == [naive_absorb(r) for r in rows]


DIRTY = "Her eyes flashed brightly at the strange old door. "
CLEAN = "The morning was quiet and nobody in the whole long street had woken yet at that hour. "


@pytest.mark.parametrize(
    "text, tag, skip, force, kinds",
    [
        ("", "p", "auto", True, ["KEEP"]), (CLEAN, "p", "auto", False, ["KEEP"]), (CLEAN, "p", "auto", True, ["REPLACE"]), (CLEAN * 2, "p", "auto", True, ["REPLACE", "KEEP"]), (CLEAN * 2, "p", "off", False, ["REPLACE"]),
        (CLEAN + DIRTY + CLEAN, "p", "auto", True, ["KEEP", "REPLACE", "KEEP"]), (DIRTY + "Short one here. " + DIRTY, "p", "auto", True, ["REPLACE"]), (DIRTY * 4 + "Short keep it is.", "p", "auto", True, ["REPLACE"]), (CLEAN * 2, "h2", "auto", True, ["REPLACE"]),
    ],
)
def test_programs(spark, text, tag, skip, force, kinds):
    df = spark.createDataFrame([(text, tag)], "text string, tag string")
    got = df.select(programs.edit_program("text", "tag", "polish", skip, force)).first()[0]
    assert [x.kind for x in got] == kinds and "".join(x.text for x in got) == text


def test_program_of_null(spark):
    got = column(spark, [None], programs.edit_program("text", F.lit("p")))[0]
    assert [(x.kind, x.text) for x in got] == [("KEEP", "")]


def test_jobs_have_clipped_context(spark):
    df = spark.createDataFrame([(1, [("KEEP", "a" * 300 + " "), ("REPLACE", "x"), ("KEEP", " " + "b" * 300), ("REPLACE", "y")], "z")], "seg_id int, program array<struct<kind:string,text:string>>, before string")
    a, b = programs.job_table(df).orderBy("span_index").collect()
    assert a.before == "…" + "a" * 280 and a.after == "b" * 280 + "…" and b.before == "…" + "b" * 280 and b.after == ""


def test_routing(spark):
    rows = [("12", "p", False), ("page 3/9", "p", False), ("Contents", "p", False), ("…", "p", False), (None, "p", False), ("He could not help but laugh.", "p", True), ("He could not help but laugh.", "pre", False), ("A calm day.", "p", False), ("他笑了。", "p", True), ("the YOUTH left", "p", True), ("the youthful man", "p", False), ("the the", "h1", True), ("suddenly discovered", "h1", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, tag string, want boolean")
    assert all(r[0] == r[1] for r in df.select(rules.needs_rewrite("text", "tag"), "want").collect())


def test_scripts_and_costs(spark):
    assert column(spark, ["Привет всем", "hello", "", None, "ありがとう hi"], scripts.mode("text")) == ["translate", "polish", "polish", "polish", "translate"]
    assert column(spark, ["Привет", "ひらがな漢字漢字", "hello", "สวัสดี"], scripts.source_language("text")) == ["rus_Cyrl", "jpn_Jpan", "zho_Hans", "tha_Thai"]
    assert column(spark, ["", None, "a", "abcdefghijklm", "漢字"], estimated_tokens("text")) == [0, 0, 1, 6, 3]
    assert prompt_budget(4096) == 2048 and prompt_budget(100) == 256
