import random

import pytest
from pyspark.sql import functions as F

from galley.operators import answers, gate, packs, rounds
from galley.operators.programs import with_programs, job_table


def naive_packs(costs, budget):
    out, pack, size, filled = [], -1, 0, False
    for c in costs:
        if c > budget:
            pack, filled, size = pack + 1, False, 0
        else:
            if not filled or size + c > budget:
                pack, filled, size = pack + 1, True, 0
            size += c
        out.append(pack)
    return out


def test_greedy_packs(spark):
    rng = random.Random(3)
    groups = {g: [rng.randrange(1, 130) for _ in range(rng.randrange(1, 60))] for g in ["a", "b", None, "hot"]}
    rows = [(g, i, c, 0) for g, cs in groups.items() for i, c in enumerate(cs)]
    rng.shuffle(rows)
    got = {(r.g, r.i): r.pack_no for r in packs.greedy_packs(spark.createDataFrame(rows, "g string, i int, cost int, other int"), "g", ["i"], "cost", 100).collect()}
    assert got == {(g, i): p for g, cs in groups.items() for i, p in enumerate(naive_packs(cs, 100))}
    assert packs.greedy_packs(spark.createDataFrame([], "g string, i int, cost int"), "g", ["i"], "cost", 9).count() == 0


def naive_oversized(text, limit):
    if len(text) <= limit:
        return [text]
    parts = [text]
    for sep in ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? "]:
        nxt = []
        for part in parts:
            if len(part) <= limit:
                nxt.append(part)
                continue
            *init, last = part.split(sep)
            buf = ""
            for piece in [p + sep for p in init] + [last]:
                if buf and len(buf) + len(piece) > limit:
                    nxt.append(buf)
                    buf = piece
                else:
                    buf += piece
            if buf:
                nxt.append(buf)
        parts = nxt
    cut = [p[i : i + limit] for p in parts for i in range(0, max(1, len(p)), limit)]
    return [p.strip() for p in cut if p.strip()]


def test_split_oversized(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "x. ", "y! ", "。", "\n", "\n\n", "zzzzzzzzzzzzzzzzzzzzzzzz"]) for _ in range(rng.randrange(40))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    assert [r[0] for r in df.select(packs.split_oversized(F.col("text"), 40)).collect()] == [naive_oversized(t, 40) for t in texts]


@pytest.mark.parametrize(
    "raw, n, want",
    [
        ("[1] a\n[2] b", 2, ["a", "b"]), ("[2] b\n[1] a", 2, ["a", "b"]), ("**[1]** a\n[1] again\n[2] b", 2, ["a", "b"]), ("[1] a", 2, None), ("a\n\nb", 2, ["a", "b"]), ("a\n\nb\n\nc", 2, None), ("just this", 1, ["just this"]), ("[3] x", 1, ["[3] x".replace("[3] ", "")]),
        ("[1]\nREPLACE:\na\nKEEP after:\n[2] b", 2, ["a", "b"]), ("<think>[1] no</think>[1] a\n[2] b", 2, ["a", "b"]), ("```\n[1] a\n[2] b\n```", 2, ["a", "b"]), ("", 1, None), ("[1] a\nDo not change it\n[2] b", 2, ["a", "b"]), ("[99999999999999] a", 2, None), (None, 2, None),
    ],
)
def test_numbered_blocks(spark, raw, n, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(answers.numbered_blocks(answers.without_noise(F.col("raw")), F.lit(n))).first()[0] == want


@pytest.mark.parametrize(
    "out, src, before, after, want",
    [
        ("He ran. New text", "Old text", "…He ran.", "", "New text"), ("New text Then left.", "Old text", "", "Then left.…", "New text"), (" New ", "Old", "", "", "New"), ("B. Old A " * 3, "Old", "", "", "Old"), ("He ran.", "Old", "He ran.", "", "He ran."),
    ],
)
def test_trim_echo(spark, out, src, before, after, want):
    df = spark.createDataFrame([(out, src, before, after)], "o string, s string, b string, a string")
    assert df.select(answers.trim_echo(*[F.col(c) for c in "osba"])).first()[0] == want


SOURCE = "Anna Bell walked slowly through the dark harbour and counted every lamp."


@pytest.mark.parametrize(
    "source, output, reason",
    [
        (SOURCE, "Anna Bell went slowly through the dark harbour, counting every lamp.", None), (SOURCE, SOURCE, None), (SOURCE, "", "length"), (SOURCE, None, "length"), (SOURCE, "Anna Bell walked.", "length"), (SOURCE, SOURCE + " Do not change the names.", "leak"),
        (SOURCE, SOURCE + " And then she went back home again.", "echo"), (SOURCE, "Anna Bell went. She saw. Lamps. Dark harbour slowly counted.", "sentences"), (SOURCE, "Anna Bell went slowly through the dark harbour and counted every", "truncated"), (SOURCE, 'Anna Bell went slowly through the "dark harbour and counted every lamp.', "truncated"),
        (SOURCE, "Ann went slowly through the dark harbour and counted every lamp.", "anchors"), (SOURCE, "Anna Bell found nothing whatever interesting about yesterday's dull parliament.", "overlap"),
        (SOURCE, "Anna Bell walked slowly in the dark. Anna Bell walked slowly in the dark harbour lamp.", "duplicate"), ("他说“长安”而已。", "He said “长安” only", "truncated"),
    ],
)
def test_gate(spark, source, output, reason):
    df = spark.createDataFrame([(source, output)], "s string, o string")
    assert df.select(gate.rejection(F.col("s"), F.col("o"))).first()[0] == reason


SEGMENTS = [(1, "it1", 0, "p", "Her eyes flashed as the the bell rang in the quiet town at noon. "), (2, "it1", 1, "p", "Tom Hill could not help but smile at the old red lamp."), (3, "it1", 2, "p", "A calm day."), (4, "it2", 0, "p", "He suddenly discovered that the iron key was lost again.")]


def packed(spark):
    planned = with_programs(spark.createDataFrame(SEGMENTS, "seg_id bigint, item_id string, seg_index int, tag string, text string"))
    return planned, packs.span_packs(job_table(planned), 1200)


def test_rounds_accept_halve_and_keep(spark):
    planned, p = packed(spark)
    final = {r.seg_id: r for r in rounds.rewrite(p, rounds.rule_based).collect()}
    assert set(final) == {1, 2, 4} and final[2].final == "Tom Hill smiled at the old red lamp." and final[2].accepted
    text = {r.seg_id: r.new_text for r in rounds.stitch(planned, rounds.rewrite(p, rounds.rule_based)).collect()}
    assert text[4] == "He found that the iron key was lost again."

    never = lambda q: q.select("chunk_id", "attempt", F.lit("nothing useful").alias("raw"))
    kept = rounds.rewrite(p, never, retries=0).collect()
    assert len(kept) == 3 and not any(r.accepted for r in kept) and all(r.final == r.source for r in kept)

    def only_alone(q):
        return rounds.rule_based(q).withColumn("raw", F.when(F.col("chunk_id").contains("/"), F.col("raw")).otherwise(""))

    halved = {r.seg_id: r for r in rounds.rewrite(p.filter("item_id = 'it1'"), only_alone, retries=0).collect()}
    assert halved[2].accepted and "/" in halved[2].chunk_id


def test_stitch_edges(spark):
    programs = spark.createDataFrame([(1, [("REPLACE", "Old one. "), ("KEEP", "Then.")])], "seg_id int, program array<struct<kind:string,text:string>>")
    final = spark.createDataFrame([(1, 0, "Old one. ", "New one.", True)], "seg_id int, span_index int, source string, final string, accepted boolean")
    assert rounds.stitch(programs, final).first().new_text == "New one.Then."
    assert rounds.stitch(programs, final, preserve_edges=True).first().new_text == "New one. Then."
