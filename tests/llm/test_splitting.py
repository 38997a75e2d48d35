import random

import pytest

from galley.llm.splitting import _best, _sparse_table, pieces, split_oversized


def brute(keys, i, j):
    return max(keys[i : j + 1])


def test_sparse_table_is_range_maximum():
    import numpy as np

    rng = random.Random(1)
    keys = np.array([rng.randrange(50) for _ in range(300)])
    levels = _sparse_table(keys)
    for _ in range(500):
        i = rng.randrange(300)
        j = rng.randrange(i, 300)
        assert _best(levels, i, j) == brute(keys.tolist(), i, j)


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, "One. Two? " * 400, "句子。" * 2000, "é" * 1500, "para one\n\n" * 300, "a" * 100_000 + " b" * 900])
def test_pieces_are_under_the_limit_and_overlap_exactly(text):
    cut = pieces(text)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(0 < b - a <= 1000 for a, b in cut)
    assert all(nxt[0] == prev[1] - 100 for prev, nxt in zip(cut, cut[1:]))


def test_cuts_at_the_strongest_border_and_rightmost_of_equals():
    text = "aaaa. " * 90 + "\n\n" + "bbbb. " * 120
    first = pieces(text)[0]
    assert text[: first[1]].endswith("\n\n")
    text = "aaaa bbb. " * 150
    assert pieces(text)[0] == (0, 1000)


def test_never_within_a_letter_and_its_accent():
    assert all(b % 2 == 0 for _, b in pieces("é" * 1500))


def test_rows(spark):
    df = spark.createDataFrame([("s", 1, None, 0), ("s", 2, "", 0), ("s", 3, "x" * 1000, 0), ("s", 4, "y z " * 300, 0), ("s", 4, "y z " * 300, 0)], "src string, row_id bigint, text string, start int")
    out = split_oversized(df).collect()
    assert {r.row_id for r in out} == {4} and sum(r.piece_no == 0 for r in out) == 2
    assert split_oversized(df.limit(0)).count() == 0


def test_a_paragraph_break_in_the_lower_half_beats_blanks_above():
    text = "word " * 80 + "end.\n\n" + "word " * 200
    assert pieces(text)[0] == (0, text.index("\n\n") + 2)
