import random
from collections import Counter

import pytest

from galley.llm import mixture, packing, pairs, repeats, residue, tokens


# --- repeated share -------------------------------------------------------
@pytest.mark.parametrize("text, share", [(None, 0), ("", 0), (" ", 0), ("one two three", 0), ("a b c d e f " * 2, 0.5), ("1. A b, c d e f!\n2. a B c d. e f", 0.5), ("静かな門の前で彼は待っていた。" * 3, 2 / 3), ("na " * 12, 11 / 12)])
def test_repeated_share(text, share):
    assert repeats.repeated_share(text) == pytest.approx(share, abs=0.01)


def brute_share(seq, n):
    marked = set()
    for i in range(len(seq) - n + 1):
        if any(seq[j : j + n] == seq[i : i + n] for j in range(i)):
            marked.update(range(i, i + n))
    return len(marked) / len(seq) if seq else 0


def test_repeated_share_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randrange(40))]
        assert repeats.repeated_share(" ".join(words)) == pytest.approx(brute_share(words, 6))


# --- packing --------------------------------------------------------------
def test_lines_of_many_documents_are_removed(spark):
    rows = [(i, "h", f"- Read more.\nline {i}\n", "x") for i in range(5)] + [(10, "g", "Read more.\nown line", "x"), (11, None, None, "x"), (12, "h", "", "x"), (13, "h", " \n ", "x"), (14, "h", "1. READ  more.\nRead more.", "x")]
    df = spark.createDataFrame(rows, "edit_id bigint, book_id string, after string, signs string")
    got = {r.edit_id: r for r in repeats.without_frequent_lines(df, "edit_id", "book_id", "after").collect()}
    assert len(got) == len(rows)
    assert [got[k].n_removed for k in (0, 10, 11, 12, 13, 14)] == [1, 0, 0, 0, 0, 2] and got[14].rejected and got[0].rejected
    assert got[10].kept_share == got[11].kept_share == got[13].kept_share == 1.0 and abs(got[0].kept_share - 6 / 16) < 1e-9
    assert repeats.without_frequent_lines(df.limit(0), "edit_id", "book_id", "after").count() == 0


def test_fill_bins_is_fullest_first_and_whole():
    rng = random.Random(5)
    for _ in range(60):
        sizes = Counter(rng.randrange(1, 60) for _ in range(rng.randrange(1, 40)))
        bins = packing.fill_bins(sizes, 60)
        used = Counter()
        for combo, times in bins:
            assert sum(s * n for s, n in combo.items()) <= 60
            used.update({s: n * times for s, n in combo.items()})
        assert used == sizes
        reach = {0}
        for s in sizes.elements():
            reach |= {r + s for r in reach if r + s <= 60}
        first = bins[0][0]
        assert sum(s * n for s, n in first.items()) == max(reach)
    assert packing.fill_bins({}, 10) == []
    with pytest.raises(ValueError):
        packing.fill_bins({11: 1}, 10)


def test_packs(spark, monkeypatch):
    monkeypatch.setattr(packing, "_RANK_BLOCK", 20)
    rng = random.Random(7)
    rows = [(i, None if i % 9 == 0 else "hot" if i % 3 else f"it{i % 7}", "x" * rng.choice([40, 40, 40, 300, 700, 1168, 3000]), None, "", 5) for i in range(300)]
    jobs = spark.createDataFrame(rows, "job_id bigint, item_id string, text string, before string, after string, pack_no int")
    out = packing.job_packs(jobs).collect()
    assert {r.job_id for r in out} == set(range(300))
    room = Counter()
    for r in out:
        room[r.item_id, r.pack_no] += r.piece_size
    assert max(room.values()) <= 1200
    size = {i: len(t) + 32 for i, _, t, *_ in rows}
    by = {}
    for r in out:
        by.setdefault(r.job_id, []).append(r)
    for i, got in by.items():
        assert sorted(r.piece_no for r in got) == list(range(got[0].n_pieces))
        assert (len(got) > 1) == (size[i] > 1200)
        assert sum(r.piece_size - 32 for r in got) == size[i] - 32
    nos = {}
    for item, no in room:
        nos.setdefault(item, []).append(no)
    assert all(sorted(x) == list(range(len(x))) for x in nos.values())
    assert packing.job_packs(jobs.limit(0)).count() == 0


# --- token ids ------------------------------------------------------------
TEXTS = [None, "", " ", "\n\n", "Hello <|endoftext|> it's", "🪶📚 ñ ภาษาไทย 漢字 ", "word's  two   three\n\n" * 400, "x" * 3000, ("ab1 " * 50 + "  \n") * 20, "'ll 've" * 300]


def test_ids_equal_the_whole_encoding(spark):
    enc = tokens.vocabulary()[0]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids array<int>")
    for chunk, overlap in ((16_384, 256), (256, 32), (400, 64)):
        got = {r.doc_id: r.ids for r in tokens.token_ids(df, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    n = {r.doc_id: r.n_tokens for r in tokens.token_ids(df, chunk=256, overlap=32, count_only=True).collect()}
    assert n == {i: len(ids) for i, ids in got.items()}
    assert all(tokens.decode(got[i]) == (t or "") for i, t in enumerate(TEXTS))
    assert tokens.token_ids(df.limit(0)).count() == 0


# --- mixture --------------------------------------------------------------
def test_fit_is_exact_where_it_can_be():
    rng = random.Random(2)
    for _ in range(100):
        counts = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 25)))
        budget = rng.randrange(0, 300)
        take = mixture.fit(counts, budget)
        assert all(0 <= take[s] <= n for s, n in counts.items())
        reach = {0}
        for s in counts.elements():
            reach |= {r + s for r in reach if r + s <= budget}
        assert sum(s * n for s, n in take.items()) == max(reach)


def test_fit_does_not_depend_on_the_order_of_the_counts():
    rnd = random.Random(2)
    counts = {s: rnd.randint(1, 9) for s in rnd.sample(range(20, 3000), 400)}
    budget = sum(s * n for s, n in counts.items()) // 3
    items = list(counts.items())
    want = mixture.fit(counts, budget)
    for _ in range(3):
        rnd.shuffle(items)
        assert mixture.fit(dict(items), budget) == want


def test_fit_large():
    rng = random.Random(4)
    counts = Counter(rng.randrange(1, 8000) for _ in range(50_000))
    total = sum(s * n for s, n in counts.items())
    for part in (0.1, 0.5, 0.93):
        take = mixture.fit(counts, int(total * part))
        assert sum(s * n for s, n in take.items()) == int(total * part)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixture, "_RANK_BLOCK", 10)
    docs = [(i, " ".join(["word"] * (1 + i % 7)), ["A", " a ", "B", "c", None, "other"][i % 6], 1) for i in range(300)] + [(900, None, "a", 1), (901, "", "b", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, repeats int")
    t = spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 2), ("C ", 1.0, 3), ("gone", 1.0, 9)], "source string, weight double, max_repeats int")
    out, report = mixture.mix(d, t)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.repeats <= {"a": 1, "b": 2, "c": 3}[r.source] for r in rows)
    rep = {r.source: r for r in report.collect()}
    for s in "abc":
        assert sum(r.n_tokens * r.repeats for r in rows if r.source == s) == rep[s].tokens
        assert abs(rep[s].tokens - rep[s].budget_tokens) <= 7
    assert rep["gone"].tokens == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert mixture.mix(d.limit(0), t)[0].count() == 0


# --- pairs ----------------------------------------------------------------
def judge():
    en = "the quick brown fox jumps over the lazy dog and she walked to the harbour where the lamps were lit and nobody knew her name "
    de = "der schnelle braune fuchs springt und niemand wusste noch wer das alte heft gebracht hatte denn der weg war weit "
    return pairs.Judge(pairs.Languages.train([("en", en * 3), ("de", de * 3)]), {"aa.": 100, 'a."': 10, "aa,": 1})


def test_curly_apostrophes_refuse_too():
    judge = pairs.Judge(pairs.Languages(), {})
    for mark in "'’ʼ":
        assert judge.defect("The youth kept every rusty anchor he was given.", f"I won{mark}t be able to edit this content.") == "refusal"


def test_the_prompt_decides_between_like_languages():
    rows = [("en", "the house by the harbour is no more " * 3), ("es", "la casa del puerto no es mas que el mar " * 3), ("pt", "a casa do porto nao e mais que o mar " * 3)]
    judge = pairs.Judge(pairs.Languages.train(rows), {})
    p = judge.languages.posterior
    for text in ("no", "no more", "casa", "mas no"):
        for prompt in ("la casa del puerto", "the house", ""):
            q, asked = p(text), p(prompt)
            prior = {x: 0.5 * (x == "en") + 0.5 * asked.get(x, 0.0) + pairs.FLOOR for x in q}
            want = q["en"] < 0.5 and q["en"] * prior["en"] < 0.5 * sum(q[x] * prior[x] for x in q)
            assert judge._foreign(text, prompt) == want  # the prompt's posterior is only spared where it cannot decide


def test_ngrams_counted_by_tasks_are_those_of_the_driver(spark):
    rows = [(i, ("en", "de", "EN ", None)[i % 4], f"the cat {i} und der hund {i % 7}") for i in range(200)]
    got = pairs.train_languages(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    want = pairs.Languages.train([(lang.strip().lower(), t) for _, lang, t in rows if lang])
    assert got.names == want.names and all(abs(got.posterior(t)[x] - want.posterior(t)[x]) < 1e-9 for t in ("the cat", "der hund", "xyz") for x in got.names)


@pytest.mark.parametrize(
    "before, after, defect",
    [
        ("She walked home.", None, "empty"), ("She walked home.", "[1] ​", "empty"), ("She walked home.", "N/A", "empty"), ("She walked home.", "```\n```", "empty"), ("She walked home.", "(empty)", "empty"),
        ("She walked home.", "Sorry, I can't help with rewriting this passage.", "refusal"), ("She walked home.", "Request declined by the safety filter.", "refusal"),
        ("She walked home.", "Here is the edited text:\nshe  walkеd home", "copy"), ("Она ушла.", "«Она ушла»", "copy"),
        ("She walked to the harbour.", "Niemand wusste noch, wer das alte Heft gebracht hatte.", "language"), ("She walked.", "彼は待った。", "language"),
        ("She walked to the harbour.", "She walked to the har", "truncated"), ('She said, "It is late." Nobody knew.', 'She said, "It is', "truncated"), ("One went. Two went. Three went. Four went.", "One walked.", "truncated"),
        ("She walked to the harbour,", "She went to the harbour,", None), ("She walked to the harbour.", "She went to the harbour.", None), ('"I am sorry, but I cannot help you," she told him.', '"I am sorry, but I can\'t help you," she told him.', None),
        ("She walked to the lamps.", "She went to the lamps, la la la la la la la la la la la la la la la la", None), (None, "She walked home.", None), ("", "She walked home.", None),
    ],
)
def test_defects(before, after, defect):
    assert judge().defect(before, after) == defect


POLITE = "Thank you very much for sharing this wonderful chapter with me, it is clear that a great deal of care went into the people and their house, and I enjoyed it from the first line to the last one. "
REASONS = "The people in it are hurt at length. Nothing softens what is done to them. Readers would be led to look on. Some of them are children. Others never learn why. " * 4


@pytest.mark.parametrize(
    "before, after, defect",
    [
        ("She walked to the harbour where the lamps were lit.", POLITE + "However, I cannot rewrite it.", "refusal"),
        ("She walked to the harbour where the lamps were lit.", "I'm sorry, but I cannot rewrite this passage. " + REASONS, "refusal"),
        ("She walked to the harbour where the lamps were lit.", REASONS + "I must decline to edit the passage.", "refusal"),
        ("She walked to the harbour where the lamps were lit.", "I саnnot rеwrite this.", "refusal"), ("She walked to the harbour where the lamps were lit.", "Ｉ ｃａｎｎｏｔ rewrite this.", "refusal"),
        ("Er ging zum Hafen und niemand wusste noch, wer das alte Heft gebracht hatte.", "He walked to the harbour and nobody knew. The lamps were lit there. I could not help him then. " + "She walked home and the fox jumped over the dog. " * 3 + "She knew her name. He walked on. The dog was lazy. The lamps were quick. Nobody walked.", None),
    ],
)
def test_refusals_are_judged_whole(before, after, defect):
    assert judge().defect(before, after) == defect


LONG = "She walked to the harbour where the lamps were lit, and nobody knew her name."


@pytest.mark.parametrize(
    "before, after, defect",
    [
        (LONG, "I went over every line of this with care and in my view it already reads very well, so nothing was altered anywhere. " + LONG, "copy"),
        ("She left.", "I went over every line of this with care and in my view it already reads very well, so here it stands:\nShe left.", "copy"),
        (LONG, "To the harbour she walked, where lamps were lit; nobody there knew her name.\n\n" + LONG, None), ("She left.", "Nobody knew that she left.", None),
    ],
)
def test_copies_behind_any_announcement(before, after, defect):
    assert judge().defect(before, after) == defect


def test_defect_rows(spark):
    docs = spark.createDataFrame([(1, "EN", "the lamps were lit and she walked home"), (2, "de", "niemand wusste noch wer das heft brachte"), (3, None, "x"), (4, "en", None)], "doc_id bigint, lang string, text string")
    edits = spark.createDataFrame([(1, "She walked home.", None, "x"), (2, "She walked home.", "She went home.", "x"), (2, None, "She went home.", "x")], "edit_id bigint, before string, after string, defect string")
    assert sorted((r.edit_id, r.defect) for r in pairs.with_defects(edits, docs).collect() if r.defect) == [(1, "empty")]
    assert pairs.with_defects(edits.limit(0), docs.limit(0)).count() == 0


def test_ends_are_counted_by_script(spark):
    docs = spark.createDataFrame([(1, "en", "the lamps were lit and she walked home to the harbour"), (2, "th", "มณีถามเมฆาเรื่องหวี")], "doc_id bigint, lang string, text string")
    rows = [(i, "She walked to the harbour.", "She went to the harbour.") for i in range(20)] + [(100 + i, "มณีถามเมฆาเรื่องหวี", "She walked to the harbour.") for i in range(10)]
    rows += [(200, "She walked to the harbour.", "She walked to the har"), (201, "Она ушла домой", "She walked home.")]
    edits = spark.createDataFrame(rows, "edit_id bigint, before string, after string")
    ends = pairs.end_shapes(edits)
    assert ends == {("latin", "aa."): 21, ("thai", "aaa"): 10, ("cyrillic", "aaa"): 1}
    assert [(r.edit_id, r.defect) for r in pairs.with_defects(edits, docs).collect() if r.defect] == [(200, "truncated")]


# --- residue --------------------------------------------------------------
@pytest.mark.parametrize(
    "text, found",
    [
        (None, False), ("", False), ("  ", False), ("Please enable JavaScript to view this chapter.", True), ("A title\n\n404 Not Found\nRequest ID: 1e4fa991", True),
        ("Dear {{ name }}, your chapter ${title} is ready.", True), ("See you at {{place}} tomorrow.", True), ("Chapter undefined: undefined", True), ("Lorem ipsum dolor sit amet, consectetur elit.", True),
        ("Please try again later.", False), ('The help page "Please enable JavaScript" was rewritten because the editor found it rude.', False), ("Write '${date}' where the name belongs; the builder fills it in.", False),
        ("The header looks like this:\n\n```html\n<h1>{{ title }}</h1>\n```\n\nThat is all.", False), ("The room number was 404, and nobody found it.", False), ("She had a placeholder name until the author chose one.", False), ("[Laughter]", False), ("« Bonjour » dit-il.", False),
        ("Seite nicht gefunden (Fehler 404)", True), ("ページが見つかりません。", True), ("word " * 5000, False),
    ],
)
def test_residue(text, found):
    assert bool(residue.Index({}, 1000).document(text)) is found


def test_the_cheap_test_rejects_no_residue():
    path = "/srv/readinghall/volumes/emberfall/ch12.html"
    index = residue.Index({}, 1000)
    texts = [text.replace(" f", " {{ f }}").replace(" v", " undefined") for _, _, text in (x.partition(": ") for x in residue.EXEMPLARS.strip().splitlines())]
    texts += [f"404 {x}" for x in residue.REASONS] + ["502 nginx 1.2 3 4 gone", "Access denied. Fi\u0301n", "ÉRREUR", "Erreur 500 : une erreur interne est survenue", "you’re 404 not found"]
    accepted = 0
    for text in texts:
        for form in ("{}", "{}: " + path, path + " {}.", "{} (ab12cd34ef) reader-7.example.org", "{}\nReference no. 00c0ffee11", "{} ½ x²", "Tale 12: {}", "{} {} 5"):
            passage = form.replace("{}", text)
            if index.residue(passage):
                accepted += 1
                assert index.may_be(passage), passage
    assert accepted > 500
    assert index.document("404 Not Found: " + path) == "error"
    assert not index.may_be("She walked home to the harbour, and nobody knew her name.")


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Lorem ipsum dolor burnat vexum corit palum nevus tarem.", "filler"),
        ("Vexum corit amet palum, nevus tarem brunat. Solit dolorem parunt vexor.", "filler"),
        ("At vero eos et accusamus et iusto odio dignissimos ducimus.", "filler"),
        ("Lorem ipsum is the text that a designer puts where content belongs.", None),
        ("Los cantos eran largos y el hombre no sabe nada de eso, pero canta.", None),
        ("Il est venu au port et la porte était fermée; il a crié, et elle a chanté.", None),
        ("Das Album kam am Abend um acht, und es war gut, dass er im Haus ist.", None),
        ("It sat at the door; that is it, or so it felt at least.", None),
        ("La cantante amava il mare e la sua terra; alias magna est.", None),
    ],
)
def test_filler_in_words_of_no_list(text, kind):
    index = residue.Index()
    assert index.document(text) == kind
    assert index.may_be(text) or kind is None


def test_frequencies_of_every_script(spark):
    texts = ["Чтобы уйти, он ждал в саду. В саду!", "you’re here", "You're it doesn't", "页面不存在 été", "페이지를 찾을 수 없습니다 404", "इस पृष्ठ को", "página {{ page }} ab12cd34ef /srv/read.html undefined", None, ""]
    got, n = residue.document_frequencies(spark.createDataFrame([(x,) for x in texts], "text string"))
    want = Counter(w for x in texts if x for w in set(residue.tokens(x)) & residue.Index().vocabulary - residue._SIGNS)
    assert n == len(texts) and got == want
    assert {"чтобы", "в", "doesn't", "页面", "페이지를", "पृष्ठ", "página"} <= set(got)


def test_residue_rows(spark):
    df = spark.createDataFrame([(1, "TODO: write the synopsis.", "a"), (2, "She walked home.", "a"), (3, None, "a")], "doc_id bigint, text string, residue string")
    assert {r.doc_id: r.residue for r in residue.with_residue(df).collect()} == {1: "filler", 2: None, 3: None}
    assert residue.with_residue(df.limit(0)).count() == 0
