import pytest

from galley.llm.sentences import Splitter, corpus_abbreviations, corpus_words, p3_found, p3_sentences, sentence_spans

S = Splitter()
CASES = [
    "Dr. Hill met Mrs. Ames at 6 p.m. to talk.|It rained.",
    "“Stay!” Anna said.|She left.",
    '"Is it open?" Anna Bell asked, turning round.|Nobody spoke.',
    '"It is only rain." |Anna closed the window.'.replace(" |", "|"),
    "“Ask him?|Tell her?” a clerk demanded.|They went.",
    'He shouted "Stop!" and then "Wait!" before noon.|Good.',
    "The file a.b.txt was version 1.2.3 then.|Next one.",
    "It weighed approx. 5.5 kg, cf. No. 3 there.|Done.",
    "They brought ropes, bread, etc.|The ship left.",
    "J. R. Moor signed it.|Fine.",
    "9. First item here.|Second sentence.",
    "One ended.Two began.|".rstrip("|").replace(".T", ".|T"),
    "She waited... and waited.|Then slept.",
    "A line\nthat wraps.|New one.",
    "No mark here\n\n|Another paragraph",
    "„Nicht anfassen!“, rief Jan am Hafen.|Am 3. Tag suchte er z. B. das Garn.|Ende.",
    "« N’y touche pas ! » cria Luc.|Le chap. 3 finit ici.",
    "—¡No lo toques! —gritó Ana.|El cap. 3 termina.",
    "«Где ты?» — спросил он.|Гл. 2 кончается, т. е. всё.|Да.",
    "“别碰它！”他喊道。|路很长……最后空手而去。|好。",
    "「触るな！」と彼は叫んだ。|道は長い。",
    "「어디?」".replace("「", '"').replace("」", '"') + " 그가 물었다.|값은 2.5냥이다.|끝.",
    '"कहाँ मिला?" नील ने पूछा।|डॉ. मोहित आया।',
    "«أين وجدت؟» سأل سالم.|لم يأت أحد.",
    "มณีถามเมฆาเรื่องหวี |ธาราจ่ายเงิน 4.5 เหรียญเพื่อซื้อ",
    'His remark ("Really?") was cut.|Yes.',
    '("You are late!" someone called.)|It began.',
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    parts = case.split("|")
    text, starts, at = "", [], 0
    for p in parts:
        if text and not text[-1].isspace() and p[0].isascii() and parts[0] != "One ended.":
            text += " "
        starts.append(len(text))
        text += p
    assert S.starts(text) == starts


@pytest.mark.parametrize("text", [None, "", "  ", "\n\t"])
def test_nothing(text):
    assert S.starts(text) == []


def test_one_sentence_and_invisible_signs():
    assert S.starts("no end at all") == [0]
    assert S.starts("One​ ends. Tw­o begins.") == [0, 11]
    assert S.starts("​") == [0]


def test_document_evidence_decides():
    assert len(S.starts("The xqz. was small. See xqz. Hill for more.")) == 2


@pytest.mark.parametrize(
    "text, n",
    [
        ("He said no. Then he left.", 2), ("He took off his cap. The wind blew.", 2), ("She studied art. She left.", 2), ("See no. 5 and cap. IV there. Done.", 2), ("Gen. Hill met Col. Ames.", 1),
        ("They told Art to wait. She sat with Art. The bell rang.", 3), ("It had a span of dept. The dept was small.", 2),
        ("At 6 p.m. Selwyn met her. Nobody saw Selwyn leave.", 2), ("At 6 p.m. Nobody came.", 2), ("He saw Selwyn leave at 6 p.m. Selwyn slept.", 2),
    ],
)
def test_words_and_names_of_the_text_decide(text, n):
    assert len(S.starts(text)) == n


def test_words_of_the_corpus_decide(spark):
    df = spark.createDataFrame([("a sog and, one approx. two",)] * 9, "text string")
    words = corpus_words(df)
    assert words == {"sog"}
    assert len(Splitter(ordinary=words).starts("It was sog. Then it fell.")) == 2


def test_rows_and_corpus(spark):
    rows = [("s", i, f"The qvx. was {i}. Ask qvx. Hill now.") for i in range(40)] + [("s", 99, None), ("s", 98, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "src string, row_id bigint, text string, sent_no int")
    known = corpus_abbreviations(df.filter("row_id < 40").selectExpr("'the qvx. was x' AS text"))
    assert "qvx" in known
    out = sentence_spans(df).collect()
    assert {r.row_id for r in out} == set(range(40))
    text = dict((r[1], r[2]) for r in rows)
    for k in range(40):
        spans = sorted((r.sent_start, r.sent_end) for r in out if r.row_id == k)
        assert "".join(text[k][a:b] for a, b in spans) == text[k]
    assert sentence_spans(df.limit(0)).count() == 0


def test_evidence_decides_alike_at_every_size(spark):
    rows = [("s", i, f"The qvx. was {i}, the quvexin. was {i}. Done.") for i in range(6)] + [("s", 8, "Ask qvx. “Hill” now."), ("s", 9, "Ask quvexin. “Hill” now."), ("s", None, "Ask qvx. “Hill” now. Go.")]
    df = spark.createDataFrame(rows, "src string, row_id bigint, text string")
    many = df.unionByName(spark.range(700_000).selectExpr("'t' AS src", "id AS row_id", "'It ended. It began.' AS text"))
    for d in (df, many):
        out = sentence_spans(d).filter("src = 's' AND (row_id > 7 OR row_id IS NULL)").collect()
        assert sorted((r.row_id or 0, r.sent_no) for r in out) == [(0, 0), (0, 1), (8, 0), (9, 0)]


def test_sentences_of_every_segment(spark, tmp_path):
    rows = [(1, "p", "One went. Two went."), (2, "h1", "A title"), (3, None, "No tag. Still here."), (4, "td", "A cell"), (5, "pre", "code")]
    spark.createDataFrame(rows, "seg_id bigint, tag string, text string").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(7, "A span.")], "span_id bigint, text string").write.parquet(f"{tmp_path}/spans.parquet")
    assert {(r.src, r.row_id) for r in p3_sentences(spark, str(tmp_path)).collect()} == {*(("segments", i) for i in range(1, 6)), ("spans", 7)}
    assert [(r.src, r.row_id, r.sent_start) for r in p3_found(spark, str(tmp_path)).collect()] == [("segments", 1, 10)]


DOCS = [
    ("a", "s", 1, "They waited in the hall with the zlq. and the lamp."),
    ("a", "s", 2, "The zlq. Hill was there. It rained."),
    ("b", "s", 3, "The zlq. Hill was there. It rained."),
    ("c", "s", 4, "The vrk. was here, and a vrk of old."),
    ("c", "s", 5, "Nobody saw the vrk. Hill was there."),
    ("d", "s", 6, "In the end Morvane left, as Morvane does."),
    ("d", "s", 7, "At 6 p.m. Morvane met her. Then it rained."),
    ("e", "s", 8, "At 6 p.m. Morvane met her. Then it rained."),
    ("f", "s", 9, "The old Table is a table of oak."),
    ("f", "s", 10, "At 6 p.m. Table met her."),
    (None, "s", 11, "The zlq. and the lamp."),
    (None, "s", 12, "The zlq. Hill was there."),
    ("a", "s", None, "The zlq. Hill was there."),
    ("a", "t", 13, None),
]


@pytest.mark.parametrize("shared", [100_000, 0])
def test_one_row_of_a_document_tells_of_another(spark, shared):
    df = spark.createDataFrame([(d, s, i, t, 1) for d, s, i, t in DOCS], "doc string, src string, row_id bigint, text string, here int")
    out = sentence_spans(df, shared=shared).filter("sent_no > 0").collect()
    cuts = {i: sorted(r.sent_start for r in out if r.row_id == i) for _, _, i, _ in DOCS}
    at = lambda i, word: dict((k, t) for _, _, k, t in DOCS)[i].index(word)
    assert cuts[2] == [at(2, "It")] and cuts[3] == [at(3, "Hill"), at(3, "It")]
    assert cuts[5] == [at(5, "Hill")]  # seen without a period in its document
    assert cuts[7] == [at(7, "Then")] and cuts[8] == [at(8, "Morvane"), at(8, "Then")]
    assert cuts[10] == [at(10, "Table")] and cuts[12] == [at(12, "Hill")] and cuts[None] == []
