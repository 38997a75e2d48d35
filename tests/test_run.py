from pyspark.sql import functions as F

from galley.operators.passages import assemble, passage_packs, rewrite_passages
from galley.operators.rounds import rule_based
from galley.plans.run import Options, run
from galley.plans.terms import build_glossary, extract_terms

SCHEMA = "seg_id bigint, book_id string, item_id string, seg_index int, tag string, text string"
ROWS = [(1, "b", "i1", 0, "p", "Он улыбнулся и ушёл домой."), (2, "b", "i1", 1, "p", "Дорога была долгой и тёмной."), (3, "b", "i1", 2, "p", "A calm day."), (4, "b", "i2", 0, "p", "Ключ лежал на столе в доме."), (5, "b", "i2", 1, "p", None)]


def upper(packs):
    """A rewriter that answers in capitals and shows what it was told of the text before."""
    blocks = F.transform("items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), F.upper(x["text"])))
    return packs.select("chunk_id", "attempt", F.array_join(blocks, "\n").alias("raw"))


def test_passages_carry_and_assemble(spark):
    s = spark.createDataFrame(ROWS, SCHEMA).filter("text IS NOT NULL")
    packs = passage_packs(s, 40, ["seg_index", "seg_id"])
    assert packs.count() == 4
    seen = []

    def spy(packs):
        seen.extend(r.prompt for r in packs.select("prompt").collect())
        return upper(packs)

    out = {r.seg_id: r.new_text for r in assemble(rewrite_passages(packs, spy, retries=0)).collect()}
    assert out[2] == ROWS[1][5].upper() and len(out) == 4
    assert any(ROWS[0][5].upper() in p and ROWS[1][5] in p for p in seen)
    silent = lambda q: q.select("chunk_id", "attempt", F.lit("").alias("raw"))
    assert {r.new_text for r in assemble(rewrite_passages(packs, silent, retries=1)).collect()} == {r[5] for r in ROWS[:4]}


def test_translate_run(spark):
    got = run(spark.createDataFrame(ROWS, SCHEMA), upper, Options(mode="translate", retries=0))
    text = {r.seg_id: r.new_text for r in got["segments"].collect()}
    assert text[1] == ROWS[0][5].upper() and text[3] == "A calm day." and text[5] is None
    assert got["log"].count() == 3 and got["hits"] is None


def test_polish_run_with_terms_and_checkpoint(spark):
    s = spark.createDataFrame([(1, "b", "i", 0, "p", "Wang could not help but smile at the old red lamp."), (2, "b", "i", 1, "p", "A calm day.")], SCHEMA)
    terms = spark.createDataFrame([("b", 1, "Wang", "Wang Lin", "person", "")], "book_id string, ord int, source string, target string, kind string, notes string")
    got = run(s, rule_based, Options(retries=0), terms)
    assert {r.seg_id: r.new_text for r in got["segments"].collect()} == {1: "Wang Lin smiled at the old red lamp.", 2: "A calm day."}
    assert got["hits"].first().n == 1
    chunk = got["log"].first().chunk_id
    done = spark.createDataFrame([("r1", chunk, ["Kept text."], 1)], "fingerprint string, chunk_id string, texts array<string>, line_no int")

    def never(packs):
        assert packs.count() == 0
        return packs.select("chunk_id", "attempt", F.lit("").alias("raw"))

    again = run(s, never, Options(retries=0), terms, done, "r1")
    assert {r.seg_id: r.new_text for r in again["segments"].collect()}[1] == "Kept text."


def test_the_glossary_goes_through_the_run(spark):
    segs = spark.createDataFrame([(1, "b", "c1", 0, "p", "The old lamp stood by the Harbourmaster all night long."), (2, "b", "c1", 1, "p", "A calm day in town."), (3, "d", "c2", 0, "p", "The old lamp stood by the Harbourmaster all night long.")], "seg_id bigint, book_id string, item_id string, seg_index int, tag string, text string")
    terms = spark.createDataFrame([("b", 1, "Harbour", "Port", "k", None)], "book_id string, ord int, source string, target string, kind string, notes string")
    seen = []

    def rewriter(packs):
        seen.extend((r.chunk_id, r.system) for r in packs.collect())
        return rule_based(packs)

    out = run(segs, rewriter, Options(retries=0), terms)
    # the source stands within a word: it is not put in, but makes its paragraph dirty in its own book alone
    assert {r.seg_id for r in out["log"].collect()} == {1}
    assert len(seen) == 1 and seen[0][1].endswith("- Harbour → Port") and out["segments"].count() == 3


def test_translation_goes_on_where_it_stopped(spark):
    s = spark.createDataFrame(ROWS, SCHEMA)
    opts = Options(mode="translate", retries=0, max_chars=40)
    packs = passage_packs(s.filter("text IS NOT NULL AND seg_id <> 3"), 40, ["seg_index", "seg_id"])
    first = packs.filter("item_id = 'i1' AND pack_no = 0").first().chunk_id
    done = spark.createDataFrame([("r", first, ["He smiled."], 1)], "fingerprint string, chunk_id string, texts array<string>, line_no int")
    seen = []

    def spy(packs):
        seen.extend((r.chunk_id, r.prompt) for r in packs.select("chunk_id", "prompt").collect())
        return upper(packs)

    got = {r.seg_id: r.new_text for r in run(s, spy, opts, done=done, name="r")["segments"].collect()}
    assert got[1] == "He smiled." and got[2] == ROWS[1][5].upper() and first not in {c for c, _ in seen}
    assert any("He smiled." in p for _, p in seen)


def test_packs_by_tokens_leave_room_for_the_prefix(spark):
    rows = [(i, "b", "c", i, "p", "He could not help but smile at the old red lamp by the door of the house.") for i in range(20)]
    s = spark.createDataFrame(rows, SCHEMA)
    count = lambda o: run(s, rule_based, o)["log"].select("chunk_id").distinct().count()
    assert count(Options(retries=0, by_tokens=True, num_ctx=1024, style="x " * 400)) > count(Options(retries=0, by_tokens=True, num_ctx=1024)) > 1


def test_glossary_is_built_from_files_and_excerpts(spark):
    s = spark.createDataFrame([("b", 0, 1, "Old Wang came."), ("c", 0, 2, "Nothing."), ("d", 0, 3, None)], "book_id string, seg_index int, seg_id bigint, text string")
    raws = {"b": '```json\n{"terms": [{"source": "Wang", "target": "King"}, {"source": "Old", "target": "Elder", "type": "title"}, {"source": "", "target": "x"}]}\n```', "c": "no terms"}
    seen = []

    def rewriter(packs):
        seen.extend(r.asDict() for r in packs.collect())
        return spark.createDataFrame([(k, 0, v) for k, v in raws.items()], "chunk_id string, attempt int, raw string")

    found = extract_terms(s, rewriter, ["seg_index", "seg_id"])
    assert {x["chunk_id"] for x in seen} == {"b", "c"} and "Old Wang came." in next(x["prompt"] for x in seen if x["chunk_id"] == "b")
    given = spark.createDataFrame([("b", 1, "wang", "Wang", "person", None), ("b", 2, "WANG", "Wang Lin", None, "n")], "book_id string, ord int, source string, target string, kind string, notes string")
    got = [(r.ord, r.source, r.target, r.kind) for r in build_glossary(given, found).orderBy("ord").collect()]
    assert got == [(1, "wang", "Wang Lin", "person"), (2, "Old", "Elder", "title")]
    assert build_glossary(None, found).count() == 2 and build_glossary(given, None).count() == 1
