import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from galley.operators import changes, checkpoints, glossary, lookup, samples
from galley.sources import formats, markup, reader, sinks, texts
from galley.streaming import intake

TERMS = "book_id string, ord int, source string, target string, kind string, notes string"


def test_substitution_is_one_pass():
    s = glossary.Substitution([("Wang", "Wang Lin"), ("Lin", "Forest"), ("a.b", r"\1"), ("长安", "Chang'an"), ("same", "same")])
    assert s.apply("Wang and Lin, wangs a.b 在长安城 same") == (r"Wang Lin and Forest, wangs \1 在Chang'an城 same", {"Wang → Wang Lin": 1, "Lin → Forest": 1, r"a.b → \1": 1, "长安 → Chang'an": 1})
    assert glossary.Substitution([("ab", "X"), ("abc", "Y")]).apply("abc ab")[0] == "Y X"
    assert s.apply(None) == (None, {}) and glossary.Substitution([]).apply("x") == ("x", {})


def test_glossary(spark):
    base = spark.createDataFrame([("b", 1, "Ann", "Anna", "person", ""), ("b", 2, "Bay", "Bay", "place", None)], TERMS)
    more = spark.createDataFrame([("b", 1, "ANN", "Hanna", "x", "n"), ("b", 2, "Cat", "Kat", None, None), ("b", 3, None, "x", None, None)], TERMS)
    got = [(r.ord, r.source, r.target, r.kind) for r in glossary.merge(base, more).orderBy("ord").collect()]
    assert got == [(1, "Ann", "Anna", "person"), (2, "Bay", "Bay", "place"), (3, "Cat", "Kat", None)]
    got = [(r.ord, r.source, r.target, r.kind, r.notes) for r in glossary.merge(base, more, overwrite=True).orderBy("ord").collect()]
    assert got[0] == (1, "Ann", "Hanna", "x", "n")
    t = spark.createDataFrame([(1, "b", "ann saw Ann at the bay"), (2, "b", None), (3, "b", ""), (4, "c", "Ann")], "id int, book_id string, text string")
    hits = glossary.relevant(t, base, "id")
    assert sorted((r.id, r.source) for r in hits.collect()) == [(1, "Ann"), (1, "Bay")] and glossary.unapplied(hits).count() == 1
    out = {r.id: r for r in glossary.substitute(t, base, "id").collect()}
    assert out[1].text == "Anna saw Anna at the bay" and out[1].hits == {"Ann → Anna": 2} and out[2].text is None and out[4].text == "Ann"
    assert glossary.hit_totals(glossary.substitute(t, base, "id")).collect()[0].n == 2


def test_glossary_files(spark):
    raws = ['{"terms":[{"source":"a","target":"b","type":"t"},{"source":"","target":"x"}]}', '[{"from":"a","to":"b"}]', '{"a":"b"}', "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "r string").select(glossary.sources_of_json(F.col("r"))).collect()]
    assert [[(x.source, x.target) for x in g or []] for g in got] == [[("a", "b")], [("a", "b")], [("a", "b")], [], []]


def test_changes(spark):
    log = spark.createDataFrame([(1, "c1", "a  b", "a b", "x2"), (2, "c1", "a", "b", "ch10.html#s1"), (3, "c2", None, "``` x", None), (4, "c2", None, "", "y")], "edit_id int, chapter_id string, before string, after string, href string")
    s = changes.summary(log).first()
    assert (s.sent, s.unchanged, s.edits, s.chapters_edited) == (4, 2, 2, 2)
    assert [r[0] for r in log.orderBy("edit_id").select(changes.href_number(F.col("href"))).collect()] == [2, 1, 0, 0]
    full = log.withColumns({"chapter_title": F.lit("t"), "para": F.lit(1), "kind": F.lit("span")})
    assert "````" in changes.markdown_entries(full).filter("edit_id = 3").first().entry


def test_checkpoints(spark, tmp_path):
    p = tmp_path / "j.jsonl"
    p.write_text("\n".join([json.dumps({"fingerprint": "f", "meta": {}}), json.dumps({"id": "a", "texts": ["1"]}), json.dumps({"id": "a", "texts": ["2"]}), '{"id": "b", "te']))
    done = checkpoints.read_journal(spark, str(p), "f")
    packs = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert [r.chunk_id for r in checkpoints.pending(packs, done, "f").collect()] == ["b"]
    assert checkpoints.finished(packs, done, "f").first().texts == ["2"]
    assert checkpoints.read_journal(spark, str(p), "g").count() == 0


def test_samples(spark):
    s = spark.createDataFrame([("d", i, t) for i, t in enumerate(["  aaaa ", None, "", "bbbb", "cccc"])], "d string, i int, text string")
    assert samples.joined_parts(samples.sample_parts(s, "d", ["i"], 6), "d").first().text == "aaaa\nbbbb"
    many = spark.createDataFrame([("d", i, f"{i}" * 800) for i in range(25)], "d string, i int, text string")
    assert samples.excerpts(many, "d", ["i"]).first().text == "\n\n".join((f"{i}" * 800)[:700] for i in range(0, 20, 2))


def test_texts(spark):
    d = spark.createDataFrame([(1, "s", "﻿one\r\n two\r\n\r\nthree\f\f  four"), (2, "s", ""), (3, "s", None)], "doc_id bigint, stem string, text string")
    assert [(r.item_id, r.title, r.seg_index, r.text) for r in texts.read_txt(d).orderBy("chapter_ord", "seg_index").collect()] == [("p0", "s", 0, "one two"), ("p0", "s", 1, "three"), ("p2", "Section 3", 0, "four")]
    page = spark.createDataFrame([(1, 0, "A bro-\nken line\ngoes on.\nNext"), (1, 1, " ")], "doc_id bigint, page int, text string")
    assert [r.text for r in texts.read_pages(page).orderBy("seg_index").collect()] == ["A broken line goes on.", "Next"]
    for raw, lines in (('["x", {"text": "y", "chapter": "B"}, {"content": "z"}, {"text": " "}]', False), ('"x"\n\n{"text": "y", "chapter": "B"}\n{"paragraph": "z"}', True), ('{"paragraphs": ["x", {"text": "y", "title": "B"}, "z"]}', False)):
        recs = texts.json_records(spark.createDataFrame([(1, "s", raw)], "doc_id bigint, stem string, text string"), lines)
        got = [(r.chapter_ord, r.title, r.seg_index, r.text) for r in texts.read_records(recs).orderBy("chapter_ord", "seg_index").collect()]
        assert got == [(0, "s", 0, "x"), (0, "s", 1, "z"), (1, "B", 0, "y")]


def test_markdown_and_html():
    md = "intro\nline\n\n# One\n- a\n2. b\n\n```py\ncode\n\n```\n## Sub\ntext\n# Two\nlast"
    got = markup.markdown_chapters(md, "s")
    assert [(c[0], c[1]) for c in got] == [("md0", "s"), ("md1", "One"), ("md2", "Two")]
    assert got[1][3] == [(0, "h1", "One"), (1, "li", "a"), (2, "li", "b"), (3, "pre", "code\n"), (4, "h2", "Sub"), (5, "p", "text")]
    rows, heads, body = markup.html_leaves("<title>T</title><body><div><p>a <b>b</b></p><p>x</p><li>c d<br>e</div><script>no</script>tail")
    assert rows == [(0, "p", "a b"), (1, "li", "c d e")] and heads["title"] == "T"
    assert markup.html_chapters("<body>only text</body>", "s")[0][3] == [(0, "p", "only text")]
    page = "<body><p class='x'>Old &amp; <i>text</i></p><p>Keep</p></body>"
    assert sinks.set_html_texts(page, {0: "New\nline"}) == "<body><p class='x'>New<br/>line</p><p>Keep</p></body>"


def make_epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml"/><item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml"/><item id="css" href="s.css" media-type="text/css"/></manifest></package>')
        z.writestr("OEBPS/nav.xhtml", "<html><body><h1>Contents</h1><li>One</li></body></html>")
        z.writestr("OEBPS/text/c1.xhtml", "<html><body><h1>One</h1><p>Old words.</p></body></html>")
        z.writestr("OEBPS/s.css", "p{}")
    return out.getvalue()


def make_docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t[:3]}</w:t></w:r><w:r><w:t>{t[3:]}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('Intro text')}{p('', '')}{p('Chapter', 'H1')}{p('Body here')}<w:tbl><w:tr><w:tc>{p('Cell text')}</w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_packages(spark, tmp_path):
    epub, docx = make_epub(), make_docx()
    assert markup.epub_chapters(epub, "s") == [("nav", "Contents", True, [(0, "h1", "Contents"), (1, "li", "One")]), ("c1", "One", False, [(0, "h1", "One"), (1, "p", "Old words.")])]
    assert markup.docx_chapters(docx, "s") == [("d0", "s", False, [(0, "p", "Intro text")]), ("d1", "Chapter", False, [(2, "h1", "Chapter"), (3, "p", "Body here"), (4, "p", "Cell text")])]
    new = sinks.rewrite_epub(epub, {("c1", 1): "New & words."})
    with zipfile.ZipFile(io.BytesIO(new)) as z, zipfile.ZipFile(io.BytesIO(epub)) as old:
        assert z.namelist()[0] == "mimetype" and b"New &amp; words." in z.read("OEBPS/text/c1.xhtml") and z.read("OEBPS/nav.xhtml") == old.read("OEBPS/nav.xhtml")
    assert markup.docx_chapters(sinks.rewrite_docx(docx, {3: "Changed"}), "s")[1][3][1] == (3, "p", "Changed")

    (tmp_path / "in").mkdir()
    for name, data in {"a.epub": epub, "b.docx": docx, "c.txt": b"one\n\ntwo", "d.md": b"# T\ntext", "e.html": b"<p>hello</p>", "f.jsonl": b'"x y"', "g.json": b'["z z"]', "h.bin": b"??"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    files = reader.read_files(spark, str(tmp_path / "in"))
    segs = reader.read_segments(files)
    by = {r.stem: r.n for r in segs.join(files.select("doc_id", "stem"), "doc_id").groupBy("stem").agg(F.count("*").alias("n")).collect()}
    assert by == {"a": 4, "b": 4, "c": 2, "d": 2, "e": 1, "f": 1, "g": 1}
    assert reader.selectable(segs).count() == 13 and reader.chapter_range(segs, 1, 1).filter("item_id = 'd1'").count() == 0
    again = sinks.rewrite_packages(files.filter("fmt = 'epub'"), segs, "epub").first().content
    assert markup.epub_chapters(bytes(again), "s") == markup.epub_chapters(epub, "s")
    written = sinks.write_files(sinks.as_markdown(segs).select(F.concat(F.col("doc_id"), F.lit(".md")).alias("name"), "content"), str(tmp_path / "out")).collect()
    assert len(written) == 7 and all(r.n_bytes > 0 for r in written) and not [p for p in (tmp_path / "out").iterdir() if p.suffix == ".tmp"]


def test_sinks(spark):
    rows = [(1, 0, "A", 0, "h2", "Head"), (1, 0, "A", 1, "li", "x"), (1, 0, "A", 2, "li", "y"), (1, 0, "A", 3, "p", "a < b\nc"), (1, 0, "A", 4, "p", None), (1, 1, "B", 0, "pre", "code")]
    s = spark.createDataFrame([(*r, False) for r in rows], "doc_id int, chapter_ord int, title string, seg_index int, tag string, text string, is_skipped boolean")
    assert sinks.as_txt(s).first().content == "Head\n\nx\n\ny\n\na < b\nc\n\ncode\n"
    assert sinks.as_markdown(s).first().content.startswith("## Head\n\n- x\n- y\n")
    assert "<p>a &lt; b<br/>c</p>" in sinks.as_html(s).first().content
    assert [r["text"] for r in json.loads(sinks.as_json(s).first().content)] == ["Head", "x", "y", "a < b\nc", "code"]
    assert len(sinks.as_json(s, lines=True).first().content.splitlines()) == 5


def test_formats_and_lookups(spark):
    df = spark.createDataFrame([(" .EPUB",), ("Markdown",), ("htm",), ("odt",), (None,)], "f string")
    assert [r[0] for r in df.select(formats.normal_format(F.col("f"))).collect()] == ["epub", "md", "html", None, None]
    w = spark.createDataFrame([(1, "c.html"), (1, "a/x.html"), (1, "y.html"), (1, "")], "doc_id int, file_name string")
    m = spark.createDataFrame([(1, "c.html"), (1, "d/c.html"), (1, "O/a/x.html"), (1, "O/b/x.html"), (1, "p/y.html"), (1, "q/y.html")], "doc_id int, member string")
    assert {r.file_name: r.member for r in lookup.match_members(w, m).collect()} == {"c.html": "c.html", "a/x.html": "O/a/x.html", "y.html": None, "": None}


def test_stream(spark, tmp_path):
    schema = "seg_id bigint, item_id string, seg_index int, tag string, text string"
    df = spark.createDataFrame([(1, "i", 0, "p", "He could not help but laugh at the sight."), (2, "i", 1, "p", "Calm.")], schema)
    df.write.parquet(str(tmp_path / "in"))
    jobs = intake.stream_jobs(intake.stream_segments(spark, str(tmp_path / "in"), df.schema))
    intake.start(jobs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.seg_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_nothing_imports_the_training_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "galley"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"galley\.llm", p.read_text())


@pytest.mark.parametrize("shared", [50_000, 0])
def test_glossary_by_both_ways(spark, shared):
    terms = spark.createDataFrame([("b", 1, "ink", "INK", "k", None), ("b", 2, "ink well", "inkwell", "k", ""), ("b", 3, "Well", "Well", "k", None), ("c", 1, "墨", "ink", None, None), (None, 1, "ink", "x", None, None), ("b", 4, "Ink", "Tinte", "k", None)], TERMS)
    texts = spark.createDataFrame([(1, "b", "Ink, ink well and inks; INK well."), (2, "c", "古墨水"), (3, None, "ink"), (4, "b", None), (5, "b", ""), (6, "d", "ink"), (6, "b", "well")], "id int, book_id string, text string")
    out = sorted(((r.id, r.text, r.hits) for r in glossary.substitute(texts, terms, "id", shared=shared).collect()), key=repr)
    assert (1, "Tinte, inkwell and inks; inkwell.", {"ink well → inkwell": 2, "Ink → Tinte": 1}) in out and (2, "古ink水", {"墨 → ink": 1}) in out
    assert len(out) == 7 and (3, "ink", {}) in out and (4, None, {}) in out and (6, "ink", {}) in out
    got = sorted((r.id, r.rank, r.source) for r in glossary.relevant(texts, terms, "id", shared=shared, cap=2).filter("id < 6").collect())
    assert got == [(1, 1, "ink well"), (1, 2, "Well"), (2, 1, "墨")]
    wanted = {r.id: r.wanted for r in glossary.with_wanted(texts.filter("id < 6"), terms, "id", shared=shared).collect()}
    assert wanted == {1: ["ink", "ink well"], 2: ["墨"], 3: None, 4: None, 5: None}
    assert glossary.substitute(texts.limit(0), terms, "id", shared=shared).count() == 0 and glossary.substitute(texts, terms.limit(0), "id", shared=shared).count() == 7


def test_places_are_those_of_a_slow_search():
    rnd = random.Random(3)
    for _ in range(300):
        terms = [("".join(rnd.choices("abA ", k=rnd.randint(1, 3))), str(i)) for i in range(5)]
        text = "".join(rnd.choices("abAB x", k=40))
        s = glossary.Substitution(terms)
        used, at, want = [(a, b) for a, b in terms if a != b], 0, []
        while at < len(text):
            here = [(a, b) for a, b in used if text[at : at + len(a)].lower() == a.lower() and glossary._edge(text, at) and glossary._edge(text, at + len(a))]
            if here:
                n = max(len(a) for a, _ in here)
                here = [x for x in here if len(x[0]) == n]
                found = text[at : at + n]
                a, b = next((x for x in here if found in (x[0], x[0].lower())), here[0])
                want.append((at, at + n, a, b))
                at += n
            else:
                at += 1
        assert s.places(text) == want


def test_markdown_chapters():
    text = "lead\nmore\n\n# One\n- a\n- \n1. b\npara\n## Two\n```x\ncode\n\nmore\n```\nafter\n# \n# Three\n```\nopen"
    got = markup.markdown_chapters(text, "stem")
    assert [(c[0], c[1]) for c in got] == [("md0", "stem"), ("md1", "One"), ("md2", ""), ("md3", "Three")]
    assert got[0][3] == [(0, "p", "lead more")]
    assert got[1][3] == [(0, "h1", "One"), (1, "li", "a"), (2, "p", "-"), (3, "li", "b"), (4, "p", "para"), (5, "h2", "Two"), (6, "pre", "code\n\nmore"), (7, "p", "after")]
    assert got[2][3] == [] and got[3][3] == [(0, "h1", "Three"), (1, "pre", "open")]
    assert markup.markdown_chapters("", "s") == [] and markup.markdown_chapters("# A", "s") == [("md0", "A", False, [(0, "h1", "A")])]


def test_every_file_is_written(spark, tmp_path):
    df = spark.range(5000).selectExpr("concat(id, '.md') AS name", "concat('text ', id) AS content").repartition(8)
    done = sinks.write_files(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 5000 and done.count() == 5000
    assert (tmp_path / "out" / "4999.md").read_text() == "text 4999"
    sinks.write_files(df.limit(3), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 5000


ROWS = [(1, 0, "p0", "One & two", 0, "h1", "One & two"), (1, 0, "p0", "One & two", 1, "p", "a < b\nc"), (1, 1, "p1", None, 0, "div", "last"), (1, 1, "p1", None, 1, "p", " ")]


@pytest.mark.parametrize("fmt", ["epub", "docx", "html", "md", "txt", "json", "jsonl"])
def test_new_documents_can_be_read_again(spark, tmp_path, fmt):
    segs = spark.createDataFrame([(*r, False) for r in ROWS], "doc_id bigint, chapter_ord int, item_id string, title string, seg_index int, tag string, text string, is_skipped boolean")
    content = sinks.as_format(segs, fmt).first().content
    assert bytes(content) == bytes(sinks.as_format(segs, fmt).first().content)
    (tmp_path / f"x.{fmt}").write_bytes(content)
    from galley.sources.reader import read_files, read_segments

    back = [" ".join(r.text.split()) for r in reader.selectable(read_segments(read_files(spark, str(tmp_path)))).orderBy("chapter_ord", "seg_index").collect()]
    assert [t.replace("a < bc", "a < b c") for t in back if t] == ["One & two", "a < b c", "last"]
    with pytest.raises(formats.FormatError):
        sinks.as_format(segs, "pdf")


def test_documents_keep_their_format(spark, tmp_path):
    from galley.api import rewrite_documents

    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    page = "<html><head><style>p {}</style></head><body class='x'><p id=1>He could not help but smile at the old red lamp.</p><p>A <b>calm</b> day.</p></body></html>"
    (folder / "a.html").write_text(page)
    (folder / "b.md").write_text("# T\n\n- one\n\nShe suddenly discovered that the key was gone again.\n")
    (folder / "sub" / "b.md").write_text("Nothing to do.\n")
    segs = spark.createDataFrame([(1, 0, "c", "T", 0, "p", "He could not help but smile at the old red lamp.", False)], "doc_id bigint, chapter_ord int, item_id string, title string, seg_index int, tag string, text string, is_skipped boolean")
    for fmt in ("epub", "docx"):
        (folder / f"c.{fmt}").write_bytes(sinks.as_format(segs, fmt).first().content)
    out = tmp_path / "out"
    assert rewrite_documents(spark, str(folder), str(out)).count() == 5
    names = sorted(p.name for p in out.iterdir())
    assert [n for n in names if "-" not in n] == ["a.polished.html", "c.polished.docx", "c.polished.epub"] and sum(n.endswith("-b.polished.md") for n in names) == 2
    assert (out / "a.polished.html").read_text() == page.replace("could not help but smile", "smiled").replace("He smiled", "He smiled")
    from galley.sources.reader import read_files, read_segments

    texts = {r.text for r in read_segments(read_files(spark, str(out))).collect()}
    assert {"He smiled at the old red lamp.", "She found that the key was gone again.", "Nothing to do.", "one"} <= texts and not any("could not help" in t for t in texts)


def test_a_folder_is_read_by_names(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.MD": b"# T\ntext", "sub/b.htm": b"<p>hello</p>", "c.txt": b"one", "d": b"PK", "e.json": b'[{"text": "x"}, "y z", {"text": " "}]', "f.bin": b"??", "g.JsonL": b'"q r"'}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "d").unlink()
    docx = make_docx()
    (tmp_path / "noname-docx").write_bytes(docx)
    got = sorted((r.tag, r.text) for r in reader.read_folder(spark, str(tmp_path)).collect())
    want = sorted((r.tag, r.text) for r in reader.read_segments(reader.read_files(spark, str(tmp_path))).collect())
    assert got == want and {t for _, t in got} >= {"T", "text", "hello", "one", "x", "y z", "q r", "Intro text"}


LOG = "edit_id bigint, book_id string, chapter_id string, chapter_title string, href string, para int, kind string, before string, after string"


def test_change_reports(spark):
    rows = [(1, "b", "c10", "Ten", "x10.html", 0, "span", "a", "b"), (2, "b", "c2", "Two", "x2.html", 1, "span", "same  text", "same text"), (3, "b", "c2", "Two", "x2.html", 0, "span", "one ``` two", None), (4, "e", None, None, None, 0, "span", None, "")]
    log = spark.createDataFrame(rows, LOG)
    terms = spark.createDataFrame([("b", "x → y", 5), ("b", "p → q", 5), ("b", "z → z2", 1)], "book_id string, term string, n bigint")
    got = {r.book_id: r.content for r in changes.report_markdown(log, "book_id", terms, k=2).collect()}
    text = got["b"]
    assert text.index("## Two") < text.index("````\none ``` two\n````") < text.index("## Ten") and "- Rewritten: 2 (left as they were: 1)" in text
    assert "- Terms put in:\n  - p → q: 5\n  - x → y: 5\n  - … 1 more\n" in text and got["e"].endswith("Nothing was rewritten.\n")
    data = json.loads(changes.report_json(log, "book_id", terms).filter("book_id = 'b'").first().content)
    assert [e["before"] for e in data["edits"]] == ["one ``` two", "a"] and [e["before"] for e in data["unchanged"]] == ["same  text"] and data["terms"]["x → y"] == 5 and data["rewritten"] == 2
    assert changes.report_markdown(log.limit(0), "book_id").count() == 0


def test_journal_of_several_files(spark, tmp_path):
    (tmp_path / "a").write_text('{"fingerprint": "f"}\n' + "".join(json.dumps({"id": "c", "texts": [f"a{i}"]}) + "\n" for i in range(50)))
    (tmp_path / "b").write_text(json.dumps({"id": "c", "texts": ["last"]}) + '\n{"id": "torn')
    done = checkpoints.read_journal(spark, str(tmp_path), "f")
    packs = spark.createDataFrame([("c",)], "chunk_id string")
    assert checkpoints.finished(packs, done, "f").first().texts == ["last"] and checkpoints.read_journal(spark, str(tmp_path), "g").count() == 0


def test_members_of_archives():
    names = {"OEBPS/text/a b.xhtml", "OEBPS/x/c.xhtml", "old/c.xhtml", "OEBPS/y/d.xhtml"}
    member = lambda href: markup.archive_member(names, "OEBPS", href)
    assert member("text/a%20b.xhtml") == member("text/a b.xhtml") == member("wrong/a b.xhtml") == "OEBPS/text/a b.xhtml"
    assert member("x/c.xhtml") == "OEBPS/x/c.xhtml" and member("z/c.xhtml") is None and member("d.xhtml") == "OEBPS/y/d.xhtml"
    assert member("") is None and member("e.xhtml") is None


def test_chunks_added_to_a_journal(spark, tmp_path):
    schema = "fingerprint string, chunk_id string, texts array<string>, line_no int"
    for n, text in ((1, "old"), (2, "new")):
        checkpoints.append(spark.createDataFrame([("f", "c", [text], n), ("g", "c", ["other"], 9)], schema), str(tmp_path / "j"))
    done = spark.read.parquet(str(tmp_path / "j"))
    packs = spark.createDataFrame([("c",), ("d",)], "chunk_id string")
    assert checkpoints.finished(packs, done, "f").collect()[0].texts == ["new"] and checkpoints.pending(packs, done, "f").count() == 1
    a, b = (spark.range(1).select(checkpoints.fingerprint(F.lit("x"), F.lit(y).cast("string"))).first()[0] for y in ("1", None))
    assert len(a) == len(b) == 16 and a != b
