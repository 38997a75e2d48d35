"""Every query of the library over the driver's tables: (session, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions import rules, scripts
from galley.functions.cost import answer_tokens, answer_tokens_for_spans, estimated_tokens
from galley.functions.text import let, strip
from galley.operators import answers, changes, checkpoints, gate, glossary, lookup, packs, passages, programs, prompts, rounds, samples, units
from galley.plans import report
from galley.session import checkpointed, spread, table
from galley.sources import formats, markup, sinks, texts

ORDER = ["chapter_ord", "seg_index", "seg_id"]
JOB_ORDER = ["seg_index", "span_index", "job_id"]
MAX_CHARS, MAX_PROMPT, NUM_CTX = 1200, 300, 2048
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "segments"), "seg_id")


# --- scripts, modes, routing ------------------------------------------------
@query
def script_ratio(spark, d):
    s = _segments(spark, d)
    counts = [F.coalesce(scripts.script_count("text", x), F.lit(0)).cast("bigint").alias(f"n_{x}") for x in scripts.RANGES]
    return s.select("seg_id", *counts, F.round(scripts.han_share("text"), 6).alias("han_share"), F.round(scripts.foreign_share("text"), 6).alias("foreign_share"))


@query
def sample_text(spark, d):
    parts = samples.sample_parts(_segments(spark, d), "book_id", ORDER, 2000)
    text = samples.joined_parts(parts, "book_id")
    return text.select("book_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query
def detect_mode(spark, d):
    text = samples.joined_parts(samples.sample_parts(_segments(spark, d), "book_id", ORDER), "book_id")
    return text.select("book_id", scripts.mode("text").alias("mode"), scripts.source_language("text").alias("src_lang"))


@query
def stride_excerpts(spark, d):
    text = samples.excerpts(_segments(spark, d), "book_id", ORDER)
    return text.select("book_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query
def boilerplate_filter(spark, d):
    return _segments(spark, d).filter(rules.is_boilerplate("text")).select("seg_id", "tag")


@query
def mtl_score(spark, d):
    scores = lambda s: F.struct(*[F.when(F.col("text").isNotNull(), rules.dirt_of(s, m, "tag")).otherwise(0).cast("bigint").alias(m) for m in ("polish", "translate")])
    return _segments(spark, d).select("seg_id", F.explode(F.array(let(rules.signals("text", True), scores))).alias("s")).select("seg_id", "s.*")


@query
def route_segments(spark, d):
    flags = {"auto": ("polish", "auto"), "aggressive": ("polish", "aggressive"), "off_": ("polish", "off"), "translate": ("translate", "auto")}
    routed = lambda s: F.struct(*[(F.col("text").isNotNull() & rules.needs_of(s, "tag", m, k)).alias(n) for n, (m, k) in flags.items()])
    rows = _segments(spark, d).select("seg_id", F.explode(F.array(let(rules.signals("text", True), routed))).alias("r"))
    return rows.select("seg_id", "r.*")


@query
def wants_polish(spark, d):
    return _segments(spark, d).filter(rules.wants_polish("text")).select("seg_id")


# --- units and programs -----------------------------------------------------
def _exploded(s: DataFrame, parts) -> DataFrame:
    return s.select("seg_id", F.posexplode(parts).alias("unit_pos", "text")).withColumn("unit_pos", F.col("unit_pos").cast("bigint"))


@query
def sentence_units(spark, d):
    return _exploded(_segments(spark, d), units.sentence_units("text"))


@query
def long_unit_split(spark, d):
    return _exploded(_segments(spark, d), units.split_long(units.sentence_units("text")))


@query
def attach_short(spark, d):
    return _exploded(_segments(spark, d), units.units("text"))


def _span_rows(spark, d) -> DataFrame:
    """Spans as stored, one a place of a segment (some were delivered twice)."""
    s = table(spark, d, "spans").groupBy("seg_id", "span_index").agg(F.min_by(F.struct("kind", "text"), "span_id").alias("s"))
    return s.select("seg_id", "span_index", "s.kind", "s.text")


def _long_index(df: DataFrame) -> DataFrame:
    return df.withColumn("span_index", F.col("span_index").cast("bigint"))


def _arrays(rows: DataFrame) -> DataFrame:
    sorted_ = F.array_sort(F.collect_list(F.struct("span_index", F.struct("kind", "text").alias("s"))))
    return rows.groupBy("seg_id").agg(F.transform(sorted_, lambda x: x["s"]).alias("program"))


@query
def coalesce_runs(spark, d):
    p = _arrays(_span_rows(spark, d)).withColumn("program", programs.coalesce(F.col("program")))
    return _long_index(programs.span_table(p))


@query
def absorb_bridges(spark, d):
    p = _arrays(_span_rows(spark, d)).withColumn("program", programs.absorb_bridges(F.col("program")))
    return _long_index(programs.span_table(p))


@query
def edit_programs(spark, d):
    return _long_index(programs.span_table(programs.with_programs(_segments(spark, d).select("seg_id", "tag", "text"))).drop("tag"))


@query
def force_dirty_argmax(spark, d):
    """Every paragraph as the list façade sends it: no routing, one unit at least."""
    s = _segments(spark, d).filter(~rules.is_boilerplate("text") & F.col("text").isNotNull())
    p = s.select("seg_id", programs.edit_program("text", F.lit("p"), "polish", "aggressive", True).alias("program"))
    return _long_index(programs.span_table(p))


@query
def keep_ratio_rollup(spark, d):
    return report.program_summary(programs.with_programs(_segments(spark, d)), "book_id")


@query
def span_jobs_context(spark, d):
    return programs.job_table(_arrays(_span_rows(spark, d)))


# --- costs and packs ----------------------------------------------------------
def _jobs(spark, d) -> DataFrame:
    return table(spark, d, "span_jobs")


@query
def token_estimate(spark, d):
    return _jobs(spark, d).select("job_id", estimated_tokens("text").cast("bigint").alias("tokens"))


@query
def pack_chars(spark, d):
    return packs.pack_span_jobs(_jobs(spark, d), MAX_CHARS, JOB_ORDER).select("job_id", "item_id", "pack_no")


@query
def pack_tokens(spark, d):
    return packs.pack_span_jobs(_jobs(spark, d), packs.token_budget(MAX_PROMPT, 40), JOB_ORDER, by_tokens=True).select("job_id", "item_id", "pack_no")


@query
def pack_segments(spark, d):
    s = _segments(spark, d)
    return packs.pack_segments(s, MAX_CHARS, ORDER).select("seg_id", "item_id", F.col("piece_no").cast("bigint").alias("piece_no"), F.md5("text").alias("digest"), "pack_no")


@query
def pack_segments_tokens(spark, d):
    s = _segments(spark, d)
    return packs.pack_segments(s, 6000, ORDER, max_prompt=400).select("seg_id", "item_id", F.col("piece_no").cast("bigint").alias("piece_no"), F.md5("text").alias("digest"), "pack_no")


@query
def max_tokens(spark, d):
    p = packs.greedy_packs(packs.job_costs(_jobs(spark, d)).select("item_id", *JOB_ORDER, "cost", F.coalesce(F.length("text"), F.lit(0)).alias("n"), estimated_tokens("text").alias("t")), "item_id", JOB_ORDER, "cost", MAX_CHARS)
    g = p.groupBy("item_id", "pack_no").agg(F.count("*").cast("int").alias("k"), F.sum("n").cast("int").alias("chars"), F.sum("t").cast("int").alias("tokens"))
    big = lambda c: c.cast("bigint")
    return g.select(
        "item_id", "pack_no", big(answer_tokens_for_spans(F.col("k"), F.col("chars"), NUM_CTX)).alias("span_chars"), big(answer_tokens_for_spans(F.col("k"), F.col("chars"), NUM_CTX, F.col("tokens"))).alias("span_tokens"),
        big(answer_tokens(F.col("chars"), "polish", NUM_CTX)).alias("polish_chars"), big(answer_tokens(F.col("chars"), "translate", NUM_CTX)).alias("translate_chars"), big(answer_tokens(F.col("chars"), "translate", NUM_CTX, F.col("tokens"))).alias("translate_tokens"),
    )


def _packs(spark, d) -> DataFrame:
    jobs = _jobs(spark, d).join(table(spark, d, "spans").select("span_id", "seg_id"), "span_id")
    once = jobs.groupBy("item_id", "seg_index", "span_index", "seg_id").agg(F.min_by(F.struct("text", "before", "after"), "job_id").alias("j"))
    return packs.span_packs(once.select("item_id", "seg_index", "span_index", "seg_id", "j.text", "j.before", "j.after"), MAX_CHARS, NUM_CTX)


@query
def chunk_ids(spark, d):
    return _packs(spark, d).select("item_id", "pack_no", "chunk_id", F.col("n_jobs").cast("bigint").alias("n_jobs"))


@query
def span_prompts(spark, d):
    p = _packs(spark, d)
    return p.select("chunk_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def full_prompts(spark, d):
    none = F.lit("")
    return _packs(spark, d).select("chunk_id", F.md5(F.concat(prompts.span_system(none, none), prompts.span_user(F.col("prompt")))).alias("digest"))


@query
def carry_context(spark, d):
    """What each pack of passages is told of the one before: its last 500 characters."""
    p = passages.passage_packs(_segments(spark, d), MAX_CHARS, ORDER)
    told = F.lag(passages.carried(F.transform("items", lambda x: x["text"]))).over(Window.partitionBy("item_id").orderBy("pack_no"))
    return p.select("item_id", "pack_no", F.md5(F.coalesce(told, F.lit(""))).alias("previous"))


# --- answers and the gate -------------------------------------------------------
@query
def parse_numbered(spark, d):
    """Two blocks as a rewriter may answer: swapped, bold, with noise; then unlabelled."""
    e = table(spark, d, "edits")
    b, a = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    kind = F.pmod("edit_id", F.lit(4))
    raw = F.when(kind == 0, F.concat(F.lit("**[2]** "), a, F.lit("\n**[1]**\n"), b)).when(kind == 1, F.concat(F.lit("<think>no</think>[1] REPLACE:\n"), b, F.lit("\n\n[2]\n"), a)).when(kind == 2, F.concat(b, F.lit("\n\n"), a)).otherwise(F.concat(F.lit("[1] "), b, F.lit("\n[1] again\n[7] "), a))
    blocks = answers.numbered_blocks(answers.without_noise(raw), F.lit(2))
    return e.select("edit_id", F.md5(F.array_join(blocks, "|")).alias("digest"))


@query
def trim_echo(spark, d):
    j = _jobs(spark, d)
    t, b, a = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "before", "after"))
    kind = F.pmod("job_id", F.lit(3))
    out = F.when(kind == 0, F.concat_ws(" ", b, t, a)).when(kind == 1, F.concat(b, F.lit(" "), t)).otherwise(F.concat(t, F.lit(" "), a))
    return j.select("job_id", answers.trim_echo(out, t, b, a).alias("trimmed"))


@query
def gate_reasons(spark, d):
    return spread(table(spark, d, "edits"), "edit_id").select("edit_id", F.coalesce(gate.rejection(F.col("before"), F.col("after")), F.lit("accepted")).alias("reason"))


@query
def paragraph_gate(spark, d):
    b, a = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    return table(spark, d, "edits").select("edit_id", gate.paragraph_fits(b, a).alias("polish"), gate.paragraph_fits(b, a, "translate").alias("translate"))


# --- rewriting ------------------------------------------------------------------
@query
def stitch(spark, d):
    p = _arrays(_span_rows(spark, d))
    final = _span_rows(spark, d).filter("kind = 'REPLACE'").select("seg_id", "span_index", strip(rounds.plain_words(F.col("text"))).alias("final"))
    return rounds.stitch(p, final).select("seg_id", "new_text")


@query
def retry_rounds(spark, d):
    return rounds.rewrite(_packs(spark, d), rounds.rule_based, retries=1).select("seg_id", "span_index", "final", "accepted", "reason")


@query
def polished_segments(spark, d):
    """The whole run without a model: route, plan, pack, rewrite by rule, gate, stitch."""
    s = _segments(spark, d).select("seg_id", "item_id", "seg_index", "tag", "text")
    planned = checkpointed(programs.with_programs(s))
    packed = packs.span_packs(programs.job_table(planned), MAX_CHARS, NUM_CTX)
    return rounds.stitch(planned, rounds.rewrite(packed, rounds.rule_based, retries=0)).select("seg_id", "new_text")


# --- change log -------------------------------------------------------------------
@query
def edits_log(spark, d):
    return changes.edits(table(spark, d, "edits")).select("edit_id", "chapter_id", "kind")


@query
def change_summary(spark, d):
    return changes.summary(table(spark, d, "edits"), "book_id")


@query
def sorted_edits(spark, d):
    e = table(spark, d, "edits").withColumn("n", changes.href_number(F.col("href")))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy("n", "href", "para", "kind", "edit_id"))).select("edit_id", "book_id", F.col("n").alias("href_no"), F.col("rank").cast("bigint").alias("rank"))


@query
def change_report(spark, d):
    return changes.markdown_entries(table(spark, d, "edits")).select("edit_id", F.md5("entry").alias("digest"))


@query
def change_log(spark, d):
    """A report a book, with the terms its glossary put into the present texts."""
    put = glossary.substitute(_segments(spark, d), _terms(spark, d), "seg_id").select("seg_id", F.explode("hits").alias("term", "n"))
    totals = put.join(_segments(spark, d).select("seg_id", "book_id"), "seg_id").groupBy("book_id", "term").agg(F.sum("n").alias("n"))
    return changes.report_markdown(table(spark, d, "edits"), "book_id", totals, k=3).select("book_id", F.md5("content").alias("digest"))


# --- glossary -----------------------------------------------------------------------
#: Terms that the texts of the tables do hold, added to every book's glossary.
OVERLAY = [("ink bottle", "inkwell"), ("the ink", "THE INK"), ("salt jar", "salt jar"), ("bell", "chime"), ("Brunnen", "Quelle"), ("银梳", "silver comb"), ("ключ", "key")]


def _terms(spark, d) -> DataFrame:
    own = table(spark, d, "glossary").select("book_id", F.col("ord").cast("bigint").alias("ord"), "source", "target", "kind", "notes")
    extra = F.array(*[F.struct(F.lit(1000 + i).cast("bigint").alias("ord"), F.lit(a).alias("source"), F.lit(b).alias("target")) for i, (a, b) in enumerate(OVERLAY)])
    more = table(spark, d, "books").select("book_id", F.explode(extra).alias("t")).select("book_id", "t.*", F.lit("overlay").alias("kind"), F.lit(None).cast("string").alias("notes"))
    return own.unionByName(more)


@query
def glossary_merge(spark, d):
    t = _terms(spark, d)
    return glossary.merge(t.filter("kind = 'person'"), t.filter("kind <> 'person'")).withColumn("ord", F.col("ord").cast("bigint"))


@query
def glossary_overwrite(spark, d):
    t = _terms(spark, d)
    return glossary.merge(t.filter("kind = 'person'"), t.filter("kind <> 'person'"), overwrite=True).withColumn("ord", F.col("ord").cast("bigint"))


@query
def glossary_relevant_topk(spark, d):
    hits = glossary.relevant(_segments(spark, d), _terms(spark, d), "seg_id")
    return hits.select("seg_id", "ord", "source", "target", F.col("rank").cast("bigint").alias("rank"))


@query
def glossary_unapplied(spark, d):
    hits = glossary.unapplied(glossary.relevant(_segments(spark, d), _terms(spark, d), "seg_id"))
    return hits.groupBy("seg_id").agg(F.count("*").alias("n"))


@query
def glossary_routing(spark, d):
    """Which paragraphs are sent when what they hold of their glossary counts, and how dirty they are then."""
    rows = glossary.with_wanted(_segments(spark, d).select("seg_id", "book_id", "tag", "text"), _terms(spark, d), "seg_id")
    hit = F.col("wanted").isNotNull()
    told = lambda s: F.struct(F.when(F.col("text").isNotNull(), rules.dirt_of(s, "polish", "tag", hit)).otherwise(0).cast("bigint").alias("score"), (F.col("text").isNotNull() & rules.needs_of(s, "tag", "polish", "aggressive", hit)).alias("sent"))
    return rows.select("seg_id", F.explode(F.array(let(rules.signals("text"), told))).alias("r")).select("seg_id", "r.*")


@query
def glossary_programs(spark, d):
    """Edit programs in which a unit with a glossary source is dirtier."""
    rows = glossary.with_wanted(_segments(spark, d).select("seg_id", "book_id", "tag", "text"), _terms(spark, d), "seg_id")
    return _long_index(programs.span_table(programs.with_programs(rows, wanted="wanted").select("seg_id", "program")))


@query
def glossary_system(spark, d):
    """What the rewriter is told for every pack of a book: the task, the style, the book's substitutions."""
    block = glossary.stable_block(_terms(spark, d))
    return block.select("book_id", prompts.span_system(F.col("block"), F.lit("")).alias("system"))


@query
def glossary_prompt(spark, d):
    return glossary.stable_block(_terms(spark, d))


@query
def glossary_apply(spark, d):
    out = glossary.substitute(_segments(spark, d), _terms(spark, d), "seg_id")
    return out.select("seg_id", F.md5("text").alias("digest"), F.aggregate(F.map_values("hits"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_hits"))


@query
def glossary_hits(spark, d):
    return glossary.hit_totals(glossary.substitute(_segments(spark, d), _terms(spark, d), "seg_id"))


@query
def glossary_json(spark, d):
    """Glossaries written as JSON and read again."""
    back = glossary.to_json(_terms(spark, d)).select("book_id", F.posexplode(glossary.sources_of_json(F.col("json"))).alias("place", "t"))
    return back.select("book_id", F.col("place").cast("bigint").alias("place"), "t.source", "t.target", "t.kind", F.nullif("t.notes", F.lit("")).alias("notes"))


# --- bookkeeping and lookups -----------------------------------------------------------
@query
def checkpoint_pending(spark, d):
    jobs = _jobs(spark, d).select(F.col("item_id").alias("chunk_id")).distinct()
    done = table(spark, d, "chapters").filter("chapter_ord % 2 = 0").select(F.lit("run1").alias("fingerprint"), F.col("item_id").alias("chunk_id"))
    return checkpoints.pending(jobs, done, "run1")


@query
def file_fingerprint(spark, d):
    b = table(spark, d, "books")
    return b.select("book_id", checkpoints.file_fingerprint(F.col("path"), F.length("path").cast("bigint"), F.col("added_at")).alias("fingerprint"))


@query
def format_names(spark, d):
    b = table(spark, d, "books")
    fmt = formats.normal_format(F.col("fmt"))
    return b.select("book_id", fmt.alias("fmt"), formats.stem(F.col("path")).alias("stem"), formats.output_path(F.col("path"), F.col("work_mode"), fmt).alias("output"))


@query
def selectable_chapters(spark, d):
    c = table(spark, d, "chapters").filter("NOT is_skipped").join(_segments(spark, d).select("item_id"), "item_id", "left_semi")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_ord"))
    return c.withColumn("n", n).filter("n BETWEEN 2 AND 4").select("book_id", "item_id", F.col("n").cast("bigint").alias("n"))


@query
def zip_member_match(spark, d):
    c = table(spark, d, "chapters")
    wanted = c.select(F.col("book_id").alias("doc_id"), F.regexp_replace("href", "#.*$", "").alias("file_name")).distinct()
    path = F.concat(F.lit("OEBPS/"), F.regexp_replace("href", "#.*$", ""))
    again = F.regexp_replace(path, "^OEBPS/text/", "OEBPS/old/")
    return lookup.match_members(wanted, c.select(F.col("book_id").alias("doc_id"), F.explode(F.array(path, again)).alias("member")).distinct())


MODELS = [("a", "tiny:3b"), ("a", "mid-14b-q4"), ("a", "deepseek-r1:14b"), ("a", "big 32b"), ("a", "alt-14b"), ("b", "plain"), ("b", "huge:70b"), ("c", "qwq:32b"), ("c", "thinking-7b"), ("d", "gem-e4b"), ("d", "one.5b"), ("d", "x0.5b")]


@query
def model_pick(spark, d):
    rows = [(k, i, m) for i, (k, m) in enumerate(MODELS)]
    return lookup.pick_model(spark.createDataFrame(rows, "k string, ord int, model string"), 14.0, "k")


VRAM = [(v, b, m) for v in (2000, 6000, 8000, 12000, 16000, 24000) for b, m in (("cuda", "m-14b"), ("cuda", "m-7b"), ("cpu", "m-7b"), ("vulkan", "m-70b"), ("cuda", "qwq"), ("cuda", "plain"))]


@query
def device_tier(spark, d):
    v = spark.createDataFrame(VRAM, "vram_mb int, backend string, model string")
    t = v.withColumn("t", lookup.device_tier(F.col("vram_mb")))
    c = t.withColumn("c", lookup.clamped(F.col("t"), F.col("model"), F.col("backend"), F.col("vram_mb")))
    return c.select("vram_mb", "backend", "model", F.col("t.max_params_b").alias("cap"), lookup.weights_billions(F.col("t.max_params_b")).alias("weights_b"), F.col("c.num_ctx").alias("num_ctx"), F.col("c.max_chars").alias("max_chars"), F.col("c.workers").alias("workers"), F.col("c.skip_mode").alias("skip_mode"))


@query
def plan_report(spark, d):
    out = report.plan(_segments(spark, d), MAX_CHARS)
    return out.select("item_id", "is_total", *[F.col(c).cast("bigint").alias(c) for c in ("paragraphs", "dirty", "skipped", "n_jobs", "packs")])


@query
def plan_translation(spark, d):
    out = report.plan(_segments(spark, d), MAX_CHARS, "translate")
    return out.select("item_id", "is_total", *[F.col(c).cast("bigint").alias(c) for c in ("paragraphs", "dirty", "skipped", "n_jobs", "packs")])


# --- sources and sinks ------------------------------------------------------------------
def _documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id")).alias("stem"), "text")


@query
def txt_paragraphs(spark, d):
    return texts.read_txt(_documents(spark, d)).select("doc_id", "item_id", F.col("seg_index").cast("bigint").alias("seg_index"), "text")


@query
def page_paragraphs(spark, d):
    pages = _documents(spark, d).select("doc_id", F.lit(0).alias("page"), "text")
    return texts.read_pages(pages).select("doc_id", "item_id", F.col("seg_index").cast("bigint").alias("seg_index"), "text")


@query
def md_blocks(spark, d):
    return markup.read_markup(_documents(spark, d), "md").select("doc_id", "item_id", "title", F.col("seg_index").cast("bigint").alias("seg_index"), "tag", "text")


@query
def html_blocks(spark, d):
    items = _as_documents(spark, d)
    pages = sinks.as_html(items).select("doc_id", F.lit("s").alias("stem"), F.col("content").alias("text"))
    back = markup.read_markup(pages, "html").join(items.select("doc_id", "item_id").distinct().withColumnRenamed("item_id", "item"), "doc_id")
    return back.select(F.col("item").alias("item_id"), F.col("seg_index").cast("bigint").alias("seg_index"), "tag", "text")


def _as_documents(spark, d) -> DataFrame:
    """Chapters as documents of their own, for the sinks."""
    s = _segments(spark, d)
    return s.select(F.xxhash64("item_id").alias("doc_id"), "item_id", F.col("item_id").alias("title"), "chapter_ord", (F.col("seg_index") * F.lit(10_000_000) + F.col("seg_id")).alias("seg_index"), "tag", "text", F.lit(False).alias("is_skipped"))


@query
def json_chapters(spark, d):
    s = _segments(spark, d)
    raw = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "tag", F.col("item_id").alias("chapter")))
    key = F.row_number().over(Window.partitionBy("book_id").orderBy("loaded_at", "seg_id"))
    recs = s.select("book_id", F.substring("book_id", 4, 20).alias("b"), key.alias("ord"), raw.alias("raw"))
    doc = F.replace("b", F.lit("-"), F.lit("")).cast("bigint")
    out = texts.read_records(recs.select(doc.alias("doc_id"), F.col("book_id").alias("stem"), "ord", "raw"))
    return out.select("doc_id", F.col("chapter_ord").cast("bigint").alias("chapter_ord"), "title", F.col("seg_index").cast("bigint").alias("seg_index"), "tag", "text")


def _digests(items: DataFrame, written: DataFrame) -> DataFrame:
    out = written.join(items.select("doc_id", "item_id").distinct(), "doc_id")
    return out.select("item_id", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


@query
def write_txt(spark, d):
    items = _as_documents(spark, d)
    return _digests(items, sinks.as_txt(items))


@query
def write_markdown(spark, d):
    items = _as_documents(spark, d)
    return _digests(items, sinks.as_markdown(items))


@query
def write_html(spark, d):
    items = _as_documents(spark, d)
    return _digests(items, sinks.as_html(items))


@query
def write_jsonl(spark, d):
    items = _as_documents(spark, d)
    return _digests(items, sinks.as_json(items, lines=True))
