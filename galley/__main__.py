"""``python -m galley COMMAND``: plans, rewritten documents, glossaries, servers' models and what a card carries."""

from __future__ import annotations

import argparse
import json
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from galley.api import plan_folder, rewrite_documents
from galley.operators import lookup
from galley.operators.endpoints import EngineError, http_rewriter
from galley.operators.glossary import load_glossary, to_json
from galley.operators.rounds import rule_based
from galley.plans.terms import build_glossary, extract_terms
from galley.sources.reader import read_folder
from galley.sources.sinks import write_files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="galley")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, folder: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        if folder:
            p.add_argument("folder")
            p.add_argument("--max-chars", type=int, default=1800)
            p.add_argument("--skip", default="auto", choices=["off", "auto", "aggressive"])
        return p

    command("plan", "what would be sent, by chapter and in all")
    p = command("apply", "rewrite the documents of a folder, each in its own format")
    p.add_argument("--out", default="polished", help="folder of the results")
    p.add_argument("--format", help="one format for all results")
    p.add_argument("--mode", default="auto", choices=["auto", "polish", "translate"])
    p.add_argument("--glossary", help="JSON files of terms")
    p.add_argument("--retries", type=int, default=2)
    g = command("glossary", "terms that a server finds in the documents of a folder, with those of a file")
    g.add_argument("--glossary", help="JSON files of terms that come first")
    g.add_argument("--out", default="glossary", help="folder of the glossary")
    for q, needed in ((p, False), (g, True), (command("models", "models of a server, and the one that would be used", False), True)):
        q.add_argument("--url", required=needed, help="an OpenAI-compatible /v1/chat/completions" + ("" if needed else "; without it stock phrases are replaced by rule"))
        q.add_argument("--model", help="by default the largest that is no reasoning model and fits")
        q.add_argument("--max-params", type=float, default=14.0, help="billions of parameters that fit")
    command("devices", "what a graphics card carries", False).add_argument("vram_mb", type=int)
    return out


def listed_models(url: str, timeout: float = 10.0) -> list[str]:
    """The models that the server of a chat address lists."""
    with urllib.request.urlopen(url.rsplit("/chat/", 1)[0] + "/models", timeout=timeout) as answer:
        return [m["id"] for m in json.loads(answer.read()).get("data", [])]


def chosen_model(spark: SparkSession, url: str, name: str | None, max_params: float) -> str:
    """The model asked for, else the best of the server's; an error if it has none."""
    if name:
        return name
    models = listed_models(url)
    if not models:
        raise EngineError(f"{url} lists no model")
    rows = spark.createDataFrame([("", i, m) for i, m in enumerate(models)], "k string, ord int, model string")
    return lookup.pick_model(rows, max_params, "k").first()["model"]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("galley").getOrCreate()
    if args.command == "plan":
        for r in plan_folder(spark, args.folder, args.max_chars, args.skip).orderBy("is_total", "item_id").toLocalIterator():
            print(f"{'all' if r.is_total else r.item_id}\t{r.paragraphs} paragraphs\t{r.dirty} to rewrite\t{r.n_jobs} spans\t{r.packs} packs")
    elif args.command == "devices":
        tier = spark.range(1).select(lookup.device_tier(F.lit(args.vram_mb)).alias("t")).select("t.*", lookup.weights_billions(F.col("t.max_params_b")).alias("weights_b")).first()
        print(", ".join(f"{k} {v}" for k, v in tier.asDict().items()))
    elif args.command == "models":
        chosen = chosen_model(spark, args.url, args.model, args.max_params)
        for m in listed_models(args.url):
            print(f"{'*' if m == chosen else ' '} {m}")
    elif args.command == "glossary":
        rewriter = http_rewriter(args.url, chosen_model(spark, args.url, args.model, args.max_params))
        segments = read_folder(spark, args.folder).withColumn("book_id", F.lit(""))
        given = load_glossary(spark, args.glossary).withColumn("book_id", F.lit("")) if args.glossary else None
        terms = build_glossary(given, extract_terms(segments, rewriter, ["doc_id", "chapter_ord", "seg_index"]))
        write_files(to_json(terms).select(F.lit("glossary.json").alias("name"), F.col("json").alias("content")), args.out)
        print(f"{terms.count()} terms in {args.out}/glossary.json")
    else:
        terms = load_glossary(spark, args.glossary) if args.glossary else None
        rewriter = http_rewriter(args.url, chosen_model(spark, args.url, args.model, args.max_params)) if args.url else rule_based
        done = rewrite_documents(spark, args.folder, args.out, args.format, rewriter=rewriter, max_chars=args.max_chars, retries=args.retries, skip_mode=args.skip, mode=args.mode, terms=terms)
        n, size = done.agg(F.count("*"), F.sum("n_bytes")).first()
        print(f"{n} files, {size or 0} bytes in {args.out}")


if __name__ == "__main__":
    main()
