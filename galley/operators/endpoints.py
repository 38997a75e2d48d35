"""Rewriters behind HTTP, and the choice among servers that were probed."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.operators.prompts import SPAN_SYSTEM
from galley.operators.rounds import Rewriter


class EngineError(RuntimeError):
    """A server that does not answer as it should."""


# Kinds of server in order of preference, on a CUDA card and elsewhere.
PREFERENCE = {"cuda": ["vllm", "llamacpp", "openai", "ollama"], "other": ["llamacpp", "ollama", "openai", "vllm"]}


def host_kind(tags: Column, props: Column, models: Column) -> Column:
    """The kind of server by which of its probes answered: tags, then props, then the owner in its models."""
    return F.when(tags, "ollama").when(props, "llamacpp").when(F.lower(models).contains("vllm"), "vllm").when(models.isNotNull(), "openai")


def choose_server(probes: DataFrame, backend: str) -> DataFrame:
    """(run, host, kind): the preferred server of each run among ``probes`` (run, ord, host, kind); the first of equals."""
    order = F.array(*[F.lit(k) for k in PREFERENCE["cuda" if backend == "cuda" else "other"]])
    place = F.array_position(order, F.col("kind"))
    r = F.row_number().over(Window.partitionBy("run").orderBy(place, "ord"))
    return probes.filter("kind IS NOT NULL").withColumn("r", r).filter("r = 1").select("run", "host", "kind")


def _ask(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


# What ends an answer, besides its length.
STOP = ["KEEP before (do not output)", "KEEP after (do not output)"]


def _answer(url: str, body: dict, timeout: float, tries: int) -> str:
    """The text that a server answers, "" where it never does.

    A server that refuses the request (400) is asked again without what not every server
    knows; one that has no such address (404) is an error of the caller's.
    """
    for k in range(tries):
        try:
            return _ask(url, body, timeout)["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise EngineError(f"{url} is not there") from e
            if e.code == 400 and "stop" in body:
                body = {x: v for x, v in body.items() if x != "stop"}
                continue
            time.sleep(min(8.0, 0.5 * 2**k))
        except (OSError, KeyError, ValueError, IndexError, TypeError):
            time.sleep(min(8.0, 0.5 * 2**k))
    return ""


def http_rewriter(url: str, model: str, slots: int = 8, system: str = SPAN_SYSTEM, temperature: float = 0.2, timeout: float = 600.0, tries: int = 3) -> Rewriter:
    """A rewriter at an OpenAI-compatible ``/v1/chat/completions``; at most ``slots`` packs are asked at once.

    A pack's own ``system`` text stands before that of the call. A pack whose calls all fail has an empty answer, which settles nothing: its jobs keep
    their source unless another attempt succeeds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = []
            for prompt, limit, said in zip(pdf["prompt"], pdf["max_tokens"], pdf["system"]):
                body = {"model": model, "temperature": temperature, "max_tokens": int(limit), "stop": STOP, "messages": [{"role": "system", "content": said or system}, {"role": "user", "content": prompt}]}
                raw.append(_answer(url, body, timeout, tries))
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "attempt": pdf["attempt"], "raw": raw})

    said = lambda packs: F.col("system") if "system" in packs.columns else F.lit(None).cast("string").alias("system")
    return lambda packs: packs.select("chunk_id", "attempt", "prompt", "max_tokens", said(packs)).repartition(slots).mapInPandas(run, "chunk_id string, attempt int, raw string")
