"""Titles from a chat-completion server: fan-out over endpoints, cleaning, checks, and append with resume."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from ..operators.titles import LIMIT, not_done

Transport = Callable[[str, dict, float], dict]
SCHEMA = "id string, instance string, raw string, seconds double, error string"


def post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def call(url: str, model: str, system: str, message: str, timeout: float = 120, max_tokens: int = 64, attempts: int = 3, transport: Transport = post, wait: Callable[[float], None] = time.sleep) -> str:
    """The answer's text. Failures are tried again after a growing pause; an answer that is all reasoning is an error."""
    body = {"model": model, "temperature": 0.2, "max_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": message}]}
    for turn in range(1, attempts + 1):
        try:
            said = transport(f"{url.rstrip('/')}/v1/chat/completions", body, timeout)["choices"][0]["message"]
            if not (said.get("content") or "").strip() and said.get("reasoning_content"):
                raise ValueError("only reasoning, no content")
            return said.get("content") or ""
        except Exception:
            if turn == attempts:
                raise
            wait(1.5 * turn)
    raise ValueError("attempts must be 1 or more")


def available(url: str, transport: Callable[[str], dict]) -> set[str]:
    """Models that a server has loaded."""
    return {m["id"] for m in transport(f"{url.rstrip('/')}/v1/models").get("data", [])}


def loaded_or_raise(url: str, model: str, transport: Callable[[str], dict], most_context: int = 16_384) -> list[str]:
    """Refuses a server that hasn't loaded ``model``; the result are warnings: other models that it holds, and a context beyond ``most_context``."""
    found = {m["id"]: m for m in transport(f"{url.rstrip('/')}/v1/models").get("data", [])}
    if model not in found:
        raise ValueError(f"{url} has not loaded {model}")
    said = [f"other resident models: {', '.join(sorted(found.keys() - {model}))}"] if len(found) > 1 else []
    context = found[model].get("loaded_context_length") or 0
    return said + ([f"{model} at context {context}"] if context > most_context else [])


def ask(messages: DataFrame, endpoints: list[str], model: str, system: str, transport: Transport = post, limit: int = LIMIT, slow: dict[str, float] | None = None, **options) -> DataFrame:
    """(id, instance, raw, seconds, error, title, refused): one answer a message, long messages first; endpoints are ``name@url``.

    Each partition is one endpoint's and each endpoint has one, so there are as many requests under way as endpoints. ``slow`` has how many times
    as long an endpoint takes: it gets so many times fewer messages, and the shortest, so that it doesn't hold up the end.
    """
    named = [e.split("@", 1) for e in endpoints]
    n = len(named)
    factor = [max(1.0, (slow or {}).get(name, 1.0)) for name, _ in named]
    order = sorted(range(n), key=lambda i: -factor[i])  # the slowest take the shortest
    share = [1 / factor[i] for i in order]
    slow_ones = [i for i in order if factor[i] > 1]
    d = messages.select("id", F.substring("text", 1, limit).alias("text")).withColumn("_n", F.coalesce(F.length("text"), F.lit(0)))
    fast = [i for i in range(n) if i not in slow_ones]
    pick = lambda among: F.element_at(F.array(*map(F.lit, among)), (F.pmod(F.xxhash64("id"), F.lit(len(among))) + 1).cast("int"))
    slot = pick(fast or order)
    if slow_ones and fast:
        upto = [sum(share[: k + 1]) / sum(share) for k in range(len(slow_ones))]
        bounds = d.approxQuantile("_n", upto, 0.001)  # as many numbers as slow endpoints
        for i, most in reversed(list(zip(slow_ones, bounds or [-1.0] * len(upto)))):
            slot = F.when(F.col("_n") <= most, F.lit(i)).otherwise(slot)
    # by the number itself: a hash of it would leave some partitions empty
    d = d.withColumn("_slot", slot).repartitionById(n, F.col("_slot")).sortWithinPartitions(F.desc("_n")).drop("_n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, slot in zip(pdf["id"], pdf["text"], pdf["_slot"]):
                name, url = named[slot]
                began = time.monotonic()
                try:
                    rows.append((i, name, call(url, model, system, text, transport=transport, **options), round(time.monotonic() - began, 3), None))
                except Exception as e:  # one message's failure is its record
                    rows.append((i, name, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["id", "instance", "raw", "seconds", "error"])

    out = d.mapInPandas(run, SCHEMA)
    title = F.when(F.col("error").isNull(), T.clean_title("raw"))
    return out.withColumn("title", title).withColumn("refused", F.when(F.col("error").isNull(), T.is_refusal(title)))


def append_titles(spark: SparkSession, messages: DataFrame, path: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Appends records of messages that ``path`` doesn't have yet, errors included, as JSON lines; returns how many messages were left."""
    try:
        done = spark.read.schema("id string").option("mode", "DROPMALFORMED").json(path)
        left = not_done(messages, done.where("id IS NOT NULL"))
    except AnalysisException:
        left = messages
    n = left.count()
    if n:
        make(left).write.mode("append").json(path)
    return n
