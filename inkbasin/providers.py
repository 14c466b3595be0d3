"""Model calls: the contract, an offline provider by rules, recorded replies, and escalation of invalid replies.

Calls run in mapInPandas with one client per task. A task may run again, so a provider has to be idempotent.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbasin.functions import jsonrepair
from inkbasin.functions.numbers import provider_cost

REPLY = "key string, text string, model string, provider string, tokens_in long, tokens_out long, error string"


class Provider(Protocol):
    name: str

    def extract(self, prompt: str, model: str, max_tokens: int) -> str: ...


class RuleProvider:
    """Deterministic and offline: the first line as title, the first sentences as summary, sentences with numbers as facts."""

    name = "rules"

    def extract(self, prompt: str, model: str, max_tokens: int) -> str:
        text = prompt.rpartition("CONTENT:\n")[2].strip()
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        points = [s for s in sentences if re.search(r"\d", s)][:10]
        return json.dumps({"title": text.split("\n", 1)[0][:80], "summary": " ".join(sentences[:2])[:500], "key_points": points}, ensure_ascii=False)


class RecordedProvider:
    """Replies by prompt hash, for tests and reruns."""

    name = "recorded"

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def extract(self, prompt: str, model: str, max_tokens: int) -> str:
        import hashlib

        return self.replies[hashlib.sha256(prompt.encode()).hexdigest()[:12]]


_REGISTRY: dict[str, Callable[[], Provider]] = {"rules": RuleProvider}
#: Environment variables that hold the keys of providers.
_KEYS: dict[str, str] = {}


def register(name: str, factory: Callable[[], Provider], key: str | None = None) -> None:
    """Make a provider known; key: the environment variable without which it can't be asked."""
    _REGISTRY[name] = factory
    _KEYS.pop(name, None)
    if key:
        _KEYS[name] = key


def first_available(*names: str) -> str:
    """The first of some providers whose key is there; ValueError that names what is missing if there is none."""
    for name in names:
        get_provider_factory(name)
        if name not in _KEYS or os.environ.get(_KEYS[name]):
            return name
    raise ValueError("no provider has its key: " + ", ".join(f"{n} needs {_KEYS[n]}" for n in names))


def get_provider_factory(name: str) -> Callable[[], Provider]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown provider: {name}")
    return _REGISTRY[name]


def get_provider(name: str) -> Provider:
    return get_provider_factory(name)()


def call(requests: DataFrame, provider: Callable[[], Provider] | str = "rules", max_rpm: float = 0, attempts: int = 1, base: float = 2.0, lanes: int = 1) -> DataFrame:
    """requests (key, prompt, model, max_tokens) -> replies; a failed call is a row with an error, never a failed job.

    max_rpm: calls a minute of the whole job, repeated ones included. It is dealt to `lanes` tasks that a barrier stage
    starts together, each with its share and its own offset, so two calls never start closer than 60 / max_rpm seconds;
    there must be room for so many tasks at once. Without a limit every task calls as fast as it can. attempts: a call
    that fails is tried again up to so many times in all, after base, base squared, ... seconds; the last error stays.
    """
    make = (lambda p=provider: _REGISTRY[p]()) if isinstance(provider, str) else provider
    if isinstance(provider, str):
        get_provider(provider)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        wait = _lane(max_rpm, lanes) if max_rpm else lambda: None
        for rows in batches:
            out = []
            for r in rows.itertuples():
                text = error = None
                for attempt in range(1, max(1, attempts) + 1):
                    wait()
                    try:
                        text, error = client.extract(r.prompt, r.model, int(r.max_tokens)), None
                        break
                    except Exception as e:  # one row's failure stays with the row
                        error = f"{type(e).__name__}: {e}"
                    if attempt < attempts:
                        time.sleep(base**attempt)
                out.append((r.key, text, r.model, client.name, len(r.prompt) // 4, len(text or "") // 4, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLY.split(", ")])

    asked = requests.select("key", "prompt", "model", "max_tokens")
    return asked.repartition(lanes).mapInPandas(run, REPLY, barrier=True) if max_rpm else asked.mapInPandas(run, REPLY)


def _lane(max_rpm: float, lanes: int) -> Callable[[], None]:
    """Waits for this task's next turn: lane k of n has every n-th turn, counted from when all lanes have come together."""
    from pyspark import BarrierTaskContext

    context = BarrierTaskContext.get()
    # the latest of the lanes' clocks, so that they count from one moment
    begin = max(float(x) for x in context.allGather(str(time.time())))
    turn = context.partitionId()

    def wait() -> None:
        nonlocal turn
        now = time.time()
        at = begin + turn * 60 / max_rpm
        if at < now:  # turns that went by are lost, not saved up
            missed = -int(-(now - at) // (lanes * 60 / max_rpm))
            turn += missed * lanes
            at = begin + turn * 60 / max_rpm
        time.sleep(max(0.0, at - now))
        turn += lanes

    return wait


def validated(requests: DataFrame, replies: DataFrame, second: Callable[[], Provider] | str, model: str) -> DataFrame:
    """Replies, those without a valid structure replaced by a second provider's, asked once."""
    checked = replies.withColumn("valid", jsonrepair.structure_valid(jsonrepair.parsed(F.col("text"))))
    bad = requests.join(checked.filter(~F.coalesce("valid", F.lit(False))).select("key"), "key", "left_semi").withColumn("model", F.lit(model))
    again = call(bad, second).withColumn("valid", jsonrepair.structure_valid(jsonrepair.parsed(F.col("text"))))
    return checked.filter("valid").unionByName(again)


def costs(replies: DataFrame) -> DataFrame:
    return replies.select("key", "model", "provider", "tokens_in", "tokens_out", provider_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")).alias("cost"))


def poll(state: Callable[[], str], every: float = 60, most: float = 86_400, terminal: tuple[str, ...] = ("succeeded", "failed", "cancelled", "expired")) -> str:
    """Ask until a terminal state; TimeoutError after `most` seconds."""
    end = time.monotonic() + most
    while (now := state()) not in terminal:
        if time.monotonic() >= end:
            raise TimeoutError(now)
        time.sleep(every)
    return now


def prompts(texts: DataFrame, template: str, *, context: str = "", redact: list[str] = (), marker: str = "CONTENT:\n", most: int = 80_000) -> DataFrame:
    """texts (key, text, doc_type, overlay_fields) with the prompt: context, template with its fields, terms to leave out, text."""
    parts = []
    if context:
        parts.append(F.lit(f"CONTEXT: {context}\n\n"))
    filled = F.replace(F.replace(F.lit(template), F.lit("{doc_type}"), F.coalesce("doc_type", F.lit("general"))), F.lit("{overlay_fields}"), F.coalesce("overlay_fields", F.lit("")))
    parts += [filled, F.lit("\n\n")]
    if redact:
        parts.append(F.lit("Do not mention: " + ", ".join(redact) + "\n\n"))
    return texts.withColumn("prompt", F.concat(*parts, F.lit(marker), F.substring("text", 1, most)))
