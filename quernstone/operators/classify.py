"""A classifier as a row-valued source: pluggable clients, retries, strict reading."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.parse import parse_response

CALL = "raw_text string, llm_failure boolean, num_retries int, error_message string, elapsed_sec double"


class Client(Protocol):
    """Answers a prompt; raises when it can't."""

    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class RuleClient:
    """Answers y where any of the words stands in the prompt, else n; needs no network."""

    words: tuple[str, ...]

    def __call__(self, prompt: str) -> str:
        label = "y" if re.search(rf"(?i)\b(?:{'|'.join(self.words)})\b", prompt) else "n"
        return f'{{"contains_painpoint": "{label}", "confidence": 1.0, "pain_points": [{{"root_cause_summary": "rule", "pain_point_snippet": "rule"}}]}}'


@dataclass(frozen=True)
class ReplayClient:
    """Recorded answers; an unknown prompt fails. For records of a bounded size."""

    answers: dict[str, str] = field(default_factory=dict)

    def __call__(self, prompt: str) -> str:
        return self.answers[prompt]


def client_of(kind: str, makers: dict[str, Callable[[], Client]]) -> Client:
    """The client of a provider; an unknown provider raises."""
    if kind not in makers:
        raise ValueError(f"unknown provider {kind}, known: {', '.join(sorted(makers))}")
    return makers[kind]()


def probe(makers: dict[str, Callable[[], Client]], names: list[str] | None = None, prompt: str = "ping", timeout: float = 90.0) -> list[tuple[str, bool, str]]:
    """(provider, whether it answers, message) of the named providers or all; failures are told, not raised."""
    out = []
    for name in names if names is not None else sorted(makers):
        try:
            answer, failed, _, message = call_with_retry(client_of(name, makers), prompt, 0, timeout=timeout)
            out.append((name, not failed and bool(answer), message))
        except Exception as e:  # noqa: BLE001 - as documented
            out.append((name, False, f"{type(e).__name__}: {e}"))
    return out


def call_with_retry(client: Client, prompt: str, retries: int = 2, wait: Callable[[float], None] = time.sleep, timeout: float | None = 90.0) -> tuple[str, bool, int, str]:
    """(answer, failed, retries, message): waits 2, 4, 8 … seconds between attempts; never raises.

    A call that takes longer than ``timeout`` seconds counts as failed; its thread is left behind.
    """
    message = ""
    for attempt in range(retries + 1):
        try:
            return _within(timeout, client, prompt), False, attempt, ""
        except Exception as e:  # noqa: BLE001 - a failed call is a row
            message = f"{type(e).__name__}: {e}"
            if attempt < retries:
                wait(2.0 ** (attempt + 1))
    return "", True, retries, message


def _within(timeout: float | None, client: Client, prompt: str) -> str:
    if timeout is None:
        return client(prompt)
    box: list = []

    def run() -> None:
        try:
            box.append((client(prompt), None))
        except Exception as e:  # noqa: BLE001 - raised by the caller
            box.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(timeout)
    if not box:
        raise TimeoutError(f"no answer in {timeout:g} s")
    answer, error = box[0]
    if error is not None:
        raise error
    return answer


def generate(df: DataFrame, prompt: Column, client: Client, retries: int = 2, at_once: int | None = None, wait: Callable[[float], None] = time.sleep, timeout: float | None = 90.0) -> DataFrame:
    """``df`` with the columns of CALL. at_once: how many partitions, so calls, run at a time."""
    source = df.repartition(at_once) if at_once else df
    source = source.withColumn("__prompt", prompt)
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [CALL])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            calls = []
            for p in b["__prompt"]:
                began = time.perf_counter()
                calls.append((*call_with_retry(client, p or "", retries, wait, timeout), time.perf_counter() - began))
            made = pd.DataFrame(calls, columns=[c.split()[0] for c in CALL.split(", ")], index=b.index)
            yield pd.concat([b[names], made], axis=1)

    return source.mapInPandas(run, schema)


def classify(df: DataFrame, prompt: Column, client: Client, **options) -> DataFrame:
    """Answers read strictly: label, summary, snippet, confidence and error flags; a failed call is undecided."""
    called = generate(df, prompt, client, **options)
    read = called.withColumn("__r", parse_response(F.col("raw_text")))
    value = lambda name, failed: F.when(F.col("llm_failure"), F.lit(failed)).otherwise(F.col(f"__r.{name}")).alias(name)
    return read.select(*df.columns, value("label", "u"), value("summary", ""), value("snippet", ""), value("confidence", 0.0), value("parse_error", False), value("schema_error", False), value("used_fallback", False), "llm_failure", "num_retries", "elapsed_sec")


def error_counters(predictions: DataFrame) -> DataFrame:
    """One row: rows, parse and schema errors, fallbacks, failures, mean seconds."""
    return predictions.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("parse_error", "schema_error", "used_fallback", "llm_failure")], F.avg("elapsed_sec").alias("mean_sec"))
