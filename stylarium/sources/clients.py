"""Outside models asked from the tasks: several requests at once, a rate, waits that double, and an error a row.

Prompts are asked by their digest, each different one once, and only those without a stored answer. Answers are published as
a version of the store before anything is joined, so a later call, or a plan that is worked out again,
does not ask for them a second time; prompts that failed have an error and are asked by the next call.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import versions

ANSWER = "digest string, answer string, error string, attempts int"


class Transient(Exception):
    """An answer that may come if it is asked for again; after: seconds that the server wants to be left alone."""

    def __init__(self, message: str, after: float = 0.0) -> None:
        super().__init__(message)
        self.after = after


@dataclass(frozen=True)
class Limits:
    """at_once and per_second (None: no limit) hold for a task: a cluster asks as many times more as it has tasks at work."""

    at_once: int = 4
    per_second: float | None = None
    tries: int = 4
    wait: float = 0.5
    longest_wait: float = 30.0


class Pace:
    """Lets callers through one by one, 1 / per_second apart."""

    def __init__(self, per_second: float | None) -> None:
        self.gap, self.free, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def pass_on(self) -> None:
        if self.gap:
            with self.lock:
                at = max(time.monotonic(), self.free)
                self.free = at + self.gap
            time.sleep(max(0.0, at - time.monotonic()))


def patient(ask: Callable[[str], str], prompt: str, limits: Limits, pace: Pace) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts): Transient errors are tried again, others end the row."""
    for attempt in range(1, limits.tries + 1):
        pace.pass_on()
        try:
            return ask(prompt), None, attempt
        except Transient as e:
            if attempt == limits.tries:
                return None, f"{type(e).__name__}: {e}", attempt
            time.sleep(min(limits.longest_wait, max(e.after, limits.wait * 2 ** (attempt - 1))))
        except Exception as e:  # whatever a client raises is that row's error
            return None, f"{type(e).__name__}: {e}", attempt
    raise ValueError("tries must be at least 1")


def asked(make: Callable[[], Callable[[str], str]], limits: Limits):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pace = make(), Pace(limits.per_second)
        with ThreadPoolExecutor(limits.at_once) as pool:
            for pdf in it:
                got = list(pool.map(lambda p: patient(ask, p, limits, pace), pdf["prompt"].tolist()))
                yield pd.DataFrame({"digest": pdf["digest"], "answer": [a for a, _, _ in got], "error": [e for _, e, _ in got], "attempts": [n for _, _, n in got]})

    return run


def answers(df: DataFrame, prompt: str, store: str, make: Callable[[], Callable[[str], str]], model: str, limits: Limits = Limits(), tasks: int | None = None) -> DataFrame:
    """df with answer and error. make builds a task's client, a function from a prompt to its answer; model names it in the store.

    A null prompt has neither. tasks bounds how many tasks ask at the same time.
    """
    spark = df.sparkSession
    digest = F.sha2(F.concat(F.lit(model), F.lit("\n"), F.col(prompt)), 256)
    want = df.where(F.col(prompt).isNotNull()).select(digest.alias("digest"), F.col(prompt).alias("prompt")).groupBy("digest").agg(F.first("prompt").alias("prompt"))
    if versions.manifest(spark, store):
        want = want.join(versions.load(spark, store).where("answer is not null").select("digest"), "digest", "left_anti")
    want = want.repartition(tasks) if tasks else want
    versions.publish(want.mapInPandas(asked(make, limits), ANSWER), store, {"model": model}, append=True)
    # Several calls may have failed before one succeeds: an answer counts before any error, then the last number of attempts.
    best = F.max_by(F.struct("answer", "error"), F.struct(F.col("answer").isNotNull(), "attempts")).alias("x")
    known = versions.load(spark, store).groupBy(F.col("digest").alias("_own")).agg(best)
    out = df.withColumn("_digest", digest).join(known, F.col("_digest") == F.col("_own"), "left")
    return out.select(*df.columns, F.col("x.answer").alias("answer"), F.when(F.col("x.answer").isNull(), F.col("x.error")).alias("error"))


def chat_client(url: str, model: str, timeout: float = 60.0, **options) -> Callable[[], Callable[[str], str]]:
    """Makes clients of a chat completions endpoint: one user message in, the first choice's text out."""

    def make() -> Callable[[str], str]:
        def ask(prompt: str) -> str:
            body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], **options}).encode()
            request = Request(url, body, {"Content-Type": "application/json"})
            try:
                with urlopen(request, timeout=timeout) as response:
                    return json.load(response)["choices"][0]["message"]["content"]
            except HTTPError as e:
                if e.code in (408, 409, 425, 429) or e.code >= 500:
                    after = e.headers.get("Retry-After") or "0"
                    raise Transient(f"HTTP {e.code}", float(after) if after.replace(".", "", 1).isdigit() else 0.0) from e
                raise ValueError(f"HTTP {e.code}") from e
            except (URLError, TimeoutError, ConnectionError) as e:
                raise Transient(str(e)) from e

        return ask

    return make


def healthy(url: str, timeout: float = 5.0) -> bool:
    try:
        with urlopen(url, timeout=timeout) as response:
            return response.status < 400
    except (URLError, TimeoutError, ConnectionError):
        return False
