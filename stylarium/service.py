"""The service's entry functions over the loop: request checks, health, styles and a batch transform."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import stripped
from .operators import agent
from .plans import loop

MOST_CHARS, MOST_ROUNDS = 10_000, 3


def request_errors(requests: DataFrame) -> DataFrame:
    """id, error of requests (id, text, max_iter, seed) that break the limits."""
    n = F.length(F.coalesce("text", F.lit("")))
    error = F.when((stripped(F.coalesce("text", F.lit(""))) == "") | (n > MOST_CHARS), f"text must have 1 to {MOST_CHARS} characters").when(
        ~F.coalesce("max_iter", F.lit(1)).between(1, MOST_ROUNDS), f"max_iter must be 1 to {MOST_ROUNDS}"
    )
    return requests.select("id", error.alias("error")).where("error is not null")


def transform(requests: DataFrame, generate: loop.Step, verify: loop.Step, score: loop.Step, retrieve: loop.Step, settings: loop.Settings = loop.Settings()) -> DataFrame:
    """The loop's results of valid requests; an invalid one is an error that names it."""
    bad = request_errors(requests).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['error']}" for r in bad))
    return loop.run(retrieve(requests.select("id", F.col("text").alias("input"))), generate, verify, score, settings)


def events(results: DataFrame) -> DataFrame:
    return agent.service_events(results, "id")


def health(probes: Mapping[str, Callable[[], bool]]) -> dict:
    """status and each dependency's state; a probe that fails or raises is down."""
    states = {}
    for name, probe in probes.items():
        try:
            states[name] = "up" if probe() else "down"
        except Exception as e:  # a probe may fail in any way; the state is all that is told
            states[name] = f"down ({type(e).__name__})"
    return {"status": "ok" if all(s == "up" for s in states.values()) else "degraded", "dependencies": states}


def styles(names: Mapping[str, str]) -> list[dict[str, str]]:
    return [{"id": k, "name": v} for k, v in sorted(names.items())]
