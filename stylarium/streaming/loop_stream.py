"""The rewrite loop as a stream: a state a request, a timer a round, retries by timers that wait longer each time.

Every micro-batch runs at most one round of each live request. What a round gave is in the state store before
the next one begins, so a query that is stopped, or loses an executor, goes on with the round it was in; only outside calls of
a round that had not been committed are made again. A request that comes again, live or finished, is ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.loop import Settings

RESULT = "id string, output string, selected_round int, total_rounds int, termination string, fallback_kind string, error string, rounds string, attempts int"


@dataclass(frozen=True)
class Steps:
    """What a task asks of outside: generate(request) -> text, verify(input, text) -> violations (kind, expected, actual),
    score(input, text) -> number, and retrieve(request) -> exemplars, for a request (id, input, exemplars, iter, previous, violations).

    An exception of generate is a failed attempt.
    """

    generate: Callable[[dict], str]
    verify: Callable[[str, str], list[dict]]
    score: Callable[[str, str], float]
    retrieve: Callable[[dict], list[dict]] | None = None


def next_step(failed: bool, blank: bool, violations: int, score: float | None, done: int, settings: Settings, retried: bool) -> str:
    """accept, revise or re_retrieve, as the batch plan routes."""
    if failed or done >= settings.most:
        return "accept"
    if blank or violations:
        return "revise"
    return "re_retrieve" if settings.least is not None and score < settings.least and not retried else "accept"


def outcome(s: dict, settings: Settings) -> dict:
    """The result of a finished request: never an empty success."""
    full = [r for r in s["rounds"] if (r["output"] or "").strip()]
    best = min(full, key=lambda r: (len(r["violations"]), -r["score"], r["round"]), default=None)
    kind = s["halt"]
    if kind == "first_round_error":
        best = None
    elif best is None:
        kind = "all_blank"
    low = settings.least is not None and s["rounds"] and s["rounds"][-1]["score"] < settings.least
    unfinished = s["iter"] >= settings.most and (s["violations"] or low)
    return {
        "id": s["id"],
        "output": best["output"] if best else s["input"],
        "selected_round": best["round"] if best else None,
        "total_rounds": s["iter"],
        "termination": "fallback" if kind else "max_rounds" if unfinished else "accepted",
        "fallback_kind": kind,
        "error": s["error"],
        "rounds": json.dumps(s["rounds"], ensure_ascii=False),
        "attempts": s["attempts"],
    }


def one_round(s: dict, steps: Steps, settings: Settings) -> dict:
    """The state after a generation that did not fail."""
    text = steps.generate({k: s[k] for k in ("id", "input", "exemplars", "iter", "previous", "violations")})
    blank = not (text or "").strip()
    violations = [] if blank else [{k: v.get(k) for k in ("kind", "expected", "actual")} for v in steps.verify(s["input"], text)]
    score = 0.0 if blank else float(steps.score(s["input"], text))
    done = s["iter"] + 1
    s = s | {"iter": done, "previous": text, "violations": violations, "tries": 0}
    s["rounds"] = [*s["rounds"], {"round": done, "output": text, "violations": violations, "score": score}]
    way = next_step(False, blank, len(violations), score, done, settings, s["retrieved"])
    if way == "re_retrieve":
        s |= {"retrieved": True, "exemplars": steps.retrieve(s) if steps.retrieve else s["exemplars"]}
    return s | {"done": way == "accept"}


class LoopProcessor(StatefulProcessor):
    """One request a key; see the module. wait: milliseconds before the first retry, doubled for each further one."""

    def __init__(self, make: Callable[[], Steps], settings: Settings, retries: int, wait: int) -> None:
        self.make, self.settings, self.retries, self.wait = make, settings, retries, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.steps = handle, None
        self.state = handle.getValueState("loop", "state string")

    def read(self) -> dict:
        return json.loads(self.state.get()[0])

    def write(self, s: dict) -> None:
        self.state.update((json.dumps(s, ensure_ascii=False),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.to_dict("records"):
                if not self.state.exists():
                    exemplars = json.loads(r["exemplars"]) if r.get("exemplars") else []
                    self.write({"id": key[0], "input": r["input"], "exemplars": exemplars, "rounds": [], "violations": [], "previous": None, "iter": 0,
                                "done": False, "halt": None, "error": None, "retrieved": False, "tries": 0, "attempts": 0})
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        s = self.read()
        if s["done"]:
            return
        self.steps = self.steps or self.make()
        s["attempts"] += 1
        now, pause = timerValues.getCurrentProcessingTimeInMs(), 0
        try:
            s = one_round(s, self.steps, self.settings)
        except Exception as e:  # a client may fail in any way: it is tried again, then the request ends
            s["tries"] += 1
            if s["tries"] <= self.retries:
                pause = self.wait << (s["tries"] - 1)
            else:
                s |= {"done": True, "error": type(e).__name__, "halt": "later_round_error" if s["iter"] else "first_round_error", "iter": s["iter"] + 1}
        if not s["done"]:
            self.handle.registerTimer(now + max(pause, 1))  # later than the timer that has just expired, which goes with this call
            self.write(s)
            return
        result = outcome(s, self.settings)
        self.write({"done": True})  # the id stays known
        frame = pd.DataFrame([result])
        yield frame.astype({"selected_round": "Int32", "total_rounds": "int32", "attempts": "int32"})

    def close(self) -> None:
        pass


def run_stream(requests: DataFrame, make: Callable[[], Steps], settings: Settings = Settings(), retries: int = 2, wait: int = 200) -> DataFrame:
    """RESULT of every finished request of a stream (id, input, exemplars: JSON list or null). make builds a task's steps."""
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    exemplars = F.col("exemplars") if "exemplars" in requests.columns else F.lit(None).cast("string")
    rows = requests.select(F.col("id").cast("string").alias("id"), "input", exemplars.alias("exemplars"))
    return rows.groupBy("id").transformWithStateInPandas(
        statefulProcessor=LoopProcessor(make, settings, retries, wait), outputStructType=RESULT, outputMode="append", timeMode="processingTime"
    )
