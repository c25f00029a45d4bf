"""A streaming sink for the service's events: files first, one manifest an epoch last, replays written once.

Tasks write their rows to files that nobody reads yet and tell the driver their names. The driver names them in the
epoch's manifest, put in place in one step that fails if the epoch has one: an epoch that runs again, after a driver was lost
between the manifest and the query's own log, finds it there and drops its new files. Readers follow the manifests,
so they see an epoch whole, and each event once.

The folder must be mounted at the same path on the driver and all executors.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

EVENT = "id string, seq int, event string, data string"
FILES, EPOCHS, DIGITS = "files", "epochs", 12


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


def remove(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)


class EventWriter(DataSourceStreamWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        for part in (FILES, EPOCHS):
            os.makedirs(f"{folder}/{part}", exist_ok=True)

    def write(self, iterator: Iterator) -> Written:
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with open(f"{self.folder}/{FILES}/{name}", "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(json.dumps({"id": row["id"], "seq": row["seq"], "event": row["event"], "data": row["data"]}, ensure_ascii=False) + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        return Written(name, n)

    def commit(self, messages: list, batchId: int) -> None:
        told = [m for m in messages if m is not None]
        draft, place = f"{self.folder}/{EPOCHS}/.{uuid.uuid4().hex}", f"{self.folder}/{EPOCHS}/{batchId:0{DIGITS}}.json"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({"epoch": batchId, "files": [m.name for m in told if m.rows], "rows": sum(m.rows for m in told)}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, place)
        except FileExistsError:
            self.drop(told)
        else:
            self.drop([m for m in told if not m.rows])
        finally:
            remove(draft)

    def abort(self, messages: list, batchId: int) -> None:
        self.drop([m for m in messages if m is not None])

    def drop(self, messages: list) -> None:
        for m in messages:
            remove(f"{self.folder}/{FILES}/{m.name}")


class EventSink(DataSource):
    """Format "service_events"; option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return "service_events"

    def streamWriter(self, schema, overwrite: bool) -> EventWriter:
        if "path" not in self.options:
            raise ValueError("service_events needs a path")
        missing = {"id", "seq", "event", "data"} - set(schema.names)
        if missing:
            raise ValueError(f"events without {sorted(missing)}")
        return EventWriter(self.options["path"])


def start(events: DataFrame, folder: str, checkpoint: str, **trigger):
    """Streams events (id, seq, event, data) into the folder."""
    events.sparkSession.dataSource.register(EventSink)
    rows = events.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("int").alias("seq"), "event", "data")
    return rows.writeStream.format("service_events").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def epochs(folder: str) -> list[dict]:
    names = sorted(n for n in os.listdir(f"{folder}/{EPOCHS}") if n.endswith(".json") and n[:DIGITS].isdigit())
    out = []
    for n in names:
        with open(f"{folder}/{EPOCHS}/{n}", encoding="utf-8") as f:
            out.append(json.load(f))
    return out


def read(spark: SparkSession, folder: str, after: int = -1) -> DataFrame:
    """Events of all epochs after one, each once."""
    names = [f"file://{os.path.abspath(folder)}/{FILES}/{n}" for e in epochs(folder) if e["epoch"] > after for n in e["files"]]
    return spark.read.schema(EVENT).json(names) if names else spark.createDataFrame([], EVENT)


def lines(events: DataFrame) -> DataFrame:
    """id, seq, line: each event as the service sends it."""
    return events.select("id", "seq", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n")).alias("line"))
