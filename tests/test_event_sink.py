"""The event sink: whole epochs, and an epoch that runs again writes nothing twice."""

import json
import os

import pytest

from stylarium.operators import agent
from stylarium.streaming import event_sink

SCHEMA = "id string, output string, error string, trace array<string>, rounds array<struct<round:int,output:string>>"


def test_a_replayed_epoch_is_written_once(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "events", "check"))
    os.mkdir(source)

    def add(name, ids):
        with open(f"{source}/{name}.json", "w") as f:
            for i in ids:
                f.write(json.dumps({"id": str(i), "output": "word " * 20, "error": "x" if i % 4 == 0 else None, "trace": ["n"], "rounds": [{"round": 1, "output": "word " * 20}]}) + "\n")

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        query = event_sink.start(agent.service_events(rows, "id"), folder, checkpoint)
        assert query.awaitTermination(90) and query.exception() is None

    add("a", range(5))
    add("b", range(5, 9))
    run()
    want = sorted(map(tuple, agent.service_events(spark.read.schema(SCHEMA).json(source), "id").collect()))
    assert sorted(map(tuple, event_sink.read(spark, folder).collect())) == want and [e["epoch"] for e in event_sink.epochs(folder)] == [0, 1]
    files = set(os.listdir(f"{folder}/files"))
    # The driver is lost after the manifest and before the query's own log: the epoch runs again.
    for name in ("1", ".1.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert sorted(map(tuple, event_sink.read(spark, folder).collect())) == want and set(os.listdir(f"{folder}/files")) == files
    # It goes on from there; readers may ask for later epochs alone.
    add("c", [20])
    run()
    later = event_sink.read(spark, folder, after=1).collect()
    assert {r["id"] for r in later} == {"20"} and event_sink.read(spark, folder).count() == len(want) + len(later)
    assert not [n for n in os.listdir(f"{folder}/epochs") if n.startswith(".")]
    line = event_sink.lines(event_sink.read(spark, folder)).where("id = '20'").orderBy("seq").first()["line"]
    assert line == "event: trace\ndata: n\n\n"


def test_what_is_refused(spark, tmp_path):
    writer = event_sink.EventWriter(str(tmp_path / "x"))
    done = writer.write(iter([{"id": "1", "seq": 0, "event": "e", "data": "d"}]))
    writer.abort([done, None], 0)
    assert os.listdir(tmp_path / "x/files") == [] and event_sink.epochs(str(tmp_path / "x")) == []
    with pytest.raises(ValueError, match="path"):
        event_sink.EventSink({}).streamWriter(spark.createDataFrame([], event_sink.EVENT).schema, False)
