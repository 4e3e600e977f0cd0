"""Live ingestion: files of events to a journal, with dedup, per-session sequence numbers and the tool loop.

Order is arrival; there is no event-time semantics in the journal. A watermark on ``ts`` only bounds the
dedup state: a replay that comes later than the delay is numbered again, so the delay is the replay
horizon. The sequence allocator and the tool loop keep a small state for each session in the state
store, which survives lost executors through its checkpoint.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import ToolLoop


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Event files as they come. ``ts`` becomes a timestamp, which watermarks need."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: list[str], delay: str = "1 day") -> DataFrame:
    """Replays within the delay are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


class Allocator(StatefulProcessor):
    """Dense sequence numbers for each session, in order of ts and id within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        n = self.mark.get()[0] if self.mark.exists() else 0
        self.mark.update((n + len(batch),))
        yield pd.DataFrame({"session": [key[0]] * len(batch), "event_id": batch["event_id"].to_numpy(), "sequence": range(n + 1, n + 1 + len(batch))})

    def close(self) -> None:
        pass


def allocate(events: DataFrame) -> DataFrame:
    """(session, event_id, sequence) of (session, event_id, ts)."""
    rows = events.select("session", "event_id", "ts")
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=Allocator(), outputStructType="session long, event_id long, sequence long", outputMode="append", timeMode="none")


class LoopTracker(StatefulProcessor):
    """The tool loop of each session across batches; a row for each unit that closes, and one when it becomes invalid."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("loop", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        loop = ToolLoop()
        if self.saved.exists():
            d = json.loads(self.saved.get()[0])
            loop = ToolLoop(d["state"], d["last"], d["opened"], Counter({(t, a): n for t, a, n in d["pending"]}))
        out = []
        for r in pd.concat(list(rows)).sort_values("sequence", kind="stable").itertuples():
            before = loop.state
            unit = loop.step(int(r.sequence), r.event_type, r.content)
            if unit:
                out.append((key[0], *unit, "unit"))
            elif loop.state == "invalid" and before != "invalid":
                out.append((key[0], int(r.sequence), int(r.sequence), "invalid"))
        self.saved.update((json.dumps({"state": loop.state, "last": loop.last, "opened": loop.opened, "pending": [[t, a, n] for (t, a), n in loop.pending.items()]}),))
        yield pd.DataFrame(out, columns=["session", "start", "end", "kind"]).astype({"session": "int64", "start": "int64", "end": "int64"})

    def close(self) -> None:
        pass


def track_tools(events: DataFrame) -> DataFrame:
    """(session, start, end, kind) of (session, sequence, event_type, content)."""
    rows = events.select("session", "sequence", "event_type", "content")
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=LoopTracker(), outputStructType="session long, start long, end long, kind string", outputMode="append", timeMode="none")


def coalesce_intents(batch: DataFrame) -> DataFrame:
    """The largest target of each session in a micro-batch: what a trigger queue boils down to."""
    return batch.groupBy("session").agg(F.max("target").alias("target"))


def run_once(stream: DataFrame, table: str, checkpoint: str) -> None:
    """All that is there now, into an in-memory table."""
    q = stream.writeStream.format("memory").queryName(table).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
