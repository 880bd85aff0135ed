"""The live side: an append-only event log fed by a stream, and versions of the state built from it.

A micro-batch is appended to the log with its batch number, so a replayed batch overwrites itself; the state of any block
is :func:`ledgerframe.operators.overlay.current_state` over base and log. Readers see the version that the pointer
names; a compaction publishes the next base and the block it covers, and keeps the later events as the new overlay. The newest
block stays out of it, as more of its events may come. A rollback writes the events that stand to a new generation of the log
and makes it, and a base not after the block, current by one pointer; older bases and generations stay for readers of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlay
from ..sources.sinks import VersionedTable

EVENTS = "asset_id long, block long, pos long, op string, owner string, data string, template long"


class LiveStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base_table = VersionedTable(spark, f"{self.root}/base")

    def start(self, stream: DataFrame, checkpoint: str | None = None):
        """Feeds a stream of events into the log; restarts resume at the checkpoint."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint or f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def _now(self) -> dict:
        return self.base_table.current() or {}

    def _log_path(self, now: dict) -> str:
        return f"{self.root}/{now.get('log', 'log')}"

    def append(self, batch: DataFrame, number: int) -> None:
        batch.select([c.split()[0] for c in EVENTS.split(", ")]).write.mode("overwrite").parquet(f"{self._log_path(self._now())}/batch={number}")

    def log(self, after: int | None = None, upto: int | None = None, now: dict | None = None) -> DataFrame:
        """Events of the log, by default those after the block that the base covers."""
        now = self._now() if now is None else now
        if after is None:
            after = now.get("block", -1)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._log_path(now))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            df = self.spark.createDataFrame([], EVENTS)
        else:
            df = self.spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(self._log_path(now))
        df = df.filter(F.col("block") > after)
        return df if upto is None else df.filter(F.col("block") <= upto)

    def _base_note(self, upto: int | None = None) -> dict:
        """The current note, with the newest base of this generation of the log that is not after ``upto``; without one there is
        no base."""
        now = self._now()
        if upto is None or now.get("block", -1) <= upto:
            return now
        for note in self.base_table.history():
            if note.get("log") != now.get("log"):
                break
            if note.get("block", -1) <= upto:
                return note
        return {"log": now["log"]} if "log" in now else {}

    def base(self, upto: int | None = None) -> DataFrame | None:
        path = self._base_note(upto).get("path")
        return self.spark.read.parquet(path) if path else None

    def state(self, upto: int | None = None) -> DataFrame:
        """The state now, or as of a block: a fork is rolled back by reading up to the last common block, from a base not
        after it."""
        note = self._base_note(upto)
        events = self.log(upto=upto, now=note)
        if note.get("burned"):
            events = events.join(self.spark.read.parquet(note["burned"]), "asset_id", "left_anti")
        return overlay.current_state(events, self.spark.read.parquet(note["path"]) if note.get("path") else None)

    def rollback(self, block: int) -> None:
        """Events after ``block`` are void from now on; later appends of the same blocks stand."""
        note = self._base_note(block)
        fresh = f"log-{uuid.uuid4().hex}"
        self.log(after=-1, upto=block).write.parquet(f"{self.root}/{fresh}/batch=-1")
        self.base_table.point({**note, "log": fresh})

    def pending(self) -> int:
        return self.log().count()

    def compact(self, at_least: int = 0) -> bool:
        """Publishes base and overlay as the next base if the overlay has ``at_least`` events of blocks before its newest, which may
        not be complete. Burned ids are kept beside it, so that a burn stays final; later events stay in the overlay."""
        now = self._now()
        events = self.log(now=now)
        newest = events.agg(F.max("block")).first()[0]
        if newest is None:
            return False
        events = events.filter(F.col("block") < newest)
        n, covered = events.agg(F.count("*"), F.max("block")).first()
        if not n or n < at_least:
            return False
        dead = events.filter("op = 'burn'").select("asset_id")
        if now.get("burned"):
            old = self.spark.read.parquet(now["burned"])
            events, dead = events.join(old, "asset_id", "left_anti"), dead.union(old)
        burned = f"{self.root}/burned-{uuid.uuid4().hex}"
        dead.distinct().write.parquet(burned)
        notes = {"block": covered, "burned": burned} | ({"log": now["log"]} if "log" in now else {})
        base = self.spark.read.parquet(now["path"]) if now.get("path") else None
        self.base_table.publish(overlay.compact(events, base).drop("ordinal"), **notes)
        return True

    def counts(self) -> DataFrame:
        from ..operators.lookups import unpivot_counts

        return unpivot_counts(self.state(), {"owner": F.col("owner"), "data": F.col("data"), "template": F.col("template")})


def asset_state_stream(events: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """The same rules as a stateful stream: for each changed asset its state after the batch (asset_id, owner, data, template,
    block, live). State is one small record an asset; a tomb keeps only its mark."""
    import pandas as pd

    def step(key, frames, state):
        owner, data, template, block, mark = state.get if state.exists else (None, None, None, None, 0)
        for f in frames:
            for e in f.sort_values(["block", "pos"]).itertuples():
                if mark == 2:
                    break
                if e.op == "burn":
                    owner, data, template, block, mark = None, None, None, e.block, 2
                elif e.op == "mint" and mark == 0:
                    owner, data, template, block, mark = e.owner, e.data, None if pd.isna(e.template) else int(e.template), e.block, 1
                elif e.op == "transfer" and mark == 1 and e.owner != owner:
                    owner, block = e.owner, e.block
                elif e.op == "setdata" and mark == 1:
                    data = e.data
        state.update((owner, data, template, None if block is None else int(block), mark))
        if mark:
            yield pd.DataFrame({"asset_id": [key[0]], "owner": [owner], "data": [data], "template": pd.array([template], dtype="Int64"), "block": pd.array([block], dtype="Int64"), "live": [mark == 1]})

    kind = "owner string, data string, template long, block long"
    return events.groupBy("asset_id").applyInPandasWithState(step, f"asset_id long, {kind}, live boolean", f"{kind}, mark int", "update", timeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An addition for time-stamped streams: counts by event-time window, with late rows dropped beyond the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
