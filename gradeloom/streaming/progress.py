"""Progress of evaluations as a stream, with the batch view of the same table.

An evaluation has one life: its events up to the first final one. A pause longer than ``idle`` ends what a
listener sees, and the next event begins another episode. Who listens after the end is told the final
state once more. The stream keeps a few values an evaluation and a timer; the batch form uses windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "evaluation_id string, kind string, ts timestamp, detail string"
FINAL = ("completada", "error")
#: The kind of a row that stands for a listener, not for an event.
LISTEN = "escuchar"
IDLE_SECONDS = 300
LOG = "evaluation_id string, status string, kind string, detail string, ts timestamp, episode int, seq int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_status(events: DataFrame, key: str = "evaluation_id", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """Latest event of each evaluation and how many there were; works on a stream in complete or update mode."""
    return events.groupBy(key).agg(F.max_by(kind, ts).alias("last_kind"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))


def counts_by_window(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind and tumbling window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n"))


def progress_log(events: DataFrame, final: tuple[str, ...] = FINAL, idle: int = IDLE_SECONDS, until: str | None = None) -> DataFrame:
    """What listeners see of all evaluations, in columns LOG, from a finished table of EVENTS.

    status is event, idle (nothing came for ``idle`` seconds; ts is when that was known) or replay (the final
    state, to a row of kind LISTEN after the end). seq counts an evaluation's events from 1, episode from 0.
    Events of one instant come in order of kind and detail; those after the final one are left out. Evaluations that
    are silent for ``idle`` seconds before ``until``, if given, end with an idle row. A null ts or id is left out.
    """
    rows = events.where("evaluation_id is not null and ts is not null")
    order = Window.partitionBy("evaluation_id").orderBy("ts", "kind", "detail")
    own = rows.where(F.coalesce("kind", F.lit("")) != LISTEN)
    ended = F.sum(F.coalesce(F.col("kind").isin(*final), F.lit(False)).cast("int"))
    alive = own.withColumn("_ends", F.coalesce(ended.over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_ends = 0").drop("_ends")
    pause = F.make_interval(secs=F.lit(idle))
    placed = alive.withColumn("_before", F.lag("ts").over(order))
    placed = placed.withColumns({"_gap": F.coalesce(F.col("ts") > F.col("_before") + pause, F.lit(False)), "seq": F.row_number().over(order)})
    placed = placed.withColumn("episode", F.sum(F.col("_gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    none = F.lit(None).cast("string")
    seen = placed.select("evaluation_id", F.lit("event").alias("status"), "kind", "detail", "ts", "episode", "seq")
    silent = placed.where("_gap").select("evaluation_id", F.lit("idle").alias("status"), none.alias("kind"), none.alias("detail"), (F.col("_before") + pause).alias("ts"), (F.col("episode") - 1).alias("episode"), (F.col("seq") - 1).alias("seq"))
    last = placed.groupBy("evaluation_id").agg(F.max_by(F.struct("kind", "detail", "ts", "episode", "seq"), "seq").alias("_l")).select("evaluation_id", "_l.*")
    over = F.coalesce(F.col("kind").isin(*final), F.lit(False))
    asked = rows.where(F.col("kind") == LISTEN).select("evaluation_id", F.col("ts").alias("_asked"))
    told = asked.join(last.where(over), "evaluation_id").where("_asked > ts").select("evaluation_id", F.lit("replay").alias("status"), "kind", "detail", F.col("_asked").alias("ts"), "episode", "seq")
    out = seen.unionByName(silent).unionByName(told)
    if until is not None:
        open_ = last.where(~over & (F.col("ts") + pause < F.lit(until).cast("timestamp")))
        out = out.unionByName(open_.select("evaluation_id", F.lit("idle").alias("status"), none.alias("kind"), none.alias("detail"), (F.col("ts") + pause).alias("ts"), "episode", "seq"))
    return out


class _Listener(StatefulProcessor):
    """One evaluation: its number of events and episodes, the last instant, and the final state once it is there."""

    def __init__(self, final: tuple[str, ...], idle: int):
        self.final, self.idle = final, timedelta(seconds=idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "seq int, episode int, last timestamp, open boolean, quiet boolean, kind string, detail string")

    def _rest(self, at: datetime | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(int((at + self.idle).replace(tzinfo=timezone.utc).timestamp() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name, found = key[0], []
        seq, episode, last, live, quiet, kind, detail = self.state.get() if self.state.exists() else (0, 0, None, True, False, None, None)
        coming = pd.concat(list(rows)).sort_values(["ts", "kind", "detail"], kind="stable", na_position="first")
        for row in coming.itertuples():
            what, more = (None if pd.isna(v) else v for v in (row.kind, row.detail))
            at = row.ts.to_pydatetime()
            if what == LISTEN:
                if not live:
                    found.append((name, "replay", kind, detail, at, episode, seq))
                continue
            if not live:
                continue
            if last is not None and at > last + self.idle:
                if not quiet:
                    found.append((name, "idle", None, None, last + self.idle, episode, seq))
                episode += 1
            seq, last, quiet = seq + 1, at, False
            found.append((name, "event", what, more, at, episode, seq))
            if what in self.final:
                live, kind, detail = False, what, more
        self.state.update((seq, episode, last, live, quiet, kind, detail))
        self._rest(last if live and not quiet else None)
        yield _log(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, episode, last, live, quiet, kind, detail = self.state.get()
        found = [(key[0], "idle", None, None, last + self.idle, episode, seq)] if live and not quiet else []
        self.state.update((seq, episode, last, live, True, kind, detail))
        yield _log(found)

    def close(self) -> None:
        pass


def _log(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])
    return out.astype({"ts": "datetime64[us]", "episode": "int32", "seq": "int32"})


def progress_stream(events: DataFrame, final: tuple[str, ...] = FINAL, idle: int = IDLE_SECONDS, late: str = "10 seconds") -> DataFrame:
    """``progress_log`` over a stream of EVENTS, in append mode.

    An idle row comes when the watermark (the newest ts less ``late``) has passed the last event by ``idle`` seconds, or
    with the event that shows it. Rows older than the watermark are left out. State: a row an evaluation, in RocksDB.
    The session's time zone is UTC, as state and rows pass timestamps without one.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    known = events.where("evaluation_id is not null and ts is not null").withWatermark("ts", late)
    return known.groupBy("evaluation_id").transformWithStateInPandas(statefulProcessor=_Listener(final, idle), outputStructType=LOG, outputMode="append", timeMode="EventTime")


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Events from a folder of Parquet files; ``files`` at most in one micro-batch."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run_available(stream: DataFrame, table: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now, into a table in memory: for tests and small reports."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def append_available(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, added to a folder; ``checkpoint`` (in a shared folder) lets a later call go on where this one ended."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
