"""Progress as a stream of several micro-batches with a restart, against the batch table and a plain walk."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeloom.streaming import progress

START = datetime(2026, 1, 1)


def plain_log(rows, idle=300, until=None):
    out, by = [], {}
    for r in rows:
        if r[0] is not None and r[2] is not None:
            by.setdefault(r[0], []).append(r)
    pause = timedelta(seconds=idle)
    for name, own in by.items():
        seq, episode, last, final = 0, 0, None, None
        for _, kind, ts, detail in sorted(own, key=lambda r: (r[2], r[1] or "", r[3] or "")):
            if kind == progress.LISTEN:
                if final and ts > last:
                    out.append((name, "replay", *final, ts, episode, seq))
            elif final is None:
                if last is not None and ts - last > pause:
                    out.append((name, "idle", None, None, last + pause, episode, seq))
                    episode += 1
                seq, last = seq + 1, ts
                out.append((name, "event", kind, detail, ts, episode, seq))
                final = (kind, detail) if kind in progress.FINAL else None
        if until and last and final is None and last + pause < until:
            out.append((name, "idle", None, None, last + pause, episode, seq))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def events():
    rng, rows = random.Random(6), []
    for e in range(25):
        at = START + timedelta(seconds=rng.randrange(600))
        for k in range(rng.randrange(1, 9)):
            at += timedelta(seconds=rng.choice([1, 20, 299, 300, 301, 900]))
            rows.append((f"e{e}", rng.choice(["fase", "juez", "fase", None]), at, f"d{k}" if rng.random() < 0.8 else None))
        if rng.random() < 0.6:
            rows.append((f"e{e}", rng.choice(progress.FINAL), at + timedelta(seconds=5), "end"))
            rows.append((f"e{e}", "fase", at + timedelta(seconds=9), "too late"))
        rows.append((f"e{e}", progress.LISTEN, at + timedelta(seconds=rng.choice([2, 60])), None))
    rows.append(("e0", progress.LISTEN, START, None))
    return sorted(rows, key=lambda r: (r[2], r[0]))


def as_rows(df):
    return sorted(((r.evaluation_id, r.status, r.kind, r.detail, r.ts, r.episode, r.seq) for r in df.collect()), key=str)


def test_batch_against_a_plain_walk(spark, events):
    rows = [*events, (None, "fase", START, None), ("x", "fase", None, None)]
    df = spark.createDataFrame(rows, progress.EVENTS).repartition(3)
    assert as_rows(progress.progress_log(df)) == plain_log(events)
    until = events[-1][2] - timedelta(seconds=10)
    assert as_rows(progress.progress_log(df, until=str(until))) == plain_log(events, until=until)
    assert progress.progress_log(df.limit(0)).count() == 0


def test_stream_with_a_restart_gives_the_batch_table(spark, events, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    cuts = [0, len(events) // 5, len(events) // 3, len(events) // 2, len(events)]

    def arrive(parts):
        for lo, hi in parts:
            spark.createDataFrame(events[lo:hi], progress.EVENTS).coalesce(1).write.mode("append").parquet(source)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        pieces = list(zip(cuts, cuts[1:], strict=False))
        for part in (pieces[:2], pieces[2:]):
            arrive(part)
            stream = progress.progress_stream(progress.read_stream(spark, source, files=1))
            got = progress.append_available(stream, out, checkpoint)
        until = events[-1][2] - timedelta(seconds=10)
        assert as_rows(got) == plain_log(events, until=until)
        assert {"event", "idle", "replay"} == {r.status for r in got.select("status").distinct().collect()}
        assert as_rows(progress.append_available(progress.progress_stream(progress.read_stream(spark, source, files=1)), out, checkpoint)) == as_rows(got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_counts_over_a_stream(spark, events, tmp_path):
    spark.createDataFrame(events, progress.EVENTS).repartition(2).write.parquet(f"{tmp_path}/in")
    stream = progress.read_stream(spark, f"{tmp_path}/in", files=1)
    status = progress.run_available(progress.last_status(stream), "progress_status")
    assert {r.evaluation_id: r.events for r in status.collect()} == {e: sum(r[0] == e for r in events) for e in {r[0] for r in events}}
    windows = progress.run_available(progress.counts_by_window(stream), "progress_windows")
    assert windows.agg(F.sum("n")).first()[0] == len(events)
