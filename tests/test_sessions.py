"""Event-time runs of a stream: late rows, repeated files, and equality with a batch."""

from __future__ import annotations

import datetime as dt

import pytest

from spectraloom.streaming import scoring, sessions

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"
DAY = dt.datetime(2024, 3, 1)


def at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture
def stream(spark, tmp_path):
    """Deliver files one after the other; returns the closed runs and the number of late rows."""
    arrivals = iter(range(100))

    def deliver(rows):
        path = str(tmp_path / "in" / f"{next(arrivals)}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        raw = scoring.arriving(spark, str(tmp_path / "in" / "*"), SCHEMA)
        found = sessions.runs(raw, "user_id", "event_id", "ts", "value", gap="2 hours", delay="4 hours")
        query = scoring.start(found, str(tmp_path / "out"), str(tmp_path / "log"))
        query.awaitTermination()
        return sessions.late_rows(query)

    def closed():
        return sorted(
            (r.user_id, (r.started.replace(tzinfo=None) - DAY).total_seconds() / 3600, r.readings, r.total, r.peak)
            for r in spark.read.parquet(str(tmp_path / "out")).collect()
        )

    deliver.closed = closed
    return deliver


def test_runs_close_behind_the_watermark(stream):
    stream([(1, at(0), 7, 1.0), (2, at(1), 7, 2.0), (3, at(5), 7, 4.0), (4, at(5.5), 8, None), (5, None, 7, 9.0), (6, at(5), None, 9.0)])
    assert stream.closed() == []  # the latest reading, less the delay, is at 1.5
    stream([(7, at(10), 7, 8.0)])
    assert stream.closed() == [(7, 0.0, 2, 3.0, 2.0)]
    stream([(8, at(30), 9, 1.0)])
    assert stream.closed() == [(7, 0.0, 2, 3.0, 2.0), (7, 5.0, 1, 4.0, 4.0), (7, 10.0, 1, 8.0, 8.0), (8, 5.5, 1, None, None)]


def test_out_of_order_rows_join_their_run(stream):
    stream([(1, at(0), 7, 1.0), (2, at(3), 7, 4.0)])
    stream([(3, at(1.5), 7, 2.0)])  # bridges the two
    stream([(4, at(20), 8, 1.0)])
    assert stream.closed() == [(7, 0.0, 3, 7.0, 4.0)]


def test_late_rows_are_counted_and_change_nothing(stream):
    stream([(1, at(0), 7, 1.0), (2, at(20), 8, 1.0)])
    before = stream.closed()
    assert before == [(7, 0.0, 1, 1.0, 1.0)]
    assert stream([(3, at(0.5), 7, 5.0), (4, at(21), 8, 1.0)]) == 1
    stream([(5, at(40), 9, 1.0)])
    assert stream.closed() == [*before, (8, 20.0, 2, 2.0, 1.0)]


def test_a_repeated_file_counts_once(stream):
    rows = [(1, at(0), 7, 1.0), (2, at(1), 7, 2.0)]
    stream(rows)
    stream(rows)
    stream([(3, at(20), 8, 1.0)])
    assert stream.closed() == [(7, 0.0, 2, 3.0, 2.0)]
