"""Runs of an instrument as event-time sessions of a stream.

Readings of one key belong to one run while the next follows within ``gap``.  The state per key
is its open runs and the ids of rows seen since the watermark; a run is written once, when
the watermark, the latest event time less ``delay``, has passed its end.  Rows that come
again within the delay (a file delivered twice) count once.  Rows behind the watermark are
dropped and counted in the query's progress; ``late_rows`` adds them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def runs(
    rows: DataFrame, key: str, row_id: str, time: str, value: str, gap: str = "6 hours", delay: str = "12 hours"
) -> DataFrame:
    """``(key, started, ended, readings, total, peak)`` per closed run; null keys and times are left out."""
    timed = rows.select(key, row_id, F.col(time).cast("timestamp").alias("at"), F.col(value).cast("double").alias("reading"))
    fresh = (
        timed.filter(F.col(key).isNotNull() & F.col("at").isNotNull())
        .withWatermark("at", delay)
        .dropDuplicatesWithinWatermark([row_id])
    )
    found = fresh.groupBy(key, F.session_window("at", gap).alias("run")).agg(
        F.count(F.lit(1)).alias("readings"), F.sum("reading").alias("total"), F.max("reading").alias("peak")
    )
    # the window ends one gap after the last reading
    return found.select(
        key, F.col("run.start").alias("started"), (F.col("run.end") - F.expr(f"INTERVAL {gap}")).alias("ended"),
        "readings", "total", "peak",
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's kept progress reports as behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
