"""Score newly arriving spectra against a frozen model.

Every stage of a fitted recipe and PCA model is a narrow column function, so the same code
that scores a table scores a stream: no state, no watermark, exactly-once through the file
sink's own log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pca import Diagnostics, PcaModel
from ..spectra import ID, Spectra


def arriving(spark: SparkSession, path: str, schema, files_per_trigger: int = 1_000) -> DataFrame:
    """New parquet files of a folder (or glob) as a stream of raw rows."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def flagged(model: PcaModel, limits: Diagnostics, spectra: Spectra) -> DataFrame:
    """T2 / Q of each arriving sample with the limits of the reference set."""
    scored = model.scored(spectra).drop("scores")
    return scored.withColumns(
        {
            "T2_flag": F.col("Hotelling_T2") > limits.t2_limit,
            "Q_flag": F.col("Q_residual") > limits.q_limit,
        }
    ).select(ID, "Hotelling_T2", "Q_residual", "T2_flag", "Q_flag", (F.col("T2_flag") | F.col("Q_flag")).alias("review_flag"))


def start(scored: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scored rows to a parquet folder."""
    writer = scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
