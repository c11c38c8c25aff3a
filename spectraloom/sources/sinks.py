"""Result sinks: every table of an analysis bundle as CSV, manifests as JSON, reports as text.

Row-sized tables are written by Spark as folders of part files; axis- or trial-sized tables
that already live on the driver go through the same writer in one part.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spectra import ID, Y, Spectra


def result_dir(dataset_path: str, suffix: str = "_results") -> str:
    """Folder beside the data set: ``/data/run1.csv`` -> ``/data/run1_results``."""
    stem = dataset_path.rstrip("/")
    name = stem.rsplit("/", 1)[-1]
    return stem[: -len(name)] + name.rsplit(".", 1)[0] + suffix


def _csv_ready(df: DataFrame) -> DataFrame:
    """CSV has no nested types: they are written as JSON text."""
    nested = ("array", "struct", "map")
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_table(spark: SparkSession, table, path: str) -> None:
    """Write a Spark or driver-side table as headed CSV."""
    if table is None:
        return
    if isinstance(table, pd.DataFrame):
        if not len(table.columns):
            return
        text = table.astype(object).where(table.notna(), None)
        schema = ", ".join(f"`{c}` string" for c in table.columns)
        rows = [[None if v is None else str(v) for v in r] for r in text.itertuples(index=False)]
        table = spark.createDataFrame(rows, schema).coalesce(1)
    _csv_ready(table).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option(
        "lineSep", "\n"
    ).text(path)


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    write_text(spark, json.dumps(payload, indent=2, default=str), path)


def wide_scores(scores: DataFrame, components: int, meta: tuple[str, ...] = ()) -> DataFrame:
    """Metadata plus one ``PC<i>`` column per component."""
    return scores.select(
        ID, *meta, *[F.get("scores", F.lit(i)).alias(f"PC{i + 1}") for i in range(components)]
    )


def write_spectra(spectra: Spectra, path: str) -> None:
    """Header-layout CSV: metadata columns, then one column per axis point."""
    cells = [F.get(Y, F.lit(i)).alias(repr(float(w))) for i, w in enumerate(spectra.axis)]
    spectra.df.select(ID, *spectra.meta, *cells).write.mode("overwrite").option("header", True).csv(path)
