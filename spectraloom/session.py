"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Independent loops of small jobs that run side by side.
AT_ONCE = 4


def build_session(master: str | None = None, app_name: str = "spectraloom", **conf) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as ``spark.checkpoint.dir`` names it.

    Only a local session, where driver and executors are one process, may go without: it gets
    a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        _scratch[application] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _scratch[application]


_scratch: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoint into the shared folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in reliable storage, so lost executors do not replay its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: smaller than a checkpoint,
    and what follows it replays nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], object]]) -> list:
    """What the tasks return, in their order; the jobs of ``AT_ONCE`` of them share the cores.

    For loops of many short jobs that don't need each other's results.
    """
    ensure_checkpoint_dir(spark)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, as ``--py-files`` would."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "spectraloom_package")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "spectraloom"))
    _shipped.add(application)


_shipped: set[str] = set()
