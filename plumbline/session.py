"""Session helpers shared by the registered queries, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Moves pandas frames to and from the driver in columnar batches.
ARROW = "spark.sql.execution.arrow.pyspark.enabled"


def local_session(cpus: int | str = "*", app: str = "plumbline", **conf: str) -> SparkSession:
    """A `local[cpus]` session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder of the session, which every executor can reach.

    It is named by `spark.checkpoint.dir`, or was given to the context.
    """
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh directory name under the shared folder.

    Every executor must see the same files, so a machine-local folder is used
    only by a local master that has no shared folder configured.
    """
    base = shared_folder(spark)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Set one runtime option for the duration of a block."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet under the shared folder and read back: it is never computed again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a small derived frame that is used several times.

    Only where the session names a checkpoint folder; otherwise the frame comes
    back as it is and is recomputed per use.
    """
    has_folder = shared_folder(df.sparkSession) is not None
    return df.checkpoint() if has_folder and not df.isStreaming else df
