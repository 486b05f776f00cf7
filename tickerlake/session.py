"""Session helpers: one place that knows about settings and work folders."""

from __future__ import annotations

import atexit
import functools
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when a query ends; otherwise they stay until the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, partitions: int = 8, app: str = "tickerlake") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started from (once for each context)."""
    context = spark.sparkContext
    if getattr(context, "_tickerlake_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="tickerlake-")) / "tickerlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted([*root.rglob("*.py"), *root.rglob("*.json")]):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._tickerlake_shipped = True


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared location that ``spark.checkpoint.dir`` names.

    Only a local master may do without the setting: its one machine then uses a temporary folder, which goes when
    the process ends.  Elsewhere executors would not see each other's files, so a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
        base = _own_folder()
    return f"{base.rstrip('/')}/tickerlake/{label}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tickerlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and go on from the written table.

    Used where several branches follow from one costly frame: they then scan the
    written columns instead of repeating the work, and a lost executor costs only
    the reading of its files.  What was shuffled for it is removed once it is written.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
