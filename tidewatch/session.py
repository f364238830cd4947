"""Session settings shared by the library, its tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def with_tasks(module: str) -> None:
    """Send the functions of a module along with the tasks that call them, so that
    executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def local_session(cpus: int | str = 8, app: str = "tidewatch", **extra: str) -> SparkSession:
    """A local[n] session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Event times are stored without a zone and always mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of its own, removed at exit; a
    cluster has to name one that all executors share.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


# Tables written by this process and not dropped yet.
_written: list[str | None] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written table.

    A Parquet table cuts the lineage like a checkpoint does, survives lost executors,
    and lets each later pass read only the columns it needs. :func:`drop_checkpoints`
    removes the tables.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """Tables written so far: a mark for :func:`drop_checkpoints`."""
    return len(_written)


def drop_checkpoints(spark: SparkSession, keep: int = 0, until: int | None = None) -> int:
    """Remove the tables this process has written after the first ``keep``; their number.

    Call it when the results that read them are written. With ``until``, a later mark, tables
    written after that stay."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = [path for path in _written[keep:until] if path is not None]
    for path in dropped:
        place = hadoop(path)
        place.getFileSystem(conf).delete(place, True)
    # Marks are places in the list, so a dropped table leaves its place empty.
    _written[keep:until] = [None] * len(_written[keep:until])
    return len(dropped)
