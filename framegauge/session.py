"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Checkpoints go when the frames that use them do.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, app: str = "framegauge", **conf: str) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SESSION_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the context's checkpoint folder or the session's
    ``spark.checkpoint.dir``.

    Only where both are unset and all runs in one process (tests, a laptop) is a local
    folder made and set; a cluster has to name one.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="framegauge-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Write ``df`` to the shared folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Folders that ``written`` has made, by application.
_scratch: dict[str, list[str]] = {}


def written(df, label: str):
    """Like ``checkpointed``, as Parquet: smaller on disk and read by column.

    Spark removes checkpoints with the frames that use them; what is written here
    stays until ``clear_scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


def scratch_mark(spark: SparkSession) -> int:
    """How many folders ``written`` has left so far."""
    return len(_scratch.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, since: int = 0, more: list[str] = ()) -> None:
    """Remove what ``written`` has left since ``since`` (``scratch_mark``), and the folders ``more``.

    For callers that have written their result: frames that are still to be read lose
    their input.
    """
    left = _scratch.get(spark.sparkContext.applicationId, [])
    for path in [*left[since:], *more]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del left[since:]
