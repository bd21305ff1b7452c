"""Session helpers: a local session for tests and benches, and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with UTC times; a cluster brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``.

    Only a local session may leave it unset, as tests do; it then gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(_CHECKPOINT_KEY, None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The plain path of a folder on a local or mounted store, and null on any other store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return where.getPath() if where.getScheme() == "file" else None


def task_count(spark: SparkSession) -> int:
    """A number of tasks for work that Spark would take for small, as it goes by bytes."""
    return max(64, 4 * spark.sparkContext.defaultParallelism)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy.

    The copy survives the loss of executors, unlike block-manager copies.  Callers select
    the few columns they need first, as a checkpoint is read whole.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
