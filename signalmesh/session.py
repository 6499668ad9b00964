"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import SparkSession

#: Paths of the tables written since :func:`only_result` began, if it has.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Rows of a batch between the JVM and Python at most: whole texts and shingle sets are long rows.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "signalmesh") -> SparkSession:
    """Local-mode session with the settings the library assumes (UTC, AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # text stages are CPU-bound: do not merge small shuffle outputs into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", os.environ.get("SIGNALMESH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Session settings the operators rely on; safe to call on any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # plan strings are rebuilt on every adaptive re-plan; the redaction and
    # theme patterns make them long, so cap their size (debug output only)
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only in local mode, when it is unset (tests), a fresh folder is made; on a
    cluster an unset folder is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local_dir = tempfile.mkdtemp(prefix="signalmesh-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def tables_folder(spark: SparkSession) -> str:
    """Where written tables lie, in the reliable checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables"


def materialize(df, name: str):
    """Write ``df`` under the reliable checkpoint folder and read it back.

    The result is a plain file scan: lineage is cut (an executor loss re-reads
    the files) and later plans built on it stay shallow.
    """
    import uuid

    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE.get() is not None:
        _MADE.get().append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they need not have it installed.

    Also keeps the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, as both sides hold a batch whole.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)


@contextmanager
def sparing_disk(spark: SparkSession):
    """Queries run inside delete their shuffle files when they end, not when the driver next collects garbage, and write zstd.

    For steps that each write their result, so that no later one reads an earlier one's shuffle.
    """
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def only_result(spark: SparkSession, build, name: str):
    """The written result of ``build()``, whose tables written on the way are deleted then; nothing else may read them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        out = build()
        made_on_the_way = list(made)
        out = materialize(out, name)
    finally:
        _MADE.reset(token)
    for path in made_on_the_way:
        remove(spark, path)
    if _MADE.get() is not None:  # a result is on the way to another one
        _MADE.get().append(made[-1])
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a job has written and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df) -> None:
    """Delete the written tables that ``df`` reads (those in :func:`tables_folder`); other files it reads are left alone.

    ``df`` and what was made of it cannot be read afterwards.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    own = path(tables_folder(spark)).toUri().getPath() + "/"
    files = [path(f).toUri().getPath() for f in df.inputFiles()]
    for name in {f[len(own):].split("/")[0] for f in files if f.startswith(own)}:
        remove(spark, f"{tables_folder(spark)}/{name}")


def attach_row(df, one_row):
    """Attach the columns of a single-row frame to every row of ``df``.

    A broadcast equi-join on a constant key; only for ``one_row`` frames that
    are global aggregates (exactly one row by construction).
    """
    from pyspark.sql import functions as F

    return df.withColumn("__one", F.lit(0)).join(F.broadcast(one_row.withColumn("__one", F.lit(0))), "__one").drop(
        "__one")
