"""Shared-storage helpers: where intermediate tables go and how a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# The shuffles of a write go when it has ended, not when the driver's collector finds that nothing names them.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. One of our own is made only in local mode without any."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="staffmart-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return root.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object for ``path`` (HDFS, object store or local)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path nobody has used, removed when the application ends."""
    path = f"{scratch_root(spark)}/staffmart/{label}-{uuid.uuid4().hex}"
    fs, hadoop_path = filesystem(spark, path)
    fs.deleteOnExit(hadoop_path)
    return path


_writing = threading.Lock()
_writes: dict[str, tuple[int, str | None]] = {}  # by session: writes under way, and the setting before the first of them


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """``DROP_SHUFFLES`` set for a write. Writes of several threads may overlap; the last to end puts the setting back."""
    session = spark._jsparkSession.sessionUUID()
    with _writing:
        under_way, before = _writes.get(session) or (0, spark.conf.get(DROP_SHUFFLES, None))
        _writes[session] = (under_way + 1, before)
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _writing:
            under_way, before = _writes.pop(session)
            if under_way > 1:
                _writes[session] = (under_way - 1, before)
            elif before is None:
                spark.conf.unset(DROP_SHUFFLES)
            else:
                spark.conf.set(DROP_SHUFFLES, before)


def store(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet and return the stored table (its schema is known, so no inference job).

    A write is an execution of its own, so nothing else reads its shuffles.
    """
    with dropping_shuffles(df.sparkSession):
        df.write.mode("errorifexists").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: later readers scan a written table that survives the loss of any executor."""
    return store(df, fresh_dir(df.sparkSession, label))


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session's settings changed for what is run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arrow_batches(max_bytes: int) -> dict[str, str]:
    """The setting by which rows go to Python in batches that end at ``max_bytes``, which bounds a task's copies of long texts."""
    return {"spark.sql.execution.arrow.maxBytesPerBatch": str(max_bytes)}
