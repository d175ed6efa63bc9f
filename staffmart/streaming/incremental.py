"""Loading batches as they arrive, and suppressing repeated deliveries."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffmart.operators.cleaning import clean
from staffmart.operators.profile import is_loadable
from staffmart.plans.star import load_star
from staffmart.schema import STAGING_SCHEMA
from staffmart.session import filesystem, materialise, settings
from staffmart.sources.csv import as_read
from staffmart.sources.warehouse import current_commit, write_staging


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gives a streaming query; it lives and dies with the checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def load_arrivals(
    spark: SparkSession,
    arrivals: str,
    root: str,
    checkpoint: str,
    as_of: dt.date,
    stream: str = "arrivals",
    csv_columns: list[str] | None = None,
) -> None:
    """Load all files that arrived since the last call into the star, then stop.

    Arrivals are staging Parquet, or with ``csv_columns`` (their header) raw CSV that is cleaned like any batch. The
    published commit records the run's id and its last micro-batch, so a batch that Spark replays after a failure is
    recognised and skipped. A run with another checkpoint is another run: nothing of it is skipped.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        name = f"{stream}/{run_id(session, checkpoint)}"
        commit = current_commit(session, root)
        if commit and commit["streams"].get(name, -1) >= batch_id:
            return
        if not is_loadable(batch):
            return
        staging = materialise(batch, "arrival") if csv_columns is None else write_staging(clean(as_read(batch), as_of), root)
        load_star(session, staging, root, as_of, streams={name: batch_id})

    if csv_columns is None:
        arriving = spark.readStream.schema(STAGING_SCHEMA).parquet(arrivals)
    else:
        header = ", ".join(f"`{c}` string" for c in csv_columns)
        # enforceSchema off: a file with another header stops the stream instead of being read by position.
        reader = spark.readStream.schema(header).option("header", True).option("escape", '"')
        arriving = reader.option("enforceSchema", False).option("multiLine", True).csv(arrivals)
    run_batches(arriving, load, checkpoint)


def run_batches(arriving: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand everything that is there to ``handle``, batch by batch."""
    query = (
        arriving.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drop_repeats(events: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """Duplicate removal inside a stream, with bounded state: a repeat that arrives within ``lateness`` is dropped. Rows that
    are later than that are dropped too, repeats or not; where every row counts, use ``append_new``."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


STATE = {
    # Keys live on the executors' disks; each batch uploads what it changed to the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def append_new(events: DataFrame, key: str, path: str, checkpoint: str) -> list[dict]:
    """Append the stream to the table at ``path``, each key once, however late it comes; returns the progress of the batches.

    The keys met so far are keyed state, dealt by hash: a batch looks up its own keys, and neither the table nor other keys are
    read, so its cost follows its size and not that of the table. State and table belong to the checkpoint: a
    replayed batch meets the state it met before and replaces its own files, and a lost executor's state comes back from the checkpoint.
    A table begun with another checkpoint is refused, as its keys are not known here. A row without a key stops the stream, as nothing
    could recognise it. Read the table with ``spark.read.parquet``, which leaves out files of unfinished batches.
    """
    spark = events.sparkSession
    (fs, begun), (_, kept) = filesystem(spark, f"{path}/_spark_metadata"), filesystem(spark, f"{checkpoint}/metadata")
    if fs.exists(begun) and not fs.exists(kept):
        raise ValueError(f"{path} was begun with another checkpoint than {checkpoint}")
    present = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"row without {key}"))).otherwise(F.col(key))
    rows = events.withColumn(key, present.cast(events.schema[key].dataType)).dropDuplicates([key])
    with settings(spark, STATE):
        query = (
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return [json.loads(progress.json) for progress in query.recentProgress]
