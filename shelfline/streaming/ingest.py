"""Loading files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from shelfline.plans.load import load_files
from shelfline.sources.listing import list_source_files
from shelfline.store import Store

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_upsert(store: Store, dataset: str, rows: DataFrame, key: Sequence[str],
                  checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert a stream of parsed rows; a replayed batch changes nothing."""

    def load(batch: DataFrame, batch_id: int) -> None:
        store.upsert(dataset, batch, key)

    return _start(rows.writeStream.foreachBatch(load), checkpoint, available_now)


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_ingest(store: Store, root: str, checkpoint: str, datasets=None, max_depth: int | None = None,
                  max_files_per_trigger: int = 1000, order_by: str = "arrival",
                  available_now: bool = True) -> StreamingQuery:
    """Load a folder whenever something arrives in it.

    The stream only says that there is something to do.  Each trigger lists the
    folder and compares it with the ledger, as the batch job does, so a file that
    was written again, or came with an old time stamp, is loaded too, and a
    replayed trigger loads nothing twice.
    """
    files = (
        store.spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        # Files are new by the ledger, not by their age against the newest.
        .option("maxFileAge", "36500d")
        .load(root)
        .select("path", F.col("length").alias("bytes"),
                F.col("modificationTime").alias("modified_at"))
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        listed = list_source_files(store.spark, root, max_depth)
        load_files(store, listed, datasets, f"stream batch {batch_id}", order_by)

    return _start(files.writeStream.foreachBatch(load), checkpoint, available_now)
