"""Listings as a stream: every micro-batch of seen files is compared with the catalog and merged into it.

The catalog is the state, so a restarted stream skips what it has already taken in, and a replayed batch changes
nothing: the same rows are found unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinora.operators.catalog import merge_upsert
from kinora.operators.scan import classified
from kinora.sources.versions import Store

FILES = "id long, root_id long, rel_path string, abs_path string, file_size long, mtime double, indexed_at timestamp, is_deleted boolean"


def take_in(store: Store, seen: DataFrame) -> None:
    """Merge the new and changed files of one batch into the stored ``files``."""
    spark = seen.sparkSession
    files = store.read("files") if store.has("files") else spark.createDataFrame([], FILES)
    todo = classified(seen, files).where("action = 'enqueue'").drop("action").withColumnRenamed("size", "file_size")
    if todo.isEmpty():
        return
    merged = merge_upsert(files, todo, ["abs_path"], {"indexed_at": F.current_timestamp(), "is_deleted": F.lit(False)})
    store.commit({"files": merged})


def watch(listings: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start taking in a stream of (root_id, rel_path, abs_path, size, mtime)."""
    writer = listings.writeStream.foreachBatch(lambda batch, _: take_in(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
