"""Incremental scans: what is on disk against what the catalog knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinora.functions.media import is_supported
from kinora.operators.catalog import numbered

#: Modification times closer than this are the same, in seconds.
TOLERANCE = 1e-3


def classified(disk: DataFrame, files: DataFrame, fresh: bool = False) -> DataFrame:
    """``disk`` (root_id, rel_path, abs_path, size, mtime) with ``action``: ``skip`` for unchanged files, else ``enqueue``.

    Only supported files count; deleted catalog rows are not looked up, so a file that comes back is new; ``fresh``
    looks nothing up.
    """
    seen = disk.where(is_supported(F.col("abs_path")))
    if fresh:
        return seen.withColumn("action", F.lit("enqueue"))
    known = files.where(~F.col("is_deleted")).select("abs_path", F.col("file_size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("_size") == F.col("size")) & (F.abs(F.col("_mtime") - F.col("mtime")) < TOLERANCE)
    joined = seen.join(known, "abs_path", "left")
    return joined.withColumn("action", F.when(F.coalesce(same, F.lit(False)), "skip").otherwise("enqueue")).select(*disk.columns, "action")


def budgeted(found: DataFrame, batch_size: int | None) -> DataFrame:
    """The first ``batch_size`` files to be read, in the order of roots and paths, stay; later ones are deferred."""
    if batch_size is None:
        return found
    todo = numbered(found.where("action = 'enqueue'"), F.col("root_id"), F.col("rel_path"))
    todo = todo.withColumn("action", F.when(F.col("place") <= batch_size, "enqueue").otherwise("defer")).drop("place")
    return found.where("action <> 'enqueue'").unionByName(todo)


def counters(found: DataFrame) -> DataFrame:
    """files_seen, files_skipped, files_enqueued, files_deferred."""
    n = lambda action: F.count_if(F.col("action") == action)
    return found.agg(F.count(F.lit(1)).alias("files_seen"), n("skip").alias("files_skipped"), n("enqueue").alias("files_enqueued"), n("defer").alias("files_deferred"))


def full_diff(disk: DataFrame, files: DataFrame, root_id: int) -> DataFrame:
    """(abs_path, action): new, changed, unchanged or missing, for one root."""
    seen = disk.where(is_supported(F.col("abs_path")) & (F.col("root_id") == root_id)).select("abs_path", "size", "mtime")
    known = files.where(~F.col("is_deleted") & (F.col("root_id") == root_id)).select("abs_path", F.col("file_size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("_size") == F.col("size")) & (F.abs(F.col("_mtime") - F.col("mtime")) < TOLERANCE)
    action = F.when(F.col("_size").isNull(), "new").when(F.col("size").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    return seen.join(known, "abs_path", "full_outer").select("abs_path", action.alias("action"))
