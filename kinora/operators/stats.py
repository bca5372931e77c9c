"""Counts and times over the catalog, each as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_stats(files: DataFrame, faces: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Faces count if they are not invalidated, also those of deleted files."""
    out = files.agg(F.count_if(~F.col("is_deleted")).alias("photos_present"), F.count_if("is_deleted").alias("photos_deleted"), F.max("indexed_at").alias("last_file_indexed"), F.max("last_seen_at").alias("last_scan"))
    out = out.crossJoin(faces.agg(F.count_if(~F.col("invalidated")).alias("faces")))  # one row each, here and below
    out = out.crossJoin(groups.agg(F.count(F.lit(1)).alias("groups")))
    return out.crossJoin(roots.agg(F.max("last_indexed_at").alias("last_root_indexed")))


def admin_counts(roots: DataFrame, files: DataFrame, faces: DataFrame, groups: DataFrame) -> DataFrame:
    out = roots.agg(F.count_if("enabled").alias("roots_count"))
    out = out.crossJoin(files.agg(F.count_if(~F.col("is_deleted")).alias("files_count")))
    out = out.crossJoin(faces.agg(F.count_if(~F.col("invalidated")).alias("faces_count")))
    return out.crossJoin(groups.agg(F.count(F.lit(1)).alias("groups_count")))


def enabled_roots(roots: DataFrame) -> DataFrame:
    return roots.where("enabled").orderBy("id")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, in whatever store it is."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
