"""Exact cosine search over the live faces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinora.functions.vectors import cosine_distance, literal


def live_faces(faces: DataFrame, files: DataFrame) -> DataFrame:
    """Faces that are not invalidated, of files that are not deleted."""
    present = files.where(~F.col("is_deleted")).select(F.col("id").alias("file_id"))
    return faces.where(~F.col("invalidated")).join(present, "file_id", "left_semi").select(*faces.columns)


def search(query: list[float], faces: DataFrame, files: DataFrame, limit: int = 50, members: DataFrame | None = None) -> DataFrame:
    """The ``limit`` nearest live faces with their file and, if members are given, their group.

    Distances are computed in the scan and cut off before anything is looked up: a face has one file and at most one
    group, so those joins neither drop nor repeat a hit.
    """
    distance = cosine_distance(F.col("embedding"), literal(query))
    near = live_faces(faces, files).select(F.col("id").alias("face_id"), "file_id", "face_thumb_rel", distance.alias("distance"))
    near = near.orderBy(F.col("distance").asc_nulls_last(), F.asc("face_id")).limit(limit)
    file = files.select(F.col("id").alias("file_id"), "file_thumb_rel", "abs_path", "rel_path", "exif")
    found = near.join(file, "file_id")
    if members is not None:
        found = found.join(members.select("face_id", "group_id"), "face_id", "left")
    extra = ["group_id"] if members is not None else []
    return found.withColumn("similarity", 1 - F.col("distance")).select("face_id", "similarity", "face_thumb_rel", "file_thumb_rel", "abs_path", "rel_path", "exif", *extra).orderBy(F.desc("similarity"), F.asc("face_id"))


def best_face(detections: DataFrame, key: str = "file_id") -> DataFrame:
    """Per image its face with the highest detection score, the first of equal ones."""
    order = F.struct((-F.col("det_score")).alias("s"), F.col("face_index"))
    return detections.groupBy(key).agg(F.min_by("id", order).alias("face_id"), F.max("det_score").alias("det_score"))
