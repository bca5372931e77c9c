"""The catalog's tables as Spark schemas, and checks of what their constraints demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOTS = "id long, path string, enabled boolean, created_at timestamp, last_indexed_at timestamp"
FILES = (
    "id long, root_id long, rel_path string, abs_path string, file_size long, mtime timestamp, width int, height int, exif string, "
    "file_thumb_rel string, indexed_at timestamp, last_seen_at timestamp, is_deleted boolean"
)
FACES = (
    "id long, file_id long, face_index int, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int, det_score float, quality_score float, "
    "embedding array<float>, face_thumb_rel string, invalidated boolean, invalidated_reason string, created_at timestamp"
)
GROUPS = "id long, label string, rep_face_id long, member_count long, created_at timestamp, updated_at timestamp"
MEMBERS = "group_id long, face_id long, score_to_rep float, created_at timestamp"
JOBS = "id long, job_type string, status string, started_at timestamp, finished_at timestamp, stats string, error string"
EDGES = "job_id long, face_id long, nbr_face_id long, similarity double"

#: Columns that are unique together.
UNIQUE = {
    "roots": [("id",), ("path",)],
    "files": [("id",), ("abs_path",), ("root_id", "rel_path")],
    "faces": [("id",), ("file_id", "face_index")],
    "face_groups": [("id",)],
    "face_group_members": [("group_id", "face_id"), ("face_id",)],
    "jobs": [("id",)],
    "face_group_edges": [("face_id", "nbr_face_id")],
}


def duplicates(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The values of ``key`` that more than one row has; nulls never clash."""
    rows = df.dropna(subset=list(key))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def wrong_dimensions(faces: DataFrame, dimension: int) -> DataFrame:
    """Faces whose embedding is missing, of another length, or holds a null."""
    v = F.col("embedding")
    return faces.where(v.isNull() | (F.size(v) != dimension) | F.exists(v, lambda x: x.isNull()))
