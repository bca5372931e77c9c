"""Groups of similar faces: components of the neighbour graph, their representatives, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinora.functions.vectors import dot
from kinora.operators.catalog import numbered
from kinora.operators.components import connected_components


def face_components(edges: DataFrame) -> DataFrame:
    """(face_id, component) over directed edges taken as undirected; faces without an edge belong to no group."""
    return connected_components(edges, "face_id", "nbr_face_id").withColumnRenamed("id", "face_id")


def build_groups(faces: DataFrame, edges: DataFrame, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(groups, members). Groups are numbered by size, largest first, then by their smallest member.

    The representative has the highest quality, a missing one counting as 0, ties to the smaller id.
    """
    member = face_components(edges).join(faces.select(F.col("id").alias("face_id"), F.coalesce("quality_score", F.lit(0.0)).alias("quality")), "face_id")
    chosen = F.min_by("face_id", F.struct((-F.col("quality")).alias("q"), F.col("face_id")))
    sized = member.groupBy("component").agg(F.count(F.lit(1)).alias("member_count"), chosen.alias("rep_face_id")).where("member_count >= 2")
    ranked = numbered(sized, F.desc("member_count"), F.asc("component")).withColumn("id", F.col("place") + (first_id - 1))
    groups = ranked.select("id", F.lit(None).cast("string").alias("label"), "rep_face_id", "member_count")
    vectors = faces.select(F.col("id").alias("face_id"), F.col("embedding").alias("mine"))
    rep = ranked.select("component", F.col("id").alias("group_id"), "rep_face_id").join(vectors.withColumnsRenamed({"face_id": "rep_face_id", "mine": "theirs"}), "rep_face_id")
    members = member.select("face_id", "component").join(rep, "component").join(vectors, "face_id")
    return groups, members.select("group_id", "face_id", dot(F.col("mine"), F.col("theirs")).alias("score_to_rep"))


def rebuild_stats(faces: DataFrame, edges: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: faces_considered, edges_kept (directed), groups_created, members_assigned."""
    out = None
    for name, t in (("faces_considered", faces), ("edges_kept", edges), ("groups_created", groups), ("members_assigned", members)):
        one = t.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def group_list(groups: DataFrame, faces: DataFrame) -> DataFrame:
    """Groups with their representative's picture, largest first."""
    rep = faces.select(F.col("id").alias("rep_face_id"), F.col("face_thumb_rel").alias("rep_face_thumb_rel"))
    return groups.join(rep, "rep_face_id", "left").select("id", "label", "member_count", "rep_face_thumb_rel").orderBy(F.desc("member_count"), F.asc("id"))


def group_detail(group_id: int, members: DataFrame, faces: DataFrame, files: DataFrame) -> DataFrame:
    """A group's members in present files, best scores first; invalidated faces stay."""
    of = members.where(F.col("group_id") == group_id).select("face_id", "score_to_rep")
    face = faces.select(F.col("id").alias("face_id"), "file_id", "face_thumb_rel", "invalidated")
    file = files.where(~F.col("is_deleted")).select(F.col("id").alias("file_id"), "file_thumb_rel", "abs_path", "exif")
    found = of.join(face, "face_id").join(file, "file_id")
    return found.select("face_id", "face_thumb_rel", "invalidated", "file_thumb_rel", "abs_path", "exif", "score_to_rep").orderBy(F.desc_nulls_last("score_to_rep"), F.asc("face_id"))


def group_summary(groups: DataFrame) -> DataFrame:
    """(member_count, n): how many groups there are of each size."""
    return groups.groupBy("member_count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("member_count"))
