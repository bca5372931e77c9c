"""Changes to the catalog as functions from old tables to new ones; swapping the stored version is the caller's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinora.session import stored


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with ascending numbers from 1 in ``order`` over all rows, without gathering them in one task.

    Rows are dealt by ranges of the order and numbered within their partition; a row per partition gives the offsets.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = held.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], always: dict[str, Column] | None = None, when_new: dict[str, Column] | None = None, id_column: str = "id") -> DataFrame:
    """Insert ``source`` rows whose keys are new, else overwrite the source's columns; ids and other columns stay.

    ``always`` sets columns of inserted and overwritten rows, ``when_new`` further ones of inserted rows.  New ids
    follow the largest one in the order of the keys.  With several source rows of a key the greatest one wins.
    """
    always, when_new = always or {}, when_new or {}
    values = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_new")) if values else source.select(*keys).distinct().withColumn("_new", F.struct(F.lit(1)))
    one = one.withColumn("_hit", F.lit(True))
    old = target.join(one, keys, "left")
    changed = {c: F.col(f"_new.{c}") for c in values} | always
    kept = old.select(*[F.when(F.col("_hit"), changed[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in target.columns])
    most = target.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_most"))
    fresh = one.join(target.select(*keys), keys, "left_anti")
    fresh = numbered(fresh, *[F.col(k) for k in keys]).crossJoin(F.broadcast(most))  # one row
    given = {id_column: F.col("_most") + F.col("place")} | {k: F.col(k) for k in keys} | when_new | changed
    return kept.unionByName(fresh.select(*[given.get(c, F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns]))


def replace_children(children: DataFrame, incoming: DataFrame, parent: str, touched: DataFrame, id_column: str = "id") -> DataFrame:
    """Drop the children of every parent in ``touched`` and add ``incoming`` under new ids."""
    kept = children.join(touched.select(parent).distinct(), parent, "left_anti").select(*children.columns)
    most = children.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_most"))
    fresh = numbered(incoming, F.col(parent), F.col("face_index")).crossJoin(F.broadcast(most))  # one row
    fresh = fresh.withColumn(id_column, F.col("_most") + F.col("place"))
    return kept.unionByName(fresh.select(*[(F.col(c) if c in fresh.columns else F.lit(None)).cast(children.schema[c].dataType).alias(c) for c in children.columns]))


def surviving(rows: DataFrame, faces: DataFrame, *columns: str) -> DataFrame:
    """Rows whose every named column still refers to a face: deletes cascade."""
    for c in columns:
        rows = rows.join(faces.select(F.col("id").alias(c)), c, "left_semi").select(*rows.columns)
    return rows


def released_representatives(groups: DataFrame, faces: DataFrame) -> DataFrame:
    """Groups whose representative is gone keep their row and stored count, without a representative."""
    there = faces.select(F.col("id").alias("_face"))
    joined = groups.join(there, F.col("rep_face_id") == F.col("_face"), "left")
    return joined.withColumn("rep_face_id", F.col("_face")).select(*groups.columns)


def _listed(ids: int | list[int]) -> list[int]:
    return [ids] if isinstance(ids, int) else list(ids)


def soft_delete_missing(files: DataFrame, root_ids: int | list[int], seen: DataFrame) -> DataFrame:
    """Files of the roots that are not among the seen paths become deleted; if nothing was seen, all of them do."""
    there = seen.select(F.col("abs_path").alias("_path")).distinct()
    joined = files.join(there, F.col("abs_path") == F.col("_path"), "left")
    gone = F.col("root_id").isin(_listed(root_ids)) & ~F.col("is_deleted") & F.col("_path").isNull()
    return joined.withColumn("is_deleted", F.col("is_deleted") | F.coalesce(gone, F.lit(False))).select(*files.columns)


def touch_seen(files: DataFrame, seen: DataFrame, now: Column, column: str = "last_seen_at") -> DataFrame:
    there = seen.select(F.col("abs_path").alias("_path")).distinct()
    joined = files.join(there, F.col("abs_path") == F.col("_path"), "left")
    return joined.withColumn(column, F.when(F.col("_path").isNotNull(), now).otherwise(F.col(column))).select(*files.columns)


def touch_root(roots: DataFrame, root_ids: int | list[int], now: Column) -> DataFrame:
    return roots.withColumn("last_indexed_at", F.when(F.col("id").isin(_listed(root_ids)), now).otherwise(F.col("last_indexed_at")))


def toggle(faces: DataFrame, face_id: int) -> DataFrame:
    """The face's ``invalidated`` flag turned over; an unknown id changes nothing."""
    return faces.withColumn("invalidated", F.when(F.col("id") == face_id, ~F.col("invalidated")).otherwise(F.col("invalidated")))


def invalidate(faces: DataFrame, face_id: int) -> DataFrame:
    return faces.withColumn("invalidated", (F.col("id") == face_id) | F.col("invalidated"))


def restore(faces: DataFrame, face_id: int) -> DataFrame:
    return faces.withColumn("invalidated", (F.col("id") != face_id) & F.col("invalidated"))


def without_stale_edges(edges: DataFrame, jobs: DataFrame, job_id: int) -> DataFrame:
    """Without the job's own edges and those of jobs that do not run.

    As ``job_id NOT IN (running)``: edges without a job stay while any job runs and go when none does.
    """
    running = jobs.where("status = 'running'").select(F.col("id").alias("job_id"))
    any_running = running.agg((F.count(F.lit(1)) > 0).alias("_any"))
    own = F.coalesce(F.col("job_id") == job_id, F.lit(False))
    alive = edges.where(~own).join(running, "job_id", "left_semi").select(*edges.columns)
    free = edges.where("job_id is null").crossJoin(F.broadcast(any_running)).where("_any").select(*edges.columns)  # one row
    return alive.unionByName(free)


def reset_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of every table, as a reset reports before it empties them."""
    counts = [t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def emptied(tables: dict[str, DataFrame], clear_roots: bool = False) -> dict[str, DataFrame]:
    return {name: t if name == "roots" and not clear_roots else t.limit(0) for name, t in tables.items()}
