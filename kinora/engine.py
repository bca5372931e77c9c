"""The catalog as a whole: roots, indexing, search, groups, invalidation, statistics, over a versioned store.

Every call that changes something reads the newest version, derives the new tables and commits them together, so a
run that is killed leaves the version before it.  One writer at a time is assumed, as a second one's commit fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinora import schema
from kinora.config import Settings
from kinora.functions.media import face_thumb, file_thumb
from kinora.operators import catalog, groups, jobs, knn, scan, search, stats
from kinora.session import remove, stored
from kinora.sources import images
from kinora.sources.files import listing
from kinora.sources.ingest import FaceDetector, detect_faces, found_in
from kinora.sources.versions import Store

TABLES = {
    "roots": schema.ROOTS, "files": schema.FILES.replace("mtime timestamp", "mtime double"), "faces": schema.FACES, "face_groups": schema.GROUPS,
    "face_group_members": schema.MEMBERS, "jobs": schema.JOBS, "face_group_edges": schema.EDGES,
}


def _contents(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the listed files; one that cannot be read has none and is reported by the detector."""
    for batch in paths:
        found = []
        for path in batch["path"]:
            try:
                with open(path, "rb") as f:
                    found.append(f.read())
            except OSError:
                found.append(None)
        yield pd.DataFrame({"path": batch["path"], "content": found})


class Catalog:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings | None = None, codec: images.Codec | None = None):
        """``codec`` decodes images and makes thumbnails, kept in ``thumbs`` below ``folder``, which workers share."""
        self.spark, self.store, self.settings = spark, Store(spark, folder), settings or Settings.of(spark)
        self.codec, self.thumbs = codec or images.available(), f"{folder}/thumbs"

    def table(self, name: str) -> DataFrame:
        return self.store.read(name) if self.store.has(name) else self.spark.createDataFrame([], TABLES[name])

    def init(self) -> None:
        """Create what is missing."""
        missing = {n: self.spark.createDataFrame([], t) for n, t in TABLES.items() if not self.store.has(n)}
        if missing:
            self.store.commit(missing)

    # --- roots ---------------------------------------------------------------------------------------------------

    def add_root(self, path: str) -> int:
        """Register a directory, or enable it again; returns its id."""
        source = self.spark.createDataFrame([(path,)], "path string")
        roots = catalog.merge_upsert(self.table("roots"), source, ["path"], {"enabled": F.lit(True)}, {"created_at": F.current_timestamp()})
        self.store.commit({"roots": roots})
        return self.table("roots").where(F.col("path") == path).first().id

    def list_roots(self) -> DataFrame:
        return stats.enabled_roots(self.table("roots"))

    # --- jobs ----------------------------------------------------------------------------------------------------

    def _begin(self, kind: str) -> int:
        """Start a job, or take over one of the kind that a killed run left; returns its id."""
        self.store.commit({"jobs": jobs.start(self.table("jobs"), kind, F.current_timestamp())})
        return self.table("jobs").where((F.col("job_type") == kind) & (F.col("status") == "running")).agg(F.max("id")).first()[0]

    @contextmanager
    def _running(self, job: int) -> Iterator[None]:
        """What runs inside can be stopped by its job; a job that fails or is stopped says so and changes nothing else."""
        self.spark.sparkContext.addJobTag(f"kinora-job-{job}")
        try:
            yield
        except BaseException as e:
            self.spark.sparkContext.removeJobTag(f"kinora-job-{job}")
            status = "interrupted" if isinstance(e, KeyboardInterrupt) or "cancelled" in str(e) else "failed"
            self.store.commit({"jobs": jobs.finish(self.table("jobs"), job, F.current_timestamp(), status, str(e)[:1000])})
            raise
        self.spark.sparkContext.removeJobTag(f"kinora-job-{job}")

    def stop(self, job: int) -> None:
        """Cancel what a job runs in this session, from another thread."""
        self.spark.sparkContext.cancelJobsWithTag(f"kinora-job-{job}")

    def _progress(self, job: int, counts: dict) -> None:
        self.store.commit({"jobs": jobs.with_stats(self.table("jobs"), job, json.dumps(counts))})

    # --- indexing ------------------------------------------------------------------------------------------------

    def index(self, detector: FaceDetector, root_ids: list[int] | None = None, fresh: bool = False, batch_size: int | None = None) -> dict:
        """Scan the enabled (or the given) roots, detect faces in new and changed files, mark missing files deleted."""
        if batch_size is not None and batch_size < 1:
            raise ValueError("batch_size has to be at least 1")
        roots = {r.id: r.path for r in self.list_roots().collect() if root_ids is None or r.id in root_ids}
        if not roots:
            return {}
        job = self._begin("index_all")
        with self._running(job):
            return self._index(job, roots, detector, fresh, batch_size)

    def _index(self, job: int, roots: dict[int, str], detector: FaceDetector, fresh: bool, batch_size: int | None) -> dict:
        now = F.current_timestamp()
        files, faces = self.table("files"), self.table("faces")
        found = stored(scan.budgeted(scan.classified(listing(self.spark, roots), files, fresh), batch_size or self.settings.batch_size), "scan")
        counts = scan.counters(found).first().asDict()
        self._progress(job, counts)
        todo = found.where("action = 'enqueue'")
        read = todo.select(F.col("abs_path").alias("path")).mapInPandas(_contents, "path string, content binary")
        detected = stored(detect_faces(read, detector, self.codec, self.settings.max_detect_side), "detected")
        counts["errors"] = detected.where("not ok").count()
        self._progress(job, counts)
        good = detected.where("ok").groupBy(F.col("path").alias("abs_path")).agg(*(F.first(c).alias(c) for c in ("width", "height", "exif")))
        done = todo.join(good, "abs_path").select("abs_path", "root_id", "rel_path", F.col("size").alias("file_size"), "mtime", "width", "height", "exif")
        done = done.withColumn("file_thumb_rel", file_thumb(F.col("root_id"), F.col("rel_path")))
        always = {"indexed_at": now, "last_seen_at": now, "is_deleted": F.lit(False)}
        files = stored(catalog.merge_upsert(files, done, ["abs_path"], always), "files")

        ids = files.select(F.col("id").alias("file_id"), F.col("abs_path").alias("path"))
        touched = good.select(F.col("abs_path").alias("path")).join(ids, "path").select("file_id")
        box = [F.col("bbox")[k].alias(f"bbox_{c}") for k, c in enumerate(("x1", "y1", "x2", "y2"))]
        new = detected.where("face_index is not null").join(ids, "path").select("file_id", "face_index", *box, "det_score", "quality_score", "embedding", F.lit(False).alias("invalidated"), now.alias("created_at"))
        new = new.withColumn("face_thumb_rel", face_thumb(F.col("file_id"), F.col("face_index")))
        files, new = self._with_thumbnails(files, new, good.select("abs_path"))
        faces = stored(catalog.replace_children(faces, new, "file_id", touched), "faces")
        seen = found.select("abs_path")
        files = catalog.soft_delete_missing(catalog.touch_seen(files, seen, now), list(roots), seen)
        table = catalog.touch_root(self.table("roots"), list(roots), now)
        counts["files_reindexed"] = good.count()
        self.store.commit({
            "files": files,
            "faces": faces,
            "roots": table,
            "face_group_members": catalog.surviving(self.table("face_group_members"), faces, "face_id"),
            "face_group_edges": catalog.surviving(self.table("face_group_edges"), faces, "face_id", "nbr_face_id"),
            "face_groups": catalog.released_representatives(self.table("face_groups"), faces),
            "jobs": jobs.finish(self.table("jobs"), job, now, stats=json.dumps(counts)),
        })
        return counts

    def _with_thumbnails(self, files: DataFrame, faces: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Write thumbnails of the files just read and of their faces; names of those not written become null."""
        mine = files.join(read, "abs_path")
        crops = faces.groupBy("file_id").agg(F.collect_list(F.struct(F.col("face_thumb_rel").alias("name"), F.array(*(f"bbox_{c}" for c in ("x1", "y1", "x2", "y2"))).alias("box"))).alias("faces"))
        if self.codec is None:
            made = read.select(F.col("abs_path").alias("path"), F.lit(None).cast("string").alias("thumb"), F.array().cast("array<string>").alias("faces"))
        else:
            wanted = mine.join(crops.withColumnRenamed("file_id", "id"), "id", "left").select(F.col("abs_path").alias("path"), F.col("file_thumb_rel").alias("thumb"), "faces")
            made = stored(images.save_thumbnails(wanted, self.codec, self.thumbs), "thumbs")
        told = files.join(made.select(F.col("path").alias("abs_path"), "thumb", F.lit(True).alias("_read")), "abs_path", "left")
        told = told.withColumn("file_thumb_rel", F.when(F.col("_read"), F.col("thumb")).otherwise(F.col("file_thumb_rel"))).select(files.columns)
        written = made.select(F.explode("faces").alias("face_thumb_rel"), F.lit(True).alias("_written"))
        faces = faces.join(written, "face_thumb_rel", "left").withColumn("face_thumb_rel", F.when(F.col("_written"), F.col("face_thumb_rel"))).select(faces.columns)
        return stored(told, "files"), faces

    # --- groups --------------------------------------------------------------------------------------------------

    def rebuild(self, k: int | None = None, threshold: float | None = None) -> dict:
        """Neighbour edges of all live faces, and the groups that they connect."""
        k, threshold = k or self.settings.group_k, self.settings.group_threshold if threshold is None else threshold
        job = self._begin("group_rebuild")
        with self._running(job):
            return self._rebuild(job, k, threshold)

    def _rebuild(self, job: int, k: int, threshold: float) -> dict:
        now = F.current_timestamp()
        live = search.live_faces(self.table("faces"), self.table("files"))
        edges = stored(knn.knn_edges(live, k, threshold, self.settings.block_size), "edges")
        self._progress(job, {"edges_kept": edges.count()})
        first = (self.table("face_groups").agg(F.max("id")).first()[0] or 0) + 1
        found, members = (stored(t, n) for t, n in zip(groups.build_groups(live, edges, first), ("groups", "members")))
        counts = groups.rebuild_stats(live, edges, found, members).first().asDict()
        kept = catalog.without_stale_edges(self.table("face_group_edges"), self.table("jobs"), job)
        self.store.commit({
            "face_groups": found.select("id", "label", "rep_face_id", "member_count", now.alias("created_at"), now.alias("updated_at")),
            "face_group_members": members.select("group_id", "face_id", F.col("score_to_rep").cast("float").alias("score_to_rep"), now.alias("created_at")),
            "face_group_edges": kept.unionByName(edges.withColumn("job_id", F.lit(job).cast("long"))).dropDuplicates(["face_id", "nbr_face_id"]),
            "jobs": jobs.finish(self.table("jobs"), job, now, stats=json.dumps(counts)),
        })
        return counts

    def group_list(self) -> DataFrame:
        return groups.group_list(self.table("face_groups"), self.table("faces"))

    def group_detail(self, group_id: int) -> DataFrame:
        return groups.group_detail(group_id, self.table("face_group_members"), self.table("faces"), self.table("files"))

    def group_summary(self) -> DataFrame:
        return groups.group_summary(self.table("face_groups"))

    # --- search, invalidation, statistics ------------------------------------------------------------------------

    def search(self, query: list[float], limit: int | None = None) -> DataFrame:
        return search.search(query, self.table("faces"), self.table("files"), limit or self.settings.search_limit, self.table("face_group_members"))

    def search_image(self, content: bytes, detector: FaceDetector, limit: int | None = None) -> DataFrame:
        """By the best face of an image; raises if there is none."""
        found = found_in(detector.load(), content, self.codec, self.settings.max_detect_side)
        if not found:
            raise ValueError("no face in the query image")
        return self.search([float(x) for x in max(found, key=lambda f: f["det_score"])["embedding"]], limit)

    def toggle(self, face_id: int) -> bool | None:
        """Turn the face's flag over; returns it, or None for an unknown face."""
        self.store.commit({"faces": catalog.toggle(self.table("faces"), face_id)})
        row = self.table("faces").where(F.col("id") == face_id).select("invalidated").first()
        return row.invalidated if row else None

    def stats(self) -> DataFrame:
        return stats.catalog_stats(self.table("files"), self.table("faces"), self.table("face_groups"), self.table("roots"))

    def admin(self) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """Counts, enabled roots, the latest jobs, and the store's bytes."""
        return stats.admin_counts(self.table("roots"), self.table("files"), self.table("faces"), self.table("face_groups")), self.list_roots(), jobs.latest(self.table("jobs")), self.store.size()

    def reset(self, clear_roots: bool = False) -> dict[str, int]:
        """Empty the tables and remove the thumbnails; returns the row counts from before."""
        tables = {n: self.table(n) for n in TABLES}
        counts = {r.table_name: r.n for r in catalog.reset_counts({n: tables[n] for n in ("files", "faces", "face_groups", "jobs", "roots")}).collect()}
        self.store.commit(catalog.emptied(tables, clear_roots))
        remove(self.spark, self.thumbs)
        return counts
