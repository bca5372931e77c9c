"""The catalog engine's registered queries over the derived tables, each with the SQL that checks it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinora.functions import geometry, media, vectors
from kinora.operators import catalog, groups, jobs, knn, scan, search, stats
from kinora.plans.fixtures import NOW, THETA, sql, view
from kinora.plans.registry import ORACLES, QUERIES, query
from kinora.session import stored
from kinora.sources.ingest import FakeDetector, detect_faces

__all__ = ["ORACLES", "QUERIES"]

now = partial(F.lit, NOW)


def live(spark: SparkSession, d: str) -> DataFrame:
    return search.live_faces(view(spark, d, "fx_faces"), view(spark, d, "fx_files"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return stored(knn.knn_edges(live(spark, d), 20, THETA), "edges")


def built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found, members = groups.build_groups(live(spark, d), edges(spark, d))
    return stored(found, "groups"), stored(members, "members")


def vector_of(spark: SparkSession, d: str, table: str, face_id: int) -> list[float]:
    """One vector, looked up by its id."""
    return [float(x) for x in view(spark, d, table).where(F.col("id") == face_id).select("embedding").first().embedding]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- search and live faces ---------------------------------------------------------------------------------------


@query("live_faces", sql("live") + "SELECT id, file_id, face_index, quality_score FROM live")
def live_faces(spark, d):
    return live(spark, d).select("id", "file_id", "face_index", "quality_score")


_NEAR = """SELECT face_id, round(1 - distance, 6) similarity, face_thumb_rel, file_thumb_rel, abs_path, rel_path, exif{extra} FROM (
  SELECT f.id face_id, f.file_id, f.face_thumb_rel, list_cosine_distance(CAST(f.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM {faces} WHERE id = {q})) distance
  FROM {faces} f JOIN fx_files fi ON fi.id = f.file_id WHERE NOT f.invalidated AND NOT fi.is_deleted ORDER BY distance, f.id LIMIT {k}) JOIN fx_files fi ON fi.id = file_id {join}"""


@query("search_topk", sql("fx_faces_scaled", "fx_files") + _NEAR.format(faces="fx_faces_scaled", q=1, k=50, extra="", join=""))
def search_topk(spark, d):
    faces, files = view(spark, d, "fx_faces_scaled"), view(spark, d, "fx_files")
    return rounded(search.search(vector_of(spark, d, "fx_faces_scaled", 1), faces, files, 50), "similarity")


@query("search_topk_with_group", sql("members", "fx_faces", "fx_files", recursive=True) + _NEAR.format(faces="fx_faces", q=0, k=50, extra=", group_id", join="LEFT JOIN members USING (face_id)"))
def search_topk_with_group(spark, d):
    faces, files = view(spark, d, "fx_faces"), view(spark, d, "fx_files")
    return rounded(search.search(vector_of(spark, d, "fx_faces", 0), faces, files, 50, built(spark, d)[1]), "similarity")


@query("best_query_face", sql("fx_faces") + "SELECT file_id, id face_id, det_score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY det_score DESC, face_index) place FROM fx_faces) WHERE place = 1")
def best_query_face(spark, d):
    return search.best_face(view(spark, d, "fx_faces"))


@query("normalize_embeddings", sql("fx_faces_scaled") + "SELECT id, round(n, 5) norm, round(CAST(embedding[1] AS DOUBLE) / n, 6) first FROM (SELECT *, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) n FROM fx_faces_scaled)")
def normalize_embeddings(spark, d):
    v = F.col("embedding")
    return view(spark, d, "fx_faces_scaled").select("id", F.round(vectors.norm(v), 5).alias("norm"), F.round(vectors.normalized(v)[0], 6).alias("first"))


# --- neighbour graph and groups ----------------------------------------------------------------------------------

_EDGES = "SELECT face_id, nbr_face_id, round(similarity, 6) similarity FROM edges"


@query("knn_edges", sql("edges") + _EDGES)
def knn_edges(spark, d):
    return rounded(knn.knn_edges(live(spark, d), 20, THETA), "similarity")


@query("knn_edges_k3", sql("sims") + f"SELECT q face_id, n nbr_face_id, round(s, 6) similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) place FROM sims) WHERE place <= 3 AND q <> n AND s >= {THETA}")
def knn_edges_k3(spark, d):
    return rounded(knn.knn_edges(live(spark, d), 3, THETA), "similarity")


@query("edge_count", sql("edges") + "SELECT count(*) n FROM edges")
def edge_count(spark, d):
    return knn.knn_edges(live(spark, d), 20, THETA).agg(F.count(F.lit(1)).alias("n"))


@query("components", sql("member", recursive=True) + "SELECT face_id, component FROM member")
def components(spark, d):
    return groups.face_components(edges(spark, d))


@query("groups", sql("groups", recursive=True) + "SELECT id, CAST(NULL AS VARCHAR) AS label, rep_face_id, member_count FROM groups")
def all_groups(spark, d):
    return built(spark, d)[0]


@query("group_members", sql("members", recursive=True) + "SELECT group_id, face_id, round(score_to_rep, 6) score_to_rep FROM members")
def group_members(spark, d):
    return rounded(built(spark, d)[1], "score_to_rep")


@query("group_list", sql("groups", "fx_faces", recursive=True) + "SELECT g.id, CAST(NULL AS VARCHAR) AS label, member_count, face_thumb_rel rep_face_thumb_rel FROM groups g LEFT JOIN fx_faces f ON f.id = rep_face_id")
def group_list(spark, d):
    return groups.group_list(built(spark, d)[0], view(spark, d, "fx_faces"))


@query("group_detail", sql("members", "fx_faces", "fx_files", recursive=True) + "SELECT m.face_id, f.face_thumb_rel, f.invalidated, fi.file_thumb_rel, fi.abs_path, fi.exif, round(score_to_rep, 6) score_to_rep FROM members m JOIN fx_faces f ON f.id = m.face_id JOIN fx_files fi ON fi.id = f.file_id WHERE group_id = 1 AND NOT fi.is_deleted")
def group_detail(spark, d):
    return rounded(groups.group_detail(1, built(spark, d)[1], view(spark, d, "fx_faces"), view(spark, d, "fx_files")), "score_to_rep")


@query("group_summary", sql("groups", recursive=True) + "SELECT member_count, count(*) n FROM groups GROUP BY member_count")
def group_summary(spark, d):
    return groups.group_summary(built(spark, d)[0])


@query("rebuild_stats", sql("live", "edges", "groups", "members", recursive=True) + "SELECT (SELECT count(*) FROM live) faces_considered, (SELECT count(*) FROM edges) edges_kept, (SELECT count(*) FROM groups) groups_created, (SELECT count(*) FROM members) members_assigned")
def rebuild_stats(spark, d):
    found = edges(spark, d)
    return groups.rebuild_stats(live(spark, d), found, *groups.build_groups(live(spark, d), found))


# --- scans -------------------------------------------------------------------------------------------------------

_SUPPORTED = "regexp_matches(lower(abs_path), '\\.(cr2|cr3|nef|arw|dng|rw2|orf|raf|pef|jpg|jpeg|png|tif|tiff|bmp|webp)$')"
_DIFF = f"""SELECT k.*, CASE WHEN f.file_size = k.size AND abs(f.mtime - k.mtime) < 1e-3 THEN 'skip' ELSE 'enqueue' END AS "action"
  FROM fx_disk k LEFT JOIN (SELECT * FROM fx_files WHERE NOT is_deleted) f ON f.abs_path = k.abs_path WHERE {_SUPPORTED.replace("abs_path", "k.abs_path")}"""


def diff(spark, d):
    return scan.classified(view(spark, d, "fx_disk"), view(spark, d, "fx_files"))


@query("scan_diff", sql("fx_disk", "fx_files") + f'SELECT abs_path, size, "action" FROM ({_DIFF})')
def scan_diff(spark, d):
    return diff(spark, d).select("abs_path", "size", "action")


@query("scan_fresh", sql("fx_disk") + f"SELECT abs_path, 'enqueue' AS \"action\" FROM fx_disk WHERE {_SUPPORTED}")
def scan_fresh(spark, d):
    return scan.classified(view(spark, d, "fx_disk"), view(spark, d, "fx_files"), fresh=True).select("abs_path", "action")


@query("scan_full_diff", sql("fx_disk", "fx_files") + f"""SELECT coalesce(k.abs_path, f.abs_path) abs_path, CASE WHEN f.abs_path IS NULL THEN 'new' WHEN k.abs_path IS NULL THEN 'missing' WHEN f.file_size = k.size AND abs(f.mtime - k.mtime) < 1e-3 THEN 'unchanged' ELSE 'changed' END AS "action"
FROM (SELECT * FROM fx_disk WHERE root_id = 3 AND {_SUPPORTED}) k FULL JOIN (SELECT * FROM fx_files WHERE NOT is_deleted AND root_id = 3) f ON f.abs_path = k.abs_path""")
def scan_full_diff(spark, d):
    return scan.full_diff(view(spark, d, "fx_disk"), view(spark, d, "fx_files"), 3)


_BUDGET = f"""SELECT *, CASE WHEN "action" = 'enqueue' AND row_number() OVER (PARTITION BY "action" ORDER BY root_id, rel_path) > 100 THEN 'defer' ELSE "action" END AS decided FROM ({_DIFF})"""


@query("batch_budget", sql("fx_disk", "fx_files") + f'SELECT abs_path, decided AS "action" FROM ({_BUDGET})')
def batch_budget(spark, d):
    return scan.budgeted(diff(spark, d), 100).select("abs_path", "action")


@query("scan_counters", sql("fx_disk", "fx_files") + f"SELECT count(*) files_seen, count(*) FILTER (decided = 'skip') files_skipped, count(*) FILTER (decided = 'enqueue') files_enqueued, count(*) FILTER (decided = 'defer') files_deferred FROM ({_BUDGET})")
def scan_counters(spark, d):
    return scan.counters(scan.budgeted(diff(spark, d), 100))


# --- changes -----------------------------------------------------------------------------------------------------


@query("files_upsert", sql("fx_files", "fx_disk") + f"""SELECT f.id, f.abs_path, coalesce(k.size, f.file_size) file_size, coalesce(k.mtime, f.mtime) mtime, CASE WHEN k.abs_path IS NULL THEN f.is_deleted ELSE false END is_deleted, CASE WHEN k.abs_path IS NULL THEN f.indexed_at ELSE {NOW} END indexed_at, f.width
  FROM fx_files f LEFT JOIN fx_disk k USING (abs_path)
  UNION ALL SELECT (SELECT max(id) FROM fx_files) + row_number() OVER (ORDER BY abs_path), abs_path, size, mtime, false, {NOW}, NULL FROM fx_disk WHERE abs_path NOT IN (SELECT abs_path FROM fx_files)""")
def files_upsert(spark, d):
    disk = view(spark, d, "fx_disk").withColumnRenamed("size", "file_size")
    out = catalog.merge_upsert(view(spark, d, "fx_files"), disk, ["abs_path"], {"indexed_at": now(), "last_seen_at": now(), "is_deleted": F.lit(False)})
    return out.select("id", "abs_path", "file_size", "mtime", "is_deleted", "indexed_at", "width")


@query("roots_upsert", sql("fx_roots") + f"SELECT id, path, enabled OR path IN ('/photos/src3', '/photos/src7') enabled, created_at FROM fx_roots UNION ALL SELECT (SELECT max(id) FROM fx_roots) + 1, '/photos/new', true, {NOW}")
def roots_upsert(spark, d):
    source = spark.createDataFrame([("/photos/src3",), ("/photos/src7",), ("/photos/new",)], "path string")
    return catalog.merge_upsert(view(spark, d, "fx_roots"), source, ["path"], {"enabled": F.lit(True)}, {"created_at": now()}).select("id", "path", "enabled", "created_at")


_REPLACED = """replaced AS (SELECT id, file_id, face_index, face_thumb_rel FROM fx_faces WHERE file_id % 10 <> 4
  UNION ALL SELECT (SELECT max(id) FROM fx_faces) + row_number() OVER (ORDER BY file_id, face_index), file_id, face_index, concat('faces/', file_id, '_', face_index, '.jpg') FROM (SELECT DISTINCT file_id FROM fx_faces WHERE file_id % 10 = 4), (SELECT unnest([0, 1]) face_index))
"""


def replaced(spark, d):
    faces = view(spark, d, "fx_faces")
    touched = faces.where("file_id % 10 = 4").select("file_id").distinct()
    incoming = touched.withColumn("face_index", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("face_thumb_rel", media.face_thumb(F.col("file_id"), F.col("face_index")))
    return catalog.replace_children(faces, incoming, "file_id", touched)


@query("faces_replace", sql("fx_faces").rstrip() + ",\n" + _REPLACED + "SELECT * FROM replaced")
def faces_replace(spark, d):
    return replaced(spark, d).select("id", "file_id", "face_index", "face_thumb_rel")


@query("cascade_members", sql("members", recursive=True).rstrip() + ",\n" + _REPLACED + "SELECT group_id, face_id FROM members WHERE face_id IN (SELECT id FROM replaced)")
def cascade_members(spark, d):
    return catalog.surviving(built(spark, d)[1], replaced(spark, d), "face_id").select("group_id", "face_id")


@query("cascade_edges", sql("edges").rstrip() + ",\n" + _REPLACED + "SELECT face_id, nbr_face_id FROM edges WHERE face_id IN (SELECT id FROM replaced) AND nbr_face_id IN (SELECT id FROM replaced)")
def cascade_edges(spark, d):
    return catalog.surviving(edges(spark, d), replaced(spark, d), "face_id", "nbr_face_id").select("face_id", "nbr_face_id")


@query("cascade_rep_null", sql("groups", recursive=True).rstrip() + ",\n" + _REPLACED + "SELECT id, CASE WHEN rep_face_id IN (SELECT id FROM replaced) THEN rep_face_id END rep_face_id, member_count FROM groups")
def cascade_rep_null(spark, d):
    return catalog.released_representatives(built(spark, d)[0], replaced(spark, d)).select("id", "rep_face_id", "member_count")


@query("soft_delete_missing", sql("fx_files", "fx_disk") + "SELECT id, is_deleted OR (root_id = 3 AND abs_path NOT IN (SELECT abs_path FROM fx_disk)) is_deleted FROM fx_files")
def soft_delete_missing(spark, d):
    return catalog.soft_delete_missing(view(spark, d, "fx_files"), 3, view(spark, d, "fx_disk")).select("id", "is_deleted")


@query("soft_delete_empty_seen", sql("fx_files") + "SELECT id, is_deleted OR root_id = 3 is_deleted FROM fx_files")
def soft_delete_empty_seen(spark, d):
    return catalog.soft_delete_missing(view(spark, d, "fx_files"), 3, view(spark, d, "fx_disk").limit(0)).select("id", "is_deleted")


@query("touch_seen", sql("fx_files", "fx_disk") + f"SELECT id, CASE WHEN abs_path IN (SELECT abs_path FROM fx_disk) THEN {NOW} ELSE last_seen_at END last_seen_at FROM fx_files")
def touch_seen(spark, d):
    return catalog.touch_seen(view(spark, d, "fx_files"), view(spark, d, "fx_disk"), now().cast("long")).select("id", "last_seen_at")


@query("touch_root", sql("fx_roots") + f"SELECT id, CASE WHEN id = 2 THEN {NOW} ELSE last_indexed_at END last_indexed_at FROM fx_roots")
def touch_root(spark, d):
    return catalog.touch_root(view(spark, d, "fx_roots"), 2, now().cast("long")).select("id", "last_indexed_at")


@query("toggle_invalidated", sql("fx_faces") + "SELECT id, CASE WHEN id = 20 THEN NOT invalidated ELSE invalidated END invalidated FROM fx_faces")
def toggle_invalidated(spark, d):
    return catalog.toggle(view(spark, d, "fx_faces"), 20).select("id", "invalidated")


def job_edges(spark, d):
    """Edges of the newest running job, of the newest done one, of an older running one, and of none."""
    running, done = (F.when(F.col("status") == s, F.col("id")) for s in ("running", "done"))
    some = view(spark, d, "fx_jobs").agg(F.max(running).alias("newest"), F.max(done).alias("done"), F.min(running).alias("oldest"))
    of = F.when(F.col("face_id") % 4 == 0, F.col("newest")).when(F.col("face_id") % 4 == 1, F.col("done")).when(F.col("face_id") % 4 == 2, F.col("oldest"))
    return edges(spark, d).crossJoin(F.broadcast(some)).withColumn("job_id", of).drop("newest", "done", "oldest")  # one row


def newest_running(spark, d) -> int:
    return view(spark, d, "fx_jobs").where("status = 'running'").agg(F.max("id")).first()[0]


_KEPT_EDGES = "SELECT job_id, face_id, nbr_face_id FROM job_edges WHERE NOT (coalesce(job_id = {own}, false) OR coalesce(job_id NOT IN (SELECT id FROM ({jobs}) WHERE status = 'running'), false))"


@query("orphan_edges_cleanup", sql("job_edges", "fx_jobs") + _KEPT_EDGES.format(own="(SELECT max(id) FROM fx_jobs WHERE status = 'running')", jobs="SELECT * FROM fx_jobs"))
def orphan_edges_cleanup(spark, d):
    return catalog.without_stale_edges(job_edges(spark, d), view(spark, d, "fx_jobs"), newest_running(spark, d)).select("job_id", "face_id", "nbr_face_id")


@query("orphan_edges_cleanup_none_running", sql("job_edges", "fx_jobs") + _KEPT_EDGES.format(own="-1", jobs="SELECT * FROM fx_jobs WHERE status <> 'running'"))
def orphan_edges_cleanup_none_running(spark, d):
    return catalog.without_stale_edges(job_edges(spark, d), view(spark, d, "fx_jobs").where("status <> 'running'"), -1).select("job_id", "face_id", "nbr_face_id")


@query("reset_counts", sql("fx_files", "fx_faces", "fx_jobs", "fx_roots") + "SELECT 'files' table_name, count(*) n FROM fx_files UNION ALL SELECT 'faces', count(*) FROM fx_faces UNION ALL SELECT 'jobs', count(*) FROM fx_jobs UNION ALL SELECT 'roots', count(*) FROM fx_roots")
def reset_counts(spark, d):
    return catalog.reset_counts({n: view(spark, d, f"fx_{n}") for n in ("files", "faces", "jobs", "roots")})


# --- jobs and statistics -----------------------------------------------------------------------------------------


@query("job_start_reclaim", sql("fx_jobs") + f"SELECT id, status, CASE WHEN hit THEN {NOW} ELSE started_at END started_at, CASE WHEN hit THEN '{{}}' ELSE stats END stats, CASE WHEN NOT hit THEN error END error FROM (SELECT *, coalesce(id = (SELECT max(id) FROM fx_jobs WHERE job_type = 'index_all' AND status = 'running'), false) hit FROM fx_jobs)")
def job_start_reclaim(spark, d):
    return jobs.start(view(spark, d, "fx_jobs"), "index_all", now()).select("id", "status", "started_at", "stats", "error")


@query("job_start_new", sql("fx_jobs") + f"SELECT id, job_type, status, started_at FROM fx_jobs UNION ALL SELECT max(id) + 1, 'export', 'running', {NOW} FROM fx_jobs")
def job_start_new(spark, d):
    return jobs.start(view(spark, d, "fx_jobs"), "export", now()).select("id", "job_type", "status", "started_at")


@query("job_finish", sql("fx_jobs") + f"SELECT id, CASE WHEN id = 10 THEN 'done' ELSE status END status, CASE WHEN id = 10 THEN {NOW} ELSE finished_at END finished_at, CASE WHEN id <> 10 THEN error END error FROM fx_jobs")
def job_finish(spark, d):
    return jobs.finish(view(spark, d, "fx_jobs"), 10, now()).select("id", "status", "finished_at", "error")


@query("latest_jobs", sql("fx_jobs") + "SELECT id, job_type, status FROM fx_jobs ORDER BY id DESC LIMIT 10")
def latest_jobs(spark, d):
    return jobs.latest(view(spark, d, "fx_jobs").select("id", "job_type", "status"))


@query("job_stats_fields", sql("fx_jobs") + "SELECT id, CAST(json_extract(stats, '$.k') AS BIGINT) k, len(json_keys(stats)) n_keys FROM fx_jobs")
def job_stats_fields(spark, d):
    return view(spark, d, "fx_jobs").select("id", F.get_json_object("stats", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("stats")).cast("long").alias("n_keys"))


@query("catalog_stats", sql("fx_files", "fx_faces", "groups", "fx_roots", recursive=True) + """SELECT count(*) FILTER (NOT is_deleted) photos_present, count(*) FILTER (is_deleted) photos_deleted, max(indexed_at) last_file_indexed, max(last_seen_at) last_scan,
  (SELECT count(*) FROM fx_faces WHERE NOT invalidated) faces, (SELECT count(*) FROM groups) AS "groups", (SELECT max(last_indexed_at) FROM fx_roots) last_root_indexed FROM fx_files""")
def catalog_stats(spark, d):
    return stats.catalog_stats(view(spark, d, "fx_files"), view(spark, d, "fx_faces"), built(spark, d)[0], view(spark, d, "fx_roots"))


@query("admin_counts", sql("fx_files", "fx_faces", "groups", "fx_roots", recursive=True) + "SELECT (SELECT count(*) FROM fx_roots WHERE enabled) roots_count, (SELECT count(*) FROM fx_files WHERE NOT is_deleted) files_count, (SELECT count(*) FROM fx_faces WHERE NOT invalidated) faces_count, (SELECT count(*) FROM groups) groups_count")
def admin_counts(spark, d):
    return stats.admin_counts(view(spark, d, "fx_roots"), view(spark, d, "fx_files"), view(spark, d, "fx_faces"), built(spark, d)[0])


@query("enabled_roots", sql("fx_roots") + "SELECT id, path, last_indexed_at FROM fx_roots WHERE enabled")
def enabled_roots(spark, d):
    return stats.enabled_roots(view(spark, d, "fx_roots")).select("id", "path", "last_indexed_at")


# --- scalar functions --------------------------------------------------------------------------------------------


@query("supported_images", sql("fx_files") + f"SELECT id, abs_path FROM fx_files WHERE {_SUPPORTED}")
def supported_images(spark, d):
    return view(spark, d, "fx_files").where(media.is_supported(F.col("abs_path"))).select("id", "abs_path")


@query("thumb_names", sql("fx_files") + "SELECT id, concat('files/', root_id, '/', replace(replace(rel_path, '/', '_'), '\\', '_'), '.jpg') file_thumb, concat('faces/', id, '_', id % 3, '.jpg') face_thumb FROM fx_files")
def thumb_names(spark, d):
    return view(spark, d, "fx_files").select("id", media.file_thumb(F.col("root_id"), F.col("rel_path")).alias("file_thumb"), media.face_thumb(F.col("id"), F.col("id") % 3).alias("face_thumb"))


_SIZE = "CAST(file_size AS DOUBLE) * pow(10, id % 13)"


@query("human_size", sql("fx_files") + f"SELECT id, CASE WHEN s < 1024 THEN format('{{:.1f}} B', s) WHEN s < pow(1024, 2) THEN format('{{:.1f}} KB', s / 1024) WHEN s < pow(1024, 3) THEN format('{{:.1f}} MB', s / pow(1024, 2)) WHEN s < pow(1024, 4) THEN format('{{:.1f}} GB', s / pow(1024, 3)) ELSE format('{{:.1f}} TB', s / pow(1024, 4)) END size FROM (SELECT id, {_SIZE} s FROM fx_files)")
def human_size(spark, d):
    return view(spark, d, "fx_files").select("id", media.human_size(F.expr(_SIZE)).alias("size"))


@query("bbox_scaled", sql("fx_faces") + "SELECT id, CAST(trunc(bbox_x1 * 1.37) AS INT) x1, CAST(trunc(bbox_y1 * 1.37) AS INT) y1, CAST(trunc(bbox_x2 * 1.37) AS INT) x2, CAST(trunc(bbox_y2 * 1.37) AS INT) y2 FROM fx_faces")
def bbox_scaled(spark, d):
    return view(spark, d, "fx_faces").select("id", *[geometry.scaled(F.col(f"bbox_{c}"), F.lit(1.37)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("bbox_padded", sql("fx_faces") + """SELECT id, x1, y1, greatest(x1 + 1, least(640, bbox_x2 + px)) x2, greatest(y1 + 1, least(480, bbox_y2 + py)) y2 FROM (
  SELECT *, greatest(0, least(639, bbox_x1 - px)) x1, greatest(0, least(479, bbox_y1 - py)) y1 FROM (
  SELECT *, CAST(trunc(CAST(bbox_x2 - bbox_x1 AS DOUBLE) * 0.15) AS INT) px, CAST(trunc(CAST(bbox_y2 - bbox_y1 AS DOUBLE) * 0.15) AS INT) py FROM fx_faces))""")
def bbox_padded(spark, d):
    box = geometry.padded(*[F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")], F.lit(640), F.lit(480))
    return view(spark, d, "fx_faces").select("id", *[b.alias(c) for b, c in zip(box, ("x1", "y1", "x2", "y2"))])


@query("resize_dims", sql("fx_files") + """SELECT id, CASE WHEN m <= 1600 THEN width ELSE greatest(1, CAST(round_even(width * (1600.0::DOUBLE / m), 0) AS INT)) END new_width,
  CASE WHEN m <= 1600 THEN height ELSE greatest(1, CAST(round_even(height * (1600.0::DOUBLE / m), 0) AS INT)) END new_height, round(CASE WHEN m <= 1600 THEN 1.0::DOUBLE ELSE 1 / (1600.0::DOUBLE / m) END, 6) back FROM (SELECT *, CAST(greatest(width, height) AS DOUBLE) m FROM fx_files)""")
def resize_dims(spark, d):
    w, h, back = geometry.detector_size(F.col("width"), F.col("height"), 1600)
    return view(spark, d, "fx_files").select("id", w.alias("new_width"), h.alias("new_height"), F.round(back, 6).alias("back"))


@query("exif_whitelist", sql("fx_files") + "SELECT id, concat('Model=', json_extract_string(exif, '$.Model'), CASE WHEN coalesce(json_extract_string(exif, '$.LensModel'), '') <> '' THEN concat('; LensModel=', json_extract_string(exif, '$.LensModel')) ELSE '' END, '; ISO=', json_extract_string(exif, '$.ISO')) shown, 3 n_kept FROM fx_files")
def exif_whitelist(spark, d):
    return view(spark, d, "fx_files").select("id", media.exif_shown(F.col("exif")).alias("shown"), F.size(media.exif_kept(F.col("exif"))).alias("n_kept"))


_DIGITS = "list_sum(list_transform(string_split(substr(sha256(abs_path), 1, 16), ''), lambda c: instr('123456789abcdef', c)))"


@query("ingest_fake_detector", sql("fx_disk", "fx_files") + f"""SELECT path, true ok, CASE WHEN n > 0 THEN CAST(k AS INT) END face_index, CASE WHEN n > 0 THEN 16 END n_dims
FROM (SELECT path, n, unnest(range(greatest(n, 1))) k FROM (SELECT abs_path path, CAST({_DIGITS} AS BIGINT) % 3 n FROM ({_DIFF}) WHERE "action" = 'enqueue'))""")
def ingest_fake_detector(spark, d):
    """Every enqueued file of the scan through detection; the made-up detector reads the path's bytes."""
    todo = diff(spark, d).where("action = 'enqueue'").select(F.col("abs_path").alias("path"), F.col("abs_path").cast("binary").alias("content"))
    return detect_faces(todo, FakeDetector(16)).select("path", "ok", "face_index", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims"))


@query("shown_time", sql("fx_jobs") + "SELECT id, CASE WHEN finished_at IS NULL THEN 'never' ELSE strftime(make_timestamp(CAST(finished_at AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S UTC') END shown FROM fx_jobs")
def shown_time(spark, d):
    return view(spark, d, "fx_jobs").select("id", media.shown_time(F.timestamp_seconds("finished_at"), "UTC").alias("shown"))


@query(
    "html_escaped",
    """SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') shown,
  starts_with(target, '/') AND substr(target, 2, 1) NOT IN ('/', chr(92)) local FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/' || url ELSE '//' || url END target FROM pages)""",
)
def html_escaped(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    target = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), "url")).otherwise(F.concat(F.lit("//"), "url"))
    return pages.select("page_id", media.html_escaped(F.col("url")).alias("shown"), media.is_local(target).alias("local"))
