"""Catalog tables derived from the driver's tables, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The neighbour threshold of the queries: at the product's default these vectors have hardly any edge.
THETA = 0.4
NOW = 1800000000

EXPRESSIONS = {
    "fx_files": (
        "documents",
        {
            "id": "doc_id",
            "root_id": "CAST(substr(source, 4) AS BIGINT)",
            "rel_path": "{rel}",
            "abs_path": "concat('/photos/', source, '/', {rel})",
            "file_size": "n_chars",
            "mtime": "CAST(1704067200 + doc_id * 60 AS DOUBLE)",
            "width": "CAST(800 + doc_id % 4000 AS INT)",
            "height": "CAST(600 + doc_id % 3000 AS INT)",
            "exif": "concat('{{\"Model\":\"M', CAST(doc_id % 7 AS {string}), '\",\"ISO\":', CAST(100 * (doc_id % 5) AS {string}), ',\"LensModel\":', CASE WHEN doc_id % 3 = 0 THEN 'null' WHEN doc_id % 3 = 1 THEN '\"\"' ELSE '\"L2\"' END, ',\"Other\":\"x\"}}')",
            "file_thumb_rel": "concat('files/', CAST(CAST(substr(source, 4) AS BIGINT) AS {string}), '/', CAST(doc_id AS {string}), '.jpg')",
            "indexed_at": "1704067200 + doc_id * 61",
            "last_seen_at": "1704067200 + doc_id * 67",
            "is_deleted": "doc_id % 11 = 5",
        },
    ),
    "fx_faces": (
        "embeddings",
        {
            "id": "vec_id",
            "file_id": "vec_id % 200",
            "face_index": "CAST(floor(vec_id / 200) AS INT)",
            "bbox_x1": "CAST(vec_id % 1000 - 40 AS INT)",
            "bbox_y1": "CAST(vec_id % 700 - 30 AS INT)",
            "bbox_x2": "CAST(vec_id % 1000 - 40 + vec_id % 300 AS INT)",
            "bbox_y2": "CAST(vec_id % 700 - 30 + vec_id % 200 AS INT)",
            "det_score": "CAST((vec_id * 53) % 97 AS DOUBLE) / 100",
            "quality_score": "CASE WHEN vec_id % 23 <> 0 THEN CAST((vec_id * 37) % 101 AS DOUBLE) / 100 END",
            "embedding": "embedding",
            "face_thumb_rel": "concat('faces/', CAST(vec_id % 200 AS {string}), '_', CAST(CAST(floor(vec_id / 200) AS INT) AS {string}), '.jpg')",
            "invalidated": "vec_id % 17 = 3",
        },
    ),
    "fx_jobs": (
        "events",
        {
            "id": "event_id",
            "job_type": "CASE WHEN event_id % 2 = 0 THEN 'index_all' ELSE 'group_rebuild' END",
            "status": "CASE event_type WHEN 'error' THEN 'running' WHEN 'view' THEN 'interrupted' ELSE 'done' END",
            "started_at": "1704067200 + event_id",
            "finished_at": "CASE WHEN event_type NOT IN ('error', 'view') THEN 1704067300 + event_id END",
            "stats": "props",
            "error": "CASE WHEN event_id % 50 = 7 THEN 'failed' END",
        },
    ),
}
_REL = "concat(lang, '/', CAST(doc_id AS {string}), CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.CR2' WHEN 2 THEN '.png' WHEN 3 THEN '.heic' ELSE '.txt' END)"


def _select(name: str, string: str) -> tuple[str, list[str]]:
    source, columns = EXPRESSIONS[name]
    filled = {c: e.replace("{rel}", _REL) for c, e in columns.items()}
    return source, [f"{e.replace('{string}', string).replace('{{', '{').replace('}}', '}')} AS {c}" for c, e in filled.items()]


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived table."""
    if name == "fx_roots":
        files = view(spark, folder, "fx_files").select("root_id").distinct()
        return files.selectExpr("root_id AS id", "concat('/photos/src', root_id) AS path", "root_id % 4 <> 3 AS enabled", "1704067200 + root_id AS created_at", "CASE WHEN root_id % 5 <> 0 THEN 1704100000 + root_id END AS last_indexed_at")
    if name == "fx_disk":
        files = view(spark, folder, "fx_files").where("id % 7 <> 2")
        old = files.selectExpr("root_id", "rel_path", "abs_path", "CASE WHEN id % 13 = 0 THEN file_size + 1 ELSE file_size END AS size", "mtime + CASE WHEN id % 5 = 1 THEN 0.0005D WHEN id % 19 = 4 THEN 0.002D ELSE 0D END AS mtime")
        new = files.where("id % 9 = 1").selectExpr("root_id", "concat('new/', id, '.jpeg') AS rel_path", "concat('/photos/src', root_id, '/new/', id, '.jpeg') AS abs_path", "file_size AS size", "mtime")
        return old.unionByName(new)
    if name == "fx_faces_scaled":
        return view(spark, folder, "fx_faces").selectExpr("*", "transform(embedding, x -> CAST(x * (1 + id % 3) AS FLOAT)) AS scaled").drop("embedding").withColumnRenamed("scaled", "embedding")
    source, columns = _select(name, "STRING")
    return spark.read.parquet(f"{folder}/{source}.parquet").selectExpr(*columns)


def sql(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the named tables, and those they need, in DuckDB's dialect."""
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        if name in parts:
            return
        for other in NEEDS.get(name, ()):
            need(other)
        if name in MORE:
            parts[name] = MORE[name]
        else:
            source, columns = _select(name, "VARCHAR")
            parts[name] = f"SELECT {', '.join(columns)} FROM {source}"

    for name in names:
        need(name)
    heads = {"reach": "reach(x, y)"}
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{heads.get(n, n)} AS ({body})" for n, body in parts.items()) + "\n"


MORE = {
    "fx_roots": "SELECT DISTINCT root_id AS id, concat('/photos/src', root_id) AS path, root_id % 4 <> 3 AS enabled, 1704067200 + root_id AS created_at, CASE WHEN root_id % 5 <> 0 THEN 1704100000 + root_id END AS last_indexed_at FROM fx_files",
    "fx_disk": """SELECT root_id, rel_path, abs_path, CASE WHEN id % 13 = 0 THEN file_size + 1 ELSE file_size END AS size,
  mtime + CAST(CASE WHEN id % 5 = 1 THEN 0.0005 WHEN id % 19 = 4 THEN 0.002 ELSE 0 END AS DOUBLE) AS mtime FROM fx_files WHERE id % 7 <> 2
  UNION ALL SELECT root_id, concat('new/', id, '.jpeg'), concat('/photos/src', root_id, '/new/', id, '.jpeg'), file_size, mtime FROM fx_files WHERE id % 7 <> 2 AND id % 9 = 1""",
    "fx_faces_scaled": "SELECT * REPLACE (list_transform(embedding, lambda x: CAST(x * (1 + id % 3) AS FLOAT)) AS embedding) FROM fx_faces",
    "live": "SELECT f.* FROM fx_faces f JOIN fx_files fi ON fi.id = f.file_id WHERE NOT f.invalidated AND NOT fi.is_deleted",
    "sims": "SELECT a.id q, b.id n, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) s FROM live a CROSS JOIN live b",
    "edges": f"SELECT q face_id, n nbr_face_id, s similarity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) place FROM sims) WHERE place <= 20 AND q <> n AND s >= {THETA}",
    "both_ways": "SELECT face_id x, nbr_face_id y FROM edges UNION SELECT nbr_face_id, face_id FROM edges",
    "reach": "SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x",
    "member": "SELECT x face_id, least(x, min(y)) component FROM reach GROUP BY x",
    "sized": "SELECT component, count(*) member_count FROM member GROUP BY component",
    "chosen": "SELECT component, face_id rep_face_id FROM (SELECT component, face_id, row_number() OVER (PARTITION BY component ORDER BY coalesce(quality_score, 0) DESC, face_id) place FROM member JOIN live ON live.id = face_id) WHERE place = 1",
    "groups": "SELECT row_number() OVER (ORDER BY member_count DESC, component) id, component, rep_face_id, member_count FROM sized JOIN chosen USING (component)",
    "members": "SELECT g.id group_id, m.face_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) score_to_rep FROM member m JOIN groups g USING (component) JOIN live a ON a.id = m.face_id JOIN live b ON b.id = g.rep_face_id",
    "job_edges": "SELECT CASE face_id % 4 WHEN 0 THEN (SELECT max(id) FROM fx_jobs WHERE status = 'running') WHEN 1 THEN (SELECT max(id) FROM fx_jobs WHERE status = 'done') WHEN 2 THEN (SELECT min(id) FROM fx_jobs WHERE status = 'running') END job_id, face_id, nbr_face_id, similarity FROM edges",
}
NEEDS = {
    "fx_roots": ("fx_files",), "fx_disk": ("fx_files",), "fx_faces_scaled": ("fx_faces",), "live": ("fx_faces", "fx_files"), "sims": ("live",), "edges": ("sims",), "both_ways": ("edges",),
    "reach": ("both_ways",), "member": ("reach",), "sized": ("member",), "chosen": ("member", "live"), "groups": ("sized", "chosen"), "members": ("member", "groups", "live"), "job_edges": ("edges", "fx_jobs"),
}
