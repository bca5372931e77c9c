import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinora import schema
from kinora.config import Settings
from kinora.functions import geometry, media, vectors
from kinora.operators import catalog, groups, jobs, knn, scan, search, stats
from kinora.plans import fixtures
from kinora.sources import files as listings
from kinora.sources.ingest import FakeDetector, detect_faces
from kinora.sources.versions import Store
from kinora.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def faces(spark, vectors_, quality=None):
    quality = quality or [None] * len(vectors_)
    return spark.createDataFrame([(k, [float(x) for x in v], q) for k, (v, q) in enumerate(zip(vectors_, quality))], "id long, embedding array<float>, quality_score double")


def plain_knn(x, k, threshold):
    out = set()
    sims = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    for q in range(len(x)):
        best = sorted(range(len(x)), key=lambda n: (-sims[q, n], n))[:k]
        out |= {(q, n) for n in best if n != q and sims[q, n] >= threshold}
    return out


@pytest.mark.parametrize("k", [1, 3, 20])
def test_knn_does_not_depend_on_blocks(spark, k):
    x = np.random.default_rng(1).standard_normal((60, 8))
    x[10:30] = x[5]
    want = plain_knn(x, k, 0.4)
    for size in (7, 2048):
        assert {(r.face_id, r.nbr_face_id) for r in knn.knn_edges(faces(spark, x), k, 0.4, size).collect()} == want
    assert {(r.face_id, r.nbr_face_id) for r in knn.knn_edges_by_window(faces(spark, x), k, 0.4).collect()} == want


def ranked(x, k, threshold):
    """{(face, neighbour): similarity} with products added up in the order of components and NaN before all else."""
    x, out = x.astype(float), {}
    with np.errstate(over="ignore", invalid="ignore"):
        sims = sum((x[:, c : c + 1] * x[:, c] for c in range(x.shape[1])), np.zeros((len(x), len(x))))
    for q in range(len(x)):
        best = np.lexsort((np.arange(len(x)), -sims[q], ~np.isnan(sims[q])))[:k]
        out |= {(q, int(n)): sims[q, n] for n in best if n != q and not sims[q, n] < threshold}
    return out


def by_stripes(x, k, threshold, stripes):
    at, ids = np.random.default_rng(3).integers(0, stripes, len(x)), np.random.default_rng(4).permutation(len(x))
    lists = []
    for i, j in [(i, j) for i in range(stripes) for j in range(i, stripes)]:
        some = ids[(at[ids] == i) | (at[ids] == j)]
        table = pa.table({"id": some, "embedding": pa.array(list(x[some])), "stripe": at[some], "i": np.full(len(some), i), "j": np.full(len(some), j)})
        lists.append(knn._both_ways(table, k, threshold))
    batches = knn._merged(iter(pa.concat_tables(lists).to_batches()), k)
    return {(f, n): v for b in batches for f, n, v in zip(*[c.to_pylist() for c in b.columns])}


def test_knn_sends_a_vector_a_fixed_number_of_times():
    assert [knn.stripes_of(n, 64, 2048) for n in (0, 2000, 10_000, 87_000, 520_000, 1_000_000)] == [1, 1, 5, 16, 16, 16]
    assert knn.stripes_of(4_000_000, 64, 2048) * knn.STRIPE_BYTES >= 4_000_000 * 256  # two stripes fit a task


@pytest.mark.parametrize("k, threshold", [(1, 0.4), (3, -1e9), (20, 0.4), (200, 0.0)])
def test_knn_equals_brute_force_on_odd_vectors(monkeypatch, k, threshold):
    random = np.random.default_rng(0)
    x = random.standard_normal((180, 16))
    copies, odd, near = x.astype(np.float32), x.copy(), x[0] + 1e-7 * x
    copies[50:90], copies[90:140] = copies[5], copies[6]
    odd[3], odd[4], odd[5, 2], odd[6, 1], odd[7] = 1e200, -1e200, np.nan, np.inf, 0
    odd[8] *= 1e-30
    for v in (copies, odd, near, near.astype(np.float32), np.round(x), np.eye(16)[random.integers(0, 16, 180)]):
        want = ranked(v, k, threshold)
        for tile, stripes, found, again in (((256, 2048), 1, 1 << 20, 1 << 16), ((16, 32), 3, 50, 20), ((7, 13), 2, 1000, 1)):
            for name, value in (("TILE", tile), ("FOUND", found), ("AGAIN", again)):
                monkeypatch.setattr(knn, name, value)
            got = by_stripes(v, k, threshold, stripes)
            assert got.keys() == want.keys()
            np.testing.assert_array_equal([got[p] for p in want], list(want.values()))


def test_knn_gives_the_bits_of_sql(spark):
    x = np.random.default_rng(2).standard_normal((300, 64)).astype(np.float32)
    want = ranked(x, 20, 0.4)
    for size in (40, 2048):
        assert {(r.face_id, r.nbr_face_id): r.similarity for r in knn.knn_edges(faces(spark, x), 20, 0.4, size).collect()} == want
    t = pa.table({"id": np.arange(300), "v": pa.array(list(x))})
    sql = duckdb.sql("SELECT a.id, b.id, list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) FROM t a, t b").fetchall()
    assert want.items() <= {(q, n): s for q, n, s in sql}.items() and len(t) == 300


def test_knn_refuses_vectors_of_different_lengths(spark):
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, None)], "id long, embedding array<float>")
    with pytest.raises(ValueError, match="2 to 4 components"):
        knn.knn_edges(ragged, 3, 0.1)


def test_knn_of_few_faces(spark):
    assert knn.knn_edges(faces(spark, np.zeros((0, 3))), 5, 0.1).count() == 0
    assert knn.knn_edges(faces(spark, np.ones((1, 3))), 5, 0.1).count() == 0
    assert {(r[0], r[1]) for r in knn.knn_edges(faces(spark, np.ones((2, 3))), 5, 3.0).collect()} == {(0, 1), (1, 0)}


def test_groups_order_representatives_and_scores(spark):
    x = np.eye(8)
    edges = spark.createDataFrame([(7, 6, 1.0), (1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "face_id long, nbr_face_id long, similarity double")
    found, members = groups.build_groups(faces(spark, x, [None, 0.2, None, 0.2, -1.0, None, None, None]), edges)
    assert rows(found.select("id", "rep_face_id", "member_count")) == [(1, 1, 3), (2, 5, 2), (3, 6, 2)]
    assert {(r.group_id, r.face_id): r.score_to_rep for r in members.collect()}[1, 1] == 1.0
    assert rows(groups.group_summary(found)) == [(2, 2), (3, 1)]


def test_numbers_follow_the_order_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert rows(catalog.numbered(df, F.desc("x"))) == sorted([(x, 1000 - x) for x in range(1000)], key=str)


def test_upsert_keeps_ids_and_inserts_after_the_largest(spark):
    target = spark.createDataFrame([(3, "a", 1, "x"), (9, "b", 2, "y")], "id long, abs_path string, size long, note string")
    source = spark.createDataFrame([("b", 5), ("c", 6), ("aa", 7), ("c", 4)], "abs_path string, size long")
    out = catalog.merge_upsert(target, source, ["abs_path"], when_new={"note": F.lit("new")})
    assert rows(out) == [(10, "aa", 7, "new"), (11, "c", 6, "new"), (3, "a", 1, "x"), (9, "b", 5, "y")]
    assert rows(catalog.merge_upsert(target, source.limit(0), ["abs_path"])) == rows(target)


def test_replaced_children_cascade(spark):
    kids = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 2, 0)], "id long, file_id long, face_index int")
    touched = spark.createDataFrame([(1,)], "file_id long")
    out = catalog.replace_children(kids, spark.createDataFrame([(1, 0)], "file_id long, face_index int"), "file_id", touched)
    assert rows(out) == [(3, 2, 0), (4, 1, 0)]
    found = spark.createDataFrame([(1, 1, 3), (2, 3, 2)], "id long, rep_face_id long, member_count long")
    assert rows(catalog.released_representatives(found, out)) == [(1, None, 3), (2, 3, 2)]
    pairs = spark.createDataFrame([(1, 3), (3, 4), (2, 4)], "face_id long, nbr_face_id long")
    assert rows(catalog.surviving(pairs, out, "face_id", "nbr_face_id")) == [(3, 4)]


def test_stale_edges_with_and_without_running_jobs(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (None, 4, 5)], "job_id long, face_id long, nbr_face_id long")
    table = spark.createDataFrame([(1, "running"), (2, "done"), (3, "running")], "id long, status string")
    assert rows(catalog.without_stale_edges(edges, table, 3)) == sorted([(1, 1, 2), (None, 4, 5)], key=str)
    assert rows(catalog.without_stale_edges(edges, table.where("id = 2"), 3)) == []


def test_deletes_touches_and_toggles(spark):
    table = spark.createDataFrame([(1, 1, "a", False, 0), (2, 1, "b", False, 0), (3, 2, "c", False, 0), (4, 1, "d", True, 0)], "id long, root_id long, abs_path string, is_deleted boolean, last_seen_at long")
    seen = spark.createDataFrame([("a",), ("a",)], "abs_path string")
    assert [r[3] for r in rows(catalog.soft_delete_missing(table, 1, seen))] == [False, True, False, True]
    assert [r[3] for r in rows(catalog.soft_delete_missing(table, 1, seen.limit(0)))] == [True, True, False, True]
    assert [r[4] for r in rows(catalog.touch_seen(table, seen, F.lit(5)))] == [5, 0, 0, 0]
    flags = spark.createDataFrame([(1, False), (2, True)], "id long, invalidated boolean")
    assert rows(catalog.toggle(flags, 2)) == [(1, False), (2, False)] and rows(catalog.toggle(flags, 9)) == rows(flags)
    assert rows(catalog.invalidate(flags, 1)) == [(1, True), (2, True)] and rows(catalog.restore(flags, 2)) == [(1, False), (2, False)]
    assert catalog.emptied({"files": table, "roots": flags})["roots"].count() == 2 and catalog.emptied({"files": table})["files"].count() == 0


def test_jobs(spark):
    table = spark.createDataFrame([(1, "x", "running", 1, None, "{}", None), (2, "x", "running", 2, None, "{}", "e"), (3, "x", "interrupted", 3, None, "{}", None)], "id long, job_type string, status string, started_at long, finished_at long, stats string, error string")
    assert [r for r in rows(jobs.start(table, "x", F.lit(9))) if r[3] == 9] == [(2, "x", "running", 9, None, "{}", None)]
    assert rows(jobs.start(table, "y", F.lit(9)))[-1][:4] == (4, "y", "running", 9)
    assert rows(jobs.start(table.limit(0), "y", F.lit(9)))[0][0] == 1
    assert rows(jobs.finish(table, 1, F.lit(9), stats='{"n":1}'))[0] == (1, "x", "done", 1, 9, '{"n":1}', None)
    assert [r.id for r in jobs.latest(table, 2).collect()] == [3, 2]


def test_scan_classes_and_budget(spark):
    disk = spark.createDataFrame([(2, "a.jpg", "/2/a.jpg", 1, 5.0), (1, "b.CR2", "/1/b.CR2", 1, 5.0), (1, "c.txt", "/1/c.txt", 1, 5.0), (1, "a.png", "/1/a.png", 1, 5.0009), (1, "d.png", "/1/d.png", 1, 5.0011), (1, ".jpg", "/1/.jpg", 1, 1.0)], listings.SCHEMA)
    known = spark.createDataFrame([("/1/b.CR2", 1, 5.0, True), ("/1/a.png", 1, 5.0, False), ("/1/d.png", 1, 5.0, False)], "abs_path string, file_size long, mtime double, is_deleted boolean")
    found = scan.classified(disk, known)
    assert {r.rel_path: r.action for r in found.collect()} == {"a.jpg": "enqueue", "b.CR2": "enqueue", "a.png": "skip", "d.png": "enqueue"}
    assert {r.rel_path: r.action for r in scan.budgeted(found, 1).collect()} == {"a.jpg": "defer", "b.CR2": "enqueue", "a.png": "skip", "d.png": "defer"}
    assert tuple(scan.counters(scan.budgeted(found, 1)).first()) == (4, 1, 1, 2)
    assert scan.classified(disk, known, fresh=True).where("action = 'skip'").count() == 0


def test_geometry(spark):
    lit = [F.lit(x) for x in (-10, 5, 3, 5)]
    box = geometry.padded(*lit, F.lit(100), F.lit(50))
    size = geometry.detector_size(F.lit(3200), F.lit(1), 1600) + geometry.detector_size(F.lit(1600), F.lit(9), 1600) + geometry.detector_size(F.lit(2000), F.lit(1875 * 2 + 2), 1600)
    row = spark.range(1).select(*box, geometry.scaled(F.lit(-7), F.lit(0.5)), *size).first()
    assert tuple(row)[:5] == (0, 5, 4, 6, -3) and tuple(row)[5:11] == (1600, 1, 2.0, 1600, 9, 1.0) and row[12] == 1600


def test_media(spark):
    df = spark.createDataFrame([("a/b.JPG", 1023, '{"Make":"","Model":"M","ISO":100,"X":1,"LensModel":null}'), ("a_b.jpg", 1280, "{}"), ("x\\y", 1024**5 * 3, None)], "p string, n long, e string")
    got = df.select(media.file_thumb(F.lit(1), F.col("p")), media.is_supported(F.col("p")), media.human_size(F.col("n")), media.exif_shown(F.col("e")), F.size(media.exif_kept(F.col("e")))).collect()
    assert [tuple(r) for r in got] == [("files/1/a_b.JPG.jpg", True, "1023.0 B", "Model=M; ISO=100", 4), ("files/1/a_b.jpg.jpg", True, "1.2 KB", "", 0), ("files/1/x_y.jpg", False, "3072.0 TB", "", got[2][4])]
    assert spark.range(1).select(media.shown_time(F.lit(None).cast("timestamp"))).first()[0] == "never"


def test_cosine_of_a_zero_vector_is_nan_and_sorts_last(spark):
    people = faces(spark, [[0, 0], [1, 0], [2, 2]]).withColumns({"file_id": F.lit(1).cast("long"), "invalidated": F.col("id") == 9, "face_thumb_rel": F.lit("t")})
    files = spark.createDataFrame([(1, "t", "/a", "a", "{}", False)], "id long, file_thumb_rel string, abs_path string, rel_path string, exif string, is_deleted boolean")
    assert [r.face_id for r in search.search([1.0, 0.1], people, files, 2).collect()] == [1, 2]
    assert spark.range(1).select(F.isnan(vectors.cosine_distance(vectors.literal([0, 0]), vectors.literal([1, 0])))).first()[0]


def test_walk_follows_links_once(spark, tmp_path):
    (tmp_path / "r" / "b").mkdir(parents=True)
    (tmp_path / "r" / "b" / "x.jpg").write_bytes(b"12")
    (tmp_path / "r" / "a.txt").write_bytes(b"1")
    os.symlink(tmp_path / "r" / "b", tmp_path / "r" / "a")
    os.symlink(tmp_path / "r", tmp_path / "r" / "b" / "loop")
    got = listings.listing(spark, {4: str(tmp_path / "r")}).collect()
    assert sorted((r.root_id, r.rel_path, r.size) for r in got) == [(4, "a.txt", 1), (4, "a/x.jpg", 2)]


def test_detection_isolates_bad_files(spark):
    df = spark.createDataFrame([(f"f{k}", bytes([k])) for k in range(20)] + [("bad", b""), ("none", None)], "path string, content binary")
    got = detect_faces(df, FakeDetector(4)).collect()
    assert {r.path for r in got if not r.ok} == {"bad", "none"} and len({r.path for r in got}) == 22
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got if r.embedding is not None)


def test_store_and_stream_take_in_listings(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    disk = spark.createDataFrame([(1, "a.jpg", "/a.jpg", 1, 5.0), (1, "b.jpg", "/b.jpg", 1, 5.0)], listings.SCHEMA)
    disk.write.parquet(source)
    run = lambda: incremental.watch(spark.readStream.schema(listings.SCHEMA).parquet(source), store, str(tmp_path / "check")).awaitTermination()
    run()
    assert rows(store.read("files").select("id", "abs_path")) == [(1, "/a.jpg"), (2, "/b.jpg")]
    disk.where("rel_path = 'a.jpg'").withColumn("size", F.lit(7).cast("long")).write.mode("append").parquet(source)
    run()
    assert rows(store.read("files").select("id", "file_size")) == [(1, 7), (2, 1)] and store.size() > 0
    before = store.tables()
    incremental.take_in(store, disk.where("rel_path = 'b.jpg'"))
    assert store.tables() == before


def test_settings_and_schema_checks(spark):
    spark.conf.set("kinora.group_k", "7")
    assert Settings.of(spark).group_k == 7 and Settings.of(spark).group_threshold == 0.55
    spark.conf.unset("kinora.group_k")
    table = spark.createDataFrame([(1, [1.0]), (1, None), (None, [1.0, 2.0])], "id long, embedding array<float>")
    assert rows(schema.duplicates(table, ("id",))) == [(1, 2)] and schema.wrong_dimensions(table, 1).count() == 2
    for ddl in (schema.ROOTS, schema.FILES, schema.FACES, schema.GROUPS, schema.MEMBERS, schema.JOBS, schema.EDGES):
        assert spark.createDataFrame([], ddl).columns
    assert stats.has_table(spark, "no_such_table") is False
    assert fixtures.sql("edges").startswith("WITH ")
