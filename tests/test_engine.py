import threading
import time

import numpy as np
import pytest

from kinora.config import Settings
from kinora.engine import Catalog
from kinora.sources.ingest import FakeDetector
from tests.test_images import png


class Same(FakeDetector):
    """Equal bytes have equal faces, so copies of a file are near each other."""


def test_index_rebuild_search_and_reset(spark, tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    contents = [b"a", b"b", b"c", b"d", b"e", b"f"]
    for k, data in enumerate(contents * 2):
        (root / f"p{k}.jpg").write_bytes(data)
    (root / "bad.png").write_bytes(b"")
    (root / "notes.txt").write_bytes(b"x")
    catalog, detector = Catalog(spark, str(tmp_path / "store"), Settings(group_threshold=0.99, block_size=4)), Same(8)
    catalog.init()
    assert catalog.add_root(str(root)) == catalog.add_root(str(root)) == 1

    counts = catalog.index(detector)
    assert (counts["files_seen"], counts["files_enqueued"], counts["files_reindexed"], counts["errors"]) == (13, 13, 12, 1)
    per_file = [len(detector.detect(c)) for c in contents]
    assert catalog.table("faces").count() == 2 * sum(per_file) > 0
    again = catalog.index(detector)
    assert (again["files_skipped"], again["files_enqueued"]) == (12, 1)

    built = catalog.rebuild()
    assert built["groups_created"] == sum(per_file) and built["members_assigned"] == 2 * sum(per_file)
    assert catalog.group_list().count() == sum(per_file) and catalog.group_detail(1).count() == 2
    assert catalog.group_summary().collect() == [(2, sum(per_file))]
    image = next(c for c in contents if detector.detect(c))
    best = catalog.search_image(image, detector, 2).collect()
    assert len(best) == 2 and all(abs(r.similarity - 1) < 1e-6 for r in best) and len({r.group_id for r in best}) == 1
    with pytest.raises(ValueError):
        catalog.search_image(next(c for c in (bytes([k]) for k in range(99)) if not detector.detect(c)), detector)

    assert catalog.toggle(best[0].face_id) is True and catalog.toggle(10**6) is None
    assert catalog.search_image(image, detector, 2).first().face_id == best[1].face_id
    assert catalog.toggle(best[0].face_id) is False

    (root / "p0.jpg").unlink()
    catalog.index(detector)
    row = catalog.stats().first()
    assert (row.photos_present, row.photos_deleted, row.faces) == (11, 1, 2 * sum(per_file))
    counts, roots, latest, size = catalog.admin()
    assert counts.first().files_count == 11 and roots.count() == 1 and size > 0
    assert {r.status for r in latest.collect()} == {"done"}
    with pytest.raises(ValueError):
        catalog.index(detector, batch_size=0)
    assert catalog.reset()["files"] == 12 and catalog.table("files").count() == 0 and catalog.list_roots().count() == 1


class Slow(FakeDetector):
    def detect(self, content):
        time.sleep(60)
        return []


class Broken(FakeDetector):
    def load(self):
        raise RuntimeError("no model")


def test_a_job_can_be_stopped_and_a_failed_one_says_so(spark, tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    (root / "a.png").write_bytes(png(30, 20))
    catalog = Catalog(spark, str(tmp_path / "store"))
    catalog.init()
    catalog.add_root(str(root))
    seen = []

    def stop():
        while not seen or seen[-1] is None:
            time.sleep(1)
            found = catalog.table("jobs").where("status = 'running' and stats like '%files_seen%'").first()
            seen.append(found.id if found else None)
        time.sleep(3)
        catalog.stop(seen[-1])

    other = threading.Thread(target=stop)
    other.start()
    began = time.time()
    with pytest.raises(Exception, match="cancelled"):
        catalog.index(Slow(4))
    other.join()
    assert time.time() - began < 55
    with pytest.raises(Exception, match="no model"):
        catalog.index(Broken(4))
    table = {r.id: (r.status, "no model" in (r.error or "")) for r in catalog.table("jobs").collect()}
    assert table == {1: ("interrupted", False), 2: ("failed", True)} and catalog.table("files").count() == 0
    assert catalog.index(FakeDetector(4))["files_reindexed"] == 1


class Ppm:
    """A codec for the plainest format, so that pixels can be followed through the engine."""

    def decode(self, content, name=""):
        kind, width, height, _, rest = content.split(b"\n", 4)
        assert kind == b"P6"
        return np.frombuffer(rest, dtype=np.uint8).reshape(int(height), int(width), 3)

    def encode(self, pixels):
        return b"P6\n%d\n%d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


class Brightest:
    """Finds one face, the box of the white pixels, and takes the shrunk image's size for its embedding."""

    pixels = True

    def load(self):
        return self

    def detect(self, pixels):
        rows, columns = np.nonzero(pixels.min(axis=2) > 200)
        if not len(rows):
            return []
        v = np.array([pixels.shape[0], pixels.shape[1], 1.0])
        return [{"bbox": [columns.min(), rows.min(), columns.max() + 1, rows.max() + 1], "det_score": 0.9, "embedding": v / np.linalg.norm(v)}]


def picture(width, height, box=None):
    pixels = np.full((height, width, 3), 40, dtype=np.uint8)
    if box:
        pixels[box[1] : box[3], box[0] : box[2]] = 255
    return Ppm().encode(pixels)


def test_pixels_sizes_and_thumbnails(spark, tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    (root / "large.png").write_bytes(picture(800, 400, (200, 100, 400, 300)))
    (root / "none.png").write_bytes(picture(50, 60))
    (root / "bad.png").write_bytes(b"P6\n1")
    catalog = Catalog(spark, str(tmp_path / "store"), Settings(max_detect_side=200, embedding_dimension=3), Ppm())
    catalog.init()
    catalog.add_root(str(root))
    counts = catalog.index(Brightest())
    assert (counts["files_reindexed"], counts["errors"]) == (2, 1)
    (face,) = catalog.table("faces").collect()
    assert (face.bbox_x1, face.bbox_y1, face.bbox_x2, face.bbox_y2) == (200, 100, 400, 300)
    thumbs = tmp_path / "store" / "thumbs"
    crop = Ppm().decode((thumbs / face.face_thumb_rel).read_bytes())
    assert crop.shape == (256, 256, 3) and crop[128, 128].tolist() == [255] * 3 and crop[2, 2].tolist() == [40] * 3
    names = {r.rel_path: r.file_thumb_rel for r in catalog.table("files").collect()}
    assert Ppm().decode((thumbs / names["large.png"]).read_bytes()).shape == (160, 320, 3)
    assert Ppm().decode((thumbs / names["none.png"]).read_bytes()).shape == (60, 50, 3)
    best = catalog.search_image((root / "large.png").read_bytes(), Brightest()).first()
    assert abs(best.similarity - 1) < 1e-6  # a query is shrunk as an indexed file is
    again = catalog.index(Brightest(), fresh=True)
    assert again["files_reindexed"] == 2 and catalog.table("faces").first().face_thumb_rel == face.face_thumb_rel
    catalog.reset()
    assert not thumbs.exists()


def test_without_a_codec_there_are_sizes_and_no_names_of_thumbnails(spark, tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    (root / "a.png").write_bytes(png(30, 20))
    catalog = Catalog(spark, str(tmp_path / "store"))
    catalog.codec = None
    catalog.init()
    catalog.add_root(str(root))
    catalog.index(FakeDetector(4))
    (row,) = catalog.table("files").collect()
    assert (row.width, row.height, row.exif, row.file_thumb_rel) == (30, 20, "{}", None)
    assert catalog.table("faces").where("face_thumb_rel is not null").count() == 0
    assert catalog.index(Brightest(), fresh=True)["errors"] == 1
