import hashlib
import random

import numpy as np

from kinora.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def brute(pages):
    first = {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(page_id, first.get(data, page_id))
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        other = first.get(data)
        refers = other if other is not None and other != page_id and sum((h or "").encode() == data for _, _, h in pages) > 1 else None
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(8)
    bodies = ["", None, "short", "é" * 60, "x" * 100, "y" * 99, "WARC/1.0\r\n", "WARC/1.0\r\n" * 30, "a" * 200 + "\r\n\r\n" + FAKE, FAKE + FAKE, "WARC/1.0", "\r\n\r\n", "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc", "long " * 40000]
    pages = [(k, f"http://h/{k}", bodies[k % len(bodies)]) for k in range(60)]
    pages += [(k, rng.choice([None, "http://a\r\nWARC-Type: x", "", "ü"]), "".join(rng.choice("ab \r\nWARC/1.0") for _ in range(rng.randint(0, 300)))) for k in range(100, 140)]
    pages += [(None, "u", "x" * 100), (None, "u", "only null id " * 20), (None, "u", "only null id " * 20), (3, "again", bodies[3]), (4, "again", bodies[4])]
    return pages


def test_round_trip_with_magic_inside_payloads(spark):
    pages = fixture()
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("64k", "3k", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_record_over_several_splits_that_holds_whole_records(spark):
    """Then the archives are read again, here with other splits, and still no record is lost."""
    inner = FAKE.replace("hello", "h" * 400).replace("Length: 5", "Length: 400") * 40
    pages = [(k, "u", inner + "x" * k if k % 3 else "plain") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before, real, read = {n: spark.conf.get(n) for n in names}, warc.candidates, []

    def changing(spark, folder, every_value=False):
        read.append(every_value)
        spark.conf.set(names[0], ("2k", "5k")[len(read) % 2])
        return real(spark, folder, every_value)

    try:
        spark.conf.set(names[1], "0")
        warc.candidates = changing
        assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(pages)
        assert read == [False, True]
    finally:
        warc.candidates = real
        for n, v in before.items():
            spark.conf.set(n, v)


def test_damaged_records_hide_only_what_follows_in_their_file(spark, tmp_path):
    good = [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Length: 7\r\n\r\n\r\n\r\nabc\r\n\r\n" for k in range(6)]
    (tmp_path / "a.warc").write_bytes("".join(good[:3]).encode())
    (tmp_path / "b.warc").write_bytes((good[3] + good[4].replace("Length: 7", "Length: 9") + good[5]).encode())
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == [0, 1, 2, 3, 4]


def test_ids_beyond_double_precision(spark):
    pages = [((1 << 60) + k, "u", "y" * 200) for k in range(3)] + [(-5, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(pages)


def test_only_the_chain_from_the_start_is_reached():
    starts, successors = np.array([0, 10, 15, 20, 40, 50]), np.array([20, 15, 20, 40, 90, 60])
    assert warc.reachable(starts, successors).tolist() == [True, False, False, True, True, False]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]
    assert warc.reachable(np.zeros(0, dtype=int), np.zeros(0, dtype=int)).tolist() == []
    assert warc.last_of(starts, successors).tolist() == [4, 4, 4, 4, 4, 5]
    n = 5000
    assert warc.reachable(np.arange(n) * 7, np.arange(1, n + 1) * 7).all()


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
