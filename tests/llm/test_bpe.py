import base64
import gc
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

P = pytest.importorskip("public_tokenizers")

from kinora.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def table():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Bpe.parse(f.read())


@pytest.fixture(scope="module")
def independent(table):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    kinds = ["ab", "a", "abc '", "the an on", "é ñ'sdtrvelm \n\t", "0123456789²½", "😀日本 語", "'\"!! s", "  　x\x1c"]
    for _ in range(1500):
        letters = rng.choice(kinds)
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([5, 40, 400]))))
    yield from ["a" * 5000, "ab" * 3000, "the" * 2000, " " * 999, "'" * 50, "'ll've'x", "x 's\n's 're're"]


def test_same_ids_as_an_independent_encoder(table, independent):
    found = list(texts())
    for k in range(0, len(found), 100):
        part = found[k : k + 100]
        ids, ends = table.encode_batch(part)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [independent.encode_ordinary(x) for x in part]
        assert table.decode_batch(ids, ends) == [x.encode() for x in part]


def test_joining_is_associative_and_equals_encoding_the_whole(table, independent):
    rng = random.Random(6)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("abthe ion") for _ in range(rng.randint(0, 30))).encode() for _ in range(3))
        x, y, z = (table._merge(s) for s in (a, b, c))
        assert table.join(table.join(x, y), z) == table.join(x, table.join(y, z)) == table._merge(a + b + c)


def test_heap_and_scan_merge_alike(table):
    rng = random.Random(7)
    for _ in range(200):
        data = "".join(rng.choice("abthe ion") for _ in range(rng.randint(33, 90))).encode()
        assert table._merge(data) == table._merge_short(data)


def test_query_on_nulls_empty_repeated_and_long_texts(spark, independent):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "the end", "z"), (3, "long word" * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken")).drop("token_ids").collect()
    want = []
    for doc_id, text, _ in rows:
        ids = independent.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_tokens_as_rows(spark, independent):
    docs = spark.createDataFrame([(1, "a cat's tale"), (2, None)], "doc_id long, text string")
    tokens = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"))
    assert {r.doc_id: r.token_ids for r in tokens.collect()} == {1: independent.encode_ordinary("a cat's tale"), 2: []}
    assert {r.doc_id: bytes(r.text) for r in bpe.decode(tokens, P.path("byte_bpe_50k.tiktoken")).collect()} == {1: b"a cat's tale", 2: b""}


def test_rank_file_lines():
    assert bpe.Bpe.parse(base64.b64encode(b"a") + b" 0\n").ranks == {b"a": 0}


def test_pieces_that_share_a_hash(table, independent, monkeypatch):
    """With a hash that knows only lengths, within a batch and in what is remembered of the one before."""
    zeros, digest = np.zeros(0x110000, dtype=np.uint64), hashlib.blake2b(digest_size=8)
    monkeypatch.setattr(bpe, "_mixed", lambda: zeros)
    monkeypatch.setattr(bpe.hashlib, "blake2b", lambda *a, **k: digest)
    encoder = bpe.Bpe(table.ranks)
    for part in (["one two", "six", ""], ["tea for two", "x" * 70 + " " + "y" * 69], ["six", "é"]):
        for _ in range(2):
            ids, ends = encoder.encode_batch(part)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [independent.encode_ordinary(x) for x in part]


def test_workers_hold_no_encoder_after_their_task(spark):
    docs = spark.createDataFrame([(k, "some text " * k) for k in range(40)], "doc_id long, text string").repartition(4)
    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.decode(bpe.encode(docs, path), path).count() == bpe.round_trip(docs, path).where("n_tokens >= 0").count() == 40

    def held(batches):
        for batch in batches:
            yield batch.set_column(0, "id", pa.array([sum(type(x).__name__ == "Bpe" for x in gc.get_objects())] * batch.num_rows))

    assert {r.id for r in spark.range(0, 80, 1, 8).mapInArrow(held, "id long").collect()} == {0}
