import random
import re

import numpy as np
import pytest

from kinora.llm import similar

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    """Per row (doc_id, shingles, component), by comparing all with all."""
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            alike = sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if same or alike:
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted(((d, len(s), least.get(find(k)) if d is not None else None) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def fixture(seed, groups=12, copies=9, words=(3, 120)):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["The", "of", "é", "Ünï"]
    rows, n = [], 0
    line = [rng.choice(vocab) for _ in range(25)]
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, copies)):
            now = list(base)
            for _ in range(rng.randint(0, max(1, len(now) // 40))):
                now[rng.randrange(len(now))] = rng.choice(vocab)
            if rng.random() < 0.2:
                base = now  # chains
            rows.append((n, rng.choice([" ", "\t", "\n "]).join(now if rng.random() < 0.7 else line + now)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_sets_equal_a_plain_version():
    texts = ["", "a", "A b\x0bc", "a b c d", "a b c d a b c d a b c d", " É é ", "x " * 9000 + "y" * 9000]
    for size in (1, 4, 5):
        assert [len(s) for s in similar.shingle_sets(texts, size)] == [len(plain_set(t, size)) for t in texts]
    one, two = similar.shingle_sets(["A b c d e f", "b c d e f g"], 4)
    assert len(np.intersect1d(one, two)) == 2


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_bands_and_pigeonhole(percent):
    bands, rng, seen, left_out = similar.Bands(percent), random.Random(percent), 0, 0
    for _ in range(1500):
        n = rng.choice([rng.randint(1, 12), rng.randint(1, 300), rng.randint(500, 900)])
        high = rng.choice([1 << 62, 1 << 64])  # the lower range leaves most blocks empty
        a = np.array(sorted({rng.randrange(high) for _ in range(n)}), dtype=np.uint64)
        gone, new = rng.randint(0, n // 8), rng.randint(0, n // 6)
        b = np.unique(np.array(rng.sample(a.tolist(), n - gone) + [rng.randrange(high) for _ in range(new)], dtype=np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
            seen += 1
            left_out += any(k and len(similar.block_keys(a, b, k, e)) < k for b, (k, e) in enumerate(zip(bands.blocks[:40], bands.empty)) if b == bands.of(len(a)))
            assert abs(bands.of(len(a)) - bands.of(len(b))) <= 1
            assert len(np.intersect1d(similar.keys_of(a, bands), similar.keys_of(b, bands))) > similar.SPARE
            x, y = (similar.short_sketch(v) for v in (a, b))
            x, y = (similar._words([v], min(len(x), len(y)) // 8)[0] for v in (x, y))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
            assert similar._close(x, y[None], len(a), np.array([len(b)]), percent)[0] >= 0
    assert seen > 50 and (left_out > 20 or percent == 95)  # with fewer blocks none is empty


EXTRA = [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one"), (None, None)]


def test_equals_brute_force(spark):
    rows = fixture(1) + EXTRA
    rows += [rows[0], (rows[1][0], rows[2][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n_shingles int").repartition(3)
    got = similar.similar_groups(docs, 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 85)


def test_equals_brute_force_with_five_words_and_tight_limits(spark, monkeypatch):
    """Groups of three are crowds already, two classes of a batch are salted and blocks hold three classes."""
    monkeypatch.setattr(similar, "BLOCK", 3)
    rows = fixture(2, groups=5, copies=14, words=(20, 60))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, similar.similar_groups(docs, small=2, hot=2).collect()), key=str) == brute(rows, 5, 80)


def test_sets_that_share_their_first_number(spark):
    """With four bits many sets share one and go by their second number."""
    rows = fixture(3, groups=8, copies=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, similar.similar_groups(docs, bits=4).collect()), key=str) == brute(rows, 5, 80)


def test_a_crowd_of_copies_and_a_very_long_text(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    rows = [(k, " ".join(base)) for k in range(60)]
    rows += [(100 + k, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(70)]
    long = [f"w{rng.randrange(900)}" for _ in range(60_000)]
    rows += [(300, " ".join(long)), (301, " ".join([*long[:-40], "tail"])), (302, " ".join(long[:30_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, similar.similar_groups(docs, hot=8).collect()), key=str) == brute(rows, 5, 80)


def test_a_common_passage_makes_fewer_pairs_than_texts(spark, monkeypatch):
    """Texts that share a passage and little else; some are near copies of others."""
    rng, counts, stored = random.Random(5), {}, similar.stored

    def counted(df, name, **options):
        out = stored(df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(similar, "stored", counted)
    line = [f"line{k}" for k in range(30)]
    texts = [line + [f"w{rng.randrange(10**6)}" for _ in range(20)] for _ in range(400)]
    texts += [[*texts[9 * k][:-1], "other"] for k in range(30)]
    texts += [["one", *texts[400 + k][1:]] for k in range(15)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, similar.similar_groups(docs).collect()), key=str) == brute(rows, 5, 80)
    assert counts["crowds"] > len(rows) and counts["pairs"] < len(rows)


def test_short_sketches_fold():
    rng = np.random.default_rng(4)
    for n in (20, 40, 3000):
        s = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        x = similar._words([similar.short_sketch(s)], 1)
        assert int(np.bitwise_count(x).sum()) % 2 == n % 2 and x.shape == (1, 1)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar.similar_groups(docs).count() == 0


def test_one_of_each_judges_an_id_text_by_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, c), (2, c), (3, a), (3, c + " tail"), (4, None), (4, ""), (4, None), (5, b + " tail"), (6, "alone"), (1, a + " tail"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.text) for r in similar.one_of_each(docs).collect()), key=str)
    (of_1,) = [t for d, t in got if d == 1]
    assert of_1 in (a, a + " tail")
    assert got == sorted([(1, of_1), (2, b), (2, c), (4, None), (4, ""), (6, "alone"), (None, a)], key=str)
    again = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(2)
    assert sorted(((r.doc_id, r.text) for r in similar.one_of_each(again).collect()), key=str) == got
