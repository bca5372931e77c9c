import math
import random
import re
import zlib

import numpy as np

from kinora.llm import toxicity
from kinora.llm.batches import code_points
from kinora.llm.words import gram_features, hashed_words


def test_words_are_runs_of_letters_in_either_case():
    _, points, offsets = code_points(["Ab cd, ab", "", "cd1AB", "xé"])
    words, text = hashed_words(points, offsets)
    assert text.tolist() == [0, 0, 0, 2, 2, 3]
    assert words[0] == words[2] == words[4] and words[1] == words[3] and len(set(words.tolist())) == 3


def test_grams_stay_within_a_text():
    _, points, offsets = code_points(["a b c", "d", "a b"])
    bucket, text = gram_features(points, offsets, 20)
    assert np.bincount(text, minlength=3).tolist() == [3 + 2 + 1, 1, 2 + 1]


def test_ftrl_finds_the_one_telling_feature_and_zeroes_the_rest():
    rng = random.Random(3)
    model = toxicity.Ftrl(100, l1=2.0)
    for _ in range(2000):
        label = rng.random() < 0.3
        model.update(np.array(sorted(rng.sample(range(1, 100), 5)) + [0] * label), int(label))
    weights = model.weights(slice(None))
    assert weights[0] > 2 and weights[0] == weights.max() and (weights[1:100] == 0).mean() > 0.5


def test_ftrl_equals_a_plain_version():
    """The update of the published algorithm, coordinate by coordinate."""
    rng, alpha, beta, l1 = random.Random(7), 0.7, 1.0, 0.3
    model, z, n = toxicity.Ftrl(12, alpha=alpha, beta=beta, l1=l1), [0.0] * 13, [0.0] * 13
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha)
    for _ in range(300):
        features, label, importance = sorted(rng.sample(range(12), 4)), rng.randint(0, 1), rng.choice([1.0, 2.5])
        model.update(np.array(features), label, importance)
        at = [*features, 12]
        w = {i: weight(i) for i in at}
        g = importance * (1 / (1 + math.exp(-sum(w.values()))) - label)
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(slice(None)), [weight(i) for i in range(13)])


def plain_features(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return {(0, w) for w in words} | {(1, *p) for p in zip(words, words[1:])} | {(2, *p) for p in zip(words, words[2:])}


def test_score_equals_a_sum_of_weights(spark):
    """Weights of single features, found by their bucket, add up in a text as in a plain logistic regression."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("red green blue, Grey".split()) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["red " * 50_000]
    bucket = {}
    for f in set().union(*map(plain_features, texts)):
        text = " ".join(f[1:]) if f[0] < 2 else f"{f[1]} zzz {f[2]}"
        _, points, offsets = code_points([text])
        found, _ = gram_features(points, offsets, toxicity.BITS)
        bucket[f] = int(found[-1])  # words come first, then pairs, then pairs that skip one
    weight = {f: rng.uniform(-1, 1) for f in bucket}
    model = spark.createDataFrame([(bucket[f], weight[f]) for f in bucket] + [(1 << toxicity.BITS, -0.4)], "bucket long, weight double")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for k, t in enumerate(texts):
        assert math.isclose(got[k], 1 / (1 + math.exp(0.4 - sum(weight[f] for f in plain_features(t)))), rel_tol=1e-9)


def rows():
    rng = random.Random(4)
    for i in range(600):
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(40)]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = "badword"
        yield i, " ".join(words), toxic


def test_held_out_accuracy_and_edge_rows(spark):
    found = list(rows())
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in found] + [(900, None, ""), (901, "", ""), (None, "badword", ""), (0, found[0][1], "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, "y") for i, _, y in found] + [(None, 1, ""), (3, None, ""), (901, 0, "")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 604
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 50 and all(r.predicted == found[r.doc_id][2] for r in held)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_labels_of_held_out_rows_are_never_read(spark):
    found = list(rows())
    docs = spark.createDataFrame([(i, t) for i, t, _ in found], "doc_id long, text string")
    schema = "doc_id long, toxic int"
    plain = toxicity.toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in found], schema))
    flipped = toxicity.toxicity(docs, spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in found], schema))
    assert sorted(plain.collect()) == sorted(flipped.collect())


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    (row,) = toxicity.toxicity(docs, labels).collect()
    assert abs(row.score - toxicity.PRIOR) < 1e-12 and row.predicted == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_without_a_model_every_document_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (5, ""), (None, "c")], "doc_id long, text string")
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    for found in ([], [(1, None)], [(77, 1), (78, 0)], [(i, 1) for i in held], [(1, 1), (2, 1)]):
        labels = spark.createDataFrame(found, "doc_id long, toxic int")
        assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {0}
        assert sorted(toxicity.clean(docs, toxicity.fit(docs, labels)).collect(), key=str) == sorted(docs.collect(), key=str)
    one = spark.createDataFrame([(zlib.crc32(b"unseen") % (1 << toxicity.BITS), 2.0)], "bucket long, weight double")
    assert toxicity.clean(docs, one).count() == 4  # no intercept: texts without a weighted feature say nothing


def test_a_capped_sample_keeps_the_class_ratio(spark):
    rng = random.Random(5)
    found = [(i, int(i % 10 == 0)) for i in range(6000)]
    docs = spark.createDataFrame([(i, "hint" if rng.random() < (0.6 if y else 0.3) else "plain") for i, y in found] + [(9000, "hint"), (9001, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame(found, "doc_id long, toxic int")

    def scores(rows):
        return {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, rows).where("doc_id >= 9000").collect()}

    whole, capped = scores(10_000), scores(300)
    assert all(whole[i] < 0.5 and capped[i] < 0.5 and abs(whole[i] - capped[i]) < 0.12 for i in (9000, 9001)), (whole, capped)
