import random
import zlib

import numpy as np
import pytest

from kinora.llm import language

WORDS = {"en": "the and with house water from this", "de": "der und mit haus wasser aus diesem", "es": "el y con casa agua desde este", "fr": "le et avec maison eau depuis cette"}


def text(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def brute_grams(s):
    padded, found = [c.lower() if c.isalpha() else None for c in f" {s} "], []
    for n in language.SIZES:
        found += [tuple(padded[i : i + n]) for i in range(len(padded) - n + 1) if None not in padded[i + 1 : i + n - 1]]
    return found


def test_grams_equal_a_plain_version():
    texts = ["The cat, 3 x", "", "ab", "a", "12 !", "Ünï"]
    hashes, where = language.grams(texts)
    named = {}
    for k, t in enumerate(texts):
        want = brute_grams(t)
        assert (where == k).sum() == len(want)
        by_size, got = {}, hashes[where == k]
        for g, h in zip(sorted(want, key=len), got.tolist()):
            by_size.setdefault(g, h)
            assert named.setdefault(g, h) == h
    assert len(set(named.values())) == len(named)


def test_filter_returns_every_language_of_a_gram_and_rates_are_right():
    rng = np.random.default_rng(1)
    profiles = {f"l{k:03d}": rng.integers(0, 2**63, 3000, dtype=np.uint64) for k in range(70)}  # two lanes
    shared = profiles["l000"][:100]
    profiles["l069"][:100] = shared
    found = language.Filter.build(profiles)
    masks = found.masks(shared)
    assert (masks[0] & np.uint64(1) == 1).all() and (masks[1] >> np.uint64(5) & np.uint64(1) == 1).all()
    strange = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    corrected = found.counts(strange, np.zeros(20000, dtype=int), 1)
    assert corrected.max() < 5


def fixture():
    rng = random.Random(2)
    return [(i, text(rng, lang), lang) for i, lang in enumerate(sorted(WORDS) * 60)]


def test_held_out_accuracy_and_edge_rows(spark):
    rows = fixture()
    extra = [(900, None, "en"), (901, "", "en"), (902, "123 !?", None), (903, "z", "en"), (None, "the house", "en"), (904, "水 日本", None), (1, rows[1][1], "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, score string")
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[904].lang_pred in WORDS and by[None].lang_pred == "en" and by[None].held_out is False
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 30 and all(r.lang_pred == rows[r.doc_id][2] and 0 < r.score <= 1 for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_predictions_equal_plain_sets(spark):
    """With filters this empty a prediction is the language whose set holds most of a text's n-grams."""
    rng = random.Random(5)
    rows = fixture()
    rows += [(300 + k, " ".join(text(rng, rng.choice(sorted(WORDS)), rng.randint(0, 4)) for _ in range(3)), None) for k in range(80)]
    rows += [(400, "the " * 60_000 + "le", None)]
    sets = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            sets.setdefault(lang, set()).update(brute_grams(t))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    for i, t, _ in rows:
        found = brute_grams(t)
        counts = {x: sum(g in sets[x] for g in found) for x in sorted(sets)}
        most = max(counts.values())
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
        elif most:
            share = most / sum(counts.values())
            assert abs(got[i].score - share) < 1e-6 and counts[got[i].lang_pred] == most


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = spark.createDataFrame(fixture(), "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="4 values"):
        language.fit(docs)


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = fixture()
    schema = "doc_id long, text string, lang string"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows], schema)
    assert sorted(language.identify(a, language.fit(a)).collect()) == sorted(language.identify(b, language.fit(b)).collect())


def test_nothing_to_learn_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(docs, language.fit(docs)).collect()[0].lang_pred == "und"
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).count() == 0
