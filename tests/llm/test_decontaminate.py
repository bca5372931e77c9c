import hashlib
import random

from kinora.llm import decontaminate as dec


def brute(docs, items):
    """Per document, straight from the definition."""
    out = []
    for doc_id, text in docs:
        w = dec.words(text)
        hit, names = set(), set()
        for item, t in items:
            found = dec.words(t)
            size = min(13, len(found))
            for k in range(len(found) - size + 1) if found and item is not None else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == found[k : k + size]:
                        hit |= set(range(p, p + size))
                        names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(9)
    vocab = ["the", "of", "and", "é", "naïve", "x1", "cat", "dog"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice([1, 5, 13, 14, 30]))) for k in range(1, 14)] + [(3, "the the the the the of"), (None, "cat"), (50, ""), (51, None), (52, "!?"), (8, None)]
    docs = [(k, say(rng.randint(0, 60))) for k in range(60)]
    for k in range(60, 90):
        passage = dec.words(rng.choice([t for _, t in items if t and len(t) > 40]))
        a = rng.randint(0, 3)
        docs.append((k, say(rng.randint(0, 20)) + " " + ", ".join(passage[a : a + rng.randint(12, 30)]).upper() + "! " + say(rng.randint(0, 200))))
    docs += [(90, None), (91, ""), (92, "..."), (None, items[0][1]), (5, docs[5][1]), (60, docs[60][1]), (93, "the of " * 30000)]
    return docs, items


def test_equals_brute_force_for_any_segment_and_block_size(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, items string, segment int").repartition(3)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute(docs[:-1], items)
    got = dec.decontaminate(d, b).select(names).collect()
    assert sorted([tuple(r) for r in got if r.doc_id != 93], key=str) == want
    assert any(r[2] for r in want) and any(r[5] for r in want)
    small = dec.find_phrases(dec.build_index(d, 100), b, block_words=20).withColumn("n_hit", dec.united(dec.F.col("runs")))
    rows = [(r.doc_id, r.n_words, r.n_hit, len(r.items)) for r in small.collect() if r.doc_id != 93]
    assert sorted(rows, key=str) == sorted([r[:4] for r in want], key=str)


def test_runs_are_word_positions(spark):
    d = spark.createDataFrame([(1, "a b needle in a haystack c"), (2, "needle in"), (3, "a haystack")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "Needle in a haystack")], "item_id long, text string")
    got = {r.doc_id: [(x.start, x.end) for x in r.runs] for r in dec.find_phrases(dec.build_index(d), b).collect()}
    assert got == {1: [(2, 6)], 2: [], 3: []}


def test_no_documents_and_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    (row,) = dec.decontaminate(docs, items).collect()
    assert (row.n_hit, row.n_items, row.contaminated) == (0, 0, False)
    assert dec.decontaminate(docs.limit(0), items).count() == 0


def test_proximity_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(20)]
    queries, span = {"q1": ["a", "b", "c"], "q2": ["a", "a", "h"], "q3": ["z"]}, 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in dec.find_near(dec.build_index(docs, 100), queries, span).collect()}
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        for name, terms in queries.items():
            holds = lambda a, b: all(w[a:b].count(x) >= terms.count(x) for x in terms)  # noqa: E731, B023
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + span) + 1):
                    if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1):
                        want.add((d, name, a, b))
    assert got == want and want
