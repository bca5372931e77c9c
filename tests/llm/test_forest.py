import numpy as np
import pandas as pd
import pytest

from kinora.llm import forest


def brute(rows, threshold, kind=np.float32):
    """(vec_id, n_links, component) per row by comparing all with all."""
    n = len(rows)
    ok = [v is not None and lab is not None and i is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v, lab in rows]
    link = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=kind).astype(float) for k in (a, b))
                link[a, b] = link[b, a] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold or (x == y).all()
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a]] + [label[b] for b in np.flatnonzero(link[a])]) for a in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[label[k]] = min(rows[k][0], least.get(label[k], rows[k][0]))
    return sorted(((rows[k][0], int(link[k].sum()), least.get(label[k]) if rows[k][0] is not None else None) for k in range(n)), key=str)


def make(rng, n, width=16, noise=0.3):
    """Vectors of which many are noisy copies, the noise around the threshold."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            v = np.array(out[rng.integers(len(out))]) + noise * rng.random() * rng.standard_normal(width) / np.sqrt(width)
        else:
            v = rng.standard_normal(width)
        out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def run(spark, rows):
    got = forest.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str)


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v, k % 3) for k, v in enumerate(make(rng, 60))]
    same = rows[0][1]
    rows += [(100, same, 0), (101, same, 0), (102, same, 1), (103, [2 * x for x in same], 0), (104, None, 0), (105, [], 0), (106, [0.0] * 16, 0), (107, [*same[:15], None], 0), (108, [*same[:15], float("nan")], 0), (109, [*same[:15], float("inf")], 0), (110, same, None), (None, same, 0), (111, same[:8], 0), (112, same[:8], 0), (100, same, 0)]
    assert run(spark, rows) == brute(rows, 0.93)
    assert run(spark, []) == []


def test_recall_with_deep_trees_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = make(rng, 1200, 64, 0.45)
    x = np.array(vectors)
    true = ((x @ x.T) >= 0.93).sum() - len(x)
    assert true > 200
    packed = [np.array(v, dtype="<f4").tobytes() for v in vectors]
    classes = spark.createDataFrame([("0", bytearray(v), k, 1, 64) for k, v in enumerate(packed)], "key string, vector binary, cls long, copies long, width int")
    monkeypatch.setattr(forest, "LEAF", 20)
    found = forest.class_links(classes, 0.93).groupBy().sum("links").first()[0]
    assert 0.95 * true <= found <= true
    monkeypatch.setattr(forest, "LEAF", 1 << 20)
    monkeypatch.setattr(forest, "LEAF_MOST", 300)
    monkeypatch.setattr(forest, "BLOCK", 200)
    assert forest.class_links(classes, 0.93).groupBy().sum("links").first()[0] == true


@pytest.mark.parametrize("n", [50, 200])
def test_small_labels_go_through_trees(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, v, 5) for k, v in enumerate(make(rng, n, 64))]
    (levels,) = spark.range(1).select(forest.levels_of(forest.F.lit(n))).first()
    assert levels >= 1 and run(spark, rows) == brute(rows, 0.93)


def test_doubles_at_the_threshold_and_text_labels(spark):
    """Cosines within 1e-9 of the threshold, which floats could not tell apart; 1.2 and 1.7 are two labels."""
    rng, rows = np.random.default_rng(6), []
    for k in range(60):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        c = 0.93 + (1 if k % 2 else -1) * 1e-9
        rows += [(2 * k, a.tolist(), f"{k}.2"), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), f"{k}.2")]
    rows += [(500, [0.0, 1e300, 3e300], "big"), (501, [-0.0, 1e300, 3e300], "big"), (502, [1.0, 1.0, 3.0], "1.2"), (503, [1.0, 1.0, 3.0], "1.7")]
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows, 0.93, float)
    assert sum(r.n_links for r in got) == 62
    floats = spark.createDataFrame([(1, [1.0, 2.0], 0.0), (2, [1.0, 2.0], -0.0), (3, [1.0, 2.0], 0.5)], "vec_id long, embedding array<double>, label double")
    assert sorted(r.n_links for r in forest.near_duplicates(floats).collect()) == [0, 1, 1]


def test_recall_at_the_shipped_depth(spark):
    """Pairs planted just above the threshold among 60,000 vectors of one label: eight levels, five trees."""
    rng, n, width = np.random.default_rng(9), 60_000, 48
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 4_000, 2):
        off = rng.standard_normal(width)
        off -= off @ x[k] * x[k]
        x[k + 1] = 0.935 * x[k] + np.sqrt(1 - 0.935**2) * off / np.linalg.norm(off)
    packed = np.ascontiguousarray(x, dtype="<f4")
    classes = spark.createDataFrame(pd.DataFrame({"cls": np.arange(n), "vector": [v.tobytes() for v in packed]}))
    classes = classes.select(forest.F.lit("0").alias("key"), "vector", "cls", forest.F.lit(1).cast("long").alias("copies"), forest.F.lit(width).alias("width"))
    links = forest.class_links(classes, 0.93).groupBy("cls").sum("links").collect()
    assert 0.99 * 4_000 <= sum(1 for r in links if r.cls < 4_000) <= 4_000


def test_a_pair_counts_once_however_many_leaves_it_shares(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 8)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    rows = [(k, (base + 0.02 * rng.standard_normal(32)).tolist(), 1) for k in range(60)] + [(100 + k, rng.standard_normal(32).tolist(), 1) for k in range(60)]
    assert run(spark, rows) == brute(rows, 0.93)
