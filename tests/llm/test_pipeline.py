import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from kinora.llm import decontaminate, secrets  # noqa: E402
from tests.llm.test_similar import brute as plain_groups  # noqa: E402


def say(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    vocab = [f"word{k}" for k in range(500)]
    items = [(k, say(rng, 30, vocab)) for k in range(5)]
    rows, labels = [], []
    for k in range(400):
        text = say(rng, rng.randint(20, 120), vocab)
        if k % 5 == 0:
            text = f"{text} badword here badword"
        if k % 2 == 0:
            labels.append((k, 1, int(k % 5 == 0)))
        if k % 40 == 1:
            text = f"{text} {items[k % 5][1]}"
        if k % 7 == 3:
            text = f"{text} password={rng.getrandbits(80):020x} end"
        rows.append((k, text, "en", "src", len(text)))
    rows += [(400 + k, rows[3 * k + 1][1] + (" tail" if k % 2 else ""), "en", "src", 0) for k in range(30)]
    rows += [(500, None, None, None, None), (501, "", "", "", 0), (None, "no id", "en", "s", 5), (2, rows[2][1], "en", "src", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_each_stage_on_what_its_predecessor_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").persist()
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    now = rows_of(docs)

    out = stages["toxicity"](spark, docs, folder).persist()
    assert out.columns == columns and rows_of(out) == [r for r in now if "badword" not in (r[1] or "")]
    now, docs = rows_of(out), out

    out = stages["near_duplicates"](spark, docs, folder).persist()
    smallest = {d for d, _, c in plain_groups(now, 5, 80) if d is None or d == c}
    assert out.columns == columns and rows_of(out) == sorted({r for r in now if r[0] in smallest}, key=str) and out.count() < len(now) - 20
    now, docs = rows_of(out), out

    out = stages["decontaminate"](spark, docs, folder).persist()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w) for _, t in items for w in decontaminate.windows(decontaminate.words(t))}
    def hit(text):
        w = decontaminate.words(text)
        return any(tuple(w[k : k + 13]) in windows for k in range(len(w) - 12))
    assert out.columns == columns and rows_of(out) == [r for r in now if not hit(r[1])] and out.count() < len(now)
    now, docs = rows_of(out), out

    out = stages["secrets"](spark, docs, folder).persist()
    formats = secrets.learn(docs)
    assert out.columns == columns and rows_of(out) == sorted([(d, secrets.redacted(t, formats)) for d, t in now], key=str)
    assert "password=" not in str(rows_of(out)) and all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())

    last = stages["bpe"](spark, out, folder).collect()
    assert len(last) == len(now) and all(r.n_tokens == len(r.token_ids) for r in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole if r.doc_id is not None) == sorted((r.doc_id, r.ids_sha256) for r in last if r.doc_id is not None)


COLUMNS = "doc_id long, text string, node string, sketch int, _component long, segment string, runs int, n_chars int"


def written(spark, folder, docs, labels=(), items=()):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")] and docs.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_nulls_long_texts_and_clashing_columns_without_labels_or_benchmark(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"word{k}" for k in range(900)]
    long = say(rng, 60_000, vocab)
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, say(rng, 50, vocab)), (None, "no id"), (None, None), (6, None), (7, "x" * 200_000)]
    folder = written(spark, tmp_path, [(i, t, "n", 1, 2, None, 3, len(t or "")) for i, t in rows] + [(5, rows[4][1], "other", None, None, "s", 1, 1)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert rows_of(docs) == sorted([r for r in rows if r[0] != 4], key=str)
    assert corpus_pipeline.run(spark, folder).count() == len(rows) - 1
