"""The training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

toxicity         drops documents that the classifier, trained on the rows of ``labels`` that may be learned from, rejects
near_duplicates  keeps the document with the smallest id of each group of five-word Jaccard similarity 0.8 or more
decontaminate    drops documents that repeat 13 words of ``benchmark`` or more in a row, or whose words are to a twentieth
                 or more those of whole shorter items
secrets          replaces secrets in the texts by a mark
bpe              encodes the texts: ids, their number, and digests of ids and of the decoded bytes

Defined results: without documents every stage returns none.  A null or empty text has no features, shingles, words,
secrets or tokens, so it passes all stages; a very long one is read whole.  A document without an id passes the stages
that decide by id.  Repeated rows count as copies, of which one stays; of rows with one id and different texts each is
judged by its own text, except that decontaminate drops all rows of an id whose text repeats the benchmark.  Without
labels of both classes nothing is toxic, without benchmark nothing is contaminated.  Further columns, whatever their
names, are kept as they are up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinora.llm import bpe, decontaminate, secrets, similar, toxicity
from kinora.llm.batches import small_batches
from kinora.llm.queries import table, vocabulary_path
from kinora.session import discard, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return similar.one_of_each(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = secrets.redact(docs, secrets.learn(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]
#: A learned classifier and learned formats have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*read)
        read = [docs]
    return docs
