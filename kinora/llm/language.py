"""Language identification by bitmask n-gram filters.

Character n-grams (3 and 4 characters, word edges included) of a bounded sample are counted per language, and each
language's most frequent ones go into one bit-sliced Bloom filter: slot h holds a bitmask with one bit per language,
so looking an n-gram up means AND-ing a few slots and gives all languages at once.  A text is judged by the
per-language popcounts over its n-grams, each corrected for that language's false-positive rate.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if nothing could be
learned.  A tie goes to the language that sorts first.  Rows are judged one by one, so repeated rows and ids change
nothing; a null id is never learned from and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinora.llm.batches import mix64, record, text_slices, texts_of
from kinora.llm.words import letters, lowered

SIZES = (3, 4)
SLOTS_LOG2, HASHES = 20, 4
#: Values of ``lang`` that can be learned; the model and what is broadcast have a row for each.
LANGUAGES = 1_024
#: Rows learned from per language, at most, and n-grams kept per language.
SAMPLE_ROWS, PROFILE = 2_000, 6_000
STEP_BYTES = 1 << 20
_FACTOR = np.uint64(0xD1342543DE82EF95)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' n-grams and the number of the text each is from.

    Everything but letters counts as a word edge; an n-gram may begin or end with an edge and has none inside.
    """
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = letters()[points]
    value = np.where(letter, lowered()[points], np.uint64(0))
    hashes, at = [], []
    for n in SIZES:
        if len(points) < n:
            continue
        ok = letter[1 : len(points) - n + 2].copy()
        for k in range(2, n - 1):
            ok &= letter[k : len(points) - n + 1 + k]
        where = np.flatnonzero(ok)
        h = value[where]
        for k in range(1, n):
            h = h * _FACTOR + value[where + k]
        hashes.append(mix64(h + np.uint64(n)))
        at.append(where)
    at = np.concatenate(at)
    return np.concatenate(hashes), np.searchsorted(ends, at + 1, side="right")


@dataclass
class Filter:
    """The bit-sliced Bloom filter: ``slots[h]`` has bit k of lane k // 64 set for language k."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray]) -> Filter:
        languages = sorted(profiles)
        slots = np.zeros(((len(languages) + 63) // 64, 1 << SLOTS_LOG2), dtype=np.uint64)
        for k, language in enumerate(languages):
            for h in cls._places(profiles[language]):
                slots[k // 64, h] |= np.uint64(1) << np.uint64(k % 64)
        fill = np.array([((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
        return cls(languages, slots, fill**HASHES)

    @staticmethod
    def _places(grams: np.ndarray) -> Iterator[np.ndarray]:
        other = mix64(grams) | np.uint64(1)
        for i in range(HASHES):
            yield (grams + np.uint64(i) * other) >> np.uint64(64 - SLOTS_LOG2)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per lane the bitmask of all languages that (seem to) have each n-gram."""
        found = None
        for h in self._places(grams):
            found = self.slots[:, h] if found is None else found & self.slots[:, h]
        return found

    def counts(self, grams: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Corrected per-language popcounts, one row per text."""
        masks, total = self.masks(grams), np.bincount(text, minlength=texts)
        raw = np.stack([np.bincount(text, weights=(masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1), minlength=texts) for k in range(len(self.languages))], axis=1)
        return np.maximum(0, (raw - total[:, None] * self.rates) / (1 - np.minimum(self.rates, 0.999)))


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, profile: int = PROFILE) -> Filter:
    """Learn from at most ``sample_rows`` rows per language, in the order of a hash of the id."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (remainder() != 2))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    if (found := counts.count()) > LANGUAGES:
        raise ValueError(f"{found} values of lang; a model holds {LANGUAGES} languages at most")
    share = F.lit(1.5 * sample_rows) / F.col("_rows") * (1 << 30)  # a few more than are needed, so no task gets a whole language
    known = known.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share)
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    chosen = known.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= sample_rows).select("doc_id", "lang").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                languages = part.column("lang").to_pylist()
                hashes, text = grams(texts_of(part))
                for language in sorted(set(languages)):
                    mine = np.array([x == language for x in languages])
                    values, n = np.unique(hashes[mine[text]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= profile).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    return Filter.build({r.lang: np.array(r.grams, dtype=np.int64).view(np.uint64) for r in rows.collect()})


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (the winner's share of the corrected counts)."""
    bound = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bound.value
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                hashes, text = grams(texts_of(part))
                n = part.num_rows
                if not model.languages:
                    yield record(schema, part.column("doc_id"), part.column("held_out"), ["und"] * n, np.zeros(n))
                    continue
                counts, total = model.counts(hashes, text, n), np.bincount(text, minlength=n)
                best, whole = counts.argmax(axis=1), counts.sum(axis=1)
                share = np.where(whole > 0, counts[np.arange(n), best] / np.maximum(whole, 1e-300), 0.0)
                found = [model.languages[b] if t else "und" for b, t in zip(best, total)]
                yield record(schema, part.column("doc_id"), part.column("held_out"), found, np.clip(np.where(total > 0, share, 0.0), 0, 1))

    return kept.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
