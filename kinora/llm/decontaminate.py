"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the training texts into segments of whole documents and stores one row per segment: its sorted
terms and, per term, the ascending word positions (as differences).  Nothing is shuffled, so no term, however common,
is gathered in one place.  ``find_phrases`` reads the stored segments and, for every phrase, takes the postings of its
rarest term in that segment, shifts them to the phrase's start and intersects them with the other terms' lists, rarer
ones first.  ``find_near`` finds all of a phrase's terms within a bounded distance, in any order.

The test set is sent to the tasks in blocks of at most BLOCK_WORDS words; with several blocks the index is searched
once for each and the found runs are united per document.

Defined results: null and empty texts have no words; test items without a word or without an id give no window;
repeated items count once by their id; repeated documents, also with equal or null ids, each get their own row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinora.llm.batches import text_slices
from kinora.session import discard, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a segment (a longer document is a segment of its own), and of a block of the test set.
SEGMENT_WORDS, BLOCK_WORDS = 1 << 19, 1 << 18
WINDOW = 13
#: Rows that a broadcast table may have; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
INDEX = "segment long, doc_ids array<long>, starts array<int>, lengths array<int>, terms string, ends binary, postings binary"


def words(text: str | None) -> list[str]:
    """Bytes are lower-cased in A-Z only, and quicker than by a table of characters."""
    return WORD.findall(text.encode().lower().decode()) if text else []


class Segment:
    """The index of some documents. Between two documents one position is left free, so no phrase crosses over."""

    def __init__(self, doc_ids, starts, lengths, terms: list[str], ends: np.ndarray, postings: np.ndarray):
        self.doc_ids, self.starts, self.lengths = doc_ids, np.asarray(starts, dtype=np.int64), np.asarray(lengths, dtype=np.int64)
        self.number = {t: k for k, t in enumerate(terms)}
        self.ends, self.postings = ends, postings
        self._lists: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, doc_ids: list, texts: list[list[str]]) -> Segment:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        seen: dict[str, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for t in texts for w in t), dtype=np.int32, count=int(lengths.sum()))
        terms = sorted(seen)
        rank = np.empty(len(terms), dtype=np.int32)
        rank[[seen[t] for t in terms]] = np.arange(len(terms))
        ids = rank[ids]
        order = np.argsort(ids, kind="stable")
        position = np.arange(len(ids)) + np.repeat(np.arange(len(texts)), lengths)
        ends = np.cumsum(np.bincount(ids, minlength=len(terms)))
        postings = np.diff(position[order], prepend=0)
        first = ends[:-1]
        postings[first] = position[order][first]
        return cls(doc_ids, starts, lengths, terms, ends, postings.astype(np.int32))

    def row(self, segment: int) -> tuple:
        return segment, self.doc_ids, self.starts.astype(np.int32), self.lengths.astype(np.int32), "\n".join(self.number), self.ends.astype("<i4").tobytes(), self.postings.astype("<i4").tobytes()

    @classmethod
    def read(cls, doc_ids, starts, lengths, terms: str, ends: bytes, postings: bytes) -> Segment:
        return cls(doc_ids, starts, lengths, terms.split("\n") if terms else [], np.frombuffer(ends, dtype="<i4"), np.frombuffer(postings, dtype="<i4"))

    def places(self, term: str) -> np.ndarray:
        """Ascending positions of a term; kept while this segment is searched."""
        got = self._lists.get(term)
        if got is None:
            k = self.number.get(term)
            got = self._lists[term] = np.zeros(0, dtype=np.int64) if k is None else np.cumsum(self.postings[self.ends[k - 1] if k else 0 : self.ends[k]], dtype=np.int64)
        return got

    def phrase(self, terms: list[str]) -> np.ndarray:
        """Positions at which the words of ``terms`` follow each other."""
        lists = sorted(((self.places(t), k) for k, t in enumerate(terms)), key=lambda x: len(x[0]))
        starts = lists[0][0] - lists[0][1]
        for places, k in lists[1:]:
            if not len(starts):
                break
            wanted = starts + k
            at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            starts = starts[places[at] == wanted]
        return starts

    def near(self, terms: list[str], span: int) -> list[tuple[int, int]]:
        """Runs [start, end) of at most ``span`` positions of one document that hold every term, as often as it is
        listed, begin and end with one of them, and contain no shorter such run."""
        need: dict[str, int] = {}
        for t in terms:
            need[t] = need.get(t, 0) + 1
        lists = sorted(((self.places(t), t) for t in need), key=lambda x: len(x[0]))
        if not len(lists[0][0]):
            return []
        around = lists[0][0]
        for places, _ in lists[1:]:
            around = around[np.searchsorted(places, around + span) > np.searchsorted(places, around - span + 1)]
        found = set()
        for p in around.tolist():
            near = sorted((x, t) for places, t in lists for x in places[np.searchsorted(places, p - span + 1) : np.searchsorted(places, p + span)].tolist())
            for a in range(len(near)):
                left = dict(need)
                for x, t in near[a:]:
                    if x - near[a][0] >= span:
                        break
                    left[t] -= 1
                    if all(n <= 0 for n in left.values()):
                        found.add((near[a][0], x + 1))
                        break
        kept = [r for r in found if self.document(r[0]) == self.document(r[1] - 1)]
        return sorted(r for r in kept if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in kept))

    def document(self, position) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index (see INDEX) over ``doc_id`` and ``text`` of ``docs``."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, texts, size, made = (TaskContext.get().partitionId()) << 32, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            segment = Segment.of(ids, texts)
            columns = zip(segment.row(first + made))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.binary(), pa.binary()]
            names = ["segment", "doc_ids", "starts", "lengths", "terms", "ends", "postings"]
            return pa.RecordBatch.from_arrays([pa.array([c[0]], k) for c, k in zip(columns, kinds)], names=names)

        for part in (part for batch in batches for part in text_slices(batch)):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = words(text)
                if ids and size + len(found) > segment_words:
                    yield flush()
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc_id)
                texts.append(found)
                size += len(found) + 1
        if ids:
            yield flush()

    return stored(kept.mapInArrow(run, INDEX), "postings", compression="zstd")


Item = tuple[str, list[str]]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """The test set's (item id, words) in blocks of bounded size; the driver holds one at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        found = words(row.text)
        if block and size + len(found) > block_words:
            yield block
            block, size = [], 0
        if found:
            block.append((row.item_id, found))
            size += len(found)
    if block:
        yield block


def windows(found: list[str], window: int = WINDOW) -> list[list[str]]:
    """Each run of ``window`` words, or all words of a shorter item."""
    return [found[k : k + window] for k in range(max(1, len(found) - window + 1))] if found else []


FOUND = "segment long, place int, doc_id long, n_words long, runs array<struct<start:int,end:int>>, items array<string>"


def _search(index: DataFrame, bound: Broadcast, window: int) -> DataFrame:
    """``bound`` holds a block's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: dict[tuple[str, ...], list[str]] = {}
        for item, found in bound.value:
            for w in windows(found, window):
                phrases.setdefault(tuple(w), []).append(item)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            for r in row.to_pylist():
                s = Segment.read(r["doc_ids"], r["starts"], r["lengths"], r["terms"], r["ends"], r["postings"])
                n = len(s.doc_ids)
                change = np.zeros(int(s.starts[-1] + s.lengths[-1]) + 2, dtype=np.int32)
                items: list[set[str]] = [set() for _ in range(n)]
                known = s.number.keys()
                for phrase, names in phrases.items():
                    if all(t in known for t in phrase) and len(starts := s.phrase(list(phrase))):
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + len(phrase), -1)
                        for d in set(s.document(starts).tolist()):
                            items[d].update(names)
                covered = np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)])
                edge = np.diff(covered)
                begins, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                owner = s.document(begins)
                runs: list[list[dict]] = [[] for _ in range(n)]
                for d, a, b in zip(owner.tolist(), begins.tolist(), ends.tolist()):
                    runs[d].append({"start": int(a - s.starts[d]), "end": int(b - s.starts[d])})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.lengths), pa.array(runs, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["segment", "place", "doc_id", "n_words", "runs", "items"],
                )

    return index.mapInArrow(run, FOUND)


def united(runs: Column) -> Column:
    """How many words the runs cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(
        F.array_sort(runs),
        zero,
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["reach"], r["start"]))).alias("n"), F.greatest(a["reach"], r["end"]).alias("reach")),
        lambda a: a["n"].cast("long"),
    )


def find_phrases(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document (see FOUND): the word runs [start, end) inside occurrences of any window, and the items' ids."""
    send, left = index.sparkSession.sparkContext.broadcast, blocks(benchmark, block_words)
    first, second = next(left, []), next(left, None)
    if second is None:
        return _search(index, send(first), window)
    found = [_hits(index, block, window) for block in (first, second)] + [_hits(index, block, window) for block in left]
    key = ["segment", "place"]
    hits = reduce(DataFrame.unionByName, found).groupBy(*key)
    hits = hits.agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("place", "of")).select(*key, F.col("of.doc_ids").alias("doc_id"), F.col("of.lengths").cast("long").alias("n_words"))
    none = _search(index.limit(0), send([]), window)
    return every.join(hits, key, "left").select(*key, "doc_id", "n_words", *(F.coalesce(c, F.array().cast(none.schema[c].dataType)).alias(c) for c in ("runs", "items")))


def _hits(index: DataFrame, items: list[Item], window: int) -> DataFrame:
    """What one block of the test set hits, stored, so that no more than one block is broadcast at a time."""
    bound = index.sparkSession.sparkContext.broadcast(items)
    found = stored(_search(index, bound, window).where("size(items) > 0").select("segment", "place", "runs", "items"), "hits")
    bound.destroy()
    return found


def find_near(index: DataFrame, queries: dict[str, list[str]], span: int) -> DataFrame:
    """(doc_id, query, start, end): runs of at most ``span`` words that hold all of a query's words in any order."""
    if sum(map(len, queries.values())) > BLOCK_WORDS:
        raise ValueError(f"more than {BLOCK_WORDS} words of queries at a time")
    bound = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows)):
            for r in row.to_pylist():
                s = Segment.read(r["doc_ids"], r["starts"], r["lengths"], r["terms"], r["ends"], r["postings"])
                found = [(s.doc_ids[d := int(s.document(a))], name, a - int(s.starts[d]), b - int(s.starts[d])) for name, terms in bound.value.items() if terms for a, b in s.near(terms, span)]
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=["doc_id", "query", "start", "end"])

    return index.mapInArrow(run, "doc_id long, query string, start long, end long")


def _judged(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What `find_phrases` finds, with n_hit and contaminated."""
    found = find_phrases(index, benchmark).withColumn("n_hit", united(F.col("runs")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(build_index(docs), benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those of documents that repeat WINDOW words of the test set or more in a row, however long
    the document, or are contaminated by shorter items; rows without an id stay."""
    spoiled = F.col("contaminated") | F.exists("runs", lambda r: r["end"] - r["start"] >= WINDOW)
    index = build_index(docs)
    gone = stored(_judged(index, benchmark).where(spoiled & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "contaminated")
    discard(index)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)


def phrases_of(texts: Iterable[str]) -> dict[str, list[str]]:
    """Queries for ``find_near`` named by their text."""
    return {t: words(t) for t in texts}
