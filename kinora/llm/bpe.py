"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A piece's bytes are cut at a power of two, both halves are encoded on their own, and the two token lists are joined.
Joining is associative, so any tree over the bytes gives the same ids.  A join re-encodes a window around the seam
and widens it until both of its borders are stable.

Why that is enough: a token list is the encoding of its bytes exactly if every two neighbours are, i.e. encoding the
bytes of each neighbouring pair gives that pair back.  Pairs inside either half are stable already, pairs inside the
window are stable because the window was encoded as one, so only the window's two borders remain to be tested.  A
window that has grown to everything has no borders left, hence the loop ends.  Tests hold the result against an
independent encoder.

Defined results: null text counts as empty; an empty text has no tokens and decodes to no bytes.  Rows are encoded
one by one, so repeated rows, repeated or null ids and further columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinora.llm.batches import code_points, mix64, record, release, text_slices, texts_of

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: What one task remembers: pieces (beyond that only a fourth is kept) and windows. Forgetting costs time, no result.
#: A worker forgets all when the task ends, as it lives on for other stages.
PIECES, WINDOWS = 1_500_000, 200_000
#: Pieces of up to so many characters are found by their hash.
SHORT = 64
#: Text encoded in one vectorised step.
STEP_BYTES = 1 << 20
#: Up to so many bytes are merged directly.
LEAF = 8


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = SPACE
    return table


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the joined texts start, as the public split pattern of this vocabulary cuts them.

    The pattern's alternatives depend on runs of one character class only, so runs are found for all texts at once:
    a blank goes with the run after it, the rest of that white space is one piece, other single white space before a
    run stands alone, and an apostrophe that starts a piece takes s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    start = np.zeros(n + 1, dtype=bool)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[points]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets[:-1]] = True
    start[0] = True
    start[1:n] = kind[1:] != kind[:-1]
    start |= begins
    start[n] = False
    after = np.flatnonzero(start[1:n] & ~begins[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quotes = np.flatnonzero(start[:n] & (points == 0x27))
    if len(quotes):
        padded = np.concatenate([points, np.zeros(3, dtype=np.uint32)])
        ends = offsets[np.searchsorted(offsets, quotes, side="right")]
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, np.array([ord(c) for c in "stmd"])) & (quotes + 1 < ends)
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (quotes + 2 < ends)
        for at, length in ((quotes[short], 2), (quotes[long & ~short], 3)):
            for k in range(1, length):
                start[at + k] = False
            start[at + length] = True
    return np.flatnonzero(start[:n])


class Bpe:
    """Encoder and decoder for a rank table (bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self._windows: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[int, bool] = {}
        self._runs = [_empty(), _empty()]
        self._bytes: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def parse(cls, table: bytes) -> Bpe:
        """From the text of a rank file: a base64 token and its rank on each line."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line.strip())})

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked neighbours, leftmost first, until none can be merged: a heap over a linked list."""
        n, ranks = len(data), self.ranks
        if n <= 4 * LEAF:
            return self._merge_short(data)
        following, previous, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            j = following[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            ends[i], alive[j] = end, False
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if (r := ranks.get(data[i : ends[k]])) is not None:
                    heapq.heappush(heap, (r, i, ends[k]))
            if (h := previous[i]) >= 0 and (r := ranks.get(data[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = following[i]
        return tuple(out)

    def _merge_short(self, data: bytes) -> tuple[int, ...]:
        """The same by scanning for the lowest rank, which is quicker for a few bytes."""
        ranks, none = self.ranks, 1 << 62
        ends = list(range(1, len(data) + 1))
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            del ends[i], pairs[i]
            start = ends[i - 1] if i else 0
            if i < len(pairs):
                pairs[i] = ranks.get(data[start : ends[i + 1]], none)
            if i:
                pairs[i - 1] = ranks.get(data[ends[i - 2] if i > 1 else 0 : ends[i]], none)
        return tuple([ranks[data[a:b]] for a, b in zip([0, *ends], ends)])

    def _window(self, data: bytes) -> tuple[int, ...]:
        got = self._windows.get(data)
        if got is None:
            got = self._merge(data)
            if len(data) <= 64:
                if len(self._windows) >= WINDOWS:
                    self._windows.clear()
                self._windows[data] = got
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        got = self._pairs.get(key := a << 32 | b)
        if got is None:
            got = self._merge(self.vocabulary[a] + self.vocabulary[b]) == (a, b)
            if len(self._pairs) >= WINDOWS:
                self._pairs.clear()
            self._pairs[key] = got
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both sides' bytes together."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        vocabulary, i, j, step_i, step_j = self.vocabulary, len(left) - 1, 1, 1, 1
        while True:
            window = self._window(b"".join([vocabulary[t] for t in left[i:]] + [vocabulary[t] for t in right[:j]]))
            open_left = i > 0 and not self.stable(left[i - 1], window[0])
            open_right = j < len(right) and not self.stable(window[-1], right[j])
            if not (open_left or open_right):
                return left[:i] + window + right[j:]
            if open_left:
                i, step_i = max(0, i - step_i), step_i * 2
            if open_right:
                j, step_j = min(len(right), j + step_j), step_j * 2

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The tree reduction. Cutting at a power of two keeps repeated bytes in step across the seam."""
        if not data:
            return ()
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        if len(data) <= LEAF:
            return self._window(data)
        cut = 1 << (len(data) - 1).bit_length() - 1
        return self.join(self.encode_piece(data[:cut]), self.encode_piece(data[cut:]))

    def _known(self, keys: np.ndarray, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and counts, in the returned ids, of the distinct pieces with these sorted keys.

        What is known lies in two sorted runs, a large and a recent one that joins it now and then.
        """
        run, at = np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        for k, (known, _, _) in enumerate(self._runs):
            if len(known):
                pos = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[pos] == keys
                run[hit], at[hit] = k, pos[hit]
        missing = np.flatnonzero(run < 0)
        fresh = [self.encode_piece(pieces(i).encode()) for i in missing.tolist()]
        counts, ids = np.zeros(len(keys), dtype=np.int64), [np.array([t for x in fresh for t in x], dtype="<u4")]
        begins, size = np.zeros(len(keys), dtype=np.int64), len(ids[0])
        counts[missing] = [len(x) for x in fresh]
        begins[missing] = np.cumsum(counts[missing]) - counts[missing]
        for k, (_, ends, tokens) in enumerate(self._runs):
            mine = np.flatnonzero(run == k)
            begins[mine] = size + np.where(at[mine] > 0, ends[at[mine] - 1], 0)
            counts[mine] = np.diff(ends, prepend=0)[at[mine]]
            ids.append(tokens)
            size += len(tokens)
        everything = np.concatenate(ids)
        if len(missing):
            self._remember(keys[missing], counts[missing], ids[0])
        return everything, begins, counts

    def _remember(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        large, recent = self._runs
        recent = _merged(recent, (keys, np.cumsum(counts), ids))
        if 4 * len(recent[0]) > len(large[0]):
            large, recent = (_merged(large, recent) if len(large[0]) < PIECES else recent), _empty()
        self._runs = [large, recent]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and len(texts) + 1 offsets into them.

        Equal pieces of the batch are found by a 64-bit hash of their characters with their length, so each distinct
        piece is encoded once; pieces longer than SHORT get a cryptographic hash of 64 bits.  The ids have to spell every
        piece; if pieces with one hash differ they don't, and the batch is encoded without hashes.
        """
        joined, points, offsets = code_points(texts)
        starts = piece_starts(points, offsets)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        lengths = np.diff(starts, append=len(points))
        within = np.arange(len(points)) - np.repeat(starts, lengths)
        key = np.add.reduceat(_mixed()[points] * _powers()[within & (SHORT - 1)], starts) ^ mix64(lengths.astype(np.uint64))
        long = np.flatnonzero(lengths > SHORT)
        key[long] = [int.from_bytes(hashlib.blake2b(joined[starts[i] : starts[i] + lengths[i]].encode(), digest_size=8).digest()) for i in long]
        keys, first, which = np.unique(key, return_index=True, return_inverse=True)
        ids, begins, counts = self._known(keys, lambda i: joined[starts[first[i]] : starts[first[i]] + lengths[first[i]]])
        ends, ids = np.concatenate([[0], np.cumsum(counts[which])]), spread(ids, begins, counts, which)
        if not self._spell(ids, ends, joined, points, starts):
            self._runs, fresh = [_empty(), _empty()], [self.encode_piece(joined[a : a + n].encode()) for a, n in zip(starts.tolist(), lengths.tolist())]
            ends, ids = np.cumsum([0, *map(len, fresh)]), np.array([t for x in fresh for t in x], dtype="<u4")
        return ids, ends[np.searchsorted(starts, offsets)]

    def _spell(self, ids: np.ndarray, ends: np.ndarray, joined: str, points: np.ndarray, starts: np.ndarray) -> bool:
        """Whether the ids between two ``ends`` are the bytes of the piece between two ``starts``, for all pieces."""
        data, sizes = self._decoder()
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        wanted = np.append(0, np.cumsum(widths))[np.append(starts, len(points))]
        found = np.append(0, np.cumsum(sizes[ids]))[ends]
        return np.array_equal(wanted, found) and spread(data, np.cumsum(sizes) - sizes, sizes, ids).tobytes() == joined.encode()

    def _decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and how many each has."""
        if self._bytes is None:
            self._bytes = np.frombuffer(b"".join(self.vocabulary), dtype=np.uint8), np.array([len(x) for x in self.vocabulary], dtype=np.int64)
        return self._bytes

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Token bytes, concatenated; concatenation is associative, so all levels of the tree collapse into one."""
        data, sizes = self._decoder()
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[offsets].tolist()
        whole = spread(data, np.cumsum(sizes) - sizes, sizes, ids).tobytes()
        return [whole[a:b] for a, b in zip(ends, ends[1:])]


def spread(values: np.ndarray, begins: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Runs of ``values`` on end: those numbered ``which``, each of ``counts`` items from ``begins``."""
    taken = counts[which]
    ends = np.cumsum(taken)
    return values[np.repeat(begins[which] - ends + taken, taken) + np.arange(ends[-1] if len(ends) else 0)]


Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _empty() -> Run:
    return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")


def _merged(a: Run, b: Run) -> Run:
    """Keys in order, the end of each key's ids, and the ids."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    counts = np.concatenate([np.diff(a[1], prepend=0), np.diff(b[1], prepend=0)])
    begins = np.cumsum(counts) - counts
    return keys[order], np.cumsum(counts[order]), spread(np.concatenate([a[2], b[2]]), begins, counts, order)


@lru_cache(1)
def _mixed() -> np.ndarray:
    return mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.full(SHORT, 0xD1342543DE82EF95, dtype=np.uint64))


def _shared(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, token_ids array<int>) for every row of ``docs``.  The rank file (a fixed vocabulary) is broadcast."""
    table = _shared(docs, ranks_path)
    kept = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.parse(table.value)
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                ids, offsets = bpe.encode_batch(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "token_ids"])
        del bpe
        release()

    return kept.mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, text binary): the bytes that the ids of ``encode`` stand for; null ids give null."""
    table = _shared(tokens, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.parse(table.value)
        for batch in batches:
            lists = batch.column("token_ids").to_pylist()
            data = [None if x is None else bpe.decode_batch(np.array(x, dtype=np.int64), np.array([0, len(x)]))[0] for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "text"])
        del bpe
        release()

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, token_ids, ids_sha256, decoded_sha256."""
    table = _shared(docs, ranks_path)
    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.parse(table.value)
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                ids, offsets = bpe.encode_batch(texts_of(part))
                packed, cuts = ids.tobytes(), (4 * offsets).tolist()
                coded = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
                decoded = [hashlib.sha256(x).hexdigest() for x in bpe.decode_batch(ids, offsets)]
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield record(schema, part.column("doc_id"), np.diff(offsets), tokens, coded, decoded)
        del bpe
        release()

    return kept.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string")
