"""N-gram Jaccard join by parity sketches.

Every text becomes the set of its distinct word shingles, as 64-bit hashes in order.  A parity sketch XORs one bit per
shingle into blocks, a block holding the shingles of one range of the hash space; the Hamming distance of two sketches
is at most the size of the sets' symmetric difference.  For two sets of Jaccard similarity t or more that difference is
at most d = (1 - t) / (1 + t) * (|A| + |B|), so of d + 1 + SPARE blocks at least 1 + SPARE are equal in both
(pigeonhole).  With some blocks more, as many as are mostly empty, a set without more empty blocks than that leaves them
out: enough others are equal.  Sizes are dealt into bands so narrow that such a pair lies in one band or in neighbouring ones; a band
has its own number of blocks, and a text takes part in its own band and the one below.

1. A scan gives each text's number of shingles, its class and a short sketch: parity of the whole set over about two
   bits a shingle.  Equal sets are one class, numbered by a 64-bit hash of the set; should two sets share one, which
   is looked for, both are numbered by a second hash.
2. A scan gives each class's block keys, packed by the partition they go to; partitions are as many as the number of
   shingles asks for.  Texts that are equal within a batch are sent once.  A key that many classes of one batch share is
   dealt over salted partitions, with its smallest class as the only one that also goes to the key's own partition.
3. Classes that share a key are paired with the smallest of them, and all with all in groups of at most SMALL.  Larger
   or salted groups are crowds.  A pair seen with 1 + SPARE keys is a candidate if the short sketches are close enough;
   so is one seen with fewer, if a key of them is of no crowd and those of crowds, as if shared, make up the number.
4. Each class is verified, on the whole sets, against the candidate it shares most keys with.  Sets of a partner's
   members are streamed past it, salted beyond MEMBERS of them.  Of the other candidates only those go on that are not
   connected by then.
5. A linked pair that step 3 left out shares 1 + SPARE keys whose groups are all crowds.  Classes in that many crowds
   which still span several components are compared with the other components of their crowds, but for each class's
   SPARE largest crowds, in which no pair shares its first, by short sketches and block by block in tasks of their own:
   first each class with its nearest, then, once those links have merged components, with all that remain near enough.
   So no link that joins two components is lost, no crowd is expanded into pairs, and only near pairs get verified.

Tables between the steps are deleted once they were read.

Defined results: null texts and texts without a word have no shingle and link with nothing; fewer words than a shingle
has make one shingle; a row with a null id links with nothing and has itself no component; repeated rows and ids each
keep their own row, an id standing for all its texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinora.llm.batches import code_points, mix64, text_slices, texts_of
from kinora.operators.components import connected_components
from kinora.session import discard, stored

#: Blocks beyond those that the pigeonhole needs: with them chance matches of single blocks are no candidates.
SPARE = 3
#: Groups of at most so many classes are compared all with all, others with their smallest member first.
SMALL = 16
#: Classes of a batch that share a key before it is salted, and the salts.
HOT, SALTS = 64, 64
#: Keys that are packed together, and keys of a partition, about.
ENTRIES, PART_KEYS = 1 << 20, 1 << 20
#: Members streamed past one partner in one go.
MEMBERS = 2_000
#: Bits of the shortest and of the longest short sketch, and classes of a crowd that are compared in one block.
SKETCH_BITS, BLOCK = (64, 1 << 14), 1_000
#: Classes whose first number is another one's, at most; of n classes about n * n / 2 ** 65 are to be expected.
CLASHES = 10_000
#: Partners of a class that are sent with one reading of its text, about.
USES = 64
#: Rows that a broadcast table may have; beyond that the join shuffles.
BROADCAST_ROWS = 300_000
STEP_BYTES = 1 << 20
_FACTOR = np.uint64(0xD1342543DE82EF95)
_POWERS = np.multiply.accumulate(np.full(1 << 12, _FACTOR, dtype=np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, and the number of the text each stands in."""
    joined, points, offsets = code_points(texts)
    n = len(points)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~((points == 0x20) | ((points >= 9) & (points <= 13)))
    edge, over = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut + 1]]
    edge[cut] = over[cut] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(over)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lower = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
    begun = np.append(0, starts)
    within = np.arange(n) - np.repeat(begun, np.diff(np.append(begun, n)))
    values = np.append(mix64((lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * _POWERS[within & 0xFFF], np.uint64(0))
    found = mix64(np.add.reduceat(values, np.ravel(np.column_stack([starts, ends])))[::2] ^ (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > len(_POWERS)).tolist():
        word = joined[starts[k] : ends[k]].translate({c: c + 32 for c in range(65, 91)})
        found[k] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest())
    return found, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Per text its distinct shingles as ascending 64-bit hashes."""
    words, text = word_hashes(texts)
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    taken = np.minimum(count, size)  # words of each shingle of a text
    many = np.maximum(count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
    h = np.zeros(len(owner), dtype=np.uint64)
    for k in range(size):
        some = taken[owner] > k
        h[some] = mix64(h[some] * _FACTOR + words[at[some] + k] + np.uint64(k + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def number_of(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The set's number, cut to ``bits`` bits, and the one to use instead should another set have it."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], signed=True) >> (64 - bits), int.from_bytes(digest[8:], signed=True)


class Numbers:
    """Numbers of sets, with the first numbers that more than one set has."""

    def __init__(self, bits: int = 64, clashing: frozenset[int] = frozenset()):
        self.bits, self.clashing = bits, clashing

    def __call__(self, shingles: np.ndarray) -> int:
        first, second = number_of(shingles, self.bits)
        return second if first in self.clashing else first


class Bands:
    """Size bands for one threshold: the band of a size, how many blocks it needs, and how many may be left out as empty."""

    def __init__(self, percent: int):
        self.percent = percent
        limits = [1]
        while limits[-1] < 1 << 40:  # a partner of a set below limits[k + 1] is below limits[k + 2]
            limits.append(max(limits[-1] + 1, -(-limits[-1] * 100 // percent)))
        self.limits = np.array(limits)
        share = Fraction(100 - percent, 100 + percent)
        least = Fraction(100, percent)
        self.blocks, self.empty = [], []
        for k in range(len(limits) - 2):
            low, high = limits[k + 1] - 1, limits[k + 2] - 1  # the largest sizes of the band and of the next
            apart = int(share * (low + min(Fraction(high), low * least)))
            need = apart + 1 + SPARE
            empty = need * math.exp(-limits[k] / need)
            self.empty.append(min(need, math.ceil(empty + 3 * math.sqrt(empty))))
            self.blocks.append(need + self.empty[-1] if apart else 0)  # sets that may not differ at all are one class

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.limits, size, side="right")) - 1


def block_keys(shingles: np.ndarray, band: int, blocks: int, empty: int = 0) -> np.ndarray:
    """One key per block: the block's number and its two 64-bit parity words; none for empty ones if those are few.

    If one of two linked sets leaves its empty blocks out, its others suffice; if neither does, both have keys for all.
    The hash space is cut into ``blocks`` ranges, so the ascending shingles are in order of their blocks already.
    """
    cuts = [(k << 64) // blocks for k in range(1, blocks)]
    ends = np.searchsorted(shingles, np.array(cuts, dtype=np.uint64)) if cuts else np.zeros(0, dtype=np.int64)
    spread, one = mix64(shingles), np.uint64(1)
    parity = [np.zeros(len(shingles) + 1, dtype=np.uint64) for _ in range(2)]
    np.bitwise_xor.accumulate(one << (spread & np.uint64(63)), out=parity[0][1:])
    np.bitwise_xor.accumulate(one << (spread >> np.uint64(6) & np.uint64(63)), out=parity[1][1:])
    bounds = np.concatenate([[0], ends, [len(shingles)]])
    a, b = (p[bounds[1:]] ^ p[bounds[:-1]] for p in parity)
    number = np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)
    keys = mix64(mix64(mix64(a) ^ (b * _FACTOR)) ^ mix64(number + np.uint64(1)))
    some = np.diff(bounds) > 0
    return keys[some] if blocks - some.sum() <= empty else keys


def short_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the whole set over a power of two of bits, about two for each shingle; half as many by `folded`."""
    least, most = SKETCH_BITS
    bits = max(least, min(most, 1 << (2 * len(shingles) - 1).bit_length()))
    at = (mix64(shingles) >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1 == 1, bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words as sketches of fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def keys_of(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    band = bands.of(len(shingles))
    found = [block_keys(shingles, b, bands.blocks[b], bands.empty[b]) for b in (band - 1, band) if b >= 0 and bands.blocks[b]]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def classes(docs: DataFrame, size: int, bits: int = 64) -> tuple[DataFrame, Numbers]:
    """(doc_id, n_shingles, node, sketch) for every row, stored; node is null without shingles or id."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                sets, ids = shingle_sets(texts_of(part), size), part.column("doc_id").to_pylist()
                known = [(*number_of(s, bits), short_sketch(s)) if len(s) and i is not None else (None,) * 3 for s, i in zip(sets, ids)]
                columns = zip(zip(*known), [pa.int64(), pa.int64(), pa.binary()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, k) for c, k in columns)], names=["doc_id", "n_shingles", "first", "second", "sketch"])

    found = stored(kept.mapInArrow(run, "doc_id long, n_shingles long, first long, second long, sketch binary"), "classes")
    same = lambda key: found.where("first is not null").groupBy(key.alias("node")).agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x <> y").select("node")
    clashing = [r.node for r in same(F.col("first")).limit(CLASHES + 1).collect()]
    if len(clashing) > CLASHES:
        raise ValueError("too many sets share their numbers")
    node = F.when(F.col("first").isin(clashing), F.col("second")).otherwise(F.col("first")) if clashing else F.col("first")
    if clashing and not same(node).isEmpty():
        raise ValueError("two sets share both of their numbers")
    out = found.select("doc_id", "n_shingles", node.alias("node"), "sketch")
    out._stored_at = found._stored_at
    return out, Numbers(bits, frozenset(clashing))


def _entries(docs: DataFrame, size: int, bands: Bands, parts: int, most: int, number: Numbers) -> DataFrame:
    """Packed (part, nodes, keys, places): block keys, the classes they are of, by the partition they go to.

    A key is a partition and 31 bits within it, with a last bit that marks it as dealt over salts.  Rows of a key's own
    partition hold its lower four bytes alone.  Without ``places`` there is a class for each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                for s in shingle_sets(texts_of(part), size):
                    if len(s) and (node := number(s)) not in found and len(k := keys_of(s, bands)):
                        found[node] = k
                        held += len(k)
                if held >= ENTRIES:
                    yield packed(found)
                    found, held = {}, 0
        if found:
            yield packed(found)

    def packed(found: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = np.array(sorted(found), dtype=np.int64)
        hashes = mix64(np.concatenate([found[n] for n in nodes.tolist()]))
        keys = hashes % np.uint64(parts) << np.uint64(32) | hashes >> np.uint64(33) << np.uint64(1)
        place = np.repeat(np.arange(len(nodes)), [len(found[n]) for n in nodes.tolist()])
        by = np.argsort(keys, kind="stable")
        keys, place = keys[by], place[by]
        lead = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(lead)
        many = np.diff(np.append(first, len(keys)))
        hot = np.repeat(many > most, many)
        own = ~hot | lead
        rows = list(cut(keys[own] | hot[own].astype(np.uint64), place[own], (keys[own] >> np.uint64(32)).astype(np.int64), False))
        if hot.any():
            salt = mix64(nodes[place[hot]].view(np.uint64)) % np.uint64(SALTS)
            salted = mix64(keys[hot] + (salt + np.uint64(1)) * _FACTOR) % np.uint64(parts)
            by = np.argsort(salted, kind="stable")
            rows += cut(keys[hot][by] | np.uint64(1), place[hot][by], salted[by].astype(np.int64), True)
        columns = zip(*((part, salted, nodes[used].tobytes(), key, index) for part, salted, used, key, index in rows))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.bool_(), *[pa.binary()] * 3])], names=["part", "salted", "nodes", "keys", "places"])

    def cut(key: np.ndarray, place: np.ndarray, part: np.ndarray, salted: bool) -> Iterator[tuple]:
        """Runs of one partition: its number, whether keys are salted, the places of its classes, keys, and whose each is."""
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            used, index = np.unique(place[a:b], return_inverse=True)
            wide = "<u4" if len(used) > 65535 else "<u2"
            apart = 8 * len(used) + int(wide[-1]) * (b - a) >= 8 * (b - a)
            yield int(part[a]), salted, place[a:b] if apart else used, key[a:b].astype("<u8" if salted else "<u4").tobytes(), b"" if apart else index.astype(wide).tobytes()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, salted boolean, nodes binary, keys binary, places binary")


PAIRS = "a long, b long, shared int, plain int, crowd long"


def _pairs(entries: DataFrame, parts: int, small: int) -> DataFrame:
    """(a, b, shared keys, those in no crowd) of pairs, and (null, member, null, null, crowd) for members of crowds.

    Crowds are groups over ``small`` or salted.  One task holds the distinct entries of its partition as arrays, sixteen
    bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = _no_entries(), [_no_entries()]
        for batch in batches:
            for part, salted, nodes, key, place in zip(*(batch.column(c).to_pylist() for c in ("part", "salted", "nodes", "keys", "places"))):
                key = np.frombuffer(key, dtype="<u8") if salted else np.frombuffer(key, dtype="<u4") | np.uint64(part << 32)
                nodes = np.frombuffer(nodes, dtype=np.int64)
                fresh.append((key, nodes[np.frombuffer(place, dtype=f"<u{len(place) // len(key)}")] if place else nodes))
            if sum(len(k) for k, _ in fresh) > PART_KEYS:
                held, fresh = _distinct(held, *fresh), []
        keys, members = _distinct(held, *fresh)
        del held, fresh
        if not len(keys):
            return
        names, places = np.unique(members, return_inverse=True)
        dealt, keys = (keys & np.uint64(1)).astype(np.int64), keys & ~np.uint64(1)
        order = np.lexsort((dealt, places, keys))  # a class may have a key both with and without the mark
        keys, places, dealt = keys[order], places[order], dealt[order]
        last = np.concatenate([(keys[1:] != keys[:-1]) | (places[1:] != places[:-1]), [True]])
        keys, places, dealt = keys[last], places[last], dealt[last]
        group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
        many, dealt = np.bincount(group), np.bincount(group, weights=dealt) > 0
        first = np.cumsum(many) - many
        crowded = (many > small) | dealt
        a, b, plain = [places[first[group]]], [places], [~crowded[group]]
        for k in range(1, small):  # the k-th member of small groups with the later ones
            of = np.flatnonzero((many > k + 1) & (many <= small))
            if not len(of):
                break
            rest = many[of] - k - 1
            lead = np.repeat(first[of] + k, rest)
            a.append(places[lead])
            b.append(places[lead + 1 + np.arange(len(lead)) - np.repeat(np.cumsum(rest) - rest, rest)])
            plain.append(np.repeat(~crowded[of], rest))
        a, b, plain = (np.concatenate(x) for x in (a, b, plain))
        for of in (plain, ~plain):
            some = of & (a != b)
            pair, shared = np.unique(a[some] * len(names) + b[some], return_counts=True)
            for at in range(0, len(pair), 50_000):
                p, n = pair[at : at + 50_000], shared[at : at + 50_000]
                yield _rows(names[p // len(names)], names[p % len(names)], n, n if of is plain else 0 * n, None)
        crowded = np.flatnonzero(crowded[group])
        for at in range(0, len(crowded), 50_000):
            some = crowded[at : at + 50_000]
            yield _rows(None, names[places[some]], None, None, keys[some].view(np.int64))

    return entries.repartitionById(parts, F.col("part")).mapInArrow(run, PAIRS)


def _no_entries() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


def _distinct(*entries: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, members = (np.concatenate(x) for x in zip(*entries))
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    return keys[new], members[new]


def _rows(a, b: np.ndarray, shared, plain, crowd) -> pa.RecordBatch:
    columns = [pa.array([None] * len(b) if x is None else x, k) for x, k in zip((a, b, shared, plain, crowd), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "shared", "plain", "crowd"])


def joined_by_size(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a stored ``right``: broadcast if its counted rows are few enough, else by a shuffle of both."""
    return left.join(F.broadcast(right) if (right.count() if rows is None else rows) <= BROADCAST_ROWS else right, on, how)


def _verified(docs: DataFrame, sources: DataFrame, pairs: DataFrame, size: int, percent: int, number: Numbers) -> DataFrame:
    """The stored (a, b) of the stored ``pairs`` whose sets have 100 * intersection >= percent * union.

    ``sources`` names one document per class.  Each document sends its set once for each pair and once as a partner,
    with the partner's members dealt over salts; a task then holds one partner's set at a time.
    """
    crowd = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(crowd, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    partners = crowd.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    uses = stored(members.unionByName(partners), "uses")
    often = uses.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / USES).cast("int").alias("readings"))
    wanted = uses.join(often, "node").groupBy("node", F.pmod(F.xxhash64("a", "salt"), F.col("readings")).alias("reading")).agg(F.collect_list(F.struct("a", "salt", "role")).alias("for"))
    wanted = stored(wanted.join(sources, "node").select("doc_id", "node", "for"), "wanted")
    texts = joined_by_size(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), wanted, "doc_id", rows=uses.count())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                sets = shingle_sets(texts_of(part), size)
                for s, node, uses in zip(sets, part.column("node").to_pylist(), part.column("for").to_pylist()):
                    if len(s) and number(s) == node:
                        for at in range(0, len(uses), 64):
                            some = uses[at : at + 64]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([u["a"] for u in some], pa.int64()), pa.array([u["salt"] for u in some], pa.int32()), pa.array([u["role"] for u in some], pa.int32()), pa.array([node] * len(some), pa.int64()), pa.array([s.tobytes()] * len(some), pa.binary())],
                                names=["a", "salt", "role", "node", "shingles"],
                            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partner, mine = None, np.zeros(0, dtype=np.uint64)
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, max(1, whole.num_rows), 256)):
            a, b = [], []
            for lead, salt, role, node, packed in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "node", "shingles"))):
                theirs = np.frombuffer(packed, dtype=np.uint64)
                if role == 0:
                    partner, mine = (lead, salt), theirs
                    continue
                if partner != (lead, salt):
                    raise ValueError("a member without its partner")
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                both = int((mine[at] == theirs).sum())
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    a.append(lead)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets = texts.select("text", "node", "for").mapInArrow(send, "a long, salt int, role int, node long, shingles binary")
    links = stored(sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compare, "a long, b long").distinct(), "links")
    discard(uses, wanted)
    return links


def node_components(docs: DataFrame, found: DataFrame, number: Numbers, size: int, percent: int, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """(id, component), stored, for the classes that link with another class; see the module's steps 2 to 5."""
    shingles = found.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * (100 - percent) * shingles // ((100 + percent) * PART_KEYS)))
    sources = stored(found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "sources")
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    raw = stored(_pairs(_entries(texts, size, Bands(percent), parts, hot, number), parts, small), "candidates")
    crowds = stored(raw.where("crowd is not null").select("crowd", F.col("b").alias("id")).distinct(), "crowds")
    pairs = stored(_candidates(raw.where("a is not null"), crowds), "pairs")
    discard(raw)
    sketches = found.where("node is not null").join(sources, ["node", "doc_id"]).select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    near = stored(_near(pairs, sketches, percent), "near")
    discard(pairs)

    best = stored(near.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b"), "best")
    links = [_verified(docs, sources, best, size, percent, number)]
    groups = connected_components(links[0], "a", "b")
    left = _apart(near.select("a", "b").join(best, ["a", "b"], "left_anti"), groups)
    unseen = stored(_unseen(crowds, groups), "unseen")
    discard(crowds)
    pool = stored(unseen.select("id").distinct().join(sketches, "id"), "sketches")
    tested = stored(left.unionByName(_crowd_pairs(unseen, pool, percent, nearest=True)).distinct(), "tested")
    for nearest in (True, False):
        # first what is left and each class's nearest; once these have merged components, all that are near enough
        fresh = tested if nearest else stored(_crowd_pairs(_several(unseen.select("crowd", "id"), groups), pool, percent, nearest=False).distinct().join(tested, ["a", "b"], "left_anti"), "rest")
        if not fresh.isEmpty():
            links.append(_verified(docs, sources, fresh, size, percent, number))
            discard(groups)
            groups = connected_components(reduce(DataFrame.unionByName, links), "a", "b")
        if not nearest:
            discard(fresh)
    discard(sources, near, best, unseen, pool, tested, *links)
    return groups


def _several(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(crowd, id, component) in crowds of several components."""
    member = members.join(groups, "id", "left").select("crowd", "id", F.coalesce("component", "id").alias("component"))
    apart = member.groupBy("crowd").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("crowd")
    return member.join(apart, "crowd", "left_semi")


def _unseen(crowds: DataFrame, groups: DataFrame) -> DataFrame:
    """(crowd, id, component) in crowds of several components, of classes that may have a link there not yet seen.

    Such a link shares more than SPARE crowds, so its first one, by size, is among no class's SPARE last ones.
    """
    member = _several(crowds, groups)
    sized = member.join(member.groupBy("crowd").agg(F.count(F.lit(1)).alias("members")), "crowd")
    ordered = F.sort_array(F.collect_list(F.struct("members", "crowd")))
    first = sized.groupBy("id", "component").agg(ordered.alias("crowds")).where(F.size("crowds") > SPARE)
    return first.select("id", "component", F.explode(F.slice("crowds", F.lit(1), F.size("crowds") - SPARE)).alias("of")).select("of.crowd", "id", "component")


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many bits below the largest distance of linked sets the sketches are; negative if they cannot be linked."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    alike = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return np.where(alike, (100 - percent) * (n + m) // (100 + percent) - apart, -1)


def _words(sketches: list[bytes], words: int) -> np.ndarray:
    """The sketches as rows of as many words, longer ones folded."""
    lengths = np.array([len(s) // 8 for s in sketches])
    out = np.empty((len(sketches), words), dtype=np.uint64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[at] = folded(np.frombuffer(b"".join(sketches[k] for k in at.tolist()), dtype=np.uint64).reshape(-1, n), words)
    return out


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The (a, b, shared) of ``pairs`` whose short sketches allow a link."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))
            words = np.array([min(len(s), len(t)) // 8 for s, t in zip(x, y)])
            keep = np.zeros(batch.num_rows, dtype=bool)
            for w in np.unique(words).tolist():
                at = np.flatnonzero(words == w)
                keep[at] = _close(*(_words([z[k] for k in at.tolist()], w) for z in (x, y)), n[at], m[at], percent) >= 0
            yield batch.select(["a", "b", "shared"]).filter(pa.array(keep))

    return both.select("a", "b", "shared", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, shared long")


def _crowd_pairs(members: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b), a < b, of one crowd and different components whose sketches allow a link; or each class's nearest only."""
    crowd = members.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.join(crowd, "crowd").join(sketches, "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("crowd", "id", "component", "n", "sketch", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids, component, block, n = (table.column(c).to_numpy() for c in ("id", "component", "block", "n"))
        sketches = table.column("sketch").to_pylist()
        x = _words(sketches, min(map(len, sketches)) // 8)  # one crowd's sizes lie in neighbouring bands
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        found: set[tuple[int, int]] = set()
        for k in left.tolist():
            others = right[component[right] != component[k]]
            if first == second and not nearest:
                others = others[others > k]
            if not len(others):
                continue
            close = _close(x[k], x[others], n[k], n[others], percent)
            chosen = others[close >= 0]
            if nearest and len(chosen):
                chosen = [others[close.argmax()]]
            found |= {(min(ids[k], ids[o]), max(ids[k], ids[o])) for o in chosen}
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("crowd", "i", "j").applyInArrow(compare, "a long, b long")


def _candidates(pairs: DataFrame, crowds: DataFrame) -> DataFrame:
    """(a, b, shared) of pairs that share 1 + SPARE keys, or may do so with the crowds that both are in.

    Pairs seen with few keys, all of crowds, are left to the comparison within crowds: texts that have but a passage in
    common are members of many crowds, and the smallest is another one in each.
    """
    summed = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum("plain").alias("plain"))
    often = crowds.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    a, b = often.select(F.col("id").alias("a"), F.col("n").alias("_a")), often.select(F.col("id").alias("b"), F.col("n").alias("_b"))
    doubtful = summed.where((F.col("shared") <= SPARE) & (F.col("plain") > 0)).join(a, "a").join(b, "b").where(F.col("plain") + F.least("_a", "_b") > SPARE)
    return summed.where(F.col("shared") > SPARE).unionByName(doubtful.select(*summed.columns)).select("a", "b", "shared")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not connected yet."""
    a, b = groups.select(F.col("id").alias("a"), F.col("component").alias("_a")), groups.select(F.col("id").alias("b"), F.col("component").alias("_b"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, small: int = SMALL, hot: int = HOT, bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    found, number = classes(docs, size, bits)
    groups = node_components(docs, found, number, size, percent, small, hot)
    ids = found.where("node is not null").select("node", "doc_id").distinct()
    member = ids.join(groups.withColumnRenamed("id", "node"), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    # an id that stands for several texts connects their components
    several = member.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least")).where("n > 1")
    joint = stored(member.distinct().join(several, "doc_id").select("component", "least"), "joint")
    if not joint.isEmpty():
        merged = connected_components(joint, "component", "least")
        member = member.join(merged.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select("doc_id", F.coalesce("_to", "component").alias("component"))
    least = stored(member.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    named = joined_by_size(member, least, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    named = stored(named, "named")
    discard(groups, joint, least)
    out = joined_by_size(found.select("doc_id", "n_shingles"), named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of the texts linked to theirs; rows without an id stay.

    An id with several texts is judged text by text, and keeps one row, the first by a hash, of those that are linked.
    """
    found, number = classes(docs, size)
    groups = node_components(docs, found, number, size, percent)
    ids = found.where("node is not null").select("node", "doc_id").distinct()
    member = ids.join(groups.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    least = stored(member.groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    gone = stored(joined_by_size(member, least, "component").where("doc_id <> least").select("doc_id", "node"), "gone")
    repeated = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        discard(found, groups, least, repeated)
        return joined_by_size(docs, gone.select("doc_id"), "doc_id", "left_anti")
    single = joined_by_size(joined_by_size(docs, repeated, "doc_id", "left_anti"), gone.select("doc_id"), "doc_id", "left_anti")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # its columns may be named as those here
    packed = joined_by_size(docs, repeated, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole)
    several = _with_node(packed, size, number)
    several = joined_by_size(several, gone.withColumnRenamed("node", "_node"), ["doc_id", "_node"], "left_anti")
    linked = stored(joined_by_size(member, repeated, "doc_id", "left_semi").select("doc_id", F.col("node").alias("_node"), F.col("component").alias("_component")), "linked")
    discard(found, groups, least)
    several = joined_by_size(several, linked, ["doc_id", "_node"], "left")
    order = F.struct(F.xxhash64("text"), F.xxhash64("row"))
    several = several.groupBy("doc_id", "_component", F.when(F.col("_component").isNull(), F.xxhash64("text")).alias("_text")).agg(F.min_by("row", order).alias("row"))
    return single.unionByName(several.select("row.*"))


def _with_node(docs: DataFrame, size: int, number: Numbers) -> DataFrame:
    """``docs`` with the class of each text as ``_node``; null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=STEP_BYTES):
                nodes = [number(s) if len(s) else None for s in shingle_sets(texts_of(part), size)]
                yield part.append_column("_node", pa.array(nodes, pa.int64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))
