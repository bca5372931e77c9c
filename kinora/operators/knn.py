"""Exact k nearest neighbours by inner product, over a grid of stripes.

Rows are dealt into stripes; every unordered pair of stripes is a task that ranks either one's rows among the other's.
There are a fixed number of stripes until one would exceed a bound in bytes, so a vector is sent a fixed number of times
for tables of up to a million short vectors, and a task holds two stripes, however many rows there are.  Nothing is
broadcast.  A task multiplies tiles in single precision and looks again, in double precision, at the pairs that may reach
a row's bar: the threshold, or its k-th best so far less what rounding can amount to.  Only the best k per row leave it,
a list a row, and lists are merged by row.

All pairs are multiplied: the bounds that spare an exact search some of them (norms, leading components) spare nothing
where vectors point in all directions.  What else is done with a pair is done for those near the best only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LISTS = "face_id long, nbr array<long>, similarity array<double>"
SCHEMA = "face_id long, nbr_face_id long, similarity double"
#: Stripes of a table that has a block for each, and the bytes of single precision beyond which there are more.
STRIPES, STRIPE_BYTES = 16, 16 << 20
#: Lists that a task merges.
MERGED_BYTES = 32 << 20
#: Rows and columns of a tile, which stays in a core's cache.
TILE = (256, 2048)
#: Pairs looked at again in one go, and pairs found after which those beyond the k-th place go.
AGAIN, FOUND = 1 << 16, 1 << 20
#: Products of shorter vectors do not overflow in single precision.
LONGEST = 1e18


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return (values if values.dtype == np.float32 else values.astype(np.float64)).reshape(len(column), -1)


def _places(group: np.ndarray) -> np.ndarray:
    """Each entry's place within its run of equal ones, from 0."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))


def _leading(k: int, group: np.ndarray, value: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Positions of each group's best ``k``: groups ascending, NaN before all else as in SQL, ties to the smaller."""
    order = np.lexsort((other, -value, ~np.isnan(value), group))
    return order[_places(group[order]) < k]


class _Best:
    """The best ``k`` so far of each row, none below the row's bar."""

    def __init__(self, rows: int, k: int, threshold: float):
        self.k, self.bar = k, np.full(rows, float(threshold))
        self.found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        self.size, self.limit = 0, FOUND

    def add(self, row: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        keep = ~(value < self.bar[row])
        self.found.append((row[keep], other[keep], value[keep]))
        self.size += int(keep.sum())
        if self.size > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, other, value = (np.concatenate(part) for part in zip(*self.found))
        kept = _leading(self.k, row, value, other)
        row, other, value = row[kept], other[kept], value[kept]
        last = _places(row) == self.k - 1
        self.bar[row[last]] = np.where(np.isnan(value[last]), np.inf, value[last])
        self.found, self.size, self.limit = [(row, other, value)], len(row), max(FOUND, 2 * len(row))
        return self.found[0]


class _Stripe:
    """Rows in the order of ids, at most ``k`` with the same vector: the others are among nobody's best ``k``, and their
    own neighbours are those of the first."""

    def __init__(self, table: pa.Table, k: int):
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), _matrix(table.column("embedding"))
        same = np.arange(len(x))
        if x.shape[1]:
            _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        by_vector = np.argsort(same, kind="stable")
        place = np.empty(len(x), dtype=np.int64)
        place[by_vector] = _places(same[by_vector])
        kept = np.flatnonzero(place < max(k, 1))
        first = np.zeros(len(x), dtype=np.int64)
        first[same[kept[place[kept] == 0]]] = np.flatnonzero(place[kept] == 0)
        self.all_ids, self.ids, self.source = ids, ids[kept], first[same]
        self.source[kept] = np.arange(len(kept))
        x = x[kept]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
            self.single = x.astype(np.float32)
        unsure = ~(norm < LONGEST)
        self.single[unsure] = np.nan  # no comparison excludes these
        self.norm = np.where(unsure, 0.0, norm)
        self.columns = np.ascontiguousarray(x.T)

    def lists(self, others: np.ndarray, row: np.ndarray, other: np.ndarray, value: np.ndarray) -> pa.Table:
        n = np.bincount(row, minlength=len(self.ids))
        offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        has = np.flatnonzero(n[self.source] > 0)
        take = pa.array(self.source[has])
        of = [pa.ListArray.from_arrays(offsets, pa.array(v)).take(take) for v in (others[other], value)]
        return pa.table({"face_id": pa.array(self.all_ids[has]), "nbr": of[0], "similarity": of[1]})


def _products(a: _Stripe, b: _Stripe, row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of the pairs, added up in the order of components as SQL does, so that they are the same bits
    whatever the stripes."""
    out = np.zeros(len(row))
    for x, y in zip(a.columns, b.columns):
        out += np.multiply(x[row], y[other], dtype=np.float64)
    return out


def _floor(bar: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """In single precision and not above ``bar`` less ``slack``."""
    return np.nextafter((bar - slack).astype(np.float32), np.float32(-np.inf))


def _clear(low: np.ndarray) -> np.ndarray:
    """Positions that are not set, of which there are few."""
    flat = low.ravel()
    if len(flat) % 8:
        return np.flatnonzero(~flat)
    word = np.flatnonzero(flat.view(np.uint64) != 0x0101010101010101)
    at, byte = np.nonzero(~flat.reshape(-1, 8)[word])
    return word[at] * 8 + byte


def _compare(a: _Stripe, b: _Stripe, mine: _Best, theirs: _Best | None) -> None:
    """Rank the rows of ``b`` for those of ``a`` and, with ``theirs``, the other way round too."""
    k, rounding = mine.k, (a.single.shape[1] + 8) * 2.0**-23
    slack_a, slack_b = (rounding * v.norm * w.norm.max(initial=0.0) + 1e-20 for v, w in ((a, b), (b, a)))
    room, marks, more = np.empty(TILE[0] * TILE[1], dtype=np.float32), np.empty(TILE[0] * TILE[1], dtype=bool), np.empty(TILE[0] * TILE[1], dtype=bool)
    across = np.ascontiguousarray(b.single.T)
    held, size = [], 0

    def look_again() -> None:
        row, other = (np.concatenate(part) for part in zip(*held))
        value = _products(a, b, row, other)
        mine.add(row, other, value)
        if theirs is not None:
            theirs.add(other, row, value)

    def low() -> np.ndarray:
        out = np.less(s, _floor(mine.bar[rows], slack_a[rows])[:, None], out=marks[: s.size].reshape(s.shape))
        if theirs is not None:
            out &= np.less(s, _floor(theirs.bar[columns], slack_b[columns]), out=more[: s.size].reshape(s.shape))
        return out

    for i in range(0, len(a.ids), TILE[0]):
        rows = slice(i, min(i + TILE[0], len(a.ids)))
        for j in range(0, len(b.ids), TILE[1]):
            columns = slice(j, min(j + TILE[1], len(b.ids)))
            shape = (rows.stop - i, columns.stop - j)
            s = np.matmul(a.single[rows], across[:, columns], out=room[: shape[0] * shape[1]].reshape(shape))
            at = _clear(low())
            if len(at) > s.size // 32:  # many: the best of this tile raise the bars
                sure = np.where(np.isnan(s), np.float32(-np.inf), s)
                if shape[1] >= k > 0:
                    mine.bar[rows] = np.fmax(mine.bar[rows], np.partition(sure, shape[1] - k, axis=1)[:, shape[1] - k] - slack_a[rows])
                if theirs is not None and shape[0] >= k > 0:
                    theirs.bar[columns] = np.fmax(theirs.bar[columns], np.partition(sure, shape[0] - k, axis=0)[shape[0] - k] - slack_b[columns])
                at = _clear(low())
            if len(at):
                r, c = np.divmod(at, shape[1])
                held.append((r + i, c + j))
                size += len(at)
            if size > AGAIN:
                look_again()
                held, size = [], 0
    if held:
        look_again()


def _both_ways(table: pa.Table, k: int, threshold: float) -> pa.Table:
    first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    stripes = [_Stripe(table.filter(pc.equal(table.column("stripe"), s)), k) for s in ([first, second] if first != second else [first])]
    a, b = stripes[0], stripes[-1]
    mine = _Best(len(a.ids), k, threshold)
    theirs = _Best(len(b.ids), k, threshold) if first != second else None
    with np.errstate(over="ignore", invalid="ignore"):
        _compare(a, b, mine, theirs)
    found = [a.lists(b.ids, *mine.cut())]
    return pa.concat_tables(found if theirs is None else [*found, b.lists(a.ids, *theirs.cut())])


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table.column("nbr").combine_chunks()
    face = np.repeat(table.column("face_id").to_numpy(), pc.list_value_length(lists).to_numpy())
    nbr, value = lists.flatten().to_numpy(), table.column("similarity").combine_chunks().flatten().to_numpy()
    kept = _leading(k, face, value, nbr)
    kept = kept[face[kept] != nbr[kept]]
    for at in range(0, len(kept), AGAIN):
        one = kept[at : at + AGAIN]
        yield pa.RecordBatch.from_arrays([pa.array(v[one]) for v in (face, nbr, value)], ["face_id", "nbr_face_id", "similarity"])


def stripes_of(rows: int, components: int, block_size: int) -> int:
    return max(1, min(-(-rows // block_size), max(STRIPES, -(-rows * 4 * components // STRIPE_BYTES))))


def knn_edges(faces: DataFrame, k: int = 20, threshold: float = 0.55, block_size: int = 2048) -> DataFrame:
    """Directed (face_id, nbr_face_id, similarity): each face's best ``k`` by inner product, itself among them, ties to
    the smaller id; then without itself and without those below the threshold.

    A face that is among its own best takes one of the k places.  Dropping those below the threshold first gives the
    same result, since they rank after all others.  A stripe has ``block_size`` rows at least, unless there are fewer.
    """
    rows = faces.select(F.col("id").cast("long").alias("id"), "embedding").where(F.col("embedding").isNotNull())
    length = F.size("embedding")
    n, short, long = rows.agg(F.count(F.lit(1)), F.coalesce(F.min(length), F.lit(0)), F.coalesce(F.max(length), F.lit(0))).first()
    if short != long:
        raise ValueError(f"vectors of {short} to {long} components have no inner product")
    stripes = stripes_of(n, long, block_size)
    of = rows.withColumn("stripe", F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    pairs = of.select("id", "embedding", "stripe", F.least("stripe", "with").alias("i"), F.greatest("stripe", "with").alias("j"))
    pairs = pairs.withColumn("pair", (F.col("i") * stripes - F.col("i") * (F.col("i") - 1) / 2 + F.col("j") - F.col("i")).cast("int"))
    dealt = pairs.repartitionById(stripes * (stripes + 1) // 2, "pair")
    found = dealt.groupBy("pair").applyInArrow(lambda t: _both_ways(t, k, threshold), LISTS)
    bytes_found = 16 * n * stripes * min(k, -(-n // stripes))
    return found.repartition(max(1, -(-bytes_found // MERGED_BYTES)), "face_id").mapInArrow(lambda b: _merged(b, k), SCHEMA)


def knn_edges_by_window(faces: DataFrame, k: int, threshold: float) -> DataFrame:
    """The definition as a plain plan, for tests: all pairs of a small table."""
    from kinora.functions.vectors import dot

    a, b = (faces.select(F.col("id").alias(n), F.col("embedding").alias(v)) for n, v in (("face_id", "x"), ("nbr_face_id", "y")))
    order = Window.partitionBy("face_id").orderBy(F.desc("similarity"), F.asc("nbr_face_id"))
    pairs = a.crossJoin(b).withColumn("similarity", dot(F.col("x"), F.col("y"))).withColumn("place", F.row_number().over(order))
    return pairs.where((F.col("place") <= k) & (F.col("face_id") != F.col("nbr_face_id")) & (F.col("similarity") >= threshold)).select("face_id", "nbr_face_id", "similarity")
