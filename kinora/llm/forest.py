"""Embedding near-duplicates by a random-projection tree forest.

Vectors are compared within a label only.  Equal vectors form one class first, told apart by a 128-bit hash.  For every
label a few trees are fitted on a bounded sample: each level of a tree projects on one random direction, each node
splits at its median, and vectors within a margin of the split go to both sides (spill).  The depth follows the label's
size, so leaves keep their size, and deeper trees are more; a label of fewer than twice SMALLEST classes is one leaf.
All classes of a leaf are compared exactly; a pair counts in the first leaf that both share, so it counts once.  Links
are verified cosines in double precision, counted per class; star edges per leaf connect components.

A leaf over LEAF_MOST classes is compared block by block, each pair of blocks in a task of its own.  Levels below the
sample's resolution split at the sample's overall median.  Tests measure recall against brute force.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or whose label or id is
null, links with nothing and is its own component; vectors of different lengths are not compared; components of floats
stay floats, all others become doubles; labels of any type are told apart by their value; equal vectors link with each
other; an id that is repeated with the same vector counts once per row, one that is repeated with different vectors
stands for all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinora.operators.components import connected_components
from kinora.session import discard, stored

#: Trees at most, and the least classes that a split leaves on a side.
TREES, SMALLEST = 6, 16
#: Classes that a leaf is meant to hold, and beyond which it is compared in blocks of BLOCK.
LEAF, LEAF_MOST, BLOCK = 256, 2_000, 1_000
#: Classes of a label that its trees are fitted on, about.
FIT_ROWS = 2_000
#: The margin as a share of a typical projected distance of two vectors at the threshold.
SPILL = 0.5
#: Rows that a broadcast table may have; beyond that the join shuffles.  A label's trees are 7 KB at most.
BROADCAST_ROWS, BROADCAST_LABELS = 200_000, 5_000


def comparable(embedding: Column, label: Column, vec_id: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & finite & some, F.lit(False))


def label_key(docs: DataFrame) -> Column:
    """The label as a string that is the same for equal labels only."""
    kind, label = docs.schema["label"].dataType, F.col("label")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (label + F.lit(0.0).cast(kind)).cast("string")  # one zero
    return F.to_json(F.struct("label")) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else label.cast("string")


def joined_by_size(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """Join with a stored ``right``: broadcast if its counted rows are few enough, else by a shuffle of both."""
    return left.join(F.broadcast(right) if right.count() <= (BROADCAST_ROWS if most is None else most) else right, on, how)


def directions(tree: int, levels: int, width: int) -> np.ndarray:
    """The unit directions of a tree's levels, the same wherever they are made."""
    found = np.stack([np.random.default_rng((tree, level, width)).standard_normal(width) for level in range(levels)]) if levels else np.zeros((0, width))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of doubles, each multiplied by a power of two so that no square overflows."""
    x = np.frombuffer(b"".join(packed), dtype="<f4" if len(packed[0]) == 4 * width else "<f8").reshape(-1, width).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(packed: list[bytes], width: int) -> np.ndarray:
    x = matrix(packed, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def levels_of(n: Column) -> Column:
    """A tree's depth for a label of n classes: leaves of about LEAF, but two splits at least if there is enough to split.

    Beyond 27 levels a leaf's number would not fit 32 bits; leaves that are larger then are compared in blocks.
    """
    return F.greatest(F.lit(0), F.least(F.lit(27), F.ceil(F.log2(n / LEAF))), F.least(F.lit(2), F.floor(F.log2(n / SMALLEST)))).cast("int")


def trees_of(levels: int) -> int:
    """A level parts a pair at the threshold with a probability of about 0.025, all trees together below 0.0002."""
    return 1 if levels == 0 else min(TREES, 4 + levels // 5)


def fit_tree(x: np.ndarray, tree: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians by node (children of i at 2i+1, 2i+2) down to where the sample ends, and medians by level."""
    p = x @ directions(tree, levels, x.shape[1]).T
    depth = max(0, min(levels, int(math.log2(max(1, len(x) / 8)))))
    cuts = np.zeros((1 << depth) - 1)
    node = np.zeros(len(x), dtype=np.int64)
    for level in range(depth):
        for n in range((1 << level) - 1, (2 << level) - 1):
            mine = node == n
            cuts[n] = np.median(p[mine, level]) if mine.any() else np.median(p[:, level])
        node = 2 * node + 1 + (p[:, level] > cuts[node])
    return cuts, np.median(p, axis=0) if levels else np.zeros(0)


def route(x: np.ndarray, tree: int, levels: int, cuts: np.ndarray, medians: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a row reaches; rows near a split take both ways."""
    p = x @ directions(tree, levels, x.shape[1]).T
    row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    for level in range(levels):
        inside = node < len(cuts)
        off = p[row, level] - np.where(inside, cuts[np.where(inside, node, 0)] if len(cuts) else 0.0, medians[level])
        left, right = off <= margin, off > -margin
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node


def spill_margin(threshold: float, width: int) -> float:
    return SPILL * math.sqrt(2 - 2 * threshold) / math.sqrt(width)


def digests(embeddings: DataFrame) -> DataFrame:
    """vec_id, key (label), width, digest (null if the vector is not comparable) and the vector, packed."""
    kind = embeddings.schema["embedding"].dataType.elementType
    wide = "float" if isinstance(kind, T.FloatType) else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{wide}>").alias("embedding"), F.col("label").alias("_label"), label_key(embeddings).alias("key"))
    rows = rows.select("vec_id", "key", F.when(comparable(F.col("embedding"), F.col("_label"), F.col("vec_id")), F.col("embedding")).alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2_000) for whole in batches for at in range(0, whole.num_rows, 2_000)):
            column = batch.column("embedding")
            flat = column.flatten().to_numpy(zero_copy_only=False) + (np.float32(0) if wide == "float" else 0.0)  # one zero
            widths = column.value_lengths().to_numpy(zero_copy_only=False)
            widths = np.where(np.isnan(widths), 0, widths).astype(np.int64) if widths.dtype.kind == "f" else widths.astype(np.int64)
            ends = np.cumsum(widths)
            packed = [flat[e - w : e].tobytes() if w else None for e, w in zip(ends.tolist(), widths.tolist())]
            known = [hashlib.blake2b(v, digest_size=16).digest() if v else None for v in packed]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("key"), pa.array(widths.astype(np.int32)), pa.array(known, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "key", "width", "digest", "vector"])

    return rows.mapInArrow(run, "vec_id long, key string, width int, digest binary, vector binary")


def routed(vectors: DataFrame, threshold: float) -> DataFrame:
    """``vectors`` (key, width, cls, copies, vector) with ``leaves``, the numbers of all leaves each is in; stored."""
    sizes = vectors.groupBy("key", "width").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.select("key", "width", "n", levels_of(F.col("n")).alias("levels")), "sizes")
    with_sizes = joined_by_size(vectors, sizes, ["key", "width"], most=BROADCAST_LABELS)
    sample = with_sizes.where((F.col("levels") > 0) & (F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) <= F.lit(FIT_ROWS) / F.col("n") * (1 << 30)))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        width, levels = int(rows["width"].iloc[0]), int(rows["levels"].iloc[0])
        x = unit(rows["vector"].tolist(), width)
        found = [fit_tree(x, t, levels) for t in range(trees_of(levels))]
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "width": [width], "cuts": [np.concatenate([c for c, _ in found])], "medians": [np.concatenate([m for _, m in found])]})

    models = stored(sample.groupBy("key", "width").applyInPandas(fit, "key string, width int, cuts array<double>, medians array<double>"), "trees")
    fitted = joined_by_size(with_sizes, models, ["key", "width"], "left", most=BROADCAST_LABELS)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [[] for _ in range(len(rows))]
            for (_, width), mine in rows.groupby(["key", "width"]).indices.items():
                x = unit(rows["vector"].iloc[mine].tolist(), int(width))
                cuts, medians = rows["cuts"].iloc[mine[0]], rows["medians"].iloc[mine[0]]
                # without a model, as a label's few classes may all be missed by the sample: one leaf
                levels = 0 if cuts is None else int(rows["levels"].iloc[mine[0]])
                trees = trees_of(levels)
                size = len(cuts) // trees if levels else 0
                for t in range(trees):
                    c, m = (np.asarray(cuts)[t * size : (t + 1) * size], np.asarray(medians)[t * levels : (t + 1) * levels]) if levels else (np.zeros(0),) * 2
                    row, node = route(x, t, levels, c, m, spill_margin(threshold, int(width)))
                    for r, n in zip(mine[row].tolist(), node.tolist()):
                        out[r].append(n * TREES + t)
            yield rows[["key", "width", "cls", "copies", "vector"]].assign(leaves=out)

    found = stored(fitted.mapInPandas(leaves, "key string, width int, cls long, copies long, vector binary, leaves array<int>"), "routed")
    discard(sizes, models)
    return found


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """One leaf, or two blocks of one: per linked class its links counted here, and the smallest class it connects to."""
    width = table.column("width")[0].as_py()
    cls, copies, block = (table.column(c).to_numpy() for c in ("cls", "copies", "block"))
    x = matrix(table.column("vector").to_pylist(), width)
    scale = np.linalg.norm(x, axis=1)
    first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    close = (x @ x.T) / np.outer(scale, scale) >= threshold
    close &= (block[:, None] == first) & (block[None, :] == second) | (block[:, None] == second) & (block[None, :] == first)
    np.fill_diagonal(close, False)
    rows = np.flatnonzero(close.any(axis=1))
    if len(rows):
        close = close[np.ix_(rows, rows)]
        leaf, lists = table.column("leaf")[0].as_py(), table.column("leaves").combine_chunks().take(pa.array(rows))
        owner, other = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        owner, other = owner[other < leaf], other[other < leaf]
        _, column, often = np.unique(other, return_inverse=True, return_counts=True)
        keep = often[column] > 1
        earlier = np.zeros((len(rows), len(often)), dtype=np.float32)
        earlier[owner[keep], column[keep]] = 1
        close &= earlier @ earlier.T == 0
    links = close @ copies[rows] if len(rows) else np.zeros(0, dtype=np.int64)
    root = cls[rows].copy()
    while len(rows):
        lower = np.minimum(root, np.where(close, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == root).all():
            break
        root = lower
    some = links > 0
    return pa.table({"cls": pa.array(cls[rows][some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root[some], pa.int64())})


def class_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, root) per class and leaf with links, stored, for ``vectors`` (key, width, cls, copies, vector)."""
    found = routed(vectors, threshold)
    key = ["key", "width", "leaf"]
    large = found.select("key", "width", F.explode("leaves").alias("leaf")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    large = stored(large.where(F.col("n") > LEAF_MOST).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    rows = joined_by_size(found.withColumn("leaf", F.explode("leaves")), large, key, "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(*key, "cls", "copies", "vector", "leaves", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    links = stored(rows.groupBy(*key, "i", "j").applyInArrow(lambda t: compare(t, threshold), "cls long, links long, root long"), "links")
    discard(found, large)
    return links


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    vectors = digests(embeddings)
    rows = stored(vectors.drop("vector"), "vectors")
    valid = rows.where("digest is not null")
    classes = stored(valid.groupBy("key", "digest").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies")), "classes")
    copied = stored(classes.where("copies > 1"), "copied")
    extra = stored(joined_by_size(valid, copied, ["key", "digest"]).where("vec_id <> cls").select("vec_id", "key", "digest"), "extra")
    same = ["vec_id", "key", "digest"]
    first = joined_by_size(vectors.where("digest is not null"), extra, same, "left_anti")
    again = stored(valid.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*same), "again")
    if not again.isEmpty():  # rows that repeat the first id of their class
        first = joined_by_size(first, again, same, "left_anti").unionByName(joined_by_size(first, again, same, "left_semi").dropDuplicates(same))
    first = joined_by_size(first, copied.drop("cls"), ["key", "digest"], "left")
    found = class_links(first.select("key", "width", F.col("vec_id").alias("cls"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "vector"), threshold)
    several = valid.groupBy("vec_id").agg(F.count_distinct("key", "digest").alias("n")).where("n > 1").select("vec_id")
    named = valid.join(several, "vec_id").join(classes, ["key", "digest"])
    edges = found.select(F.col("cls").alias("src"), F.col("root").alias("dst")).unionByName(named.select(F.col("vec_id").alias("src"), F.col("cls").alias("dst")))
    groups = connected_components(edges).withColumnsRenamed({"id": "cls"})
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    facts = classes.join(links, "cls", "left").join(groups, "cls", "left")
    facts = facts.select("key", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    component = F.coalesce("component", "vec_id")
    out = rows.join(facts, ["key", "digest"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
