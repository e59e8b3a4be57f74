"""Embedding near-duplicates by epsilon grid order.

Unit vectors of cosine >= t are within eps = sqrt(2 - 2t). Vectors are put in
order of label and of the eps-grid cells of their leading principal dimensions.
Consecutive runs of that order are the leaves of a tree of intervals, each with
its bounding box. The join descends from pairs of roots to pairs of leaves and
skips pairs whose boxes are over eps apart, which proves that no vector of one
is near one of the other: projections never lengthen a distance. The tree has one
root a label: intervals of a range of the order, then ranges, are put together
``FANOUT`` at a time. Leaf pairs are compared in full on all dimensions. Equal
vectors of a label are one class, named by a hash of label and vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import components, cut
from .common import short

THRESHOLD = 0.93
#: Leading principal dimensions that the grid has.
DIMS = 8
#: Vectors in a leaf, and intervals below a node.
LEAF = 1024
FANOUT = 16
#: Added to eps for rounding in the projections.
SLACK = 1e-6


def principal_axes(rows: DataFrame, dims: int = DIMS) -> np.ndarray:
    """The leading axes of the unit vectors of ``rows`` (column v), by the covariance summed on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if not len(x):
                continue
            x /= np.linalg.norm(x, axis=1)[:, None]
            x = np.hstack([x, np.ones((len(x), 1))])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    sums = rows.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x")).collect()  # (d + 1)^2 numbers
    if not sums:
        return np.zeros((0, 0))
    d = max(r[0] for r in sums)
    m = np.zeros((d + 1, d + 1))
    for i, j, x in sums:
        m[i, j] = x
    mean = m[:d, d] / m[d, d]
    values, axes = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
    return axes[:, np.argsort(-values)[: min(dims, d)]]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def leaves(rows: DataFrame, axes: np.ndarray, eps: float, leaf: int = LEAF) -> DataFrame:
    """The rows in grid order, cut into leaves: part and seq name a leaf, p is the projection."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3))
            if len(x):
                p = (x / np.linalg.norm(x, axis=1)[:, None]) @ axes
                cells = np.floor(p / eps).astype(np.int32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(t)) for a, t in ((p, pa.float64()), (cells, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "p", "cell"])

    put = rows.select("label", "key", "copies", "v").mapInArrow(project, "label string, key string, copies long, v array<double>, p array<double>, cell array<int>")
    put = put.repartitionByRange("label", "cell", "key").sortWithinPartitions("label", "cell", "key").withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, label, n = -1, None, 0
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                if x != label or n == leaf:
                    seq, label, n = seq + 1, x, 0
                n += 1
                out.append(seq)
            keep = [batch.schema.get_field_index(c) for c in ("label", "key", "copies", "v", "p", "part")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.int64())], names=["label", "key", "copies", "v", "p", "part", "seq"])

    return put.mapInArrow(number, "label string, key string, copies long, v array<double>, p array<double>, part int, seq long")


def leaf_pairs(rows: DataFrame, dims: int, eps: float, fanout: int = FANOUT) -> DataFrame:
    """Pairs of leaves whose boxes are within eps, by descending pairs of intervals from one root a label."""
    box = lambda side, f: F.array(*(f(F.col(side)[i]) for i in range(dims)))
    level = cut(rows.groupBy("label", "part", "seq").agg(box("p", F.min).alias("low"), box("p", F.max).alias("high")))
    levels, ups = [level], []
    seqs, parts = (x or 0 for x in level.agg(F.max("seq"), F.max("part")).first())
    while seqs or parts:
        # leaves of a range first, then the ranges themselves
        up = {"part": F.col("part"), "seq": F.floor(F.col("seq") / fanout)} if seqs else {"part": F.floor(F.col("part") / fanout).cast("int"), "seq": F.col("seq")}
        seqs, parts = (seqs // fanout, parts) if seqs else (0, parts // fanout)
        ups.append(up)
        level = cut(level.withColumns(up).groupBy("label", "part", "seq").agg(box("low", F.min).alias("low"), box("high", F.max).alias("high")))
        levels.append(level)
    gap = " + ".join(f"pow(greatest(0D, a.low[{i}] - b.high[{i}], b.low[{i}] - a.high[{i}]), 2)" for i in range(dims))
    near = f"({gap}) <= {(eps + SLACK) ** 2!r}D AND (a.part, a.seq) <= (b.part, b.seq)"
    pairs = levels[-1].select("label", F.col("part").alias("a_part"), F.col("seq").alias("a_seq"), F.col("part").alias("b_part"), F.col("seq").alias("b_seq"))
    node = F.struct("part", "seq", "low", "high")
    for level, up in zip(reversed(levels[:-1]), reversed(ups), strict=True):
        side = lambda s: level.select("label", up["part"].alias(f"{s}_part"), up["seq"].cast("long").alias(f"{s}_seq"), node.alias(s))  # noqa: E731, B023
        both = pairs.join(side("a"), ["label", "a_part", "a_seq"]).join(side("b"), ["label", "b_part", "b_seq"]).filter(near)
        pairs = cut(both.select("label", F.col("a.part").alias("a_part"), F.col("a.seq").alias("a_seq"), F.col("b.part").alias("b_part"), F.col("b.seq").alias("b_seq")))
    return pairs


def _compare(v: np.ndarray, weight: np.ndarray, side: np.ndarray, threshold: float):
    """Links of one leaf pair: (row, weight of its partners, smallest row that it reaches), rows by number."""
    norm = np.sqrt((v * v).sum(axis=1))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(b)
    b = a if same else b
    link = (v[a] @ v[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold
    if same:
        np.fill_diagonal(link, False)
    total = np.zeros(len(v), np.int64)
    total[a] += link @ weight[b]
    if not same:
        total[b] += weight[a] @ link
    root = np.arange(len(v))
    none = np.iinfo(np.int64).max
    while True:
        old = root.copy()
        root[a] = np.minimum(root[a], np.where(link, root[b][None, :], none).min(axis=1))
        root[b] = np.minimum(root[b], np.where(link, root[a][:, None], none).min(axis=0))
        if (old == root).all():
            break
    some = total > 0
    return np.flatnonzero(some), total[some], root[some]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, dims: int = DIMS, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors link if their labels are equal and not null, they have equally many
    components, and their cosine, in double precision, is at least ``threshold``.
    A vector that is null or zero, or holds null, NaN or infinite components,
    links with nothing, nor does one with a null id; it is its own component.
    Rows of one id count each, with equal vectors or others; an empty table gives
    no rows; columns other than the three are not read.
    """
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce(F.forall("v", number) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    key = F.concat_ws("/", F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "v", "label"))
    keyed = every.withColumn("usable", usable).withColumn("key", key).withColumn("label", F.concat_ws("/", F.size("v"), "label"))
    good = keyed.filter("usable")
    longest = good.agg(F.max(F.size("v"))).first()[0] or 0
    # shorter vectors are filled with zeros: their labels keep them apart
    most = F.array_max(F.transform("v", F.abs))
    tame = F.when(most.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / most))  # squares stay finite and above zero
    full = F.concat(tame, F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))
    classes = cut(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first(full).alias("v")))
    eps = math.sqrt(2 - 2 * threshold)
    axes = principal_axes(classes, dims)
    ordered = cut(leaves(classes, axes, eps, leaf))
    pairs = leaf_pairs(ordered, max(1, axes.shape[1]), eps)
    a = pairs.withColumnsRenamed({"a_part": "part", "a_seq": "seq"}).select("label", "part", "seq", F.concat_ws("/", "label", "part", "seq", "b_part", "b_seq").alias("tile"), F.lit(0).alias("side"))
    b = pairs.filter("a_part <> b_part OR a_seq <> b_seq").withColumnsRenamed({"b_part": "part", "b_seq": "seq"}).select("label", "part", "seq", F.concat_ws("/", "label", "a_part", "a_seq", "part", "seq").alias("tile"), F.lit(1).alias("side"))
    tiles = ordered.join(a.union(b), ["label", "part", "seq"]).select("tile", "side", "key", "copies", "v")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                side, copies = (t.column(c).to_numpy() for c in ("side", "copies"))
                who, total, root = _compare(_matrix(t.column("v").chunk(0)), copies, side, threshold)
                names = t.column("key").chunk(0)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), pa.array(total, pa.int64()), names.take(pa.array(root))], names=["key", "links", "root"])

        for batch in batches:
            tile = batch.column(0).to_pylist()
            start = 0
            for i in range(1, len(tile) + 1):
                if i == len(tile) or tile[i] != tile[start]:
                    if tile[start] != at:
                        yield from close()
                        held, at = [], tile[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        yield from close()

    found = cut(tiles.mapInArrow(run, "key string, links long, root string"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key")
    named = cut(classes.select("key", "rep", "copies").join(links, "key", "left").join(comps, "key", "left").withColumn("component", F.coalesce("component", "key")))
    first = short(named.filter("component <> key OR links > 0").groupBy("component").agg(F.min("rep").alias("component_id")))
    named = named.join(first, "component", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    done = good.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    rest = keyed.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
