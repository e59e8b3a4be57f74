"""N-gram Jaccard join by MinHash banding.

A document is the set of its runs of five words. Documents of one set are one
class, named by a hash of the set. Classes whose minima agree in a band are
candidates; candidates are gathered into clusters along stars (each member of a
bucket with the bucket's smallest). Members of a cluster are put in layers by the
size of their sets, so that only one layer and the next can hold links, and the
pairs of these are verified on the full sets, in tiles of two blocks. A tile gives
sums and a spanning forest, never its pairs.

Bands follow from the recall asked for: two sets of similarity s share one of b
bands of r rows with probability 1 - (1 - s^r)^b. For 0.8, r = 6 and b = 38
that leaves out ten links in a million before clusters add more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.iterate import components, cut
from .common import WORD, map_texts, short

N = 5
THRESHOLD = 0.8
RECALL = 0.99999
ROWS = 6
BLOCK = 256
_M = np.uint64(0x9E3779B97F4A7C15)
_find = re.compile(WORD).findall


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` rows that find a pair at the threshold with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams.

    A text of fewer words than n has one n-gram, all its words; one without words has none.
    """
    words = [_find(t) for t in texts]
    flat = [w for x in words for w in x]
    code = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(flat)}
    h = np.fromiter(map(code.__getitem__, flat), np.uint64, len(flat))
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        grams = grams * _M + h[i : len(h) - n + 1 + i] if len(grams) else grams
    grams = _mix(grams)
    out = []
    for a, c in zip(ends - counts, counts, strict=True):
        if c >= n:
            out.append(np.unique(grams[a : a + c - n + 1]))
        elif c:
            x = np.zeros(1, np.uint64)
            for v in h[a : a + c]:
                x = x * _M + v
            out.append(_mix(x + np.uint64(c)))
        else:
            out.append(grams[:0])
    return out


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def _layer(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Sets of layers that differ by two or more differ too much in size to reach the threshold."""
    return np.floor(np.log(np.maximum(sizes, 1)) / -math.log(threshold) + 1e-9).astype(np.int32)


def signatures(docs: DataFrame, bands: int, rows: int = ROWS, n: int = N, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ``keep``, set_key (of the n-gram set; empty if it has none), layer (of its size), bands (a hash for each band)."""
    fields = [T.StructField("set_key", T.BinaryType()), T.StructField("layer", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
    rng = np.random.default_rng(7)
    a = (rng.integers(0, 2**32, bands * rows, np.uint32) | np.uint32(1))[:, None]
    b = rng.integers(0, 2**32, bands * rows, np.uint32)[:, None]
    tag = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def fn(texts: list[str]) -> list[pa.Array]:
        sets = shingle_sets(texts, n)
        minima = np.full((len(sets), bands * rows), 2**32 - 1, np.uint32)
        for i, s in enumerate(sets):
            low = (s >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(low), 512):
                part = (a * low[None, at : at + 512] + b).min(axis=1)
                np.minimum(minima[i], part, out=minima[i])
        keys = np.broadcast_to(tag, (len(sets), bands)).copy()
        cells = minima.reshape(len(sets), bands, rows).astype(np.uint64)
        for r in range(rows):
            keys = _mix(keys * _M + cells[:, :, r])
        full = np.array([len(s) > 0 for s in sets], bool)
        bounds = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
        return [
            pa.array([_set_key(s) for s in sets], pa.binary()),
            pa.array(_layer(np.array([len(s) for s in sets]), threshold), pa.int32()),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys[full].reshape(-1).view(np.int64))),
        ]

    return map_texts(docs, fields, fn, keep=["doc_id", *keep])


def _tile(weights: np.ndarray, side: np.ndarray, sets: list[np.ndarray], diagonal: bool, threshold: float):
    """Links inside one tile, between its two sides or within its only one: (set, weight of its partners, first set that it reaches), by number."""
    ids = np.arange(len(sets))
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, cols = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = np.bincount(cols, minlength=len(values)) > 1
    keep = shared[cols]
    rank = np.cumsum(shared) - 1
    cols, owner = rank[cols[keep]], owner[keep]
    order = np.argsort(cols, kind="stable")
    cols, owner = cols[order], owner[order]
    common = np.zeros((m, m), np.float32)
    step = 8192
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(cols, [at, at + step])
        x = np.zeros((m, step), np.float32)
        x[owner[a:b], cols[a:b] - at] = 1
        common += x @ x.T
    both = common.astype(np.float64)
    link = both / (sizes[:, None] + sizes[None, :] - both) >= threshold
    np.fill_diagonal(link, False)
    if not diagonal:
        link &= side[:, None] != side[None, :]
    total = link @ weights
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == root).all():
            break
        root = low
    some = total > 0
    return ids[some], total[some], root[some]


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, n: int = N, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id, n_links of each document; with ``keep`` also these columns, and ``component``, a key of the linked group (null without words or id).

    Two documents link if the Jaccard similarity of their n-gram sets is at
    least ``threshold``; n_links counts the others that a document links with,
    equal ones too. class_id is the smallest doc_id that links reach. Texts
    without words (null, empty, white space) link with nothing and are their own
    class, as are rows with a null id (class null). Rows that repeat an id are
    each counted, with equal texts and with others. Texts are taken whole,
    whatever their length; columns other than the two are not read. An empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    sig = cut(signatures(docs, bands_for(threshold, recall, rows), rows, n, threshold, keep))
    named = sig.filter("doc_id IS NOT NULL AND set_key <> X''")
    # candidates are gathered by c, a number of the set; two sets of one number only make a cluster larger
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("layer").alias("layer"), F.any_value("bands").alias("bands"))
    classes = cut(classes.withColumn("c", F.xxhash64("set_key")))
    cells = classes.select("c", F.explode("bands").alias("cell"))
    buckets = cells.groupBy("cell").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    stars = cells.join(buckets, "cell").filter("c <> low").select(F.col("c").alias("a"), F.col("low").alias("b"))
    clusters = components(stars).withColumnRenamed("id", "c")
    named_clusters = cut(clusters.join(classes.select("c", "copies", "set_key", "layer", "rep"), "c"))
    # a cluster of up to a block is one tile; larger ones have their layers, in blocks
    sizes = named_clusters.groupBy("component", "layer").agg(F.count("*").alias("n"))
    large = sizes.groupBy("component").agg(F.sum("n").alias("total")).filter(F.col("total") > block).select("component")
    sizes = cut(sizes.join(large, "component", "left_semi").select("component", "layer", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    beside = lambda by, name: sizes.select("component", (F.col("layer") + by).alias("layer"), F.col("blocks").alias(name))
    near = short(sizes.join(beside(-1, "above"), ["component", "layer"], "left").join(beside(1, "under"), ["component", "layer"], "left"))
    members = named_clusters.join(near, ["component", "layer"], "left").withColumn("layer", F.when(F.col("blocks").isNotNull(), F.col("layer")).otherwise(-1))
    members = cut(members.na.fill(1, ["blocks"]).na.fill(0, ["above", "under"]))

    gram = T.StructField("grams", T.ArrayType(T.LongType(), False))
    key = T.StructField("found_key", T.BinaryType())

    def fn(texts: list[str]) -> list[pa.Array]:
        sets = shingle_sets(texts, n)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        return [pa.array([_set_key(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))]

    # the texts of a class's smallest id; another text of that id is told by its set
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    texts = docs.select("doc_id", "text").join(members, docs["doc_id"] == members["rep"]).drop("doc_id", "rep", "c")
    sets = map_texts(texts, [key, gram], fn).filter("found_key = set_key").drop("found_key", "text").withColumn("own", own)
    tile = lambda lo, i, j, side: F.struct(lo.alias("lo"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    span = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(span("blocks"), lambda o: tile(F.col("layer"), F.least("own", o), F.greatest("own", o), 0))
    upward = F.transform(span("above"), lambda o: tile(F.col("layer"), F.col("own"), -1 - o, 1))
    downward = F.transform(span("under"), lambda o: tile(F.col("layer") - 1, o, -1 - F.col("own"), 2))
    tiles = sets.withColumn("t", F.explode(F.concat(inside, upward, downward))).select("component", "t.lo", "t.i", "t.j", "t.side", "own", "set_key", "copies", "grams")
    tiles = tiles.repartition("component", "lo", "i", "j").sortWithinPartitions("component", "lo", "i", "j", "set_key")
    schema = "set_key binary, links long, root binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        at = None

        def close() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            side, weights, sets_ = zip(*held.values())
            who, total, root = _tile(np.array(weights), np.array(side), list(sets_), at[2] == at[3], threshold)
            names = pa.array(list(held), pa.binary())
            return pa.RecordBatch.from_arrays([names.take(pa.array(who)), pa.array(total, pa.int64()), names.take(pa.array(root))], names=["set_key", "links", "root"])

        for batch in batches:
            comp, lo, i, j, side, own_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            keys, copies, grams = batch.column(6).to_pylist(), batch.column(7).to_pylist(), batch.column(8)
            flat, offsets = grams.values.to_numpy(zero_copy_only=False).view(np.uint64), grams.offsets.to_numpy()
            for k in range(batch.num_rows):
                tile_ = (comp[k], lo[k], i[k], j[k])
                if tile_ != at:
                    if (out := close()) is not None:
                        yield out
                    held, at = {}, tile_
                if keys[k] not in held:
                    # a tile of two layers has these as sides, a tile of one layer its two blocks
                    held[keys[k]] = (side[k] if j[k] < 0 else own_[k], copies[k], flat[offsets[k] : offsets[k + 1]].copy())
        if (out := close()) is not None:
            yield out

    found = cut(tiles.mapInArrow(run, schema))
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("set_key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "set_key")
    linked = classes.select("set_key", "rep", "copies").join(links, "set_key", "left").join(comps, "set_key", "left")
    linked = cut(linked.withColumn("component", F.coalesce("component", "set_key")))
    first = short(linked.filter("component <> set_key OR links > 0").groupBy("component").agg(F.min("rep").alias("class_id")))
    by_key = linked.join(first, "component", "left").select("set_key", "component", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = ["doc_id", "class_id", "n_links", *keep, *(["component"] if keep else [])]
    done = named.join(by_key, "set_key").select(*out)
    rest = sig.filter("doc_id IS NULL OR set_key = X''").withColumns({"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "component": F.lit(None).cast("binary")})
    return done.union(rest.select(*out))
