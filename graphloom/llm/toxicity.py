"""Toxicity by a character n-gram linear classifier scaled by naive Bayes log-count ratios.

A feature is a character n-gram that a text holds at least once, in lower case.
Its value is the log-ratio of its smoothed rates in toxic and clean labelled
texts; the weights on these values come from a regularised logistic regression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.iterate import cut
from .common import map_texts

SIZES = (4, 5)
BITS = 22
#: About so many labelled texts of each class are learnt from, those with the lowest hashes.
SAMPLE = 6_000
#: N-grams whose rates in the two classes differ by so many standard errors get a weight.
SURE = 5.0
CUT = 0.7
_P = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str], sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) for every n-gram of every text; a space pads both ends."""
    parts, owner_len = [], []
    for t in texts:
        s = f" {t.lower()} "
        parts.append(s)
        owner_len.append(len(s))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), owner_len)
    who, what = [], []
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for i in range(n):
            h *= _P
            h += codes[i : m + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h >>= np.uint64(64 - bits)
        inside = owner[:m] == owner[n - 1 :]
        who.append(owner[:m][inside])
        what.append(h[inside].astype(np.int64))
    if not who:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(who), np.concatenate(what)


def _once(who: np.ndarray, what: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((who.astype(np.int64) << bits) | what)
    return both >> bits, both & ((1 << bits) - 1)


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the bounded sample; an id with several labels is toxic if one says so, an id on several texts labels each, equal rows count once.

    The classes are counted first, so that each task drops what is beyond the
    sample's hashes by itself.
    """
    one = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    every = cut(docs.select("doc_id", F.xxhash64("text").alias("k")).join(one, "doc_id").distinct())
    n = {r[0]: r[1] for r in every.groupBy("toxic").count().collect()}
    place = F.pmod(F.shiftright(F.xxhash64("doc_id", "k", F.lit(3)), 8), F.lit(1 << 40))
    low = [(F.col("toxic") == c) & (place < int(min(1.0, per_class / m) * (1 << 40))) for c, m in n.items()]
    few = every.filter(reduce(lambda a, b: a | b, low)) if low else every  # about 2 * per_class rows of three numbers
    return docs.select("doc_id", "text", F.xxhash64("text").alias("k")).join(F.broadcast(few), ["doc_id", "k"]).dropDuplicates(["doc_id", "k"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, sure: float = SURE, strength: float = 1.0) -> dict:
    """Buckets, their weights (ratio times coefficient) and the intercept.

    Counting and feature extraction run on Spark over the bounded sample; the
    driver gets the counts of the n-grams that differ surely and the sample's hits
    on them. With no labelled texts of one class the model is constant.
    """
    sample = cut(labelled(docs, labels, per_class))
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {"bucket": [], "weight": [], "bias": 6.0 if n1 else -6.0}

    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "toxic", "clean")])

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                toxic = part.column(1).to_numpy(zero_copy_only=False) == 1
                who, what = _once(*grams([t or "" for t in part.column(0).to_pylist()]))
                bucket, of = np.unique(what, return_inverse=True)
                pos = np.bincount(of, toxic[who], len(bucket)).astype(np.int64)
                neg = np.bincount(of, ~toxic[who], len(bucket)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(pos), pa.array(neg)], names=["bucket", "toxic", "clean"])

    found = sample.select("text", "toxic").mapInArrow(count, counts).groupBy("bucket").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q"))
    a, b = F.col("p") / n1, F.col("q") / n0
    mean = (F.col("p") + F.col("q")) / (n1 + n0)
    z = F.abs(a - b) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-9)
    top = found.filter(z >= sure).select("bucket", "p", "q").collect()
    if not top:
        return {"bucket": [], "weight": [], "bias": float(np.log(n1 / n0))}
    top.sort()
    bucket = np.array([r[0] for r in top], np.int64)
    p, q = (np.array([r[i] for r in top], float) for i in (1, 2))
    ratio = np.log(((p + 1) / (n1 + 2)) / ((q + 1) / (n0 + 2)))

    fields = [T.StructField("hits", T.ArrayType(T.IntegerType(), False))]
    number = np.arange(1, len(bucket) + 1, dtype=np.int32)

    def hits(texts: list[str]) -> list[pa.Array]:
        who, what = grams(texts)
        f = _spread(bucket, number)[what]
        who, f = _once(who[f > 0], f[f > 0].astype(np.int64) - 1)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(texts)))])
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(f, pa.int32()))]

    got = map_texts(sample, fields, hits, keep=["toxic"]).toArrow().combine_chunks()
    every = got.column("hits").combine_chunks()
    counts_, flat = pc.list_value_length(every).to_numpy(zero_copy_only=False), every.flatten().to_numpy(zero_copy_only=False)
    y = got.column("toxic").to_numpy().astype(float)
    # in an order of their own, so that the sums do not depend on the order of tasks
    key = np.lexsort((np.bincount(np.repeat(np.arange(len(y)), counts_), (flat.astype(np.float64) + 1) ** 1.5, len(y)), counts_, y))
    ends = np.cumsum(counts_)
    col = np.concatenate([flat[ends[i] - counts_[i] : ends[i]] for i in key]) if len(flat) else flat
    doc, y = np.repeat(np.arange(len(y), dtype=np.int32), counts_[key]), y[key]
    weight, bias = _logistic(doc, col, ratio, y, strength)
    return {"bucket": bucket.tolist(), "weight": (weight * ratio).tolist(), "bias": float(bias)}


def _logistic(doc: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, strength: float, steps: int = 200):
    """L2-regularised logistic regression on sparse 0/1 features times ``scale``, by accelerated gradient steps.

    Both classes weigh the same in the fit; the intercept is set back to the sample's rates.
    """
    n, k = len(y), len(scale)
    value = scale[col]
    w, b = np.zeros(k), 0.0
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    row = np.bincount(doc, value**2, n)
    rate = 1.0 / (0.25 * max(1.0, np.average(row, weights=balance) * 2) + strength / n)
    vw, vb, m = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(doc, value * vw[col], n) + vb
        g = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        nw = vw - rate * (np.bincount(col, g[doc] * value, k) + strength / n * vw)
        nb = vb - rate * g.sum()
        nm = (1 + np.sqrt(1 + 4 * m * m)) / 2
        vw, vb = nw + (m - 1) / nm * (nw - w), nb + (m - 1) / nm * (nb - b)
        w, b, m = nw, nb, nm
    return w, b


def score(df: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` from 0 to 1, of every text; null scores as the empty text does."""
    bucket = np.array(model["bucket"], np.int64)
    weight = np.array(model["weight"], np.float32)
    bias = model["bias"]

    def fn(texts: list[str]) -> list[pa.Array]:
        table = _spread(bucket, weight)
        who, what = grams(texts)
        hit = table[what] != 0
        who, what = _once(who[hit], what[hit])
        z = np.bincount(who, table[what], len(texts)) + bias
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())]

    return map_texts(df, [T.StructField("score", T.DoubleType())], fn, text, keep)


_tables: dict = {}


def _spread(bucket: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A dense table of the buckets, 0 where there is none; a worker keeps the last two."""
    key = (bucket.tobytes(), values.tobytes())
    if key not in _tables:
        while len(_tables) > 1:
            _tables.pop(next(iter(_tables)))
        _tables[key] = np.zeros(1 << BITS, values.dtype)
        _tables[key][bucket] = values
    return _tables[key]


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled rows that are not held out, then score every row.

    Appends held_out, score and predicted (1 from 0.7 on). Rows with a null id
    are scored, never learnt from; null and empty texts score alike, long ones
    whole, repeated rows equally. An empty table gives no rows. Columns of
    these three names are replaced, others pass.
    """
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    out = score(docs, model, keep=keep)
    return out.withColumn("held_out", held_out()).withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int"))
