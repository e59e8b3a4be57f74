"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A spot is an anchor and the next ``CHAIN`` content words. Where no anchor stands
among the ``GAP`` words before a word, that word is an anchor too, so texts in
other languages, lists and code have spots as well. A fingerprint is the set of
a text's spots; likeness is Jaccard. For comparison across a corpus sets are
partitioned by length: sets of lengths a <= b can reach t only if a >= t * b.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAIN = 2
GAP = 12
THRESHOLD = 0.8
#: Common words of four languages.
ANCHORS = frozenset(
    """
    a an and are as at be been by for from had has have he her his i in is it its not of on or she that the their they
    this to was we were which with you
    au aux avec ce cette dans de des du elle en est et il la le les ne nous ou par pas pour que qui se son sur un une
    aber als auch auf aus bei das dem den der des die ein eine einen er es für ich im ist mit nicht noch sich sie sind
    so und von war wie wird zu zum zur
    al como con del desde el ella ellos era es ese esta este fue ha los las lo más muy no para pero por porque
    se sin su sus también y ya
    """.split()
)
_find = re.compile(r"\w+").findall
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spots(texts: list[str], chain: int = CHAIN, gap: int = GAP) -> list[np.ndarray]:
    """Sorted distinct 32-bit spot hashes of each text; a text without words has one, of the whole text, or none if empty."""
    words = [_find(t.lower()) for t in texts]
    flat = [w for x in words for w in x]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    starts = ends - counts
    total = len(flat)
    names = dict.fromkeys(flat)
    for w in names:
        names[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    stop = {names[w] for w in ANCHORS if w in names}
    h = np.fromiter(map(names.__getitem__, flat), np.uint64, total)
    common = np.isin(h, np.fromiter(stop, np.uint64, len(stop)))
    at = np.arange(total)
    first = np.repeat(starts, counts)
    last = np.maximum.accumulate(np.where(common, at, -1)) if total else at
    previous = np.concatenate([[-1], last[:-1]]) if total else at
    anchor = np.flatnonzero(common | (previous < np.maximum(first, at - gap)))
    content = np.flatnonzero(~common)
    k = np.searchsorted(content, anchor, side="right")
    end = np.repeat(ends, counts)[anchor] if total else anchor
    sig = h[anchor] * _M
    for i in range(chain):
        j = content[np.minimum(k + i, len(content) - 1)] if len(content) else np.full(len(anchor), total)
        inside = (k + i < len(content)) & (j < end)
        sig = _mix(sig) + np.where(inside, h[np.minimum(j, max(0, total - 1))] if total else sig, np.uint64(0))
    sig = (_mix(sig) >> np.uint64(32)).astype(np.uint32)
    bounds = np.searchsorted(anchor, np.concatenate([starts, [total]]))
    out = []
    for i, t in enumerate(texts):
        if counts[i]:
            out.append(np.unique(sig[bounds[i] : bounds[i + 1]]))
        else:
            out.append(np.array([xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass"))] if t else [], np.uint32))
    return out


def as_text(spots_: np.ndarray) -> str:
    """Eight hex digits a spot, in order."""
    return spots_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two spot sets; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def length_partition(size: Column, threshold: float = THRESHOLD) -> Column:
    """Sets of one partition or of neighbouring ones may reach the threshold, others cannot."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(1 / threshold))).cast("int")


def similar_classes(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of classes of equal fingerprints, each named by its smallest doc_id.

    ``prints`` has doc_id and fingerprint. Within a length partition and its
    upper neighbour, classes meet on the first spots in hash order only: of n
    spots, n - ceil(t * n) + 1. Lengths are compared before sets are. Rows without an
    id are in no class, empty fingerprints in no pair; equal fingerprints are one class, so no pair
    either. An empty table gives no rows.
    """
    spot_list = F.when(F.length("fingerprint") == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.length("fingerprint") / 8 - 1).cast("int")), lambda i: F.substring("fingerprint", i * 8 + 1, 8))
    )
    classes = prints.filter("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("id")).select("id", spot_list.alias("s")).withColumn("n", F.size("s"))
    prefix = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    keyed = classes.filter("n > 0").withColumn("p", length_partition(F.col("n"), threshold)).select("id", "s", "n", "p", F.explode(prefix).alias("spot"))
    low = keyed.select(F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("p"), "spot", F.struct("id", "n", "s", F.col("p").alias("own")).alias("x"))
    high = keyed.select("p", "spot", F.struct("id", "n", "s", F.col("p").alias("own")).alias("y"))
    pairs = low.join(high, ["p", "spot"]).filter("(x.own < y.own OR x.id < y.id) AND least(x.n, y.n) >= greatest(x.n, y.n) * %r" % threshold)
    common = F.size(F.array_intersect("x.s", "y.s"))
    value = common / (F.col("x.n") + F.col("y.n") - common)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), value.alias("jaccard")).filter(F.col("jaccard") >= threshold).distinct()


def _splits(docs: DataFrame, per_bucket: int, most: int) -> list[int]:
    rows = docs.count()
    n = max(1, min(most, rows // per_bucket))
    found = docs.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return sorted({int(x) for x in found})


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many splits are at most the key, by binary search in a literal array."""
    if not splits:
        return F.lit(0)
    array = f"array({','.join(f'{s}L' for s in splits)})"
    top = len(splits).bit_length()
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(top))))
    value = lambda i: F.get(F.expr(array), i - 1)
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(splits)) & (value(p + s) <= key), p + s).otherwise(p))


def fingerprint(docs: DataFrame, per_bucket: int = 1000, most: int = 8192) -> DataFrame:
    """Fingerprints of each text and of its edited text, and two likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as
    many of the next document in descending doc_id (rows of one id by text; null
    ids come last); after the last comes the first. Null is the empty text. A
    lone document is its own next. An empty table gives no rows. Other columns are not read.

    Documents are dealt to buckets of neighbouring ids; the first row of each
    bucket is dealt to the bucket before it as well, so every row meets its next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    splits = _splits(docs.select("doc_id"), per_bucket, most)
    docs = docs.withColumn("bucket", F.coalesce(_bucket(F.col("doc_id"), splits), F.lit(-1)))
    heads = {r[0]: r[1] for r in docs.groupBy("bucket").agg(F.max("doc_id")).collect()}  # one row a bucket
    order = sorted(heads)
    before = dict(zip(order, order[1:] + order[:1], strict=True))  # the bucket whose last row needs this one's first
    at = F.col("bucket") + 1
    literal = lambda values, kind: F.get(F.expr(f"array({','.join('null' if v is None else f'{v}L' for v in values)})").cast(f"array<{kind}>"), at)
    every = range(-1, len(splits) + 1)
    is_head = F.col("doc_id").eqNullSafe(literal([heads.get(b) for b in every], "bigint"))
    own, more = F.struct(F.col("bucket").cast("int").alias("b"), F.lit(0).alias("role")), F.struct(literal([before.get(b) for b in every], "int").alias("b"), F.lit(1).alias("role"))
    dealt = docs.withColumn("x", F.explode(F.when(is_head, F.array(own, more)).otherwise(F.array(own)))).select("x.b", "x.role", "doc_id", "text")
    dealt = dealt.repartition("b").sortWithinPartitions("b", "role", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, n_spots int, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                new = list(zip(part["b"], part["role"], part["doc_id"], part["text"], spots(part["text"]), strict=True))
                rows = held + new
                held = rows[-1:]
                todo = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and x[1] == 0]
                if todo:
                    yield _compare(todo, names)

    return dealt.mapInArrow(run, schema)


def _compare(todo: list[tuple], names: list[str]) -> pa.RecordBatch:
    edited = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in todo]
    other = spots(edited)
    cols = [
        pa.array([x[2] for x, _ in todo], pa.int64()),
        pa.array([len(x[3]) for x, _ in todo], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array([as_text(x[4]) for x, _ in todo]),
        pa.array([as_text(s) for s in other]),
        pa.array([len(x[4]) for x, _ in todo], pa.int32()),
        pa.array([likeness(x[4], s) for (x, _), s in zip(todo, other, strict=True)], pa.float64()),
        pa.array([likeness(x[4], y[4]) for x, y in todo], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=names)
