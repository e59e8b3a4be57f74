"""Byte-level BPE by merge replay over distinct words.

Texts come in batches of 256 rows or about a megabyte. The distinct words of a
batch that the worker has not met are laid out in one row of symbols, with an
inverted index from merge rank (that is, from token pair) to the positions where
the pair stands. Ranks are taken in order; each merge touches its two neighbours
only, which enter the index anew. The words' ids are then dealt back to the documents. A worker remembers the
words that it has met up to a bound and then starts afresh; this costs time only.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Words whose ids a worker remembers, and bytes of them; beyond either the memory starts afresh.
REMEMBERED, REMEMBERED_BYTES = 450_000, 24 << 20

IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))
DECODED = T.StructField("decoded", T.BinaryType())


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """A rank file as tables: the id of each byte, and the id that each pair of ids merges to."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        get = ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.of_bytes = np.full(1 << 16, -1, np.int64)
        for x in range(256):
            for y in range(256):
                self.of_bytes[x << 8 | y] = get(bytes([x, y]), -1)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words and how many each has, as by merging the lowest-ranked, leftmost pair again and again."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    total = len(data)
    if not total:
        return np.empty(0, np.int32), lengths
    last = ends[lengths > 0] - 1
    start = ends - lengths
    rank = merges.of_bytes[data[:-1] << 8 | data[1:]]
    rank[last[:-1]] = -1
    place = np.flatnonzero(rank >= 0)
    place = place[np.argsort(rank[place], kind="stable")]
    distinct, cuts = np.unique(rank[place], return_index=True)
    index = {r: x.tolist() for r, x in zip(distinct.tolist(), np.split(place, cuts[1:]), strict=True)} if len(distinct) else {}
    sym = merges.of_byte[data].tolist()  # the token that starts here; -1 once merged into its left neighbour
    sym.append(-1)
    after = np.arange(1, total + 1)
    after[last] = total
    before = np.arange(-1, total - 1)
    before[start[lengths > 0]] = total
    after, before = after.tolist(), before.tolist()
    heap = list(index)
    heapq.heapify(heap)
    pair = merges.pairs.get
    push = heapq.heappush
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        places.sort()
        waits: list[int] = []
        held = -1  # the end of a word in which this merge made a pair of lower rank: that one goes first
        for i in places:
            j = after[i]
            if pair(sym[i] << 20 | sym[j]) != r:
                continue
            if i < held:
                waits.append(i)
                continue
            sym[i] = r
            sym[j] = -1
            k = after[j]
            after[i] = k
            if k < total:
                before[k] = i
                q = pair(r << 20 | sym[k])
                if q is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        push(heap, q)
                    if q < r:
                        held = ends[np.searchsorted(ends, i, "right")]
            h = before[i]
            if h < total:
                q = pair(sym[h] << 20 | r)
                if q is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        push(heap, q)
                    if q < r:
                        held = ends[np.searchsorted(ends, i, "right")]
        if waits:
            if r not in index:
                index[r] = []
                push(heap, r)
            index[r] += waits
    ids = np.array(sym[:total], np.int32)
    alive = np.concatenate([[0], np.cumsum(ids >= 0)])
    return ids[ids >= 0], alive[ends] - alive[start]


class Words:
    """Ids of the words met so far, in flat arrays: word w has ids[start[w]:start[w + 1]]."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)
        self.size = 0

    def learn(self, words: Iterable[str], most: int = REMEMBERED) -> None:
        """The ids of all these words are there afterwards; what was there goes if there would be more than ``most`` words or too many bytes."""
        new = [w for w in words if w not in self.at]
        if not new:
            return
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        size = sum(map(len, data))
        if self.at and (len(self.at) + len(new) > most or self.size + size > REMEMBERED_BYTES):
            self.clear()
            new = list(words)
            data = [w.encode("utf-8", "surrogatepass") for w in new]
            size = sum(map(len, data))
        ids, counts = replay(data, self.merges)
        at = len(self.at)
        self.size += size
        self.at.update(zip(new, range(at, at + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])


_words: dict[str, Words] = {}
_tokens: dict[str, list[bytes]] = {}


def _bytes_of(ids: pa.Array, ranks: str) -> pa.Array:
    """The bytes that each list of ids stands for; null for null."""
    if ranks not in _tokens:
        by_rank = load_ranks(ranks)
        _tokens[ranks] = sorted(by_rank, key=by_rank.get)
    token = _tokens[ranks].__getitem__
    flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    data = [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.array(data, pa.binary(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def encode(df: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = PATTERN, keep: list[str] | None = None, decoded: bool = False, remember: int = REMEMBERED) -> DataFrame:
    """Append ``ids``, the token ids of each text, and if asked for ``decoded``, the bytes that these ids stand for.

    Every match of ``pattern`` is encoded apart from the others; special tokens
    are ordinary text. Every token longer than a byte has to be the merge of two
    others, as in rank files made by merging. Null and empty texts have no ids,
    repeated rows equal ones; long words take n log n time; an empty table gives
    no rows; columns of these names are replaced. ``remember`` bounds the words that a
    worker keeps between batches; it changes the time that is taken, never the ids.
    """
    find = regex.compile(pattern).findall

    def fn(texts: list[str]) -> list[pa.Array]:
        words = _words.get(ranks) or _words.setdefault(ranks, Words(Merges(load_ranks(ranks))))
        found = [find(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = [w for x in found for w in x]
        del found
        words.learn(dict.fromkeys(flat), remember)
        which = np.fromiter(map(words.at.__getitem__, flat), np.int64, len(flat))
        del flat
        lengths = words.start[which + 1] - words.start[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(words.start[which] - (ends - lengths), lengths)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(words.ids[source], pa.int32()))
        return [ids, _bytes_of(ids, ranks)] if decoded else [ids]

    return map_texts(df, [IDS, DECODED] if decoded else [IDS], fn, text, keep)


def decode(df: DataFrame, ids: str = "ids", ranks: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Append ``decoded``, the bytes that ``ids`` stand for. Null ids give null; an unknown id is an error."""
    keep = [c for c in (df.columns if keep is None else keep) if c != DECODED.name]
    schema = T.StructType([df.schema[c] for c in keep] + [DECODED])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(width)), _bytes_of(part.column(width), ranks)], names=schema.names)

    return df.select(*keep, F.col(ids).alias("__ids__")).mapInArrow(run, schema)
