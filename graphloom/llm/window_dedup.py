"""Substring dedup by level-wise doubling over windows of words.

Rows are packed, as they are read, into pieces of about ``PIECE`` bytes, stored
compressed. Of the short windows inside a long one the one of least hash is its
seed, so equal long windows have equal seeds at equal places. Level by level a
piece sends the distinct hashes of its seeds, grown to the level's length, to
buckets by hash; a bucket answers one bit a hash: whether another piece has it.
Windows whose seed is repeated, there or within the piece, grow to twice the
length, the others are given up; the loop ends at the full length, or when no
window is left. At the full length hashes travel with the smallest id of the
piece and the bit says whether a smaller one has the window.

A hash that many documents share reaches its bucket once a piece. No row is
grouped by document, source or text, so no key of theirs can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut
from .common import stored

#: Bytes of text a piece, and of text a bucket.
PIECE = 2 << 20
#: Words of the shortest level at least.
SHORTEST = 5
#: Bytes of text that are hashed at a time; a longer word is hashed whole.
CHUNK = 1 << 20
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
_KEYS = "piece long, bucket long, level int, body binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mixed(np.arange(1, 257, dtype=_U) * _U(_P))


def _powers(n: int, p: int) -> np.ndarray:
    out = np.full(n, p, dtype=_U)
    out[:1] = 1
    return np.cumprod(out)


def levels(size: int) -> list[int]:
    """Lengths from the shortest to ``size``, each at most twice the last one."""
    out = [size]
    while (half := -(-out[0] // 2)) >= SHORTEST:
        out.insert(0, half)
    return out


class Words:
    """The words of a column of texts: where each begins and ends, of which row it is, its hash."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        texts = pa.concat_arrays([texts])
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.at, self.data = at, data[: at[-1]]
        full = ~BLANK[self.data]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        edges = at[(at > 0) & (at < at[-1])]
        first[edges] = full[edges]
        last[edges - 1] = full[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(at[1:], self.start, side="right")
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=_U)
        up = down = np.empty(0, dtype=_U)
        i = 0
        while i < len(out):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + CHUNK, side="right")))
            n = int(self.end[j - 1] - low)
            if n > len(up):
                up, down = _powers(max(n, CHUNK), _P), _powers(max(n, CHUNK), pow(_P, -1, 1 << 64))
            sums = np.zeros(n + 1, dtype=_U)
            np.cumsum(_BYTES[self.data[low : low + n]] * up[:n], out=sums[1:])
            s, e = self.start[i:j] - low, self.end[i:j] - low
            out[i:j] = _mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
            i = j
        return out

    def windows(self, size: int, salt: int) -> np.ndarray:
        """A hash of the ``size`` words from each word on, by doubling; the last ``size`` - 1 words have none."""
        h, n = _mixed(self.hash + _U(salt)), 1
        while n < size:
            step = min(n, size - n)
            h = _mixed((h[: len(h) - step] * _U(_P)) ^ (h[step:] + _U(2 * n + salt)))
            n += step
        return h


def _seeds(h: np.ndarray, span: int) -> np.ndarray:
    """Where the least of the ``span`` values from each one on stands, the first of equal ones."""
    value, place, n = h, np.arange(len(h)), 1
    while n < span:
        step = min(n, span - n)
        first = value[: len(value) - step] <= value[step:]
        value = np.where(first, value[: len(value) - step], value[step:])
        place = np.where(first, place[: len(place) - step], place[step:])
        n += step
    return place


class _Keys:
    """The windows of a piece at one level, and their distinct hashes in the order of buckets and keys."""

    def __init__(self, words: Words, ids: pa.Array, size: int, length: int, buckets: int, shown: np.ndarray | None = None) -> None:
        n = len(words.start)
        base = levels(size)[0]
        known = np.asarray(ids.is_valid())
        number = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        if n < size:
            at = np.empty(0, dtype=np.int64)
        else:
            at = np.arange(n - size + 1)
            at = at[(words.row[at] == words.row[at + size - 1]) & known[words.row[at]]]
        if shown is not None:
            at = at[shown[at]]
        self.at = at
        if not len(at):
            self.key, self.bucket, self.least, self.inside = (np.empty(0, dtype=t) for t in (_U, np.int64, np.int64, bool))
            self.of = self.id = np.empty(0, dtype=np.int64)
            return
        place = at if length == size else np.clip(_seeds(words.windows(base, 1), size - base + 1)[at] - (length - base) // 2, at, at + size - length)
        key = words.windows(length, 2)[place]
        if length < size:
            key >>= _U(32)
        bucket = (words.windows(length, 3)[place] % _U(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        k, b, i = key[order], bucket[order], number[words.row[at[order]]]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        runs = np.flatnonzero(new)
        self.key, self.bucket = k[runs], b[runs]
        self.least = np.minimum.reduceat(i, runs)
        self.inside = self.least < np.maximum.reduceat(i, runs)
        self.of = np.empty(len(k), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1  # the hash of each window
        self.id = number[words.row[at]]

    def sent(self, whole: bool) -> Iterator[tuple[int, bytes]]:
        """(bucket, its hashes, with the least ids where they are whole)."""
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(self.key)], strict=True):
            if a < b:
                yield int(self.bucket[a]), self.key[a:b].tobytes() + self.least[a:b].tobytes() if whole else self.key[a:b].astype(np.uint32).tobytes()

    def told(self, answers: pa.Table) -> np.ndarray:
        """For each hash the bit that its bucket answered."""
        bits = np.zeros(len(self.key), dtype=bool)
        for bucket, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True):
            a, b = np.searchsorted(self.bucket, (bucket, bucket + 1))
            bits[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a)
        return bits


def pieces(df: DataFrame) -> DataFrame:
    """(piece, bytes, body): rows packed in the order in which they are read, about ``PIECE`` bytes of text together."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_pydict({"bytes": pa.array([table.nbytes], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            ends = np.cumsum(np.full(batch.num_rows, 16) + pc.fill_null(pc.binary_length(batch.column("__text__")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(batch.num_rows, int(np.searchsorted(ends, before + PIECE - size)) + 1)
                waiting.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= PIECE:
                    yield packed(waiting)
                    waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    return stored(df.mapInArrow(run, "bytes long, body binary").withColumn("piece", F.monotonically_increasing_id()))


def _rows(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all().combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _survivors(words: Words, ids: pa.Array, size: int, buckets: int, answers: pa.Table) -> np.ndarray | None:
    """Of each word: is its window of ``size`` words still a candidate after the levels answered? At the full length: is it removed?"""
    shown = None
    for length in sorted(set(answers["level"].to_pylist())):
        keys = _Keys(words, ids, size, length, buckets, shown)
        bits = keys.told(answers.filter(pc.equal(answers["level"], length)))
        shown = np.zeros(len(words.start), dtype=bool)
        shown[keys.at] = (bits[keys.of] | (keys.id > keys.least[keys.of])) if length == size else (bits | keys.inside)[keys.of]
    return shown


def judged(keys: DataFrame, whole: bool) -> DataFrame:
    """The buckets' answers to pieces, a bit for each hash that a piece sent: another piece has it, or has it with a smaller id."""

    def judge(group: pa.Table) -> pa.Table:
        bodies = group["body"].to_pylist()
        n = np.array([len(x) // (16 if whole else 4) for x in bodies])
        key = np.concatenate([np.frombuffer(x, _U if whole else np.uint32, count=k) for x, k in zip(bodies, n, strict=True)])
        order = np.argsort(key, kind="stable")
        runs = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        size = np.diff(np.append(runs, len(key)))
        bit = np.empty(len(key), dtype=bool)
        if whole:
            ids = np.concatenate([np.frombuffer(x, np.int64, offset=8 * k) for x, k in zip(bodies, n, strict=True)])
            bit[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], runs), size)
        else:
            bit[order] = np.repeat(size > 1, size)
        out = [np.packbits(x).tobytes() for x in np.split(bit, np.cumsum(n)[:-1])]
        return pa.table({"piece": group["piece"], "bucket": group["bucket"], "level": group["level"], "body": pa.array(out, pa.binary())})

    return keys.groupBy("bucket").applyInArrow(judge, _KEYS)


def remove_repeats(df: DataFrame, size: int = 13, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Append n_words, n_removed (long) and kept (string) to every row of ``df``.

    Words are runs of anything but ASCII white space. A word goes if a window of
    ``size`` words of one text covers it whose words also start, in order, in a row
    with a smaller id; windows are judged on the input. What is kept is joined by
    one space. Windows of rows with equal ids do not remove each other, so repeated
    rows give equal results. Rows with a null id lose nothing and remove nothing.
    Null and empty texts have no words; an empty table gives no rows. Long texts
    are read whole; a piece holds one of any length. Ids are numbers. Columns that
    have the new names are replaced.
    """
    new = ("n_words", "n_removed", "kept")
    keep = [c for c in df.columns if c not in new]
    # the text and the id travel once
    alike = {text: ("__text__", "string"), id_col: ("__id__", "bigint")}
    names = [alike[c][0] if c in alike and df.schema[c].dataType.simpleString() == alike[c][1] else f"c{i}" for i, c in enumerate(keep)]
    also = {"__text__": F.col(f"`{text}`").cast("string"), "__id__": F.col(f"`{id_col}`").cast("long")}
    own = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), *(x.alias(n) for n, x in also.items() if n not in names))
    packed = pieces(own)
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    buckets = 1 << (total // PIECE).bit_length()
    todo = levels(size)
    body = packed.select("piece", "body")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, packed_rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from emitted(piece, packed_rows.as_py(), todo[0], None).to_batches()

    def emitted(piece: int, packed_rows: bytes, length: int, answers: pa.Table | None) -> pa.Table:
        rows = _rows(packed_rows)
        words, ids = Words(_column(rows, "__text__")), _column(rows, "__id__")
        shown = None if answers is None else _survivors(words, ids, size, buckets, answers)
        out = list(_Keys(words, ids, size, length, buckets, shown).sent(length == size))
        columns = ([piece] * len(out), [b for b, _ in out], [length] * len(out))
        return pa.table({**{k: pa.array(x, t) for k, x, t in zip(("piece", "bucket", "level"), columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)}, "body": pa.array([x for _, x in out], pa.binary())})

    def grow(length: int):
        def fn(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return emitted(key[0].as_py(), left["body"][0].as_py(), length, right)

        return fn

    answers = new_answers = cut(judged(body.mapInArrow(first, _KEYS), todo[0] == size))
    for length in todo[1:]:
        if new_answers.isEmpty():  # no candidate is left
            break
        keys = body.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(grow(length), _KEYS)
        new_answers = cut(judged(keys, length == size))
        answers = answers.union(new_answers)

    kinds = [own.schema[n] for n in names]
    schema = own.select(*names).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}).schema

    def last(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _rows(left["body"][0].as_py())
        words, ids = Words(_column(rows, "__text__")), _column(rows, "__id__")
        gone = np.zeros(len(words.start) + 1, dtype=np.int64)
        if size in right["level"].to_pylist():
            at = np.flatnonzero(_survivors(words, ids, size, buckets, right))
            np.add.at(gone, at, 1)
            np.add.at(gone, at + size, -1)
        gone = np.cumsum(gone[:-1]) > 0
        n = len(rows)
        count, lost = np.bincount(words.row, minlength=n), np.bincount(words.row[gone], minlength=n)
        data, ends = words.data.tobytes(), np.searchsorted(words.row, np.arange(n + 1))
        kept = []
        for i in range(n):
            own_words = data[words.at[i] : words.at[i + 1]].split()
            if lost[i]:
                own_words = [w for w, g in zip(own_words, gone[ends[i] : ends[i + 1]], strict=True) if not g]
            kept.append(b" ".join(own_words).decode())
        found = [pa.array(count, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())]
        return pa.table([*(rows[k.name] for k in kinds), *found], names=[k.name for k in kinds] + list(new))

    out = body.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(last, schema)
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))
