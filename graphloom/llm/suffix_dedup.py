"""Removal of long repeated byte strings by run-length indexes over parts of the corpus.

One index of a whole corpus would be one structure in one place. Texts are
therefore dealt out by content: of every 200-byte window the 64-byte string with
the lowest hash is its anchor, so equal windows have equal anchors and meet. An
anchor's context is all windows that it serves, about 270 bytes. Equal contexts
count once (each of two or more is a repeat as a whole); the different contexts
of some anchors make the text of one run-length index, whose matching statistics
mark the windows that stand in two contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .run_index import RunIndex

LENGTH = 200
GRAM = 64
#: Bytes of text hashed at once.
CHUNK = 1 << 18
#: Bytes of contexts that make an index.
INDEX_BYTES = 1 << 19
#: Different contexts up to which an anchor's are indexed in one task; the windows of an anchor
#: with more are spread over the cluster by their own hashes.
MOST_CONTEXTS = 15_000
#: Bits of the filters that say which contexts need their bytes and which anchors have too many, least and most as a power
#: of two: eight for each entry between these. Beyond the most a filter lets more through than is needed, and costs time.
FILTER_BITS = (26, 30)
#: Bytes of a text that are hashed at once, at some 80 bytes of memory each; a longer text goes in pieces that overlap by a window less one byte.
PIECE = CHUNK
#: Bytes of contexts that a task sends at once.
PART = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(41).integers(0, 2**64, 256, np.uint64, endpoint=False)
_LOW = np.uint64((1 << 28) - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash, and the inverse powers that make substring hashes place-free."""
    n = len(data)
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        for i, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers[0][:n], out=sums[1:])
    return sums, _powers[1]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Contexts of the texts in ``data``, cut at ``bounds``: text number, start, end (in data), anchor hash, context hash."""
    none = np.empty(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums, inverse = _prefix(data)
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    best = (_sliding_min(key, length - gram + 1) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    window = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at, of = best[window], text[window]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    first, last = window[new], window[np.concatenate([new[1:], [len(window)]]) - 1]
    end = last + length
    context = _mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    return of[new], first, end, grams[at[new]], context


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of runs of about CHUNK bytes."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to
        at = to


def _chunks(column: pa.Array, length: int, piece: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, where in it, bytes, bounds) of runs of texts of about CHUNK bytes, and of the pieces of long ones."""
    column = column.fill_null("")
    offsets = _offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for at, to in _runs(offsets):
        size = int(offsets[to] - offsets[at])
        if to == at + 1 and size > piece:
            for start in range(0, size - length + 1, piece):
                part = data[offsets[at] + start : min(offsets[at] + start + piece + length - 1, offsets[to])]
                yield at, start, part, np.array([0, len(part)])
        else:
            yield at, 0, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


def _contexts(column: pa.Array, length: int, gram: int):
    """anchors() of a whole batch: row, start and end in the row's text, hashes."""
    rows, starts, ends, hs, cs = [], [], [], [], []
    for row, shift, data, bounds in _chunks(column, length, PIECE):
        of, a, b, h, c = anchors(data, bounds, length, gram)
        rows.append(of + row)
        starts.append(a - bounds[of] + shift)
        ends.append(b - bounds[of] + shift)
        hs.append(h)
        cs.append(c)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(rows), join(starts), join(ends), join(hs), join(cs)


_FOUND = "h long, c long, many boolean, doc_id long, k long, start long, end long"
_DECIDED = "doc_id long, k long, start long, end long, need long, anchor long"
_WINDOWS = "h long, w long, doc_id long, k long, start long"
_BYTES = "h long, c long, doc_id long, k long, start long, bytes binary"


def _batch(names: str, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in names.split(", ")])


def _first_look(length: int, gram: int):
    """Runs inside a batch are settled there: their members become repeats, one sample goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, h, c = _contexts(batch.column(2), length, gram)
            if not len(row):
                continue
            _, first, of, n = np.unique(c, return_index=True, return_inverse=True, return_counts=True)
            ids, keys = batch.column(0), batch.column(1)
            take = lambda x, at: x.take(pa.array(at))
            yield _batch(_FOUND, [h[first].view(np.int64), c[first].view(np.int64), n > 1, take(ids, row[first]), take(keys, row[first]), start[first], end[first]])
            whole = np.flatnonzero(n[of] > 1)
            if len(whole):
                cut_at = np.flatnonzero(np.concatenate([[True], (np.diff(whole) > 1) | (np.diff(row[whole]) != 0)]))
                a, b = whole[cut_at], whole[np.concatenate([cut_at[1:], [len(whole)]]) - 1]
                gone = pa.nulls(len(a), pa.int64())
                yield _batch(_FOUND, [gone, gone, pa.nulls(len(a), pa.bool_()), take(ids, row[a]), take(keys, row[a]), start[a], end[b]])

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor and context: marks runs of two or more, and the anchors that have several runs."""
    held: pa.RecordBatch | None = None
    first_c: tuple[int, int] | None = None  # anchor and first context of the group that goes on
    seen: tuple[int, int] | None = None  # the last row given out

    def look(t: pa.Table, last: bool) -> pa.RecordBatch | None:
        nonlocal first_c, seen
        n = t.num_rows - (not last)
        if n <= 0:
            return None
        h, c = (t.column(x).to_numpy().astype(np.int64) for x in ("h", "c"))
        many = t.column("many").to_numpy().astype(bool)
        next_h = np.concatenate([h[1:] == h[:-1], [False]])
        next_c = next_h & np.concatenate([c[1:] == c[:-1], [False]])
        prev_c = np.concatenate([[seen == (h[0], c[0])], next_c[:-1]])
        new = np.concatenate([[first_c is None or first_c[0] != h[0]], ~next_h[:-1]])
        group = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        first = np.where(group >= 0, c[group], first_c[1] if first_c else 0)
        whole = many | next_c | prev_c
        need = ~next_c & (next_h | (c != first))
        first_c, seen = (int(h[n - 1]), int(first[n - 1])), (int(h[n - 1]), int(c[n - 1]))
        out = np.flatnonzero((whole | need)[:n])
        col = lambda name, gone: pa.array(t.column(name).to_numpy()[out], mask=gone[out]) if name not in ("doc_id", "k") else t.column(name).combine_chunks().take(pa.array(out))
        return _batch(_DECIDED, [col("doc_id", whole), col("k", whole), col("start", ~whole), col("end", ~whole), pa.array(c[out], mask=~need[out]), pa.array(h[out], mask=~need[out])])

    for batch in batches:
        settled = batch.filter(batch.column(0).is_null())
        if settled.num_rows:
            yield _batch(_DECIDED, [settled.column(i) for i in range(3, 7)] + [pa.nulls(settled.num_rows, pa.int64())] * 2)
        batch = batch.filter(batch.column(0).is_valid())
        if batch.num_rows:
            t = pa.Table.from_batches(([held] if held is not None else []) + [batch])
            out = look(t, False)
            held = t.slice(t.num_rows - 1).combine_chunks().to_batches()[0]
            if out is not None:
                yield out
    if held is not None and (out := look(pa.Table.from_batches([held]), True)) is not None:
        yield out


def _chosen(c: np.ndarray, bits) -> np.ndarray:
    """Which hashes the filter knows."""
    table = np.frombuffer(bits.value, np.uint8)
    slot = c & np.uint64(len(table) * 8 - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _needed(batch: pa.RecordBatch, needed, large, length: int, gram: int, of_large: bool):
    """The contexts of a batch that are needed, each once, of large anchors or of the others, about PART bytes of them at a time."""
    row, start, end, h, c = _contexts(batch.column(2), length, gram)
    if not len(row):
        return
    hit = np.flatnonzero(_chosen(c, needed) & (_chosen(h, large) == of_large))
    at = hit[np.unique(c[hit], return_index=True)[1]]
    row, start, end, h, c = (x[at] for x in (row, start, end, h, c))
    texts = batch.column(2)
    data = memoryview(texts.buffers()[2] or b"")
    base = _offsets(texts)[row]
    part = (np.cumsum(end - start) - 1) // PART
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(at) else at
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        found = [data[a:b].tobytes() for a, b in zip((base + start)[i:j].tolist(), (base + end)[i:j].tolist(), strict=True)]
        yield row[i:j], start[i:j], end[i:j], h[i:j], c[i:j], found


def _needed_bytes(needed, large, length: int, gram: int):
    """The bytes of needed contexts, but for those of large anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, _, h, c, found in _needed(batch, needed, large, length, gram, False):
                rows = pa.array(row)
                yield _batch(_BYTES, [h.view(np.int64), c.view(np.int64), batch.column(0).take(rows), batch.column(1).take(rows), start, pa.array(found, pa.binary())])

    return run


def _large_windows(needed, large, length: int, gram: int):
    """The windows of large anchors' contexts, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, end, h, _, found in _needed(batch, needed, large, length, gram, True):
                data = np.frombuffer(b"".join(found), np.uint8)
                size = end - start
                ends = np.cumsum(size)
                of = np.repeat(np.arange(len(found)), size - length + 1)
                place = np.arange(len(of)) - np.repeat(np.cumsum(size - length + 1) - (size - length + 1), size - length + 1)
                at = (ends - size)[of] + place
                sums, inverse = _prefix(data)
                w = _mix((sums[at + length] - sums[at]) * inverse[at])
                rows = pa.array(row[of])
                yield _batch(_WINDOWS, [h[of].view(np.int64), w.view(np.int64), batch.column(0).take(rows), batch.column(1).take(rows), start[of] + place])

    return run


def _match(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, k, start, end) of the stretches of each context that stand in another one too."""
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
    index = RunIndex(data, bounds)
    inside = np.ones(len(index.symbols), bool)
    inside[index.ends] = False
    hit = np.flatnonzero(index.longest_matches()[inside] >= length)
    if not len(hit):
        return []
    of = np.searchsorted(bounds, hit, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(of) != 0)]))
    a, b = hit[new], hit[np.concatenate([new[1:], [len(hit)]]) - 1] + length
    who = of[new]
    return [(rows[w][0], rows[w][1], rows[w][2] + int(x), rows[w][2] + int(y)) for w, x, y in zip(who.tolist(), a - bounds[who], b - bounds[who], strict=True)]


def _compare(length: int):
    """Rows in order of anchor: windows of different contexts of one anchor are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups so far, then the group that goes on
        closed, size, at, last = 0, 0, None, None

        def close(upto: int) -> Iterator[pa.RecordBatch]:
            out = _match(held[:upto], length) if upto > 1 else []
            if out:
                cols = list(zip(*out, strict=True))
                yield _batch("doc_id long, k long, start long, end long", [pa.array(x, pa.int64()) for x in cols])

        for batch in batches:
            for h, c, doc, k, start, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (h, c) == last:
                    continue
                if h != at:
                    if closed and len(held) - closed == 1:
                        held.pop()  # a lone context matches nothing
                    closed, at = len(held), h
                    if size >= INDEX_BYTES:
                        yield from close(closed)
                        held, closed, size = [], 0, 0
                held.append((doc, k, start, data))
                size += len(data)
                last = (h, c)
        yield from close(len(held))

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of text and start: the spans of each text, joined where they meet."""
    held: pa.Table | None = None  # joined spans of the text that goes on

    def texts(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """A row for each joined span, and where texts begin among them."""
        doc, null, k, start, end = (x.to_numpy() for x in (t.column(0).fill_null(0), t.column(0).is_null(), *t.columns[1:]))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (k[1:] != k[:-1])])
        group = np.cumsum(new) << 32  # a text is shorter than that
        reach = np.maximum.accumulate(end + group)
        first = np.flatnonzero(new | np.concatenate([[True], (start + group)[1:] > reach[:-1]]))
        stop = np.concatenate([first[1:], [len(start)]]) - 1
        out = t.take(pa.array(first)).set_column(3, "end", pa.array((reach - group)[stop]))
        return out, np.flatnonzero(new[first])

    def lists(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        spans = pa.StructArray.from_arrays([t.column(i).combine_chunks() for i in (2, 3)], fields=list(_SPAN.value_type))
        rows = pa.array(begin)
        cols = [t.column(i).combine_chunks().take(rows) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(np.append(begin, t.num_rows), pa.int32()), spans).cast(_SPAN)], names=["doc_id", "k", "spans"])

    for batch in batches:
        if batch.num_rows:
            t, begin = texts(pa.concat_tables(([held] if held is not None else []) + [pa.Table.from_batches([batch]).rename_columns(["doc_id", "k", "start", "end"])]))
            held = t.slice(begin[-1])
            if begin[-1]:
                yield lists(t.slice(0, begin[-1]), begin[:-1])
    if held is not None:
        yield lists(held, np.zeros(1, np.int64))


def _filter(values: DataFrame):
    """A broadcast bitmap of the low bits of column x, sized by the number of rows: 8 to 128 MB."""
    least, most = FILTER_BITS
    size = min(most, max(least, (8 * values.count()).bit_length()))
    slot = F.col("x").bitwiseAND((1 << size) - 1)
    parts = values.groupBy(F.shiftright(slot, 15).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits")).collect()
    bits = bytearray(1 << (size - 3))
    for part, x in parts:
        bits[part << 12 : (part << 12) + len(x)] = x
    return values.sparkSession.sparkContext.broadcast(bytes(bits))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, k, spans) of texts that hold repeats; k is the hash of the text, spans are byte ranges in order, apart.

    Two passes over the texts and no shuffle of them: the first sends a sample
    of each run inside a batch, the second the bytes of the samples that a
    filter lets through. What the filter lets through beyond need
    costs time only.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("k"), "text")
    seen = texts.mapInArrow(_first_look(length, gram), _FOUND)
    seen = seen.repartition(F.coalesce("h", "k")).sortWithinPartitions("h", "c")
    decided = stored(seen.mapInArrow(_decide, _DECIDED))
    wanted = decided.filter("need IS NOT NULL")
    needed = _filter(wanted.select(F.col("need").alias("x")))
    crowded = wanted.groupBy(F.col("anchor").alias("x")).count().filter(F.col("count") > MOST_CONTEXTS).select("x")
    large = _filter(crowded)
    sent = texts.mapInArrow(_needed_bytes(needed, large, length, gram), _BYTES).repartition("h").sortWithinPartitions("h", "c")
    found = sent.mapInArrow(_compare(length), "doc_id long, k long, start long, end long")
    if large.value.strip(b"\0"):
        each = texts.mapInArrow(_large_windows(needed, large, length, gram), _WINDOWS)
        twice = each.groupBy("h", "w").count().filter("count > 1").select("h", "w")
        found = found.union(each.join(twice, ["h", "w"]).select("doc_id", "k", "start", (F.col("start") + length).alias("end")))
    whole = decided.filter("start IS NOT NULL").select("doc_id", "k", "start", "end")
    spans = whole.union(found).repartition("doc_id", "k").sortWithinPartitions("doc_id", "k", "start")
    return spans.mapInArrow(_join_spans, "doc_id long, k long, spans array<struct<start:bigint,end:bigint>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (merged byte ranges that go) and kept (the bytes that stay) of every row.

    A byte goes if a string of ``length`` bytes covers it that starts anywhere
    else too, in this text or another. Null is the empty text; texts shorter
    than ``length`` stay whole, long ones are searched whole. Rows that are equal in id and text are repeats
    of each other. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeats(docs, length, gram).select(F.col("doc_id").alias("d"), "k", "spans")
    left = docs.withColumn("own", F.xxhash64("text"))
    both = left.join(found, left["doc_id"].eqNullSafe(found["d"]) & (left["own"] == found["k"]), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in _runs(_offsets(batch.column(1))):
                part = batch.slice(at, to - at)
                n, out, kept = [], [], []
                for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    spans = spans or []
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
                    n.append(len(text))
                    out.append(spans)
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(out, _SPAN), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, schema)
