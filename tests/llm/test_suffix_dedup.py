import hashlib
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from graphloom.llm import queries, suffix_dedup
from graphloom.llm.run_index import RunIndex


def brute(rows, length):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for (i, _, _), t, g in zip(rows, texts, gone, strict=True):
        spans = sum(g[k] and not (k and g[k - 1]) for k in range(len(g)))
        out.append((i, len(t), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(
        ((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str
    )


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op8_repeats(spark, sf).collect()), key=str) == brute(rows, 200)


def test_short_strings_equal_brute_force(spark, docs):
    rng = random.Random(9)
    for alphabet, n in (("ab", 40), ("abcdefghij é", 200)):
        passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, 60))) for _ in range(8)]
        rows = []
        for i in range(n):
            parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
            rows.append((i, "".join(parts), "a"))
        rows += [(n, None, "a"), (n + 1, "", "a"), (n + 2, "x" * 300, "a"), (n + 3, rows[3][1], "b"), (None, passages[0], "b"), (3, rows[3][1], "a")]
        df = docs(rows).repartition(5)
        assert result(suffix_dedup.remove_repeats(df, length=20, gram=8)) == brute(rows, 20)
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def test_run_index_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        alphabet = rng.choice(["ab", "a", "abcdef"])
        base = "".join(rng.choice(alphabet) for _ in range(60))
        texts = []
        for _ in range(rng.randint(1, 7)):
            i = rng.randint(0, 40)
            texts.append((base[i : i + rng.randint(0, 30)] + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))).encode())
        places = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]

        def common(a, b):
            x, y = texts[a[0]][a[1] :], texts[b[0]][b[1] :]
            return next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

        index = RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        got = index.longest_matches()
        assert all(got[index.starts[k] + i] == max((common((k, i), p) for p in places if p != (k, i)), default=0) for k, i in places)
        assert len(index.head_samples) == len(index.tail_samples) == len(index.run_symbols)


def test_windows_of_large_anchors_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 1)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(30)) + passage[: 150 + 10 * i] + "#" * (i % 2), "a") for i in range(12)]
    assert result(suffix_dedup.remove_repeats(docs(rows).repartition(3))) == brute(rows, 200)


def test_long_texts_in_pieces_equal_brute_force(spark, docs, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 40)
    passages = ["".join(rng.choice("abc") for _ in range(45)) for _ in range(3)]
    rows = [(i, "".join(rng.choice([*passages, "xyz" * rng.randint(1, 20)]) for _ in range(rng.randint(1, 9))), "a") for i in range(12)]
    texts = [t.encode() for _, t, _ in rows]
    import pyarrow as pa

    whole = {(int(r), int(k)) for r, a, b, _, _ in zip(*suffix_dedup._contexts(pa.array([t for _, t, _ in rows]), 20, 8), strict=True) for k in range(a, b - 19)}
    assert whole == {(r, k) for r, t in enumerate(texts) for k in range(len(t) - 19)}
    monkeypatch.undo()
    assert result(suffix_dedup.remove_repeats(docs(rows), length=20, gram=8)) == brute(rows, 20)


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_the_index_of_one_anchor():
    rng = random.Random(1)
    passage = bytes(rng.choice(b"abcdefghij klmnop") for _ in range(210))
    rows = [(i, i, 0, passage[rng.randrange(20) :] + bytes(rng.choice(b"abcdefghij klmnop") for _ in range(rng.randrange(60, 120)))) for i in range(2000)]
    out, mb = peak_mb(lambda: suffix_dedup._match(rows, 200))
    assert mb < 90 * sum(len(r[3]) for r in rows) / 1e6
    assert {r[0] for r in out} >= {r[0] for r in rows if r[3][:200] in passage}  # at least the strings of the passage itself


def test_memory_of_a_long_text():
    text = np.random.default_rng(1).integers(97, 123, 8 << 20).astype(np.uint8).tobytes().decode()
    (row, start, end, _, _), mb = peak_mb(lambda: suffix_dedup._contexts(pa.array([text]), 200, 64))
    assert mb < 200
    assert start[0] == 0 and end[-1] == len(text) and (end - 199)[:-1].tolist() == start[1:].tolist()


def test_needed_contexts_come_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 900))) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(range(30)), pa.array(texts)], names=["doc_id", "k", "text"])
    every, none = SimpleNamespace(value=b"\xff" * 64), SimpleNamespace(value=bytes(64))
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    for large, of_large in ((none, False), (every, True)):
        parts = list(suffix_dedup._needed(batch, every, large, 200, 64, of_large))
        assert len(parts) > 5 and all(sum(map(len, p[5])) < 1000 + 400 for p in parts)
        got = sorted((int(r), int(a), int(b), x) for p in parts for r, a, b, x in zip(p[0], p[1], p[2], p[5], strict=True))
        assert got == sorted((int(r), int(a), int(b), texts[r].encode()[a:b]) for r, a, b, _, _ in zip(*suffix_dedup._contexts(batch.column(2), 200, 64), strict=True))
        assert not list(suffix_dedup._needed(batch, every, large, 200, 64, not of_large))


def test_spans_join_across_batches():
    rng = random.Random(2)
    rows = sorted({(rng.choice([None, 0, 1, 2]), rng.choice([5, 6]), s := rng.randint(0, 60), s + rng.randint(1, 9)) for _ in range(90)}, key=lambda r: (r[0] is not None, r))
    want = {}
    for d, k, a, b in rows:
        spans = want.setdefault((d, k), [])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for size in (1, 7, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=["doc_id", "k", "start", "end"]) for i in range(0, len(rows), size)]
        out = [r for x in suffix_dedup._join_spans(iter(batches)) for r in x.to_pylist()]
        assert [(r["doc_id"], r["k"]) for r in out] == list(want)
        assert {(r["doc_id"], r["k"]): [[s["start"], s["end"]] for s in r["spans"]] for r in out} == want
    assert not list(suffix_dedup._join_spans(iter([])))
