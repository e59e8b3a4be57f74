import hashlib
import random

import public_tokenizers
import tiktoken

from graphloom.llm import bpe, queries

SF = "/root/testdata/sf0.001"


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.RANKS), special_tokens={})


def test_query_equals_tiktoken_on_every_document(spark):
    enc = reference()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_replay_equals_tiktoken_on_odd_words():
    enc, ranks = reference(), bpe.load_ranks(bpe.RANKS)
    rng = random.Random(3)
    words = ["a" * n for n in range(1, 70)] + ["ab" * 300, "é" * 99, "\u0000", "日本語" * 20]
    words += ["".join(rng.choice("abcdefgeinrst") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    words.insert(5, "")
    ids, counts = bpe.replay([w.encode() for w in words], bpe.Merges(ranks))
    ends = counts.cumsum()
    for w, b, c in zip(words, ends, counts, strict=True):
        assert ids[b - c : b].tolist() == (enc._encode_single_piece(w) if w else [])


def test_edge_rows(spark, docs):
    df = docs([(1, None, "a"), (2, "", "a"), (3, "hi", None), (3, "hi", None), (None, " x", "b"), (4, "z" * 50_000, "b")]).withColumnRenamed("lang", "ids")
    out = bpe.decode(bpe.encode(df))
    got = [(r.doc_id, len(r.ids), bytes(r.decoded)) for r in out.collect()]
    assert (1, 0, b"") in got and (2, 0, b"") in got and sum(g[0] == 3 for g in got) == 2
    assert next(g[2] for g in got if g[0] == 4) == b"z" * 50_000
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_memory_is_bounded_by_words_and_bytes(monkeypatch):
    words = bpe.Words(bpe.Merges(bpe.load_ranks(bpe.RANKS)))
    words.learn(dict.fromkeys(f"w{i}" for i in range(50)), 60)
    kept = {w: words.ids[words.start[k] : words.start[k + 1]].tolist() for w, k in words.at.items()}
    words.learn(dict.fromkeys(["w3", *(f"x{i}" for i in range(30))]), 60)
    assert set(words.at) == {"w3", *(f"x{i}" for i in range(30))} and words.ids[words.start[words.at["w3"]] : words.start[words.at["w3"] + 1]].tolist() == kept["w3"]
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 10_000)
    long = "ab" * 3000
    words.learn({long: None})
    words.learn({long[:-1] + "c": None})
    assert set(words.at) == {long[:-1] + "c"} and words.size == len(long)
