import zlib

from graphloom.llm import queries, slots

SF = "/root/testdata/sf0.01"


def test_query_on_whole_table(spark):
    rows = queries.op7_slots(spark, SF).collect()
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(k, len(t) + 1, zlib.crc32(t)) for k, t in docs.items()}
    loads = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(loads) <= 1.02 * min(loads)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_map_versions_and_growth(spark, tmp_path):
    weights = [(i * 7919) % 1000 + 1 for i in range(512)]
    one = slots.first_map(weights, 8)
    two = slots.grow(one, weights, 9)
    assert all(a == b or b == 8 for a, b in zip(one, two, strict=True))
    loads = [sum(w for w, s in zip(weights, two, strict=True) if s == k) for k in range(9)]
    assert max(loads) <= 1.05 * min(loads)
    path = str(tmp_path / "map")
    assert slots.load_map(spark, path) == (0, [])
    assert slots.current_map(spark, weights, 8, path) == one == slots.current_map(spark, weights, 8, path) and slots.load_map(spark, path) == (1, one)
    assert slots.current_map(spark, weights, 9, path)[:3] == two[:3] and slots.load_map(spark, path)[0] == 2 and slots.load_map(spark, path, 1) == (1, one)
    heavier = [w * (3 if s % 8 == 0 else 1) for s, w in enumerate(weights)]
    moved = slots.current_map(spark, heavier, 9, path)
    loads = [sum(w for w, s in zip(heavier, moved, strict=True) if s == k) for k in range(9)]
    assert max(loads) <= 1.02 * sum(heavier) / 9 and slots.load_map(spark, path)[0] == 3
    assert sum(a != b for a, b in zip(two, moved, strict=True)) < 250


def test_the_query_keeps_to_a_stored_map(spark, docs, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 9), "a") for i in range(3000)] + [(None, f"n{i}", "a") for i in range(3000)]
    path = str(tmp_path / "map")
    where = lambda n, shards: {(r.doc_id, r.text_crc32): r.shard for r in slots.shard_documents(docs(rows[:n]), shards=shards, path=path).collect()}
    one, two = where(5900, 4), where(6000, 4)
    assert sum(one[k] != two[k] for k in one) < 600 and len(set(two.values())) == 4
    three = where(6000, 5)
    assert sum(two[k] != three[k] for k in two) < 2400 and slots.load_map(spark, path)[0] >= 2
    sizes = {}
    for r in slots.shard_documents(docs(rows), shards=5, path=path).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert max(sizes.values()) <= 1.03 * min(sizes.values())


def test_edges(spark, docs):
    rows = [(1, None, "a"), (None, "x", "a"), (2, "é" * 1000, "b"), (2, "é" * 1000, "b")]
    got = slots.shard_documents(docs(rows), shards=2).collect()
    assert sorted(r["size"] for r in got) == [1, 2, 2001, 2001]
    assert slots.shard_documents(docs([])).count() == 0
