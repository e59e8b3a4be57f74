import re

from graphloom.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """Shares by weight, the excess over twice a source's size dealt out again until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            free.remove(s)
        if not free:
            return target


def test_query_on_whole_table(spark):
    rows = queries.op5_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    assert {r.doc_id: r.size for r in rows} == size and len(rows) == len(docs)
    by = {}
    for d in docs:
        by[d.source] = by.get(d.source, 0) + size[d.doc_id]
    targets = brute_targets(by)
    for s in by:
        own = [r for r in rows if r.source == s]
        assert abs(own[0].target - targets[s]) < 1e-6 * max(1, targets[s]) and {r.source_size for r in own} == {by[s]}
        assert abs(sum(r.taken for r in own) - targets[s]) <= max(r.size for r in own) / 2 + 1
        p = targets[s] / by[s]
        assert all(r.copies in (int(p), int(p) + 1) and r.taken <= 2 * r.size for r in own if r.size)
    again = {(r.doc_id, r.taken) for r in queries.op5_mixing(spark, SF).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_edges_and_many_levels(spark, docs):
    rows = [(i, "w " * (1 + i % 7), "hot") for i in range(900)] + [(i, "a b c", f"s{i % 5}") for i in range(900, 960)] + [(1000, None, None), (1001, "", "e"), (1002, "x", None), (1002, "x", None)]
    got = mixing.mix(docs(rows), fan=4).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    assert all(r.taken == 0 for r in got if r.doc_id in (1000, 1001))
    assert mixing.mix(docs(rows[:0])).count() == 0


def test_many_equal_rows_spread(spark, docs):
    rows = [(None, "a b c", "hot")] * 3000 + [(i, "w " * (1 + i % 5), "cold") for i in range(500)]
    out = mixing.mix(docs(rows), fan=8).collect()
    assert len(out) == 3500
    for s in ("hot", "cold"):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
