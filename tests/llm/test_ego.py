import numpy as np

from graphloom.llm import ego, queries

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    ids = [r[0] for r in rows]
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {k: [] for k in range(len(rows))}
    v = {k: np.array(np.array(rows[k][1], np.float32), np.float64) for k in good}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and v[a] @ v[b] / (np.sqrt(v[a] @ v[a]) * np.sqrt(v[b] @ v[b])) >= threshold:
                link[a].append(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for m in link[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        c = min(ids[m] for m in seen)
        out.append((ids[k], len(link[k]), c, ids[k] == c))
    return sorted(out)


def test_query_on_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op2_ego(spark, SF).collect()) == brute(rows)


def test_many_leaves_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12))
    v = (centres[rng.integers(0, 30, 400)] + rng.normal(size=(400, 12)) * 0.25).astype(np.float32)
    rows = [(i, x.tolist(), int(i % 3 == 0)) for i, x in enumerate(v)]
    rows += [(400 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ego.near_duplicates(df, leaf=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_edges(spark):
    rows = [
        (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, float("nan")], 1), (4, [1.0, None], 1), (5, [1.0, 0.0], None), (6, [1.0, 0.0], None),
        (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [float("inf"), 1.0], 1), (10, [], 1), (11, [1.0, 0.0], 2),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in ego.near_duplicates(df).collect()}
    assert got == {*((i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)), (7, 2, 7, True), (8, 2, 7, False)}
    assert ego.near_duplicates(df.limit(0)).count() == 0


def test_ids_on_several_vectors_labels_as_text_and_lengths(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.01, 1.0], "a"), (3, [1.0, 0.02], "a"), (3, [1.0, 0.0, 0.0], "a"), (4, [1.0, 0.0, 0.1], "a"), (5, [1.0, 0.0], "b"), (6, [1e-200, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in ego.near_duplicates(df, leaf=1).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False)])


def test_many_ranges_end_in_one_root(spark):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(rng.normal(size=(300, 6)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(tuple(r) for r in ego.near_duplicates(df, leaf=2).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(rows)
