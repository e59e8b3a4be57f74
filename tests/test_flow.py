"""Queries without SQL against plain loops, and small cases with known answers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import conflicts, forest, graphs, lattice, trees
from graphloom.queries import flow

SF = "/root/testdata/sf0.001"


def test_unique_on_known_forests(spark):
    cases = {
        "used in turns": ([(0, "Alloc", None), (1, "Copy", 0), (2, "LoadAddr", 1), (3, "Copy", 0), (4, "LoadAddr", 3), (5, "StoreAddr", 1)], {0, 1, 2, 3, 4, 5}),
        "one after the other": ([(0, "Alloc", None), (1, "Copy", 0), (2, "StoreAddr", 1), (3, "Copy", 0), (4, "StoreAddr", 3)], set()),
        "lent inside": ([(0, "Alloc", None), (1, "Copy", 0), (2, "Copy", 1), (3, "StoreAddr", 2), (4, "LoadAddr", 1)], set()),
        "clash below only": ([(0, "Alloc", None), (1, "Copy", 0), (2, "Copy", 1), (3, "Copy", 1), (4, "LoadAddr", 2), (5, "Copy", 0)], {1, 2, 3, 4}),
        "two fields": ([(0, "Alloc", None), (1, "Project", 0, [4]), (2, "Project", 0, [5]), (3, "Copy", 1), (4, "Copy", 2), (5, "LoadAddr", 3)], set()),
        "field and whole": ([(0, "Alloc", None), (1, "Project", 0, [4]), (2, "Copy", 1), (3, "Copy", 0), (4, "LoadAddr", 2)], {0, 1, 2, 3, 4}),
        "root projection keeps its children": ([(0, "Project", None, [1]), (1, "Copy", 0), (2, "Copy", 0), (3, "LoadAddr", 1)], {0, 1, 2, 3}),
    }
    rows = [(g, i, k, s, f[0] if f else []) for g, (ns, _) in cases.items() for i, k, s, *f in ns]
    df = spark.createDataFrame(rows, "graph_id string, node_id long, kind string, source long, field array<int>")
    out = forest.unique_nodes(df).collect()
    assert {g: {r.node_id for r in out if r.graph_id == g and not r.unique} for g in cases} == {g: bad for g, (_, bad) in cases.items()}


def test_chains_of_any_depth(spark):
    n = 300
    df = spark.range(n).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("source"), F.when(F.col("id") == 200, "StoreAddr").otherwise("Copy").alias("kind"), F.lit(0).alias("offset"))
    assert forest.needs_write(df).count() == 201
    assert {r[0] for r in forest.last_descendants(df).select("last_desc").distinct().collect()} == {n - 1}
    assert forest.flow_nodes(df).agg(F.min("store"), F.max("store"), F.count("store")).first() == (200, 200, 201)
    tree = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("mod").alias("kind"), F.lit(True).alias("pub"))
    assert trees.descendants(spark.createDataFrame([(10,)], "id long"), tree).count() == n - 11
    assert trees.mark_public(spark.createDataFrame([(7, "x")], "id long, label string"), tree, "x").count() == n - 7
    t = trees.with_desc_tests(tree, F.col("id") == 100).agg(F.sum(F.col("any_desc").cast("int")), F.sum(F.col("every_desc").cast("int"))).first()
    assert t == (100, 1)
    b = spark.createDataFrame([(1, n - 1)], "block long, loop long")
    assert graphs.enclosing_loops(b, tree.select(F.col("id").alias("loop"), "parent")).agg(F.count("*"), F.max("depth")).first() == (n, n - 1)
    proj = df.withColumn("kind", F.when((F.col("node_id") > 0) & (F.col("node_id") < n - 1), "Project").otherwise("Copy")).withColumn("field", F.array(F.col("node_id").cast("int")))
    last = forest.collapsed_children(proj).filter(F.col("node_id") == n - 1).first()
    assert last.parent == 0 and list(last.path) == list(range(1, n - 1))


def test_flow_takes_the_highest_child_not_the_largest_id(spark):
    rows = [("g", 0, None, "Copy", 0), ("g", 1, 0, "Copy", 0), ("g", 4, 0, "LoadAddr", 0), ("g", 5, 1, "LoadAddr", 0)]
    out = forest.flow_nodes(spark.createDataFrame(rows, "graph_id string, node_id long, source long, kind string, offset long"))
    assert {r.node_id: r.load for r in out.collect()} == {0: 4, 1: 5, 4: 4, 5: 5}


def test_projections_collapse_into_paths(spark):
    rows = [("g", 0, None, "Copy", []), ("g", 1, 0, "Project", [3]), ("g", 2, 1, "Project", [5]), ("g", 3, 2, "Copy", []), ("g", 4, 0, "Copy", []), ("g", 5, 3, "Copy", [])]
    out = forest.collapsed_children(spark.createDataFrame(rows, "graph_id string, node_id long, source long, kind string, field array<int>"))
    assert {r.node_id: (r.parent, list(r.path)) for r in out.collect()} == {0: (None, []), 3: (0, [3, 5]), 4: (0, []), 5: (3, [])}


def plain_fold(rows):
    """A run of events by linear search: entries are start -> (size, graph, node), nodes of a graph a list of destinations."""
    entries, graphs_, seen, out = {}, [], set(), []
    for e in rows:
        kind = flow.ev.NODE_KINDS.get(e.kind)
        if e.kind == "BeginFuncBody":
            seen.clear()
        if e.kind == "AddrOfLocal":
            kind = "Copy" if (e.func, e.local) in seen else kind
            seen.add((e.func, e.local))
        if kind is None:
            continue

        def look(p):
            below = [s for s in entries if s <= p]
            if not below:
                return None, None
            s = max(below)
            size = entries[s][0]
            return (entries[s][1:] if (s == p if size is None else p <= s + size) else None), s

        hit, _ = look(e.ptr)
        if kind in flow.ev.ROOTS or hit is None:
            g, source = len(graphs_), None
            graphs_.append([])
        else:
            g, source = hit
            want = (e.source_local, [])
            if e.source_local is not None and list(e.source_path) == []:
                source = next((i for i in reversed(range(len(graphs_[g]))) if graphs_[g][i] == want), source)
        n = len(graphs_[g])
        graphs_[g].append((e.dest_local, list(e.dest_path)))
        out.append((e.run_id, e.seq, g, n, source, kind))
        if e.kind in ("Alloc", "AddrOfLocal"):
            entries[e.ptr] = (e.size, g, n)
        elif e.kind == "AddrOfSized":
            entries.setdefault(e.ptr, (e.size, g, n))
        elif e.kind == "Free":
            if e.ptr:
                entries.pop(e.ptr, None)
        elif e.kind in ("CopyPtr", "Offset", "Project"):
            p = e.ptr if e.kind == "CopyPtr" else e.new_ptr
            hit, floor = look(p)
            if hit is None and (floor is None or entries[floor][0] is None or e.kind == "CopyPtr"):
                entries[p] = (None, g, n)
    return out


def test_sources_by_destination_and_overwritten_locals(spark):
    kinds = "run_id string, seq long, kind string, ptr long, new_ptr long, size long, func string, local long, source_local long, dest_local long, source_path array<int>, dest_path array<int>"
    rows = [
        ("r", 0, "Alloc", 100, None, 8, "f", 0, None, 1, [], []),
        ("r", 1, "CopyPtr", 100, None, None, "g", 0, 1, 2, [], []),  # from node 0: the place is the same in another function
        ("r", 2, "CopyPtr", 100, None, None, "f", 0, 2, 3, [7], []),  # a part of a place finds no destination: the pointer's node
        ("r", 3, "CopyPtr", 100, None, None, "f", 0, 2, 2, [], [7]),  # from node 1; its own destination is a part
        ("r", 4, "LoadAddr", 100, None, None, "f", 0, 2, None, [], []),  # still from node 1
        ("s", 0, "AddrOfLocal", 50, None, 4, "f", 1, None, None, [], []),
        ("s", 1, "AddrOfLocal", 50, None, 4, "f", 1, None, None, [], []),  # taken again: a copy, and the entry from now on
        ("s", 2, "LoadAddr", 52, None, None, "f", 0, None, None, [], []),
        ("s", 3, "Arg", 900, None, None, "f", 0, None, None, [], []),  # an unknown pointer; only copies of pointers are remembered
        ("s", 4, "Arg", 900, None, None, "f", 0, None, None, [], []),
        ("s", 5, "CopyPtr", 0, None, None, "f", 0, None, None, [], []),
    ]
    df = spark.createDataFrame(rows, kinds).withColumn("offset", F.lit(0).cast("long"))
    got = {(r.run_id, r.seq): (r.graph_id, r.node_id, r.source, r.is_null) for r in flow.ev.provenance(df).collect()}
    assert [got["r", i] for i in range(5)] == [(0, 0, None, False), (0, 1, 0, False), (0, 2, 0, False), (0, 3, 1, False), (0, 4, 1, False)]
    assert [got["s", i] for i in range(6)] == [(0, 0, None, False), (0, 1, 0, False), (0, 2, 1, False), (1, 0, None, False), (2, 0, None, False), (3, 0, None, True)]


def test_provenance_fold_and_node_kinds(spark):
    runs = {}
    for e in flow.event_log(spark, SF).orderBy("run_id", "seq").collect():
        runs.setdefault(e.run_id, []).append(e)
    want = [x for rows in runs.values() for x in plain_fold(rows)]
    got = [(r.run_id, r.seq, r.graph_id, r.node_id, r.source, r.kind) for r in flow.provenance_fold(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kinds = {}
    for r in flow.node_kinds(spark, SF).filter("node_kind IS NOT NULL").collect():
        kinds[r.node_kind] = kinds.get(r.node_kind, 0) + r.n
    assert kinds == Counter(w[5] for w in want)


def test_masked_permissions(spark):
    perms = {r.id: r.perms for r in flow.pointers(spark, SF).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    fixed = {r.o_orderkey: lattice.WRITE for r in orders if r.o_orderstatus == "P"}
    subs = [(r.a, r.b, r.except_mask) for r in flow.subsets(spark, SF).collect()]
    for r in orders:
        if r.o_orderpriority == "1-URGENT":
            perms[r.o_orderkey] = (perms[r.o_orderkey] | lattice.READ) & ~lattice.LINEAR
    restrict = lambda i, new: (new & ~fixed.get(i, 0)) | (perms[i] & fixed.get(i, 0))
    changed = True
    while changed:
        changed = False
        for a, b, mask in subs:
            pa, pb = perms[a], perms[b]
            up = pb & lattice.OFFSETS & ~mask if pa & lattice.FREE else 0
            new = restrict(a, (pa | up) & ~(~pb & lattice.DOWN & ~mask)), restrict(b, pb | (pa & lattice.UP & ~mask))
            changed |= new != (pa, pb)
            perms[a], perms[b] = new
    assert {r.id: r.perms for r in flow.perm_masked(spark, SF).collect()} == perms


def test_permissions_flow_to_the_superset(spark):
    def run(ps, subs, given=None):
        p = spark.createDataFrame([(i, v, f) for i, (v, f) in ps.items()], "id long, perms int, forbidden int")
        g = given and spark.createDataFrame(given, "id long, kind string, mask int")
        return {r.id: r.perms for r in lattice.propagate(p, spark.createDataFrame(subs, "a long, b long, except_mask int"), g).collect()}

    w, u, f, o = lattice.WRITE, lattice.UNIQUE, lattice.FREE, lattice.OFFSET_ADD
    assert run({1: (w, 0), 2: (0, 0)}, [(1, 2, 0)]) == {1: w, 2: w}
    assert run({1: (0, 0), 2: (w | u, 0)}, [(1, 2, 0)]) == {1: 0, 2: w | u}
    assert run({1: (u, 0), 2: (0, 0)}, [(1, 2, 0)]) == {1: 0, 2: 0}
    assert run({1: (f, 0), 2: (o, 0)}, [(1, 2, 0)]) == {1: f | o, 2: f | o}
    assert run({1: (f, 0), 2: (o, 0)}, [(1, 2, o)]) == {1: f, 2: f | o}
    assert run({1: (w | u, u), 2: (0, w)}, [(1, 2, 0)]) == {1: w | u, 2: 0}
    assert run({1: (lattice.LINEAR, 0), 2: (0, 0)}, [(1, 2, 0)]) == {1: lattice.LINEAR, 2: 0}
    assert run({1: (0, 0), 2: (u, 0)}, [(1, 2, 0)], [(1, "all_perms", w | u), (1, "no_perms", 0)]) == {1: w | u, 2: w | u}
    with pytest.raises(Exception, match="contradict"):
        run({1: (w, 0), 2: (0, 0)}, [(1, 2, 0)], [(2, "no_perms", w)])
    n = 12
    assert set(run({i: (w if i == 0 else 0, 0) for i in range(n)}, [(i, i + 1, 0) for i in range(n - 1)]).values()) == {w}


def test_cells_are_taken_from_the_superset(spark):
    w, u = lattice.WRITE, lattice.UNIQUE
    run = lambda ps, subs: sorted(r.id for r in lattice.cells(spark.createDataFrame(list(enumerate(ps, 1)), "id long, perms int"), spark.createDataFrame(subs, "a long, b long")).collect())
    assert run([w | u, w], [(1, 2)]) == [1, 2]  # into a, whatever its bits
    assert run([w, w | u], [(1, 2)]) == [1]  # not into b with both bits
    assert run([w, 0, u], [(1, 2), (2, 3)]) == [1, 2, 3]


def test_loops_entry_writes_and_refinement(spark):
    loops = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "loop long, parent long")
    blocks = spark.createDataFrame([(10, 2), (11, 3), (12, 2), (13, None)], "block long, loop long")
    e = graphs.enclosing_loops(blocks, loops)
    common = lambda *b: [r.loop for r in graphs.tightest_common_loop(e, spark.createDataFrame([(x,) for x in b], "block long")).collect()]
    assert common(10, 12) == [2] and common(10, 11) == [1] and common(10, 13) == []
    rows = [("f", 1, "p", 7, True, False), ("f", 2, "p", 8, True, False), ("f", 3, "p", 9, False, False), ("f", 4, "p", 10, False, False), ("f", 4, "p", 11, True, True), ("f", 5, "p", 12, False, False), ("f", 6, "p", 13, False, False)]
    st = spark.createDataFrame(rows, "func string, block long, place string, stmt long, writes boolean, partial boolean")
    edges = spark.createDataFrame([("f", *e) for e in ((1, 3), (2, 3), (1, 6), (3, 4), (4, 5))], "func string, src long, dst long")
    entry = lattice.block_entry_writes(st, edges)
    assert sorted((r.block, r.low == r.high) for r in entry.collect()) == [(3, False), (4, False), (5, False), (6, True)]
    assert {r.stmt: r.write for r in lattice.recent_writes(st, entry).collect()} == {7: None, 8: None, 9: None, 10: None, 11: None, 12: None, 13: 7}
    p = spark.createDataFrame([(1, lattice.UNIQUE | lattice.READ, 0), (2, lattice.UNIQUE, 0)], "id long, perms int, forbidden int")
    s = spark.createDataFrame([(1, 2, 0)], "a long, b long, except_mask int")
    out = lattice.refined(p, s, lambda f: f.filter("id = 2"))
    assert {r.id: r.perms for r in out.collect()} == {1: lattice.READ, 2: lattice.READ}
    v = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 2)], "id long, low long")
    le = spark.createDataFrame([(1, 2)], "a long, b long")
    caps = spark.createDataFrame([(3, 1)], "id long, cap long")
    mins = spark.createDataFrame([(2, 3), (2, 4)], "id long, part long")
    assert {tuple(r) for r in lattice.bounds(v, le, caps, mins=mins).collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 2)}


def test_paths_and_attributes(spark):
    t = spark.createDataFrame([(0, None, [], None), (1, 0, ["a", "b"], ["inline"]), (2, 0, ["x", "a", "b"], [])], "id long, parent long, path array<string>, attrs array<string>")
    ids = lambda c: sorted(r.id for r in t.filter(c).collect())
    assert ids(trees.path_is(0, ["a", "b"])) == [1] and ids(trees.path_is(1, ["a", "b"])) == [2] and ids(trees.has_attr("inline")) == [1]
    assert [r.id for r in trees.item(t, ["a", "b"]).collect()] == [1]


def test_steps(spark):
    step = "array<struct<kind:string,index:long,literal:boolean,splittable:boolean>>"
    f = lambda i, s=True: ("Field", i, True, s)
    x = lambda i, lit=True, s=False: ("Index", i, lit, s)
    rows = [
        ([f(1)], [f(2)], True), ([f(1)], [f(1), f(2)], False), ([x(1)], [x(2)], False), ([x(1, s=True)], [x(2, s=True)], True), ([f(1), x(1, False), f(1)], [f(1), x(9), f(2)], False),
        ([f(1, False), f(1)], [f(1, False), f(2)], False), ([f(1, False)], [f(2)], False), ([], [f(2)], False),
    ]
    df = spark.createDataFrame(rows, f"a {step}, b {step}, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", conflicts.separable(F.col("a"), F.col("b"))).collect())


def test_components_take_every_line(spark, tmp_path):
    from graphloom.queries.trees import components_all_parts, components_parts

    lines = [(1, 7, 50, 0.1), (2, 7, 50, 0.1), (3, 7, 1, 0.0), (3, 8, 2, 0.0), (4, 8, 3, 0.05), (5, 9, 50, 0.0), (6, 9, 1, 0.1), (7, 5, 1, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, 10 + o) for o in range(1, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.id: r.component for r in components_parts(spark, str(tmp_path)).collect()} == {11: 11, 12: 11}
    want = {c: c for c in range(11, 18)}
    for _ in lines:
        for o, part, *_ in lines:
            want[10 + o] = min(want[10 + x[0]] for x in lines if x[1] == part or x[0] == o)
    assert {r.id: r.component for r in components_all_parts(spark, str(tmp_path)).collect()} == want == {11: 11, 12: 11, 13: 11, 14: 11, 15: 15, 16: 15, 17: 17}


def test_repeated_graphs_are_whole_and_few_ids_are_gathered(spark, tmp_path):
    day = lambda u, kinds: [(u * 10 + i, f"2024-01-01 00:00:0{i}", u, k) for i, k in enumerate(kinds)]
    rows = [e for u in range(1, 10) for e in day(u, ["view"] * 3 + ["click"] * (u > 7))]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    ids = lambda *us: ",".join(f"{u}/2024-01-01" for u in us)
    got = flow.repeated_whole_histories(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(2, ids(8, 9)), (7, ids(1, 2, 3, 4, 5))]
    plan = got._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_runs_are_folded_in_batches_with_sources_by_destination(spark):
    n = 400
    rows = [("r", 0, "Alloc", 100, None, 50, None, 0)]
    rows += [("r", i, "CopyPtr", 100, None, None, (i - 1) % 3 if i % 5 else 9, i % 3) for i in range(1, n)]
    rows += [("s", i, "Alloc" if i == 0 else "LoadAddr", 7, None, 1, None, None) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id string, seq long, kind string, ptr long, new_ptr long, size long, source_local long, dest_local long")
    df = df.withColumns({"offset": F.lit(0).cast("long"), "func": F.lit("f"), "local": F.lit(0).cast("long")})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        out = flow.ev.provenance(df)
        got = {(r.run_id, r.seq): (r.graph_id, r.node_id, r.source) for r in out.collect()}
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set(key, before)
    want, last = {("r", 0): (0, 0, None)}, {0: 0}
    for i in range(1, n):
        want["r", i] = (0, i, last.get((i - 1) % 3 if i % 5 else 9, 0))
        last[i % 3] = i
    want |= {("s", i): (0, i, None if i == 0 else 0) for i in range(n)}
    assert got == want
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_classes_are_numbered_without_a_global_window(spark):
    nodes = spark.createDataFrame([(i, i % 7 == 3) for i in range(600)], "id long, is_global boolean")
    equal = spark.createDataFrame([(i, i + 300) for i in range(0, 300, 2)], "a long, b long")
    out = lattice.renumbered(nodes, equal)
    first = {i: i - 300 if i >= 300 and i % 2 == 0 else i for i in range(600)}
    number = {f: n for n, f in enumerate(sorted(set(first.values())))}
    assert {r.id: r.number for r in out.collect()} == {i: number[f] for i, f in first.items()}
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
