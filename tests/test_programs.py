import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.hashes import jodyhash, nested_hash, wrapped_product
from graphloom.operators import bisection, graphs, keyed
from graphloom.plans.iterate import shared_folder
from graphloom.queries import programs, sets

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1
NUMBER = {"tinyint": 5, "smallint": 6, "int": 7, "bigint": 8, "boolean": 10}


def jody(words):
    h = 0
    turn = lambda x: (x << 14 | x >> 50) & M
    for w in words:
        h = ((turn(turn((h + w + 0x1F3D5B79) & M) ^ w) ^ 0x1F3D5B79) + w) & M
    return h


def plain_hash(v, kind, depth):
    if v is None:
        return int.from_bytes(b"NullStar", "little")
    if isinstance(kind, T.StructType):
        return jody(plain_hash(v[f.name], f.dataType, depth - 1) for f in kind.fields) if depth else int.from_bytes(b"LeafRcrd", "little")
    if isinstance(kind, T.ArrayType):
        # the array's fixed value is the word of the format, whose letters are not quite "LeafArry"
        return jody(plain_hash(x, kind.elementType, depth - 1) for x in v) if depth else 0x797272414661654C
    return (int(v) & M) ^ (0x5A5A5A5A5A5A5A5A * NUMBER[kind.simpleString()] & M)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_nested_hashes_equal_recursion(spark):
    kind = T._parse_datatype_string("a: bigint, b: struct<c: array<struct<d: int, e: array<smallint>>>, f: boolean>, g: tinyint")
    rows = [(-1, ([(1, [1, 2, None]), (None, []), None], True), -128), (2**63 - 1, None, None), (0, (None, False), 1), (5, ([], None), 0)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    for depth in range(7):
        got = {r.i: r.h for r in df.select("i", nested_hash(F.col("v"), kind, depth).alias("h")).collect()}
        assert got == {r.i: signed(plain_hash(r.v, kind, depth)) for r in df.collect()}, depth
    deep = T.ArrayType(T.ArrayType(T.LongType()))
    assert spark.range(1).select(nested_hash(F.array(F.array()).cast("array<array<bigint>>"), deep).alias("h")).first().h == signed(jody([0]))
    with pytest.raises(TypeError):
        nested_hash(F.col("v"), T.StringType())


def test_nested_hashes_of_a_whole_table(spark):
    lines = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        lines.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey, r.l_suppkey if r.l_suppkey % 3 else None))
    line = T._parse_datatype_string("n: smallint, part: int, supp: bigint")
    kind = T._parse_datatype_string("k: bigint, dear: boolean, who: struct<c: int, y: tinyint>, lines: array<struct<n: smallint, part: int, supp: bigint>>")
    want = {}
    for o in spark.read.parquet(f"{SF}/orders.parquet").collect():
        own = lines.get(o.o_orderkey)
        own = own and [dict(zip(line.names, x)) for x in sorted(own, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0))]
        v = {"k": o.o_orderkey, "dear": o.o_totalprice > 150_000, "who": {"c": o.o_custkey, "y": o.o_orderdate.year % 100}, "lines": own}
        want[o.o_orderkey] = (signed(plain_hash(v, kind, 8)), signed(plain_hash(v, kind, 1)))
    assert {r.o_orderkey: (r.hash, r.shallow) for r in programs.nested_hashes(spark, SF).collect()} == want


def test_callees_come_first(spark):
    draw = random.Random(3)
    calls = [(draw.randrange(60), draw.randrange(60)) for _ in range(70)] + [(99, 1), (1, 99)]
    ids = list(range(60))
    got = {r.id: r for r in graphs.callee_order(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(calls, "src long, dst long")).collect()}
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in calls:
            if a in reach and b in reach:
                reach[a] |= reach[b]
    assert sorted(got) == ids and sorted(r.place for r in got.values()) == ids
    assert all(got[i].component == min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids)
    assert all(got[b].place < got[a].place for a, b in calls if a in reach and b in reach and a not in reach[b])
    assert max(r.layer for r in got.values()) > 3
    assert graphs.callee_order(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long")).collect() == []


def test_bisection_equals_one_by_one(spark):
    draw = random.Random(9)
    rows, value = [], {}
    for key in range(30):
        for place in range(draw.randrange(1, 20)):
            rows.append((key, place * 3))
            value[key, place * 3] = draw.choice([0, 0, 0, 1, 2, 3, 4]) if key % 3 else draw.choice([0, 0, 0, 9])
    # 9 fails alone, two equal ones of 1 to 4 fail together
    wrong = lambda s: 9 in s or any(s.count(x) > 1 for x in (1, 2, 3, 4))
    want = {}
    for key in range(30):
        have = []
        for k, p in rows:
            if k == key:
                want[k, p] = not wrong([*have, value[k, p]])
                have += [value[k, p]] * want[k, p]
    table = spark.createDataFrame([(*k, v) for k, v in value.items()], "key long, place long, v int")
    jobs = []

    def check(groups):
        jobs.append(1)
        s = groups.join(table, ["key", "place"]).groupBy("group").agg(F.collect_list("v").alias("vs"))
        bad = F.array_contains("vs", 9) | F.reduce(F.array(*map(F.lit, (1, 2, 3, 4))), F.lit(False), lambda a, x: a | (F.size(F.filter("vs", lambda y: y == x)) > 1))
        return s.filter(bad).select("group", F.lit("wrong").alias("error"))

    got = bisection.bisected(table.select("key", "place"), check)
    assert {(r.key, r.place): r.accepted for r in got.collect()} == want and not all(want.values())
    assert all((r.error is None) == r.accepted for r in got.collect())
    jobs.clear()
    bisection.bisected(table.filter("key % 3 = 0").select("key", "place"), check).collect()
    assert len(jobs) <= 7  # levels and the last test, whatever the number of keys
    assert bisection.bisected(table.select("key", "place").limit(0), check).collect() == []


def test_ancestors_pass_over_links(spark):
    rows = [("a", 1, "/x/y/f"), ("a", 2, "/l/k/p"), ("a", 3, "/x/y/z/g"), ("b", 1, "/l/k/p"), ("b", 2, "/x/f"), ("c", 1, "/l/k/p"), ("c", 2, "/l/k/q"), ("d", 1, "/x/f"), ("d", 2, "/l/kk/f"), ("e", 1, "/x/y"), ("e", 2, None)]
    df = spark.createDataFrame(rows, "g string, i int, path string")
    got = {r.g: r.ancestor for r in keyed.common_ancestor(df, "g", order="i", links="/l/k").collect()}
    assert got == {"a": "/x/y", "b": "", "c": "/l/k", "d": "", "e": "/x"}
    assert {r.g: r.ancestor for r in keyed.common_ancestor(df, "g", order="i").collect()}["a"] == ""


def test_products_wrap(spark):
    words = [0, 1, -1, 2**63 - 1, -(2**63), 9_000_000, 2**40 + 7]
    for k in (0, 1, -1, 4_611_686_018_427, -87_178_291_199, 2**63 - 1, -(2**63)):
        got = spark.createDataFrame([(w,) for w in words], "w long").select("w", wrapped_product(F.col("w"), k).alias("p")).collect()
        assert {r.w: r.p for r in got} == {w: signed(w * k & M) for w in words}


def test_word_hashes_of_large_keys(spark, tmp_path):
    keys = [3, 2_000_000, 8_999_999, 200_000_000, 5 * 10**9]
    spark.createDataFrame([(k, k // 10) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.hash for r in sets.word_hashes(spark, str(tmp_path)).collect()}
    assert got == {k: signed(jody(x & M for x in ((k + 1) * 4_611_686_018_427, k // 10 - 1_000_000, -k * 87_178_291_199))) for k in keys}


def test_hashes_of_words_with_gaps_and_long_runs(spark):
    runs = [[], [5], None, [1, None], list(range(400)), [-1, 2**63 - 1]]
    df = spark.createDataFrame(list(enumerate(runs)), "i int, w array<bigint>").coalesce(1)
    got = {r.i: r.h for r in df.select("i", jodyhash(F.col("w")).alias("h")).collect()}
    assert got == {i: None if w is None or None in w else signed(jody(x & M for x in w)) for i, w in enumerate(runs)}


def test_candidates_are_kept_in_columns(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    used = lambda: folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    before = used()
    rows = spark.range(200_000).select(F.floor(F.col("id") / 4).alias("key"), (F.col("id") % 4).alias("place"))
    got = bisection.bisected(rows, lambda g: g.groupBy("group").agg(F.lit("x").alias("error")).limit(0))
    assert used() - before < 2_000_000 and got.filter("accepted").count() == 200_000
