import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import events as ev
from graphloom.operators import intervals


def test_overlaps_equal_a_loop(spark):
    draw = random.Random(5)
    make = lambda n, tag: [(draw.choice("ab"), f"{tag}{i}", (s := draw.randrange(-50, 300)), s + draw.choice([0, 0, 1, 2, 7, 64, 200])) for i in range(n)] + [(None, f"{tag}n", 0, 9)]
    a, b = make(150, "a"), make(120, "b")
    kind = "k string, id string, start long, end long"
    got = intervals.overlaps(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "k").select("l.id", "r.id").collect()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted(map(tuple, got)) == want and len(want) > 1000
    empty = spark.createDataFrame([], kind)
    assert intervals.overlaps(empty, empty, "k").collect() == []


def test_one_file_with_many_edits_and_definitions(spark):
    n = 100_000
    d = spark.range(n).selectExpr("id % 1000 AS group", "'f' AS file", "id * 100 AS start", "id * 100 + 60 AS end")
    e = spark.range(n).selectExpr("'f' AS file", "id AS ord", "id * 100 + 10 AS start", "id * 100 + 15 AS end")
    began = time.time()
    assert intervals.overlaps(e, d, "file").count() == n
    assert time.time() - began < 60


def test_joined_texts_by_hand(spark):
    rows = [
        ("k", "h", 0, 4, "abcd", False), ("k", "h", 0, 4, "abcd", False), ("k", "h", 2, 6, "cdef", True), ("k", "h", 5, 7, "XY", False), ("k", "h", 9, 10, "z", False),
        ("s", "h", 3, 5, "qq", False), ("s", "h", 3, 5, "qq", False), ("w", "h", 0, 9, "whole xxx", False), ("w", "h", 2, 4, "..", False), ("t", "h", 0, 3, "aaa", False), ("t", "g", 0, 3, "aaa", False),
    ]
    df = spark.createDataFrame(rows, "key string, header string, start long, end long, text string, is_defn boolean")
    got = {(r.key, r.start, r.end, r.n, r.is_defn, r.text) for r in intervals.overlap_buckets(df).collect()}
    assert got == {("k", 0, 7, 3, True, "abcdeXY"), ("s", 3, 5, 1, False, "qq"), ("w", 0, 9, 2, False, "whole xxx")}


def plain_chains(log):
    """The memory map of the log, event by event."""
    out = []
    for run in {r[0] for r in log}:
        live = {}
        for _, seq, kind, ptr, new, size in sorted((r for r in log if r[0] == run), key=lambda r: r[1]):
            def find(p):
                base = max((b for b in live if b <= p), default=None)
                return live[base] if base is not None and p < base + live[base][0] else None

            if kind == "Alloc" or kind == "Realloc" and ptr != new:
                if kind == "Realloc":
                    live.pop(ptr, None)
                base = ptr if kind == "Alloc" else new
                if find(base) or base in live:
                    raise ValueError
                live[base] = [size, base, seq, [(seq, kind)]]
            elif kind == "Realloc":
                live[ptr][0] = size
                live[ptr][3].append((seq, kind))
            elif kind == "Free":
                if a := live.pop(ptr, None):
                    out += [(run, a[1], a[2], i, *x) for i, x in enumerate([*a[3], (seq, kind)])]
            elif a := find(ptr):
                a[3].append((seq, kind))
        for a in live.values():
            out += [(run, a[1], a[2], i, *x) for i, x in enumerate([*a[3], (None, "Done")])]
    return sorted(out, key=str)


KIND = "run_id string, seq long, kind string, ptr long, new_ptr long, size long"


def test_inner_chains_equal_a_memory_map(spark):
    draw = random.Random(12)
    log = []
    for run in "abc":
        live = {}
        for seq in range(0, 900, 3):
            free = [s for s in range(12) if s not in live]
            kind = draw.choice(["Alloc", "Free", "Realloc", "Realloc", "Use", "Use", "Use", "Use"])
            if kind == "Alloc" and free:
                live[s := draw.choice(free)] = 1
                log.append((run, seq, kind, 100 * s, None, draw.choice([0, 1, 40, 100])))
            elif kind == "Free":
                s = draw.randrange(12)
                live.pop(s, None)
                log.append((run, seq, kind, 100 * s, None, None))
            elif kind == "Realloc" and live and free:
                s, t = draw.choice(sorted(live)), draw.choice([None, *free])
                if t is not None:
                    live.pop(s)
                    live[t] = 1
                log.append((run, seq, kind, 100 * s, 100 * (s if t is None else t), draw.choice([1, 60, 100])))
            elif kind == "Use":
                log.append((run, seq, "Use", draw.randrange(1300), None, None))
    want = plain_chains(log)
    got = ev.inner_chains(spark.createDataFrame(log, KIND)).collect()
    assert sorted(map(tuple, got), key=str) == want and sum(x[5] == "Use" for x in want) > 40


def test_wrong_logs_and_no_events(spark):
    inside = [("r", 0, "Alloc", 0, None, 10), ("r", 1, "Alloc", 5, None, 1)]
    twice = [("r", 0, "Alloc", 0, None, 0), ("r", 1, "Alloc", 0, None, 1)]
    nothing = [("r", 0, "Realloc", 7, 7, 1)]
    for log in (inside, twice, nothing):
        with pytest.raises(ValueError):
            ev.inner_chains(spark.createDataFrame(log, KIND))
    assert ev.inner_chains(spark.createDataFrame([], KIND)).collect() == []


def test_pieces_of_all_widths_are_told_apart(spark):
    draw = random.Random(3)
    for kind, top in (("long", 1 << 62), ("decimal(20,0)", 1 << 64)):
        log, live, seq = [], [], 0
        for _ in range(400):
            ptr, size = draw.randrange(top), draw.choice([1, 4095, 4097, 70_000, 1 << 30, 1 << 58])
            size = min(size, top - ptr)
            if draw.random() < 0.5 and all(ptr + size <= p or p + n <= ptr for p, n in live):
                live.append((ptr, size))
                log.append(("r", seq, "Alloc", ptr, None, size))
            elif live and draw.random() < 0.2:
                log.append(("r", seq, "Free", live.pop(draw.randrange(len(live)))[0], None, None))
            elif live:
                p, n = draw.choice(live)
                log.append(("r", seq, "Use", min(p + draw.choice([0, n - 1, n, n // 2]), top - 1), None, None))
            seq += 1
        df = spark.createDataFrame([(*x[:3], str(x[3]), None, x[5] and str(x[5])) for x in log], "run_id string, seq long, kind string, ptr string, new_ptr string, size string")
        got = ev.inner_chains(df.withColumns({c: F.col(c).cast(kind) for c in ("ptr", "new_ptr", "size")})).collect()
        want = plain_chains(log)
        assert sorted(((r.run_id, int(r.ptr), *r[2:]) for r in got), key=str) == want and sum(x[5] == "Use" for x in want) > 40


def test_points_travel_once_whatever_lives_there_are(spark):
    log = [("r", i, "Use", 64 + i % 9, None, None) for i in range(1, 3000)]
    lives = [("r", 64, 8, 1, 1 << 52, 0), *(("r", 128 + 64 * i, 8, 1 + i, 1 + i + 3**i % 2000, i) for i in range(300))]
    pieces = spark.createDataFrame(lives, "run_id string, ptr long, size long, first long, until long, opened long")
    store = spark.sparkContext._jsc.sc().statusStore()
    sent = lambda: {s.stageId(): s.shuffleWriteRecords() for s in map(all_.apply, range(all_.size()))}
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    all_ = store.stageList(None, False, False, none, None)
    before = sent()
    assert ev.live_at(spark.createDataFrame(log, KIND), pieces).count() == sum(x[3] < 72 for x in log)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    all_ = store.stageList(None, False, False, none, None)
    rows = sum(n for k, n in sent().items() if k not in before)
    assert len(log) < rows < 2 * len(log)
