"""Readers, writers, edits, coverage exports and capture on small files."""

import base64
import json
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from graphloom.functions.hashes import djb2, jodyhash, normal_path
from graphloom.operators import coverage, intervals, keyed, metrics
from graphloom.sources import files
from graphloom.streaming import capture


def test_edits_on_known_texts(spark):
    cases = [
        ("a", "int x = 1;", [(4, 1, "count"), (8, 1, "20")], "int count = 20;"),  # two replacements
        ("b", "f(old);", [(2, 0, "&"), (2, 3, "new")], "f(&new);"),  # an insertion where a replacement starts comes first
        ("c", "f(old);", [(5, 0, ", 1"), (2, 3, "new")], "f(new, 1);"),  # and one where it ends comes behind, in whatever order
        ("d", "()", [(1, 0, "a, "), (1, 0, "b")], "(a, b)"),  # insertions of one place in the order given
        ("e", "x;", [(0, 1, "y"), (0, 1, "y")], "y;"),  # equal replacements count once
        ("f", "x;", [(0, 0, "*"), (0, 0, "*")], "**x;"),  # equal insertions do not
    ]
    f = spark.createDataFrame([(n, t.encode()) for n, t, _, _ in cases], "file string, content binary")
    e = spark.createDataFrame([(n, i, *x) for n, _, xs, _ in cases for i, x in enumerate(xs)], "file string, ord long, off long, len long, text string")
    assert {r.file: bytes(r.content).decode() for r in intervals.apply_edits(f, e).collect()} == {n: w for n, _, _, w in cases}
    assert intervals.out_of_bounds(e, f).count() == 0 and intervals.conflicts(e).count() == 0
    bad = spark.createDataFrame([("a", 0, 1, 3, "x"), ("a", 1, 2, 1, "y"), ("a", 2, 9, 5, "z")], e.schema)
    assert [(r.first, r.second) for r in intervals.conflicts(bad).collect()] == [(0, 1)] and intervals.out_of_bounds(bad, f).count() == 1


def test_small_text_functions(spark):
    df = spark.createDataFrame([("aXbXc", "X"), ("aXbc", "X"), ("abc", "X"), ("aaa", "aa")], "t string, p string")
    assert [r[0] for r in df.select(intervals.unique_place(F.col("t"), F.col("p"))).collect()] == [None, 1, None, None]
    assert df.limit(1).select(intervals.erased(F.col("t"), F.lit(1), F.lit(3))).first()[0] == "a   c"
    paths = ["/a/./b/../c", "../x//y", "/..", "a/../..", "../../b/..", "./.", "/a/../../b", ""]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(normal_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["/a/c", "../x/y", "/..", "..", "../..", "", "/../b", ""]
    word = lambda s: int.from_bytes(s.encode(), "little")
    texts = ["", "wordlist", "wordlistWORDLIST"]
    rows = spark.createDataFrame([(s, [word(s[i : i + 8]) for i in range(0, len(s), 8)]) for s in texts], "s string, w array<long>")
    assert {r.s: r.h % 2**64 for r in rows.select("s", jodyhash(F.col("w")).alias("h")).collect()} == {s: plain_jody(s) for s in texts}
    where = spark.createDataFrame([("abcabc", 0, 3, 0), ("abcabc", 0, -1, None), ("abcabc", 1, 6, 3), ("abcabc", -5, 99, None)], "t string, a int, b int, want int")
    assert all(r.want == r.got for r in where.select("want", intervals.unique_place(F.col("t"), F.lit("abc"), F.col("a"), F.col("b")).alias("got")).collect())

    def plain(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + b) % 2**64
        return h - 2**64 if h >= 2**63 else h

    words = ["", "a", "größer", "x" * 500]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", djb2(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: plain(w) for w in words}


def plain_jody(s):
    """The hash by its published steps, on unsigned words."""
    h, c, m = 0, 0x1F3D5B79, 2**64 - 1
    turn = lambda x: (x << 14 | x >> 50) & m
    for i in range(0, len(s), 8):
        w = int.from_bytes(s[i : i + 8].encode(), "little")
        h = turn((h + w + c) & m) ^ w
        h = ((turn(h) ^ c) + w) & m
    return h


def test_offsets_past_edits(spark):
    e = spark.createDataFrame([("a", 0, 5, 0, "abc"), ("a", 1, 10, 2, "x"), ("a", 2, 20, 4, "")], "file string, ord long, off long, len long, text string")
    want = {4: 4, 5: 5, 6: 9, 10: 13, 11: None, 12: 14, 20: 22, 22: None, 24: 22, 30: 28}
    o = spark.createDataFrame([("a", k) for k in want], "file string, at long")
    assert {r.at: r.new for r in intervals.map_offsets(o, e).collect()} == want


def test_ancestors_and_links(spark):
    p = spark.createDataFrame([("one", 0, "src/a.c"), ("two", 0, "src/a.c"), ("two", 1, "src/lib/b.c"), ("rep", 0, "src/a.c"), ("rep", 1, "src/a.c"), ("far", 0, "x/a.c"), ("far", 1, "y/a.c"), ("abs", 0, "/p/q/a.c"), ("abs", 1, "/p/r/b.c")], "g string, o int, path string")
    assert {r.g: r.ancestor for r in keyed.common_ancestor(p, "g", order="o").collect()} == {"one": "src", "two": "src", "rep": "src", "far": "", "abs": "/p"}
    c = spark.createDataFrame([(0, "/w/util", "obj/one.o"), (1, "/w/core", "obj/two.o"), (2, "/w/core", "/w/core/obj/two.o"), (3, "/w", None)], "idx int, directory string, output string")
    l = spark.createDataFrame([(9, "/w/core", ["../util/obj/one.o", "./obj/two.o", "obj/none.o"])], "idx int, directory string, inputs array<string>")  # noqa: E741
    joined = keyed.linked(l, c)
    assert [r.idx for r in joined.orderBy("pos").collect()] == [0, 2, None]
    assert sorted(r.idx for r in keyed.leftovers(c, joined).collect()) == [1, 3]


def test_replicated_edits(spark):
    d = spark.createDataFrame([("g", "a", 10, 30), ("g", "b", 5, 25)], "group string, def_file string, start long, end long")
    e = spark.createDataFrame([("a", 0, 12, 2, "x")], "file string, ord long, off long, len long, text string")
    assert sorted((r.file, r.off) for r in intervals.replicated_edits(e, d).collect()) == [("a", 12), ("b", 7)]
    with pytest.raises(Exception, match="edge"):
        intervals.replicated_edits(e.withColumn("off", F.lit(29).cast("long")), d).collect()


def test_coverage_export_and_sets(spark, tmp_path):
    export = {"data": [{"files": [{"filename": "f.c", "segments": [[1, 1, 1, True, True, False], [2, 1, 0, True, True, False], [3, 2, "5", True, True, False]]}, {"filename": None, "segments": []}]}]}
    (tmp_path / "cov.json").write_text(json.dumps(export))
    seg = files.read_segments(spark, str(tmp_path / "cov.json"))
    assert sorted(r.line + 1 for r in coverage.lines_from_segments(seg).filter("covered").collect()) == [1, 3]
    lines = spark.createDataFrame([("h1", 0), ("h1", 9), ("h2", 3)], "file string, line long")
    for kind in ("identity", "zlib", "zstd"):
        packed = files.bitmaps_of_lines(lines, kind).withColumn("compression", F.lit(kind))
        assert sorted(tuple(r) for r in files.lines_of_bitmaps(packed, "bitmap").collect()) == [("h1", 0), ("h1", 9), ("h2", 3)]
    again = spark.createDataFrame([("f.c", b"one"), ("g.c", b"one")], "file string, content binary")
    two = seg.union(seg.filter("line = 2").select(F.struct(F.lit(0).alias("i"), F.lit(9).alias("j")), F.lit("g.c"), "line", "col", "count", "has_count"))
    assert [(r.path, r.line) for r in files.by_content(two, again).collect()] == [("g.c", 2)]
    saved = {"files": {"h1": {"filepath": {"utf8": "a.c"}, "expanded_hash": "e", "covered": "AQ==", "coverable": "Aw==", "config": {"index": 1}}, "h2": {"filepath": {"hex": "622e63"}, "covered": "", "config": {"inline": ["x"]}}}, "configs": [[], ["-O2"]]}
    (tmp_path / "set.json").write_text(json.dumps(saved))
    rows = {r.file: r for r in files.read_coverset(spark, str(tmp_path / "set.json")).collect()}
    assert rows["h1"].config == ["-O2"] and rows["h2"].path == "b.c" and rows["h2"].config == ["x"]
    out = files.read_coverset(spark, str(tmp_path / "set.json"))
    files.write_coverset(out, [["-O2"]], str(tmp_path / "back"))
    assert sorted(map(str, files.read_coverset(spark, str(tmp_path / "back")).collect())) == sorted(map(str, out.collect()))
    (tmp_path / "bad.json").write_text('{"files": {"h": {}}}')
    with pytest.raises(Exception, match="missing"):
        files.read_coverset(spark, str(tmp_path / "bad.json")).collect()
    a = coverage.CoverSet(spark.createDataFrame([("f", "x")], "file string, expanded_hash string"), lines, lines)
    b = coverage.CoverSet(spark.createDataFrame([("f", "y")], "file string, expanded_hash string"), lines, lines)
    assert coverage.mismatches(a, b).count() == 1 and coverage.require_same(a, a).count() == 1
    with pytest.raises(Exception, match="differ"):
        coverage.require_same(a, b).collect()


def test_configs(spark):
    out = coverage.config_product({"a": ["1", "2"], "b": ["x", "y", "z"]}, spark.range(1))
    assert out.count() == 6
    presets = {"base": {"values": {"A": ["1"], "B": ["1"]}}, "late": {"values": {"B": ["2"]}}, "own": {"inherits": ["base", "late"], "values": {"C": ["3"]}}, "loop": {"inherits": ["loop"]}}
    assert coverage.preset_values(presets, "own") == {"A": ["1"], "B": ["2"], "C": ["3"]}
    with pytest.raises(ValueError, match="cycle"):
        coverage.preset_values(presets, "loop")
    rows = [("c", 0, "SSL", "on", True), ("c", 1, "Log", "OFF", True), ("c", 2, "Mode", "Fast", False), ("c", 3, "Kept", "ON", False), ("c", 4, "ALL", "TRUE", True), ("d", 0, "SSL", "1", True)]
    f = spark.createDataFrame(rows, "config string, ord int, variable string, value string, boolean boolean")
    assert {r.config: r.features for r in coverage.feature_names(f).collect()} == {"c": ["SSL", "Mode_Fast", "Kept_ON", "ALL"], "d": []}
    m = spark.createDataFrame([("d", 1, "s1", ["b"]), ("d", 2, "s2", ["a"])], "name string, ord long, spec string, features array<string>")
    assert tuple(coverage.merged_dependencies(m).first()) == ("d", "s1", ["a", "b"])
    assert spark.range(1).select(coverage.line_count(F.lit("a\nb\n"))).first()[0] == 3


def test_logs_and_records(spark, tmp_path):
    (tmp_path / "torn.json").write_text('{"seq": 1, "kind": "A"}\nnothing to read\n{"seq": 3, "kind": "C"}\n')
    assert [r.seq for r in files.read_events(spark, str(tmp_path / "torn.json"), "seq long, kind string").collect()] == [1]
    with pytest.raises(ZeroDivisionError):
        with files.recorded(spark, str(tmp_path / "record")) as record:
            record["steps"] = [1, 2]
            1 / 0
    assert json.loads(spark.read.text(str(tmp_path / "record")).first()[0]) == {"steps": [1, 2]}
    (tmp_path / "log.json").write_text('{"seq": 1, "kind": "A"}\n{"seq": 2, "kind": "B"}\n{"seq": 3, "kin\n{"seq": 4, "kind": "D"}\n')
    assert sorted(r.seq for r in files.read_events(spark, str(tmp_path / "log.json"), "seq long, kind string").collect()) == [1, 2]
    raw = b"".join(struct.pack("<BQ", t, v) for t, v in ((1, 5), (2, 2**64 - 1))) + b"xx"
    os.mkdir(tmp_path / "x")
    (tmp_path / "x" / "c.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    assert [(r.seq, r.tag, int(r.val)) for r in files.read_checks(spark, str(tmp_path / "x")).orderBy("seq").collect()] == [(0, 1, 5), (1, 2, 2**64 - 1)]
    (tmp_path / "out.txt").write_text('plain\n{"reason": "other"}\n{"reason": "compiler-message", "message": {"level": "warning", "code": {"code": "clippy::x"}, "message": "m"}}\n')
    assert [tuple(r) for r in files.read_messages(spark, str(tmp_path / "out.txt")).collect()] == [("warning", "clippy::x", "m")]
    (tmp_path / "cc.json").write_text(json.dumps([{"directory": "/d", "file": "a.c", "command": "cc a.c"}, {"directory": "/d", "file": "b.S", "arguments": ["cc"]}, {"directory": "/d", "file": "a.c", "command": "cc -O a.c"}]))
    assert [r.idx for r in keyed.compile_commands(files.read_compile_commands(spark, str(tmp_path / "cc.json")), r"\.").collect()] == [0]
    m = spark.createDataFrame([(1, "a"), (2, "b")], "proj_key long, path string")
    assert files.merged_metadata([m, m]).count() == 2
    with pytest.raises(Exception, match="two values"):
        files.merged_metadata([m, m.withColumn("path", F.lit("z"))]).collect()
    files.write_relations({"edge": m}, str(tmp_path / "rel"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "rel/edge")).count() == 2
    files.write_json(m, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_keyed_corner_cases(spark):
    sig = spark.createDataFrame([("k", "a", False), ("k", "b", False), ("k", "a", False), ("d", "x", True), ("d", "y", False)], "key string, signature string, is_defn boolean")
    assert [tuple(r) for r in keyed.agreed_signatures(sig).collect()] == [("d", "x")]
    c = spark.createDataFrame([("o1", "a.c"), ("o2", "b.c")], "output string, file string")
    l = spark.createDataFrame([("t", "exe", True, ["o1", "z"]), ("t", "exe", False, ["o2"])], "output string, kind string, is_driver boolean, inputs array<string>")  # noqa: E741
    assert [tuple(r) for r in keyed.build_targets(c, l).collect()] == [("t", "exe", ["a.c", "z"])]
    assert sorted(r.target for r in keyed.build_targets(c, l.limit(0)).collect()) == ["o1", "o2"]
    g = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "a", "x")], "k long, o long, c string, l string")
    assert tuple(keyed.grouped_first(g, "k", "o", "l").first()) == (1, "a", ["x", "y"])
    a = spark.createDataFrame([("p", "1")], "path string, text string")
    b = spark.createDataFrame([("p", "2"), ("q", "3")], "path string, text string")
    assert keyed.merged_items(a, b).count() == 2 and [tuple(r) for r in keyed.merged_items(a, b, True).collect()] == [("p", "2")]
    e = spark.createDataFrame([(90,), (10,)], "created long")
    assert keyed.pruned_cache(e, 100, 20).count() == 1
    a = spark.createDataFrame([(1, ("x", None))], "b int, a struct<z:string,y:string>")
    b = spark.createDataFrame([((None, "x"), 1)], "a struct<y:string,z:string>, b int")
    keys = [df.select(keyed.cache_key(df, cs)).first()[0] for df, cs in ((a, ["b", "a"]), (a, ["a", "b"]), (b, ["a", "b"]), (a, ["a"]))]
    assert len(set(keys[:3])) == 1 and keys[3] != keys[0] and len(keys[0]) == 64
    hit, rest = keyed.cached(a.union(a.withColumn("b", F.lit(2))), ["b", "a"], spark.createDataFrame([(keys[0], "kept")], "key string, result string"))
    assert [r.result for r in hit.collect()] == ["kept"] and [r.b for r in rest.collect()] == [2]
    t = spark.createDataFrame([("s", "head\n//@ a/b.rs\none\ntwo\n//@ c.rs\nthree")], "source string, text string")
    assert {r.path: r.text for r in keyed.split_items(t).collect()} == {"": "head\n", "a/b.rs": "one\ntwo\n", "c.rs": "three"}
    tied = spark.createDataFrame([("/base", "w_30_x"), ("/b/10_b", "x_99"), ("/b/9_z", None)], "path string, other string")
    assert metrics.highest_numbered(tied).first().path == "/b/10_b"
    m = spark.createDataFrame([("clippy::x", "warning"), ("E1", "error"), ("E1", "help"), (None, "error")], "code string, level string")
    assert {r.kind: r.n for r in metrics.message_counts(m).collect()} == {"lint": 1, "error": 1}
    lines = spark.createDataFrame([("a", "fn f();\t"), ("a", " \t\x0c"), ("a", "unsafe fn g() {\r"), ("build.rs", "fn x() {")], "path string, line string")
    assert tuple(metrics.source_metrics(lines).first()) == (1, 2, 1, 1, 1.0)
    with pytest.raises(Exception, match="no functions"):
        metrics.source_metrics(spark.createDataFrame([("a", "x")], "path string, line string")).collect()
    r = spark.createDataFrame([(10, 3, 4, 1)], "total_ms long, translation_ms long, corpus long, diverged long")
    assert metrics.converged(metrics.measuring_time(r)).select("measurement_ms", "converged").first() == (7, 3)


def test_capture(spark, tmp_path):
    schema = "run_id long, seq long, kind string"
    kinds = ["Early", "Main", "A", "B", "Done", "Late", "Late"]
    for i, part in enumerate((kinds[:3], kinds[3:])):
        spark.createDataFrame([(7, i * 3 + n, k) for n, k in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = capture.read_capture(spark, str(tmp_path / "in"), schema, 1)
    q = capture.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.kind for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()] == ["Main", "A", "B", "Done"]
    q = capture.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp3"), append=False, form="json")
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    with pytest.raises(Exception, match="unknown hook"):
        capture.hook_events(spark.createDataFrame([(1, 1, "mmap", 1, 1, 1, 1)], "run_id long, seq long, hook string, ptr long, size long, count long, result long")).collect()
    counts = capture.program_events(stream)
    q = counts.writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("counts").orderBy(F.desc(F.col("events") + F.col("before_main") + F.col("after_done"))).first()
    assert tuple(last) == (7, 4, 1, 2)


def test_bitmaps_of_one_large_file_go_in_pieces(spark):
    n = 600_000
    lines = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * 5).alias("line"))
    twice = lines.union(spark.createDataFrame([("f", 5), ("g", 65_535), ("g", 65_536), ("h", 0), (None, 7)], "file string, line long"))
    packed = files.bitmaps_of_lines(twice).withColumn("compression", F.lit("identity"))
    by_file = {r.file: base64.b64decode(r.bitmap) for r in packed.collect()}
    assert {k: len(v) for k, v in by_file.items()} == {"f": (n - 1) * 5 // 8 + 1, "g": 8193, "h": 1, None: 1}
    back = files.lines_of_bitmaps(packed, "bitmap")
    assert back.filter("file <> 'f'").count() == 3 and back.filter("file IS NULL").first().line == 7
    assert back.filter("file = 'f'").agg(F.count("*"), F.sum("line"), F.max("line")).first()[:] == (n, 5 * n * (n - 1) // 2, 5 * (n - 1))
    for bad in (-1, None):
        with pytest.raises(Exception, match="from 0 on"):
            files.bitmaps_of_lines(spark.createDataFrame([("f", bad)], "file string, line long")).collect()
