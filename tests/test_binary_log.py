import os
import random
import struct

import pytest

from graphloom.sources import binary_log
from graphloom.sources.binary_log import BinaryLog, read_binary_log, write_binary_log

KIND = "run_id string, seq long, mir_loc long, kind string, ptr decimal(20,0), new_ptr decimal(20,0), size decimal(20,0), offset long, local long, proj_key decimal(20,0)"


def made(runs, n, seed=1):
    from decimal import Decimal

    draw = random.Random(seed)
    out = []
    for run in runs:
        for i in range(n):
            name, fields = draw.choice(binary_log.KINDS)
            big = {"Q": lambda: Decimal(draw.choice([0, 7, 2**64 - 1])), "I": lambda: draw.choice([0, 2**32 - 1]), "q": lambda: draw.choice([-(2**63), 5])}
            have = {f: Decimal(big[k]()) if f in binary_log.BIG else int(big[k]()) for f, k in fields}
            out.append((run, i, draw.randrange(2**32), name, *(have.get(f) for f in binary_log.FIELDS)))
    return out


def test_round_trip_and_replaced_runs(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = made("abc", 300)
    write_binary_log(spark.createDataFrame(rows, KIND).repartition(4), path)
    assert sorted(os.listdir(path)) == ["a.log", "b.log", "c.log"]
    back = read_binary_log(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str) and back.rdd.getNumPartitions() == 3
    again = made("b", 5, 2)
    write_binary_log(spark.createDataFrame(again, KIND), path)
    want = [r for r in rows if r[0] != "b"] + again
    assert sorted(map(tuple, read_binary_log(spark, path).collect()), key=str) == sorted(want, key=str)
    write_binary_log(spark.createDataFrame(again, KIND), path, "overwrite")
    assert os.listdir(path) == ["b.log"]


def test_bytes_are_those_of_the_format(spark, tmp_path):
    df = spark.createDataFrame([("r", 0, 9, "Offset", 16, -4, 12)], "run_id string, seq long, mir_loc long, kind string, ptr long, offset long, new_ptr long")
    write_binary_log(df, str(tmp_path / "x"))
    assert (tmp_path / "x" / "r.log").read_bytes() == struct.pack("<IIQqQ", 9, 15, 16, -4, 12)


def test_a_broken_tail_ends_a_log_and_only_that_one(spark, tmp_path):
    rows = made("ab", 50)
    path = tmp_path / "logs"
    write_binary_log(spark.createDataFrame(rows, KIND), str(path))
    whole = (path / "a.log").read_bytes()
    (path / "a.log").write_bytes(whole + struct.pack("<IIQ", 1, 0, 3)[:-1])
    (path / "c.log").write_bytes(struct.pack("<IIQ", 1, 0, 3) + struct.pack("<II", 1, 99) + whole)
    (path / "d.log").write_bytes(b"")
    got = read_binary_log(spark, str(path)).collect()
    assert sorted((tuple(r) for r in got if r.run_id != "c"), key=str) == sorted(rows, key=str)
    assert [(r.seq, r.kind, int(r.ptr)) for r in got if r.run_id == "c"] == [(0, "CopyPtr", 3)]
    assert read_binary_log(spark, str(tmp_path / "none")).collect() == []


def test_rows_that_make_no_record(spark, tmp_path):
    for bad in (("r", 0, 1, "Nothing", None), ("r", 0, 1, "Free", None), (None, 0, 1, "Done", None)):
        with pytest.raises(Exception, match="kind|needs|name"):
            write_binary_log(spark.createDataFrame([bad], "run_id string, seq long, mir_loc long, kind string, ptr long"), str(tmp_path / "bad"))
    assert not [n for n in os.listdir(tmp_path / "bad") if n.endswith(".log")]


def test_stream_over_a_restart(spark, tmp_path):
    path, sink = str(tmp_path / "logs"), str(tmp_path / "out")
    spark.dataSource.register(BinaryLog)

    def run():
        q = spark.readStream.format("binary_log").load(path).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()

    first, second = made("ab", 40), made("cd", 30)
    write_binary_log(spark.createDataFrame(first, KIND), path)
    run()
    assert spark.read.parquet(sink).count() == 80
    write_binary_log(spark.createDataFrame(second, KIND), path)
    run()
    assert sorted(map(tuple, spark.read.parquet(sink).select(*[c.split()[0] for c in KIND.split(", ")]).collect()), key=str) == sorted(first + second, key=str)


def test_many_runs_share_tasks(spark, tmp_path):
    rows = made([f"r{i:03}" for i in range(450)], 4)
    write_binary_log(spark.createDataFrame(rows, KIND), str(tmp_path / "logs"))
    back = read_binary_log(spark, str(tmp_path / "logs"))
    assert len(os.listdir(tmp_path / "logs")) == 450 and back.rdd.getNumPartitions() <= 2 * binary_log.TASKS
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_values_without_room_are_errors(spark, tmp_path):
    from decimal import Decimal

    for ptr, place in ((Decimal(2**64), 0), (Decimal(-1), 0), (Decimal(1), 2**32), (Decimal(1), -1)):
        with pytest.raises(Exception, match="room"):
            write_binary_log(spark.createDataFrame([("r", 0, place, "Free", ptr)], "run_id string, seq long, mir_loc long, kind string, ptr decimal(20,0)"), str(tmp_path / "bad"))
