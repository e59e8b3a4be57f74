import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries, window_dedup

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """(id, words, removed, kept) of each row of (id, text)."""
    least, out = {}, []
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if i is not None and (x not in least or i < least[x]):
                least[x] = i
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def got(df, **more):
    return sorted((tuple(r) for r in window_dedup.remove_repeats(df, **more).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def test_levels():
    assert window_dedup.levels(13) == [7, 13] and window_dedup.levels(50) == [7, 13, 25, 50] and window_dedup.levels(3) == [3]


@pytest.mark.parametrize("size", [3, 13, 50])
def test_equals_brute_force(spark, docs, monkeypatch, size):
    draw = random.Random(size)
    base = [draw.choice(["a", "b", "é", " x", "word", "d" * 40]) + str(draw.randrange(9)) for _ in range(4000)]
    rows = []
    for i in range(150):
        parts = [base[(k := draw.randrange(3900)) : k + draw.randrange(1, 3 * size)] for _ in range(draw.randrange(6))]
        rows.append((i, draw.choice([" ", "\n", "\x0b\t"]).join(w for p in parts for w in p), "a"))
    rows += [(200, None, "a"), (201, "", "a"), (202, " ".join(base), None), (202, " ".join(base), "b"), (None, " ".join(base), "b"), (-5, " ".join(base[100:300]), "b"), (300, "one two", "a"), (202, " ".join(base[5:]), "a"), (301, "z" * 3_000_000 + " " + " ".join(base[7:99]), "a")]
    draw.shuffle(rows)
    monkeypatch.setattr(window_dedup, "PIECE", 1 << 12)
    want = brute([r[:2] for r in rows], size)
    assert sum(w[2] for w in want) > 1000
    assert got(docs(rows).repartition(5), size=size) == want


def test_nothing_repeated_and_no_rows(spark, docs):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "a") for i in range(20)]
    assert got(docs(rows)) == brute([r[:2] for r in rows], 13)
    assert got(docs([])) == []
    assert window_dedup.remove_repeats(docs([])).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept"]


def test_clashing_columns(spark, docs):
    df = docs([(1, "x y", "a")]).select("*", F.lit(7).alias("kept"), F.lit(8).alias("piece"), F.lit(9).alias("__id__"), F.lit(1).alias("c0"), F.lit(2).alias("a.b"))
    row = window_dedup.remove_repeats(df).collect()[0]
    assert (row.kept, row.piece, row["__id__"], row.c0, row["a.b"], row.n_words) == ("x y", 8, 9, 1, 2, 2)


def test_query_on_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 13)]
    assert sorted((tuple(r) for r in queries.op13_windows(spark, SF).collect()), key=str) == sorted(want, key=str)
