import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    """(word, n, form, form_n, root, n_near)"""
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    form = {}
    for a, bs in near.items():
        b = min(bs, key=lambda b: (-counts[b], b), default=None)
        form[a] = b if b is not None and counts[b] >= 2 * counts[a] else None
    root = {}
    for a in counts:
        r = a
        while form[r]:
            r = form[r]
        root[a] = r
    return sorted((a, n, form[a], counts[form[a]] if form[a] else None, root[a], len(near[a])) for a, n in counts.items())


def made(k, seed=1, letters="abéÿ"):
    draw = random.Random(seed)
    return {"".join(draw.choice(letters) for _ in range(draw.randrange(5, 9))): draw.choice([3, 5, 9, 40, 40, 90]) for _ in range(k)}


@pytest.mark.parametrize("tile,unit", [(4096, 1024), (16, 8)])
def test_near_words_equal_brute_force(spark, monkeypatch, tile, unit):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "UNIT", unit)
    counts = made(700) | {"x" * 4000: 3, "x" * 4001: 8, "x" * 1999 + "y" + "x" * 2000: 3, "zzzzz": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(words).collect()}
    want = {}
    for a in counts:
        if bs := [b for b in counts if one_edit(a, b)]:
            best = min(bs, key=lambda b: (-counts[b], b))
            want[a] = (len(bs), counts[best], best)
    assert got == want and sum(x[0] for x in want.values()) > 900


def test_index_alone():
    words = list(made(300, 5))
    index = spelling._Index(words)
    got = set()
    for size in set(map(len, words)):
        q, w = index.near(np.array([i for i, x in enumerate(words) if len(x) == size]))
        got |= set(zip(q.tolist(), w.tolist()))
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}


def test_query_on_small_tables(spark, saved):
    draw = random.Random(3)
    base = list(made(60, 9))
    texts = [(i, " ".join(draw.choice(base).upper() if k % 5 == 0 else draw.choice(base) for k in range(200)), "a") for i in range(300)]
    texts += [(400, None, "a"), (401, "", "a"), (None, "ABCDE-abcdé_abcdé1abcdé " + "q" * 100_000, None), (5, texts[5][1], "b"), (5, "nöeld nöeld nöeld ×÷aaaa", "b")]
    sf = saved(texts)
    counts = Counter()
    for i, t, _ in texts:
        for run in spelling.RUN.findall(t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = queries.op11_spelling(spark, sf)
    assert got.columns == ["word", "n", "form", "form_n", "root", "n_near"]
    assert sorted(map(tuple, got.collect())) == want and any(r[2] for r in want)


def test_roots_follow_long_ways(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(50)], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w50"}


def test_no_rows(spark, docs):
    assert spelling.variants(docs([])).collect() == []
    assert spelling.variants(docs([(1, None, "a"), (2, "ab cd", "a")])).collect() == []
