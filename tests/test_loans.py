import random
from itertools import product

from pyspark.sql import functions as F

from graphloom.operators import lattice, loans
from graphloom.plans import iterate
from graphloom.plans.iterate import Rule, mutual

COLUMNS = {
    "cfg": "p q", "issued": "origin loan p", "killed": "loan p", "invalidated": "loan p", "base": "o1 o2 p", "used": "var p", "defined": "var p", "refers": "var origin", "universal": "origin", "known": "o1 o2",
}


def frames(spark, facts):
    kind = lambda name: ", ".join(f"{c} long" for c in ("func " + COLUMNS[name]).split())
    return loans.Facts(**{name: spark.createDataFrame(sorted(facts.get(name, set())), kind(name)) for name in COLUMNS})


def plain(f):
    """The rules one by one over sets until nothing is new."""
    points = {(r[0], x) for r in f["cfg"] for x in r[1:]}
    v = set(f["used"])
    while new := {(g, x, p) for g, x, q in v for h, p, r in f["cfg"] if (h, r) == (g, q) and (g, x, p) not in f["defined"]} - v:
        v |= new
    live = {(g, o, p) for g, x, p in v for h, y, o in f["refers"] if (h, y) == (g, x)} | {(g, o, p) for g, o in f["universal"] for h, p in points if h == g}
    sub, held = set(f["base"]), set(f["issued"])
    while True:
        new = {(g, a, d, p) for g, a, b, p in sub for h, c, d, q in sub if (g, b, p) == (h, c, q) and a != d}
        new |= {(g, a, b, q) for g, a, b, p in sub for h, r, q in f["cfg"] if (h, r) == (g, p) and {(g, a, q), (g, b, q)} <= live}
        more = {(g, b, x, p) for g, o, x, p in held for h, a, b, q in sub if (g, o, p) == (h, a, q)}
        more |= {(g, o, x, q) for g, o, x, p in held for h, r, q in f["cfg"] if (h, r) == (g, p) and (g, x, p) not in f["killed"] and (g, o, q) in live}
        if new <= sub and more <= held:
            break
        sub |= new
        held |= more
    errors = {(g, x, p) for g, o, x, p in held if (g, o, p) in live and (g, x, p) in f["invalidated"]}
    known = set(f["known"])
    while new := {(g, a, d) for g, a, b in known for h, c, d in known if (g, b) == (h, c)} - known:
        known |= new
    return errors, {(g, a, b, p) for g, a, b, p in sub if {(g, a), (g, b)} <= f["universal"] and a != b and (g, a, b) not in known}


def test_conflicts_equal_plain_rules(spark):
    draw = random.Random(6)
    f = {name: set() for name in COLUMNS}
    some = {"cfg": 14, "issued": 5, "killed": 3, "invalidated": 12, "base": 7, "used": 5, "defined": 3, "refers": 5, "universal": 2, "known": 1}
    size = {"p": 9, "q": 9, "origin": 5, "loan": 4, "var": 4, "o1": 5, "o2": 5}
    for func, (name, n) in product(range(12), some.items()):
        f[name] |= {(func, *(draw.randrange(size[c]) for c in COLUMNS[name].split())) for _ in range(n)}
    errors, subsets = plain(f)
    got = loans.conflicts(frames(spark, f))
    assert {tuple(r) for r in got.errors.select("func", "loan", "p").collect()} == errors and len(errors) > 10
    assert {tuple(r) for r in got.subset_errors.select("func", "o1", "o2", "p").collect()} == subsets and subsets
    none = loans.conflicts(frames(spark, {}))
    assert none.errors.collect() == [] and none.subset_errors.collect() == []


def test_settled_takes_unique_until_no_error_is_left(spark):
    f = {"cfg": {(1, 0, 1), (1, 1, 2)}, "issued": {(1, 0, 7, 0)}, "invalidated": {(1, 7, 1)}, "used": {(1, 0, 2)}, "refers": {(1, 0, 0)}}
    facts = frames(spark, f)
    pointers = spark.createDataFrame([(1, lattice.UNIQUE | lattice.READ, 0), (2, lattice.UNIQUE, 0), (3, lattice.UNIQUE, 0)], "id long, perms int, forbidden int")
    subsets = spark.createDataFrame([(1, 2, 0)], "a long, b long, except_mask int")
    owners = spark.createDataFrame([(1, 7, 2)], "func long, loan long, id long")
    out = loans.settled(pointers, subsets, lambda state: loans.conflicts(facts).errors, owners)
    assert {r.id: r.perms for r in out.collect()} == {1: lattice.READ, 2: lattice.READ, 3: lattice.UNIQUE}


def test_mutual_relations(spark, monkeypatch):
    """Ways of odd and even length from 0, each from the other; a relation that nothing is derived for stays."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(30, 3)], "a long, b long")
    seed = spark.createDataFrame([(0,)], "n long")
    on = lambda d: d.join(edges, d["n"] == edges["a"]).select(F.col("b").alias("n"))
    monkeypatch.setattr(iterate, "TOGETHER", 3)
    out = mutual({"even": seed, "odd": seed.limit(0), "other": seed}, [Rule("odd", ("even",), on), Rule("even", ("odd",), on)])
    even, odd, n = {0}, set(), 0
    hop = {i: i + 1 for i in range(30)} | {30: 3}
    for k in range(1, 200):
        n = hop[n]
        (odd if k % 2 else even).add(n)
    assert {r.n for r in out["even"].collect()} == even and {r.n for r in out["odd"].collect()} == odd and out["other"].count() == 1
