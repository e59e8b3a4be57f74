"""Loan conflicts by the published rules of origin-based borrow checking: which loans are live where they are invalidated.

Facts are frames of longs, all with ``func``, so all functions go together:

* ``cfg`` (func, p, q): control goes from point p to q
* ``issued`` (func, origin, loan, p), ``killed`` (func, loan, p), ``invalidated`` (func, loan, p)
* ``base`` (func, o1, o2, p): o2 outlives o1 from p on
* ``used``, ``defined`` (func, var, p); ``refers`` (func, var, origin): a use of the variable needs the origin
* ``universal`` (func, origin): live at every point; ``known`` (func, o1, o2): subsets of universal origins that are declared
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import Rule, cut, fixpoint, mutual
from . import lattice


@dataclass(frozen=True)
class Facts:
    cfg: DataFrame
    issued: DataFrame
    killed: DataFrame
    invalidated: DataFrame
    base: DataFrame
    used: DataFrame
    defined: DataFrame
    refers: DataFrame
    universal: DataFrame
    known: DataFrame


def origins_live(facts: Facts, cfg: DataFrame) -> DataFrame:
    """(func, origin, p): origins of variables that are used before they are defined again, and universal ones at every point."""
    back = cfg.select("func", F.col("q").alias("p"), F.col("p").alias("to"))
    ends = cut(facts.defined.select("func", "var", "p").distinct())

    def step(d: DataFrame) -> DataFrame:
        return d.join(back, ["func", "p"]).select("func", "var", F.col("to").alias("p")).join(ends, ["func", "var", "p"], "left_anti")

    live = fixpoint(facts.used.select("func", "var", "p"), step)
    points = cfg.select("func", "p").union(cfg.select("func", "q")).distinct()
    return live.join(facts.refers, ["func", "var"]).select("func", "origin", "p").union(facts.universal.join(points, "func").select("func", "origin", "p")).distinct()


@dataclass(frozen=True)
class Conflicts:
    """``errors`` (func, loan, p), ``subset_errors`` (func, o1, o2, p), the loans that are ``held`` at a point (func, loan, p), and the relations behind them."""

    errors: DataFrame
    held: DataFrame
    subset_errors: DataFrame
    subset: DataFrame
    contains: DataFrame
    live: DataFrame


def conflicts(facts: Facts) -> Conflicts:
    """Loans that are live where they are invalidated, and universal origins that outlive others without being declared so.

    First liveness, as the other rules test it; then subsets and the loans that
    origins hold at a point's start, in one fixpoint of two relations. Rounds grow
    as the longest way through a function's points. Relations without rows give
    none; repeated facts count once; rows with nulls derive nothing.
    """
    cfg = cut(facts.cfg.select("func", "p", "q").dropna().distinct())
    live = cut(origins_live(facts, cfg))
    killed = cut(facts.killed.select("func", "loan", "p").distinct())
    o = lambda name: live.select("func", F.col("origin").alias(name), F.col("p").alias("q"))

    def follows(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("func", F.col("o1").alias("o2"), F.col("o2").alias("o3"), "p")
        return a.join(b, ["func", "o2", "p"]).filter("o1 <> o3").select("func", "o1", F.col("o3").alias("o2"), "p")

    def stays(s: DataFrame) -> DataFrame:
        on = s.join(cfg, ["func", "p"]).join(o("o1"), ["func", "o1", "q"], "left_semi").join(o("o2"), ["func", "o2", "q"], "left_semi")
        return on.select("func", "o1", "o2", F.col("q").alias("p"))

    def passes(c: DataFrame, s: DataFrame) -> DataFrame:
        return c.join(s.withColumnRenamed("o1", "origin"), ["func", "origin", "p"]).select("func", F.col("o2").alias("origin"), "loan", "p")

    def flows(c: DataFrame) -> DataFrame:
        on = c.join(killed, ["func", "loan", "p"], "left_anti").join(cfg, ["func", "p"]).join(o("origin"), ["func", "origin", "q"], "left_semi")
        return on.select("func", "origin", "loan", F.col("q").alias("p"))

    seeds = {"subset": facts.base.select("func", "o1", "o2", "p").dropna(), "contains": facts.issued.select("func", "origin", "loan", "p").dropna()}
    rules = [Rule("subset", ("subset", "subset"), follows), Rule("subset", ("subset",), stays), Rule("contains", ("contains", "subset"), passes), Rule("contains", ("contains",), flows)]
    out = mutual(seeds, rules)
    held = cut(out["contains"].join(live, ["func", "origin", "p"], "left_semi").select("func", "loan", "p").distinct())
    errors = facts.invalidated.select("func", "loan", "p").distinct().join(held, ["func", "loan", "p"], "left_semi")
    free = facts.universal.select("func", F.col("origin").alias("o1")).distinct()
    declared = fixpoint(facts.known.select("func", "o1", "o2"), lambda d: d.join(facts.known.select("func", F.col("o1").alias("o2"), F.col("o2").alias("o3")), ["func", "o2"]).select("func", "o1", F.col("o3").alias("o2")))
    both = out["subset"].join(free, ["func", "o1"], "left_semi").join(free.withColumnRenamed("o1", "o2"), ["func", "o2"], "left_semi")
    wrong = both.filter("o1 <> o2").join(declared, ["func", "o1", "o2"], "left_anti")
    return Conflicts(errors, held, wrong, out["subset"], out["contains"], live)


def settled(pointers: DataFrame, subsets: DataFrame, errors: Callable[[DataFrame], DataFrame], owners: DataFrame, cap: int = 20) -> DataFrame:
    """Permissions that the loan rules agree with: ``errors(permissions)`` are the (func, loan, p) of a hypothesis, by ``conflicts``,
    ``owners`` (func, loan, id) say which pointer a loan is of; the pointers of loans in error lose UNIQUE, round by round.

    Where permissions decide only which loans can be invalidated, what origins hold is the
    same for all of them, so it is found once: ``errors`` then joins ``Conflicts.held`` with what is left.
    """
    return lattice.refined(pointers, subsets, lambda state: errors(state).join(owners, ["func", "loan"]).select("id"), cap)
