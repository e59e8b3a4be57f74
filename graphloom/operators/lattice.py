"""Fixpoints over constraint tables: permission bits, flags, pointees, classes, bounds, writes, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import along, components, cut, deleted, fixpoint, numbered, pushed, written

#: Permission bits.
READ, WRITE, UNIQUE, LINEAR, OFFSET_ADD, OFFSET_SUB, FREE, NON_NULL, HEAP, STACK = (1 << i for i in range(10))
DOWN = UNIQUE | NON_NULL | HEAP | STACK
UP = READ | WRITE | OFFSET_ADD | OFFSET_SUB | FREE
OFFSETS = OFFSET_ADD | OFFSET_SUB


def _and(a: Column, b: Column | int) -> Column:
    return a.bitwiseAND(b)


def propagate(pointers: DataFrame, subsets: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """(id, perms): permission bits at the fixpoint.

    ``pointers`` is (id, perms, forbidden), ``subsets`` (a, b, except_mask): what a
    points to, b may point to. What b lacks of the DOWN bits, a loses; what a has
    of the UP bits, b gains; if a has FREE and b an offset, a gains that offset.
    LINEAR does not move. Masked bits are left out of a constraint, forbidden
    bits keep their first value. Bits of UP only come and bits of DOWN only go, so
    the order of constraints is no matter, and pointers that changed in a round
    are the only ones whose constraints are looked at in the next.

    ``constraints`` (id, kind, mask) set bits (all_perms) and clear bits (no_perms)
    first; that the flow brings back what they took is an error, as no values satisfy both.
    """
    first = pointers.select("id", F.col("perms").cast("int").alias("perms"), F.coalesce("forbidden", F.lit(0)).cast("int").alias("f"))
    if constraints is not None:
        said = cut(constraints.groupBy("id").agg(*(F.bit_or(F.when(F.col("kind") == k, F.col("mask")).otherwise(0)).cast("int").alias(k) for k in ("all_perms", "no_perms"))))
        given = _and(F.col("perms").bitwiseOR(F.coalesce("all_perms", F.lit(0))), F.bitwise_not(F.coalesce("no_perms", F.lit(0))))
        kept = _and(given, F.bitwise_not("f")).bitwiseOR(_and(F.col("perms"), F.col("f")))
        first = first.join(said, "id", "left").select("id", kept.alias("perms"), "f")
    edges = cut(subsets.select("a", "b", F.bitwise_not(F.coalesce("except_mask", F.lit(0)).cast("int")).alias("mask")).repartition("a"))
    state, _, path = written(first)
    touched = edges
    while True:
        value = lambda n: state.select(F.col("id").alias(n), F.col("perms").alias(f"p{n}"))  # noqa: E731, B023
        both = touched.join(value("a"), "a").join(value("b"), "b")
        offsets = F.when(_and(F.col("pa"), FREE) != 0, _and(F.col("pb"), OFFSETS)).otherwise(0)
        to_a = F.struct(F.col("a").alias("id"), _and(F.bitwise_not("pb"), _and(F.col("mask"), DOWN)).alias("lose"), _and(offsets, F.col("mask")).alias("gain"))
        to_b = F.struct(F.col("b").alias("id"), F.lit(0).alias("lose"), _and(F.col("pa"), _and(F.col("mask"), UP)).alias("gain"))
        per = both.select(F.explode(F.array(to_a, to_b)).alias("x")).select("x.*").groupBy("id").agg(F.bit_or("lose").alias("lose"), F.bit_or("gain").alias("gain"))
        moved = _and(F.col("perms").bitwiseOR(F.coalesce("gain", F.lit(0))), F.bitwise_not(F.coalesce("lose", F.lit(0))))
        new = _and(moved, F.bitwise_not("f")).bitwiseOR(_and(F.col("perms"), F.col("f")))
        before = path
        state, _, path = written(state.join(per, "id", "left").select("id", new.alias("perms"), "f", (new != F.col("perms")).alias("changed")))
        dirty, n, _ = written(state.filter("changed").select("id"))
        if not n:
            break
        deleted(state.sparkSession, [before])
        touched = edges.join(dirty, edges["a"] == dirty["id"], "left_semi").union(edges.join(dirty, edges["b"] == dirty["id"], "left_semi")).distinct()
    if constraints is None:
        return state.select("id", "perms")
    broken = _and(_and(F.col("perms"), F.col("no_perms")).bitwiseOR(_and(F.bitwise_not("perms"), F.col("all_perms"))), F.bitwise_not("f")) != 0
    ok = F.assert_true(~F.coalesce(broken, F.lit(False)), F.lit("constraints contradict each other"))
    return state.join(said, "id", "left").filter(F.coalesce(ok.cast("boolean"), F.lit(True))).select("id", "perms")


def cells(pointers: DataFrame, subsets: DataFrame) -> DataFrame:
    """(id) of pointers that need a cell: seeded where WRITE is there without UNIQUE, spread both ways over subsets (a, b).

    b does not keep a flag that comes from a if b has WRITE with UNIQUE; a takes
    b's flag whatever its own bits are, and passes it on to what flows into it.
    """
    w, u = _and(F.col("perms"), WRITE) != 0, _and(F.col("perms"), UNIQUE) != 0
    shut = pointers.filter(w & u).select(F.col("id").alias("b"))
    e = cut(subsets.select("a", "b").join(shut, "b", "left_anti").select("a", "b").union(subsets.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return fixpoint(pointers.filter(w & ~u).select("id"), lambda d: d.join(e, F.expr("id = a")).select(F.col("b").alias("id")))


def pointees(seeds: DataFrame, subsets: DataFrame) -> DataFrame:
    """(id, type) with types pushed along Subset(p, q) from p to q."""
    e = cut(subsets.select("p", "q"))
    return fixpoint(seeds.select("id", "type"), lambda d: d.join(e, F.expr("id = p")).select(F.col("q").alias("id"), "type"))


def sole_types(types: DataFrame) -> DataFrame:
    """(id, type) of ids with one type only, a concrete one."""
    one = types.groupBy("id").agg(F.min("type").alias("type"), F.max("type").alias("other"), F.bool_and("concrete").alias("c"))
    return one.filter("type = other AND c").select("id", "type")


def unified(nodes: DataFrame, equal: DataFrame) -> DataFrame:
    """(id, rep, type, conflict) by unification: rep is the class's smallest id, conflict says that concrete types differ."""
    comp = components(equal.select("a", "b"))
    named = nodes.join(comp, "id", "left").withColumn("rep", F.coalesce("component", "id"))
    per = named.groupBy("rep").agg(F.min("type").alias("type"), F.max("type").alias("other"))
    return named.select("id", "rep").join(per, "rep").select("id", "rep", "type", F.coalesce(F.col("type") != F.col("other"), F.lit(False)).alias("conflict"))


def renumbered(nodes: DataFrame, equal: DataFrame) -> DataFrame:
    """(id, rep, number): classes represented by a global member if there is one, numbered from 0 in order of first id."""
    comp = components(equal.select("a", "b"))
    named = cut(nodes.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")))
    reps = named.groupBy("c").agg(F.min(F.struct((~F.col("is_global")).alias("local"), "id")).alias("r"), F.min("id").alias("first"))
    return named.join(numbered(reps, "first", "number"), "c").select("id", F.col("r.id").alias("rep"), "number")


def bounds(variables: DataFrame, at_most: DataFrame, caps: DataFrame, top: int = 2, mins: DataFrame | None = None) -> DataFrame:
    """(id, low, high) over an ordered lattice from 0 to ``top``: low is the largest start that reaches id, high the smallest cap that id reaches, else ``top``.

    ``at_most`` is (a, b) for a <= b; ``mins`` is (id, part) for a variable that
    is the least of its parts, and so at most each of them. What is at most such a
    variable is at most all parts; that the variable reaches one of its parts
    from below is not concluded, so its low may be lower than it need be.
    """
    e = at_most.select("a", "b")
    if mins is not None:
        e = e.union(mins.select("id", "part"))
    low = pushed(variables.select("id", F.coalesce("low", F.lit(0)).cast("long").alias("low")), along(e.select(F.col("a").alias("id"), F.col("b").alias("to_id")), ["id"]), ["id"], {"low": F.max})
    high = pushed(caps.select("id", F.col("cap").cast("long").alias("high")), along(e.select(F.col("b").alias("id"), F.col("a").alias("to_id")), ["id"]), ["id"], {"high": F.min})
    return variables.select("id").join(low, "id").join(high, "id", "left").select("id", "low", F.coalesce("high", F.lit(top)).cast("long").alias("high"))


def recent_writes(statements: DataFrame, entry: DataFrame | None = None) -> DataFrame:
    """Append ``write``: the last statement strictly before that wrote the place, null if none did or several may have.

    ``statements`` is (func, block, place, stmt, writes, partial). A write of the same
    block counts first; a partial one leaves none. Before a block's first write
    the state at its start counts: ``entry`` is (func, block, place, low, high) from
    ``block_entry_writes``; without it a block starts unwritten.
    """
    before = Window.partitionBy("func", "block", "place").orderBy("stmt").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("writes"), F.struct("stmt", "partial")), ignorenulls=True).over(before)
    own = F.when(~F.col("w.partial"), F.col("w.stmt"))
    if entry is None:
        return statements.withColumn("w", last).withColumn("write", own).drop("w")
    one = entry.filter("low = high").select("func", "block", "place", F.col("low").alias("__entry__"))
    out = statements.withColumn("w", last).join(one, ["func", "block", "place"], "left")
    return out.select(*statements.columns, F.when(F.col("w").isNull(), F.col("__entry__")).otherwise(own).alias("write"))


def last_writes(statements: DataFrame) -> DataFrame:
    """(func, block, place, low, high) at a block's end, of places that it writes: the last write; low and high differ if it is partial."""
    last = statements.filter("writes").groupBy("func", "block", "place").agg(F.max(F.struct("stmt", "partial")).alias("w"))
    several = lambda side: F.when(F.col("w.partial"), F.lit(side).cast("long")).otherwise(F.col("w.stmt"))
    return last.select("func", "block", "place", several(-2).alias("low"), several(-1).alias("high"))


def block_entry_writes(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """(func, block, place, low, high): writes that may reach a block's start; equal for one, different for several.

    A block that writes a place passes its own last write on (several, if that
    is partial), others what they get. ``edges`` is (func, src, dst). States
    are joined as smallest and largest write, so no set of writes is kept.
    """
    gen = cut(last_writes(statements))
    hop = along(edges.select("func", F.col("src").alias("block"), F.col("dst").alias("to_block")), ["func", "block"])
    own = gen.select("func", "block", "place")
    through = lambda d: hop(d.join(own, ["func", "block", "place"], "left_anti"))
    start = hop(gen).groupBy("func", "block", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return pushed(start, through, ["func", "block", "place"], {"low": F.min, "high": F.max})


def last_uses(uses: DataFrame, live_out: DataFrame) -> DataFrame:
    """Uses after which the local is used no more in its block and is not live at the block's end.

    ``uses`` is (block, local, stmt, kind); a later definition ends a life too.
    """
    order = Window.partitionBy("block", "local").orderBy("stmt")
    u = uses.withColumn("then", F.lead("kind").over(order))
    gone = u.join(live_out.select("block", "local", F.lit(True).alias("live")), ["block", "local"], "left")
    return gone.filter("kind = 'use' AND (then = 'def' OR (then IS NULL AND live IS NULL))").drop("then", "live")


def live_in(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, local) live at a block's start: used before any definition there, or live at a successor's start and not defined."""
    kill = cut(blocks.filter("defines").select(F.col("block").alias("kb"), F.col("local").alias("kl")))
    hop = cut(edges.select("src", "dst"))

    def step(d: DataFrame) -> DataFrame:
        back = d.join(hop, F.expr("block = dst")).select(F.col("src").alias("block"), "local")
        return back.join(kill, (F.col("block") == F.col("kb")) & (F.col("local") == F.col("kl")), "left_anti")

    return fixpoint(blocks.filter("uses_first").select("block", "local"), step)


def live_out(live: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, local) live at a block's end: live at the start of a successor."""
    return live.join(edges, F.expr("block = dst")).select(F.col("src").alias("block"), "local").distinct()


def refined(pointers: DataFrame, subsets: DataFrame, loans, cap: int = 20) -> DataFrame:
    """Permissions after outer rounds: ``loans(frame)`` names pointers that must lose UNIQUE; an error after ``cap`` rounds.

    The constraints of all functions are one table, so a round settles every
    function and what they share at once; the values are those of going through
    the functions in turn until the shared part no longer changes.
    """
    state = propagate(pointers, subsets)
    for _ in range(cap):
        bad = loans(state).select("id").join(state.filter(_and(F.col("perms"), UNIQUE) != 0), "id", "left_semi").distinct()
        if bad.isEmpty():
            return state
        lost = state.join(bad.withColumn("bad", F.lit(True)), "id", "left")
        perms = F.when(F.col("bad"), _and(F.col("perms"), F.bitwise_not(F.lit(UNIQUE)))).otherwise(F.col("perms"))
        state = propagate(lost.select("id", perms.cast("int").alias("perms")).join(pointers.select("id", "forbidden"), "id"), subsets)
    raise RuntimeError(f"loans are left after {cap} rounds")
