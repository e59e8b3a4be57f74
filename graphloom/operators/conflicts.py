"""Accesses of calls that clash, innermost ranges, uses of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much an access destroys.
RANKS = {"Read": 0, "SharedBorrow": 1, "Move": 2, "Call": 3, "MutBorrow": 4}
DESTRUCTIVE = ("Move", "Call", "MutBorrow")


def clashes(a: str, b: str) -> Column:
    """Whether two accesses of different arguments clash; an unknown root overlaps every place."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    overlap = x("root").isNull() | y("root").isNull() | (x("root") == y("root"))
    shared = (x("kind") == "SharedBorrow") & (y("kind") == "SharedBorrow")
    reads = (x("kind") == "Read") & (y("kind") == "Read")
    return (x("arg") != y("arg")) & overlap & ~shared & ~reads & (x("kind").isin(*DESTRUCTIVE) | y("kind").isin(*DESTRUCTIVE))


def conflict_pairs(accesses: DataFrame) -> DataFrame:
    """(call, a, b): clashing accesses of one call, the earlier first.

    ``accesses`` is (call, ord, arg, kind, root, ...). A pair needs a destroyer,
    so only destroyers meet the others of their call and place.
    """
    row = F.struct("ord", "arg", "kind", "root", *[c for c in accesses.columns if c not in ("call", "ord", "arg", "kind", "root")])
    x = accesses.filter(F.col("kind").isin(*DESTRUCTIVE)).select("call", row.alias("x"))
    y = accesses.select("call", row.alias("y"))
    known = x.filter("x.root IS NOT NULL").join(y.filter("y.root IS NOT NULL"), (x["call"] == y["call"]) & (F.col("x.root") == F.col("y.root"))).select(x["call"], "x", "y")
    loose = x.join(y, "call").filter("x.root IS NULL OR y.root IS NULL").select("call", "x", "y")
    both = known.union(loose).filter(F.col("x.ord") != F.col("y.ord")).filter(clashes("x", "y"))
    first = F.col("x.ord") < F.col("y.ord")
    return both.select("call", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b")).distinct()


def same_step(a: Column, b: Column) -> Column:
    """Steps (kind, index, literal): literal indices compare, any other index equals any index."""
    index = F.when((a["kind"] == "Index") & a["literal"] & b["literal"], a["index"] == b["index"])
    field = F.when(a["kind"] == "Field", a["index"] == b["index"])
    return (a["kind"] == b["kind"]) & F.coalesce(index, field, F.lit(True))


def separable(a: Column, b: Column) -> Column:
    """The paths part at a step that can be split, after a common beginning of such steps; if one begins the other they never part.

    A step is (kind, index, literal, splittable).
    """
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(same_step(x, y).alias("same"), (x["splittable"] & y["splittable"]).alias("split")))
    stop = F.array_position(F.transform(pairs, lambda p: p["same"]), F.lit(False)).cast("int")
    return F.coalesce((stop > 0) & F.forall(F.slice(pairs, F.lit(1), F.greatest(stop, F.lit(0))), lambda p: p["split"]), F.lit(False))


def unresolved(pairs: DataFrame) -> DataFrame:
    """Conflict pairs whose places, of one known root, do not part at a split; ``a`` and ``b`` have ``path``."""
    known = F.coalesce(F.col("a.root") == F.col("b.root"), F.lit(False))
    return pairs.filter(~(known & separable(F.col("a.path"), F.col("b.path"))))


def chosen_side(pairs: DataFrame) -> DataFrame:
    """Append pick: of each pair the less destructive access, then the later argument, then the leftmost place."""
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    order = lambda s: F.struct(rank[F.col(f"{s}.kind")], -F.col(f"{s}.arg"), F.col(f"{s}.ord"))
    return pairs.withColumn("pick", F.when(order("a") <= order("b"), F.col("a")).otherwise(F.col("b")))


def planned(pairs: DataFrame, feasible: DataFrame) -> DataFrame:
    """(call, outer, ord): what is lifted out of each call whose lifts are all feasible.

    Pairs that part at a split need nothing. Of the others one side is chosen, and
    its outer expression is lifted, once, for the first pair that asks for it;
    ``ord`` is that pair's access, ``feasible`` is (call, outer, ord). Order is the place of the access.
    """
    picks = chosen_side(unresolved(pairs)).select("call", F.col("pick.outer").alias("outer"), F.struct("a.ord", "b.ord").alias("edge"), F.col("pick.ord").alias("ord"))
    once = picks.groupBy("call", "outer").agg(F.min_by("ord", "edge").alias("ord"))
    ok = once.join(feasible.select("call", "outer", "ord", F.lit(True).alias("ok")).distinct(), ["call", "outer", "ord"], "left")
    whole = ok.groupBy("call").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_ok")).filter("all_ok")
    return once.join(whole.select("call"), "call", "left_semi")


def _holders(points: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(p, r): each point or span with the ranges of its key that hold it.

    A range of length n is put into the one or two cells of size 2^ceil(log2 n)
    that it touches; a point looks into its cell of each size that its key has.
    So the join is on equality, and what meets in a cell is near.
    """
    level = F.ceil(F.log2((F.col("end") - F.col("start") + 1).cast("double"))).cast("int")
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), "level")).cast("long")
    r = ranges.select(key, F.struct("start", "end", "id").alias("r"), level.alias("level"), "start", "end")
    r = r.select(key, "r", "level", F.explode(F.array_distinct(F.array(cell(F.col("start")), cell(F.col("end"))))).alias("cell"))
    p = points.select(key, F.struct(*points.columns).alias("p")).join(r.select(key, "level").distinct(), key)
    p = p.withColumn("cell", cell(F.col("p.start")))
    return p.join(r, [key, "level", "cell"]).filter("r.start <= p.start AND r.end >= p.end").select("p", "r")


def innermost(points: DataFrame, ranges: DataFrame, key: str = "file") -> DataFrame:
    """Append ``range_id``: the shortest range (start, end inclusive, id) of the key that holds each (start, end); null if none does.

    Equal points get equal answers.
    """
    best = _holders(points.distinct(), ranges, key).groupBy("p").agg(F.min(F.struct((F.col("r.end") - F.col("r.start")).alias("n"), F.col("r.id").alias("id"))).alias("m"))
    found = best.select(F.to_json("p").alias("__p__"), F.col("m.id").alias("range_id"))
    return points.withColumn("__p__", F.to_json(F.struct(*points.columns))).join(found, "__p__", "left").select(*points.columns, "range_id")


def parents_by_range(ranges: DataFrame, key: str = "file") -> DataFrame:
    """(id, parent): the smallest other range that holds each range; of equal ones the one with the smaller id holds."""
    held = _holders(ranges, ranges, key).filter("r.id <> p.id AND NOT (r.start = p.start AND r.end = p.end AND r.id > p.id)")
    best = held.groupBy("p.id").agg(F.min_by(F.col("r.id"), F.struct(F.col("r.end") - F.col("r.start"), F.col("r.start"), -F.col("r.id"))).alias("parent"))
    return ranges.select("id").join(best, "id", "left")


def post_order(ranges: DataFrame, key: str = "file") -> DataFrame:
    """Append ``place``: each range's number from 0 in its key, inner ranges before those that hold them, neighbours from left to right.

    The ranges are nested or apart; of equal ones the one with the larger id is the inner one.
    """
    order = Window.partitionBy(key).orderBy("end", F.desc("start"), F.desc("id"))
    return ranges.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def item_uses(references: DataFrame, ranges: DataFrame) -> DataFrame:
    """(user, used): distinct pairs of the item around each reference and the item that it names."""
    return innermost(references, ranges).filter("range_id IS NOT NULL").select(F.col("range_id").alias("user"), "used").distinct()


def used_by(uses: DataFrame) -> DataFrame:
    """(user, items): what each item uses directly, in order."""
    return uses.groupBy("user").agg(F.array_sort(F.collect_set("used")).alias("items"))
