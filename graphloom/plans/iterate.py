"""Iteration on frames: lineage cuts, semi-naive fixpoints, doubling over forests, dense numbers, components.

The driver sees counts and fingerprints of a round, never its rows. No loop has a
bound of its own: each ends when a round adds nothing.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, count

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rounds of a fixpoint that stay apart before they are written as one.
TOGETHER = 12


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder (``spark.checkpoint.dir``) and go on from there.

    Where the session names no folder, a local master gets a temporary one; on a
    cluster that is an error, as other machines would not see it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], cap: int | None = None) -> DataFrame:
    """All rows that ``step`` derives from ``seed``, directly or again.

    Each round works on the new rows only and writes these only. It ends when a
    round finds nothing new; with ``cap`` more rounds than that are an error.
    """
    rounds = Rounds(seed.distinct())
    for n in count():
        rounds.settle()
        every = rounds.every()
        rounds.add(step(rounds.last).select(*every.columns).distinct().join(every, every.columns, "left_anti"))
        if not rounds.new:
            return rounds.every()
        if n == cap:
            raise RuntimeError(f"no fixpoint after {cap} rounds")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, int, str]:
    """``df`` as Parquet in the shared folder, read again, with its number of rows, counted on the way, and its path."""
    path, seen = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"], path


def stored(df: DataFrame, paths: list[str] | None = None, clean: bool = True) -> DataFrame:
    """Like ``cut`` for large frames: Parquet, packed by columns, after which the shuffles and checkpoints that nothing refers to any more are dropped.

    ``paths`` gets its path, for ``deleted``.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    if clean:
        tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner see what has gone out of use; else old shuffle files stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


class Rounds:
    """The rows that a fixpoint has found, round by round; a round writes its own rows only.

    Once in ``TOGETHER`` rounds the earlier ones are written as one, and what they had written is deleted.
    """

    def __init__(self, seed: DataFrame, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        self.parts: list[DataFrame] = []
        self.paths: list[str] = []
        self.fold = fold
        self.last, self.new = seed, 0
        self.add(seed)

    def every(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    def add(self, rows: DataFrame) -> None:
        """Write a round's rows: ``last`` has them, ``new`` is their number."""
        self.last, self.new, path = written(rows)
        if self.new or not self.parts:
            self.parts.append(self.last)
            self.paths.append(path)

    def settle(self) -> None:
        """Between two rounds: put the earlier ones together if they are many. Frames of ``every`` from before are void then."""
        if len(self.parts) > TOGETHER:
            old = self.paths[:-1]
            one, _, path = written(self.fold(reduce(DataFrame.union, self.parts[:-1])))
            self.parts, self.paths = [one, self.parts[-1]], [path, self.paths[-1]]
            deleted(one.sparkSession, old)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Rule:
    """Rows of ``head`` from one row each of the relations of ``body``: ``make`` gets their frames and returns head's columns."""

    head: str
    body: tuple[str, ...]
    make: Callable[..., DataFrame]


def mutual(seeds: dict[str, DataFrame], rules: list[Rule]) -> dict[str, DataFrame]:
    """All rows that the rules derive, for several relations that depend on each other; ``seeds`` has every head.

    Semi-naive: in a round each relation has its own new rows, and a rule is
    applied once for each place of its body that has some, with all rows known
    at the other places. A round writes new rows only. What a rule negates must be
    complete before, that is come from outside or from an earlier call. It ends when a round
    finds nothing new.
    """
    rounds = {name: Rounds(seed.distinct()) for name, seed in seeds.items()}
    delta = {name: r.last for name, r in rounds.items() if r.new}
    while delta:
        for r in rounds.values():
            r.settle()
        every = {name: r.every() for name, r in rounds.items()}
        found: dict[str, list[DataFrame]] = {}
        for r in rules:
            for i, name in enumerate(r.body):
                if name in delta:
                    frames = [delta[name] if k == i else every[other] for k, other in enumerate(r.body)]
                    found.setdefault(r.head, []).append(r.make(*frames).select(*every[r.head].columns))
        for head, frames in found.items():
            rounds[head].add(reduce(DataFrame.union, frames).distinct().join(every[head], every[head].columns, "left_anti"))
        delta = {head: rounds[head].last for head in found if rounds[head].new}
    return {name: r.every() for name, r in rounds.items()}


def fingerprint(df: DataFrame) -> tuple:
    """Row count and an order-free hash sum: equal for equal frames."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], cap: int | None = None) -> DataFrame:
    """Apply ``step`` until the frame no longer changes; with ``cap``, more rounds than that are an error."""
    state = cut(state)
    before = fingerprint(state)
    for n in count():
        state = cut(step(state))
        now = fingerprint(state)
        if now == before:
            return state
        if n == cap:
            raise RuntimeError(f"no fixpoint after {cap} rounds")
        before = now


def along(edges: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Sends rows along ``edges`` (keys, ``to_``keys): what comes out has the ends' keys and the values of the starts."""
    e = cut(edges)

    def send(delta: DataFrame) -> DataFrame:
        return delta.join(e, keys).select(*(F.col(f"to_{k}").alias(k) if f"to_{k}" in e.columns else F.col(k) for k in keys), *(c for c in delta.columns if c not in keys))

    return send


def pushed(state: DataFrame, send: Callable[[DataFrame], DataFrame], keys: list[str], values: dict[str, Callable]) -> DataFrame:
    """``state`` (keys, values), one row a key, with each value aggregated over all rows that ``send`` carries to a key, directly or again.

    The aggregates are idempotent (``min``, ``max``, ``bool_or``). Only rows that
    changed in a round are written, and send anything in the next one. Rows with a null key are not sent.
    """
    folded = lambda df: df.groupBy(*keys).agg(*(f(v).alias(v) for v, f in values.items()))
    rounds = Rounds(state.select(*keys, *values), folded)
    while rounds.new:
        rounds.settle()
        sent = send(rounds.last).dropna(subset=keys).groupBy(*keys).agg(*(f(F.col(v)).alias(f"__{v}") for v, f in values.items()))
        # of the state only the keys that something was sent to
        now = folded(rounds.every().join(sent.select(*keys), keys, "left_semi")).withColumn("__here__", F.lit(True))
        new = {v: _of_two(f)(F.col(v), F.col(f"__{v}")) for v, f in values.items()}
        changed = reduce(lambda a, b: a | b, (~new[v].eqNullSafe(F.col(v)) for v in values), F.col("__here__").isNull())
        rounds.add(sent.join(now, keys, "left").filter(changed).select(*keys, *(new[v].alias(v) for v in values)))
    return folded(rounds.every())


def _of_two(f: Callable) -> Callable:
    """The same aggregate of two values, null for none."""
    return {F.min: F.least, F.max: F.greatest, F.bool_or: F.greatest}[f]


def jumps(parents: DataFrame, group: list[str]) -> Iterable[DataFrame]:
    """(group, id, up): each node with its ancestor 1, 2, 4, ... steps above; nodes that have none are left out.

    ``parents`` is (group, id, up), one row a node, without cycles. Each frame
    takes one join of the last one with itself, so a chain of n nodes takes log2(n).
    """
    jump = cut(parents.filter("up IS NOT NULL").select(*group, "id", "up"))
    while not jump.isEmpty():
        yield jump
        above = jump.select(*group, F.col("id").alias("up"), F.col("up").alias("__top__"))
        jump = cut(jump.join(above, [*group, "up"]).select(*group, "id", F.col("__top__").alias("up")))


def over_subtrees(parents: DataFrame, seed: DataFrame, group: list[str], values: dict[str, Callable]) -> DataFrame:
    """(group, id, values): each value aggregated over a node's subtree, itself included; nodes with none below are absent.

    ``seed`` is (group, id, values). The aggregates are idempotent. Rounds grow as
    the logarithm of the depth.
    """
    state = cut(seed.select(*group, "id", *values))
    for jump in jumps(parents, group):
        sent = state.join(jump, [*group, "id"]).select(*group, F.col("up").alias("id"), *values)
        both = state.union(sent)
        state = cut(both.groupBy(*group, "id").agg(*(f(v).alias(v) for v, f in values.items())) if values else both.distinct())
    return state


def below(parents: DataFrame, seed: DataFrame, group: list[str]) -> DataFrame:
    """(group, id): the nodes of ``seed`` and all that hang under them."""
    state = cut(seed.select(*group, "id").distinct())
    for jump in jumps(parents, group):
        sent = jump.join(state.withColumnRenamed("id", "up"), [*group, "up"], "left_semi").select(*group, "id")
        state = cut(state.union(sent).distinct())
    return state


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, steps) of all nodes and all their ancestors, steps counted from 1."""
    found: DataFrame | None = None
    for n, jump in enumerate(jumps(parents, [])):
        here = jump.select("id", F.col("up").alias("ancestor"), F.lit(1 << n).alias("steps"))
        if found is None:
            found = here
            continue
        further = jump.join(found.select(F.col("id").alias("up"), "ancestor", (F.col("steps") + (1 << n)).alias("steps")), "up").select("id", "ancestor", "steps")
        found = cut(found.union(here).union(further))
    return parents.select("id", F.col("up").alias("ancestor"), F.lit(1).alias("steps")).limit(0) if found is None else found


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Append ``name``: the rows' numbers from 0 in the order of a column, without gaps.

    Ranges of the column are numbered apart and moved by the sizes of those
    before; the driver sees one count a range.
    """
    placed = cut(df.repartitionByRange(order).withColumn("__part__", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__part__").agg(F.count("*")).collect())
    below_ = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes[:-1]), initial=0)))
    offset = F.create_map(*(F.lit(x).cast("long") for kv in below_.items() for x in kv))[F.col("__part__").cast("long")] if below_ else F.lit(0)
    number = F.row_number().over(Window.partitionBy("__part__").orderBy(order)) - 1 + offset
    return placed.withColumn(name, number.cast("long")).drop("__part__")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that an edge (a, b) has; a component is named by its smallest id.

    Alternating large-star and small-star rounds: each hangs the larger
    neighbours of a node, then the smaller ones, under the smallest. Rounds grow
    as the logarithm of the longest chain. Loops and null ends are ignored. The
    joins of a round are left to the adaptive planner, which splits the centre of a
    large star; the least neighbour is found by partial minima before the shuffle.
    """

    def step(e: DataFrame) -> DataFrame:
        near = e.select(F.col("b").alias("u"), F.col("a").alias("v")).union(e.select("a", "b")).groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = e.join(near, e["b"] == near["u"]).select("a", F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.union(lowest.select("a", F.col("m").alias("b"))).distinct()

    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = until_stable(e, step)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
