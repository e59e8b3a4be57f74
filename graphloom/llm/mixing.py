"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source has the same expected number of copies, target over
source size. Its whole part is taken at once. The fractions are rounded in
pairs: two documents exchange words, at random but without drift, until one of
them has no fraction left, and the other goes on. Groups of ``FAN`` documents
are folded in one task each; what is left of ``FAN`` groups meets in the next
level, so a source of any size ends in one document after log_FAN(n) levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut
from .common import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
FAN = 64
SEED = 20
#: Sources up to which their table is broadcast; beyond it rows are joined by shuffling.
FEW_SOURCES = 10_000

_ITEM = "struct<h:bigint,id:bigint,size:bigint,base:bigint,f:double>"
_DONE = "array<struct<id:bigint,size:bigint,copies:bigint>>"

#: One step of the fold: `a` is the state (`r`: the document with a fraction, if
#: any, `o`: the finished ones), `x` the next document.
_FOLD = f"""
aggregate(
  items,
  named_struct('r', cast(null as {_ITEM}), 'o', cast(array() as {_DONE})),
  (a, x) -> CASE
    WHEN a.r IS NULL THEN named_struct('r', x, 'o', a.o)
    ELSE transform(array(named_struct(
        'wa', a.r.f * a.r.size, 'wb', x.f * x.size,
        'u', pmod(xxhash64(a.r.h, x.h, {SEED}), 1073741824) / 1073741824D)), v ->
      transform(array(named_struct(
          'give', least(v.wa, x.size - v.wb), 'get', least(v.wb, a.r.size - v.wa))), m ->
        CASE
          WHEN v.u * (m.give + m.get) < m.get THEN CASE
            WHEN v.wa <= x.size - v.wb THEN named_struct(
              'r', named_struct('h', x.h, 'id', x.id, 'size', x.size, 'base', x.base, 'f', (v.wa + v.wb) / x.size),
              'o', array_append(a.o, named_struct('id', a.r.id, 'size', a.r.size, 'copies', a.r.base)))
            ELSE named_struct(
              'r', named_struct('h', a.r.h, 'id', a.r.id, 'size', a.r.size, 'base', a.r.base, 'f', (v.wa + v.wb - x.size) / a.r.size),
              'o', array_append(a.o, named_struct('id', x.id, 'size', x.size, 'copies', x.base + 1L))) END
          ELSE CASE
            WHEN v.wb <= a.r.size - v.wa THEN named_struct(
              'r', named_struct('h', a.r.h, 'id', a.r.id, 'size', a.r.size, 'base', a.r.base, 'f', (v.wa + v.wb) / a.r.size),
              'o', array_append(a.o, named_struct('id', x.id, 'size', x.size, 'copies', x.base)))
            ELSE named_struct(
              'r', named_struct('h', x.h, 'id', x.id, 'size', x.size, 'base', x.base, 'f', (v.wa + v.wb - a.r.size) / x.size),
              'o', array_append(a.o, named_struct('id', a.r.id, 'size', a.r.size, 'copies', a.r.base + 1L))) END
        END)[0])[0]
  END)
"""


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: its size, weight and target.

    The weights repeat over the sources in code point order, null last. A target
    stops at ``most`` times its source's size and the excess goes to the others
    by weight. In order of cap over weight the stopped sources come first, so
    running sums find them without rounds.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("double"))
    src = src.withColumn("cap", F.col("source_size") * float(most)).withColumn("total", F.sum("source_size").over(every) * share)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    src = src.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("heavy", F.sum("w").over(onward))
    src = src.withColumn("full", F.col("left") * F.col("w") >= F.col("cap") * F.col("heavy"))
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    return src.select("source", "source_size", "w", F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - taken) / free * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", fan: int = FAN) -> DataFrame:
    """Copies of each document, so that each source gets its target of words.

    Rows: doc_id, source, size, source_size, target, copies, taken. Texts
    without words (null, empty) have size 0 and no copies. Every row of the
    input is a document, repeated and null ids too. Rows that agree in id, source and
    size are interchangeable. Long texts are counted whole. What is left of a source at the end
    is one document with a fraction; it is rounded to the nearer side, so a
    source misses its target by half a document at most. An empty table gives
    no rows. Draws hash the ids, so reruns agree. Other columns are not read,
    whatever their names.
    """
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    targets = cut(source_targets(sizes))
    # a source may hold most rows: the table of sources is sent to them while it is short
    near = F.broadcast if targets.count() <= FEW_SOURCES else (lambda x: x)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))  # null is a source of its own
    names = targets.select(key.alias("k"), "source_size", "target")
    rows = sizes.withColumn("k", key).join(near(names), "k").withColumn("p", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("base", F.floor("p").cast("long")).withColumn("f", F.col("p") - F.floor("p"))
    settled = rows.filter((F.col("f") <= 0) | (F.col("size") == 0)).select("k", "id", "size", F.col("base").alias("copies"))
    open_rows = rows.filter((F.col("f") > 0) & (F.col("size") > 0))
    largest = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    groups = -(-largest // fan)
    # rows that agree in all that counts here are numbered, so that any number of them (null ids, say) spreads over the groups:
    # each task counts its own, running sums over the tasks give where its numbers begin
    alike = ["k", "id", "size", "base", "f"]
    counted = open_rows.groupBy(*alike, F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*alike).orderBy("task"))
    each = counted.withColumn("upto", upto).withColumn("number", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))))
    h = F.xxhash64("id", "size", "number", F.lit(SEED))
    level = each.select("k", F.pmod(F.shiftright(h, 8), F.lit(groups)).alias("g"), F.struct(h.alias("h"), F.col("id").cast("long").alias("id"), "size", "base", "f").alias("item"))
    parts = [settled]
    while True:
        folded = cut(level.groupBy("k", "g").agg(F.sort_array(F.collect_list("item")).alias("items")).select("k", "g", F.expr(_FOLD).alias("s")))
        parts.append(folded.select("k", F.explode("s.o").alias("d")).select("k", "d.id", "d.size", "d.copies"))
        if groups == 1:
            break
        groups = -(-groups // fan)
        level = folded.filter("s.r IS NOT NULL").select("k", F.pmod("g", F.lit(groups)).alias("g"), F.col("s.r").alias("item"))
    last = F.col("s.r")
    parts.append(folded.filter("s.r IS NOT NULL").select("k", last["id"].alias("id"), last["size"].alias("size"), (last["base"] + F.when(last["f"] >= 0.5, 1).otherwise(0)).cast("long").alias("copies")))
    done = parts[0]
    for x in parts[1:]:
        done = done.unionByName(x)
    return done.join(near(targets.select(key.alias("k"), "source", "source_size", "target")), "k").select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
