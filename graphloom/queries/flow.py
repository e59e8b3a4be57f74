"""Provenance, event and fixpoint queries on stand-ins: a user's events as one object's history, a customer's orders as pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import forest, lattice
from ..streaming.capture import EVENT_HOOKS, hook_events


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def forest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A graph a user, a node an event in order of time: views hang under the last sign-up, every fourth and the rest under the last view or sign-up, else under node 0.

    Views of even number are projections, of one field.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    e = _t(spark, sf, "events").withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    last = lambda *kinds: F.max(F.when(F.col("event_type").isin(*kinds), F.col("n"))).over(before)
    source = F.when(F.col("event_type") == "signup", F.lit(0)).when((F.col("event_type") == "view") & (F.col("event_id") % 4 != 0), last("signup")).otherwise(last("signup", "view"))
    kind = F.create_map(*(F.lit(x) for kv in {"signup": "Copy", "view": "Copy", "click": "LoadAddr", "purchase": "StoreAddr", "error": "Offset"}.items() for x in kv))[F.col("event_type")]
    kind = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), "Project").otherwise(kind)
    field = F.when(kind == "Project", F.array((F.col("event_id") % 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    return e.select(
        F.col("user_id").alias("graph_id"), F.col("n").alias("node_id"), F.when(F.col("n") > 0, F.coalesce(source, F.lit(0))).cast("long").alias("source"), kind.alias("kind"),
        field.alias("field"), (F.floor("value") - 10).cast("long").alias("offset"), F.concat(F.lit("f"), F.col("user_id") % 7).alias("func"), (F.col("n") % 4).alias("dest"), "event_id",
    )


FOREST = """WITH RECURSIVE ev AS (SELECT *, row_number() OVER w - 1 AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 sv AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN n END) OVER w AS ls, max(CASE WHEN event_type IN ('signup', 'view') THEN n END) OVER w AS lv
   FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 nd AS (SELECT user_id AS g, n, event_id AS e, CASE WHEN n > 0 THEN coalesce(CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'view' AND event_id % 4 <> 0 THEN ls ELSE lv END, 0) END AS s,
   CASE WHEN event_type = 'click' THEN 'LoadAddr' WHEN event_type = 'purchase' THEN 'StoreAddr' WHEN event_type = 'error' THEN 'Offset' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'Project' ELSE 'Copy' END AS kind,
   event_id % 3 AS fld, floor(value)::BIGINT - 10 AS off, 'f' || user_id % 7 AS func, n % 4 AS dest FROM sv),
 up AS (SELECT g, n, n AS a FROM nd UNION ALL SELECT up.g, up.n, nd.s FROM up JOIN nd ON nd.g = up.g AND nd.n = up.a WHERE nd.s IS NOT NULL),
 last AS (SELECT g, a AS n, max(n) AS d FROM up GROUP BY 1, 2),
 cl AS (SELECT g, n, s AS at, []::BIGINT[] AS path FROM nd WHERE kind <> 'Project' OR s IS NULL
   UNION ALL SELECT cl.g, cl.n, p.s, list_prepend(p.fld, cl.path) FROM cl JOIN nd p ON p.g = cl.g AND p.n = cl.at WHERE p.kind = 'Project' AND p.s IS NOT NULL),
 kd AS (SELECT cl.g, cl.n, cl.at AS p, cl.path FROM cl LEFT JOIN nd q ON q.g = cl.g AND q.n = cl.at WHERE cl.at IS NULL OR q.kind <> 'Project' OR q.s IS NULL),
 bad AS (SELECT DISTINCT x.g, x.p AS n FROM kd x JOIN kd y ON y.g = x.g AND y.p = x.p AND y.n < x.n JOIN last l ON l.g = y.g AND l.n = y.n AND l.d > x.n
   WHERE x.path[1:least(len(x.path), len(y.path))] = y.path[1:least(len(x.path), len(y.path))]),
 uq AS (SELECT nd.g, nd.n, NOT EXISTS (SELECT 1 FROM up JOIN bad ON bad.g = up.g AND bad.n = up.a WHERE up.g = nd.g AND up.n = nd.n) AS u FROM nd)"""

_FLOWS = {"load": "kind = 'LoadAddr'", "store": "kind = 'StoreAddr'", "pos_offset": "kind = 'Offset' AND off > 0", "neg_offset": "kind = 'Offset' AND off < 0"}


def _flow_sql() -> str:
    """A node with the flow shows itself; others what their highest child with the flow below it shows."""
    own = " UNION ALL ".join(f"SELECT g, n, '{k}' AS f FROM nd WHERE {c}" for k, c in _FLOWS.items())
    shown = ", ".join(f"max(CASE WHEN f = '{k}' THEN tip END) AS {k}" for k in _FLOWS)
    return FOREST + f""", own AS ({own}), hs AS (SELECT DISTINCT up.g, up.a AS n, f FROM up JOIN own ON own.g = up.g AND own.n = up.n),
 nx AS (SELECT hs.g, hs.f, nd.s AS n, max(hs.n) AS c FROM hs JOIN nd ON nd.g = hs.g AND nd.n = hs.n WHERE nd.s IS NOT NULL GROUP BY 1, 2, 3),
 st AS (SELECT * FROM nx WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.g = nx.g AND own.n = nx.n AND own.f = nx.f)),
 ch AS (SELECT g, n, f, n AS tip FROM hs UNION ALL SELECT ch.g, ch.n, ch.f, st.c FROM ch JOIN st ON st.g = ch.g AND st.n = ch.tip AND st.f = ch.f),
 v4 AS (SELECT nd.g, nd.n, {shown} FROM nd LEFT JOIN (SELECT ch.* FROM ch JOIN own ON own.g = ch.g AND own.n = ch.tip AND own.f = ch.f) c ON c.g = nd.g AND c.n = nd.n GROUP BY 1, 2)"""


def needs_write(spark: SparkSession, sf: str) -> DataFrame:
    return forest.needs_write(forest_nodes(spark, sf))


def last_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return forest.last_descendants(forest_nodes(spark, sf))


def flow_exact(spark: SparkSession, sf: str) -> DataFrame:
    return forest.flow_nodes(forest_nodes(spark, sf))


def unique_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return forest.unique_nodes(forest_nodes(spark, sf))


def graph_permissions(spark: SparkSession, sf: str) -> DataFrame:
    n = forest_nodes(spark, sf)
    out = forest.permissions(n.withColumn("is_null", F.lit(False)), forest.flow_nodes(n), forest.unique_nodes(n))
    return out.select("func", "local", F.col("set_bits").cast("long").alias("set_bits"), F.col("drop_bits").cast("long").alias("drop_bits"))


def collapsed_children(spark: SparkSession, sf: str) -> DataFrame:
    out = forest.collapsed_children(forest_nodes(spark, sf))
    return out.select("graph_id", "node_id", "parent", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


def needs_write_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as one chain: graphs as deep as a user has events."""
    n = forest_nodes(spark, sf).withColumn("source", F.when(F.col("node_id") > 0, F.col("node_id") - 1))
    return forest.needs_write(n)


def distinct_graphs(spark: SparkSession, sf: str) -> DataFrame:
    return forest.without_repeats(_histories(spark, sf)).groupBy("graph_id").agg(F.count("*").alias("n"))


def broken_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Forests with some sources lost and some null pointers among the others."""
    lost = F.when(F.col("event_id") % 97 != 0, F.col("source"))
    return forest.broken(forest_nodes(spark, sf).withColumn("source", lost).withColumn("is_null", F.col("event_id") % 1009 == 0))


def without_local_dest(spark: SparkSession, sf: str) -> DataFrame:
    """Projections stand for addresses of locals here."""
    n = forest_nodes(spark, sf).withColumn("kind", F.when(F.col("kind") == "Project", "AddrOfLocal").otherwise(F.col("kind")))
    return forest.without_local_dest(n).select("graph_id", "node_id", "dest")


def argument_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as arguments of a call and views as results."""
    e = _t(spark, sf, "events").select(
        "event_id", F.concat(F.lit("f"), F.col("user_id") % 5).alias("func"), (F.col("event_id") % 9).cast("int").alias("block"), (F.col("event_id") % 4).cast("int").alias("stmt"),
        F.when(F.col("event_type") == "click", "Arg").when(F.col("event_type") == "view", "Ret").alias("transfer"), F.concat(F.lit("g"), F.col("user_id") % 3).alias("transfer_func"),
    )
    return ev.locations(e).select("event_id", "node_func", F.col("node_block").cast("long").alias("node_block"), F.col("node_stmt").cast("long").alias("node_stmt"))


def owned_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Node 0 as the allocation, purchases of dear things as frees, projections as dereferences."""
    n = forest_nodes(spark, sf)
    kind = F.when(F.col("node_id") == 0, "Alloc").when((F.col("kind") == "StoreAddr") & (F.col("offset") > 100), "Free").when(F.col("kind") == "Project", "Deref").otherwise("Copy")
    out = ev.owned_paths(n.withColumn("kind", kind))
    return out.select("graph_id", "allocation", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def chains(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups as allocations of a user's one pointer, purchases as frees: the events of each, to its end."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "Alloc").when(F.col("event_type") == "purchase", "Free").otherwise("Load")
    e = e.select((F.col("user_id") % 16).alias("run_id"), F.row_number().over(order).cast("long").alias("seq"), kind.alias("kind"), F.col("user_id").alias("ptr"))
    return ev.chains(e).select("run_id", "ptr", "alloc_seq", F.col("place").cast("long").alias("place"), "seq", "kind")


def asof_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """As ``asof_object``, an interval's end left out."""
    return _asof(spark, sf, False)


def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return forest.counts(forest_nodes(spark, sf))


def _histories(spark: SparkSession, sf: str) -> DataFrame:
    """A graph a user and day, a node an event in order of time."""
    order = Window.partitionBy("graph_id").orderBy("ts", "event_id")
    e = _t(spark, sf, "events").withColumn("graph_id", F.concat_ws("/", "user_id", F.to_date("ts"))).withColumn("n", F.row_number().over(order))
    return e.select("graph_id", F.col("n").alias("node_id"), F.lit(None).cast("long").alias("source"), F.col("event_type").alias("kind"))


def repeated_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Days of a user whose three first events are alike: graphs that repeat, and how often."""
    n = _histories(spark, sf).filter("node_id <= 3")
    return forest.repeated_graphs(n).select("n", F.array_join("graph_ids", ",").alias("graph_ids"))


def repeated_whole_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Days of a user whose events are all alike: graphs that repeat, and how often."""
    return forest.repeated_graphs(_histories(spark, sf)).select("n", F.array_join("graph_ids", ",").alias("graph_ids"))


def asof_object(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups begin an interval of as many hours as their value; other events look for theirs."""
    return _asof(spark, sf, True)


def _asof(spark: SparkSession, sf: str, inclusive: bool) -> DataFrame:
    s = (F.unix_timestamp("ts") - F.lit(1_704_067_200)).cast("long")
    e = _t(spark, sf, "events").withColumn("at", s)
    starts = e.filter("event_type = 'signup'").select("user_id", F.col("at").alias("start"), (F.floor("value") * 3600).cast("long").alias("size"), F.col("event_id").alias("object"))
    return ev.asof(e.filter("event_type <> 'signup'").select("user_id", "at", "event_id"), starts, "user_id", inclusive).select("event_id", "object")


def leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups as allocations, purchases as frees of a user's one pointer."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "signup", "Alloc").when(F.col("event_type") == "purchase", "Free").otherwise("Load")
    e = _t(spark, sf, "events").select((F.col("user_id") % 16).alias("run_id"), F.row_number().over(order).cast("long").alias("seq"), kind.alias("kind"), F.col("user_id").alias("ptr"))
    return ev.lifetimes(e)


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log for each user: events as pointer events over small addresses, so that intervals meet, end and begin anew."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    none = F.lit(None).cast("long")
    third = F.col("event_id") % 3
    kind = (
        F.when(F.col("event_type") == "signup", F.when(third == 0, "BeginFuncBody").when(third == 1, "AddrOfLocal").otherwise("Alloc"))
        .when(F.col("event_type") == "view", F.when(third == 0, "CopyPtr").otherwise("Offset"))
        .when(F.col("event_type") == "click", "LoadAddr")
        .when(F.col("event_type") == "purchase", F.when(third == 0, "Free").otherwise("StoreAddr"))
        .otherwise(F.when(third == 0, "AddrOfSized").otherwise("Project"))
    )
    at = (F.floor("value").cast("long") * 5) % 97
    path = lambda n: F.when(F.col("event_id") % n == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return _t(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.row_number().over(order).cast("long").alias("seq"), kind.alias("kind"), at.alias("ptr"),
        F.when(kind.isin("Offset", "Project"), at + F.col("event_id") % 11).alias("new_ptr"), F.when(kind.isin("Alloc", "AddrOfSized", "AddrOfLocal"), F.col("event_id") % 13).otherwise(none).alias("size"),
        (F.col("event_id") % 11).alias("offset"), F.when(F.col("event_id") % 2 == 0, "f").otherwise("g").alias("func"), (F.col("event_id") % 5).alias("local"),
        F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 3).alias("source_local"), F.when(F.col("event_id") % 5 > 0, (F.col("event_id") + 1) % 3).alias("dest_local"),
        path(7).alias("source_path"), path(11).alias("dest_path"),
    )


def provenance_fold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.provenance(event_log(spark, sf)).select("run_id", "seq", "graph_id", "node_id", "source", "kind")


def node_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return ev.node_kinds(event_log(spark, sf)).groupBy("kind", "node_kind").agg(F.count("*").alias("n"))


def hooked(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as hook calls of every kind."""
    names = ("malloc", "calloc", "realloc", "reallocarray", "free", "offset", *EVENT_HOOKS)
    hooks = F.element_at(F.array(*map(F.lit, names)), (F.col("l_suppkey") % len(names) + 1).cast("int"))
    calls = _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("seq"), hooks.alias("hook"), F.col("l_quantity").cast("long").alias("size"), F.col("l_linenumber").cast("long").alias("count"),
        (F.col("l_partkey") % 3).alias("ptr"), F.col("l_partkey").alias("result"),
    )
    out = hook_events(calls)
    return out.groupBy("kind", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("ptr").alias("ptrs"), F.sum("new_ptr").alias("new_ptrs")).withColumn("part", F.col("part").cast("long"))


def pointers(spark: SparkSession, sf: str) -> DataFrame:
    """(id, perms, forbidden): orders as pointers, bits from their keys."""
    o = _t(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.pmod(F.col("o_orderkey") * 37 + F.col("o_custkey"), F.lit(1024)).cast("int").alias("perms"), F.lit(0).alias("forbidden"))


def subsets(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, except_mask): from each order to its customer's next one of the year."""
    order = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    nxt = _t(spark, sf, "orders").withColumn("b", F.lead("o_orderkey").over(order)).filter("b IS NOT NULL")
    return nxt.select(F.col("o_orderkey").alias("a"), "b", F.when(F.col("o_orderpriority") == "5-LOW", lattice.READ).otherwise(0).alias("except_mask"))


SUBSETS = """WITH RECURSIVE p AS (SELECT o_orderkey AS id, ((o_orderkey * 37 + o_custkey) % 1024)::INT AS perms, o_orderpriority AS pr, o_orderstatus AS st FROM orders),
 sub AS (SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL),
 rc AS (SELECT id AS a, id AS b FROM p UNION ALL SELECT rc.a, sub.b FROM rc JOIN sub ON rc.b = sub.a),
 cc AS (SELECT o_orderkey AS id, min(o_orderkey) OVER w AS rep, o_orderpriority AS pr, o_orderstatus AS st FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate)))"""


def perm_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.propagate(pointers(spark, sf), subsets(spark, sf).withColumn("except_mask", F.lit(0))).withColumn("perms", F.col("perms").cast("long"))


def perm_masked(spark: SparkSession, sf: str) -> DataFrame:
    """With masks, given and forbidden bits: orders of status P keep their WRITE bit, urgent ones are given READ and lose LINEAR."""
    o = _t(spark, sf, "orders")
    forbidden = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", lattice.WRITE).otherwise(0).alias("forbidden"))
    urgent = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    given = urgent.select("id", F.lit("all_perms").alias("kind"), F.lit(lattice.READ).alias("mask")).union(urgent.select("id", F.lit("no_perms"), F.lit(lattice.LINEAR)))
    out = lattice.propagate(pointers(spark, sf).drop("forbidden").join(forbidden, "id"), subsets(spark, sf), given)
    return out.withColumn("perms", F.col("perms").cast("long"))


def cell_flags(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.cells(pointers(spark, sf), subsets(spark, sf))


def pointee_types(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities as types that flow to later orders; those of orders with one type, not the lowest, are shown."""
    o = _t(spark, sf, "orders")
    types = lattice.pointees(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type")), subsets(spark, sf).select(F.col("a").alias("p"), F.col("b").alias("q")))
    return lattice.sole_types(types.withColumn("concrete", F.col("type") != "5-LOW"))


def type_classes(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"))
    return lattice.unified(o, subsets(spark, sf)).select("id", "rep", "type", "conflict")


def class_numbers(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_global"))
    return lattice.renumbered(o, subsets(spark, sf))


def ownership_bounds(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    low = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0).cast("long")
    caps = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 250000, 2).otherwise(1).cast("long").alias("cap"))
    return lattice.bounds(o.select(F.col("o_orderkey").alias("id"), low.alias("low")), subsets(spark, sf).select("a", "b"), caps)


def _days(e: DataFrame, ahead: int) -> DataFrame:
    """(func, src, dst): from each day of a user's events to the next ones, up to ``ahead`` of them."""
    days = e.select("func", "block").distinct()
    order = Window.partitionBy("func").orderBy("block")
    each = days.withColumn("next", F.array(*(F.lead("block", k).over(order) for k in range(1, ahead + 1)))).withColumn("dst", F.explode("next"))
    return each.filter("dst IS NOT NULL").select("func", F.col("block").alias("src"), "dst")


def recent_writes(spark: SparkSession, sf: str) -> DataFrame:
    """A user's purchases as writes to two places, days as blocks that lead to the next two days; cheap ones are partial."""
    e = _t(spark, sf, "events").select(
        F.col("user_id").alias("func"), F.to_date("ts").alias("block"), (F.col("event_id") % 2).alias("place"), F.col("event_id").alias("stmt"), (F.col("event_type") == "purchase").alias("writes"), (F.col("value") < 5).alias("partial")
    )
    return lattice.recent_writes(e, lattice.block_entry_writes(e, _days(e, 2))).select("stmt", "write")


def last_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as uses and sign-ups as definitions of a user's one local, days as blocks that lead to the next day."""
    e = _t(spark, sf, "events").select(F.col("user_id").alias("func"), F.to_date("ts").alias("block"), "event_id", "event_type")
    name = lambda c: F.concat_ws("/", "func", c)
    kind = F.when(F.col("event_type") == "click", "use").otherwise("def")
    u = e.filter("event_type IN ('click', 'signup')").select(name("block").alias("block"), F.col("func").alias("local"), F.col("event_id").alias("stmt"), kind.alias("kind"))
    blocks = u.groupBy("block", "local").agg((F.min_by("kind", "stmt") == "use").alias("uses_first"), F.bool_or(F.col("kind") == "def").alias("defines"))
    edges = _days(e, 1).select(name("src").alias("src"), name("dst").alias("dst"))
    return lattice.last_uses(u, lattice.live_out(lattice.live_in(blocks, edges), edges)).select("stmt", "local")


def live_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as blocks of one flow a year; urgent ones use their customer, finished ones define it."""
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("block"), F.col("o_custkey").alias("local"), (F.col("o_orderpriority") == "1-URGENT").alias("uses_first"), (F.col("o_orderstatus") == "F").alias("defines"))
    return lattice.live_in(o, subsets(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst")))


QUERIES = {
    "needs_write": needs_write, "last_descendants": last_descendants, "flow_exact": flow_exact, "unique_nodes": unique_nodes, "graph_permissions": graph_permissions,
    "graph_counts": graph_counts, "repeated_histories": repeated_histories, "repeated_whole_histories": repeated_whole_histories, "asof_object": asof_object, "leaks": leaks, "provenance_fold": provenance_fold,
    "node_kinds": node_kinds, "hook_events": hooked, "perm_fixpoint": perm_fixpoint, "perm_masked": perm_masked, "cell_flags": cell_flags,
    "pointee_types": pointee_types, "type_classes": type_classes, "class_numbers": class_numbers, "ownership_bounds": ownership_bounds,
    "recent_writes": recent_writes, "last_uses": last_uses, "live_orders": live_orders, "collapsed_children": collapsed_children,
    "needs_write_chains": needs_write_chains, "distinct_graphs": distinct_graphs, "broken_graphs": broken_graphs,
    "without_local_dest": without_local_dest, "argument_locations": argument_locations, "owned_paths": owned_paths, "chains": chains,
    "asof_exclusive": asof_exclusive,
}

_L = lattice

ORACLE = {
    "needs_write": FOREST + " SELECT DISTINCT up.g AS graph_id, up.a AS node_id FROM up JOIN nd ON nd.g = up.g AND nd.n = up.n WHERE nd.kind = 'StoreAddr'",
    "last_descendants": FOREST + " SELECT g AS graph_id, n AS node_id, d AS last_desc FROM last",
    "flow_exact": _flow_sql() + " SELECT g AS graph_id, n AS node_id, load, store, pos_offset, neg_offset FROM v4",
    "unique_nodes": FOREST + ' SELECT g AS graph_id, n AS node_id, u AS "unique" FROM uq',
    "graph_permissions": _flow_sql() + f""" SELECT func, dest AS local, bit_or((CASE WHEN load IS NOT NULL THEN {_L.READ} ELSE 0 END) + (CASE WHEN store IS NOT NULL THEN {_L.WRITE} ELSE 0 END)
      + (CASE WHEN pos_offset IS NOT NULL THEN {_L.OFFSET_ADD} ELSE 0 END) + (CASE WHEN neg_offset IS NOT NULL THEN {_L.OFFSET_SUB} ELSE 0 END))::BIGINT AS set_bits,
      bit_or(CASE WHEN uq.u THEN 0 ELSE {_L.UNIQUE} END)::BIGINT AS drop_bits FROM nd JOIN v4 USING (g, n) JOIN uq USING (g, n) GROUP BY 1, 2""",
    "graph_counts": "SELECT count(DISTINCT user_id) AS graphs, count(*) AS nodes FROM events",
    "repeated_histories": """WITH e AS (SELECT user_id || '/' || ts::DATE AS g, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events),
      s AS (SELECT g, string_agg(event_type, ',' ORDER BY n) AS shape FROM e WHERE n <= 3 GROUP BY 1)
      SELECT count(*) AS n, array_to_string(list_sort(list(g))[1:5], ',') AS graph_ids FROM s GROUP BY shape HAVING count(*) > 1""",
    "repeated_whole_histories": """WITH s AS (SELECT user_id || '/' || ts::DATE AS g, string_agg(event_type, ',' ORDER BY ts, event_id) AS shape FROM events GROUP BY 1)
      SELECT count(*) AS n, array_to_string(list_sort(list(g))[1:5], ',') AS graph_ids FROM s GROUP BY shape HAVING count(*) > 1""",
    "asof_object": """WITH e AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), i AS (SELECT user_id, s, floor(value)::BIGINT * 3600 AS size, event_id AS object FROM e WHERE event_type = 'signup')
      SELECT e.event_id, CASE WHEN e.s <= f.s + f.size THEN f.object END AS object FROM e LEFT JOIN LATERAL (
        SELECT * FROM i WHERE i.user_id = e.user_id AND i.s <= e.s ORDER BY i.s DESC, i.object DESC LIMIT 1) f ON true WHERE event_type <> 'signup'""",
    "leaks": """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
      n AS (SELECT *, lead(event_type) OVER w AS t, lead(seq) OVER w AS s2 FROM e WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY seq))
      SELECT user_id % 16 AS run_id, user_id AS ptr, seq AS alloc_seq, CASE WHEN t = 'purchase' THEN s2 END AS end_seq, coalesce(t <> 'purchase', true) AS leaked FROM n WHERE event_type = 'signup'""",
    "node_kinds": """WITH e AS (SELECT user_id AS r, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type
        WHEN 'signup' THEN ['BeginFuncBody', 'AddrOfLocal', 'Alloc'][event_id % 3 + 1] WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'CopyPtr' ELSE 'Offset' END WHEN 'click' THEN 'LoadAddr'
        WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'Free' ELSE 'StoreAddr' END ELSE CASE WHEN event_id % 3 = 0 THEN 'AddrOfSized' ELSE 'Project' END END AS kind FROM events),
      s AS (SELECT *, count(*) FILTER (kind = 'BeginFuncBody') OVER (PARTITION BY r ORDER BY seq) AS era FROM e),
      n AS (SELECT *, kind = 'AddrOfLocal' AND row_number() OVER (PARTITION BY r, era, i % 2, i % 5, kind ORDER BY seq) > 1 AS again FROM s)
      SELECT kind, CASE WHEN again OR kind = 'CopyPtr' THEN 'Copy' WHEN kind <> 'BeginFuncBody' THEN kind END AS node_kind, count(*) AS n FROM n GROUP BY 1, 2""",
    "hook_events": """WITH c AS (SELECT l_suppkey % 19 AS h, l_quantity::BIGINT AS size, l_linenumber::BIGINT AS cnt, l_partkey % 3 AS ptr, l_partkey AS result FROM lineitem),
      k AS (SELECT unnest(['Project', 'CopyPtr', 'FromInt', 'ToInt', 'AddrOfLocal', 'AddrOfSized', 'LoadValue', 'StoreValue', 'Ret', 'LoadAddr', 'StoreAddr', 'StoreAddrTaken', 'BeginFuncBody']) AS kind, unnest(range(6, 19)) AS h),
      e AS (SELECT 0 AS part, 'Alloc' AS kind, result AS ptr, NULL AS new_ptr, CASE h WHEN 1 THEN cnt * size ELSE size END AS size FROM c WHERE h IN (0, 1)
        UNION ALL SELECT 0, 'Free', ptr, NULL, NULL FROM c WHERE h IN (2, 3, 4) UNION ALL SELECT 1, 'Alloc', result, NULL, CASE h WHEN 3 THEN cnt * size ELSE size END FROM c WHERE h IN (2, 3)
        UNION ALL SELECT 0, CASE WHEN ptr = 0 THEN 'CopyPtr' ELSE 'Offset' END, CASE WHEN ptr = 0 THEN size ELSE ptr END, CASE WHEN ptr <> 0 THEN result END, NULL FROM c WHERE h = 5
        UNION ALL SELECT 0, kind, CASE WHEN kind <> 'BeginFuncBody' THEN ptr END, CASE WHEN kind = 'Project' THEN result END, CASE WHEN kind LIKE 'AddrOf%' THEN size END FROM c JOIN k USING (h))
      SELECT kind, part::BIGINT AS part, count(*) AS n, sum(size)::BIGINT AS bytes, sum(ptr)::BIGINT AS ptrs, sum(new_ptr)::BIGINT AS new_ptrs FROM e GROUP BY 1, 2""",
    "perm_fixpoint": SUBSETS + f""", u AS (SELECT rc.b AS id, bit_or(q.perms) & {_L.UP} AS up FROM rc JOIN p q ON q.id = rc.a GROUP BY 1),
      d AS (SELECT rc.a AS id, bit_and(q.perms) & {_L.DOWN} AS down FROM rc JOIN p q ON q.id = rc.b GROUP BY 1),
      o AS (SELECT cc.id, bit_or(q.perms & {_L.OFFSETS}) OVER (PARTITION BY cc.rep) AS off FROM cc JOIN p q ON q.id = cc.id)
      SELECT id, (up | down | (p.perms & {_L.LINEAR}) | CASE WHEN up & {_L.FREE} <> 0 THEN off ELSE 0 END)::BIGINT AS perms FROM p JOIN u USING (id) JOIN d USING (id) JOIN o USING (id)""",
    "cell_flags": SUBSETS + f""", k AS (SELECT id, perms & {_L.WRITE} <> 0 AS w, perms & {_L.UNIQUE} <> 0 AS u FROM p),
      r AS (SELECT id FROM k WHERE w AND NOT u
        UNION SELECT e.b FROM r JOIN (SELECT b AS a, a AS b FROM sub UNION ALL SELECT sub.a, sub.b FROM sub JOIN k ON k.id = sub.b AND NOT (k.w AND k.u)) e ON e.a = r.id) SELECT id FROM r""",
    "pointee_types": SUBSETS + " SELECT rc.b AS id, min(p.pr) AS type FROM rc JOIN p ON p.id = rc.a GROUP BY 1 HAVING min(p.pr) = max(p.pr) AND min(p.pr) <> '5-LOW'",
    "type_classes": SUBSETS + " SELECT id, rep, min(pr) OVER (PARTITION BY rep) AS type, min(pr) OVER (PARTITION BY rep) <> max(pr) OVER (PARTITION BY rep) AS conflict FROM cc",
    "class_numbers": SUBSETS + """ SELECT id, coalesce(min(CASE WHEN st = 'F' THEN id END) OVER (PARTITION BY rep), rep) AS rep, dense_rank() OVER (ORDER BY rep) - 1 AS number FROM cc""",
    "ownership_bounds": SUBSETS + """, v AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END::BIGINT AS low, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_totalprice > 250000 THEN 2 ELSE 1 END END::BIGINT AS cap FROM orders),
      l AS (SELECT rc.b AS id, max(low) AS low FROM rc JOIN v ON v.id = rc.a GROUP BY 1), h AS (SELECT rc.a AS id, min(cap) AS high FROM rc JOIN v ON v.id = rc.b GROUP BY 1) SELECT id, low, coalesce(high, 2) AS high FROM l JOIN h USING (id)""",
    "recent_writes": """WITH RECURSIVE s AS (SELECT user_id AS f, ts::DATE AS b, event_id % 2 AS p, event_id AS e, value < 5 AS part, event_type = 'purchase' AS w FROM events),
      g AS (SELECT f, b, p, max(e) AS e, arg_max(part, e) AS part FROM s WHERE w GROUP BY 1, 2, 3),
      d AS (SELECT f, b, lead(b, 1) OVER o AS x, lead(b, 2) OVER o AS y FROM (SELECT DISTINCT f, b FROM s) WINDOW o AS (PARTITION BY f ORDER BY b)),
      h AS (SELECT f, b, x AS t FROM d WHERE x IS NOT NULL UNION ALL SELECT f, b, y FROM d WHERE y IS NOT NULL),
      r AS (SELECT g.f, h.t AS b, p, e, part FROM g JOIN h ON h.f = g.f AND h.b = g.b
        UNION SELECT r.f, h.t, r.p, r.e, r.part FROM r JOIN h ON h.f = r.f AND h.b = r.b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.f = r.f AND g.b = r.b AND g.p = r.p)),
      n AS (SELECT f, b, p, CASE WHEN count(*) = 1 AND NOT bool_or(part) THEN min(e) END AS e FROM r GROUP BY 1, 2, 3),
      i AS (SELECT s.*, max(CASE WHEN w THEN e END) OVER (PARTITION BY f, b, p ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s)
      SELECT i.e AS stmt, CASE WHEN last IS NULL THEN n.e WHEN NOT (SELECT value < 5 FROM events v WHERE v.event_id = last) THEN last END AS write FROM i LEFT JOIN n ON n.f = i.f AND n.b = i.b AND n.p = i.p""",
    "last_uses": """WITH u AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS t FROM events WHERE event_type IN ('click', 'signup'))
      SELECT event_id AS stmt, user_id AS local FROM u WHERE event_type = 'click' AND coalesce(t, 'signup') = 'signup'""",
    "collapsed_children": FOREST + " SELECT g AS graph_id, n AS node_id, p AS parent, array_to_string(path, '.') AS path FROM kd",
    "needs_write_chains": """WITH e AS (SELECT user_id AS g, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
      SELECT g AS graph_id, n AS node_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY g) AS x FROM e) WHERE n <= x""",
    "distinct_graphs": """WITH s AS (SELECT user_id || '/' || ts::DATE AS g, string_agg(event_type, ',' ORDER BY ts, event_id) AS shape, count(*) AS n FROM events GROUP BY 1)
      SELECT min(g) AS graph_id, any_value(n) AS n FROM s GROUP BY shape""",
    "broken_graphs": FOREST + """ SELECT g AS graph_id, n AS node_id, 'source' AS problem FROM nd WHERE n > 0 AND e % 97 = 0
      UNION ALL SELECT g, NULL, 'mixed pointers' FROM nd GROUP BY g HAVING bool_or(e % 1009 = 0) AND NOT bool_and(e % 1009 = 0)""",
    "without_local_dest": FOREST + " SELECT g AS graph_id, n AS node_id, CASE WHEN kind <> 'Project' THEN dest END AS dest FROM nd",
    "argument_locations": """SELECT event_id, CASE event_type WHEN 'click' THEN 'g' || user_id % 3 ELSE 'f' || user_id % 5 END AS node_func,
      CASE event_type WHEN 'click' THEN 0 ELSE event_id % 9 END AS node_block, CASE event_type WHEN 'click' THEN 0 ELSE event_id % 4 END AS node_stmt FROM events""",
    "owned_paths": FOREST + """, f AS (SELECT g, n FROM nd WHERE kind = 'StoreAddr' AND off > 100 AND n > 0), k AS (SELECT g FROM f GROUP BY 1 HAVING count(*) = 1)
      SELECT up.g AS graph_id, 0 AS allocation, coalesce(string_agg(up.a, ',' ORDER BY up.a) FILTER (x.kind <> 'Project'), '') AS path
      FROM up JOIN f ON f.g = up.g AND f.n = up.n JOIN k ON k.g = up.g JOIN nd x ON x.g = up.g AND x.n = up.a WHERE up.a > 0 GROUP BY 1""",
    "chains": """WITH e AS (SELECT user_id AS u, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
      l AS (SELECT *, max(CASE WHEN t IN ('signup', 'purchase') THEN seq END) OVER (PARTITION BY u ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
      a AS (SELECT l.u, l.seq, CASE l.t WHEN 'signup' THEN 'Alloc' WHEN 'purchase' THEN 'Free' ELSE 'Load' END AS kind, CASE WHEN l.t = 'signup' THEN l.seq WHEN x.t = 'signup' THEN l.b END AS s FROM l LEFT JOIN e x ON x.u = l.u AND x.seq = l.b),
      z AS (SELECT u, seq, kind, s FROM a WHERE s IS NOT NULL UNION ALL SELECT u, NULL, 'Done', s FROM a WHERE s IS NOT NULL GROUP BY u, s HAVING NOT bool_or(kind = 'Free'))
      SELECT u % 16 AS run_id, u AS ptr, s AS alloc_seq, row_number() OVER (PARTITION BY u, s ORDER BY seq NULLS LAST) - 1 AS place, seq, kind FROM z""",
    "asof_exclusive": """WITH e AS (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), i AS (SELECT user_id, s, floor(value)::BIGINT * 3600 AS size, event_id AS object FROM e WHERE event_type = 'signup')
      SELECT e.event_id, CASE WHEN e.s < f.s + f.size THEN f.object END AS object FROM e LEFT JOIN LATERAL (
        SELECT * FROM i WHERE i.user_id = e.user_id AND i.s <= e.s ORDER BY i.s DESC, i.object DESC LIMIT 1) f ON true WHERE event_type <> 'signup'""",
    "live_orders": SUBSETS + """, b AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority = '1-URGENT' AS u, o_orderstatus = 'F' AS d FROM orders),
      r AS (SELECT id, c FROM b WHERE u UNION SELECT sub.a, r.c FROM r JOIN sub ON sub.b = r.id JOIN b ON b.id = sub.a WHERE NOT (b.d AND b.c = r.c)) SELECT id AS block, c AS local FROM r""",
}
