"""Queries on provenance forests: nodes (graph_id, node_id, source, kind, field, offset), source < node_id, roots without source.

Ancestry goes by doubling: each node meets its ancestor 1, 2, 4, ... steps above, so
rounds grow as the logarithm of the depth and no pairs of nodes are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import below, cut, over_subtrees

KEY = ["graph_id", "node_id"]
#: What a node counts as, for the four flows.
LOADS = ("LoadAddr", "LoadValue")
STORES = ("StoreAddr", "StoreValue")


def _parents(nodes: DataFrame) -> DataFrame:
    """(graph_id, id, up): each node with its source."""
    return nodes.filter("source IS NOT NULL").select("graph_id", F.col("node_id").alias("id"), F.col("source").alias("up"))


def flows(kind: Column, offset: Column) -> dict[str, Column]:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {
        "load": yes(kind == "LoadAddr"),
        "store": yes(kind == "StoreAddr"),
        "pos_offset": yes((kind == "Offset") & (offset > 0)),
        "neg_offset": yes((kind == "Offset") & (offset < 0)),
    }


def ancestors_of(nodes: DataFrame, want: Column, itself: bool = True) -> DataFrame:
    """(graph_id, node_id) of the matching nodes' ancestors, distinct; with the nodes themselves or without."""
    start = nodes.filter(want)
    seed = start.select("graph_id", F.col("node_id").alias("id")) if itself else start.filter("source IS NOT NULL").select("graph_id", F.col("source").alias("id"))
    return over_subtrees(_parents(nodes), seed.distinct(), ["graph_id"], {}).select("graph_id", F.col("id").alias("node_id"))


def needs_write(nodes: DataFrame) -> DataFrame:
    """Nodes that an address is stored through, and all their ancestors."""
    return ancestors_of(nodes, F.coalesce(F.col("kind") == "StoreAddr", F.lit(False)))


def last_descendants(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, last_desc): the largest id in each node's subtree, itself included."""
    seed = nodes.select("graph_id", F.col("node_id").alias("id"), F.col("node_id").alias("last_desc"))
    return over_subtrees(_parents(nodes), seed, ["graph_id"], {"last_desc": F.max}).withColumnRenamed("id", "node_id").select(*KEY, "last_desc")


def flow_nodes(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, load, store, pos_offset, neg_offset): for each flow a node of the subtree, null if none.

    A node that has the flow itself takes its own id; else it takes the value of
    its direct child of the highest id whose subtree has one. This is neither
    the largest nor any such id. Which subtrees have a flow is found first; then
    each node points to itself or to that child, and pointers are followed by doubling.
    """
    each = nodes.select(*KEY, "source", F.explode(F.array(*(F.struct(F.lit(n).alias("flow"), c.alias("own")) for n, c in flows(F.col("kind"), F.col("offset")).items()))).alias("x"))
    own = cut(each.filter("x.own").select("graph_id", "x.flow", F.col("node_id").alias("id")))
    # one forest for each flow that a graph has, so that all go in one run
    parents = _parents(nodes).join(own.select("graph_id", "flow").distinct(), "graph_id").select("graph_id", "flow", "id", "up")
    parents = cut(parents)
    has = over_subtrees(parents, own, ["graph_id", "flow"], {})
    best = has.join(parents, ["graph_id", "flow", "id"]).groupBy("graph_id", "flow", F.col("up").alias("id")).agg(F.max("id").alias("to"))
    at = cut(best.join(own, ["graph_id", "flow", "id"], "left_anti").select("graph_id", "flow", "id", "to"))
    ends = cut(own.select("graph_id", "flow", "id", F.col("id").alias("value")))
    while not at.isEmpty():
        onward = ends.select("graph_id", "flow", F.col("id").alias("to"), "value")
        ends = cut(ends.union(at.join(onward, ["graph_id", "flow", "to"]).select("graph_id", "flow", "id", "value")))
        further = at.select("graph_id", "flow", F.col("id").alias("to"), F.col("to").alias("then"))
        at = cut(at.join(further, ["graph_id", "flow", "to"]).select("graph_id", "flow", "id", F.col("then").alias("to")))
    found = ends.groupBy("graph_id", F.col("id").alias("node_id")).pivot("flow", ["load", "store", "pos_offset", "neg_offset"]).agg(F.max("value"))
    return nodes.select(*KEY).join(found, KEY, "left")


def collapsed_children(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, parent, path) of the nodes that are no projections, under their nearest such ancestor.

    path is the fields of the projections passed, from the parent down. A root is
    no projection here, whatever its kind. Runs of projections are put together
    by doubling.
    """
    proj = nodes.filter("kind = 'Project' AND source IS NOT NULL").select("graph_id", F.col("node_id").alias("p"), F.col("source").alias("up"), "field")
    name = lambda d, s: d.select("graph_id", F.col("p").alias("up"), F.col("up").alias(f"{s}_up"), F.col("field").alias(f"{s}_field"))
    proj = cut(proj)
    open_ = proj.join(name(proj, "o"), ["graph_id", "up"], "left_semi")
    while not open_.isEmpty():
        proj = cut(proj.join(name(proj, "o"), ["graph_id", "up"], "left").select("graph_id", "p", F.when(F.col("o_field").isNotNull(), F.col("o_up")).otherwise(F.col("up")).alias("up"), F.concat(F.coalesce("o_field", F.array().cast("array<int>")), "field").alias("field")))
        open_ = proj.join(name(proj, "o"), ["graph_id", "up"], "left_semi")
    rest = nodes.filter("kind <> 'Project' OR source IS NULL").select(*KEY, F.col("source").alias("up"))
    out = rest.join(name(proj, "o"), ["graph_id", "up"], "left")
    hit = F.col("o_field").isNotNull()
    return out.select(*KEY, F.when(hit, F.col("o_up")).otherwise(F.col("up")).alias("parent"), F.when(hit, F.col("o_field")).otherwise(F.array().cast("array<int>")).alias("path"))


def aliases(a: Column, b: Column) -> Column:
    """One path begins with the other."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, unique): neither the node nor an ancestor has children that clash.

    A child clashes with an earlier aliasing one that is used after the child
    begins. Siblings of one path need no pairs: a running maximum of the earlier ones'
    last descendants decides. Only distinct paths of one parent are paired.
    """
    kids = cut(collapsed_children(nodes).filter("parent IS NOT NULL").join(last_descendants(nodes), KEY))
    paths = kids.groupBy("graph_id", "parent", "path").agg(F.lit(1).alias("one"))
    pairs = paths.alias("x").join(paths.alias("y"), ["graph_id", "parent"]).filter(aliases(F.col("x.path"), F.col("y.path"))).select("graph_id", "parent", F.col("x.path").alias("path"), F.col("y.path").alias("other"))
    seen = kids.withColumnsRenamed({"path": "other"}).join(pairs, ["graph_id", "parent", "other"])
    before = Window.partitionBy("graph_id", "parent", "path").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    busy = seen.withColumn("busy", F.max("last_desc").over(before)).filter("other = path AND busy > node_id").select("graph_id", F.col("parent").alias("node_id"))
    bad = below(_parents(nodes), busy.withColumnRenamed("node_id", "id"), ["graph_id"]).select("graph_id", F.col("id").alias("node_id"), F.lit(True).alias("bad"))
    return nodes.select(*KEY).join(bad, KEY, "left").select(*KEY, F.col("bad").isNull().alias("unique"))


def without_repeats(nodes: DataFrame) -> DataFrame:
    """Distinct graphs, the first of equal ones."""
    rows = [c for c in nodes.columns if c != "graph_id"]
    shape = nodes.groupBy("graph_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node_id", *[c for c in rows if c != "node_id"])))), 256).alias("shape"))
    first = shape.groupBy("shape").agg(F.min("graph_id").alias("graph_id"))
    return nodes.join(first.select("graph_id"), "graph_id", "left_semi")


def repeated_graphs(nodes: DataFrame, show: int = 5) -> DataFrame:
    """(shape, n, graph_ids): graphs that occur more than once, and up to ``show`` of their ids, the smallest.

    Each task passes on its ``show`` smallest ids of a shape, never all of them.
    """
    rows = [c for c in nodes.columns if c not in ("graph_id", "node_id")]
    shape = cut(nodes.groupBy("graph_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node_id", *rows)))), 256).alias("shape")))
    n = shape.groupBy("shape").agg(F.count("*").alias("n")).filter("n > 1")
    order = Window.partitionBy("shape").orderBy(F.asc_nulls_last("graph_id"))
    low = shape.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= show)
    return n.join(low.groupBy("shape").agg(F.array_sort(F.collect_list("graph_id")).alias("graph_ids")), "shape").select("shape", "n", "graph_ids")


def counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_distinct("graph_id").alias("graphs"), F.count("*").alias("nodes"))


def broken(nodes: DataFrame) -> DataFrame:
    """Rows that break the model: a root with a source, a source that is not earlier, null and other pointers in one graph."""
    mixed = nodes.groupBy("graph_id").agg((F.count_distinct("is_null") > 1).alias("mixed")) if "is_null" in nodes.columns else None
    bad = nodes.filter("(node_id = 0 AND source IS NOT NULL) OR (node_id > 0 AND (source IS NULL OR source >= node_id))").select(*KEY, F.lit("source").alias("problem"))
    if mixed is None:
        return bad
    return bad.union(mixed.filter("mixed").select("graph_id", F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"), F.lit("mixed pointers").alias("problem")))


def without_local_dest(nodes: DataFrame) -> DataFrame:
    """The destination of address-of-local nodes goes; done last, as other queries read it."""
    return nodes.withColumn("dest", F.when(F.coalesce(F.col("kind") != "AddrOfLocal", F.lit(True)), F.col("dest")))


def permissions(nodes: DataFrame, flow: DataFrame, unique: DataFrame) -> DataFrame:
    """(func, local, set_bits, drop_bits): what the flows of a place's nodes say about its permissions."""
    from .lattice import NON_NULL, OFFSET_ADD, OFFSET_SUB, READ, UNIQUE, WRITE

    bit = lambda c, b: F.when(c, b).otherwise(0)
    gain = bit(F.col("load").isNotNull(), READ) + bit(F.col("store").isNotNull(), WRITE) + bit(F.col("pos_offset").isNotNull(), OFFSET_ADD) + bit(F.col("neg_offset").isNotNull(), OFFSET_SUB)
    drop = bit(~F.col("unique"), UNIQUE) + bit(F.coalesce("is_null", F.lit(False)), NON_NULL)
    rows = nodes.join(flow, KEY).join(unique, KEY).filter("dest IS NOT NULL")
    return rows.groupBy("func", F.col("dest").alias("local")).agg(F.bit_or(gain).alias("set_bits"), F.bit_or(drop).alias("drop_bits"))
