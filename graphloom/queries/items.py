"""Keyed lists, merged items, build targets, caches, counters, and files that are written to the shared folder and read back, on stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, intervals, keyed, metrics, trees
from ..plans.iterate import shared_folder
from ..sources import binary_log, files
from . import flow, sets
from .trees import NODES, nodes


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _new(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _joined(values: str) -> Column:
    return F.array_join(values, ",")


def grouped_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's first order, and all its statuses in order."""
    rows = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return keyed.grouped_first(rows, "o_custkey", "o_orderkey", "o_orderstatus").withColumn("o_orderstatus", _joined("o_orderstatus"))


def edits_out_of_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as edits of a file of some thousand bytes."""
    e = sets.edits(spark, sf)
    content = F.expr("cast(repeat('x', cast(3000 + file % 700 AS int)) AS binary)")
    return intervals.out_of_bounds(e, e.select("file").distinct().withColumn("content", content)).select("file", "ord")


def erased_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' types with some letters put as spaces."""
    p = _t(spark, sf, "part")
    return p.select("p_partkey", intervals.erased(F.col("p_type"), (F.col("p_size") % 4).cast("int"), F.lit(3)).alias("text"))


def item_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """The function of a path of crate, nation and name."""
    t = nodes(spark, sf).withColumn("path", F.when(F.col("kind") == "fn", F.array(F.lit("crate"), F.col("parent").cast("string"), "name")))
    first = _t(spark, sf, "customer").agg(F.min_by(F.struct("c_nationkey", "c_name"), "c_custkey").alias("c")).first()["c"]
    return trees.item(t, ["crate", str(first["c_nationkey"] + 100), first["c_name"]])


def measuring_times(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs: the whole time is the price, the translation's the customer's number."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("total_ms"), F.col("o_custkey").alias("translation_ms"))
    return metrics.measuring_time(o)


def converged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as runs: their orders as corpus, finished ones diverged."""
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("corpus"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("diverged"))
    return metrics.converged(o)


def event_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counters(_t(spark, sf, "events"), "user_id", "event_type")


def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as sources: their customers' segments between markers with the customers' names, the last two letters only, so that paths repeat."""
    piece = F.concat(F.lit("//@ "), F.substring("c_name", -2, 2), F.lit("\n"), "c_mktsegment", F.lit("\n"))
    texts = _t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("source")).agg(F.concat(F.lit("head\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", piece.alias("p")))), lambda x: x["p"]), "")).alias("text"))
    return keyed.split_items(texts)


def merged_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as items, those of even numbers and some unknown ones written over them, in two ways."""
    p = _t(spark, sf, "part")
    base = p.filter("p_partkey % 3 > 0").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_name").alias("text"))
    new = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_type").alias("text"))
    return keyed.merged_items(base, new).withColumn("way", F.lit("all")).union(keyed.merged_items(base, new, True).withColumn("way", F.lit("known")))


def link_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as objects but for every seventh, orders as links of their lines' parts; an order that is dear has its driver's command and its linker's."""
    objects = _t(spark, sf, "part").filter("p_partkey % 7 > 0").select(F.concat(F.lit("o"), "p_partkey").alias("output"), F.col("p_name").alias("file"))
    li = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("o"), "l_partkey"))).alias("inputs"))
    o = _t(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    link = o.select(F.concat(F.lit("t"), "o_orderkey").alias("output"), F.col("o_orderstatus").alias("kind"), "inputs", F.lit(True).alias("is_driver"))
    tool = o.filter("o_totalprice > 200000").select(F.concat(F.lit("t"), "o_orderkey").alias("output"), F.lit("ld").alias("kind"), F.array(F.lit("x")).alias("inputs"), F.lit(False).alias("is_driver"))
    return keyed.build_targets(objects, link.union(tool)).withColumn("inputs", _joined("inputs"))


def cached_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer and status were computed with those of every fifth order, of which old entries have gone."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store = o.filter("o_orderkey % 5 = 0").select(keyed.cache_key(o, ["o_custkey", "o_orderstatus"]).alias("key"), (F.col("o_orderkey") % 100).alias("created"))
    fresh = keyed.pruned_cache(store, 100, 70).groupBy("key").agg(F.max("created").alias("created"))
    hits, misses = keyed.cached(o, ["o_custkey", "o_orderstatus"], fresh)
    return hits.select("o_orderkey", "created").union(misses.select("o_orderkey", F.lit(None).cast("long")))


def cover_report(spark: SparkSession, sf: str) -> DataFrame:
    """What is printed of a set with the lines of its files: a marker a line."""
    lines = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").cast("long").alias("line")).distinct()
    return coverage.report(sets.cover(spark, sf, "A"), lines)[1]


def coverset_file(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files of a set, with a config from a list or of their own, written as one document and read again."""
    c = _t(spark, sf, "customer").filter("c_name IS NOT NULL")
    listed = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") % 3)
    rows = c.select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("file"), F.col("c_name").alias("path"), F.lit("e").alias("expanded_hash"), F.base64(F.col("c_mktsegment").cast("binary")).alias("covered"), F.lit("").alias("coverable"), F.lit("zlib").alias("compression"), listed.alias("config_index"), F.array("c_mktsegment").alias("config"))
    path = _new(spark)
    files.write_coverset(rows, [["a"], ["b", "c"], []], path)
    return files.read_coverset(spark, path).select("file", "path", "covered", "compression", _joined("config").alias("config"))


def bitmap_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines' parts as line numbers of fifty files, packed to bitmaps and unpacked."""
    lines = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("file"), F.col("l_partkey").alias("line"))
    packed = files.bitmaps_of_lines(lines, "zstd").withColumn("compression", F.lit("zstd"))
    return files.lines_of_bitmaps(packed, "bitmap")


def message_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a tool's output: some are messages of a compiler, some of others, some plain text."""
    e = _t(spark, sf, "events")
    m = F.struct(F.when(F.col("user_id") % 2 == 0, "compiler-message").otherwise("artifact").alias("reason"), F.struct(F.col("event_type").alias("level"), F.struct(F.concat(F.lit("E"), "user_id").alias("code")).alias("code"), F.col("event_id").cast("string").alias("message")).alias("message"))
    path = _new(spark)
    e.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), F.to_json(m))).otherwise(F.to_json(m)).alias("value")).write.text(path)
    return files.read_messages(spark, path)


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as JSON lines, written and read."""
    e = flow.event_log(spark, sf).select("run_id", "seq", "kind", "ptr", "new_ptr", "size")
    path = _new(spark)
    files.write_json(e, path)
    return files.read_events(spark, path, "run_id long, seq long, kind string, ptr long, new_ptr long, size long").select("run_id", "seq", "kind", "ptr", "new_ptr", "size")


def binary_log_file(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as binary files, one a run, written and read; numbers within a run count from 0."""
    e = flow.event_log(spark, sf).filter("kind IN ('CopyPtr', 'LoadAddr', 'StoreAddr', 'Free', 'BeginFuncBody') AND (ptr IS NOT NULL OR kind = 'BeginFuncBody')")
    path = _new(spark)
    binary_log.write_binary_log(e.select(F.col("run_id").cast("string").alias("run_id"), "seq", F.lit(3).alias("mir_loc"), "kind", "ptr"), path)
    return binary_log.read_binary_log(spark, path).select("run_id", "seq", "kind", F.col("ptr").cast("long").alias("ptr"))


def relation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two relations of the nations as tab-separated text, read back."""
    n = _t(spark, sf, "nation")
    path = _new(spark)
    files.write_relations({"inside": n.select("n_nationkey", "n_regionkey"), "named": n.select("n_nationkey", "n_name")}, path)
    read = lambda name, kind: spark.read.schema(kind).option("sep", "\t").csv(f"{path}/{name}")
    return read("inside", "id long, region long").join(read("named", "id long, name string"), "id")


def merged_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Projections by key from two parts of the lines that share keys."""
    li = _t(spark, sf, "lineitem").select((F.col("l_partkey") * 8 + F.col("l_partkey") % 5).alias("proj_key"), F.col("l_partkey").alias("field"))
    return files.merged_metadata([li.filter("field % 3 < 2").distinct(), li.filter("field % 3 > 0").distinct()])


def graph_files(spark: SparkSession, sf: str) -> DataFrame:
    """Provenance nodes, a folder for each of 16 runs, read back by one."""
    n = flow.event_log(spark, sf).select((F.col("run_id") % 16).alias("run_id"), "seq", "kind")
    path = _new(spark)
    files.write_graph(n, path)
    return spark.read.parquet(path).filter("run_id = 3").select("seq", "kind").groupBy("kind").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


QUERIES = {
    "grouped_orders": grouped_orders, "edits_out_of_bounds": edits_out_of_bounds, "erased_spans": erased_spans, "item_by_path": item_by_path, "measuring_times": measuring_times,
    "converged_runs": converged_runs, "event_counters": event_counters, "split_texts": split_texts, "merged_paths": merged_paths, "link_targets": link_targets, "cached_orders": cached_orders,
    "cover_report": cover_report, "coverset_file": coverset_file, "bitmap_lines": bitmap_lines, "message_lines": message_lines, "event_lines": event_lines, "binary_log_file": binary_log_file,
    "relation_files": relation_files, "merged_projections": merged_projections, "graph_files": graph_files,
}

_LOG = """WITH g AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (floor(value)::BIGINT * 5) % 97 AS ptr, event_id,
    CASE event_type WHEN 'signup' THEN ['BeginFuncBody', 'AddrOfLocal', 'Alloc'][event_id % 3 + 1] WHEN 'view' THEN ['CopyPtr', 'Offset', 'Offset'][event_id % 3 + 1] WHEN 'click' THEN 'LoadAddr'
      WHEN 'purchase' THEN ['Free', 'StoreAddr', 'StoreAddr'][event_id % 3 + 1] ELSE ['AddrOfSized', 'Project', 'Project'][event_id % 3 + 1] END AS kind FROM events)"""

ORACLE = {
    "event_lines": _LOG + """ SELECT run_id, seq, kind, ptr, CASE WHEN kind IN ('Offset', 'Project') THEN ptr + event_id % 11 END AS new_ptr, CASE WHEN kind IN ('Alloc', 'AddrOfSized', 'AddrOfLocal') THEN event_id % 13 END AS size FROM g""",
    "binary_log_file": _LOG + """ SELECT run_id::VARCHAR AS run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS seq, kind, CASE WHEN kind <> 'BeginFuncBody' THEN ptr END AS ptr
      FROM g WHERE kind IN ('CopyPtr', 'LoadAddr', 'StoreAddr', 'Free', 'BeginFuncBody') AND (ptr IS NOT NULL OR kind = 'BeginFuncBody')""",
    "graph_files": _LOG + " SELECT kind, count(*) AS n, sum(seq)::BIGINT AS seqs FROM g WHERE run_id % 16 = 3 GROUP BY 1",
    "grouped_orders": "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "edits_out_of_bounds": "WITH " + sets._EDITS + " SELECT file, ord FROM edits WHERE off + len > 3000 + file % 700",
    "erased_spans": "SELECT p_partkey, left(p_type, (p_size % 4)::INT) || '   ' || substr(p_type, (p_size % 4 + 4)::INT) AS text FROM part",
    "item_by_path": NODES + " SELECT id FROM nodes WHERE kind = 'fn' AND (parent, name) = (SELECT (100 + c_nationkey, c_name) FROM customer ORDER BY c_custkey LIMIT 1)",
    "measuring_times": "SELECT o_orderkey, floor(o_totalprice)::BIGINT AS total_ms, o_custkey AS translation_ms, floor(o_totalprice)::BIGINT - o_custkey AS measurement_ms FROM orders",
    "converged_runs": "SELECT o_custkey, count(*) AS corpus, count(*) FILTER (o_orderstatus = 'F') AS diverged, count(*) FILTER (o_orderstatus <> 'F') AS converged FROM orders GROUP BY 1",
    "event_counters": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "split_texts": "SELECT c_nationkey AS source, right(c_name, 2) AS path, arg_max(c_mktsegment, c_custkey) || chr(10) AS text FROM customer GROUP BY 1, 2 UNION ALL SELECT DISTINCT c_nationkey, '', 'head' || chr(10) FROM customer",
    "merged_paths": """SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS text, 'all' AS way FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 2 = 0
      UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END, 'known' FROM part WHERE p_partkey % 3 > 0""",
    "link_targets": """SELECT 't' || l_orderkey AS target, o_orderstatus AS kind, string_agg(CASE WHEN p_partkey % 7 > 0 THEN p_name ELSE 'o' || l_partkey END, ',' ORDER BY 'o' || l_partkey) AS inputs
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, o_orderstatus""",
    "cached_orders": "SELECT o_orderkey, (SELECT max(x.o_orderkey % 100) FROM orders x WHERE x.o_orderkey % 5 = 0 AND x.o_orderkey % 100 >= 30 AND x.o_custkey = o.o_custkey AND x.o_orderstatus = o.o_orderstatus) AS created FROM orders o",
    "cover_report": sets.ORACLE["cover_markers"],
    "coverset_file": """SELECT sha256(c_custkey::VARCHAR) AS file, c_name AS path, to_base64(encode(c_mktsegment)) AS covered, 'zlib' AS compression,
      CASE WHEN c_nationkey % 2 = 0 THEN ['a', 'b,c', ''][c_nationkey % 3 + 1] ELSE c_mktsegment END AS config FROM customer""",
    "bitmap_lines": "SELECT DISTINCT (l_orderkey % 50)::VARCHAR AS file, l_partkey AS line FROM lineitem",
    "message_lines": "SELECT event_type AS level, 'E' || user_id AS code, event_id::VARCHAR AS message FROM events WHERE user_id % 2 = 0 AND event_id % 3 > 0",
    "relation_files": "SELECT n_nationkey AS id, n_regionkey AS region, n_name AS name FROM nation",
    "merged_projections": "SELECT DISTINCT l_partkey * 8 + l_partkey % 5 AS proj_key, l_partkey AS field FROM lineitem",
}
