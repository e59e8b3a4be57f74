"""Tree and graph queries on stand-ins: region, nation, customer and order as a tree; orders, parts and nations as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs, trees
from ..plans.iterate import components


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """id, parent, kind, name, pub, tag: the crate, regions and nations as modules, customers as functions, orders as statements."""
    none = lambda t: F.lit(None).cast(t)
    row = lambda i, p, kind, name, pub, tag: [i.cast("long").alias("id"), p.cast("long").alias("parent"), F.lit(kind).alias("kind"), name.alias("name"), pub.alias("pub"), tag.alias("tag")]
    c = F.col
    one = spark.range(1).select(*row(c("id"), none("long"), "crate", none("string"), none("boolean"), none("string")))
    r = _t(spark, sf, "region").select(*row(c("r_regionkey") + 1, F.lit(0), "mod", c("r_name"), F.lit(True), none("string")))
    n = _t(spark, sf, "nation").select(*row(c("n_nationkey") + 100, c("n_regionkey") + 1, "mod", c("n_name"), c("n_nationkey") >= 10, none("string")))
    u = _t(spark, sf, "customer").select(*row(c("c_custkey") + 1000, c("c_nationkey") + 100, "fn", c("c_name"), c("c_acctbal") > 0, c("c_mktsegment")))
    o = _t(spark, sf, "orders").select(*row(c("o_orderkey") + 100_000_000, c("o_custkey") + 1000, "stmt", none("string"), none("boolean"), c("o_orderstatus")))
    return one.union(r).union(n).union(u).union(o)


NODES = """WITH RECURSIVE nodes AS (
  SELECT 0::BIGINT AS id, NULL::BIGINT AS parent, 'crate' AS kind, NULL::VARCHAR AS name, NULL::BOOLEAN AS pub, NULL::VARCHAR AS tag
  UNION ALL SELECT 1 + r_regionkey, 0, 'mod', r_name, true, NULL FROM region
  UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 'mod', n_name, n_nationkey >= 10, NULL FROM nation
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'fn', c_name, c_acctbal > 0, c_mktsegment FROM customer
  UNION ALL SELECT 100000000 + o_orderkey, 1000 + o_custkey, 'stmt', NULL, NULL, o_orderstatus FROM orders
)"""


def select_child(spark: SparkSession, sf: str) -> DataFrame:
    t = nodes(spark, sf)
    regions = trees.child(trees.root(t), t, trees.is_kind("mod"))
    return trees.child(regions, t, trees.is_kind("mod") & trees.name_is("NATION_1.*"))


def select_desc(spark: SparkSession, sf: str) -> DataFrame:
    t = nodes(spark, sf)
    some = trees.child(trees.root(t), t, trees.name_is("A.*"))
    return trees.desc(some, t, trees.is_kind("stmt") & trees.truth(F.col("tag") == "P"))


def select_any_every(spark: SparkSession, sf: str) -> DataFrame:
    t = trees.with_child_tests(nodes(spark, sf), trees.truth(F.col("tag") == "F"))
    return t.filter("kind = 'fn'").select("id", "any_child", "every_child")


def select_any_every_desc(spark: SparkSession, sf: str) -> DataFrame:
    t = trees.with_desc_tests(nodes(spark, sf), ~trees.truth((F.col("kind") == "fn") & ~F.col("pub")))
    return t.filter("kind <> 'stmt'").select("id", "any_desc", "every_desc")


def select_first_last(spark: SparkSession, sf: str) -> DataFrame:
    t = nodes(spark, sf)
    want = trees.is_kind("fn") & (trees.truth(F.col("pub")) & ~trees.truth(F.col("tag") == "BUILDING") | trees.name_is(".*7"))
    some = trees.keep(t.select("id"), t, want)
    return trees.first(some).withColumn("which", F.lit("first")).union(trees.last(some).withColumn("which", F.lit("last")))


def _trees_of_items(spark: SparkSession, sf: str) -> DataFrame:
    """The tree with paths, attributes, kinds of items, visibility and mutability: customers are items of three kinds, orders their parameters."""
    t = nodes(spark, sf)
    item = F.when(F.col("kind") == "fn", F.element_at(F.array(*map(F.lit, ("fn", "static", "ty"))), (F.col("id") % 3 + 1).cast("int")))
    return t.select(
        "id", "parent", F.when(F.col("kind") == "fn", F.when(F.col("id") % 7 == 0, "foreign_item").otherwise("item")).when(F.col("kind") == "stmt", "param").otherwise("item").alias("kind"),
        F.coalesce(item, F.when(F.col("kind") == "mod", "mod")).alias("item_kind"), "name", F.when(F.col("pub"), "pub").alias("vis"), F.when(F.col("tag") == "F", "mut").alias("mutbl"),
        F.when(F.col("kind") == "fn", F.array(F.lit("crate"), F.col("parent").cast("string"), "name")).alias("path"), F.when(F.col("kind") == "fn", F.array("tag")).alias("attrs"), "tag",
    )


def select_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """``crate; desc(ty)`` takes the nodes of that kind, as the kind of a node wins; foreign items of a kind, mutable parameters and items by path are other selections."""
    t = _trees_of_items(spark, sf)
    tests = {
        "ty": trees.is_named_kind("ty"), "static": trees.is_named_kind("static") & ~trees.is_public(), "foreign fn": trees.is_named_kind("foreign_item") & trees.is_named_kind("fn"),
        "mut arg": trees.is_named_kind("arg") & trees.is_mutable(), "itemlike": trees.is_kind("itemlike") & trees.has_attr("BUILDING"),
        "path": trees.path_is(1, ["100", "Customer#000000007"]) | trees.path_is(0, ["100", "Customer#000000007"]),
    }
    under = t.join(trees.descendants(trees.root(t), t), "id", "left_semi")
    passed = F.explode(F.array_compact(F.array(*(F.when(want, F.lit(name)) for name, want in tests.items()))))
    return under.select("id", passed.alias("test")).groupBy("test").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def select_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Marks inside a test: functions with one label or the other, unless both; then those with a marked child are added."""
    t = nodes(spark, sf)
    m = _marks(spark, sf)
    m = trees.mark(m, trees.keep(t.select("id"), t, trees.name_is(".*[13579]")), "odd")
    m = trees.mark(m, trees.keep(t.select("id"), t, trees.truth(F.col("tag") == "P")), "late")
    labelled = trees.with_labels(t, m)
    a, b = trees.has_label("BUILDING"), trees.has_label("odd")
    some = trees.keep(t.select("id"), labelled, (a | b) & ~(a & b))
    above = trees.with_child_tests(labelled, trees.has_label("late")).filter("any_child").select("id")
    return trees.added(trees.added(trees.reset(some), some), above)


def _used(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as expressions that use a customer's definition: the field is the flag, the argument the line number, a call if filled."""
    li, o = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("o_custkey") + 1000).alias("target"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("arg"), (F.col("l_linestatus") == "F").alias("call")
    )


def marks_to_fields(spark: SparkSession, sf: str) -> DataFrame:
    return trees.move_marks(_marks(spark, sf), _used(spark, sf), "MACHINERY", F.col("field") == "A")


def marks_to_args(spark: SparkSession, sf: str) -> DataFrame:
    return trees.move_marks(_marks(spark, sf), _used(spark, sf), "BUILDING", F.col("arg") == 2)


def marks_to_callers(spark: SparkSession, sf: str) -> DataFrame:
    return trees.printed_marks(trees.move_marks(_marks(spark, sf), _used(spark, sf), "FURNITURE", F.col("call")))


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).filter("kind = 'fn'").select("id", F.col("tag").alias("label"))


def marks_algebra(spark: SparkSession, sf: str) -> DataFrame:
    t, m = nodes(spark, sf), _marks(spark, sf)
    m = trees.rename_marks(trees.copy_marks(m, "BUILDING", "SITE"), "MACHINERY", "TOOL")
    m = trees.unmark(m, trees.keep(t.select("id"), t, trees.truth(~F.col("pub"))), "SITE")
    return trees.rename_marks(trees.delete_marks(m, "HOUSEHOLD"), "FURNITURE", "FURNITURE")


def marks_to_uses(spark: SparkSession, sf: str) -> DataFrame:
    t = nodes(spark, sf)
    uses = t.filter("kind = 'stmt'").select("id", F.col("parent").alias("target"), "tag")
    return trees.move_marks(_marks(spark, sf), uses, "BUILDING", F.col("tag") != "P")


def marks_public(spark: SparkSession, sf: str) -> DataFrame:
    t = nodes(spark, sf)
    start = trees.mark(_marks(spark, sf).limit(0), trees.child(trees.root(t), t, trees.name_is("A.*")), "seen")
    return trees.mark_public(start, t, "seen")


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): each supplier nation with the two customer nations that it sends most lines to."""
    li, s, o, c = (_t(spark, sf, x) for x in ("lineitem", "supplier", "orders", "customer"))
    n = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey"))
    n = n.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return n.withColumn("place", place).filter("place <= 2").select("src", "dst")


TRADE = """WITH RECURSIVE trade AS (
  SELECT src, dst FROM (
    SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS place FROM (
      SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, count(*) AS n
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      GROUP BY 1, 2)) WHERE place <= 2
), paths AS (SELECT src, dst FROM trade UNION SELECT p.src, t.dst FROM paths p JOIN trade t ON p.dst = t.src
), scc AS (
  SELECT n.id, least(n.id, min(a.dst)) AS component FROM (SELECT n_nationkey::BIGINT AS id FROM nation) n
  LEFT JOIN (SELECT x.src, x.dst FROM paths x JOIN paths y ON x.src = y.dst AND x.dst = y.src) a ON a.src = n.id GROUP BY 1
)"""


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def closure_nations(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.closure(trade(spark, sf))


def scc_nations(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.strong_components(_nations(spark, sf), trade(spark, sf)).select("id", "component")


def condensed_nations(spark: SparkSession, sf: str) -> DataFrame:
    e = trade(spark, sf)
    return graphs.condensed(graphs.strong_components(_nations(spark, sf), e), e)[1]


def outside_successors(spark: SparkSession, sf: str) -> DataFrame:
    members = _nations(spark, sf).filter("id < 8")
    return graphs.outside_successors(trade(spark, sf), members)


def inverted_trade(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.inverted(trade(spark, sf)).select("dst", F.array_join(F.col("srcs").cast("array<string>"), ",").alias("srcs"))


def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Nations below 15 as functions; trade mentions, and every nation inhabits the next."""
    n = _nations(spark, sf)
    e = graphs.definition_graph(trade(spark, sf), n.filter("id < 24").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    return graphs.call_graph(e, n.filter("id < 15")).select("src", "dst")


def condensed_members(spark: SparkSession, sf: str) -> DataFrame:
    """Components with those of their nations that have a span, from number 9 on."""
    e = trade(spark, sf)
    parts, _ = graphs.condensed(graphs.strong_components(_nations(spark, sf), e), e, _nations(spark, sf).filter("id >= 9"))
    return parts.select("component", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def type_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What nation 3 depends on, not through ends whose sum divides by four."""
    return graphs.dependency_closure(trade(spark, sf), _nations(spark, sf).filter("id = 3"), (F.col("src") + F.col("dst")) % 4 > 0)


def _rings(spark: SparkSession, sf: str, orders: str) -> DataFrame:
    """From each line of an order to the next one's part, back to the first if the order is finished."""
    li, o = _t(spark, sf, "lineitem"), _t(spark, sf, "orders").filter(orders)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return both.select(F.col("l_partkey").alias("src"), F.coalesce(F.lead("l_partkey").over(order), F.when(F.col("o_orderstatus") == "F", F.first("l_partkey").over(whole))).alias("dst")).filter("dst IS NOT NULL")


def _scc(spark: SparkSession, sf: str, orders: str) -> DataFrame:
    return graphs.strong_components(_t(spark, sf, "part").select(F.col("p_partkey").alias("id")), _rings(spark, sf, orders)).select("id", "component")


def scc_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Strong components of parts over the lines of the dearest orders, as its SQL stores all pairs that reach each other."""
    return _scc(spark, sf, "o_totalprice > 450000")


def scc_all_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Strong components of parts over all lines."""
    return _scc(spark, sf, "true")


def definitions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts, mention edges (order to part, part to a like part), and roots: dear orders."""
    li, p = _t(spark, sf, "lineitem"), _t(spark, sf, "part")
    order, part = (lambda c: -F.col(c) - 1), F.col  # an order is a negative number, so that ids stay short
    uses = li.select(order("l_orderkey").alias("src"), part("l_partkey").alias("dst"))
    like = Window.partitionBy("p_type", "p_size", "p_brand").orderBy("p_partkey")
    chain = p.withColumn("next", F.lead("p_partkey").over(like)).filter("next IS NOT NULL").select(F.col("p_partkey").alias("src"), F.col("next").alias("dst"))
    roots = _t(spark, sf, "orders").filter("o_totalprice >= 480000").select(order("o_orderkey").alias("id"))
    return p.select(F.col("p_partkey").alias("id")), graphs.definition_graph(uses, chain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), roots


def dead_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that no dear order reaches, over lines and from a part to the next like one."""
    return graphs.dead(*definitions(spark, sf)).select(F.concat(F.lit("part:"), F.col("id").cast("string")).alias("id"))


def _linked_customers(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """(id, component): customers linked by a part on these lines."""
    links = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_partkey", "o_custkey").distinct()
    hub = links.select(F.col("o_custkey").alias("a"), (-F.col("l_partkey") - 1).alias("b"))  # a part is a negative id: no pairs of customers
    comp = components(hub)
    best = comp.filter("id >= 0").groupBy("component").agg(F.min("id").alias("low"))
    return comp.filter("id >= 0").join(best, "component").select("id", F.col("low").alias("component"))


def components_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers linked by a part that they ordered in bulk, 0.11 % of the lines: (id, component)."""
    return _linked_customers(_t(spark, sf, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.1"), _t(spark, sf, "orders"))


def components_all_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers linked by any part that they ordered, over all lines: (id, component)."""
    return _linked_customers(_t(spark, sf, "lineitem"), _t(spark, sf, "orders"))


def _call_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li, o = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    targets = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("targets"))
    parts = o.join(targets, o["o_orderkey"] == targets["l_orderkey"]).select(F.col("o_orderkey").alias("component"), flag.alias("all_mutable"), "targets", F.col("o_custkey").alias("site"))
    return parts, _t(spark, sf, "part").filter("p_size >= 48").select(F.col("p_partkey").alias("name"))


def escaping_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    out = graphs.call_sites(*_call_parts(spark, sf), mutable=False)
    return out.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("component")).cast("array<string>"), ",").alias("components"))


def affected_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.call_sites(*_call_parts(spark, sf), mutable=True).select("component", "site")


def enclosing_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks round each loop: customers in nations in regions in the whole."""
    t = nodes(spark, sf)
    blocks = t.filter("kind = 'fn'").select(F.col("id").alias("block"), F.col("parent").alias("loop"))
    loops = t.filter("kind IN ('mod', 'crate')").select(F.col("id").alias("loop"), "parent")
    every = graphs.enclosing_loops(blocks, loops)
    common = graphs.tightest_common_loop(every, _t(spark, sf, "customer").filter("c_nationkey < 2").select((F.col("c_custkey") + 1000).alias("block")))
    return every.groupBy("loop").agg(F.count("*").alias("n")).join(common.withColumn("common", F.lit(True)), "loop", "left").select("loop", "n", F.coalesce("common", F.lit(False)).alias("common"))


QUERIES = {
    "scc_all_parts": scc_all_parts, "dead_parts": dead_parts, "select_child": select_child, "select_desc": select_desc, "select_any_every": select_any_every,
    "select_any_every_desc": select_any_every_desc, "select_first_last": select_first_last, "marks_algebra": marks_algebra, "marks_to_uses": marks_to_uses,
    "marks_public": marks_public, "closure_nations": closure_nations, "scc_nations": scc_nations, "condensed_nations": condensed_nations,
    "outside_successors": outside_successors, "inverted_trade": inverted_trade, "components_parts": components_parts, "components_all_parts": components_all_parts,
    "escaping_call_sites": escaping_call_sites, "affected_call_sites": affected_call_sites, "enclosing_loops": enclosing_loops,
    "select_kinds": select_kinds, "select_marked": select_marked, "marks_to_fields": marks_to_fields, "marks_to_args": marks_to_args, "marks_to_callers": marks_to_callers,
    "call_graph": call_graph, "condensed_members": condensed_members, "type_closure": type_closure, "scc_parts": scc_parts,
}

_CALLS = """SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS m FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 48))"""

ORACLE = {
    "dead_parts": """WITH RECURSIVE e AS (
        SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst FROM lineitem
        UNION SELECT 'part:' || p_partkey, 'part:' || nxt FROM (
          SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_type, p_size, p_brand ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL
      ), r AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_totalprice >= 480000 UNION SELECT e.dst FROM r JOIN e ON r.id = e.src)
      SELECT 'part:' || p_partkey AS id FROM part WHERE 'part:' || p_partkey NOT IN (SELECT id FROM r)""",
    "select_child": NODES + " SELECT n.id FROM nodes n JOIN nodes p ON n.parent = p.id AND p.parent = 0 WHERE n.kind = 'mod' AND regexp_full_match(n.name, 'NATION_1.*')",
    "select_desc": NODES + """, d AS (SELECT id FROM nodes WHERE parent IN (SELECT id FROM nodes WHERE parent = 0 AND name LIKE 'A%')
        UNION SELECT n.id FROM d JOIN nodes n ON n.parent = d.id)
      SELECT n.id FROM nodes n JOIN d USING (id) WHERE n.kind = 'stmt' AND n.tag = 'P'""",
    "select_any_every": NODES + """ SELECT f.id, coalesce(bool_or(s.tag = 'F'), false) AS any_child, coalesce(bool_and(s.tag = 'F'), true) AS every_child
      FROM nodes f LEFT JOIN nodes s ON s.parent = f.id WHERE f.kind = 'fn' GROUP BY 1""",
    "select_any_every_desc": NODES + """, t AS (SELECT id, parent, kind, NOT coalesce(kind = 'fn' AND NOT pub, false) AS w FROM nodes),
      c AS (SELECT id AS top, id FROM t WHERE kind <> 'stmt' UNION ALL SELECT c.top, t.id FROM c JOIN t ON t.parent = c.id)
      SELECT c.top AS id, coalesce(bool_or(t.w) FILTER (c.top <> c.id), false) AS any_desc, coalesce(bool_and(t.w) FILTER (c.top <> c.id), true) AS every_desc
      FROM c JOIN t ON t.id = c.id GROUP BY 1""",
    "select_first_last": NODES + """, s AS (SELECT id FROM nodes WHERE kind = 'fn' AND (pub AND tag <> 'BUILDING' OR name LIKE '%7'))
      SELECT min(id) AS id, 'first' AS which FROM s UNION ALL SELECT max(id), 'last' FROM s""",
    "marks_algebra": NODES + """, m AS (SELECT id, tag, pub FROM nodes WHERE kind = 'fn')
      SELECT id, CASE tag WHEN 'MACHINERY' THEN 'TOOL' ELSE tag END AS label FROM m WHERE tag NOT IN ('HOUSEHOLD', 'FURNITURE')
      UNION ALL SELECT id, 'SITE' FROM m WHERE tag = 'BUILDING' AND pub""",
    "marks_to_uses": NODES + """ SELECT id, tag AS label FROM nodes WHERE kind = 'fn' AND tag <> 'BUILDING'
      UNION ALL SELECT o.id, 'BUILDING' FROM nodes o JOIN nodes f ON o.parent = f.id WHERE o.kind = 'stmt' AND o.tag <> 'P' AND f.tag = 'BUILDING'""",
    "marks_public": NODES + """, d AS (SELECT id, kind FROM nodes WHERE parent = 0 AND name LIKE 'A%'
        UNION SELECT n.id, n.kind FROM d JOIN nodes n ON n.parent = d.id AND n.pub WHERE d.kind = 'mod')
      SELECT id, 'seen' AS label FROM d""",
    "closure_nations": TRADE + " SELECT src, dst FROM paths",
    "scc_nations": TRADE + " SELECT id, component FROM scc",
    "condensed_nations": TRADE + """ SELECT DISTINCT a.component AS src_component, b.component AS dst_component
      FROM trade JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.component <> b.component""",
    "outside_successors": TRADE + " SELECT DISTINCT dst AS id FROM trade WHERE src < 8 AND dst >= 8",
    "inverted_trade": TRADE + " SELECT dst, string_agg(src, ',' ORDER BY src) AS srcs FROM trade GROUP BY 1",
    "components_parts": """WITH RECURSIVE b AS (SELECT DISTINCT l_partkey AS p, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.1),
      l AS (SELECT DISTINCT x.c AS a, y.c AS b FROM b x JOIN b y ON x.p = y.p),
      r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
      SELECT a AS id, min(b) AS component FROM r GROUP BY 1""",
    "components_all_parts": """WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS c, -l_partkey - 1 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      e AS (SELECT c AS a, p AS b FROM l UNION ALL SELECT p, c FROM l),
      r(id, component) USING KEY (id) AS (SELECT DISTINCT a, CASE WHEN a >= 0 THEN a ELSE 9223372036854775807 END FROM e
        UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.id JOIN recurring.r o ON o.id = e.b WHERE r.component < o.component GROUP BY 1)
      SELECT id, component FROM r WHERE id >= 0""",
    "select_kinds": NODES + """, t AS (SELECT *, CASE WHEN kind = 'fn' AND id % 7 = 0 THEN 'foreign_item' WHEN kind = 'stmt' THEN 'param' ELSE 'item' END AS k, CASE kind WHEN 'fn' THEN ['fn', 'static', 'ty'][id % 3 + 1] WHEN 'mod' THEN 'mod' END AS i FROM nodes WHERE id > 0),
      s AS (SELECT 'static' AS test, id FROM t WHERE i = 'static' AND NOT coalesce(pub, false) UNION ALL SELECT 'foreign fn', id FROM t WHERE k = 'foreign_item' AND i = 'fn'
        UNION ALL SELECT 'mut arg', id FROM t WHERE k = 'param' AND tag = 'F' UNION ALL SELECT 'itemlike', id FROM t WHERE kind = 'fn' AND tag = 'BUILDING'
        UNION ALL SELECT 'path', id FROM t WHERE kind = 'fn' AND parent = 100 AND name = 'Customer#000000007')
      SELECT test, count(*) AS n, sum(id)::BIGINT AS ids FROM s GROUP BY 1""",
    "select_marked": NODES + """ SELECT id FROM nodes WHERE coalesce(kind = 'fn' AND tag = 'BUILDING', false) <> coalesce(regexp_full_match(name, '.*[13579]'), false)
      UNION SELECT parent FROM nodes WHERE tag = 'P'""",
    **{name: NODES + f""" SELECT id, tag AS label FROM nodes WHERE kind = 'fn' AND tag <> '{label}'
      UNION SELECT l_orderkey * 10 + l_linenumber, '{label}' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = '{label}' AND {test}"""
      for name, label, test in (("marks_to_fields", "MACHINERY", "l_returnflag = 'A'"), ("marks_to_args", "BUILDING", "l_linenumber = 2"), ("marks_to_callers", "FURNITURE", "l_linestatus = 'F'"))},
    "call_graph": TRADE + " SELECT src, dst FROM trade WHERE src < 15 AND dst < 15 AND src <> dst + 1",
    "condensed_members": TRADE + " SELECT component, coalesce(string_agg(id, ',' ORDER BY id) FILTER (id >= 9), '') AS members FROM scc GROUP BY 1",
    "type_closure": TRADE + ", r AS (SELECT 3::BIGINT AS id UNION SELECT dst FROM r JOIN trade ON src = id AND (src + dst) % 4 > 0) SELECT id FROM r",
    "scc_parts": """WITH RECURSIVE f AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 450000),
      g AS (SELECT l_partkey AS src, coalesce(lead(l_partkey) OVER w, CASE WHEN o_orderstatus = 'F' THEN first(l_partkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END) AS dst FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
      e AS (SELECT DISTINCT src, dst FROM g WHERE dst IS NOT NULL), x AS (SELECT DISTINCT src FROM e),
      r AS (SELECT src AS a, src AS b FROM x UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
      c AS (SELECT y.a AS id, min(y.b) AS component FROM r y JOIN r z ON z.a = y.b AND z.b = y.a GROUP BY 1)
      SELECT p_partkey AS id, coalesce(component, p_partkey) AS component FROM part LEFT JOIN c ON c.id = p_partkey""",
    "escaping_call_sites": f"""SELECT o_custkey AS site, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS components FROM ({_CALLS}) WHERE NOT coalesce(m, true) GROUP BY 1""",
    "affected_call_sites": f"SELECT o_orderkey AS component, o_custkey AS site FROM ({_CALLS}) WHERE coalesce(m, false)",
    "enclosing_loops": """SELECT loop, count(*) AS n, loop = (SELECT CASE WHEN count(DISTINCT n_regionkey) > 1 THEN 0 WHEN count(DISTINCT n_nationkey) > 1 THEN 1 + min(n_regionkey) ELSE 100 + min(n_nationkey) END
          FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 2) AS common
      FROM (SELECT unnest([100 + n_nationkey, 1 + n_regionkey, 0])::BIGINT AS loop FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""",
}
