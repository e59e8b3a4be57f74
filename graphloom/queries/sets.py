"""Coverage, interval, keyed and metric queries on stand-ins: lines of parts as source lines, orders as intervals, events as edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashes import djb2, jodyhash, normal_path, wrapped_product
from ..operators import conflicts, coverage, intervals, keyed, metrics


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cover(spark: SparkSession, sf: str, flag: str) -> coverage.CoverSet:
    """The lines of each part with a return flag: all coverable, those of over 25 pieces covered."""
    li = _t(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag)
    line = [F.col("l_partkey").alias("file"), F.col("l_linenumber").cast("long").alias("line")]
    return coverage.CoverSet(li.select(line[0]).distinct(), li.filter("l_quantity > 25").select(*line).distinct(), li.select(*line).distinct())


def _shown(s: coverage.CoverSet) -> DataFrame:
    lines = s.covered.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("line")).cast("array<string>"), ",").alias("lines"))
    return coverage.per_file(s).join(lines, "file", "left").select("file", "n_covered", "n_coverable", F.coalesce("lines", F.lit("")).alias("lines"))


def _pair(op):
    return lambda spark, sf: _shown(op(cover(spark, sf, "A"), cover(spark, sf, "R")))


_COVER = """WITH a AS (SELECT DISTINCT l_partkey AS file, l_linenumber::BIGINT AS line FROM lineitem WHERE l_returnflag = 'A'),
  b AS (SELECT DISTINCT l_partkey AS file, l_linenumber::BIGINT AS line FROM lineitem WHERE l_returnflag = 'R'),
  ca AS (SELECT DISTINCT l_partkey AS file, l_linenumber::BIGINT AS line FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25),
  cb AS (SELECT DISTINCT l_partkey AS file, l_linenumber::BIGINT AS line FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25),
"""


def _cover_sql(files: str, covered: str) -> str:
    return _COVER + f"""fs AS ({files}), cs AS ({covered}), may AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE file NOT IN (SELECT file FROM a))
      SELECT file, (SELECT count(*) FROM cs WHERE cs.file = fs.file) AS n_covered, (SELECT count(*) FROM may WHERE may.file = fs.file) AS n_coverable,
        coalesce((SELECT string_agg(line, ',' ORDER BY line::VARCHAR) FROM cs WHERE cs.file = fs.file), '') AS lines FROM fs"""


_EITHER = "SELECT file FROM a UNION SELECT file FROM b"
_LEFT = "SELECT DISTINCT file FROM a"


def cover_negate(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(coverage.negate(cover(spark, sf, "A")))


def cover_totals(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.totals(coverage.negate(cover(spark, sf, "A")))


def cover_markers(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").cast("long").alias("line")).distinct()
    return coverage.line_markers(cover(spark, sf, "A"), lines)


def cover_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as change points: days are lines, seconds of the day columns."""
    s = F.unix_timestamp("ts") - F.lit(1_704_067_200)
    seg = _t(spark, sf, "events").select(
        F.col("user_id").alias("file"), (F.floor(s / 86400) + 1).cast("long").alias("line"), (s % 86400 + 1).cast("long").alias("col"),
        F.when(F.col("event_id") % 13 == 0, "many").when(F.col("value") > 10, F.floor("value").cast("string")).otherwise("0").alias("count"), (F.col("event_type") != "error").alias("has_count"),
    )
    # columns at the day's edges: every seventh segment starts a line, others of a third stand right behind its end
    seg = seg.withColumn("col", F.when(F.col("col") % 7 == 0, 1).otherwise(F.col("col"))).withColumn("line_len", F.when(F.col("line") % 3 == 0, F.col("col") - 1).otherwise(90_000))
    return coverage.lines_from_segments(coverage_first(seg))


def coverage_first(seg: DataFrame) -> DataFrame:
    """One change point a place, the one of the highest count."""
    best = F.max_by(F.struct("count", "has_count", "line_len"), F.struct("count", "has_count"))
    return seg.groupBy("file", "line", "col").agg(best.alias("b")).select("file", "line", "col", "b.*")


def config_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    out = coverage.merge_configs(o.select(F.array("o_orderpriority").alias("config")), o.select(F.array("o_orderpriority", "o_orderstatus").alias("config")))
    return out.select(F.array_join("config", "+").alias("config"), "index")


def config_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files whose config, an index into a list of priorities, moves to the index in a merged list; every fifth names none."""
    o = _t(spark, sf, "orders")
    a = o.select(F.array("o_orderpriority").alias("config")).distinct().withColumn("index", 10 - F.ascii(F.col("config")[0]).cast("long") + 48)
    merged = coverage.merge_configs(a, o.select(F.array("o_orderstatus").alias("config")))
    files = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, 10 - F.ascii("o_orderpriority").cast("long") + 48).alias("config_index"))
    return coverage.remapped(files, a, merged)


def cover_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The symmetric difference of a negated set and the union of two others, as an expression over sets."""
    a, r, n = (cover(spark, sf, f) for f in "ARN")
    return _shown(coverage.symmetric_difference(coverage.negate(a), coverage.union(r, n)))


def cover_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that two sets hash differently; a third of the hashes are not given."""
    p = _t(spark, sf, "part")
    side = lambda c, n: coverage.CoverSet(p.select(F.col("p_partkey").alias("file"), F.when(F.col("p_partkey") % 3 == n, "").otherwise(F.col(c)).alias("expanded_hash")), p, p)
    brand = lambda c: F.concat(F.lit("Brand#"), F.col("p_size") % 5 + 1, F.lit("1"))  # noqa: E731, ARG005
    p = p.withColumn("other", brand("p_size"))
    return coverage.mismatches(side("p_brand", 0), side("other", 1))


def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", coverage.line_count(F.col("text")).cast("long").alias("n"))


def feature_names(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as variables: urgent and low ones are switches, in any case, others values."""
    o = _t(spark, sf, "orders")
    switch = F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    value = F.when(switch, F.when(F.col("o_orderstatus") == "F", "On").when(F.col("o_orderstatus") == "O", "TRUE").otherwise("off")).otherwise(F.col("o_orderstatus"))
    rows = o.select(F.col("o_custkey").alias("config"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("V"), F.col("o_orderkey").cast("string")).alias("variable"), value.alias("value"), switch.alias("boolean"))
    return coverage.feature_names(rows).select("config", F.array_join("features", ",").alias("features"))


def merged_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """A part's lines as dependencies: the first one's flag counts, all discounts are features."""
    li = _t(spark, sf, "lineitem")
    rows = li.select(F.col("l_partkey").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("spec"), F.array(F.col("l_linenumber").cast("string"), "l_linestatus").alias("features"))
    return coverage.merged_dependencies(rows).select("name", "spec", F.array_join("features", ",").alias("features"))


def config_product(spark: SparkSession, sf: str) -> DataFrame:
    """Every choice of two variables for each nation."""
    return coverage.config_product({"mode": ["fast", "small"], "log": ["on", "off", "auto"]}, _t(spark, sf, "nation").select("n_nationkey"))


def spans_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """(key, ord, start, end): a customer's orders as day intervals, longer for dearer ones."""
    start = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long")
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), start.alias("start"), (start + 1 + F.floor(F.col("o_totalprice") / 2000)).cast("long").alias("end"))


_SPANS = """spans AS (SELECT o_custkey AS key, o_orderkey AS ord, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS "start",
  date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT + 1 + floor(o_totalprice / 2000)::BIGINT AS "end" FROM orders)"""


def overlap_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as declarations, statuses as headers, dear ones as definitions."""
    more = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("header"), (F.col("o_totalprice") > 250000).alias("is_defn"))
    return intervals.overlap_buckets(spans_of_orders(spark, sf).join(more, "ord"))


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """(file, ord, off, len, text): a user's events as edits; sign-ups insert, others replace as many bytes as their value is."""
    off = F.floor((F.unix_timestamp("ts") - F.lit(1_704_067_200)) / 600).cast("long")
    length = F.when(F.col("event_type") == "signup", 0).otherwise(F.floor("value") + 1).cast("long")
    return _t(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("ord"), off.alias("off"), length.alias("len"), F.col("event_type").alias("text"))


_EDITS = """edits AS (SELECT user_id AS file, event_id AS ord, floor((epoch(date_trunc('second', ts)) - 1704067200) / 600)::BIGINT AS off,
  CASE event_type WHEN 'signup' THEN 0 ELSE floor(value)::BIGINT + 1 END AS len, event_type AS text FROM events),
 ded AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY file, off, len, text ORDER BY ord) AS n FROM edits) WHERE n = 1 OR len = 0)"""


def edit_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.conflicts(edits(spark, sf))


def edit_order(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.sorted_edits(intervals.distinct_edits(edits(spark, sf))).select("file", "ord", "off", "len", "place")


def sound_edits(spark: SparkSession, sf: str) -> DataFrame:
    """The edits of each file that clash with none before: every edit that starts after all earlier ones end."""
    before = Window.partitionBy("file").orderBy("off", "ord").rowsBetween(Window.unboundedPreceding, -1)
    e = intervals.distinct_edits(edits(spark, sf)).filter("len > 0")
    return e.withColumn("upto", F.max(F.col("off") + F.col("len")).over(before)).filter("upto IS NULL OR off >= upto").drop("upto")


_SOUND = """, sound AS (SELECT * EXCLUDE upto FROM (SELECT *, max(off + len) OVER (PARTITION BY file ORDER BY off, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
  FROM ded WHERE len > 0) WHERE upto IS NULL OR off >= upto)"""


def split_insertions(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.split_insertions(sound_edits(spark, sf).union(edits(spark, sf).filter("len = 0")))


def offset_map(spark: SparkSession, sf: str) -> DataFrame:
    """Where sign-ups stand after the sound edits and the sign-ups' own insertions, some at the offset itself."""
    some = edits(spark, sf).filter("len = 0")
    return intervals.map_offsets(some.select("file", F.col("off").alias("at")).distinct(), sound_edits(spark, sf).unionByName(some))


def edited_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.edited_ranges(sound_edits(spark, sf))


def apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of users, as long as their edits need, after these."""
    e = sound_edits(spark, sf)
    files = e.groupBy("file").agg(F.max(F.col("off") + F.col("len")).alias("n")).select("file", F.repeat(F.lit("."), F.col("n").cast("int")).cast("binary").alias("content"))
    e = e.withColumn("file", F.col("file").cast("string"))
    out = intervals.apply_edits(files.withColumn("file", F.col("file").cast("string")), e)
    return out.select(F.col("file").cast("long").alias("file"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def innermost_range(spark: SparkSession, sf: str) -> DataFrame:
    """For each event the shortest interval of the orders of the customer with the user's number that holds its day of 1995 on."""
    day = F.datediff("ts", F.lit("1990-01-01")).cast("long")
    points = _t(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id"), (day - 10 * 365 + F.col("event_id") % 700).alias("start"))
    ranges = spans_of_orders(spark, sf).select(F.col("key").alias("file"), "start", "end", F.col("ord").alias("id"))
    return conflicts.innermost(points.withColumn("end", F.col("start")), ranges).select("event_id", "range_id")


def parent_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return conflicts.parents_by_range(spans_of_orders(spark, sf).select(F.col("key").alias("file"), "start", "end", F.col("ord").alias("id")))


def accesses(spark: SparkSession, sf: str) -> DataFrame:
    """(call, ord, arg, kind, root, outer, path): a customer's orders as accesses; priorities are kinds, months arguments, statuses roots, P unknown.

    Two accesses share an outer expression; a path is the field of the month and, for later years, an index or the field of the day.
    """
    kinds = F.create_map(*(F.lit(x) for kv in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), conflicts.RANKS) for x in kv))
    root = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    step = lambda kind, n, literal, split: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("index"), literal.alias("literal"), split.alias("splittable"))
    first = step("Field", F.month("o_orderdate") % 3, F.lit(True), F.col("o_orderkey") % 7 > 0)
    odd = F.col("o_orderkey") % 2 == 1
    second = F.when(odd, step("Index", F.dayofmonth("o_orderdate") % 2, F.col("o_orderkey") % 3 > 0, F.lit(False))).otherwise(step("Field", F.dayofmonth("o_orderdate") % 2, F.lit(True), F.lit(True)))
    path = F.when(F.year("o_orderdate") > 1996, F.array(first, second)).otherwise(F.array(first))
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("call"), F.col("o_orderkey").alias("ord"), F.month("o_orderdate").alias("arg"), F.coalesce(kinds[F.col("o_orderpriority")], F.lit("Read")).alias("kind"), root.alias("root"), F.floor(F.col("o_orderkey") / 2).alias("outer"), path.alias("path"))


_ACCESSES = """acc AS (SELECT o_custkey AS call, o_orderkey AS ord, month(o_orderdate) AS arg,
   CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 0 END AS k,
   CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS root, o_orderkey // 2 AS outer_, month(o_orderdate) % 3 AS f1, o_orderkey % 7 > 0 AS s1,
   year(o_orderdate) > 1996 AS deep, o_orderkey % 2 = 1 AS idx, day(o_orderdate) % 2 AS f2, o_orderkey % 3 > 0 AS lit FROM orders),
 pairs AS (SELECT a.call, a.ord AS a_ord, b.ord AS b_ord, a.root = b.root AND (CASE WHEN a.f1 <> b.f1 THEN a.s1 AND b.s1
     ELSE a.deep AND b.deep AND a.s1 AND b.s1 AND NOT a.idx AND NOT b.idx AND a.f2 <> b.f2 END) AS apart, CASE WHEN (a.k, -a.arg, a.ord) <= (b.k, -b.arg, b.ord) THEN a.ord ELSE b.ord END AS pick
   FROM acc a JOIN acc b ON a.call = b.call AND a.ord < b.ord AND a.arg <> b.arg AND (a.root IS NULL OR b.root IS NULL OR a.root = b.root)
   WHERE NOT (a.k = 1 AND b.k = 1) AND NOT (a.k = 0 AND b.k = 0) AND (a.k >= 2 OR b.k >= 2))"""


def conflict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = conflicts.chosen_side(conflicts.conflict_pairs(accesses(spark, sf)))
    return out.select("call", F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), F.col("pick.ord").alias("pick"))


def lift_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Lifts of cheap orders are feasible."""
    cheap = _t(spark, sf, "orders").filter("o_totalprice < 400000").select(F.col("o_custkey").alias("call"), F.floor(F.col("o_orderkey") / 2).alias("outer"), F.col("o_orderkey").alias("ord"))
    return conflicts.planned(conflicts.conflict_pairs(accesses(spark, sf)), cheap)


def post_order(spark: SparkSession, sf: str) -> DataFrame:
    """Lines inside orders: a customer's orders are ranges of ten places, their lines ranges of one."""
    o, li = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    whole = o.select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 9).alias("end"), (F.col("o_orderkey") * 10).alias("id"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    inner = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("file"), at.alias("start"), at.alias("end"), at.alias("id"))
    return conflicts.post_order(whole.union(inner.distinct())).select("file", "id", "place")


def item_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a customer's order intervals hold the start of which others, by the innermost."""
    s = spans_of_orders(spark, sf)
    refs = s.select(F.col("key").alias("file"), F.col("start"), F.col("start").alias("end"), F.col("ord").alias("used"))
    out = conflicts.used_by(conflicts.item_uses(refs, s.select(F.col("key").alias("file"), "start", "end", F.col("ord").alias("id"))))
    return out.select("user", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commands: of each file, given by directory and name or as an absolute path, the first; assembly goes."""
    end = F.when(F.col("o_orderkey") % 11 == 0, ".S").otherwise(".c")
    name = F.concat(F.lit("f"), F.col("o_custkey") % 50, end)
    file = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/d"), F.col("o_custkey") % 2, F.lit("/"), name)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("./x/../"), name)).otherwise(name)
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.concat(F.lit("/d"), F.col("o_custkey") % 2).alias("directory"), file.alias("file"))
    return keyed.compile_commands(rows).select("idx", "file")


def normal_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that orders spell in odd ways."""
    p = F.concat_ws(
        "/", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("a"), F.when(F.col("o_orderkey") % 3 == 0, "..").otherwise("."), F.concat(F.lit("d"), F.col("o_custkey") % 5),
        F.when(F.col("o_orderkey") % 5 < 2, "..").otherwise(""), F.when(F.col("o_orderkey") % 7 < 3, "..").otherwise("e"), "o_orderstatus",
    )
    return _t(spark, sf, "orders").select("o_orderkey", normal_path(p).alias("path"))


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as commands in the directory of their nation, some of which spell their output from above."""
    out = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("../n"), "s_nationkey", F.lit("/o"), F.col("s_suppkey") % 2)).otherwise(F.concat(F.lit("o"), F.col("s_suppkey") % 2))
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), F.concat(F.lit("/b/n"), "s_nationkey").alias("directory"), out.alias("output"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as links in the root directory that name an object of their nation and one that no one makes."""
    one = F.concat(F.lit("b/./n"), "c_nationkey", F.lit("/x/../o"), F.col("c_custkey") % 2)
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.lit("/").alias("directory"), F.array(one, "c_mktsegment").alias("inputs"))


def link_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.linked(_links(spark, sf), _commands(spark, sf)).select("link_idx", F.col("pos").cast("long").alias("pos"), "input", "idx")


def leftover_anti(spark: SparkSession, sf: str) -> DataFrame:
    c = _commands(spark, sf)
    return keyed.leftovers(c, keyed.linked(_links(spark, sf), c)).select("idx")


def common_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages").select(F.split("url", "/")[3].alias("grp"), "url")
    return keyed.common_ancestor(p.filter("grp IS NOT NULL"), "grp", "url")


def function_pairs(spark: SparkSession, sf: str) -> DataFrame:
    left = _t(spark, sf, "supplier").select(F.when(F.col("s_nationkey") == 3, "main_0").when(F.col("s_nationkey") == 4, "main").otherwise(F.concat(F.lit("f"), "s_nationkey")).alias("name"), F.col("s_name").alias("definition"))
    right = _t(spark, sf, "customer").select(F.when(F.col("c_nationkey") == 3, "main").otherwise(F.concat(F.lit("f"), "c_nationkey")).alias("name"), F.col("c_name").alias("definition"), F.col("c_custkey").alias("ord"))
    return keyed.function_pairs(left, right)


def agreed_signatures(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("signature"), (F.col("l_linestatus") == "F").alias("is_defn"))
    bad = _t(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    return keyed.without_keys(keyed.agreed_signatures(rows), bad)


def declarations(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.declarations_by_header(_t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("text"), (F.col("o_orderstatus") == "F").alias("is_defn")))


def equal_definitions(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.array("o_orderpriority", "o_orderstatus").alias("tokens"), F.col("o_orderkey").alias("id"))
    return keyed.equal_definitions(o).select("symbol", "token_hash", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def message_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Open lines as lints, others of odd part as messages with a code, the rest without one; returned ones are errors, sold ones notes."""
    code = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("clippy::"), "l_returnflag")).when(F.col("l_partkey") % 2 == 1, F.concat(F.lit("E"), "l_partkey"))
    level = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("note")
    return metrics.message_counts(_t(spark, sf, "lineitem").select(code.alias("code"), level.alias("level")), failed=True)


def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files of lines: a line is a function, unsafe if returned."""
    li = _t(spark, sf, "lineitem")
    line = F.concat(F.when(F.col("l_returnflag") == "R", "unsafe ").otherwise(""), F.lit("fn f("), F.col("l_partkey").cast("string"), F.lit(")"), F.when(F.col("l_linestatus") == "O", ";\t \r").otherwise(" {"))
    line = F.when(F.col("l_partkey") % 10 == 0, "\t \f").otherwise(line)
    return metrics.source_metrics(li.select(F.col("l_orderkey").cast("string").alias("path"), line.alias("line"), F.col("l_linenumber").alias("stage")), ["stage"])


def step_times(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("end_ns")
    e = _t(spark, sf, "events").select("user_id", "event_id", "ts", ns).withColumn("start_ns", F.lag("end_ns").over(order)).filter("start_ns IS NOT NULL")
    return metrics.step_times(e).select("event_id", "elapsed_ms")


def status_lists(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.status_lists(_t(spark, sf, "customer").select(F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name")))
    return out.select("status", F.array_join("names", ",").alias("names"))


def duplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.duplicates(_t(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("name")), "name")


def highest_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Customers named after their balance; every third name has no underscore, the numbers behind it do not count."""
    name = F.concat(F.floor(F.abs("c_acctbal")).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "-").otherwise("_"), "c_name")
    return metrics.highest_numbered(_t(spark, sf, "customer").select(name.alias("path")))


def word_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as three words of 64 bits."""
    words = F.array(wrapped_product(F.col("o_orderkey") + 1, 4_611_686_018_427), F.col("o_custkey") - 1_000_000, wrapped_product(F.col("o_orderkey"), -87_178_291_199))
    return _t(spark, sf, "orders").select("o_orderkey", jodyhash(words).alias("hash"))


def unique_places(spark: SparkSession, sf: str) -> DataFrame:
    """Where a part's first letters stand in its type, between two bounds."""
    p = _t(spark, sf, "part")
    at = intervals.unique_place(F.col("p_type"), F.substring("p_name", 1, 1), (F.col("p_size") % 4).cast("int"), F.when(F.col("p_size") % 3 > 0, F.lit(12)).otherwise(-1))
    return p.select("p_partkey", at.cast("long").alias("at"))


def name_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", djb2(F.concat_ws("/", "p_name", "p_type")).alias("hash"))


QUERIES = {
    "cover_union": _pair(coverage.union), "cover_intersection": _pair(coverage.intersection), "cover_difference": _pair(coverage.difference),
    "cover_symmetric_difference": _pair(coverage.symmetric_difference), "cover_negate": cover_negate, "cover_totals": cover_totals,
    "cover_markers": cover_markers, "cover_segments": cover_segments, "config_merge": config_merge, "overlap_buckets": overlap_buckets,
    "edit_conflicts": edit_conflicts, "edit_order": edit_order, "split_insertions": split_insertions, "offset_map": offset_map,
    "edited_ranges": edited_ranges, "apply_edits": apply_edits, "innermost_range": innermost_range, "parent_ranges": parent_ranges,
    "conflict_pairs": conflict_pairs, "lift_plan": lift_plan, "item_uses": item_uses, "dedupe_first": dedupe_first, "link_left_join": link_left_join,
    "leftover_anti": leftover_anti, "common_ancestor": common_ancestor, "function_pairs": function_pairs, "agreed_signatures": agreed_signatures,
    "declarations": declarations, "equal_definitions": equal_definitions, "message_counts": message_counts, "source_metrics": source_metrics,
    "step_times": step_times, "status_lists": status_lists, "duplicate_lines": duplicate_lines, "highest_numbered": highest_numbered,
    "name_hashes": name_hashes, "config_remap": config_remap, "cover_nested": cover_nested, "cover_mismatches": cover_mismatches, "line_counts": line_counts,
    "feature_names": feature_names, "merged_dependencies": merged_dependencies, "config_product": config_product, "post_order": post_order,
    "normal_paths": normal_paths, "word_hashes": word_hashes, "unique_places": unique_places,
}

_NEG = """SELECT file, line FROM (SELECT file, unnest(range(0, max(line) + 1)) AS line FROM ca GROUP BY file) WHERE (file, line) NOT IN (SELECT (file, line) FROM ca)"""

ORACLE = {
    "cover_union": _cover_sql(_EITHER, "SELECT * FROM ca UNION SELECT * FROM cb"),
    "cover_intersection": _cover_sql("SELECT file FROM a INTERSECT SELECT file FROM b", "SELECT * FROM ca INTERSECT SELECT * FROM cb"),
    "cover_difference": _cover_sql(_LEFT, "SELECT * FROM ca EXCEPT SELECT * FROM cb"),
    "cover_symmetric_difference": _cover_sql(_EITHER, "(SELECT * FROM ca EXCEPT SELECT * FROM cb) UNION ALL (SELECT * FROM cb EXCEPT SELECT * FROM ca)"),
    "cover_negate": _cover_sql(_LEFT, _NEG),
    "cover_totals": _COVER + f"""n AS (SELECT (SELECT count(*) FROM ({_NEG}))::BIGINT AS n_covered, (SELECT count(*) FROM a)::BIGINT AS n_coverable)
      SELECT n_covered, n_coverable, CASE WHEN n_coverable > 0 THEN n_covered::DOUBLE / n_coverable ELSE 0 END AS ratio FROM n""",
    "cover_markers": _COVER + """l AS (SELECT DISTINCT l_partkey AS file, l_linenumber::BIGINT AS line FROM lineitem)
      SELECT file, line, CASE WHEN (file, line) IN (SELECT (file, line) FROM ca) THEN '+' WHEN (file, line) IN (SELECT (file, line) FROM a) THEN '-' ELSE ' ' END AS marker FROM l""",
    "cover_segments": """WITH e AS (SELECT user_id AS file, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS s, CASE WHEN event_id % 13 = 0 THEN 'many' WHEN value > 10 THEN floor(value)::BIGINT::VARCHAR ELSE '0' END AS c, event_type <> 'error' AS h FROM events),
      k AS (SELECT file, s // 86400 + 1 AS line, CASE WHEN (s % 86400 + 1) % 7 = 0 THEN 1 ELSE s % 86400 + 1 END AS col, c, h FROM e),
      g AS (SELECT file, line, col, arg_max(c, (c, h)) AS c, arg_max(h, (c, h)) AS h FROM k GROUP BY 1, 2, 3),
      n AS (SELECT *, lead(line) OVER w AS nl, lead(col) OVER w AS nc FROM g WHERE c <> 'many' OR NOT h WINDOW w AS (PARTITION BY file ORDER BY line, col)),
      q AS (SELECT *, CASE WHEN h THEN c::INT ELSE 0 END AS v, line + CASE WHEN line % 3 = 0 THEN 1 ELSE 0 END AS lo FROM n),
      r AS (SELECT file, lo, CASE WHEN nl IS NULL THEN CASE WHEN v > 0 THEN lo END WHEN nc = 1 THEN nl - 1 ELSE nl END AS hi, v > 0 AS k FROM q WHERE h)
      SELECT file, unnest - 1 AS line, bool_or(k) AS covered FROM (SELECT file, k, unnest(range(lo, hi + 1)) AS unnest FROM r WHERE hi >= lo) GROUP BY 1, 2""",
    "config_merge": """SELECT config, row_number() OVER (ORDER BY k) - 1 AS index FROM (
      SELECT DISTINCT o_orderpriority AS config, [o_orderpriority] AS k FROM orders UNION SELECT DISTINCT o_orderpriority || '+' || o_orderstatus, [o_orderpriority, o_orderstatus] FROM orders)""",
    "overlap_buckets": "WITH " + _SPANS + """, m AS (SELECT DISTINCT key, o_orderstatus AS header, "start", "end", o_totalprice > 250000 AS is_defn FROM spans JOIN orders ON o_orderkey = ord),
      o AS (SELECT *, CASE WHEN "start" < lag("end") OVER w THEN 0 ELSE 1 END AS opens FROM m WINDOW w AS (PARTITION BY key, header ORDER BY "start", "end", is_defn)),
      b AS (SELECT *, sum(opens) OVER (PARTITION BY key, header ORDER BY "start", "end", is_defn ROWS UNBOUNDED PRECEDING) AS bucket FROM o),
      g AS (SELECT key, header, bucket, min("start") AS "start", max("end") AS "end", count(*) AS n, bool_or(is_defn) AS is_defn FROM b GROUP BY 1, 2, 3)
      SELECT key, header, "start", "end", n, is_defn FROM g WHERE n > 1 OR key IN (SELECT key FROM m GROUP BY 1 HAVING count(*) = 1)""",
    "edit_conflicts": "WITH " + _EDITS + """ SELECT file, first, ord AS second FROM (
      SELECT *, lag(off + len) OVER w AS pe, lag(ord) OVER w AS first FROM ded WHERE len > 0 WINDOW w AS (PARTITION BY file ORDER BY off, ord)) WHERE off < pe""",
    "edit_order": "WITH " + _EDITS + " SELECT file, ord, off, len, row_number() OVER (PARTITION BY file ORDER BY off, ord)::INT AS place FROM ded",
    "split_insertions": "WITH " + _EDITS + _SOUND + " SELECT i.file, i.ord AS insertion, r.ord AS replacement FROM edits i JOIN sound r ON i.file = r.file AND i.len = 0 AND r.off < i.off AND i.off < r.off + r.len",
    "offset_map": "WITH " + _EDITS + _SOUND + """, o AS (SELECT DISTINCT file, off AS at FROM edits WHERE len = 0), s AS (SELECT file, off, len, text FROM sound UNION ALL SELECT file, off, len, text FROM edits WHERE len = 0)
      SELECT o.file, o.at, CASE WHEN coalesce(bool_or(s.off + s.len > o.at), false) THEN NULL
        ELSE o.at + coalesce(sum(length(s.text) - s.len), 0)::BIGINT END AS new FROM o LEFT JOIN s ON s.file = o.file AND s.off < o.at GROUP BY 1, 2""",
    "edited_ranges": "WITH " + _EDITS + _SOUND + """ SELECT file, off, len, new_start, new_start + length(text) AS new_end FROM (SELECT *,
      off + coalesce(sum(length(text) - len) OVER (PARTITION BY file ORDER BY off, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_start FROM sound)""",
    "apply_edits": "WITH " + _EDITS + _SOUND + """, g AS (SELECT *, lag(off + len, 1, 0) OVER (PARTITION BY file ORDER BY off, ord) AS e FROM sound),
      t AS (SELECT file, string_agg(repeat('.', (off - e)::INT) || text, '' ORDER BY off, ord) AS x FROM g GROUP BY 1)
      SELECT file, length(x)::BIGINT AS n_bytes, sha256(x) AS sha256 FROM t""",
    "innermost_range": "WITH " + _SPANS + """, p AS (SELECT user_id, event_id, date_diff('day', DATE '1990-01-01', ts::DATE) - 3650 + event_id % 700 AS d FROM events)
      SELECT event_id, (SELECT arg_min(ord, ("end" - "start", ord)) FROM spans WHERE key = user_id AND "start" <= d AND d <= "end") AS range_id FROM p""",
    "parent_ranges": "WITH " + _SPANS + """ SELECT x.ord AS id, arg_min(y.ord, (y."end" - y."start", y."start", -y.ord)) AS parent FROM spans x
      LEFT JOIN spans y ON x.key = y.key AND y.ord <> x.ord AND y."start" <= x."start" AND y."end" >= x."end" AND NOT (y."start" = x."start" AND y."end" = x."end" AND y.ord > x.ord) GROUP BY 1""",
    "conflict_pairs": "WITH " + _ACCESSES + " SELECT call, a_ord, b_ord, pick FROM pairs",
    "lift_plan": "WITH " + _ACCESSES + """, c AS (SELECT pairs.call, acc.outer_, arg_min(pick, (a_ord, b_ord)) AS ord FROM pairs JOIN acc ON acc.ord = pick WHERE NOT coalesce(apart, false) GROUP BY 1, 2)
      SELECT call, outer_ AS "outer", ord FROM c WHERE call NOT IN (SELECT call FROM c JOIN orders ON o_orderkey = ord WHERE o_totalprice >= 400000)""",
    "post_order": """WITH r AS (SELECT o_custkey AS file, o_orderkey * 10 AS id, o_orderkey AS o, 1 AS last FROM orders
        UNION SELECT o_custkey, l_orderkey * 10 + l_linenumber, l_orderkey, 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY o, last, id) - 1 AS place FROM r""",
    "item_uses": "WITH " + _SPANS + """, u AS (SELECT DISTINCT ord AS used, (SELECT arg_min(y.ord, (y."end" - y."start", y.ord)) FROM spans y WHERE y.key = x.key AND y."start" <= x."start" AND x."start" <= y."end") AS u FROM spans x)
      SELECT u AS user, string_agg(used, ',' ORDER BY used) AS items FROM u GROUP BY 1""",
    "dedupe_first": """WITH c AS (SELECT o_orderkey AS idx, o_custkey % 2 AS d, 'f' || o_custkey % 50 || CASE WHEN o_orderkey % 11 = 0 THEN '.S' ELSE '.c' END AS n FROM orders),
      k AS (SELECT min(idx) AS idx FROM c WHERE n LIKE '%.c' GROUP BY d, n)
      SELECT idx, CASE idx % 3 WHEN 0 THEN '/d' || d || '/' || n WHEN 1 THEN './x/../' || n ELSE n END AS file FROM c JOIN k USING (idx)""",
    "normal_paths": """WITH q AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS abs, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 THEN ['a'] WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN ['..'] ELSE [] END AS p,
        'd' || o_custkey % 5 AS d, o_orderkey % 5 < 2 AS up, o_orderkey % 7 < 3 AS up2, o_orderstatus AS st FROM orders),
      r AS (SELECT *, CASE WHEN NOT up THEN list_append(p, d) ELSE p END AS x FROM q),
      y AS (SELECT *, CASE WHEN NOT up2 THEN list_append(x, 'e') WHEN len(x) > 0 AND x[-1] <> '..' THEN x[:-2] ELSE list_append(x, '..') END AS z FROM r)
      SELECT o_orderkey, CASE WHEN abs THEN '/' ELSE '' END || array_to_string(list_append(z, st), '/') AS path FROM y""",
    "link_left_join": """WITH l AS (SELECT c_custkey AS link_idx, c_nationkey AS k, c_custkey % 2 AS o, unnest([{'p': 0::BIGINT, 'i': 'b/./n' || c_nationkey || '/x/../o' || c_custkey % 2}, {'p': 1, 'i': c_mktsegment}]) AS x FROM customer)
      SELECT link_idx, x.p AS pos, x.i AS input, CASE WHEN x.p = 0 THEN (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = k AND s_suppkey % 2 = o) END AS idx FROM l""",
    "leftover_anti": """SELECT s_suppkey AS idx FROM supplier s WHERE s_suppkey < (SELECT max(x.s_suppkey) FROM supplier x WHERE x.s_nationkey = s.s_nationkey AND x.s_suppkey % 2 = s.s_suppkey % 2)
      OR NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey % 2 = s_suppkey % 2)""",
    "common_ancestor": """WITH p AS (SELECT string_split(url, '/')[4] AS grp, string_split(url, '/') AS x FROM pages),
      g AS (SELECT grp, min(x) AS a, max(x) AS b FROM p WHERE grp IS NOT NULL GROUP BY 1)
      SELECT grp, array_to_string(a[:least(len(a) - 1, coalesce((SELECT min(i) - 1 FROM range(1, least(len(a), len(b)) + 1) t(i) WHERE a[i] <> b[i]), least(len(a), len(b))))], '/') AS ancestor FROM g""",
    "function_pairs": """WITH r AS (SELECT CASE c_nationkey WHEN 3 THEN 'main' ELSE 'f' || c_nationkey END AS name, arg_max(c_name, c_custkey) AS right_def FROM customer GROUP BY 1)
      SELECT name, s_name AS left_def, right_def FROM (SELECT CASE s_nationkey WHEN 3 THEN 'main' ELSE 'f' || s_nationkey END AS name, s_name FROM supplier WHERE s_nationkey <> 4) JOIN r USING (name)""",
    "agreed_signatures": """WITH g AS (SELECT l_orderkey AS key, min(l_returnflag) FILTER (l_linestatus = 'F') AS a, max(l_returnflag) FILTER (l_linestatus = 'F') AS b,
        min(l_returnflag) FILTER (l_linestatus <> 'F') AS c, max(l_returnflag) FILTER (l_linestatus <> 'F') AS d FROM lineitem GROUP BY 1)
      SELECT key, coalesce(a, c) AS signature FROM g WHERE CASE WHEN a IS NULL THEN c = d ELSE a = b END AND key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
    "declarations": """SELECT key, defn, decl, CASE WHEN defn <> defn2 THEN 'definitions differ' WHEN decls > 1 THEN 'several declarations' END AS problem FROM (
      SELECT o_custkey AS key, min(o_orderpriority) FILTER (o_orderstatus = 'F') AS defn, max(o_orderpriority) FILTER (o_orderstatus = 'F') AS defn2,
        min(o_orderpriority) FILTER (o_orderstatus <> 'F') AS decl, count(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'F') AS decls FROM orders GROUP BY 1)""",
    "equal_definitions": """SELECT o_custkey AS symbol, sha256(o_orderpriority || ' ' || o_orderstatus) AS token_hash, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1, 2""",
    "message_counts": """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'lint' WHEN l_partkey % 2 = 1 AND l_returnflag = 'R' THEN 'error' WHEN l_partkey % 2 = 1 AND l_returnflag = 'A' THEN 'warning' END AS kind FROM lineitem
      UNION ALL SELECT 'error') WHERE kind IS NOT NULL GROUP BY 1""",
    "source_metrics": """WITH l AS (SELECT l_linenumber AS stage, l_orderkey AS o, l_partkey % 10 <> 0 AS ink, l_partkey % 10 <> 0 AND l_linestatus <> 'O' AS fn, l_returnflag = 'R' AS u FROM lineitem)
      SELECT stage, count(DISTINCT o) AS files, count(*) FILTER (WHERE ink) AS lines, count(*) FILTER (WHERE fn) AS functions, count(*) FILTER (WHERE fn AND u) AS unsafe_functions,
        round_even(count(*) FILTER (WHERE fn AND u)::DOUBLE / count(*) FILTER (WHERE fn), 3) AS unsafe_ratio FROM l GROUP BY 1""",
    "step_times": """SELECT event_id, ((us - pv) * 1000) // 1000000 AS elapsed_ms FROM (
      SELECT event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv FROM events) WHERE pv IS NOT NULL""",
    "status_lists": "SELECT c_mktsegment AS status, string_agg(c_name, ',' ORDER BY c_name) AS names FROM customer GROUP BY 1",
    "duplicate_lines": "SELECT l_orderkey || ':' || l_linenumber AS name, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "highest_numbered": """WITH n AS (SELECT floor(abs(c_acctbal))::BIGINT AS n, floor(abs(c_acctbal))::BIGINT || '_' || c_name AS path FROM customer WHERE c_custkey % 3 <> 0)
      SELECT min(path) AS path FROM n WHERE n = (SELECT max(n) FROM n)""",
    "word_hashes": """WITH w AS (SELECT o_orderkey, unnest([(o_orderkey + 1)::HUGEINT * 4611686018427, o_custkey - 1000000, -o_orderkey::HUGEINT * 87178291199]) AS x, unnest([1, 2, 3]) AS i FROM orders),
      u AS (SELECT o_orderkey, list(((x % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 ORDER BY i) AS x FROM w GROUP BY 1),
      h AS (SELECT o_orderkey, list_reduce(list_prepend(0::HUGEINT, x), lambda h, w: (
          (((xor((((h + w + 524114809) % 18446744073709551616) % 1125899906842624) * 16384 + ((h + w + 524114809) % 18446744073709551616) // 1125899906842624, w) % 1125899906842624) * 16384
            + xor((((h + w + 524114809) % 18446744073709551616) % 1125899906842624) * 16384 + ((h + w + 524114809) % 18446744073709551616) // 1125899906842624, w) // 1125899906842624)).xor(524114809::HUGEINT) + w) % 18446744073709551616) AS h FROM u)
      SELECT o_orderkey, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM h""",
    "unique_places": """WITH p AS (SELECT p_partkey, p_name[1] AS c, p_size % 4 AS lo, CASE WHEN p_size % 3 > 0 THEN least(12, length(p_type)) ELSE length(p_type) END AS hi, p_type AS t FROM part),
      q AS (SELECT *, t[lo + 1:hi] AS x FROM p)
      SELECT p_partkey, CASE WHEN length(x) - length(replace(x, c, '')) = 1 THEN instr(x, c) - 1 + lo END AS at FROM q""",
    "config_remap": """WITH m AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT o_orderpriority AS c FROM orders UNION SELECT o_orderstatus FROM orders))
      SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN i END AS config_index FROM orders JOIN m ON c = o_orderpriority""",
    "cover_nested": """WITH l AS (SELECT l_partkey AS file, l_linenumber::BIGINT AS line, l_returnflag AS f, l_quantity > 25 AS hit FROM lineitem),
      ca AS (SELECT DISTINCT file, line FROM l WHERE f = 'A' AND hit), x AS (SELECT file, unnest(range(0, max(line) + 1)) AS line FROM ca GROUP BY file),
      n AS (SELECT * FROM x EXCEPT SELECT * FROM ca), u AS (SELECT DISTINCT file, line FROM l WHERE f <> 'A' AND hit),
      cs AS ((SELECT * FROM n EXCEPT SELECT * FROM u) UNION ALL (SELECT * FROM u EXCEPT SELECT * FROM n)),
      k AS (SELECT file, CASE WHEN bool_or(f = 'A') THEN 'A' WHEN bool_or(f = 'R') THEN 'R' ELSE 'N' END AS f FROM l GROUP BY 1),
      may AS (SELECT DISTINCT l.file, line FROM l JOIN k ON k.file = l.file AND k.f = l.f)
      SELECT file, (SELECT count(*) FROM cs WHERE cs.file = k.file) AS n_covered, (SELECT count(*) FROM may WHERE may.file = k.file) AS n_coverable,
        coalesce((SELECT string_agg(line, ',' ORDER BY line::VARCHAR) FROM cs WHERE cs.file = k.file), '') AS lines FROM k""",
    "cover_mismatches": """SELECT p_partkey AS file, p_brand AS left_hash, 'Brand#' || p_size % 5 + 1 || '1' AS right_hash FROM part
      WHERE p_partkey % 3 = 2 AND p_brand <> 'Brand#' || p_size % 5 + 1 || '1'""",
    "line_counts": "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents",
    "feature_names": """WITH v AS (SELECT o_custkey AS config, o_orderkey AS k, o_orderpriority IN ('1-URGENT', '5-LOW') AS b, o_orderstatus AS st FROM orders)
      SELECT config, coalesce(string_agg('V' || k || CASE WHEN b THEN '' ELSE '_' || st END, ',' ORDER BY k) FILTER (NOT b OR st IN ('F', 'O')), '') AS features FROM v GROUP BY 1""",
    "merged_dependencies": """WITH f AS (SELECT l_partkey AS name, l_linenumber::VARCHAR AS f FROM lineitem UNION SELECT l_partkey, l_linestatus FROM lineitem),
      a AS (SELECT l_partkey AS name, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS spec FROM lineitem GROUP BY 1)
      SELECT name, any_value(spec) AS spec, string_agg(f, ',' ORDER BY f) AS features FROM f JOIN a USING (name) GROUP BY 1""",
    "config_product": "SELECT n_nationkey, mode, log FROM nation, (SELECT unnest(['fast', 'small']) AS mode), (SELECT unnest(['on', 'off', 'auto']) AS log)",
    "name_hashes": """WITH h AS (SELECT p_partkey, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(p_name || '/' || p_type, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 33 + c) % 18446744073709551616) AS h FROM part)
      SELECT p_partkey, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM h""",
}
