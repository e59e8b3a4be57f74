"""Keyed merges: deduplication by order, link joins, agreement of definitions, build targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import joined_path, normal_path


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each key the first row in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n__", n).filter("__n__ = 1").drop("__n__")


def compile_commands(rows: DataFrame, pattern: str | None = None) -> DataFrame:
    """Commands whose file matches, without assembly; one for each absolute file, the first.

    A relative file is seen from the command's directory.
    """
    kept = rows.filter(~F.col("file").rlike(r"\.[sS]$"))
    kept = (kept if pattern is None else kept.filter(F.col("file").rlike(pattern))).withColumn("__file__", normal_path(joined_path(F.col("directory"), F.col("file"))))
    return first_by(kept, ["__file__"], ["idx"]).drop("__file__")


def linked(links: DataFrame, commands: DataFrame) -> DataFrame:
    """(link_idx, pos, input, idx) of every link input; idx is the last command with that output, null if none has it.

    ``links`` is (idx, directory, inputs), ``commands`` (idx, directory, output).
    An input is seen from its link's directory and an output from its command's,
    so one object that two directories spell differently is one path.
    """
    place = lambda c: normal_path(joined_path(F.col("directory"), F.col(c)))
    by_output = commands.filter("output IS NOT NULL").groupBy(place("output").alias("__path__")).agg(F.max("idx").alias("idx"))
    each = links.select(F.col("idx").alias("link_idx"), "directory", F.posexplode("inputs").alias("pos", "input")).withColumn("__path__", place("input"))
    return each.join(by_output, "__path__", "left").select("link_idx", "pos", "input", "idx")


def leftovers(commands: DataFrame, joined: DataFrame) -> DataFrame:
    """Commands that no link uses: one more group, at the top."""
    used = joined.filter("idx IS NOT NULL").select("idx").distinct()
    return commands.join(used, "idx", "left_anti")


def common_ancestor(paths: DataFrame, group: str, path: str = "path", order: str | None = None, links: str | None = None) -> DataFrame:
    """(group, ancestor): the folder of a group's first file, cut to the leading parts that all its files share.

    A file is never its own ancestor. Of paths in order of parts the lowest and the
    highest differ no later than any two do. The first file is the one of the
    lowest ``order``, else the lowest path; null paths do not count. Files under
    the folder ``links`` stand for links: they are passed over, but for the first file.
    """
    parts = F.split(path, "/")
    link = F.lit(False) if links is None else F.coalesce(F.col(path).startswith(f"{links}/") | (F.col(path) == links), F.lit(False))
    first = F.min_by(parts, F.struct(order, path)) if order else F.min(parts)
    counted = F.when(~link, parts)
    ends = paths.filter(F.col(path).isNotNull()).groupBy(group).agg(F.min(counted).alias("low"), F.max(counted).alias("high"), first.alias("first"))
    ends = ends.select(group, F.least("low", "first").alias("a"), F.greatest("high", "first").alias("b"), F.size("first").alias("n"))
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    stop = F.array_position(same, F.lit(False))
    shared = F.when(stop > 0, stop - 1).otherwise(F.least(F.size("a"), F.size("b")))
    return ends.select(group, F.array_join(F.slice("a", 1, F.least(shared, F.col("n") - 1).cast("int")), "/").alias("ancestor"))


def function_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, left_def, right_def): definitions of one name; left ``main`` goes, ``main_0`` counts as main; the last right one wins."""
    l = left.filter("name <> 'main'").withColumn("name", F.when(F.col("name") == "main_0", "main").otherwise(F.col("name")))  # noqa: E741
    r = right.groupBy("name").agg(F.max_by("definition", "ord").alias("right_def"))
    return l.join(r, "name").select("name", F.col("definition").alias("left_def"), "right_def")


def agreed_signatures(rows: DataFrame) -> DataFrame:
    """(key, signature) of keys on whose signature all definitions agree, or, without any, all declarations."""
    n = rows.groupBy("key").agg(
        *(f(F.when(F.col("is_defn") == d, F.col("signature"))).alias(f"{name}{int(d)}") for d in (True, False) for f, name in ((F.min, "low"), (F.max, "high")))
    )
    pick = F.when(F.col("low1").isNotNull(), F.when(F.col("low1") == F.col("high1"), F.col("low1"))).otherwise(F.when(F.col("low0") == F.col("high0"), F.col("low0")))
    return n.select("key", pick.alias("signature")).filter("signature IS NOT NULL")


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("key").distinct(), "key", "left_anti")


def declarations_by_header(rows: DataFrame) -> DataFrame:
    """(key, defn, decl, problem): a key's definition and its declaration; problem says if texts differ or several declarations stand."""
    text = lambda d: F.when(F.col("is_defn") == d, F.col("text"))
    n = rows.groupBy("key").agg(
        F.min(text(True)).alias("defn"), F.max(text(True)).alias("defn2"), F.min(text(False)).alias("decl"), F.count_distinct(text(False)).alias("decls")
    )
    problem = F.when(F.col("defn") != F.col("defn2"), "definitions differ").when(F.col("decls") > 1, "several declarations")
    return n.select("key", "defn", "decl", problem.alias("problem"))


def grouped_first(rows: DataFrame, key: str, order: str, listed: str) -> DataFrame:
    """One row a key: the first row's other columns, and all of ``listed`` in order."""
    others = [c for c in rows.columns if c not in (key, order, listed)]
    out = rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("f"), F.transform(F.array_sort(F.collect_list(F.struct(order, listed))), lambda x: x[listed]).alias(listed))
    return out.select(key, "f.*", listed)


def equal_definitions(tokens: DataFrame) -> DataFrame:
    """(symbol, token_hash, members): definitions of one symbol with the same tokens."""
    return tokens.groupBy("symbol", F.sha2(F.array_join("tokens", " "), 256).alias("token_hash")).agg(F.array_sort(F.collect_list("id")).alias("members"))


def build_targets(compiles: DataFrame, links: DataFrame) -> DataFrame:
    """(target, kind, inputs): link targets with the sources of their inputs; without links, one target an object.

    Outputs of compile commands are unique, and so are link targets once a
    linker's own command has given way to its driver's; else reading fails.
    """
    n = Window.partitionBy("output")
    objects = compiles.withColumn("n", F.count("*").over(n)).filter(F.coalesce(F.assert_true(F.col("n") == 1, F.lit("an object has two commands")).cast("boolean"), F.lit(True)))
    driver = F.max(F.col("is_driver").cast("int")).over(n) == 1
    tied = links.withColumn("driver", driver).filter("is_driver OR NOT driver")
    tied = tied.withColumn("n", F.count("*").over(n)).filter(F.coalesce(F.assert_true(F.col("n") == 1, F.lit("a target has two commands")).cast("boolean"), F.lit(True)))
    each = tied.select(F.col("output").alias("target"), "kind", F.posexplode("inputs").alias("pos", "input"))
    each = each.join(objects.select(F.col("output").alias("input"), "file"), "input", "left").groupBy("target", "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("file", "input").alias("x")))), lambda s: s["x"]).alias("inputs")
    )
    any_link = links.limit(1).select(F.lit(True).alias("some"))
    alone = objects.join(any_link, F.lit(True), "left_anti").select(F.col("output").alias("target"), F.lit("object").alias("kind"), F.array("file").alias("inputs"))
    return each.union(alone)


def merged_items(base: DataFrame, new: DataFrame, overwrite_only: bool = False) -> DataFrame:
    """(path, text): a map of items with another merged over it, or only where a path exists already."""
    b, n = base.select("path", F.col("text").alias("old")), new.select("path", F.col("text").alias("put"))
    return b.join(n, "path", "left" if overwrite_only else "full").select("path", F.coalesce("put", "old").alias("text"))


def split_items(texts: DataFrame, marker: str = r"^//@ (\S+)$") -> DataFrame:
    """(source, path, text): texts cut at marker lines that name the path of what follows; what stands before the first one has an empty path.

    ``texts`` is (source, text). The markers are not part of the pieces; of a path
    that comes twice the later piece counts, as in a map.
    """
    cut_at = f"(?m){marker}\n?"
    pieces = F.split("text", cut_at, -1)
    names = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?m){marker}"), 1))
    each = texts.select("source", F.posexplode(F.arrays_zip(names.alias("path"), pieces.alias("text"))).alias("pos", "x")).select("source", "pos", "x.path", "x.text")
    return each.filter("path <> '' OR text <> ''").groupBy("source", "path").agg(F.max_by("text", "pos").alias("text"))


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    """A value whose structs have their fields by name, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.struct(*(_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def cache_key(df: DataFrame, columns: list[str]) -> Column:
    """The key of a cached result: SHA-256 of the JSON of some columns, keys in order of name at every depth, nulls written out."""
    row = F.struct(*(_sorted_fields(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def cached(df: DataFrame, columns: list[str], store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key a store (key, ...) has, with what it keeps for them, and the rows to be computed, both with ``key``."""
    keyed = df.withColumn("key", cache_key(df, columns))
    return keyed.join(store, "key"), keyed.join(store, "key", "left_anti")


def pruned_cache(entries: DataFrame, now: int, max_age: int) -> DataFrame:
    return entries.filter(F.lit(now) - F.col("created") <= max_age)
