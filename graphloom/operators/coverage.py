"""Set algebra over line coverage.

A set is three frames: files (file, config columns), and lines (file, line) that
are covered or coverable. Rows are the canonical form; bitmaps exist at the
edges only (``sources.bitmaps``). Lines count from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import numbered


@dataclass(frozen=True)
class CoverSet:
    files: DataFrame
    covered: DataFrame
    coverable: DataFrame

    def _lines(self, side: str) -> DataFrame:
        return getattr(self, side).select("file", "line")


def _metadata(a: CoverSet, b: CoverSet) -> tuple[DataFrame, DataFrame]:
    """Files of both and their coverable lines; a file of both keeps the left one's, uncombined."""
    extra = b.files.join(a.files.select("file"), "file", "left_anti")
    files = a.files.unionByName(extra, allowMissingColumns=True)
    return files, a._lines("coverable").union(b._lines("coverable").join(extra.select("file"), "file", "left_semi"))


def union(a: CoverSet, b: CoverSet) -> CoverSet:
    files, coverable = _metadata(a, b)
    return CoverSet(files, a._lines("covered").union(b._lines("covered")).distinct(), coverable)


def intersection(a: CoverSet, b: CoverSet) -> CoverSet:
    """Files of both sets only; one without common lines stays, empty."""
    files = a.files.join(b.files.select("file"), "file", "left_semi")
    return CoverSet(files, a._lines("covered").join(b._lines("covered"), ["file", "line"], "left_semi"), a._lines("coverable").join(files.select("file"), "file", "left_semi"))


def difference(a: CoverSet, b: CoverSet) -> CoverSet:
    return CoverSet(a.files, a._lines("covered").join(b._lines("covered"), ["file", "line"], "left_anti"), a.coverable)


def symmetric_difference(a: CoverSet, b: CoverSet) -> CoverSet:
    files, coverable = _metadata(a, b)
    x, y = a._lines("covered"), b._lines("covered")
    return CoverSet(files, x.join(y, ["file", "line"], "left_anti").union(y.join(x, ["file", "line"], "left_anti")), coverable)


def negate(a: CoverSet) -> CoverSet:
    """Flips the lines up to the last covered one of each file; what lies behind stays uncovered, as do empty files."""
    tops = a.covered.groupBy("file").agg(F.max("line").alias("top"))
    every = tops.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("line"))
    return CoverSet(a.files, every.join(a._lines("covered"), ["file", "line"], "left_anti"), a.coverable)


def mismatches(a: CoverSet, b: CoverSet, column: str = "expanded_hash") -> DataFrame:
    """Files of both sets whose hashes are given on both sides and differ."""
    x, y = (s.files.select("file", F.col(column).alias(n)) for s, n in ((a, "left_hash"), (b, "right_hash")))
    return x.join(y, "file").filter("left_hash <> '' AND right_hash <> '' AND left_hash <> right_hash")


def require_same(a: CoverSet, b: CoverSet, column: str = "expanded_hash") -> DataFrame:
    """The left files; an error, when read, if a hash differs."""
    bad = mismatches(a, b, column).select("file", F.lit(True).alias("bad"))
    return a.files.join(bad, "file", "left").filter(F.coalesce(F.assert_true(F.col("bad").isNull(), F.lit("expanded hashes differ")).cast("boolean"), F.lit(True))).drop("bad")


def per_file(a: CoverSet) -> DataFrame:
    """(file, n_covered, n_coverable) of every file."""
    n = lambda side: getattr(a, side).groupBy("file").agg(F.count("*").alias(f"n_{side}"))
    out = a.files.select("file").join(n("covered"), "file", "left").join(n("coverable"), "file", "left")
    return out.select("file", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_covered", "n_coverable")))


def totals(a: CoverSet) -> DataFrame:
    """Sums and their ratio, 0 if nothing is coverable; the ratio may exceed 1, as coverable lines are never combined."""
    return per_file(a).agg(F.coalesce(F.sum("n_covered"), F.lit(0)).alias("n_covered"), F.coalesce(F.sum("n_coverable"), F.lit(0)).alias("n_coverable")).withColumn(
        "ratio", F.when(F.col("n_coverable") > 0, F.col("n_covered") / F.col("n_coverable")).otherwise(0.0)
    )


def line_markers(a: CoverSet, lines: DataFrame) -> DataFrame:
    """(file, line, marker): plus if covered, minus if only coverable, else blank."""
    c = a._lines("covered").withColumn("hit", F.lit(True))
    o = a._lines("coverable").distinct().withColumn("may", F.lit(True))
    return lines.join(c, ["file", "line"], "left").join(o, ["file", "line"], "left").select(
        "file", "line", F.when(F.col("hit"), "+").when(F.col("may"), "-").otherwise(" ").alias("marker")
    )


def merge_configs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(config, index): the distinct configs of both, numbered from 0 in order."""
    return numbered(a.select("config").union(b.select("config")).distinct(), "config", "index")


def remapped(files: DataFrame, configs: DataFrame, merged: DataFrame, column: str = "config_index") -> DataFrame:
    """``files`` with their index into ``configs`` (config, index) put as the index into ``merged``; files without one stay as they are."""
    new = configs.select(F.col("index").alias("__old__"), "config").join(merged.select("config", F.col("index").alias("__new__")), "config").drop("config")
    rest = [F.col("__new__").alias(c) if c == column else F.col(c) for c in files.columns]
    return files.join(new, F.col(column) == F.col("__old__"), "left").select(*rest)


def report(a: CoverSet, lines: DataFrame | None = None) -> tuple[CoverSet, DataFrame]:
    """The set itself, and what to print of it: sums, or with ``lines`` (file, line) a marker for each line."""
    return a, totals(a) if lines is None else line_markers(a, lines)


def line_count(text: Column) -> Column:
    """Lines of a text, an empty one after a final newline included."""
    return F.size(F.split(text, "\n", -1))


def lines_from_segments(segments: DataFrame) -> DataFrame:
    """(file, line, covered) of coverable lines, from (file, line, col, count, has_count), lines from 1.

    A segment's count holds up to the next segment. A segment that starts right
    behind the end of its line (``line_len``, if given) counts from the next line
    on; one that is followed by a segment at column 1 ends on the line before. The
    last segment counts for its own line if its count is above 0. Counts may be
    whole numbers written as text; a segment with any other count is left out, and
    so is one with a line below 1. One without a count is neither covered nor coverable.
    """
    order = Window.partitionBy("file").orderBy("line", "col")
    count = F.when(F.col("count").cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.col("count").cast("string")).try_cast("decimal(38,0)"))
    s = segments.withColumn("n", F.when(F.col("has_count"), count).otherwise(0)).filter("n IS NOT NULL AND line > 0")
    s = s.withColumns({"col": F.coalesce("col", F.lit(1)), "next_line": F.lead("line").over(order), "next_col": F.lead(F.coalesce("col", F.lit(1))).over(order)})
    first = F.col("line")
    if "line_len" in segments.columns:
        first = F.when(F.col("col") == F.col("line_len") + 1, F.col("line") + 1).otherwise(first)
    final = F.when(F.col("next_col") == 1, F.col("next_line") - 1).otherwise(F.col("next_line"))
    upto = F.when(F.col("next_line").isNotNull(), final).when(F.col("n") > 0, F.col("first"))
    each = s.withColumn("first", first).withColumn("upto", upto).filter("has_count AND upto >= first")
    each = each.select("file", F.explode(F.sequence("first", "upto")).alias("at"), "n")
    return each.groupBy("file", (F.col("at") - 1).cast("long").alias("line")).agg(F.bool_or(F.col("n") > 0).alias("covered"))


def config_product(variables: dict[str, list[str]], frame: DataFrame) -> DataFrame:
    """One row for every choice of one value a variable; the product is asked for, its size that of the lists."""
    out = frame
    for name, values in variables.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def preset_values(presets: dict[str, dict], name: str, path: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """A preset's variables with those of its parents; of two parents the later one wins, the preset itself over both."""
    if name in path:
        raise ValueError(f"presets inherit in a cycle: {' -> '.join((*path, name))}")
    own = presets[name]
    out: dict[str, list[str]] = {}
    for parent in own.get("inherits", ()):
        out |= preset_values(presets, parent, (*path, name))
    return out | own.get("values", {})


def feature_names(frame: DataFrame) -> DataFrame:
    """(config, features) from (config, ord, variable, value, boolean), features in order of ``ord``, spelled as the variables are.

    A variable all of whose allowed values are booleans (``boolean``) gives its
    bare name if the value is ON or TRUE in any case, else nothing; others give name_value.
    """
    bare = F.when(F.upper("value").isin("ON", "TRUE"), F.col("variable"))
    feature = F.when(F.col("boolean"), bare).otherwise(F.concat("variable", F.lit("_"), "value"))
    every = F.array_sort(F.collect_list(F.when(feature.isNotNull(), F.struct("ord", feature.alias("feature")))))
    return frame.groupBy("config").agg(F.transform(every, lambda x: x["feature"]).alias("features"))


def merged_dependencies(specs: DataFrame) -> DataFrame:
    """(name, spec, features) from (name, ord, spec, features): the first spec, all features in order."""
    each = specs.select("name", "ord", "spec", F.explode_outer("features").alias("f"))
    return each.groupBy("name").agg(F.min_by("spec", "ord").alias("spec"), F.array_sort(F.collect_set("f")).alias("features"))
