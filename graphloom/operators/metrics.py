"""Code metrics, message counts, step records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(part, whole, places: int = 3):
    """Half-even rounding, as the measuring scripts round."""
    return F.bround(part / whole, places)


def source_metrics(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """files, lines, functions, unsafe_functions, unsafe_ratio of (path, line) rows.

    White space at a line's end, of any kind, is dropped first; empty lines do not
    count. A function is a line with ``fn `` and ``(`` that does not end in ``;``.
    A build script at the root is left out. Without functions the ratio is an
    error, as it has no value.
    """
    text = F.regexp_replace("line", r"(?U)[\s\x1c-\x1f]+$", "")
    is_fn = text.contains("fn ") & text.contains("(") & ~text.endswith(";")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = lines.filter("path <> 'build.rs'").groupBy(*(by or [])).agg(
        F.count_distinct("path").alias("files"),
        one(text != "").alias("lines"),
        one(is_fn).alias("functions"),
        one(is_fn & text.contains("unsafe ")).alias("unsafe_functions"),
    )
    value = F.when(F.col("functions") == 0, F.raise_error(F.lit("no functions")).cast("double")).otherwise(ratio(F.col("unsafe_functions"), F.col("functions")))
    return rows.withColumn("unsafe_ratio", value)


def message_counts(messages: DataFrame, failed: bool = False) -> DataFrame:
    """(kind, n): lints by their code, other messages by level, errors and warnings only; a failed run is one more error.

    Messages without a code are summaries of others and do not count.
    """
    lint = F.col("code").startswith("clippy::")
    kinds = messages.filter("code IS NOT NULL").select(F.when(lint, "lint").when(F.col("level").isin("error", "warning"), F.col("level")).alias("kind")).filter("kind IS NOT NULL")
    if failed:
        kinds = kinds.union(messages.sparkSession.range(1).select(F.lit("error")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def step_times(steps: DataFrame) -> DataFrame:
    """Append elapsed_ms, whole milliseconds below the nanoseconds between start_ns and end_ns."""
    return steps.withColumn("elapsed_ms", F.floor((F.col("end_ns") - F.col("start_ns")) / 1_000_000).cast("long"))


def measuring_time(runs: DataFrame) -> DataFrame:
    return runs.withColumn("measurement_ms", F.col("total_ms") - F.col("translation_ms"))


def converged(runs: DataFrame) -> DataFrame:
    return runs.withColumn("converged", F.col("corpus") - F.col("diverged"))


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def counters(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def status_lists(rows: DataFrame) -> DataFrame:
    """(status, names): names of each status, in order."""
    return rows.groupBy("status").agg(F.array_sort(F.collect_list("name")).alias("names"))


def highest_numbered(paths: DataFrame) -> DataFrame:
    """The path whose name begins with the highest number before an underscore; of equal numbers the lowest path; others do not count."""
    n = F.regexp_extract("path", r"^(?:.*/)?([0-9]+)_[^/]*$", 1).try_cast("decimal(38,0)")
    top = paths.select("path", n.alias("n")).filter("n IS NOT NULL").agg(F.min_by("path", F.struct((-F.col("n")).alias("n"), "path")).alias("path"))
    return top.filter("path IS NOT NULL")
