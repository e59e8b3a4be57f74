"""Intervals and text edits: overlap buckets, edit checks, offset maps, application.

Edits are (file, ord, off, len, text); offsets count bytes in the original.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_buckets(rows: DataFrame, key: str = "key", header: str = "header") -> DataFrame:
    """(key, header, start, end, n, is_defn): runs in which each interval of a header starts before the one before it ends.

    ``rows`` is (key, header, start, end, is_defn) and may have text. Entries that are equal in all of
    these count once. The comparison is with the
    previous entry, not with the furthest end so far. A key of one entry keeps it;
    of a key with several entries, in whatever headers, runs of one are left out.
    Where rows have a text, as long as the interval, a run's text is added: that of the
    first entry that spans the run, else the entries' texts laid over each other in order.
    """
    entry = ["start", "end", *(c for c in ("text", "is_defn") if c in rows.columns)]
    order = Window.partitionBy(key, header).orderBy(*entry)
    opens = F.when(F.col("start") < F.lag("end").over(order), 0).otherwise(1)
    b = rows.select(key, header, *entry).distinct().withColumn("opens", opens).withColumn("bucket", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = [F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("texts")] if "text" in entry else []
    b = b.groupBy(key, header, "bucket").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.bool_or("is_defn").alias("is_defn"), *texts)
    if texts:
        whole = F.filter("texts", lambda t: (t["start"] == F.col("start")) & (t["end"] == F.col("end")))
        tail = lambda acc, t: F.substring(acc, (t["end"] - F.col("start") + 1).cast("int"), F.char_length(acc))
        laid = F.aggregate("texts", F.lit(""), lambda acc, t: F.concat(F.substring(acc, F.lit(1), (t["start"] - F.col("start")).cast("int")), t["text"], tail(acc, t)))
        b = b.withColumn("text", F.when(F.size(whole) > 0, whole[0]["text"]).otherwise(laid)).drop("texts")
    total = F.sum("n").over(Window.partitionBy(key))
    return b.withColumn("total", total).filter("n > 1 OR total = 1").drop("total", "bucket")


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(l, r): pairs of rows of equal key whose intervals from ``start`` to ``end``, exclusive, overlap; both are whole rows.

    An empty interval overlaps those that it lies strictly inside. Intervals are
    dealt to cells as wide as they are, rounded up to a power of two: one touches two
    cells of its own width at most, and two of any wider one. The wider one of
    a pair stays in its cells, the narrower one looks there, for each width that
    its key has; a pair counts in the cell where the later of the two starts. So the
    join is on equality, and what meets in a cell is near, however many
    intervals a key has. Null keys and ends match nothing.
    """
    wide = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double"))).cast("int")
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), "level")).cast("long")
    cells = F.explode(F.array_distinct(F.array(cell(F.col("start")), cell(F.greatest("start", F.col("end") - 1))))).alias("cell")
    rows = lambda df: df.select(F.col(key).alias("k"), "start", "end", F.struct(*df.columns).alias("row"), wide.alias("own"))

    def meet(narrow: DataFrame, wider: DataFrame, strictly: bool) -> DataFrame:
        w = wider.withColumn("level", F.col("own")).select("k", "level", F.col("start").alias("ws"), F.col("end").alias("we"), F.col("row").alias("w"), cells)
        levels = wider.select("k", F.col("own").alias("level")).distinct()
        n = narrow.join(levels, "k").filter(F.col("own") < F.col("level") if strictly else F.col("own") <= F.col("level"))
        n = n.select("k", "level", F.col("start").alias("ns"), F.col("end").alias("ne"), F.col("row").alias("n"), cells)
        later = F.floor(F.greatest("ns", "ws") / F.pow(F.lit(2.0), "level")).cast("long")
        return n.join(w, ["k", "level", "cell"]).filter((F.col("ns") < F.col("we")) & (F.col("ws") < F.col("ne")) & (F.col("cell") == later))

    a, b = rows(left), rows(right)
    return meet(a, b, False).select(F.col("n").alias("l"), F.col("w").alias("r")).union(meet(b, a, True).select(F.col("w").alias("l"), F.col("n").alias("r")))


def sorted_edits(edits: DataFrame) -> DataFrame:
    """Edits in order of offset, those of one offset as given, numbered per file."""
    return edits.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("off", "ord")))


def out_of_bounds(edits: DataFrame, files: DataFrame) -> DataFrame:
    return edits.join(files.select("file", F.octet_length("content").alias("size")), "file").filter("off < 0 OR len < 0 OR off + len > size").drop("size")


def distinct_edits(edits: DataFrame) -> DataFrame:
    """Replacements that are equal count once, the first; insertions are never merged."""
    n = F.row_number().over(Window.partitionBy("file", "off", "len", "text").orderBy("ord"))
    return edits.withColumn("n", n).filter("n = 1 OR len = 0").drop("n")


def conflicts(edits: DataFrame) -> DataFrame:
    """(file, first, second): neighbouring replacements that overlap, after equal ones are merged; touching is fine."""
    order = Window.partitionBy("file").orderBy("off", "ord")
    r = distinct_edits(edits).filter("len > 0").withColumns({"pe": F.lag(F.col("off") + F.col("len")).over(order), "first": F.lag("ord").over(order)})
    return r.filter("off < pe").select("file", "first", F.col("ord").alias("second"))


def split_insertions(edits: DataFrame) -> DataFrame:
    """(file, insertion, replacement): insertions strictly inside a replacement.

    Of replacements that do not overlap, only the last to start before an
    insertion can hold it, so a running maximum finds it without a range join.
    """
    order = Window.partitionBy("file").orderBy("off", F.col("len") > 0, "ord").rowsBetween(Window.unboundedPreceding, -1)
    held = F.max(F.when(F.col("len") > 0, F.struct("off", (F.col("off") + F.col("len")).alias("end"), "ord"))).over(order)
    r = edits.withColumn("r", held)
    return r.filter("len = 0 AND r.off < off AND off < r.end").select("file", F.col("ord").alias("insertion"), F.col("r.ord").alias("replacement"))


def map_offsets(offsets: DataFrame, edits: DataFrame) -> DataFrame:
    """Append ``new`` to (file, at): the place after all edits that start before it and end at or before it; null inside one.

    An insertion at the offset itself does not move it. One sorted pass over
    edits and offsets together; no pair of them is made.
    """
    at_end = F.when(F.col("len") > 0, 0).otherwise(2)  # at one place: replacements that end there, offsets, insertions
    e = edits.select("file", (F.col("off") + F.col("len")).alias("at"), (F.octet_length("text") - F.col("len")).cast("long").alias("grown"), F.col("off").alias("from"), at_end.alias("side"))
    o = offsets.select("file", "at", F.lit(None).cast("long").alias("grown"), F.lit(None).cast("long").alias("from"), F.lit(1).alias("side"))
    order = Window.partitionBy("file").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("file").orderBy("at", "side").rowsBetween(1, Window.unboundedFollowing)
    both = e.union(o).withColumns({"moved": F.coalesce(F.sum("grown").over(order), F.lit(0)), "next": F.min("from").over(after)})
    inside = F.col("next") < F.col("at")
    return both.filter("side = 1").select("file", "at", F.when(~F.coalesce(inside, F.lit(False)), F.col("at") + F.col("moved")).alias("new"))


def edited_ranges(edits: DataFrame) -> DataFrame:
    """(file, off, len, new_start, new_end): where each replacement stands after all edits of its file."""
    order = Window.partitionBy("file").orderBy("off", "ord").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text")
    start = F.col("off") + F.coalesce(F.sum(size - F.col("len")).over(order), F.lit(0))
    return edits.withColumn("new_start", start).select("file", "off", "len", "new_start", (F.col("new_start") + size).alias("new_end"))


def unique_place(text: Column, part: Column, begin: Column | None = None, end: Column | None = None) -> Column:
    """Where ``part`` stands in the characters from ``begin`` to ``end`` of ``text`` (from 0), if it does so once.

    Null for none or several, overlapping ones too, and for an empty part. A
    negative or missing end is the text's end.
    """
    size = F.char_length(text)
    low = F.lit(0) if begin is None else F.greatest(begin, F.lit(0))
    high = size if end is None else F.when(end >= 0, F.least(end, size)).otherwise(size)
    within = F.substring(text, low + 1, F.greatest(high - low, F.lit(0)))
    at = F.instr(within, part)
    again = F.instr(F.substring(within, at + 1, size), part)
    return F.when((F.char_length(part) > 0) & (at > 0) & (again == 0), at - 1 + low)


def replicated_edits(edits: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, ord, off, len, text): all edits, and those inside a definition once more for each one of its ``group`` in another file.

    ``definitions`` is (group, def_file, start, end). A copy stands at the same
    distance from the start; equal edits of a file are one, with the least ord. An edit over a
    definition's edge is an error when read; one that only touches it is outside.
    """
    e = edits.select("file", "ord", "len", "text", F.col("off").alias("start"), (F.col("off") + F.col("len")).alias("end"))
    d = definitions.select("group", F.col("def_file").alias("file"), "start", "end")
    inside = overlaps(e, d, "file")
    whole = F.assert_true((F.col("l.start") >= F.col("r.start")) & (F.col("l.end") <= F.col("r.end")), F.lit("an edit crosses a definition's edge"))
    based = inside.filter(F.coalesce(whole.cast("boolean"), F.lit(True))).select("r.group", F.col("l.file").alias("of"), (F.col("l.start") - F.col("r.start")).alias("rel"), "l.len", "l.text", "l.ord")
    copies = based.join(d, "group").filter("file <> of").select("file", "ord", (F.col("start") + F.col("rel")).alias("off"), "len", "text")
    return edits.select("file", "ord", "off", "len", "text").union(copies).groupBy("file", "off", "len", "text").agg(F.min("ord").alias("ord")).select("file", "ord", "off", "len", "text")


def erased(text: Column, off: Column, length: Column) -> Column:
    """The text with a span put as spaces of the same length."""
    return F.overlay(text, F.repeat(F.lit(" "), length), off + 1, length)


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, content) after all edits, one task a file.

    Equal replacements count once; at one offset insertions come before a
    replacement, in the order given. Conflicts are errors.
    """
    e = distinct_edits(edits).select("file", "ord", "off", "len", F.encode("text", "utf-8").alias("text"))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for content in left["content"]:
            parts, at = [], 0
            for r in right.assign(repl=right["len"] > 0).sort_values(["off", "repl", "ord"], kind="stable").itertuples():
                if r.off < at or r.off + r.len > len(content):
                    raise ValueError(f"{key[0]}: edit at {r.off} overlaps another or leaves the file")
                parts += [content[at : r.off], r.text]
                at = r.off + r.len
            out.append(b"".join([*parts, content[at:]]))
        return pd.DataFrame({"file": key[0], "content": out})

    return files.groupBy("file").cogroup(e.groupBy("file")).applyInPandas(run, "file string, content binary")
