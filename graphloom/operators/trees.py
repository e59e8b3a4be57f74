"""Selection over a tree of nodes, and labels on nodes.

``nodes`` has id, parent and attribute columns. A selection is a frame (id),
distinct; ``marks`` is (id, label). Predicates are Columns over node
attributes; build them with ``truth`` so that an attribute that a node lacks is
false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import below, cut, over_subtrees

#: Kinds that the general kind holds.
ITEM_LIKE = ("item", "trait_item", "impl_item", "foreign_item")


def truth(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_kind(kind: str) -> Column:
    if kind == "any":
        return F.lit(True)
    return truth(F.col("kind").isin(*ITEM_LIKE) if kind == "itemlike" else F.col("kind") == kind)


#: Names of kinds of nodes and of items (fixed values); a name in both lists stands for the node's kind. ``arg`` is ``param``.
NODE_KINDS = ("any", "itemlike", "item", "trait_item", "impl_item", "foreign_item", "stmt", "expr", "pat", "ty", "param", "arg", "field")
ITEM_KINDS = (
    "extern_crate", "use", "static", "const", "fn", "mod", "foreign_mod", "inline_asm", "ty", "opaquety", "enum",
    "struct", "union", "trait", "trait_alias", "impl", "mac", "macro_def",
)


def is_item_kind(kind: str) -> Column:
    return truth(F.col("item_kind") == kind)


def is_named_kind(name: str) -> Column:
    """The test that a bare name stands for."""
    if name in NODE_KINDS:
        return is_kind("param" if name == "arg" else name)
    if name in ITEM_KINDS:
        return is_item_kind(name)
    raise ValueError(f"{name} is neither a kind of node nor of item")


def is_public() -> Column:
    """False where a node has no visibility."""
    return truth(F.col("vis") == "pub")


def is_mutable() -> Column:
    """False where mutability does not apply."""
    return truth(F.col("mutbl") == "mut")


def name_is(pattern: str) -> Column:
    """The whole name matches; a node without a name does not."""
    return truth(F.col("name").rlike(f"^(?:{pattern})$"))


def path_is(prefix: int, path: list[str], column: str = "path") -> Column:
    """Equality of the path without its first ``prefix`` segments."""
    rest = F.slice(F.col(column), prefix + 1, F.greatest(F.size(column) - prefix, F.lit(0)))
    return truth((F.size(column) >= prefix) & (rest == F.array(*map(F.lit, path)).cast("array<string>")))


def has_attr(name: str, column: str = "attrs") -> Column:
    return truth(F.array_contains(column, name))


def root(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent IS NULL").select("id")


def item(nodes: DataFrame, path: list[str]) -> DataFrame:
    """The node of an absolute path; an error if there is none."""
    found = nodes.filter(path_is(0, path)).select("id")
    n = found.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") > 0, F.lit(f"no item {'::'.join(path)}")).alias("ok"))
    return found.crossJoin(F.broadcast(n)).select("id")


def added(selection: DataFrame, more: DataFrame) -> DataFrame:
    return selection.select("id").union(more.select("id")).distinct()


def child(selection: DataFrame, nodes: DataFrame, want: Column) -> DataFrame:
    """Direct children that match; they replace the selection."""
    s = selection.select(F.col("id").alias("sel"))
    return nodes.filter(want).join(s, nodes["parent"] == s["sel"], "left_semi").select("id").distinct()


def _parents(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent IS NOT NULL").select("id", F.col("parent").alias("up"))


def descendants(selection: DataFrame, nodes: DataFrame) -> DataFrame:
    """All strict descendants; a selected node is one only below another selected node."""
    up = cut(_parents(nodes))
    kids = up.join(selection.select(F.col("id").alias("up")), "up", "left_semi").select("id")
    return below(up, kids, [])


def desc(selection: DataFrame, nodes: DataFrame, want: Column) -> DataFrame:
    return nodes.filter(want).join(descendants(selection, nodes), "id", "left_semi").select("id")


def keep(selection: DataFrame, nodes: DataFrame, want: Column) -> DataFrame:
    return nodes.filter(want).join(selection, "id", "left_semi").select("id")


def first(selection: DataFrame) -> DataFrame:
    return selection.agg(F.min("id").alias("id")).filter("id IS NOT NULL")


def last(selection: DataFrame) -> DataFrame:
    return selection.agg(F.max("id").alias("id")).filter("id IS NOT NULL")


def with_child_tests(nodes: DataFrame, want: Column) -> DataFrame:
    """Append any_child and every_child for a predicate; without children these are false and true."""
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.bool_or(want).alias("some"), F.bool_and(want).alias("every"))
    return nodes.join(kids, nodes["id"] == kids["p"], "left").select(nodes["*"], F.coalesce("some", F.lit(False)).alias("any_child"), F.coalesce("every", F.lit(True)).alias("every_child"))


def with_desc_tests(nodes: DataFrame, want: Column) -> DataFrame:
    """Append any_desc and every_desc for a predicate.

    Both kinds of nodes, those that match and those that do not, are counted over
    subtrees in one run.
    """
    up = cut(_parents(nodes))
    hit = F.coalesce(want, F.lit(False))
    seed = nodes.select("id", hit.alias("some"), (~hit).alias("other")).join(up, "id").groupBy(F.col("up").alias("id")).agg(F.bool_or("some").alias("some"), F.bool_or("other").alias("other"))
    found = over_subtrees(up, seed, [], {"some": F.bool_or, "other": F.bool_or})
    out = nodes.join(found.withColumnRenamed("id", "__id__"), F.col("id") == F.col("__id__"), "left")
    return out.select(nodes["*"], F.coalesce("some", F.lit(False)).alias("any_desc"), (~F.coalesce("other", F.lit(False))).alias("every_desc"))


def with_labels(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Append ``labels``, the labels of each node, for tests with ``has_label``."""
    per = marks.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return nodes.join(per, "id", "left").select(nodes["*"], F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def has_label(label: str) -> Column:
    return truth(F.array_contains("labels", label))


def mark(marks: DataFrame, selection: DataFrame, label: str) -> DataFrame:
    return marks.select("id", "label").union(selection.select("id", F.lit(label))).distinct()


def unmark(marks: DataFrame, selection: DataFrame, label: str) -> DataFrame:
    return marks.join(selection.select("id", F.lit(label).alias("label")), ["id", "label"], "left_anti")


def marked(marks: DataFrame, label: str) -> DataFrame:
    return marks.filter(F.col("label") == label).select("id").distinct()


def copy_marks(marks: DataFrame, old: str, new: str) -> DataFrame:
    return mark(marks, marked(marks, old), new)


def delete_marks(marks: DataFrame, label: str) -> DataFrame:
    return marks.filter(F.col("label") != label)


def rename_marks(marks: DataFrame, old: str, new: str) -> DataFrame:
    """Copy, then delete the old label; with equal names all of them go."""
    return delete_marks(copy_marks(marks, old, new), old)


def move_marks(marks: DataFrame, uses: DataFrame, label: str, want: Column | None = None) -> DataFrame:
    """Marks of definitions go to the places that use them: ``uses`` is (id, target) with columns that ``want`` may test.

    The definitions lose the label, whether used or not.
    """
    u = uses if want is None else uses.filter(want)
    old = marked(marks, label)
    new = u.join(old.withColumnRenamed("id", "target"), "target", "left_semi").select("id", F.lit(label).alias("label"))
    rest = marks.filter(F.col("label") != label)
    return rest.union(new).distinct()


def mark_public(marks: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Public children of marked modules take the label, and so on down through public modules."""
    modules = nodes.filter("kind = 'mod'").select(F.col("id").alias("up"))
    open_ = cut(nodes.filter(truth(F.col("pub"))).select("id", F.col("parent").alias("up")).join(modules, "up", "left_semi").select("id", "up"))
    return mark(marks, below(open_, marked(marks, label), []), label)


def printed_marks(marks: DataFrame) -> DataFrame:
    """(id, label) in order."""
    return marks.select("id", "label").distinct().orderBy("id", "label")


def no_marks(marks: DataFrame) -> DataFrame:
    return marks.limit(0)


def reset(selection: DataFrame) -> DataFrame:
    return selection.limit(0)
