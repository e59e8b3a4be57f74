"""A corpus from raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, mixing, ngram_join, secret_scan, toxicity
from graphloom.plans.iterate import cut

#: Words that a worker keeps between batches of the last stage: fewer than the operator alone keeps, as workers of earlier stages stay.
REMEMBER = 250_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones that this stage is given.

    Null and empty texts are scored like others, repeated rows alike; columns of
    any name pass as they are; an empty table stays empty.
    """
    names = {c: f"__{i}__" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = toxicity.classify(docs.withColumnsRenamed(names), common.table(spark, sf_dir, "labels"))
    return out.filter("predicted = 0").select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once; rows without an id stay.

    An id that stands on several texts keeps each of them that has no partner of a
    smaller id; of its texts that are linked, and of equal rows, one stays. Texts
    without words link with nothing. An empty table stays empty.
    """
    names = {c: f"__{i}__" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = docs.withColumnsRenamed(names).withColumn("__key__", F.coalesce(F.sha2(F.col("text"), 256), F.lit("-")))
    found = ngram_join.near_duplicates(own.select("doc_id", "text", "__key__"), keep=("__key__",)).filter("doc_id = class_id")
    group = F.coalesce(F.hex("component"), "__key__")
    kept = found.groupBy("doc_id", group.alias("__group__")).agg(F.min("__key__").alias("__key__")).select("doc_id", "__key__")
    once = Window.partitionBy("doc_id", "__key__").orderBy(F.xxhash64(*own.columns))
    left = own.join(kept, ["doc_id", "__key__"], "left_semi").withColumn("__n__", F.row_number().over(once)).filter("__n__ = 1")
    return left.unionByName(own.filter("doc_id IS NULL"), allowMissingColumns=True).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays, repeated ones each; null texts stay null, an empty table empty."""
    masked = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return masked.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies; documents without words stay once.

    Rows that agree in id, source and size share the copies that the mix takes of
    them, evenly, the first by hash one more, so the mix takes what it should where
    ids repeat too. Columns of any name pass as they are; an empty table stays empty.
    """
    names = {c: f"__{i}__" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    own = docs.withColumnsRenamed(names)
    group = ["__d__", "__k__", "__size__"]
    name = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("-"))
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    rows = own.withColumns({"__d__": name("doc_id"), "__k__": name("source"), "__size__": size, "__h__": F.xxhash64(*own.columns)})
    taken = mixing.mix(own).select(name("doc_id").alias("__d__"), name("source").alias("__k__"), F.col("size").alias("__size__"), "copies")
    taken = taken.groupBy(*group).agg(F.sum("copies").alias("__sum__"), F.count("*").alias("__of__"))
    # equal rows count together: the running numbers of the others tell how many of them get one copy more
    alike = rows.groupBy(*group, "__h__").agg(F.count("*").alias("__n__"))
    upto = F.sum("__n__").over(Window.partitionBy(*group).orderBy("__h__"))
    more = F.greatest(F.lit(0), F.least(F.lit(0), F.expr("__sum__ % __of__") - F.col("__upto__")) + F.col("__n__"))
    share = alike.withColumn("__upto__", upto).join(taken, group).withColumn("__copies__", F.when(F.col("__size__") == 0, F.col("__n__")).otherwise(F.expr("__sum__ div __of__") * F.col("__n__") + more))
    share = cut(share.select(*group, "__h__", "__n__", "__copies__"))
    both = rows.join(share.filter("__copies__ > 0"), [*group, "__h__"])
    if not share.filter("__n__ > 1").isEmpty():
        each = [*group, *own.columns]
        both = both.groupBy(*each).agg(F.min("__copies__").alias("__copies__"))
    return both.withColumn("__copy__", F.explode(F.sequence(F.lit(1).cast("long"), "__copies__"))).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to the row's text; null and empty texts have none and decode to nothing.

    Repeated rows have equal ids; an empty table gives no rows.
    """
    out = bpe.encode(docs, decoded=True, remember=REMEMBER)
    back = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", back.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: SQL has no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
