"""What the corpus operators share: table reading, stored frames, batched Arrow maps, span digests."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.iterate import cut

#: A word: a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``rows`` rows, cut once a piece's texts reach ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
        to = min(to, at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def map_texts(
    df: DataFrame,
    fields: list[T.StructField],
    fn: Callable[[list[str]], Iterable[pa.Array]],
    text: str = "text",
    keep: list[str] | None = None,
    rows: int = 256,
    size: int = 1 << 20,
) -> DataFrame:
    """Append columns computed from a text column, at most ``rows`` rows or about ``size`` bytes of text at a time.

    ``fn`` gets a list of texts (null comes as the empty text) and returns one
    Arrow array for each of ``fields``. ``keep`` lists the columns that pass
    through, all by default; one with the name of a new column is replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, width, rows, size):
                texts = [x or "" for x in part.column(width).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(width)] + list(fn(texts)), names=schema.names
                )

    cols = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{text}`").cast("string").alias("__text__")]
    return df.select(*cols).mapInArrow(run, schema)


SPAN = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a few numbers each up to which a table is sent to all tasks; beyond it rows are joined by shuffling.
SHORT = 200_000


def short(df: DataFrame) -> DataFrame:
    """``df``, stored and counted, marked to be sent to all tasks if it is short, so that a key of many rows elsewhere stays spread."""
    df = cut(df)
    return F.broadcast(df) if df.limit(SHORT + 1).count() <= SHORT else df
