"""Online capture of events: bounded triggers, one ordered sink a batch, events outside the program counted and dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_capture(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Event files as a stream. A slow sink holds the source back by files a trigger; nothing is dropped for being late."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Hooks that make one event as it is, and its kind (fixed values); allocator and offset hooks are apart.
EVENT_HOOKS = {
    "ptr_project": "Project", "ptr_copy": "CopyPtr", "ptr_contrive": "FromInt", "ptr_to_int": "ToInt", "addr_of_local": "AddrOfLocal",
    "addr_of_sized": "AddrOfSized", "load_value": "LoadValue", "store_value": "StoreValue", "ptr_ret": "Ret", "ptr_load": "LoadAddr",
    "ptr_store": "StoreAddr", "ptr_store_addr_taken": "StoreAddrTaken", "mark_begin_body": "BeginFuncBody",
}


def hook_events(calls: DataFrame) -> DataFrame:
    """(run_id, seq, part, kind, ptr, new_ptr, size) of allocator, offset and event hooks; part numbers the events of one call.

    ``calls`` is (run_id, seq, hook, ptr, size, count, result). calloc and
    reallocarray take the product of their sizes; realloc is a free and an
    allocation, in this order; an offset from the null pointer is a copy of the
    offset. A call of any other name is an error when read.
    """
    c = F.col
    none = F.lit(None).cast("long")
    event = lambda part, kind, ptr, size=none, new=none: F.struct(F.lit(part).alias("part"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), ptr.alias("ptr"), new.alias("new_ptr"), size.alias("size"))
    again = lambda size: F.array(event(0, "Free", c("ptr")), event(1, "Alloc", c("result"), size))
    kind = F.create_map(*(F.lit(x) for kv in EVENT_HOOKS.items() for x in kv))[c("hook")]
    known = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown hook "), F.coalesce("hook", F.lit("null")))).cast("string"))
    sized = F.when(c("hook").isin("addr_of_local", "addr_of_sized"), c("size"))
    made = (
        F.when(c("hook") == "malloc", F.array(event(0, "Alloc", c("result"), c("size"))))
        .when(c("hook") == "calloc", F.array(event(0, "Alloc", c("result"), c("count") * c("size"))))
        .when(c("hook") == "realloc", again(c("size")))
        .when(c("hook") == "reallocarray", again(c("count") * c("size")))
        .when(c("hook") == "free", F.array(event(0, "Free", c("ptr"))))
        .when((c("hook") == "offset") & (c("ptr") == 0), F.array(event(0, "CopyPtr", c("size"))))
        .when(c("hook") == "offset", F.array(event(0, "Offset", c("ptr"), new=c("result"))))
        .otherwise(F.array(event(0, known, F.when(c("hook") != "mark_begin_body", c("ptr")), sized, F.when(c("hook") == "ptr_project", c("result")))))
    )
    return calls.select("run_id", "seq", F.explode(made).alias("e")).select("run_id", "seq", "e.*")


def inside_program(events: DataFrame) -> DataFrame:
    """The rows of a stream from a run's Main to its Done, those two included; others are dropped.

    The state of a run is one number. Rows of a batch are taken in order of seq.
    """

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase = state.get[0] if state.exists else 0
        rows = pd.concat(list(pdfs)).sort_values("seq")
        keep = []
        for kind in rows["kind"]:
            phase = 1 if phase == 0 and kind == "Main" else phase
            keep.append(phase == 1)
            phase = 2 if phase == 1 and kind == "Done" else phase
        state.update((phase,))
        yield rows[keep]

    return events.groupBy("run_id").applyInPandasWithState(fold, events.schema, "phase int", "append", GroupStateTimeout.NoTimeout)


def program_events(events: DataFrame) -> DataFrame:
    """(run_id, events, before_main, after_done) as a stream of running counts for each run.

    Events before a run's Main and after its Done are dropped and counted. The
    state of a run is four numbers; rows of a batch are taken in order of seq.
    """

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, kept, before, after = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(pdfs)).sort_values("seq")
        for kind in rows["kind"]:
            if phase == 0 and kind != "Main":
                before += 1
            elif phase == 2:
                after += 1
            else:
                phase = 2 if kind == "Done" else 1
                kept += 1
        state.update((phase, kept, before, after))
        yield pd.DataFrame({"run_id": [key[0]], "events": [kept], "before_main": [before], "after_done": [after]})

    return events.groupBy("run_id").applyInPandasWithState(
        fold, "run_id long, events long, before_main long, after_done long", "phase int, kept long, before long, after long", "update", GroupStateTimeout.NoTimeout
    )


def drain(events: DataFrame, path: str, checkpoint: str, append: bool = True, form: str = "parquet"):
    """Write the events of programs (see ``inside_program``) until the source is dry, as Parquet or as JSON lines.

    A batch that is written again replaces itself. A log that starts afresh
    (``append`` false) first removes what stands under ``path``; it needs a new checkpoint.
    """
    kept = inside_program(events)
    if not append:
        empty = events.sparkSession.createDataFrame([], kept.schema).withColumn("batch", F.lit(0))
        empty.write.mode("overwrite").partitionBy("batch").format(form).save(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(form).save(f"{path}/batch={number:09d}")

    return kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
