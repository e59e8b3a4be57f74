"""Binary event logs as a data source: batch and stream reader, and a writer that commits whole files.

A log file is one run: records without marks between them, little endian, each the
place (32 bits), the kind's number (32 bits) and the kind's fields. A file is read in
order, a block at a time, and ends where a record is cut off or names no kind; files
are read in parallel, several in a task if there are many.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Kinds by number, and their fields in order with their formats (fixed values).
KINDS = (
    ("CopyPtr", (("ptr", "Q"),)),
    ("Project", (("ptr", "Q"), ("new_ptr", "Q"), ("proj_key", "Q"))),
    ("Alloc", (("size", "Q"), ("ptr", "Q"))),
    ("Free", (("ptr", "Q"),)),
    ("Realloc", (("ptr", "Q"), ("size", "Q"), ("new_ptr", "Q"))),
    ("Ret", (("ptr", "Q"),)),
    ("LoadAddr", (("ptr", "Q"),)),
    ("StoreAddr", (("ptr", "Q"),)),
    ("StoreAddrTaken", (("ptr", "Q"),)),
    ("AddrOfLocal", (("ptr", "Q"), ("local", "I"), ("size", "I"))),
    ("AddrOfSized", (("ptr", "Q"), ("size", "Q"))),
    ("ToInt", (("ptr", "Q"),)),
    ("FromInt", (("ptr", "Q"),)),
    ("LoadValue", (("ptr", "Q"),)),
    ("StoreValue", (("ptr", "Q"),)),
    ("Offset", (("ptr", "Q"), ("offset", "q"), ("new_ptr", "Q"))),
    ("BeginFuncBody", ()),
    ("Done", ()),
)

BIG = ("ptr", "new_ptr", "size", "proj_key")
FIELDS = ("ptr", "new_ptr", "size", "offset", "local", "proj_key")
SCHEMA = "run_id string, seq long, mir_loc long, kind string, ptr decimal(20,0), new_ptr decimal(20,0), size decimal(20,0), offset long, local long, proj_key decimal(20,0)"
ENDING = ".log"
#: Bytes that are read at a time, and records of a batch.
BLOCK, RECORDS = 1 << 20, 10_000
#: Up to so many files are a task each; beyond that tasks share them, with so many bytes a task at least.
TASKS, TASK_BYTES = 200, 16 << 20

_HEAD = struct.Struct("<II")
_BODY = [struct.Struct("<" + "".join(f for _, f in fields)) for _, fields in KINDS]
_NUMBER = {name: i for i, (name, _) in enumerate(KINDS)}


def records(read) -> Iterator[tuple]:
    """(place, kind's number, fields' values) of a log; ``read(n)`` gives its next bytes. Stops at the first record that is not whole."""
    data, at = b"", 0
    while True:
        if len(data) - at < 64:
            data, at = data[at:] + read(BLOCK), 0
        if len(data) - at < _HEAD.size:
            return
        place, kind = _HEAD.unpack_from(data, at)
        if kind >= len(KINDS) or len(data) - at < _HEAD.size + _BODY[kind].size:
            return
        yield place, kind, _BODY[kind].unpack_from(data, at + _HEAD.size)
        at += _HEAD.size + _BODY[kind].size


def encoded(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """The records of a batch, laid out in order, and where each one starts, with the end of all.

    A field that its kind needs and a row lacks, or that its format has no room for, is a ValueError, as is an unknown kind.
    """
    names = batch.column("kind").to_pylist()
    if unknown := set(names) - set(_NUMBER):
        raise ValueError(f"unknown kind {min(unknown, key=str)}")
    kinds = np.array([_NUMBER[n] for n in names], np.int64)
    at = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(np.array([_HEAD.size + x.size for x in _BODY])[kinds], out=at[1:])
    out = np.empty(at[-1], np.uint8)
    place = pa.compute.fill_null(batch.column("mir_loc"), 0)
    for number in np.unique(kinds):
        name, fields = KINDS[number]
        rows = np.flatnonzero(kinds == number)
        made = np.zeros(len(rows), [("mir_loc", "<u4"), ("kind", "<u4"), *((f, _ARRAY[k]) for f, k in fields)])
        made["kind"] = number
        for f, k in (("mir_loc", "I"), *fields):
            values = (place if f == "mir_loc" else batch.column(f)).take(pa.array(rows))
            if values.null_count:
                raise ValueError(f"{name} needs {', '.join(n for n, _ in fields)}")
            made[f] = _numbers(values, f, k)
        out[at[rows][:, None] + np.arange(made.itemsize)] = made.view(np.uint8).reshape(len(rows), -1)
    return out.tobytes(), at


#: The struct formats of fields as numpy types.
_ARRAY = {"Q": "<u8", "I": "<u4", "q": "<i8"}


def _numbers(values: pa.Array, field: str, form: str) -> np.ndarray:
    """Whole numbers without nulls; a decimal is 16 bytes, of which a value of 64 bits without sign leaves the upper 8 zero."""
    if pa.types.is_decimal(values.type):
        low, high = np.frombuffer(values.buffers()[1], "<u8")[2 * values.offset :][: 2 * len(values)].reshape(-1, 2).T
        fits = not high.any()
    else:
        low = values.to_numpy(zero_copy_only=False)
        fits = form == "q" or not len(low) or (low.min() >= 0 and low.max() < 1 << 32)
    if not fits:
        raise ValueError(f"{field} has no room for a value")
    return low


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _sizes(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of all logs, in order of their names."""
    fs, base = _store(path)
    info = fs.get_file_info(base)
    if info.type == pyarrow.fs.FileType.File:
        return [(base, info.size)]
    return sorted((f.path, f.size or 0) for f in fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if f.is_file and f.base_name.endswith(ENDING))


def _logs(path: str) -> list[str]:
    return [name for name, _ in _sizes(path)]


@dataclass
class _Files(InputPartition):
    names: list[str]


def _dealt(files: list[tuple[str, int]]) -> list[_Files]:
    """A file a task if they are few; else neighbours share one, up to an even part of the bytes and of the files."""
    if len(files) <= TASKS:
        return [_Files([name]) for name, _ in files]
    tasks = max(TASKS, sum(n for _, n in files) // TASK_BYTES)
    most, many = max(1, sum(n for _, n in files) / tasks), max(1, len(files) / tasks)
    out: list[_Files] = []
    filled = 2.0
    for name, n in files:
        if filled >= 2:
            out.append(_Files([]))
            filled = 0.0
        out[-1].names.append(name)
        filled += n / most + 1 / many
    return out


def _read(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The events of some files; a batch may hold the end of one and the start of others."""
    fs, _ = _store(path)
    big = pa.decimal128(20, 0)
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        found = [dict(zip((n for n, _ in KINDS[k][1]), v, strict=True)) for _, k, v, _, _ in rows]
        cols = [pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([KINDS[r[1]][0] for r in rows])]
        for f in FIELDS:
            values = [x.get(f) for x in found]
            cols.append(pa.array([None if v is None else Decimal(v) for v in values], big) if f in BIG else pa.array(values, pa.int64()))
        return pa.RecordBatch.from_arrays(cols, names=["run_id", "seq", "mir_loc", "kind", *FIELDS])

    for name in names:
        run = name.rsplit("/", 1)[-1].removesuffix(ENDING)
        with fs.open_input_stream(name) as f:
            for seq, r in enumerate(records(f.read)):
                rows.append((*r, run, seq))
                if len(rows) == RECORDS:
                    yield batch()
                    rows = []
    if rows:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Files]:
        return _dealt(_sizes(self.path)) or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.names)


class _StreamReader(DataSourceStreamReader):
    """Files in the order of their names; an offset is the last name taken. A file is whole when it appears, as the writer moves it in."""

    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most
        self.at = ""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        new = [n for n in _logs(self.path) if n > self.at][: self.most]
        self.at = new[-1] if new else self.at
        return {"after": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        self.at = max(self.at, end["after"])  # after a restart, what the plan has taken
        return _dealt([f for f in _sizes(self.path) if start["after"] < f[0] <= end["after"]])

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.names)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["after"])


@dataclass
class _Written(WriterCommitMessage):
    """The files of a task: run n of ``runs`` is ``{part}-{n}``, hidden, until it is moved."""

    part: str
    runs: list[str]

    def moves(self, base: str) -> Iterator[tuple[str, str]]:
        return ((f"{base}/.{self.part}-{n}.part", f"{base}/{run}{ENDING}") for n, run in enumerate(self.runs))


class _Writer(DataSourceArrowWriter):
    """Each task writes the runs that it has under hidden names; the commit moves them in, an abort deletes them."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, base = _store(self.path)
        fs.create_dir(base)
        done = _Written(uuid.uuid4().hex, [])
        out = None
        for batch in iterator:
            data, at = encoded(batch)
            runs = batch.column("run_id").to_pylist()
            first = 0
            for run, rows in groupby(runs):
                if run is None or "/" in run:
                    raise ValueError("a run's name makes its file's name")
                end = first + sum(1 for _ in rows)
                if not done.runs or run != done.runs[-1]:
                    if out:
                        out.close()
                    out = fs.open_output_stream(f"{base}/.{done.part}-{len(done.runs)}.part")
                    done.runs.append(run)
                out.write(data[at[first] : at[end]])
                first = end
        if out:
            out.close()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = _store(self.path)
        if self.overwrite:
            kept = {f"{run}{ENDING}" for x in messages if x for run in x.runs}
            for name in _logs(self.path):
                if name.rsplit("/", 1)[-1] not in kept:
                    fs.delete_file(name)
        for part, to in (m for x in messages if x for m in x.moves(base)):
            fs.move(part, to)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, base = _store(self.path)
        for part, _ in (m for x in messages if x for m in x.moves(base)):
            if fs.get_file_info(part).is_file:
                fs.delete_file(part)


class BinaryLog(DataSource):
    """``spark.dataSource.register(BinaryLog)``, then format ``binary_log`` with a path; ``maxFilesPerTrigger`` for streams (1 by default)."""

    @classmethod
    def name(cls) -> str:
        return "binary_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("maxFilesPerTrigger", 1)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_binary_log(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write a file for each run, its events in order of seq. Runs that the folder has are replaced, with mode overwrite others go too.

    Columns that the log has and ``events`` lacks count as null. Rows without a run or of an
    unknown kind are a ValueError. No events write no files.
    """
    kinds = dict(x.strip().split(" ", 1) for x in SCHEMA.replace("(20,0)", "(20;0)").split(","))
    full = events.select(*((F.col(c) if c in events.columns else F.lit(None)).cast(k.replace(";", ",")).alias(c) for c, k in kinds.items()))
    events.sparkSession.dataSource.register(BinaryLog)
    full.repartition("run_id").sortWithinPartitions("run_id", "seq").write.format("binary_log").mode(mode).save(path)


def read_binary_log(spark, path: str) -> DataFrame:
    """The events of all logs under a path, of each up to its first broken record."""
    spark.dataSource.register(BinaryLog)
    return spark.read.format("binary_log").load(path)
