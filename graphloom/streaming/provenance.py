"""Provenance of a running program: the fold of ``events.provenance`` over micro-batches, its state kept by the stream.

A run's pointer map, graph sizes, last nodes of locals and addresses taken lie in
the state store, part by part; a batch reads the parts that its events touch and
writes back those that changed. The store must hold keys of their own, as RocksDB's does
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, MutableMapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import NODE_KINDS, _Event, _Fold

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Kept(MutableMapping):
    """A map state as a mapping that remembers what it has read, until ``flush`` writes what has changed."""

    def __init__(self, state, key: Callable = tuple, load: Callable = lambda v: v[0], dump: Callable = lambda v: (v,), empty: Callable = lambda v: v is None) -> None:
        self.state, self.key, self.load, self.dump, self.empty = state, key, load, dump, empty
        self.seen: dict = {}
        self.changed: set = set()

    def get(self, k, default=None):
        if k not in self.seen:
            found = self.state.getValue(self.key(k))
            self.seen[k] = None if found is None else self.load(found)
        return default if self.seen[k] is None else self.seen[k]

    def __getitem__(self, k):
        if (v := self.get(k)) is None:
            raise KeyError(k)
        return v

    def __setitem__(self, k, v) -> None:
        self.seen[k] = v
        self.changed.add(k)

    def __delitem__(self, k) -> None:
        self[k] = None

    def __iter__(self):
        return iter(self.seen)

    def __len__(self) -> int:
        return len(self.seen)

    def flush(self) -> None:
        for k in self.changed:
            if not self.empty(self.seen[k]):
                self.state.updateValue(self.key(k), self.dump(self.seen[k]))
            elif self.state.containsKey(self.key(k)):
                self.state.removeKey(self.key(k))


def _load_page(v) -> dict | int:
    body = json.loads(bytes(v[0]))
    return {int(k): tuple(x) for k, x in body.items()} if isinstance(body, dict) else int(body)


class _Run(StatefulProcessor):
    """One run's fold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "level int, prefix bigint", "body binary")
        self.sizes = handle.getMapState("sizes", "graph bigint", "size bigint")
        self.dests = handle.getMapState("dests", "graph bigint, local bigint", "node bigint")
        self.taken = handle.getMapState("taken", "func string, local bigint", "era bigint")
        self.counts = handle.getValueState("counts", "graphs bigint, era bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        graphs, era = self.counts.get() if self.counts.exists() else (0, 0)
        pages = _Kept(self.pages, load=_load_page, dump=lambda v: (json.dumps(v).encode() if isinstance(v, dict) else json.dumps(str(v)).encode(),), empty=lambda v: not v)
        sizes, dests = _Kept(self.sizes, key=lambda k: (k,)), _Kept(self.dests)
        taken = _Kept(self.taken)
        fold = _Fold(pages, sizes, dests, graphs)
        out = []
        for r in sorted(rows, key=lambda r: r.seq):
            era += r.kind == "BeginFuncBody"
            kind = NODE_KINDS.get(r.kind)
            if r.kind == "AddrOfLocal":
                # the first one since a function began is a root, as in ``node_kinds``
                if taken.get((r.func, r.local)) == era + 1:
                    kind = "Copy"
                else:
                    taken[r.func, r.local] = era + 1
            if kind is None:
                continue
            number = lambda x: None if x is None else int(x)
            e = _Event(*(kind if f == "node_kind" else list(getattr(r, f) or []) if f.endswith("_path") else getattr(r, f) for f in _Event._fields))
            e = e._replace(ptr=number(e.ptr), new_ptr=number(e.new_ptr), size=number(e.size))
            graph, node, source = fold.add(e)
            out.append(Row(run_id=key[0], graph_id=graph, node_id=node, source=source, kind=kind, func=r.func, dest_local=number(r.dest_local), ptr=e.ptr, is_null=e.ptr == 0, offset=number(r.offset), seq=number(r.seq)))
        for kept in (pages, sizes, dests, taken):
            kept.flush()
        self.counts.update((fold.graphs, era))
        yield from out

    def close(self) -> None:
        pass


def live_provenance(events: DataFrame) -> DataFrame:
    """The rows of ``events.provenance`` as a stream: however a log is cut into batches, and over restarts, they are the same.

    ``events`` has run_id, seq, kind, func, local, source_local, dest_local, ptr, new_ptr,
    size, offset and may have source_path and dest_path. A batch is taken in
    order of seq; batches must come in that order too. A null run is a run. Pointers of
    nodes are longs, as there. Batches without events give no rows.
    """
    have = events.columns
    whole = {c: "cast(array() as array<int>)" for c in ("source_path", "dest_path") if c not in have}
    rows = events.selectExpr("*", *(f"{x} AS {c}" for c, x in whole.items()))
    long = lambda name: T.StructField(name, T.LongType())
    fields = [T.StructField("run_id", events.schema["run_id"].dataType), long("graph_id"), long("node_id"), long("source"), T.StructField("kind", T.StringType()), T.StructField("func", T.StringType())]
    fields += [long("dest_local"), long("ptr"), T.StructField("is_null", T.BooleanType()), long("offset"), long("seq")]
    return rows.groupBy("run_id").transformWithState(_Run(), T.StructType(fields), "append", "None")
