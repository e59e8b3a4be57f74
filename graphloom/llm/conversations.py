"""Conversation structure repair by iterative-deepening A*.

A conversation is read as roles: an optional system turn, then user and assistant
in turn, from first to last. A search goes through its rows in order, trying the
edits in ASCII order (Delete, Insert, Keep, Rerole) under a bound on the cost that
grows until a way fits; the first way found is the cheapest and the least one. What a
state is known to cost at least, first an estimate (required deletions, truncated
rows, pairs of roles that cannot stand side by side), is raised whenever a search from
it fails, and no state is entered with less than that.

Long conversations are cut into pieces of ``PIECE`` rows. A piece is searched once
for each pair of states before and after it, and the pieces' best ways are put
together from the end, so neither a search nor a group of rows grows with a
conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut

PIECE = 200
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
WHITE = " \t\n\x0b\f\r"

#: States by what stands before: nothing, a system, a user, an assistant turn; the role that may follow.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEEDED = (USER, USER, ASSISTANT, USER)
LETTER = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: States in which a conversation may end.
ENDS = (BEGIN, ASSISTANT)
STEPS = "DIKR"


class Search:
    """The cheapest edits of a piece: ``rows`` are codes, d for one that must go, else the role's initial, a capital for a truncated text."""

    def __init__(self, rows: str, end: int) -> None:
        self.rows, self.end = rows, end
        self.known: dict[tuple[int, int], int] = {}
        n = len(rows)
        base, pairs, after = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            c = rows[i]
            if c == "d":
                base[i], pairs[i], after[i] = base[i + 1] + DELETE, pairs[i + 1], after[i + 1]
                continue
            odd, big, j = c.lower() not in "sua", c.isupper(), after[i + 1]
            base[i] = base[i + 1] + ((min(REROLE + TRUNCATED, DELETE) if odd else TRUNCATED) if big else REROLE * odd)
            if j < n:
                pair = self._apart(c, rows[j]) + pairs[j + 1]
            else:  # the last row is what the piece ends with
                pair = 0 if odd or end not in (USER, ASSISTANT) or c.lower() == LETTER[end] else DELETE - TRUNCATED if big else INSERT
            pairs[i], after[i] = max(pairs[i + 1], pair), i
        self.base, self.pairs, self.after = base, pairs, after

    @staticmethod
    def _apart(a: str, b: str) -> int:
        """What it costs at least, besides what each row costs alone, that ``b`` comes next after ``a``."""
        if a.lower() not in "sua" or b.lower() not in "sua":
            return 0
        return 0 if (a + b).lower() in ("su", "ua", "au") else DELETE - TRUNCATED if a.isupper() or b.isupper() else REROLE

    def least(self, i: int, state: int) -> int:
        """What the rows from ``i`` on cost at least after ``state``."""
        j = self.after[i]
        if j == len(self.rows):
            return self.base[i] + (INSERT if state != self.end else 0)
        if state == BEGIN:
            return self.base[i] + self.pairs[j]
        return self.base[i] + max(self.pairs[j], self._apart(LETTER[state], self.rows[j]) + self.pairs[j + 1])

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, next row, next state) of every edit, in ASCII order."""
        need, here = NEEDED[state], i < len(self.rows)
        c = self.rows[i] if here else "d"
        if here:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, need
        if c != "d":
            more = TRUNCATED if c.isupper() else 0
            if c.lower() == LETTER[need]:
                yield "K", more, i + 1, need
            elif state == BEGIN and c.lower() == "s":
                yield "K", more, i + 1, SYSTEM
            if c.lower() != LETTER[need]:
                yield "R", REROLE + more, i + 1, need

    def possible(self, state: int) -> bool:
        """Can the piece be left in the end state at all?"""
        if self.end == BEGIN:
            return state == BEGIN
        if self.end == SYSTEM:
            return state == SYSTEM or state == BEGIN and "s" in self.rows.lower()
        return True

    def run(self, state: int) -> tuple[int, str] | None:
        """(cost, edits) from a state on."""
        if not self.possible(state):
            return None
        bound = self.known.setdefault((0, state), self.least(0, state))
        while (way := self._within(state, bound)) is None:
            bound = self.known[0, state]
        return bound, way

    def _within(self, state: int, bound: int) -> str | None:
        """The first way that costs ``bound`` at most. A failed state learns the least that its edits leave open."""
        n, known, never = len(self.rows), self.known, 1 << 60
        way: list[str] = []
        open_ = [(0, state, bound, self.edits(0, state), [never])]
        if n == 0 and state == self.end:
            return ""
        while open_:
            i, s, left, edits, least = open_[-1]
            for letter, cost, j, t in edits:
                if (j, t) not in known:
                    known[j, t] = self.least(j, t) if self.end not in (BEGIN, SYSTEM) or self._open(j, t) else never
                if cost + known[j, t] > left:
                    least[0] = min(least[0], cost + known[j, t])
                    continue
                way.append(letter)
                if j == n and t == self.end:
                    return "".join(way)
                open_.append((j, t, left - cost, self.edits(j, t), [never]))
                break
            else:
                open_.pop()
                known[i, s] = max(known[i, s], least[0])
                if open_:
                    way.pop()
                    up = open_[-1]
                    j, t = i, s
                    up[4][0] = min(up[4][0], up[2] - left + known[j, t])
        return None

    def _open(self, i: int, state: int) -> bool:
        """Can an end before any user turn still be reached?"""
        if self.end == BEGIN:
            return state == BEGIN
        return state == SYSTEM or state == BEGIN and "s" in self.rows[i:].lower()


def piece_ways(rows: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of a piece; only the first one begins with nothing, only the last one ends for good."""
    out = []
    for end in ENDS if last else range(4):
        search = Search(rows, end)
        out += [(s, end, *found) for s in ((BEGIN,) if first else range(4)) if (found := search.run(s)) is not None]
    return out


class _Chain:
    """A way through the pieces from one on: its own edits and those of the next pieces."""

    def __init__(self, cost: int, own: str, then: _Chain | None) -> None:
        self.cost, self.own, self.then = cost, own, then

    def letters(self) -> Iterator[str]:
        at: _Chain | None = self
        while at:
            yield from at.own
            at = at.then

    def below(self, other: _Chain) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        return next((a < b for a, b in zip_longest(self.letters(), other.letters(), fillvalue="") if a != b), False)


def joined(pieces: Iterator[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """(cost, edits by piece) of the least way through pieces that come last first."""
    best: dict[int, _Chain | None] = dict.fromkeys(ENDS)
    for ways in pieces:
        new: dict[int, _Chain] = {}
        for s, t, cost, own in ways:
            if t in best:
                way = _Chain(cost + (best[t].cost if best[t] else 0), own, best[t])
                if s not in new or way.below(new[s]):
                    new[s] = way
        best = new
    at = whole = best[BEGIN]
    out = []
    while at:
        out.append(at.own)
        at = at.then
    return whole.cost, out


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) after the damage that the checksum of ``conv:turn`` decides; nulls count as one space, in roles and texts too."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    k = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    spoilt = F.when(k == 1, "").when(k == 2, F.regexp_replace(plain(text), "[.!?]", "")).otherwise(plain(text))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.when(k == 4, "user").otherwise(plain(role)).alias("role"), spoilt.alias("text"), k.alias("k"))
    return rows.filter("k <> 0").withColumn("again", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text")


def _codes(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation from 0, fault and code; cut, as they are read three times."""
    by_turn = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("place", F.row_number().over(by_turn) - 1).withColumn("before", F.lag(F.substring("role", 1, 1)).over(by_turn))
    same = Window.partitionBy("conv", "role", F.sha2("text", 256)).orderBy("place")
    told = F.rtrim("text", F.lit(WHITE))
    fault = F.when(told == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~F.right(told, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"))
    odd = F.col("before").isNotNull() & ~F.concat("before", initial).isin("su", "ua", "au")
    placed = placed.withColumn("fault", fault)
    return cut(placed.select("conv", "turn", "role", "text", "place", F.floor(F.col("place") / PIECE).alias("piece"), "fault", odd.alias("odd"), F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code).alias("code")))


def _ways(rows: DataFrame) -> DataFrame:
    """(conv, piece, cost, audit) of each piece of each conversation; the cost is that of the whole conversation."""
    pieces = rows.groupBy("conv", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("c"))
    pieces = pieces.select("conv", "piece", F.concat_ws("", F.col("c.code")).alias("rows"), (F.col("piece") == F.max("piece").over(Window.partitionBy("conv"))).alias("last"))
    found = "conv string, piece long, cost long, audit string"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool, bool], list] = {}
        for batch in batches:
            if len(seen) > 50_000:
                seen.clear()
            out = []
            for piece, rows_, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                key = (rows_, piece == 0, last)
                if key not in seen:
                    seen[key] = piece_ways(*key)
                out.append([dict(zip(("a", "b", "cost", "edits"), w, strict=True)) for w in seen[key]])
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["conv", "piece", "ways"])

    kind = "array<struct<a:int,b:int,cost:bigint,edits:string>>"
    ways = pieces.withColumn("conv", F.to_json(F.struct("conv"))).mapInArrow(search, f"conv string, piece long, ways {kind}")
    dealt = ways.repartition("conv").sortWithinPartitions("conv", F.col("piece").desc())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(conv: str, ways: list) -> pa.RecordBatch:
            cost, audits = joined([[(w["a"], w["b"], w["cost"], w["edits"]) for w in x] for x in ways])
            n = len(audits)
            return pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([cost] * n, pa.int64()), pa.array(audits, pa.string())], names=["conv", "piece", "cost", "audit"])

        at, held, out = None, [], []
        for batch in batches:
            for conv, ways_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != at and held:
                    out.append(whole(at, held))
                    held = []
                at = conv
                held.append(ways_)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if held:
            yield whole(at, held)

    back = F.from_json("conv", F.lit(f"struct<conv:{rows.schema['conv'].dataType.simpleString()}>"))
    return dealt.mapInArrow(put, found).withColumn("conv", back["conv"])


def _repaired(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): a piece's edits come before its rows, and the hash goes along."""
    key = F.to_json(F.struct("conv")).alias("conv")
    none = F.lit(None).cast("string")
    both = ways.select(key, "piece", F.lit(-1).alias("place"), F.col("audit").alias("role"), none.alias("text")).union(rows.select(key, "piece", "place", "role", "text"))
    dealt = both.repartition("conv").sortWithinPartitions("conv", "piece", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, state, edits, begun = None, None, BEGIN, iter(""), False
        done: list[tuple[str, str]] = []

        def line(role: str, text: str) -> None:
            nonlocal begun
            sha.update(("\n" * begun + role + ":" + text).encode())
            begun = True

        def close() -> None:
            """Edits after the last row of a piece insert."""
            nonlocal state
            for _ in edits:
                state = NEEDED[state]
                line(ROLE[state], "")

        for batch in batches:
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if place < 0:
                    if at is not None:
                        close()
                    if conv != at:
                        if at is not None:
                            done.append((at, sha.hexdigest()))
                        at, sha, state, begun = conv, hashlib.sha256(), BEGIN, False
                    edits = iter(role)
                    continue
                while (e := next(edits)) == "I":
                    state = NEEDED[state]
                    line(ROLE[state], "")
                if e == "K":
                    state = SYSTEM if role[:1] == "s" else NEEDED[state]
                    line(role, text)
                elif e == "R":
                    state = NEEDED[state]
                    line(ROLE[state], text)
            yield pa.RecordBatch.from_pydict({"conv": pa.array([d[0] for d in done], pa.string()), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})
            done = []
        if at is not None:
            close()
            yield pa.RecordBatch.from_pydict({"conv": pa.array([at], pa.string()), "repaired_sha256": pa.array([sha.hexdigest()], pa.string())})

    back = F.from_json("conv", F.lit(f"struct<conv:{rows.schema['conv'].dataType.simpleString()}>"))
    return dealt.mapInArrow(run, "conv string, repaired_sha256 string").withColumn("conv", back["conv"])


def repair(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of (conv, turn, role, text).

    Rows stand by turn, nulls first, equal turns by role and text. A null id is a
    conversation of its own; roles and texts are not null. A row that has no text
    but white space is blank, one whose role and text came before a duplicate, one
    that does not end in ``.``, ``!`` or ``?`` truncated; the first that holds counts. Blank and
    duplicate rows must go (4), a truncated one costs 3 if it stays; a role is set for 3, an empty
    turn put in for 3. Of equal costs the least audit in ASCII order is taken. Long texts are hashed
    as they come; a conversation of any length is searched piece by piece. An empty table gives no rows.
    """
    coded = _codes(rows)
    ways = cut(_ways(coded))
    count: dict[str, Column] = {f: F.count(F.when(F.col("fault") == f, 1)) for f in ("blank", "duplicate", "truncated")}
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    faults = coded.groupBy("conv").agg(gaps.alias("gaps"), *(c.alias(f) for f, c in count.items()), F.count(F.when(F.col("odd"), 1)).alias("illegal"))
    # the pieces' edits are the audit: they make one value a conversation, as the rows of the result ask for
    audits = ways.groupBy("conv").agg(F.first("cost").alias("cost"), F.concat_ws("", F.sort_array(F.collect_list(F.struct("piece", "audit")))["audit"]).alias("audit"))
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    hashes = _repaired(coded, ways)
    out = faults.join(audits, same(faults, audits)).drop(audits["conv"])
    return out.join(hashes, same(out, hashes)).drop(hashes["conv"])


def repair_damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair`` after ``damage``: a row for every conversation of ``df``; one that has lost all rows has zeros, an empty audit and an empty text's hash.

    Repeated rows are damaged alike. Other columns are not read.
    """
    every = df.select(F.col(f"`{conv}`").alias(conv)).distinct()
    found = repair(damage(df, conv, turn, role, text))
    out = every.join(found, every[conv].eqNullSafe(found["conv"]), "left").drop("conv") if conv != "conv" else every.withColumnRenamed("conv", "__c__").join(found, F.col("__c__").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("__c__", "conv")
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.fillna(0, list(zero)).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
