import hashlib
import random
import time
import zlib
from functools import cache

import pytest

from graphloom.llm import conversations, queries

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\f\r"


def cheapest(codes):
    """(cost, edits) from the end on, for every state: no search, no bounds, no pieces."""

    @cache
    def at(i, s):
        out = [(0, "")] if i == len(codes) and s in "-a" else []
        need = {"-": "u", "s": "u", "u": "a", "a": "u"}[s]
        if i < len(codes):
            c = codes[i]
            out.append((4 + at(i + 1, s)[0], "D" + at(i + 1, s)[1]))
            if c != "d":
                more = 3 * c.isupper()
                for to in ({need} | ({"s"} if s == "-" else set())) & {c.lower()}:
                    out.append((more + at(i + 1, to)[0], "K" + at(i + 1, to)[1]))
                out.append((3 + more + at(i + 1, need)[0], "R" + at(i + 1, need)[1]))
            for k, t in ((1, need), (2, "a" if need == "u" else "u")):  # a third one is never cheapest
                rest = [(e, x) for e, x in ((after(i, t, c)) for c in [codes[i]])]
                out += [(3 * k + e, "I" * k + x) for e, x in rest]
        elif s not in "-a":
            out.append((3 if need == "a" else 6, "I" if need == "a" else "II"))
        return min(out)

    @cache
    def after(i, s, c):
        """Like ``at``, but nothing more is put in before row i."""
        need = {"-": "u", "s": "u", "u": "a", "a": "u"}[s]
        out = [(4 + at(i + 1, s)[0], "D" + at(i + 1, s)[1])]
        if c != "d":
            more = 3 * c.isupper()
            if c.lower() == need:
                out.append((more + at(i + 1, need)[0], "K" + at(i + 1, need)[1]))
            out.append((3 + more + at(i + 1, need)[0], "R" + at(i + 1, need)[1]))
        return min(out)

    return at(0, "-")


@pytest.mark.parametrize("piece", [200, 3, 1])
def test_search_equals_recursion(piece):
    draw = random.Random(piece)
    for _ in range(1500):
        codes = "".join(draw.choice("uuuaaaUAsSdxX") for _ in range(draw.randrange(9)))
        cuts = [codes[i : i + piece] for i in range(0, len(codes), piece)] or [""]
        ways = [conversations.piece_ways(c, i == 0, i == len(cuts) - 1) for i, c in enumerate(cuts)]
        cost, audits = conversations.joined(reversed(ways))
        assert (cost, "".join(audits)) == cheapest(codes), codes


def test_long_pieces_take_little_time():
    draw = random.Random(2)
    began = time.time()
    for codes in ("u" * 200, "a" * 200, "d" * 200, "X" * 200, "uU" * 100, "".join(draw.choice("uaUAsdx") for _ in range(200))):
        conversations.piece_ways(codes, False, False)
    assert time.time() - began < 30


def expected(rows):
    """Rows of the query for (conv_id, turn, role, text)."""
    out, by = [], {}
    for c, t, r, x in rows:
        t_, r, x = " " if t is None else t, " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{t_}".encode()) % 20
        x = "" if k == 1 else "".join(y for y in x if y not in ".!?") if k == 2 else x
        by.setdefault(c, []).extend([(t is not None, t or 0, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1))
    for c, own in by.items():
        own.sort()
        seen, faults, codes = set(), [], ""
        for _, _, r, x in own:
            told = x.rstrip(WHITE)
            f = "blank" if not told else "duplicate" if (r, x) in seen else "truncated" if told[-1] not in ".!?" else ""
            seen.add((r, x))
            faults.append(f)
            code = r[:1] if r[:1] in ("s", "u", "a") else "x"
            codes += "d" if f in ("blank", "duplicate") else code.upper() if f else code
        turns = [t for known, t, _, _ in own if known]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit = cheapest(codes)
        lines, i, s = [], 0, "-"
        for e in audit:
            need = "assistant" if s == "u" else "user"
            if e == "I":
                lines.append(need + ":")
            elif e != "D":
                lines.append((own[i][2] if e == "K" else need) + ":" + own[i][3])
            s = s if e == "D" else "s" if e == "K" and s == "-" and own[i][2][:1] == "s" else need[0]
            i += e != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = queries.op12_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


KINDS = "conv_id long, turn long, role string, text string"


def test_odd_rows_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 7)
    draw = random.Random(8)
    rows = [(None, t, r, x) for t in (None, None, 3) for r in (None, "user") for x in (None, "", "ok.", "a? \v")]
    rows += [(-4, None, "assistant", "only."), (5, 2, "tool", "Yes!"), (6, 1, "user", "q " * 300_000 + " " * 300_000 + "."), (6, 2, "assistant", " " * 1_000_000), (7, 0, "", "x")]
    rows += [(k, t, draw.choice(["user", "assistant", "user", "assistant", "system", "other"]), draw.choice(["fine.", f"well {t}.", f"no {t}", "", "why?"])) for k in (10, 11) for t in range(120)]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "Hello."))
    want = expected(rows)
    got = conversations.repair_damaged(spark.createDataFrame(rows, KINDS).repartition(4))
    assert sorted(map(tuple, got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str) == want
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want


def test_other_names_and_no_rows(spark):
    df = spark.createDataFrame([("a b", 1, "user", "Hi.", 3)], "conv string, t long, who string, said string, cost long")
    row = conversations.repair_damaged(df, "conv", "t", "who", "said").collect()[0]
    assert row["conv"] == "a b" and len(row) == 9
    assert conversations.repair_damaged(spark.createDataFrame([], KINDS)).collect() == []
