"""Secret scans by assignment-aware lexing.

Three plain patterns give the base spans. Beyond them the text is lexed for
assignments as source and configuration files write them (``name = "x"``,
``"name": "x"``, ``export NAME=x``, ``name := x``, ``name => x``, ``name: type =
"x"``, ``<name>x</name>``). Values are strings of any quotes with escapes, joined
strings (``"a" + "b"``, ``"a" "b"``), strings and words that go on after a
backslash at a line's end, block scalars and bare words. A value that is a name
(``x``, ``$x``, ``${x}``) takes the literal of that constant, defined before or
after it, over as many steps as the text has; comments define no constants. A
literal is scored by the most telling name that reaches it and by its own make-up.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPAN, SPAN_ARROW, map_texts

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
HEAD = re.compile(
    r"(?<![A-Za-z0-9_.$-])(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)[\"'`]?\]?[\x20\t]*+(?P<op>:=|=>|\?=|=(?![=~>])|:(?![:=/]))[\x20\t]*+"
)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>\s*+(?P<value>[^<>\s]++)\s*+</")
QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}", re.S) for q in "\"'"}
PREFIX = re.compile(r"[rRbBfFuU]{1,2}(?=[\"'])")
JOINT = re.compile(r"[\x20\t]*+(?:(?:[+.&]|\\)[\x20\t]*+\r?\n?[\x20\t]*+)?(?=[\"'])")
BARE = re.compile(r"[^\s\"'`,;&?(){}\[\]<>\\]++")
GOES_ON = re.compile(r"\\\r?\n[\x20\t]*+")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[\x20\t]*+\r?\n")
LINE = re.compile(r"([\x20\t]*+)([^\n]*+)(?:\n|\Z)")
OPENS = re.compile(r":[\x20\t]*+[|>][+-]?[0-9]?[+-]?[\x20\t]*+\r?\Z")
TYPED = re.compile(r"[\x20\t]*+=(?![=~>])[\x20\t]*+")
REFERENCE = re.compile(r"\$?\{?\{?\x20?([A-Za-z_][A-Za-z0-9_.-]*)\x20?\}?\}?\Z")
ESCAPE = re.compile(r"\\(?:([nrt0])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.S)
COMMENT = re.compile(r"(?m)(?:^|(?<=\s))(?:#|//)[^\n]*+")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How telling a part of a name is, from 0 to 1.
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "access": 0.4, "auth": 0.6, "bearer": 0.9,
    "signing": 0.5, "encryption": 0.5, "client": 0.2, "api": 0.4, "key": 0.4, "salt": 0.5, "webhook": 0.4, "session": 0.4,
}
PLACEHOLDER = re.compile(r"(?i)(x+|\*+|\.+|0+|changeme.*|example.*|your[_-].*|<.*>|\$\{?.*|%.*|none|null|true|false|todo.*)\Z")
KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 1.0


def name_score(name: str) -> float:
    return min(1.0, sum(NAME_PARTS.get(p.lower(), 0.0) for p in PART.findall(name)))


def literal_score(value: str) -> float:
    """0 for what cannot be a secret, up to 1 for long values of many kinds of characters."""
    n = len(value)
    if n < 8 or any(c.isspace() for c in value) or PLACEHOLDER.match(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = any(c.isdigit() for c in value) + any(c.isalpha() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, entropy / 4) * min(1.0, n / 16) * (0.4 + 0.3 * min(kinds, 2))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind; one that is too short is dropped with all that it covers."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def unescaped(value: str) -> str:
    if "\\" not in value:
        return value
    plain = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}
    return ESCAPE.sub(lambda m: plain[m[1]] if m[1] else chr(int(m[2] or m[3], 16)) if m[2] or m[3] else m[4], value)


class _Lines:
    """The lines of a text: where each begins, its depth, which line ends its block, how many lines up to it open blocks."""

    def __init__(self, text: str) -> None:
        self.at, self.rows, self.until, self.opened = [], [], [], [0]
        deeper: list[int] = []  # lines whose block goes on, each one deeper than the last
        at = 0
        while at < len(text):
            m = LINE.match(text, at)
            depth, body, i = len(m[1]), m[2].strip(), len(self.at)
            while body and deeper and self.rows[deeper[-1]][0] >= depth:
                self.until[deeper.pop()] = i
            if body:
                deeper.append(i)
            self.at.append(at)
            self.rows.append((depth, m.start(2), m.end(2), m[2] if body else ""))
            self.until.append(-1)
            self.opened.append(self.opened[-1] + bool(OPENS.search(m[2])))
            at = m.end()
        for i in deeper:
            self.until[i] = len(self.at)


class _Reader:
    """Reads the values of one text. A closing mark that is not found is not sought again."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.absent: set[str] = set()
        self.lines: _Lines | None = None

    def close(self, mark: str, at: int) -> int:
        if mark in self.absent:
            return -1
        end = self.text.find(mark, at)
        if end < 0:
            self.absent.add(mark)
        return end

    def string(self, at: int) -> tuple[int, int, int, str] | None:
        """(start, end, next, value) of the string that begins here; start and end are those of what it holds."""
        if m := PREFIX.match(self.text, at):
            at = m.end()
        mark = self.text[at : at + 3]
        if mark not in ('"""', "'''"):
            mark = mark[:1]
        if len(mark) == 3 or mark == "`":
            end = self.close(mark, at + len(mark))
            return None if end < 0 else (at + len(mark), end, end + len(mark), unescaped(self.text[at + len(mark) : end]))
        m = QUOTED[mark].match(self.text, at) if mark in QUOTED else None
        return m and (m.start(1), m.end(1), m.end(), unescaped(m[1]))

    def value(self, at: int, name_at: int, op: str) -> tuple[int, int, str, str | None] | None:
        """(start, end, value, name of the constant that it may be) of the value that begins here."""
        if s := self.string(at):
            start, end, on, *parts = s
            while (j := JOINT.match(self.text, on)) and (s := self.string(j.end())):
                end, on = s[1], s[2]
                parts.append(s[3])
            value = "".join(parts)
            ref = REFERENCE.match(value) if "$" in value or "{" in value else None
            return start, end, value, ref and ref[1]
        if op == ":" and (m := BLOCK.match(self.text, at)):
            return self.block(m.end(), name_at)
        if not (m := BARE.match(self.text, at)):
            if self.text.startswith(("${", "{{"), at) and (r := re.compile(r"\$?\{\{?\x20?([A-Za-z_][A-Za-z0-9_.-]*+)\x20?\}\}?").match(self.text, at)):
                return at, r.end(), r[0], r[1]
            return None
        if op == ":" and (t := TYPED.match(self.text, m.end())):
            return self.value(t.end(), name_at, "=")
        start, end, parts = m.start(), m.end(), [m[0]]
        while (g := GOES_ON.match(self.text, end)) and (m := BARE.match(self.text, g.end())):
            end = m.end()
            parts.append(m[0])
        value = "".join(parts)
        if value == "$" and self.text.startswith("{", end) and (r := re.compile(r"\{([A-Za-z_][A-Za-z0-9_.-]*+)\}").match(self.text, end)):
            return start, r.end(), value + r[0], r[1]
        ref = REFERENCE.match(value)
        return start, end, value, ref and ref[1]

    def block(self, at: int, name_at: int) -> tuple[int, int, str, str | None] | None:
        """Lines that are indented deeper than the name's line. One that holds blocks of its own is no literal: its value is empty."""
        lines = self.lines = self.lines or _Lines(self.text)
        i = bisect_right(lines.at, name_at) - 1
        to = lines.until[i]
        if lines.opened[to] > lines.opened[i + 1]:
            return at, lines.rows[to - 1][2], "", None
        rows = [r for r in lines.rows[i + 1 : to] if r[3]]
        return (rows[0][1], rows[-1][2], "".join(r[3] for r in rows), None) if rows else None


def assignments(text: str) -> list[tuple[str, int, tuple[int, int, str, str | None]]]:
    """(name, where the name stands, value) of every assignment, in order."""
    read = _Reader(text)
    found = []
    at = 0
    while m := HEAD.search(text, at):
        at = m.end()
        if (v := read.value(at, m.start(), m["op"])) and v[0] < v[1]:
            found.append((m["name"], m.start(), v))
            # what stands in a value of several lines is read too, what stands in another one is not
            at = v[1] if text.find("\n", v[0], v[1]) < 0 else at
    if "</" in text:
        found += [(m["name"], m.start(), (m.start("value"), m.end("value"), m["value"], None)) for m in ELEMENT.finditer(text)]
        found.sort(key=lambda x: x[1])
    return found


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive name, directly or through constants."""
    if ":" not in text and "=" not in text and "</" not in text:
        return []
    found = assignments(text)
    if not any(name_score(n) for n, _, _ in found):
        return []
    defined: dict[str, list[int]] = {}  # name -> its assignments, in order
    if any(v[3] for _, _, v in found):
        hidden = [m.span() for m in COMMENT.finditer(text)]
        starts = [a for a, _ in hidden]
        for i, (name, at, _) in enumerate(found):
            k = bisect_right(starts, at) - 1
            if k < 0 or at >= hidden[k][1]:
                defined.setdefault(name.removeprefix("$"), []).append(i)

    def follows(i: int) -> int:
        """The assignment of the constant that this one's value names: the nearest before it, else after it; itself if there is none."""
        if (name := found[i][2][3]) not in defined:
            return i
        where = defined[name]
        k = bisect_left(where, i)
        return where[k - 1] if k else next((w for w in where[:2] if w != i), i)

    source: dict[int, int] = {}  # the assignment whose literal this one's value is; in a circle, the one before the first

    def trace(i: int) -> int:
        """Each step is taken once for all names: what a walk has passed keeps its end."""
        way, place = [], {}
        while i not in source and i not in place:
            place[i] = len(way)
            way.append(i)
            i = follows(i)
        k = place.get(i, len(way))
        source.update((x, way[j - 1] if j > k else way[-1]) for j, x in enumerate(way[k:], k))
        source.update((x, source[i]) for x in way[:k])
        return source[way[0] if way else i]

    best: dict[tuple[int, int, str], float] = {}
    for i, (name, _, _) in enumerate(found):
        if score := name_score(name):
            a, b, value, _ = found[trace(i)][2]
            best[a, b, value] = max(best.get((a, b, value), 0.0), score)
    return [("literal", a, b) for (a, b, v), s in best.items() if (own := literal_score(v)) >= 0.3 and s + own >= THRESHOLD]


def all_spans(text: str) -> tuple[list, list]:
    order = {k: i for i, k in enumerate(KINDS)}
    place = lambda s: (s[1], order[s[0]], s[2])
    base = sorted(base_spans(text), key=place)
    more = literal_spans(text)
    if more:
        starts = [a for _, a, _ in base]
        ends = list(accumulate((b for _, _, b in base), max))  # the furthest end of the spans up to each one
        free = lambda x: (k := bisect_left(starts, x[2])) == 0 or ends[k - 1] <= x[1]
        more = [x for x in more if free(x)]
    return base, sorted(base + more, key=place)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans put as ``[SECRET]``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``base`` and ``spans``, arrays of (kind, start, end) in code points, by start and kind.

    Null and empty texts have no spans, repeated rows equal ones, an empty table no
    rows. Texts are read whole, in time linear in their length; of spans that begin
    together the kinds' order decides. Columns of these names are replaced.
    """
    def fn(texts: list[str]) -> list[pa.Array]:
        found = [all_spans(t) for t in texts]
        row = lambda x: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in x]
        return [pa.array([row(x[i]) for x in found], SPAN_ARROW) for i in (0, 1)]

    return map_texts(df, [T.StructField("base", SPAN), T.StructField("spans", SPAN)], fn, text, keep)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every secret in the text masked. Null texts stay null, empty ones empty, and every row stays."""
    name = max(df.columns, key=len) + "_masked"  # no column has it
    out = map_texts(df, [T.StructField(name, T.StringType())], lambda texts: [pa.array([mask(t, all_spans(t)[1]) for t in texts], pa.string())], text)
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col(name))).select(*df.columns)
