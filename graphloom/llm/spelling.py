"""Spelling variants of a vocabulary by a bit-sliced position index.

Words that differ by one edit agree in the front or the rear half of the shorter
one, so each word goes to the blocks of its halves. A task lays the words of its
blocks out as bits: for each position and letter one bitset of the words that
have it there. A query of L letters takes L steps. A step and-s the bitsets of the
query's letter at the same, the next and the last position into four sets at once:
words without an error so far, and words with one replaced, one more and one
letter less. All queries of a length go together, 64 words an operation.

Blocks of over ``TILE`` words are split by hash; each pair of parts is a unit of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut
from .common import short

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, LEAST, SPOIL = 5, 3, 97
#: Distinct words that a task counts before it sends them on.
TOGETHER = 200_000
#: Words of a block that are compared at once; letters of words that are laid out at once.
TILE, LETTERS = 4096, 1 << 22
#: Words that are gathered from small blocks; 64-bit cells of a set of queries.
UNIT, CELLS = 1024, 1 << 17

_NEAR = "word string, n_near long, best_n long, best string"


def spoilt(doc_id: object, run: str, prefix: int) -> str:
    """The run, without one code point if ``SPOIL`` divides the checksum of ``<doc_id>:<run>``; ``prefix`` is that of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % SPOIL else run[: (k := h % len(run))] + run[k + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): letter runs with A to Z lower-cased and spoilt, of ``shortest`` code points and ``least`` occurrences at least.

    Null texts have none; a null id counts as an empty one. Tasks count before words are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                if not (t := t.as_py()):
                    continue
                i = i.as_py()
                prefix = zlib.crc32(f"{'' if i is None else i}:".encode())
                # bytes.lower() lowers A to Z alone
                for w, n in Counter(RUN.findall(t.encode().lower().decode())).items():
                    if len(w := spoilt(i, w, prefix)) >= shortest:
                        seen[w] += n
                if len(seen) >= TOGETHER:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counted = docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class _Index:
    """Bitsets over a list of words, by position and letter."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.array([len(w) for w in words])
        width = int(self.size.max()) + 2
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters, code = np.unique(flat, return_inverse=True)
        self.letters = len(letters)
        self.code = np.full((len(words), width), self.letters, dtype=np.int32)  # past the end
        self.code[np.arange(width) < self.size[:, None]] = code
        self.cells = -(-len(words) // 64)

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((*rows.shape[:-1], self.cells * 64), dtype=bool)
        out[..., : rows.shape[-1]] = rows
        return np.packbits(out, axis=-1, bitorder="little").view(np.uint64)

    def _at(self, position: int) -> np.ndarray:
        """The bitsets of one position: a row for each letter, the last one for none."""
        return self._bits(self.code[:, position] == np.arange(self.letters + 1)[:, None])

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): pairs of words that differ by exactly one edit, in the order of ``queries``, which are of one length."""
        size = int(self.size[queries[0]])
        of_size = {n: self._bits(self.size == n) for n in (size - 1, size, size + 1)}
        none = np.zeros((len(queries), self.cells), dtype=np.uint64)
        here, after = self._at(0), self._at(1)
        before = np.zeros_like(here)
        exact, changed, less = none + self._bits(self.size >= 0), none, none
        more = exact & ~here[-1]
        for j in range(size):
            q = self.code[queries, j]
            same, onward = here[q], exact & here[q]
            changed = (changed & same) | (exact & ~same & ~here[-1])
            less = (less & before[q]) | exact
            more = (more & after[q]) | (onward & ~after[-1])
            exact = onward
            if j + 1 < size:
                before, here, after = here, after, self._at(j + 2)
        found = (changed & of_size[size]) | (more & of_size[size + 1]) | (less & of_size[size - 1])
        r, c = np.nonzero(found)
        bit = np.unpackbits(found[r, c].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, b = np.nonzero(bit)
        return queries[r[k]], c[k] * 64 + b


def _near_in(words: list[str], n: np.ndarray, block: np.ndarray, least: np.ndarray, rear: np.ndarray, own: np.ndarray, tile: np.ndarray) -> pa.RecordBatch | None:
    """For each word of the blocks that has near words there: how many, and the most frequent one. A pair counts in one block alone."""
    index = _Index(words)
    pairs = []
    for size in np.unique(index.size):
        queries = np.flatnonzero(index.size == size)
        step = max(1, CELLS // index.cells)
        pairs += [index.near(queries[i : i + step]) for i in range(0, len(queries), step)]
    q, w = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    ok = (block[q] == block[w]) & (np.minimum(index.size[q], index.size[w]) == least[q]) & ((tile[q] == 1) | (own[q] != own[w]))
    q, w = q[ok], w[ok]
    for a in range(0, len(q), UNIT):  # a pair that agrees in both halves counts in the block of the front one
        part = np.flatnonzero(rear[q[a : a + UNIT]]) + a
        if len(part):
            half = int(least[q[part]].max()) // 2
            front = np.arange(half) < (least[q[part]] // 2)[:, None]
            both = ((index.code[q[part], :half] == index.code[w[part], :half]) | ~front).all(axis=1)
            q[part[both]] = -1
    w, q = w[q >= 0], q[q >= 0]
    if not len(q):
        return None
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    order = np.lexsort((rank[w], q))
    q, w = q[order], w[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[i] for i in q[first]], pa.string()), "n_near": pa.array(np.diff(np.append(first, len(q))), pa.int64()),
        "best_n": pa.array(n[w[first]], pa.int64()), "best": pa.array([words[i] for i in w[first]], pa.string()),
    })


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word of (word, n) that has near ones, words that differ by exactly one code point
    put in, left out or replaced: how many, and the one of largest n, the smallest in code point order of equal ones.

    Words are distinct and not null. One without near words is absent; an empty table gives no rows.
    """
    size = F.char_length("word")
    halves = [(m, rear) for m in (size, size - 1) for rear in (False, True)]
    part = lambda m, rear: F.expr("word").substr(size - (m - F.floor(m / 2)) + 1, m) if rear else F.expr("word").substr(F.lit(1), F.floor(m / 2).cast("int"))
    blocks = F.array(*(F.struct(m.alias("least"), F.lit(rear).alias("rear"), part(m.cast("int"), rear).alias("part")) for m, rear in halves))
    keyed = words.filter("word <> ''").select("word", "n", F.explode(blocks).alias("b")).select("word", "n", "b.*")
    key = ["least", "rear", "part"]
    counts = keyed.groupBy(*key).count().filter("count > 1")  # a word alone in its block has no near one there
    large = short(counts.filter(F.col("count") > TILE).select(*key, F.ceil(F.col("count") / TILE).cast("int").alias("parts")))
    keyed = keyed.join(large, key, "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.lit(0)))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    unit = keyed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("parts", "other")
    at = [*key, "low", "high"]
    dealt = unit.repartition(*at).sortWithinPartitions(*at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of whole units
        last: list[tuple] = []  # of the unit that may go on
        letters, unit_of = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            units = [r[3:] for r in rows]
            block = np.cumsum([0] + [a != b for a, b in zip(units[1:], units, strict=False)])
            cols = [np.array(x) for x in zip(*((r[1], r[3], r[4], r[2], r[6] == r[7]) for r in rows), strict=True)]
            found = _near_in([r[0] for r in rows], cols[0], block, cols[1], cols[2], cols[3], cols[4])
            if found is not None:
                yield found

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if r[3:] != unit_of:
                    if len(last) > 1:
                        rows += last
                        letters += sum(len(x[0]) for x in last)
                    last, unit_of = [], r[3:]
                    if len(rows) >= UNIT or letters >= LETTERS:
                        yield from done()
                        rows, letters = [], 0
                last.append(r)
        if len(last) > 1:
            rows += last
        if rows:
            yield from done()

    found = dealt.select("word", "n", "own", *at).mapInArrow(run, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. By doubling; forms have no circles."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = cut(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = both.drop("moved")
        if both.filter("moved").isEmpty():
            return state


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", times: int = 2) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of every word of the texts' vocabulary.

    A word's form is its most frequent near word, if that is at least ``times`` as
    frequent, else null; of equal ones the smallest in code point order. Forms are
    more frequent than their words, so following them ends, at the root; a word
    without a form is its own. Null and empty texts have no words, repeated rows
    count each, long texts are read whole, an empty table gives no rows. Other columns are not read.
    """
    words = cut(vocabulary(docs, id_col, text))
    near = cut(near_words(words))
    both = words.join(near, "word", "left")
    fit = F.col("best_n") >= times * F.col("n")
    both = cut(both.select("word", "n", F.when(fit, F.col("best")).alias("form"), F.when(fit, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    return both.join(roots(both.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
