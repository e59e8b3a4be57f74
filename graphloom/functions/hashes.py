"""Hashes and path functions as columns; hashes of 64-bit words run over Arrow batches, as numbers must wrap there."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def djb2(data: Column) -> Column:
    """The 64-bit hash h = 33 h + byte from 5381, of a string's UTF-8 bytes, as a signed long."""
    hex_ = F.hex(data.cast("binary"))
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda i: F.conv(F.substring(hex_, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    # 33 h is h shifted and added, which wraps in 64 bits under any overflow setting
    step = lambda h, c: _add(_add(F.shiftleft(h, 5), h), c)
    return F.when(F.octet_length(data) == 0, F.lit(5381).cast("long")).otherwise(F.aggregate(codes, F.lit(5381).cast("long"), step))


def _add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64: the low 63 bits are added apart, so nothing overflows."""
    low = F.lit((1 << 62) - 1)
    s = a.bitwiseAND(low) + b.bitwiseAND(low)
    top = F.shiftrightunsigned(a, 62) + F.shiftrightunsigned(b, 62) + F.shiftrightunsigned(s, 62)
    return F.shiftleft(top.bitwiseAND(F.lit(3)), 62).bitwiseOR(s.bitwiseAND(low))


def wrapped_product(a: Column, factor: int) -> Column:
    """A long times a whole number modulo 2^64, as a signed long, under any overflow setting: limbs of 32 bits times limbs of 31, none of which overflows."""
    low, high = a.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(a, 32)
    limbs = [(F.lit((factor % (1 << 64) >> at) & ((1 << 31) - 1)).cast("long"), at) for at in (0, 31, 62)]
    parts = [F.shiftleft(x * k, at + by) for x, by in ((low, 0), (high, 32)) for k, at in limbs if at + by < 64]
    return reduce(_add, parts)


#: The word that is mixed in, and the rotation (fixed values).
SALT, TURN = 0x1F3D5B79, 14


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hashes h with a word more each; numpy's 64-bit numbers without sign wrap."""
    turned = lambda x: (x << np.uint64(TURN)) | (x >> np.uint64(64 - TURN))
    return (turned(turned(h + w + np.uint64(SALT)) ^ w) ^ np.uint64(SALT)) + w


def _folded(starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of each run ``words[start:end]``: the n-th words of all runs that have one are mixed in at once."""
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    shorter, first, h = (starts - ends)[order], starts[order], out[order]
    for n in range(-int(shorter[0]) if len(shorter) else 0):
        have = np.searchsorted(shorter, -n)  # runs longer than n
        h[:have] = _mixed(h[:have], words[first[:have] + n])
    out[order] = h
    return out


def _bounds(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends among the values of lists; null lists are empty."""
    at = lists.offsets.to_numpy().astype(np.int64)
    null = lists.is_null().to_numpy(zero_copy_only=False)
    return at[:-1], np.where(null, at[:-1], at[1:])


def jodyhash(words: Column) -> Column:
    """A 64-bit hash of an array of 64-bit words, as a signed long; of an empty array 0, of null or with a null word null."""

    def run(a: pa.Array) -> pa.Array:
        starts, ends = _bounds(a)
        holes = np.concatenate([[0], np.cumsum(a.values.is_null().to_numpy(zero_copy_only=False))])
        null = a.is_null().to_numpy(zero_copy_only=False) | (holes[ends] > holes[starts])
        return pa.array(_folded(starts, ends, a.values.fill_null(0).to_numpy().view(np.uint64)).view(np.int64), mask=null)

    return _arrow(run)(words.cast("array<bigint>"))


def _arrow(run: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    def hashed(a: pa.Array) -> pa.Array:
        return run(a)

    return F.arrow_udf(hashed, "long")


#: Numbers of simple types, the word that mixes them in, and the hashes of what is not followed (fixed values).
TYPE_NUMBERS = {"tinyint": 5, "smallint": 6, "int": 7, "bigint": 8, "boolean": 10}
TYPE_MIX = 0x5A5A5A5A5A5A5A5A
LEAF_ARRAY, LEAF_RECORD, NULL_POINTER = 0x797272414661654C, 0x647263526661654C, 0x726174536C6C754E
DEPTH = 8


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def nested_hash(value: Column, kind: T.DataType, depth: int = DEPTH) -> Column:
    """A 64-bit hash of a value of any type made of whole numbers, booleans, arrays and records, as a signed long.

    Simple values are mixed with the number of their type, the parts of arrays and
    records are hashed one level deeper and joined by ``jodyhash`` in order. Deeper
    than ``depth`` levels an array or record has a hash of its own, whatever it holds; a null
    has one too, at any depth. A batch of values is hashed level by level, all values of a
    level at once. Other types are a TypeError.
    """
    _check(kind, depth)
    return _arrow(lambda a: pa.array(_hashed(a, kind, depth).view(np.int64)))(value)


def _check(kind: T.DataType, depth: int) -> None:
    if isinstance(kind, T.StructType):
        for f in kind.fields if depth else ():
            _check(f.dataType, depth - 1)
    elif isinstance(kind, T.ArrayType):
        if depth:
            _check(kind.elementType, depth - 1)
    elif kind.simpleString() not in TYPE_NUMBERS:
        raise TypeError(f"no hash for {kind.simpleString()}")


def _hashed(a: pa.Array, kind: T.DataType, depth: int) -> np.ndarray:
    if isinstance(kind, T.StructType):
        out = np.full(len(a), 0 if depth else LEAF_RECORD, np.uint64)
        for i, f in enumerate(kind.fields if depth else ()):
            out = _mixed(out, _hashed(a.field(i), f.dataType, depth - 1))
    elif isinstance(kind, T.ArrayType):
        out = _folded(*_bounds(a), _hashed(a.values, kind.elementType, depth - 1)) if depth else np.full(len(a), LEAF_ARRAY, np.uint64)
    else:
        name = kind.simpleString()
        plain = a.fill_null(False if name == "boolean" else 0).to_numpy(zero_copy_only=False)
        out = plain.astype(np.int64).view(np.uint64) ^ np.uint64(TYPE_MIX * TYPE_NUMBERS[name] % (1 << 64))
    return np.where(a.is_null().to_numpy(zero_copy_only=False), np.uint64(NULL_POINTER), out)


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` resolved in the text alone; a ``..`` with no named part before it stays."""
    up = lambda a: (F.size(a) > 0) & (F.get(a, F.size(a) - 1) != "..")
    step = lambda a, p: F.when((p == ".") | (p == ""), a).when((p == "..") & up(a), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def joined_path(directory: Column, path: Column) -> Column:
    """A path seen from a directory; an absolute one stands alone."""
    return F.when(path.startswith("/") | directory.isNull() | (directory == ""), path).otherwise(F.concat_ws("/", directory, path))
