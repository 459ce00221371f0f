"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakroom.sources.tables import spread

_P = 0x9E3779B97F4A7C15 | 1  # odd multiplier: invertible modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Hand memory that Arrow and the C library hold back for later use to the system (the latter where it is glibc)."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return
    trim(0)


def lean(run):
    """A function for mapInPandas or applyInPandas that gives back what ``run`` has used and freed.

    A Python worker lives on for later tasks, beside its executor's heap: what one task has
    freed and the worker still holds counts against the memory of all that run after it.
    """
    if inspect.isgeneratorfunction(run):

        def leaned(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

    elif run.__code__.co_argcount == 1:

        def leaned(df):
            try:
                return run(df)
            finally:
                give_back()

    else:

        def leaned(df, other):
            try:
                return run(df, other)
            finally:
                give_back()

    return leaned


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _P), ("q", _P_INV)):
            v = np.full(size, base, dtype=np.uint64)
            v[0] = 1
            _POWERS[name] = np.cumprod(v, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


class PrefixHash:
    """Rabin-Karp prefix sums over a byte buffer: the hash of any slice in O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self._inv = _powers(n + 1)
        self.sums = np.empty(n + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE_CODES[data] * p[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self._inv[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 buffer."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def text_batches(texts, max_bytes: int = 1 << 18):
    """Index ranges of consecutive texts of about ``max_bytes`` characters (one text at least)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > max_bytes:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` under internal names, null texts as empty; spread over the cores if in few splits."""
    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def held_out(id_col: Column) -> Column:
    """crc32 of the decimal id modulo 4 equals 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Times to the microsecond, as JSON has them between ``pack_rest`` and ``unpack_rest``.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _plain(kind: T.DataType) -> T.DataType:
    """``kind`` with lists of entries for maps, whose keys JSON would have as strings."""
    if isinstance(kind, T.MapType):
        return T.ArrayType(T.StructType([T.StructField("key", _plain(kind.keyType)), T.StructField("value", _plain(kind.valueType))]))
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f"f{i}", _plain(f.dataType)) for i, f in enumerate(kind.fields)])
    return kind


def _to_plain(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(_to_plain(e["key"], kind.keyType).alias("key"), _to_plain(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _to_plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = [_to_plain(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else c
    return c


def _from_plain(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(c, lambda e: F.struct(_from_plain(e["key"], kind.keyType), _from_plain(e["value"], kind.valueType))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _from_plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = [_from_plain(c.getField(f"f{i}"), f.dataType).alias(f.name) for i, f in enumerate(kind.fields)]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else c
    return c


def pack_rest(df: DataFrame, keep: list[str], name: str = "_rest") -> tuple[DataFrame, T.StructType]:
    """Fold every column outside ``keep`` into one JSON string column, and give their schema.

    Columns go by their number, so names can't clash; times keep their microseconds, maps
    become lists of entries.
    """
    rest = [f for f in df.schema if f.name not in keep]
    cells = [_to_plain(F.col(f"`{f.name}`"), f.dataType).alias(f"f{i}") for i, f in enumerate(rest)]
    packed = F.to_json(F.struct(*cells), _TIMES) if cells else F.lit("{}")
    return df.select(*[F.col(f"`{c}`") for c in keep], packed.alias(name)), T.StructType(rest)


def unpack_rest(df: DataFrame, schema: T.StructType, name: str = "_rest") -> DataFrame:
    """Undo ``pack_rest``."""
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    cells = F.from_json(F.col(f"`{name}`"), _plain(schema), _TIMES)
    opened = df.select(*others, cells.alias(name)) if schema.fields else df
    back = [_from_plain(F.col(f"`{name}`").getField(f"f{i}"), f.dataType).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    return opened.select(*others, *back)


def blocks_of(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """How many blocks of about ``rows_each`` rows the table needs (a count, no data)."""
    return max(least, -(-df.count() // rows_each))
