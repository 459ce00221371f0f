"""Joins in which null keys are keys like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakroom.functions.crypto import lookup_key

#: Rows of one narrow key column that are sent to all executors at most (some MB).
BROADCAST_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with null equal to null; the keys come out once, from the left.

    Spark plans ``<=>`` as a hash or sort-merge join like any equality.
    """
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    out = left.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The right side of a join, marked by its number of rows: for broadcast, or to be shuffled.

    Spark goes by the bytes of the files underneath, and a few MB of Parquet can be a GB
    of rows: unmarked, these would pass through the driver.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if a count proves it small, else for a shuffled join."""
    return sized(df, df.limit(BROADCAST_ROWS + 1).count())


#: Words of 64 bits that a sieve has: some MB, for any number of keys.
SIEVE_WORDS = 1 << 17


def sieved(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``by`` isn't in ``keys`` (none is lost whose is), without a shuffle.

    Each key sets three bits of one word (a Bloom filter); the words are broadcast. Of
    500,000 keys, about one other row in 200 stays, of 2,000,000 about one in eight.
    """

    def hashed(df):
        return df.withColumn("_h", F.xxhash64(F.lit(13), *by)).withColumn("_w", F.pmod("_h", F.lit(SIEVE_WORDS)))

    bits = F.expr("|".join(f"shiftleft(1L, int(shiftright(_h, {k}) & 63L))" for k in (20, 30, 40)))
    words = hashed(keys).groupBy("_w").agg(F.bit_or(bits).alias("_bits"))
    return hashed(rows).join(F.broadcast(words), "_w").where(F.col("_bits").bitwiseAND(bits) == bits).drop("_h", "_w", "_bits")


def row_key(text: Column, passphrase: str | None = None) -> Column:
    """What tells rows of equal text keys apart: 128 bits of the text, or its keyed lookup.

    Rows that agree in this, too, are equal, and so is what is found in them.
    """
    if passphrase is not None:
        return lookup_key(F.lit("row"), text, passphrase)
    return F.concat_ws("-", F.xxhash64(text), F.xxhash64(F.lit(7), text))
