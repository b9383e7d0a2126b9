"""A filter of fixed size in front of an equi-join.

The hashes of one side's keys set bits in a table of at most WORDS rows of 64 bits (about 2 MB), which
is broadcast: its size is bounded whatever the data. Rows of the other side whose bit is not set have
no partner and need not be shuffled; the join itself stays exact. When keys are so many that most bits
are set, the filter lets more through and the join is an ordinary one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 17
_WORD, _BITS = "__bitset_word", "__bitset_bits"


def _word(key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 6), F.lit(WORDS))


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))


def bitset(keys: DataFrame, key: Column) -> DataFrame:
    """The filter of a side's keys; key: a 64-bit hash."""
    return keys.select(_word(key).alias(_WORD), _bit(key).alias(_BITS)).groupBy(_WORD).agg(F.bit_or(_BITS).alias(_BITS))


def with_test(rows: DataFrame, key: Column, filter_: DataFrame, name: str) -> DataFrame:
    """rows with a column: may the key be on the other side?"""
    tested = rows.join(F.broadcast(filter_), _word(key) == F.col(_WORD), "left")  # at most WORDS rows
    return tested.withColumn(name, F.coalesce(F.col(_BITS).bitwiseAND(_bit(key)) != 0, F.lit(False))).drop(_WORD, _BITS)


def only_possible(rows: DataFrame, key: Column, filter_: DataFrame) -> DataFrame:
    """Rows whose key may be on the other side."""
    return with_test(rows, key, filter_, "__bitset_test").where("__bitset_test").drop("__bitset_test")
