"""A blocked Bloom filter made and probed with DataFrame functions alone.

A key sets a few bits in one block of 512 bits (eight longs). The filter is a table with a
row per block that has any bit set. Its size is fixed by the number of keys, known before
it is built, so the side to broadcast is checked; a filter beyond the bound is joined by a
shuffle on the block instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Bytes of filter up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class BlockedBloom:
    table: DataFrame  # block long, w0..w7 long
    blocks: int
    bits_per_key: int

    @property
    def broadcastable(self) -> bool:
        return self.blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _bits(key: Column, hashes: int) -> list[Column]:
    """Bit numbers, 0 to 511, from a second hash by nine bits each."""
    h = F.xxhash64(key, F.lit(7))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511).cast("long")) for i in range(hashes)]


HASHES = 6


def build(keys: DataFrame, key: str, bits_per_key: int = 12, n_keys: int | None = None) -> BlockedBloom:
    """The filter of a column of strings or numbers; null keys are left out."""
    kept = keys.select(F.col(key).alias("k")).where("k is not null")
    n = kept.count() if n_keys is None else n_keys
    blocks = max(1, -(-n * bits_per_key // (64 * WORDS)))
    bits = kept.select(_block(F.col("k"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("k"), HASHES))).alias("bit"))
    word = lambda i: F.bit_or(F.when(F.shiftright("bit", 6) == i, F.expr("shiftleft(1L, int(bit & 63))")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}")
    return BlockedBloom(bits.groupBy("block").agg(*[word(i) for i in range(WORDS)]), blocks, bits_per_key)


def mark(df: DataFrame, key: str, bloom: BlockedBloom, name: str) -> DataFrame:
    """df with a column that tells whether a row's key may be in the filter; it is true for every key that is."""
    own = df.columns
    table = bloom.table.select(F.col("block").alias("_bf"), *[F.col(f"w{i}").alias(f"_bf{i}") for i in range(WORDS)])
    side = F.broadcast(table) if bloom.broadcastable else table
    joined = df.withColumn("_bf_key", _block(F.col(key), bloom.blocks)).join(side, F.col("_bf_key") == F.col("_bf"), "left")
    test = F.lit(True)
    words = F.array(*[F.col(f"_bf{i}") for i in range(WORDS)])
    for b in _bits(F.col(key), HASHES):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        test = test & (F.element_at(words, (F.shiftright(b, 6) + 1).cast("int")).bitwiseAND(mask) != 0)
    return joined.select(*own, F.coalesce(test, F.lit(False)).alias(name))


def maybe_in(df: DataFrame, key: str, bloom: BlockedBloom) -> DataFrame:
    """The rows of df whose key may be in the filter; none that is in it is lost."""
    return mark(df, key, bloom, "_maybe").where("_maybe").drop("_maybe")


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose key is not in the staged table gone (key), nulls kept.

    A small table is broadcast. Beyond that the rows that can't be in it stay where they are, and only the others,
    hardly more than go, are shuffled: a corpus is not moved to take some rows out.
    """
    n = gone.count()
    if n * 32 <= BROADCAST_BYTES:
        return df.join(F.broadcast(gone), key, "left_anti").select(*df.columns)
    marked = mark(df, key, build(gone, key, n_keys=n), "_gone")
    stay = marked.where("not _gone").drop("_gone")
    return stay.union(marked.where("_gone").drop("_gone").join(gone, key, "left_anti").select(*df.columns))


def attach(df: DataFrame, key: str, table: DataFrame, value: str, table_bytes: int) -> DataFrame:
    """df left-joined with a staged table (key, value) whose keys are unique, moving only rows that may have a value."""
    if table_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), key, "left")
    marked = mark(df, key, build(table, key), "_has")
    kind = table.schema[value].dataType
    rest = marked.where("not _has").drop("_has").withColumn(value, F.lit(None).cast(kind))
    return rest.unionByName(marked.where("_has").drop("_has").join(table, key, "left"))
