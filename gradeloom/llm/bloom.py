"""Bloom filters as small tables of bitmaps, in Spark functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import materialise

#: Bits of one bitmap of bitmap_construct_agg.
CHUNK = 32768


def slots_for(rows: int, *, bits_per_row: int, functions: int, max_bits: int) -> int:
    """Slots of each hash function; together at most ``max_bits`` and a chunk each."""
    return min(max(rows * bits_per_row, CHUNK), max_bits) // functions // CHUNK * CHUNK + CHUNK


def slot(key: Column, function: int, slots: int) -> Column:
    """Slot of a key under one hash function; each function has slots of its own."""
    return F.pmod(F.xxhash64(key, F.lit(function)), F.lit(slots)) + F.lit(function * slots)


def _longs(bitmap: Column) -> Column:
    """A bitmap's bytes as an array of longs, eight bytes each, the first one highest."""
    eight = lambda i: F.conv(F.hex(F.substring(bitmap, i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 64 - 1)), eight)


def _bit(longs: Column, at: Column) -> Column:
    position = F.bitmap_bit_position(at).cast("int")
    shift = F.lit(56) - F.floor(position % 64 / 8).cast("int") * 8 + position % 8
    return F.coalesce(F.getbit(F.get(longs, F.floor(position / 64).cast("int")), shift) == 1, F.lit(False))


def bitmaps(keys: DataFrame, key: str, slots: int, functions: int, repeated: bool = False) -> DataFrame:
    """(chunk, bits) of the slots that the keys hit, or that at least two rows hit."""
    hit = keys.select(F.explode(F.array(*[slot(F.col(key), i, slots) for i in range(functions)])).alias("slot"))
    if repeated:
        hit = hit.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return materialise(hit.groupBy(F.bitmap_bucket_number("slot").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")), "bloom")


def flag(rows: DataFrame, key: Column, filters: DataFrame, slots: int, functions: int, name: str) -> DataFrame:
    """Add a boolean: whether all slots of the key are set.

    The bitmaps are broadcast: their bits are bounded by slots * functions.
    """
    columns, tests = rows.columns, []
    for i in range(functions):
        side = filters.select(F.col("chunk").alias(f"_chunk{i}"), _longs(F.col("bits")).alias(f"_bits{i}"))
        at = slot(key, i, slots)
        rows = rows.join(F.broadcast(side), F.bitmap_bucket_number(at) == F.col(f"_chunk{i}"), "left")
        tests.append(_bit(F.col(f"_bits{i}"), at))
    return rows.select(*columns, reduce(lambda a, b: a & b, tests).alias(name))
