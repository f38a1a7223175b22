"""Hashed bitmaps (Bloom filters) built and probed with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergamo.session import settle

#: Bits of a stored bucket, as a power of two: an array of 512 longs.
BUCKET = 15
#: Smallest and largest filter, as powers of two of its bits; 2^30 bits are 128 MB, which bounds the broadcast.
LEAST, MOST = 20, 30
SEEDS = (11, 23)


def filter_bits(n: int, per_key: int = 16) -> int:
    """Power of two of the bits that n keys need, within LEAST and MOST."""
    return min(MOST, max(LEAST, (max(1, n) * per_key - 1).bit_length()))


def _places(key: Column, bits: int, seeds: tuple[int, ...]) -> list[Column]:
    return [F.xxhash64(F.lit(s), key).bitwiseAND(F.lit((1 << bits) - 1)) for s in seeds]


def build(keys: DataFrame, key: str, bits: int, least: int = 1, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(bucket, words): bits hit by at least `least` keys, as an array of longs; a bucket without a bit is left out.

    Places are combined within each task before they shuffle, as rows of two numbers."""
    places = keys.select(F.explode(F.array(*_places(F.col(key), bits, seeds))).alias("p"))
    if least > 1:
        places = places.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("word"))
    per = 1 << (BUCKET - 6)
    held = words.groupBy(F.shiftright("w", BUCKET - 6).alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(F.lit(per - 1)).cast("int"), "word"))).alias("m"))
    return settle(held.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words")))


def probe(rows: DataFrame, key: str, filter_: DataFrame, bits: int, flag: str, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """rows with the boolean column `flag`: false means that the filter surely lacks the key."""
    out, cols, test = rows, rows.columns, F.lit(True)
    for i, place in enumerate(_places(F.col(key), bits, seeds)):
        side = filter_.select(F.col("bucket").alias(f"_b{i}"), F.col("words").alias(f"_w{i}"))
        out = out.withColumn(f"_p{i}", place).join(F.broadcast(side), F.shiftright(f"_p{i}", BUCKET) == F.col(f"_b{i}"), "left")
        word = F.get(F.col(f"_w{i}"), F.shiftright(f"_p{i}", 6).bitwiseAND(F.lit((1 << (BUCKET - 6)) - 1)).cast("int"))
        test = test & F.coalesce(F.getbit(word, F.col(f"_p{i}").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))
    return out.select(*cols, test.alias(flag))
