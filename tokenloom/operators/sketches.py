"""Sketches of token sets and counts: sizes, estimates, and storage as binary columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bloom_bits(n: Column, p: Column) -> Column:
    """Bits for n items at a false-positive rate of p, rounded up to a power of two."""
    need = -n * F.log(p) / (math.log(2) ** 2)
    return F.pow(F.lit(2.0), F.ceil(F.log2(need))).cast("bigint")


def bloom_hashes(n: Column, bits: Column) -> Column:
    """Hash functions for that many items and bits, one at least."""
    return F.greatest(F.floor(bits / n * math.log(2)), F.lit(1)).cast("int")


def bloom_estimate(bits: Column, hashes: Column, ones: Column) -> Column:
    """Distinct items of a filter with so many bits set."""
    return -bits / hashes * F.log(1 - ones / bits)


def bit_positions(token: Column, bits: int, hashes: int, step: int = 47) -> Column:
    """Places of a token's bits; the hash functions' seeds are multiples of step."""
    return F.array(*(F.pmod(F.xxhash64(token, F.lit(i * step)), F.lit(bits)) for i in range(hashes)))


def bloom(tokens: DataFrame, bits: int, hashes: int, column: str = "token") -> DataFrame:
    """(word, value): the filter as numbered 32-bit words that have a bit set, built by aggregation."""
    at = tokens.select(F.explode(bit_positions(F.col(column), bits, hashes)).alias("b"))
    return at.groupBy((F.col("b") / 32).cast("bigint").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 32 AS INT))")).alias("value"))


def bloom_contains(tokens: DataFrame, words: DataFrame, bits: int, hashes: int, column: str = "token") -> DataFrame:
    """tokens with `maybe`: whether all of a token's bits are set."""
    at = tokens.select(column).distinct().select(column, F.explode(bit_positions(F.col(column), bits, hashes)).alias("b"))
    hit = at.withColumn("word", (F.col("b") / 32).cast("bigint")).join(words, "word", "left").select(column, (F.coalesce("value", F.lit(0).cast("bigint")).bitwiseAND(F.expr("shiftleft(1L, CAST(b % 32 AS INT))")) != 0).alias("set"))
    return tokens.join(hit.groupBy(column).agg(F.min("set").alias("maybe")), column)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _hashed(token: np.ndarray) -> np.ndarray:
    """What the hash functions of LONG tokens begin with: Spark's xxhash64 over arrays."""
    h = _rotated(token.view(np.uint64) * _P2, 31) * _P1 ^ np.uint64((42 + 8 + int(_P5)) % 2**64)
    return _mixed(_rotated(h, 27) * _P1 + _P4)


def _place(hashed: np.ndarray, seed: int, bits: int) -> np.ndarray:
    own = (hashed + np.uint64(int(_P5) + 4)) ^ np.uint64(seed * int(_P1) % 2**64)
    return np.mod(_mixed(_rotated(own, 23) * _P2 + _P3).view(np.int64), np.int64(bits))


def bit_places(token: np.ndarray, bits: int, hashes: int, step: int = 47) -> list[np.ndarray]:
    """bit_positions of an array of LONG tokens, an array for each hash function."""
    h = _hashed(token)
    return [_place(h, i * step, bits) for i in range(hashes)]


def filter_bytes(words: DataFrame, bits: int) -> np.ndarray:
    """The filter's 32-bit words as one array, to be broadcast: bits / 8 bytes on the driver and in each Python worker."""
    out = np.zeros(bits // 32 + 1, np.uint32)
    rows = words.select("word", "value").toArrow()
    out[rows["word"].to_numpy()] = rows["value"].to_numpy().astype(np.uint32)
    return out


def maybe_in(token: np.ndarray, words: np.ndarray, bits: int, hashes: int, step: int = 47) -> np.ndarray:
    """bloom_contains for an array of tokens: whether all of a token's bits are set."""
    h, left = _hashed(token), np.arange(len(token))
    for i in range(hashes):
        at = _place(h[left], i * step, bits)
        left = left[(words[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)) != 0]
    out = np.zeros(len(token), bool)
    out[left] = True
    return out


def ones(words: DataFrame) -> DataFrame:
    """(ones): bits set."""
    return words.agg(F.coalesce(F.sum(F.bit_count("value")), F.lit(0)).alias("ones"))


def distinct_sketch(tokens: DataFrame, keys: list[str] | None = None, column: str = "token", log_registers: int = 10) -> DataFrame:
    """keys, sketch (binary) of the distinct tokens; sketches of parts merge into that of the whole."""
    return tokens.groupBy(*(keys or [])).agg(F.hll_sketch_agg(column, F.lit(log_registers)).alias("sketch"))


def merged_sketch(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return sketches.groupBy(*(keys or [])).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def count_sketch(tokens: DataFrame, keys: list[str] | None = None, column: str = "token", eps: float = 0.001, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """keys, sketch (binary): count-min sketch of the tokens' counts."""
    return tokens.groupBy(*(keys or [])).agg(F.count_min_sketch(F.col(column), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def count_min(tokens: DataFrame, depth: int, width: int, column: str = "token", seed: int = 1) -> DataFrame:
    """(row, cell, n): a count-min sketch as a table of its counters, built by aggregation; tables add up to that of all tokens."""
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(column, F.lit(seed * 47 + r)), F.lit(width)).alias("cell")) for r in range(depth)))
    return tokens.groupBy(column).agg(F.count("*").alias("__n__")).select(F.explode(cells).alias("c"), "__n__").groupBy("c.row", "c.cell").agg(F.sum("__n__").alias("n"))


def count_min_estimates(tokens: DataFrame, sketch: DataFrame, depth: int, width: int, column: str = "token", seed: int = 1) -> DataFrame:
    """(token, estimate) of distinct tokens: the least of their counters, 0 where one is missing."""
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(column, F.lit(seed * 47 + r)), F.lit(width)).alias("cell")) for r in range(depth)))
    asked = tokens.select(column).distinct().select(column, F.explode(cells).alias("c")).select(column, "c.row", "c.cell")
    return asked.join(sketch, ["row", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def saved(sketches: DataFrame, path: str, mode: str = "error") -> None:
    """Sketches are rows of counters, words or binary columns, so they are stored like any other table."""
    sketches.write.mode(mode).parquet(path)


def loaded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
