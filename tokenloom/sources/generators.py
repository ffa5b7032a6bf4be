"""Synthetic genomes and reads, drawn by hash so that any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.tokens import reverse_complement


def _draw(*key: Column | int) -> Column:
    """Uniform number in 0..1 of a key."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / float(1 << 53)


def genome_pair(spark: SparkSession, size: int, difference: float, seed: int = 1) -> DataFrame:
    """(pos, a, b): bases of a random genome, and of one in which each base differs with that probability."""
    base = F.floor(_draw(F.col("id"), seed) * 4).cast("int")
    shift = F.floor(_draw(F.col("id"), seed + 2) * 3).cast("int") + 1
    other = F.when(_draw(F.col("id"), seed + 1) < difference, (base + shift) % 4).otherwise(base)
    letter = lambda c: F.substring(F.lit("ACGT"), c + 1, F.lit(1))
    return spark.range(size).select(F.col("id").alias("pos"), letter(base).alias("a"), letter(other).alias("b"))


def assembled(bases: DataFrame, column: str, chunk: int = 100_000) -> DataFrame:
    """(chunk, sequence): a genome's bases joined into pieces, each with the first `chunk` bases of the next one.

    A read of at most `chunk` bases lies within one piece.
    """
    own = bases.select((F.col("pos") / chunk).cast("bigint").alias("chunk"), "pos", F.col(column).alias("c"))
    both = own.union(own.where("chunk > 0").select(F.col("chunk") - 1, "pos", "c"))
    return both.groupBy("chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("sequence"))


def uniform_reads(spark: SparkSession, pieces: DataFrame, size: int, coverage: float, length: int, error: float = 0.0, category_id: int = 0, seed: int = 1, chunk: int = 100_000) -> DataFrame:
    """Reads of one length from uniform starts and either strand, with quality 41 and substitution errors."""
    n = int(coverage * size / length)
    start = F.floor(_draw(F.col("id"), seed) * (size - length + 1))
    r = spark.range(n).select((F.col("id") + 1).alias("read_id"), start.cast("bigint").alias("start"))
    r = r.withColumn("chunk", (F.col("start") / chunk).cast("bigint")).join(pieces, "chunk")
    own = F.substring("sequence", (F.col("start") - F.col("chunk") * chunk + 1).cast("int"), F.lit(length))
    strand = _draw(F.col("read_id"), seed + 1) < 0.5
    whole = F.when(strand, own).otherwise(reverse_complement(own))
    return r.select(
        "read_id",
        F.concat(F.lit("read"), "read_id").alias("header"),
        with_errors(whole, F.col("read_id"), error, seed + 2).alias("sequence"),
        F.repeat(F.lit(chr(33 + 41)), F.lit(length)).alias("qualities"),
        F.lit(category_id).alias("category_id"),
        "start",
        (F.col("start") + length).alias("end"),
    )


def with_errors(sequence: Column, key: Column, error: float, seed: int = 1) -> Column:
    """sequence with each base changed to another one with that probability."""
    if not error:
        return sequence
    chars = F.filter(F.split(sequence, ""), lambda c: c != "")

    def changed(c: Column, i: Column) -> Column:
        shift = F.floor(_draw(key, i, seed + 1) * 3).cast("int") + 1
        to = F.substring(F.lit("ACGT"), (F.instr(F.lit("ACGT"), c) - 1 + shift) % 4 + 1, F.lit(1))
        return F.when((_draw(key, i, seed) < error) & c.isin("A", "C", "G", "T"), to).otherwise(c)

    return F.array_join(F.transform(chars, changed), "")
