"""Counting tokens: per category, occurrence histograms, specificity, token length, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.tokens import hash_share, specificity, tokenise, unpacked, upper_bound
from tokenloom.operators import shards

EXACT_THRESHOLDS = (70.0, 85.0, 90.0, 95.0, 99.0, 100.0, 100.01)
SKETCH_THRESHOLDS = (70.0, 85.0, 90.0, 95.0, 99.0, 101.0)


def counts_by_category(records: DataFrame, k: int) -> DataFrame:
    """(token, category_id, cnt)."""
    return tokenise(records, k, ("category_id",), positions=False).groupBy("token", "category_id").agg(F.count("*").alias("cnt"))


def token_totals(records: DataFrame, k: int) -> DataFrame:
    """(token, total), counted without regard to categories."""
    return tokenise(records, k, (), positions=False).groupBy("token").agg(F.count("*").alias("total"))


def non_singletons(counts: DataFrame, scope: str = "pooled") -> DataFrame:
    """Counts without tokens that occur once: in all categories together (pooled), in one (per_category), or none left out."""
    if scope == "none":
        return counts
    if scope == "per_category":
        return counts.where("cnt > 1")
    more = counts.groupBy("token").agg(F.sum("cnt").alias("__n__")).where("__n__ > 1").select("token")
    return counts.join(more, "token")


def count_vectors(counts: DataFrame, categories: list[int]) -> DataFrame:
    """(token, c0, c1, ... , total, categories, most): one column of counts per category.

    An aggregation does what a merge join of sorted count files would: one shuffle for any number of categories.
    """
    own = [F.coalesce(F.sum(F.when(F.col("category_id") == c, F.col("cnt"))), F.lit(0)).alias(f"c{c}") for c in categories]
    return counts.groupBy("token").agg(*own, F.sum("cnt").alias("total"), F.count("*").alias("categories"), F.max("cnt").alias("most"))


def summed(counts: DataFrame) -> DataFrame:
    """(token, total, categories, most)."""
    return counts.groupBy("token").agg(F.sum("cnt").alias("total"), F.count("*").alias("categories"), F.max("cnt").alias("most"))


def histogram(totals: DataFrame, min_bin: int = 100) -> DataFrame:
    """(occurrence, unique_kmers): how many tokens occur so often; bins of min_bin tokens or fewer are dropped."""
    return totals.where("total > 0").groupBy(F.col("total").alias("occurrence")).agg(F.count("*").alias("unique_kmers")).where(F.col("unique_kmers") > min_bin)


def specificity_cube(counts: DataFrame, thresholds: tuple[float, ...] = EXACT_THRESHOLDS) -> DataFrame:
    """(upper_bound, occurrences, unique_kmers): tokens by the least threshold above their specificity, and total."""
    t = summed(counts).where("total > 0")
    bound = upper_bound(specificity(F.col("most"), F.col("total")), list(thresholds))
    return t.groupBy(bound.alias("upper_bound"), F.col("total").alias("occurrences")).agg(F.count("*").alias("unique_kmers"))


def distinct_by_k(records: DataFrame, ks: list[int], exact: bool = True, rsd: float = 0.0325, **source) -> DataFrame:
    """(k, distinct_kmers) for each k, exactly or by sketch, in one job.

    Exactly: short tokens are marked in maps of bits, longer ones of one parity dealt once for all
    their lengths; source: sequence and prepare of shards.dealt.
    """
    if exact:
        long = [[k for k in ks if k >= shards.LEAST_K and k % 2 == odd] for odd in (0, 1)]
        parts = [*(shards.distinct_short(records, k, **source) for k in ks if k < shards.LEAST_K), *(shards.distinct(records, own, **source) for own in long if own)]
    else:
        parts = [tokenise(records, k, (), positions=False).agg(F.approx_count_distinct("token", rsd).alias("distinct_kmers")).select(F.lit(k).alias("k"), "distinct_kmers") for k in ks]
    return reduce(DataFrame.union, parts)


def choose_k(by_k: DataFrame, change: float = 0.1) -> DataFrame:
    """(k, distinct_kmers, step) of the first k from which the next changes the count by less than `change` of their mean."""
    from pyspark.sql import Window as W

    nxt = F.lead("distinct_kmers").over(W.orderBy("k"))  # one row per k tried
    step = F.abs(nxt - F.col("distinct_kmers")) / ((nxt + F.col("distinct_kmers")) / 2)
    return by_k.withColumn("step", step).where(F.col("step") < change).orderBy("k").limit(1)


def unique_k(records: DataFrame, first: int = 11, last: int = 31, change: float = 0.1, exact: bool = False) -> int:
    """Token length by the rule of choose_k, trying k one after the other; `last` if none settles."""
    seen = distinct_by_k(records, [first], exact).first()["distinct_kmers"]
    for k in range(first, last - 1, 2):
        after = distinct_by_k(records, [k + 2], exact).first()["distinct_kmers"]
        if abs(after - seen) / max((after + seen) / 2, 1) < change:
            return k
        seen = after
    return last


def band(totals: DataFrame, lower: int, upper: int) -> DataFrame:
    """Tokens whose total is within lower..upper."""
    return totals.where(F.col("total").between(lower, upper))


def sampled(tokens: DataFrame, share: float, seed: int = 1, column: str = "token") -> DataFrame:
    """Share of the tokens, chosen by hash: the same tokens wherever and however often it runs."""
    if share >= 1:
        return tokens
    return tokens.where(hash_share(F.col(column), seed) < share)


def is_discriminative(categories: Column) -> Column:
    return categories == 1


def with_string(df: DataFrame, k: int, name: str = "kmer") -> DataFrame:
    """The token column as a string of bases."""
    return df.withColumn(name, unpacked(F.col("token"), k)).drop("token")


def purity(occurrences: DataFrame) -> DataFrame:
    """(tokens, pure): tokens that occur at all, and those in one category only."""
    per = occurrences.select("token", "category_id").distinct().groupBy("token").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("tokens"), F.coalesce(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)), F.lit(0)).alias("pure"))
