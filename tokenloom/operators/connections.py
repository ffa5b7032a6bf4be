"""The weighted graph of records that share tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.sources.shared import checkpointed

#: Token tables up to so many rows are broadcast to the scan (16 bytes each); beyond it, both sides are shuffled.
BROADCAST_TOKENS = 4_000_000


def selected_occurrences(occurrences: DataFrame, tokens: DataFrame, size: int | None = None) -> DataFrame:
    """Occurrences of the given tokens; size: their number, where it is known."""
    if size is None:
        size = tokens.count()
    return occurrences.join(F.broadcast(tokens.select("token")) if size <= BROADCAST_TOKENS else tokens.select("token"), "token", "left_semi")


def first_positions(occurrences: DataFrame, record: str = "read_id") -> DataFrame:
    """(record, token, pos): where each token is first."""
    return occurrences.groupBy(record, "token").agg(F.min("pos").alias("pos"))


def multiplicities(occurrences: DataFrame, record: str = "read_id") -> DataFrame:
    """(record, token, m)."""
    return occurrences.groupBy(record, "token").agg(F.count("*").alias("m"))


def pairs(mult: DataFrame, record: str = "read_id", min_score: int = 1) -> DataFrame:
    """(x, y, score) with x < y: over shared tokens, the sum of the products of their multiplicities.

    Tokens must come from a band, which bounds how many records hold one; a token's pairs
    are as many as that bound squared.
    """
    a = mult.select(F.col(record).alias("x"), "token", F.col("m").alias("mx"))
    b = mult.select(F.col(record).alias("y"), "token", F.col("m").alias("my"))
    both = a.join(b, "token").where("x < y")
    return both.groupBy("x", "y").agg(F.sum(F.col("mx") * F.col("my")).alias("score")).where(F.col("score") >= min_score)


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, made in one pass over the edges."""
    ends = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return edges.withColumn("__e__", F.explode(ends)).withColumns({"x": F.col("__e__.x"), "y": F.col("__e__.y")}).drop("__e__")


def connections(mult: DataFrame, record: str = "read_id", min_score: int = 1) -> DataFrame:
    """Directed edges of all records, either way."""
    return mirrored(pairs(mult, record, min_score))


def one_sided(mult: DataFrame, pivots: DataFrame, record: str = "read_id", min_score: int = 1) -> DataFrame:
    """Directed edges that start in one of the pivots (a column of record ids)."""
    a = mult.join(pivots.select(record).distinct(), record, "left_semi").select(F.col(record).alias("x"), "token", F.col("m").alias("mx"))
    b = mult.select(F.col(record).alias("y"), "token", F.col("m").alias("my"))
    return a.join(b, "token").where("x <> y").groupBy("x", "y").agg(F.sum(F.col("mx") * F.col("my")).alias("score")).where(F.col("score") >= min_score)


def above(edges: DataFrame, score: int) -> DataFrame:
    return edges.where(F.col("score") > score)


def top_fraction(edges: DataFrame, fraction: float = 0.15) -> DataFrame:
    """The first floor(fraction * n) of the n directed edges by score (highest first), least id, greatest id, direction.

    Only the cut score's edges are ranked: how many edges each score has tells which scores
    are wholly in or out, so no edge list is sorted as a whole.
    """
    by_score = edges.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()  # one row per score
    limit = int(sum(r["n"] for r in by_score) * fraction + 1e-9)
    taken, cut = 0, None
    for r in by_score:
        if taken + r["n"] > limit:
            cut = r["score"]
            break
        taken += r["n"]
    if cut is None:
        return edges
    whole = edges.where(F.col("score") > cut)
    part = edges.where(F.col("score") == cut).withColumns({"__a__": F.least("x", "y"), "__b__": F.greatest("x", "y")})
    return whole.unionByName(_first(part, ["__a__", "__b__", "x"], limit - taken).drop("__a__", "__b__"))


def _first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of an order, without a task that sees n of them.

    Rows are dealt into ranges of the order; the ranges' sizes, one row each, say how many of
    each range's rows are in, and each range is cut by itself.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p__", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__p__").agg(F.count("*").alias("k"))
    before = W.orderBy("__p__").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    room = sizes.select("__p__", (F.lit(n) - F.coalesce(F.sum("k").over(before), F.lit(0))).alias("__room__"))
    ranked = dealt.join(F.broadcast(room.where("__room__ > 0")), "__p__").withColumn("__k__", F.row_number().over(W.partitionBy("__p__").orderBy(*order)))
    return ranked.where(F.col("__k__") <= F.col("__room__")).drop("__p__", "__room__", "__k__")


def with_quality(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """Edges with is_good: whether both ends are of one category; categories: (read_id, category_id)."""
    c = categories.select("read_id", "category_id")
    return edges.join(c.withColumnsRenamed({"read_id": "x", "category_id": "__cx__"}), "x").join(c.withColumnsRenamed({"read_id": "y", "category_id": "__cy__"}), "y").withColumn("is_good", F.col("__cx__") == F.col("__cy__")).drop("__cx__", "__cy__")


def quality_histogram(edges: DataFrame) -> DataFrame:
    """(score, good, bad, ratio) of the edges."""
    good = F.sum(F.when(F.col("is_good"), 1).otherwise(0))
    return edges.groupBy("score").agg(good.alias("good"), (F.count("*") - good).alias("bad"), (good / F.count("*")).alias("ratio"))


def best_per_vertex(edges: DataFrame) -> DataFrame:
    """(y, x, score): the edge of the highest score that ends in y; the lowest x among equals."""
    top = F.max(F.struct("score", (-F.col("x")).alias("nx"))).alias("t")
    return edges.groupBy("y").agg(top).select("y", (-F.col("t.nx")).alias("x"), F.col("t.score").alias("score"))


def best_histogram(edges: DataFrame) -> DataFrame:
    """(score, vertices): how many vertices have this highest score."""
    return edges.groupBy("y").agg(F.max("score").alias("score")).groupBy("score").agg(F.count("*").alias("vertices"))


def overlap_by_score(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """(score, overlap, edges): true overlaps of 1 or more of the connected records; spans: (read_id, start, end)."""
    s = spans.select("read_id", "start", "end")
    ends = lambda v: s.select(F.col("read_id").alias(v), F.col("start").alias(f"s{v}"), F.col("end").alias(f"e{v}"))
    both = edges.join(ends("x"), "x").join(ends("y"), "y")
    overlap = F.greatest(F.least("ex", "ey") - F.greatest("sx", "sy"), F.lit(0))
    return both.withColumn("overlap", overlap).where("overlap >= 1").groupBy("score", "overlap").agg(F.count("*").alias("edges"))


def overlap_estimates(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(x, y, score, overlap): the larger of the ranges that shared tokens' first positions span in either record."""
    p = lambda v: positions.select(F.col("read_id").alias(v), "token", F.col("pos").alias(f"p{v}"))
    shared = edges.join(p("x"), "x").join(p("y"), ["y", "token"])
    reach = lambda v: F.max(f"p{v}") - F.min(f"p{v}")
    return shared.groupBy("x", "y", "score").agg(F.greatest(reach("x"), reach("y")).alias("overlap"))


def multiset_intersection(mult: DataFrame, x: Column, y: Column, record: str = "read_id") -> DataFrame:
    """(shared): sum over tokens of the lesser multiplicity in the records x and y."""
    own = mult.where(F.col(record).isin(x, y)).groupBy("token").agg(F.count("*").alias("n"), F.min("m").alias("m")).where("n = 2")
    return own.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("shared"))

