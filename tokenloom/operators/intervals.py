"""Unions of intervals and coverage by depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.sources.shared import checkpointed


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df dealt into ranges of keys and order, with the range's number __p__: a key with many rows lies in many ranges."""
    return checkpointed(df.repartitionByRange(*keys, *order).withColumn("__p__", F.spark_partition_id()), "ranges")


def _carried(ranged: DataFrame, keys: list[str], **carry) -> DataFrame:
    """keys, __p__ and each carry (aggregate, then window function over the key's ranges): one row per key and range."""
    own = ranged.groupBy(*keys, "__p__").agg(*(agg.alias(name) for name, (agg, _) in carry.items()))
    w = W.partitionBy(*keys).orderBy("__p__")
    return own.select(*(F.col(k).alias(f"__k_{k}__") for k in keys), F.col("__p__").alias("__q__"), *(over(F.col(name), w).alias(name) for name, (_, over) in carry.items()))


def _with(ranged: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    same = F.col("__p__") == F.col("__q__")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}__"))
    return ranged.join(carried, same).drop("__q__", *(f"__k_{k}__" for k in keys))


def _sum_before(c, w):
    return F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _max_before(c, w):
    return F.max(c).over(w.rowsBetween(W.unboundedPreceding, -1))


def interval_union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end of the united intervals of each key; intervals that only touch stay apart.

    A key's intervals are dealt into ranges of their starts; what a range needs of those
    before it (the greatest end, the number of islands) is one row per range.
    """
    r = _ranged(df.select(*keys, F.col(start).alias("__s__"), F.col(end).alias("__e__")), keys, ["__s__", "__e__"])
    order = W.partitionBy(*keys, "__p__").orderBy("__s__", "__e__")
    r = _with(r, keys, _carried(r, keys, __far__=(F.max("__e__"), _max_before)))
    before = F.greatest("__far__", F.max("__e__").over(order.rowsBetween(W.unboundedPreceding, -1)))
    # A sum over the rows so far numbers the islands within a range; those before it come on top.
    opened = r.withColumn("__new__", F.when(before.isNull() | (F.col("__s__") >= before), 1).otherwise(0)).drop("__far__")
    local = opened.withColumn("__i__", F.sum("__new__").over(order.rowsBetween(W.unboundedPreceding, 0)))
    island = _with(local, keys, _carried(opened, keys, __past__=(F.sum("__new__"), _sum_before))).withColumn("__i__", F.col("__i__") + F.col("__past__"))
    return island.groupBy(*keys, "__i__").agg(F.min("__s__").alias("start"), F.max("__e__").alias("end")).drop("__i__")


def _events(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.pos", "e.d")


def depth_steps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, pos, depth after all starts and ends at pos, next (the next such place); pre-aggregated by place, dealt into ranges."""
    r = _ranged(_events(df, keys, start, end).groupBy(*keys, "pos").agg(F.sum("d").alias("d")), keys, ["pos"])
    order = W.partitionBy(*keys, "__p__").orderBy("pos")
    r = _with(r, keys, _carried(r, keys, __past__=(F.sum("d"), _sum_before), __then__=(F.min("pos"), lambda c, w: F.lead(c).over(w))))
    return r.select(*keys, "pos", (F.sum("d").over(order) + F.col("__past__")).alias("depth"), F.coalesce(F.lead("pos").over(order), F.col("__then__")).alias("next"))


def coverage_histogram(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, depth, bases: how many places lie under that many intervals, gaps within a key's range included."""
    s = depth_steps(df, keys, start, end).where("next IS NOT NULL")
    return s.groupBy(*keys, "depth").agg(F.sum(F.col("next") - F.col("pos")).alias("bases"))


def coverage_histogram_by_event(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """As a sweep gives it that changes the depth at an event before it counts the gap to the event before.

    The first gap begins at -1; ends come before starts of the same place.  Kept for
    comparison with results made that way; coverage_histogram is the right count.
    """
    r = _ranged(_events(df, keys, start, end), keys, ["pos", "d"])
    r = _with(r, keys, _carried(r, keys, __past__=(F.sum("d"), _sum_before), __last__=(F.max("pos"), lambda c, w: F.lag(c).over(w))))
    order = W.partitionBy(*keys, "__p__").orderBy("pos", "d")
    # A start is counted at once, an end after its gap.
    after = F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("__past__")
    run = r.select(*keys, "pos", "d", after.alias("after"), F.coalesce(F.lag("pos").over(order), F.col("__last__"), F.lit(-1)).alias("prev"))
    depth = F.when(F.col("d") > 0, F.col("after")).otherwise(F.col("after") + 1)
    return run.select(*keys, depth.alias("depth"), (F.col("pos") - F.col("prev")).alias("gap")).where("gap > 0").groupBy(*keys, "depth").agg(F.sum("gap").alias("bases"))


def report(membership: DataFrame, records: DataFrame) -> DataFrame:
    """(component_id, line): `#id : a/b [(s,e);(s,e) / ...]`, reads and united intervals by category."""
    own = membership.join(records.select("read_id", "category_id", "start", "end"), "read_id")
    counts = own.groupBy("component_id", "category_id").agg(F.count("*").alias("n"))
    counts = counts.groupBy("component_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category_id", "n"))), lambda x: x["n"].cast("string")), "/").alias("counts"))
    united = interval_union(own, ["component_id", "category_id"])
    text = F.concat(F.lit("("), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit(")"))
    per = united.select("component_id", "category_id", "start", text.alias("t")).groupBy("component_id", "category_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "t"))), lambda x: x["t"]), ";").alias("t"))
    whole = per.groupBy("component_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category_id", "t"))), lambda x: x["t"]), " / ").alias("spans"))
    line = F.concat(F.lit("#"), F.col("component_id").cast("string"), F.lit(" : "), F.col("counts"), F.lit(" ["), F.col("spans"), F.lit("]"))
    return counts.join(whole, "component_id").select("component_id", line.alias("line"))
