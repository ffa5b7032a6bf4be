"""Connected components and what follows from them, as DataFrame loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.sources.shared import checkpointed


#: Edges up to which components are found in one task (24 bytes each); more of them take rounds.
FEW_EDGES = 1_000_000


def _in_one_task(e: DataFrame) -> DataFrame:
    """(id, component_id) of few distinct edges (u, v): least labels hooked and halved over arrays."""

    def run(it):
        rows = [(rb.column(0).to_numpy(), rb.column(1).to_numpy()) for rb in it]
        u, v = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component_id"])

    return e.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInArrow(run, "id bigint, component_id bigint")


def connected_components(edges: DataFrame, x: str = "x", y: str = "y", max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(id, component_id) for every id on an edge; component_id is the smallest id of the component.

    Alternates large-star and small-star steps, which end in one star per component
    after a number of rounds logarithmic in the component's size.  Minima are
    pre-aggregated before each shuffle; rows per round never exceed the edges plus ids.
    Up to `few` distinct edges (counted) are done in one task instead, with the same result.
    Self loops and repeated edges are harmless; edges with a null end are ignored.
    """
    e = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = checkpointed(e.distinct())
    if dict(e.dtypes)["u"] in ("bigint", "int") and e.count() <= few:
        return checkpointed(_in_one_task(e))
    ids = checkpointed(e.select(F.col("u").alias("id")).union(e.select("v")).distinct())
    e = e.where("u <> v")
    state = None
    for _ in range(max_rounds):
        # Large star: each neighbour above u joins the least of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below it join the least of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(low, "u")
        e = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(e)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == state:
            break
        state = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("r"))
    return ids.join(root, ids["id"] == root["u"], "left").select("id", F.coalesce("r", "id").alias("component_id"))


def components_of(edges: DataFrame, members: DataFrame | None = None, min_size: int = 1) -> DataFrame:
    """(component_id, read_id) of components of min_size members or more; members adds records without an edge."""
    found = connected_components(edges).select("component_id", F.col("id").alias("read_id"))
    if members is not None:
        alone = members.select("read_id").distinct().join(found, "read_id", "left_anti").select(F.col("read_id").alias("component_id"), "read_id")
        found = found.unionByName(alone)
    return at_least(found, min_size)


def sizes(membership: DataFrame) -> DataFrame:
    """(component_id, size)."""
    return membership.groupBy("component_id").agg(F.count("*").alias("size"))


def at_least(membership: DataFrame, min_size: int) -> DataFrame:
    """Members of components that have min_size members; smaller ones, emptied ones too, are gone."""
    if min_size <= 1:
        return membership
    keep = sizes(membership).where(F.col("size") >= min_size).select("component_id")
    return membership.join(keep, "component_id", "left_semi")


def bounded_components(edges: DataFrame, max_size: int, max_edges: int = 2_000_000) -> DataFrame:
    """(component_id, read_id, x, y): components by merging along edges of falling score, never beyond max_size.

    The result depends on the order of merges, so each connected component's edges are
    gone through one by one, in one task; components are independent of each other.
    Ties go by least, then greatest id.  x, y: the edge that brought the member in, null
    for a component's first.  Components above max_edges edges are refused.
    """
    import pandas as pd

    label = connected_components(edges).select(F.col("id").alias("x"), F.col("component_id").alias("__c__"))
    e = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "score").groupBy("x", "y").agg(F.max("score").alias("score")).join(label, "x")
    most = e.groupBy("__c__").count().agg(F.max("count")).first()[0] or 0
    if most > max_edges:
        raise ValueError(f"a component has {most} edges; bounded merging takes {max_edges} at most")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "x", "y"], ascending=[False, True, True])
        root: dict[int, int] = {}
        size: dict[int, int] = {}
        kept = []

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for x, y in zip(rows["x"], rows["y"]):
            a, b = find(x), find(y)
            if a != b and size.get(a, 1) + size.get(b, 1) <= max_size:
                a, b = min(a, b), max(a, b)
                root[b], size[a] = a, size.get(a, 1) + size.get(b, 1)
                kept.append((x, y))
        out = [(find(v), v) for v in sorted(root)]
        tree = dict.fromkeys((v for _, v in out))
        for x, y in kept:
            tree[y if tree[y] is None and find(y) != y else x] = (x, y)
        return pd.DataFrame([(c, v, *(tree[v] or (None, None))) for c, v in out], columns=["component_id", "read_id", "x", "y"]).astype({"x": "Int64", "y": "Int64"})

    return e.groupBy("__c__").applyInPandas(merge, "component_id bigint, read_id bigint, x bigint, y bigint")


def assigned(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """(component_id, read_id): cores' members, and every other record with its best core.

    edges: directed, from core to record, (x, y, score) where x is a core's id; cores:
    (component_id, read_id).  A record goes to the core of the highest score, the lowest id
    among equals; cores never join; records without an edge stay out.
    """
    free = edges.join(cores.select(F.col("read_id").alias("y")), "y", "left_anti")
    best = free.groupBy("y").agg(F.max(F.struct("score", (-F.col("x")).alias("nx"))).alias("t"))
    return cores.select("component_id", "read_id").union(best.select((-F.col("t.nx")).alias("component_id"), F.col("y").alias("read_id")))


def core_scores(mult: DataFrame, cores: DataFrame, min_score: int = 20) -> DataFrame:
    """(x, y, score): shared tokens of each core's distinct token set with records outside of cores."""
    own = tokens_of(cores, mult).select(F.col("component_id").alias("x"), "token")
    rest = mult.join(cores.select("read_id"), "read_id", "left_anti").select(F.col("read_id").alias("y"), "token", "m")
    return own.join(rest, "token").groupBy("x", "y").agg(F.sum("m").alias("score")).where(F.col("score") >= min_score)


def merged(membership: DataFrame, into: DataFrame) -> DataFrame:
    """Membership after components are merged; into: (component_id, target).  The least id of a target's components survives."""
    groups = into.groupBy("target").agg(F.min("component_id").alias("survivor"))
    to = into.join(groups, "target").select("component_id", "survivor")
    return membership.join(to, "component_id", "left").select(F.coalesce("survivor", "component_id").alias("component_id"), "read_id")


def tokens_of(membership: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(component_id, token): union of the members' tokens, each once."""
    return membership.join(occurrences.select("read_id", "token"), "read_id").select("component_id", "token").distinct()


def without_postings(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings (token, component_id) of components that are still there."""
    return postings.join(gone.select("component_id"), "component_id", "left_anti")


def truncated_postings(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """As an older index maintenance left them: of a token that loses any, only postings below the greatest lost id."""
    lost = postings.join(gone.select("component_id"), "component_id", "left_semi").groupBy("token").agg(F.max("component_id").alias("__top__"))
    kept = without_postings(postings, gone).join(lost, "token", "left")
    return kept.where(F.col("__top__").isNull() | (F.col("component_id") < F.col("__top__"))).drop("__top__")
