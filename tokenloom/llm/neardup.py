"""Near-duplicate documents by chosen-path set similarity join.

Each distinct shingle set gets a sketch of minwise tokens.  Independent trees branch it
by tokens that the node's own hash selects, so that a set's path depends on nothing but
its sketch; sets that share a path meet in a node.  Nodes with one member are dropped,
nodes with many are branched further, and small nodes are compared exhaustively on the
full sets.  Only links within a node's components leave it, so that a group of thousands
of copies costs rows in proportion to its size, not to its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import map_texts, stored, table, trimmed
from tokenloom.llm.words import mix, split, windows
from tokenloom.operators.components import connected_components

_U = np.uint64
_rng = np.random.default_rng(0x5EED)

#: Minwise tokens in a sketch.
TOKENS = 64
_MUL = (_rng.integers(0, 2**31, TOKENS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, TOKENS, dtype=np.uint32)

#: A node branches by one token, and by a second one in this share of nodes: at a
#: similarity of 0.85 a pair then meets in 1.1 children on average.
_SECOND = 0.3

#: Share of nodes with a second token below the first levels, where only crowded nodes are
#: branched: a pair in a crowd has no other chance, so it is parted less easily there.
_SECOND_DEEP = 0.8


def shingle_sets(texts: list[bytes | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text is one shingle, one without words none."""
    b = split(texts)
    h = b.hashes()
    w = windows(h, n)
    out = []
    for a, z in zip(b.first[:-1].tolist(), b.first[1:].tolist()):
        out.append(np.unique(w[a : z - n + 1]) if z - a >= n else windows(h[a:z], z - a)[:1] if z > a else w[:0])
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minwise values for each set; sets must not be empty."""
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(x) for x in sets[:-1]], out=at[1:])
    low = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    out = np.empty((len(sets), TOKENS), np.uint32)
    for lo in range(0, len(sets), 512):  # slabs that stay in the cache
        hi = min(lo + 512, len(sets))
        part = low[at[lo] : at[hi] if hi < len(sets) else len(low)]
        own = at[lo:hi] - at[lo]
        for k in range(TOKENS):
            out[lo:hi, k] = np.minimum.reduceat(part * _MUL[k] + _ADD[k], own)
    return out


def _signature(texts: list[bytes | None], n: int) -> list:
    sets = shingle_sets(texts, n)
    size = np.array([len(x) for x in sets], np.int64)
    some = np.flatnonzero(size)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    mins: list[bytes | None] = [None] * len(sets)
    for i in some:
        one[i] = mix(sets[i]).sum()
        two[i] = np.bitwise_xor.reduce(mix(sets[i] + _U(0x1234567)))
    if len(some):
        for i, row in zip(some, sketches([sets[i] for i in some])):
            mins[i] = row.astype("<u4").tobytes()
    return [size, one.view(np.int64), two.view(np.int64), pa.array(mins, pa.binary())]


def branch(keys: np.ndarray, row: np.ndarray, mins: np.ndarray, levels: int, share: float = _SECOND) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes after some levels: keys and rows of mins that follow them."""
    for _ in range(levels):
        second = np.flatnonzero((mix(keys + _U(2)) >> _U(11)).astype(np.float64) < share * 2.0**53)
        k = np.concatenate([keys, keys[second]])
        r = np.concatenate([row, row[second]])
        salt = np.repeat(np.array([1, 3], np.uint64), [len(keys), len(second)])
        token = (mix(k + salt) % _U(TOKENS)).astype(np.int64)
        keys = mix(mix(k) + mix(mins[r, token].astype(np.uint64) + (token.astype(np.uint64) << _U(32)) + _U(1 << 40)))
        row = r
    return keys, row


def _branched(rows: DataFrame, levels: int, trees: int = 0) -> DataFrame:
    """(node, cls) after some levels; rows: (cls, mins), or (cls, mins, node) to go on from a node."""

    def run(it):
        for rb in it:
            cls = rb.column(0).to_numpy()
            for lo in range(0, len(cls), 1024):
                own = cls[lo : lo + 1024]
                mins = np.frombuffer(b"".join(rb.column(1).slice(lo, 1024).to_pylist()), "<u4").reshape(len(own), TOKENS)
                if trees:
                    keys, row = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64)), len(own)), np.tile(np.arange(len(own)), trees)
                else:
                    keys, row = rb.column(2).slice(lo, 1024).to_numpy().view(np.uint64), np.arange(len(own))
                keys, row = branch(keys, row, mins, levels, _SECOND if trees else _SECOND_DEEP)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[row])], ["node", "cls"])
        trimmed()

    return rows.mapInArrow(run, "node bigint, cls bigint")


def components_of(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the first set of its component; sets are linked if 100 * common >= percent * union.

    Searches from each set once, against the postings of its elements, until none is unreached.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), size)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    posting = owner[by]
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.bincount(inverse, minlength=len(values)), out=at[1:])
    begin = np.concatenate([[0], np.cumsum(size)])
    root = np.full(m, -1)
    left = m
    for first in range(m):
        if root[first] >= 0:
            continue
        root[first], left, queue = first, left - 1, [first]
        while queue and left:
            x = queue.pop()
            own = inverse[begin[x] : begin[x + 1]]
            n = at[own + 1] - at[own]
            common = np.bincount(posting[np.repeat(at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)
            new = np.flatnonzero((root < 0) & (100 * common >= percent * (size + size[x] - common)))
            root[new] = first
            left -= len(new)
            queue += new.tolist()
    return root.tolist()


def _compared(members: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) from (gid, cls, set) rows: each member and the first member of its component within the group."""

    def links(cls, sets):
        return [(cls[i], cls[r]) for i, r in enumerate(components_of(sets, percent)) if r != i]

    def run(it):
        gid, cls, sets = None, [], []
        for rb in it:
            out = []
            for g, c, s in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)):
                if g != gid:
                    out += links(cls, sets) if cls else []
                    gid, cls, sets = g, [], []
                cls.append(c)
                sets.append(np.frombuffer(s.as_buffer(), "<u8").copy())
            yield _pairs(out)
        yield _pairs(links(cls, sets) if cls else [])
        trimmed()

    return members.repartition("gid").sortWithinPartitions("gid", "cls").mapInArrow(run, "x bigint, y bigint")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["x", "y"])


def _with_sets(docs: DataFrame, members: DataFrame, n: int, id_col: str, text_col: str, most_ids: int) -> DataFrame:
    """(gid, cls, set) for (gid, cls): full shingle sets of the documents that stand for a class."""
    need = stored(members.select("cls").distinct(), "need")
    own = need.withColumnRenamed("cls", id_col)
    # Ids are broadcast up to a checked number; beyond it both sides are shuffled.
    few = need.count() <= most_ids
    texts = docs.select(id_col, text_col).join(F.broadcast(own) if few else own, id_col, "left_semi")

    def blobs(t):
        return [pa.array([x.astype("<u8").tobytes() for x in shingle_sets(t, n)], pa.binary())]

    sets = map_texts(texts, blobs, "set binary", id_col, text_col).withColumnRenamed(id_col, "cls").dropDuplicates(["cls"])
    return members.join(sets, "cls").select("gid", "cls", "set")


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    shingle: int = 5,
    trees: int = 10,
    depth: int = 4,
    max_depth: int = 8,
    node_limit: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_ids: int = 2_000_000,
) -> DataFrame:
    """Groups of near-duplicates: id_col, n_shingles, class_id, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set
    holds its distinct `shingle`-word shingles, or its whole sequence if it has fewer
    words.  Documents are linked if 100 * common >= percent * union, which is decided on
    the full sets.  class_id: the smallest id with the same set; component_id: the
    smallest id that links lead to; kept: whether that is the row's own.

    Null and empty texts have an empty set and are linked with nothing.  A row without
    an id can't be named by others: it is compared with nothing, has null class and
    component, and is kept.  Repeated rows with equal id and text come out once; rows
    that share an id but not a text stand for one document.  Other columns are ignored.
    Ids must be whole numbers.

    trees * depth sets the recall: at a similarity of exactly 0.85 a pair misses all ten
    trees with a probability of 0.00007 at level 4, and of 0.0002 in crowds that are
    branched down to level 8 (0.00001 at 0.9).  Nodes above node_limit after max_depth
    are cut into blocks of which every two are compared, so no pair is left out.
    """
    fields = "n_shingles bigint, s1 bigint, s2 bigint, mins binary"
    keys = stored(map_texts(docs, lambda t: _signature(t, shingle), fields, id_col, text_col), "sketch")
    some = keys.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(some.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct(F.col(id_col).cast("bigint").alias("cls"), "mins")).alias("m")).select("s1", "s2", "n_shingles", "m.cls", "m.mins"), "class")

    # A document that has several texts stands for several classes; its id is a vertex all the same.
    many = some.groupBy(id_col).agg(F.min(F.struct("s1", "s2")).alias("a"), F.max(F.struct("s1", "s2")).alias("b")).where("a <> b").select(id_col)
    rows = _branched(classes.select("cls", "mins"), depth, trees)
    groups: list[DataFrame] = []
    level = depth
    while True:
        rows = stored(rows, "path")
        sized = rows.groupBy("node").count().where("count > 1")
        met = stored(rows.join(sized, "node"), "met")
        small = met.where(F.col("count") <= node_limit)
        groups.append(small.groupBy("node").agg(F.sort_array(F.collect_set("cls")).alias("members")).where(F.size("members") > 1).select("members"))
        large = met.where(F.col("count") > node_limit)
        if level >= max_depth or large.isEmpty():
            break
        rows = _branched(large.join(classes.select("cls", "mins"), "cls").select("cls", "mins", "node"), 2)
        level += 2

    if not large.isEmpty():
        groups.append(_blocks(large, node_limit))
    # The same members often meet in several trees: they are compared once.
    each = groups[0]
    for g in groups[1:]:
        each = each.union(g)
    each = each.groupBy(F.xxhash64("members").alias("gid"), F.hash("members").alias("g2")).agg(F.first("members").alias("members")).select(F.xxhash64("gid", "g2").alias("gid"), F.explode("members").alias("cls"))
    each = stored(each, "member")
    links = stored(_compared(_with_sets(docs, each, shingle, id_col, text_col, most_ids), percent).distinct(), "link")
    same = many.join(some, id_col).join(classes.select("s1", "s2", "cls"), ["s1", "s2"]).select(F.col(id_col).cast("bigint").alias("x"), F.col("cls").alias("y"))
    found = connected_components(links.union(same), few=0).select(F.col("id").alias("cls"), "component_id")

    rows = keys.select(id_col, "n_shingles", "s1", "s2").where(F.col(id_col).isNotNull()).distinct()
    rows = rows.join(classes.select("s1", "s2", F.col("cls").alias("class_id")), ["s1", "s2"], "left")
    rows = rows.join(found.withColumnRenamed("cls", "class_id"), "class_id", "left")
    own = F.col(id_col).cast("bigint")
    out = rows.select(id_col, "n_shingles", F.coalesce("class_id", own).alias("class_id"), F.coalesce("component_id", "class_id", own).alias("component_id"))
    none = keys.where(F.col(id_col).isNull()).select(id_col, "n_shingles", F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("bigint").alias("component_id"))
    return out.union(none).withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(True)))


def _blocks(large: DataFrame, limit: int) -> DataFrame:
    """(members) of every two blocks of each large node's members, about half the limit in a block."""
    n = F.ceil(F.col("count") / (limit / 2)).cast("bigint")
    placed = large.select("node", "cls", n.alias("n"), F.pmod(F.xxhash64("cls", F.lit(7)), n).alias("b"))
    pairs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("c")
    return placed.select("node", "cls", "b", pairs).select("node", F.least("b", "c").alias("b"), F.greatest("b", "c").alias("c"), "cls").groupBy("node", "b", "c").agg(F.sort_array(F.collect_set("cls")).alias("members")).where(F.size("members") > 1).select("members")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, most_ids: int = 2_000_000) -> DataFrame:
    """Pipeline stage: one document of each group stays, that with the smallest id; the columns stay as they are.

    Null and empty texts are in no group and stay, as do rows without an id, whatever their
    text; of rows with one id one stays; an empty table stays empty; column names don't matter.
    """
    found = stored(near_duplicates(docs), "group")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(F.broadcast(gone) if gone.count() <= most_ids else gone, "doc_id", "left_anti")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    again = stored(again, "again")
    twice = left.join(again, "doc_id", "left_semi")
    return left.join(again, "doc_id", "left_anti").union(twice.dropDuplicates(["doc_id"]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i+least(5,len(w))-1], ' ')) AS s
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w)-4, 1)+1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (
  SELECT DISTINCT x AS id, x AS r FROM link
  UNION SELECT link.y AS id, reach.r FROM reach JOIN link ON link.x = reach.id),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(comp.c, w.doc_id) AS BIGINT) AS component_id,
  coalesce(comp.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.id = w.doc_id
"""
