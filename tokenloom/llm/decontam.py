"""Benchmark decontamination by suffix arrays over the training texts.

Training texts are cut into shards of some million bytes.  Each shard gets a word
suffix array, built by prefix doubling; the test suffixes are searched in it by binary
search, which gives the places of their windows (each distinct window once, however
many items share it) and, in `longest_matches`, every item's longest verbatim match.
How far a match goes on in a text is looked up in the items' own suffix array.  A shard
is made, searched and dropped within one task, so nothing is shuffled, and a passage
that a third of all documents share costs each task only its own share.

The test set is broadcast in blocks of at most `block_bytes`; a larger set takes
several passes, each of which extends what the passes before it found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import EMPTY_SHA256, slices, stored, table, trimmed
from tokenloom.llm.words import ALNUM, Batch, batches, mix, split, windows

_U = np.uint64
_STATE = "n_words bigint, longest bigint, longest_at bigint, longest_item string, spans array<struct<start:bigint,end:bigint>>, items array<string>"


class TestSet:
    """Words of the test items, laid end to end, and their distinct windows.

    Windows that many items share are searched once; which items have a window is known by
    classes of windows with the same items, so a template that all items begin with is one
    class, however many items there are.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        b = split([(t or "").encode() for _, t in items], inside=ALNUM)
        n = b.counts
        own = [None if i is None else str(i) for i, _ in items]
        #: Names of the items in order, null last; items are known by their places here.
        self.names = sorted(set(own), key=lambda x: (x is None, x or ""))
        rank = {x: k for k, x in enumerate(self.names)}
        of_item = np.array([rank[x] for x in own], np.int64)
        self.hash = b.hashes()
        self.ids = np.concatenate([self.hash >> _U(43), np.zeros(3, np.uint64)])
        self.item = of_item[b.doc]
        self.left = np.repeat(b.first[1:], n) - np.arange(len(self.hash))
        self.at = np.arange(len(self.hash)) - np.repeat(b.first[:-1], n)
        self.depth = int(n.max(initial=0))
        need = np.minimum(window, np.repeat(n, n))
        #: Suffixes that begin a window; shorter tails of an item can't.
        starts = np.flatnonzero(self.left >= need)
        content = np.zeros(len(starts), np.uint64)
        for k in np.unique(need[starts]).tolist():
            some = need[starts] == k
            content[some] = mix(windows(self.hash, k)[starts[some]] + _U(k))
        _, first, win = np.unique(content, return_index=True, return_inverse=True)
        #: One suffix for each distinct window, and its length.
        self.rep = starts[first]
        self.need = need[self.rep]
        self.widest = int(self.need.max(initial=0))
        pair = np.unique(win.astype(np.int64) * max(len(self.names), 1) + self.item[starts])
        win, item = pair // max(len(self.names), 1), pair % max(len(self.names), 1)
        at = np.searchsorted(win, np.arange(len(self.rep) + 1))
        same = np.add.reduceat(mix(item.astype(np.uint64) + _U(1)), at[:-1]) if len(self.rep) else np.zeros(0, np.uint64)
        _, one, self.cls = np.unique(mix(same + np.diff(at).astype(np.uint64)), return_index=True, return_inverse=True)
        self.class_items = [item[at[w] : at[w + 1]] for w in one.tolist()]
        #: First three words of each window that has as many, in order, for a look whether a shard has them.
        wide = np.flatnonzero(self.need >= 3)
        first3 = _triple(self.ids, self.rep[wide])
        by = np.argsort(first3, kind="stable")
        self.wide, self.first3 = wide[by], first3[by]
        self.narrow = np.flatnonzero(self.need < 3)
        # The items' own suffix array, in which places of a text are looked up.
        stream = np.insert(self.hash, b.first[1:], mix(np.arange(b.n_docs, dtype=np.uint64) + _U(0xB0BDE2A5C3D41977)))
        self.stream = stream
        self.stream_item = np.insert(self.item, b.first[1:], -1) if len(stream) else np.zeros(0, np.int64)
        self.order, self.triple = suffix_array(stream >> _U(43), self.depth) if len(stream) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def present(self, ordered: np.ndarray) -> np.ndarray:
        """Windows whose first three words are among a shard's ordered triples; the shorter list is looked up in the longer one."""
        if len(self.first3) <= len(ordered):
            at = np.minimum(np.searchsorted(ordered, self.first3), len(ordered) - 1)
            found = self.wide[ordered[at] == self.first3]
        else:
            once = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
            lo, hi = np.searchsorted(self.first3, once, "left"), np.searchsorted(self.first3, once, "right")
            n = (hi - lo)[hi > lo]
            found = self.wide[np.repeat(lo[hi > lo] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.concatenate([self.narrow, found])


def _triple(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Three 21-bit word ids from each place, as one number."""
    return (ids[at] << _U(42)) | (ids[at + 1] << _U(21)) | ids[at + 2]


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ids by their first `depth` words at least, and each place's triple.

    ids: 21-bit word ids, as uint64.  Prefix doubling: only suffixes that are still
    equal to another are sorted again.
    """
    n = len(ids)
    padded = np.concatenate([ids, np.zeros(3, np.uint64)])
    triple = (padded[:-3] << _U(42)) | (padded[1:-2] << _U(21)) | padded[2:-1]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = group
    known = 3
    while known < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        places = order[slots]
        key = (group[slots].astype(np.uint64) << _U(32)) | (rank[np.minimum(places + known, n)] + 1).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[slots], key = places[by], key[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order[slots]] = group[slots]
        known *= 2
    return order, triple


def _bound(order, triple, at, lo, hi, want, after: bool):
    """Binary search of each want[i] within slots lo[i]..hi[i], whose triples `at` words on ascend."""
    lo, hi, n = lo.copy(), hi.copy(), len(triple)
    active = np.flatnonzero(lo < hi)
    while len(active):
        mid = (lo[active] + hi[active]) >> 1
        place = order[mid] + at
        seen = np.where(place < n, triple[np.minimum(place, n - 1)], _U(0))
        right = seen <= want[active] if after else seen < want[active]
        lo[active[right]] = mid[right] + 1
        hi[active[~right]] = mid[~right]
        active = active[lo[active] < hi[active]]
    return lo


def match(order: np.ndarray, triple: np.ndarray, ids: np.ndarray, q: np.ndarray, left: np.ndarray):
    """Longest match, of left[i] words at most, of each suffix q[i] of ids in a suffix array: words, and its slots lo..hi."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    best, best_lo, best_hi = (np.zeros(len(q), np.int64) for _ in range(3))
    active, at = np.arange(len(q)), 0
    while len(active):
        room = left[active] - at
        whole = _triple(ids, q[active] + at)
        reach = np.zeros(len(active), np.int64)
        a3, b3 = lo[active], hi[active]
        for words in (1, 2, 3):
            ok = np.flatnonzero((room >= words) & (reach == words - 1))
            if not len(ok):
                continue
            mask = _U((1 << (21 * (3 - words))) - 1)
            want = whole[ok]
            a = _bound(order, triple, at, a3[ok], b3[ok], want & ~mask, False)
            b = _bound(order, triple, at, a, b3[ok], want | mask, True)
            found = b > a
            reach[ok[found]] = words
            a3[ok[found]], b3[ok[found]] = a[found], b[found]
        best[active] = at + reach
        some = active[reach > 0]
        best_lo[some], best_hi[some] = a3[reach > 0], b3[reach > 0]
        lo[active], hi[active] = a3, b3
        active, at = active[(reach == 3) & (room > 3)], at + 3
    return best, best_lo, best_hi


def _shards(b: Batch, most: int, overlap: int):
    """Word streams of about `most` words: hash, document, word number (-1 between documents).

    A very long document spans several shards, which overlap by the longest item.
    """
    if not b.n_docs:
        return
    h, n = b.hashes(), b.counts
    stream = np.insert(h, b.first[1:], mix(np.arange(b.n_docs, dtype=np.uint64) + _U(0xD0C5E9A2A7012345)))
    doc = np.repeat(np.arange(b.n_docs), n + 1)
    word = np.arange(len(stream)) - np.repeat(b.first[:-1] + np.arange(b.n_docs), n + 1)
    for lo in range(0, len(stream), most):
        yield stream[lo : lo + most + overlap], doc[lo : lo + most + overlap], word[lo : lo + most + overlap], min(most, len(stream) - lo)


def _equal(stream: np.ndarray, place: np.ndarray, other: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words, of length[i] at most, are equal from place and from start; word ids have 21 bits, and the hashes decide."""
    n, ok = np.zeros(len(place), np.int64), np.arange(len(place))
    k = 0
    while len(ok := ok[length[ok] > k]):
        ok = ok[stream[place[ok] + k] == other[start[ok] + k]]
        n[ok] += 1
        k += 1
    return n


def _hits(b: Batch, test: TestSet, shard_words: int):
    """For each shard that has windows of the test set: its stream, the windows' places in it, and their text, word and window."""
    for stream, doc, word, own in _shards(b, shard_words, test.depth):
        order, triple = suffix_array(stream >> _U(43), test.widest)
        q = test.present(triple[order])
        best, lo, hi = match(order, triple, test.ids, test.rep[q], test.need[q])
        found = np.flatnonzero(best == test.need[q])
        n = (hi - lo)[found]
        win = np.repeat(q[found], n)
        place = order[np.repeat(lo[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ok = (place < own) & (place + test.need[win] <= len(stream))
        win, place = win[ok], place[ok]
        ok = _equal(stream, place, test.hash, test.rep[win], test.need[win]) == test.need[win]
        if ok.any():
            yield stream, place[ok], doc[place[ok]], word[place[ok]], win[ok]


def _longest(stream: np.ndarray, place: np.ndarray, last: np.ndarray, test: TestSet):
    """Words of the longest match with an item from each place, no further than last, and its slots in the items' suffix array."""
    ids = np.concatenate([stream >> _U(43), np.zeros(3, np.uint64)])
    best, lo, hi = match(test.order, test.triple, ids, place, np.minimum(last - place, test.depth))
    return _equal(stream, place, test.stream, test.order[np.minimum(lo, len(test.order) - 1)], best), lo, hi


def find(b: Batch, test: TestSet, shard_words: int = 1_000_000) -> list[tuple]:
    """For each text with a window of the test set: number, spans, items, longest match, its place and item."""
    spans, classes, tops = [], [], {}
    for stream, place, doc, word, win in _hits(b, test, shard_words):
        spans.append(np.stack([doc, word, word + test.need[win]]))
        classes.append(np.unique(np.stack([doc, test.cls[win]], axis=1), axis=0))
        place, at = np.unique(place, return_index=True)
        doc, word, need = doc[at], word[at], test.need[win[at]]
        last = np.minimum(place + b.counts[doc] - word, len(stream))
        length, lo, hi = _longest(stream, place, last, test)
        by = np.lexsort((word, -length, doc))
        for k in by[np.flatnonzero(np.diff(doc[by], prepend=-1))].tolist():
            same = test.stream_item[test.order[lo[k] : hi[k]]]
            if length[k] >= need[k]:
                top = (-int(length[k]), int(word[k]), int(same.min()))
            else:  # two words of one 21-bit id parted the search; the window itself is a match
                top = (-int(need[k]), int(word[k]), int(test.class_items[test.cls[win[at[k]]]].min()))
            tops[int(doc[k])] = min(tops.get(int(doc[k]), top), top)
    if not spans:
        return []
    doc, start, end = np.concatenate(spans, axis=1)
    # Each text's words in a range of their own; a span goes on as long as the next begins by its end.
    wide = int(end.max()) + 2
    by = np.lexsort((start, doc))
    s, e = (doc * wide + start)[by], np.maximum.accumulate((doc * wide + end)[by])
    head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    of, s, e = s[head] // wide, s[head] % wide, e[np.append(head[1:], len(e)) - 1] % wide
    pairs = np.unique(np.concatenate(classes), axis=0)
    out = []
    for i, (n, at, item) in sorted(tops.items()):
        own = np.flatnonzero(of == i) if len(tops) < 8 else slice(*np.searchsorted(of, [i, i + 1]))
        has = pairs[slice(*np.searchsorted(pairs[:, 0], [i, i + 1])), 1]
        items = np.unique(np.concatenate([test.class_items[c] for c in has.tolist()]))
        out.append((i, np.stack([s[own], e[own]], axis=1).tolist(), [test.names[k] for k in items.tolist()], -n, at, test.names[item]))
    return out


def touched(b: Batch, test: TestSet, shard_words: int = 1_000_000) -> np.ndarray:
    """Numbers of the texts with a window of the test set."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(doc for _, _, doc, _, _ in _hits(b, test, shard_words))]))


def _order(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def _merged(a: list[dict], b: list[list[int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted([*((x["start"], x["end"]) for x in a), *map(tuple, b)]):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def _pass(df: DataFrame, keep: list[str], items: list[tuple[object, str | None]], window: int, shard_words: int) -> DataFrame:
    """df: the columns of keep, __text__ and the state of the passes before; updates the state."""
    spark = df.sparkSession
    test = spark.sparkContext.broadcast(TestSet(items, window))
    schema, n = df.schema, len(keep)
    names = schema.fieldNames()

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        for rb in it:
            for lo, hi, texts in slices(rb, n, 4_000_000):
                part = rb.slice(lo, hi - lo)
                b = split(texts, inside=ALNUM)
                state = {k: part.column(n + 1 + j).to_pylist() for j, k in enumerate(names[n + 1 :])}
                state["n_words"] = b.counts.tolist()
                for i, spans, items_, length, at, item in find(b, test.value, shard_words):
                    state["spans"][i] = _merged(state["spans"][i], spans)
                    state["items"][i] = sorted({*state["items"][i], *items_}, key=_order)
                    if (-length, at, _order(item)) < (-state["longest"][i], state["longest_at"][i] or 0, _order(state["longest_item"][i])):
                        state["longest"][i], state["longest_at"][i], state["longest_item"][i] = length, at, item
                own = [pa.array(v, type=fields.field(k).type) for k, v in state.items()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n + 1)), *own], names)
        trimmed()

    return df.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16_000_000, shard_words: int = 1_000_000) -> DataFrame:
    """Each row's verbatim overlap with the test items.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is
    `window` consecutive words of an item, or a whole item with fewer words.

    Returns one row per row of docs: id_col, n_words, longest (words of the longest
    verbatim match with any item that begins where a window does, 0: none), longest_at
    (its first word), longest_item, spans (merged word ranges inside windows), items (ids as text, sorted).
    Ties for the longest match go to the earlier place, then the lower item id.

    Null and empty texts have no words and no match; items without words have no
    window; repeated rows each get their own result; an item id that occurs twice
    counts once; items without an id are together one item, null in items and last in
    its order; null document ids stay null.  An empty test set leaves every row clean.
    Other columns of either table are ignored.
    """
    zero = {"n_words": F.lit(0).cast("bigint"), "longest": F.lit(0).cast("bigint"), "longest_at": F.lit(None).cast("bigint"), "longest_item": F.lit(None).cast("string"), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "items": F.array().cast("array<string>")}
    df = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text__"), *(c.alias(k) for k, c in zero.items()))
    for k, items in enumerate(_test_blocks(benchmark, item_col, item_text_col, block_bytes)):
        df = _pass(stored(df, "decontam") if k else df, [id_col], items, window, shard_words)
    return df.drop("__text__")


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def touches(df: DataFrame, items: list[tuple[object, str | None]], window: int, text_col: str = "text"):
    """Column: whether a text holds any window of the items (at most a block of them)."""
    test = df.sparkSession.sparkContext.broadcast(TestSet(items, window))

    @F.arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        out = np.zeros(len(texts), bool)
        for lo, hi in batches(texts, 4_000_000):
            out[lo + touched(split(texts[lo:hi], inside=ALNUM), test.value)] = True
        return pa.array(out)

    return hit(F.col(text_col).cast("binary"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16_000_000, shard_words: int = 1_000_000) -> DataFrame:
    """Longest verbatim match of each test item over all texts, however short: item_id, longest, item_at, id, at.

    Every suffix of every item is searched in each shard's suffix array.  item_at and at are
    the first word in the item and in the text; ties go to the lowest document id, then place
    in the text, then in the item.  Items of which no word occurs are left out; rows without a
    document id are searched, and lose ties.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary"))
    schema = spark.createDataFrame([], f"item int, longest bigint, item_at bigint, id {source.schema[0].dataType.simpleString()}, at bigint").schema
    out = None
    for items in _test_blocks(benchmark, item_col, item_text_col, block_bytes):
        test = spark.sparkContext.broadcast(TestSet(items, 1))

        def run(it, test=test):
            t = test.value
            q = np.arange(len(t.hash))
            for rb in it:
                for lo, _, texts in slices(rb, 1, 4_000_000):
                    b = split(texts, inside=ALNUM)
                    for stream, doc, word, own in _shards(b, shard_words, t.depth):
                        order, triple = suffix_array(stream >> _U(43), t.depth)
                        # Only words that the shard has can begin a match.
                        some = q[np.isin(t.ids[: len(q)], triple >> _U(42))]
                        best, a, z = match(order, triple, t.ids, some, t.left[some])
                        best = _equal(t.hash, some, stream, order[np.minimum(a, len(order) - 1)], best)
                        by = np.lexsort((some, -best, t.item[some]))
                        for k in by[np.flatnonzero(np.diff(t.item[some][by], prepend=-1))].tolist():
                            places = order[a[k] : z[k]]
                            places = places[_equal(stream, places, t.hash, np.full(len(places), some[k]), np.full(len(places), best[k])) == best[k]]
                            if best[k] and len(places):
                                p = int(places.min())
                                yield pa.RecordBatch.from_arrays([pa.array([t.item[some[k]]], pa.int32()), pa.array([best[k]]), pa.array([t.at[some[k]]]), rb.column(0).slice(lo + int(doc[p]), 1), pa.array([word[p]])], schema.fieldNames())
            trimmed()

        names = F.array(*(F.lit(x) for x in test.value.names)) if test.value.names else F.array(F.lit(None).cast("string"))
        found = source.mapInArrow(run, schema).groupBy("item").agg(F.min(F.struct((-F.col("longest")).alias("n"), F.col("id").isNull().alias("none"), "id", "at", "item_at")).alias("m"))
        one = found.select(F.element_at(names, F.col("item") + 1).alias(item_col), (-F.col("m.n")).alias("longest"), "m.item_at", "m.id", "m.at")
        out = one if out is None else out.unionByName(one)
    return out


def _test_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int):
    """The test items in blocks of about block_bytes, as (id as text, text) lists."""
    test = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    size = test.agg(F.sum(F.octet_length("t") + 64).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = test if blocks == 1 else test.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]  # at most a block


def without(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs whose text holds no window of the test set, all columns unchanged; nothing is shuffled.

    Null and empty texts have no window and stay, as do all rows beside an empty test set;
    repeated rows go or stay together; ids, null or not, and other columns are not looked at.
    """
    for k, items in enumerate(_test_blocks(benchmark, item_col, item_text_col, block_bytes)):
        docs = stored(docs, "decontam") if k else docs
        docs = docs.where(~touches(docs, items, window, text_col))
    return docs


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with any window of the test set go; see `without` for odd rows."""
    return without(docs, table(spark, sf_dir, "benchmark"))


# Brute force in SQL: every window against every run of words.
ORACLE = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i+least(10,len(w))-1], ' ') AS t
  FROM bw, LATERAL (SELECT unnest(range(1, len(w)-least(10,len(w))+2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS t
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w)-n+2)) AS i) WHERE len(w) >= n),
hits AS (SELECT r.doc_id, r.i, r.n, win.item_id FROM runs r JOIN win ON win.n = r.n AND win.t = r.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit,0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n_items,0) AS BIGINT) AS n_items,
  CASE WHEN items.s IS NULL THEN '{EMPTY_SHA256}' ELSE sha256(items.s) END AS items_sha256,
  coalesce(words.n_hit,0) > 0 AS contaminated
FROM dw d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
