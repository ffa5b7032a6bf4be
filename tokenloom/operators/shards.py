"""Exact counts of long tokens, dealt by minimizers.

Neighbouring tokens of a text mostly have the same least m-mer (minimizer).  Such a run is
sent as one stretch of bases, packed two bits each, to the shard of its minimizer: one or two
bytes a token instead of a row each.  A minimizer is that of the canonical token, so all
occurrences of a token meet in one shard, where they are sorted as one array.  Shards are
gone through one by one, so a task holds one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.tokens import _CODE, MAX_K

#: Shorter tokens repeat so often that a plain aggregation has few rows to send.
LEAST_K = 13
#: Letters whose stretches are gathered before they are sent; letters made into m-mers at once.
_GATHERED, _CHUNK = 4_000_000, 500_000
#: Bytes of packed bases that are unpacked at once.
_UNPACKED = 2_000_000
#: Pairs that are gathered before they are summed and sent (24 bytes each).
_PAIRS = 2_000_000
_NULL = np.iinfo(np.int64).min
_BASES = np.array([[b >> s & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)


def rolled(one: np.ndarray, k: int, backward: bool = False) -> np.ndarray:
    """All windows of k two-bit codes as numbers, put together from windows of 1, 2, 4, ... codes; backward: the first code is the lowest."""
    out, size, own, p, n = None, 0, one, 1, len(one)
    while True:
        if k & p:
            if out is None:
                out, size = own, p
            else:
                m = max(n - size - p + 1, 0)
                a, b = out[:m], own[size : size + m]
                out = (b << one.dtype.type(2 * size)) | a if backward else (a << one.dtype.type(2 * p)) | b
                size += p
            if size == k:
                return out[: max(n - k + 1, 0)]
        m = max(n - 2 * p + 1, 0)
        a, b = own[:m], own[p : p + m]
        own = (b << one.dtype.type(2 * p)) | a if backward else (a << one.dtype.type(2 * p)) | b
        p *= 2


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n, p = len(values) - w + 1, 1
    while 2 * p <= w:
        values = np.minimum(values[:-p], values[p:])
        p *= 2
    return np.minimum(values[:n], values[w - p : w - p + n]) if w > p else values[:n]


def _stretches(data: np.ndarray, k: int, m: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, shard) of the stretches in a byte array, and its codes."""
    code = _CODE[data]
    bad = code > 3
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16), code
    wrong = np.zeros(len(code) + 1, np.int32)
    np.cumsum(bad, out=wrong[1:])
    code[bad] = 0
    c = code.astype(np.uint32)
    mers = np.minimum(rolled(c, m), rolled(np.uint32(3) - c, m, True)) * np.uint32(0x9E3779B1)
    least = _least(mers, k - m + 1)
    valid = wrong[k:] == wrong[:-k]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, n))
    keep = valid[first]
    first, windows = first[keep], windows[keep]
    h = least[first]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return first, windows, ((h ^ (h >> np.uint32(13))) % np.uint32(shards)).astype(np.uint16), code


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these sizes: each one's number repeated, and the places 0, 1, ... within it."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _shards(df: DataFrame) -> int:
    return min(4096, max(256, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _flanks(bad: np.ndarray, before: np.ndarray, after: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many good letters, `most` at most, stand next to each stretch: before its first letter, and from `after` on."""
    bad = np.concatenate([np.ones(most, bool), bad, np.ones(most, bool)])
    left, right = np.zeros((2, len(before)), np.int64)
    for j in range(most):
        left += (left == j) & ~bad[before + most - 1 - j]
        right += (right == j) & ~bad[after + most + j]
    return left, right


def _cut(first: np.ndarray, windows: np.ndarray, shard: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches in pieces of `most` windows."""
    which, at = _within((windows + most - 1) // most)
    return first[which] + most * at, np.minimum(windows[which] - most * at, most), shard[which]


def dealt(records: DataFrame, k: int, carry: tuple[str, ...] = (), sequence: str = "sequence", prepare: Callable[[bytes], bytes] | None = None, places: bool = True, flank: int = 0) -> DataFrame:
    """(shard, n, size, blob): stretches of the records' tokens with their places and the carried whole numbers, dealt and sorted by shard.

    prepare: what makes a sequence of the column's bytes, where that isn't the sequence itself.
    places: without them, 0 stands for each, which takes next to no bytes.  flank: up to so many
    good letters on either side go with a stretch, and their numbers (left, and 256 times right) are its place;
    it is cut to have 32 letters at most.
    """
    if not LEAST_K <= k <= MAX_K:
        raise ValueError(f"k must be between {LEAST_K} and {MAX_K}")
    source = records.select(*(F.col(c).cast("bigint") for c in carry), F.col(sequence).cast("binary").alias("__s__"))
    shards, m, width = _shards(records), min(9, k - 4), len(carry)
    codec = "zstd"

    def send(parts: list) -> pa.RecordBatch:
        shard, windows, pos, packed, sizes = (np.concatenate([p[i] for p in parts]) for i in range(5))
        own = [np.concatenate([p[5][c] for p in parts]) for c in range(width)]
        order = np.argsort(shard, kind="stable")
        shard, windows, pos, own = shard[order], windows[order].astype(np.int32), pos[order].astype(np.int32), [o[order] for o in own]
        which, at = _within(sizes[order])
        packed = packed[(np.cumsum(sizes) - sizes)[order][which] + at]
        ends = np.cumsum(sizes[order])
        lo = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        hi = np.append(lo[1:], len(shard))
        blobs, raw = [], []
        for a, z in zip(lo.tolist(), hi.tolist()):
            b = b"".join([windows[a:z].tobytes(), pos[a:z].tobytes(), *(np.diff(o[a:z], prepend=0).tobytes() for o in own), packed[ends[a - 1] if a else 0 : ends[z - 1]].tobytes()])
            raw.append(len(b))
            blobs.append(pa.compress(b, codec, asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(shard[lo].astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(raw, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "n", "size", "blob"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, letters = [], 0
        for rb in it:
            texts = [x or b"" for x in rb.column(width).to_pylist()]
            if prepare:
                texts = [prepare(x) for x in texts]
            values = [rb.column(c).fill_null(int(_NULL)).to_numpy(zero_copy_only=False) for c in range(width)]
            ends = np.cumsum([len(x) + 1 for x in texts])
            lo = 0
            while lo < len(texts):
                begin = ends[lo] - len(texts[lo]) - 1
                hi = max(lo + 1, int(np.searchsorted(ends, begin + _CHUNK, side="right")))
                data = np.frombuffer(b"\n".join([*texts[lo:hi], b""]), np.uint8)
                first, windows, shard, code = _stretches(data, k, m, shards)
                if len(first):
                    if flank:
                        first, windows, shard = _cut(first, windows, shard, 33 - k - 2 * flank)
                    row = np.searchsorted(ends[lo:hi] - begin, first, side="right") + lo
                    left, right = _flanks(_CODE[data] > 3, first, first + windows + k - 1, flank) if flank else (0, 0)
                    sizes = (windows + left + right + k + 2) // 4
                    which, at = _within(sizes * 4)
                    four = np.append(code, np.zeros(4, np.uint8))[(first - left)[which] + at].reshape(-1, 4)
                    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
                    if flank:
                        pos = left | right << 8
                    elif places:
                        pos = first - (ends[row] - begin) + np.array([len(texts[i]) for i in range(lo, hi)])[row - lo] + 1 + k
                    else:
                        pos = np.zeros(len(first), np.int64)
                    parts.append((shard, windows, pos, packed, sizes, [v[row] for v in values]))
                letters += len(data)
                lo = hi
                if letters >= _GATHERED:
                    if parts:
                        yield send(parts)
                    parts, letters = [], 0
        if parts:
            yield send(parts)

    blobs = source.mapInArrow(run, "shard int, n int, size int, blob binary")
    return blobs.repartition("shard").sortWithinPartitions("shard")


def _unpacked(rows: list[tuple[int, int, bytes]], k: int, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(token, pos, carried) of some blobs of a shard."""
    windows, pos, packed, own = [], [], [], [[] for _ in range(width)]
    for n, size, blob in rows:
        b = np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.uint8)
        windows.append(b[: 4 * n].view(np.int32))
        pos.append(b[4 * n : 8 * n].view(np.int32))
        for c in range(width):
            own[c].append(np.cumsum(np.frombuffer(b[8 * n * (c + 1) : 8 * n * (c + 2)].tobytes(), np.int64)))
        packed.append(b[8 * n * (width + 1) :])
    windows = np.concatenate(windows)
    code = _BASES[np.concatenate(packed)].reshape(-1).astype(np.uint64)
    stride = (windows.astype(np.int64) + k + 2) // 4 * 4
    which, at = _within(windows)
    place = (np.cumsum(stride) - stride)[which] + at
    token = np.minimum(rolled(code, k)[place], rolled(np.uint64(3) - code, k, True)[place]).view(np.int64)
    return token, np.concatenate(pos)[which] + at.astype(np.int32), [np.concatenate(o)[which] for o in own]


def _parts(rows: list) -> Iterator[list]:
    """A shard's blobs, so many at a time as are unpacked at once."""
    lo = 0
    while lo < len(rows):
        hi, size = lo, 0
        while hi < len(rows) and (hi == lo or size < _UNPACKED):
            size += rows[hi][1]
            hi += 1
        yield rows[lo:hi]
        lo = hi


def _over_shards(blobs: DataFrame, of_shard: Callable[[list], list | None], batches: Callable[[Iterator[list]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The batches made of what of_shard(blobs) returns, if anything, of a task's shards one after another."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        now, rows = None, []
        for rb in it:
            for shard, n, size, blob in zip(*(rb.column(c).to_pylist() for c in range(4))):
                if shard != now:
                    if rows and (out := of_shard(rows)):
                        yield out
                    now, rows = shard, []
                rows.append((n, size, blob))
        if rows and (out := of_shard(rows)):
            yield out

    return blobs.mapInArrow(lambda it: batches(each(it)), schema)


def _by_shard(blobs: DataFrame, of_shard: Callable[[list], list | None], schema: str) -> DataFrame:
    """What of_shard(blobs) returns of every shard: a list of arrays by the schema, or None."""
    names = [f.split()[0] for f in schema.split(",")]
    return _over_shards(blobs, of_shard, lambda parts: (pa.RecordBatch.from_arrays([pa.array(x) for x in out], names) for out in parts), schema)


def _gathered(k: int, width: int, each: Callable) -> Callable[[list], list | None]:
    def of_shard(rows: list) -> list | None:
        parts = [_unpacked(x, k, width) for x in _parts(rows)]
        token, pos = (np.concatenate([p[i] for p in parts]) for i in range(2))
        return each(token, pos, [np.concatenate([p[2][c] for p in parts]) for c in range(width)])

    return of_shard


def gathered(blobs: DataFrame, k: int, width: int, each: Callable, schema: str) -> DataFrame:
    """What each(token, pos, carried) returns of every shard: a list of arrays by the schema, or None; carried nulls are the least LONG."""
    return _by_shard(blobs, _gathered(k, width, each), schema)


def _of_lengths(rows: list, k: int, ks: list[int]) -> list[np.ndarray]:
    """Tokens of each length of ks whose middle k letters are windows of these flanked stretches."""
    windows, pos, packed = [], [], []
    for n, size, blob in rows:
        b = np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), np.uint8)
        windows.append(b[: 4 * n].view(np.int32))
        pos.append(b[4 * n : 8 * n].view(np.int32))
        packed.append(b[8 * n :])
    windows, pos = np.concatenate(windows).astype(np.int64), np.concatenate(pos).astype(np.int64)
    left, right = pos & 255, pos >> 8
    # A stretch is a number of 32 letters, the first one highest; its reverse complement another.
    eight = np.zeros((len(windows), 8), np.uint8)
    eight[_within((windows + left + right + k + 2) // 4)] = np.concatenate(packed)
    forward = eight.view(">u8").ravel().astype(np.uint64)
    backward = (~forward).byteswap()
    for bits, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        backward = (backward >> np.uint64(bits)) & np.uint64(mask) | (backward & np.uint64(mask)) << np.uint64(bits)
    out = []
    for size in ks:
        d, rest = (size - k) // 2, np.uint64(64 - 2 * size)
        lo = np.maximum(d - left, 0)
        which, at = _within(np.maximum(np.minimum(windows, windows + right - d) - lo, 0))
        place = (2 * ((left + lo - d)[which] + at)).astype(np.uint64)
        token = np.minimum((forward[which] << place) >> rest, (backward[which] << (rest - place)) >> rest)
        out.append(token.astype(np.uint32) if size <= 16 else token)
    return out


def distinct(records: DataFrame, ks: list[int], **source) -> DataFrame:
    """(k, distinct_kmers) of lengths that differ by even numbers, in one dealing.

    A token lies in the shard of its middle letters, as many as the least length has: those of
    its reverse complement are their reverse complement, so its occurrences meet.
    """
    k = min(ks)
    flank = (max(ks) - k) // 2
    if any((x - k) % 2 for x in ks) or max(ks) > MAX_K:
        raise ValueError(f"lengths must differ by even numbers and be {MAX_K} at most")

    if not flank:  # one length: stretches aren't cut
        return _all_lengths(of_tokens(records, k, lambda token, n: [np.array([k], np.int32), np.array([len(token)], np.int64)], "k int, n bigint", **source), ks)

    def of_shard(rows: list) -> list:
        parts = [_of_lengths(x, k, ks) for x in _parts(rows)]
        sizes = [len(runs(np.sort(np.concatenate([p[i] for p in parts])))[0]) for i in range(len(ks))]
        return [np.array(ks, np.int32), np.array(sizes, np.int64)]

    counts = _by_shard(dealt(records, k, places=False, flank=flank, **source), of_shard, "k int, n bigint")
    return _all_lengths(counts, ks)


def _all_lengths(counts: DataFrame, ks: list[int]) -> DataFrame:
    """(k, distinct_kmers) of counts (k, n) by part; 0 for lengths without any."""
    sums = counts.agg(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n{k}") for k in ks))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("distinct_kmers")) for k in ks))))


def distinct_short(records: DataFrame, k: int, sequence: str = "sequence", prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(k, distinct_kmers) of a length of 12 at most: each task marks what it meets in a map of 4 ** k bits, sent in blocks."""
    if not 1 <= k < LEAST_K:
        raise ValueError(f"k must be between 1 and {LEAST_K - 1}")
    size, block = max(4**k, 8), 1 << 16

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(size, bool)
        for rb in it:
            texts = [(prepare(x or b"") if prepare else x or b"") for x in rb.column(0).to_pylist()]
            ends, lo = np.cumsum([len(x) + 1 for x in texts]), 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - len(texts[lo]) - 1 + _CHUNK, side="right")))
                code = _CODE[np.frombuffer(b"\n".join([*texts[lo:hi], b""]), np.uint8)]
                wrong = np.concatenate([[0], np.cumsum(code > 3, dtype=np.int32)])
                c = (code & 3).astype(np.uint32)
                met[np.minimum(rolled(c, k), rolled(np.uint32(3) - c, k, True))[wrong[k:] == wrong[:-k]]] = True
                lo = hi
        for at in range(0, size, block):
            if met[at : at + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([at // block], pa.int32()), pa.array([np.packbits(met[at : at + block]).tobytes()], pa.binary())], ["block", "bits"])

    def added(rows) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(np.unpackbits(bits).sum())], pa.int64())], ["k", "n"])
        for rb in rows:
            for b, own in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                own = np.frombuffer(own, np.uint8)
                if b != now and now is not None:
                    yield done()
                now, bits = b, own if b != now else bits | own
        if now is not None:
            yield done()

    blocks = records.select(F.col(sequence).cast("binary")).mapInArrow(run, "block int, bits binary")
    return _all_lengths(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(added, "k int, n bigint"), [k])


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal neighbours begins, and its length."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _in_band(token: np.ndarray, lower: int, upper: int | None) -> np.ndarray:
    """Places of the occurrences whose token is found lower..upper times, by token."""
    s = np.sort(token)
    first, n = runs(s)
    band = s[first[(n >= lower) & (n <= upper)]]
    if not len(band):
        return np.zeros(0, np.int64)
    # A small table of hashes leaves few occurrences to look up.
    h = lambda t: (t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[h(band)] = True
    at = np.flatnonzero(table[h(token)])
    k = np.minimum(np.searchsorted(band, token[at]), len(band) - 1)
    at = at[band[k] == token[at]]
    return at[np.argsort(token[at], kind="stable")]


def totals(records: DataFrame, k: int, lower: int = 1, upper: int | None = None, **source) -> DataFrame:
    """(token, total) of tokens found lower..upper times; source: sequence and prepare of dealt, here and below."""

    def each(token, n):
        keep = (n >= lower) & (n <= (upper or n.max(initial=0)))
        return [token[keep], n[keep].astype(np.int64)]

    return of_tokens(records, k, each, "token bigint, total bigint", **source)


def of_tokens(records: DataFrame, k: int, each: Callable, schema: str, **source) -> DataFrame:
    """What each(token, total) returns of every shard's distinct tokens: a list of arrays by the schema."""

    def of_shard(token, pos, own):
        s = np.sort(token)
        first, n = runs(s)
        return each(s[first], n)

    return gathered(dealt(records, k, places=False, **source), k, 0, of_shard, schema)


def _counted(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, key, count) of their pairs by token, and the token's total beside each."""
    order = np.lexsort((key, token))
    t, v = token[order], key[order]
    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (v[1:] != v[:-1]))) if len(t) else np.zeros(0, np.int64)
    _, size = runs(t)
    return t[first], v[first], np.diff(np.append(first, len(t))), np.repeat(size, size)[first]


def profile(records: DataFrame, k: int, key: str = "category_id", **source) -> DataFrame:
    """(cnt, total, n): how many pairs of a token and a key are found cnt times, where the token is found total times."""

    def each(token, pos, own):
        _, _, cnt, total = _counted(token, own[0])
        both, n = np.unique(np.stack([cnt, total]), axis=1, return_counts=True) if len(cnt) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        return [both[0].astype(np.int64), both[1].astype(np.int64), n.astype(np.int64)]

    rows = gathered(dealt(records, k, (key,), places=False, **source), k, 1, each, "cnt bigint, total bigint, n bigint")
    return rows.groupBy("cnt", "total").agg(F.sum("n").alias("n"))


def _met(t: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows a < b of the same token t, sorted by their records' numbers at[a] * n + at[b], which come first."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(t)):
        same = np.flatnonzero(t[d:] == t[:-d])
        if not len(same):
            break
        a.append(same)
        b.append(same + d)
    a, b = np.concatenate(a), np.concatenate(b)
    key = at[a] * n + at[b]
    order = np.argsort(key, kind="stable")
    return key[order], a[order], b[order]


def _pairs(token: np.ndarray, record: np.ndarray) -> list[np.ndarray]:
    """(x, y, score) with x < y over a shard: of the tokens that two records share, the products of their multiplicities."""
    t, v, m, _ = _counted(token, record)
    ids, at = np.unique(v, return_inverse=True)
    key, a, b = _met(t, at, len(ids))
    first, _ = runs(key)
    score = (m[a] * m[b]).astype(np.int64)
    return [ids[at[a[first]]], ids[at[b[first]]], np.add.reduceat(score, first) if len(first) else score]


def _summed(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    """Pairs sorted by x and y, each once with the sum of its scores."""
    order = np.lexsort((y, x))
    x, y, score = x[order], y[order], score[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)
    return [x[first], y[first], np.add.reduceat(score, first) if len(first) else score]


def _low_bits(a: np.ndarray, bits: int) -> bytes:
    """So many low bits of each number, without a gap."""
    least = (bits + 7) // 8
    octets = a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - least :]
    return np.packbits(np.unpackbits(octets, axis=1)[:, 8 * least - bits :]).tobytes()


def _from_low_bits(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    least = (bits + 7) // 8
    each = np.zeros((n, 8 * least), np.uint8)
    each[:, 8 * least - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
    octets = np.zeros((n, 8), np.uint8)
    octets[:, 8 - least :] = np.packbits(each, axis=1).reshape(n, least)
    return octets.view(">u8").ravel().astype(np.uint64)


#: Of a byte a pair: the shift and greatest value of the x, score and y fields; the greatest stands for a number that follows in full.
_FIELDS = ((0, 3), (2, 3), (4, 15))


def _packed_pairs(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> tuple[int, bytes]:
    """Sorted pairs as bytes, and the length of what is compressed of them.

    A pair is the differences to the one before (to x, for the first y of an x) and its score less 1: as
    many low bits of y's difference as hold no pattern, and a byte of what is above them and of the others.
    """
    dx = np.diff(x, prepend=0)
    head = dx != 0
    head[:1] = True
    dy = np.where(head, y - x, np.diff(y, prepend=0)).view(np.uint64)
    bits = int(np.log2(max(np.median(dy), 1))) if len(dy) else 0
    numbers = [dx.view(np.uint64), (score - 1).view(np.uint64), dy >> np.uint64(bits)]
    byte = np.zeros(len(x), np.uint8)
    for (shift, top), a in zip(_FIELDS, numbers):
        byte |= np.minimum(a, np.uint64(top)).astype(np.uint8) << np.uint8(shift)
    full = np.concatenate([a[a >= np.uint64(top)] for (_, top), a in zip(_FIELDS, numbers)])
    rest = byte.tobytes() + full.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(rest), bytes([bits]) + _low_bits(dy, bits) + pa.compress(rest, "zstd", asbytes=True)


def _unpacked_pairs(n: int, size: int, blob: bytes) -> list[np.ndarray]:
    bits = blob[0]
    end = 1 + (n * bits + 7) // 8
    rest = np.frombuffer(pa.decompress(blob[end:], size, "zstd", asbytes=True), np.uint8)
    full = np.ascontiguousarray(rest[n:].reshape(8, -1).T).view(np.uint64).ravel()
    numbers, at = [], 0
    for shift, top in _FIELDS:
        a = (rest[:n] >> np.uint8(shift) & np.uint8(top)).astype(np.uint64)
        more = np.flatnonzero(a == top)
        a[more] = full[at : at + len(more)]
        at += len(more)
        numbers.append(a)
    low = _from_low_bits(np.frombuffer(blob, np.uint8)[1:end], n, bits)
    dx, score, dy = numbers[0].view(np.int64), (numbers[1] + np.uint64(1)).view(np.int64), (numbers[2] << np.uint64(bits) | low).view(np.int64)
    x, run = np.cumsum(dx), np.cumsum(dy)
    head = dx != 0
    head[:1] = True
    first = np.flatnonzero(head)
    return [x, run + np.repeat(x[first] + dy[first] - run[first], np.diff(np.append(first, n))), score]


def _sent(parts: Iterator[list[np.ndarray]], shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, n, size, blob): pairs (x, y, score) summed over many parts, dealt by neighbouring x."""

    def send(gathered: list) -> pa.RecordBatch:
        x, y, score = _summed(*(np.concatenate([p[i] for p in gathered]) for i in range(3)))
        h = (x >> 6).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shard = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.uint16)
        order = np.argsort(shard, kind="stable")
        x, y, score = x[order], y[order], score[order]
        lo, n = runs(shard[order])
        sizes, packed = zip(*(_packed_pairs(x[a:z], y[a:z], score[a:z]) for a, z in zip(lo.tolist(), (lo + n).tolist())))
        return pa.RecordBatch.from_arrays([pa.array(shard[order][lo].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["shard", "n", "size", "blob"])

    own, size = [], 0
    for p in parts:
        own.append(p)
        size += len(p[0])
        if size >= _PAIRS:
            yield send(own)
            own, size = [], 0
    if size:
        yield send(own)


def summed_pairs(blobs: DataFrame, min_score: int = 1) -> DataFrame:
    """(x, y, score) of dealt pairs, a shard at a time: each pair's sum, where it is min_score or more."""

    def of_shard(rows: list) -> list | None:
        now, parts, size = [], [], 0
        for i, row in enumerate(rows, 1):
            parts.append(_unpacked_pairs(*row))
            size += row[0]
            if size >= _PAIRS or i == len(rows):
                now, parts, size = _summed(*(np.concatenate([*([now[c]] if now else []), *(p[c] for p in parts)]) for c in range(3))), [], 0
        keep = now[2] >= min_score
        return [a[keep] for a in now] if keep.any() else None

    return _by_shard(blobs.repartition("shard").sortWithinPartitions("shard"), of_shard, "x bigint, y bigint, score bigint")


def band_pairs(records: DataFrame, k: int, lower: int, upper: int, record: str = "read_id", min_score: int = 1, **source) -> DataFrame:
    """(x, y, score) with x < y: records that share tokens of the band, as connections.pairs has them.

    Most pairs share a token or two, and there are more of them than any other rows: they
    go to the sums sorted and as differences, three bytes each instead of a row.
    """
    return summed_pairs(dealt_pairs(records, k, lower, upper, record, **source), min_score)


def dealt_pairs(records: DataFrame, k: int, lower: int, upper: int, record: str = "read_id", **source) -> DataFrame:
    """(shard, n, size, blob): pairs of records that share tokens of the band, with the scores of each task's tokens."""
    shards = _shards(records)

    def each(token, pos, own):
        at = _in_band(token, lower, upper)
        at = at[own[0][at] != _NULL]
        return _pairs(token[at], own[0][at]) if len(at) else None

    return _over_shards(dealt(records, k, (record,), places=False, **source), _gathered(k, 1, each), lambda parts: _sent(parts, shards), "shard int, n int, size int, blob binary")


def _spans(token: np.ndarray, record: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """(x, y, score, x0, x1, y0, y1): _pairs with the least and greatest first place of the shared tokens in either record."""
    order = np.lexsort((pos, record, token))
    t, v, p = token[order], record[order], pos[order]
    head = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])))
    m = np.diff(np.append(head, len(t)))
    t, v, p = t[head], v[head], p[head]
    ids, at = np.unique(v, return_inverse=True)
    key, a, b = _met(t, at, len(ids))
    first, _ = runs(key)
    over = lambda f, x: f.reduceat(x, first) if len(first) else x
    ends = [over(f, p[i]) for i in (a, b) for f in (np.minimum, np.maximum)]
    return [ids[at[a[first]]], ids[at[b[first]]], over(np.add, (m[a] * m[b]).astype(np.int64)), *ends]


def band_overlaps(records: DataFrame, k: int, lower: int, upper: int, record: str = "read_id", min_score: int = 1, **source) -> DataFrame:
    """(x, y, score, overlap) with x < y: band_pairs with the larger of the ranges that shared tokens' first places span in either record.

    A shard has all occurrences of its tokens, so each pair's sum and ranges over a shard are one row; no occurrence is sent again.
    """

    def each(token, pos, own):
        at = _in_band(token, lower, upper)
        at = at[own[0][at] != _NULL]
        return _spans(token[at], own[0][at], pos[at]) if len(at) else None

    parts = gathered(dealt(records, k, (record,), **source), k, 1, each, "x bigint, y bigint, score bigint, x0 int, x1 int, y0 int, y1 int")
    both = parts.groupBy("x", "y").agg(F.sum("score").alias("score"), *(f(c).alias(c) for c, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))))
    return both.where(F.col("score") >= min_score).select("x", "y", "score", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("overlap"))


def band_occurrences(records: DataFrame, k: int, lower: int, upper: int, **source) -> DataFrame:
    """(read_id, category_id, pos, token) of the band's tokens."""

    def each(token, pos, own):
        at = _in_band(token, lower, upper)
        return [own[0][at], pa.array(own[1][at], mask=own[1][at] == _NULL).cast(pa.int32()), pos[at], token[at]] if len(at) else None

    return gathered(dealt(records, k, ("read_id", "category_id"), **source), k, 2, each, "read_id bigint, category_id int, pos int, token bigint")
