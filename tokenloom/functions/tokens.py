"""Tokens (k-mers): column expressions for short inputs, and the vectorised tokeniser for all others.

A token is k bases, canonical (the lesser of itself and its reverse complement) and packed
two bits a base (A 0, C 1, G 2, T 3) into a LONG, so that the order of packed tokens is
that of their strings.  k is at most 31.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_K = 31

_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_SEPARATOR = 5


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def windows(s: Column, k: int) -> Column:
    """All windows of k characters; none if the text is shorter."""
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def packed(s: Column) -> Column:
    """String of A, C, G, T (31 at most) to its number."""
    return F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("bigint")


def unpacked(code: Column, k: int) -> Column:
    """Number to its string of k bases."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def expression_tokens(records: DataFrame, k: int, key: str = "read_id", sequence: str = "sequence", block: int = 64) -> DataFrame:
    """(key, code): canonical windows of A, C, G, T without Python; code: digits 0 to 3 for the bases, read as a decimal number (k: 18 at most).

    The text is cut into blocks that overlap by a window first, as a substring counts its place
    from the text's start; and numbers, unlike strings, are aggregated without a sort.
    """
    cut = F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{1,{block + k - 1}}})).{{1,{block}}}"), F.lit(1))
    b = records.select(key, F.explode(cut).alias("b")).where(F.length("b") >= k)
    both = b.select(key, F.translate("b", "ACGT", "0123").alias("f"), F.reverse(F.translate("b", "ACGT", "3210")).alias("r"))
    at = both.select("*", F.explode(F.sequence(F.lit(1), F.length("f") - k + 1)).alias("i"))
    number = lambda c, i: F.substring(c, i, F.lit(k)).cast("bigint")
    return at.select(key, F.least(number("f", F.col("i")), number("r", F.length("r") - k + 2 - F.col("i"))).alias("code"))


def code_string(code: Column, k: int) -> Column:
    """The bases of a code of expression_tokens."""
    return F.translate(F.lpad(code.cast("string"), k, "0"), "0123", "ACGT")


def quality_windows(q: Column, k: int) -> Column:
    """(low, mean) of each window of k quality characters: least code, and integer mean of the codes."""
    codes = F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c))
    at = F.when(F.length(q) >= k, F.sequence(F.lit(1), F.length(q) - k + 1)).otherwise(F.array().cast("array<int>"))

    def both(i: Column) -> Column:
        own = F.slice(codes, i, F.lit(k))
        return F.struct(F.array_min(own).alias("low"), F.floor(F.aggregate(own, F.lit(0), lambda a, x: a + x) / k).cast("int").alias("mean"))

    return F.transform(at, both)


def quality_below(a: Column, b: Column) -> Column:
    """Whether either figure of a is below that of b (no order: both ways may hold)."""
    return (a["low"] < b["low"]) | (a["mean"] < b["mean"])


def quality_above(a: Column, b: Column) -> Column:
    """Whether both figures of a are above those of b."""
    return (a["low"] > b["low"]) & (a["mean"] > b["mean"])


def specificity(most: Column, total: Column) -> Column:
    """Share of a token's largest category, in percent."""
    return most / total * 100


def upper_bound(value: Column, thresholds: list[float]) -> Column:
    """Least threshold above the value."""
    out = F.lit(None).cast("double")
    for t in sorted(thresholds, reverse=True):
        out = F.when(value < t, F.lit(float(t))).otherwise(out)
    return out


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def rescaled_exp(score: Column, low: Column, high: Column, bottom: float = 0.3, top: float = 20.0) -> Column:
    """exp of the score scaled linearly to bottom..top; the top where all scores are equal."""
    scaled = F.when(high > low, (top - bottom) * (score - low) / (high - low) + bottom).otherwise(F.lit(top))
    return F.exp(scaled)


def hash_share(key: Column, seed: int = 1) -> Column:
    """A number in 0..1 from a key: the first 32 bits of an MD5, which any SQL engine has; near keys are independent."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def quality_rows(records: DataFrame, k: int, record: str = "read_id", qualities: str = "qualities") -> DataFrame:
    """(record, pos, low, mean) of every window of k quality characters, vectorised; see quality_windows."""

    def run(it):
        for rb in it:
            for i in range(rb.num_rows):
                q = np.frombuffer(rb.column(1)[i].as_py() or b"", np.uint8)
                if len(q) < k:
                    continue
                own = np.lib.stride_tricks.sliding_window_view(q, k)
                sums = np.concatenate([[0], np.cumsum(q, dtype=np.int64)])
                n = len(own)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(k, n + k, dtype=np.int32)), pa.array(own.min(1).astype(np.int32)), pa.array(((sums[k:] - sums[:-k]) // k).astype(np.int32))], [record, "pos", "low", "mean"])

    source = records.select(record, F.col(qualities).cast("binary"))
    return source.mapInArrow(run, f"{record} {source.schema[0].dataType.simpleString()}, pos int, low int, mean int")


def _tokens_of(data: np.ndarray, k: int, n_as_a: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid windows in a byte array and their canonical codes."""
    code = _CODE[data].astype(np.uint64)
    code[data == 10] = _SEPARATOR
    bad = code == _SEPARATOR if n_as_a else code > 3
    m = len(code) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wrong = np.zeros(len(code) + 1, np.int32)
    np.cumsum(bad, out=wrong[1:])
    forward = np.where(code > 3, 0, code).astype(np.uint64)
    backward = np.where(code > 3, 0, 3 - code).astype(np.uint64)
    f, r = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    for j in range(k):
        f = (f << np.uint64(2)) | forward[j : j + m]
        r |= backward[j : j + m] << np.uint64(2 * j)
    at = np.flatnonzero(wrong[k:] == wrong[:-k])
    return at, np.minimum(f[at], r[at])


def tokenise(records: DataFrame, k: int, carry: tuple[str, ...] = ("read_id", "category_id"), sequence: str = "sequence", positions: bool = True, n_as_a: bool = False) -> DataFrame:
    """One row per token occurrence: the carried columns, pos (if positions) and token.

    pos is the place after the window, counted from 0.  Windows with characters other than A, C, G, T
    are dropped; n_as_a reads these as A on either strand instead.  Only the carried columns
    leave the scan; the sequence itself goes no further.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    source = records.select(*carry, F.col(sequence).cast("binary").alias("__s__"))
    n = len(carry)
    names = [*carry, *(["pos"] if positions else []), "token"]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:n]]

    def run(it):
        for rb in it:
            texts = rb.column(n)
            sizes = np.array([len(x or b"") + 1 for x in texts.to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(sizes):
                start = ends[lo] - sizes[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, start + 500_000, side="right")))
                data = np.frombuffer(b"\n".join([*(x or b"" for x in texts.slice(lo, hi - lo).to_pylist()), b""]), np.uint8)
                at, token = _tokens_of(data, k, n_as_a)
                row = np.searchsorted(ends[lo:hi] - start, at, side="right")
                take = pa.array(row + lo)
                own = [rb.column(c).take(take) for c in range(n)]
                if positions:
                    own.append(pa.array((at - (ends[lo:hi] - sizes[lo:hi] - start)[row] + k).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*own, pa.array(token.view(np.int64))], names)
                lo = hi

    return source.mapInArrow(run, ", ".join([*fields, *(["pos int"] if positions else []), "token bigint"]))
