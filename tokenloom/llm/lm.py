"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how often
the context occurs; expectation-maximisation learns the weights on counts from which the
scored occurrence itself is held out (deleted).

Counts are exact and grow with the corpus, so they are never gathered in one place.
Texts are packed into chunks; a chunk asks for its distinct n-grams' counts by sending
them, sorted, delta-coded and compressed, to hash shards, which add up all chunks'
counts and answer each chunk in its own order.  The number of shards follows the number
of tokens, so a shard's share stays the same size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import crc_of, slices, stored, table, trimmed
from tokenloom.llm.words import mix, split

_U = np.uint64
#: Stand for the end of a text and for what is before its first word.
_END, _START = _U(0xE0D0E0D0E0D0E0D1), _U(0x57A7757A7757A775)

#: Context-frequency buckets by powers of two; grid of the estimates' logarithms for the mixture fit.
BUCKETS, _STEPS, _GRID2, _GRID1 = 24, 4, 121, 161


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    raw = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _sorted_packed(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=_U(0)))


def _sorted_unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


_CHUNK = "chunk bigint, ids array<{id}>, held array<boolean>, n array<bigint>, words binary, tokens binary, total bigint"


def _chunks(docs: DataFrame, held, id_col: str, text_col: str, most: int) -> DataFrame:
    """Texts as chunks: sorted hashes of the distinct words, and the words' numbers in order, an end after each text."""
    source = docs.select(F.col(id_col), F.coalesce(held, F.lit(False)).alias("__held__"), F.col(text_col).cast("binary"))
    fields = _CHUNK.format(id=source.schema[0].dataType.simpleString())

    def run(it):
        serial = TaskContext.get().partitionId() << 32
        for rb in it:
            for lo, hi, texts in slices(rb, 2, most):
                b = split(texts)
                h = np.insert(b.hashes(), b.first[1:], _END)
                words, tokens = np.unique(h, return_inverse=True)
                row = [[serial], [rb.column(0).slice(lo, hi - lo).to_pylist()], [rb.column(1).slice(lo, hi - lo).to_pylist()], [(b.counts + 1).tolist()], [_sorted_packed(words)], [packed(tokens)], [len(h)]]
                serial += 1
                yield pa.RecordBatch.from_pydict({k: pa.array(v, type=t) for (k, t), v in zip(types, row)})
        trimmed()

    schema = docs.sparkSession.createDataFrame([], fields).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [(f.name, f.type) for f in to_arrow_schema(schema)]
    return source.mapInArrow(run, schema)


def _pairs(words: np.ndarray, tokens: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Hash, of so many bits, of each token with the one before it."""
    before = np.empty(len(tokens), np.uint64)
    before[1:] = words[tokens[:-1]]
    before[np.cumsum(n) - n] = _START
    return mix(before * _U(0x9E3779B97F4A7C15) + words[tokens]) >> _U(64 - bits)


def _requests(chunks: DataFrame, shard_bits: int, bits: int) -> DataFrame:
    """(kind, shard, chunk, keys, counts): each chunk's distinct words (1) and pairs (2) by shard, with their training counts."""

    def run(it):
        for rb in it:
            for i in range(rb.num_rows):
                chunk, held, n, words, tokens = (rb.column(k)[i].as_py() for k in range(5))
                n = np.array(n)
                words, tokens = _sorted_unpacked(words), unpacked(tokens).astype(np.int64)
                learn = np.repeat(~np.array(held), n)
                pairs = _pairs(words, tokens, n, bits)
                own, at = np.unique(pairs, return_inverse=True)
                out = []
                for kind, keys, width, counts in ((1, words, 64, np.bincount(tokens[learn], minlength=len(words))), (2, own, bits, np.bincount(at[learn], minlength=len(own)))):
                    cut = np.searchsorted(keys, np.arange(1, 1 << shard_bits, dtype=np.uint64) << _U(width - shard_bits)) if shard_bits else []
                    out += [(kind, s, chunk, _sorted_packed(k), packed(c)) for s, (k, c) in enumerate(zip(np.split(keys, cut), np.split(counts, cut))) if len(k)]
                yield pa.RecordBatch.from_pydict(dict(zip(("kind", "shard", "chunk", "keys", "counts"), (pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))))))
                del words, tokens, pairs, own, at, out
        trimmed()

    return chunks.select("chunk", "held", "n", "words", "tokens").mapInArrow(run, "kind int, shard bigint, chunk bigint, keys binary, counts binary")


def _answers(requests: DataFrame, parts: int) -> DataFrame:
    """(kind, shard, chunk, totals), and for each shard a row of chunk -1 with its sum and number of counted words."""

    def added(kind, shard, asked):
        keys = [_sorted_unpacked(k) for _, k, _ in asked]
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[by][1:] != every[by][:-1]
        total = np.add.reduceat(np.concatenate([unpacked(c) for _, _, c in asked])[by], np.flatnonzero(new))
        out = np.empty(len(every), np.uint64)
        out[by] = total[np.cumsum(new) - 1]
        rows = [(kind, shard, chunk, packed(x), 0, 0) for (chunk, _, _), x in zip(asked, np.split(out, np.cumsum([len(k) for k in keys])[:-1]))]
        return [*rows, (kind, shard, -1, b"", int(total.sum()), int((total > 0).sum()))] if kind == 1 else rows

    def batch(rows):
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["kind", "shard", "chunk", "totals", "n", "v"])

    def run(it):
        at, asked = None, []
        for rb in it:
            for kind, shard, chunk, keys, counts in zip(*(rb.column(k).to_pylist() for k in range(5))):
                if (kind, shard) != at:
                    if asked:
                        yield batch(added(*at, asked))
                    at, asked = (kind, shard), []
                asked.append((chunk, keys, counts))
        yield batch(added(*at, asked) if asked else [])
        del asked
        trimmed()

    dealt = requests.repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard", "chunk")
    return dealt.mapInArrow(run, "kind int, shard bigint, chunk bigint, totals binary, n bigint, v bigint")


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1)


def _grid(p: np.ndarray, size: int) -> np.ndarray:
    """Cell of each probability; the last one is for 0."""
    with np.errstate(divide="ignore"):
        x = -np.log2(p) * _STEPS
    return np.where(p > 0, np.clip(np.nan_to_num(x, posinf=0), 0, size - 2), size - 1).astype(np.int64)


def _contexts(tokens: np.ndarray, n: np.ndarray, counts: np.ndarray, starts: int) -> np.ndarray:
    """How often each token's context begins a training pair."""
    out = np.empty(len(tokens), np.int64)
    out[1:] = counts[tokens[:-1]]
    out[np.cumsum(n) - n] = starts
    return out


def _counted(chunks: DataFrame, answers: DataFrame, bits: int, big_n: int, starts: int) -> DataFrame:
    """Chunks with every token's counts, and the cells of the mixture fit."""
    by = answers.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "shard", "totals"))).alias("a"))
    joined = chunks.join(by, "chunk").select("ids", "held", "n", "words", "tokens", "a")
    fields = f"ids {joined.schema['ids'].dataType.simpleString()}, held array<boolean>, n array<bigint>, tokens binary, counts binary, pairs binary, cells array<struct<cell:bigint,n:bigint>>"
    schema = chunks.sparkSession.createDataFrame([], fields).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    types = {f.name: f.type for f in to_arrow_schema(schema)}

    def run(it):
        for rb in it:
            for i in range(rb.num_rows):
                ids, held, n, words, tokens, a = (rb.column(k)[i].as_py() for k in range(6))
                sizes = np.array(n)
                words, t = _sorted_unpacked(words), unpacked(tokens).astype(np.int64)
                counts = np.concatenate([unpacked(x["totals"]) for x in a if x["kind"] == 1]).astype(np.int64)
                at = np.unique(_pairs(words, t, sizes, bits), return_inverse=True)[1]
                pairs = np.concatenate([unpacked(x["totals"]) for x in a if x["kind"] == 2]).astype(np.int64)[at]
                # One occurrence less of everything: the one that is predicted.
                learn = np.repeat(~np.array(held), sizes)
                ctx, c2, c1 = _contexts(t, sizes, counts, starts)[learn], pairs[learn] - 1, counts[t][learn] - 1
                p2 = c2 / np.maximum(ctx - 1, 1)
                p1 = c1 / max(big_n - 1, 1)
                cell = (_bucket(ctx) * _GRID2 + _grid(p2, _GRID2)) * _GRID1 + _grid(p1, _GRID1)
                cells, k = np.unique(cell, return_counts=True)
                row = {"ids": ids, "held": held, "n": n, "tokens": tokens, "counts": packed(counts), "pairs": packed(pairs), "cells": [{"cell": c, "n": m} for c, m in zip(cells.tolist(), k.tolist())]}
                del words, t, counts, at, pairs, ctx, c2, c1, p2, p1, cell, a
                yield pa.RecordBatch.from_pydict({k: pa.array([v], type=types[k]) for k, v in row.items()})
        trimmed()

    return joined.mapInArrow(run, schema)


def mixture(cells: np.ndarray, n: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket, by expectation-maximisation over counted cells."""
    bucket, g2, g1 = cells // (_GRID1 * _GRID2), cells // _GRID1 % _GRID2, cells % _GRID1
    p = np.stack([
        np.where(g2 < _GRID2 - 1, 2.0 ** (-(g2 + 0.5) / _STEPS), 0.0),
        np.where(g1 < _GRID1 - 1, 2.0 ** (-(g1 + 0.5) / _STEPS), 0.0),
        np.full(len(cells), 1 / (v + 1)),
    ], axis=1)
    w = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        part = w[bucket] * p
        part *= (n / part.sum(1))[:, None]
        got = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1) + 1e-3
        w = got / got.sum(1, keepdims=True)
    return w


def score(docs: DataFrame, held_out: int = 1, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8_000_000, shard_tokens: int = 1_000_000) -> DataFrame:
    """Log10 probabilities of each row's text under a model of the rows that aren't held out.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end that counts as a
    token.  Held out are rows whose crc32 of the id as text leaves remainder `held_out`
    by `folds`; their tokens are in no count.  Returns id_col, held_out, n_tokens,
    n_known (tokens that training has), train_tokens, base_score (unigrams with 0.5
    added) and score (the interpolated bigram model).

    Null and empty texts are one token, the end; null ids aren't held out and stay null;
    repeated rows are learnt and scored one by one; without any training row all words
    are equally likely, with log10 probability 0 for the one possible token.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    held = F.pmod(crc_of(id_col), F.lit(folds)) == held_out
    chunks = stored(_chunks(docs, held, id_col, text_col, chunk_bytes), "chunk")
    total = chunks.agg(F.sum("total")).first()[0] or 0
    starts = chunks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    shard_bits = max(2, int(np.ceil(np.log2(max(total, 1) / shard_tokens))))
    bits = int(min(64, max(44, np.ceil(np.log2(max(total, 1))) + 24)))
    answers = stored(_answers(_requests(chunks, shard_bits, bits), 2 << shard_bits), "answer")
    got = answers.where("chunk = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    big_n, v = got["n"] or 0, got["v"] or 0
    counted = stored(_counted(chunks, answers, bits, big_n, starts), "counted")
    cells = counted.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).orderBy("cell").toArrow()  # at most the grid
    weights = spark.sparkContext.broadcast(mixture(cells["cell"].to_numpy(), cells["n"].to_numpy().astype(float), v))
    fields = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    id_type = spark.createDataFrame([], fields).schema

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(id_type[0].dataType)
        w = weights.value
        for rb in it:
            for i in range(rb.num_rows):
                ids, held_, n, tokens, counts, pairs = (rb.column(k)[i].as_py() for k in range(6))
                n = np.array(n)
                t, counts, c2 = unpacked(tokens).astype(np.int64), unpacked(counts).astype(np.int64), unpacked(pairs).astype(np.int64)
                ctx, c1 = _contexts(t, n, counts, starts), counts[t]
                mix_ = w[_bucket(ctx)]
                known = ctx > 0
                p = np.where(known, mix_[:, 0], 0) * c2 / np.maximum(ctx, 1)
                rest = mix_[:, 1] * c1 / big_n + mix_[:, 2] / (v + 1) if big_n else np.full(len(t), 1 / (v + 1))
                p += rest / np.where(known | (big_n == 0), 1, mix_[:, 1] + mix_[:, 2])
                at = np.cumsum(n) - n
                base = np.log10((c1 + 0.5) / (big_n + 0.5 * (v + 1)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, type=kind), pa.array(held_, pa.bool_()), pa.array(n), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), at)),
                    pa.array(np.full(len(n), big_n, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at)),
                ], id_type.fieldNames())
        trimmed()

    return counted.select("ids", "held", "n", "tokens", "counts", "pairs").mapInArrow(run, id_type)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """What the operator must give but for the fitted weights, and those from the same cells, in plain Python, for tests."""
    import math
    import zlib
    from collections import Counter

    toks = {i: [x.decode("utf-8", "replace") for x in (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    uni, bi = Counter(), Counter()
    for i, t in toks.items():
        if not held[i]:
            uni.update(t)
            bi.update(zip([0, *t], t))
    big_n, v, starts = sum(uni.values()), len(uni), sum(not h for h in held.values())
    context = lambda u: starts if u == 0 else uni[u]
    cells = Counter()
    for i, t in toks.items():
        if not held[i]:
            for u, x in zip([0, *t], t):
                p2, p1 = np.array([(bi[u, x] - 1) / max(context(u) - 1, 1)]), np.array([(uni[x] - 1) / max(big_n - 1, 1)])
                cells[int((_bucket(np.array([context(u)])) * _GRID2 + _grid(p2, _GRID2))[0] * _GRID1 + _grid(p1, _GRID1)[0])] += 1
    keys = sorted(cells)
    w = mixture(np.array(keys, np.int64), np.array([cells[k] for k in keys], float), v)
    out = {}
    for i, t in toks.items():
        base = sum(math.log10((uni[x] + 0.5) / (big_n + 0.5 * (v + 1))) for x in t)
        total = 0.0
        for u, x in zip([0, *t], t):
            a, b, c = w[_bucket(np.array([context(u)]))[0]]
            rest = b * uni[x] / big_n + c / (v + 1) if big_n else 1 / (v + 1)
            total += math.log10(a * bi[u, x] / context(u) + rest) if context(u) else math.log10(rest / ((b + c) if big_n else 1))
        out[i] = (held[i], len(t), sum(uni[x] > 0 for x in t), big_n, base, total)
    return out
