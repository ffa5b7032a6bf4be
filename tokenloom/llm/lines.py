"""Quality rules with cross-document line frequency.

One pass hashes each document's normalised lines and counts, per host, the documents
that have them; lines above the limits are removed, and documents that lose too much
are rejected, beside those that fail the within-document rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import slices, stored, table, trimmed
from tokenloom.llm.words import _BASE, _LOWER, Batch, hash_ranges, mix, split, windows

_U = np.uint64
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STEP = np.array([pow(_BASE, k, 2**64) for k in range(64)], dtype=np.uint64)


def _by_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the places of at."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[at])


def lines_of(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that have a word: document, first byte, end byte, first word, number of words."""
    breaks = np.flatnonzero(b.data == 10)
    of_word = np.searchsorted(breaks, b.starts)
    first = np.flatnonzero(np.diff(of_word, prepend=-1))
    line = of_word[first]
    begin = np.where(line > 0, breaks[np.maximum(line - 1, 0)] + 1, 0)
    return np.searchsorted(b.text_at, begin, side="right") - 1, begin, breaks[line], first, np.diff(np.append(first, len(b.starts)))


def normalised(b: Batch, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of each line's lower-cased words; blanks between them don't count."""
    if not len(first):
        return np.zeros(0, np.uint64)
    h = hash_ranges(_LOWER[b.data], b.starts, b.ends)
    at = np.arange(len(h)) - np.repeat(first, n)
    power = _STEP[at % 64]
    h = np.where(at < 64, h * power, mix(h + at.astype(np.uint64)) * power)
    return mix(np.add.reduceat(h, first) + n.astype(np.uint64))


def rules(b: Batch) -> dict[str, np.ndarray]:
    """Within-document figures of each text."""
    chars = (b.data & 0xC0) != 0x80
    inside = np.zeros(len(b.data) + 1, np.int8)
    inside[b.starts] += 1
    inside[b.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    doc, begin, end, _, _ = lines_of(b)
    same = mix(hash_ranges(b.data, begin, end) + mix(doc.astype(np.uint64)))
    once = np.unique(same, return_index=True)[1]
    dup = np.bincount(doc, minlength=b.n_docs) - np.bincount(doc[once], minlength=b.n_docs)
    n = len(b.starts)
    covered = np.zeros(n, bool)
    if n >= 8:
        w = windows(b.hashes(), 8)
        owner = b.doc
        start = np.flatnonzero(owner[: n - 7] == owner[7:])
        key = mix(w[start] + mix(owner[start].astype(np.uint64)))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            slot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = start[twice[slot] == key]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + 8, -1)
            covered = np.cumsum(edge[:-1]) > 0
    return {
        "n_words": b.counts,
        "word_chars": _by_doc(chars & inside, b.text_at),
        "n_symbols": _by_doc(_SYMBOLS[b.data], b.text_at),
        "n_dup_lines": dup,
        "n_repeat_words": _by_doc(covered, b.first),
    }


def _host_line(host: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(line + mix(host))


def _hosts(values: list) -> np.ndarray:
    """One hash per document of its host; null is a host of its own."""
    b = [b"\x00" if x is None else b"=" + str(x).encode() for x in values]
    ends = np.cumsum([len(x) for x in b], dtype=np.int64)
    return hash_ranges(np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def common_lines(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", min_docs: int = 8, share: float = 0.02, max_docs: int = 200, most_ids: int = 2_000_000) -> DataFrame:
    """Lines above the limits: host, line (hashes), docs (distinct documents of the host that have the line).

    A line is above the limits if more than `min_docs` documents of its host have it, and
    either more than `share` of that host's rows or more than `max_docs`, so that the bar
    of a host with millions of documents is no higher than that.  Each batch counts its own
    documents' distinct lines before anything is shuffled; rows whose id occurs again are
    counted by their ids, so that they are one document.
    """
    again = stored(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id__")).count().where("count > 1").select("__id__"), "again")
    repeated = again.count()
    source = docs.select(F.col(host_col).cast("string").alias("h"), F.col(id_col).alias("__id__"), F.col(text_col).cast("binary").alias("t"))
    rows = _line_rows(source.drop("__id__"), "docs bigint")
    if not repeated:
        counts = rows.groupBy("host", "line").agg(F.sum("docs").alias("docs"))
    else:
        ids = F.broadcast(again) if repeated <= most_ids else again
        single = _line_rows(source.join(ids, "__id__", "left_anti").drop("__id__"), "docs bigint")
        many = _line_rows(source.join(ids, "__id__", "left_semi").select("h", "t", "__id__"), f"id {source.schema['__id__'].dataType.simpleString()}").where("line <> 0").distinct().groupBy("host", "line").agg(F.count("*").alias("docs"))
        every = rows.where("line = 0").select("host", "line", "docs").union(single.where("line <> 0")).union(many.select("host", "line", "docs"))
        counts = every.groupBy("host", "line").agg(F.sum("docs").alias("docs"))
    counts = stored(counts.where(F.col("docs") > min_docs), "lines")
    of_host = counts.where("line = 0").select("host", F.col("docs").alias("of"))
    return counts.where("line <> 0").join(of_host, "host").where((F.col("docs") > F.col("of") * share) | (F.col("docs") > max_docs)).select("host", "line", "docs")


def _line_rows(source: DataFrame, last: str) -> DataFrame:
    """(host, line, last) of rows (h, t[, id]): lines with their number of rows in a batch, or one for each id that has them.

    Line 0 stands for the host's rows themselves.
    """
    by_id = not last.startswith("docs")

    def count(it):
        for rb in it:
            hosts = _hosts(rb.column(0).to_pylist()) if len(rb) else []
            for lo, hi, texts in slices(rb, 1, 6_000_000):
                b = split(texts, lower=False)
                doc, _, _, first, n = lines_of(b)
                line = normalised(b, first, n)
                once = np.unique(mix(line + mix(doc.astype(np.uint64))), return_index=True)[1]
                doc, line = doc[once], line[once]
                host = hosts[lo:hi][doc]
                if by_id:
                    yield pa.RecordBatch.from_arrays([pa.array(host.view(np.int64)), pa.array(line.view(np.int64)), rb.column(2).take(pa.array(doc + lo))], ["host", "line", "id"])
                    continue
                _, at, docs_ = np.unique(_host_line(host, line), return_index=True, return_counts=True)
                own, n_own = np.unique(hosts[lo:hi], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, host[at]]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(own), np.uint64), line[at]]).view(np.int64)), pa.array(np.concatenate([n_own, docs_]))], ["host", "line", "docs"])
        trimmed()

    return source.mapInArrow(count, f"host bigint, line bigint, {last}")


def line_quality(
    docs: DataFrame,
    host_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 8,
    share: float = 0.02,
    max_docs: int = 200,
    min_left: float = 0.5,
    min_words: int = 20,
    max_repeat: float = 0.3,
    block_lines: int = 4_000_000,
) -> DataFrame:
    """Quality figures and verdict of each row.

    Words are `[^\\x20\\x09-\\x0D]+`.  Returns id_col, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, removed_words (words in lines above the limits of
    common_lines), base_failed and kept.  A row is rejected if base_failed (fewer than
    min_words words, or over max_repeat of them in repeated 8-word windows) or if less
    than min_left of its words are left.

    Rows with one id are one document to the line counts, and each gets its own result; a
    row without an id is a document of its own.  Null and empty texts have no
    words and fail; null hosts together are one host; null ids stay null; a host with
    min_docs documents or fewer has no line above the limits.  Other columns are ignored.

    The lines to remove are broadcast in blocks of at most block_lines hashes; more
    of them take further passes, each adding the words of its own lines.
    """
    lines = stored(common_lines(docs, host_col, id_col, text_col, min_docs, share, max_docs), "common")
    n = lines.count()
    blocks = max(1, -(-n // block_lines))
    df = docs.select(F.col(id_col), F.col(host_col).cast("string").alias("__host__"), F.col(text_col).cast("binary").alias("__text__"), F.lit(0).cast("bigint").alias("__removed__"))
    spark = docs.sparkSession
    for k in range(blocks):
        part = lines if blocks == 1 else lines.where(F.pmod(F.xxhash64("line"), F.lit(blocks)) == k)
        rows = part.select("host", "line").toArrow()  # at most a block
        keys = np.sort(_host_line(rows["host"].to_numpy().view(np.uint64), rows["line"].to_numpy().view(np.uint64)))
        df = _removal(df, spark.sparkContext.broadcast(keys), last=k + 1 == blocks)
        if k + 1 < blocks:
            df = stored(df, "depleted")
    out = df.select(F.col(id_col), F.col("__removed__").alias("removed_words"), *_FIGURES)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    left = (F.col("n_words") - F.col("removed_words")) >= min_left * F.col("n_words")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & left)


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removal(df: DataFrame, keys, last: bool) -> DataFrame:
    """(id, host, text, removed) with the words of the lines in keys added to removed; the last pass has the figures of rules instead of the text."""
    tail = df.sparkSession.createDataFrame([], ", ".join(f"{c} bigint" for c in _FIGURES)).schema
    head = df.schema
    schema = type(head)([head[0], head[3], *tail.fields]) if last else head

    def run(it):
        top = keys.value
        for rb in it:
            hosts = _hosts(rb.column(1).to_pylist()) if len(rb) else []
            for lo, hi, texts in slices(rb, 2, 2_000_000):
                part = rb.slice(lo, hi - lo)
                gone = part.column(3).to_numpy().copy()
                b = split(texts, lower=False)
                if len(top):
                    doc, _, _, first, n = lines_of(b)
                    key = _host_line(hosts[lo:hi][doc], normalised(b, first, n))
                    hit = top[np.minimum(np.searchsorted(top, key), len(top) - 1)] == key
                    gone = gone + np.bincount(doc[hit], weights=n[hit], minlength=b.n_docs).astype(np.int64)
                if last:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gone), *map(pa.array, rules(b).values())], schema.fieldNames())
                else:
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(gone)], schema.fieldNames())
        trimmed()

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
base AS (
  SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d JOIN w USING (doc_id)),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT doc_id, source, line, regexp_extract_all(translate(line,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM lines),
real_lines AS (SELECT doc_id, source, line, len(lw) AS n, array_to_string(lw, ' ') AS norm FROM full_lines WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real_lines GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS t FROM w, LATERAL (SELECT unnest(range(1, len(w)-6)) AS i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, t FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest(range(i, i+8)) AS p FROM win JOIN twice USING (doc_id, t)) GROUP BY 1),
hosts AS (SELECT source, count(*) AS of_host FROM d GROUP BY 1),
common AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS docs FROM real_lines GROUP BY 1, 2) JOIN hosts USING (source)
  WHERE docs > 8 AND (docs > of_host * 0.02 OR docs > 200)),
gone AS (SELECT doc_id, sum(n) AS removed FROM real_lines JOIN common USING (source, norm) GROUP BY 1),
r AS (
  SELECT base.doc_id, n_words, word_chars, n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM base LEFT JOIN dup ON dup.doc_id = base.doc_id LEFT JOIN rep ON rep.doc_id = base.doc_id LEFT JOIN gone ON gone.doc_id = base.doc_id)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (n_words - removed_words) >= 0.5 * n_words AS kept
FROM r
"""
