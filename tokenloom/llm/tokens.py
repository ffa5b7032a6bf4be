"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but token ids of fixed width, one document after another, each
closed by the end-of-document id.  The scan cuts files into blocks, searches each block
for the separator with array operations, and stitches documents that cross blocks by a
prefix scan over the blocks' token counts and separators.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.llm.common import slices, table, trimmed
from tokenloom.sources.shared import forget_at_exit, new_path

#: Fixed value: the public splitting pattern of the byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Vocabulary of the registered query: 50,256 ranks, so that id 50256 is free for the end of a document.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
EOD = 50256

#: Digits of a document id (modulo 2**64) at the head of its tokens, base 50,000, least first; the first is 1 more than the digit.
_DIGITS, _BASE = 5, 50_000


def _encoder(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}, special_tokens={})


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", with_id: bool = True, most: int = 50_000) -> DataFrame:
    """tokens (binary): each row's ids as little-endian uint16; with_id: after five ids that hold its document id.

    Very long texts are encoded in pieces of about `most` characters, cut before a
    blank that follows a non-blank, where the pattern ends a word as well.
    Null ids are written as zeros; null texts have no ids.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    own = {}

    def pieces(text: str):
        at = 0
        while len(text) - at > most:
            to = at + most
            while to < len(text) and not (text[to] == " " and not text[to - 1].isspace()):
                to += 1
            yield text[at:to]
            at = to
        yield text[at:]

    def run(it):
        enc = own.setdefault(0, _encoder(ranks.value))
        for rb in it:
            ids = rb.column(0).to_pylist()
            for lo, hi, texts in slices(rb, 1, 2_000_000):
                out = []
                for i, t in zip(ids[lo:hi], texts):
                    t = (t or b"").decode("utf-8", "replace")
                    got = [x for p in pieces(t) for x in enc.encode_ordinary(p)]
                    if with_id:
                        head = [0] * _DIGITS if i is None else [i % 2**64 // _BASE**k % _BASE for k in range(_DIGITS)]
                        head[0] += i is not None
                        got = head + got
                    out.append(np.array(got, dtype="<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], ["tokens"])
        trimmed()

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, "tokens binary")


def write_token_files(tokens: DataFrame, path: str, eod: int = EOD, width: int = 2) -> None:
    """Flat files of the ids in the binary column `tokens`, with the id eod after each row.

    Spark's own text writer puts the rows' bytes out as they are, with the bytes of the
    separator as line end; so any file system that Spark writes to will do.
    """
    end = eod.to_bytes(width, "little").decode("iso-8859-1")
    tokens.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def scan(spark: SparkSession, path: str, eod: int = EOD, width: int = 2, block_tokens: int = 1 << 21, head: int = 0) -> DataFrame:
    """Documents of flat token files: path, ordinal, start, n_tokens, closed, head.

    start: the first token's place in its file; n_tokens without the separator; closed:
    whether a separator ends it (false: the file ends first); head: its first `head`
    ids.  A document without tokens counts, except after the last separator of a file.
    Bytes at the end that make no whole id are ignored; an empty file has no document.
    Files are read whole (keep shards under 2 GB, as the writer's are) and cut into
    blocks of block_tokens ids, of which each is searched on its own.
    """
    assert block_tokens >= max(head, 1)
    size = block_tokens * width
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    blocks = files.where(F.col("length") >= width).select("path", F.expr(f"explode(sequence(0L, (length - length % {width} - 1) div {size}))").alias("block"), "content")
    blocks = blocks.select("path", "block", F.expr(f"substring(content, CAST(block * {size} + 1 AS INT), {size})").alias("bytes"))
    kind = f"<u{width}"

    def search(it):
        for rb in it:
            for at in range(rb.num_rows):
                raw = rb.column(2)[at].as_buffer()
                ids = np.frombuffer(raw, dtype=kind, count=len(raw) // width)
                seps = np.flatnonzero(ids == eod)
                # The ids after each separator, as far as the block goes, taken at once.
                size = np.minimum(head, len(ids) - seps - 1)
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = ids[np.repeat(seps + 1 - ends[:-1], size) + np.arange(ends[-1])].astype(np.int64)
                heads = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, 1), rb.column(1).slice(at, 1), pa.array([len(ids)]), one(pa.array(seps)), one(heads), one(pa.array(ids[:head].astype(np.int64)))], ["path", "block", "n", "seps", "heads", "prefix"])
        trimmed()

    found = blocks.mapInArrow(search, "path string, block bigint, n bigint, seps array<bigint>, heads array<array<bigint>>, prefix array<bigint>")
    order = W.partitionBy("path").orderBy("block")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    scanned = (
        found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("seps", F.transform("seps", lambda x: x + F.col("base")))
        .withColumn("next", F.first(F.element_at(F.when(F.size("seps") > 0, F.col("seps")), 1), ignorenulls=True).over(after))
        .withColumn("total", F.sum("n").over(W.partitionBy("path")))
        .withColumn("more", F.coalesce(F.lead("prefix").over(order), F.array().cast("array<bigint>")))
        .withColumn("starts", F.concat(F.when(F.col("block") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.transform("seps", lambda x: x + 1)))
        .withColumn("heads", F.concat(F.when(F.col("block") == 0, F.array("prefix")).otherwise(F.array().cast("array<array<bigint>>")), F.col("heads")))
        .withColumn("ends", F.concat(F.when(F.col("block") == 0, F.col("seps")).otherwise(F.when(F.size("seps") > 0, F.slice("seps", F.lit(2), F.size("seps"))).otherwise(F.col("seps"))), F.when(F.size("starts") > 0, F.array("next")).otherwise(F.array().cast("array<bigint>"))))
        .withColumn("ordinal", F.coalesce(F.sum(F.size("starts")).over(before), F.lit(0)))
    )
    each = scanned.select("path", "total", "more", "ordinal", F.posexplode(F.arrays_zip("starts", "ends", "heads")).alias("k", "d"))
    n = F.coalesce(F.col("d.ends"), F.col("total")) - F.col("d.starts")
    return each.where(F.col("d.ends").isNotNull() | (F.col("d.starts") < F.col("total"))).select(
        "path",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        F.col("d.starts").alias("start"),
        n.alias("n_tokens"),
        F.col("d.ends").isNotNull().alias("closed"),
        F.slice(F.concat("d.heads", "more"), F.lit(1), F.least(F.lit(head).cast("bigint"), n).cast("int")).alias("head"),
    )


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, eod: int = EOD, block_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count of each row of docs (id_col, n_tokens), by way of flat token files in the shared folder.

    Null and empty texts have 0 tokens; null ids stay null; repeated rows are counted
    one by one; an empty table has no rows; other columns are ignored.  Ids are whole
    numbers of 64 bits at most, negative ones too; others are refused.
    """
    spark = docs.sparkSession
    own = docs.schema[id_col].dataType.simpleString()
    if own not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids of token files are whole numbers, not {own}")
    path = new_path(spark, "tokens")
    write_token_files(encoded(docs, vocabulary, id_col, text_col), path, eod)
    forget_at_exit(spark, path)
    found = scan(spark, path, eod, 2, block_tokens, _DIGITS)
    # Up to 2**64, so beyond a bigint until its upper half is made negative.
    digit = lambda k: F.element_at("head", k + 1).cast("decimal(20,0)") * F.lit(str(_BASE**k)).cast("decimal(20,0)")
    value = (sum((digit(k) for k in range(1, _DIGITS)), digit(0)) - 1).cast("decimal(38,0)")
    signed = F.when(value >= F.lit(str(2**63)).cast("decimal(38,0)"), value - F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(value)
    return found.select(F.when(F.element_at("head", 1) > 0, signed).cast(own).alias(id_col), (F.col("n_tokens") - _DIGITS).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
