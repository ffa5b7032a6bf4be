"""The driver's tables as records, in DataFrame form and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = "ACGTACGTACGTACGTACGTACGTAC"
_QUALITIES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores.

    A table of one small file is one partition, and tokenising it would keep one core busy;
    tables with enough splits stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per language, numbered in their order with null last.

    To be broadcast: Spark takes it for as large as the documents, and would send all texts to a task per language.
    """
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("__lang__")).distinct()
    return F.broadcast(langs.select("__lang__", (F.row_number().over(W.orderBy(F.asc_nulls_last("__lang__"))) - 1).cast("int").alias("category_id")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads as (read_id, category_id, text) with their texts as they are, of which bases makes sequences."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return d.join(_languages(spark, sf_dir), F.col("lang").eqNullSafe(F.col("__lang__"))).select((F.col("doc_id") + 1).alias("read_id"), "category_id", "text")


_TO_BASES = bytes.maketrans(_LETTERS.encode(), _BASES.encode())
_NO_LETTERS = bytes(set(range(256)) - set(_LETTERS.encode()))


def bases(text: bytes) -> bytes:
    """The sequence that reads has for a text."""
    return text.decode("utf-8", "replace").lower().encode().translate(_TO_BASES, _NO_LETTERS)


def reads(spark: SparkSession, sf_dir: str, with_qualities: bool = False) -> DataFrame:
    """documents as reads: letters a-z become bases in turn, the language is the file."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    letters = F.regexp_replace(F.lower("text"), "[^a-z]+", "")
    out = d.select((F.col("doc_id") + 1).alias("read_id"), "lang", letters.alias("letters")).join(_languages(spark, sf_dir), F.col("lang").eqNullSafe(F.col("__lang__")))
    start = (F.col("read_id") * 37) % 5000 + 1
    cols = [F.col("read_id"), F.concat(F.lit("read"), "read_id").alias("header"), F.translate("letters", _LETTERS, _BASES).alias("sequence"), F.col("category_id").cast("int").alias("category_id"), start.alias("start"), (start + F.length("letters")).alias("end")]
    if with_qualities:
        cols.append(F.translate("letters", _LETTERS, _QUALITIES).alias("qualities"))
    return out.select(*cols)


#: reads as a SQL common table.
READS = f"""reads AS MATERIALIZED (
  SELECT read_id, 'read' || read_id AS header, translate(letters, '{_LETTERS}', '{_BASES}') AS sequence, category_id,
    (read_id * 37) % 5000 + 1 AS start, (read_id * 37) % 5000 + 1 + length(letters) AS stop,
    translate(letters, '{_LETTERS}', '{_QUALITIES}') AS qualities
  FROM (SELECT doc_id + 1 AS read_id, CAST(dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 AS INTEGER) AS category_id,
    regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM documents))"""


def occurrences(k: int, name: str = "occ") -> str:
    """Token occurrences as a SQL common table; needs reads."""
    w = f"substr(sequence, i, {k})"
    return f"""{name} AS MATERIALIZED (
  SELECT read_id, category_id, CAST(i - 1 + {k} AS INTEGER) AS pos, least({w}, reverse(translate({w}, 'ACGT', 'TGCA'))) AS kmer
  FROM reads, LATERAL (SELECT unnest(range(1, length(sequence) - {k} + 2)) AS i) WHERE length(sequence) >= {k})"""


def band(k: int, lower: int, upper: int) -> str:
    """Tokens of the occurrence band as SQL common tables; also needs occ."""
    return f"""sdk AS MATERIALIZED (SELECT kmer, count(*) AS total FROM occ GROUP BY 1 HAVING count(*) BETWEEN {lower} AND {upper}),
sdk_occ AS MATERIALIZED (SELECT occ.* FROM occ JOIN sdk USING (kmer))"""


CONNECTIONS = """mult AS MATERIALIZED (SELECT read_id, kmer, count(*) AS m FROM sdk_occ GROUP BY 1, 2),
conn AS MATERIALIZED (SELECT a.read_id AS x, b.read_id AS y, CAST(sum(a.m * b.m) AS BIGINT) AS score FROM mult a JOIN mult b ON a.kmer = b.kmer AND a.read_id <> b.read_id GROUP BY 1, 2)"""


def components_sql(edges: str, name: str = "comp") -> str:
    """Connected components of the relation edges (x, y), both directions present; needs WITH RECURSIVE."""
    return f"""reach AS (SELECT DISTINCT x AS id, x AS r FROM {edges} UNION SELECT e.y, reach.r FROM reach JOIN {edges} e ON e.x = reach.id),
{name} AS MATERIALIZED (SELECT id AS read_id, CAST(min(r) AS BIGINT) AS component_id FROM reach GROUP BY 1)"""
