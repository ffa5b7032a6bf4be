"""Reading and writing sequence records, token lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.functions.tokens import canonical, hash_share, unpacked

SCHEMA = "read_id bigint, header string, sequence string, qualities string, category_id int, start bigint, end bigint"


def sniff(spark: SparkSession, path: str) -> str:
    """fastq or fasta, by the first lines of a file; anything else is an error."""
    lines = [r["value"] for r in spark.read.text(path).limit(3).collect()]
    if not lines or not lines[0]:
        raise ValueError(f"{path} is empty")
    if lines[0][0] == "@" and len(lines) == 3 and lines[2][:1] == "+":
        return "fastq"
    if lines[0][0] == ">":
        return "fasta"
    raise ValueError(f"{path} is neither FASTQ nor FASTA")


def _numbered(spark: SparkSession, paths: list[str], separator: str | None = None) -> DataFrame:
    """(path_no, file, n, value): the lines of all files below each path, with their numbers from 0 within a file.

    A task's rows of one split stand in the file's order, so a line's number is its place in
    the split plus the lines of the file's splits before it.  Splits are counted first (one
    row each), and no line is moved, in whatever order Spark deals the splits out.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    lines = None
    for k, path in enumerate(paths):
        one = reader.text(path).select(F.lit(k).alias("path_no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
        lines = one if lines is None else lines.unionByName(one)
    split = ["path_no", "file", "block"]
    sizes = lines.groupBy(*split).agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = W.partitionBy("path_no", "file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*split, "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    # One row per split of the input, 128 MB of text by default: a million rows are 128 TB.
    numbered = lines.join(F.broadcast(offsets), split)
    return numbered.select("path_no", "file", (F.col("id") - F.col("first") + F.col("before")).alias("n"), "value")


def _placed(records: DataFrame) -> DataFrame:
    """(path_no, n, header, sequence, qualities): records numbered from 0 within their path, file by file in the order of their names."""
    sizes = records.groupBy("path_no", "file").agg((F.max("r") + 1).alias("records"))
    before = W.partitionBy("path_no").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("path_no", "file", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("before"))
    return records.join(F.broadcast(offsets), ["path_no", "file"]).select("path_no", (F.col("r") + F.col("before")).alias("n"), "header", "sequence", "qualities")


def _fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path_no, file, r, header, sequence, qualities): four lines a record; an incomplete last record of a file is left out."""
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.rtrim(F.col("value"), F.lit("\r"))))
    four = _numbered(spark, paths).groupBy("path_no", "file", (F.col("n") / 4).cast("bigint").alias("r")).agg(line(0).alias("h"), line(1).alias("sequence"), line(3).alias("qualities"))
    return four.where("qualities IS NOT NULL").select("path_no", "file", "r", F.expr("substring(h, 2)").alias("header"), "sequence", "qualities")


def _fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path_no, file, r, header, sequence, qualities); sequences may be wrapped over many lines.

    Records are split at line starts with `>` by the text reader itself, which a task does
    for its share of a file.
    """
    parts = _numbered(spark, paths, "\n>").withColumn("value", F.regexp_replace("value", "^>", ""))
    header = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substring(F.col("value"), F.length(header) + 2, F.length("value")), r"\s+", "")
    own = parts.select("path_no", "file", F.col("n").alias("r"), F.trim(header, F.lit("\r")).alias("header"), body.alias("sequence"), F.lit(None).cast("string").alias("qualities"))
    return own.where("header <> '' OR sequence <> ''")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(n, header, sequence, qualities) of a FASTQ file or of a folder of them."""
    return _placed(_fastq(spark, [path])).drop("path_no")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(n, header, sequence, qualities) of a FASTA file or of a folder of them."""
    return _placed(_fasta(spark, [path])).drop("path_no")


# Header forms of read simulators: pattern, group of the start, and how the length comes from the groups.
_SIMLORD = r";length=(\d+)bp;startpos=(\d+);"
_NANOSIM = r"_(\d+)_[^_]+_[^_]+_[^_]+_[^_]+_(\d+)_"
_PASS = r"(\d+)_(\d+)\|(\d+)\|"


def _number(header: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(header, pattern, group).try_cast("bigint")


def header_form(header: Column) -> Column:
    """Which simulator's form a header has; the last of simlord, nanosim, pass that fits."""
    return F.when(header.rlike(_PASS), "pass").when(header.rlike(_NANOSIM), "nanosim").when(header.rlike(_SIMLORD), "simlord")


def with_origin(records: DataFrame, form: Column | str | None = None) -> DataFrame:
    """records with start and end by their headers' form (0, 0 where there is none).

    The end is the start plus the length, but only where the start isn't 0.  form: a name
    or a column of names, by default each header's own.
    """
    h = F.col("header")
    f = header_form(h) if form is None else F.lit(form) if isinstance(form, str) else form
    start = F.when(f == "simlord", _number(h, _SIMLORD, 2)).when(f == "nanosim", _number(h, _NANOSIM, 1)).when(f == "pass", _number(h, _PASS, 3))
    length = F.when(f == "simlord", _number(h, _SIMLORD, 1)).when(f == "nanosim", _number(h, _NANOSIM, 2)).when(f == "pass", _number(h, _PASS, 2) - _number(h, _PASS, 1))
    s = F.coalesce(start, F.lit(0).cast("bigint"))
    return records.withColumn("start", s).withColumn("end", F.when(s != 0, s + F.coalesce(length, F.lit(0))).otherwise(F.lit(0).cast("bigint")))


def read_records(spark: SparkSession, paths: list[str], annotate: bool = True) -> DataFrame:
    """Records of several files, in SCHEMA; ids go on from file to file from 1, categories are the files' numbers (0: annotate is off).

    Each file's format is sniffed, and its first header decides on the form of all its
    headers.  All files of a format are one scan, whose records are numbered together.
    """
    forms = [sniff(spark, p) for p in paths]
    out = None
    for form, reader in (("fastq", _fastq), ("fasta", _fasta)):
        own = [k for k, f in enumerate(forms) if f == form]
        if own:
            r = _placed(reader(spark, [paths[k] for k in own])).withColumn("path_no", F.element_at(F.array(*map(F.lit, own)), F.col("path_no") + 1))
            out = r if out is None else out.unionByName(r)
    each = out.groupBy("path_no").agg((F.max("n") + 1).alias("records"), F.min_by(header_form(F.col("header")), "n").alias("form"))
    before = W.orderBy("path_no").rowsBetween(W.unboundedPreceding, -1)  # one row per path
    files = each.select("path_no", "form", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("before"))
    r = with_origin(out.join(F.broadcast(files), "path_no"), F.coalesce("form", F.lit("none")))
    return r.select((F.col("n") + 1 + F.col("before")).alias("read_id"), "header", "sequence", "qualities", (F.col("path_no") if annotate else F.lit(0)).alias("category_id"), "start", "end")


def file_statistics(records: DataFrame, key: str = "category_id") -> DataFrame:
    """key, records, min_length, max_length, avg_length (whole number), total_bases; the row of all files has a null key."""
    n = F.length("sequence")
    total = F.sum(n.cast("bigint"))
    return records.rollup(key).agg(F.count("*").alias("records"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.floor(total / F.count("*")).alias("avg_length"), total.alias("total_bases"))


def read_token_list(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(kmer) of a list with one token a line, canonical and each once; and the length of the last line."""
    lines = spark.read.text(path).select(F.trim("value").alias("kmer")).where("kmer <> ''")
    last = _numbered(spark, [path]).where("trim(value) <> ''").agg(F.max_by(F.length(F.trim("value")), F.struct("file", "n")).alias("n")).first()["n"]
    if last is None:
        raise ValueError(f"{path} has no token")
    return lines.select(canonical(F.col("kmer")).alias("kmer")).distinct(), last


def parse_counts(lines: DataFrame) -> DataFrame:
    """(kmer, cnt) of lines `KMER COUNT`."""
    return lines.select(F.substring_index("value", " ", 1).alias("kmer"), F.split("value", " ")[1].cast("bigint").alias("cnt"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_counts(spark.read.text(path))


def write_counts(counts: DataFrame, path: str, mode: str = "error", k: int | None = None, compression: str = "none") -> None:
    """Lines `KMER COUNT`, sorted by token over all files.

    k: counts have packed tokens of k bases (token) instead of strings (kmer), in the same order;
    they are sorted as numbers and become strings only where they are written.
    """
    kmer = F.col("kmer") if k is None else unpacked(F.col("token"), k)
    counts.orderBy("kmer" if k is None else "token").select(F.concat_ws(" ", kmer, F.col("cnt").cast("string")).alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_tokens(tokens: DataFrame, path: str, mode: str = "error") -> None:
    """One token a line."""
    tokens.select(F.col("kmer").alias("value")).write.mode(mode).text(path)


def rendered(form: str = "fastx") -> Column:
    """A record's text: fasta, fastq, or whichever the qualities allow (a record without a letter has as many qualities: none, but not null)."""
    fasta = F.concat(F.lit(">"), "header", F.lit("\n"), "sequence")
    fastq = F.concat(F.lit("@"), "header", F.lit("\n"), "sequence", F.lit("\n+\n"), F.coalesce("qualities", F.lit("")))
    return {"fasta": fasta, "fastq": fastq, "fastx": F.when(F.col("qualities").isNull() | ((F.col("qualities") == "") & (F.col("sequence") != "")), fasta).otherwise(fastq)}[form]


def write_records(records: DataFrame, path: str, form: str = "fastx", mode: str = "error") -> None:
    records.select(rendered(form).alias("value")).write.mode(mode).text(path)


def exported_rows(membership: DataFrame, records: DataFrame) -> DataFrame:
    """Records of components, with component_id; records of none are left out."""
    return records.join(membership, "read_id")


def write_components(membership: DataFrame, records: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per component with its records; what is there already stays unless mode says otherwise."""
    rows = exported_rows(membership, records)
    rows.select("component_id", rendered().alias("value")).repartition("component_id").write.mode(mode).partitionBy("component_id").text(path)


def write_tree(nodes: DataFrame, links: DataFrame, path: str, mode: str = "error") -> None:
    """Nodes and links as JSON lines, for a viewer."""
    nodes.write.mode(mode).json(f"{path}/nodes")
    links.write.mode(mode).json(f"{path}/links")


def subsampled(records: DataFrame, wanted: int, seed: int = 1) -> DataFrame:
    """About `wanted` records without an N, chosen by the hash of their ids: the same ones each time."""
    total = max(records.count(), 1)
    share = min(1.0, wanted / total)
    clean = records.where(~F.contains(F.col("sequence"), F.lit("N")))
    return clean.where(hash_share(F.col("read_id"), seed) < share)

