"""Command line: count, count-approx, group, subsample, generate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tokenloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("count", "count tokens by file and select a band"), ("count-approx", "the same, with singletons pooled over files")):
        c = sub.add_parser(name, help=what)
        c.add_argument("paths", nargs="+")
        c.add_argument("-k", "--k-size", type=int)
        c.add_argument("--lower", type=int, required=True)
        c.add_argument("--upper", type=int, required=True)
        c.add_argument("--share", type=float, default=1.0, help="share of the selected tokens to export")
        c.add_argument("-o", "--output", required=True)
    g = sub.add_parser("group", help="group records by the tokens they share")
    g.add_argument("paths", nargs="+")
    g.add_argument("-k", "--kmers", required=True, help="list of tokens, one a line")
    g.add_argument("-o", "--output", required=True)
    g.add_argument("--min-size", type=int, default=30)
    g.add_argument("--max-size", type=int, default=-1)
    g.add_argument("--fraction", type=float, default=0.15)
    g.add_argument("--score", type=int, default=0)
    g.add_argument("--tail", type=int, default=40)
    g.add_argument("--enrichment", type=int, default=20)
    g.add_argument("--dims", type=int, default=16)
    g.add_argument("-s", "--spectral", action="store_true")
    g.add_argument("-d", "--debug", action="store_true", help="print each component's reads and intervals")
    s = sub.add_parser("subsample", help="a random part of a file's records")
    s.add_argument("path")
    s.add_argument("wanted", type=int)
    s.add_argument("-o", "--output")
    r = sub.add_parser("generate", help="a pair of genomes and reads from both")
    r.add_argument("-n", "--size", type=int, required=True)
    r.add_argument("-d", "--difference", type=float, required=True)
    r.add_argument("-c", "--coverage", type=float, default=30)
    r.add_argument("-r", "--length", type=int, default=1000)
    r.add_argument("-e", "--error", type=float, default=0.0)
    r.add_argument("-o", "--output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from pyspark.sql import functions as F

    from tokenloom.functions.tokens import packed
    from tokenloom.operators import counting, intervals
    from tokenloom.plans import programs
    from tokenloom.sources import generators, records

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tokenloom").getOrCreate()
    if a.command in ("count", "count-approx"):
        r = records.read_records(spark, a.paths)
        found = programs.select_tokens(r, a.lower, a.upper, a.k_size, a.share) if a.command == "count" else programs.approximate_selection(r, a.lower, a.upper, a.k_size)
        records.write_tokens(counting.with_string(found.tokens, found.k), f"{a.output}/tokens")
        found.cube.write.parquet(f"{a.output}/specificity")
        found.histogram.write.parquet(f"{a.output}/histogram")
    elif a.command == "group":
        r = records.read_records(spark, a.paths)
        tokens, k = records.read_token_list(spark, a.kmers)
        s = programs.Settings(a.min_size, a.max_size, a.fraction, a.score, a.enrichment, a.tail, a.dims, a.spectral)
        found = programs.group_records(r, tokens.select(packed(F.col("kmer")).alias("token")), k, s)
        records.write_components(found.components, r, a.output)
        if a.debug:
            for row in intervals.report(found.components, r).orderBy("component_id").toLocalIterator():
                print(row["line"])
    elif a.command == "subsample":
        programs.subsample(spark, a.path, a.wanted, a.output or f"{a.path}_subsampled")
    else:
        bases = generators.genome_pair(spark, a.size, a.difference)
        for k, column in enumerate("ab"):
            reads = generators.uniform_reads(spark, generators.assembled(bases, column), a.size, a.coverage, a.length, a.error, k, seed=10 * k + 1)
            records.write_records(reads, f"{a.output}/{column}", "fastq")


if __name__ == "__main__":
    main()
