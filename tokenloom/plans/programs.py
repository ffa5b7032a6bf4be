"""Whole programs: token counting and selection, grouping of records, subsampling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.tokens import tokenise
from tokenloom.operators import components as C
from tokenloom.operators import connections as N
from tokenloom.operators import counting as K
from tokenloom.operators import spectral, trees
from tokenloom.sources.shared import checkpointed


@dataclass(frozen=True)
class Settings:
    """How records are grouped.

    min_size: least members of a result; max_size: most members of a scaffold (-1: any
    number); fraction: share of directed edges that make scaffolds, used where score is 0;
    score: scaffold edges have more than this; enrichment: least score that brings a record
    to a core; tail: least score of an edge that amplifies a tail; dims: eigenvectors;
    spectral_only: group all records by edges of 5 and more at once.
    """

    min_size: int = 30
    max_size: int = -1
    fraction: float = 0.15
    score: int = 0
    enrichment: int = 20
    tail: int = 40
    dims: int = 16
    spectral_only: bool = False
    core_score: int = 5
    forced_score: int = 5


@dataclass
class Selection:
    k: int
    counts: DataFrame
    cube: DataFrame
    histogram: DataFrame
    tokens: DataFrame
    extra: dict = field(default_factory=dict)


def select_tokens(records: DataFrame, lower: int, upper: int, k: int | None = None, share: float = 1.0, seed: int = 1, singleton_scope: str = "per_category", thresholds: tuple[float, ...] = K.EXACT_THRESHOLDS) -> Selection:
    """Counts tokens by category and selects those whose total is within lower..upper.

    k: token length, by the rule of unique_k where it is None.  singleton_scope: which
    single occurrences are left out first.  tokens: (token, total, categories,
    discriminative), or a share of them.
    """
    k = k or K.unique_k(records)
    counts = checkpointed(K.counts_by_category(records, k))
    kept = K.non_singletons(counts, singleton_scope)
    totals = K.summed(kept)
    chosen = K.sampled(K.band(totals, lower, upper), share, seed).withColumn("discriminative", K.is_discriminative(F.col("categories")))
    return Selection(k, counts, K.specificity_cube(kept, thresholds), K.histogram(totals), chosen)


def approximate_selection(records: DataFrame, lower: int, upper: int, k: int | None = None) -> Selection:
    """As select_tokens by the rules of the sketch-based program: singletons are left out over all categories together."""
    return select_tokens(records, lower, upper, k, singleton_scope="pooled", thresholds=K.SKETCH_THRESHOLDS)


@dataclass
class Grouping:
    """scaffolds and components: (component_id, read_id); forest: (x, y, score); tails: (component_id, side, read_id)."""

    scaffolds: DataFrame
    components: DataFrame
    forest: DataFrame | None = None
    tails: DataFrame | None = None


def group_records(records: DataFrame, tokens: DataFrame, k: int, settings: Settings = Settings()) -> Grouping:
    """Groups records by the tokens they share.

    Strong edges make scaffolds; tails of scaffolds that share tokens join scaffolds into
    cores, by spectral grouping; every other record goes to the core it shares most with.
    """
    occ = checkpointed(N.selected_occurrences(tokenise(records, k), tokens))
    mult = checkpointed(N.multiplicities(occ))
    if settings.spectral_only:
        edges = N.pairs(mult, min_score=settings.forced_score)
        found = spectral.spectral_clusters(edges, settings.dims).select(F.col("cluster").alias("component_id"), "read_id")
        return Grouping(found, C.at_least(found, settings.min_size))

    if settings.score > 0:
        edges = N.above(N.connections(mult, min_score=settings.score), settings.score)
    else:
        edges = N.top_fraction(N.connections(mult), settings.fraction)
    edges = checkpointed(edges)
    if settings.max_size > 0:
        bounded = checkpointed(C.bounded_components(edges, settings.max_size))
        scaffolds = bounded.select("component_id", "read_id")
        forest = bounded.where("x IS NOT NULL").select("x", "y").join(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "score").distinct(), ["x", "y"])
    else:
        scaffolds = C.components_of(edges)
        forest = trees.spanning_forest(edges)
    scaffolds = checkpointed(C.at_least(scaffolds, settings.min_size))
    forest = checkpointed(forest.join(scaffolds.select(F.col("read_id").alias("x")), "x", "left_semi"))
    cores, tail = scaffolds, None
    if C.sizes(scaffolds).count() > 2:
        lengths = records.select("read_id", F.length("sequence").alias("length"))
        average = int(lengths.agg(F.floor(F.avg("length"))).first()[0] or 0)
        first = N.first_positions(occ)
        overlaps = N.overlap_estimates(forest, first)
        ends = trees.tails(overlaps, lengths, average)
        names = scaffolds.withColumnRenamed("component_id", "scaffold")
        ends = ends.join(names, "read_id").select(F.col("scaffold").alias("component_id"), "side", "read_id")
        strong = N.one_sided(mult, ends.select("read_id"), min_score=settings.tail)
        tail = checkpointed(trees.amplified(ends, strong, settings.tail))
        links = N.above(trees.tail_overlaps(tail, mult), settings.core_score).select(F.col("c1").alias("x"), F.col("c2").alias("y"), "score")
        links = checkpointed(links)
        if not links.isEmpty():
            joined = spectral.spectral_clusters(links, settings.dims).select(F.col("read_id").alias("component_id"), F.col("cluster").alias("target"))
            cores = checkpointed(C.merged(scaffolds, joined))
    enriched = C.assigned(C.core_scores(mult, cores, settings.enrichment), cores)
    return Grouping(scaffolds, C.at_least(checkpointed(enriched), settings.min_size), forest, tail)


def subsample(spark: SparkSession, path: str, wanted: int, out: str, seed: int = 1, mode: str = "error") -> None:
    """About `wanted` records of a file, without those that hold an N, as FASTQ."""
    from tokenloom.sources import records as R

    R.write_records(R.subsampled(R.read_records(spark, [path]), wanted, seed), out, "fastq", mode)
