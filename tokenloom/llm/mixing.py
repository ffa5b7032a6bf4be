"""Mixing to target weights with soft memberships.

A classifier learnt from the table of labels gives each document its posterior of every
domain; nonnegative document rates are then fitted so that the expected tokens of each
domain meet the targets.  The fit is least squares by projected gradients on the rates:
in a document's own metric a gradient step moves its rate by its posterior times a vector
that is the same for all, so a round is one aggregation over the documents, and each
document replays the rounds' vectors on its rate wherever it lies.  Two forms follow each
other: steps scaled by the curvature and projected lazily (rates are the projection of 1
plus the sum of all steps; these are Newton steps on the dual), then plain accelerated
ones, projected each time, where targets can't be met.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import map_texts, stored, table
from tokenloom.llm.quality import fit, labelled, margins
from tokenloom.llm.words import split

_log = logging.getLogger(__name__)

#: Domains by the labels' columns quality and toxic, in this order, with the target weight of each.
DOMAINS = ("good", "poor", "good_toxic", "poor_toxic")
TARGETS = (0.94, 0.04, 0.015, 0.005)


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Number of the domain that a row of labels names; null if either label is."""
    return F.when(F.col(quality) > 0, 0).when(F.col(quality) <= 0, 1) + F.when(F.col(toxic) > 0, 2).when(F.col(toxic) <= 0, 0)


def memberships(docs: DataFrame, labels: DataFrame, domain: Column, n_domains: int, max_train: int = 12_000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens (words) and posterior (one number per domain) of each row.

    One-against-the-rest scores of a hashed n-gram classifier, learnt from at most
    max_train labelled rows, are normalised to sum to 1.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(labelled(docs, labels, domain, max_train, id_col, text_col), bits, n_domains))

    def member(texts):
        p = np.exp(np.clip(margins(texts, shared.value, bits), -30, 30))
        p /= 1 + p
        p /= p.sum(1, keepdims=True)
        return [split(texts).counts, list(p)]

    return map_texts(docs, member, "n_tokens bigint, posterior array<double>", id_col, text_col)


#: Whole numbers of this part of all tokens are summed.
_UNIT = 1e15

#: Weight of the rates' own distance to 1 beside the distance to the targets.  It makes the
#: optimum one point and the dual strictly concave, so that targets out of reach take no more
#: rounds than others; a rate of r is off the plain optimum's condition by this times r.
_NEAR = 1e-10

#: A round of the start looks at steps with these dampings, times the greatest curvature.
_DAMPING = (0.0, *(10.0**-k for k in range(10, -1, -1)))


@dataclass
class Fit:
    """State of the rates, and how well they do.

    mu: coefficients of the start; steps: (momentum, gradient step) of the projected gradients
    after it; left: each domain's share of all tokens that is left to meet (target less what
    the rates give); optimal: whether the gradient's optimality condition holds; rounds: passes
    over the rows.
    """

    mu: list[float]
    steps: list[tuple[float, list[float]]]
    left: list[float]
    optimal: bool
    rounds: int


def rates_of(p: np.ndarray, mu: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates by posterior, and how far the last step moved each."""
    rate = np.maximum(1 + (p * np.asarray(mu)).sum(1), 0.0)
    before, moved = rate, np.zeros_like(rate)
    for momentum, step in steps:
        ahead = rate + momentum * (rate - before)
        before, rate = rate, np.maximum(ahead + (p * np.asarray(step)).sum(1), 0.0)
        moved = rate - ahead
    return rate, moved


def _partial(tried: list[tuple[np.ndarray, list]], n: float, d: int):
    """A batch function: for every (mu, steps) tried, the sums of tokens by domain and of the curvature's upper half, and the longest last move, as (at, total, most)."""
    upper = np.triu_indices(d)

    def run(it):
        total = np.zeros((len(tried), d + len(upper[0])))
        most = np.zeros(len(tried))
        for rb in it:
            p = rb.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            part = p * (rb.column(0).to_numpy(zero_copy_only=False) * (_UNIT / n))[:, None]
            second = np.rint(part[:, upper[0]] * p[:, upper[1]])
            for k, state in enumerate(tried):
                rate, moved = rates_of(p, *state)
                # Whole numbers below 2**53, save in tries that are nine times too long.
                total[k, :d] += np.rint(part * rate[:, None]).sum(0)
                total[k, d:] += second[rate > 0].sum(0)
                most[k] = max(most[k], np.abs(moved).max(initial=0.0))
        total = np.minimum(total, 9e18).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel()), pa.array(np.repeat(most, total.shape[1]))], ["at", "total", "most"])

    return run


def fit_rates(rows: DataFrame, targets: tuple[float, ...], rounds: int = 1000, tolerance: float = 1e-6, start: int = 60) -> Fit:
    """Rates >= 0 that bring the domains' expected tokens as near to the targets as any do.

    Minimises half the squared distance of the domains' expected tokens to the targets, in
    the metric in which a document weighs as much as its tokens: there a gradient step
    changes a rate by the posterior times a vector that is the same for all documents, and
    the state is a few numbers.

    Beside it the rates' distance to 1 counts a little (`_NEAR`), so that one point is the
    optimum.  It is max(0, 1 + posterior * mu), the projection of 1 plus the sum of all steps:
    mu by steps scaled with the curvature (Newton's on the dual, which is concave), damped
    until the dual still rises at their end; at most `start` of them.  Where these stop short,
    accelerated projected gradients (step 1 / the curvature's greatest eigenvalue, momentum
    dropped when it points uphill) go on until no rate moves by more than `tolerance` times
    that step.  Both ends are optimality conditions, and `optimal` says whether one holds; at
    most `rounds` passes go
    over the rows.  Sums over documents are whole numbers of 1e-15 of all tokens, so that the
    order of adding doesn't change a digit.
    """
    d = len(targets)
    n = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    if not n:
        return Fit([0.0] * d, [], [0.0] * d, True, 0)
    weight = sum(targets)
    goal = np.array([t / weight for t in targets])
    upper = np.triu_indices(d)
    passes = 0

    def passed(tried: list[tuple[np.ndarray, list]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """What is left of the targets, the curvature and the longest last move, for every state tried."""
        nonlocal passes
        passes += 1
        found = rows.select("n_tokens", "posterior").mapInArrow(_partial(tried, n, d), "at int, total bigint, most double")
        total, most = np.zeros(len(tried) * (d + len(upper[0]))), np.zeros(len(tried) * (d + len(upper[0])))
        for r in found.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most")).collect():  # one row for each number of the state
            total[r["at"]], most[r["at"]] = float(r["total"]) / _UNIT, r["most"]
        out = []
        for part, far in zip(total.reshape(len(tried), -1), most.reshape(len(tried), -1)):
            c = np.zeros((d, d))
            c[upper] = c[upper[::-1]] = part[d:]
            out.append((goal - part[:d], c, float(far[0])))
        return out

    mu = np.zeros(d)
    ((left, c, _),) = passed([(mu, [])])
    greatest = float(np.linalg.eigvalsh(c)[-1])
    for _ in range(start):
        slope = left - _NEAR * mu
        if np.abs(left).max() <= tolerance or np.abs(slope).max() <= tolerance * 1e-4:
            break
        moves = [np.linalg.solve(c + np.eye(d) * (_NEAR + more * greatest), slope) for more in _DAMPING]
        found = passed([(mu + move, []) for move in moves])
        slopes = [x[0] - _NEAR * (mu + move) for move, x in zip(moves, found)]
        # Tries with several times all tokens aren't exact, and never the maximum.
        rising = [k for k, g in enumerate(slopes) if np.abs(g).max() < 8 and (g @ moves[k] >= 0 or np.square(g).sum() <= 0.25 * np.square(slope).sum())]
        if not rising:
            break
        mu, (left, c, _) = mu + moves[rising[0]], found[rising[0]]

    steps: list[tuple[float, list[float]]] = []
    # Posteriors sum to 1, so no document's gradient is longer than the greatest number.
    optimal = bool(np.abs(left).max() <= tolerance or (start and np.abs(left - _NEAR * mu).max() <= tolerance * 1e-2))
    momentum, t, before = 0.0, 1.0, left
    while not optimal and passes < rounds:
        ahead = left + momentum * (left - before)
        step = (momentum, (ahead / greatest).tolist())
        ((now, _, far),) = passed([(mu, [*steps, step])])
        optimal = far * greatest <= tolerance or bool(np.abs(now).max() <= tolerance)
        steps.append(step)
        before, left = left, now
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, t = ((t - 1) / after, after) if np.square(left).sum() <= np.square(before).sum() else (0.0, 1.0)
    return Fit(mu.tolist(), steps, left.tolist(), optimal, passes)


def with_rates(rows: DataFrame, fitted: Fit) -> DataFrame:
    """rows with the column rate that the fit gives each posterior."""
    if not fitted.optimal or np.abs(fitted.left).max() > 1e-4:
        _log.warning("targets not met: %s of all tokens left by domain, optimal: %s, passes: %d", fitted.left, fitted.optimal, fitted.rounds)
    if not fitted.steps:
        return rows.withColumn("rate", F.greatest(F.lit(0.0), sum((F.col("posterior")[k] * F.lit(float(m)) for k, m in enumerate(fitted.mu)), F.lit(1.0))))

    @F.arrow_udf("double")
    def rate(posterior: pa.Array) -> pa.Array:
        return pa.array(rates_of(posterior.flatten().to_numpy(zero_copy_only=False).reshape(len(posterior), -1), fitted.mu, fitted.steps)[0])

    return rows.withColumn("rate", rate("posterior"))


def mix(docs: DataFrame, labels: DataFrame, domain: Column | None = None, targets: tuple[float, ...] = TARGETS, max_train: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rates of each row: id_col, n_tokens, posterior, rate.

    rate: how often the row's document is to be drawn on average, so that the expected
    tokens of each domain (rate * n_tokens * posterior, over all rows) are its target's
    part of the tokens there are.  Targets are normalised to sum to 1; targets that no
    rates >= 0 can meet are met as nearly as any rates do; what is left is logged.

    Null and empty texts have 0 tokens and a rate by their posterior; labels without an id or a label are
    skipped; rows labelled twice are learnt twice; repeated rows get equal rates; null
    ids stay null; without labels all posteriors are equal and rates stay near 1; an
    empty table has no rates.  Other columns are ignored.
    """
    rows = stored(memberships(docs, labels, domain if domain is not None else domain_of(), len(targets), max_train, id_col=id_col, text_col=text_col), "member")
    return with_rates(rows, fit_rates(rows, targets, rounds=200))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_tokens", *(F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(DOMAINS)), "rate")


def copies(rate: Column, key: Column, seed: int = 17) -> Column:
    """How often a row is drawn: the rate's whole part, and one more with the chance of the rest, by a hash of the key."""
    share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return (F.floor(rate) + F.when(share < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the documents with their posteriors, sampling rates and copies.

    Each row keeps its columns and gets n_tokens, posterior, rate and copies (whole draws that
    the rate comes to, by a hash of doc_id; 0: the mix does without the row); a name that the
    table has already is replaced.  Null and empty texts have 0 tokens; rows with equal texts
    have equal rates, and equal ids equal copies; without labels all rates stay near 1.
    """
    labels = table(spark, sf_dir, "labels")
    bits = 18
    shared = spark.sparkContext.broadcast(fit(labelled(docs, labels, domain_of(), 12_000, "doc_id", "text"), bits, len(DOMAINS)))

    @F.arrow_udf("struct<n_tokens:bigint,posterior:array<double>>")
    def member(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        p = np.exp(np.clip(margins(texts, shared.value, bits), -30, 30))
        p /= 1 + p
        p /= p.sum(1, keepdims=True)
        return pa.array([{"n_tokens": n, "posterior": row} for n, row in zip(split(texts).counts.tolist(), p.tolist())], type=pa.struct([("n_tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))]))

    kept = docs.drop("n_tokens", "posterior", "rate", "copies")
    names = kept.columns
    own = kept.select(F.struct(*(kept[f"`{c}`"] for c in names)).alias("row"), member(F.col("text").cast("binary")).alias("m"))
    scored = stored(own.select("row", "m.n_tokens", "m.posterior"), "weigh")
    rated = with_rates(scored, fit_rates(scored.select("n_tokens", "posterior"), TARGETS, rounds=200))
    return rated.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "n_tokens", "posterior", "rate", copies(F.col("rate"), F.col("row.doc_id")).alias("copies"))
