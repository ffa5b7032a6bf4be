"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Training takes a bounded sample of labelled rows (`max_train` of them, by hash order of
the id) in one task; the weights are one array of fixed size, which is broadcast to
score every whole text as a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import crc_of, map_texts, slices, table
from tokenloom.llm.words import ALNUM, SHAPES, batches, mix, split, windows

_U = np.uint64
#: Stands for a word equal to the word before it.
_AGAIN = _U(0xA6A14A6A14)


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts (n = 1, 2), text by text, and the place where each text's begin.

    Tokens are runs of letters and digits, and runs of other visible characters, of the
    lower-cased text; a word equal to the word before it becomes a mark of repetition.
    Bucket 0 is the bias, which each text has once, so that no text is without features.
    """
    b = split(texts, inside=SHAPES)
    h, doc = b.hashes(), b.doc
    word = np.flatnonzero(ALNUM[b.data[b.starts]])
    same = (h[word[1:]] == h[word[:-1]]) & (doc[word[1:]] == doc[word[:-1]])
    h[word[1:][same]] = _AGAIN
    pairs = windows(h, 2)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    n = b.counts
    n_pairs = np.maximum(n - 1, 0)
    at = np.zeros(b.n_docs + 1, np.int64)
    np.cumsum(1 + n + n_pairs, out=at[1:])
    out = np.zeros(at[-1], np.int64)
    room = _U((1 << bits) - 1)
    out[np.arange(len(h)) + np.repeat(at[:-1] + 1 - b.first[:-1], n)] = 1 + (mix(h) % room).astype(np.int64)
    skipped = np.concatenate([[0], np.cumsum(n_pairs)[:-1]]) if b.n_docs else np.zeros(0, np.int64)
    out[np.arange(len(inside)) + np.repeat(at[:-1] + 1 + n - skipped, n_pairs)] = 1 + (mix(pairs[inside] + _U(1)) % room).astype(np.int64)
    return out, at


def train(examples, bits: int, classes: int = 1, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal over (buckets, class) pairs; class: 0/1 for one column of weights, else the column that is true.

    A text's feature is its n-gram's count divided by the root of the number of n-grams.
    """
    size = (1 << bits) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    goals = np.arange(classes)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for buckets, y in examples:
        i, c = np.unique(buckets, return_counts=True)
        x = (c / np.sqrt(len(buckets)))[:, None]
        zi, ni = z[i], n[i]
        w = weights(zi, ni)
        p = 1 / (1 + np.exp(-np.clip((w * x).sum(0), -30, 30)))
        g = x * (p - (y if classes == 1 else (goals == y)))
        step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
        z[i] += g - step * w
        n[i] += g * g
    return weights(z, n).astype(np.float32)


def margins(texts: list[bytes | None], w: np.ndarray, bits: int) -> np.ndarray:
    """Sparse dot product of each text with each column of weights."""
    out = np.zeros((len(texts), w.shape[1]))
    for lo, hi in batches(texts, 2_000_000):
        f, at = features(texts[lo:hi], bits)
        for k in range(w.shape[1]):
            out[lo:hi, k] = np.add.reduceat(w[:, k].astype(np.float64)[f], at[:-1]) / np.sqrt(np.diff(at))
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: Column, max_train: int, id_col: str, text_col: str) -> DataFrame:
    """(y, text, o) of at most max_train labelled rows, those with the lowest hashes of their ids.

    The bound counts labels whose document is there.  An id with several texts, or with a
    label given twice, counts once for each label, with the least of its texts.
    """
    own = labels.select(F.col(id_col).alias("__id__"), label.cast("int").alias("__y__")).where("__id__ IS NOT NULL AND __y__ IS NOT NULL").distinct()
    present = docs.select(F.col(id_col).alias("__id__")).join(own, "__id__").distinct()
    order = F.xxhash64(F.col("__id__"), F.lit(29)).alias("__o__")
    chosen = present.select("__id__", "__y__", order).orderBy("__o__", "__id__", "__y__").limit(max_train)
    d = docs.select(F.col(id_col).alias("__id__"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__t__"))
    both = d.join(F.broadcast(chosen), "__id__")
    return both.groupBy("__o__", "__id__", "__y__").agg(F.min("__t__").alias("text")).select(F.col("__y__").alias("y"), "text", F.col("__o__").alias("o"))


def fit(examples: DataFrame, bits: int, classes: int = 1, epochs: int = 2) -> np.ndarray:
    """Weights from the (y, text, o) rows of labelled(), learnt in one task in the order of o.

    Each epoch's rows are sent on their own, so that the task holds a batch of texts at a
    time, however long they are.
    """

    def learn(it):
        def seen():
            for rb in it:
                ys = rb.column(0).to_pylist()
                for lo, hi, texts in slices(rb, 1, 2_000_000):
                    f, at = features(texts, bits)
                    yield from ((f[a:z], y) for a, z, y in zip(at[:-1], at[1:], ys[lo:hi]))

        yield pa.RecordBatch.from_arrays([pa.array([train(seen(), bits, classes).tobytes()], type=pa.binary())], ["w"])

    each = examples.select("y", "text", "o", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    got = each.repartition(1).sortWithinPartitions("epoch", "o", "y", "text").mapInArrow(learn, "w binary").first()
    # No labelled row: no task, or one that has seen none.
    return np.frombuffer(got["w"], np.float32).reshape(-1, classes) if got else np.zeros(((1 << bits) + 1, classes), np.float32)


def model(docs: DataFrame, labels: DataFrame, max_train: int = 12_000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn_where: Column | None = None) -> np.ndarray:
    """Weights learnt from labelled rows (at most max_train of those where learn_where holds)."""
    if learn_where is not None:
        labels = labels.where(learn_where)
    return fit(labelled(docs, labels, F.when(F.col(label_col) > 0, 1).when(F.col(label_col) <= 0, 0), max_train, id_col, text_col), bits)


def score(spark: SparkSession, text: Column, w: np.ndarray, bits: int = 18) -> Column:
    """Probability of label 1 for a column of texts; nulls count as empty."""
    shared = spark.sparkContext.broadcast(w)

    @F.arrow_udf("double")
    def probability(t: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-margins(t.to_pylist(), shared.value, bits)[:, 0])))

    return probability(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 12_000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 2, folds: int = 4) -> DataFrame:
    """Score of each row: id_col, held_out, score, predicted.

    Rows whose crc32 of the id as text leaves remainder `held_out` by `folds` are never
    learnt from; predicted is 1 if score >= threshold.  Only the text is read for a
    score.  Null and empty texts have the bias as their one feature; labels without an id
    or a value are skipped; a label given twice is learnt once; repeated rows get
    equal scores; without any label every score is 0.5.  A null id is not held out.
    """
    fold = F.pmod(crc_of(id_col), F.lit(folds)) == held_out
    w = model(docs, labels, max_train, bits, id_col, text_col, label_col, ~fold)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def probability(texts):
        return [1 / (1 + np.exp(-margins(texts, shared.value, bits)[:, 0]))]

    out = map_texts(docs, probability, "score double", id_col, text_col)
    return out.select(id_col, F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Pipeline stage: rows with a score under the threshold go; the columns stay as they are.

    Null and empty texts have the score of the bias and mostly go; repeated rows go or stay
    together; a null id is as good as another; without any label nothing is known, and all
    rows stay.  Names of other columns don't matter.
    """
    w = model(docs, table(spark, sf_dir, "labels"), learn_where=F.pmod(crc_of("doc_id"), F.lit(4)) != 2)
    return docs.where(score(spark, F.col("text"), w) >= threshold) if w.any() else docs
