"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else the learner sees is unlabelled web text. A small network ``g``
minimises the non-negative unbiased risk ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])`` with the sigmoid
loss; where a minibatch's second part falls below zero, its gradient is taken back, which keeps the learner from fitting
the unlabelled sample. The class prior is estimated as the share of ones among the labels that may be learned from, and
that is all that labels 0 are used for; labels of other documents are not used.

The fit uses at most ``POSITIVES`` labelled and ``UNLABELLED`` unlabelled documents, those first by a hash of doc_id, and
is made on the driver from some tens of numbers for each; of rows that repeat a doc_id one is taken. Every document is scored, from its whole text, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import rows_of, short_batches, table, text_or_empty

#: Bounds of the fitting sample.
POSITIVES, UNLABELLED = 20_000, 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 40, 512, 0.01, 1e-4, 7

_ASCII = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _groups() -> np.ndarray:
    """For each byte, the number of the share that it counts to."""
    to = np.full(256, 5, np.int64)  # controls
    to[[9, 10, 11, 12, 13, 32]] = 0
    to[ord("a") : ord("z") + 1], to[ord("A") : ord("Z") + 1], to[ord("0") : ord("9") + 1] = 1, 2, 3
    to[128:] = 4
    for k, c in enumerate(_ASCII):
        to[ord(c)] = 6 + k
    return to


_TO, SHARES = _groups(), 6 + len(_ASCII)
FEATURES = SHARES + 7


def features(text: str) -> np.ndarray:
    """Numbers that describe a whole text's form, whatever its language; all zero for an empty text."""
    out = np.zeros(FEATURES, np.float32)
    data = text.encode()
    if not data:
        return out
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:SHARES] = np.sqrt(np.bincount(_TO, weights=byte, minlength=SHARES) / len(data))
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    letters = byte[65:91].sum() + byte[97:123].sum()
    out[SHARES:] = (
        np.log1p(len(words)) / 10,
        len(data) / n / 20,
        len(set(words)) / n,
        len(set(words)) / n**0.8 / 2,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        byte[65:91].sum() / max(letters, 1),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, (x - self.mean) / self.scale)[1], -40, 40)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = layers
    hidden = np.tanh(x @ w + b)
    return hidden, hidden @ v + c[0]


def risk(layers: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the unbiased risk with the sigmoid loss, l(g) = 1 - s(g) and l(-g) = s(g): what positives cost, and what
    negatives cost by the unlabelled rows less the positives among them. The second may be negative by chance."""
    sp, su = (1 / (1 + np.exp(-np.clip(_forward(layers, x)[1], -40, 40))) for x in (xp, xu))
    return prior * float((1 - sp).mean()), float(su.mean()) - prior * float(sp.mean())


def descent(layers: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float) -> list[np.ndarray]:
    """The gradient of the risk's sum, or, where the second part is below zero, that of the second part backwards."""
    (hp, gp), (hu, gu) = _forward(layers, xp), _forward(layers, xu)
    sp, su = 1 / (1 + np.exp(-np.clip(gp, -40, 40))), 1 / (1 + np.exp(-np.clip(gu, -40, 40)))
    slope_p, slope_u = sp * (1 - sp) / len(xp), su * (1 - su) / len(xu)
    if su.mean() - prior * sp.mean() >= 0:
        dp, du = -2 * prior * slope_p, slope_u
    else:
        dp, du = prior * slope_p, -slope_u
    out = [np.zeros_like(x, dtype=np.float64) for x in layers]
    for x, h, d in ((xp, hp, dp), (xu, hu, du)):
        back = np.outer(d, layers[2]) * (1 - h * h)
        for at, g in enumerate((x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()]))):
            out[at] += g
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk by Adam. Without positives or unlabelled rows every score is the prior."""
    rng = np.random.default_rng(SEED)
    if not len(positive) or not len(unlabelled):
        odds = np.log(prior / (1 - prior))
        return Model(np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([odds])])
    every = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    layers = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    rounds = max(1, max(len(p), len(u)) // BATCH)
    for _ in range(EPOCHS):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(rounds):
            xp = p[np.take(order_p, range(k * BATCH, (k + 1) * BATCH), mode="wrap")]
            xu = u[np.take(order_u, range(k * BATCH, (k + 1) * BATCH), mode="wrap")]
            gradient = [DECAY * layers[0], np.zeros(HIDDEN), DECAY * layers[2], np.zeros(1)]
            gradient = [a + b for a, b in zip(gradient, descent(layers, xp, xu, prior), strict=True)]
            step += 1
            for at, g in enumerate(gradient):
                first[at] = 0.9 * first[at] + 0.1 * g
                second[at] = 0.999 * second[at] + 0.001 * g * g
                layers[at] = layers[at] - RATE * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, layers)


def may_learn(doc_id: str = "doc_id"):
    """Rows whose labels may be learned from; the others are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on documents of ``docs`` (doc_id, text); ``labels`` has (doc_id, quality). Null labels and ids are left out."""
    short_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & may_learn()).select("doc_id", (F.col("quality") == 1).alias("good"))
    ones, of = known.agg(F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)), F.count("*")).first()
    prior = min(0.98, max(0.02, (ones + 1) / (of + 2)))
    first = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(known.where("good"), positives).withColumn("p", F.lit(1)).unionByName(first(docs.where("doc_id is not null"), unlabelled).withColumn("p", F.lit(0)))
    # Bounded by the two parameters, so that it can be broadcast at any size of the corpus.
    sample = sample.groupBy("doc_id").agg(F.max("p").alias("positive"), F.min("p").alias("labelled_only"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, texts, p, only in rows_of(batches, "k", "t", "positive", "labelled_only"):
            rows = [features(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary()), pa.array(p, pa.int32()), pa.array(only, pa.int32())], ["k", "x", "positive", "labelled_only"])

    chosen = docs.select("doc_id", text_or_empty().alias("t")).join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("k"), "t", "positive", "labelled_only")
    each = chosen.mapInArrow(run, "k long, x binary, positive int, labelled_only int")
    got = each.groupBy("k", "positive", "labelled_only").agg(F.min("x").alias("x")).toArrow()  # a row for each id of the sample
    if not got.num_rows:
        return fit(np.zeros((0, FEATURES)), np.zeros((0, FEATURES)), prior)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    positive, only = got["positive"].to_numpy() == 1, got["labelled_only"].to_numpy() == 1
    return fit(_ordered(x[positive]), _ordered(x[~only]), prior)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Rows in an order of their own, so that the fit does not depend on how Spark delivers them."""
    return x[np.lexsort(x.T[::-1])]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document. Null texts count as empty; repeated rows stay."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for keys, texts in rows_of(batches, "k", "t"):
            s = model.scores(np.stack([features(t) for t in texts])) if keys else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("k"), text_or_empty().alias("t")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns; one pass, nothing is exchanged."""
    short_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                keep = model.scores(np.stack([features(t or "") for t in batch.column(at).to_pylist()])) >= least
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (~F.coalesce(may_learn(), F.lit(True))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
