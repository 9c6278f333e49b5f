"""Toxicity by a character n-gram linear classifier with naive Bayes features.

The features of a text are the character n-grams of its words, hashed to a
fixed number of buckets, with ``log(1 + count)`` as value.  Each is scaled by
the log ratio of its share in toxic and in clean training texts, the vector is
brought to length one, and a logistic regression is fitted over it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sheaf.llm.common import ODD, doc_crc, texts_of

BUCKETS, SHORTEST, LONGEST = 1 << 18, 3, 5
#: Labelled rows to learn from, at most, of each label: those with the smallest hash of their id.
SAMPLE = {1: 2500, 0: 5000}
EPOCHS, RATE, DECAY = 12, 0.5, 1e-7
#: Code points whose n-grams are held at once.
STRETCH = 1 << 17
THRESHOLD = 0.7


def _buckets(chars: np.ndarray) -> np.ndarray:
    """Bucket of each n-gram of a stretch of code points, words parted by single blanks that belong to them."""
    blank, out = chars == 32, []
    for n in range(SHORTEST, LONGEST + 1):
        size = len(chars) - n + 1
        if size <= 0:
            break
        inside, h = np.ones(size, bool), np.full(size, n, np.uint64)
        for k in range(n):
            h = (h ^ chars[k : k + size]) * ODD
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                inside &= ~blank[k : k + size]
        out.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their values; none for a text without words."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(chars) <= STRETCH:
        grams = np.sort(_buckets(chars))
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        return grams[first], np.log1p(np.diff(first, append=len(grams)))
    # a long text is counted stretch by stretch; n-grams over a seam are counted with the later one
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(chars), STRETCH):
        counts += np.bincount(_buckets(chars[max(0, at - LONGEST + 1) : at + STRETCH]), minlength=BUCKETS)
        if at:
            counts -= np.bincount(_buckets(chars[at - LONGEST + 1 : at]), minlength=BUCKETS)
    which = np.flatnonzero(counts)
    return which, np.log1p(counts[which])


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def scaled(self, which: np.ndarray, values: np.ndarray) -> np.ndarray:
        x = values * self.ratio[which]
        return x / np.sqrt(x @ x + 1e-9)

    def score(self, which: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weight[which] @ self.scaled(which, values) + self.bias))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Logistic regression by stochastic gradient steps; 0.5 for all without rows."""
    share = np.ones((2, BUCKETS))
    for (which, values), y in zip(rows, labels):
        share[int(y), which] += values
    share /= share.sum(axis=1, keepdims=True)
    model = Model(np.log(share[1]) - np.log(share[0]), np.zeros(BUCKETS), 0.0)
    scaled = [(which, model.scaled(which, values)) for which, values in rows]
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    order, rng = np.arange(len(rows)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            which, x = scaled[i]
            off = 1 / (1 + np.exp(-(model.weight[which] @ x + model.bias))) - labels[i]
            step = off * x + DECAY * model.weight[which]
            seen[which] += step * step
            seen_bias += off * off
            model.weight[which] -= RATE * step / np.sqrt(seen[which])
            model.bias -= RATE * off / np.sqrt(seen_bias)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str, text_col: str, label_id: str, label: str) -> DataFrame:
    """The bounded sample: id, label (1 if any row of the id says so), text."""
    known = labels.select(F.col(label_id).alias("__id"), F.col(label).cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)")
    known = known.withColumn("__train", trains).filter("__train").groupBy("__id").agg(F.max("__label").alias("__label"))
    picked = None
    for value, n in SAMPLE.items():
        own = known.filter(F.col("__label") == value).orderBy(F.xxhash64("__id"), "__id").limit(n)
        picked = own if picked is None else picked.unionByName(own)
    # at most sum(SAMPLE) rows go to every task
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    sample = texts.join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    # one row an id, the least text of several
    return sample.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))


def train(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic") -> Model:
    """Fits the model in one task on the bounded sample; ``trains`` is a condition on ``__id``.

    Repeated labels of an id count as one, toxic if any is; of several rows with
    one id the least text counts; null labels and ids are left out.  Without labels every score is 0.5.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["__id"], r["__text"] or "", r["__label"]) for b in batches for r in b.to_pylist())
        model = fit([features(text) for _, text, _ in rows], np.array([y for _, _, y in rows], float))
        yield pa.RecordBatch.from_pydict(
            {"ratio": [model.ratio.tobytes()], "weight": [model.weight.tobytes()], "bias": [model.bias]},
            pa.schema([("ratio", pa.binary()), ("weight", pa.binary()), ("bias", pa.float64())]),
        )

    sample = training_rows(docs, labels, trains, id_col, text_col, label_id, label)
    got = sample.coalesce(1).mapInArrow(learn, "ratio binary, weight binary, bias double").first()
    return Model(np.frombuffer(got["ratio"]), np.frombuffer(got["weight"]), got["bias"]) if got else Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0)


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic; that of a text without features for null and empty ones."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(*features(t)) for t in texts_of(batch)], pa.float64())

    return arrow_udf(run, "double")(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 3 is 1, never learnt from), score, predicted.

    Only texts are scored, so ids, ties and other columns do not matter; an
    empty table gives no rows.
    """
    model = train(docs, labels, F.pmod(doc_crc("__id"), F.lit(3)) != 1, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return scored.select(
        "doc_id", (F.pmod(doc_crc("doc_id"), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
