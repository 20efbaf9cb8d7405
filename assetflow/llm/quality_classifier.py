"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Text, chunks, mix, wider

#: Buckets of the hashed features, and the labelled documents that a model is fitted on at most.
BUCKETS = 1 << 18
MOST_EXAMPLES = 12_000
EPOCHS = 3

_KIND = np.zeros(256, np.int64)  # 0 other (letters beyond ASCII among them), 1 upper, 2 lower, 3 digit, 4 sign
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4


def _shapes(text: Text) -> np.ndarray:
    """What a word looks like: its cases, digits, signs, its last sign, and whether it repeats the word before."""
    kind = _KIND[text.data]
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kind == k)])[np.stack([text.starts, text.ends])], axis=0)[0]
    word = text.word_hashes()
    repeats = np.concatenate([[False], (word[1:] == word[:-1]) & (text.doc[1:] == text.doc[:-1])])[: len(word)]
    last = text.data[text.ends - 1]
    parts = [np.minimum(count(1), 2), np.minimum(count(2), 1), np.minimum(count(3), 1), np.minimum(count(4), 3), np.where(_KIND[last] == 4, last, 0), kind[text.starts] == 1, repeats]
    key = np.zeros(len(word), np.uint64)
    for part in parts:
        key = key * np.uint64(257) + part.astype(np.uint64) + np.uint64(1)
    return mix(key)


def features(text: Text, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word n-gram of the documents (words singly and in pairs, their shapes in runs of one to three), and n + 1 offsets."""
    word, shape = text.word_hashes(), _shapes(text)
    where, keys = [], []
    for salt, (hashes, size) in enumerate([(word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)]):
        at, key = text.windows(hashes, size)
        where.append(text.doc[at])
        keys.append(mix(key + np.uint64(salt)) % np.uint64(buckets))
    doc, key = np.concatenate(where), np.concatenate(keys).astype(np.int32)
    order = np.argsort(doc, kind="stable")
    return key[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=text.n))])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, text: Text) -> np.ndarray:
        keys, offsets = features(text, len(self.weights))
        sums = np.diff(np.concatenate([[0.0], np.cumsum(self.weights[keys], dtype=np.float64)])[offsets])
        return 1 / (1 + np.exp(-np.clip(self.bias + sums / np.sqrt(np.maximum(1, np.diff(offsets))), -40, 40)))


def _fit(examples: list[tuple[int, np.ndarray]], buckets: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """FTRL-proximal with a rate per coordinate; the last coordinate is the bias."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, keys in examples:
            at, times = np.unique(np.append(keys, buckets), return_counts=True)
            x = times / np.sqrt(max(1, len(keys)))
            x[-1] = 1.0
            w = weights(at)
            slope = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - label) * x
            rate = (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / alpha
            z[at] += slope - rate * w
            n[at] += slope**2
    w = weights(np.arange(buckets + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = BUCKETS, most_examples: int = MOST_EXAMPLES, epochs: int = EPOCHS) -> Model:
    """Fits a model on at most most_examples labelled documents (those whose hashed doc_id is smallest), whole texts.

    labels: doc_id and the label (0 or 1); other values and nulls don't count.  Only text is an
    input.  Features are made where the documents lie; one task takes the bounded sample in a fixed
    order, so reruns give the same model, and the driver gets the weights alone.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_examples)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in chunks(batch):
                keys, offsets = features(text, buckets)
                packed = pa.array([keys[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), packed], names=["doc_id", "label", "keys"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            examples += zip(batch.column("label").to_pylist(), [np.frombuffer(k, np.int32) for k in batch.column("keys").to_pylist()], strict=True)
        weights, bias = _fit(examples, buckets, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    made = texts.mapInArrow(extract, "doc_id bigint, label int, keys binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id", "keys")
    row = made.mapInArrow(fit, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(row["weights"]), np.float32), row["bias"]) if row else Model(np.zeros(buckets, np.float32), 0.0)


def score(documents: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """The documents with a column output: probability that the text is of label 1.

    Null and empty texts get the model's score of no words at all.  Each row is scored alone from
    its whole text, and every other column is kept; a column already named output is replaced.
    No shuffle; the model (buckets x 4 bytes) goes to the tasks.
    """
    kept = documents.drop(output)
    schema = wider(kept, **{output: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.scores(words))], names=[*rows.schema.names, output])

    return kept.mapInArrow(run, schema)
