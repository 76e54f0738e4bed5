"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from rulelens.llm.texts import PRIME, arrow_list, mix, slices
from rulelens.plans.joins import semi_by_key
from rulelens.plans.storage import materialize

# Labelled documents that the model is fitted on, picked by a hash of the id (about so many, all if fewer).
TRAIN_ROWS = 12_000
DIMENSIONS = 1 << 18
SHARDS = 8
EPOCHS = 4
RATE, STEADY, L1, L2 = 0.5, 1.0, 0.0005, 0.001
SCALE = 4.0
TOKEN = re.compile(r"\w+|[^\w\s]+")
SAME = np.uint64(0xA5A5A5A5A5A5A5A5)
BIAS = 0  # index that every document has


def features(texts):
    """Hashed word 1-grams and 2-grams of texts: `(row, index)` and how many each row has.

    Words are runs of word characters or of marks; a word equal to the one before counts as a word of its own kind, so that
    repetition is seen whatever is repeated.
    """
    found = [TOKEN.findall(text) if text else [] for text in texts]
    counts = np.array([len(f) for f in found])
    row = np.repeat(np.arange(len(texts)), counts)
    coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()] if len(row) else np.zeros(0, np.uint64)
    pair = row[1:] == row[:-1]
    again = np.zeros(len(h), bool)
    again[1:] = pair & (h[1:] == h[:-1])
    h = np.where(again, SAME, h)
    two = mix(h[:-1] * PRIME + h[1:])[pair]
    rows = np.concatenate([row, row[:-1][pair] if len(row) else row])
    index = np.concatenate([mix(h), two]) % np.uint64(DIMENSIONS - 1) + np.uint64(1)
    order = np.argsort(rows, kind="stable")
    return rows[order], index[order].astype(np.int64), np.bincount(rows, minlength=len(texts))


def _feature_rows(batches):
    for batch in batches:
        for at, n in slices(batch, "text"):
            part = batch.slice(at, n)
            _, index, counts = features(part["text"].to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [part[c] for c in ("shard", "place", "label")] + [arrow_list(index.astype(np.int32), offsets)],
                names=["shard", "place", "label", "index"],
            )


def _weights(z, n):
    """Weights of the regularised leader; the bias is not regularised."""
    l1 = np.full(len(z), L1)
    l1[BIAS] = 0
    return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((STEADY + np.sqrt(n)) / RATE + L2))


def _sparse(index):
    """Distinct indices of a document with their values: shares of its n-grams, and the bias."""
    at, count = np.unique(index, return_counts=True)
    return np.append(at, BIAS), np.append(count * (SCALE / np.sqrt(max(1, len(index)))), 1.0).clip(max=8 * SCALE)


class Learner:
    """The state of the regularised leader: sums of gradients and of their squares."""

    def __init__(self, z, n):
        self.z, self.n = z.copy(), n.copy()

    def learn(self, index, label):
        at, x = _sparse(index)
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == BIAS, 0, L1)
        w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((STEADY + np.sqrt(n)) / RATE + L2))
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
        self.n[at] += g * g


def _train(z, n):
    """One pass over rows sorted by shard and place: how each shard's learner moves the state."""

    def moved(learner):
        at = np.flatnonzero((learner.n != n) | (learner.z != z))
        return pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(learner.z[at] - z[at]), pa.array(learner.n[at] - n[at])],
            names=["index", "z", "n"],
        )

    def convert(batches):
        learner, shard = None, None
        for batch in batches:
            flat, sizes = batch["index"].flatten().to_numpy(), batch["index"].value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            for own, label, a, b in zip(batch["shard"].to_pylist(), batch["label"].to_pylist(), ends - sizes, ends):
                if own != shard:
                    if learner is not None:
                        yield moved(learner)
                    learner, shard = Learner(z, n), own
                learner.learn(flat[a:b], label)
        if learner is not None:
            yield moved(learner)

    return convert


def fit(docs, labels, id_col="doc_id", text_col="text", train_rows=TRAIN_ROWS):
    """Weights fitted on about `train_rows` of the documents that `labels` (id, label 0 or 1) names.

    Every shard of the sample has a learner of its own; after each pass their moves are averaged. An id with several labels
    takes the smallest. The state that meets in the driver is bounded by the number of dimensions.
    """
    labels = labels.filter("label is not null").groupBy(id_col).agg(F.min("label").alias("label"))
    labels = materialize(labels, "labels")
    share = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).cast("double") * labels.count() < float(train_rows) * (1 << 30)
    chosen = materialize(labels.filter(share), "chosen")
    # The sample's size is bounded by its parameter, so its ids may be broadcast; with a larger one they are shuffled.
    rows = semi_by_key(docs.select(id_col, F.col(text_col).alias("text")), chosen, [id_col], "inner")
    place = F.xxhash64(id_col, "text")
    rows = rows.select(F.pmod(place, F.lit(SHARDS)).cast("int").alias("shard"), place.alias("place"), F.col("label").cast("int").alias("label"), "text")
    rows = rows.mapInArrow(_feature_rows, "shard int, place bigint, label int, index array<int>")
    rows = materialize(rows.repartition("shard").sortWithinPartitions("shard", "place"), "features")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place")
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for _ in range(EPOCHS):
        moves = rows.mapInArrow(_train(z, n), "index int, z double, n double")
        total = moves.groupBy("index").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        at = total["index"].to_numpy()
        z[at] += total["z"].to_numpy() / SHARDS
        n[at] += total["n"].to_numpy() / SHARDS
    return _weights(z, n)


def score(docs, weights, id_col="doc_id", text_col="text"):
    """`(id, score)`: probability of label 1. A null or empty text has the score of the bias alone.

    Rows map one to one, repeated ones and null ids included; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def convert(batches):
        w = model.value
        for batch in batches:
            for at, size in slices(batch, "text"):
                row, index, counts = features(batch["text"].slice(at, size).to_pylist())
                value = _dots(row, index, counts, w)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(at, size), pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))))], names=["id", "score"]
                )

    kind = rows.dtypes[0][1]
    return rows.mapInArrow(convert, f"id {kind}, score double").withColumnRenamed("id", id_col)


def _dots(row, index, counts, w):
    """Sparse dot products of all rows with the weights; a value is at most as large as in training."""
    key = row * DIMENSIONS + index
    at, count = np.unique(key, return_counts=True) if len(key) else (key, key)
    own = at // DIMENSIONS
    x = (count * (SCALE / np.sqrt(np.maximum(1, counts[own])))).clip(max=8 * SCALE)
    return w[BIAS] + np.bincount(own, x * w[at % DIMENSIONS], minlength=len(counts))
