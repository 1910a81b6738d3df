"""Quality classifier: supervised embeddings of subwords.

A text is cut at ASCII white space. A word, between marks of its begin and end, has one feature for
itself and one for each run of ``GRAMS`` bytes in it; a feature is hashed to one of ``BUCKETS``
vectors. Of pairs of words only those of twice the same word are a feature, one for all of them, with
a vector of its own. A text is the average of the vectors of all its features, repeats included, and a softmax
over a linear layer gives the probability of quality 1. Vectors and layer are learned by stochastic
gradient descent in numpy, one text at a time, with a falling rate.

Training reads at most about ``TRAIN_DOCS`` whole texts of each label, chosen by hash of id and
text, from the rows outside the held-out fold, in the order of those hashes, so the model does not
depend on the order of the rows. Both labels weigh the same.

The model is linear in the average, so each bucket's vector folds into one number, and a distinct
word of a batch is scored once by look-ups in that table (``BUCKETS`` floats, broadcast).

Defined results: texts without a word (null, empty, blank) have the average zero and get the score of
the layer's intercept; without training rows of both labels every score is the share of rows with
label 1 (0.5 without rows). A null label is no label; rows of an id with several labels count under each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import crc32_mod, materialize, parts

FOLDS = 5                          # rows with crc32(doc_id) % 5 = 0 are held out
GRAMS = (2, 3, 4)                  # bytes, marks included
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 8
RATE = 0.2
TRAIN_DOCS = 3000                  # whole texts of either label
TRAIN_FEATURES = 20_000_000        # distinct features of all training texts together
THRESHOLD = 0.3
SCORE = "__fw_quality"             # column that is added to the documents' own ones
PART_BYTES = 1 << 22

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


@dataclass
class Model:
    table: np.ndarray              # of each bucket, what it adds to the odds of label 1
    intercept: float


# --- texts to features ----------------------------------------------------------------------------

def word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word of the texts, where each text's words begin)."""
    text = pc.fill_null(column, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(text)
    begin = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(begin[0], begin[-1] - begin[0])
    begin = begin - begin[0]
    real = pc.greater(pc.binary_length(flat), 0)             # the pieces around outer white space
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = flat.filter(real).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), kept[begin]


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, where each word's begin) of the features of distinct words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    off = np.frombuffer(offsets, np.int64)[words.offset:words.offset + n + 1]
    size = np.diff(off) + 2
    ends = np.cumsum(size)
    first = ends - size
    raw = np.zeros(ends[-1] + max(GRAMS), np.uint64)          # 1 and 2 are the marks
    inside = np.ones(ends[-1], bool)
    inside[first] = inside[ends - 1] = False
    raw[:ends[-1]][inside] = np.frombuffer(data, np.uint8)[off[0]:off[-1]].astype(np.uint64) + 3
    raw[first], raw[ends - 1] = 1, 2
    with np.errstate(over="ignore"):
        # The word itself, by a sum of its bytes times powers of their places.
        place = np.arange(ends[-1]) - np.repeat(first, size)
        power = np.full(int(size.max()), _MULTIPLY, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        keys = [np.add.reduceat(raw[:ends[-1]] * power[place], first) * np.uint64(2) + np.uint64(1)]
        starts = [first]
        left = np.repeat(ends, size) - np.arange(ends[-1])    # bytes from here to the word's end
        for k in GRAMS:
            at = np.flatnonzero(left >= k)
            key = np.full(len(at), k, np.uint64)
            for j in range(k):
                key = (key << np.uint64(9)) | raw[at + j]
            keys.append(key * np.uint64(2))
            starts.append(at)
        key = np.concatenate(keys)
        key ^= key >> np.uint64(31)
        key *= _MULTIPLY
        key ^= key >> np.uint64(29)
        key *= _MULTIPLY
    order = np.argsort(np.concatenate(starts), kind="stable")
    count = 1 + sum(np.maximum(size - k + 1, 0) for k in GRAMS)
    return (key[order] >> _SHIFT).astype(np.int64), np.concatenate([[0], np.cumsum(count)])


def repeats(number: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many words of each text repeat the word before them."""
    same = np.zeros(len(number) + 1, np.int64)
    same[1:len(number)] = number[1:] == number[:-1]
    same[begin[:-1]] = 0
    total = np.concatenate([[0], np.cumsum(same[:-1])])
    return total[begin[1:]] - total[begin[:-1]]


def _text_features(words, number, begin, buckets, at) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of each text."""
    for lo, hi, again in zip(begin[:-1].tolist(), begin[1:].tolist(),
                             repeats(number, begin).tolist()):
        own, times = np.unique(number[lo:hi], return_counts=True)
        size = at[own + 1] - at[own]
        end = np.cumsum(size)
        rows = np.repeat(at[own] - end + size, size) + np.arange(end[-1] if len(end) else 0)
        found, place = np.unique(buckets[rows], return_inverse=True)
        counts = np.bincount(place, weights=np.repeat(times, size), minlength=len(found))
        if again:
            found, counts = np.append(found, BUCKETS), np.append(counts, again)
        yield found, counts


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the training texts: label, order, buckets, counts."""
    for b in batches:
        for lo, hi in _parts(b.column("text")):
            some = b.slice(lo, hi - lo)
            words, number, begin = word_lists(some.column("text"))
            found = list(_text_features(words, number, begin, *features(words)))
            yield pa.RecordBatch.from_arrays(
                [some.column("quality"), some.column("h1"), some.column("h2"),
                 pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())),
                 pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))],
                names=["quality", "h1", "h2", "buckets", "counts"])


def _parts(column: pa.Array) -> list[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return parts(sizes, PART_BYTES)


# --- training -------------------------------------------------------------------------------------

def training_texts(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(quality, h1, h2, text) of about ``train_docs`` labelled rows of each label."""
    known = labels.select(F.col("doc_id").alias("__fw_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("__fw_id").isNotNull()
                        & (crc32_mod(F.col("__fw_id"), FOLDS) != 0))
    sizes = known.groupBy("quality").agg(F.count(F.lit(1)).alias("rows"))
    share = float(train_docs) / F.col("rows") * 1_000_003
    known = known.join(F.broadcast(sizes), "quality").where(          # two rows at most
        F.pmod(F.xxhash64("__fw_id"), F.lit(1_000_003)) < share).select("__fw_id", "quality")
    # About 2 x train_docs small rows, by the sampling above.
    return docs.select("doc_id", "text").join(
        F.broadcast(known), F.col("doc_id") == F.col("__fw_id")).select(
        "quality", F.xxhash64("doc_id").alias("h1"), F.xxhash64("text").alias("h2"), "text")


def descend(found: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = EPOCHS,
            rate: float = RATE, dim: int = DIM) -> Model:
    """Learn vectors and layer from (buckets, counts) and labels of texts.

    The step along a text's gradient is divided by the squared length of its shares of features, so
    its average moves by the rate however many features the text has."""
    rng = np.random.default_rng(0)
    vectors = ((rng.random((BUCKETS + 1, dim)) - 0.5) / dim).astype(np.float32)
    layer = ((rng.random((2, dim)) - 0.5) / dim).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = (len(label) / 2 / np.maximum(np.bincount(label, minlength=2), 1)).astype(np.float32)
    step, steps = 0, epochs * len(label)
    for _ in range(epochs):
        for i in rng.permutation(len(label)).tolist():
            now = rate * (1 - step / steps)
            step += 1
            buckets, counts = found[i]
            if len(buckets):
                share = counts / counts.sum()
                hidden = share @ vectors[buckets]
            else:
                hidden = np.zeros(dim, np.float32)
            odds = layer @ hidden + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[label[i]] -= 1
            p *= weight[label[i]]
            back = p @ layer
            layer -= now * np.outer(p, hidden)
            bias -= 0.1 * now * p
            if len(buckets):
                vectors[buckets] -= np.outer(share * (now / (share @ share)), back)
    turn = (layer[1] - layer[0]).astype(np.float64)
    return Model((vectors @ turn).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the model. The driver gets the features of the sampled texts: eight bytes for each distinct
    one, at most ``TRAIN_FEATURES`` of them."""
    rows = training_texts(docs, labels).mapInArrow(
        _feature_rows, "quality int, h1 long, h2 long, buckets array<int>, counts array<float>")
    rows = materialize(rows, "quality")
    order = ["h1", "h2", "quality"]
    sizes = rows.select(*order, F.size("buckets").alias("n")).orderBy(*order).toArrow()
    label = sizes.column("quality").to_numpy().astype(np.int64)
    if len(set(label.tolist())) < 2:
        share = min(max(float(label.mean()), 1e-9), 1 - 1e-9) if len(label) else 0.5
        return Model(np.zeros(BUCKETS + 1, np.float32), float(np.log(share / (1 - share))))
    share = min(1.0, TRAIN_FEATURES / max(int(sizes.column("n").to_numpy().sum()), 1))
    if share < 1.0:                # fewer texts, again by hash, where they are very long
        rows = rows.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(1_000_003)) < share * 1_000_003)
    got = rows.orderBy(*order).toArrow()
    label = got.column("quality").to_numpy().astype(np.int64)
    found = []
    for a, c in zip(got.column("buckets").chunks, got.column("counts").chunks):
        at = a.offsets.to_numpy()
        x, y = a.values.to_numpy(), c.values.to_numpy()
        found += [(x[lo:hi], y[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
    return descend(found, label)


# --- scoring --------------------------------------------------------------------------------------

def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of quality 1 of each text."""
    words, number, begin = word_lists(column)
    buckets, at = features(words)
    out = np.full(len(column), model.intercept)
    if len(number):
        value = np.add.reduceat(model.table[buckets].astype(np.float64), at[:-1])
        size = np.diff(at)
        full, again = np.flatnonzero(np.diff(begin)), repeats(number, begin)
        again = again[full]
        out[full] += ((np.add.reduceat(value[number], begin[full])
                       + again * float(model.table[BUCKETS]))
                      / (np.add.reduceat(size[number], begin[full]) + again))
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text",
                out_col: str = SCORE) -> DataFrame:
    """``docs`` plus the score of every whole text."""
    schema = docs.withColumn(out_col, F.lit(0.0)).schema
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _parts(b.column(text_col)):
                rows = b.slice(lo, hi - lo)
                new = pa.array(score_texts(shared.value, rows.column(text_col)))
                yield pa.RecordBatch.from_arrays(
                    [new if n == out_col else rows.column(n) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
