"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel, with Nystroem
landmarks.

A text is cut at white space; of a piece only its letters count (``i.d-i*o t`` loses its marks) and
runs of single letters are joined. Windows of ``WIDTH`` symbols slide over ``^`` + letters. Two
windows are alike by their common subsequences of ``ORDER`` symbols, each weighted by ``DECAY`` to
the power of the stretch it covers, so a gap or an inserted character lowers the likeness and does
not destroy it. The machine learns on windows mapped to their kernel values with landmark windows.
Its decision function is linear in the subsequences, so the landmarks fold into one table of
subsequence weights that scores a window by look-ups. A text scores as its worst window; a logistic
curve fitted on the training texts turns that into a probability.

Labels are of texts, not of windows. The first toxic windows are those that tell the classes apart
and together cover the toxic texts, also with a symbol inserted; then, round by round, the worst
windows of the toxic texts join them, and the worst windows of the clean texts are added as
counter-examples.

Training reads at most about ``TRAIN_DOCS`` whole texts of the two labels, chosen by hash of the id,
from the rows outside the held-out fold. Windows are counted, weighed and scored in Spark; the driver
gets the windows that tell the classes apart, up to three more of each toxic text and round, at most
``MAX_POSITIVES`` further ones, ``MAX_NEGATIVES`` clean ones a round, and eight numbers for each text.
Texts are taken in the order of the hashes of their id and text, windows of equal worth in the order
of their numbers, and of near copies the first in that order counts: the order of the rows has no
influence.

Defined results: null, empty and blank texts score 0; texts without a letter get the curve's value
for no window; without training rows of both labels every score is the share of toxic rows (0 if none).
A null label is no label; rows of an id with several labels count under each of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import crc32_mod, materialize, text_slices, texts

WIDTH = 7
ORDER = 3
DECAY = 0.5
LANDMARKS = 800
TRAIN_DOCS = (8000, 2500)         # whole texts of label 0 and label 1
ROUNDS = 2
THRESHOLD = 0.3
SCORE = "__fw_toxicity"          # column that is added to the documents' own ones
SYMBOLS = 64                     # 0: none, 1: start, 2-27: a-z, the rest: other letters by hash
ODDS = 6.0                       # how much likelier a toxic window is in toxic texts
SUPPORT = 0.005                  # share of the toxic texts that a toxic window must occur in
MAX_POSITIVES = 1500
MAX_NEGATIVES = 3000
TOP = (1, 2, 3, 5, 8)            # which of a text's worst windows its score looks at
LEVELS = (0.25, 0.5, 0.75, 1.0)  # decision values above which a text's windows are counted
FEATURES = len(TOP) + len(LEVELS) + 1
FLOOR = -1.5                     # decision value that stands for "none"
PART_CHARS = 1 << 20
ORDERED = ["h1", "h2", "toxic"]

_MARKS = re.compile(r"[\W\d_]+")
_SINGLES = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]?\s+){2,}[^\W\d_][^\w\s]?(?!\S)")
_TRIPLES = np.array(list(combinations(range(WIDTH), ORDER)))
_WEIGHTS = DECAY ** (_TRIPLES[:, -1] - _TRIPLES[:, 0] + 1.0)


@dataclass
class Model:
    weights: np.ndarray          # of the subsequences
    intercept: float
    curve: np.ndarray            # coefficients of the logistic curve over a text's ranks


# --- texts to windows ---------------------------------------------------------------------------

def pieces(text: str) -> Counter[str]:
    """The pieces of a text and how often they occur, runs of single letters joined."""
    text = text.lower()
    found = Counter(text.split())
    if sum(len(_MARKS.sub("", p)) == 1 for p in found if len(p) <= 2) > 1:
        found.update("".join(run.split()) for run in _SINGLES.findall(text))
    return found


def _symbols(chars: str) -> np.ndarray:
    code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = 28 + code % (SYMBOLS - 28)
    small = (code >= 97) & (code <= 122)
    out[small] = code[small] - 95
    out[code == 94] = 1          # the start mark; a letter never has this code
    return out


def windows(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (as numbers) of the letters of all pieces, and where each piece's windows begin."""
    words = ["^" + _MARKS.sub("", p) for p in found]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.concatenate([_symbols("".join(words)), np.zeros(WIDTH, np.int64)])
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length)
    count = np.maximum(length - WIDTH + 1, 1)
    first = np.cumsum(count) - count
    at = np.repeat(end - length - first, count) + np.arange(count.sum())
    stop = np.repeat(end, count)
    code = np.zeros(len(at), np.int64)
    for k in range(WIDTH):
        code = code * SYMBOLS + np.where(at + k < stop, flat[at + k], 0)
    return code, first


def _unpack(code: np.ndarray) -> np.ndarray:
    return np.stack([code >> (6 * (WIDTH - 1 - k)) & 63 for k in range(WIDTH)], axis=1)


def subsequences(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of each window (as numbers), their weights, and the window's kernel norm."""
    sym = _unpack(code)
    ids = np.zeros((len(code), len(_TRIPLES)), np.int32)
    for k in range(ORDER):
        ids = ids * SYMBOLS + sym[:, _TRIPLES[:, k]].astype(np.int32)
    # Symbol 0 only stands at the end, so a subsequence is whole if its last symbol is.
    weights = np.where(sym[:, _TRIPLES[:, -1]] > 0, _WEIGHTS, 0.0).astype(np.float32)
    return ids, weights, np.sqrt(np.maximum(_self_kernel(sym), 1e-12))


def _self_kernel(sym: np.ndarray) -> np.ndarray:
    """Kernel of each window with itself, by dynamic programming over pairs of places.

    ends[i, j] sums the pairs of equal subsequences of p symbols that end at places i and j; sums
    carries them on, decayed by one for each place passed. Both are symmetric in i and j."""
    x = np.ascontiguousarray(sym.T)
    square = np.float32(DECAY * DECAY)
    same = {(i, j): ((x[i] == x[j]) & (x[i] > 0)).astype(np.float32) * square
            for j in range(WIDTH) for i in range(j + 1)}
    ends = same
    for p in range(2, ORDER + 1):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for j in range(p - 2, WIDTH):
            for i in range(p - 2, j + 1):
                total = ends[i, j]
                if i > p - 2:
                    total = total + np.float32(DECAY) * sums[i - 1, j]
                if j > p - 2:
                    total = total + np.float32(DECAY) * sums[min(i, j - 1), max(i, j - 1)]
                if i > p - 2:
                    total = total - square * sums[i - 1, j - 1]
                sums[i, j] = total
        ends = {(i, j): same[i, j] * sums[i - 1, j - 1]
                for j in range(p - 1, WIDTH) for i in range(p - 1, j + 1)}
    return sum(v if i == j else 2 * v for (i, j), v in ends.items())


def decide(model: Model, code: np.ndarray) -> np.ndarray:
    """The machine's decision value of every window."""
    out = np.empty(len(code))
    for at in range(0, len(code), 1 << 15):
        ids, w, norm = subsequences(code[at:at + (1 << 15)])
        out[at:at + (1 << 15)] = (model.weights[ids] * w).sum(1) / norm
    return out + model.intercept


# --- training -----------------------------------------------------------------------------------

def _kernel(code: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalized kernel values of windows with landmarks."""
    ids, w, norm = subsequences(landmarks)
    known = np.unique(ids)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    rows = np.searchsorted(known, ids)
    for j in range(len(landmarks)):
        np.add.at(table[:, j], rows[j], w[j] / norm[j])
    out = np.empty((len(code), len(landmarks)), np.float32)
    for at in range(0, len(code), 4096):
        ids, w, norm = subsequences(code[at:at + 4096])
        rows = np.searchsorted(known, ids)
        rows[rows == len(known)] = len(known) - 1
        rows = np.where(known[rows] == ids, rows, len(known))
        part = np.zeros((len(ids), len(landmarks)), np.float32)
        for k in range(ids.shape[1]):
            part += table[rows[:, k]] * w[:, k, None]
        out[at:at + 4096] = part / norm[:, None]
    return out


def _svm(z: np.ndarray, y: np.ndarray, cost: float = 100.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, balanced classes, by Newton's method."""
    x = np.concatenate([z, np.ones((len(z), 1), z.dtype)], axis=1).astype(np.float64)
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * cost * 100
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(30):
        margin = 1 - y * (x @ w)
        on = margin > 0
        grad = ridge * w - 2 * (x[on].T @ (c[on] * y[on] * margin[on]))
        hess = np.diag(ridge) + 2 * (x[on].T * c[on]) @ x[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit(positive: np.ndarray, negative: np.ndarray, gapped: np.ndarray,
        landmarks: int = LANDMARKS) -> Model:
    """Machine on toxic windows (as found and ``gapped``) and clean windows; half of the landmarks
    are toxic, half clean."""
    half = landmarks // 2
    marks = np.unique(np.concatenate([positive[:half], negative[:half]]))
    gram = _kernel(marks, marks).astype(np.float64)
    value, vector = np.linalg.eigh(gram)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    gapped = gapped[~np.isin(gapped, np.concatenate([positive, negative]))]
    code = np.concatenate([positive, gapped, negative])
    y = np.concatenate([np.ones(len(positive) + len(gapped)), -np.ones(len(negative))])
    w, b = _svm(_kernel(code, marks) @ root.astype(np.float32), y)
    ids, weight, norm = subsequences(marks)
    table = np.zeros(SYMBOLS ** ORDER)
    np.add.at(table, ids, weight * ((root @ w) / norm)[:, None])
    return Model(table.astype(np.float32), b, np.zeros(FEATURES + 1))


def _ranks(values: np.ndarray, repeats: np.ndarray, above: np.ndarray, total: float) -> np.ndarray:
    """What the logistic curve sees of a text: its TOP worst decision values (a window that occurs
    again counts again), how many windows lie above each of LEVELS, and how many there are."""
    out = np.full(FEATURES, FLOOR)
    most = max(TOP)
    if len(values):
        best = np.argsort(-values, kind="stable")[:most]
        worst = np.repeat(values[best], np.minimum(repeats[best], most))[:most]
        for i, k in enumerate(TOP):
            if k <= len(worst):
                out[i] = max(worst[k - 1], FLOOR)
    out[len(TOP):-1] = np.log1p(above)
    out[-1] = np.log1p(total)
    return out


def _logistic(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Coefficients (intercept last) of Platt's curve over the ranks; targets are drawn in from 0
    and 1."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 0.05 * w
        hess = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _gapped(code: np.ndarray) -> np.ndarray:
    """Windows with one foreign symbol inserted at an inner place: what the kernel is to tolerate."""
    sym = _unpack(code)
    out = []
    for k in range(2, WIDTH):
        inside = sym[:, k] > 0
        some = sym[inside]
        new = np.concatenate([some[:, :k], np.full((len(some), 1), 2 + 23), some[:, k:-1]], axis=1)
        out.append(sum(new[:, i] << (6 * (WIDTH - 1 - i)) for i in range(WIDTH)))
    return np.unique(np.concatenate(out)) if out else code


def _doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the training texts: label, minimum hashes, windows, their numbers of occurrences."""
    kind = pa.list_(pa.int64())
    for b in batches:
        for at, run in text_slices(b.column("text"), PART_CHARS):
            codes, repeats, marks = [], [], []
            for t in run:
                found = pieces(t)
                code, first = windows(list(found))
                times = np.repeat(np.fromiter(found.values(), np.int64, len(found)),
                                  np.diff(np.append(first, len(code))))
                distinct, place = np.unique(code, return_inverse=True)
                codes.append(distinct)
                repeats.append(np.bincount(place, weights=times, minlength=len(distinct)))
                marks.append(_marks(distinct))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(at, len(run)) for c in ("h1", "h2", "toxic")),
                 *(pa.array([x.astype(np.int64) for x in some], kind)
                   for some in (marks, codes, repeats))],
                names=["h1", "h2", "toxic", "marks", "windows", "counts"])


def training_texts(docs: DataFrame, labels: DataFrame, train_docs: tuple[int, int] = TRAIN_DOCS) -> DataFrame:
    """(h1, h2, toxic, text) of a bounded sample of the labelled rows outside the held-out fold; h1
    and h2 are hashes of id and text."""
    known = labels.select(F.col("doc_id").alias("__fw_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("__fw_id").isNotNull()
                        & (crc32_mod(F.col("__fw_id"), 4) != 2))
    sizes = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"))
    most = F.when(F.col("toxic") == 1, float(train_docs[1])).otherwise(float(train_docs[0]))
    share = most / F.col("rows") * 1_000_003
    known = known.join(F.broadcast(sizes), "toxic").where(
        F.pmod(F.xxhash64("__fw_id"), F.lit(1_000_003)) < share).select("__fw_id", "toxic")
    # About sum(train_docs) small rows, by the sampling above.
    return docs.select("doc_id", "text").join(
        F.broadcast(known), F.col("doc_id") == F.col("__fw_id")).select(
        F.xxhash64("doc_id").alias("h1"), F.xxhash64("text").alias("h2"), "toxic", "text")


def _cover(bags: list[np.ndarray], code: np.ndarray, gain: np.ndarray, times: int = 3):
    """Windows, the most telling first, until every toxic text has ``times`` of them."""
    place = {c: i for i, c in enumerate(code.tolist())}
    inside = [np.array([place[c] for c in bag.tolist() if c in place], np.int64) for bag in bags]
    need = np.array([min(times, len(i)) for i in inside])
    docs_of: dict[int, list[int]] = {}
    for d, some in enumerate(inside):
        for i in some.tolist():
            docs_of.setdefault(i, []).append(d)
    left = np.zeros(len(code))
    for i, ds in docs_of.items():
        left[i] = len(ds)
    chosen = []
    while need.any():
        i = int(np.argmax(left * gain))
        if left[i] <= 1:
            break
        chosen.append(code[i])
        for d in docs_of[i]:
            if need[d] > 0:
                need[d] -= 1
                if need[d] == 0:
                    left[inside[d]] -= 1
        left[i] = 0
    return np.array(chosen, np.int64)


def _marks(code: np.ndarray) -> np.ndarray:
    """Eight minimum hashes of a text's windows; none if it has no window."""
    keys = np.random.default_rng(0).integers(1, 1 << 62, 8, dtype=np.uint64) | np.uint64(1)
    if not len(code):
        return code
    h = (code.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15)) * keys
    h ^= h >> np.uint64(29)
    h *= keys
    return (h >> np.uint64(16)).min(0)


def _once(marks: list[list[int]]) -> np.ndarray:
    """One training text of each group of near copies, which would make their common words telling.
    Texts are near copies if most of their eight minimum hashes of windows agree."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, own in enumerate(marks):
        places = list(enumerate(own))
        same = Counter(j for m in places for j in seen.get(m, ()))
        if same and max(same.values()) >= 5:
            continue
        for m in places:
            seen.setdefault(m, []).append(i)
        kept.append(i)
    return np.array(kept, np.int64)


def _rank_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for code, times in zip(b.column("windows"), b.column("counts")):
                value, n = decide(model.value, np.array(code.values)), np.array(times.values)
                above = np.array([n[value > t].sum() for t in LEVELS])
                out.append(_ranks(value, n, above, n.sum()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ORDERED), pa.array(out, pa.list_(pa.float64()))],
                names=[*ORDERED, "ranks"])
    return run


def _telling_bags(telling):
    """The telling windows of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [np.array(x.values) for x in b.column("windows")]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ORDERED),
                 pa.array([x[np.isin(x, telling.value)] for x in bags], pa.list_(pa.int64()))],
                names=[*ORDERED, "bag"])
    return run


def _worst_rows(model, most: int = 3):
    """The worst windows of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, np.int64)]
            for x in b.column("windows"):
                code = np.array(x.values)
                value = decide(model.value, code)
                found.append(code[np.argsort(-value, kind="stable")[:most]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))],
                                             names=["w"])
    return run


def _window_values(model):
    """The decision value of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = decide(model.value, b.column("w").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("w"), b.column("odds"), pa.array(value)],
                                             names=["w", "odds", "value"])
    return run


def _windows(df: DataFrame) -> np.ndarray:
    return df.select("w").toArrow().column("w").to_numpy().astype(np.int64)


def _joined(*some: np.ndarray) -> np.ndarray:
    """All windows, each once, where it comes first."""
    return np.array(list(dict.fromkeys(np.concatenate(some).tolist())), np.int64)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the machine."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    sample = materialize(training_texts(docs, labels).mapInArrow(
        _doc_windows, "h1 long, h2 long, toxic int, marks array<long>, windows array<long>, "
        "counts array<long>"), "toxicity")
    signs = sample.select(*ORDERED, "marks").orderBy(*ORDERED).toArrow()
    toxic = np.array(signs.column("toxic").to_pylist(), bool)
    if not toxic.any() or toxic.all():
        part = float(toxic.mean()) if len(toxic) else 0.0
        part = min(max(part, 1e-9), 1 - 1e-9)
        curve = np.zeros(FEATURES + 1)
        curve[-1] = np.log(part / (1 - part))
        return Model(np.zeros(SYMBOLS ** ORDER, np.float32), 0.0, curve)
    single = _once(signs.column("marks").to_pylist())
    n_bad, n_clean = int(toxic[single].sum()), int((~toxic[single]).sum())
    # As many small rows as the sample has texts.
    chosen = spark.createDataFrame([tuple(r.values()) for r in signs.select(ORDERED).take(
        pa.array(single)).to_pylist()], "h1 long, h2 long, toxic int")
    kept = materialize(sample.dropDuplicates(ORDERED).join(F.broadcast(chosen), ORDERED),
                       "toxicity-kept")
    bad = kept.where("toxic = 1")

    odds = ((F.col("bad") + 0.5) / n_bad) / ((F.col("good") + 0.5) / n_clean)
    expected = F.col("good") * (n_bad / n_clean)
    held = materialize(
        kept.select("toxic", F.explode("windows").alias("w")).groupBy("w").agg(
            F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .withColumn("odds", odds)
        .withColumn("surplus", (F.col("bad") - expected) / F.sqrt(expected + 1)), "toxicity-windows")
    telling = held.where((F.col("bad") >= max(2, SUPPORT * n_bad)) & (F.col("odds") >= ODDS)
                         ).orderBy("w").select("w", "odds").toArrow()
    code = telling.column("w").to_numpy()
    bags = bad.mapInArrow(_telling_bags(share(code)), "h1 long, h2 long, toxic int, bag array<long>"
                          ).orderBy(*ORDERED).toArrow().column("bag")
    positive = _cover([np.array(x.values) for chunk in bags.chunks for x in chunk], code,
                      np.log(telling.column("odds").to_numpy()))
    # Further windows that toxic texts hold far more often than chance allows.
    strong = held.where((F.col("bad") >= max(3, SUPPORT * n_bad)) & (F.col("odds") >= ODDS)
                        & (F.col("surplus") >= 4)).orderBy(F.desc("surplus"), "w")
    positive = _joined(positive, _windows(strong.limit(MAX_POSITIVES)))
    if not len(positive):
        positive = _windows(held.where("bad > 0").orderBy(F.desc("odds"), "w").limit(LANDMARKS))
    clean = held.where("good > 0")
    negative = _joined(*(_windows(clean.orderBy(by, "w").limit(MAX_NEGATIVES // 2))
                         for by in (F.desc("good"), F.xxhash64("w"))))
    negative = negative[~np.isin(negative, positive)]
    for _ in range(ROUNDS):
        model = share(fit(positive, negative, _gapped(positive[:LANDMARKS])))
        # The worst windows of each toxic text join, unless clean texts hold them as well.
        worst = bad.mapInArrow(_worst_rows(model), "w long").distinct().join(held, "w")
        witness = worst.where(F.col("odds") >= ODDS).select("w", "odds").mapInArrow(
            _window_values(model), "w long, odds double, value double")
        positive = _joined(positive, _windows(witness.where("value > 0").orderBy("w")))
        hard = clean.where(F.col("odds") < ODDS).select("w", "odds").mapInArrow(
            _window_values(model), "w long, odds double, value double").where("value > -0.8")
        hard = _windows(hard.orderBy(F.desc("value"), "w").limit(MAX_NEGATIVES))
        negative = _joined(hard, negative)
        negative = negative[~np.isin(negative, positive)][:2 * MAX_NEGATIVES]
    model = fit(positive, negative, _gapped(positive[:LANDMARKS]))
    ranks = kept.select(*ORDERED, "windows", "counts").mapInArrow(
        _rank_rows(share(model)), "h1 long, h2 long, toxic int, ranks array<double>"
    ).orderBy(*ORDERED).toArrow()
    model.curve = _logistic(np.array(ranks.column("ranks").to_pylist()),
                            np.array(ranks.column("toxic").to_pylist(), bool))
    return model


# --- scoring ------------------------------------------------------------------------------------

def score_texts(model: Model, batch: list[str]) -> np.ndarray:
    """Probability that each text is toxic."""
    own = [pieces(t) for t in batch]
    found = {p: i for i, p in enumerate(set().union(*own))}
    code, first = windows(list(found))
    stop = np.append(first[1:], len(code))
    distinct, at = np.unique(code, return_inverse=True)
    value = decide(model, distinct)[at]
    ranks = np.empty((len(batch), FEATURES))
    above = np.stack([np.add.reduceat(value > t, first, dtype=np.int64) for t in LEVELS], axis=1) \
        if len(code) else np.zeros((0, len(LEVELS)), np.int64)
    best = np.maximum.reduceat(value, first) if len(code) else value
    sizes = stop - first
    for i, p in enumerate(own):
        at = np.fromiter(map(found.__getitem__, p), np.int64, len(p))
        times = np.fromiter(p.values(), np.int64, len(p))
        # The worst windows lie in the pieces that hold the worst windows.
        if len(at) > max(TOP):
            some = np.argpartition(-best[at], max(TOP) - 1)[:max(TOP)]
        else:
            some = np.arange(len(at))
        mine, n = at[some], times[some]
        inside = [value[first[j]:stop[j]] for j in mine.tolist()]
        values = np.concatenate(inside) if inside else np.zeros(0)
        ranks[i] = _ranks(values, np.repeat(n, sizes[mine]), times @ above[at],
                          (times * sizes[at]).sum())
    odds = (ranks * model.curve[:-1]).sum(1) + model.curve[-1]    # alike in any batch
    scores = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    if model.weights.any():
        scores[[not p for p in own]] = 0.0
    return scores


def with_scores(docs: DataFrame, model: Model, text_col: str = "text",
                out_col: str = SCORE) -> DataFrame:
    """``docs`` plus the score of every whole text."""
    schema = docs.withColumn(out_col, F.lit(0.0)).schema
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in text_slices(b.column(text_col), PART_CHARS):
                rows = b.slice(at, len(part))
                new = pa.array(score_texts(shared.value, part), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [new if n == out_col else rows.column(n) for n in names], names=names)

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col(SCORE).alias("score"),
        (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with the columns of ``docs``."""
    scored = with_scores(docs, train(docs, labels))
    return scored.where(F.col(SCORE) < THRESHOLD).select(*docs.columns)
