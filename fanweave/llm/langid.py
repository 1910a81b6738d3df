"""Language identification by prediction by partial matching (PPM).

For every language a byte context tree of order ``ORDER`` is counted on labelled training texts and
then frozen. The code length of a byte starts at the longest known context: a byte seen there
n times among t (d different ones) costs -log2(n / (t + d)); otherwise the escape costs
-log2(d / (t + d)) and the next shorter context is asked; below the empty context all 256 bytes are
alike. The trees of all languages share one automaton (state: longest known context), so a text
costs one table look-up per byte for all languages at once. The predicted language has the shortest
code; the score is its posterior under equal priors.

ASCII letters are lower-cased; a text starts after ORDER zero bytes. Contexts that occur fewer times
than a threshold are left out, the least threshold that leaves ``MAX_CONTEXTS`` contexts at most.
Training takes at most about ``TRAIN_DOCS`` whole documents of a language, chosen by hash of text.

Defined results: a null, empty or letterless text gives ``und`` and score 0; so does everything if
there is no training row; equal code lengths give the first language in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import crc32_mod, parts, text_bytes

ORDER = 3
TRAIN_DOCS = 1500
MAX_CONTEXTS = 20_000
STRETCH = 256                 # bytes of one lane of the automaton
LANES = 8192
PART_BYTES = 2 << 20          # text that is scored or counted at once
LETTERS = "__fw_letters"      # column that is added to the documents' own ones

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray        # byte -> column; the last column is the end of a lane
    move: np.ndarray          # [state * columns + column] -> state
    cost: np.ndarray          # [state * columns + column, language] bits


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (ORDER + 1)-byte strings per language and about PART_BYTES of text: a text of any
    length is taken in stretches, each after the ORDER bytes before it."""
    def counted(lang: str, codes: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(values), pa.string()), pa.array(values),
             pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        data, off = text_bytes(b.column("text"))
        for lang in sorted(set(langs)):
            codes, size = [], 0
            for i in np.flatnonzero(langs == lang).tolist():
                for at in range(int(off[i]), int(off[i + 1]), PART_BYTES):
                    stop = min(at + PART_BYTES, int(off[i + 1]))
                    before = data[max(at - ORDER, int(off[i])):at]
                    t = np.concatenate([np.zeros(ORDER - len(before), np.uint8), _FOLD[before],
                                        _FOLD[data[at:stop]]]).astype(np.int64)
                    codes.append(sum(t[k:len(t) - ORDER + k] << (8 * (ORDER - k))
                                     for k in range(ORDER + 1)))
                    size += stop - at
                    if size >= PART_BYTES:
                        yield counted(lang, codes)
                        codes, size = [], 0
            if codes:
                yield counted(lang, codes)


def training_rows(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text): a sample of the labelled documents outside the held-out fold."""
    rows = docs.where((crc32_mod(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()
                      & F.col("text").isNotNull()).select("lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    share = F.lit(float(train_docs)) / F.col("docs") * 1_000_003
    return rows.join(F.broadcast(sizes), "lang").where(
        F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share).select("lang", "text")


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray,
          max_contexts: int = MAX_CONTEXTS) -> Model:
    """Freeze the counts into the automaton and its cost table."""
    counted: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(ORDER + 1):        # contexts of k bytes: (context, byte, language, count)
        low = gram & ((1 << 8 * (k + 1)) - 1)
        key, inverse = np.unique(low * len(langs) + lang, return_inverse=True)
        total = np.bincount(inverse, weights=n).astype(np.int64)
        code, own = np.divmod(key, len(langs))
        counted.append((code >> 8, code & 255, own, total))
    threshold = 2
    totals = [np.unique(c, return_inverse=True) for c, *_ in counted]
    sums = [np.bincount(inv, weights=t) for (_, inv), (*_, t) in zip(totals, counted)]
    while sum(int((s >= threshold).sum()) for s in sums) > max_contexts:
        threshold += max(1, threshold // 8)
    seen = np.zeros(256, bool)
    seen[counted[0][1]] = True
    seen[0] = True                # stands before every text
    symbol = np.full(256, int(seen.sum()), np.int64)       # a column for all unseen bytes
    symbol[seen] = np.arange(int(seen.sum()))
    width = int(seen.sum()) + 2
    end = width - 1
    known = np.flatnonzero(seen)
    # States in order of context length, so that the next shorter context comes first.
    state: dict[tuple[int, int], int] = {}
    for k in range(ORDER + 1):
        for c in totals[k][0][sums[k] >= (threshold if k else 0)].tolist():
            state[k, c] = len(state)
    cost = np.empty((len(state), width, len(langs)))
    move = np.empty((len(state), width), np.int64)
    rows = [(np.array([state.get((k, c), -1) for c in counted[k][0].tolist()]), *counted[k][1:])
            for k in range(ORDER + 1)]
    for (k, c), s in state.items():
        shorter = state[k - 1, c & ((1 << 8 * (k - 1)) - 1)] if k else None
        cost[s] = cost[shorter] if k else 8.0
        for b, column in zip(known.tolist(), symbol[known].tolist()):
            longer = (k + 1, c << 8 | b)
            move[s, column] = state[longer] if k < ORDER and longer in state else (
                move[shorter, column] if k else state.get((1, b), s))
        move[s, width - 2] = state[0, 0]
        move[s, end] = s
    for k in range(ORDER + 1):
        at, byte, own, total = rows[k]
        keep = at >= 0
        at, byte, own, total = at[keep], byte[keep], own[keep], total[keep]
        t = np.zeros((len(state), len(langs)))
        d = np.zeros((len(state), len(langs)))
        np.add.at(t, (at, own), total)
        np.add.at(d, (at, own), 1)
        mine = np.unique(at)
        below = np.array([0], np.int64) if k == 0 else None
        if k:
            codes = {s: c for (kk, c), s in state.items() if kk == k}
            below = np.array([state[k - 1, codes[s] & ((1 << 8 * (k - 1)) - 1)]
                              for s in mine.tolist()], np.int64)
            base = cost[below]
        else:
            base = np.full((1, width, len(langs)), 8.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(t[mine] > 0, -np.log2(d[mine] / (t[mine] + d[mine])), 0.0)
        cost[mine] = base + escape[:, None, :]
        cost[at, symbol[byte], own] = -np.log2(total / (t[at, own] + d[at, own]))
    cost[:, end] = 0.0
    return Model(langs, symbol, move.ravel().astype(np.int32),
                 cost.reshape(-1, len(langs)).astype(np.float32))


def train(docs: DataFrame) -> Model | None:
    rows = training_rows(docs).mapInArrow(_grams, "lang string, gram long, n long")
    counts = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    langs = sorted(counts["lang"].unique())
    lang = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    return build(langs, lang, counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


def code_lengths(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of every text under every language: [texts, languages]."""
    width = int(model.symbol.max()) + 2
    lens = np.diff(off)
    per_doc = -(-lens // STRETCH)
    doc = np.repeat(np.arange(len(lens)), per_doc)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = off[doc] + nth * STRETCH
    stop = np.minimum(start + STRETCH, off[doc + 1])
    out = np.zeros((len(lens), len(model.langs)))
    # ORDER bytes of warm-up before each lane: the last bytes before it, zeros before the text.
    columns = np.concatenate([model.symbol[_FOLD[data]], [model.symbol[0], width - 1]])
    zero, pad = len(data), len(data) + 1
    root = 0
    for at in range(0, len(doc), LANES):
        s, e, d = start[at:at + LANES], stop[at:at + LANES], doc[at:at + LANES]
        state = np.full(len(s), root, np.int64)
        bits = np.zeros((len(s), len(model.langs)), np.float64)
        for step in range(-ORDER, int((e - s).max())):
            pos = s + step
            pos = np.where(pos < off[d], zero, pos) if step < 0 else np.where(pos < e, pos, pad)
            cell = state * width + columns[pos]
            if step >= 0:
                bits += model.cost[cell]
            state = model.move[cell].astype(np.int64)
        np.add.at(out, d, bits)
    return out


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.withColumn(LETTERS, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        return rows.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = docs.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = text_bytes(b.column(text_col))
            bits = np.concatenate([np.zeros((0, len(m.langs))), *(
                code_lengths(m, data[off[s]:off[e]], off[s:e + 1] - off[s])
                for s, e in parts(np.diff(off), PART_BYTES))])
            best = bits.argmin(1)
            odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0))
            letters = b.column(LETTERS).to_numpy(zero_copy_only=False).astype(bool)
            pred = [m.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept]
                + [pa.array(pred, pa.string()), pa.array(np.where(letters, 1 / odds.sum(1), 0.0))],
                names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled rows outside the fold."""
    model = train(docs)
    held = (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), model)
