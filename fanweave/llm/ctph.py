"""Context-triggered piecewise hashing (CTPH).

A hash of the last ``ROLL`` bytes decides where pieces end: a position is a boundary at block size
2^k if the k lowest bits of its hash are set, so the boundaries of a block size are also boundaries
of the next smaller one. Each piece gives one of 64 characters. A text's block size is the smallest
power of two that leaves 64 pieces at most on average, halved while the signature stays short. A
fingerprint is ``block size:signature:signature at twice the block size``. Two fingerprints are
compared where their block sizes are equal or differ by a factor of two: likeness is 1 less the
edit distance (insertions and deletions) over the signatures' joint length, and 0 for signatures
without a common run of ``RUN`` characters.

Defined results: null text is the empty text, fingerprint ``4::``; equal fingerprints have likeness
1; documents of one id follow each other in the order of their text; null ids come first; a single
document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import text_slices

ROLL = 7
MIN_LEVEL = 2                 # smallest block size: 4 bytes
PIECES = 64
SHORT = 32                    # a signature below this length asks for a smaller block size
RUN = 4
BUCKET_DOCS = 5_000
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "S1")
_CODE = {c: i for i, c in enumerate(_LETTERS.tobytes().decode())}
_ROLL_MUL = 0x01000193
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of the piece hash's base and of its inverse, modulo 2^64, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def _boundaries(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible boundaries in one text and the levels up to which they hold."""
    padded = np.concatenate([np.zeros(ROLL - 1, np.uint32), raw.astype(np.uint32) + 1])
    n = len(raw)
    h = np.zeros(n, np.uint32)
    for k in range(ROLL):
        h *= np.uint32(_ROLL_MUL)
        h += padded[k:k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    at = np.flatnonzero((h & np.uint32((1 << MIN_LEVEL) - 1)) == (1 << MIN_LEVEL) - 1)
    rest = ~h[at]
    level = np.where(rest == 0, 32, np.bitwise_count((rest & -rest) - np.uint32(1)))
    return at, level


def _signature(ends: np.ndarray, n: int, sums: np.ndarray, down: np.ndarray, most: int) -> str:
    """One character per piece; what lies past the last boundary, or past ``most`` pieces, is a
    piece too."""
    stops = ends[:most - 1] + 1
    if n and (not len(stops) or stops[-1] < n):
        stops = np.append(stops, n)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    with np.errstate(over="ignore"):
        h = (sums[stops] - sums[starts]) * down[starts]
        h += (stops - starts).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return _LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if not n:
        return f"{1 << MIN_LEVEL}::"
    up, down = _Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    at, level = _boundaries(raw)
    k = MIN_LEVEL
    while PIECES << k < n:
        k += 1
    while k > MIN_LEVEL and np.count_nonzero(level >= k) < SHORT:
        k -= 1
    return ":".join((str(1 << k), _signature(at[level >= k], n, sums, down, PIECES),
                     _signature(at[level > k], n, sums, down, PIECES // 2)))


def _common_run(a: str, b: str) -> bool:
    if min(len(a), len(b)) < RUN:
        return a == b
    own = {a[i:i + RUN] for i in range(len(a) - RUN + 1)}
    return any(b[i:i + RUN] in own for i in range(len(b) - RUN + 1))


def _edit_likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """1 - edit distance / joint length of many signature pairs at once (at most 64 characters):
    the longest common subsequence, bit-parallel within a pair and vectorized over the pairs."""
    out = np.zeros(len(pairs))
    rows = [i for i, (a, b) in enumerate(pairs) if a and b and _common_run(a, b)]
    if not rows:
        return out
    la = np.array([len(pairs[i][0]) for i in rows])
    lb = np.array([len(pairs[i][1]) for i in rows])
    masks = np.zeros((len(rows), len(_CODE) + 1), np.uint64)
    other = np.full((len(rows), int(lb.max())), len(_CODE), np.int64)
    for r, i in enumerate(rows):
        a, b = pairs[i]
        for bit, c in enumerate(a):
            masks[r, _CODE[c]] |= np.uint64(1 << bit)
        other[r, :len(b)] = [_CODE[c] for c in b]
    v = np.full(len(rows), ~np.uint64(0))
    each = np.arange(len(rows))
    with np.errstate(over="ignore"):
        for step in range(other.shape[1]):
            u = v & masks[each, other[:, step]]
            v = (v + u) | (v - u)
    whole = ~np.uint64(0) >> (64 - la).astype(np.uint64)
    common = np.bitwise_count(~v & whole)
    out[rows] = 2.0 * common / (la + lb)
    return out


def compare(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of fingerprints."""
    asks: list[tuple[str, str]] = []
    owner: list[int] = []
    out = np.zeros(len(pairs))
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        some = ([(x1, y1), (x2, y2)] if bx == by else [(x1, y2)] if bx == 2 * by
                else [(x2, y1)] if by == 2 * bx else [])
        asks += some
        owner += [i] * len(some)
    if asks:
        np.maximum.at(out, owner, _edit_likeness(asks))
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, flag, id, text); the row of flag 1 that ends a bucket is the
    first document of the bucket after it."""
    held = None                                   # (bucket, id, text, fingerprint)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        ids, own, nxt = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        changed = [edited(r[1], r[3]) for r in rows]
        prints = [fingerprint(t.encode()) for t in changed]
        first = [r[4] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
             pa.array(first, pa.string()), pa.array(prints, pa.string()),
             pa.array(compare(list(zip(first, prints))), pa.float64()),
             pa.array(compare(list(zip(first, nxt))), pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                   "near_edited", "near_next"])

    for b in batches:
        rows, size = [], 0
        buckets, flags, ids = (b.column(c).to_pylist() for c in ("bucket", "flag", "doc_id"))
        own = (t for _, run in text_slices(b.column("text"), 1 << 20) for t in run)
        for bucket, flag, doc, text in zip(buckets, flags, ids, own):
            print_ = fingerprint(text.encode())
            if held is not None and held[0] == bucket:
                rows.append((held[1], held[2], print_, text[:len(held[2]) // 4], held[3]))
                size += len(held[2])
                if size > 1 << 20:
                    yield emit(rows)
                    rows, size = [], 0
            held = None if flag else (bucket, doc, text, print_)
        yield emit(rows)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how alike they are.

    Documents are dealt to buckets of consecutive ids (bounds: quantiles of the id); each bucket
    also gets the first document of the next one, the last bucket that of the first one."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, -(-docs.count() // BUCKET_DOCS))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) \
        if n > 1 else []
    # approxQuantile gives doubles; a bound only has to be the same number everywhere.
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(
        F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    docs = docs.withColumn("bucket", bucket.cast("int"))
    # One row per bucket: the next bucket's first id.
    lows = sorted(((r["bucket"], r["low"]) for r in docs.groupBy("bucket").agg(
        F.min("doc_id").alias("low")).collect()), key=lambda x: x[0])
    if not lows:
        return spark.createDataFrame([], REPORT)
    following = [(own, low, lows[i - 1][0]) for i, (own, low) in enumerate(lows)]
    heads = spark.createDataFrame(following, "own int, low long, bucket int")
    heads = docs.withColumnRenamed("bucket", "own").join(F.broadcast(heads), "own").where(
        F.col("doc_id").eqNullSafe(F.col("low")))
    heads = heads.groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    rows = docs.withColumn("flag", F.lit(0)).unionByName(heads.withColumn("flag", F.lit(1)))
    rows = rows.repartition("bucket").sortWithinPartitions(
        "bucket", "flag", F.col("doc_id").asc_nulls_first(), "text")
    return rows.mapInArrow(_fingerprints, REPORT)


REPORT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
