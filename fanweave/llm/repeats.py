"""Removal of long repeats with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the corpus,
in the same text or another one, overlapping or not, judged on the input texts.

Suffixes are dealt out by anchors. The anchor of a window is, of the strings of ``SAMPLE`` bytes that
begin at its first ``MARGIN`` + 1 places, the one of least hash: equal windows have equal anchors at
equal places, so they meet in one bucket, and only anchors that occur again matter. The centre is the
``length - MARGIN`` bytes from the anchor on, which every window of that anchor holds; its context is
what its windows can reach: ``MARGIN`` bytes to either side of the centre. In a bucket the centre is
common to all contexts and stands as one symbol. The bucket's suffixes are sorted by linear grouping
(``suffix_sort``); a window repeats if a neighbouring suffix agrees with it in the MARGIN + 1
symbols that a window has, or if its context as a whole occurs more than once. Equal contexts are
one member with a count, so copies do not swell a bucket. A bucket of more than ``BUCKET`` members
is divided by offset: the windows that begin left of the middle share half of the left margin, the
others half of the right one; these bytes join the centre, equal rests become one member, and the
parts are dealt out anew until they fit. With an empty margin one member is left, so this ends.

The hash of the sample only brings candidates together. Whole contexts are equal if four polynomials
modulo 2^31 - 1 agree whose bases are drawn anew for each run, after the texts are given: two texts
that differ pass as equal with a chance below 10^-25, whatever they hold. Centres of contexts that
differ are compared by 128 bits of BLAKE2b, the rest byte by byte.

Defined results: null text is the empty text; texts shorter than ``length`` lose nothing; rows that
repeat an id and a text are copies of each other, and both lose everything from ``length`` bytes on;
rows are matched by (id, SHA-256 of text), null ids included.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import (discard, materialize, parts, scratch_path, text_bytes,
                                 write_rows)
from fanweave.llm.suffix_sort import suffix_array

LENGTH = 400
PASSAGE = 200                     # shortest length; a passage of over 50 words has more bytes
MARGIN = 63                       # a context's windows are the 64 bits of a long
SAMPLE = PASSAGE - MARGIN
BUCKET = 4096
HASH_PARTS = 3
SEGMENT = 1 << 17                 # longer texts are hashed in overlapping segments
PART = 1 << 18
CUT_BYTES = 1 << 21               # text whose contexts are Python objects at once
SORT_SYMBOLS = 100_000
TASK_MEMBERS = 4000                # contexts that one task sorts, on average
PLACES = "__fw_places"            # column that is added to the documents' own ones

_BASE = 0x9E3779B97F4A7C15
_PRIME = (1 << 31) - 1
_LOW = np.uint64((1 << 24) - 1)   # place of a string in its part
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, modulus: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, modulo a prime below 2^31 or 2^64."""
    own = _powers.get((base, modulus))
    if own is None or len(own) < n:
        if len(_powers) > 20:                             # those of an earlier run
            _powers.clear()
        own = np.ones(1, np.uint64)
        while len(own) < max(n, PART):
            more = own * np.uint64(pow(base, len(own), modulus))
            own = np.concatenate([own, more if modulus > 1 << 32 else more % np.uint64(modulus)])
        own = own if modulus > 1 << 32 else own.astype(np.uint32)
        _powers[base, modulus] = own
    return own[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def draw_bases() -> list[tuple[int, int, int]]:
    """Four random (base, weight of the left margin, weight of the right margin)."""
    return [tuple(2 + secrets.randbelow(_PRIME - 3) for _ in range(3)) for _ in range(4)]


def _context_hashes(value: np.ndarray, begin: np.ndarray, at: np.ndarray, end: np.ndarray,
                    centre: int, bases: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """62 bits of the centres value[at:at + centre], as far as the contexts hold them, and 124 bits
    of the contexts value[begin:end], as three longs."""
    prime, n, out, middle = np.uint64(_PRIME), len(value), [], []
    stop = np.minimum(at + centre, end)
    sums = np.zeros(n + 1, np.uint64)
    left, right = (at - begin).astype(np.uint64), (end - at).astype(np.uint64)
    for base, of_left, of_right in bases:
        # Below 2^8 x 2^31 x 2^20: exact.
        np.cumsum(value * _power(base, _PRIME, n), out=sums[1:])
        down = _power(pow(base, -1, _PRIME), _PRIME, n + 1)
        if len(middle) < 2:
            middle.append((sums[stop] - sums[at]) % prime * down[at] % prime)
        h = (sums[end] - sums[begin]) % prime * down[begin]
        out.append((h % prime + left * np.uint64(of_left) + right * np.uint64(of_right)) % prime)
    high = np.uint64(32)
    return [(a << high) | b for a, b in (middle, out[:2], out[2:])]


def anchors(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray,
            length: int, bases: list[tuple[int, int, int]]):
    """Anchors of the windows of several stretches of ``raw``: (stretch, place, whether the centre
    ends in the stretch, hashes of the sample and the centre, two of the context). Stretch i is raw[lo[i]:hi[i]]; its windows, of PASSAGE bytes at
    least, start at first[i] up to, not including, last[i]."""
    n = len(raw)
    places, windows = n - SAMPLE + 1, n - PASSAGE + 1
    empty = np.zeros(0, np.int64)
    if windows <= 0:
        return empty, empty, empty.astype(bool), *[empty.view(np.uint64)] * 4
    value = raw.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * _power(_BASE, 1 << 64, n), out=sums[1:])
    h = _mix((sums[SAMPLE:] - sums[:places]) * _power(pow(_BASE, -1, 1 << 64), 1 << 64, places))
    key = (h & ~_LOW) | np.arange(places, dtype=np.uint64)
    inside = np.zeros(windows + 1, np.int32)
    good = last > first
    np.add.at(inside, first[good], 1)
    np.add.at(inside, last[good], -1)
    # Least key of each MARGIN + 1 places, from the minima up to and from a block boundary on.
    width = MARGIN + 1
    blocks = np.concatenate([key, np.full(-places % width, ~np.uint64(0))]).reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[:windows], upto[width - 1:width - 1 + windows])
    at = np.unique((least[np.cumsum(inside[:-1]) > 0] & _LOW).astype(np.int64))
    stretch = np.searchsorted(lo, at, side="right") - 1
    begin = np.maximum(at - MARGIN, lo[stretch])
    end = np.minimum(at + length, hi[stretch])
    centre = length - MARGIN
    return (stretch, at, at + centre <= end, h[at],
            *_context_hashes(value, begin, at, end, centre, bases))


def _segments(off: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Stretches to hash together, as (text, begin, first window, end of windows) in its bytes."""
    part, size = [], 0
    for d, n in enumerate(np.diff(off).tolist()):
        for w in range(0, max(n - PASSAGE + 1, 0), SEGMENT):
            stop = min(w + SEGMENT, n - PASSAGE + 1)
            part.append((d, max(0, w - MARGIN), w, stop))
            size += stop - w + LENGTH
            if size >= PART:
                yield part
                part, size = [], 0
    if part:
        yield part


ANCHORS = "rid long, doc_id long, th binary, pos long, hash long, centre long, x1 long, x2 long"


def _anchor_rows(length: int, bases: list[tuple[int, int, int]]):
    """A row of place -1 for every text that has a window, which carries its id, and a row for
    each of its anchors. ``centre`` is null where no window of this length has the anchor; a centre
    that is the sample has the sample's hash."""
    names = ["rid", "doc_id", "th", "pos", "hash", "centre", "x1", "x2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column("text"))
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            longer = pa.array(np.flatnonzero(np.diff(off) >= PASSAGE))
            n = len(longer)
            nothing = pa.array(np.zeros(n, np.int64))
            before = (-1, np.zeros(0, np.int64))     # the text of the last segment, its anchors
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(longer) for c in ("rid", "doc_id", "th")),
                 pa.array(np.full(n, -1)), *[nothing] * 4], names=names)
            for part in _segments(off):
                doc, begin, first, last = (np.array(x, np.int64) for x in zip(*part))
                end = np.minimum(last + length + MARGIN, np.diff(off)[doc])
                size = end - begin
                lo = np.cumsum(size) - size
                raw = np.concatenate([data[off[d] + s:off[d] + e]
                                      for d, s, e in zip(doc, begin, end)])
                i, at, whole, h, centre, *hashes = anchors(
                    raw, lo, lo + size, lo + first - begin, lo + last - begin, length, bases)
                pos = at - lo[i] + begin[i]
                # Two segments of a text may find one anchor where they meet.
                new = np.ones(len(at), bool)
                for k in np.flatnonzero(first > 0):
                    own = i == k
                    earlier = pos[i == k - 1] if k else before[1] if before[0] == doc[k] else pos[:0]
                    new[own] = ~np.isin(pos[own], earlier)
                before = (int(doc[-1]), pos[i == len(doc) - 1])
                i, pos, h = i[new], pos[new], h[new].view(np.int64)
                centre = h if length == PASSAGE else centre[new].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[doc[i]]), pa.nulls(len(pos), pa.int64()),
                     pa.nulls(len(pos), pa.binary()), pa.array(pos), pa.array(h),
                     pa.array(centre, mask=~whole[new]),
                     *(pa.array(x[new].view(np.int64)) for x in hashes)], names=names)
    return run


# --- buckets ------------------------------------------------------------------------------------

def repeated_windows(buckets: list[list[tuple[bytes, bytes, int]]], margin: int) -> list[list[int]]:
    """For each member (left, right, count) of each bucket the bits of its windows that repeat. Bit
    o is the window that begins ``margin - o`` bytes before the centre."""
    full = (1 << (margin + 1)) - 1
    masks = [[full if n > 1 else 0 for _, _, n in b] for b in buckets]
    batch: list[int] = []
    size = 0
    for i, b in enumerate(buckets):
        if len(b) > 1:
            batch.append(i)
            size += sum(len(left) + len(right) + 2 for left, right, _ in b)
        if batch and (size > SORT_SYMBOLS or i == len(buckets) - 1):
            _sort_buckets([buckets[k] for k in batch], [masks[k] for k in batch], margin)
            batch, size = [], 0
    if batch:
        _sort_buckets([buckets[k] for k in batch], [masks[k] for k in batch], margin)
    return masks


def _sort_buckets(buckets, masks, margin: int) -> None:
    """One suffix array over the contexts of several buckets. Symbols: 0 the end, 1 after each
    context, 2 to 257 bytes, from 258 on the centre of each bucket."""
    parts, owner, begins, lefts = [], [], [], []
    at = 0
    for k, bucket in enumerate(buckets):
        for member, (left, right, _) in enumerate(bucket):
            parts += [np.frombuffer(left, np.uint8).astype(np.int32) + 2, [258 + k],
                      np.frombuffer(right, np.uint8).astype(np.int32) + 2, [1]]
            owner.append((k, member))
            begins.append(at)
            lefts.append(len(left))
            at += len(left) + len(right) + 2
    text = np.concatenate([*parts, [0]]).astype(np.int32)
    order = suffix_array(text)
    begins, lefts = np.array(begins), np.array(lefts)
    ends = np.append(begins[1:], at) - 1                     # the separator of each context
    context = np.minimum(np.searchsorted(begins, np.arange(len(text)), side="right") - 1,
                         len(begins) - 1)
    need = margin + 1
    holds = np.arange(len(text)) + need <= ends[context]     # suffixes that hold a whole window
    a, b = order[:-1], order[1:]
    both = holds[a] & holds[b]
    a, b = a[both], b[both]
    for step in range(need):                                 # compare, dropping pairs that differ
        same = text[a + step] == text[b + step]
        a, b = a[same], b[same]
    hit = np.unique(np.concatenate([a, b]))
    for suffix, c in zip(hit.tolist(), context[hit].tolist()):
        k, member = owner[c]
        masks[k][member] |= 1 << (margin - int(lefts[c]) + suffix - int(begins[c]))


def _solve_rows(margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(at, 256) for big in batches for at in range(0, big.num_rows, 256)):
            keys, ids = b.column("key").to_pylist(), []
            buckets = [[(m["left"], m["right"], m["n"]) for m in members]
                       for members in b.column("members").to_pylist()]
            names = [[m["id"] for m in members] for members in b.column("members").to_pylist()]
            for key, own, masks in zip(keys, names, repeated_windows(buckets, margin)):
                ids += [(key, i, m) for i, m in zip(own, masks) if m]
            out = np.array([m for _, _, m in ids], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in ids], pa.string()),
                 pa.array([i for _, i, _ in ids], pa.string()), pa.array(out)],
                names=["key", "id", "mask"])
    return run


def solve(members: DataFrame, margin: int = MARGIN, bucket: int = BUCKET) -> DataFrame:
    """(key, id, left, right, n) -> (key, id, mask) of the members with a repeated window."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    large = materialize(sizes.where(F.col("size") > bucket), "repeats-large")
    hot = not large.isEmpty()
    fit = members.join(large, "key", "left_anti") if hot else members
    tasks = max(1, -(-members.count() // TASK_MEMBERS))
    grouped = fit.repartition(tasks, "key").groupBy("key").agg(
        F.collect_list(F.struct("id", "left", "right", "n")).alias("members"))
    # A lone member that occurs once has nothing to agree with.
    grouped = grouped.where((F.size("members") > 1) | (F.col("members")[0]["n"] > 1))
    found = grouped.mapInArrow(_solve_rows(margin), "key string, id string, mask long")
    if not hot:
        return found
    rest = members.join(large, "key", "left_semi")
    mid = margin // 2
    tail = margin - mid               # bytes of the left margin that the first half shares
    absorbed = F.expr(f"substring(left, octet_length(left) - {tail} + 1, {tail})")
    halves = [
        ("a", mid, 0, F.octet_length("left") >= tail, absorbed,
         F.expr(f"substring(left, 1, octet_length(left) - {tail})"),
         F.expr(f"substring(right, 1, {mid})")),
        ("b", margin - mid - 1, mid + 1, F.octet_length("right") >= mid + 1,
         F.expr(f"substring(right, 1, {mid + 1})"),
         F.expr(f"substring(left, greatest(octet_length(left) - {margin - mid - 1} + 1, 1), "
                f"{margin - mid - 1})"),
         F.expr(f"substring(right, {mid + 2}, octet_length(right))")),
    ]
    for side, smaller, shift, has, shared, left, right in halves:
        part = rest.where(has).select(
            "key", "id", "n",
            F.sha2(F.concat(F.encode("key", "utf-8"), F.lit(side.encode()), shared), 256)
            .alias("part"), left.alias("left"), right.alias("right"))
        part = materialize(part.withColumn("sub", F.sha2(F.concat(
            F.octet_length("left").cast("string").cast("binary"), F.lit(b":"), "left", "right"),
            256)), "repeats-part")
        merged = part.groupBy("part", "left", "right").agg(
            F.sum("n").alias("n"), F.first("sub").alias("id")).withColumnRenamed("part", "key")
        masks = solve(merged, smaller, bucket)
        back = part.select("key", "id", "part", "sub").join(
            masks.select(F.col("key").alias("part"), F.col("id").alias("sub"), "mask"),
            ["part", "sub"])
        found = found.unionByName(back.select(
            "key", "id", F.shiftleft("mask", shift).alias("mask")))
    return found.groupBy("key", "id").agg(F.bit_or("mask").alias("mask"))


def _context_rows(length: int):
    """Contexts of the asked places of each text, those of about ``CUT_BYTES`` of text at a time."""
    centre = length - MARGIN
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column("text"))
            for s, e in parts(np.diff(off), CUT_BYTES):
                raw = data[off[s]:off[e]].tobytes()
                rows = []
                for d, asked in enumerate(b.column("asked").slice(s, e - s).to_pylist(), s):
                    lo, hi = int(off[d] - off[s]), int(off[d + 1] - off[s])
                    for a in asked:
                        p = lo + a["pos"]
                        digest = hashlib.blake2b(raw[p:p + centre], digest_size=16).hexdigest()
                        rows.append((f"{a['centre']:x}-{digest}", f"{a['x1']:x}.{a['x2']:x}",
                                     a["centre"], a["x1"], a["x2"], a["n"],
                                     raw[max(lo, p - MARGIN):p],
                                     raw[p + centre:min(hi, p + length)]))
                cols = list(zip(*rows)) or [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(cols, kinds)],
                    names=["key", "id", "centre", "x1", "x2", "n", "left", "right"])
    return run


def repeat_places(docs: DataFrame, length: int = LENGTH, shared: bool = False) -> DataFrame:
    """(doc_id, th, places): for the texts with a repeated window, the anchors (pos, mask); with
    ``shared`` for all texts with a repeated sample, mask 0 where no window repeats."""
    if length < PASSAGE:
        raise ValueError(f"repeats of fewer than {PASSAGE} bytes are not searched for")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.unhex(F.sha2("text", 256)).alias("th"), "text")
    spark, context = docs.sparkSession, ["centre", "x1", "x2"]
    path, kept = scratch_path(spark, "repeats-anchors"), scratch_path(spark, "repeats-candidates")
    rows = write_rows(
        named.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "th", "text")
        .mapInArrow(_anchor_rows(length, draw_bases()), ANCHORS), path)
    owners = materialize(rows.where("pos < 0").select("rid", "doc_id", "th"), "repeats-owners")
    # The anchors that occur again, one part of the hashes after the other: what is shuffled at a
    # time takes that part of the disk. The repeated hashes are written first, so that the join has
    # nothing but a shuffle on either side and Spark can split a hash that very many anchors have.
    for part in range(HASH_PARTS):
        some = rows.where("pos >= 0").select("rid", "pos", "hash", *context).where(
            F.pmod("hash", F.lit(HASH_PARTS)) == part)
        again = materialize(some.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                            .select("hash"), "repeats-again")
        marks = write_rows(some.join(again, "hash").drop("hash"), kept, "append")
    discard(rows, path)

    # Only centres that occur again matter; a sample may occur again within other bytes.
    classes = marks.where("centre IS NOT NULL").groupBy(*context).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "pos")).alias("at"))
    classes = materialize(classes, "repeats-classes")
    split = classes.groupBy("centre").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    split = materialize(split.select("centre"), "repeats-split")
    alone = classes.join(split, "centre", "left_anti").where("n > 1").select(
        *context, F.lit(-1).cast("long").alias("mask"))
    asked = (classes.join(split, "centre")
             .select(F.col("at.rid").alias("rid"), F.col("at.pos").alias("pos"), *context, "n")
             .join(owners, "rid").groupBy("doc_id", "th").agg(F.collect_list(
                 F.struct("pos", *context, "n")).alias("asked")))
    members = named.join(asked, named["doc_id"].eqNullSafe(asked["doc_id"])
                         & named["th"].eqNullSafe(asked["th"])).select("text", "asked")
    members = materialize(
        members.mapInArrow(_context_rows(length), "key string, id string, centre long, "
                           "x1 long, x2 long, n long, left binary, right binary")
        .dropDuplicates(["key", "id"]), "repeats-contexts")
    masks = solve(members.select("key", "id", "left", "right", "n"), MARGIN, BUCKET).join(
        members.select("key", "id", *context), ["key", "id"]).select(*context, "mask")
    masks = materialize(masks.unionByName(alone), "repeats-masks")
    # Rows that repeat an id and a text have the same places: one of them gives its own.
    one = materialize(owners.groupBy("doc_id", "th").agg(F.min("rid").alias("rid")), "repeats-one")
    found = marks.join(masks, context, "left" if shared else "inner")
    return found.select("rid", "pos", F.coalesce("mask", F.lit(0)).alias("mask")).join(
        one, "rid").groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("pos", "mask")).alias("places"))


def covered(n: int, pos: np.ndarray, mask: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of a text's n bytes lie in a repeated window."""
    starts = np.zeros(max(n - length + 1, 0), bool)
    bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    at = (pos[:, None] - MARGIN + np.arange(MARGIN + 1))[bits.astype(bool)]
    starts[at[(at >= 0) & (at < len(starts))]] = True
    return _cover(n, np.flatnonzero(starts), length)


def _cover(n: int, begin: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(n + length + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return np.cumsum(edge[:n]) > 0


def _with_places(docs: DataFrame, length: int, shared: bool = False) -> DataFrame:
    places = materialize(repeat_places(docs, length, shared), "repeats-places").select(
        F.col("doc_id").alias("__fw_id"), F.col("th").alias("__fw_th"), F.col("places").alias(PLACES))
    return docs.join(places, docs["doc_id"].eqNullSafe(places["__fw_id"])
                     & (F.unhex(F.sha2(docs["text"], 256)) == places["__fw_th"]), "left").drop(
        "__fw_id", "__fw_th")


def _texts_and_places(b: pa.RecordBatch):
    """(bytes, places, masks) of each text; no places: None."""
    data, off = text_bytes(b.column("text"))
    places = b.column(PLACES)
    for d in range(b.num_rows):
        raw = data[off[d]:off[d + 1]]
        if places[d].is_valid:
            flat = places[d].values
            yield raw, flat.field("pos").to_numpy(), flat.field("mask").to_numpy()
        else:
            yield raw, None, None


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, pos, mask in _texts_and_places(b):
                kept, spans, common = raw, 0, 0
                if pos is not None:
                    gone = covered(len(raw), pos, mask, length)
                    kept = raw[~gone]
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                    common = int(_cover(len(raw), pos, SAMPLE).sum())
                out.append((len(raw), len(raw) - len(kept), spans,
                            hashlib.sha256(kept.tobytes()).hexdigest(), common))
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])
    return run


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document, and n_shared: the bytes
    under those sample strings of the text that occur again. Any PASSAGE bytes that repeat hold such
    a sample, so it also shows repeats that are too short to be removed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_places(docs, length, shared=True).mapInArrow(
        _digests(length), "doc_id long, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, n_shared long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; a character goes if all its bytes do.
    ``length`` is what counts as a repeat, in bytes, PASSAGE or more. ``n_chars``, where there is
    such a column, is counted anew. Null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for (raw, pos, mask), valid in zip(_texts_and_places(b), b.column("text").is_valid()):
                if pos is not None:
                    gone = covered(len(raw), pos, mask, length)
                    head = (raw & 0xC0) != 0x80                     # first byte of each character
                    whole = np.logical_and.reduceat(gone, np.flatnonzero(head))
                    raw = raw[~whole[np.cumsum(head) - 1]]
                new.append(raw.tobytes().decode() if valid.as_py() else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.string()) if n == "text" else b.column(n) for n in names],
                names=names)

    out = _with_places(docs, length).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return out.select(*names)
