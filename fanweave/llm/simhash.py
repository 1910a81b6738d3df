"""SimHash near-duplicates linked through pivot distance tables.

Fingerprint: A-Z lower-cased, words between blanks (space, \\t to \\r), shingles of three words with
repeats (fewer words: the whole sequence as one), XXH64 of each shingle with seed 42; a bit is set
if it is set in over half of the hashes. No words: fingerprint zero, linked like any other.

Linking works on distinct fingerprints. Their Hamming distances to ``PIVOTS`` reference fingerprints
are computed once. By the triangle inequality a pair within ``max_bits`` bits differs by at most
``max_bits`` in every distance, so a pair with a larger coordinate difference is discarded, and the
survivors are verified bit by bit. To deal the pairs out, the 64 bits are cut into max_bits + 1
blocks: a linked pair agrees on one of them, so rows meet by block value. A group of more than
``GROUP_ROWS`` fingerprints is cut again by blocks of its remaining bits until it fits; the fixed
bits only grow, so this ends, no pair is lost, and no task holds an unbounded group. A group gives
a star per connected part, not its pairs. Components come from alternating large and small stars.

Defined results: null text is the empty text; a null id never is the smallest, and a component of
null ids only has a null component id; rows that repeat an id get one result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.llm.common import materialize, text_bytes

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
PIVOTS = 16
GROUP_ROWS = 2048
_CHUNK = 1 << 16

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def pivot_fingerprints(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: XXH64 of their own number."""
    return [xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)]


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text."""
    tokens = text.translate(_FOLD).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    width = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        stop = min(n, at + _CHUNK)
        hashes = np.fromiter(
            [digest(joined[a:b], SEED) for a, b in
             zip(starts[at:stop].tolist(), ends[at + width - 1:stop + width - 1].tolist())],
            ">u8", stop - at)
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp",
                      words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without its text, plus the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept, F.lit(0).cast("long").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_bytes(b.column(text_col))
            raw = data.tobytes()
            fps = np.fromiter((fingerprint(raw[s:e], words) for s, e in
                               zip(off[:-1].tolist(), off[1:].tolist())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array(fps.view(np.int64))],
                names=[*kept, out_col])

    return docs.mapInArrow(run, schema)


# --- linking ------------------------------------------------------------------------------------

def _cut(bits: list[int], parts: int) -> list[int]:
    """The bit positions in ``parts`` consecutive groups, each as a mask."""
    bounds = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(bounds, bounds[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _linked_stars(fps: np.ndarray, coords: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(root, member) edges of the connected parts of one group."""
    order = np.argsort(coords[:, 0], kind="stable")
    fps, coords = fps[order], coords[order].astype(np.int16)
    reach = np.searchsorted(coords[:, 0], coords[:, 0] + max_bits, side="right")
    counts = reach - np.arange(len(fps)) - 1
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    cum = np.concatenate([[0], np.cumsum(counts)])
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(cum, cum[lo] + (1 << 20), side="right")) - 1)
        n = counts[lo:hi]
        left = np.repeat(np.arange(lo, hi), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(cum[lo:hi] - cum[lo], n)
        for j in range(1, coords.shape[1]):
            near = np.abs(coords[left, j] - coords[right, j]) <= max_bits
            left, right = left[near], right[near]
        close = np.bitwise_count(fps[left] ^ fps[right]) <= max_bits
        for a, b in zip(left[close].tolist(), right[close].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[b] = a
        lo = hi
    parts: dict[int, list[int]] = {}
    for i, fp in enumerate(fps.view(np.int64).tolist()):
        parts.setdefault(find(i), []).append(fp)
    return [(min(p), x) for p in parts.values() if len(p) > 1 for x in p if x != min(p)]


def _group_edges(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column("members")
            flat = members.flatten()
            fps = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            coords = np.concatenate(
                [flat.field(c).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8)
                 .reshape(-1, 8) for c in ("near", "far")], axis=1)
            sizes = np.array([len(m) for m in members], np.int64)
            edges: list[tuple[int, int]] = []
            at = 0
            for n in sizes.tolist():
                edges += _linked_stars(fps[at:at + n], coords[at:at + n], max_bits)
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges], pa.int64()),
                 pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])
    return run


def link(fps: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` within ``max_bits`` bits."""
    pivots = [_signed(p) for p in pivot_fingerprints()]
    # So many bits that are left can be cut once more; fewer cannot hold more fingerprints.
    group_rows = max(group_rows, 1 << (max_bits + 1))

    def packed(some: list[int]):
        """Eight distances, one byte each, in a long."""
        total = F.lit(0).cast("long")
        for i, p in enumerate(some):
            total = total.bitwiseOR(F.shiftleft(
                F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        return total

    rows = materialize(fps.select("fp", packed(pivots[:8]).alias("near"),
                                  packed(pivots[8:]).alias("far")), "simhash-pivots")
    masks = F.array(*[F.lit(_signed(m)) for m in _cut(list(range(64)), max_bits + 1)])
    rows = rows.select("*", F.explode(masks).alias("mask"))
    rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    split = F.udf(lambda mask: [_signed((mask & (2 ** 64 - 1)) | m) for m in _cut(
        [i for i in range(64) if not mask >> i & 1], max_bits + 1)], "array<long>")
    edges = None
    while True:
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        large = materialize(sizes.where(F.col("n") > group_rows), "simhash-large")
        hot = large.count()
        fit = rows if not hot else rows.join(large, ["mask", "value"], "left_anti")
        groups = (fit.groupBy("mask", "value")
                  .agg(F.collect_list(F.struct("fp", "near", "far")).alias("members"))
                  .where(F.size("members") > 1).select("members"))
        found = groups.mapInArrow(_group_edges(max_bits), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if not hot:
            return edges.distinct()
        # One Python call per distinct mask of a large group, not per row.
        finer = (large.select("mask").distinct().withColumn("finer", split("mask")))
        rows = rows.join(large.drop("n"), ["mask", "value"], "left_semi").join(
            F.broadcast(finer), "mask").select("fp", "near", "far",
                                               F.explode("finer").alias("mask"))
        rows = materialize(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))),
                           "simhash-finer")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b).

    Large star: every larger neighbour of u moves to the smallest node m near u. Small star: the
    smaller neighbours of u move to their minimum. Minima are aggregated before the shuffle, and
    the joins that follow are ones that adaptive execution may split."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct(), "components")
    tally = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    state = edges.agg(*tally).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v"))
        # A node without larger neighbours keeps its link to the minimum through small star.
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "components")
        now = edges.agg(*tally).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: its id, ``fp`` and ``root`` (the smallest fingerprint that its own one
    reaches, which names the group). Written to the shared folder before the linking starts."""
    ids = materialize(with_fingerprints(docs.select(id_col, text_col), text_col, words=words),
                      "simhash")
    roots = components(link(ids.select("fp").distinct(), max_bits))
    rows = ids.join(roots, ids["fp"] == roots["node"], "left")
    return rows.select(id_col, "fp", F.coalesce("root", "fp").alias("root"))


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    rows = near_duplicates(docs)
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest (id, fingerprint), null
    ids last. Rows that agree in id and fingerprint count as one document."""
    rows = near_duplicates(docs)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    kept = rows.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.fp")
    copies = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__fw_rows"))
    kept = kept.join(copies, kept["doc_id"].eqNullSafe(copies["doc_id"])).select(
        kept["doc_id"].alias("__fw_id"), F.col("fp").alias("__fw_fp"), "__fw_rows")
    kept = materialize(kept, "simhash-kept")
    same = lambda k: docs["doc_id"].eqNullSafe(k["__fw_id"])
    once = kept.where("__fw_rows = 1")
    out = docs.join(once, same(once)).select(*[docs[c] for c in docs.columns])
    repeated = kept.where("__fw_rows > 1")
    if repeated.isEmpty():
        return out
    # Rows that share an id: tell them apart by their fingerprint.
    both = docs.join(repeated, same(repeated))
    both = both.select(*[docs[c] for c in docs.columns], "__fw_fp", F.col("text").alias("__fw_text"))
    marked = with_fingerprints(both, "__fw_text", "__fw_own").where("__fw_own = __fw_fp")
    return out.unionByName(marked.dropDuplicates(["doc_id", "__fw_own"]).select(*docs.columns))
