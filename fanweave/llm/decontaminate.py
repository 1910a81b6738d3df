"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the windows of ten consecutive words of each benchmark item (all words of a shorter
item). Texts are lower-cased, cut into words and joined by single blanks. Search per batch of
documents: a shift table over hashed blocks says how far the window may move; a zero shift selects
the bucket of patterns that end in that block, and direct comparison of the bytes confirms. Many
stretches of the batch move at once, each with its own position, so numpy does the skipping.
Patterns are divided into length classes, so that a one-word item does not shorten the shifts of
the long windows.

The documents are never shuffled. The patterns of one block of items (``block_bytes`` of item text
at most, or one longer item) are broadcast; more items mean more blocks, one pass after the other.

Defined results: null or wordless documents have no words and no hits; an item without words gives
no window; items that share an id count once; a null item id is written as ``null``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fanweave.llm.common import materialize, parts, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
PART_BYTES = 2 << 20                 # text that is searched at once
STRETCH = 1024                       # bytes of text per search position
CLASS_FLOORS = (24, 8, 1)            # shortest pattern of each length class
TABLE_BITS = 18
# Columns that are added to the documents' own ones.
N_WORDS, HIT_BITS, ITEM_IDS = "__fw_n_words", "__fw_hit_bits", "__fw_item_ids"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

# A-Z become a-z; bytes of words stay; all others become a blank.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[~_IS_WORD[_FOLD]] = 0x20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return _WORD.findall(raw.translate(_FOLD.tobytes()))


def windows(words: list[bytes], width: int = WINDOW) -> set[bytes]:
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


class ShiftTable:
    """Shift table and suffix buckets of the patterns of one length class."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m, 3 if m < 24 else 8)
        self.mask = np.uint64((1 << 8 * b) - 1)
        raw = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << TABLE_BITS, min(m - b + 1, 255), np.uint8)
        for j in range(m - b + 1):   # the block that ends m - b - j bytes before the window's end
            code = np.zeros(len(raw), np.uint64)
            for k in range(b):
                code |= raw[:, j + k].astype(np.uint64) << np.uint64(8 * k)
            np.minimum.at(self.shift, self.hash(code), min(m - b - j, 255))
        self.buckets: dict[int, list[bytes]] = {}
        for p, h in zip(patterns, self.hash(code).tolist()):
            self.buckets.setdefault(h, []).append(p)

    def hash(self, code: np.ndarray) -> np.ndarray:
        return ((code * _MULTIPLIER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray) -> list[tuple[int, bytes]]:
        """(start, pattern) of every occurrence in ``text``, which ends in 8 spare bytes."""
        n = len(text) - 8
        if n < self.m:
            return []
        # The eight bytes from any position, as one integer.
        words = np.ndarray((n + 1,), "<u8", text, strides=(1,))
        last = n - self.m + 1
        pos = np.arange(0, last, STRETCH)
        end = np.minimum(pos + STRETCH, last)
        found: list[np.ndarray] = []
        while len(pos):
            h = self.hash(words[pos + (self.m - self.block)] & self.mask)
            step = self.shift[h].astype(np.int64)
            if not step.all():
                zero = step == 0
                found.append(np.stack([pos[zero], h[zero]]))
                step[zero] = 1
            pos = pos + step
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
        if not found:
            return []
        raw = text.tobytes()
        hits = []
        for start, h in zip(*np.concatenate(found, axis=1).tolist()):
            for p in self.buckets.get(h, ()):
                if raw.startswith(p, start):
                    hits.append((start, p))
        return hits


class Searcher:
    def __init__(self, items: list[tuple[object, str | None]], width: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for p in windows(item_words(text), width):
                owners.setdefault(p, set()).add("null" if item is None else str(item))
        self.owners = owners
        self.words = {p: p.count(b" ") + 1 for p in owners}
        self.tables, rest = [], list(owners)
        for floor in CLASS_FLOORS:
            own = [p for p in rest if len(p) >= floor]
            rest = [p for p in rest if len(p) < floor]
            if own:
                self.tables.append(ShiftTable(own))

    def scan(self, data: np.ndarray, off: np.ndarray):
        """n_words per document, word positions hit (one array over all documents, with the
        documents' word offsets), and (document, item) pairs."""
        docs = len(off) - 1
        lens = np.diff(off)
        # One zero byte before each document and at the end keeps words of two documents apart.
        padded = np.zeros(len(data) + docs + 1, np.uint8)
        at = np.arange(len(data)) + np.repeat(np.arange(1, docs + 1), lens)
        padded[at] = _FOLD[data]
        word = padded > 0x20
        end = np.flatnonzero(word[:-1] & ~word[1:])          # last byte of each word
        per_doc = np.searchsorted(end, off + np.arange(docs + 1))
        first = per_doc
        keep = word.copy()
        keep[end + 1] = True
        padded[end + 1] = 0x20
        filled = np.unique(first[1:][np.diff(first) > 0]) - 1
        padded[end[filled] + 1] = 0                          # no pattern reaches past a document
        text = np.concatenate([padded[keep], np.zeros(8, np.uint8)])
        ends = np.flatnonzero(text[:len(text) - 8] <= 0x20)
        marks = np.zeros(len(end) + 1, np.int32)
        pairs: set[tuple[int, str]] = set()
        for t in self.tables:
            for start, p in t.search(text):
                stop = start + len(p)
                if (start and text[start - 1] > 0x20) or text[stop] > 0x20:
                    continue
                w = int(np.searchsorted(ends, start))
                marks[w] += 1
                marks[w + self.words[p]] -= 1
                doc = int(np.searchsorted(first, w, side="right")) - 1
                pairs.update((doc, item) for item in self.owners[p])
        return first, np.cumsum(marks[:-1]) > 0, pairs


def _scan_block(searcher, schema: pa.Schema, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher.value
        for b in batches:
            data, off = text_bytes(b.column(text_col))
            items: dict[int, set[str]] = {}
            hits: list[np.ndarray] = []
            for s, e in parts(np.diff(off), PART_BYTES):
                first, hit, pairs = search.scan(data[off[s]:off[e]], off[s:e + 1] - off[s])
                hits += [hit[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                for doc, item in pairs:
                    items.setdefault(s + doc, set()).add(item)
            old_bits = b.column(HIT_BITS).to_pylist()
            old_items = b.column(ITEM_IDS).to_pylist()
            bits, ids = [], []
            for d in range(b.num_rows):
                h = hits[d]
                if old_bits[d]:
                    h = h | np.unpackbits(np.frombuffer(old_bits[d], np.uint8),
                                          count=len(h)).astype(bool)
                bits.append(np.packbits(h).tobytes() if h.any() else b"")
                ids.append(sorted(items.get(d, set()) | set(old_items[d])))
            done = {HIT_BITS: pa.array(bits, pa.binary()),
                    ITEM_IDS: pa.array(ids, pa.list_(pa.string())),
                    N_WORDS: pa.array([len(h) for h in hits], pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [done.get(f, b.column(f) if f in b.schema.names else None) for f in schema.names],
                names=schema.names)
    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Driver-side blocks of items, each of a bounded size, read one after the other."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    total = rows.select(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield n, [(r["i"], r["t"]) for r in part.collect()]


def find_overlaps(docs: DataFrame, items: DataFrame, *, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with three more columns: ``N_WORDS``, ``HIT_BITS`` (one bit per word, empty if
    none is hit) and ``ITEM_IDS`` (sorted ids of the items with an occurring window)."""
    spark = docs.sparkSession
    out = (docs.withColumn(N_WORDS, F.lit(0).cast("long")).withColumn(HIT_BITS, F.lit(b""))
           .withColumn(ITEM_IDS, F.expr("cast(array() as array<string>)")))
    schema: StructType = out.schema
    names = pa.schema([(f.name, pa.null()) for f in schema.fields])
    for n, block in _item_blocks(items, item_id_col, item_text_col, block_bytes):
        searcher = spark.sparkContext.broadcast(Searcher(block, width))
        out = out.mapInArrow(_scan_block(searcher, names, text_col), schema)
        if n > 1:
            out = materialize(out, "overlaps")
    return out


def overlap_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = find_overlaps(docs.select("doc_id", "text"), items)
    return found.select(
        F.col("doc_id"), F.col(N_WORDS).alias("n_words"),
        _set_bits(HIT_BITS).alias("n_hit"),
        F.size(ITEM_IDS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEM_IDS, ","), 256).alias("items_sha256"),
        (F.octet_length(HIT_BITS) > 0).alias("contaminated"))


def _set_bits(column: str):
    """Number of set bits of a binary column."""
    digits = F.hex(column)
    weight = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
    return sum((F.length(digits) - F.length(F.translate(digits, chars, ""))) * k
               for k, chars in weight.items()).cast("long")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a hit word, with the columns of ``docs``."""
    found = find_overlaps(docs, items)
    return found.where(F.octet_length(HIT_BITS) == 0).select(*docs.columns)
