"""Token-id archive: one zstandard frame per document under a shared dictionary.

A dictionary is trained on the serialized id arrays (little-endian uint32) of a sample of documents
and stored beside the data. Documents are encoded where they are scanned; only compressed frames
are shuffled, into buckets of consecutive ids. A block (about ``BLOCK_BYTES``) is one binary value:

    magic, version, SHA-256 of the dictionary, number of documents,
    index: id present (u8), id (i64), frame offset (u64), token count (u64) per document,
    frames

Blocks are rows of a Parquet table with their id range beside them, so that a reader of one document
reads one block and decompresses one frame. A block made with another dictionary is refused.

Defined results: null text is empty (only the end id); documents come in ascending id order, null
ids first, rows of one id in the order of their content; special-token strings inside a text are
encoded as the library does by default.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fanweave.llm.common import scratch_path, text_slices
from fanweave.llm.id_table import IdTable

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
DICTIONARY_BYTES = 64 * 1024
TRAIN_DOCS = 1000                   # bound of the sample that the dictionary is trained on
BLOCK_BYTES = 512 << 10
PART_CHARS = 512 << 10              # characters that are encoded at once
ZSTD_LEVEL = 1
BUCKET_DOCS = 20_000
MAGIC = b"TIDA"
_HEAD = "<4sI32sQ"
BLOCKS = ("bucket int, block int, min_id long, max_id long, docs long, tokens long, data binary")

# Texts of these characters only can be cut into pre-tokens by _CLASS exactly as the tokenizer does
# it (no apostrophe, no special token, letters that stay letters); others go to the library whole.
_OTHER = re.compile(
    "[^\t\n\r -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|<\\|")
# Classes of the bytes of such a text, lower-cased: 0 blank, 1 letter, 2 digit, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0, 9, 10, 13, 32]] = 0
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x30:0x3A] = 2


class WordEncoder:
    """Encodes whole texts; the library sees every distinct pre-token once, words in long joined
    calls. The ids of a text are those of its pre-tokens in order."""

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.closes[i] = piece.endswith("</w>")
        self.table = IdTable(self._solve)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.int32)

    def _solve(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of pre-tokens. One call of the library takes many, put apart by blanks: a pre-token
        ends with an id that closes a word."""
        out: list[np.ndarray] = []
        for at in range(0, len(tokens), 2000):
            some = [t.decode() for t in tokens[at:at + 2000]]
            ids = self._whole(" ".join(some))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                cuts = [0, *ends.tolist()]
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += [self._whole(w) for w in some]
        return out

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        plain = [not _OTHER.search(t) for t in batch]
        raws = [t.lower().encode() if p else b"" for t, p in zip(batch, plain)]
        # A zero byte ends each text; eight more are spare.
        raw = np.frombuffer(b"\0".join([*raws, b"\0" * 8]), np.uint8)
        kind = _CLASS[raw[:-8]]
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(kind))
        token = kind[begin] > 0
        begin, stop = begin[token], stop[token]
        ids, offsets = self.table.lookup(raw, begin, stop)
        first = np.cumsum([0] + [len(r) + 1 for r in raws])
        cuts = offsets[np.searchsorted(begin, first)].tolist()
        return [ids[a:b] if p else self._whole(t)
                for t, p, a, b in zip(batch, plain, cuts, cuts[1:])]


@lru_cache(maxsize=1)
def encoder(name: str = VOCABULARY) -> WordEncoder:
    return WordEncoder(public_tokenizers.path(name))


def _with_end(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes() + struct.pack("<I", END_ID)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> bytes:
    """Dictionary bytes from a sample of at most about ``train_docs`` documents, chosen by the
    hash of their text; empty if the sample is too small to train on."""
    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(n, 1))) < train_docs) \
        if n > train_docs else docs

    def run(batches):
        for b in batches:
            for _, part in text_slices(b.column("text"), PART_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_with_end(x)[:1 << 14] for x in encoder().encode(part)],
                              pa.binary())], names=["ids"])

    samples = sorted(r[0] for r in chosen.select("text").mapInArrow(run, "ids binary")
                     .limit(2 * train_docs).collect())
    try:
        return zstandard.train_dictionary(
            min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _encode(dictionary: bytes, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zd = _dictionary(dictionary)
        if zd is not None:
            zd.precompute_compress(level=ZSTD_LEVEL)
        z = zstandard.ZstdCompressor(level=ZSTD_LEVEL, dict_data=zd)
        for b in batches:
            for at, part in text_slices(b.column("text"), PART_CHARS):
                rows = b.slice(at, len(part))
                ids = rows.column("doc_id")
                known = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                bucket = np.searchsorted(bounds, known, side="right").astype(np.int32)
                bucket[ids.is_null().to_numpy(zero_copy_only=False)] = -1
                arrays = [_with_end(x) for x in encoder().encode(part)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(bucket), pa.array([len(a) // 4 for a in arrays], pa.int64()),
                     pa.array([z.compress(a) for a in arrays], pa.binary())],
                    names=["doc_id", "bucket", "n", "frame"])
    return run


def _pack(dictionary: bytes):
    """Blocks from frames that come sorted by (bucket, id)."""
    digest = hashlib.sha256(dictionary).digest()

    def block(bucket: int, no: int, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        ids = np.array([r[0] or 0 for r in rows], "<i8")
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        data = b"".join([
            struct.pack(_HEAD, MAGIC, 1, digest, n),
            np.array([r[0] is not None for r in rows], np.uint8).tobytes(), ids.tobytes(),
            (np.cumsum(sizes) - sizes).astype("<u8").tobytes(),
            np.array([r[1] for r in rows], "<u8").tobytes(), *[r[2] for r in rows]])
        known = [r[0] for r in rows if r[0] is not None]
        values = [bucket, no, min(known, default=None), max(known, default=None), n,
                  sum(r[1] for r in rows), data]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                 pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds)],
            names=["bucket", "block", "min_id", "max_id", "docs", "tokens", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, bucket, no = [], 0, None, 0
        for b in batches:
            for doc, own, n, frame in zip(*[b.column(c).to_pylist() for c in
                                            ("doc_id", "bucket", "n", "frame")]):
                if rows and (own != bucket or size >= BLOCK_BYTES):
                    yield block(bucket, no, rows)
                    rows, size, no = [], 0, no + 1
                if own != bucket:
                    bucket, no = own, 0
                rows.append((doc, n, frame))
                size += len(frame)
        if rows:
            yield block(bucket, no, rows)
    return run


def write_archive(docs: DataFrame, path: str) -> None:
    """Encode (doc_id, text) and write ``path``/dictionary and ``path``/blocks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dictionary = train(docs)
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())],
                          "dictionary binary, sha256 string").coalesce(1).write.parquet(
        f"{path}/dictionary")
    n = max(1, -(-docs.count() // BUCKET_DOCS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    frames = docs.mapInArrow(_encode(dictionary, bounds),
                             "doc_id long, bucket int, n long, frame binary")
    frames = frames.repartition("bucket").sortWithinPartitions(
        "bucket", F.col("doc_id").asc_nulls_first(), "n", "frame")
    frames.mapInArrow(_pack(dictionary), BLOCKS).write.parquet(f"{path}/blocks")


def _parse(data: bytes, expected: bytes):
    magic, version, digest, n = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token-id block")
    if digest != expected:
        raise ValueError("the block was written with another dictionary")
    at = struct.calcsize(_HEAD)
    known = np.frombuffer(data, np.uint8, n, at)
    ids = np.frombuffer(data, "<i8", n, at + n)
    offsets = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    counts = np.frombuffer(data, "<u8", n, at + 17 * n).astype(np.int64)
    base = at + 25 * n
    return known, ids, np.append(offsets + base, len(data)), counts


def _decode(dictionary: bytes):
    """Rows of decoded documents. With ``wanted`` only those ids are decompressed."""
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for b in batches:
            for bucket, block, data in zip(b.column("bucket").to_pylist(),
                                           b.column("block").to_pylist(), b.column("data")):
                data = data.as_py()
                known, ids, offsets, counts = _parse(data, digest)
                crcs = np.empty(len(ids), np.int64)
                sizes = np.empty(len(ids), np.int64)
                for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    raw = z.decompress(data[s:e])
                    crcs[i], sizes[i] = zlib.crc32(raw), len(raw) // 4
                if (sizes != counts).any():
                    raise ValueError("a frame does not match the index")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=known == 0), pa.array(np.full(len(ids), bucket, np.int32)),
                     pa.array(np.full(len(ids), block, np.int32)),
                     pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crcs)],
                    names=["doc_id", "bucket", "block", "within", "n_tokens", "ids_crc32"])
    return run


def _read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return bytes(row["dictionary"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks.

    ``start`` adds three sums: of the buckets before (one number per bucket, on the driver), of
    the bucket's blocks before, and of the block's documents before."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = {r["bucket"]: r["t"] for r in blocks.groupBy("bucket").agg(
        F.sum("tokens").alias("t")).collect()}
    before, base = 0, []
    for bucket in sorted(totals):
        base.append((bucket, before))
        before += totals[bucket]
    base = spark.createDataFrame(base, "bucket int, base long")
    order = Window.partitionBy("bucket").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    index = blocks.select("bucket", "block", F.coalesce(F.sum("tokens").over(order), F.lit(0))
                          .alias("earlier")).join(base, "bucket")
    rows = blocks.mapInArrow(
        _decode(_read_dictionary(spark, path)),
        "doc_id long, bucket int, block int, within long, n_tokens long, ids_crc32 long")
    return rows.join(index, ["bucket", "block"]).select(
        "doc_id", (F.col("base") + F.col("earlier") + F.col("within")).alias("start"),
        "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (one list per row of that id): reads the blocks whose id range
    holds it and decompresses its frames only."""
    dictionary = _read_dictionary(spark, path)
    digest, z = hashlib.sha256(dictionary).digest(), zstandard.ZstdDecompressor(
        dict_data=_dictionary(dictionary))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(
        (F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id)).orderBy("bucket", "block")
    found = []
    for row in blocks.select("data").toLocalIterator():
        data = bytes(row["data"])
        known, ids, offsets, _ = _parse(data, digest)
        for i in np.flatnonzero((ids == doc_id) & (known == 1)):
            found.append(np.frombuffer(z.decompress(data[offsets[i]:offsets[i + 1]]),
                                       "<u4").tolist())
    return found


def archive_documents(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to a fresh archive in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_archive(docs, path)
    return read_archive(docs.sparkSession, path)
