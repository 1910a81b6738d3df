"""Prefix trie of conversations, by collapsing whole sequences.

A conversation is its turns (role, text) in order; a node of depth d stands for one distinct
sequence of d turns, the root for none. A turn sequence is known by a chain of SHA-256 digests, so
each prefix of a conversation has a key of fixed size and no text is moved again once it is hashed.

Identical conversations collapse first: one weighted sequence with the list of conversations that
end there. Sequences that are proper prefixes of others are set apart by an anti-join; what is left
are the leaves. Only distinct sequences are expanded into prefixes, and their weights are summed
per key, so the work follows the distinct turns, and a common first turn is added up map-side.

A node's subtree sum needs no pairs of nodes and ancestors. Each node is owned by its smallest
member. What a sequence owns is the lower end of its own path, so a sequence adds its whole total to
every prefix that it does not own, and a running sum from its end to every prefix that it owns.

Defined results: null role and text are empty; rows of one conversation and turn come in the order
of role and text, repeated rows count each time; rows without a conv_id belong to no conversation;
without conversations there is no root. The turns of one conversation pass through one task, sorted
and spilled by Spark and hashed as a stream; end lists are cut into blocks of ids in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanweave.llm.common import materialize

HEADS = 6                          # a rebuilt conversation takes up to HEADS - 1 foreign turns
HUNDRED = 100
BLOCK_BITS = 12                    # an end list's block: the conv_ids of one run of 4,096 numbers
ROOT = hashlib.sha256(b"").digest()
EMPTY_LIST = hashlib.sha256(b"").hexdigest()


@dataclass
class Trie:
    """nodes: key, parent (key), depth, conv_id, n_convs, n_leaves, n_children, saved_tokens.
    ends: key, block, ids: the conversations that end in a node, in blocks of ascending ids."""
    nodes: DataFrame
    ends: DataFrame


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): the turns of every conversation, counted from 0."""
    rows = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    line = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select(
        "conv_id", (F.row_number().over(line) - 1).cast("long").alias("pos"),
        F.unhex(F.sha2(said, 256)).alias("digest"), F.length("text").cast("long").alias("chars"))


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): conversation c begins with the first h turns of c - c % 100, h =
    crc32(c) % 6, and goes on with its own turns after the first h. No hundred has more than 199
    conversations, so the heads meet no hot key."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    convs = turns.where("pos = 0").select("conv_id")
    heads = turns.where(F.col("pos") < HEADS - 1).select(
        F.col("conv_id").alias("base"), "pos", "digest", "chars")
    taken = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"),
                         h.alias("h")).join(heads, "base").where("pos < h")
    own = turns.where(F.col("pos") >= h)
    return convs, taken.select(*turns.columns).unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and position -> a prefix for each of them. ``last`` marks the
    whole sequence; it is known when the next turn is seen, so one row is held back."""
    names = ["conv_id", "depth", "key", "parent", "chars", "last"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    held: list = []
    out: list[list] = []

    def done():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return batch

    for b in batches:
        for conv, digest, chars in zip(b.column("conv_id").to_pylist(),
                                       b.column("digest").to_pylist(),
                                       b.column("chars").to_pylist()):
            same = bool(held) and held[0] == conv
            if held:
                held[5] = not same
                out.append(held)
            parent, depth = (held[2], held[1]) if same else (ROOT, 0)
            held = [conv, depth + 1, hashlib.sha256(parent + digest).digest(), parent, chars, True]
        if out:
            yield done()
    if held:
        out.append(held)
        yield done()


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of end lists sorted by key and block -> the digest of each whole list."""
    key, state = None, None
    for b in batches:
        found = []
        for own, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if own != key:
                if key is not None:
                    found.append((key, state.hexdigest()))
                key, state, glue = own, hashlib.sha256(), ""
            state.update((glue + ids).encode())
            glue = ","
        yield _digest_rows(found)
    if key is not None:
        yield _digest_rows([(key, state.hexdigest())])


def _digest_rows(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in found], pa.binary()), pa.array([d for _, d in found], pa.string())],
        names=["key", "ends_sha256"])


def list_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of each end list, decimal ids in ascending order and commas."""
    joined = ends.select("key", "block", F.array_join(F.col("ids").cast("array<string>"), ",")
                         .alias("ids"))
    return joined.repartition("key").sortWithinPartitions("key", "block").mapInArrow(
        _list_digests, "key binary, ends_sha256 string")


def build(convs: DataFrame, turns: DataFrame) -> Trie:
    """The trie of conversations (conv_id) with turns (conv_id, pos, digest, chars)."""
    chained = materialize(
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(
            _chain, "conv_id long, depth long, key binary, parent binary, chars long, last boolean"),
        "trie-prefixes")

    # Identical conversations collapse into one weighted sequence.
    whole = chained.where("last").select("conv_id", "key")
    final = materialize(convs.join(whole, "conv_id", "left").select(
        "conv_id", F.coalesce("key", F.lit(ROOT)).alias("key")), "trie-final")
    sequences = materialize(final.groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("rep")), "trie-sequences")
    block = F.shiftright("conv_id", BLOCK_BITS)
    ends = final.groupBy("key", block.alias("block")).agg(
        F.array_sort(F.collect_list("conv_id")).alias("ids"))

    # Distinct sequences expand into prefixes; those that prolong no other are the leaves.
    paths = chained.join(sequences.select(F.col("rep").alias("conv_id"), "weight"), "conv_id")
    inner = paths.where("not last").select("key").unionByName(
        paths.where("depth = 1").select(F.lit(ROOT).alias("key"))).distinct()
    leaves = sequences.join(inner, "key", "left_anti").select(
        F.col("rep").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    roots = sequences.select(
        F.col("rep").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"), "weight")
    paths = materialize(paths.drop("last").unionByName(roots).join(leaves, "conv_id", "left"),
                        "trie-paths")
    nodes = materialize(paths.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.min("chars").alias("chars")), "trie-nodes")

    # Subtree sums: what a sequence owns is the lower end of its path.
    value = (F.col("n_convs") - 1) * F.col("chars")
    totals = nodes.groupBy("conv_id").agg(F.sum(value).alias("total"))
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, 0)
    own = nodes.select("key", F.sum(value).over(upward).alias("below"),
                       F.sum(value).over(Window.partitionBy("conv_id")).alias("total"))
    through = paths.join(totals, "conv_id").groupBy("key").agg(F.sum("total").alias("through"))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(own, "key").join(through, "key").join(children, "key", "left").select(
        "key", "parent", "depth", "conv_id", "n_convs", "n_leaves",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        (F.col("through") - F.col("total") + F.col("below")).alias("saved_tokens"))
    return Trie(materialize(nodes, "trie-sums"), materialize(ends, "trie-ends"))


def node_report(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations, one row each."""
    turns = materialize(ordered_turns(rows), "trie-turns")
    trie = build(*spliced(turns))
    parents = trie.nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (trie.nodes.join(list_digests(trie.ends), "key", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_LIST))
                    .alias("ends_sha256")))
