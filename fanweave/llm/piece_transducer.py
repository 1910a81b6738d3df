"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines compiled from a model file (``transducers.Machine``), joined by composition:

* the normaliser reads the begin of a text and its characters and writes a blank U+2581 for the
  begin and for every blank, any other character as it is;
* the pieces: a trie of all pieces, whose final arcs write the piece's id and lead back to the root;
* byte fallback, at the same root: a character that is no piece by itself is read by an arc that
  writes the id of its first UTF-8 byte, further arcs write those of the others.

Normaliser, pieces and byte fallback are composed once. That machine composed with an input is a
lattice: from every place in the text one arc per way from the root back to the root. Its shortest
path in the tropical semiring (min, +) is the encoding. In a unigram model an arc weighs the piece's
negative score. The scores of a BPE model are ranks of merges and do not add up along a path, so
there a pair automaton is composed in as well: an arc after another weighs 0 if the merges leave the
two pieces side by side, and infinity otherwise. Exactly one path then stays finite, which is the
merge result. Arcs of the pair automaton are made as needed.

No piece joins two characters that are neighbours in no piece, so a text falls into independent
stretches there; each distinct stretch is composed and solved once per Python worker.

Defined results: null text is the empty text, which has no ids; invalid byte runs decode to U+FFFD;
a literal U+2581 decodes to a blank, as in the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from fanweave.llm.common import text_slices
from fanweave.llm.id_table import IdTable
from fanweave.llm.transducers import EPSILON, Machine, compose

VOCABULARY = "piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
BPE = 2
CACHE_PAIRS = 1_000_000
PART_CHARS = 512 << 10
INFINITY = float("inf")
FALLBACK = 1e4                       # weight of a character without a piece in a unigram model
BEGIN = "<begin>"                    # input symbol before the first character of a text
BEGIN_BYTE = b"\xff"                 # its byte in a batch: UTF-8 has none like it


def _symbols(raw: bytes) -> list[str]:
    """Input symbols of a stretch of a batch."""
    return [BEGIN, *raw[1:].decode()] if raw.startswith(BEGIN_BYTE) else list(raw.decode())


class Transducer:
    """The composed transducer of one model."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        self.first_blank = norm.add_dummy_prefix
        self.merges = model.trainer_spec.model_type == BPE
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER)}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces)
                         if p.type == BYTE}
        self.root = 0
        self.steps: dict[tuple[int, str], tuple[int | None, list[tuple[str, list[int]]]]] = {}
        self._compile()
        self._decoder(model)
        self.table = IdTable(lambda some: [self._solve(_symbols(x)) for x in some])
        self.pairs: dict[str, dict[str, float]] = {}
        self.n_pairs = 0

    # --- compilation

    def _normaliser(self) -> Machine:
        m = Machine()
        only = m.state(final=True)
        for symbol in (BEGIN, " "):
            m.add(only, symbol, BLANK, 0.0, only)
        m.rest[only] = lambda symbol: [(symbol, 0.0, only)]
        return m

    def _vocabulary(self) -> Machine:
        """Pieces and byte fallback, from the root back to the root."""
        m = Machine()
        root = m.state(final=True)
        for piece, own in self.ids.items():
            if self.merges and len(piece) > 1 and self._merge(piece) != [piece]:
                continue                      # no merge makes it: all its paths are infinite
            state = root
            for c in piece:
                if c not in m.table[state]:
                    m.add(state, c, EPSILON, 0.0, m.state())
                state = m.table[state][c][0][2]
            m.add(state, EPSILON, own, 0.0 if self.merges else -self.scores[piece], root)

        def by_bytes(c: str) -> list:
            ids = [self.byte_ids.get(b, self.unknown) for b in c.encode()]
            states = [m.state() for _ in ids[1:]]
            for state, own, target in zip(states, ids[1:], [*states[1:], root]):
                m.add(state, EPSILON, own, 0.0, target)
            return [(ids[0], 0.0 if self.merges else FALLBACK, [*states, root][0])]

        for c in list(m.table[root]):         # begins pieces, but is none itself
            if c not in self.ids:
                m.table[root][c] += by_bytes(c)
        m.rest[root] = by_bytes
        return m

    def _compile(self) -> None:
        """The composed machine, and which characters are neighbours in some piece."""
        self.normaliser = self._normaliser()
        self.machine = compose(self.normaliser, self._vocabulary())
        joined = set()
        for piece in self.ids:
            if not self.merges or len(piece) == 1 or self._merge(piece) == [piece]:
                joined.update(zip(piece, piece[1:]))
        self.joined = joined
        if any(a != BLANK and b == BLANK for a, b in joined):
            raise ValueError("pieces that go on after a blank are not supported")
        # Pairs of bytes of a text between which no piece goes on, for a first cut: ASCII pairs,
        # everything before the first of some blanks, and the begin, which counts as a blank.
        self.apart = np.zeros(1 << 16, bool)
        for a in range(128):
            for b in range(128):
                pair = (BLANK if a == 32 else chr(a), BLANK if b == 32 else chr(b))
                self.apart[a * 256 + b] = pair not in joined
        self.apart[128 * 256 + 32::256] = True
        self.apart[255 * 256:] = self.apart[32 * 256:33 * 256]

    def _merge(self, text: str) -> list[str]:
        """The merges of a BPE model on a short string: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], -INFINITY)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _weight(self, before: str, piece: str) -> float:
        """The pair automaton's weight of ``piece`` after ``before``, made on first use."""
        if (before[-1], piece[0]) not in self.joined:
            weight = 0.0
        else:
            weight = 0.0 if self._merge(before + piece) == [before, piece] else INFINITY
        if self.n_pairs > CACHE_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.pairs.setdefault(before, {})[piece] = weight
        self.n_pairs += 1
        return weight

    # --- encoding

    def compose_input(self, stretch: list[str]) -> list[list[tuple[int, str, list[int]]]]:
        """The lattice of a stretch of input symbols: for each place the arcs that end there,
        (begin, piece or character, ids), the longest first. An arc is a way through the composed
        machine from the root back to the root."""
        n, known, root = len(stretch), self.steps, self.root
        ends: list[list[tuple[int, str, list[int]]]] = [[] for _ in range(n + 1)]
        for begin in range(n):
            state, end = root, begin
            while state is not None and end < n:
                symbol = stretch[end]
                end += 1
                try:
                    state, ways = known[state, symbol]
                except KeyError:
                    state, ways = self._step(state, symbol)
                for label, ids in ways:
                    ends[end].append((begin, label, ids))
        return ends

    def _step(self, state: int, symbol: str) -> tuple[int | None, list[tuple[str, list[int]]]]:
        """One symbol on from a state of the composed machine: the state from which longer pieces go
        on, and (piece or character, ids) of the ways that are back at the root without reading more."""
        onward, ways = None, []
        arcs = self.machine.arcs(state, symbol)
        for output, _, back in arcs:
            ids, in_trie = ([], True) if output == EPSILON else ([output], False)
            if in_trie:
                onward = back
            while back != self.root and (free := self.machine.arcs(back, EPSILON)):
                output, _, back = free[0]
                ids.append(output)
            if back == self.root:
                ways.append((self.pieces[ids[0]] if in_trie
                             else self.normaliser.arcs(0, symbol)[0][0], ids))
        if arcs:
            self.steps[state, symbol] = onward, ways
        return onward, ways

    def shortest_path(self, lattice: list[list[tuple[int, str, list[int]]]]) -> list[int]:
        """Ids on the shortest path through a lattice."""
        cost = [0.0] + [INFINITY] * (len(lattice) - 1)
        begins, last = [0] * len(lattice), [""] * len(lattice)
        written: list[list[int]] = [[]] * len(lattice)
        pairs = self.pairs
        for end in range(1, len(lattice)):
            for begin, piece, ids in lattice[end]:
                before = last[begin]
                if not self.merges:
                    arc = -self.scores.get(piece, -FALLBACK)
                elif not before:
                    arc = 0.0
                else:
                    try:
                        arc = pairs[before][piece]
                    except KeyError:
                        arc = self._weight(before, piece)
                if cost[begin] + arc < cost[end]:
                    cost[end], begins[end], last[end] = cost[begin] + arc, begin, piece
                    written[end] = ids
                    if self.merges:           # weights are 0 and infinity: no path is shorter
                        break
        out, end = [], len(lattice) - 1
        while end:
            out.append(written[end])
            end = begins[end]
        return [i for ids in reversed(out) for i in ids]

    def _solve(self, stretch: list[str]) -> np.ndarray:
        """Ids of a stretch of input symbols, cut further where no piece joins its characters."""
        out, begin = [], 0
        shown = [self.normaliser.arcs(0, s)[0][0] for s in stretch]
        for i in range(1, len(stretch) + 1):
            if i == len(stretch) or (shown[i - 1], shown[i]) not in self.joined:
                out += self.shortest_path(self.compose_input(stretch[begin:i]))
                begin = i
        return np.array(out, np.int32)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        first = BEGIN_BYTE if self.first_blank else b""
        plain = [BLANK not in t for t in batch]
        raws = [first + t.encode() if t and p else b"" for t, p in zip(batch, plain)]
        raw = np.frombuffer(b"".join([*raws, b"\0" * 8]), np.uint8)
        n = len(raw) - 8
        begins = np.cumsum([0] + [len(r) for r in raws])
        new = np.zeros(n + 1, bool)
        new[1:n] = self.apart[raw[:n - 1].astype(np.uint16) * np.uint16(256) + raw[1:n]]
        new[begins] = True
        start = np.flatnonzero(new[:n])
        ids, offsets = self.table.lookup(raw, start, np.append(start[1:], n)[:len(start)])
        cuts = offsets[np.searchsorted(start, begins)].tolist()
        return [ids[a:b] if p else self._solve([*([BEGIN] if first else []), *t])
                for t, p, a, b in zip(batch, plain, cuts, cuts[1:])]

    # --- decoding

    def _decoder(self, model) -> None:
        """The inverse transducer as tables: the bytes of every id."""
        raw = []
        for p in model.pieces:
            if p.type == BYTE:
                raw.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type in (CONTROL, UNKNOWN):
                raw.append(b"")
            else:
                raw.append(p.piece.replace(BLANK, " ").encode())
        self.out_len = np.array([len(r) for r in raw], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out_raw = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        n = self.out_len[ids]
        total = int(n.sum())
        at = np.repeat(self.out_at[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        text = self.out_raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.first_blank and text.startswith(" ") else text


@lru_cache(maxsize=1)
def transducer(name: str = VOCABULARY) -> Transducer:
    return Transducer(public_tokenizers.path(name))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = transducer()
    for b in batches:
        docs = b.column("doc_id")
        for at, own in text_slices(b.column("text"), PART_CHARS):
            ids = t.encode(own)
            back = [t.decode(x) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [docs.slice(at, len(own)), pa.array(np.diff(offsets), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                 pa.array([x == y for x, y in zip(back, own)], pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "exact"])


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text, and, decoded from the ids, the SHA-256 of the
    text and whether it is the input again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, exact boolean")
