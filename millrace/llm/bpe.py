"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Any place of a piece may begin a token, so reading byte by byte, a set of nodes in the trie of tokens is
under way. Determinising such sets gives one state for each node of the trie: the longest token part
under way names its set, as the others are its suffixes. Transitions are made when first met.

A token may follow another only if merging their bytes by rank gives back just these two, and the
encoding of a prefix is an encoding of a shorter prefix and one token that may follow: so among the
tokens that end in a state, just one may follow what its place of beginning ended with. The
transducer keeps that token for the places it may still need, the bytes of its lookahead. What all
tokens under way agree on is emitted; the lookahead is bounded by the longest token, save where two
encodings run on side by side.

States are at most the trie's nodes; the tables of transitions and of pairs that may follow have
bounds and start anew when full. Every piece goes through the transducer.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import held

#: White space of the Unicode property, as the pattern's \s means it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Places kept before tokens that are agreed on are emitted.
_LOOKAHEAD = 512
_MOST_MOVES = 200_000
_MOST_PIECES = 150_000
_MOST_PAIRS = 250_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a line for each token, base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def _ranges(kind: str, upto: int) -> str:
    """Regular-expression ranges of the characters whose general category starts with kind."""
    out, start = [], None
    for c in range(upto + 2):
        inside = c <= upto and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def splitter(astral: bool = False) -> re.Pattern:
    """The pattern that splits text before merging, for Python's re.

    Without astral, only for texts of the basic plane: its classes are one bitmap each then.
    """
    upto = sys.maxunicode if astral else 0xFFFF
    letter, number = _ranges("L", upto), _ranges("N", upto)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Transducer:
    """Encodes pieces of bytes by the ranks of their merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._child: dict[int, int] = {}  # node << 8 | byte: node
        self._token, self._parent, self._byte, self._depth = [-1], [0], [0], [0]  # of each node
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self._child.get(node << 8 | byte) or self._grow(node, byte)
            self._token[node] = rank
        self._size = {rank: len(token) for token, rank in ranks.items()}
        self._follows: dict[int, bool] = {}  # left token << 17 | right token
        self._moves: dict[int, int] = {}  # state << 8 | byte: state
        self._ends: dict[int, tuple[tuple[int, int], ...]] = {}  # of a state: size and rank of the tokens that end in it
        self._suffix: dict[int, int] = {0: 0}  # of a node: that of its longest proper suffix

    def _grow(self, node: int, byte: int) -> int:
        for of_node, value in ((self._token, -1), (self._parent, node), (self._byte, byte), (self._depth, self._depth[node] + 1)):
            of_node.append(value)
        self._child[node << 8 | byte] = len(self._token) - 1
        return len(self._token) - 1

    def merge(self, piece: bytes) -> list[int]:
        """BPE by definition: always the leftmost pair of the lowest rank. Quadratic; for token pairs."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank_of = self.ranks.get
        costs = [rank_of(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while costs and (rank := min(costs)) < 1 << 60:
            at = costs.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank_of(parts[at - 1] + parts[at], 1 << 60)
            if at < len(costs):
                costs[at] = rank_of(parts[at] + parts[at + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether right can come after left; -1 stands for the start of the piece."""
        known = self._follows.get(left << 17 | right)
        if known is None:
            if left < 0:
                known = self.merge(self.tokens[right]) == [right]
            else:
                known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self._follows) >= _MOST_PAIRS:
                self._follows.clear()
            self._follows[left << 17 | right] = known
        return known

    def _suffix_of(self, node: int) -> int:
        if node not in self._suffix:
            parent = self._parent[node]
            self._suffix[node] = self._move(self._suffix_of(parent), self._byte[node]) if parent else 0
        return self._suffix[node]

    def _move(self, state: int, byte: int) -> int:
        """Makes the transition from a state on a byte: the longest part that goes on, or the byte alone."""
        node = state
        while (to := self._child.get(node << 8 | byte)) is None:
            if not node:
                raise ValueError(f"no token for byte {byte}")
            node = self._suffix_of(node)
        if len(self._moves) >= _MOST_MOVES:
            self._moves.clear()
        self._moves[state << 8 | byte] = to
        if to not in self._ends:
            found, node = [], to
            while node:
                if self._token[node] >= 0:
                    found.append((self._depth[node], self._token[node]))
                node = self._suffix_of(node)
            self._ends[to] = tuple(found)
        return to

    def _agreed(self, last: list[int], state: int) -> int:
        """The furthest place that the encodings of all places under way go through."""
        places = set(range(len(last) - 1 - self._depth[state], len(last)))
        while len(places) > 1:
            at = max(places)
            places.remove(at)
            places.add(at - self._size[last[at]])
        return places.pop()

    def _upto(self, last: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= self._size[last[at]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        out, last, state, room = [], [-1], 0, _LOOKAHEAD
        moves, ends, known = self._moves.get, self._ends, self._follows.get
        for byte in piece:
            to = moves(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            # last[-size] is the last token before the place where a token of that size began
            for size, token in ends[state]:
                fits = known(last[-size] << 17 | token)
                if fits or fits is None and self.follows(last[-size], token):
                    break
            else:
                raise ValueError(f"no token ends with byte {byte}")
            last.append(token)
            if len(last) > room:
                at = self._agreed(last, state)
                out += self._upto(last, at)
                last = last[at:]
                room = len(last) + _LOOKAHEAD
        return out + self._upto(last, len(last) - 1)


class Encoder:
    """Texts to ids, as 4-byte little-endian integers; encodings of pieces are kept in a bounded table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.transducer = Transducer(ranks)
        self.decoder = Decoder(self.transducer.tokens)
        self._basic, self._full = splitter().findall, None
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= _MOST_PIECES:
                    self.clear()
                packed = np.array(outer.transducer.encode(piece.encode()), "<u4").tobytes()
                if len(piece) < 64:
                    self[piece] = packed
                return packed

        self._pieces = Pieces()

    def encode(self, text: str, astral: bool = True) -> bytes:
        """astral: whether the text may hold characters beyond the basic plane; few do, and splitting them is slow."""
        if astral and goes_beyond(text):
            if self._full is None:
                self._full = splitter(astral=True).findall
            return b"".join(map(self._pieces.__getitem__, self._full(text)))
        return b"".join(map(self._pieces.__getitem__, self._basic(text)))


class Utf8Stream:
    """Incremental UTF-8 state machine: feed it bytes cut anywhere, it gives text as soon as it is whole.

    Its state is the head of a character whose other bytes are still to come, 3 bytes at most.
    """

    def __init__(self) -> None:
        self.head = b""

    def feed(self, data: bytes) -> str:
        data = self.head + data
        whole = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                if (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > back:
                    whole -= back
                break
            if lead < 0x80:
                break
        self.head = data[whole:]
        return data[:whole].decode("utf-8")

    def close(self) -> None:
        if self.head:
            raise ValueError("the stream ends within a character")


class Decoder:
    """Packed ids to text, block by block, through the UTF-8 state machine."""

    def __init__(self, tokens: dict[int, bytes]):
        count = max(tokens, default=-1) + 1
        self._length = np.array([len(tokens.get(i, b"")) for i in range(count)], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(count)), np.uint8)

    def raw(self, ids: bytes) -> bytes:
        """The bytes of the ids' tokens."""
        which = np.frombuffer(ids, "<u4")
        length = self._length[which]
        shift = self._start[which] - (np.cumsum(length) - length)
        return self._bytes[np.arange(length.sum()) + np.repeat(shift, length)].tobytes()

    def stream(self, ids: bytes, block: int = 65536) -> Iterator[str]:
        state = Utf8Stream()
        for at in range(0, len(ids), 4 * block):
            yield state.feed(self.raw(ids[at : at + 4 * block]))
        state.close()


def encoder_for(ranks: bytes) -> Encoder:
    """The encoder of a rank file; a worker process keeps it for its next tasks."""
    return held(f"bpe {hashlib.sha256(ranks).hexdigest()}", lambda: Encoder(read_ranks(ranks)))


def goes_beyond(text: str) -> bool:
    """Whether a text holds characters beyond the basic plane, whose UTF-8 begins with F0 to F4."""
    return not text.isascii() and any(lead in data for data in [text.encode()] for lead in (b"\xf0", b"\xf1", b"\xf2", b"\xf3", b"\xf4"))


def has_astral(texts: pa.Array) -> bool:
    """Whether any string of an Arrow array goes beyond the basic plane (a lead byte of F0 or more)."""
    data = texts.buffers()[-1]
    if data is None or not len(texts):
        return False
    return bool((np.frombuffer(data, np.uint8) >= 0xF0).any())


def encode_documents(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the packed ids.

    Each document is encoded and decoded in its own row: no shuffle, and memory of one batch. A
    null text counts as empty and has no ids. The rank file is read by the driver and sent to
    the executors as it is (its size doesn't depend on the data).
    """
    with open(ranks_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks.value)
        for batch in batches:
            astral = has_astral(batch.column(1))
            rows = []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "", astral)
                decoded = hashlib.sha256()
                for part in encoder.decoder.stream(ids):
                    decoded.update(part.encode())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), *[ids] * keep_ids))
            columns = list(zip(*rows, strict=True)) or [[]] * (3 + keep_ids)
            types = [pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_ids]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return docs.select(id_col, text_col).mapInArrow(encoded, schema)
