"""Content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash of the last ids says so, so equal
passages give equal chunks wherever they stand. The store's folder holds three Parquet tables:

chunks    digest, n_ids, ids      each distinct chunk once, ids as 2- or 4-byte little-endian integers
recipes   doc_id, start, n_tokens, digests, root    in ascending doc_id order; root: Merkle root of digests
manifest  part, first_id, n_docs, n_tokens, root    Merkle root of each part's recipes: root, id, start and length, in order

Reading verifies every chunk against its digest, every recipe against its root and every part against the manifest.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import _SPACE
from millrace.llm.common import held
from millrace.llm.words import mix
from millrace.plans.scratch import materialise

#: A boundary falls where the hash of the last WINDOW ids has MASK bits clear.
WINDOW, MASK, LEAST, MOST = 16, 0x3FF, 256, 8192
END = 0
_FACTOR = 0x9E3779B97F4A7C15
_OF_ID = mix(np.arange(1, 1 + (1 << 16), dtype=np.uint64))
_MOST_PIECES = 600_000
_MOST_LONG = 100_000
#: Characters of texts that are encoded together.
_CHARACTERS = 250_000
#: New pieces in one of the strings that the library is given.
_IN_BLOCK = 100
_BETWEEN = re.compile(r"(?<=\S)[ \n](?=\S)")
_KINDS = dict.fromkeys(("Lu", "Ll", "Lt", "Lm", "Lo"), 0) | dict.fromkeys(("Nd", "Nl", "No"), 1) | {"Cn": 5}
#: What may follow an apostrophe within a piece, as code points, and the size of the piece.
_SUFFIX = {suffix.encode("utf-32-le"): 1 + len(suffix) for suffix in ("s", "t", "re", "ve", "m", "ll", "d")}
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: A byte that UTF-8 never holds.
_NO_BYTE = 0xFF


def cut(ids: np.ndarray) -> list[int]:
    """End positions of the chunks of a stream of ids."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_OF_ID[ids & 0xFFFF], out=sums[1:])
    # at the place that ends a window, a hash of the sum over its ids, and so of these ids alone
    rolling = (sums[WINDOW:] - sums[:-WINDOW]) * np.uint64(_FACTOR) >> np.uint64(40)
    marks = np.flatnonzero((rolling & np.uint64(MASK)) == 0) + WINDOW
    ends, start = [], 0
    for mark in marks.tolist():
        while mark - start > MOST:
            start += MOST
            ends.append(start)
        if mark - start >= LEAST and mark < n:
            ends.append(mark)
            start = mark
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, n]


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree over digests; an odd one out goes up as it is."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=16).digest() for d in digests] or [b"\0" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def digest_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def _byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers use for each byte: printable Latin-1 for itself, the others from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xA0 and b != 0xAD]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


@functools.cache
def _kinds() -> np.ndarray:
    """Of every character: 0 for letters, 1 for numbers, 2 for other ones, 3 for white space, 5 for those that Python's tables lack."""
    space = re.compile(f"[{_SPACE}]")
    out = np.array([_KINDS.get(unicodedata.category(chr(c)), 2) for c in range(sys.maxunicode + 1)], np.uint8)
    out[[c for c in range(1 << 16) if space.match(chr(c))]] = 3
    return out


def piece_starts(points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pattern that splits texts begins a piece, for texts one after the other.

    points: code points, with one more of any value after each text; kinds: theirs, changed here; ends: the places
    after texts, which are pieces too.
    """
    kinds[ends] = 4
    starts = np.ones(len(kinds), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    starts[ends] = True
    # white space before something else: its last character stands alone, or goes with what follows if it is a blank
    last = np.flatnonzero((kinds[:-1] == 3) & (kinds[1:] < 3))
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    for at in np.flatnonzero((points == 0x27) & starts & (kinds == 2)).tolist():
        size = _SUFFIX.get(points[at + 1 : at + 2].tobytes()) or _SUFFIX.get(points[at + 1 : at + 3].tobytes())
        if size:
            starts[at + 1 : at + size] = False
            starts[at + size] = True
    return starts


class _Table:
    """Packed ids of pieces: of those of at most 24 bytes and four ids in rows, found many at a time.

    A row has three words of a piece's bytes and the ids, with FF in the bytes of ids that a piece lacks.
    """

    def __init__(self, width: int, most: int):
        self.width, self.most, self.n = width, most, 0
        self._bits = max(4, (2 * most - 1).bit_length())
        self._rows = np.empty((1 << self._bits, 3 + width // 2), np.uint64)
        self.clear()

    def clear(self) -> None:
        self._rows[:, :3], self._rows[:, 3:], self.n = 0, _ALL, 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * _FACTORS[0] + keys[:, 1] * _FACTORS[1] + keys[:, 2] * _FACTORS[2]
        mixed ^= mixed >> np.uint64(32)
        return (mixed * _FACTORS[3] >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ids of each key's row, all FF where it has none."""
        slots, last = self._first(keys), (1 << self._bits) - 1
        rows = self._rows.take(slots, axis=0)
        left = np.flatnonzero(((rows[:, 0] != keys[:, 0]) | (rows[:, 1] != keys[:, 1]) | (rows[:, 2] != keys[:, 2])) & (rows[:, 3] != _ALL))
        slots = slots[left]
        while len(left):
            slots = slots + 1 & last
            got, wanted = self._rows.take(slots, axis=0), keys[left]
            rows[left] = got
            on = ((got[:, :3] != wanted).any(axis=1)) & (got[:, 3] != _ALL)
            left, slots = left[on], slots[on]
        return np.ascontiguousarray(rows[:, 3:])

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Distinct keys that have no row yet."""
        if self.n + len(keys) > self.most:
            self.clear()
            keys, ids = keys[: self.most], ids[: self.most]
        self.n += len(keys)
        new, slots, last = np.concatenate([keys, ids], axis=1), self._first(keys), (1 << self._bits) - 1
        while len(new):
            free = self._rows[slots, 3] == _ALL
            self._rows[slots[free]] = new[free]
            on = (self._rows[slots] != new).any(axis=1)
            new, slots = new[on], slots[on] + 1 & last


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct piece.

    A byte-level BPE tokenizer hands the pieces of its pre-tokenizer to its model one by one, so the ids of a
    text are those of its pieces. The ids of pieces met before are kept in bounded tables; new ones go to the
    library many in a call. Texts that hold the string of an added token, or a character that Python's tables
    lack, go through the library as they are, and so does every text if the tokenizer is of another kind.
    """

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(file_text)
        setup = json.loads(file_text)
        before, model = setup.get("pre_tokenizer") or {}, setup["model"]
        self._by_piece = setup.get("normalizer") is None and model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        #: bytes of an id, and their code in arrays. No id has a highest byte of FF: FF in each byte is a gap and found nowhere else.
        self.width, code = (2, "H") if self._tokenizer.get_vocab_size() <= 0xFE00 else (4, "I")
        self._pack = lambda ids: array(code, ids).tobytes()
        self._gap = b"\xff" * self.width
        self._no_id, self._end = (1 << 8 * self.width) - 1, (1 << 8 * self.width) - 2
        self._short, self._long = _Table(self.width, _MOST_PIECES), {}
        self._characters = _byte_characters()
        self._table = "".join(self._characters[b] for b in range(256))
        if self._by_piece:
            # the same model without a splitter; a character that no merge takes keeps pieces apart
            self._model = Tokenizer(self._tokenizer.model)
            self._barrier, vocab = self._characters[_NO_BYTE], self._model.get_vocab()
            whole = vocab.keys() >= set(self._characters.values()) and not any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
            self._together = whole and sum(self._barrier in token for token in vocab) == 1

    def encode(self, text: str) -> bytes:
        """Ids packed in ``width`` bytes each."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The packed ids of each text, in order."""
        group: list[str] = []
        n = 0
        for text in texts:
            whole = not self._by_piece or any(t in text for t in self._added)
            if whole or n + len(text) > _CHARACTERS:
                yield from self._encode_group(group)
                group, n = [], 0
            if whole:
                yield self._whole(text)
            elif len(text) > _CHARACTERS:
                yield b"".join(packed for part in _parts(text) for packed in self._encode_group([part]))
            else:
                group.append(text)
                n += len(text)
        yield from self._encode_group(group)

    def _whole(self, text: str) -> bytes:
        return self._pack(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts, whose pieces are looked up together."""
        if not texts:
            return []
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(text) + 1 for text in texts]) - 1
        kinds = _kinds()[points]
        if kinds.max() > 3:  # the library's tables may be newer than Python's
            odd = {*np.searchsorted(ends, np.flatnonzero(kinds > 3)).tolist()}
            rest = iter(self._encode_group([text for i, text in enumerate(texts) if i not in odd]))
            return [self._whole(text) if i in odd else next(rest) for i, text in enumerate(texts)]
        starts = np.flatnonzero(piece_starts(points, kinds, ends))
        data = joined.encode()
        at = starts
        if len(data) > len(points):
            before = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.uint8), out=before[1:])
            at = before[starts]
        sizes = np.diff(at, append=len(data))
        padded = data + bytes(32)
        words = np.ndarray((len(data) + 24,), "<u8", padded, strides=(1,))
        keys = np.empty((len(at), 3), np.uint64)
        for k in range(3):
            keys[:, k] = words[at + 8 * k] & _MASKS[np.clip(sizes - 8 * k, 0, 8)]
        ids = self._short.find(keys).view(f"<u{self.width}")
        if (long := sizes > 24).any():
            ids[long] = self._no_id
        if b"\0" in data:  # keys do not tell trailing zeros from missing bytes
            ids[np.frombuffer(data, np.uint8)[at + sizes - 1] == 0] = self._no_id
        sentinels = np.searchsorted(starts, ends)
        ids[sentinels, 0] = self._end
        ids[sentinels, 1:] = self._no_id
        has = ids != self._no_id
        gaps = np.flatnonzero(~has[:, 0])
        has[gaps, 0] = True
        row = ids[has]
        bounds = np.flatnonzero(row == self._end) * self.width
        packed = row.tobytes()
        out = [packed[a:b] for a, b in zip([0, *(bounds + self.width).tolist()], bounds.tolist(), strict=False)]
        if not len(gaps):
            return out
        stops = np.append(starts, len(joined))[gaps + 1]
        pieces = [joined[a:b] for a, b in zip(starts[gaps].tolist(), stops.tolist(), strict=True)]
        answers = self._answers(pieces, gaps, keys, sizes)
        filled, start = [], 0
        for stream in out:
            runs = stream.split(self._gap)
            if len(runs) > 1:
                both = [b""] * (2 * len(runs) - 1)
                both[::2], both[1::2] = runs, [answers[piece] for piece in pieces[start : start + len(runs) - 1]]
                start, stream = start + len(runs) - 1, b"".join(both)
            filled.append(stream)
        return filled

    def _answers(self, pieces: list[str], gaps: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> dict[str, bytes]:
        """The packed ids of pieces that have no row; those that may have one get it."""
        first = dict(zip(reversed(pieces), reversed(gaps.tolist()), strict=True))
        answers = {piece: self._long[piece] for piece in first if piece in self._long}
        new = [piece for piece in first if piece not in answers]
        asked = dict(zip(new, self._ask(new), strict=True)) if new else {}
        most = 4 * self.width
        short = [piece for piece in new if sizes[first[piece]] <= 24 and len(asked[piece]) <= most and piece[-1] != "\0"]
        if short:
            ids = np.frombuffer(b"".join(asked[piece].ljust(most, b"\xff") for piece in short), "<u8").reshape(len(short), -1)
            self._short.add(keys[[first[piece] for piece in short]], ids)
        if len(self._long) >= _MOST_LONG:
            self._long.clear()
        kept = set(short)
        self._long.update((piece, packed) for piece, packed in asked.items() if piece not in kept and len(piece) < 64)
        return answers | asked

    def _ask(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece, from the library."""
        shown = [codecs.charmap_decode(piece.encode(), "strict", self._table)[0] for piece in pieces]
        if not self._together:
            return [self._pack([t.id for t in self._tokenizer.model.tokenize(piece)]) for piece in shown]
        # a long string costs the library's queue of merges more for each byte than a short one
        blocks = [self._barrier.join(shown[k : k + _IN_BLOCK]) for k in range(0, len(shown), _IN_BLOCK)]
        barrier, ids = self._model.token_to_id(self._barrier), []
        for block in self._model.encode_batch_fast(blocks, add_special_tokens=False):
            ids += block.ids
            ids.append(barrier)
        row = np.array(ids, f"<u{self.width}")
        packed, bounds = row.tobytes(), (np.flatnonzero(row == barrier) * self.width).tolist()
        return [packed[a:b] for a, b in zip([0, *(x + self.width for x in bounds)], bounds, strict=False)]


def _parts(text: str) -> Iterator[str]:
    """A long text in parts, cut before single blanks and line ends, where a piece begins whatever surrounds it. A text without these stays whole."""
    start = 0
    while start < len(text):
        cut_at = _BETWEEN.search(text, start + _CHARACTERS)
        end = cut_at.start() if cut_at else len(text)
        yield text[start:end]
        start = end


def _encoder(file_text: str) -> LibraryEncoder:
    # a task has its core to itself: the library starts no threads
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(f"library {hashlib.sha256(file_text.encode()).hexdigest()}", lambda: LibraryEncoder(file_text))


def write_store(docs: DataFrame, tokenizer_file: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append END, and write the store to a new folder.

    A null text counts as empty: its stream is END alone. Rows that repeat an id follow one another
    in an arbitrary but harmless order. The string of an added token, such as an end mark, becomes that
    token's id, as the library has it. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        file_text = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for each chunk that this task hasn't met yet."""
        encoder, met = _encoder(file_text.value), set()
        width, end_mark = encoder.width, END.to_bytes(encoder.width, "little")
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, max(1, whole.num_rows), 500)):
                chunks: list[tuple[bytes, int, bytes]] = []
                recipes = []
                for ids in encoder.encode_all((text.as_py() or "" for text in batch.column(1))):
                    stream = ids + end_mark
                    digests, start = [], 0
                    for end in cut(np.frombuffer(stream, f"<u{width}")):
                        data = stream[start * width : end * width]
                        digests.append(digest_of(data))
                        if digests[-1] not in met:
                            if len(met) > 1_000_000:
                                met.clear()
                            met.add(digests[-1])
                            chunks.append((digests[-1], end - start, data))
                        start = end
                    recipes.append((len(stream) // width, b"".join(digests), merkle(digests)))
                n, m = len(recipes), len(chunks)
                ids_col = pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([True] * n + [False] * m), ids_col,
                        pa.array([r[0] for r in recipes] + [c[1] for c in chunks], pa.int64()),
                        pa.array([r[1] for r in recipes] + [c[0] for c in chunks], pa.binary()),
                        pa.array([r[2] for r in recipes] + [c[2] for c in chunks], pa.binary()),
                    ],
                    ["recipe", "doc_id", "n", "digest", "data"],
                )

    rows = docs.select(id_col, text_col).mapInArrow(encoded, f"recipe boolean, doc_id {id_type}, n bigint, digest binary, data binary")
    # one pass encodes; documents (a few bytes a chunk) and chunks part ways afterwards
    both = materialise_by_kind(rows)
    chunks = both.filter("not recipe").select("digest", F.col("n").alias("n_ids"), F.col("data").alias("ids"))
    chunks.repartition(F.col("digest")).dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    # ascending order without one task for all: ranges of ids, sums by range, running sums within
    recipes = both.filter("recipe").select("doc_id", F.col("n").alias("n_tokens"), F.col("digest").alias("digests"), F.col("data").alias("root"))
    ranges = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root")).withColumn("part", F.spark_partition_id())
    ranges = materialise(ranges, "ranges")
    parts = ranges.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_tokens").over(before), F.lit(0))).select(F.col("part").alias("_part"), "_offset")
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of the shuffle
    placed = ranges.join(F.broadcast(parts), F.col("part") == F.col("_part")).withColumn("start", F.col("_offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed.select("part", "doc_id", "start", "n_tokens", "digests", "root").sortWithinPartitions("part", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")

    sealed_parts(spark, path).write.parquet(f"{path}/manifest")


def sealed_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, first_id, n_docs, n_tokens, root of each part, from the recipes. A part is whole within a task."""
    from pyspark.sql.pandas.types import to_arrow_type

    written = spark.read.parquet(f"{path}/recipes").select("part", "doc_id", "n_tokens", "root", "start")
    id_type, arrow_id = written.schema["doc_id"].dataType.simpleString(), to_arrow_type(written.schema["doc_id"].dataType)

    def sealed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part, first_id, n_tokens, leaves):
            values = [part, first_id, len(leaves), n_tokens, merkle(leaves)]
            types = [pa.int32(), arrow_id, pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["part", "first_id", "n_docs", "n_tokens", "root"])

        now, first_id, n_tokens, leaves = None, None, 0, []
        for batch in batches:
            for part, doc_id, n, root, start in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now:
                    if leaves:
                        yield row(now, first_id, n_tokens, leaves)
                    now, first_id, n_tokens, leaves = part, doc_id, 0, []
                n_tokens += n
                leaves.append(digest_of(root + f"{doc_id} {start} {n}".encode()))
        if leaves:
            yield row(now, first_id, n_tokens, leaves)

    return written.repartition(F.col("part")).sortWithinPartitions("part", "start").mapInArrow(sealed, f"part int, first_id {id_type}, n_docs bigint, n_tokens bigint, root binary")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise where the recipes are not those that the manifest was made of."""
    names = ["part", "first_id", "n_docs", "n_tokens", "root"]
    both = sealed_parts(spark, path).select(*names, F.lit(1).alias("side")).unionByName(spark.read.parquet(f"{path}/manifest").select(*names, F.lit(2).alias("side")))
    # one row for each part of the shuffle
    wrong = both.groupBy(*names).agg(F.sum("side").alias("sides"), F.count("*").alias("n")).filter("sides <> 3 or n <> 2")
    if not wrong.isEmpty():
        raise ValueError("the recipes do not match the manifest")


def materialise_by_kind(rows: DataFrame) -> DataFrame:
    """The encoder's rows as a scratch table whose two kinds are read apart."""
    from millrace.plans.scratch import new_path

    path = new_path(rows.sparkSession, "encoded")
    rows.write.option("compression", "zstd").partitionBy("recipe").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@functools.lru_cache(4096)
def _shift(n_bytes: int) -> tuple[int, ...]:
    """What n_bytes zero bytes do to a crc32 without its final xor: images of the 32 single bits."""
    if n_bytes == 0:
        return tuple(1 << i for i in range(32))
    if n_bytes == 1:
        out = []
        for i in range(32):
            c = 1 << i
            for _ in range(8):
                c = c >> 1 ^ 0xEDB88320 * (c & 1)
            out.append(c)
        return tuple(out)
    half = _shift(n_bytes // 2)
    twice = tuple(_apply(half, c) for c in half)
    return tuple(_apply(_shift(1), c) for c in twice) if n_bytes % 2 else twice


def _apply(images: tuple[int, ...], c: int) -> int:
    out = 0
    while c:
        low = c & -c
        out ^= images[low.bit_length() - 1]
        c ^= low
    return out


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two strings of bytes one after the other, from those of each."""
    return _apply(_shift(second_bytes), first) ^ second


def verified_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, n_ids, crc32 (of the ids as 4-byte integers) of each chunk, read back and checked."""

    def checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for digest, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest_of(data) != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{len(data) // max(n, 1)}").astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["digest", "n_ids", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("digest", "n_ids", "ids").mapInArrow(checked, "digest binary, n_ids bigint, crc bigint")


def recipe_entries(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each recipe: doc_id, start, n_tokens, root, seq, digest."""
    recipes = spark.read.parquet(f"{path}/recipes")
    last = F.expr("cast(length(digests) div 16 as int) - 1")
    return recipes.withColumn("seq", F.explode(F.sequence(F.lit(0), last))).withColumn("digest", F.expr("substring(digests, seq * 16 + 1, 16)")).drop("digests", "part")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    Every chunk is read and checked once, however many documents share it; a document's crc32 is
    put together from its chunks', and its root is compared with the recipe's. A document's
    chunks meet in one row; the longest document bounds it.
    """
    verify_manifest(spark, path)
    chunks = materialise(verified_chunks(spark, path), "verified")
    facts = recipe_entries(spark, path).join(chunks, "digest", "left").withColumn("fact", F.struct("seq", "digest", F.coalesce("n_ids", F.lit(-1)).alias("n"), "crc"))
    # the start tells rows apart that repeat an id
    one = facts.groupBy("start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    id_type = one.schema["doc_id"].dataType.simpleString()

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            flat = lists.flatten()
            digests, ns, parts = flat.field("digest").to_pylist(), flat.field("n").to_pylist(), flat.field("crc").to_pylist()
            crcs = []
            for n, root, a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), ends, ends[1:], strict=False):
                if merkle(digests[a:b]) != root or min(ns[a:b]) < 0 or sum(ns[a:b]) != n:
                    raise ValueError("a recipe does not match its chunks")
                crc = parts[a]
                for k in range(a + 1, b):
                    crc = crc32_join(crc, parts[k], 4 * ns[k])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return one.select("doc_id", "start", "n_tokens", "root", "facts").mapInArrow(summed, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of int): every document put together from its chunks."""
    verify_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", F.col("ids").alias("data"), "n_ids")
    facts = recipe_entries(spark, path).join(chunks, "digest").groupBy("start", "doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "n_ids", "data"))).alias("facts"))
    id_type = facts.schema["doc_id"].dataType.simpleString()

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = []
            for root, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if merkle([p["digest"] for p in parts]) != root or any(digest_of(p["data"]) != p["digest"] for p in parts):
                    raise ValueError("a document does not match its recipe")
                streams.append(np.concatenate([np.frombuffer(p["data"], f"<u{len(p['data']) // p['n_ids']}").astype("<i4") for p in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(streams, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return facts.mapInArrow(joined, f"doc_id {id_type}, start bigint, ids array<int>")
