"""Counting neighbouring words of texts with one shuffle of packed pairs.

A task counts equal pairs of some million bytes of text and sends them, sorted and packed, to the part of their hash;
a part holds its packed pairs only. Words are what the table of bytes leaves between blanks.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task packs at a time, and those of a part.
PACKED, PART_BYTES = 12_000_000, 12_000_000
#: Lower-cased runs of ASCII letters; every byte of another character is a blank.
ASCII_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = "key string, pat string, cnt bigint, pats bigint, total bigint, squares decimal(38,0)"


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Texts of PACKED bytes together, or one longer text."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary()).drop_null()
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < len(column):
            upto = max(int(np.searchsorted(ends, ends[at] + PACKED - size, "right")) - 1, at + (not size))
            if upto > at:
                held.append(column.slice(at, upto - at))
                size += int(ends[upto] - ends[at])
            at = upto
            if at < len(column) or size >= PACKED:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pairs(texts: list[pa.Array], letters: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words, and of the distinct pairs in order: first words, second words, counts."""
    column = pa.concat_arrays(texts)
    _, ends, data = column.buffers()
    clean = pa.LargeStringArray.from_buffers(len(column), ends, pa.py_buffer((data.to_pybytes() if data else b"").translate(letters)), None, 0, column.offset)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean))
    words = lists.flatten().dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int64)
    code = ids[:-1] * len(words.dictionary) + ids[1:]
    lasts = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1] - 1
    keep = np.ones(len(code), bool)
    keep[lasts[(lasts >= 0) & (lasts < len(code))]] = False
    code = code[keep]
    code.sort()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    a, b = np.divmod(code[first], max(len(words.dictionary), 1))
    return words.dictionary, a, b, np.diff(np.append(first, len(code)))


def _packed(words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    spelt = [w.encode() for w in words.to_pylist()]
    hashes = np.array([zlib.crc32(w) for w in spelt], np.uint64)
    part = ((hashes[a] * np.uint64(2654435761) + hashes[b] * np.uint64(40503)) >> np.uint64(7)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    a, b, n, part = a[order], b[order], n[order], part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
    for i, j in zip(cuts, cuts[1:], strict=False):
        used, places = np.unique(np.concatenate([a[i:j], b[i:j]]), return_inverse=True)
        places, counts = places.astype(np.min_scalar_type(len(used))), n[i:j].astype(np.min_scalar_type(int(n[i:j].max())))
        yield int(part[i]), zlib.compress(pickle.dumps((b" ".join([spelt[u] for u in used.tolist()]), places, counts)), 1)


def _merged(blobs: list[pa.Buffer]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a part, and its distinct pairs in the order of their first words' numbers, with their counts."""
    names, places, counts, at = [], [], [], 0
    for blob in blobs:
        known, own, n = pickle.loads(zlib.decompress(blob))
        names.append(pc.split_pattern(pa.array([known.decode()], pa.large_string()), " ").flatten())
        places.append(own.astype(np.int32).reshape(2, -1) + np.int32(at))
        at += len(names[-1])
        counts.append(n.astype(np.int64))
    words = pa.concat_arrays(names).dictionary_encode()
    ids = words.indices.to_numpy()
    del names
    code = np.concatenate([ids[own[0]].astype(np.int64) * len(words.dictionary) + ids[own[1]] for own in places])
    del places
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    a, b = np.divmod(code[first], len(words.dictionary))
    return words.dictionary.cast(pa.string()), a, b, np.add.reduceat(np.concatenate(counts)[order], first)


def _rows(words: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "pat", "cnt", "pats", "total", "squares"]
    none = lambda k, kind: pa.nulls(k, kind)
    often = np.flatnonzero(n > least)
    for at in range(0, len(often), 50_000):
        own = often[at : at + 50_000]
        k = len(own)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(a[own])), words.take(pa.array(b[own])), pa.array(n[own]), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.decimal128(38, 0))], names)
    first = np.flatnonzero(np.diff(a, prepend=-1))
    pats, total = np.diff(np.append(first, len(a))), np.add.reduceat(n, first)
    squares = np.add.reduceat(n.astype(object) ** 2, first) if int(n.max()) > 1_000_000 else np.add.reduceat(n * n, first)
    for at in range(0, len(first), 50_000):
        to = slice(at, at + 50_000)
        k = len(first[to])
        yield pa.RecordBatch.from_arrays([words.take(pa.array(a[first[to]])), none(k, pa.string()), none(k, pa.int64()), pa.array(pats[to]), pa.array(total[to]), pa.array(squares[to].tolist(), pa.int64() if squares.dtype != object else pa.decimal128(38, 0)).cast(pa.decimal128(38, 0))], names)


def neighbours(rows: DataFrame, text: str = "text", least: int = 5, letters: bytes = ASCII_WORDS) -> DataFrame:
    """(key, pat, cnt, pats, total, squares) of the words that follow a word in the same text.

    One row for each pair met more than ``least`` times, with cnt; and, with pat null, rows for each key that hold in
    parts the number of its pairs, rare ones too, the sum of their counts and that of their squares.
    """
    parts = 1 + (rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0) // PART_BYTES

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches):
            for part, blob in _packed(*_pairs(texts, letters), parts):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                if part != of and blobs:
                    yield from _rows(*_merged(blobs), least)
                    blobs = []
                of = part
                blobs.append(blob.as_buffer())
        if blobs:
            yield from _rows(*_merged(blobs), least)

    packed = rows.select(text).mapInArrow(pack, "part int, blob binary")
    return packed.repartition(min(parts, 2000), "part").sortWithinPartitions("part").mapInArrow(count, SCHEMA)
