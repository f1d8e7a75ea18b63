"""Exact dedup of incoming batches against immutable snapshots, screened by binary fuse filters.

Texts are equal when they agree byte for byte without ASCII white space. A snapshot is a table of
its distinct digests, dealt into shards, with one static 3-wise binary fuse filter of each shard's
digests. A new batch is first grouped by itself, so a text with millions of copies goes on as one
row; its distinct digests are screened by the filters of their shards, and only what a filter
can't rule out joins the snapshot's exact buckets, where the texts are compared byte for byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE_BYTES
from millrace.plans.scratch import materialise

SHARD_ROWS = 250_000
LEAST_SHARDS = 64
#: Classes with more than a 500th of all rows are broadcast; tables below LEAST_ROWS have none.
HEAVY_SHARE = 500
LEAST_ROWS = 10_000


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of keys and seed."""
    h = keys + np.uint64(seed & (2**64 - 1))
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Static set filter with 8-bit fingerprints: no false negatives, about 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots of each hash, in three neighbouring segments."""
        mask = np.uint64(segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print_of(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """keys: distinct unsigned 64-bit integers."""
        n = max(len(keys), 2)
        segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-room // segment) - 2)
        for seed in range(1, 200):
            h = _mixed(keys, seed * 0x9E3779B97F4A7C15)
            if (order := cls._peel(h, segment, segments)) is not None:
                break
            segments += seed % 10 == 0  # a little more room for odd small sets
        else:
            raise ValueError("no binary fuse filter fits these keys")
        prints = np.zeros((segments + 2) * segment, np.uint8)
        slots = cls._slots(h, segment, segments)
        for which, slot in reversed(order):
            three = slots[:, which]
            # the slot itself still holds 0, so the xor over all three is that of the other two
            prints[slot] = cls._print_of(h[which]) ^ np.bitwise_xor.reduce(prints[three], axis=0)
        return cls(seed, segment, segments, prints)

    @classmethod
    def _peel(cls, h: np.ndarray, segment: int, segments: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, slot that only this key still uses); None if some keys remain."""
        slots, size, left, order = cls._slots(h, segment, segments), (segments + 2) * segment, np.arange(len(h)), []
        while len(left):
            used = np.bincount(slots[:, left].ravel(), minlength=size)
            alone = used[slots[:, left]] == 1
            free = alone.any(axis=0)
            if not free.any():
                return None
            which = left[free]
            order.append((which, slots[np.argmax(alone[:, free], axis=0), which]))
            left = left[~free]
        return order

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys, self.seed * 0x9E3779B97F4A7C15)
        return np.bitwise_xor.reduce(self.prints[self._slots(h, self.segment, self.segments)], axis=0) == self._print_of(h)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        return cls(*np.frombuffer(data[:24], "<i8").tolist(), np.frombuffer(data[24:], np.uint8))


@dataclass
class Snapshot:
    """groups: shard, key, sha, keep_points, keep_id, n. filters: shard, filter. Neither changes."""

    groups: DataFrame
    filters: DataFrame
    shards: int


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE_BYTES)


def digests(docs: DataFrame, id_col: str, text_col: str, mark: Column) -> DataFrame:
    """doc_id, mark, points (code points of the text), sha (of the normalised text), key (its first 8 bytes)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            shas = [hashlib.sha256(t.translate(None, SPACE_BYTES)).digest() for t in texts.cast(pa.binary()).to_pylist()]
            keys = np.frombuffer(b"".join(s[:8] for s in shas), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.utf8_length(texts).cast(pa.int64()), pa.array(shas, pa.binary()), pa.array(keys)], ["doc_id", "mark", "points", "sha", "key"])

    return docs.select(id_col, mark.alias("_mark"), text_col).mapInArrow(hashed, f"doc_id {id_type}, mark boolean, points bigint, sha binary, key bigint")


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays (most points, then smallest id) and how many there are."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").alias("i")))
    return rows.groupBy("key", "sha").agg(best.alias("_best"), F.count("*").alias("n")).select("key", "sha", (-F.col("_best.p")).alias("keep_points"), F.col("_best.i").alias("keep_id"), "n")


def build_snapshot(rows: DataFrame, n_rows: int) -> Snapshot:
    """rows: as digests() gives them, n_rows of them at most."""
    shards = max(LEAST_SHARDS, -(-n_rows // SHARD_ROWS))
    groups = materialise(grouped(rows).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")), "snapshot")

    def build(table: pa.Table) -> pa.Table:
        # a shard holds distinct digests, dealt evenly: its size is bounded by SHARD_ROWS, near enough
        keys = np.unique(table["key"].to_numpy().view(np.uint64))
        return pa.table({"shard": table["shard"][:1].cast(pa.int32()), "filter": pa.array([FuseFilter.build(keys).to_bytes()], pa.binary())})

    filters = materialise(groups.select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, filter binary"), "filters")
    return Snapshot(groups, filters, shards)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """groups with ``maybe``: false where the filters show that the snapshot lacks the digest."""
    dealt = groups.withColumn("shard", F.pmod("key", F.lit(snapshot.shards)).cast("int"))
    columns = dealt.columns

    def probe(batch: pa.Table, filters: pa.Table) -> pa.Table:
        keys = batch["key"].to_numpy().view(np.uint64)
        hit = FuseFilter.from_bytes(filters["filter"][0].as_py()).maybe(keys) if filters.num_rows else np.zeros(len(keys), bool)
        return batch.select(columns).append_column("maybe", pa.array(hit, pa.bool_()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", maybe boolean"
    return dealt.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInArrow(probe, schema)


def same_bytes(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pairs (key, sha, old_id, new_id) whose two texts agree byte for byte: their key and sha.

    One join brings the texts of just the rows that stand for a digest; each digest has two. Rows are found
    by id and digest: other texts can share the id, and null ids are many.
    """
    ends = F.array_distinct(F.array(F.col("old_id"), F.col("new_id")))
    needed = pairs.select("key", "sha", F.explode(ends).alias("_id"))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")
    texts = docs.select(F.col(id_col).alias("_doc"), text.alias("_text")).withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    texts = texts.join(needed, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("sha")))
    both = texts.groupBy("key", "sha").agg(F.min("_text").alias("_a"), F.max("_text").alias("_b"))
    return both.filter(F.col("_a") == F.col("_b")).select("key", "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_snapshot: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    in_snapshot says which rows make up the snapshot, the others being the incoming batch; by
    default a hash of the id halves the table. Of equal texts the one with the most code points
    stays, then the smallest id (null first). A null text is an empty one, and all empty texts
    are equal. The id names a row: rows that repeat an id stay or go together. An empty table
    gives an empty result.
    """
    mark = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0 if in_snapshot is None else F.coalesce(in_snapshot, F.lit(False))
    rows = materialise(digests(docs, id_col, text_col, mark), "digests")
    n_rows = rows.count()
    snapshot = build_snapshot(rows.filter("mark"), n_rows)
    fresh = materialise(screen(grouped(rows.filter("not mark")), snapshot), "screened")

    old = snapshot.groups.select("key", "sha", F.col("keep_id").alias("old_id"))
    pairs = fresh.filter("maybe").select("key", "sha", F.col("keep_id").alias("new_id")).join(old, ["key", "sha"])
    verified = materialise(same_bytes(pairs, docs, id_col, text_col), "verified").withColumn("_same", F.lit(True))
    # digests that agree while their texts don't stay apart, by batch
    fresh = fresh.join(verified, ["key", "sha"], "left").select("key", "sha", "keep_points", "keep_id", "n", F.lit(False).alias("mark"), (~F.coalesce("_same", F.lit(False))).alias("apart"))
    both = snapshot.groups.select("key", "sha", "keep_points", "keep_id", "n", F.lit(True).alias("mark"), F.lit(False).alias("apart")).unionByName(fresh)
    best = F.min(F.struct((-F.col("keep_points")).alias("p"), F.col("keep_id").alias("i")))
    classes = both.groupBy("key", "sha", "apart").agg(best.alias("_best"), F.sum("n").alias("group_size"), F.collect_set("mark").alias("_marks"))
    classes = materialise(classes.select("sha", F.explode("_marks").alias("mark"), F.col("_best.i").alias("keep_id"), "group_size"), "classes")

    # heavy classes, at most 2 * HEAVY_SHARE rows, are broadcast; no other key has many rows
    heavy = F.broadcast(classes.filter(F.col("group_size") * HEAVY_SHARE >= n_rows)) if n_rows >= LEAST_ROWS else None
    if heavy is None:
        out = rows.join(classes, ["sha", "mark"])
    else:
        light = classes.filter(F.col("group_size") * HEAVY_SHARE < n_rows)
        out = rows.join(heavy, ["sha", "mark"]).unionByName(rows.join(heavy.select("sha", "mark"), ["sha", "mark"], "left_anti").join(light, ["sha", "mark"]))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
