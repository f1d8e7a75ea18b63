"""Substring dedup: seed and extend on winnowed anchors.

A passage counts as repeated if it has WINDOW words at least and begins in an earlier document too.
Seeds: of every WINDOW words, winnowing picks the run of GRAM words with the least hash, so documents
that share a passage share an anchor in it, at the same place. Documents meet on their anchors.

Extension: all windows that hold an anchor lie within REACH words of it to either side. Occurrences
of an anchor with the same surroundings are one class, however many there are; a class takes the
smallest document of its occurrences as the source of all its windows. Where an anchor has several
classes, the seed is extended both ways at once: window k reaches k words to the left of the anchor and the
rest to the right, and classes of the anchor that agree on it have one hash for it. A match thus
takes 64 bits of the anchor's words and 64 of the window's, at the same place, so chance matches
stay out at any size of corpus. The windows found extend over neighbouring anchors into maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix, run_hashes, running, word_hashes
from millrace.plans.scratch import materialise

WINDOW = 50
GRAM = 18
REACH = WINDOW - GRAM


class Runs:
    """Hashes of any run of words of one document, from running sums modulo 2**64."""

    def __init__(self, text: bytes):
        self.words = text.split()
        self.sums = running(mix(word_hashes(self.words)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(run_hashes(self.sums, starts, ends) + (ends - starts).astype(np.uint64))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def anchors(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: runs of GRAM words that are least in some window."""
    n = len(runs.words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    h = runs.hashes(at, at + GRAM)
    width = REACH + 1
    least = _least(h, width)
    # the largest of the minima of the windows around a place equals its hash if it is least in one
    none = np.zeros(width - 1, np.uint64)
    around = ~_least(~np.concatenate([none, least, none]), width)
    chosen = np.flatnonzero(around == h)
    return chosen, h[chosen]


def _long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each anchor: doc_id, at, anchor, around (hash of its surroundings), left, right (their words)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, max(1, whole.num_rows), 500)):
                parts, which = [], []
                for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    runs = Runs(text or b"")
                    at, h = anchors(runs)
                    if len(at):
                        left = np.minimum(REACH, at)
                        right = np.minimum(REACH, len(runs.words) - GRAM - at)
                        around = mix(runs.hashes(at - left, at + GRAM + right) + (left * (REACH + 1) + right).astype(np.uint64))
                        parts.append((at, _long(h), _long(around), left, right))
                        which.append(np.full(len(at), k))
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
                ids = batch.column(0).take(pa.array(np.concatenate(which) if which else np.zeros(0, np.int64)))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.int8()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c).cast(t) for c, t in zip(cols, types, strict=True))], ["doc_id", "at", "anchor", "around", "left", "right"])

    return docs.select(id_col, text_col).mapInArrow(found, f"doc_id {id_type}, at int, anchor bigint, around bigint, left tinyint, right tinyint")


def window_hashes(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Windows around the anchor of each class: anchor, around, k (words to the left), window (hash), source.

    classes: anchor, around, left, right, source, at. Each source is read once for all its classes;
    their number is bounded by its length.
    """
    asked = classes.groupBy("source").agg(F.collect_list(F.struct("anchor", "around", "at", "left", "right")).alias("asked"))
    texts = docs.select(F.col(id_col).alias("source"), F.col(text_col).alias("text")).filter("source is not null and text is not null")
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 200) for k in range(0, max(1, whole.num_rows), 200)):
                out = []
                for n, (text, asked) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    runs = Runs(text)
                    anchor, around, at, left, right = (np.array([a[f] for a in asked], np.int64) for f in ("anchor", "around", "at", "left", "right"))
                    k = np.arange(REACH + 1)
                    row, k = np.nonzero((k <= left[:, None]) & (REACH - k <= right[:, None]))
                    start = at[row] - k
                    good = (start >= 0) & (start + WINDOW <= len(runs.words))  # an id that is repeated may bring another text
                    row, k, start = row[good], k[good], start[good]
                    out.append((np.full(len(row), n), anchor[row], around[row], k, _long(runs.hashes(start, start + WINDOW))))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]).cast(pa.int8()), pa.array(cols[4])], ["source", "anchor", "around", "k", "window"])

    return asked.join(texts, "source").select("source", "text", "asked").mapInArrow(hashed, f"source {id_type}, anchor bigint, around bigint, k tinyint, window bigint")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows that begin in an earlier document too: doc_id, spans (array of (at, mask)).

    Bit k of a span's mask stands for the window that begins k words before the anchor at ``at``.
    """
    found = materialise(occurrences(docs, id_col, text_col).filter("doc_id is not null"), "anchors")
    classes = found.groupBy("anchor", "around", "left", "right").agg(F.min("doc_id").alias("source"), F.min_by("at", "doc_id").alias("at"), F.max("doc_id").alias("last"))
    ends = classes.groupBy("anchor").agg(F.min("source").alias("_first"), F.max("last").alias("_last"), F.count("*").alias("_classes")).filter("_first < _last")
    classes = materialise(classes.join(ends, "anchor").drop("_first", "_last"), "classes")

    # across the classes of an anchor: the smallest document with the same window
    several = classes.filter("_classes > 1")
    windows = materialise(window_hashes(docs, several, id_col, text_col), "windows")
    shared = ["anchor", "k", "window"]
    # a table of its own: the join with it can be split where a passage has very many surroundings
    earliest = materialise(windows.groupBy(*shared).agg(F.min("source").alias("first"), F.max("source").alias("_most")).filter("first < _most").drop("_most"), "earliest")
    # for each class: the windows whose earliest document comes before the class's own source
    across = windows.join(earliest, shared).filter("first < source").groupBy("anchor", "around").agg(F.collect_set("k").alias("across"))
    # occurrences after their class's source have all the windows their surroundings hold
    reach = "cast(aggregate(sequence(0, {r}), 0L, (m, k) -> if(k <= left and {r} - k <= right, m | shiftleft(1L, cast(k as int)), m)) as bigint)".format(r=REACH)
    sources = materialise(classes.join(across, ["anchor", "around"], "left").select("anchor", "around", "left", "right", "source", F.expr(reach).alias("whole"), F.expr("aggregate(coalesce(across, array()), 0L, (m, k) -> m | shiftleft(1L, cast(k as int)))").alias("before"), F.coalesce("last", "source").alias("last")).filter("last > source or before <> 0"), "sources")
    hits = found.join(sources, ["anchor", "around", "left", "right"])
    # an occurrence in the source itself can only repeat what other classes have from before it
    mask = F.when(F.col("doc_id") > F.col("source"), F.col("whole")).otherwise(F.col("before"))
    hits = hits.select("doc_id", "at", mask.alias("mask")).filter("mask <> 0")
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("at", "mask")).alias("spans"))


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        at = np.array([s["at"] for s in spans], np.int64)
        mask = np.array([s["mask"] for s in spans], np.int64)
        row, k = np.nonzero((mask[:, None] >> np.arange(REACH + 1)) & 1)
        start = at[row] - k
        start = np.unique(start[(start >= 0) & (start + WINDOW <= n)])
        edge[start] += 1
        edge[start + WINDOW] -= 1
    return np.cumsum(edge)[:n] > 0


def maximal(n: int, spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal repeats as (first word, number of words)."""
    edge = np.diff(np.concatenate([[0], covered(n, spans).view(np.int8), [0]]))
    return [(int(a), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, repeats, and with keep_text the kept text.

    repeats: the maximal repeats removed, as an array of (at, n) in words. Kept words are joined by one
    space. A null text has no words. Repeats within one document stay. Rows without an id are
    compared with nothing; rows that repeat an id count as one document. An empty table gives an
    empty result.
    """
    spans = materialise(repeats(docs, id_col, text_col), "spans").withColumnRenamed("doc_id", "_doc")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, max(1, whole.num_rows), 500)):
                rows = []
                for text, span in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    gone = covered(len(words), span) if span else None
                    left = words if gone is None else [words[i] for i in np.flatnonzero(~gone)]
                    out = b" ".join(left)
                    long = [{"at": a, "n": n} for a, n in maximal(len(words), span)] if span else []
                    rows.append((len(words), len(words) - len(left), hashlib.sha256(out).hexdigest(), long, *[out.decode()] * keep_text))
                cols = list(zip(*rows, strict=True)) or [[]] * (4 + keep_text)
                types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])), *[pa.string()] * keep_text]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", *["kept_text"] * keep_text]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, repeats array<struct<at:int,n:int>>" + ", kept_text string" * keep_text
    return base.join(spans, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "spans").mapInArrow(kept, schema)
