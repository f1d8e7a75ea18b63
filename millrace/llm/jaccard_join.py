"""N-gram Jaccard join: links between documents whose shingle sets are nearly the same.

The join is size-aware. Of small sets, every subset of the size that a link needs to share is
listed, and sets that list the same subset are linked outright. Of large sets, the rarest shingles
(as many as a linked set can't all lack) go into inverted lists; lists give candidate pairs, and the
sets of each pair are compared. The boundary is where listing subsets starts to cost more than
scanning lists, by the size histogram and the mean list length of the corpus.

What keeps large groups of copies cheap, without losing a link between different components:

* equal sets are one class from the start;
* in a first round, each set of a list is compared with one pivot only;
* in a second round, only sets of different components in a list are compared: those outside the
  list's most common component with all of the list.

Before sets are compared, parity maps rule out most pairs: bit i of a map is the parity of the number of
elements that hash to i, so two maps differ in no more bits than their sets in elements. Every set has
a small map of fixed size, and a full one in proportion to its size. What is left is compared element by
element, by Spark, one pair a row.

Rarity is estimated by a count sketch of fixed width over all documents. It only orders the shingles: any
order gives the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import shingles, word_hashes
from millrace.plans.components import components
from millrace.plans.lookup import restrict
from millrace.plans.scratch import materialise

SKETCH = 1 << 18
#: Bits of a set's small parity map.
MAP_BITS = 512
#: What comparing a list entry with its list's pivot costs at most, in subset rows. A pivot stands for
#: the whole list, so the cost of an entry stops growing with the list.
COMPARISON = 8
#: The boundary is sought up to this size; larger sets have too many subsets for any corpus.
MOST_SMALL = 30


def needed(n: int, m: int, percent: int) -> int:
    """Shared elements that sets of n and m elements need for a link."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of subsets that a set of n elements may have to share with a set it links to."""
    least, most = -(-percent * n // 100), 100 * n // percent
    return sorted({c for m in range(max(1, least), most + 1) if (c := needed(n, m, percent)) <= min(n, m)})


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest size whose sets are best served by listing subsets; 0 if none is."""
    best, cost, least = 0, 0.0, 0.0
    for n in range(1, MOST_SMALL + 1):
        by_subsets = sum(math.comb(n, c) for c in subset_sizes(n, percent))
        by_lists = (n - -(-percent * n // 100) + 1) * (1 + min(list_length - 1, COMPARISON))
        cost += sizes.get(n, 0) * (by_subsets - by_lists)
        if cost < least or n == 1:
            best, least = n, cost
    return best


def set_of(text: bytes, size: int) -> np.ndarray:
    """A document's set: bytes.lower() and bytes.split() know ASCII letters and white space only."""
    return shingles(word_hashes(text.lower().split()), size)


def parity_map(s: np.ndarray, bits: int) -> np.ndarray:
    """A map of as many bits, a power of two. The xor of the halves of a map is the map of half as many bits."""
    return np.packbits(np.bincount((s >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1).view(np.int64)


def full_bits(n: int) -> int:
    """Bits of the full map of a set: between n and 2n, MAP_BITS at least."""
    return max(MAP_BITS, 1 << n.bit_length())


def sketch_of(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, dict[int, int]]:
    """How often the shingles of each of SKETCH buckets occur, and how many small sets have each size.

    Both have a fixed size; each task adds up its documents before anything is shuffled.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes, waiting, held = np.zeros(SKETCH, np.int64), np.zeros(MOST_SMALL + 1, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                s = set_of(text or b"", size)
                if len(s) <= MOST_SMALL:
                    sizes[len(s)] += 1
                waiting.append((s % np.uint64(SKETCH)).astype(np.int64))
                held += len(s)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SKETCH)
        used, small = np.flatnonzero(total), np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, -1 - small])), pa.array(np.concatenate([total[used], sizes[small]]))], ["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # SKETCH + MOST_SMALL rows at most
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    counts = np.zeros(SKETCH, np.int64)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return counts, {int(-1 - b): int(c) for b, c in zip(bucket, n, strict=True) if b < 0}


def _subsets(s: np.ndarray, percent: int) -> list[int]:
    """Hashes of all subsets of s of the sizes that matter, by the elements left out."""
    out = []
    total = int(np.bitwise_xor.reduce(s)), int(s.sum())
    values = s.tolist()
    n = len(values)

    def emit(c: int, left: int, start: int, x: int, a: int) -> None:
        if left == 0:
            key = xxhash.xxh3_64_intdigest(b"%d %d %d" % (c, x, a & (2**64 - 1)))
            out.append(key - (1 << 64) if key >> 63 else key)
            return
        for i in range(start, n - left + 1):
            emit(c, left - 1, i + 1, x ^ values[i], a - values[i])

    for c in subset_sizes(n, percent):
        before = len(out)
        emit(c, n - c, 0, *total)
        out[before:] = [(c, k) for k in out[before:]]
    return out


def described(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, counts: np.ndarray, small: int) -> DataFrame:
    """doc_id, n, sig_a, sig_b, keys (list entries; the first ``core`` serve larger sets), subsets, sub_c, map, full."""
    # ranks have 24 bits whatever the counts: their logarithms, to a few millionths
    ranks = docs.sparkSession.sparkContext.broadcast((np.log2(counts + 1.0) * (1 << 18)).astype(np.uint64))
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(text: bytes) -> tuple:
        s = set_of(text, size)
        n = len(s)
        digest = xxhash.xxh3_128_digest(s.tobytes())
        sig = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
        if n == 0:
            return 0, *sig, 0, [], [], [], [], []
        pairs = _subsets(s, percent) if n <= small else []
        keys, core = np.zeros(0, np.int64), 0
        if n > small or 100 * n >= percent * (small + 1):
            order = (ranks.value[(s % np.uint64(SKETCH)).astype(np.int64)] << np.uint64(40)) | (s >> np.uint64(24))
            long, short = n - -(-percent * n // 100) + 1, n - needed(n, n, percent) + 1
            first = np.argsort(order)
            last, last_core = order[first[long - 1]], order[first[short - 1]]
            # elements that tie with the last are taken too: the order has no other tie rule
            keys = s[first[: np.searchsorted(order[first], last, "right")]].view(np.int64)
            core = int(np.searchsorted(order[first], last_core, "right"))
        return n, *sig, core, keys, [k for _, k in pairs], [c for c, _ in pairs], parity_map(s, MAP_BITS), parity_map(s, full_bits(n))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, max(1, whole.num_rows), 1000)):
                got = [of(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                cols = list(zip(*got, strict=True)) or [[]] * 9
                longs = pa.list_(pa.int64())
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), longs, longs, pa.list_(pa.int32()), longs, longs]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n", "sig_a", "sig_b", "core", "keys", "subsets", "sub_c", "map", "full"])

    return docs.select(id_col, text_col).mapInArrow(rows, f"doc_id {id_type}, n bigint, sig_a bigint, sig_b bigint, core int, keys array<bigint>, subsets array<bigint>, sub_c array<int>, map array<bigint>, full array<bigint>")


def sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def most_apart(n: Column, m: Column, percent: int) -> Column:
    """Elements in which linked sets of n and m elements may differ at most."""
    return n + m - 2 * F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))


def maps_fit(n: Column, m: Column, a: str, b: str, percent: int) -> Column:
    """False only if the small maps rule out that sets of n and m elements link."""
    differ = F.lit(0)
    for i in range(MAP_BITS // 64):
        differ += F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return differ <= most_apart(n, m, percent)


def not_ruled_out(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) whose full maps allow a link. The larger map is folded to the smaller."""
    one = maps.select(F.col("doc_id").alias("src"), "n", F.col("full").alias("_a"))
    two = maps.select(F.col("doc_id").alias("dst"), F.col("n").alias("m"), F.col("full").alias("_b"))
    folded = "if(size({0}) = _l, {0}, transform(sequence(0, _l - 1), i -> aggregate(sequence(i, size({0}) - 1, _l), 0L, (x, j) -> x ^ {0}[j])))"
    differ = F.expr(f"aggregate(zip_with({folded.format('_a')}, {folded.format('_b')}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    joined = pairs.join(one, "src").join(two, "dst").withColumn("_l", F.least(F.size("_a"), F.size("_b")))
    return joined.filter(differ <= most_apart(F.col("n"), F.col("m"), percent)).select("src", "dst").distinct()


def subset_links(reps: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) among small sets.

    Sets that list a subset of c elements share c at least. If any two of them link by that, both link
    with the smallest of the list: its size asks for no more. So each is held against that one
    only.
    """
    rows = reps.filter(F.size("subsets") > 0).select("doc_id", "n", F.explode(F.arrays_zip("subsets", "sub_c")).alias("s")).select("doc_id", "n", F.col("s.subsets").alias("key"), F.col("s.sub_c").alias("c"))
    least = rows.groupBy("key", "c").agg(F.min(F.struct("n", "doc_id")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("key", "c", F.col("m.n").alias("m"), F.col("m.doc_id").alias("dst"))
    links = rows.join(least, ["key", "c"]).filter((F.col("doc_id") != F.col("dst")) & (F.col("c") * 100 >= (F.col("n") + F.col("m") - F.col("c")) * percent))
    return links.select(F.col("doc_id").alias("src"), "dst").distinct()


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (src, dst) whose sets link. docs: doc_id, text.

    Only the sets of documents in a pair are made, each once, and the elements that two sets share are
    counted row by row: a task holds the sets of a pair, however many pairs a document has.
    """
    id_type = pairs.schema["src"].dataType.simpleString()

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 200) for k in range(0, max(1, whole.num_rows), 200)):
                sets = [set_of(t.as_buffer().to_pybytes(), size).view(np.int64) for t in batch.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "s"])

    members = materialise(pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "members")
    sets = materialise(restrict(docs, members, "doc_id").mapInArrow(made, f"doc_id {id_type}, s array<bigint>"), "sets")
    one, two = sets.select(F.col("doc_id").alias("src"), F.col("s").alias("_a")), sets.select(F.col("doc_id").alias("dst"), F.col("s").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(one, "src").join(two, "dst").filter(shared * 100 >= (F.size("_a") + F.size("_b") - shared) * percent).select("src", "dst")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links).

    A null or empty text, or one without words, has an empty set and links with nothing. A document
    without an id links with nothing either; its component_id is null. An id names a row: rows
    that repeat an id count as one document. An empty table gives an empty result.
    """
    counts, sizes = sketch_of(docs, text_col, size)
    # the mean number of occurrences beside one occurrence: variance / mean is free of the collisions of unrelated shingles
    spread = float(counts.var() / counts.mean()) if counts.any() else 1.0
    small = boundary(sizes, max(1.0, spread), percent)
    rows = materialise(described(docs, id_col, text_col, size, percent, counts, small), "described")

    sets = rows.filter("n > 0 and doc_id is not null")
    classes = materialise(sets.groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sets.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    # a table of its own: joins with it can be split where a pivot has many pairs
    maps = materialise(reps.select("doc_id", "n", "full"), "maps")

    small_links = materialise(subset_links(reps, percent), "small_links")

    # lists with at least two sets; the smaller set of a pair serves by its core entries alone
    entries = reps.select("doc_id", "n", F.posexplode("keys").alias("at", "key"), "core").select("key", "doc_id", (F.col("n") * 2 + (F.col("at") < F.col("core")).cast("int")).alias("nc"))
    lists = entries.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.min_by("nc", "doc_id").alias("pivot_nc"), F.max("doc_id").alias("_most")).filter("pivot < _most").drop("_most")
    shared = materialise(entries.join(lists, "key"), "shared")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")

    n, m = F.floor(F.col("nc") / 2), F.floor(F.col("pivot_nc") / 2)
    first = shared.filter("doc_id <> pivot").filter(sizes_fit(n, m, percent) & (F.greatest(n, m) > small)).select(F.col("doc_id").alias("src"), F.col("pivot").alias("dst")).distinct()
    first = materialise(not_ruled_out(first, maps, percent), "first")
    links = materialise(verified(first, texts, size, percent), "links").unionByName(small_links)
    labels = materialise(components(links), "labels").withColumnRenamed("id", "doc_id")

    # lists that still hold several components
    named = shared.select("key", "doc_id", "nc").join(labels, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    named = materialise(named, "named")
    per_label = named.groupBy("key", "label").agg(F.count("*").alias("k"))
    common = per_label.groupBy("key").agg(F.max_by("label", "k").alias("common"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    mixed = materialise(named.join(common, "key").join(reps.select("doc_id", "map"), "doc_id"), "mixed")
    few = mixed.filter("label <> common").select("key", F.col("doc_id").alias("src"), F.col("nc").alias("a"), F.col("label").alias("la"), F.col("map").alias("ma"))
    every = mixed.select("key", F.col("doc_id").alias("dst"), F.col("nc").alias("b"), F.col("label").alias("lb"), F.col("map").alias("mb"), (F.col("label") == F.col("common")).alias("usual"))
    n, m = F.floor(F.col("a") / 2), F.floor(F.col("b") / 2)
    core = F.when(n < m, F.col("a") % 2 == 1).when(n > m, F.col("b") % 2 == 1).otherwise((F.col("a") % 2 == 1) | (F.col("b") % 2 == 1))
    second = few.join(every, "key").filter((F.col("la") != F.col("lb")) & (F.col("usual") | (F.col("src") < F.col("dst"))) & core & sizes_fit(n, m, percent) & (F.greatest(n, m) > small) & maps_fit(n, m, "ma", "mb", percent))
    second = not_ruled_out(second.select("src", "dst").distinct(), maps, percent)
    seen = first.select("src", "dst").union(first.select("dst", "src"))
    second = materialise(second.join(seen, ["src", "dst"], "left_anti"), "second")
    more = materialise(verified(second, texts, size, percent), "more")
    found = materialise(components(links.unionByName(more)), "components").withColumnRenamed("id", "rep")

    of_class = classes.join(found, "rep", "left").select("n", "sig_a", "sig_b", F.coalesce("component", "rep").alias("component_id"))
    single = rows.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = sets.select("doc_id", "n", "sig_a", "sig_b").join(of_class, ["n", "sig_a", "sig_b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(single)
