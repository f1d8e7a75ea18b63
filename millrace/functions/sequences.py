"""Functions of token arrays: n-grams, slices, projections of tags, overlap scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, each joined by a blank; none for a shorter array.

    Built by zipping the array with itself, shifted: words may be any expression, and is evaluated n
    times, not once for each run.
    """
    grams = words
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(words, k, F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.filter(grams, lambda x: x.isNotNull()) if n > 1 else words


def ngrams_upto(words: Column, most: int) -> Column:
    return F.concat(*(ngrams(words, n) for n in range(1, most + 1)))


def zip_short(a: Column, b: Column, join) -> Column:
    """join(x, y) over two arrays, the shorter one deciding."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), join)


def slash_joined(words: Column, tags: Column) -> Column:
    return F.array_join(zip_short(words, tags, lambda w, t: F.concat_ws("/", w, t)), " ")


def before_slash(words: Column) -> Column:
    return F.transform(words, lambda w: F.substring_index(w, "/", 1))


def to_inside_head(chunks: Column) -> Column:
    """BIO chunk tags as I-...H-: the last tag of a chunk is its head; O stays."""
    last = lambda i: (i == F.size(chunks) - 1) | ~F.coalesce(F.get(chunks, i + 1), F.lit("O")).startswith("I-")
    return F.transform(chunks, lambda x, i: F.when(x == "O", x).otherwise(F.concat(F.when(last(i), "H-").otherwise("I-"), F.substring(x, 3, 2**31 - 1))))


def numbered(items: Column) -> Column:
    """Items that occur more than once get a running number, from the left."""
    return F.transform(items, lambda x, i: F.when(F.size(F.filter(items, lambda y: y == x)) > 1, F.concat(x, F.size(F.filter(F.slice(items, 1, i + 1), lambda y: y == x)).cast("string"))).otherwise(x))


def overlap_score(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets, times the size of the first."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either * F.size(a)).otherwise(0.0)


def locate_run(words: Column, run: Column) -> Column:
    """0-based place of the first occurrence of run in words; null if there is none."""
    starts = F.when(F.size(words) >= F.size(run), F.sequence(F.lit(0), F.size(words) - F.size(run))).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda i: F.slice(words, i + 1, F.size(run)) == run), F.lit(0))


def align_map(pairs: Column) -> Column:
    """'i-j' pairs as a map from i to its js, in the order given."""
    ends = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("int").alias("i"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int").alias("j")))
    keys = F.array_distinct(F.transform(ends, lambda e: e["i"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(ends, lambda e: e["i"] == k), lambda e: e["j"])))
