"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target of words by its weight. Within a source, documents are not alike: a document's
expected number of copies grows with its size to the power of ``power`` and with its own weight, up to
the most that a document may have, and the expected words of a source add up to its target. The whole
part of the expectation is certain copies. The rest is a document's inclusion probability in a sample
without replacement: documents are ranked by random odds divided by inclusion odds, and the ranking is
cut where the words reach what the certain copies leave open. What a cut between whole documents
leaves open then goes to the one document whose size fits it best, lower ranks first among equals.

No source is ever sorted as a whole. Ranking values fall into BINS bins; the words of each bin,
summed by partial aggregation, give the bin that holds the cut, and only its documents are
ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_of, words_of
from millrace.plans.lookup import attach
from millrace.plans.scratch import materialise

BINS = 16384
#: Steps of the expected number of copies for each factor of two: documents of one step are alike, so a source has a few hundred at most.
STEPS = 32


def _fill(rows: DataFrame, total: Column, within: list[str]) -> DataFrame:
    """rows (_weight, _cap) with ``_share``: min(cap, level * weight), adding up to total if the caps allow it.

    What a row at its cap can't take is shared anew by weight. With the rows in order of cap / weight,
    the level is that of the first row whose cap is not reached, the highest of such levels.
    """
    ratio = F.col("_cap") / F.col("_weight")
    by_ratio = Window.partitionBy(*within).orderBy(ratio)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
    level = F.max(F.when(ratio >= F.col("_level"), F.col("_level"))).over(Window.partitionBy(*within))
    return out.withColumn("_share", F.coalesce(F.least(F.col("_cap"), level * F.col("_weight")), F.col("_cap"))).drop("_level")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with ``target``: words of the mix for each source.

    Weights go round the sources by code point, null last. The total is share * all words; a
    target stops at most * source_size and what it can't take is shared anew by weight.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    out = sources.withColumn("_weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth + 1).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    return _fill(out, total, []).select("source", "source_size", F.col("_share").alias("target"))


def expectations(steps: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """For each source: source_size, target, _copies (expected copies by step) and _open (words that certain copies leave open).

    steps: source, _step, _words. Both tables have a row for each source, or for each of its few steps.
    """
    words = F.col("_words").cast("double")
    rows = steps.filter("_step is not null").join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_weight", F.pow(F.lit(2.0), F.col("_step") / STEPS) * words).withColumn("_cap", words * F.lit(float(most)))
    rows = _fill(rows, F.col("target"), ["source"]).withColumn("_each", F.col("_share") / words)
    rows = rows.withColumn("_each", F.when(F.col("_each") > most - 1e-9, F.lit(float(most))).otherwise(F.col("_each")))
    made = rows.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("_step", "_each"))).alias("_copies"), F.sum((F.col("_each") - F.floor("_each")) * words).alias("_open"))
    made = made.withColumnRenamed("source", "_source")
    return targets.join(made, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").withColumn("_open", F.coalesce("_open", F.lit(0.0)))


def _uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, power: float = 0.25, weight_col: str | None = None, seed: int = 42,
) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies, taken, expected (copies).

    weight_col (if given) multiplies a document's expected copies; a null counts as 1, and a weight
    that isn't positive takes the document out. The draw depends on ids, texts and seed alone, so reruns
    agree; a null text has size 0 and no copies, repeated rows are ordered arbitrarily but alike. A
    source without words has target 0; an empty table gives an empty result.
    """
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(text_of(text_col))).cast("long").alias("size"), weight.alias("_w"), _uniform(seed, F.col(id_col), F.col(text_col)).alias("_u"))
    step = F.when((F.col("size") > 0) & (F.col("_w") > 0), F.round(STEPS * (power * F.log2("size") + F.log2("_w"))).cast("int"))
    sized = materialise(sized.withColumn("_step", step).drop("_w"), "sized")
    steps = materialise(sized.groupBy("source", "_step").agg(F.sum("size").alias("_words")), "steps")
    targets = source_targets(steps.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    targets = materialise(expectations(steps, targets, most), "targets")

    placed = attach(sized, targets, "source").withColumn("expected", F.coalesce(F.try_element_at("_copies", "_step"), F.lit(0.0))).drop("_copies", "_step")
    placed = placed.withColumn("_whole", F.floor("expected")).withColumn("_p", F.col("expected") - F.col("_whole"))
    # documents without a chance beyond their certain copies have no rank and no words in the ranking
    placed = placed.withColumn("_size", F.when(F.col("_p") > 1e-9, F.col("size")).otherwise(0))
    ratio = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    ranked = placed.withColumn("_rank", F.when(F.col("_size") > 0, ratio / (1 + ratio)).otherwise(1.0)).withColumn("_bin", F.least(F.floor(F.col("_rank") * BINS), F.lit(BINS - 1))).drop("_u", "_p")

    # the bin of each source that holds the cut: at most BINS rows of a source meet in a task
    bins = ranked.groupBy("source", "_bin").agg(F.sum("_size").alias("_words"), F.first("_open").alias("_left"))
    upto = Window.partitionBy("source").orderBy("_bin")
    bins = bins.withColumn("_before", F.sum("_words").over(upto) - F.col("_words")).filter(F.col("_before") + F.col("_words") > F.col("_left"))
    cuts = materialise(bins.groupBy("source").agg(F.min(F.struct("_bin", "_before")).alias("_cut")).select("source", F.col("_cut._bin").alias("_cut_bin"), F.col("_cut._before").alias("_cut_before")), "cuts")

    placed = attach(ranked, cuts, "source", "left")
    inside = F.col("_cut_bin").isNull() | (F.col("_bin") < F.col("_cut_bin"))
    at_cut = placed.filter(F.col("_bin") == F.col("_cut_bin"))
    in_order = Window.partitionBy("source").orderBy("_rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = at_cut.withColumn("_in", F.sum("_size").over(in_order) + F.col("_cut_before") <= F.col("_open"))
    rest = placed.filter(F.col("_cut_bin").isNull() | (F.col("_bin") != F.col("_cut_bin"))).withColumn("_in", inside)
    chosen = rest.unionByName(at_cut).drop("_cut_bin", "_cut_before").withColumn("_in", F.col("_in") & (F.col("_size") > 0))
    chosen = materialise(chosen, "chosen")

    # the document that fits best what the cut leaves open; the low bits of the order break ties
    gaps = chosen.groupBy("source").agg((F.first("_open") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0))).cast("long").alias("_gap"))
    gaps = materialise(gaps, "gaps")
    miss = F.abs(F.col("_gap") - F.col("size"))
    fit = F.when(~F.col("_in") & (F.col("_size") > 0) & (miss < F.col("_gap")), F.shiftleft(F.least(miss, F.lit(2**31 - 1)), 31) + F.floor(F.col("_rank") * (2**31 - 1)))
    fitted = attach(chosen, gaps, "source").withColumn("_fit", fit)
    best = materialise(fitted.groupBy("source").agg(F.min("_fit").alias("_best")), "best")
    final = attach(fitted, best, "source")
    copies = F.col("_whole") + F.when(F.col("_in") | F.coalesce(F.col("_fit") == F.col("_best"), F.lit(False)), 1).otherwise(0)
    return final.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "expected")
