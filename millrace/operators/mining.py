"""Statistics over pattern rows: which patterns stand out for a keyword, and their examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.pairs import neighbours
from millrace.plans.scratch import materialise


def good_patterns(rows: DataFrame, key: str = "wordpos", pat: str = "pat", n: str | None = None, least: int = 5, deviations: float = 1.0) -> DataFrame:
    """(key, pat, cnt, freq, avg_freq, dev) of patterns that stand out among those of their key.

    cnt is at least least + 1 and lies more than ``deviations`` population standard deviations above the
    key's mean; keys whose patterns are all equally frequent have none. One shuffle by (key, pat) of
    partial sums, one by key of distinct patterns; the statistics are sums, so no key is sorted.
    """
    counts = rows.groupBy(key, pat).agg((F.count("*") if n is None else F.sum(n)).cast("long").alias("cnt"))
    stats = counts.groupBy(key).agg(F.sum("cnt").alias("freq"), F.avg("cnt").alias("avg_freq"), F.stddev_pop("cnt").alias("dev"))
    return _standing_out(counts.filter(F.col("cnt") > least), stats, key, pat, deviations)


def good_neighbours(rows: DataFrame, text: str = "text", least: int = 5, deviations: float = 1.0) -> DataFrame:
    """good_patterns of the pairs of neighbouring words of texts: no row is made for a pair met ``least`` times or less.

    The deviations come from whole sums of counts and squares, so they are exactly 0 where all counts are equal.
    """
    table = materialise(neighbours(rows, text, least), "neighbours")
    sums = table.filter("pat IS NULL").groupBy("key").agg(F.sum("pats").alias("k"), F.sum("total").alias("freq"), F.sum("squares").cast("decimal(38,0)").alias("q"))
    spread = (F.col("k") * F.col("q") - F.col("freq").cast("decimal(19,0)") * F.col("freq")).cast("double")
    stats = sums.select("key", "freq", (F.col("freq") / F.col("k")).alias("avg_freq"), (F.sqrt(spread) / F.col("k")).alias("dev"))
    return _standing_out(table.filter("pat IS NOT NULL").select("key", "pat", "cnt"), stats, "key", "pat", deviations)


def _standing_out(frequent: DataFrame, stats: DataFrame, key: str, pat: str, deviations: float) -> DataFrame:
    out = frequent.join(stats.filter("dev > 0"), key)
    return out.filter((F.col("cnt") - F.col("avg_freq")) / F.col("dev") > deviations).select(key, pat, "cnt", "freq", "avg_freq", "dev")


def example_rollup(rows: DataFrame, good: DataFrame, least: int = 3) -> DataFrame:
    """(wordpos, freq, avg_freq, dev, patterns): good patterns by falling count, then by text, each with its
    examples of more than ``least`` occurrences by (iocs, example)."""
    has_cnt = "cnt" in rows.columns
    n = F.sum("cnt") if has_cnt else F.count("*")
    first = F.min(F.struct("iocs", F.to_json("instance_sym").alias("_order"), F.map_entries("instance_sym").alias("sym")))
    kept = rows.join(good.select("wordpos", "pat"), ["wordpos", "pat"], "left_semi")
    grouped = kept.groupBy("wordpos", "pat", "example").agg(n.alias("n"), first.alias("f")).filter(F.col("n") > least)
    lists = grouped.groupBy("wordpos", "pat").agg(F.sort_array(F.collect_list(F.struct(F.col("f.iocs").alias("iocs"), "example", F.col("n").alias("cnt"), F.col("f.sym").alias("sym")))).alias("examples"))
    examples = F.transform("examples", lambda x: F.struct(x["example"].alias("example"), x["cnt"].alias("cnt"), F.map_from_entries(x["sym"]).alias("sym")))
    listed = good.join(lists, ["wordpos", "pat"], "left").withColumn("_e", F.when(F.col("examples").isNotNull(), examples))
    one = listed.groupBy("wordpos").agg(F.first("freq").alias("freq"), F.first("avg_freq").alias("avg_freq"), F.first("dev").alias("dev"), F.collect_list(F.struct((-F.col("cnt")).alias("m"), "pat", "cnt", F.col("_e").alias("examples"))).alias("_p"))
    by_count = lambda a, b: F.when(a["m"] < b["m"], -1).when(a["m"] > b["m"], 1).when(a["pat"] < b["pat"], -1).when(a["pat"] > b["pat"], 1).otherwise(0)
    return one.select("wordpos", "freq", "avg_freq", "dev", F.transform(F.array_sort("_p", by_count), lambda p: F.struct(p["pat"].alias("pat"), p["cnt"].alias("cnt"), p["examples"].alias("examples"))).alias("patterns"))


def top_instances(rows: DataFrame, good: DataFrame, most: int = 3) -> DataFrame:
    """(wordpos, pat, rank, iocs, iocs_cnt, example, example_cnt): the most frequent iocs of each good pattern with their most frequent example."""
    n = F.sum("cnt") if "cnt" in rows.columns else F.count("*")
    kept = rows.join(good.select("wordpos", "pat"), ["wordpos", "pat"], "left_semi")
    examples = kept.groupBy("wordpos", "pat", "iocs", "example").agg(n.cast("long").alias("k"))
    iocs = examples.groupBy("wordpos", "pat", "iocs").agg(F.sum("k").alias("iocs_cnt"), F.min(F.struct((-F.col("k")).alias("m"), "example")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("wordpos", "pat").orderBy(F.desc("iocs_cnt"), "iocs"))
    return iocs.withColumn("rank", rank).filter(F.col("rank") <= most).select("wordpos", "pat", "rank", "iocs", "iocs_cnt", F.col("b.example").alias("example"), (-F.col("b.m")).alias("example_cnt"))


def pretty(table: DataFrame) -> DataFrame:
    """(keyword, keyword_count, pattern, pattern_count, instances): one row for each pattern."""
    rows = table.select(F.col("wordpos").alias("keyword"), F.col("freq").alias("keyword_count"), F.explode("patterns").alias("p"))
    text = lambda x: F.split_part(F.split_part(x["example"], F.lit("["), F.lit(2)), F.lit("]"), F.lit(1))
    instances = F.transform(F.col("p.examples"), lambda x: F.struct(text(x).alias("instance"), F.transform_keys(x["sym"], lambda k, v: k.cast("string")).alias("tag")))
    return rows.select("keyword", "keyword_count", F.col("p.pat").alias("pattern"), F.col("p.cnt").alias("pattern_count"), instances.alias("instances"))
