"""URL filters: host and path rules, else a character language-model ratio, all DataFrame operations.

URLs that a rule allows or blocks are the examples of two variable-order Markov models over
characters (Witten-Bell interpolation of contexts of 0 to 3 characters). A URL without a rule is
blocked if its length-normalised log-likelihood difference lies below a threshold that is
calibrated on examples held out from the models.

The interpolated score is folded into one weight for each character n-gram that occurs in the
examples, so a URL's score is the sum of the weights of its n-grams: one join, one sum.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import materialise

#: Fixed values: (verdict, host, path) of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
#: Characters of the models' alphabet; digits count as 0, others as ~.
ALPHABET = string.ascii_lowercase + "0./:?=&#-_%+@,;^$~"
_KEPT = r"a-z0./:?=&#\-_%+@,;"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _characters(url: Column) -> Column:
    """The URL as the models see it, between start marks and an end mark."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(url), "[0-9]", "0"), f"[^{_KEPT}]", "~")
    return F.concat(F.lit("^" * (ORDER - 1)), folded, F.lit("$"))


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """The columns keep and _gram: a row for each n-gram of 1 to ORDER characters that ends in or after the URL's first.

    Characters are split off once and rows don't carry the URL, so a URL costs in proportion to its length.
    """
    gram = lambda k: " || ".join(f"_c[e - {j}]" for j in range(k, 0, -1))
    every = F.expr(f"flatten(transform(sequence({ORDER}, size(_c)), e -> array({', '.join(gram(k) for k in range(1, ORDER + 1))})))")
    return df.withColumn("_c", F.split("_chars", "")).select(*keep, F.explode(every).alias("_gram"))


def gram_weights(examples: DataFrame) -> tuple[DataFrame, float, float]:
    """Weight of each n-gram (_gram, _weight), the constant of each character, and that of each URL.

    examples: _chars, _good. With P the interpolated probability, L = log P_good / P_bad, and B(h) the log ratio of what the two models hand
    down from context h, an n-gram g = hc weighs L(g) - L(g without its first character) - B(h),
    plus B(g), as a context of the next character. Summed over a URL, this gives for each
    character L of its longest known n-gram plus B of the longer known contexts. The contexts of the first
    character are start marks, which end no n-gram: their B is each URL's constant.
    """
    counts = _grams(examples, "_good").groupBy("_gram").agg(F.count_if(F.col("_good")).alias("_g"), F.count_if(~F.col("_good")).alias("_b"))
    counts = materialise(counts.withColumn("_context", F.expr("left(_gram, length(_gram) - 1)")), "grams")
    contexts = counts.groupBy("_context").agg(F.sum("_g").alias("_ng"), F.count_if(F.col("_g") > 0).alias("_tg"), F.sum("_b").alias("_nb"), F.count_if(F.col("_b") > 0).alias("_tb"))
    down = lambda n, t: F.when(F.col(n) > 0, F.col(t) / (F.col(n) + F.col(t))).otherwise(1.0)
    contexts = materialise(contexts.withColumn("_down", F.log(down("_ng", "_tg") / down("_nb", "_tb"))), "contexts")
    joined = counts.join(contexts, "_context")
    lower, done = None, []
    for k in range(1, ORDER + 1):
        these = joined.filter(F.length("_gram") == k)
        if lower is None:
            these = these.withColumns({"_pg": F.lit(1 / len(ALPHABET)), "_pb": F.lit(1 / len(ALPHABET)), "_before": F.lit(0.0)})
        else:
            these = these.withColumn("_tail", F.expr("substr(_gram, 2)")).join(lower, "_tail").drop("_tail")
        mixed = lambda c, n, t, p: F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        these = materialise(these.withColumns({"_pg": mixed("_g", "_ng", "_tg", "_pg"), "_pb": mixed("_b", "_nb", "_tb", "_pb")}).withColumn("_ratio", F.log(F.col("_pg") / F.col("_pb"))), f"order{k}")
        done.append(these.select("_gram", (F.col("_ratio") - F.col("_before") - F.col("_down")).alias("_own")))
        lower = these.select(F.col("_gram").alias("_tail"), "_pg", "_pb", F.col("_ratio").alias("_before"))
    grams = done[0]
    for more in done[1:]:
        grams = grams.unionByName(more)
    weights = grams.join(contexts.select(F.col("_context").alias("_gram"), F.col("_down").alias("_next")), "_gram", "left")
    marks = {r[0]: r[1] for r in contexts.filter(F.col("_context").isin(*("^" * k for k in range(ORDER)))).select("_context", "_down").collect()}
    weights = materialise(weights.select("_gram", (F.col("_own") + F.coalesce(F.col("_next"), F.lit(0.0))).alias("_weight")), "weights")
    return weights, marks.get("", 0.0), sum(b for c, b in marks.items() if c)


def scored(urls: DataFrame, weights: DataFrame, constant: float, start: float, broadcast_rows: int) -> DataFrame:
    """(_id, score) of urls (_id, _chars): log-likelihood difference per character."""
    small = weights.limit(broadcast_rows + 1).count() <= broadcast_rows
    sized = urls.withColumn("_length", F.length("_chars") - (ORDER - 1))
    hits = _grams(sized, "_id", "_length").join(F.broadcast(weights) if small else weights, "_gram", "left")
    length = F.first("_length")
    return hits.groupBy("_id").agg(((F.sum(F.coalesce("_weight", F.lit(0.0))) + F.lit(start)) / length + F.lit(constant)).alias("score"))


def _threshold(examples: DataFrame) -> float:
    """The score that best tells held-out accepted from rejected URLs (balanced accuracy).

    Scores meet in bins of 0.02, so the table that is ordered has 1001 rows at most.
    """
    bins = examples.withColumn("_bin", F.greatest(F.lit(-500), F.least(F.lit(500), F.round(F.col("score") * 50)))).groupBy("_bin").agg(F.sum(F.when(F.col("_good"), F.col("_n")).otherwise(0)).alias("_g"), F.sum(F.when(F.col("_good"), 0).otherwise(F.col("_n"))).alias("_b"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    gain = F.coalesce(F.sum("_b").over(upto), F.lit(0)) / F.sum("_b").over(whole) - F.coalesce(F.sum("_g").over(upto), F.lit(0)) / F.sum("_g").over(whole)
    best = bins.withColumn("_gain", gain).filter("_gain is not null").orderBy(F.desc("_gain"), F.abs("_bin"), "_bin").select("_bin").limit(1).collect()
    return (best[0][0] - 0.5) / 50 if best else 0.0


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, broadcast_rows: int = 300_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (null where a rule decides).

    A null URL has no characters to judge and is allowed, with a null score. Where the rules give
    no examples of one kind the models say nothing and URLs without a rule are allowed. Repeated
    rows get the same verdict; an empty table gives an empty result.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    base = base.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "_said": verdict, "_chars": _characters(F.col("_url"))}).withColumn("_id", F.md5("_chars"))
    # equal URLs are counted and scored once
    distinct = base.filter("_url is not null").groupBy("_id", "_chars", "_said").agg(F.count("*").alias("_n"))
    distinct = materialise(distinct.withColumn("_good", F.col("_said") == "allow").withColumn("_held", F.pmod(F.xxhash64("_chars"), F.lit(5)) == 0), "urls")
    examples = distinct.filter("_said is not null")
    weights, constant, start = gram_weights(examples.filter(~F.col("_held")))
    both = examples.agg(F.count_if(F.col("_good")).alias("g"), F.count_if(~F.col("_good")).alias("b")).first()
    if not (both["g"] and both["b"]):
        return base.select("page_id", "host", "path", "rule", F.coalesce("_said", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    scores = materialise(scored(distinct.filter("_said is null or _held").select("_id", "_chars").distinct(), weights, constant, start, broadcast_rows), "scores")
    threshold = _threshold(examples.filter("_held").join(scores, "_id"))
    known = base.filter("_said is not null or _url is null").withColumn("score", F.lit(None).cast("double"))
    judged = base.filter("_said is null and _url is not null").join(scores, "_id", "left")
    out = known.unionByName(judged)
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("score") < F.lit(threshold), "block").otherwise("allow")).alias("verdict"), "score")
