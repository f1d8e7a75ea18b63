"""Quality rules by weak supervision, in DataFrame operations only.

Every rule looks at a few numbers of a text and votes good (1), bad (0) or abstains (null). Bad texts are
of several kinds, and each kind has two rules or more that look for it in different ways, so that
agreement tells a kind from a rule's error. Expectation-maximisation estimates, from the votes on all
documents, how common good texts and each kind are, and how often each rule votes good on them;
a document's posterior probability of being good then takes the place of an all-rules-must-pass filter.

The estimates are free: the kinds' rules only give the values that EM starts from, and each rate is
smoothed by two documents' worth of votes.

The votes of a document are one of at most 3**rules patterns, so the corpus is read once for the
numbers and EM runs on the pattern counts, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_of, words_of
from millrace.plans.scratch import materialise

SYMBOLS = "#*$%&|<>"
#: Kinds of bad texts and the rules that look for them.
KINDS = {"symbols": ("symbols", "marked", "letters"), "repetition": ("repeats", "dup_lines", "distinct"), "shouting": ("upper", "bangs"), "form": ("word_length", "stops")}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_stops", "n_marked", "n_letters", "n_distinct")


def _count(text: Column, char_class: str) -> Column:
    """Number of characters of a class; one pass that drops the runs of all others."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", "")).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the numbers the rules look at (all long; 0 for a null or empty text).

    n_repeat_words counts the words in 3-word windows that the text holds twice or more. Windows
    are keyed by a hash with the position in the low bits; after a primitive sort equal windows
    are neighbours, and the words of neighbours with one hash are compared, so a text of n words
    costs O(n log n) in its own row, without any shuffle.
    """
    t = text_of(text_col)
    lines = F.expr(r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')")
    out = (
        docs.withColumn("_t", t)
        .withColumn("_w", words_of(F.col("_t")))
        .withColumn("_lines", lines)
        .withColumn("_h", F.expr("if(size(_w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
        .withColumn("_bits", F.expr("case when size(_w) < 65536 then 16 when size(_w) < 16777216 then 24 else 31 end"))
        .withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<bigint>), sort_array(transform(_h, (h, i) -> shiftleft(h, _bits) | i)))"))
        .withColumn("_low", F.expr("shiftleft(1L, _bits) - 1"))
        .withColumn("_d", F.expr(f"transform(filter(sequence(0, greatest(size(_s) - 1, 0)), j -> size(_s) > 0 and ({_same('j', 'j + 1')} or {_same('j - 1', 'j')})), j -> _s[j] & _low)"))
    )
    return out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": _count(F.col("_t"), SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr("cast(size(array_distinct(concat(_d, transform(_d, p -> p + 1), transform(_d, p -> p + 2)))) as bigint)"),
            "n_lines": F.size("_lines").cast("long"),
            "n_upper": _count(F.col("_t"), r"\p{Lu}"),
            "n_bangs": _count(F.col("_t"), "!"),
            "n_stops": _count(F.col("_t"), ".?;:"),
            "n_marked": F.expr(f"if(_t rlike '[{SYMBOLS}]', size(filter(_w, w -> w rlike '[{SYMBOLS}]')), 0)").cast("long"),
            "n_letters": _count(F.col("_t"), r"\p{L}"),
            "n_distinct": F.size(F.array_distinct("_w")).cast("long"),
        }
    ).drop("_t", "_w", "_lines", "_h", "_bits", "_s", "_low", "_d")


def _same(a: str, b: str) -> str:
    """Whether the sorted window keys at a and b stand for the same three words."""
    p, q = f"cast(get(_s, {a}) & _low as int)", f"cast(get(_s, {b}) & _low as int)"
    words = " and ".join(f"_w[{p} + {k}] = _w[{q} + {k}]" for k in range(3))
    return f"coalesce(shiftright(get(_s, {a}), _bits) = shiftright(get(_s, {b}), _bits) and {words}, false)"


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(value: Column, good: tuple[float, float], bad_below: float, bad_above: float, when: Column | None = None) -> Column:
    v = F.when(value.between(*good), F.lit(1)).when((value < bad_below) | (value > bad_above), F.lit(0))
    return v if when is None else F.when(when, v)


def rules() -> dict[str, Column]:
    """The voters: name to a column of 1 (good), 0 (bad) or null (abstains)."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": _vote(per_word("n_symbols"), (0.0, 0.02), -1.0, 0.15),
        "marked": _vote(per_word("n_marked"), (0.0, 0.02), -1.0, 0.2),
        "letters": _vote(per_char("n_letters"), (0.92, 1.0), 0.88, 1.0),
        "repeats": _vote(per_word("n_repeat_words"), (0.0, 0.12), -1.0, 0.35),
        "dup_lines": _vote(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), (0.0, 0.2), -1.0, 0.45, F.col("n_lines") >= 4),
        "distinct": _vote(per_word("n_distinct"), (0.45, 1.0), 0.3, 1.0, F.col("n_words") >= 50),
        "upper": _vote(per_char("n_upper"), (0.0, 0.15), -1.0, 0.4),
        "bangs": _vote(per_word("n_bangs"), (0.0, 0.06), -1.0, 0.4),
        "word_length": _vote(per_word("word_chars"), (3.0, 9.0), 2.0, 14.0),
        "stops": _vote(per_word("n_stops"), (0.02, 0.5), 0.004, 1.0, F.col("n_words") >= 100),
    }


def fit(patterns: list[tuple[int, dict]], kinds: dict[str, tuple[str, ...]] = KINDS, rounds: int = 300, smooth: float = 1.0) -> dict:
    """EM over vote patterns: pairs of a number of documents and their votes by rule.

    Returns the share of each class ("good" and the kinds) and each rule's rate of good votes by
    class. EM starts from rules that are right on 95% of good texts and on 90% of the texts of their own kind, and
    that pass 80% of other bad texts; 80% of texts are taken to be good at first.
    """
    names = [r for rules_of in kinds.values() for r in rules_of]
    classes = ["good", *kinds]
    share = np.array([0.8, *[0.2 / len(kinds)] * len(kinds)])
    rate = np.array([[0.95 if c == "good" else 0.1 if r in kinds[c] else 0.8 for r in names] for c in classes])
    n = np.array([float(k) for k, _ in patterns])
    passed = np.array([[votes.get(r) == 1 for r in names] for _, votes in patterns], float).reshape(len(patterns), len(names))
    failed = np.array([[votes.get(r) == 0 for r in names] for _, votes in patterns], float).reshape(len(patterns), len(names))
    for _ in range(rounds if len(patterns) else 0):
        score = np.log(share) + passed @ np.log(rate).T + failed @ np.log(1 - rate).T
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight *= (n / weight.sum(axis=1))[:, None]
        share = (weight.sum(axis=0) + smooth) / (n.sum() + smooth * len(classes))
        hits, misses = weight.T @ passed, weight.T @ failed
        before, rate = rate, (hits + smooth) / (hits + misses + 2 * smooth)
        if np.abs(before - rate).max() < 1e-7:
            break
    return {"share": dict(zip(classes, share.tolist(), strict=True)), "rate": {c: dict(zip(names, row.tolist(), strict=True)) for c, row in zip(classes, rate, strict=True)}}


def posterior(model: dict) -> Column:
    """Probability of a good text given the votes in the columns v_<rule>."""
    against = F.lit(0.0)
    share, rate = model["share"], model["rate"]
    for kind in share:
        if kind != "good":
            odds = F.lit(float(np.log(share[kind] / share["good"])))
            for r, p in rate[kind].items():
                good = rate["good"][r]
                odds += F.when(F.col(f"v_{r}") == 1, float(np.log(p / good))).when(F.col(f"v_{r}") == 0, float(np.log((1 - p) / (1 - good)))).otherwise(0.0)
            against += F.exp(odds)
    return 1 / (1 + against)


def quality_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs (or its columns ``keep``) with the counts, base_failed, quality (posterior) and kept.

    A null or empty text has no words and so fails the base rule; repeated rows are judged alike;
    an empty table gives an empty result. A column of docs that has the name of a count is
    replaced by it. Rows are never joined or dropped: the result has one row per input row.
    """
    names = list(rules())
    fresh = [*_COUNTS, "base_failed", "quality", "kept"]
    kept_cols = [c for c in (docs.columns if keep is None else keep) if c not in fresh]
    counted = with_counts(docs.select(*dict.fromkeys([*kept_cols, text_col])), text_col)
    # the counts are costly and used twice: by EM and for the verdicts
    voted = materialise(counted.select(*kept_cols, *_COUNTS).withColumn("base_failed", base_failed()).withColumns({f"v_{r}": v for r, v in rules().items()}), "votes")
    # at most 3**10 rows, whatever the size of the corpus
    patterns = voted.groupBy(*(f"v_{r}" for r in names)).agg(F.count("*").alias("n")).collect()
    model = fit([(x["n"], {r: x[f"v_{r}"] for r in names}) for x in patterns])
    out = voted.withColumn("quality", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return out.drop(*(f"v_{r}" for r in names))
