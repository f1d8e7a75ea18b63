"""What grows with the input: rows in scratch tables and shuffles, work done twice."""

import math
import random
import re
import statistics
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.functions import text as X
from millrace.operators import align, counting, elements, lm, matching, mining, pairs, tagger, windows
from millrace.operators.grammar import collocation_grammar, default_grammar


def _sentences(n, seed=3):
    rng = random.Random(seed)
    some = lambda k: [f"w{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randint(1, k))]
    return [(i, some(8), some(15)) for i in range(n)]


def _plain_em(rows, rounds):
    table = defaultdict(lambda: 1.0)
    for _ in range(rounds):
        c, total = Counter(), Counter()
        for _, src, tgt in rows:
            for t in tgt:
                z = sum(table[s, t] for s in src)
                for s in src:
                    c[s, t] += table[s, t] / z
                    total[s] += table[s, t] / z
        table = {(s, t): v / total[s] for (s, t), v in c.items()}
    return table


def test_alignment_keeps_no_row_for_a_word_pair(spark, monkeypatch):
    rows, written = _sentences(60), []
    keep = align.materialise
    monkeypatch.setattr(align, "PART_PAIRS", 500, raising=False)
    monkeypatch.setattr(align, "materialise", lambda df, label: written.append(keep(df, label)) or written[-1])
    monkeypatch.setattr(align, "drop", lambda table: None, raising=False)
    pairs = spark.createDataFrame(rows, "pair_id bigint, src array<string>, tgt array<string>")
    got = {(r.s, r.t): r.p for r in align.model_one(pairs, 3).collect()}
    assert got == pytest.approx(_plain_em(rows, 3))
    word_pairs = sum(len(set(s)) * len(set(t)) for _, s, t in rows)
    assert max(t.count() for t in written) < word_pairs / 4


def test_alignment_with_empty_sides_and_the_null_word(spark):
    rows = [(1, ["a", "a"], ["x", "y"]), (2, [], ["x"]), (3, ["a"], []), (4, None, None)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, src array<string>, tgt array<string>")
    assert {(r.s, r.t): r.p for r in align.model_one(pairs, 2).collect()} == pytest.approx({("a", "x"): 0.5, ("a", "y"): 0.5})
    assert {(r.s, r.t) for r in align.model_one(pairs, 1, null_word=True).collect()} == {("a", "x"), ("a", "y"), ("NULL", "x"), ("NULL", "y")}


def test_cooccurrence_shuffles_no_word_pairs(spark):
    rows = _sentences(60)
    pairs = spark.createDataFrame(rows, "pair_id bigint, src array<string>, tgt array<string>")
    out = counting.cooccurrence(pairs)
    assert sorted((r.src, r.tgt) for r in out.collect()) == sorted({(s, t) for _, a, b in rows for s in a for t in b})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(src" not in plan and "Generate explode" not in plan


def test_tagger_searches_each_text_once(spark, monkeypatch):
    taken = []
    keep = tagger.needed_phrases
    monkeypatch.setattr(tagger, "needed_phrases", lambda lines, *a: taken.append(lines.count()) or keep(lines, *a))
    lines = spark.range(40).select("id", F.when(F.col("id") % 4 < 3, F.concat(F.lit("甲乙"), (F.col("id") % 4).cast("string"))).alias("value"))
    phrases = spark.createDataFrame([("甲乙", "甲 乙", "Na Nb", -1.0)], "zh string, zh_seg string, tag string, pr double")
    out = tagger.tag_lines(lines, phrases, lm.BackoffModel({"<unk>": (-1.0, None)}, 1))
    assert out.columns == ["id", "value", "zh", "zh_seg", "tag", "tag_cat", "pr"] and taken == [4]
    got = {r.id: r for r in out.collect()}
    assert len(got) == 40 and all(r.value is None or r.value in r.zh_seg.replace(" ", "") for r in got.values())
    assert got[6].zh_seg == got[2].zh_seg and (got[3].zh, got[3].pr) == ("", 0.0)


def test_phrases_by_packed_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "PART_TOKENS", 50)
    rng = random.Random(5)
    rows = [([w := rng.choices(["a", "b", "ß", "d e"], k=rng.randint(0, 9)), [f"T{len(x)}{rng.randint(0, 1)}" for x in w]]) for _ in range(80)] + [(None, None), (["solo"], ["T"])]
    want = Counter((" ".join(w[i : i + k]), " ".join(t[i : i + k])) for w, t in rows if w for k in range(1, 6) for i in range(len(w) - k + 1))
    out = counting.phrase_counts(spark.createDataFrame(rows, "words array<string>, tags array<string>"))
    assert "gram" not in str(out.columns) and out.count() == len(want)
    got = {(r.zh_seg, r.tag): r for r in out.collect()}
    assert {k: r["count"] for k, r in got.items()} == dict(want)
    assert got["solo", "T"].pr == pytest.approx(math.log(1 / sum(want.values()))) and got["solo", "T"].zh == "solo"
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastNestedLoopJoin" not in plan


def test_language_model_counts_once(spark, monkeypatch):
    written, keep = [], lm.materialise
    monkeypatch.setattr(lm, "materialise", lambda df, label: written.append((label, df._jdf.queryExecution().executedPlan().toString())) or keep(df, label))
    sents = spark.createDataFrame([(["a", "b", "a"],), (["b"],), ([],)], "words array<string>")
    tables = lm.adjusted_counts(sents, 3)
    assert all("Generate" not in plan for _, plan in written)
    assert {(r.gram, r.n) for t in tables for r in t.collect()} == {
        ("a", 2), ("b", 2), ("</s>", 3), ("<s> a", 1), ("<s> b", 1), ("<s> </s>", 1), ("a b", 1), ("b a", 1), ("a </s>", 1), ("b </s>", 1),
        ("<s> a b", 1), ("a b a", 1), ("b a </s>", 1), ("<s> b </s>", 1),
    }
    assert {(r.gram, r.n) for r in lm.adjusted_counts(sents, 1)[0].collect()} == {("a", 2), ("b", 2), ("</s>", 3)}


@pytest.mark.parametrize("kind", ["grammar", "collocation"])
def test_matcher_makes_elements_once_for_each_kind_of_token(kind, monkeypatch):
    grammar = default_grammar() if kind == "grammar" else collocation_grammar()
    made, keep = [], elements.grammar_elements if kind == "grammar" else elements.collocation_elements
    monkeypatch.setattr(matching, f"{kind}_elements", lambda *t, **k: made.append(1) or keep(*t, **k))
    rng, size = random.Random(7), 0
    words = ["it", "In", "in", "order", "to", "'s", "dog’s", "herself", "seem", "what", "run", "the", "thing", "anything", "of", "up", "big", "s"]
    poss = ["NN", "NNS", "VBP", "VBN", "IN", "JJ", "TO", "RB", "PRP", "DT", "RP", "WP", "CD"]
    chunks = ["H-NP", "I-NP", "H-VP", "I-VP", "H-PP", "H-SBAR", "I-SBAR", "H-PRT", "H-ADJP", "O"]
    matcher = matching.Matcher(grammar, kind, None)
    assert matcher.candidates([], [], [], [], None) == []
    for _ in range(400):
        n = rng.randint(1, 14)
        w, t, c = rng.choices(words, k=n), rng.choices(poss, [9, 2, 6, 2, 5, 3, 4, 1, 2, 3, 1, 1, 1], k=n), rng.choices(chunks, [6, 4, 6, 2, 4, 2, 1, 1, 1, 1], k=n)
        sent = w, [x.lower() for x in w], t, c
        vocab = None if n % 2 else {"run", "dog’s", "seem"}
        want = matching.candidates(keep(*sent), w, sent[1], grammar, vocab)
        assert sorted(map(str, matcher.candidates(*sent, vocab))) == sorted(map(str, want))
    size = len(made)
    for _ in range(50):
        matcher.candidates(*sent, None)
    assert len(made) == size


def test_pattern_rows_use_the_matcher(spark, monkeypatch):
    monkeypatch.setattr(matching, "candidates", None)
    monkeypatch.setattr(matching.Matcher, "STATES", 0)
    sents = spark.createDataFrame([("I have great difficulty in understanding him .".split(), "I have great difficulty in understand him .".split(), "PRP VBP JJ NN IN VBG PRP .".split(), "H-NP H-VP I-NP H-NP H-PP H-VP H-NP O".split())], "words array<string>, lemmas array<string>, poss array<string>, chunks array<string>")
    rows = matching.pattern_rows(sents, default_grammar(), None).collect()
    assert ("difficulty:N", "difficulty in doing") in {(r.wordpos, r.pat) for r in rows}
    bare = matching.pattern_rows(sents, default_grammar(), None, instances=False)
    assert bare.columns == ["wordpos", "pat"] and sorted(map(tuple, bare.collect())) == sorted((r.wordpos, r.pat) for r in rows)


def _plain_good(texts, least=5, deviations=1.0):
    counts = Counter(p for t in texts if t for w in [re.findall("[a-z]+", "".join(c.lower() if c.isascii() else " " for c in t))] for p in zip(w, w[1:], strict=False))
    own = defaultdict(list)
    for (k, _), n in counts.items():
        own[k].append(n)
    dev = {k: statistics.pstdev(v) for k, v in own.items()}
    return {(k, p): (n, sum(own[k]), pytest.approx(statistics.mean(own[k])), pytest.approx(dev[k])) for (k, p), n in counts.items() if n > least and dev[k] and (n - statistics.mean(own[k])) / dev[k] > deviations}


def test_good_patterns_keep_no_row_for_a_rare_pair(spark, monkeypatch, tmp_path):
    written, keep = [], mining.materialise
    monkeypatch.setattr(mining, "materialise", lambda df, label: written.append((keep(df, label), df._jdf.queryExecution().executedPlan().toString())) or written[-1][0])
    monkeypatch.setattr(pairs, "PART_BYTES", 500)
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "B", "b", "cé", "the", "the", f"x{'yz'[n % 2] * (n % 9)}"]) + rng.choice([" ", "\n", ", ", "\u3000", "  "]) for _ in range(rng.randint(0, 30))) for n in range(150)]
    texts += [None, "", " ", "İı K", "solo", "a", "equal one " * 7, "...", None, "p q", "p q."] + ["m n", "m o"] * 7
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.good_patterns(spark, str(tmp_path))
    want = _plain_good(texts)
    assert {(r.key, r.pat): (r.cnt, r.freq, r.avg_freq, r.dev) for r in out.collect()} == want and len(want) > 5
    ((table, plan),) = written
    assert "Generate" not in plan and "HashAggregate" not in plan
    assert table.filter("pat IS NOT NULL AND cnt <= 5").count() == 0 and table.select("key").distinct().count() > 20


def test_texts_are_packed_by_bytes(monkeypatch):
    monkeypatch.setattr(pairs, "PACKED", 10)
    rows = ["abc", None, "defg", "x" * 25, "", "hij", "k" * 10, "l", "m"]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 4], pa.string())], ["t"]) for i in (0, 4, 8)]
    groups = [[x.decode() for a in held for x in a.to_pylist()] for held in pairs._texts(batches)]
    assert sum(groups, []) == [r for r in rows if r is not None]
    assert all(sum(map(len, g)) <= 10 or len([x for x in g if x]) == 1 for g in groups)
    assert list(pairs._texts([])) == []
    words, a, b, n = pairs._pairs([pa.array([b"", b" a b a b", b"..", b"b c"], pa.large_binary())], pairs.ASCII_WORDS)
    names = words.to_pylist()
    assert sorted((names[i], names[j], int(k)) for i, j, k in zip(a, b, n, strict=True)) == [("a", "b", 2), ("b", "a", 1), ("b", "c", 1)]
    assert len(pairs._pairs([pa.array([b"", b"a"], pa.large_binary())], pairs.ASCII_WORDS)[3]) == 0


def _plain_marks(text, pattern, placeholder):
    """The marked text and what was replaced, by the surveyed patterns."""
    out, found = [], []
    for part in re.findall(r"\{\{.*?\}\}|\{\{.*$|[^{]+|\{", text):
        if part.startswith("{{"):
            out.append(part)
            found += [placeholder] * part.endswith(placeholder)
        else:
            out.append(re.sub(pattern, placeholder, part))
            found += re.findall(pattern, part)
    return "".join(out), found


def test_placeholders_make_their_texts_once(spark):
    number, latin = f"[{X.NUMERALS}]+|[0-9]+", r"[-/.﹒~—─=*&_’]*[A-Za-z][-A-Za-z/.﹒~—─=*&_’]*"
    rng = random.Random(17)
    some = ["{{", "}}", "{", "}", "{{CD}}", "{{FW}}", "1", "23", "四五", "億", "a", "Zb", "é", "—", "’", "﹒", "--", "=*", ".", "-", "–", "京", "龍", " ", "\n", "😀", "K"]
    texts = ["", "-" * 300_000, "x" + "-" * 300_000 + "y", "=" * 50_000 + "1"]
    texts += ["".join(rng.choices(some[4 * (n % 2 and n % 3 > 0) :], k=rng.randint(1, 14))) for n in range(1500)]
    t = F.col("t")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    parts = {"n": X.mark_numbers(t), "l": X.mark_latin(t), "no": X.number_originals(t), "lo": X.latin_originals(t), "both": X.mark(t)}
    got = df.withColumns(parts | {"rn": X.restore(X.mark_numbers(t), X.NUMBER, X.number_originals(t)), "rl": X.restore(X.mark_latin(t), X.LATIN, X.latin_originals(t))})
    for r in got.collect():
        n, l = _plain_marks(r.t, number, X.NUMBER) if len(r.t) < 99 else (r.n, r.no), _plain_marks(r.t, latin, X.LATIN) if len(r.t) < 99 else (r.l, r.lo)
        assert (r.n, r.no, r.l, r.lo) == (*n, *l), r.t[:99]
        assert r.both == (_plain_marks(n[0], latin, X.LATIN)[0] if len(r.t) < 99 else r.both) and r.rn == r.rl == r.t
        if len(r.t) > 99:
            assert r.both == {1: r.t, 2: X.LATIN, 3: r.t[:-1] + X.NUMBER}[r.i]
    plan = df.select(X.restore(X.mark_latin(t), X.LATIN, X.latin_originals(t)).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert spark.sql("SELECT CAST(NULL AS string) t").select(*parts.values(), X.restore(t, X.LATIN, X.latin_originals(t))).first()[:] == (None,) * 6
