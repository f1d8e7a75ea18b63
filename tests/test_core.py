"""The engine's own operators on literal fixtures, and whole queries on them."""

import math
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import sequences as S
from millrace.functions import text as X
from millrace.operators import align, counting, evaluate, lines, lm, matching, mining, projection, tagged, tagger
from millrace.operators.elements import collocation_elements, grammar_elements
from millrace.operators.grammar import collocation_grammar, default_grammar, read_grammar, unfold
from millrace.plans.components import components
from millrace.plans.lifecycles import mine_patterns, project_patterns
from millrace.plans.lookup import attach
from millrace.sources import lines as L
from millrace.sources import tables as T

SENTENCE = (
    "I have great difficulty in understanding him .", "I have great difficulty in understand him .",
    "PRP VBP JJ NN IN VBG PRP .", "H-NP H-VP I-NP H-NP H-PP H-VP H-NP O",
)
VOCAB = set(" ".join(SENTENCE[:2]).split())


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def file_lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def in_order(df, column="value"):
    return [r[column] for r in df.orderBy("line_no").collect()]


def sentences(spark, *sents):
    return spark.createDataFrame([tuple(p.split() for p in s) for s in sents], "words array<string>, lemmas array<string>, poss array<string>, chunks array<string>")


def test_line_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("c\nb\n\na\tx\ty\n", encoding="utf-8")
    read = L.read_lines(spark, str(tmp_path / "a.txt"))
    assert in_order(read) == ["c", "b", "", "a\tx\ty"]
    L.write_lines(read, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "c\nb\n\na\tx\ty\n"
    two = {r.line_no: (r.left, r.right) for r in L.split_two(read).collect()}
    assert two[3] == ("a", "x\ty") and two[0] == ("c", None)
    bars = L.split_bar_tags(file_lines(spark, ["w1\tw2|||x|||t1\tt2"])).first()
    assert (bars.text, bars.tag) == ("w1 w2|||x", "t1 t2")
    with pytest.raises(Exception, match="wrong number of columns"):
        L.split_columns(read, 3).collect()
    assert L.phrasal_verbs(file_lines(spark, ["carry_out_of ", "get"])).orderBy("verb").collect()[0][:] == ("carry", 3, "out_of")


def test_line_operators(spark):
    a, b = file_lines(spark, ["a", "b", "c"]), file_lines(spark, ["x", "y"])
    merged = lines.interleave(a, b)
    assert in_order(merged) == ["a", "x", "", "b", "y", ""]
    src, tgt = lines.split_pairs(merged)
    assert (in_order(src), in_order(tgt)) == (["a", "b"], ["x", "y"])
    seven = file_lines(spark, list("abcdefg"))
    assert in_order(lines.slice_groups(seven, 3, slice(None, None, 2))) == ["a", "c", "d", "f"]
    with pytest.raises(AssertionError):
        lines.slice_groups(seven, 3, "x")
    assert in_order(lines.unpivot_columns(L.split_columns(file_lines(spark, ["a\tb", "c\td"]), 2))) == ["a", "b", "", "c", "d", ""]
    groups = lines.blank_line_groups(file_lines(spark, ["a", "b", "", "", "c"])).orderBy("record").collect()
    assert [r["values"] for r in groups] == [["a", "b"], [], ["c"]]
    assert lines.merge_tags(lines.groups_of(file_lines(spark, ["w v u", "T S", ""]), 3)).first().value == "w/T v/S"
    parts = lines.fold_split(file_lines(spark, ["x"] * 65)).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 54, "test": 6}
    assert one(spark, lines.strip_tags(F.col("c")), c="a/b/T c") == "a c"
    assert one(spark, lines.strip_stops(F.col("c")), c="。。我。你。") == "我。你"
    routes = spark.createDataFrame([(["B-VP", "O"],), (["O", "B-NP"],), (["B-NP", "B-VP"],), ([],)], "chunks array<string>")
    assert [r.route for r in lines.route_chunks(routes).collect()] == ["vp", "pure_np", "np", "pure_np"]
    assert lines.sample_lines(seven, 3).collect() == lines.sample_lines(seven.repartition(3), 3).collect()


def test_text_functions(spark):
    c = F.col("c")
    assert one(spark, X.to_half_width(c), c="ＡＢ１２　三百～") == "AB12 三百~"
    assert one(spark, X.squeeze(c), c="　\t a b  ") == "a b"
    assert one(spark, X.preprocess(c), c="ＡＢ１２　三百 x-ray {{CD}} {{") == "{{FW}}{{CD}} {{CD}} {{FW}} {{CD}} {{"
    assert one(spark, X.char_tokens(c), c="我 {{CD}}b　c") == ["我", "{{CD}}", "b", "c"]
    assert one(spark, X.clause_split(c), c="a,b;;c") == ["a,", "b;", ";", "c"]
    assert one(spark, X.chinese_sentences(c), c="「好。」他说。走！") == ["「好。」他说。", "走！"]
    assert one(spark, X.english_sentences(c), c='He left. "Go!" She did.') == ["He left.", '"Go!"', "She did."]
    assert one(spark, X.word_tokens(c), c="They can't say \"no\", he's 1,000.") == ["They", "ca", "n't", "say", "``", "no", "''", ",", "he", "'s", "1,000", "."]
    assert one(spark, X.to_ascii(c), c="naïve straße — “Ł”") == 'naive strasse - "L"'
    assert one(spark, X.lower_first(c), c="ABc") == "aBc"
    assert [one(spark, X.is_number(c), c=v) for v in ("1e3", "x")] == [True, False]


def test_placeholder_round_trip(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1２三 ,-/.我X") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], ["c"]).withColumn("h", X.to_half_width(F.col("c")))
    df = df.withColumn("m", X.mark_numbers(F.col("h"))).withColumn("l", X.mark_latin(F.col("m")))
    back = X.restore(X.restore(F.col("l"), X.NUMBER, X.number_originals(F.col("h"))), X.LATIN, X.latin_originals(F.col("m")))
    assert df.filter(back != F.col("h")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["O", "B-NP", "I-NP", "B-VP", "I-VP"]), max_size=12))
def test_chunks(spark, tags):
    got = one(spark, S.to_inside_head(F.split("c", " ")), c=" ".join(tags)) if tags else []
    assert len(got) == len(tags)
    for i, t in enumerate(tags):
        last = i + 1 == len(tags) or not tags[i + 1].startswith("I-")
        assert got[i] == ("O" if t == "O" else ("H-" if last else "I-") + t[2:])


def test_sequences(spark):
    w = F.split("c", " ")
    assert one(spark, S.ngrams(w, 2), c="a b c") == ["a b", "b c"] and one(spark, S.ngrams(w, 4), c="a b c") == []
    assert one(spark, S.numbered(w), c="sth of sth V") == ["sth1", "of", "sth2", "V"]
    assert one(spark, S.overlap_score(w, F.split("d", " ")), c="a b", d="b c") == pytest.approx(2 / 3)
    assert one(spark, S.align_map(w), c="0-1 2-0 0-0") == {0: [1, 0], 2: [0]}
    assert one(spark, S.locate_run(w, F.split("d", " ")), c="a b a c", d="a c") == 2


def test_golden_patterns(spark):
    rows = matching.pattern_rows(sentences(spark, SENTENCE), default_grammar(), VOCAB).collect()
    assert sorted((r.wordpos, r.pat, r.iocs, r.example, r.instance_sym) for r in rows) == [
        ("difficulty:N", "difficulty in doing", "difficulty in understand", "[difficulty in understanding]", {0: "N", 1: "in", 2: "doing"}),
        ("great:ADJ", "great sth", "great difficulty", "[great difficulty]", {0: "ADJ", 1: "sth"}),
        ("have:V", "have sth", "have difficulty", "[have great difficulty]", {0: "V", 2: "sth"}),
        ("understand:V", "understand sth", "understand him", "[understanding him]", {0: "V", 1: "sth"}),
    ]
    unequal = (*SENTENCE[:3], "H-NP")
    assert matching.pattern_rows(sentences(spark, unequal), default_grammar(), VOCAB).count() == 0
    assert matching.pattern_rows(sentences(spark, SENTENCE), default_grammar(), {"zebra"}).count() == 0
    found = matching.pattern_rows(sentences(spark, SENTENCE), collocation_grammar(), VOCAB, "collocation").collect()
    assert ("have:V", "(V sth)have difficulty") in {(r.wordpos, r.pat) for r in found}
    combined = matching.combined_rows(sentences(spark, SENTENCE), default_grammar(), collocation_grammar(), VOCAB).collect()
    assert sorted((r.wordpos, r.pat, r.iocs, r.example) for r in combined) == [
        ("difficulty:N", "great difficulty in doing", "great difficulty in understand", "[great difficulty in understanding]"),
        ("difficulty:N", "have difficulty in doing", "have difficulty in understand", "[have great difficulty in understanding]"),
        ("have:V", "i have sth", "i have difficulty", "[i have great difficulty]"),
    ]


def _brute(elements, grammar):
    """All ways to choose an element or a skip for the tokens around a keyword, tested one by one."""
    out, keys = [], set(grammar.keywords)

    def side(run, count, most):
        ways = [[]]
        done = [] if count else [[]]
        for j, own in enumerate(run):
            if not own or not ways or j > most:
                break
            grown = []
            for way in ways if count else []:
                options = [(e, j) for e in own if e not in keys and e != "_"]
                grown += [[*way, o] for o in options]
                if "_" in own:
                    grown.append(way)
            done += [g for g in grown if len(g) == count and g[-1][1] == j] if count else []
            ways = [g for g in grown if len(g) < count]
        return done

    for i, own in enumerate(elements):
        held = [e for e in own if e in keys]
        for (k, n, at), patterns in grammar.buckets.items():
            if not held or held[0] != k or i < at or len(elements) - i - 1 < n - at - 1:
                continue
            for a in side(elements[:i][::-1], at, 3 * at):
                for b in side(elements[i + 1 :], n - at - 1, 3 * (n - at - 1)):
                    tokens = [e for e, _ in a[::-1]] + [k] + [e for e, _ in b]
                    if " ".join(tokens) in patterns:
                        out.append((k, i, tokens, [i - 1 - j for _, j in a[::-1]] + [i] + [i + 1 + j for _, j in b]))
    return out


def test_candidates_against_all_products():
    rng, grammar = random.Random(8), default_grammar()
    tags = ["NN", "VBP", "VBG", "IN", "JJ", "DT", "TO", "PRP", "RB", "MD", "VBN", "."]
    for _ in range(60):
        n = rng.randint(1, 9)
        poss = [rng.choice(tags) for _ in range(n)]
        chunks = [rng.choice(["H-NP", "I-NP", "H-VP", "H-PP", "O"]) for _ in range(n)]
        lemmas = [rng.choice(["in", "of", "it", "be", "that", "x"]) for _ in range(n)]
        elements = grammar_elements(lemmas, lemmas, poss, chunks)
        got = matching.candidates(elements, lemmas, lemmas, grammar, None)
        assert sorted(map(repr, got)) == sorted(map(repr, _brute(elements, grammar)))


def test_lines_of_several_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 3000), ("c", 30)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    want = [f"{name}{i}" for name, n in (("a", 3), ("b", 3000), ("c", 30)) for i in range(n)]
    read = lambda paths: [r.value for r in L.read_lines(spark, paths).orderBy("line_no").collect()]
    assert read(str(tmp_path)) == want
    assert read([str(tmp_path / f"{x}.txt") for x in "cab"]) == want[3003:] + want[:3003]
    assert [r.line_no for r in L.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == list(range(3033))


def test_long_texts(spark):
    text = "「" + "x" * 50_000 + "。" + "ab-" * 20_000 + "！" + "y" * 50_000
    row = spark.createDataFrame([(text,)], "t string").select(F.size(X.chinese_sentences(F.col("t"))).alias("n"), X.restore(X.mark_latin(F.col("t")), X.LATIN, X.latin_originals(F.col("t"))).alias("r")).first()
    assert row.n == 3 and row.r == text


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("millrace", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    script = "import __spark_entry__ as e; q = e.queries(); assert 'good_patterns' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        if (tmp_path / "corpus_pipeline.py").exists():
            (tmp_path / "corpus_pipeline.py").unlink()


def test_elements():
    assert grammar_elements(["John", "'s", "car"], ["John", "'s", "car"], ["NNP", "POS", "NN"], ["I-NP", "I-NP", "H-NP"]) == [["N", "one's", "sth"], ["_"], ["N", "sth"]]
    words = "carry out it".split()
    assert collocation_elements(words, words, ["VB", "RP", "PRP"], ["H-VP", "H-PRT", "H-NP"], {"carry": {2: {"out"}}}) == [["V", "do"], ["_"], ["one", "sth"]]
    assert matching.context("a b c d e f".split(), ["H", "I", "H", "H", "O", "H"], [4]) == ("d ", " f")
    assert unfold("V a|b+c sth") == ["V a sth", "V b c sth"]
    assert read_grammar("VERB\tg\tV about|at sth\n# note\n").groups == {"V about sth": "g", "V at sth": "g"}
    assert sum(map(len, collocation_grammar().buckets.values())) == 28


def test_mining(spark):
    rows = [("k", "p1", "i", "[p one]", {0: "N"}, 20), ("k", "p2", "i", "[p two]", {0: "N"}, 2), ("k", "p3", "j", "[p x]", {0: "N"}, 1), ("k", "p4", "j", "[p y]", {0: "N"}, 1), ("same", "a", "i", "[x]", {0: "V"}, 9), ("same", "b", "i", "[x]", {0: "V"}, 9)]
    data = spark.createDataFrame(rows, "wordpos string, pat string, iocs string, example string, instance_sym map<int,string>, cnt long")
    good = mining.good_patterns(data, n="cnt")
    r = good.first()
    counts = [20, 2, 1, 1]
    assert good.count() == 1 and (r.pat, r.cnt, r.freq, r.avg_freq) == ("p1", 20, 24, 6.0)
    assert r.dev == pytest.approx(math.sqrt(sum((c - 6) ** 2 for c in counts) / 4))
    table = mining.example_rollup(data, good)
    nice = mining.pretty(table).first()
    assert (nice.keyword, nice.keyword_count, nice.pattern, nice.pattern_count) == ("k", 24, "p1", 20)
    assert [(i.instance, i.tag) for i in nice.instances] == [("p one", {"0": "N"})]
    assert mining.top_instances(data, good).first()[:] == ("k", "p1", 1, "i", 20, "[p one]", 20)
    many = sentences(spark, *([SENTENCE] * 8))
    assert mine_patterns(many, VOCAB).count() == 0  # every keyword has one pattern only


def test_projection(spark, tmp_path):
    t = projection.target_pattern
    assert t({0: "V", 2: "sth1", 3: "of"}, {0: [0], 2: [3, 1], 3: [2]}, list("abcd")) == "a:V c:of sth1"
    assert t({0: "V"}, {}, ["a"]) is None and t({0: "V"}, {0: [5]}, ["a"]) is None and t({0: "V", 1: "sth"}, {0: [0], 1: [0]}, ["a"]) is None
    assert t({0: "xyz", 1: "V"}, {1: [0]}, ["a"]) == "a:V"
    table = T.phrase_table(file_lines(spark, ["he accept any form of criticism ||| 他 接受 任何 批評 ||| 0.5 0.5 0.5 0.5 2.7 ||| 1-1 2-2 5-3 ||| 1"]))
    r = table.first()
    assert r.scores == [0.5] * 4 and r.aligns == {1: [1], 2: [2], 5: [3]}
    back = T.phrase_table(file_lines(spark, ["a b ||| x y ||| 1 2 3 4 ||| 0-1 ||| 1"]), reverse=True).first()
    assert (back.en, back.scores, back.aligns) == ("x y", [3.0, 4.0, 1.0, 2.0], {1: [0]})
    pattern = [("accept:V", 108, "accept sth of sth", 3, [("accept any form of criticism", {"0": "V", "1": "sth", "4": "sth"})])]
    patterns = spark.createDataFrame(pattern, T.PATTERN_SCHEMA)
    got = projection.project(patterns, table).first()
    assert (got.pattern, got.ch_pattern, got.prob) == ("accept sth1 of sth2", "接受:V sth1 sth2", 0.0625)
    sents = spark.createDataFrame([(5, "he accept any form of criticism now", "他 接受 任何 批評 了"), (2, "he accept any", "他 接受 任何 批評")], "line_no long, en string, ch string")
    text = project_patterns(patterns, table, sents).first().value
    assert text == " |||  ||| accept sth1 of sth2 ||| 接受:V sth1 sth2 ||| 0.0625\nhe accept any form of criticism now他 接受 任何 批評 了"
    T.write_json_lines(patterns, str(tmp_path / "p"))
    assert T.read_json_lines(spark, str(tmp_path / "p")).collect() == patterns.collect()
    assert T.lexical_table(file_lines(spark, ["a b c 0.5"])).first()[:] == ("a", "b c", 0.5)
    assert T.aligner_configs("s $src t $tgt", "en", "zh") == {"src_tgt": "s en t zh", "tgt_src": "s zh t en"}


def test_language_model(spark):
    sents = [["a", "b"], ["a", "c", "b"], ["b"]]
    table = lm.kneser_ney(spark.createDataFrame([(s,) for s in sents], "words array<string>"), 3)
    rows = {r.gram: r for r in table.collect()}
    unigrams = [g for g, r in rows.items() if r.n == 1 and g not in ("<s>", "<unk>")]
    assert sum(10 ** rows[g].prob for g in unigrams) + 10 ** rows["<unk>"].prob == pytest.approx(1)
    model = lm.BackoffModel.collected(table)
    for context in ("a", "<s> a", "c"):
        words = [*unigrams, "never"]
        assert sum(10 ** model._one([*context.split(), w]) for w in words) == pytest.approx(1)
    assert model["a b"] == model[("a", "b")] < 0


def test_language_model_of_order_six(spark):
    """Against plain interpolated Kneser-Ney with modified discounts, all orders."""
    rng = random.Random(4)
    sents = [rng.choices("abcde", [8, 4, 2, 1, 1], k=rng.randint(1, 12)) for _ in range(150)]
    raw = {}
    for sent in sents:
        w = ("<s>", *sent, "</s>")
        for k in range(1, 7):
            for i in range(len(w) - k + 1):
                raw[w[i : i + k]] = raw.get(w[i : i + k], 0) + 1
    counts, gammas, probs = {}, {}, {}
    for g, n in raw.items():
        if g != ("<s>",):
            counts[g] = n if len(g) == 6 or g[0] == "<s>" else sum(x[1:] == g for x in raw if len(x) == len(g) + 1)
    for k in range(1, 7):
        own = {g: n for g, n in counts.items() if len(g) == k}
        t = [sum(n == m for n in own.values()) for m in range(1, 5)]
        d = [0.2] * 3
        if all(t):
            y = t[0] / (t[0] + 2 * t[1])
            found = [m - (m + 1) * y * t[m] / t[m - 1] for m in (1, 2, 3)]
            d = found if all(0 <= x <= m for m, x in enumerate(found, 1)) else d
        of_context = {}
        for g, n in own.items():
            of_context.setdefault(g[:-1], []).append(n)
        gammas |= {h: sum(d[min(n, 3) - 1] for n in ns) / sum(ns) for h, ns in of_context.items()}
        for g, n in own.items():
            below = probs[g[1:]] if k > 1 else 1 / (len(own) + 1)
            probs[g] = (n - d[min(n, 3) - 1]) / sum(of_context[g[:-1]]) + gammas[g[:-1]] * below
    got = {tuple(r.gram.split()): r for r in lm.kneser_ney(spark.createDataFrame([(s,) for s in sents], "words array<string>")).collect()}
    assert got.keys() == {*probs, ("<s>",), ("<unk>",)}
    for g, p in probs.items():
        assert got[g].n == len(g) and got[g].prob == pytest.approx(math.log10(p))
        assert got[g].backoff is None if g not in gammas else got[g].backoff == pytest.approx(math.log10(gammas[g]))


def test_tagger(spark):
    phrases = spark.createDataFrame([("我", "我", "Nh", 5, -1.0), ("下週", "下 週", "Nes Nf", 3, -2.0), ("下", "下", "Nes", 3, -9.0)], "zh string, zh_seg string, tag string, count int, pr double")
    tags = spark.createDataFrame([(["Nh", "Nes", "Nf"],)], "words array<string>")
    model = lm.BackoffModel.collected(lm.kneser_ney(tags, 2))
    got = tagger.tag_lines(spark.createDataFrame([(1, "我下週１２去"), (2, ""), (3, "Ab,我")], "i int, value string"), phrases, model).orderBy("i").collect()
    assert got[0].zh_seg.startswith("我 下 週") and got[0].tag.startswith("Nh Nes Nf") and got[0].tag_cat.startswith("Nh + Nes Nf")
    assert "12" in got[0].zh_seg and (got[1].zh_seg, got[1].pr) == ("", 0.0) and got[2].zh_seg.startswith("Ab")
    assert spark.createDataFrame([got[0]]).select(T.cli_format("/").alias("v")).first().v.startswith("我/Nh 下/Nes 週/Nf")


def test_tagger_beyond_its_limits(spark):
    phrases = spark.createDataFrame([("我", "我", "Nh", -1.0), ("下週", "下 週", "Nes Nf", -2.0), ("下週", "下週", "Nd", -3.0), ("下", "下", "Nes", -9.0), ("去", "去", "D", -2.5)], "zh string, zh_seg string, tag string, pr double")
    table = lm.kneser_ney(spark.createDataFrame([(["Nh", "Nes", "Nf", "D"],), (["Nh", "Nd"],), (["D"],)], "words array<string>"), 3)
    rows = spark.createDataFrame([(1, "我下週１２去"), (2, ""), (3, "Ab,我"), (4, "去我,下週下"), (5, None), (6, "我下週１２去")], "i int, value string")
    small, filed = lm.BackoffModel.collected(table), lm.BackoffModel.collected(table, 2)
    for tags in ("Nh Nes Nf D", "Nd Nh", "never D D Nh", ""):
        assert filed[tags] == small[tags]
    want = tagger.tag_lines(rows, phrases, small).orderBy("i").collect()
    assert want[3].zh_seg.startswith("去 我") and want[5][2:] == want[0][2:]
    assert tagger.tag_lines(rows, phrases, filed, most_phrases=2).orderBy("i").collect() == want


def test_toktag_reaches_the_lookup(spark, tmp_path):
    from millrace.queries import UNSPACED, toktag

    names = ["small ring", "red widget", "small widget", "ring", "Red bolt"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey int, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    back = str.maketrans(UNSPACED, "abcdefghijklmnopqrstuvwxyz")
    got = {r.p_partkey: r for r in toktag(spark, str(tmp_path)).collect()}
    assert {k: r.zh_seg.translate(back) for k, r in got.items()} == {k: n.lower() for k, n in enumerate(names)}
    assert got[0].tag == "L5 L4" and got[3].tag == "L4" and all(r.pr > tagger.UNKNOWN_PR for r in got.values())


def test_counting(spark):
    rows = spark.createDataFrame([(["A", "b", "B"], ["1", "2", "3"]), (["A", "B"], ["1", "3"])], "words array<string>, tags array<string>")
    counts = {(r.zh_seg, r.tag): (r["count"], r.pr) for r in counting.phrase_counts(rows).collect()}
    assert counts["A", "1"] == (2, pytest.approx(math.log(2 / 9))) and counts["A B", "1 3"][0] == 1
    assert {r.lower: r.word for r in counting.truecase_model(rows).collect()} == {"b": "B"}
    vocab = counting.vocabulary(rows)
    assert [(r.id, r.word, r.n) for r in vocab.orderBy("id").collect()] == [(2, "A", 2), (3, "B", 2), (4, "b", 1)]
    keyed = rows.withColumn("k", F.monotonically_increasing_id())
    assert sorted(r.ids for r in counting.numericalise(keyed, vocab, "k").collect()) == [[2, 3], [2, 4, 3]]
    assert counting.vocabulary_gate(keyed, vocab.filter("word = 'b'"), "k", F.col("words")).count() == 1


def test_alignment_and_evaluation(spark):
    pairs = spark.createDataFrame([(1, ["the", "house"], ["das", "haus"]), (2, ["the", "book"], ["das", "buch"]), (3, ["a", "book"], ["ein", "buch"])], "pair_id long, src array<string>, tgt array<string>")
    table = {(r.s, r.t): r.p for r in align.model_one(pairs, 5).collect()}
    assert table["book", "buch"] > 0.8 and table["the", "das"] > 0.8
    aligned = {r.pair_id: r.aligns for r in align.best_alignment(pairs, align.model_one(pairs, 5)).collect()}
    assert aligned[2] == "0-0 1-1"
    diff = evaluate.diff_lines(spark.createDataFrame([(0, "a b c", "a x c d")], "line_no long, src string, tgt string"))
    assert diff.first().value == "a [-b-] {+x+} c {+d+}"
    assert [r.word for r in evaluate.error_words(evaluate.error_spans(diff)).collect()] == ["b"]
    articles = spark.createDataFrame([(1, ["a b", "c"], ["b", "c"]), (2, ["a"], [])], "article_id long, en array<string>, ch array<string>")
    split = evaluate.split_articles(articles, lambda c: X.tokens(c)).collect()
    assert len(split) == 2 and split[0].score == pytest.approx((1 / 2 * 2 + 1) / 3)


def test_tagged_blocks(spark):
    blocks = ["I\tI\tPRP\tB-NP\tO", "go\tgo\tVBP\tB-VP\tO", "", "", "x\tx\tNN\tB-NP\tO"]
    got = tagged.from_blocks(file_lines(spark, blocks)).orderBy("record").collect()
    assert [r.chunks for r in got] == [["H-NP", "H-VP"], ["H-NP"]]
    line = tagged.to_columns(tagged.from_blocks(file_lines(spark, blocks))).orderBy("line_no")
    assert tagged.from_columns(line).orderBy("line_no").first().words == ["I", "go"]
    with pytest.raises(Exception, match="fewer than four columns"):
        tagged.from_columns(file_lines(spark, ["a\tb"])).collect()


def test_plans(spark):
    edges = spark.createDataFrame([(5, 2), (2, 9), (9, 7), (20, 21), (3, 3)] + [(100, k) for k in range(101, 140)], "src long, dst long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert {k: got[k] for k in (2, 5, 7, 9, 20, 21)} == {2: 2, 5: 2, 7: 2, 9: 2, 20: 20, 21: 20} and {got[k] for k in range(100, 140)} == {100} and 3 not in got
    assert components(edges.limit(0)).count() == 0
    big, small = spark.range(50).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    for most in (10, 1):
        assert sorted((r.id, r.v) for r in attach(big, small, "k", broadcast_rows=most).collect()) == [(i, "nab"[i % 3]) for i in range(50)]


def test_stream(spark, tmp_path):
    from millrace.streaming.counts import stream_phrase_counts

    rows = spark.createDataFrame([(["a", "b"], ["1", "2"]), (["a"], ["1"])], "words array<string>, tags array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_phrase_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.zh_seg, r["count"]) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1), ("a b", 1)}


def test_entry_stands_alone():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "good_patterns" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    assert not re.search(r"\bllm\b", open(names["good_patterns"].__code__.co_filename).read())
