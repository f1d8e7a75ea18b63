"""External commands, named sources and the command line."""

import sys

import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.operators.external import pipe
from millrace.sources.catalog import Catalog
from millrace.sources.lines import read_lines

UPPER = [sys.executable, "-c", "import sys\nfor line in sys.stdin: sys.stdout.write(line.upper())"]
LATE = [sys.executable, "-c", "import sys\nfor line in sys.stdin.readlines(): sys.stdout.write(line)"]


def test_pipe(spark):
    rows = spark.range(7000).select(F.col("id").alias("line_no"), F.concat(F.lit("line é "), F.col("id")).alias("value")).repartition(3)
    got = pipe(rows, UPPER)
    assert got.columns == ["line_no", "value"]
    assert {r.line_no: r.value for r in got.collect()} == {i: f"LINE É {i}" for i in range(7000)}
    assert pipe(rows.filter("false"), ["no such command"]).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a\nb\r\nc", "z"), (4, "w" * 3_000_000, None)], "line_no long, value string, tag string").coalesce(1)
    for command in (UPPER, LATE):
        both = {r.line_no: (r.value, r.tag, r.told.lower()) for r in pipe(odd, command, out="told").collect()}
        assert both == {1: (None, "x", ""), 2: ("", "y", ""), 3: ("a\nb\r\nc", "z", "a b c"), 4: ("w" * 3_000_000, None, "w" * 3_000_000)}
    # output that comes at the end of the input only, many times as large as a pipe
    assert pipe(rows.coalesce(1), LATE).filter("value = concat('line é ', line_no)").count() == 7000


@pytest.mark.parametrize(
    ("code", "message"),
    [("print('once')", "too few lines"), ("import sys\nfor x in sys.stdin: print(x)", "too many lines"),
     ("import sys\nfor x in sys.stdin: sys.stdout.write(x)\nsys.exit('broken')", "broken")],
)
def test_pipe_of_wrong_commands(spark, code, message):
    rows = spark.range(100).select(F.col("id").cast("string").alias("value")).coalesce(1)
    with pytest.raises(Exception, match=message):
        pipe(rows, [sys.executable, "-c", code]).collect()


def test_catalog(spark, tmp_path):
    (tmp_path / "en.txt").write_text("a b\nc\n", encoding="utf-8")
    (tmp_path / "more.txt").write_text("x\ty\n", encoding="utf-8")
    (tmp_path / "words.txt").write_text("b \na\nb\n", encoding="utf-8")
    (tmp_path / "pt.txt").write_text("a b ||| 甲 ||| 0.5 0.25 0.5 0.25 ||| 0-0 1-0 ||| 1 1 1\n", encoding="utf-8")
    (tmp_path / "corpus.ini").write_text(
        "[both]\npath = en.txt\n  more.txt\n[two]\npath = more.txt ; TAB between\nkind = columns\ncolumns = 2\nnote = kept\n"
        "[words]\nkind = vocabulary\npath = words.txt\n[table]\nkind = phrases\npath = pt.txt\n[bare]\nkind = lines\n", encoding="utf-8",
    )
    catalog = Catalog.read(str(tmp_path / "corpus.ini"))
    assert catalog.names() == ["both", "two", "words", "table", "bare"]
    assert [r.value for r in catalog.load(spark, "both").orderBy("line_no").collect()] == ["a b", "c", "x\ty"]
    assert catalog.load(spark, "two").first().cols == ["x", "y"] and catalog.settings("two")["note"] == "kept"
    assert sorted(r.word for r in catalog.load(spark, "words").collect()) == ["a", "b"]
    assert catalog.load(spark, "table").first()[1:3] == ("a b", "甲")
    assert Catalog("[a]\npath = s3a://bucket/x", "/root").paths("a") == ["s3a://bucket/x"]
    with pytest.raises(KeyError, match="no source none; known: both"):
        catalog.load(spark, "none")
    with pytest.raises(ValueError, match="has no path"):
        catalog.load(spark, "bare")
    with pytest.raises(ValueError, match="unknown kind"):
        Catalog("[a]\nkind = hdf")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "tagged.txt").write_text("天地 人和|||Na VC\n人和 天地|||VC Na\n天地|||Na\n", encoding="utf-8")
    (tmp_path / "lines.txt").write_text("天地人和\n\n人和\n", encoding="utf-8")
    tagged, phrases, model = (str(tmp_path / n) for n in ("tagged.txt", "phrases", "model"))
    main(["build-phrases", tagged, phrases], spark)
    main(["build-lm", tagged, model, "--order", "3"], spark)
    tag = ["tag", "-t", phrases, "-l", model]
    main([*tag, str(tmp_path / "lines.txt")], spark)
    assert capsys.readouterr().out.splitlines() == ["天地/Na 人和/VC", "", "人和/VC"]
    main([*tag, "-f", "tab", "-o", str(tmp_path / "out"), str(tmp_path / "lines.txt")], spark)
    assert [r.value for r in read_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()] == ["天地 人和\tNa VC", "\t", "人和\tVC"]
    main(["lookup", phrases, "天地", "--number", "2"], spark)
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and "天地" in out[0] and out[1].endswith("s for 2 lookups")
    main(["score", model, "Na VC"], spark)
    order, score = capsys.readouterr().out.split()
    assert order == "3" and -5 < float(score) < 0
    main(["clean", phrases], spark)
    main(["clean", str(tmp_path)], spark)
    assert capsys.readouterr().out.splitlines() == ["removed", "no finished table there"]
    assert (tmp_path / "tagged.txt").exists() and not (tmp_path / "phrases").exists()
