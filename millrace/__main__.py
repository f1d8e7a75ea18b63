"""Command line: build the tagger's tables, tag, look up and time, score, clean.

    python -m millrace build-phrases TAGGED OUT         TAGGED: lines of words|||tags
    python -m millrace build-lm TAGGED OUT [--order 6]
    python -m millrace tag -t PHRASES -l MODEL [-f verbose|tab|/] [-o OUT] FILE...
    python -m millrace lookup PHRASES TEXT [--number 5]
    python -m millrace score MODEL TAGS
    python -m millrace clean TABLE

Tables are Parquet folders; paths may be on any file system that Spark reads.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators.counting import phrase_counts
from millrace.operators.lm import BackoffModel, kneser_ney
from millrace.plans.lifecycles import tag_text
from millrace.sources.lines import read_lines, split_bar_tags, write_lines
from millrace.sources.tables import cli_format


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description="Corpus analytics on Spark")
    tasks = top.add_subparsers(dest="task", required=True)
    for name in ("build-phrases", "build-lm"):
        build = tasks.add_parser(name)
        build.add_argument("tagged")
        build.add_argument("out")
    build.add_argument("--order", type=int, default=6)
    tag = tasks.add_parser("tag")
    tag.add_argument("-t", "--phrases", required=True)
    tag.add_argument("-l", "--language-model", required=True)
    tag.add_argument("-f", "--format", default="/", choices=["verbose", "tab", "/"])
    tag.add_argument("-o", "--out", help="folder of text files; without it, lines are printed")
    tag.add_argument("files", nargs="+")
    lookup = tasks.add_parser("lookup")
    lookup.add_argument("phrases")
    lookup.add_argument("text")
    lookup.add_argument("--number", type=int, default=5)
    score = tasks.add_parser("score")
    score.add_argument("model")
    score.add_argument("tags")
    tasks.add_parser("clean").add_argument("table")
    return top


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a table's folder; anything but a finished Parquet table is left alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")
    return bool(files.exists(mark) and files.delete(where, True))


def model_for(table: DataFrame, tags: str) -> BackoffModel:
    """The model with the n-grams of one line of tags alone: as many rows as the line has runs."""
    order = table.agg(F.max("n")).first()[0] or 1
    words = tags.split()
    runs = {" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)}
    rows = table.filter(F.col("gram").isin([*runs, "<unk>"])).collect()
    return BackoffModel({r["gram"]: (r["prob"], r["backoff"]) for r in rows}, order)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"millrace {args.task}").getOrCreate()
    if args.task in ("build-phrases", "build-lm"):
        lines = split_bar_tags(read_lines(spark, args.tagged))
        words, tags = tokens(F.col("text")), tokens(F.col("tag"))
        table = phrase_counts(lines.select(words.alias("words"), tags.alias("tags"))) if args.task == "build-phrases" else kneser_ney(lines.select(tags.alias("words")), args.order)
        table.write.parquet(args.out)
    elif args.task == "tag":
        tagged = tag_text(read_lines(spark, args.files), spark.read.parquet(args.phrases), spark.read.parquet(args.language_model))
        shown = tagged.select("line_no", cli_format(args.format).alias("value"))
        if args.out:
            write_lines(shown, args.out)
        else:
            for row in shown.orderBy("line_no").toLocalIterator():
                print(row.value)
    elif args.task == "lookup":
        found, begin = [], time.perf_counter()
        for _ in range(args.number):
            found = spark.read.parquet(args.phrases).filter(F.col("zh") == args.text).orderBy(F.desc("pr"), "zh_seg", "tag").collect()
        seconds = time.perf_counter() - begin
        for row in found:
            print(*row, sep="\t")
        print(f"{seconds:.3f} s for {args.number} lookups")
    elif args.task == "score":
        model = model_for(spark.read.parquet(args.model), args.tags)
        print(model.order, model[args.tags], sep="\t")
    else:
        print("removed" if remove(spark, args.table) else "no finished table there")


if __name__ == "__main__":
    main()
