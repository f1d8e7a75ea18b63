"""Named sources and targets: an ini file says where each lies and how it is read.

    [english]
    path = corpus/en.txt        ; one or more files, folders or globs, in order, one a line
    kind = lines                ; lines (the default), columns, bar_tags, phrases, lexical, vocabulary, json, parquet
    columns = 2                 ; for columns: how many there must be

A relative path starts at the ini file's folder, or at ``root``. Each section also takes settings of any other
name, which ``settings`` returns.
"""

from __future__ import annotations

import configparser
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import lines as L
from millrace.sources import tables as T

KINDS = ("lines", "columns", "bar_tags", "phrases", "lexical", "vocabulary", "json", "parquet")


class Catalog:
    def __init__(self, text: str, root: str = ""):
        self._ini = configparser.ConfigParser(interpolation=None, inline_comment_prefixes=(";",))
        self._ini.read_string(text)
        self._root = root
        for name in self.names():
            if self._ini[name].get("kind", "lines") not in KINDS:
                raise ValueError(f"source {name}: unknown kind {self._ini[name]['kind']}")

    @classmethod
    def read(cls, path: str, root: str | None = None) -> Catalog:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), posixpath.dirname(posixpath.abspath(path)) if root is None else root)

    def names(self) -> list[str]:
        return self._ini.sections()

    def settings(self, name: str) -> dict[str, str]:
        if name not in self._ini:
            raise KeyError(f"no source {name}; known: {', '.join(self.names())}")
        return dict(self._ini[name])

    def paths(self, name: str) -> list[str]:
        """Where a source lies; URIs and absolute paths stay as they are."""
        found = [p.strip() for p in self.settings(name).get("path", "").splitlines() if p.strip()]
        if not found:
            raise ValueError(f"source {name} has no path")
        return [p if not self._root or re.match(r"/|\w+:", p) else f"{self._root.rstrip('/')}/{p}" for p in found]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        kind, paths = self.settings(name).get("kind", "lines"), self.paths(name)
        if kind == "parquet":
            return spark.read.parquet(*paths)
        if kind == "json":
            return spark.read.json(paths)
        rows = L.read_lines(spark, paths)
        if kind == "columns":
            count = self.settings(name).get("columns")
            return L.split_columns(rows, int(count) if count else None)
        if kind == "vocabulary":
            return rows.select(F.regexp_replace("value", r"(?U)\s+$", "").alias("word")).distinct()
        return {"lines": lambda r: r, "bar_tags": L.split_bar_tags, "phrases": T.phrase_table, "lexical": T.lexical_table}[kind](rows)
