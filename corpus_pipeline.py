"""The training-data pipeline: documents in, token ids out, one operator a stage.

Each stage is written as Parquet and read again by the next, so a lost executor costs the current
stage at most. All stages but the last return rows with the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_documents
from millrace.llm.common import table
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.jaccard_join import near_components
from millrace.llm.mixing import mix_sources
from millrace.llm.quality_rules import quality_rules
from millrace.llm.queries import vocabulary
from millrace.plans.scratch import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality_rules(whole, keep=["row"]).filter("kept").select("row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return _only(docs, exact_dedup(docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest id. Links are of 5-word runs, 80%; op10's contract of 4 and 85% is its own."""
    return _only(docs, near_components(docs, size=5, percent=80).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mix_sources(docs).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies")).dropDuplicates(["_id"])
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), keep_ids=True)


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    ids = chosen.select(F.col("doc_id").alias("_id"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]

#: SQL can express neither expectation-maximisation, nor sampling by a hash of Spark's, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
