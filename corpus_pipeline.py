"""From raw documents to packed training windows.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the session's shared folder and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.

1. toxicity: documents that the lexicon rejects go; it learns further terms by the labels.
2. line dedup: later copies of line runs are cut out; a document of which nothing
   is left by that goes, as it was nothing but copies.
3. n-gram Jaccard join: one document of each group of near copies stays.
4. benchmark decontamination: documents that hold a benchmark item go.
5. best-fit packing: what is left is packed into windows.

Defined results of every stage are those of its operator: null, empty and blank texts
and rows with a null doc_id pass all filtering stages (a document left empty by stage 2
alone goes); repeated rows are one document in stages 2 and 3 and rows of their own in
the others; extra columns of any name are passed through; an empty table gives no rows.

``ORACLE_SQL`` is None: the alignment of stage 4 and the search of stage 5 have no
SQL; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from textloom.llm._common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, lexicon=toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, count="__removed").where((F.col("__removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        cut = F.when(F.col("__removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", cut)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows are those of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
