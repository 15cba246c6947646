"""What the queries share: the corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.corpus import Corpus
from textloom.sources.texts import from_texts


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    """The words of ``documents`` with lang and source."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return from_texts(d, words_only=True)


def benchmark(spark: SparkSession, sf_dir: str) -> Corpus:
    return from_texts(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), doc_column="item_id", words_only=True)


def turns(spark: SparkSession, sf_dir: str) -> Corpus:
    """The words of ``conversations``, a document for each turn, with role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return from_texts(c.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text", "role"), words_only=True)


def _tok(table: str, doc: str) -> str:
    return (
        f"SELECT doc_id, unnest(w) AS token, CAST(generate_subscripts(w, 1) AS INTEGER) AS token_id FROM (SELECT {doc} AS doc_id, regexp_extract_all(lower(trim(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})"
    )


TOK = f"tok AS ({_tok('documents', 'doc_id')})"
BENCH = f"bench AS ({_tok('benchmark', 'item_id')})"
TURNS = f"tok AS ({_tok('conversations', "concat_ws('-', conv_id, turn)")})"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
