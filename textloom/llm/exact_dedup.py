"""Exact dedup with a split for heavy hitters.

1. One scan gives each document's 128-bit digest; the narrow table of ids and
   digests is written, and nothing later reads a text.
2. Misra-Gries summaries, one a partition, name every digest that has over
   1/``counters`` of the rows of some partition. A digest with over
   N/``counters`` of all N rows is always among them.
3. An exact count, with map-side combining, verifies the candidates (over
   ``CANDIDATES`` of them are not broadcast: then all digests are counted so);
   those that are frequent indeed are
   the heavy hitters (fewer than ``counters`` digests, whatever the input), and
   the least doc_id of each is its winner.
4. The winners are broadcast: their copies are named on the map side, without a
   shuffle, so no task receives a hot digest. The remaining digests are shuffled
   by digest as usual.

Defined results: texts are equal if they are identical, empty texts among them.
A null text equals nothing. The document with the least non-null doc_id stays;
rows that repeat a doc_id with the same text are one document, so they are not
named, and ``survivors`` keeps one of them; with another text they are another
document, which goes or stays by its own text. Rows with a null doc_id are copies
if their text has a document with an id; else they all stay. Extra columns are
passed through by ``survivors``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import maybe_broadcast, only, written

COUNTERS = 4096
#: Digests of 16 bytes that are broadcast to be counted.
CANDIDATES = 250_000


class MisraGries:
    """At most ``k`` counters; a value seen over n/(k+1) times among n is among them."""

    def __init__(self, k: int) -> None:
        self.k, self.counts = k, {}

    def add(self, value: bytes, n: int = 1) -> None:
        c = self.counts
        if value in c:
            c[value] += n
        elif len(c) < self.k:
            c[value] = n
        else:
            least = min(n, min(c.values()))
            if least:
                self.counts = c = {x: m - least for x, m in c.items() if m > least}
                if n > least and len(c) < self.k:
                    c[value] = n - least


def _summaries(k: int):
    """Candidates of a partition of n rows: all that have over n/k, and no more than 4k/3.

    With 4k counters a count is too low by at most n/(4k).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mg, seen = MisraGries(4 * k), 0
        for batch in batches:
            seen += len(batch)
            for x in pc.value_counts(batch.column(0)).to_pylist():
                mg.add(x["values"], x["counts"])
        kept = [x for x, n in mg.counts.items() if n > 0.75 * seen / k]
        yield pa.RecordBatch.from_arrays([pa.array(kept, type=pa.binary())], names=["digest"])

    return run


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and digest of every document with a text."""
    d = only(docs, "doc_id", "text").where(F.col("text").isNotNull())
    return d.select("doc_id", F.unhex(F.md5("text")).alias("digest"))


def _split(docs: DataFrame, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digests, the heavy hitters (digest, keep_id), and of the others the rows whose digest has several (doc_id, digest, keep_id)."""
    table = written(digests(docs), "digests")
    n = table.count()
    candidates = written(table.select("digest").mapInArrow(_summaries(counters), "digest binary").distinct(), "candidates")
    counted = table.join(F.broadcast(candidates), "digest", "left_semi") if candidates.count() <= CANDIDATES else table
    heavy = counted.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where(F.col("n") > F.greatest(F.lit(2), F.lit(n) / counters)).select("digest", "keep_id")
    heavy = written(heavy, "winners")  # under `counters` rows: each has over n / counters of the n documents
    rest = table.join(F.broadcast(heavy), "digest", "left_anti")
    keep = rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").select("digest", "keep_id")
    return table, heavy, rest.join(keep, "digest").select("doc_id", "digest", "keep_id")


_COPY = "keep_id is not null and (doc_id is null or doc_id <> keep_id)"


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Pairs (doc_id, keep_id): each document that is a copy, and the one that stays for it."""
    table, heavy, cold = _split(docs, counters)
    hot = table.join(F.broadcast(heavy), "digest").select("doc_id", "keep_id")
    copies = hot.unionByName(cold.select("doc_id", "keep_id")).where(_COPY)
    return copies.where(F.col("doc_id").isNotNull()).distinct().unionByName(copies.where(F.col("doc_id").isNull()))


def survivors(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row for each text, with all their columns; only rows that repeat a doc_id with its text are shuffled whole."""
    table, heavy, cold = _split(docs, counters)
    gone = written(cold.where(_COPY).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__copy")).distinct(), "copies")
    again = table.where("doc_id is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    again = written(again.select(F.col("doc_id").alias("__again"), F.col("digest").alias("__twice")), "again")
    out = docs.withColumn("__digest", F.unhex(F.md5("text")))
    out = out.join(F.broadcast(heavy.select(F.col("digest").alias("__hot"), F.col("keep_id").alias("__keep"))), F.col("__digest") == F.col("__hot"), "left")
    out = out.where(F.col("__keep").isNull() | F.coalesce(F.col("doc_id") == F.col("__keep"), F.lit(False))).drop("__hot", "__keep")
    out = out.join(maybe_broadcast(gone, gone.count()), (F.col("__digest") == F.col("__copy")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
    known, on = maybe_broadcast(again, again.count()), (F.col("__digest") == F.col("__twice")) & (F.col("doc_id") == F.col("__again"))
    return out.join(known, on, "left_anti").unionByName(out.join(known, on, "left_semi").dropDuplicates(["doc_id", "__digest"])).drop("__digest")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE = {
    "op5_exact_dedup": """
WITH k AS (SELECT text, min(doc_id) AS keep_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)
SELECT DISTINCT d.doc_id, k.keep_id FROM documents d JOIN k ON d.text = k.text WHERE d.doc_id <> k.keep_id"""
}
