"""Line dedup: suffix array over line ids by distributed prefix doubling.

Each document is its sequence of non-blank lines; a line's id is the 128-bit
digest of its text. Lines that occur once in the corpus can be in no repeated
run, so they cut the sequences into islands of repeated lines, the strings whose
suffixes are sorted.

A suffix's rank is (line id, number of smaller suffixes that begin with this
line): an order-preserving name that needs no global sort. Doubling step k ranks
the suffixes by (rank here, rank 2^k lines on), so ranks hold for prefixes of
2^(k+1) lines. A run counts as repeated from ``min_words`` words, and a non-blank
line has one word at least, so log2(min_words) steps are enough, however long the
runs are: longer runs are unions of overlapping shorter ones.

The prefix of suffix i that just reaches ``min_words`` has some l lines. The
suffixes that share these l lines are the interval of the suffix array with
longest common prefixes of l or more; it is named by the ranks for 2^k lines
(2^k <= l) at i and at i+l-2^k. Its first member, by (doc_id, line), is the
original; the l lines at all others are copies. Overlapping and adjacent copies
unite to maximal repeated runs, and their lines are deleted. A run's end, where
fewer than ``min_words`` words are left, is covered likewise from its other end
(the stretch that just reaches ``min_words`` backwards).

Defined results: lines are equal if their texts are identical; blank lines are
never deleted. A run that overlaps its own copy (one line again and again) keeps
its first line. A null or empty text stays as it is. A document with a null
doc_id stays as it is and is no original. Rows that repeat a doc_id
with the same text are one document, so both rows keep the same lines; with
another text they are another document. Texts of any length are worked on whole.
Extra columns are passed through, but for one of the name of the count, which is
replaced. An empty table gives no rows. A line that occurs everywhere is no burden
to one task: suffixes that are alike are summed before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm._common import maybe_broadcast, only, written

#: Runs of identical lines of fewer words stay.
MIN_WORDS = 25
#: Bytes of a table of runs that is broadcast.
BROADCAST_BYTES = 48 << 20


def _nonblank(text: Column) -> Column:
    """(index among all lines, line) of the non-blank lines."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(lines, lambda s: F.trim(F.translate(s["line"], "\t\r\f\v", "    ")) != "")


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, txt (hash of the text), k (place among the non-blank lines), at (among all), id (digest), words."""
    d = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    x = d.select("doc_id", F.xxhash64("text").alias("txt"), F.posexplode(_nonblank(F.col("text"))).alias("k", "s"))
    return x.select("doc_id", "txt", "k", F.col("s.at").alias("at"), F.unhex(F.md5("s.line")).alias("id"), F.regexp_count(F.col("s.line"), F.lit("\\S+")).alias("words"))


def islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Maximal stretches of repeated lines with at least ``min_words`` words; ``isle`` tells those of a document apart."""
    repeated = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    hot = lines.join(repeated, "id", "left_semi").repartition("doc_id", "txt")
    hot = hot.groupBy("doc_id", "txt", "k").agg(*[F.first(c).alias(c) for c in ("at", "id", "words")])
    hot = hot.withColumn("isle", F.col("k") - F.row_number().over(W.partitionBy("doc_id", "txt").orderBy("k")))
    hot = hot.withColumn("isle_words", F.sum("words").over(W.partitionBy("doc_id", "txt", "isle")))
    return hot.where(F.col("isle_words") >= min_words).drop("isle_words")


def suffix_ranks(isles: DataFrame, steps: int) -> DataFrame:
    """Columns o0 to o<steps>: with ``id``, the suffix's rank by its first 2^k lines.

    ``o<k>`` is the number of suffixes that begin with the same line and are
    smaller by their first 2^k lines; an island's end is smaller than any line.
    """
    here = W.partitionBy("doc_id", "txt", "isle").orderBy("k")
    x = isles.withColumn("o0", F.lit(0))
    for k in range(steps):
        x = x.withColumns({"nid": F.lead("id", 2**k).over(here), "no": F.lead(f"o{k}", 2**k).over(here)})
        # Suffixes that are alike so far are one row of the group, however often a line occurs.
        x = written(x, f"suffixes{k}")
        alike = x.groupBy("id", f"o{k}", "nid", "no").agg(F.count("*").alias("n"))
        smaller = W.partitionBy("id").orderBy(f"o{k}", F.col("nid").asc_nulls_first(), F.col("no").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
        alike = alike.select(F.col("id").alias("__id"), F.col(f"o{k}").alias("__o"), F.col("nid").alias("__nid"), F.col("no").alias("__no"), F.coalesce(F.sum("n").over(smaller), F.lit(0)).cast("int").alias(f"o{k + 1}"))
        same = (F.col("id") == F.col("__id")) & (F.col(f"o{k}") == F.col("__o")) & F.col("nid").eqNullSafe(F.col("__nid")) & F.col("no").eqNullSafe(F.col("__no"))
        x = x.join(alike, same).drop("__id", "__o", "__nid", "__no")
    return x.drop("nid", "no")


_BLOCK = "doc_id long, txt long, first int, n int, a binary, ao int, b binary, bo int, ats array<int>"


def _blocks(steps: int, least: int):
    """Islands, as arrays, to blocks that just reach ``least`` words, forwards from each line and backwards from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            if not len(flat):
                continue
            words, at, k = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("words", "at", "k"))
            ranks = np.stack([flat.field(f"o{j}").to_numpy(zero_copy_only=False) for j in range(steps + 1)])
            ends = np.cumsum(np.bincount(row, minlength=len(batch)))
            begin, end = (ends - np.bincount(row, minlength=len(batch)))[row], ends[row]
            cum = np.cumsum(words)
            before = cum - words
            i = np.arange(len(words))
            last = np.searchsorted(cum, before + least)
            down = np.stack([i, last - i + 1], 1)[last < end]
            first = np.searchsorted(before, cum - least, side="right") - 1
            up = np.stack([first, i - first + 1], 1)[first >= begin]
            both = np.unique(np.concatenate([down, up]), axis=0)
            if not len(both):
                continue
            p, n = both[:, 0], both[:, 1]
            level = np.frexp(n.astype(float))[1] - 1
            q = p + n - (1 << level)
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(at[np.repeat(p - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())].astype(np.int32)))
            ids = flat.field("id")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row[p])), batch.column("txt").take(pa.array(row[p])), pa.array(k[p].astype(np.int32)), pa.array(n.astype(np.int32)), ids.take(pa.array(p)), pa.array(ranks[level, p].astype(np.int32)), ids.take(pa.array(q)), pa.array(ranks[level, q].astype(np.int32)), spans],
                names=["doc_id", "txt", "first", "n", "a", "ao", "b", "bo", "ats"],
            )

    return run


def copied_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, txt, runs (array of first and last index of the maximal runs to delete), removed (lines)."""
    lines = written(line_table(docs), "lines")
    steps = max(1, min_words).bit_length() - 1
    x = suffix_ranks(islands(lines, min_words), steps)
    x = x.groupBy("doc_id", "txt", "isle").agg(F.sort_array(F.collect_list(F.struct("k", "at", "id", "words", *[f"o{j}" for j in range(steps + 1)]))).alias("s"))
    blocks = written(x.mapInArrow(_blocks(steps, min_words), _BLOCK), "blocks")
    here, name = F.struct("doc_id", "txt", "first"), ["a", "ao", "b", "bo", "n"]
    original = blocks.groupBy(*name).agg(F.min(here).alias("original"), F.count("*").alias("times")).where("times > 1").drop("times")
    dead = blocks.join(original, name).where(here > F.col("original")).select("doc_id", "txt", F.explode("ats").alias("at"))
    dead = dead.groupBy("doc_id", "txt").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    # Neighbouring lines unite to runs: an index begins one if its predecessor isn't there, and ends one likewise.
    ats = F.col("ats")
    begins = F.filter(ats, lambda v, i: (i == 0) | (F.element_at(ats, F.greatest(i, F.lit(1))) != v - 1))
    ends = F.filter(ats, lambda v, i: (i == F.size(ats) - 1) | (F.element_at(ats, F.least(i + 2, F.size(ats))) != v + 1))
    return dead.select("doc_id", "txt", F.arrays_zip(begins.alias("first"), ends.alias("last")).alias("runs"), F.size("ats").alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, count: str = "removed_lines") -> DataFrame:
    """``docs`` with later copies of line runs cut out of ``text``, and their number of lines as column ``count``, which replaces one of that name."""
    runs = written(copied_runs(docs, min_words), "runs").withColumnsRenamed({"doc_id": "__id", "txt": "__txt", "runs": "__runs", "removed": "__count"})
    held = runs.agg(F.coalesce(F.sum(48 + 8 * F.size("__runs")), F.lit(0))).first()[0]
    runs = maybe_broadcast(runs, held, BROADCAST_BYTES)
    out = docs.drop(count).withColumn("__hash", F.xxhash64("text"))
    out = out.join(runs, (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__txt")), "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.exists("__runs", lambda r: i.between(r["first"], r["last"])))
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return out.withColumns({"text": text, count: F.coalesce("__count", F.lit(0))}).drop("__id", "__txt", "__hash", "__runs", "__count")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "removed_lines")


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE = {
    "op7_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, len(regexp_extract_all(line, '\S+')) AS words FROM l WHERE regexp_matches(line, '\S')),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS cum FROM b),
d AS (SELECT *, cum - words AS before FROM c),
arr AS (SELECT doc_id, list(line ORDER BY k) AS lines FROM d GROUP BY doc_id),
spans AS (
  SELECT x.doc_id, x.k AS f, y.k AS e FROM d x ASOF JOIN d y ON x.doc_id = y.doc_id AND x.before + {MIN_WORDS} <= y.cum
  UNION SELECT x.doc_id, y.k, x.k FROM d x ASOF JOIN d y ON x.doc_id = y.doc_id AND x.cum - {MIN_WORDS} >= y.before),
named AS (SELECT doc_id, f, e, md5(array_to_string(lines[f:e], chr(10))) AS m FROM spans JOIN arr USING (doc_id)),
copies AS (SELECT doc_id, f, e FROM named QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, f) > 1),
dead AS (SELECT DISTINCT d.doc_id, d.pos FROM copies c JOIN d ON c.doc_id = d.doc_id AND d.k BETWEEN c.f AND c.e),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN dead ON l.doc_id = dead.doc_id AND l.pos = dead.pos GROUP BY l.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM dead GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN g.n IS NULL THEN o.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(g.n, 0) AS INTEGER) AS removed_lines
FROM documents o LEFT JOIN kept k ON o.doc_id = k.doc_id LEFT JOIN gone g ON o.doc_id = g.doc_id"""
}
