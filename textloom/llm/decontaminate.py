"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. An item's seeds are all of its n-grams. None is left out for being frequent:
   copies of an item make its n-grams frequent, and an edited copy holds only some
   of them, so every one may be the last that finds it.
2. One pass joins passages to items by their seeds, where the documents are
   read: the window around a seed, as long as the item and half as much again,
   is compared with the item. A window whose words, as a bag, couldn't reach the
   threshold is left; on the others Smith-Waterman aligns words (match 2,
   mismatch -1, gap -1). The score is the alignment's share of the item's best
   possible one, so edited, shortened and paraphrased copies are found. A copy
   without ``n`` words in a row as they are in the item has no seed and isn't found.

No text is shuffled. The seeds are what is broadcast: they grow with the
benchmark, not with the corpus; a benchmark of more than ``slice_items`` items is
worked off in slices of that size.

Words are runs of ``a-z``, ``0-9`` and non-ASCII characters, lower case.

Defined results: an item with fewer than ``n`` words is too short to tell and
matches nothing, as do null and empty items; items that repeat an item_id are
items of their own, and the best score of each (document, item_id) is given.
Null and empty texts match nothing; rows that repeat a doc_id are searched one by
one, and their best score is given; a document with a null doc_id is searched as
well. An empty benchmark or corpus gives no rows. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _words
from textloom.llm._common import only

N = 4
#: Share of an item's best possible alignment from which a document is contaminated.
THRESHOLD = 0.5
SLICE_ITEMS = 100_000
_BITS = 22
#: Bytes of windows whose scores a task remembers.
_CACHE = 1 << 25


class Items:
    """The benchmark: the items' words, their n-grams as a sorted array, and where each n-gram occurs."""

    def __init__(self, rows: list[tuple[int, str]], n: int) -> None:
        rows = [(i, t) for i, t in rows if t]
        self.n, self.ids, self.words = n, [i for i, _ in rows], []
        gram, item, at = [], [], []
        for _, _, h, counts in _words.words(pa.array([t.lower() for _, t in rows], type=pa.string())):
            for w in np.split(h, np.cumsum(counts)[:-1]):
                k = len(self.words)
                self.words.append(w)
                if len(w) >= n:
                    g, _, p = _words.ngrams(w, np.array([len(w)]), n)
                    gram.append(g)
                    item.append(np.full(len(g), k))
                    at.append(p)
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        self.gram, self.item, self.at = join(gram, np.uint64), join(item, np.int64), join(at, np.int64)


class Finder:
    """Finds the n-grams of a sorted array among many: a bit table drops nearly all others."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = grams
        self.table = np.zeros(1 << _BITS, dtype=bool)
        self.table[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def __call__(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``g`` of n-grams that are in the array, and theirs in the array."""
        if not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p = np.flatnonzero(self.table[(g >> np.uint64(64 - _BITS)).view(np.int64)])
        q = np.minimum(np.searchsorted(self.grams, g[p]), len(self.grams) - 1)
        ok = self.grams[q] == g[p]
        return p[ok], q[ok]


def align(item: np.ndarray, window: np.ndarray) -> float:
    """Smith-Waterman (match 2, mismatch -1, gap -1) as a share of the item's best possible score."""
    slope = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, dtype=np.int64)
    best = 0
    for w in item:
        step = row[:-1] + np.where(window == w, 2, -1)
        new = np.maximum(row, 1) - 1
        np.maximum(new[1:], step, out=new[1:])
        # A gap along the row costs 1 a word: the best start is a running maximum of score + place.
        row = np.maximum.accumulate(new + slope) - slope
        best = max(best, int(row.max()))
    return best / (2 * len(item))


class Matcher:
    def __init__(self, items: Items, threshold: float) -> None:
        order = np.argsort(items.gram, kind="stable")
        self.item, self.at, g = items.item[order], items.at[order], items.gram[order]
        self.items, self.threshold = items, threshold
        grams, self.begin = np.unique(g, return_index=True)
        self.end = np.append(self.begin[1:], len(g))
        self.finder = Finder(grams)
        self.size = np.array([len(w) for w in items.words])
        self.cache: dict = {}
        self.cached = 0

    def score(self, k: int, window: np.ndarray) -> float:
        item = self.items.words[k]
        key = (k, window.tobytes())
        if key in self.cache:
            return self.cache[key]
        # No word of the item can match twice, so this bounds the alignment.
        most = np.isin(item, window).sum() / len(item)
        found = align(item, window) if most >= self.threshold else 0.0
        self.cached += window.nbytes
        if len(self.cache) > 20_000 or self.cached > _CACHE:
            self.cache.clear()
            self.cached = window.nbytes
        self.cache[key] = found
        return found

    def rows(self, lower: pa.Array) -> Iterator[tuple[int, int, float]]:
        """(row, item, score) of each passage that reaches the threshold; the best of each row and item."""
        for a, _, h, counts in _words.words(lower):
            g, row, at = _words.ngrams(h, counts, self.items.n)
            p, q = self.finder(g)
            if not len(p):
                continue
            first = np.concatenate([[0], np.cumsum(counts)])
            times = self.end[q] - self.begin[q]
            occ = np.repeat(self.begin[q] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            p = np.repeat(p, times)
            r, k = row[p], self.item[occ]
            size = self.size[k]
            begin = at[p] - self.at[occ]
            lo, hi = np.maximum(begin - size // 4 - 1, first[r]), np.minimum(begin + size + size // 4 + 1, first[r + 1])
            order = np.lexsort((lo, k, r))
            best: dict[tuple[int, int], float] = {}
            i = 0
            while i < len(order):
                j, (x, y) = order[i], (r[order[i]], k[order[i]])
                low, high = lo[j], hi[j]
                i += 1
                while i < len(order) and (r[order[i]], k[order[i]]) == (x, y) and lo[order[i]] <= high:
                    high = max(high, hi[order[i]])
                    i += 1
                s = self.score(int(y), h[low:high])
                if s >= self.threshold:
                    best[int(x), int(y)] = max(s, best.get((int(x), int(y)), 0.0))
            for (x, y), s in best.items():
                yield a + x, self.items.ids[y], s


def _slices(benchmark: DataFrame, n: int, slice_items: int) -> Iterator[Items]:
    b = only(benchmark, "item_id", "text").where("text is not null")
    parts = max(1, -(-b.count() // slice_items))
    for i in range(parts):
        own = b.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i) if parts > 1 else b
        items = Items([(r["item_id"], r["text"]) for r in own.collect()], n)
        if len(items.gram):
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """doc_id, item_id, score of each document that holds a copy, whole or edited, of an item."""
    schema = "doc_id long, item_id long, score double"
    d = only(docs, "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    out = None
    for items in _slices(benchmark, n, slice_items):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            m = Matcher(items, threshold)
            for batch in batches:
                found = list(m.rows(batch.column(1)))
                ids = batch.column(0).take(pa.array([r for r, _, _ in found], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i, _ in found], type=pa.int64()), pa.array([round(s, 6) for _, _, s in found], type=pa.float64())], names=["doc_id", "item_id", "score"])

        part = d.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _dirty(items: Items, threshold: float):
    """A pandas UDF: whether a lower-case text holds a copy of an item."""

    @F.pandas_udf("boolean")
    def dirty(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(items, threshold)
        for texts in batches:
            flag = np.zeros(len(texts), dtype=bool)
            flag[[r for r, _, _ in m.rows(pa.array(texts, type=pa.string()))]] = True
            yield pd.Series(flag)

    return dirty


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """``docs`` without the documents that hold a copy of an item, all columns kept; no shuffle."""
    out = docs
    for items in _slices(benchmark, n, slice_items):
        out = out.where(~_dirty(items, threshold)(F.lower("text")))
    return out


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE: dict[str, str] = {}
