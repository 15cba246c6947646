"""Numbers of similar documents, from all pairs of documents, without a row for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.corpus import Corpus
from textloom.functions.store import written
from textloom.operators.windows import numbered

#: Different texts of a block; rows that are compared with a block at once; words of a block that are columns of a dense matrix at most; meetings that are counted at once.
BLOCK, STRIPE, DENSE, MEETINGS = 8192, 256, 1500, 4_000_000
#: Share of pairs from which a word is cheaper as a column of a dense matrix.
OFTEN = 0.008


def encoded(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers of rows that begin at ``starts`` as differences of 7 bits a byte, and where each row begins and ends."""
    d = np.diff(ids.astype(np.int64), prepend=0)
    begin = starts[:-1][np.diff(starts) > 0]
    d[begin] = ids[begin]
    size = 1 + sum((d >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        there = size > k
        out[at[:-1][there] + k] = (d[there] >> 7 * k & 127) | ((size[there] > k + 1) << 7)
    return out, at[starts]


def decoded(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and where each row begins and ends, from ``encoded`` rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    d = np.zeros(len(ends), np.int64)
    for k in range(5):
        there = begins + k <= ends
        d[there] |= (raw[begins[there] + k] & 127).astype(np.int64) << 7 * k
    starts = np.searchsorted(ends, offsets - offsets[0])
    total = np.concatenate([[0], np.cumsum(d)])
    return total[1:] - np.repeat(total[starts[:-1]], np.diff(starts)), starts


def meetings(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For stripes of rows of ``a`` the first row, and the numbers of common words with each row of ``b``."""
    (ia, sa), (ib, sb) = a, b
    na, nb = len(sa) - 1, len(sb) - 1
    words, wb = np.unique(ib, return_inverse=True)
    wa = np.searchsorted(words, ia)
    there = words[np.minimum(wa, max(len(words) - 1, 0))] == ia if len(words) else np.zeros(len(ia), bool)
    ra, wa = np.repeat(np.arange(na), np.diff(sa))[there], wa[there]
    rb = np.repeat(np.arange(nb), np.diff(sb))
    fb = np.bincount(wb, minlength=len(words))
    share = np.bincount(wa, minlength=len(words)) / max(na, 1) * fb / max(nb, 1)
    often = np.argsort(-share, kind="stable")[:DENSE]
    often = often[share[often] > OFTEN]
    column = np.full(len(words), -1)
    column[often] = np.arange(len(often))
    cb = column[wb]
    dense = np.zeros((len(often), nb), np.float32)
    dense[cb[cb >= 0], rb[cb >= 0]] = 1
    of = rb[np.argsort(wb, kind="stable")]  # the rows of b by word
    at = np.concatenate([[0], np.cumsum(fb)])
    ca = column[wa]
    cuts = np.searchsorted(ra, np.arange(0, na + STRIPE, STRIPE))
    for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
        first = k * STRIPE
        rows = min(STRIPE, na - first)
        r, w, c = ra[p:q] - first, wa[p:q], ca[p:q]
        m = np.zeros((rows, len(often)), np.float32)
        m[r[c >= 0], c[c >= 0]] = 1
        both = m @ dense
        r, w = r[c < 0], w[c < 0]
        met = np.cumsum(fb[w])
        bounds = np.flatnonzero(np.diff(met // MEETINGS, prepend=-1)) if len(w) else np.zeros(0, np.int64)
        for x, z in zip(bounds, [*bounds[1:], len(w)]):
            n = fb[w[x:z]]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[w[x:z]], n)
            low, high = r[x], r[z - 1] + 1
            both[low:high] += np.bincount(np.repeat((r[x:z] - low) * nb, n) + of[place], minlength=(high - low) * nb).reshape(-1, nb)
        yield first, both


def needed(sizes: np.ndarray, least: float) -> np.ndarray:
    """The least number n of 1 or more with n / size >= ``least``."""
    n = np.maximum(np.floor(sizes * least) - 1, 1)
    for _ in range(3):
        n += n / sizes < least
    return n.astype(np.float32)


def linked(a, b, copies_a: np.ndarray, copies_b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, ...]:
    """For rows of ``a`` the documents in ``b`` that have ``least`` of their words, and that have ``least`` of their own in them; for rows of ``b`` those in ``a``."""
    need_a, need_b = needed(np.diff(a[1]), least), needed(np.diff(b[1]), least)
    out = [np.zeros(len(x)) for x in (need_a, need_a, need_b, need_b)]
    for first, both in meetings(a, b):
        s = slice(first, first + len(both))
        if same:
            both[np.arange(len(both)), np.arange(first, first + len(both))] = 0
        for k, hit in ((0, both >= need_a[s, None]), (1, both >= need_b)):
            hit = hit.astype(np.float64)
            out[k][s] += hit @ copies_b
            if not same:
                out[3 - k] += copies_a[s] @ hit
    return tuple(x.astype(np.int64) for x in out)


def overlap_links(corpus: Corpus, feature: str = "token", meta_cols: list[str] | None = None, min_similarity: float = 1 / 3) -> DataFrame:
    """doc_id, class, links, linked: a row for each document of ``compare_documents`` by ``overlap_pct`` and docfreq, without a row for each pair.

    ``class`` is the least doc_id of the documents with the same words and ``meta_cols``. ``links`` are the other documents that
    have ``min_similarity`` of its words, those of its class too; ``linked`` those that have as much of their words in it.

    Documents of a class are linked alike, so one of each is compared. Those of a group are cut into blocks, and a task
    compares two blocks: frequent words as a product of dense matrices, others by their rows. The work is quadratic in
    the different texts of a group, the memory of a task is bounded, and a text is sent once for each block.
    """
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity is above 0 and at most 1")
    keys = meta_cols or []
    names = [f"__m{k}" for k in range(len(keys))]
    d = corpus.words(feature)
    if d is not None and corpus.exploded[2] is corpus.meta:
        d = corpus.exploded[1].select("doc_id", "words", *[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)])
    else:
        w = corpus.tokens.where(F.col(f"`{feature}`").isNotNull()).groupBy("doc_id").agg(F.collect_set(F.col(f"`{feature}`").cast("string")).alias("words"))
        d = corpus.meta.select("doc_id", *[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names)]).distinct().join(w, "doc_id", "left").withColumn("words", F.coalesce("words", F.array()))
    seed, numbers, *_ = numbered(d, False)
    d = d.withColumn("words", F.array_sort(F.array_distinct("words")))
    d = d.select("doc_id", *names, F.transform("words", lambda w: F.xxhash64(w, F.lit(seed))).alias("h"))
    kept = ["doc_id", *names]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rank = numbers.value
        for batch in batches:
            found = batch.column("h")
            starts = found.offsets.to_numpy().astype(np.int64)
            values = found.values.to_numpy()[starts[0] : starts[-1]]
            starts = starts - starts[0]
            ids = rank[np.searchsorted(hashes, values)] if len(values) else np.zeros(0, np.int32)
            row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            ids = ids[np.argsort(row << 32 | ids.astype(np.int64))]
            raw, at = encoded(ids, starts)
            own = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), own], names=[*kept, "own"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*kept).schema.fields)
    sets = written(d.mapInArrow(number, f"{kinds}, own binary"), "sets").withColumn("c", F.when(F.length("own") > 0, F.unhex(F.sha2("own", 256))))
    agree = F.col("c").isNotNull()
    for n in names:  # what is null agrees with nothing
        agree = agree & F.col(n).isNotNull()
    cls = sets.where(agree).groupBy(*names, "c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("own").alias("own"))
    cls = written(cls, "classes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    groups = cls.groupBy(*names).agg(F.count("*").alias("n")) if names else cls.agg(F.count("*").alias("n"))
    groups = written(groups.select(*names, blocks.alias("of")), "groups")
    tasks = int(groups.agg(F.sum(F.col("of") * (F.col("of") + 1) / 2)).first()[0] or 1)
    m = (cls.join(groups, names) if names else cls.crossJoin(groups)).withColumn("b", F.pmod(F.xxhash64("c"), F.col("of")).cast("int"))
    m = m.select(*names, "rep", "copies", "own", "b", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("o"))
    by = [*names, "i", "j"]
    m = m.select(*names, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "copies", "own").repartition(max(12, min(tasks, 20_000)), *by)

    def count(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        b = table["b"].to_numpy()
        sides = []
        for n in (i, j):
            t = table.filter(pa.array(b == n)).combine_chunks()
            own = t["own"]
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            sides.append((t["rep"], decoded(own.cast(pa.binary())), t["copies"].to_numpy().astype(float)))
        (ra, a, ca), (rb, bb, cb) = sides
        links, into, links_b, into_b = linked(a, bb, ca, cb, min_similarity, i == j)
        out = [pa.table({"rep": ra, "links": pa.array(links), "linked": pa.array(into)})]
        if i != j:
            out.append(pa.table({"rep": rb, "links": pa.array(links_b), "linked": pa.array(into_b)}))
        return pa.concat_tables(out)

    kind = cls.schema["rep"].dataType.simpleString()
    n = m.groupBy(*by).applyInArrow(count, f"rep {kind}, links long, linked long").groupBy("rep").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    n = cls.select(*names, "c", "rep", "copies").join(n.withColumnRenamed("rep", "__rep"), F.col("rep") == F.col("__rep"))
    r = sets.select("doc_id", *names, "c").join(n, [*names, "c"], "left")
    more = lambda c: F.coalesce(F.col(c) + F.col("copies") - 1, F.lit(0)).cast("long").alias(c)
    return r.select("doc_id", F.coalesce("rep", "doc_id").alias("class"), more("links"), more("linked"))
