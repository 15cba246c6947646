"""Best-fit packing by a grouping genetic algorithm on islands.

A document longer than the window is cut into whole windows, which are bins of
their own, and a remainder. Remainders and shorter documents are the items.
Items are hashed into shards of bounded size, each a bin-packing problem; a shard
leaves at most one bin badly filled, so shards of thousands of items cost nothing.

Each shard is solved by ``islands`` populations, which evolve apart, in tasks of
their own. An individual is a grouping of the items into bins; its fitness is the
mean of the squared fill of the bins, which prefers fewer bins and, with as many,
wholly filled ones and the room that is left in one. Best fit mostly reaches the
least number of bins; what the search gains over it are bins without padding.
Crossover takes a parent and injects bins of the
other, well-filled ones first by chance; bins of the parent that share an item
with an injected one are dropped, and the items that this displaces, and that are
in no injected bin, are put back by best fit, largest first; then items are exchanged between bins
where that fills one. Mutation empties
some of the worst bins likewise. After each epoch the islands of a shard pass
their elite on in a ring. At the end the best individual of all islands is taken.
An island stops before its generations are over only if all its bins but one are full.

All randomness is seeded by shard, island and epoch, and items are ordered by
(tokens, doc_id, part), so a task that runs again gives the same bins.

Tokens are runs of non-blank characters, unless the caller names a column of
counts.

Defined results: null and empty texts have no tokens and are in no bin, as are
null counts and counts under 1. Rows that repeat a doc_id are items of their own.
A document with a null doc_id is packed as any other. An empty table gives no
bins. A document of exactly the window's length is a bin. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import only, written

WINDOW = 2048
SHARD_ITEMS = 1500
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 10, 6
#: Tasks of an epoch, at most; beyond it a task evolves several islands.
TASKS = 20_000


def best_fit(items: list[int], size: list[int], bins: list[list[int]], room: list[int], window: int) -> None:
    """Puts each item, largest first, into the open bin with the least room that takes it, else into a new one."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in sorted(items, key=lambda x: (-size[x], x)):
        s = size[i]
        at = bisect_left(free, (s, -1))
        if at < len(free):
            r, b = free.pop(at)
            bins[b].append(i)
            room[b] = r - s
        else:
            b = len(bins)
            bins.append([i])
            room.append(window - s)
        if room[b]:
            insort(free, (room[b], b))


def fitness(room: list[int], window: int) -> float:
    """Mean square fill of the bins."""
    return sum(((window - r) / window) ** 2 for r in room) / len(room) if room else 1.0


class Individual:
    """A grouping: bins of item numbers and the room left in each."""

    def __init__(self, bins: list[list[int]], size: list[int], window: int) -> None:
        self.bins = bins
        self.room = [window - sum(size[i] for i in b) for b in bins]
        self.fit = fitness(self.room, window)

    def labels(self, n: int) -> np.ndarray:
        out = np.empty(n, dtype=np.int32)
        for b, own in enumerate(self.bins):
            out[own] = b
        return out

    @staticmethod
    def of(labels: np.ndarray, size: list[int], window: int) -> Individual:
        order = np.argsort(labels, kind="stable")
        cut = np.flatnonzero(np.diff(labels[order])) + 1
        return Individual([x.tolist() for x in np.split(order, cut)], size, window)


def tighten(size: list[int], bins: list[list[int]], room: list[int]) -> None:
    """Exchanges an item for one of another open bin that is larger by just the room, as long as that fills a bin; the room moves to the other."""
    at: dict[int, set[int]] = {}
    for b, r in enumerate(room):
        if r:
            for i in bins[b]:
                at.setdefault(size[i], set()).add(i)
    where = {i: b for b, r in enumerate(room) if r for i in bins[b]}
    for b in sorted(range(len(bins)), key=lambda x: (room[x], x)):
        if not room[b]:
            continue
        for i in sorted(bins[b]):
            j = min((x for x in at.get(size[i] + room[b], ()) if where[x] != b), default=None)
            if j is None:
                continue
            o = where[j]
            bins[b][bins[b].index(i)], bins[o][bins[o].index(j)] = j, i
            room[o] += room[b]
            room[b] = 0
            where[i] = o
            for x in bins[b]:
                at[size[x]].discard(x)
                where.pop(x, None)
            break


def _rebuilt(kept: list[list[int]], size: list[int], window: int, n: int) -> Individual:
    """The kept bins and, by best fit, all items that are in none of them."""
    there = np.zeros(n, dtype=bool)
    for b in kept:
        there[b] = True
    bins = [list(b) for b in kept]
    room = [window - sum(size[i] for i in b) for b in bins]
    best_fit(np.flatnonzero(~there).tolist(), size, bins, room, window)
    if kept:
        tighten(size, bins, room)
    return Individual(bins, size, window)


def crossover(a: Individual, b: Individual, size: list[int], window: int, rng: np.random.Generator) -> Individual:
    """Whole bins of ``b``, well-filled ones the likelier, are injected into ``a``."""
    n = len(size)
    fill = 1 - np.array(b.room) / window
    inject = rng.random(len(b.bins)) < 0.5 * fill**4
    taken = np.zeros(n, dtype=bool)
    chosen = [own for own, x in zip(b.bins, inject) if x]
    for own in chosen:
        taken[own] = True
    label = a.labels(n)
    hit = np.zeros(len(a.bins), dtype=bool)
    hit[label[taken]] = True  # these would hold an item twice
    return _rebuilt(chosen + [own for own, x in zip(a.bins, hit) if not x], size, window, n)


def mutate(a: Individual, size: list[int], window: int, rng: np.random.Generator) -> Individual:
    """Empties bins that aren't full, badly filled ones the likelier, and some full ones."""
    room = np.array(a.room) / window
    keep = rng.random(len(a.bins)) >= np.where(room > 0, np.minimum(0.9, 0.5 + 4 * room), 0.03)
    return _rebuilt([own for own, x in zip(a.bins, keep) if x], size, window, len(size))


def seeded(size: list[int], window: int, population: int, rng: np.random.Generator) -> list[Individual]:
    """Best fit with the largest first, and best fit in an order disturbed at random."""
    n = len(size)
    out = [_rebuilt([], size, window, n)]
    for _ in range(population - 1):
        bins: list[list[int]] = []
        room: list[int] = []
        order = np.argsort(-np.array(size) * rng.uniform(0.5, 1.0, n), kind="stable")
        for part in np.array_split(order, max(1, n // 100)):
            best_fit(part.tolist(), size, bins, room, window)
        out.append(Individual(bins, size, window))
    return out


def evolve(people: list[Individual], size: list[int], window: int, generations: int, rng: np.random.Generator) -> list[Individual]:
    """Steady-state: in each generation a child of two tournament winners, and a mutant of the best, replace the worst."""
    people = sorted(people, key=lambda x: -x.fit)
    for _ in range(generations):
        if sum(1 for r in people[0].room if r) <= 1:
            break  # no grouping is fitter
        pick = lambda: people[min(rng.integers(len(people)), rng.integers(len(people)))]
        children = [crossover(pick(), pick(), size, window, rng), mutate(people[0], size, window, rng)]
        people = sorted(people + children, key=lambda x: -x.fit)[: len(people)]
    return people


def _epoch(window: int, population: int, generations: int, epoch: int, last: bool):
    """One epoch of a shard's islands; rows are shard, island, sizes and the island's individuals as bin numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size = np.frombuffer(r["sizes"], dtype=np.int32).tolist()
                rng = np.random.default_rng([r["shard"], r["island"], epoch])
                people = [Individual.of(np.frombuffer(x, dtype=np.int32), size, window) for x in r["people"]]
                if epoch == 0:
                    people = seeded(size, window, population, rng)
                people = evolve(people, size, window, generations, rng)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": r["shard"], "island": r["island"], "sizes": r["sizes"], "people": [x.labels(len(size)).tobytes() for x in people[: 1 if last else population]], "fit": people[0].fit}], schema=_STATE
                )

    return run


_STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("people", pa.list_(pa.binary())), ("fit", pa.float64())])
_STATE_SQL = "shard long, island int, sizes binary, people array<binary>, fit double"


def _migrate(table: pa.Table) -> pa.Table:
    """Each island's best individual replaces the worst of the next one in the ring."""
    rows = sorted(table.to_pylist(), key=lambda r: r["island"])
    elite = [r["people"][0] for r in rows]
    for k, r in enumerate(rows):
        if len(rows) > 1:
            r["people"] = [*(r["people"][:-1] if len(r["people"]) > 1 else r["people"]), elite[k - 1]]
    return pa.Table.from_pylist(rows, schema=_STATE)


def items(docs: DataFrame, window: int = WINDOW, tokens: str | None = None) -> DataFrame:
    """doc_id, part, start, tokens, full: the pieces of all documents; full ones fill a window."""
    if tokens is None:
        d = only(docs, "doc_id", "text").select("doc_id", F.regexp_count("text", F.lit("\\S+")).alias("n"))
    else:
        d = only(docs, "doc_id", tokens).select("doc_id", F.col(f"`{tokens}`").cast("long").alias("n"))
    d = d.where("n >= 1")
    part = F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / window).cast("int")))
    d = d.select("doc_id", "n", part.alias("part")).withColumn("start", F.col("part") * F.lit(window))
    d = d.withColumn("tokens", F.least(F.lit(window), F.col("n") - F.col("start")).cast("int"))
    return d.select("doc_id", "part", F.col("start").cast("long").alias("start"), "tokens", (F.col("tokens") == window).alias("full"))


def pack(docs: DataFrame, window: int = WINDOW, tokens: str | None = None, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """bin_id, place (in the bin), doc_id, part, start, tokens, bin_tokens: every token of every document, once."""
    pieces = written(items(docs, window, tokens), "items")
    open_ = pieces.where("not full")
    shards = max(1, -(-open_.count() // shard_items))
    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards))
    grouped = open_.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("tokens", "doc_id", "part", "start"))).alias("own"))
    grouped = written(grouped, "shards")
    sizes = pa.schema([("shard", pa.int64()), ("sizes", pa.binary())])

    def packed_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.asarray(x, dtype=np.int32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, type=pa.binary())], schema=sizes)

    state = grouped.select("shard", "own.tokens").mapInArrow(packed_sizes, "shard long, sizes binary")
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.withColumn("people", F.array().cast("array<binary>")).select("shard", "island", "sizes", "people", F.lit(0.0).alias("fit"))
    for e in range(epochs):
        # A number of partitions that is given isn't coalesced, as these rows are small and their work isn't.
        state = state.repartition(min(TASKS, shards * islands), "shard", "island").mapInArrow(_epoch(window, population, generations, e, e == epochs - 1), _STATE_SQL)
        if e < epochs - 1:
            state = state.groupBy("shard").applyInArrow(_migrate, _STATE_SQL)
    best = state.groupBy("shard").agg(F.max_by(F.element_at("people", 1), F.struct("fit", -F.col("island"))).alias("labels"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, dtype=np.int32).tolist() for x in batch.column(1).to_pylist()], type=pa.list_(pa.int32()))], names=["shard", "labels"])

    labels = best.mapInArrow(numbers, "shard long, labels array<int>")
    shared = grouped.join(labels, "shard").select("shard", F.inline(F.arrays_zip("labels", "own")))
    bins = F.concat_ws("-", F.col("shard").cast("string"), F.col("labels").cast("string"))
    shared = shared.select(bins.alias("bin_id"), F.col("own.doc_id").alias("doc_id"), F.col("own.part").alias("part"), F.col("own.start").alias("start"), F.col("own.tokens").alias("tokens"))
    members = shared.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct(-F.col("tokens"), "doc_id", "part", "start", "tokens"))).alias("own"), F.sum("tokens").alias("bin_tokens"))
    members = members.select("bin_id", "bin_tokens", F.posexplode("own").alias("place", "x")).select("bin_id", "place", "x.doc_id", "x.part", "x.start", "x.tokens", F.col("bin_tokens").cast("int").alias("bin_tokens"))
    alone = pieces.where("full").select(F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("part").cast("string")).alias("bin_id"), F.lit(0).alias("place"), "doc_id", "part", "start", "tokens", F.col("tokens").alias("bin_tokens"))
    return members.unionByName(alone)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
