"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The sets of word n-grams (3 words by default) of all documents are joined with
themselves: all sets with a Jaccard similarity of ``threshold`` or more are linked,
exactly. The result has one row a document, with its class (documents that links
connect) and its number of links; pairs are never shuffled or written.

Order. All n-grams have one global order: first the light ones by hash, then the
heavy ones, those in over ``heavy`` of the documents, by frequency. Heavy n-grams
are counted over all documents; there are at most (mean set size / ``heavy``) of
them, whatever the input, so the list is broadcast.

Fragments. The order is cut vertically. Of each set the first fragment (light
n-grams with a hash below ``FIRST`` of all) and the prefix (the first
|x| - ceil(t|x|) + 1, of which similar sets share one) are sent to the task of
their hash range, packed. Documents with the same set are one entity from here on.
A range names each n-gram's list of entities by the least of them, its label; near
copies mostly have the same label for all that they share.

A list is cut where sizes are too far apart for sets to be similar.

Clusters. An entity keeps the labels under which it may meet a similar one. What
two sets share in the first fragment is at least what they must share in all less
what the one with less has beyond it. The least of that over its possible partners
(``_least`` over all sizes, and ``_mates`` for sets with few n-grams in the first
fragment, which are looked at list by list) bounds an entity: if its listed n-grams
don't reach it, it has no partner, and labels that hold less than half of it may be
dropped, as two similar sets can't both drop all that they share.

Overlaps. The entities of a label are a cell; a label of over ``cell`` of them is cut
into blocks, and every two blocks are a cell. Cells are worked off in tasks of
bounded size: the overlap of each fragment of the order is counted separately for
all pairs in it, by matrix product or by lists, and summed per pair. A pair that
meets in several cells counts in that of its least common label. What leaves a task
is the sum of links of each entity, and a spanning forest of the links.

Words are runs of ``a-z``, ``0-9`` and non-ASCII characters, lower case; a
document of fewer words than ``n`` has one n-gram, of all its words. N-grams
are told apart by 64-bit hashes.

Defined results: a document is a (doc_id, text); rows that repeat both are one, and
a doc_id with another text is another document. Null, empty and wordless texts are
similar to nothing, each a class of its own without links. Documents with a null
doc_id have no row and are kept by ``one_of_each``. Extra columns are ignored, and
passed through by ``one_of_each``. An empty table gives no rows. Texts are worked on
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _words
from textloom.llm._common import maybe_broadcast, only, written

N = 3
THRESHOLD = 0.6
HEAVY = 1 / 200
FRAGMENTS = 8
#: Share of the light n-grams in the first fragment: the larger, the more of it similar sets must share, and the more is sent.
FIRST = 0.6
#: Entities of a block of a cell.
CELL = 1000
#: N-grams that a task should hold.
PART_GRAMS = 1_500_000
#: Bytes of a table of representatives that is broadcast.
BROADCAST_BYTES = 48 << 20
U = np.uint64
_BITS = 20


def need(size: np.ndarray, t: float) -> np.ndarray:
    """ceil(t * size), safe against rounding."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def _set_hash(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(_words.mix(s ^ U(0x5851F42D4C957F2D)), first[full])
    return _words.mix(out + sizes.astype(np.uint64) * _words.MULT).view(np.int64)


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, h, counts in _words.words(column):
        g, row, _ = _words.ngrams(h, counts, n)
        yield a, b, *_words.sets(g, row, b - a)


def _texts(docs: DataFrame) -> DataFrame:
    d = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull())
    return d.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.xxhash64("text").alias("txt"))


def _spread(x: np.ndarray, parts: int) -> np.ndarray:
    return ((_words.mix(x.view(np.uint64)) >> U(33)) % U(parts)).astype(np.int64)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change."""
    if not len(columns[0]):
        return np.empty(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.empty(0, np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.repeat(starts - _starts(counts), counts) + np.arange(int(counts.sum()))


def _reader(table: pa.Table):
    return lambda c, d: np.concatenate([np.frombuffer(x, dtype=d) for x in table.column(c).to_pylist()])


def _profile(n: int, heavy: float):
    """Of each document its set's hash and size (kind 0); of n-grams that are frequent among some documents, their count (1); number of documents (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names=["kind", "key", "set", "n", "txt"])

        held, docs, size = [], 0, 0

        def frequent() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            ok = c >= max(2, heavy * docs)
            none = np.zeros(ok.sum(), np.int64)
            return out(1, g[ok].view(np.int64), none, c[ok], none)

        total = 0
        for batch in batches:
            ids, txt = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b, s, sizes in _sets(batch.column(1), n):
                yield out(0, ids[a:b], _set_hash(s, sizes), sizes, txt[a:b])
                held.append(s)
                docs, size, total = docs + b - a, size + len(s), total + b - a
                if size > 2_000_000:
                    yield frequent()
                    held, docs, size = [], 0, 0
        if held:
            yield frequent()
        yield out(2, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([total]), np.zeros(1, np.int64))

    return run


#: Share of a set that may be beyond the first fragment before it is odd.
_SHARE = 1 - FIRST + 0.1


def _odd(z: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Sets with so many n-grams beyond the first fragment that ``_least`` doesn't hold for them and their partners."""
    return rest > _SHARE * z


def _least(z: np.ndarray, rest: np.ndarray, t: float) -> np.ndarray:
    """The least that a set shares in the first fragment with a similar one that isn't odd, over all sizes of it.

    With a partner of b n-grams that is t/(1+t) (z + b) less min(rest, share * b):
    falling and then rising in b, so least where rest = share * b, or at an end.
    """
    b = np.clip(rest / _SHARE, t * z, z / t)
    return np.maximum(np.ceil(t / (1 + t) * (z + b) - np.minimum(rest, _SHARE * b) - 1e-6), 1).astype(np.int64)


def _prefixes(n: int, t: float, heavy: np.ndarray, parts: int):
    """First fragment and prefix of each set, packed: for each batch and part, n-grams, and by entity its hash, size, n-grams beyond the fragment, and n-grams here.

    ``heavy`` is sorted from the rarest to the most frequent.
    """
    order = np.argsort(heavy, kind="stable")
    sorted_heavy = heavy[order]
    cut = U(int(FIRST * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << _BITS, dtype=bool)
        table[(heavy >> U(64 - _BITS)).astype(np.int64)] = True
        held: list[tuple] = []
        size, seen = 0, set()

        def packed() -> pa.RecordBatch:
            g, e, z, r = (np.concatenate(x) for x in zip(*held))
            part = _spread(g, parts)
            o = np.argsort(part, kind="stable")
            g, e, z, r, part = g[o], e[o], z[o], r[o], part[o]
            new = _heads(e, part)
            count = np.diff(new, append=len(g))
            cuts, new_cuts = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(part[new], np.arange(parts + 1))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            blob = lambda x, c, d: [x[c[p] : c[p + 1]].astype(d).tobytes() for p in some]
            cols = [blob(g, cuts, np.uint64), blob(e[new], new_cuts, np.int64), *(blob(x[new], new_cuts, np.int32) for x in (z, r)), blob(count, new_cuts, np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(x, type=pa.binary()) for x in cols]], names=["part", *"gezrc"])

        for batch in batches:
            for _, _, s, sizes in _sets(batch.column(1), n):
                if not len(s):
                    continue
                ent = _set_hash(s, sizes)
                fresh = np.array([x > 0 and e not in seen and not seen.add(e) for e, x in zip(ent.tolist(), sizes.tolist())], dtype=bool)
                first = _starts(sizes)
                row = np.repeat(np.arange(len(sizes)), sizes)
                long = sizes - need(sizes, t) + 1
                rank = np.zeros(len(s), dtype=np.int64)
                if len(heavy):
                    p = np.flatnonzero(table[(s >> U(64 - _BITS)).view(np.int64)])
                    q = np.minimum(np.searchsorted(sorted_heavy, s[p]), len(heavy) - 1)
                    ok = sorted_heavy[q] == s[p]
                    rank[p[ok]] = order[q[ok]] + 1
                light = rank == 0
                nth = np.cumsum(light)
                nth -= (nth - light)[np.minimum(first, len(s) - 1)][row]
                lights = np.bincount(row[light], minlength=len(sizes))
                inner = light & (s < cut)
                keep = inner | (light & (nth <= long[row]))
                # Where the prefix takes in heavy n-grams, which is rare, they are ordered by frequency.
                at = np.flatnonzero(~light & (lights < long)[row])
                at = at[np.lexsort((rank[at], row[at]))]
                begin = np.searchsorted(row[at], row[at])
                keep[at] = lights[row[at]] + np.arange(len(at)) - begin + 1 <= long[row[at]]
                rest = sizes - np.bincount(row[inner], minlength=len(sizes))
                k = np.flatnonzero(keep & fresh[row])
                held.append((s[k], ent[row[k]], sizes[row[k]], rest[row[k]]))
                size += len(k)
                if size > 1_000_000:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return run


_POSTINGS = "part int, g binary, e binary, z binary, r binary, c binary"
_LABELS = "q long, e binary, z binary, r binary, s binary, c binary, l binary, n binary"
_FAR = 2**31 - 1


def _mates(begin: np.ndarray, length: np.ndarray, who: np.ndarray, z: np.ndarray, rest: np.ndarray, t: float) -> np.ndarray:
    """Of each entity the least that it must share in the first fragment with an odd one of its lists, and if it is odd with any one.

    The entities of a list are taken together by size, so a long list costs no more than its length by the number of sizes.
    """
    out = np.full(len(z), _FAR, dtype=np.int64)
    odd = _odd(z, rest)
    if not len(begin):
        return out
    lists = np.flatnonzero((length > 1) & np.maximum.reduceat(odd[who], begin))
    i, of = who[_ranges(begin[lists], length[lists])], np.repeat(np.arange(len(lists)), length[lists])
    level = np.floor(np.log(np.maximum(z[i], 1)) / np.log(1.05)).astype(np.int64)
    o = np.lexsort((odd[i], level, of))
    own, own_of = i[o], of[o]
    new = _heads(own_of, level[o], odd[own])
    if not len(new):
        return out
    low, high, most = np.minimum.reduceat(z[own], new), np.maximum.reduceat(z[own], new), np.maximum.reduceat(rest[own], new)
    sort_of, sort_odd = own_of[new], odd[own][new]
    sorts = np.bincount(sort_of, minlength=len(lists))
    first, work = _starts(sorts), np.cumsum(sorts[of])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + 500_000)))
        n = sorts[of[a:b]]
        k, m = _ranges(first[of[a:b]], n), np.repeat(i[a:b], n)
        ok = (odd[m] | sort_odd[k]) & (t * z[m] <= high[k] + 1e-9) & (t * low[k] <= z[m] + 1e-9)
        k, m = k[ok], m[ok]
        least = np.ceil(t / (1 + t) * (z[m] + low[k]) - np.minimum(rest[m], most[k]) - 1e-6)
        np.minimum.at(out, m, np.maximum(least, 1).astype(np.int64))
        a = b
    return out


def _labels(t: float, parts: int):
    """Of one part, by entity: the labels of its lists of several entities, how many n-grams each has, and what it shares at least by ``_mates``."""

    def run(table: pa.Table) -> pa.Table:
        read = _reader(table)
        g, e, z, r, c = read("g", np.uint64), read("e", np.int64), read("z", np.int32), read("r", np.int32), read("c", np.int32)
        ent, at, back = np.unique(e, return_index=True, return_inverse=True)
        z, r = z[at].astype(np.int64), r[at].astype(np.int64)
        who = np.repeat(back, c)
        o = np.lexsort((who, z[who], g))
        g, who = g[o], who[o]
        new = _heads(g, who)  # copies of a set are one entity
        g, who = g[new], who[new]
        apart = np.ones(len(g), dtype=bool)
        apart[1:] = (g[1:] != g[:-1]) | (z[who[:-1]] < t * z[who[1:]] - 1e-9)
        begin = np.flatnonzero(apart)
        length = np.diff(begin, append=len(g))
        least = _mates(begin, length, who, z, r, t)
        label, several = np.repeat(np.minimum.reduceat(who, begin), length) if len(g) else who, np.repeat(length > 1, length)
        who, label = who[several], label[several]
        o = np.lexsort((label, who))
        who, label = who[o], label[o]
        new = _heads(who, label)
        n = np.diff(new, append=len(who)).astype(np.int32)
        who, label = who[new], label[new]
        own = _heads(who)
        count = np.diff(own, append=len(who))
        q = _spread(ent[who[own]], parts)
        rows = []
        for x in np.unique(q):
            k = np.flatnonzero(q == x)
            p = _ranges(own[k], count[k])
            i = who[own[k]]
            rows.append((int(x), ent[i].tobytes(), *(v[i].astype(np.int32).tobytes() for v in (z, r, least)), count[k].astype(np.int32).tobytes(), ent[label[p]].tobytes(), n[p].tobytes()))
        return pa.table([pa.array([r[k] for r in rows], type=pa.binary() if k else pa.int64()) for k in range(8)], names=["q", *"ezrscln"])

    return run


def _kept(t: float):
    """Of one hash range of entities: those that may be similar to another, and the labels that they keep."""

    def run(table: pa.Table) -> pa.Table:
        read = _reader(table)
        e, z, r, s, c = read("e", np.int64), read("z", np.int32), read("r", np.int32), read("s", np.int32), read("c", np.int32)
        label, n = read("l", np.int64), read("n", np.int32)
        ent, at, back = np.unique(e, return_index=True, return_inverse=True)
        z, r = z[at].astype(np.int64), r[at].astype(np.int64)
        least = np.where(_odd(z, r), _FAR, _least(z, r, t))
        np.minimum.at(least, back, s)
        who = np.repeat(back, c)
        o = np.lexsort((label, who))
        who, label, n = who[o], label[o], n[o]
        new = _heads(who, label)
        n = np.add.reduceat(n.astype(np.int64), new)
        who, label = who[new], label[new]
        o = np.lexsort((label, n, who))
        who, label, n = who[o], label[o], n[o]
        total = np.cumsum(n)
        total -= (total - n)[np.searchsorted(who, who)]
        keep = (np.bincount(who, n, len(ent)) >= least)[who] & (total > ((least - 1) // 2)[who])
        who, label = who[keep], label[keep]
        own = _heads(who)
        ends = np.append(own, len(who)).astype(np.int32)
        i = who[own]
        return pa.table([pa.array(ent[i]), pa.array(z[i]), pa.ListArray.from_arrays(pa.array(ends), pa.array(label))], names=["entity", "z", "labels"])

    return run


_CELLS = "unit long, g binary, e binary, z binary, d binary, k binary, c binary, cb binary, ln binary, l binary"


def _segments(n: int):
    """The sets of representatives, packed: for each batch and unit, n-grams, and by entity its size, documents, cells here (label, blocks, own block) and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ent, nd = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b, s, sizes in _sets(batch.column(1), n):
                first = _starts(sizes)
                by: dict[int, list[tuple]] = {}
                for r in range(a, b):
                    labels = np.array(batch.column(4)[r].as_py(), dtype=np.int64)
                    labels.sort()
                    g = s[first[r - a] : first[r - a] + sizes[r - a]].tobytes()
                    cells: dict[int, list[tuple]] = {}
                    for x in batch.column(3)[r].as_py():
                        cells.setdefault(x["unit"], []).append((x["label"], x["i"], x["j"], x["b"]))
                    for unit, own in cells.items():
                        by.setdefault(unit, []).append((g, ent[r], sizes[r - a], nd[r], own, labels))
                rows = []
                for unit, own in by.items():
                    column = lambda k, d: np.array([x[k] for x in own], dtype=d).tobytes()
                    cells = [c for x in own for c in x[4]]
                    rows.append((
                        unit, b"".join(x[0] for x in own), column(1, np.int64), column(2, np.int32), column(3, np.int64), np.array([len(x[4]) for x in own], np.int32).tobytes(),
                        np.array([c[0] for c in cells], np.int64).tobytes(), np.array([c[1:] for c in cells], np.int32).tobytes(), np.array([len(x[5]) for x in own], np.int32).tobytes(), np.concatenate([x[5] for x in own]).tobytes(),
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.binary() if k else pa.int64()) for k in range(10)], names=["unit", "g", "e", "z", "d", "k", "c", "cb", "ln", "l"])

    return run


def _pair_counts(list_begin: np.ndarray, length: np.ndarray, member: np.ndarray, key: np.ndarray, width: np.ndarray, total: np.ndarray) -> None:
    """Adds 1 at key + x * width + y for every two members x < y of each list."""
    for size in np.unique(length):
        runs = np.flatnonzero(length == size)
        x, y = np.triu_indices(int(size), 1)
        step = max(1, 500_000 // len(x))
        for r in range(0, len(runs), step):
            k = runs[r : r + step]
            own = list_begin[k, None]
            i, j = member[own + x], member[own + y]
            at = (key[k, None] + i * width[k, None] + j).ravel()
            if len(at) * 8 > len(total):
                total += np.bincount(at, minlength=len(total)).astype(np.int32)
            else:
                at, n = np.unique(at, return_counts=True)
                total[at] += n.astype(np.int32)


def overlaps(grams: np.ndarray, row: np.ndarray, cell: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells of rows, the overlap of each two rows of a cell: base of each cell, and counts at base + x * m + y for its rows x < y.

    ``grams`` are those of each row, sorted by hash within it; ``cell`` is each row's, ascending.
    """
    cells = int(cell[-1]) + 1
    m = np.bincount(cell, minlength=cells)
    base, first = _starts(m * m), _starts(m)
    total = np.zeros(int((m * m).sum()), dtype=np.int32)
    width = U((1 << 64) // fragments) if fragments > 1 else None
    frag = np.minimum((grams // width).astype(np.int8), fragments - 1) if width else np.zeros(len(grams), np.int8)
    for f in range(fragments):
        k = np.flatnonzero(frag == f)
        o = np.lexsort((row[k], grams[k], cell[row[k]]))
        g, r = grams[k[o]], row[k[o]]
        c = cell[r]
        begin = _heads(g, c)
        length = np.diff(begin, append=len(g))
        local = r - first[c]
        own = c[begin]
        dense = length > np.maximum(32, m[own] // 16)
        partial = np.zeros(len(total), dtype=np.int32)  # what this fragment holds of each overlap
        few = np.flatnonzero((length > 1) & ~dense)
        _pair_counts(begin[few], length[few], local, base[own[few]], m[own[few]], partial)
        lists = np.flatnonzero(dense)
        for x in np.unique(own[lists]):
            here = lists[own[lists] == x]
            block = partial[base[x] : base[x] + m[x] ** 2].reshape(m[x], m[x])
            for a in range(0, len(here), 2048):
                some = here[a : a + 2048]
                matrix = np.zeros((m[x], len(some)), dtype=np.float32)
                matrix[local[_ranges(begin[some], length[some])], np.repeat(np.arange(len(some)), length[some])] = 1
                block += np.triu((matrix @ matrix.T).astype(np.int32), 1)
        total += partial
    return base, total


def forest(x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """The least number in each number's component."""
    label = np.arange(m)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return label


_LINKS = "kind int, a long, b long, n long, jaccard double"


def _count(t: float, fragments: int, pairs: bool):
    """Of one unit's cells: links of each entity (kind 0, n) and a spanning forest of them (kind 1), or all similar pairs (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        read = _reader(table)
        g, e, z, d = read("g", np.uint64), read("e", np.int64), read("z", np.int32).astype(np.int64), read("d", np.int64)
        k, c, cb, ln, l = read("k", np.int32), read("c", np.int64), read("cb", np.int32).reshape(-1, 3), read("ln", np.int32), read("l", np.int64)
        start, l_start, c_start = _starts(z), _starts(ln), _starts(k)
        ent, at = np.unique(e, return_index=True)  # rows that repeat a document send it again
        z, d, start = z[at], d[at], start[at]
        pick = _ranges(c_start[at], k[at])
        owner, c, cb = np.repeat(np.arange(len(ent)), k[at]), c[pick], cb[pick]
        ln, l = ln[at], l[_ranges(l_start[at], ln[at])]
        l_start = _starts(ln)
        names, l = np.unique(l, return_inverse=True)
        has = np.repeat(np.arange(len(ent), dtype=np.int64), ln) * len(names) + l  # ascending
        o = np.lexsort((owner, cb[:, 1], cb[:, 0], c))
        owner, c, cb = owner[o], c[o], cb[o]
        new = _heads(c, cb[:, 0], cb[:, 1])
        m = np.diff(new, append=len(c))
        new, m = new[m > 1], m[m > 1]
        grams = np.add.reduceat(z[owner], new) if len(new) else m
        links, found, joined = np.zeros(len(ent), dtype=np.int64), [], []
        lo = 0
        while lo < len(new):
            hi, squares, load = lo, 0, 0
            while hi < len(new) and (hi == lo or (squares + int(m[hi]) ** 2 <= 4_000_000 and load + int(grams[hi]) <= 1_000_000)):
                squares, load, hi = squares + int(m[hi]) ** 2, load + int(grams[hi]), hi + 1
            rows = _ranges(new[lo:hi], m[lo:hi])
            who, cell = owner[rows], np.repeat(np.arange(hi - lo), m[lo:hi])
            base, n = overlaps(g[_ranges(start[who], z[who])], np.repeat(np.arange(len(who)), z[who]), cell, fragments)
            p = np.flatnonzero(n)
            own = np.searchsorted(base, p, side="right") - 1
            x, y = np.divmod(p - base[own], m[lo + own])
            first = _starts(m[lo:hi])[own]
            x, y, n = x + first, y + first, n[p].astype(np.int64)
            i, j = who[x], who[y]
            union = z[i] + z[j] - n
            ok = n >= union * (t - 1e-12)
            mixed = cb[rows, 0] != cb[rows, 1]
            ok &= ~mixed[x] | (cb[rows[x], 2] != cb[rows[y], 2])  # in a cell of two blocks, pairs of one block belong to another cell
            i, j, n, union, label = i[ok], j[ok], n[ok], union[ok], np.searchsorted(names, c[rows[x[ok]]])
            # The pair counts where its least common label is.
            mine, open_, nth = np.zeros(len(i), dtype=bool), np.arange(len(i)), 0
            while len(open_):
                open_ = open_[nth < ln[i[open_]]]
                try_ = l[l_start[i[open_]] + nth]
                there = j[open_] * len(names) + try_
                hit = has[np.minimum(np.searchsorted(has, there), len(has) - 1)] == there
                mine[open_[hit & (try_ == label[open_])]] = True
                open_, nth = open_[~hit], nth + 1
            i, j = i[mine], j[mine]
            if pairs:
                found.append((ent[i], ent[j], n[mine] / union[mine]))
            else:
                links += np.bincount(i, d[j], len(ent)).astype(np.int64) + np.bincount(j, d[i], len(ent)).astype(np.int64)
                tree = forest(i, j, len(ent))
                k_ = np.flatnonzero(tree != np.arange(len(ent)))
                joined.append((k_, tree[k_]))
            lo = hi
        if pairs:
            a, b, s = (np.concatenate([f[q] for f in found]) if found else np.empty(0, np.int64 if q < 2 else float) for q in range(3))
            return pa.table([pa.array(np.full(len(a), 2, np.int32)), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64)), pa.array(s)], names=["kind", "a", "b", "n", "jaccard"])
        x, y = (np.concatenate([f[q] for f in joined]) if joined else np.empty(0, np.int64) for q in range(2))
        tree = forest(x, y, len(ent))
        some, k_ = np.flatnonzero(links), np.flatnonzero(tree != np.arange(len(ent)))
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(k_)])
        a, b = np.concatenate([ent[some], ent[k_]]), np.concatenate([np.zeros(len(some), np.int64), ent[tree[k_]]])
        return pa.table([pa.array(kind), pa.array(a), pa.array(b), pa.array(np.concatenate([links[some], np.zeros(len(k_), np.int64)])), pa.array(np.zeros(len(a)))], names=["kind", "a", "b", "n", "jaccard"])

    return run


def entities(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, heavy: float = HEAVY, fragments: int = FRAGMENTS, part_grams: int = PART_GRAMS, cell: int = CELL, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, txt, entity, size) of every document, and what ``_count`` found: (kind, a, b, n, jaccard)."""
    d = _texts(docs)
    profile = written(d.mapInArrow(_profile(n, heavy), "kind int, key long, set long, n long, txt long"), "profile")
    known = profile.groupBy("kind").agg(F.sum("n").alias("n")).collect()
    known = {r["kind"]: r["n"] for r in known}
    counts = profile.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, heavy * known.get(2, 0))).orderBy("n", "key").toPandas()
    grams = counts["key"].to_numpy(dtype=np.int64).view(np.uint64)
    member = profile.where("kind = 0").select(F.col("key").alias("doc_id"), "txt", F.col("set").alias("entity"), F.col("n").alias("size")).distinct()
    parts = max(12, -(-int(known.get(0, 0) * max(FIRST, 1 - threshold)) // part_grams))
    postings = d.select("doc_id", "text").mapInArrow(_prefixes(n, threshold, grams, parts), _POSTINGS)
    labels = postings.groupBy("part").applyInArrow(_labels(threshold, parts), _LABELS)
    kept = written(labels.groupBy("q").applyInArrow(_kept(threshold), "entity long, z long, labels array<long>"), "kept")
    under = kept.select("entity", "z", F.explode("labels").alias("label"))
    clusters = written(under.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), "clusters")
    hot = clusters.where(F.col("n") > cell)
    hot = maybe_broadcast(hot, hot.count())
    cold = under.join(hot, "label", "left_anti").join(clusters.where(F.col("n") <= cell).select("label"), "label")
    none = F.lit(0).alias
    cold = cold.select("entity", "z", "label", none("i"), none("j"), none("b"))
    split = under.join(hot.select("label", F.ceil(F.col("n") / cell).cast("int").alias("blocks")), "label")
    split = split.withColumn("b", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("entity", "z", "label", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b")
    cells = written(cold.unionByName(split), "cells")
    units = max(12, -(-int(cells.agg(F.sum("z")).first()[0] or 0) // part_grams))
    unit = F.pmod(F.xxhash64("label", "i", "j"), F.lit(units)).alias("unit")
    sent = cells.groupBy("entity").agg(F.collect_list(F.struct(unit, "label", "i", "j", "b")).alias("cells"), F.collect_set("label").alias("labels"))
    reps = member.groupBy("entity").agg(F.min(F.struct("doc_id", "txt")).alias("rep"), F.count("*").alias("nd"))
    reps = written(sent.join(reps, "entity").select("entity", F.col("rep.doc_id").alias("rep_id"), F.col("rep.txt").alias("rep_txt"), "nd", "cells", "labels"), "reps")
    rows, held = reps.agg(F.count("*"), F.coalesce(F.sum(40 * F.size("cells") + 8 * F.size("labels") + 64), F.lit(0))).first()
    text = d.join(maybe_broadcast(reps, held, BROADCAST_BYTES), (d["doc_id"] == reps["rep_id"]) & d["txt"].eqNullSafe(reps["rep_txt"]))
    segments = text.select("entity", "text", "nd", "cells", "labels").mapInArrow(_segments(n), _CELLS)
    return member, written(segments.groupBy("unit").applyInArrow(_count(threshold, fragments, pairs), _LINKS), "links")


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **how) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, entity) and the similar pairs of different sets (a, b, jaccard), each once."""
    member, found = entities(docs, n, threshold, pairs=True, **how)
    return member.where("size > 0").select("doc_id", "entity").distinct(), found.where("kind = 2").select("a", "b", "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its connected component; edges a, b. Each round takes the least label around and then that label's label."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("other")).withColumnRenamed("a", "node")
        best = labels.join(near, "node").select("node", F.least("label", "other").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = written(best.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("now"), "label").withColumnsRenamed({"label": "was", "now": "label"}), "labels")
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, txt, class_id, class_txt, links of every document: its class is named by its least (doc_id, txt)."""
    member, found = entities(docs, n, threshold, **how)
    label = components(found.where("kind = 1")).select(F.col("node").alias("entity"), "label")
    links = found.where("kind = 0").groupBy(F.col("a").alias("entity")).agg(F.sum("n").alias("others"))
    own = member.where("size > 0").groupBy("entity").agg(F.min(F.struct("doc_id", "txt")).alias("least"), F.count("*").alias("nd"))
    own = own.join(label, "entity", "left").join(links, "entity", "left").where("nd > 1 or others is not null")
    own = written(own.select("entity", "least", F.coalesce("label", "entity").alias("label"), (F.coalesce("others", F.lit(0)) + F.col("nd") - 1).alias("links")), "several")
    named = own.groupBy("label").agg(F.min("least").alias("class"))
    own = written(own.join(named, "label").select("entity", "class", "links"), "classes")
    out = member.join(maybe_broadcast(own, own.count(), 500_000), "entity", "left")
    name = lambda c: F.coalesce(F.col(f"class.{c}"), F.col(c)).alias(f"class_{c.removeprefix('doc_')}")
    return out.select("doc_id", "txt", name("doc_id"), name("txt"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and links (the number of other documents that are similar) of every document."""
    return classes(docs, n, threshold, **how).select("doc_id", "class_id", "links")


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` with one document of each class, all columns kept; removed by doc_id and text."""
    gone = classes(docs, n, threshold, **how).where("doc_id <> class_id or txt <> class_txt").select(F.col("doc_id").alias("__gone"), F.col("txt").alias("__txt"))
    gone = written(gone, "gone")
    out = docs.withColumn("__hash", F.xxhash64("text"))
    return out.join(maybe_broadcast(gone, gone.count()), (out["doc_id"] == gone["__gone"]) & (out["__hash"] == gone["__txt"]), "left_anti").drop("__hash")


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLE = {
    "op6_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM w WHERE len(w) > 0),
z AS (SELECT doc_id, count(*) AS z FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM p JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE n >= (x.z + y.z - n) * ({THRESHOLD} - 1e-12)),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
class AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.b, d.doc_id)) AS class_id, coalesce(l.n, 0) AS links
FROM documents d LEFT JOIN class c ON d.doc_id = c.a LEFT JOIN links l ON d.doc_id = l.a WHERE d.doc_id IS NOT NULL"""
}
