"""Queries over all words, which have no SQL, against brute force on a small table."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from textloom.plans import registry

COPY = "a text that was copied more often than any bound on the documents of a word"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The folder of a table of documents, and its rows: random texts, a large group of exact copies, texts that share a rare word only."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(3, 25))) if x < 60) or "w1" for _ in range(60)]
    texts += [COPY] * 45 + [f"zzz common w1 w2 w3 own{k} w{k}" for k in range(4)] + ["whst w1 w2 whst w5"]
    rows = [(d, t, ("en", "de")[d % 2], ("x", "y")[d % 3 == 0]) for d, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def words(text):
    return re.findall(r"\w+", text.lower())


def overlaps(rows, least=1 / 3):
    """Brute force: class, links, linked of each document."""
    sets = [set(words(t)) for _, t, _, _ in rows]
    want = {}
    for a, (doc, _, *ma) in enumerate(rows):
        near = [b for b, (_, _, *mb) in enumerate(rows) if b != a and None not in ma and ma == mb and sets[a] & sets[b]]
        links, linked = (sum(len(sets[a] & sets[b]) / len(sets[x]) >= least for b, x in ((b, b if back else a) for b in near)) for back in (0, 1))
        want[doc] = (min([doc, *(rows[b][0] for b in near if sets[a] == sets[b])]), links, linked)
    return want


def test_overlap(spark, table):
    folder, rows = table
    got = {r.doc_id: (r["class"], r.links, r.linked) for r in registry.QUERIES["overlap_by_language_all"](spark, folder).collect()}
    assert got == overlaps(rows) and any(c != d for d, (c, *_) in got.items())


def test_overlap_of_blocks(spark, monkeypatch):
    """Groups of many blocks, words of all frequencies, texts without words, documents without a language."""
    from textloom.operators import links
    from textloom.sources.texts import from_texts

    for name, size in (("BLOCK", 7), ("STRIPE", 3), ("DENSE", 4), ("MEETINGS", 5)):
        monkeypatch.setattr(links, name, size)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 12))) if x < 400) for _ in range(90)] + ["w1 w2", "w2 w1", "", " - ", "w1"]
    rows = [(f"d{k:02d}", t, "en" if k % 9 else None, "x" if k % 4 else "y") for k, t in enumerate(texts)]
    c = from_texts(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string"), words_only=True)
    for least in (1 / 3, 0.6, 1.0):
        got = {r.doc_id: (r["class"], r.links, r.linked) for r in links.overlap_links(c, meta_cols=["lang", "source"], min_similarity=least).collect()}
        assert got == overlaps(rows, least)
    other = c.set("token", "upper(token)")
    assert {r.doc_id: (r["class"], r.links, r.linked) for r in links.overlap_links(other, min_similarity=0.6).collect()} == overlaps([(d, t, "", "") for d, t, *_ in rows], 0.6)


def test_deduplicated(spark, table):
    folder, rows = table
    own = {d: Counter(words(t)) for d, t, _, _ in rows}
    df = Counter(w for c in own.values() for w in c)
    own = {d: {w: n for w, n in c.items() if df[w] >= 2} for d, c in own.items()}
    n = sum(1 for c in own.values() if c)
    vec = {d: {w: k / sum(c.values()) * math.log2(n / df[w]) for w, k in c.items()} for d, c in own.items()}
    norm = {d: math.sqrt(sum(v * v for v in c.values())) for d, c in vec.items()}
    gone = set()
    for a in vec:
        for b in vec:
            if a < b and norm[a] and norm[b] and sum(v * vec[b].get(w, 0) for w, v in vec[a].items()) >= (0.9 - 1e-9) * norm[a] * norm[b]:
                gone.add(b)
    left = {r.doc_id for r in registry.QUERIES["deduplicated_all"](spark, folder).collect()}
    assert left == set(own) - gone and sum(rows[d][1] == COPY for d in left) == 1


def window_edges(rows, size):
    """Brute force: the positions of src that have dst within ``size`` positions."""
    edges = Counter()
    for _, t, _, _ in rows:
        w = words(t)
        for i, x in enumerate(w):
            edges.update((x, y) for y in set(w[max(0, i - size) : i + size + 1]) - {x})
    return edges


def test_windows(spark, table):
    folder, rows = table
    edges = window_edges(rows, 5)
    run = lambda name: list(registry.QUERIES[name](spark, folder).collect())
    assert {(r.src, r.dst): r.weight for r in run("network_window_all")} == edges
    out, into = [[Counter(), Counter()] for _ in range(2)]
    for (x, y), n in edges.items():
        for side, v in ((out, x), (into, y)):
            side[0][v] += n
            side[1][v] += 1
    alpha = {e: min((1 - n / s[v]) ** (k[v] - 1) for (s, k), v in ((out, e[0]), (into, e[1]))) for e, n in edges.items()}
    assert {(r.src, r.dst): r.alpha for r in run("network_backbone_all")} == pytest.approx({e: a for e, a in alpha.items() if a < 0.05}, abs=1e-6)
    edges = window_edges(rows, 2)
    near = sorted((-n, y) for (x, y), n in edges.items() if x == "whst")[:10]
    names = {"whst"} | {y for _, y in near}
    assert {(r.src, r.dst): r.weight for r in run("network_ego_all")} == {e: n for e, n in edges.items() if set(e) <= names}


def test_contexts(spark, table):
    folder, rows = table
    own = [Counter(words(t)) for _, t, _, _ in rows]
    vocab = sorted({w for c in own for w in c})
    m = np.array([[c[w] for w in vocab] for c in own], dtype=float)
    size = np.sqrt((m**2).sum(0))
    has = (m > 0).astype(float)
    both, n = has.T @ has, has.sum(0)
    off = ~np.eye(len(vocab), dtype=bool)
    met = (both > 0) & off
    edges = lambda name: {(r.src, r.dst): r.weight for r in registry.QUERIES[name](spark, folder).collect()}
    want = lambda w, keep: {(vocab[i], vocab[j]): w[i, j] for i, j in np.argwhere(keep & met)}
    cosine = m.T @ m / np.outer(size, size)
    assert edges("network_cosine_all") == pytest.approx(want(cosine, np.triu(cosine >= 0.2)), abs=1e-6)
    share = both / n[:, None]
    assert edges("network_conditional_all") == pytest.approx(want(share, share >= 0.5), abs=1e-6)
    b, c = n[:, None] - both, n[None, :] - both
    d = len(rows) - ((b + c) - both)
    total, under = both + b + c + d, (both + c) * (b + d) * (both + b) * (c + d)
    chi = np.where(under == 0, 0, total * (np.abs(both * d - b * c) - total / 2) ** 2 / np.where(under == 0, 1, under))
    assert edges("network_chi2_all") == pytest.approx(want(chi, chi >= 100), abs=1e-3)
    assert ("copied", "bound") in edges("network_conditional_all")


def test_split_is_bounded(spark, monkeypatch):
    """Tokens with spaces leave Python in batches of so many, and documents may be cut by them."""
    import pyarrow as pa
    from textloom.functions import text as T
    from textloom.sources import texts

    rows = [(k, "  one two,\nthree's 4.5 " * n) for k, n in enumerate([0, 1, 30, 2, 100])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in T.split(df, "text", False, None, None, size=7).collect():
        got.setdefault(r.doc_id, []).append((r.sentence, r.token_id, r.token, r.space, r.start, r.end))
    assert got == {d: list(T.split_text(t)) for d, t in rows if t}
    sizes = []
    take = pa.RecordBatch.from_arrays
    df = type("Rows", (), {"columns": ["doc_id", "text"], "select": lambda *_: spark.createDataFrame([], "doc_id long"), "mapInArrow": lambda _, f, __: sizes.extend(b.num_rows for b in f(iter([take([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])])))})()
    T.split(df, "text", False, None, None, size=50)
    assert max(sizes) <= 50 < sum(sizes)
    c = texts.from_texts(spark.createDataFrame(rows, "doc_id long, text string"), remember_spaces=True)
    assert {r.doc_id: r.text for r in texts.untokenize(c).collect()} == {d: t.strip() for d, t in rows if t}


def test_ego_has_no_bound(spark, tmp_path):
    """A word in more than 600 documents has its network, as has one that is reached; one that is nowhere has none."""
    texts = ["whst w1 w2 whst w5"] * 650 + ["w1 whst w7 w7 w2 whst", "x y"]
    rows = [(d, t, "en", "x") for d, t in enumerate(texts)]
    for name, some in (("full", rows), ("none", rows[-1:])):
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    edges = window_edges(rows, 2)
    near = sorted((-n, y) for (x, y), n in edges.items() if x == "whst")[:10]
    names = {"whst"} | {y for _, y in near}
    got = registry.QUERIES["network_ego"](spark, f"{tmp_path}/full").collect()
    assert {(r.src, r.dst): r.weight for r in got} == {e: n for e, n in edges.items() if set(e) <= names}
    assert registry.QUERIES["network_ego"](spark, f"{tmp_path}/none").collect() == []


def test_bounds_of_null_values(spark):
    """Rows without a value don't meet in one task."""
    from textloom.operators.preprocessing import bounded

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        t = spark.range(0, 400, 1, 4).selectExpr("id as doc_id", "1 as token_id", "if(id % 100 < 3, concat('w', id % 100), null) as f", "id as x")
        out = [r for r in bounded(t, "f", 2, None).selectExpr("*", "spark_partition_id() as part").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.f, r.x) for r in out if r.f) == [(k, f"w{k % 100}", k) for k in range(400) if k % 100 < 3] and len(out) == 400
    parts = Counter(r.part for r in out if r.f is None)
    assert max(parts.values()) < 200


def test_ngrams_are_partitioned_by_document(spark, table):
    """The tokens are shuffled by document alone, not by document and null, which no later count could use."""
    for name in ("trigrams", "preprocess_bigrams"):
        df = registry.QUERIES[name](spark, table[0])
        plan = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
        assert plan and not any("isnull" in x.split("hashpartitioning(")[1].split("ENSURE")[0] for x in plan)


def test_document_frequencies_are_counted_in_rows(spark, table):
    """No shuffle of words by document, unless an id comes twice: then its rows are one document."""
    from textloom.sources.texts import from_texts

    c = from_texts(spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "b")], "doc_id long, text string"), words_only=True)
    f = c.filter_freq("token", min=2, docs=True)
    assert sorted(r.token for r in f.tokens.collect()) == ["b", "b", "b"]
    assert "doc_id" not in f.tokens._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")[1].split("explode(array_distinct")[0].split("Aggregate [token")[1]
    c = from_texts(spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "b")], "doc_id long, text string"), words_only=True)
    assert sorted(r.token for r in c.filter_freq("token", min=2, docs=True).tokens.collect()) == ["b", "b"]
    assert c.set("token", "upper(token)").words() is None


def test_meetings_are_counted(monkeypatch):
    """Frequent words by matrices, others by rows, in stripes and steps; the numbers of rows come back from their bytes."""
    import pyarrow as pa
    from textloom.operators import links

    for name, size in (("STRIPE", 3), ("DENSE", 4), ("MEETINGS", 5)):
        monkeypatch.setattr(links, name, size)
    rng = np.random.default_rng(3)

    def some(n):
        rows = [sorted({int(x) - 1 for x in rng.zipf(1.3, int(rng.integers(0, 15))) if x < 1 << 29}) for _ in range(n)]
        starts = np.cumsum([0, *map(len, rows)])
        raw, at = links.encoded(np.array([x for r in rows for x in r], np.int64), starts)
        ids, found = links.decoded(pa.array([raw[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary()).slice(1))
        assert [list(ids[a:z]) for a, z in zip(found, found[1:])] == rows[1:]
        return rows[1:], (ids, found)

    for n, k in ((11, 20), (20, 11), (2, 2), (30, 3)):
        (ra, a), (rb, b) = some(n), some(k)
        got = {first + i: list(row) for first, both in links.meetings(a, b) for i, row in enumerate(both)}
        assert got == {i: [len(set(x) & set(y)) for y in rb] for i, x in enumerate(ra)}
    assert [list(links.needed(np.arange(1, 8), f)) for f in (1 / 3, 1.0)] == [[1, 1, 1, 2, 2, 2, 3], [*range(1, 8)]]
