"""Queries over token positions: features, contexts, subsets, recoding.

All leaves of all queries are looked up in one pass. Contexts, and features where
the query's form allows it, are then DataFrame algebra on (context, position):
unions, semi-joins, range windows. Complete hits, which are a greedy choice within a
document, are made by a state machine over the matches (not the tokens) of each
document, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Corpus
from textloom.operators import dictionary, greedy
from textloom.operators import query as Q


def _plan(corpus: Corpus, queries: str | list[str], codes: list[str] | None, feature: str) -> list[tuple[str, object]]:
    """(code, tree) of each query; equal leaves of all queries share a number."""
    named = Q.labelled([queries] if isinstance(queries, str) else list(queries), codes)
    trees = [(code, Q.parse(text, feature)) for code, text in named]
    numbers: dict[tuple, int] = {}
    for _, x in trees:
        for leaf in Q.leaves(x):
            if leaf.feature not in corpus.tokens.columns:
                raise Q.QueryError(f"there is no column {leaf.feature!r}; there are {corpus.feature_names}")
            key = (tuple(leaf.terms), leaf.feature, leaf.sensitive, tuple(leaf.token_expr), tuple(leaf.meta_expr))
            leaf.number = numbers.setdefault(key, len(numbers))
    return trees


def leaf_matches(corpus: Corpus, trees: list, context: list[str], as_ascii: bool) -> DataFrame:
    """leaf, context, token_id, n: where each leaf matches, under its conditions."""
    leaves = {leaf.number: leaf for _, x in trees for leaf in Q.leaves(x)}
    parts = []
    t = corpus.tokens
    for feature in dict.fromkeys(x.feature for x in leaves.values()):
        own = [x for x in leaves.values() if x.feature == feature]
        conditions = {x.number: reduce(lambda a, b: a & b, [F.coalesce(F.expr(e), F.lit(False)) for e in x.token_expr if e.strip()]) for x in own if any(e.strip() for e in x.token_expr)}
        keep = [c for c in t.columns if c not in (*context, "token_id")] if conditions else []
        patterns = [(x.number, s, x.sensitive) for x in own for s in x.terms]
        m = dictionary.lookup(t, feature, patterns, context, ascii_=as_ascii, keep=keep)
        for number, ok in conditions.items():
            m = m.where((F.col("number") != number) | ok)
        parts.append(m.select(F.col("number").alias("leaf"), *context, "token_id", "n"))
    m = reduce(lambda a, b: a.unionByName(b), parts)
    for x in leaves.values():
        if any(e.strip() for e in x.meta_expr):
            ok = corpus.meta.where(reduce(lambda a, b: a & b, [F.expr(e) for e in x.meta_expr if e.strip()])).select("doc_id")
            m = m.where(F.col("leaf") != x.number).unionByName(m.where(F.col("leaf") == x.number).join(ok, "doc_id", "left_semi").select(*m.columns))
    return m.distinct()


def _algebraic(x, parent: str = "") -> bool:
    """Whether features of the query are the same by windows and joins as by the state machine."""
    if isinstance(x, Q.Leaf):
        return True
    if x.relation == "sequence" or x.directed:
        return False
    return all(_algebraic(t, x.relation) for t in x.terms)


def _features(x, m: DataFrame, context: list[str]) -> DataFrame:
    """context, token_id, n, ghost of all matches for which the query holds."""
    if isinstance(x, Q.Leaf):
        return m.where(F.col("leaf") == x.number).select(*context, "token_id", "n", F.lit(x.ghost).alias("ghost"))
    parts = [_features(t, m, context) for t in x.terms]
    if x.relation == "OR":
        return reduce(lambda a, b: a.unionByName(b), parts)
    if x.relation == "NOT":
        return parts[0].join(parts[1].select(*context).distinct(), context, "left_anti")
    rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn("__t", F.lit(k)) for k, p in enumerate(parts)])
    n = len(parts)
    if x.relation == "AND":
        rows = rows.withColumn("__ok", F.size(F.collect_set("__t").over(W.partitionBy(*context))) == n)
    else:
        near = W.partitionBy(*context).orderBy("token_id")
        rows = rows.withColumn("__begin", F.size(F.collect_set("__t").over(near.rangeBetween(0, x.window))) == n)
        rows = rows.withColumn("__ok", F.max("__begin").over(near.rangeBetween(-x.window, 0))).drop("__begin")
    return rows.where("__ok").drop("__ok", "__t")


def _contexts(x, m: DataFrame, context: list[str]) -> DataFrame:
    """Contexts for which the query holds."""
    if isinstance(x, Q.Leaf):
        return m.where(F.col("leaf") == x.number).select(*context).distinct()
    if x.relation == "OR":
        return reduce(lambda a, b: a.unionByName(b), [_contexts(t, m, context) for t in x.terms]).distinct()
    if x.relation == "NOT":
        return _contexts(x.terms[0], m, context).join(_contexts(x.terms[1], m, context), context, "left_anti")
    if x.relation == "AND":
        return reduce(lambda a, b: a.join(b, context, "left_semi"), [_contexts(t, m, context) for t in x.terms])
    if _algebraic(x):
        return _features(x, m, context).select(*context).distinct()
    found = _machine([("", x)], m, context, True, False)
    return found.select("doc_id", *(["sentence"] if "sentence" in context else [])).distinct()


def _boolean(x, leaf) -> Column | None:
    """The condition on a context, by one on each leaf; None for queries with positions."""
    if isinstance(x, Q.Leaf):
        return leaf(x.number)
    parts = [_boolean(t, leaf) for t in x.terms]
    if x.relation not in ("OR", "AND", "NOT") or any(p is None for p in parts):
        return None
    return parts[0] & ~parts[1] if x.relation == "NOT" else reduce((lambda a, b: a | b) if x.relation == "OR" else (lambda a, b: a & b), parts)


_HITS = "code string, doc_id {doc}, sentence int, token_id int, n int, ghost boolean, hit_id int"


def _machine(trees: list, m: DataFrame, context: list[str], every: bool, longest: bool) -> DataFrame:
    """The state machine over each document's matches."""
    sentence = F.col("sentence") if "sentence" in context else F.lit(None).cast("int")
    doc = m.schema["doc_id"].dataType.simpleString()
    each = m.groupBy("doc_id").agg(F.collect_list(F.struct("leaf", sentence.cast("int").alias("s"), F.col("token_id").cast("int").alias("t"), F.col("n").cast("int").alias("n"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            docs = batch.column(0)
            rows: list[int] = []
            for k, own in enumerate(batch.column(1).to_pylist()):
                found: dict[int, list] = {}
                for x in own:
                    found.setdefault(x["leaf"], []).append((x["s"], x["t"], x["n"]))
                for code, tree in trees:
                    hits = greedy.evaluate(tree, found, every)
                    if not every:
                        hits = greedy.without_overlaps(hits, longest)
                    for h in hits:
                        rows.append(k)
                        for c, v in zip(out, (code, None, h.sentence, h.at, h.words, h.ghost, h.hit)):
                            c.append(v)
            types = (pa.string(), None, pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            cols = [docs.take(pa.array(rows, type=pa.int64())) if t is None else pa.array(c, type=t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(cols, names=["code", "doc_id", "sentence", "token_id", "n", "ghost", "hit_id"])

    return each.mapInArrow(run, _HITS.format(doc=doc))


def search_features(corpus: Corpus, queries: str | list[str], codes: list[str] | None = None, feature: str = "token", mode: str = "unique_hits", context_level: str = "document", keep_longest: bool = True, as_ascii: bool = False) -> DataFrame:
    """code, feature, doc_id, sentence, token_id, hit_id: a row for each token of a hit.

    ``unique_hits`` gives complete hits, which can be counted; ``features`` all tokens
    for which the query holds (hit_id then tells nothing). hit_id counts within a
    code and document.
    """
    if mode not in ("unique_hits", "features"):
        raise ValueError("mode is 'unique_hits' or 'features'")
    context = corpus.context(context_level)
    trees = _plan(corpus, queries, codes, feature)
    m = leaf_matches(corpus, trees, context, as_ascii)
    every = mode == "features"
    algebra = [(c, x) for c, x in trees if every and _algebraic(x)]
    machine = [(c, x) for c, x in trees if not (every and _algebraic(x))]
    parts = [_machine(machine, m, context, every, keep_longest).drop("sentence")] if machine else []
    for code, x in algebra:
        f = _features(x, m, context).where("not ghost")
        parts.append(f.select(F.lit(code).alias("code"), "doc_id", F.col("token_id").cast("int").alias("token_id"), F.col("n").cast("int").alias("n"), "ghost", F.lit(1).alias("hit_id")))
    hits = reduce(lambda a, b: a.unionByName(b), parts).where("not ghost")
    at = F.explode(F.sequence(F.col("token_id"), F.col("token_id") + F.col("n") - 1))
    hits = hits.select("code", "doc_id", "hit_id", at.alias("token_id"))
    hits = hits.distinct()
    if not corpus.has_sentences:
        return corpus.tokens_at(hits, feature).select("code", "feature", "doc_id", F.lit(None).cast("int").alias("sentence"), "token_id", "hit_id")
    t = corpus.tokens.select("doc_id", "token_id", F.col(f"`{feature}`").alias("feature"), F.col("sentence").cast("int").alias("sentence"))
    return hits.join(t, ["doc_id", "token_id"]).select("code", "feature", "doc_id", "sentence", "token_id", "hit_id")


def all_contexts(corpus: Corpus, context: list[str]) -> DataFrame:
    return corpus.meta.select("doc_id") if context == ["doc_id"] else corpus.tokens.select(*context).distinct()


def search_contexts(corpus: Corpus, queries: str | list[str], codes: list[str] | None = None, feature: str = "token", context_level: str = "document", inverse: bool = False, as_ascii: bool = False) -> DataFrame:
    """code, doc_id, sentence: the contexts for which a query holds, or with ``inverse`` all others."""
    context = corpus.context(context_level)
    trees = _plan(corpus, queries, codes, feature)
    m = leaf_matches(corpus, trees, context, as_ascii)
    sentence = F.col("sentence").cast("int") if "sentence" in context else F.lit(None).cast("int")
    parts = []
    plain = [(code, c) for code, x in trees if (c := _boolean(x, lambda k: F.array_contains("__leaves", k))) is not None]
    if plain:  # all such queries by one row for each context
        flags = m.groupBy(*context).agg(F.collect_set("leaf").alias("__leaves"))
        if inverse:
            flags = all_contexts(corpus, context).join(flags, context, "left").withColumn("__leaves", F.coalesce("__leaves", F.array().cast("array<int>")))
        held = F.array_compact(F.array(*[F.when(~c if inverse else c, F.lit(code)) for code, c in plain]))
        parts.append(flags.select(F.explode(held).alias("code"), "doc_id", sentence.alias("sentence")))
    for code, x in [(code, x) for code, x in trees if _boolean(x, lambda k: F.lit(True)) is None]:
        c = _contexts(x, m, context)
        if inverse:
            c = all_contexts(corpus, context).join(c, context, "left_anti")
        parts.append(c.select(F.lit(code).alias("code"), "doc_id", sentence.alias("sentence")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def subset_query(corpus: Corpus, query: str, feature: str = "token", context_level: str = "document", window: int | None = None, inverse: bool = False) -> Corpus:
    """Keeps the contexts for which the query holds (``inverse``: the others), or the tokens within ``window`` of its features."""
    context = corpus.context(context_level)
    if window is not None:
        hits = search_features(corpus, query, feature=feature, mode="features", context_level=context_level).select("doc_id", "token_id").distinct().withColumn("__hit", F.lit(True))
        inside = corpus.around(hits, window) if corpus.is_plain and context == ["doc_id"] else None
        if inside is not None:
            return Corpus(inside, corpus.meta.join(inside.select("doc_id").distinct(), "doc_id", "left_semi"), corpus.model)
        near = W.partitionBy(*context).orderBy("token_id").rangeBetween(-window, window)
        t = corpus.tokens.join(hits, ["doc_id", "token_id"], "left").withColumn("__near", F.max(F.coalesce("__hit", F.lit(False))).over(near))
        t = t.where("__near").select(*corpus.tokens.columns)
    else:
        c = search_contexts(corpus, query, feature=feature, context_level=context_level).select(*context)
        t = corpus.tokens.join(c, context, "left_anti" if inverse else "left_semi").select(*corpus.tokens.columns)
    return Corpus(t, corpus.meta.join(t.select("doc_id").distinct(), "doc_id", "left_semi"), corpus.model)


def code_features(corpus: Corpus, queries: str | list[str], codes: list[str] | None = None, feature: str = "token", column: str = "code", context_level: str = "document", add_column: dict[str, list] | None = None, overwrite: bool = True) -> Corpus:
    """Adds ``column`` with the code of the first query that holds for a token; ``add_column`` has further values by query."""
    named = [c for c, _ in Q.labelled([queries] if isinstance(queries, str) else list(queries), codes)]
    hits = search_features(corpus, queries, codes, feature, "features", context_level)
    order = F.coalesce(*[F.when(F.col("code") == c, F.lit(k)) for k, c in enumerate(named)])
    first = hits.groupBy("doc_id", "token_id").agg(F.min(order).alias("__q"))
    new = {column: named} | (add_column or {})
    t = corpus.tokens.join(first, ["doc_id", "token_id"], "left")
    for name, values in new.items():
        value = F.coalesce(*[F.when(F.col("__q") == k, F.lit(v)) for k, v in enumerate(values)])
        if not overwrite and name in corpus.tokens.columns:
            value = F.coalesce(value, F.col(name))
        t = t.withColumn(name, value)
    return Corpus(t.drop("__q"), corpus.meta, corpus.model)


def search_recode(corpus: Corpus, feature: str, new_value: str, query: str, context_level: str = "document") -> Corpus:
    """Gives the tokens of a query's hits a new value."""
    hits = search_features(corpus, query, feature=feature, mode="features", context_level=context_level).select("doc_id", "token_id").distinct().withColumn("__hit", F.lit(True))
    t = corpus.tokens.join(hits, ["doc_id", "token_id"], "left")
    return Corpus(t.withColumn(feature, F.when(F.col("__hit"), F.lit(new_value)).otherwise(F.col(feature))).drop("__hit").select(*corpus.tokens.columns), corpus.meta, corpus.model)


def summary(hits: DataFrame) -> DataFrame:
    """code, hits, sentences, documents of feature hits; contexts have no ``hits``."""
    aggs: list[Column] = [F.count_distinct("doc_id", F.coalesce("sentence", F.lit(0))).alias("sentences"), F.count_distinct("doc_id").alias("documents")]
    if "hit_id" in hits.columns:
        aggs.insert(0, F.count_distinct("doc_id", "hit_id").alias("hits"))
    return hits.groupBy("code").agg(*aggs)
