"""Comparison of vocabularies, and words that go with a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.corpus import Condition, Corpus
from textloom.functions.stats import chi2
from textloom.operators import search


def _freq(corpus: Corpus, feature: str, what: str) -> DataFrame:
    t = corpus.tokens.where(F.col(f"`{feature}`").isNotNull()).select("doc_id", F.col(f"`{feature}`").cast("string").alias("feature"))
    if what == "freq":
        return t.groupBy("feature").agg(F.count("*").alias("freq"))
    once = t.distinct()
    if what == "docfreq":
        return once.groupBy("feature").agg(F.count("*").alias("freq"))
    other = once.select("doc_id", F.col("feature").alias("other"))
    pairs = once.join(other, "doc_id").where("feature <> other")
    return pairs.groupBy(F.concat_ws(" & ", "feature", "other").alias("feature")).agg(F.count("*").alias("freq"))


def _compared(f: DataFrame, rows_x: DataFrame, rows_y: DataFrame, smooth: float, yates: str | bool, what: str, min_ratio: float | None, min_chi2: float | None) -> DataFrame:
    f = f.withColumn("freq", F.col("freq_x") + F.col("freq_y")).where("freq > 0")
    total = f.agg(F.sum("freq_x").alias("sx"), F.sum("freq_y").alias("sy"), F.count("*").alias("rows"))
    f = f.crossJoin(F.broadcast(total))
    if what != "freq":
        f = f.crossJoin(F.broadcast(rows_x)).crossJoin(F.broadcast(rows_y))
    if what == "freq":
        base = lambda s: F.col(s) + F.col("rows") * smooth
        px, py, notx, noty = (F.col("freq_x") + smooth) / base("sx"), (F.col("freq_y") + smooth) / base("sy"), F.col("sx") - F.col("freq_x"), F.col("sy") - F.col("freq_y")
    else:
        px, py, notx, noty = (F.col("freq_x") + smooth) / (F.col("nx") + smooth), (F.col("freq_y") + smooth) / (F.col("ny") + smooth), F.col("nx"), F.col("ny")
    ratio = F.when(py != 0, px / py).otherwise(F.when(px > 0, F.lit(float("inf"))))
    out = f.select("feature", "freq_x", "freq_y", "freq", px.alias("p_x"), py.alias("p_y"), ratio.alias("ratio"), chi2(F.col("freq_x"), F.col("freq_y"), notx, noty, yates).alias("chi2"))
    if min_ratio is not None:
        out = out.where(F.col("ratio") > min_ratio)
    if min_chi2 is not None:
        out = out.where(F.col("chi2") > min_chi2)
    return out


def _documents(corpus: Corpus, name: str) -> DataFrame:
    return corpus.tokens.agg(F.count_distinct("doc_id").alias(name))


def compare_corpus(x: Corpus, y: Corpus, feature: str = "token", smooth: float = 0.1, min_ratio: float | None = None, min_chi2: float | None = None, is_subset: bool = False, yates: str | bool = "auto", what: str = "freq") -> DataFrame:
    """feature, freq_x, freq_y, freq, p_x, p_y, ratio, chi2: how the vocabularies of two corpora differ.

    ``is_subset``: x is part of y, and is taken out of it. ``what`` is freq, docfreq
    or cooccurrence (pairs of features by documents).
    """
    fx, fy = _freq(x, feature, what).withColumnRenamed("freq", "fx"), _freq(y, feature, what).withColumnRenamed("freq", "fy")
    f = fx.join(fy, "feature", "full_outer").select("feature", F.coalesce("fx", F.lit(0)).alias("freq_x"), F.coalesce("fy", F.lit(0)).alias("freq_y"))
    nx, ny = _documents(x, "nx"), _documents(y, "ny")
    if is_subset:
        f = f.withColumn("freq_y", F.col("freq_y") - F.col("freq_x"))
        ny = ny.crossJoin(nx).select((F.col("ny") - F.col("nx")).alias("ny"))
    return _compared(f, nx, ny, smooth, yates, what, min_ratio, min_chi2)


def compare_subset(corpus: Corpus, feature: str = "token", subset_x: Condition | None = None, subset_meta_x: Condition | None = None, query_x: str | None = None, query_feature: str = "token", smooth: float = 0.1, min_ratio: float | None = None, min_chi2: float | None = None, yates: str | bool = "auto", what: str = "freq") -> DataFrame:
    """``compare_corpus`` of a subset, by condition or query, with the rest."""
    x = corpus.subset(subset_x, subset_meta_x) if subset_x is not None or subset_meta_x is not None else corpus
    if query_x is not None:
        x = search.subset_query(x, query_x, feature=query_feature)
    return compare_corpus(x, corpus, feature, smooth, min_ratio, min_chi2, True, yates, what)


def feature_associations(corpus: Corpus, query: str | None = None, hits: DataFrame | None = None, feature: str = "token", query_feature: str = "token", window: int = 15, n: int = 25, min_freq: int = 1, sort_by: str = "chi2", subset: Condition | None = None, subset_meta: Condition | None = None, include_self: bool = False) -> DataFrame:
    """feature, freq, freq_not, ratio, chi2 of the n words most typical of the ``window`` around hits, compared with the rest."""
    if (query is None) == (hits is None):
        raise ValueError("either a query or hits")
    if hits is None:
        hits = search.search_features(corpus, query, feature=query_feature, mode="features")
    places = hits.select("doc_id", "token_id").distinct().withColumn("__hit", F.lit(True))
    t = corpus.tokens
    if subset is not None or subset_meta is not None:
        ok = corpus.flagged(subset, subset_meta)
        places = places.join(ok, ["doc_id", "token_id"], "left_semi")
    inside = corpus.around(places, window, feature)
    if inside is not None:
        near = Corpus(inside, corpus.meta, corpus.model)
    else:
        marked = Corpus(t.join(places, ["doc_id", "token_id"], "left"), corpus.meta, corpus.model)
        near = marked.subset("coalesce(__hit, false)", window=window)
    out = compare_corpus(near, corpus, feature, is_subset=True).where(F.col("freq_x") > min_freq)
    if not include_self:
        own = corpus.tokens_at(places.drop("__hit"), feature).select(F.col("feature").cast("string").alias("feature")).distinct()
        out = out.join(own, "feature", "left_anti")
    out = out.select("feature", F.col("freq_x").alias("freq"), F.col("freq_y").alias("freq_not"), "ratio", "chi2")
    return out.orderBy(F.desc(sort_by), "feature").limit(n)


def plot_data(comparison: DataFrame, n: int = 200, mode: str = "both") -> DataFrame:
    """The rows that a plot of a comparison shows: the n of highest chi-square, ``both`` halves over- and underused."""
    over = comparison.where("ratio >= 1").orderBy(F.desc("chi2"), "feature")
    under = comparison.where("ratio < 1").orderBy(F.desc("chi2"), "feature")
    if mode == "ratio_x":
        return over.limit(n)
    if mode == "ratio_y":
        return under.limit(n)
    return over.limit(n // 2).unionByName(under.limit(n // 2))
