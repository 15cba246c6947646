"""Document-term matrices as long tables, their weights, and statistics of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Condition, Corpus
from textloom.functions.stats import chi2
from textloom.operators import preprocessing

WEIGHTS = ("norm_tfidf", "tfidf", "docfreq", "termfreq")


def counts(t: DataFrame, feature: str, context: list[str]) -> DataFrame:
    """The context columns, feature, n."""
    return t.where(F.col(f"`{feature}`").isNotNull()).groupBy(*context, F.col(f"`{feature}`").alias("feature")).agg(F.count("*").alias("n"))


def counts_of(corpus: Corpus, feature: str, context_level: str) -> DataFrame:
    """``counts`` of a corpus; from the rows of the texts, if there are such, with ``total`` (their words) and without a shuffle."""
    m = corpus.counted(feature, context_level)
    return counts(corpus.tokens, feature, corpus.context(context_level)) if m is None else m


def dtm(corpus: Corpus, feature: str = "token", context_level: str = "document", weight: str = "termfreq", subset_tokens: Condition | None = None, subset_meta: Condition | None = None, ngrams: int = 1, ngram_before_subset: bool = False) -> DataFrame:
    """The context columns, feature, value.

    With a subset, inverse document frequencies are those of the whole corpus.
    """
    if weight not in WEIGHTS:
        raise ValueError(f"weight is one of {WEIGHTS}")
    context = corpus.context(context_level)
    whole = corpus
    if ngrams > 1 and (ngram_before_subset or (subset_tokens is None and subset_meta is None)):
        whole = Corpus(preprocessing.ngram(corpus.tokens, feature, ngrams, context), corpus.meta, corpus.model)
    part = whole
    if subset_tokens is not None or subset_meta is not None:
        part = whole.subset(subset_tokens, subset_meta)
        if ngrams > 1 and not ngram_before_subset:
            part = Corpus(preprocessing.ngram(part.tokens, feature, ngrams, context), part.meta, part.model)
            whole = Corpus(preprocessing.ngram(corpus.tokens, feature, ngrams, context), corpus.meta, corpus.model)
    m = counts_of(part, feature, context_level)
    n = F.col("n").cast("double")
    if weight == "termfreq":
        return m.select(*context, "feature", n.alias("value"))
    if weight == "docfreq":
        return m.select(*context, "feature", F.lit(1.0).alias("value"))
    return weighted(m, context, weight, idf(counts_of(whole, feature, context_level) if part is not whole else m, number_of_contexts(whole, context)))


def number_of_contexts(corpus: Corpus, context: list[str]) -> DataFrame:
    """One row: the number of contexts, those without a feature too."""
    d = corpus.words() if context == ["doc_id"] else None
    if d is not None:
        return d.where(F.size("words") > 0).agg(F.count("*").cast("double").alias("contexts"))
    return corpus.tokens.agg(F.count_distinct(*context).cast("double").alias("contexts"))


def idf(m: DataFrame, contexts: DataFrame) -> DataFrame:
    """feature, idf: log2 of contexts over contexts with the feature."""
    df = m.groupBy("feature").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(contexts)).select("feature", F.log2(F.col("contexts") / F.col("df")).alias("idf"))


def weighted(m: DataFrame, context: list[str], weight: str, inverse: DataFrame) -> DataFrame:
    tf = F.col("n").cast("double")
    if weight == "norm_tfidf":
        m = m.withColumn("__row", F.col("total") if "total" in m.columns else F.sum("n").over(W.partitionBy(*context)))
        tf = tf / F.col("__row")
    return m.join(inverse, "feature").select(*context, "feature", (tf * F.col("idf")).alias("value"))


def summed(corpus: Corpus, feature: str = "token", context_level: str = "document") -> DataFrame:
    """feature, value: tf-idf summed over the contexts. As the idf is one for all of them, counts are summed first and no row of the matrix is shuffled."""
    context = corpus.context(context_level)
    s = counts_of(corpus, feature, context_level).groupBy("feature").agg(F.sum("n").cast("double").alias("n"), F.count("*").alias("df"))
    s = s.crossJoin(F.broadcast(number_of_contexts(corpus, context)))
    return s.select("feature", (F.col("n") * F.log2(F.col("contexts") / F.col("df"))).alias("value"))


def wide(m: DataFrame, features: list[str], context: list[str] | None = None) -> DataFrame:
    """One column for each of the named features."""
    context = context or [c for c in m.columns if c not in ("feature", "value")]
    return m.where(F.col("feature").isin(features)).groupBy(*context).pivot("feature", features).agg(F.first("value")).fillna(0.0, features)


def feature_stats(corpus: Corpus, feature: str = "token", context_level: str = "document") -> DataFrame:
    """term, characters, number, nonalpha, termfreq, docfreq, reldocfreq, tfidf of each value of a feature."""
    context = corpus.context(context_level)
    m = counts_of(corpus, feature, context_level)
    if "total" in m.columns:
        m, rows = m.withColumn("share", F.col("n") / F.col("total")), number_of_contexts(corpus, context).select(F.col("contexts").cast("long").alias("rows"))
    else:
        m = m.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*context)))
        rows = m.agg(F.count_distinct(*context).alias("rows"))
    s = m.groupBy("feature").agg(F.sum("n").alias("termfreq"), F.count("*").alias("docfreq"), F.avg("share").alias("share"))
    s = s.crossJoin(F.broadcast(rows))
    return s.select(
        F.col("feature").alias("term"), F.char_length("feature").cast("int").alias("characters"), F.col("feature").rlike("[0-9]").alias("number"), F.col("feature").rlike(r"[^\p{L}\p{N}_]").alias("nonalpha"),
        "termfreq", "docfreq", (F.col("docfreq") / F.col("rows")).alias("reldocfreq"), (F.col("share") * F.log2(F.col("rows") / F.col("docfreq"))).alias("tfidf"),
    )


def top_features(corpus: Corpus, feature: str = "token", n: int = 10, group_by: list[str] | None = None, group_by_meta: list[str] | None = None, rank_by: str = "freq", drop_null: bool = True, long: bool = False) -> DataFrame:
    """The n most frequent (or by signed chi-square most typical) values in each group; ties by value.

    Wide: the group's columns and r1 to r<n>; long: one row for each.
    """
    group = [*(group_by or []), *(group_by_meta or [])]
    t = corpus.tokens.select("doc_id", F.col(f"`{feature}`").alias("feature"), *(group_by or []))
    if group_by_meta:
        t = t.join(corpus.meta.select("doc_id", *group_by_meta), "doc_id", "left")
    if not group:
        t, group = t.withColumn("total", F.lit("total")), ["total"]
    f = t.groupBy(*group, "feature").agg(F.count("*").alias("freq"))
    score = F.col("freq").cast("double")
    if rank_by == "chi2":
        f = f.withColumns({"__f": F.sum("freq").over(W.partitionBy("feature")), "__g": F.sum("freq").over(W.partitionBy(*group))})
        f = f.crossJoin(F.broadcast(t.agg(F.count("*").alias("__n"))))
        a, b, c, d = F.col("freq"), F.col("__f") - F.col("freq"), F.col("__g") - F.col("freq"), F.col("__n") - F.col("__g")
        ratio = F.when(d == 0, F.lit(1.0)).when(c == 0, F.lit(0.0)).when(b == 0, F.lit(float("inf"))).otherwise((a / c) / (b / d))
        ratio = F.when(c == 0, F.lit(0.0)).otherwise(ratio)
        score = chi2(a, b, c, d, True) * F.when(ratio < 1, -1).otherwise(1)
    elif rank_by != "freq":
        raise ValueError("rank_by is 'freq' or 'chi2'")
    if drop_null:
        f = f.where(F.col("feature").isNotNull())
    f = f.withColumn("score", score)
    f = f.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), F.asc("feature")))).where(F.col("rank") <= n)
    if long:
        return f.select(*group, "rank", "feature", "freq", "score")
    names = [f"r{k}" for k in range(1, n + 1)]
    out = f.groupBy(*group).agg(*[F.max(F.when(F.col("rank") == k, F.col("feature"))).alias(c) for k, c in enumerate(names, 1)])
    return out
