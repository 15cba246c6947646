"""Similarity of documents over their features, and removal of duplicates by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import BROADCAST_WORDS, Condition, Corpus, expr
from textloom.functions.store import written
from textloom.operators import dtm as D


def compare_documents(
    corpus: Corpus, feature: str = "token", date_col: str | None = None, meta_cols: list[str] | None = None, hour_window: float | tuple[float, float] = 24, measure: str = "cosine",
    min_similarity: float = 0.0, weight: str = "norm_tfidf", ngrams: int = 1, from_subset: Condition | None = None, to_subset: Condition | None = None,
) -> DataFrame:
    """src, dst, weight (and hourdiff) of the pairs of documents of at least ``min_similarity`` that share a feature.

    Pairs agree in ``meta_cols``; with ``date_col``, dst is within ``hour_window``
    hours of src. Cosine pairs are given once (src < dst) unless subsets or dates
    give them a direction; ``overlap_pct`` is the share of src's weight that lies on
    features of dst, and has both directions.

    The features are an inverted index that is joined with itself, with the group
    as a key of the join, so only documents that share a feature meet. With a
    ``min_similarity`` only pairs that share a feature of src's prefix meet: its
    rarest features, without as many of the frequent ones as couldn't reach
    ``min_similarity`` alone. That leaves out no pair (for cosine the shared feature
    is in dst's prefix too, as both have one order).
    """
    if measure not in ("cosine", "overlap_pct"):
        raise ValueError("measure is 'cosine' or 'overlap_pct'")
    m = D.dtm(corpus, feature, weight=weight, ngrams=ngrams).where("value <> 0")
    keys = meta_cols or []
    extra = [*keys, *([date_col] if date_col else [])]
    m = m.join(corpus.meta.select("doc_id", *extra), "doc_id") if extra else m
    norm = m.groupBy("doc_id").agg((F.sqrt(F.sum(F.col("value") ** 2)) if measure == "cosine" else F.sum("value")).alias("norm"))

    def side(condition: Condition | None, doc: str, value: str, date: str) -> DataFrame:
        s = m if condition is None else m.join(corpus.meta.where(expr(condition)).select("doc_id"), "doc_id", "left_semi")
        return s.select(F.col("doc_id").alias(doc), "feature", F.col("value").alias(value), *keys, *([F.col(date_col).alias(date)] if date_col else []))

    x, y = side(from_subset, "src", "vx", "tx"), side(to_subset, "dst", "vy", "ty")
    directed = measure == "overlap_pct" or from_subset is not None or to_subset is not None or date_col is not None
    if min_similarity > 0 and not _few_meetings(m):
        head = _prefixes(m, measure, min_similarity)
        a = x.join(head.withColumnRenamed("doc_id", "src"), ["src", "feature"], "left_semi").select("src", "feature", *keys)
        b = (y.join(head.withColumnRenamed("doc_id", "dst"), ["dst", "feature"], "left_semi") if measure == "cosine" else y).select("dst", "feature", *keys)
        pairs = a.join(b, ["feature", *keys]).where("src <> dst" if directed else "src < dst").select("src", "dst").distinct()
        if measure == "cosine":
            pairs = _promising(pairs, m, norm, min_similarity)
        p = pairs.join(x, "src").join(y.drop(*keys), ["dst", "feature"])
    else:
        p = x.join(y, ["feature", *keys]).where("src <> dst" if directed else "src < dst")
    by = ["src", "dst"]
    if date_col:
        low, high = hour_window if isinstance(hour_window, tuple) else (-hour_window, hour_window)
        p = p.withColumn("hourdiff", (F.col("ty").cast("timestamp").cast("double") - F.col("tx").cast("timestamp").cast("double")) / 3600)
        p = p.where((F.col("hourdiff") >= low) & (F.col("hourdiff") <= high))
        by.append("hourdiff")
    part = F.sum(F.col("vx") * F.col("vy")) if measure == "cosine" else F.sum("vx")
    p = p.groupBy(*by).agg(part.alias("part"))
    nx = norm.select(F.col("doc_id").alias("src"), F.col("norm").alias("nx"))
    p = p.join(nx, "src")
    if measure == "cosine":
        p = p.join(norm.select(F.col("doc_id").alias("dst"), F.col("norm").alias("ny")), "dst")
        p = p.withColumn("weight", F.col("part") / (F.col("nx") * F.col("ny")))
    else:
        p = p.withColumn("weight", F.col("part") / F.col("nx"))
    return p.where(F.col("weight") >= min_similarity).select("src", "dst", "weight", *(["hourdiff"] if date_col else []))


def _few_meetings(m: DataFrame, times: int = 10) -> bool:
    """Whether all documents that share a feature are few enough to meet: then prefixes would cost more than they leave out."""
    df = m.groupBy("feature").agg(F.count("*").alias("n"))
    r = df.agg(F.sum(F.col("n").cast("double") ** 2), F.sum("n")).first()
    return (r[0] or 0) <= times * (r[1] or 0)


def _promising(pairs: DataFrame, m: DataFrame, norm: DataFrame, least: float) -> DataFrame:
    """The pairs that may reach ``least`` by what they share of a longer prefix, so that only those meet with all their features.

    A pair has no other common features up to where the first of the two prefixes ends, and beyond that no more
    similarity than the norm of the rest of that document, so than the greater of both rests.
    """
    head = _prefixes(m, "cosine", min(least, 0.7)).join(m, ["doc_id", "feature"]).join(norm, "doc_id").select("doc_id", "feature", (F.col("value") / F.col("norm")).alias("v"))
    rest = head.groupBy("doc_id").agg(F.sqrt(F.greatest(1 - F.sum(F.col("v") ** 2), F.lit(0.0))).alias("rest"))
    x, y = head.withColumnsRenamed({"doc_id": "src", "v": "vx"}), head.withColumnsRenamed({"doc_id": "dst", "v": "vy"})
    p = pairs.join(x, "src").join(y, ["dst", "feature"]).groupBy("src", "dst").agg(F.sum(F.col("vx") * F.col("vy")).alias("part"))
    p = p.join(rest.withColumnsRenamed({"doc_id": "src", "rest": "rx"}), "src").join(rest.withColumnsRenamed({"doc_id": "dst", "rest": "ry"}), "dst")
    return p.where(F.col("part") + F.greatest("rx", "ry") >= least - 1e-9).select("src", "dst")


def _prefixes(m: DataFrame, measure: str, least: float) -> DataFrame:
    """doc_id, feature of each document's rarest features, without the frequent ones that weigh less than ``least`` in all."""
    size = F.col("value") ** 2 if measure == "cosine" else F.col("value")
    df = m.groupBy("feature").agg(F.count("*").alias("__df"))
    by = W.partitionBy("doc_id").orderBy(F.desc("__df"), F.desc("feature")).rowsBetween(W.unboundedPreceding, 0)
    s = m.join(df, "feature").select("doc_id", "feature", F.sum(size).over(by).alias("__rest"), F.sum(size).over(W.partitionBy("doc_id")).alias("__all"))
    share = least**2 if measure == "cosine" else least
    return s.where(F.col("__rest") >= F.lit(share * (1 - 1e-9)) * F.col("__all")).select("doc_id", "feature")


def duplicates(
    corpus: Corpus, feature: str = "token", date_col: str | None = None, meta_cols: list[str] | None = None, hour_window: float = 24, min_docfreq: int = 2, max_docfreq_pct: float = 1.0,
    lowercase: bool = True, similarity: float = 1.0, keep: str = "first", weight: str = "norm_tfidf", measure: str = "cosine", ngrams: int = 1,
) -> DataFrame:
    """doc_id of the documents to remove.

    With dates, of each similar pair the later one goes (``keep`` first) or the
    earlier (last); without, or at the same time, the one with the greater doc_id
    (``first``), the lesser (``last``), or the greater hash (``random``).
    """
    if keep not in ("first", "last", "random"):
        raise ValueError("keep is 'first', 'last' or 'random'")
    plain = corpus.model == "words" and corpus.is_plain and keep != "random" and measure == "cosine" and weight in ("tfidf", "norm_tfidf") and ngrams == 1 and similarity > 0
    if plain and not date_col and not meta_cols and (d := corpus.words(feature)) is not None:
        return _duplicates_by_class(corpus, d, min_docfreq, max_docfreq_pct, similarity, keep)
    t = corpus.tokens.withColumn("__f", F.lower(feature) if lowercase else F.col(feature))
    df = t.where("__f is not null").groupBy("__f").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_docfreq)
    if max_docfreq_pct < 1:
        # The bound is a cell of one row, so it is broadcast.
        top = corpus.meta.agg((F.count("*") * max_docfreq_pct).alias("top"))
        df = df.crossJoin(F.broadcast(top)).where("n <= top")
    c = Corpus(t.join(df.select("__f"), "__f", "left_semi"), corpus.meta, corpus.model)
    # Similarities are sums of products; a copy's may fall short of 1 by rounding.
    p = compare_documents(c, "__f", date_col, meta_cols, hour_window, measure, similarity - 1e-9, weight, ngrams)
    first = F.least("src", "dst")
    last = F.greatest("src", "dst")
    tie = {"first": last, "last": first}.get(keep)
    if tie is None:
        tie = F.when(F.xxhash64("src", first) >= F.xxhash64("dst", first), F.col("src")).otherwise(F.col("dst"))
    if date_col:
        later = F.when(F.col("hourdiff") > 0, F.col("dst")).when(F.col("hourdiff") < 0, F.col("src"))
        earlier = F.when(F.col("hourdiff") > 0, F.col("src")).when(F.col("hourdiff") < 0, F.col("dst"))
        tie = F.coalesce({"first": later, "last": earlier}.get(keep, F.lit(None)), tie)
    return p.select(tie.alias("doc_id")).distinct()


def _duplicates_by_class(corpus: Corpus, d: DataFrame, min_docfreq: int, max_docfreq_pct: float, similarity: float, keep: str) -> DataFrame:
    """``duplicates`` by cosine of rows of lower-case words. Texts of the same words are a class, of which one document stays, and only those are compared.

    That is all of them, as the documents of a class are equally similar to others. A class without a word in the
    bounds has no similarity and keeps its documents. The documents' words are shuffled once by word and once by
    document, and are then a row of each document, from which prefixes and vectors are read.
    """
    cls = written(d.where(F.size("words") > 0).select("doc_id", F.sha2(F.array_join(F.sort_array("words"), " "), 256).alias("c")), "classes")
    many = cls.groupBy("c").agg((F.min if keep == "first" else F.max)("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = written(cls.join(many, "c").where("doc_id <> rep").select("doc_id", "rep", "copies"), "copies")
    few = F.broadcast if copies.count() <= BROADCAST_WORDS else (lambda x: x)
    m = Corpus.count_rows(d.join(few(copies.select("doc_id")), "doc_id", "left_anti"))
    m = m.join(few(copies.select(F.col("rep").alias("doc_id"), "copies").distinct()), "doc_id", "left").select("doc_id", "feature", F.col("n").cast("int").alias("n"), F.coalesce("copies", F.lit(1)).alias("copies"))
    df = m.groupBy("feature").agg(F.sum("copies").alias("df")).where(F.col("df") >= min_docfreq)
    if max_docfreq_pct < 1:
        df = df.crossJoin(F.broadcast(corpus.meta.agg((F.count("*") * max_docfreq_pct).alias("top")))).where("df <= top")
    m = m.join(df.select("feature", F.col("df").cast("int").alias("df")), "feature").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "feature", "n")), False).alias("own"), F.first("copies").alias("copies"))
    m = written(m, "vectors")
    # The most frequent words come first; a prefix is what is left after those that weigh too little alone.
    v = m.crossJoin(F.broadcast(m.agg(F.sum("copies").cast("double").alias("contexts"))))
    v = v.select("doc_id", F.filter(F.transform("own", lambda x: F.struct(x["feature"].alias("feature"), (x["n"] * F.log2(F.col("contexts") / x["df"])).alias("v"))), lambda x: x["v"] != 0).alias("own"))
    v = v.where(F.size("own") > 0).select("doc_id", "own", F.aggregate("own", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]).alias("all"))
    least = similarity - 1e-9

    def prefix(share: float) -> DataFrame:
        # The bound is in the state: within the function it could be made anew for each word.
        start = F.struct(F.lit(0.0).alias("rest"), F.lit(0).alias("k"), F.lit(0.0).alias("cut"), (F.lit(share * (1 - 1e-9)) * F.col("all")).alias("bound"))

        def step(a, x):
            rest = a["rest"] + x["v"] * x["v"]
            out = rest < a["bound"]
            return F.struct(rest.alias("rest"), (a["k"] + out.cast("int")).alias("k"), F.when(out, rest).otherwise(a["cut"]).alias("cut"), a["bound"].alias("bound"))

        p = v.select("doc_id", "own", "all", F.aggregate("own", start, step).alias("a"))
        values = F.transform("own", lambda x: x["v"])
        p = p.select("doc_id", "own", "a", F.col("a.cut").alias("cut"), "all", F.sqrt("all").alias("norm"), F.array_max(values).alias("most"), F.aggregate(values, F.lit(0.0), lambda s, x: s + x).alias("values"))
        return p.select("doc_id", F.sqrt(F.col("cut") / F.col("all")).alias("rest"), "norm", (F.col("most") / F.col("norm")).alias("top"), (F.col("values") / F.col("norm")).alias("sum"), F.inline(F.slice("own", F.col("a.k") + 1, F.size("own"))))

    # A pair is at most as similar as the one's greatest value times the other's sum, so long and short texts don't meet.
    head = prefix(min(least**2, 0.75)).select("doc_id", "feature", (F.col("v") / F.col("norm")).alias("v"), "rest", "top", "sum")
    x, y = (head.select(F.col("doc_id").alias(doc), "feature", *[F.col(c).alias(f"{c}_{doc}") for c in ("v", "rest", "top", "sum")]) for doc in ("src", "dst"))
    pairs = x.join(y, "feature").where("src < dst").where(F.least(F.col("top_src") * F.col("sum_dst"), F.col("top_dst") * F.col("sum_src")) >= least - 1e-9)
    # Beyond the first end of two prefixes a pair has no more similarity than the norm of that document's rest.
    pairs = pairs.groupBy("src", "dst").agg(F.sum(F.col("v_src") * F.col("v_dst")).alias("part"), F.first(F.greatest("rest_src", "rest_dst")).alias("rest"))
    pairs = written(pairs.where(F.col("part") + F.col("rest") >= least - 1e-9).select("src", "dst"), "pairs")
    # Both vectors come to the pair as rows; their words meet within the task, without another shuffle.
    both = pairs.join(v.select(F.col("doc_id").alias("src"), F.col("own").alias("x"), F.col("all").alias("ax")), "src").join(v.select(F.col("doc_id").alias("dst"), F.col("own").alias("y"), F.col("all").alias("ay")), "dst")
    zero = F.lit(0.0)
    own = F.concat(F.transform("x", lambda h: F.struct(h["feature"].alias("f"), h["v"].alias("vx"), zero.alias("vy"))), F.transform("y", lambda h: F.struct(h["feature"].alias("f"), zero.alias("vx"), h["v"].alias("vy"))))
    p = both.select("src", "dst", F.sqrt(F.col("ax") * F.col("ay")).alias("norms"), F.inline(own)).groupBy("dst", "src", "norms", "f").agg(F.sum("vx").alias("vx"), F.sum("vy").alias("vy"))
    p = p.groupBy("dst", "src", "norms").agg(F.sum(F.col("vx") * F.col("vy")).alias("s")).where(F.col("s") >= least * F.col("norms"))
    gone = p.select((F.greatest if keep == "first" else F.least)("src", "dst").alias("doc_id"))
    return gone.unionByName(copies.join(v.select(F.col("doc_id").alias("rep")), "rep", "left_semi").select("doc_id")).distinct()


def deduplicate(corpus: Corpus, feature: str = "token", **how) -> Corpus:
    """The corpus without ``duplicates``."""
    gone = duplicates(corpus, feature, **how)
    return Corpus(corpus.tokens.join(gone, "doc_id", "left_anti"), corpus.meta.join(gone, "doc_id", "left_anti"), corpus.model)
