"""Counts and aggregates over tokens, hits and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.corpus import Corpus, expr


def count(corpus: Corpus, meta_cols: list[str] | None = None, hits: DataFrame | None = None, feature: str | None = None, what: str = "documents", wide: bool = True, codes: list[str] | None = None) -> DataFrame:
    """For each group of documents N (documents), V (tokens), and the number of each code.

    ``what`` counts the documents, hits or tokens of a code, which comes from hits or
    from a token column. Wide: a column for each code (``codes`` names them, else
    they are looked up first); long: columns code and count.
    """
    if what not in ("documents", "tokens", "hits"):
        raise ValueError("what is 'documents', 'tokens' or 'hits'")
    if hits is not None and feature is not None:
        raise ValueError("codes come from hits or from a feature, not both")
    meta = corpus.meta if meta_cols else corpus.meta.withColumn("group", F.lit("total"))
    group = meta_cols or ["group"]
    meta = meta.select("doc_id", *group)
    length = corpus.tokens.groupBy("doc_id").agg(F.count("*").alias("__len"))
    d = meta.join(length, "doc_id", "left").groupBy(*group).agg(F.count("*").alias("N"), F.coalesce(F.sum("__len"), F.lit(0)).alias("V"))
    if hits is None and feature is None:
        return d
    if feature is not None:
        h = corpus.tokens.where(F.col(f"`{feature}`").isNotNull()).select("doc_id", F.col(f"`{feature}`").cast("string").alias("code"))
        keys = {"documents": ["doc_id", "code"]}.get(what)
    else:
        h = hits
        keys = {"documents": ["doc_id", "code"], "hits": [c for c in ("doc_id", "code", "hit_id", "sentence") if c in h.columns and (c != "sentence" or "hit_id" not in h.columns)]}.get(what)
    if keys:
        h = h.select(*keys).distinct()
    c = meta.join(h.select("doc_id", "code"), "doc_id").groupBy(*group, "code").agg(F.count("*").alias("count"))
    if not wide:
        keep = [d[g].eqNullSafe(c[g]) for g in group]
        return d.join(c, keep).select(*[d[g] for g in group], "N", "V", "code", "count")
    if codes is None:
        codes = sorted(r[0] for r in c.select("code").distinct().collect())
    p = c.groupBy(*group).agg(*[F.sum(F.when(F.col("code") == x, F.col("count")).otherwise(0)).alias(x) for x in codes]) if codes else c.select(*group).distinct()
    out = d.join(p, [d[g].eqNullSafe(p[g]) for g in group], "left")
    return out.select(*[d[g] for g in group], "N", "V", *[F.coalesce(p[f"`{x}`"], F.lit(0)).alias(x) for x in codes])


def aggregate(corpus: Corpus, by: list[str] | None = None, id: str | None = None, wide: bool = True, **exprs: Column | str) -> DataFrame:
    """Any aggregates over tokens, by columns of the tokens or metadata.

    With ``id`` only rows with an id count, and each id (of a document) once, for
    annotations that span several tokens.
    """
    t = corpus.tokens
    by = by or []
    extra = [c for c in by if c not in t.columns and c in corpus.meta.columns]
    missing = [c for c in by if c not in t.columns and c not in corpus.meta.columns]
    if missing:
        raise ValueError(f"columns {missing} are in neither table")
    if extra:
        t = t.join(corpus.meta.select("doc_id", *extra), "doc_id", "left")
    if id is not None:
        first = F.struct("token_id", *[F.col(f"`{c}`") for c in t.columns if c != "token_id"])
        t = t.where(F.col(id).isNotNull()).groupBy(F.col("doc_id").alias("__d"), F.col(id).alias("__i")).agg(F.min_by(first, "token_id").alias("__r")).select("__r.*")
    out = t.groupBy(*by).agg(*[expr(x).alias(k) for k, x in exprs.items()])
    if wide:
        return out
    return out.unpivot(by, list(exprs), "variable", "value")
