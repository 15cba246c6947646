"""Keywords in context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Corpus
from textloom.operators import search


def tightened(text: Column) -> Column:
    """Without the blanks before closing signs and after opening ones."""
    text = F.regexp_replace(text, r"\s+([.,:;!?)\]}])", "$1")
    return F.regexp_replace(text, r"([(\[{])\s+", "$1")


def kwic(corpus: Corpus, hits: DataFrame | None = None, query: str | list[str] | None = None, codes: list[str] | None = None, ntokens: int = 10, n: int | None = None, nsample: int | None = None, output_feature: str = "token", query_feature: str = "token", tags: tuple[str, str] = ("<", ">"), seed: int = 0, **how) -> DataFrame:
    """doc_id, code, hit_id, feature, kwic: the tokens within ``ntokens`` of each hit's tokens, and [...] where they aren't adjacent.

    ``n`` gives the first hits by document and position, ``nsample`` as many drawn by a seeded hash.
    """
    if hits is None:
        hits = search.search_features(corpus, query, codes=codes, feature=query_feature, **how)
    key = ["code", "doc_id", "hit_id"]
    if n is not None or nsample is not None:
        some = hits.groupBy(*key).agg(F.min("token_id").alias("__at"))
        order = [F.xxhash64(F.lit(seed), *key)] if nsample is not None else ["doc_id", "__at", "code", "hit_id"]
        hits = hits.join(some.orderBy(*order).limit(nsample if nsample is not None else n).select(*key), key, "left_semi")
    h = hits.select(*key, "token_id", F.col("feature").alias("__f"))
    label = h.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_id", "__f"))), lambda x: x["__f"]), " -> ").alias("feature"))
    spots = h.select(*key, F.col("token_id").alias("__k"), F.explode(F.sequence(F.col("token_id") - ntokens, F.col("token_id") + ntokens)).alias("token_id"))
    spots = spots.groupBy(*key, "token_id").agg(F.max((F.col("__k") == F.col("token_id")).cast("int")).alias("__kw"))
    w = corpus.tokens_at(spots, output_feature, "__t").where("__t is not null").withColumn("__t", F.col("__t").cast("string"))
    text = F.when(F.col("__kw") == 1, F.concat(F.lit(tags[0]), "__t", F.lit(tags[1]))).otherwise(F.col("__t"))
    gap = F.col("token_id") - F.lag("token_id").over(W.partitionBy(*key).orderBy("token_id")) > 1
    w = w.withColumn("__t", F.when(gap, F.concat(F.lit("[...] "), text)).otherwise(text))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_id", "__t"))), lambda x: x["__t"]), " ")
    w = w.groupBy(*key).agg(F.concat(F.lit("..."), tightened(joined), F.lit("...")).alias("kwic"))
    return w.join(label, key).select("doc_id", "code", "hit_id", "feature", "kwic")
