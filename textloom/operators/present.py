"""What browsers and plots show, as DataFrames; HTML as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.corpus import Corpus


def browse(corpus: Corpus, token_col: str = "token", highlight: str | None = None, scale: str | None = None, category: str | None = None, n: int = 500, select: str = "first", seed: int = 0) -> DataFrame:
    """doc_id, html of ``n`` documents (the feature is a report of that many): the first by doc_id or drawn by a seeded hash.

    ``highlight`` (0 to 1), ``scale`` (-1 to 1) and ``category`` name token columns that colour a token.
    """
    if select not in ("first", "random"):
        raise ValueError("select is 'first' or 'random'")
    order = ["doc_id"] if select == "first" else [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    docs = corpus.meta.select("doc_id").orderBy(*order).limit(n)
    t = corpus.tokens.join(docs, "doc_id", "left_semi")
    safe = F.replace(F.replace(F.replace(F.col(token_col), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    style = F.lit(None).cast("string")
    if category is not None:
        style = F.concat(F.lit("background: hsl("), F.pmod(F.xxhash64(F.col(category).cast("string")), F.lit(360)).cast("string"), F.lit(", 80%, 85%)"))
        style = F.when(F.col(category).isNotNull(), style)
    elif scale is not None:
        style = F.when(F.col(scale).isNotNull(), F.concat(F.lit("background: rgba("), F.when(F.col(scale) < 0, F.lit("255, 0, 0")).otherwise(F.lit("0, 160, 0")), F.lit(", "), F.round(F.abs(scale), 3).cast("string"), F.lit(")")))
    elif highlight is not None:
        style = F.when(F.col(highlight).isNotNull(), F.concat(F.lit("background: rgba(255, 210, 0, "), F.round(F.col(highlight).cast("double"), 3).cast("string"), F.lit(")")))
    mark = F.when(style.isNotNull(), F.concat(F.lit('<span style="'), style, F.lit('">'), safe, F.lit("</span>"))).otherwise(safe)
    space = F.coalesce("space", F.lit("")) if "space" in t.columns else F.lit(" ")
    t = t.select("doc_id", "token_id", F.concat(mark, space).alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_id", "x"))), lambda s: s["x"]), "")
    return t.groupBy("doc_id").agg(F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("html"))


def browse_hits(corpus: Corpus, hits: DataFrame, **how) -> DataFrame:
    """The documents with a hit, its tokens coloured by code."""
    h = hits.groupBy("doc_id", "token_id").agg(F.min("code").alias("__code"))
    t = corpus.tokens.join(h, ["doc_id", "token_id"], "left")
    m = corpus.meta.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return browse(Corpus(t, m, corpus.model), category="__code", **how)


def cloud(dtm: DataFrame, n: int = 100) -> DataFrame:
    """feature, freq, size (0 to 1) of the n features of the greatest sum."""
    f = dtm.groupBy("feature").agg(F.sum("value").alias("freq")).orderBy(F.desc("freq"), "feature").limit(n)
    top = f.agg(F.max("freq").alias("top"))
    return f.crossJoin(F.broadcast(top)).select("feature", "freq", (F.sqrt("freq") / F.sqrt("top")).alias("size"))
