"""Marking n-grams on their tokens, and tf-idf as a token column."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.corpus import Corpus
from textloom.operators import dtm


def tag_ngrams(corpus: Corpus, column: str, ngrams: int | str, new_column: str | None = None, priority: str = "long") -> Corpus:
    """Spreads the value at an n-gram's last token over all its tokens.

    ``ngrams`` is the length, or the column that has it; rows without value or length
    tag nothing. A token in several n-grams gets the value of the longest, the shortest
    or the first (that ends earliest); with one length always that of the first. Tokens
    in none keep their value.
    """
    if priority not in ("long", "short", "first"):
        raise ValueError("priority is 'long', 'short' or 'first'")
    size = F.lit(ngrams) if isinstance(ngrams, int) else F.col(f"`{ngrams}`").cast("int")
    rank = {"long": -F.col("n"), "short": F.col("n"), "first": F.lit(0)}[priority]
    tags = corpus.tokens.select("doc_id", F.col("token_id").alias("last"), F.col(f"`{column}`").alias("value"), size.alias("n")).where("value is not null and n >= 1")
    spread = tags.withColumn("token_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("last") - F.col("n") + 1), F.col("last"))))
    best = spread.groupBy("doc_id", "token_id").agg(F.min_by("value", F.struct(rank, F.col("last"))).alias("__tag"))
    t = corpus.tokens.join(best, ["doc_id", "token_id"], "left").withColumn(new_column or column, F.coalesce("__tag", F.col(f"`{column}`"))).drop("__tag")
    return Corpus(t, corpus.meta, corpus.model)


def add_tfidf(corpus: Corpus, feature: str = "feature", column: str = "tfidf") -> Corpus:
    """Adds to each token the tf-idf of its feature in its document, by shares; tokens without a feature go."""
    m = corpus.counted(feature, positions=True) if corpus.is_plain else None
    if m is not None:  # a word goes to its idf with its positions, and the tokens come from those
        inverse = dtm.idf(corpus.counted(feature), dtm.number_of_contexts(corpus, ["doc_id"]))
        t = m.join(inverse, "feature").select("doc_id", F.explode("where").alias("token_id"), F.col("feature").alias(feature), (F.col("n").cast("double") / F.col("total") * F.col("idf")).alias(column))
        return Corpus(t, corpus.meta, corpus.model)
    m = dtm.dtm(corpus, feature, weight="norm_tfidf").select("doc_id", F.col("feature").alias(feature), F.col("value").alias(column))
    return Corpus(corpus.tokens.join(m, ["doc_id", feature]).select(*corpus.tokens.columns, column), corpus.meta, corpus.model)
