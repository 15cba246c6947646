"""Preprocessing of tokens to features; a feature that is filtered out is null, its row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Condition, Corpus, expr
from textloom.functions import text as T
from textloom.functions.stem import stemmer
from textloom.functions.stopwords import stopwords


def ngram(t: DataFrame, column: str, n: int, context: list[str], skip_empty: bool = True, sep: str = "/", empty: str = "") -> DataFrame:
    """Replaces a feature by the n-gram that ends at it; positions before the context are empty. Null features are no part of one.

    Rows are partitioned by context alone, so what is counted by n-gram and context after that needs no other shuffle.
    """
    t = t.repartition(*context)
    order = W.partitionBy(*context, *([F.col(f"`{column}`").isNull()] if skip_empty else [])).orderBy("token_id")
    before = [F.coalesce(F.lag(column, k).over(order), F.lit(empty)) for k in range(n - 1, 0, -1)]
    return t.withColumn(column, F.when(F.col(column).isNotNull(), F.concat_ws(sep, *before, F.col(column))))


def bounded(t: DataFrame, column: str, low: int | None, high: int | None, by: list[str] | None = None) -> DataFrame:
    """Sets values to null whose number of rows (or of distinct ``by``) is out of bounds."""
    n = F.count_distinct(*by) if by else F.count("*")
    f = t.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(n.alias("__n"))
    if low is not None:
        f = f.where(F.col("__n") >= low)
    if high is not None:
        f = f.where(F.col("__n") <= high)
    # Nulls match nothing; in the join one task would get them all.
    some = t.where(F.col(column).isNotNull()).join(f.select("__v"), F.col(column) == F.col("__v"), "left")
    return some.withColumn(column, F.col("__v")).drop("__v").unionByName(t.where(F.col(column).isNull()))


def preprocess(
    corpus: Corpus, column: str = "token", new_column: str = "feature", lowercase: bool = True, ngrams: int = 1, ngram_context: str = "document", as_ascii: bool = False,
    remove_punctuation: bool = True, remove_stopwords: bool = False, remove_numbers: bool = False, use_stemming: bool = False, language: str = "english", replace_whitespace: bool = False,
    min_freq: int | None = None, max_freq: int | None = None, min_docfreq: int | None = None, max_docfreq: int | None = None, min_char: int | None = None, max_char: int | None = None, skip_empty: bool = True,
) -> Corpus:
    """Adds a preprocessed column, in this order: case, ASCII, stopwords, signs and numbers, stems, n-grams, document frequency, frequency, length."""
    x: Column = F.col(f"`{column}`").cast("string")
    if replace_whitespace:
        x = F.translate(x, " ", "_")
    if lowercase:
        x = F.lower(x)
    if as_ascii:
        x = T.as_ascii(x)
    if remove_stopwords:
        x = F.when(~x.isin(stopwords("english" if language == "porter" else language)), x)
    x = T.keep_kind(x, remove_punctuation, remove_numbers)
    if use_stemming:
        x = stemmer(language)(x)
    t = corpus.tokens.withColumn(new_column, x)
    if ngrams > 1:
        t = ngram(t, new_column, ngrams, corpus.context(ngram_context), skip_empty)
    if min_docfreq is not None or max_docfreq is not None:
        t = bounded(t, new_column, min_docfreq, max_docfreq, corpus.context(ngram_context))
    if min_freq is not None or max_freq is not None:
        t = bounded(t, new_column, min_freq, max_freq)
    size = F.char_length(new_column)
    if min_char is not None:
        t = t.withColumn(new_column, F.when(size >= min_char, F.col(new_column)))
    if max_char is not None:
        t = t.withColumn(new_column, F.when(size <= max_char, F.col(new_column)))
    return Corpus(t, corpus.meta, corpus.model)


def feature_subset(corpus: Corpus, column: str, new_column: str, subset: Condition | None = None, inverse: bool = False, min_freq: int | None = None, max_freq: int | None = None, min_docfreq: int | None = None, max_docfreq: int | None = None, min_char: int | None = None, max_char: int | None = None) -> Corpus:
    """Adds a column with the values where a condition holds, and null elsewhere; no row goes."""
    ok = F.coalesce(expr(subset), F.lit(False)) if subset is not None else F.lit(True)
    t = corpus.tokens.withColumn(new_column, F.when(~ok if inverse else ok, F.col(f"`{column}`")))
    if min_docfreq is not None or max_docfreq is not None:
        t = bounded(t, new_column, min_docfreq, max_docfreq, ["doc_id"])
    if min_freq is not None or max_freq is not None:
        t = bounded(t, new_column, min_freq, max_freq)
    if min_char is not None:
        t = t.withColumn(new_column, F.when(F.char_length(new_column) >= min_char, F.col(new_column)))
    if max_char is not None:
        t = t.withColumn(new_column, F.when(F.char_length(new_column) <= max_char, F.col(new_column)))
    return Corpus(t, corpus.meta, corpus.model)
