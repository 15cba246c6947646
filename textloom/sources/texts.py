"""Corpora from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Corpus
from textloom.functions import text as T


def from_texts(
    df: DataFrame, text_columns: str | list[str] = "text", doc_column: str = "doc_id", split_sentences: bool = False, remember_spaces: bool = False,
    max_tokens: int | None = None, max_sentences: int | None = None, words_only: bool = False, check: bool = False,
) -> Corpus:
    """Tokenizes a table with one document a row; its other columns are the metadata.

    Several text columns are one text, joined by an empty line. Without a column
    ``doc_column`` documents are numbered. Null texts are empty, texts are trimmed.
    Without sentences, spaces or limits on them, all is done in the JVM; else
    positions come from Python, in batches of a bounded number of tokens. With ``words_only`` tokens are lower-case
    words. ``remember_spaces`` adds ``space``, ``start``, ``end`` (and ``field`` if
    there are several text columns, to which start and end are then local).
    """
    columns = [text_columns] if isinstance(text_columns, str) else list(text_columns)
    doc = "doc_id"
    if doc_column not in df.columns:
        df = df.withColumn(doc, (F.monotonically_increasing_id() + 1).cast("string"))
    elif doc_column != doc:
        df = df.withColumnRenamed(doc_column, doc)
    if check and df.groupBy(doc).count().where("count > 1").limit(1).collect():
        raise ValueError("doc_id must be unique")
    meta = df.drop(*columns)
    part = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    text = F.concat_ws("\n\n", *part) if len(part) > 1 else part[0]
    source = df.select(doc, text.alias("__text"), *([F.array(*[F.char_length(p) for p in part]).alias("__long")] if len(part) > 1 else []))
    if words_only or not (split_sentences or remember_spaces or max_sentences):
        found = T.words("__text") if words_only else T.tokens("__text")
        if max_tokens:
            found = F.slice(found, 1, max_tokens)
        t = source.select(doc, F.posexplode(found).alias("token_id", "token")).withColumn("token_id", F.col("token_id") + 1)
        own = [F.col(f"`{c}`") for c in meta.columns]
        rows = df.select(*own, text.alias("__text")).select(*own, found.alias("words")) if "words" not in meta.columns and len(set(meta.columns)) == len(meta.columns) else None
        return Corpus(t, meta, "words" if words_only else "regex", (t, rows, meta) if rows is not None else None)
    t = T.split(source, "__text", split_sentences, max_tokens, max_sentences)
    keep = [doc, *(["sentence"] if split_sentences else []), "token_id", "token"]
    if remember_spaces:
        if len(part) > 1:
            # Where each field begins, as an offset: the lengths before it and the two line ends between fields.
            begins = F.transform("__long", lambda _, i: F.aggregate(F.slice("__long", 1, i), i * 2, lambda a, x: a + x))
            field = F.array_max(F.filter(F.transform(begins, lambda b, i: F.when(F.col("start") > b, i).otherwise(F.lit(-1))), lambda i: i >= 0))
            t = t.withColumn("__field", field).withColumn("__base", F.element_at(begins, F.col("__field") + 1))
            t = t.withColumns({"field": F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__field") + 1), "start": F.col("start") - F.col("__base"), "end": F.col("end") - F.col("__base")})
            keep.append("field")
        keep += ["space", "start", "end"]
    return Corpus(t.select(*keep), meta, "regex")


def untokenize(corpus: Corpus) -> DataFrame:
    """The texts again, one column for each field, with the metadata."""
    t = corpus.tokens
    space = F.coalesce("space", F.lit("")) if "space" in t.columns else F.lit(" ")
    keys = ["doc_id", *(["field"] if "field" in t.columns else [])]
    s = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("token_id", F.coalesce("token", F.lit("")).alias("token"), space.alias("space")))).alias("s"))
    joined = F.concat(F.array_join(F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: F.concat(x["token"], x["space"])), ""), F.element_at("s", -1)["token"])
    s = s.select(*keys, joined.alias("text"))
    if "field" in t.columns:
        s = s.groupBy("doc_id").pivot("field").agg(F.first("text"))
    return s.join(corpus.meta, "doc_id")


def export_spans(corpus: Corpus, variables: list[str]) -> DataFrame:
    """doc_id, variable, value, field, offset, length, text: stretches of consecutive tokens with the same value."""
    t = corpus.tokens
    field = F.col("field") if "field" in t.columns else F.lit("text")
    long = t.select("doc_id", "token_id", field.alias("field"), "token", "space", "start", "end", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value")) for v in variables])).alias("v"))
    long = long.select("*", "v.variable", "v.value").drop("v").where("value is not null")
    run = F.col("token_id") - F.row_number().over(W.partitionBy("doc_id", "variable", "value", "field").orderBy("token_id"))
    long = long.withColumn("run", run)
    s = long.groupBy("doc_id", "variable", "value", "field", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.sort_array(F.collect_list(F.struct("token_id", F.concat("token", F.coalesce("space", F.lit(""))).alias("x")))).alias("s"))
    return s.select("doc_id", "variable", "value", "field", F.col("a").alias("offset"), (F.col("b") - F.col("a") + 1).alias("length"), F.rtrim(F.array_join("s.x", "")).alias("text"))


def quotes(corpus: Corpus, marks: tuple[str, ...] = ('"', "“", "”", "„", "«", "»")) -> Corpus:
    """Adds ``in_quote``: whether the token is within quotation marks of its paragraph (an odd number of marks before it)."""
    t = corpus.tokens
    paragraph = F.sum(F.coalesce(F.lag("space").over(W.partitionBy("doc_id").orderBy("token_id")).rlike(r"\n"), F.lit(False)).cast("int")).over(W.partitionBy("doc_id").orderBy("token_id"))
    t = t.withColumn("__par", paragraph if "space" in t.columns else F.lit(0))
    mark = F.col("token").isin(*marks).cast("int")
    before = F.coalesce(F.sum(mark).over(W.partitionBy("doc_id", "__par").orderBy("token_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return Corpus(t.withColumn("in_quote", (mark == 0) & (before % 2 == 1)).drop("__par"), corpus.meta, corpus.model)
