"""Corpora from tables of tokens; unions of corpora; Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Corpus


def local_ids(tokens: DataFrame, sentence_is_local: bool = True, token_is_local: bool = True) -> DataFrame:
    """Numbers sentences and tokens from 1 within each document, running over sentences; parents follow."""
    has = "sentence" in tokens.columns
    order = [*(["sentence"] if has else []), "token_id"]
    # With ids that begin anew in each sentence, a parent is one of its own sentence.
    unit = ["doc_id", *(["sentence"] if has and token_is_local else [])]
    new = tokens.withColumn("__new", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    if "parent" in tokens.columns:
        ids = new.select(*[F.col(c).alias(f"__{c}") for c in unit], F.col("token_id").alias("__id"), F.col("__new").alias("__parent"))
        on = [new[c] == ids[f"__{c}"] for c in unit] + [new["parent"] == ids["__id"]]
        new = new.join(ids, on, "left").withColumn("parent", F.col("__parent")).drop(*[f"__{c}" for c in unit], "__id", "__parent")
    if has:
        new = new.withColumn("sentence", F.dense_rank().over(W.partitionBy("doc_id").orderBy("sentence")))
    return new.withColumn("token_id", F.col("__new")).drop("__new").select(*tokens.columns)


def from_tokens(
    tokens: DataFrame, doc_col: str = "doc_id", token_id_col: str | None = "token_id", token_col: str | None = None, sentence_col: str | None = None, parent_col: str | None = None,
    meta: DataFrame | None = None, meta_cols: list[str] | None = None, feature_cols: list[str] | None = None, sentence_is_local: bool = True, token_is_local: bool = True,
) -> Corpus:
    """Imports a table with a row for each token.

    Metadata is a table of its own, or columns of the token table that are the
    same for all tokens of a document. Positions must be unique.
    """
    names = {doc_col: "doc_id", token_id_col: "token_id", token_col: "token", sentence_col: "sentence", parent_col: "parent"}
    names = {k: v for k, v in names.items() if k}
    features = feature_cols if feature_cols is not None else [c for c in tokens.columns if c not in names and c not in (meta_cols or [])]
    t = tokens.select(*[F.col(k).alias(v) for k, v in names.items()], *features)
    if "token_id" not in t.columns:
        raise ValueError("a token table needs a column of token ids")
    numeric = [c for c in ("token_id", "sentence", "parent") if c in t.columns and dict(t.dtypes)[c] == "string"]
    if numeric:
        raise ValueError(f"{numeric} must be numeric")
    keys = ["doc_id", *(["sentence"] if "sentence" in t.columns and token_is_local else []), "token_id"]
    if t.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError(f"positions ({', '.join(keys)}) must be unique")
    if meta is not None:
        m = meta.withColumnRenamed(doc_col, "doc_id")
        m = m.join(t.select("doc_id").distinct(), "doc_id", "left_semi")
        lost = t.select("doc_id").distinct().join(m, "doc_id", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"the metadata has no document {lost[0][0]}")
    elif meta_cols:
        m = tokens.select(F.col(doc_col).alias("doc_id"), *meta_cols).distinct()
        if m.groupBy("doc_id").count().where("count > 1").limit(1).collect():
            raise ValueError("metadata columns must have one value for each document")
    else:
        m = t.select("doc_id").distinct()
    return Corpus(local_ids(t, sentence_is_local, token_is_local), m, "imported")


def feats_to_columns(corpus: Corpus, column: str = "feats", keep: list[str] | None = None, drop: list[str] | None = None, rm_column: bool = True) -> Corpus:
    """Turns morphological features ``A=x|B=y`` into columns; a name that is taken gets the prefix ``feats.``."""
    pairs = F.str_to_map(F.col(column), F.lit(r"\|"), F.lit("="))
    t = corpus.tokens
    if keep is None:
        keep = sorted(r[0] for r in t.where(F.col(column).isNotNull()).select(F.explode(F.map_keys(pairs))).distinct().collect() if r[0])
    keep = [k for k in keep if k not in (drop or [])]
    taken = set(t.columns) - ({column} if rm_column else set())
    new = {(f"feats.{k}" if k in taken else k): F.try_element_at(pairs, F.lit(k)) for k in keep}
    t = t.withColumns(new)
    return Corpus(t.drop(column) if rm_column else t, corpus.meta, corpus.model)


def merge(corpora: list[Corpus], keep_data: str = "intersect", keep_meta: str = "intersect", if_duplicate: str = "stop", duplicate_tag: str = "#D") -> Corpus:
    """The union of corpora. A document id that an earlier one has raises, is renamed, or its document is dropped."""

    def union(parts: list[DataFrame], keep: str) -> DataFrame:
        if keep == "all":
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        return reduce(lambda a, b: a.unionByName(b), [p.select(*common) for p in parts])

    if if_duplicate == "rename":
        # A tagged id is a string, so all are.
        named = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
        corpora = [Corpus(named(c.tokens), named(c.meta), c.model) for c in corpora]
    done: list[Corpus] = []
    seen: DataFrame | None = None
    for c in corpora:
        if seen is not None:
            twice = c.meta.select("doc_id").join(seen, "doc_id", "left_semi")
            if if_duplicate == "stop":
                if twice.limit(1).collect():
                    raise ValueError("a document id is in several corpora")
            elif if_duplicate == "drop":
                c = Corpus(c.tokens.join(twice, "doc_id", "left_anti"), c.meta.join(twice, "doc_id", "left_anti"), c.model)
            elif if_duplicate == "rename":
                while twice.limit(1).collect():
                    tagged = lambda df, d=twice: df.join(d.select("doc_id", F.lit(True).alias("__twice")), "doc_id", "left").withColumn("doc_id", F.when(F.col("__twice"), F.concat(F.col("doc_id").cast("string"), F.lit(duplicate_tag))).otherwise(F.col("doc_id").cast("string"))).drop("__twice").select(*df.columns)
                    c = Corpus(tagged(c.tokens), tagged(c.meta), c.model)
                    twice = c.meta.select("doc_id").join(seen, "doc_id", "left_semi")
            else:
                raise ValueError("if_duplicate is 'stop', 'rename' or 'drop'")
        done.append(c)
        ids = c.meta.select("doc_id")
        seen = ids if seen is None else seen.union(ids)
    t = union([c.tokens for c in done], keep_data)
    if "sentence" in t.columns and not all("sentence" in c.tokens.columns for c in done):
        t = t.drop("sentence")
    return Corpus(t, union([c.meta for c in done], keep_meta), done[0].model)


def save(corpus: Corpus, path: str, mode: str = "errorifexists") -> None:
    """Writes both tables as Parquet, tokens clustered by document."""
    corpus.tokens.repartition("doc_id").sortWithinPartitions("doc_id", "token_id").write.mode(mode).parquet(f"{path}/tokens")
    corpus.meta.write.mode(mode).parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, model: str = "saved") -> Corpus:
    return Corpus(spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/meta"), model)
