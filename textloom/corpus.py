"""The corpus: a table of tokens and a table of documents.

A ``Corpus`` is immutable; each method returns a new one (or a DataFrame) and runs
nothing. Tokens have ``doc_id``, ``token_id``, optionally ``sentence``, and any
other columns as features; a null feature is a token that was filtered out. A
position is a column, never the order of rows. Conditions are Columns or SQL strings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.store import written

#: Words that are broadcast; beyond it they are joined by shuffling.
BROADCAST_WORDS = 1_000_000
PROTECTED = ("doc_id", "token_id")
#: Meta tables of fewer rows than this are broadcast if a caller says so by ``small_meta``.
Condition = Column | str


def expr(x: Condition) -> Column:
    return F.expr(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Corpus:
    """Tokens, metadata of documents, and the name of what made the tokens."""

    tokens: DataFrame
    meta: DataFrame
    model: str = "regex"
    #: The tokens that were exploded from a table with ``doc_id``, the array ``words`` and the metadata, that table, and the metadata.
    exploded: tuple[DataFrame, DataFrame, DataFrame] | None = None

    # -- description
    def words(self, feature: str = "token", context_level: str = "document") -> DataFrame | None:
        """doc_id, words: a row for each text, from which the tokens come unchanged; None if there is no such table.

        What concerns one text is then done in its row, without a shuffle of the tokens.
        """
        if self.exploded is None or self.exploded[0] is not self.tokens or feature != "token" or context_level != "document":
            return None
        return self.exploded[1].select("doc_id", "words") if self._unique else None

    @cached_property
    def _unique(self) -> bool:
        """Whether a text has one row; looked up once."""
        return not self.exploded[1].groupBy("doc_id").count().where("count > 1").limit(1).collect()

    def counted(self, feature: str = "token", context_level: str = "document", positions: bool = False) -> DataFrame | None:
        """doc_id, feature, n, total (words of the text) and with ``positions`` where: each word of each text, counted in its row; None as for ``words``."""
        d = self.words(feature, context_level)
        return None if d is None else self.count_rows(d, positions)

    @staticmethod
    def count_rows(d: DataFrame, positions: bool = False) -> DataFrame:
        """``counted`` of rows of doc_id and words."""
        word = (lambda x: x["w"]) if positions else (lambda x: x)
        own = F.transform("words", lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))) if positions else F.col("words")
        d = d.where(F.size("words") > 0).select("doc_id", F.sort_array(own).alias("s"))
        at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: ~word(F.get("s", i)).eqNullSafe(word(F.get("s", i - 1))))
        d = d.select("doc_id", "s", at.alias("at"))

        def one(a, k):
            n = F.coalesce(F.get("at", k + 1), F.size("s")) - a
            where = [F.transform(F.slice("s", a + 1, n), lambda x: x["i"]).alias("where")] if positions else []
            return F.struct(word(F.get("s", a)).alias("feature"), n.cast("long").alias("n"), F.size("s").cast("long").alias("total"), *where)

        return d.select("doc_id", F.inline(F.transform("at", one)))

    def tokens_at(self, places: DataFrame, feature: str = "token", name: str = "feature") -> DataFrame:
        """``places`` (doc_id, token_id, any columns) that are in the text, with its token there as ``name``: taken from the rows of the texts, if there are such, which are fewer than the tokens."""
        d = self.words(feature)
        if d is None:
            return places.join(self.tokens.select("doc_id", "token_id", F.col(f"`{feature}`").alias(name)), ["doc_id", "token_id"])
        others = [c for c in places.columns if c != "doc_id"]
        p = places.groupBy("doc_id").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in others])).alias("__places"))
        p = p.join(d, "doc_id").select("doc_id", "words", F.explode("__places").alias("__p"))
        p = p.select("doc_id", *[F.col(f"__p.`{c}`") for c in others], F.when(F.col("__p.token_id") >= 1, F.get("words", F.col("__p.token_id") - 1)).alias(name))
        return p.where(F.col(f"`{name}`").isNotNull())

    def around(self, hits: DataFrame, window: int, feature: str = "token") -> DataFrame | None:
        """doc_id, token_id, token within ``window`` positions of ``hits`` (doc_id, token_id), each once; None as for ``words``."""
        d = self.words(feature)
        if d is None:
            return None
        p = hits.groupBy("doc_id").agg(F.collect_set("token_id").alias("__hits")).join(d, "doc_id")
        near = F.array_distinct(F.flatten(F.transform("__hits", lambda h: F.sequence(F.greatest(h - window, F.lit(1)), F.least(h + window, F.size("words"))))))
        p = p.select("doc_id", "words", F.explode(near).alias("token_id"))
        return p.select("doc_id", "token_id", F.get("words", F.col("token_id") - 1).alias("token"))

    def tokens_with(self, *columns: str) -> DataFrame:
        """The tokens with columns of the metadata; from the rows of the texts, if those have them, without a join."""
        if self.words() is not None and self.exploded[2] is self.meta and self.is_plain:
            d = self.exploded[1].select("doc_id", *columns, F.posexplode("words").alias("token_id", "token"))
            return d.select("doc_id", (F.col("token_id") + 1).alias("token_id"), "token", *columns)
        return self.tokens.join(self.meta.select("doc_id", *columns), "doc_id")

    @property
    def is_plain(self) -> bool:
        """Whether tokens have no columns but their place and their word."""
        return self.tokens.columns == ["doc_id", "token_id", "token"]

    @property
    def has_sentences(self) -> bool:
        return "sentence" in self.tokens.columns

    @property
    def names(self) -> list[str]:
        return self.tokens.columns

    @property
    def meta_names(self) -> list[str]:
        return self.meta.columns

    @property
    def feature_names(self) -> list[str]:
        return [c for c in self.tokens.columns if c not in ("doc_id", "sentence", "token_id")]

    def n(self) -> int:
        return self.tokens.count()

    def n_meta(self) -> int:
        return self.meta.count()

    def describe(self) -> DataFrame:
        """One row: tokens, documents, sentences."""
        s = F.count_distinct("doc_id", "sentence") if self.has_sentences else F.lit(None).cast("long")
        return self.tokens.agg(F.count("*").alias("tokens"), F.count_distinct("doc_id").alias("documents"), s.alias("sentences"))

    def validate(self) -> Corpus:
        """Raises if a position isn't unique, a document isn't unique in the metadata, or a name isn't allowed."""
        for c in [*self.tokens.columns, *self.meta.columns]:
            if c.startswith("."):
                raise ValueError(f"column names can't begin with a dot: {c}")
        for df, keys in ((self.tokens, ["doc_id", "token_id"]), (self.meta, ["doc_id"])):
            missing = [k for k in keys if k not in df.columns]
            if missing:
                raise ValueError(f"columns {missing} are missing")
            twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"{keys} must be unique; {twice[0].asDict()} isn't")
        return self

    def context(self, level: str = "document") -> list[str]:
        """The columns that tell contexts apart."""
        if level == "document":
            return ["doc_id"]
        if level != "sentence":
            raise ValueError("a context is a document or a sentence")
        if not self.has_sentences:
            raise ValueError("there is no sentence column; split sentences when the corpus is made")
        return ["doc_id", "sentence"]

    def context_labels(self, level: str = "document") -> DataFrame:
        """The tokens' positions and the label of their context (``doc #sentence``)."""
        return self.tokens.select(*PROTECTED, F.concat_ws(" #", *[F.col(c).cast("string") for c in self.context(level)]).alias("context"))

    def context_level(self, level: str) -> list[str]:
        return self.context(level)

    # -- access
    def get(self, columns: list[str] | None = None, subset: Condition | None = None, doc_id: list | None = None, token_id: list | None = None) -> DataFrame:
        """Token rows, by condition or by keys."""
        t = self.tokens
        if doc_id is not None:
            t = t.where(F.col("doc_id").isin(doc_id))
        if token_id is not None:
            t = t.where(F.col("token_id").isin(token_id))
        if subset is not None:
            t = t.where(expr(subset))
        return t.select(*columns) if columns else t

    def get_meta(self, columns: list[str] | None = None, per_token: bool = False, subset: Condition | None = None, doc_id: list | None = None) -> DataFrame:
        """Document rows, or with ``per_token`` one for each token."""
        m = self.meta
        if doc_id is not None:
            m = m.where(F.col("doc_id").isin(doc_id))
        if subset is not None:
            m = m.where(expr(subset))
        if per_token:
            m = self.tokens.select(*PROTECTED).join(m, "doc_id", "left" if doc_id is None and subset is None else "inner")
        return m.select(*columns) if columns else m

    def levels(self, column: str, meta: bool = False) -> DataFrame:
        """The distinct values of a column."""
        return (self.meta if meta else self.tokens).select(column).where(F.col(column).isNotNull()).distinct()

    def set_levels(self, column: str, mapping: dict, meta: bool = False) -> Corpus:
        """Renames values of a column; others stay."""
        items = [F.when(F.col(column) == k, F.lit(v)) for k, v in mapping.items()]
        new = F.coalesce(*items, F.col(column))
        return replace(self, meta=self.meta.withColumn(column, new)) if meta else replace(self, tokens=self.tokens.withColumn(column, new))

    def flagged(self, subset: Condition | None = None, subset_meta: Condition | None = None, window: int | None = None, inverse: bool = False) -> DataFrame:
        """doc_id, token_id of the tokens that a condition holds for (null counts as false), or that are within ``window`` of one."""
        t = self.tokens if subset_meta is None else self.tokens.join(self.meta.where(expr(subset_meta)).select("doc_id"), "doc_id", "left_semi")
        hit = F.coalesce(expr(subset), F.lit(False)) if subset is not None else F.lit(True)
        if window is not None:
            hit = F.max(hit).over(W.partitionBy("doc_id").orderBy("token_id").rangeBetween(-window, window))
        t = t.withColumn("__hit", hit)
        return t.where(~F.col("__hit") if inverse else F.col("__hit")).select(*PROTECTED)

    # -- change
    def set(self, column: str, value: Condition, subset: Condition | None = None) -> Corpus:
        """Assigns a column, where ``subset`` holds; elsewhere the old value or null stays."""
        if column == "doc_id":
            raise ValueError("doc_id can't be changed")
        new = expr(value)
        if subset is not None:
            old = F.col(column) if column in self.tokens.columns else F.lit(None)
            new = F.when(expr(subset), new).otherwise(old)
        t = self.tokens.withColumn(column, new)
        same = self.exploded is not None and self.exploded[0] is self.tokens and column not in ("token_id", "token", "sentence")
        return replace(self, tokens=t, exploded=(t, *self.exploded[1:]) if same else None)

    def set_meta(self, column: str, value: Condition, subset: Condition | None = None) -> Corpus:
        if column == "doc_id":
            raise ValueError("doc_id can't be changed")
        new = expr(value)
        if subset is not None:
            old = F.col(column) if column in self.meta.columns else F.lit(None)
            new = F.when(expr(subset), new).otherwise(old)
        return replace(self, meta=self.meta.withColumn(column, new))

    @staticmethod
    def _merged(left: DataFrame, df: DataFrame, by: dict[str, str], columns: list[str] | None) -> DataFrame:
        columns = columns or [c for c in df.columns if c not in by.values()]
        clash = [c for c in columns if c in left.columns]
        if clash:
            raise ValueError(f"columns {clash} are there already")
        twice = df.groupBy(*by.values()).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError("the keys of the table to merge must be unique")
        right = df.select(*[F.col(v).alias(f"__key_{k}") for k, v in by.items()], *columns)
        on = [left[k] == F.col(f"__key_{k}") for k in by]
        return left.join(right, on, "left").drop(*[f"__key_{k}" for k in by])

    def merge(self, df: DataFrame, by: list[str] | dict[str, str], columns: list[str] | None = None) -> Corpus:
        """Left join of a table with unique keys onto the tokens; ``by`` maps our columns to its."""
        by = by if isinstance(by, dict) else {c: c for c in by}
        return replace(self, tokens=self._merged(self.tokens, df, by, columns))

    def merge_meta(self, df: DataFrame, by: list[str] | dict[str, str], columns: list[str] | None = None) -> Corpus:
        by = by if isinstance(by, dict) else {c: c for c in by}
        return replace(self, meta=self._merged(self.meta, df, by, columns))

    def delete_columns(self, *columns: str) -> Corpus:
        self._guard(columns, PROTECTED)
        return replace(self, tokens=self.tokens.drop(*columns))

    def delete_meta_columns(self, *columns: str) -> Corpus:
        self._guard(columns, ("doc_id",))
        return replace(self, meta=self.meta.drop(*columns))

    def set_name(self, old: str, new: str) -> Corpus:
        self._guard((old, new), PROTECTED)
        return replace(self, tokens=self.tokens.withColumnRenamed(old, new))

    def set_meta_name(self, old: str, new: str) -> Corpus:
        self._guard((old, new), ("doc_id",))
        return replace(self, meta=self.meta.withColumnRenamed(old, new))

    @staticmethod
    def _guard(columns, protected) -> None:
        bad = [c for c in columns if c in protected]
        if bad:
            raise ValueError(f"{bad} can't be renamed or deleted")

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Corpus:
        """Any function of the token table."""
        return replace(self, tokens=fn(self.tokens))

    def persist(self) -> Corpus:
        return replace(self, tokens=self.tokens.persist(), meta=self.meta.persist())

    def copy(self) -> Corpus:
        return self

    # -- subsets
    def subset(self, subset: Condition | None = None, subset_meta: Condition | None = None, window: int | None = None) -> Corpus:
        """Keeps tokens, or documents, or both. Documents without a token left go.

        With ``window``, tokens within so many positions of one that ``subset``
        holds for stay too.
        """
        t, m = self.tokens, self.meta
        if subset_meta is not None:
            m = m.where(expr(subset_meta))
            t = t.join(m.select("doc_id"), "doc_id", "left_semi")
        if subset is not None:
            if window is None:
                t = t.where(expr(subset))
            else:
                near = W.partitionBy("doc_id").orderBy("token_id").rangeBetween(-window, window)
                t = t.withColumn("__near", F.max(F.coalesce(expr(subset), F.lit(False))).over(near)).where("__near").drop("__near")
            m = m.join(t.select("doc_id").distinct(), "doc_id", "left_semi")
        return replace(self, tokens=t, meta=m)

    def subset_meta(self, subset: Condition) -> Corpus:
        return self.subset(subset_meta=subset)

    def filter_freq(self, column: str, min: int | None = None, max: int | None = None, top: int | None = None, bottom: int | None = None, docs: bool = False) -> Corpus:
        """Keeps tokens whose value has a frequency (or with ``docs`` a document frequency) in the bounds, or among the top or bottom."""
        if docs and top is None and bottom is None and self.words(column) is not None:
            return self._filter_docfreq(column, min, max)
        if docs and (d := self.words(column)) is not None:
            f = d.select(F.explode(F.array_distinct("words")).alias(column)).groupBy(column).agg(F.count("*").alias("__n"))
        else:
            count = F.count_distinct("doc_id") if docs else F.count("*")
            f = self.tokens.where(F.col(column).isNotNull()).groupBy(column).agg(count.alias("__n"))
        if min is not None:
            f = f.where(F.col("__n") >= min)
        if max is not None:
            f = f.where(F.col("__n") <= max)
        if top is not None:
            f = f.orderBy(F.desc("__n"), column).limit(top)
        if bottom is not None:
            f = f.orderBy("__n", column).limit(bottom)
        t = self.tokens.join(f.select(column), column, "left_semi").select(*self.tokens.columns)
        return replace(self, tokens=t, meta=self.meta.join(t.select("doc_id").distinct(), "doc_id", "left_semi"))

    def _filter_docfreq(self, column: str, least: int | None, most: int | None) -> Corpus:
        """``filter_freq`` by document frequency. Of words within and beyond the bounds the fewer are broadcast, if they are few enough, so the tokens aren't shuffled; what stays is written, as it is used several times."""
        ok = F.lit(True)
        if least is not None:
            ok = ok & (F.col("__n") >= least)
        if most is not None:
            ok = ok & (F.col("__n") <= most)
        f = self.words(column).select(F.explode(F.array_distinct("words")).alias(column)).groupBy(column).agg(F.count("*").alias("__n"))
        f = written(f.select(column, ok.alias("__ok")), "frequencies")
        n = {r[0]: r[1] for r in f.groupBy("__ok").count().collect()}
        kept, gone = f.where("__ok").select(column), f.where("not __ok").select(column)
        if n.get(True, 0) <= n.get(False, 0) or n.get(False, 0) > BROADCAST_WORDS:
            t = self.tokens.join(F.broadcast(kept) if n.get(True, 0) <= BROADCAST_WORDS else kept, column, "left_semi")
        else:
            t = self.tokens.join(F.broadcast(gone), column, "left_anti")
        t = written(t.select(*self.tokens.columns), "tokens")
        return replace(self, tokens=t, meta=self.meta.join(t.select("doc_id").distinct(), "doc_id", "left_semi"))

    # -- operators, which live in modules of their own
    def preprocess(self, column: str = "token", new_column: str = "feature", **how) -> Corpus:
        from textloom.operators import preprocessing

        return preprocessing.preprocess(self, column, new_column, **how)

    def feature_subset(self, column: str, new_column: str, subset: Condition, **how) -> Corpus:
        from textloom.operators import preprocessing

        return preprocessing.feature_subset(self, column, new_column, subset, **how)

    def search_features(self, queries, **how) -> DataFrame:
        from textloom.operators import search

        return search.search_features(self, queries, **how)

    def search_contexts(self, queries, **how) -> DataFrame:
        from textloom.operators import search

        return search.search_contexts(self, queries, **how)

    def subset_query(self, query: str, **how) -> Corpus:
        from textloom.operators import search

        return search.subset_query(self, query, **how)

    def code_features(self, queries, **how) -> Corpus:
        from textloom.operators import search

        return search.code_features(self, queries, **how)

    def search_recode(self, feature: str, new_value: str, query: str, **how) -> Corpus:
        from textloom.operators import search

        return search.search_recode(self, feature, new_value, query, **how)

    def dtm(self, feature: str = "token", **how) -> DataFrame:
        from textloom.operators import dtm

        return dtm.dtm(self, feature, **how)
