"""Dictionaries: patterns of one or more words, with wildcards, looked up in token columns.

All patterns are looked up in one pass over the tokens. The first word of a pattern
is joined with the token by equality: by the whole word or, if it has a wildcard, by
the letters before that (three at most), after which its expression is tried. So
the join's size is that of the candidates. With patterns of several words, tokens
that match no word of any pattern are dropped where they are read; only the others
are shuffled, and a window over the document compares those that follow one another.
With patterns of one word alone nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Corpus
from textloom.functions import text as T

MAX_WORDS = 100
#: Patterns, or words of patterns, that are broadcast; beyond it they are joined by shuffling.
BROADCAST = 200_000
#: Words that are compared within an expression; beyond it they are broadcast.
INLINE = 2_000
_PIECE = regex.compile(r"(?:\\.|[*?]|" + T.TOKEN.replace(r"|[^\s]", "") + r")+|[^\s]")


def pattern_words(pattern: str, sep: str = " ") -> list[str]:
    """The tokens of a pattern; wildcards and escapes belong to the words that they touch."""
    text = pattern.replace("_", " ")
    if sep != " ":
        text = text.replace(sep, " ")
    return _PIECE.findall(text)


def _rows(patterns: Iterable[tuple[int, str, bool]], sep: str, wildcards: bool, ascii_: bool) -> list[tuple]:
    out = []
    for number, pattern, sensitive in patterns:
        words = pattern_words(pattern.strip(), sep)
        if not words or len(words) > MAX_WORDS:
            if words:
                raise ValueError(f"a pattern has at most {MAX_WORDS} words")
            continue
        if not sensitive:
            words = [w.lower() for w in words]
        wild = wildcards and any(T.has_wildcard(w) for w in words)
        rx = [T.wildcard_regex(w) if wildcards else "^" + regex.escape(T.unescaped(w)) + "$" for w in words]
        first = T.unescaped(words[0])
        head = wildcards and T.has_wildcard(words[0])
        # Words are joined by a character that is in no token.
        whole = "^" + "\u0001".join(x[1:-1].replace(".*", "[^\u0001]*").replace(".?", "[^\u0001]?") for x in rx) + "$"
        stem = _stem(words[0])
        key = f"{len(stem)}{stem}" if head else f"={first}"
        each = [rx[k] if wildcards and T.has_wildcard(w) else None for k, w in enumerate(words)]
        out.append((number, sensitive, len(words), key, rx[0] if head else None, None if wild else "\u0001".join(T.unescaped(w) for w in words), whole, [T.unescaped(w) for w in words], each))
    return out


def _stem(pattern: str) -> str:
    """What stands before the first wildcard, up to three letters."""
    return regex.match(r"(?:\\.|[^*?\\])*", pattern).group().replace("\\", "")[:3]


def _any_word(t: DataFrame, rows: list[tuple]) -> DataFrame:
    """The rows whose ``__w`` matches a word of a pattern, in whatever case."""
    plain = {w.lower() for r in rows for w, rx in zip(r[7], r[8]) if rx is None}
    wild = {rx.lower() if rx == rx.lower() else f"(?i){rx}" for r in rows for rx in r[8] if rx is not None}
    if len(plain) > BROADCAST or len(wild) > INLINE:
        return t
    word, ok = F.lower("__w"), F.lit(False)
    for rx in sorted(wild):
        ok = ok | word.rlike(rx)
    if len(plain) <= INLINE:
        return t.where(word.isin(sorted(plain)) | ok)
    known = t.sparkSession.createDataFrame([(w,) for w in sorted(plain)], "__known string")
    return t.join(F.broadcast(known), word == F.col("__known"), "left").where(F.col("__known").isNotNull() | ok).drop("__known")


_PATTERNS = "number int, sensitive boolean, words int, key string, head string, exact string, whole string"


def _adjacent(own: Column, length: int) -> Column:
    """Whether neighbours in an array of ``length`` words follow one another: within a token, or from its end to the next one."""

    def follows(k: Column) -> Column:
        p, q = F.element_at(own, k), F.element_at(own, k + 1)
        return ((q["i"] == p["i"]) & (q["s"] == p["s"] + 1)) | ((q["i"] == p["i"] + 1) & (q["s"] == 0) & (p["s"] == p["last"]))

    return F.forall(F.sequence(F.lit(1), F.lit(length - 1)), follows)


def lookup(tokens: DataFrame, column: str, patterns: Iterable[tuple[int, str, bool]], context: list[str], sep: str = " ", wildcards: bool = True, ascii_: bool = False, keep: list[str] | None = None) -> DataFrame:
    """number, the context columns, token_id and n (tokens) of every match of the patterns (number, text, case-sensitive).

    Tokens that hold several words, as replaced ones do, are compared word by word,
    so spaces between signs (``: )``) make no difference. ``keep`` names columns of
    the first token that conditions need.
    """
    spark = tokens.sparkSession
    rows = _rows(patterns, sep, wildcards, ascii_)
    keep = keep or []
    value = F.col(f"`{column}`").cast("string")
    if ascii_:
        value = T.as_ascii(value)
    t = tokens.where(value.isNotNull()).select(*dict.fromkeys([*context, "token_id", *keep]), value.alias("__v"))
    table = spark.createDataFrame([r[:7] for r in rows] or [(0, False, 1, "", "", "", "")], _PATTERNS)
    if not rows:
        table = table.limit(0)
    longest = max((r[2] for r in rows), default=1)
    join_small = F.broadcast if len(rows) <= BROADCAST else (lambda x: x)
    if longest > 1:
        pieces = F.regexp_extract_all(F.translate(F.col("__v"), "_", " "), F.lit(T.TOKEN), F.lit(0))
        t = t.withColumn("__ps", F.when(F.col("__v").rlike(r"[^\p{L}\p{N}]") & (F.size(pieces) > 1), pieces).otherwise(F.array("__v")))
        t = t.select("*", F.posexplode("__ps").alias("__sub", "__w"), (F.size("__ps") - 1).alias("__last")).drop("__ps", "__v")
        t = _any_word(t, rows)
        after = W.partitionBy(*context).orderBy("token_id", "__sub")
        lengths = sorted({r[2] for r in rows if r[2] > 1})
        s = F.struct(F.col("token_id").alias("i"), F.col("__sub").alias("s"), F.col("__last").alias("last"), F.col("__w").alias("w"))
        t = t.withColumn("__next", F.collect_list(s).over(after.rowsBetween(0, longest - 1)))
        for length in lengths:
            own = F.slice("__next", 1, length)
            t = t.withColumns({f"__g{length}": F.when(F.size(own) == length, F.when(_adjacent(own, length), F.array_join(F.transform(own, lambda x: x["w"]), "\u0001"))), f"__e{length}": F.element_at(own, -1)["i"]})
        t = t.drop("__next", "__last")
    else:
        lengths = []
        t = t.withColumnRenamed("__v", "__w")
    out = None
    for sensitive in sorted({r[1] for r in rows}) or [False]:
        own = table.where(F.col("sensitive") == sensitive)
        word = F.col("__w") if sensitive else F.lower("__w")
        stems = sorted({r[3][0] for r in rows if r[1] == sensitive} - {"="})
        if stems:
            keys = [F.concat(F.lit("="), word), *(F.concat(F.lit(k), F.substring(word, 1, int(k))) for k in stems)]
            hit = t.withColumn("__key", F.explode(F.array(*keys))).join(join_small(own), F.col("__key") == F.col("key")).drop("__key")
            hit = hit.where(F.col("head").isNull() | F.expr(f"{'__w' if sensitive else 'lower(__w)'} RLIKE head"))
        else:
            hit = t.join(join_small(own), F.concat(F.lit("="), word) == F.col("key"))
        if lengths:
            gram, end = F.lit(None).cast("string"), F.col("token_id")
            for length in lengths:
                gram = F.when(F.col("words") == length, F.col(f"__g{length}")).otherwise(gram)
                end = F.when(F.col("words") == length, F.col(f"__e{length}")).otherwise(end)
            gram = gram if sensitive else F.lower(gram)
            hit = hit.withColumn("__gram", gram)
            ok = F.when(F.col("exact").isNotNull(), F.col("__gram") == F.col("exact")).otherwise(F.expr("__gram RLIKE whole"))
            hit = hit.where((F.col("words") == 1) | ok).withColumn("n", (end - F.col("token_id") + 1).cast("int"))
            # A token of several words is no match for one of them.
            hit = hit.withColumn("n", F.when(F.col("words") == 1, F.lit(1)).otherwise(F.col("n")))
        else:
            hit = hit.withColumn("n", F.lit(1))
        hit = hit.select("number", *dict.fromkeys([*context, "token_id", *keep]), "n")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct() if longest > 1 else out


def melt(nested: dict, prefix: tuple[str, ...] = ()) -> list[dict]:
    """A nested dictionary of lists as rows: string, code, code_l2, ..."""
    out: list[dict] = []
    for key, value in nested.items():
        path = (*prefix, str(key))
        if isinstance(value, dict):
            out += melt(value, path)
            continue
        for s in [value] if isinstance(value, str) else value:
            out.append({"string": s} | {("code" if k == 0 else f"code_l{k + 1}"): p for k, p in enumerate(path)})
    return out


def as_dictionary(spark: SparkSession, d, string_col: str = "string") -> DataFrame:
    """A DataFrame with the column ``string_col`` from one, from rows, from a list of strings or from a nested dictionary."""
    if isinstance(d, DataFrame):
        return d
    if isinstance(d, dict):
        d = melt(d)
    rows = [x if isinstance(x, dict) else {string_col: x} for x in d]
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)


def _numbered(spark: SparkSession, d, string_col: str) -> tuple[DataFrame, list]:
    """The dictionary's rows with numbers; a dictionary is user input of bounded size and lives on the driver."""
    df = as_dictionary(spark, d, string_col)
    rows = df.collect()
    fields = [f for f in df.schema.fields]
    if not rows:
        return df.limit(0).selectExpr("cast(0 as int) as __number", "*"), []
    import pyspark.sql.types as P

    schema = P.StructType([P.StructField("__number", P.IntegerType()), *fields])
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schema), [(k, r[string_col]) for k, r in enumerate(rows) if r[string_col] is not None]


def _small(numbered: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(numbered) if rows <= BROADCAST else numbered


def matches(corpus: Corpus, d, token_col: str = "token", string_col: str = "string", sep: str = " ", mode: str = "unique_hits", case_sensitive: bool = False, use_wildcards: bool = True, ascii: bool = False, context_level: str = "document") -> tuple[DataFrame, DataFrame]:
    """(hits with ``__number``, context columns, token_id of the first token, n), and the numbered dictionary, with a broadcast hint if it is small.

    In mode unique_hits a token belongs to one hit: of overlapping ones the longest,
    then the one that begins first, then the dictionary's first.
    """
    context = corpus.context(context_level)
    numbered, patterns = _numbered(corpus.tokens.sparkSession, d, string_col)
    m = lookup(corpus.tokens, token_col, [(k, s, case_sensitive) for k, s in patterns], context, sep, use_wildcards, ascii)
    m = m.withColumnRenamed("number", "__number")
    if mode == "unique_hits":
        hit = F.struct(-F.col("n"), "token_id", "__number").alias("__hit")
        spread = m.select(*context, "__number", "token_id", "n", hit, F.explode(F.sequence(F.col("token_id"), F.col("token_id") + F.col("n") - 1)).alias("__t"))
        best = F.min("__hit").over(W.partitionBy("doc_id", "__t"))
        won = spread.withColumn("__won", F.col("__hit") == best)
        m = won.groupBy(*context, "__number", "token_id", "n").agg(F.min(F.col("__won").cast("int")).alias("__won")).where("__won = 1").drop("__won")
    elif mode != "features":
        raise ValueError("mode is 'unique_hits' or 'features'")
    return m, _small(numbered, len(patterns))


def _with_ids(m: DataFrame) -> DataFrame:
    """hit_id: numbers from 1 within a document in the order of the text."""
    return m.withColumn("hit_id", F.dense_rank().over(W.partitionBy("doc_id").orderBy("token_id", "__number")).cast("int"))


def _spread(m: DataFrame, context: list[str]) -> DataFrame:
    at = F.explode(F.sequence(F.col("token_id"), F.col("token_id") + F.col("n") - 1))
    return m.select(*context, "__number", "hit_id", at.alias("token_id"))


def search_dictionary(corpus: Corpus, d, token_col: str = "token", string_col: str = "string", code_col: str = "code", sep: str = " ", mode: str = "unique_hits", case_sensitive: bool = False, use_wildcards: bool = True, ascii: bool = False) -> DataFrame:
    """code, feature, doc_id, sentence, token_id, hit_id of each token of a hit."""
    m, numbered = matches(corpus, d, token_col, string_col, sep, mode, case_sensitive, use_wildcards, ascii)
    codes = numbered.select("__number", F.col(code_col if code_col in numbered.columns else string_col).cast("string").alias("code"))
    hits = _spread(_with_ids(m), ["doc_id"]).join(codes, "__number").drop("__number")
    sentence = F.col("sentence") if corpus.has_sentences else F.lit(None).cast("int").alias("sentence")
    t = corpus.tokens.select("doc_id", "token_id", F.col(token_col).alias("feature"), sentence)
    return hits.join(t, ["doc_id", "token_id"]).select("code", "feature", "doc_id", "sentence", "token_id", "hit_id")


def code_dictionary(corpus: Corpus, d, token_col: str = "token", string_col: str = "string", column: str = "code", sep: str = " ", case_sensitive: bool = False, use_wildcards: bool = True, ascii: bool = False, only_hits: bool = False) -> Corpus:
    """Adds the dictionary's columns and ``<column>_id`` (the hit) to the tokens of its hits; with ``only_hits`` the other tokens go."""
    m, numbered = matches(corpus, d, token_col, string_col, sep, "unique_hits", case_sensitive, use_wildcards, ascii)
    extra = numbered.drop(string_col)
    hits = _spread(_with_ids(m), ["doc_id"]).withColumnRenamed("hit_id", f"{column}_id").join(extra, "__number").drop("__number")
    if only_hits and corpus.is_plain and "token" not in hits.columns:
        return Corpus(corpus.tokens_at(hits, "token", "token"), corpus.meta, corpus.model)
    t = corpus.tokens.drop(*[c for c in hits.columns if c not in ("doc_id", "token_id")])
    if only_hits:
        return Corpus(t.join(hits, ["doc_id", "token_id"]), corpus.meta, corpus.model)
    return Corpus(t.join(hits, ["doc_id", "token_id"], "left"), corpus.meta, corpus.model)


def code_from_features(corpus: Corpus, hits: DataFrame, token_col: str = "token") -> DataFrame:
    """code, label: the string that most of a code's hits have."""
    s = hits.groupBy("code", "doc_id", "hit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_id", "feature"))), lambda x: x["feature"]), " ").alias("label"))
    n = s.groupBy("code", "label").agg(F.count("*").alias("n"))
    return n.groupBy("code").agg(F.max_by("label", F.struct("n", "label")).alias("label"))


def replace_dictionary(corpus: Corpus, d, token_col: str = "token", string_col: str = "string", code_col: str = "code", sep: str = " ", code_from_features_: bool = False, code_sep: str = "_", decrement_ids: bool = True, case_sensitive: bool = False, use_wildcards: bool = True) -> Corpus:
    """Makes each hit one token, its code (or matched string), and renumbers the tokens after it."""
    m, numbered = matches(corpus, d, token_col, string_col, sep, "unique_hits", case_sensitive, use_wildcards)
    label = F.col(code_col).cast("string") if code_col in numbered.columns else F.lit(None).cast("string")
    m = m.join(numbered.select("__number", label.alias("__code")), "__number").select("doc_id", "token_id", "n", "__code")
    d = corpus.words(token_col) if decrement_ids and corpus.is_plain else None
    if d is not None:  # in the rows of the texts: what stands before each hit, its value, and what stands after the last
        hits = m.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token_id", "n", "__code"))).alias("h"))
        end = lambda h: F.coalesce(h["token_id"] + h["n"] - 1, F.lit(0))

        def part(h, k):
            a = end(F.get("h", k - 1))
            joined = F.array_join(F.slice("words", h["token_id"], h["n"]), code_sep if code_from_features_ else "")
            return F.concat(F.slice("words", a + 1, h["token_id"] - 1 - a), F.array(joined if code_from_features_ else F.coalesce(h["__code"], joined)))

        last = end(F.get("h", F.size("h") - 1))
        new = F.concat(F.flatten(F.transform("h", part)), F.slice("words", last + 1, F.size("words") - last))
        d = d.join(hits, "doc_id", "left").select("doc_id", F.when(F.col("h").isNull(), F.col("words")).otherwise(new).alias("w"))
        t = d.select("doc_id", F.posexplode("w").alias("token_id", token_col)).withColumn("token_id", F.col("token_id") + 1)
        return Corpus(t, corpus.meta, corpus.model)
    here = W.partitionBy("doc_id").orderBy("token_id")
    t = corpus.tokens.join(m, ["doc_id", "token_id"], "left")
    begin = F.last(F.when(F.col("n").isNotNull(), F.col("token_id")), True).over(here)
    size = F.last("n", True).over(here)
    t = t.withColumn("__begin", F.when(F.col("token_id") < begin + size, begin))
    hit = W.partitionBy("doc_id", "__begin")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_id", F.col(token_col).alias("v"))).over(hit)), lambda x: x["v"]), code_sep if code_from_features_ else "")
    value = joined if code_from_features_ else F.coalesce("__code", joined)
    t = t.withColumn(token_col, F.when(F.col("__begin").isNotNull(), value).otherwise(F.col(token_col)))
    t = t.withColumn("__gone", (F.col("__begin").isNotNull() & (F.col("token_id") > F.col("__begin"))).cast("int"))
    if decrement_ids:
        t = t.withColumn("__id", (F.col("token_id") - F.sum("__gone").over(here)).cast("int")).where("__gone = 0").withColumn("token_id", F.col("__id")).drop("__id")
    else:
        t = t.where("__gone = 0")
    return Corpus(t.select(*corpus.tokens.columns), corpus.meta, corpus.model)
