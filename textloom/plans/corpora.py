"""Making, changing and leaving corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import aggregate, dictionary, preprocessing
from textloom.plans._base import TOK, benchmark, documents, rounded
from textloom.sources import tables, texts
from textloom.sources.texts import from_texts


def tokenize(spark, sf):
    """Every word with its position."""
    return documents(spark, sf).tokens


def tokens_by_language(spark, sf):
    """N documents and V tokens of each language."""
    return aggregate.count(documents(spark, sf), ["lang"])


def aggregate_tokens(spark, sf):
    """Tokens, distinct tokens and their mean length by language and source."""
    c = documents(spark, sf)
    return rounded(aggregate.aggregate(c, ["lang", "source"], n=F.count("*"), types=F.count_distinct("token"), chars=F.avg(F.char_length("token"))), "chars")


def subset_tokens(spark, sf):
    """Words of over 6 letters of the English documents, counted by document."""
    c = documents(spark, sf).subset("length(token) > 6", "lang = 'en'")
    return c.tokens.groupBy("doc_id").agg(F.count("*").alias("n")).join(c.meta, "doc_id").select("doc_id", "n", "source")


def subset_window(spark, sf):
    """Tokens within 2 positions of a number, counted by document."""
    c = documents(spark, sf).subset("token rlike '^[0-9]+$'", window=2)
    return c.tokens.groupBy("doc_id").agg(F.count("*").alias("n"))


def frequency_filter(spark, sf):
    """Words with 5 to 50 occurrences in all."""
    c = documents(spark, sf).filter_freq("token", min=5, max=50)
    return c.tokens.groupBy("token").agg(F.count("*").alias("n"))


def docfreq_filter(spark, sf):
    """Words in 3 to 20 documents."""
    c = documents(spark, sf).filter_freq("token", min=3, max=20, docs=True)
    return c.tokens.groupBy("token").agg(F.count_distinct("doc_id").alias("n"))


def merge_labels(spark, sf):
    """The labels as metadata; tokens by quality."""
    c = documents(spark, sf)
    c = c.merge_meta(spark.read.parquet(f"{sf}/labels.parquet"), ["doc_id"])
    return aggregate.count(c, ["quality"]).select(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("label"), "N", "V")


def preprocess_bigrams(spark, sf):
    """Stopwords out, then the pairs of words that are in 3 documents or more."""
    c = preprocessing.preprocess(documents(spark, sf), remove_stopwords=True, remove_numbers=True, ngrams=2, min_docfreq=3)
    return c.tokens.where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def feature_subset(spark, sf):
    """A column with the long words that occur 3 times or more; the others are null."""
    c = preprocessing.feature_subset(documents(spark, sf), "token", "long", "length(token) >= 8", min_freq=3)
    return c.tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count("long").alias("long"))


def merged_corpora(spark, sf):
    """Documents and benchmark in one corpus; ids that both have are tagged."""
    d, b = documents(spark, sf), benchmark(spark, sf)
    m = tables.merge([d, b], if_duplicate="rename", keep_meta="intersect")
    return m.tokens.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("n"))


def untokenized(spark, sf):
    """Texts to tokens with their spaces, and back."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return texts.untokenize(from_texts(d, remember_spaces=True)).select("doc_id", F.md5("text").alias("digest"))


def spans(spark, sf):
    """Stretches of numbers next to each other, with their offsets in the text."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    c = from_texts(d, remember_spaces=True).set("number", F.when(F.col("token").rlike("^[0-9]+$"), F.lit("number")))
    return texts.export_spans(c, ["number"])


def stems(spark, sf):
    """Stems of the English words, counted."""
    c = documents(spark, sf).subset(subset_meta="lang = 'en'")
    c = preprocessing.preprocess(c, use_stemming=True)
    return c.tokens.groupBy("feature").agg(F.count("*").alias("n"))


def replaced(spark, sf):
    """Two-word expressions made one token; tokens left in each document."""
    c = dictionary.replace_dictionary(documents(spark, sf), ["of the", "in the", "the *ing"])
    return c.tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("token_id").alias("last"))


QUERIES = {f.__name__: f for f in (tokenize, tokens_by_language, aggregate_tokens, subset_tokens, subset_window, frequency_filter, docfreq_filter, merge_labels, preprocess_bigrams, feature_subset, merged_corpora, untokenized, spans, stems, replaced)}

from textloom.functions.stopwords import stopwords as _stop  # noqa: E402

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in _stop("english"))
ORACLE = {
    "tokenize": f"WITH {TOK} SELECT doc_id, token_id, token FROM tok",
    "tokens_by_language": f"WITH {TOK} SELECT lang, count(DISTINCT d.doc_id) AS N, CAST(count(t.token) AS BIGINT) AS V FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY lang",
    "aggregate_tokens": f"WITH {TOK} SELECT lang, source, count(*) AS n, count(DISTINCT token) AS types, round(avg(length(token)), 6) AS chars FROM tok JOIN documents USING (doc_id) GROUP BY lang, source",
    "subset_tokens": f"WITH {TOK} SELECT doc_id, count(*) AS n, any_value(source) AS source FROM tok JOIN documents USING (doc_id) WHERE length(token) > 6 AND lang = 'en' GROUP BY doc_id",
    "subset_window": f"WITH {TOK}, h AS (SELECT doc_id, token_id FROM tok WHERE regexp_matches(token, '^[0-9]+$')) SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT t.doc_id, t.token_id FROM tok t JOIN h ON t.doc_id = h.doc_id AND abs(t.token_id - h.token_id) <= 2) GROUP BY doc_id",
    "frequency_filter": f"WITH {TOK} SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) BETWEEN 5 AND 50",
    "docfreq_filter": f"WITH {TOK} SELECT token, count(DISTINCT doc_id) AS n FROM tok GROUP BY token HAVING count(DISTINCT doc_id) BETWEEN 3 AND 20",
    "merge_labels": f"WITH {TOK} SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS label, count(DISTINCT d.doc_id) AS N, CAST(count(t.token) AS BIGINT) AS V FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY quality",
    "preprocess_bigrams": f"WITH {TOK}, f AS (SELECT doc_id, token_id, token FROM tok WHERE token NOT IN ({_STOP}) AND regexp_matches(token, '\\p{{L}}')), g AS (SELECT doc_id, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY token_id), '') || '/' || token AS feature FROM f) SELECT feature, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY feature HAVING count(DISTINCT doc_id) >= 3",
    "feature_subset": f"WITH {TOK}, l AS (SELECT token FROM tok WHERE length(token) >= 8 GROUP BY token HAVING count(*) >= 3) SELECT doc_id, count(*) AS tokens, count(l.token) AS long FROM tok LEFT JOIN l ON tok.token = l.token GROUP BY doc_id",
    "merged_corpora": f"WITH {TOK}, b AS (SELECT item_id AS id, len(regexp_extract_all(lower(trim(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+')) AS n FROM benchmark), u AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n FROM tok GROUP BY 1 UNION ALL SELECT CASE WHEN id IN (SELECT doc_id FROM documents) THEN id || '#D' ELSE CAST(id AS VARCHAR) END, CAST(n AS BIGINT) FROM b WHERE n > 0) SELECT doc_id, n FROM u",
    "untokenized": "SELECT doc_id, md5(trim(regexp_replace(text, '^[ ]+|[ ]+$', '', 'g'))) AS digest FROM documents WHERE regexp_matches(text, '\\S')",
    "replaced": f"""WITH {TOK}, n AS (SELECT *, lead(token) OVER w AS nxt FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY token_id)),
h AS (SELECT doc_id, token_id, CASE WHEN token = 'of' AND nxt = 'the' THEN 0 WHEN token = 'in' AND nxt = 'the' THEN 1 WHEN token = 'the' AND nxt LIKE '%ing' THEN 2 END AS k FROM n),
m AS (SELECT * FROM h WHERE k IS NOT NULL),
won AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.token_id = m.token_id - 1))
SELECT t.doc_id, count(*) - coalesce(any_value(g.n), 0) AS n, CAST(count(*) - coalesce(any_value(g.n), 0) AS INTEGER) AS last FROM tok t LEFT JOIN (SELECT doc_id, count(*) AS n FROM won GROUP BY doc_id) g ON t.doc_id = g.doc_id GROUP BY t.doc_id""",
}
