"""Access, change, import, query language and presentation, each by a query with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import dictionary, network, overlap, preprocessing, present, search
from textloom.plans._base import TOK, documents, rounded, turns
from textloom.sources import tables, texts
from textloom.sources.texts import from_texts


def accessed(spark, sf):
    """Rows by condition and by keys, with labels of their context."""
    c = documents(spark, sf)
    a = c.get(["doc_id", "token_id", "token"], subset="token_id <= 3", doc_id=list(range(20))).withColumn("how", F.lit("keys"))
    labels = c.context_labels().where("token_id = 2").select("doc_id", "token_id", F.col("context").alias("token")).withColumn("how", F.lit("context"))
    return a.unionByName(labels)


def meta_by_token(spark, sf):
    """Metadata expanded to the tokens, counted."""
    m = documents(spark, sf).get_meta(["doc_id", "source", "token_id"], per_token=True, subset="lang <> 'en'")
    return m.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def described(spark, sf):
    """Tokens and documents, and the columns there are."""
    c = documents(spark, sf)
    names = F.lit(",".join([*c.names, *c.meta_names, *c.feature_names]))
    return c.validate().describe().select("tokens", "documents", names.alias("names"))


def levels(spark, sf):
    """Values of columns, after some are renamed."""
    c = documents(spark, sf).set_levels("lang", {"en": "English", "de": "German"}, meta=True)
    c = c.set_levels("token", {"the": "THE"})
    return c.levels("lang", meta=True).select(F.col("lang").alias("value")).unionByName(c.levels("token").where("token in ('THE', 'the', 'of')").select(F.col("token").alias("value")))


def assigned(spark, sf):
    """Columns assigned where a condition holds, renamed and deleted."""
    c = documents(spark, sf).set("long", "length(token)", subset="length(token) > 5").set("double", F.col("long") * 2)
    c = c.set_name("double", "twice").delete_columns("long").set_meta("short", F.lit(True), subset="source is null or length(source) < 6").set_meta_name("short", "brief").delete_meta_columns("lang")
    return c.get_meta(["doc_id", "brief"]).join(c.tokens.groupBy("doc_id").agg(F.sum("twice").alias("twice"), F.count("*").alias("n")), "doc_id")


def merged_tokens(spark, sf):
    """A table with a row for each word, merged onto the tokens."""
    c = documents(spark, sf)
    first = c.tokens.groupBy("token").agg(F.min("doc_id").alias("first_doc"))
    c = c.merge(first.withColumnRenamed("token", "word"), {"token": "word"})
    return c.tokens.groupBy("doc_id").agg(F.sum(F.expr("cast(first_doc = doc_id as int)")).alias("new"), F.count("*").alias("n"))


def top_words(spark, sf):
    """The tokens of the 20 most and of the 20 least frequent words of 2 documents or more (a report of that many)."""
    c = documents(spark, sf)
    top = c.filter_freq("token", top=20).tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("side", F.lit("top"))
    low = c.filter_freq("token", bottom=20).tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def first_tokens(spark, sf):
    """At most 10 tokens of each text."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return from_texts(d, words_only=True, max_tokens=10).tokens


def fields(spark, sf):
    """Two text columns as one text: tokens of each field, with places within it."""
    d = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("Item "), "item_id").alias("title"), F.trim("text").alias("text"))
    c = from_texts(d, text_columns=["title", "text"], remember_spaces=True)
    return c.tokens.groupBy("doc_id", "field").agg(F.max("end").alias("last"), F.min("start").alias("first"))


def imported(spark, sf):
    """Tokens with ids that run over the whole table and parents by them, made local to the documents."""
    t = documents(spark, sf).tokens.where("doc_id < 200")
    t = t.withColumn("id", (F.col("doc_id") * 1_000_000 + F.col("token_id")).cast("long"))
    t = t.select(F.col("doc_id").alias("document"), "id", F.col("token").alias("word"), F.when(F.col("token_id") > 1, F.col("id") - 1).alias("head"))
    return tables.from_tokens(t, "document", "id", "word", parent_col="head", token_is_local=False).tokens.select("doc_id", "token_id", "token", F.coalesce("parent", F.lit(0)).alias("parent"))


def morphology(spark, sf):
    """Features ``A=x|B=y`` as columns."""
    c = documents(spark, sf)
    feats = F.when(F.length("token") > 3, F.concat(F.lit("First="), F.substring("token", 1, 1), F.lit("|Size="), F.length("token").cast("string")))
    c = tables.feats_to_columns(c.set("feats", feats).subset("token_id <= 5"), keep=["First", "Size", "None"])
    return c.tokens.select("doc_id", "token_id", "First", "Size", "None")


def whitespace(spark, sf):
    """Lengths, case and white space of a preprocessed column."""
    c = documents(spark, sf).set("pair", F.concat("token", F.lit(" X")))
    c = preprocessing.preprocess(c, "pair", "feature", lowercase=False, replace_whitespace=True, min_char=7, max_char=15)
    return c.tokens.where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"))


def trigrams(spark, sf):
    """Groups of three words."""
    c = preprocessing.preprocess(documents(spark, sf), ngrams=3, min_docfreq=2)
    return c.tokens.where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"))


def query_conditions(spark, sf):
    """Conditions on tokens and documents, a column's prefix, both wildcards, escapes and case."""
    c = documents(spark, sf).set("start", F.initcap(F.substring("token", 1, 2)))
    q = ["early# the~{token_id <= 20}", "column# start: Th~s", "one# th?s", "meta# of~[lang = 'en' and doc_id < 100]", r"plain# {the*}", "word# a*d"]
    hits = search.search_features(c, q, mode="features")
    return hits.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def hit_codes(spark, sf):
    """A nested dictionary, melted, looked up."""
    d = dictionary.melt({"article": {"def": ["the"], "indef": ["a", "an"]}, "link": ["of", "and"]})
    rows = [(r["string"], r["code"], r.get("code_l2")) for r in d]
    c = dictionary.code_dictionary(documents(spark, sf), spark.createDataFrame(rows, "string string, code string, code_l2 string"))
    return c.tokens.where("code is not null").groupBy("code", "code_l2").agg(F.count("*").alias("n"), F.count("code_id").alias("ids"))


def smoothed(spark, sf):
    """Shares of the words by additive smoothing."""
    f = documents(spark, sf).tokens.groupBy("token").agg(F.count("*").alias("freq"))
    whole = f.agg(F.sum(F.col("freq") + 0.5).alias("all"))  # as a join, since a window over all rows is one task
    return rounded(f.crossJoin(F.broadcast(whole)).select("token", "freq", ((F.col("freq") + 0.5) / F.col("all")).alias("p")), "p", places=9)


def smoothed_in_languages(spark, sf):
    """The same for each language. The sums of the languages, which are few, are joined: a window would put all words of one in a task."""
    f = documents(spark, sf).tokens_with("lang").groupBy("lang", "token").agg(F.count("*").alias("freq"))
    whole = f.groupBy(F.col("lang").alias("of")).agg(F.sum(F.col("freq") + 0.5).alias("all"))
    f = f.join(F.broadcast(whole), F.col("lang").eqNullSafe(F.col("of")))
    return rounded(f.select("lang", "token", ((F.col("freq") + 0.5) / F.col("all")).alias("p")), "p", places=9)


def turn_network(spark, sf):
    """Conditional probabilities, weighted by frequency, of words within the turns of a role."""
    c = turns(spark, sf).subset("length(token) >= 4", "role = 'system'")
    e = network.semnet(c, "token", measure="con_prob_weighted").edges
    return rounded(e.select("src", "dst", "weight"), "weight")


def marked_up(spark, sf):
    """Texts of the first 50 documents as HTML (a report of that many), long words highlighted."""
    c = documents(spark, sf).set("mark", F.when(F.length("token") > 9, F.lit(0.5)))
    return present.browse(c, highlight="mark", n=50)


def word_cloud(spark, sf):
    """The 100 most frequent words and their sizes (a report of that many)."""
    return rounded(present.cloud(documents(spark, sf).dtm()), "size").select("feature", F.col("freq").cast("long").alias("freq"), "size")


def quoted(spark, sf):
    """Tokens within quotation marks, by document."""
    d = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", r"\s+", " ").alias("text"))
    c = texts.quotes(from_texts(d, remember_spaces=True))
    return c.tokens.where("in_quote").groupBy("doc_id").agg(F.count("*").alias("n"))


def tagged(spark, sf):
    """Number of letters of words at whose ends groups of so many words are tagged, the longest first."""
    c = documents(spark, sf).set("size", "length(token)", subset="length(token) between 9 and 12").set("tag", "token", subset="size is not null")
    c = overlap.tag_ngrams(c.set("size", F.col("size") - 7), "tag", "size", "tag", priority="long")
    return c.tokens.where("tag is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("tag")).alias("letters"))


def token_tfidf(spark, sf):
    """tf-idf of each token, summed by document."""
    t = overlap.add_tfidf(documents(spark, sf), "token").tokens
    return rounded(t.groupBy("doc_id").agg(F.sum("tfidf").alias("tfidf"), F.count("*").alias("n")), "tfidf", places=5)


QUERIES = {f.__name__: f for f in (tagged, token_tfidf, accessed, meta_by_token, described, levels, assigned, merged_tokens, top_words, first_tokens, fields, imported, morphology, whitespace, trigrams, query_conditions, hit_codes, smoothed, smoothed_in_languages, turn_network, marked_up, word_cloud, quoted)}
ORACLE = {
    "tagged": f"""WITH {TOK}, g AS (SELECT doc_id, token_id AS last, token AS tag, length(token) - 7 AS n FROM tok WHERE length(token) BETWEEN 9 AND 12),
s AS (SELECT doc_id, tag, n, last, unnest(range(greatest(1, last - n + 1), last + 1)) AS token_id FROM g),
b AS (SELECT doc_id, token_id, tag FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, token_id ORDER BY n DESC, last) = 1)
SELECT doc_id, count(*) AS n, CAST(sum(length(tag)) AS BIGINT) AS letters FROM b GROUP BY doc_id""",
    "token_tfidf": f"WITH {TOK}, m AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM m GROUP BY 1), r AS (SELECT doc_id, sum(n) AS r FROM m GROUP BY 1) SELECT doc_id, round(sum(m.n * m.n / r * log2((SELECT count(DISTINCT doc_id) FROM tok) / df)), 5) AS tfidf, CAST(sum(m.n) AS BIGINT) AS n FROM m JOIN df USING (token) JOIN r USING (doc_id) GROUP BY doc_id",
    "accessed": f"WITH {TOK} SELECT doc_id, token_id, token, 'keys' AS how FROM tok WHERE token_id <= 3 AND doc_id < 20 UNION ALL SELECT doc_id, token_id, CAST(doc_id AS VARCHAR), 'context' FROM tok WHERE token_id = 2",
    "meta_by_token": f"WITH {TOK} SELECT source, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok JOIN documents USING (doc_id) WHERE lang <> 'en' GROUP BY source",
    "described": f"WITH {TOK} SELECT count(*) AS tokens, count(DISTINCT doc_id) AS documents, 'doc_id,token_id,token,doc_id,lang,source,token' AS names FROM tok",
    "levels": f"WITH {TOK} SELECT DISTINCT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT DISTINCT CASE token WHEN 'the' THEN 'THE' ELSE token END FROM tok WHERE token IN ('the', 'of')",
    "assigned": f"WITH {TOK} SELECT doc_id, CASE WHEN source IS NULL OR length(source) < 6 THEN true END AS brief, CAST(sum(CASE WHEN length(token) > 5 THEN 2 * length(token) END) AS BIGINT) AS twice, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY doc_id, source",
    "merged_tokens": f"WITH {TOK}, f AS (SELECT token, min(doc_id) AS first_doc FROM tok GROUP BY token) SELECT doc_id, CAST(sum(CAST(first_doc = doc_id AS INT)) AS BIGINT) AS new, count(*) AS n FROM tok JOIN f USING (token) GROUP BY doc_id",
    "top_words": f"WITH {TOK}, f AS (SELECT token, count(*) AS n FROM tok GROUP BY token) (SELECT token, n, 'top' AS side FROM f ORDER BY n DESC, token LIMIT 20) UNION ALL (SELECT token, n, 'bottom' FROM f ORDER BY n, token LIMIT 20)",
    "first_tokens": f"WITH {TOK} SELECT doc_id, token_id, token FROM tok WHERE token_id <= 10",
    "fields": r"SELECT item_id AS doc_id, f AS field, CAST(length(rtrim(t)) AS INTEGER) AS last, 1 AS first FROM (SELECT item_id, unnest(['title', 'text']) AS f, unnest(['Item ' || item_id, trim(text)]) AS t FROM benchmark) WHERE regexp_matches(t, '\S')",
    "imported": f"WITH {TOK} SELECT doc_id, token_id, token, CAST(token_id - 1 AS INTEGER) AS parent FROM tok WHERE doc_id < 200",
    "morphology": f'WITH {TOK} SELECT doc_id, token_id, CASE WHEN length(token) > 3 THEN token[1] END AS "First", CASE WHEN length(token) > 3 THEN CAST(length(token) AS VARCHAR) END AS "Size", CAST(NULL AS VARCHAR) AS "None" FROM tok WHERE token_id <= 5',
    "whitespace": f"WITH {TOK} SELECT feature, count(*) AS n FROM (SELECT token || '_X' AS feature FROM tok) WHERE length(feature) BETWEEN 7 AND 15 AND regexp_matches(feature, '[\\p{{L}}\\p{{N}}]') GROUP BY feature",
    "trigrams": f"WITH {TOK}, g AS (SELECT doc_id, concat_ws('/', coalesce(lag(token, 2) OVER w, ''), coalesce(lag(token) OVER w, ''), token) AS feature FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY token_id)) SELECT feature, count(*) AS n FROM g GROUP BY feature HAVING count(DISTINCT doc_id) >= 2",
    "query_conditions": f"""WITH {TOK}, h AS (
SELECT 'early' AS code, doc_id FROM tok WHERE token = 'the' AND token_id <= 20
UNION ALL SELECT 'column', doc_id FROM tok WHERE token LIKE 'th%'
UNION ALL SELECT 'one', doc_id FROM tok WHERE regexp_full_match(token, 'th.?s')
UNION ALL SELECT 'meta', t.doc_id FROM tok t JOIN documents d ON t.doc_id = d.doc_id WHERE token = 'of' AND lang = 'en' AND d.doc_id < 100
UNION ALL SELECT 'word', doc_id FROM tok WHERE regexp_full_match(token, 'a.*d'))
SELECT code, count(*) AS n, count(DISTINCT doc_id) AS docs FROM h GROUP BY code""",
    "hit_codes": f"WITH {TOK} SELECT CASE WHEN token IN ('the', 'a', 'an') THEN 'article' ELSE 'link' END AS code, CASE WHEN token = 'the' THEN 'def' WHEN token IN ('a', 'an') THEN 'indef' END AS code_l2, count(*) AS n, count(*) AS ids FROM tok WHERE token IN ('the', 'a', 'an', 'of', 'and') GROUP BY 1, 2",
    "smoothed": f"WITH {TOK}, f AS (SELECT token, count(*) AS freq FROM tok GROUP BY token) SELECT token, freq, round((freq + 0.5) / (SELECT sum(freq + 0.5) FROM f), 9) AS p FROM f",
    "smoothed_in_languages": f"WITH {TOK}, f AS (SELECT lang, token, count(*) AS freq FROM tok JOIN documents USING (doc_id) GROUP BY lang, token) SELECT lang, token, round((freq + 0.5) / sum(freq + 0.5) OVER (PARTITION BY lang), 9) AS p FROM f",
    "marked_up": f"WITH {TOK}, d AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50) SELECT doc_id, '<p>' || string_agg(CASE WHEN length(token) > 9 THEN '<span style=\"background: rgba(255, 210, 0, 0.5)\">' || token || '</span> ' ELSE token || ' ' END, '' ORDER BY token_id) || '</p>' AS html FROM tok JOIN d USING (doc_id) GROUP BY doc_id",
    "word_cloud": f"WITH {TOK}, f AS (SELECT token AS feature, count(*) AS freq FROM tok GROUP BY token ORDER BY freq DESC, feature LIMIT 100) SELECT feature, freq, round(sqrt(freq) / sqrt((SELECT max(freq) FROM f)), 6) AS size FROM f",
}
