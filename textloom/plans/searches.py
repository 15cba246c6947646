"""Queries of the query language, dictionaries, keywords in context."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import aggregate, dictionary, kwic, search
from textloom.plans._base import TOK, documents


def count_query(spark, sf):
    """In how many documents of each language ``the AND of`` holds."""
    c = documents(spark, sf)
    hits = search.search_contexts(c, "both# the AND of")
    return aggregate.count(c, ["lang"], hits, codes=["both"])


def contexts_boolean(spark, sf):
    """Documents for which Boolean queries hold, nested, with wildcards and conditions on the document."""
    return search.search_contexts(documents(spark, sf), ["a# (the AND of) NOT la", "b# th*ing OR (ent AND of)", "c# (the AND and)~[lang = 'de']"]).select("code", "doc_id")


def contexts_inverse(spark, sf):
    """Documents for which a query doesn't hold."""
    return search.search_contexts(documents(spark, sf), "the AND of", inverse=True).select("code", "doc_id")


def contexts_sequence(spark, sf):
    """Documents with a sequence of words, some by wildcard."""
    return search.search_contexts(documents(spark, sf), ['s# "of the"', 'w# "the *ing"']).select("code", "doc_id")


def features_proximity(spark, sf):
    """All words of a proximity query: ``of`` and ``and`` within 3 positions."""
    return search.search_features(documents(spark, sf), '"of and"~3', mode="features").select("code", "doc_id", "token_id", "feature")


def features_and(spark, sf):
    """All words for which a Boolean query holds; those of the ghost don't count."""
    return search.search_features(documents(spark, sf), "in* AND la~g", mode="features").select("code", "doc_id", "token_id", "feature")


def unique_hits(spark, sf):
    """Complete hits of a Boolean and of a directed proximity query, by document."""
    h = search.search_features(documents(spark, sf), ["both# the AND (of OR in)", 'near# "of the"~5d'])
    return h.groupBy("code", "doc_id").agg(F.count_distinct("hit_id").alias("hits"), F.count("*").alias("tokens"))


def hits_summary(spark, sf):
    """Hits and documents of single words, by query."""
    h = search.search_features(documents(spark, sf), ["the# the", "of# of", "num# <1* 2*>"])
    return search.summary(h).select("code", "hits", "documents")


def subset_by_query(spark, sf):
    """Tokens within 3 positions of a word, counted by document."""
    c = search.subset_query(documents(spark, sf), "whst", window=3)
    return c.tokens.groupBy("doc_id").agg(F.count("*").alias("n"))


def coded_tokens(spark, sf):
    """Tokens by the code of the first query that holds for them."""
    c = search.code_features(documents(spark, sf), ["ing# *ing", "th# th*"])
    return c.tokens.groupBy("code").agg(F.count("*").alias("n"))


def recoded(spark, sf):
    """Words after recoding all numbers to one value."""
    c = search.search_recode(documents(spark, sf), "token", "#number", "0* 1* 2* 3* 4* 5* 6* 7* 8* 9*")
    return c.tokens.groupBy("token").agg(F.count("*").alias("n"))


_DICT = [{"string": "of the", "code": "rel", "weight": 2}, {"string": "the", "code": "art", "weight": 1}, {"string": "in*", "code": "in", "weight": 3}]


def dictionary_hits(spark, sf):
    """All matches of a dictionary of words, expressions and wildcards."""
    h = dictionary.search_dictionary(documents(spark, sf), _DICT, mode="features")
    return h.select("code", "doc_id", "token_id", "feature").distinct()


def dictionary_scores(spark, sf):
    """The sum of a dictionary's weights, each hit once, by document."""
    c = dictionary.code_dictionary(documents(spark, sf), _DICT, only_hits=True)
    return aggregate.aggregate(c, ["doc_id"], id="code_id", hits=F.count("*"), weight=F.sum("weight"))


def keywords_in_context(spark, sf):
    """Each ``whst`` with 3 words on either side."""
    c = documents(spark, sf)
    return kwic.kwic(c, search.search_features(c, "whst"), ntokens=3).select("doc_id", "code", "feature", "kwic")


QUERIES = {f.__name__: f for f in (count_query, contexts_boolean, contexts_inverse, contexts_sequence, features_proximity, features_and, unique_hits, hits_summary, subset_by_query, coded_tokens, recoded, dictionary_hits, dictionary_scores, keywords_in_context)}

_NEXT = f"{TOK}, nx AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY token_id) AS nxt FROM tok)"
_WON = """hit AS (SELECT doc_id, token_id, 2 AS n, 0 AS k FROM nx WHERE token = 'of' AND nxt = 'the' UNION ALL SELECT doc_id, token_id, 1, 1 FROM nx WHERE token = 'the' UNION ALL SELECT doc_id, token_id, 1, 2 FROM nx WHERE token LIKE 'in%'),
won AS (SELECT h.* FROM hit h WHERE NOT (k = 1 AND EXISTS (SELECT 1 FROM hit o WHERE o.k = 0 AND o.doc_id = h.doc_id AND o.token_id = h.token_id - 1)))"""
ORACLE = {
    "count_query": f"WITH {TOK}, b AS (SELECT doc_id FROM tok WHERE token IN ('the', 'of') GROUP BY doc_id HAVING count(DISTINCT token) = 2), n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) SELECT lang, count(*) AS N, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS V, count(b.doc_id) AS both FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN b ON d.doc_id = b.doc_id GROUP BY lang",
    "contexts_boolean": f"""WITH {TOK}, f AS (SELECT doc_id, bool_or(token = 'the') AS the, bool_or(token = 'of') AS o, bool_or(token = 'la') AS la, bool_or(token = 'ent') AS ent, bool_or(token = 'and') AS a, bool_or(token LIKE 'th%ing') AS th FROM tok GROUP BY doc_id)
SELECT 'a' AS code, doc_id FROM f WHERE the AND o AND NOT la UNION ALL SELECT 'b', doc_id FROM f WHERE th OR (ent AND o) UNION ALL SELECT 'c', doc_id FROM f JOIN documents USING (doc_id) WHERE the AND a AND lang = 'de'""",
    "contexts_inverse": f"WITH {TOK}, b AS (SELECT doc_id FROM tok WHERE token IN ('the', 'of') GROUP BY doc_id HAVING count(DISTINCT token) = 2) SELECT 'query_1' AS code, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)",
    "contexts_sequence": f"WITH {_NEXT} SELECT DISTINCT 's' AS code, doc_id FROM nx WHERE token = 'of' AND nxt = 'the' UNION ALL SELECT DISTINCT 'w', doc_id FROM nx WHERE token = 'the' AND nxt LIKE '%ing'",
    "features_proximity": f"WITH {TOK}, h AS (SELECT * FROM tok WHERE token IN ('of', 'and')) SELECT DISTINCT 'query_1' AS code, x.doc_id, x.token_id, x.token AS feature FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.token <> y.token AND abs(x.token_id - y.token_id) <= 3 UNION SELECT 'query_1', x.doc_id, x.token_id, x.token FROM h x JOIN h a ON x.doc_id = a.doc_id AND x.token_id BETWEEN a.token_id AND a.token_id + 3 JOIN h y ON y.doc_id = a.doc_id AND y.token <> a.token AND y.token_id BETWEEN a.token_id AND a.token_id + 3",
    "features_and": f"WITH {TOK}, l AS (SELECT DISTINCT doc_id FROM tok WHERE token = 'la') SELECT 'query_1' AS code, doc_id, token_id, token AS feature FROM tok JOIN l USING (doc_id) WHERE token LIKE 'in%'",
    "hits_summary": f"WITH {_NEXT} SELECT token AS code, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM tok WHERE token IN ('the', 'of') GROUP BY token UNION ALL SELECT 'num', count(*), count(DISTINCT doc_id) FROM nx WHERE token LIKE '1%' AND nxt LIKE '2%' HAVING count(*) > 0",
    "subset_by_query": f"WITH {TOK}, h AS (SELECT * FROM tok WHERE token = 'whst') SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT t.doc_id, t.token_id FROM tok t JOIN h ON t.doc_id = h.doc_id AND abs(t.token_id - h.token_id) <= 3) GROUP BY doc_id",
    "coded_tokens": f"WITH {TOK} SELECT CASE WHEN token LIKE '%ing' THEN 'ing' WHEN token LIKE 'th%' THEN 'th' END AS code, count(*) AS n FROM tok GROUP BY 1",
    "recoded": f"WITH {TOK} SELECT CASE WHEN regexp_matches(token, '^[0-9]') THEN '#number' ELSE token END AS token, count(*) AS n FROM tok GROUP BY 1",
    "dictionary_hits": f"WITH {_NEXT} SELECT 'rel' AS code, doc_id, token_id, token AS feature FROM nx WHERE token = 'of' AND nxt = 'the' UNION SELECT 'rel', doc_id, token_id + 1, 'the' FROM nx WHERE token = 'of' AND nxt = 'the' UNION SELECT 'art', doc_id, token_id, token FROM tok WHERE token = 'the' UNION SELECT 'in', doc_id, token_id, token FROM tok WHERE token LIKE 'in%'",
    "dictionary_scores": f"WITH {_NEXT}, {_WON} SELECT doc_id, count(*) AS hits, CAST(sum(CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END) AS BIGINT) AS weight FROM won GROUP BY doc_id",
    "keywords_in_context": f"WITH {TOK}, h AS (SELECT doc_id, token_id AS k FROM tok WHERE token = 'whst') SELECT h.doc_id, 'query_1' AS code, 'whst' AS feature, '...' || string_agg(CASE WHEN t.token_id = h.k THEN '<' || t.token || '>' ELSE t.token END, ' ' ORDER BY t.token_id) || '...' AS kwic FROM h JOIN tok t ON t.doc_id = h.doc_id AND abs(t.token_id - h.k) <= 3 GROUP BY h.doc_id, h.k",
}
