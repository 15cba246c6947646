"""Tree patterns, and what browsers show."""

from pyspark.sql import functions as F
from textloom.corpus import Corpus
from textloom.operators import annotate, dtm, present, search

ROWS = [
    (1, "Mary", "Mary", "PROPN", 2, "nsubj"), (2, "said", "say", "VERB", 0, "root"), (3, "that", "that", "SCONJ", 6, "mark"), (4, "John", "John", "PROPN", 6, "nsubj"),
    (5, "has", "have", "AUX", 6, "aux"), (6, "bought", "buy", "VERB", 2, "ccomp"), (7, "red", "red", "ADJ", 8, "amod"), (8, "apples", "apple", "NOUN", 6, "obj"), (9, "and", "and", "CCONJ", 10, "cc"), (10, "pears", "pear", "NOUN", 8, "conj"),
]


def parsed(spark):
    t = spark.createDataFrame([("d", 1, *r) for r in ROWS], "doc_id string, sentence int, token_id int, token string, lemma string, POS string, parent int, relation string")
    return Corpus(t, t.select("doc_id").distinct(), "parsed")


def by_token(c, column):
    return {r.token: r[column] for r in c.tokens.collect()}


def test_quotes_and_clauses(spark):
    c = annotate.annotate(parsed(spark), "quote", annotate.quote_patterns())
    got = by_token(c, "quote")
    assert got["Mary"] == "source" and got["said"] == "verb" and all(got[w] == "quote" for w in ("that", "John", "has", "bought", "red", "apples"))
    assert by_token(c, "quote_fill")["red"] == 2
    row = annotate.aggregate_annotation(c, "quote", text=True, n=("quote", F.count("*"))).first()
    assert row.source_txt == "Mary" and row.quote_txt.startswith("that John has bought red apples") and row.n == 8
    folded = annotate.fold(c, "quote", ["source"], who=F.first("token"))
    assert set(by_token(folded, "who").values()) == {"Mary"} and "Mary" not in by_token(folded, "who")
    clauses = by_token(annotate.annotate(parsed(spark), "clause", annotate.clause_patterns()), "clause")
    assert clauses["John"] == "subject" and clauses["bought"] == "verb" and clauses["apples"] == "predicate"


def test_transformations(spark):
    c = annotate.split_conjunctions(parsed(spark))
    assert by_token(c, "relation")["pears"] == "obj" and by_token(c, "parent")["pears"] == 6
    i = annotate.isolate(parsed(spark), ("ccomp",))
    assert by_token(i, "clause")["apples"] == 6 and by_token(i, "clause")["Mary"] == 2


def test_present(spark, corpus):
    c = corpus(["a <b> c", "d"])
    hits = search.search_features(c, "b")
    html = [r.html for r in present.browse_hits(c, hits).collect()]
    assert len(html) == 1 and "&lt;" in html[0] and "<span" in html[0]
    assert present.browse(c.set("x", "1.0"), highlight="x", n=1).count() == 1
    assert present.cloud(dtm.dtm(c), 3).count() == 3
