"""Comparison, networks, similarity, preprocessing: known sums and round trips."""

import pytest
from pyspark.sql import functions as F
from textloom.corpus import Corpus
from textloom.functions.stem import porter2
from textloom.functions.stats import simple_good_turing
from textloom.operators import compare, dtm, network, preprocessing, similarity
from textloom.sources import tables, texts

from tests.test_search import T3

Y3 = ["We are not talking about fuel again!", "There must be much more interesting things to discuss", "In the meantime, Mark Rutte is still simply Rutte"]


def total(df, column, places=2):
    return round(df.agg(F.sum(column)).first()[0], places)


def test_comparison(corpus):
    x, y = corpus(T3, split_sentences=True), corpus(Y3, split_sentences=True)
    assert total(compare.compare_corpus(x, y), "chi2", 3) == 2.215
    assert total(compare.compare_subset(x, query_x="rutte"), "chi2", 3) == 5.646
    assert total(compare.compare_subset(x, query_x="rutte", what="docfreq", smooth=0), "chi2", 3) == 4.809
    assert compare.compare_corpus(x, y, what="cooccurrence", smooth=0).count() > 0


@pytest.mark.parametrize("measure, weight", [("count_undirected", 44), ("cosine", 37.94), ("con_prob", 77.5), ("con_prob_weighted", 39.38), ("chi2", 36.35)])
def test_semnet(corpus, measure, weight):
    assert total(network.semnet(corpus(T3), measure=measure).edges, "weight") == weight


def test_window_backbone_ego(corpus):
    c = corpus(T3)
    assert network.semnet_window(c, measure="count_directed", window=10).edges.count() == 88
    assert network.semnet_window(c, measure="count_directed", window=5).edges.count() == 82
    assert network.backbone_filter(network.semnet(c, measure="cosine"), 0.5).edges.count() == 43
    e = network.ego(network.semnet(c, measure="chi2"), ["fuel", "fuels"], only_filter_vertices=False)
    assert {r.src for r in e.edges.collect()} == {"fuel", "fuels"}
    some = c.set("token", "case when lower(token) in ('rutte', 'renewable') then null else token end")
    assert "Rutte" not in {r.name for r in network.semnet(some, measure="count_undirected").vertices.collect()}


def test_similarity(corpus, spark):
    c = corpus(T3)
    assert similarity.compare_documents(c, measure="overlap_pct").count() == 4
    assert similarity.compare_documents(c, measure="overlap_pct", from_subset="doc_id = '1'").count() == 2
    dated = c.merge_meta(spark.createDataFrame([("1", "2010-01-01"), ("2", "2010-01-01"), ("3", "2012-01-01")], "doc_id string, date string"), ["doc_id"])
    assert similarity.compare_documents(dated, date_col="date", hour_window=(0, 36), measure="overlap_pct").count() == 2
    assert similarity.deduplicate(c, similarity=0.025).meta.count() == 1


def test_preprocess(corpus):
    c = preprocessing.preprocess(corpus(T3), use_stemming=True, ngrams=3)
    got = [r.feature for r in c.tokens.orderBy("doc_id", "token_id").collect()]
    assert got[:3] == ["//renew", "/renew/fuel", "renew/fuel/is"] and got[7] is None and got[13] == "//mark"
    assert [porter2(w) for w in ("running", "happily", "generously", "skies", "dying", "consolidation")] == ["run", "happili", "generous", "sky", "die", "consolid"]


def test_top_features_ties(corpus):
    assert dtm.top_features(corpus(["b b a a c"]), n=2).first()[1:] == ("a", "b")


def test_round_trip(spark):
    rows = [("a", "Title: one", "Two  spaces,\n a line."), ("b", "", "x"), ("c", "é ü", "")]
    d = spark.createDataFrame(rows, "doc_id string, title string, text string")
    u = {r.doc_id: r for r in texts.untokenize(texts.from_texts(d, ["title", "text"], remember_spaces=True)).collect()}
    assert u["a"].title == "Title: one" and u["a"].text == "Two  spaces,\n a line."


def test_merge(corpus):
    x, y = corpus(T3, list("abc")), corpus(Y3, list("cde"))
    with pytest.raises(ValueError):
        tables.merge([x, y])
    assert tables.merge([x, y], if_duplicate="drop").meta.count() == 5
    assert {r.doc_id for r in tables.merge([x, y], if_duplicate="rename").meta.collect()} == {"a", "b", "c", "c#D", "d", "e"}


def test_import(spark):
    t = spark.createDataFrame([(1, 1, 5, "x"), (1, 2, 5, "y"), (2, 1, 9, "z")], "document int, sent int, id int, word string")
    c = tables.from_tokens(t, "document", "id", "word", "sent")
    assert sorted(tuple(r) for r in c.tokens.select("doc_id", "token_id", "sentence", "token").collect()) == [(1, 1, 1, "x"), (1, 2, 2, "y"), (2, 1, 1, "z")]
    with pytest.raises(ValueError):
        Corpus(c.tokens.unionByName(c.tokens), c.meta).validate()


def test_good_turing():
    p = simple_good_turing([1] * 10 + [2] * 5 + [3] * 3 + [5, 8])
    assert p and all(0 < v < 1 for v in p.values()) and p[8] > p[1]
