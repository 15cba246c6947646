"""What is done in the rows of the texts: no table of tokens is shuffled for it, and the results are those of the tokens."""

import re

import pytest
from pyspark.sql import functions as F
from textloom.corpus import Corpus
from textloom.operators import compare, dictionary, dtm, kwic, network, overlap, search, similarity
from textloom.plans import registry

TEXTS = ["b a b the end", "", "of the a a in the singing end", "a", "the the b of the ring in the in", "c b a"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(c):
    """The same corpus without the rows of its texts."""
    return Corpus(c.tokens, c.meta, c.model)


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_counts(corpus):
    c = corpus(TEXTS, words_only=True)
    assert "Exchange" not in plan(dtm.dtm(c))
    assert rows(dtm.dtm(c, weight="norm_tfidf")) == rows(dtm.dtm(plain(c), weight="norm_tfidf"))
    assert rows(dtm.feature_stats(c)) == rows(dtm.feature_stats(plain(c)))
    assert "Window" not in plan(dtm.feature_stats(c))
    assert rows(dtm.summed(c)) == rows(dtm.dtm(plain(c), weight="tfidf").groupBy("feature").agg(F.sum("value").alias("value")))


def test_token_tfidf(corpus):
    c = corpus(TEXTS, words_only=True)
    assert not re.search(r"Join \[doc_id", plan(overlap.add_tfidf(c, "token").tokens))
    assert rows(overlap.add_tfidf(c, "token").tokens) == rows(overlap.add_tfidf(plain(c), "token").tokens)


def test_doc_twice(corpus):
    c = corpus(TEXTS, ids=["x", "x", "x", "y", "y", "z"], words_only=True)
    assert c.words() is None and rows(dtm.dtm(c)) == rows(dtm.dtm(plain(c)))


@pytest.mark.parametrize(
    "make",
    [
        lambda c: search.search_features(c, ['near# "of the"~2', "i# in*"]),
        lambda c: search.search_features(c.set("start", F.substring("token", 1, 1)), "column# start: t", mode="features"),
        lambda c: search.subset_query(c, "the", window=1).tokens,
        lambda c: compare.feature_associations(c, "the", window=2, min_freq=0),
        lambda c: kwic.kwic(c, search.search_features(c, "the"), ntokens=2),
        lambda c: dictionary.code_dictionary(c, [{"string": "of the", "weight": 2}, {"string": "in", "weight": 1}], only_hits=True).tokens,
        lambda c: dictionary.replace_dictionary(c, ["of the", "in the", "the *ing"]).tokens,
        lambda c: dictionary.replace_dictionary(c, [{"string": "of the", "code": "X"}, {"string": "the", "code": None}], code_from_features_=True).tokens,
    ],
)
def test_places(corpus, make):
    c = corpus(TEXTS, words_only=True)
    assert not re.search(r"Join \[doc_id#\d+L?, token_id", plan(make(c)))
    assert rows(make(c)) == rows(make(plain(c)))


def test_languages_without_window(spark):
    df = registry.QUERIES["smoothed_in_languages"](spark, "/root/testdata/sf0.001")
    assert "Window" not in plan(df) and "SortMergeJoin" not in plan(df)


@pytest.mark.parametrize("bounds", [(2, 3), (None, 1), (4, None)])
def test_document_frequencies(corpus, bounds):
    c = corpus(TEXTS, words_only=True)
    kept = c.filter_freq("token", *bounds, docs=True)
    assert "Exchange" not in plan(kept.tokens)
    assert rows(kept.tokens) == rows(plain(c).filter_freq("token", *bounds, docs=True).tokens) and kept.n() > 0


@pytest.mark.parametrize("measure", ["chi2", "cosine", "con_prob", "count_directed"])
def test_pairs_are_counted_by_numbers(corpus, measure):
    c = corpus(TEXTS, words_only=True)
    e = network.semnet(c, measure=measure).edges
    assert "hashpartitioning(src" not in plan(e) and rows(e) == rows(network.semnet(plain(c), measure=measure).edges)


def test_copies_are_not_compared(corpus, monkeypatch):
    pairs, write = [], similarity.written

    def keep(df, name):
        df = write(df, name)
        if name == "pairs":
            pairs.append(df)
        return df

    monkeypatch.setattr(similarity, "written", keep)
    texts = ["a b c d e"] * 30 + ["c b a e d", "f g h", "f g i", "j"]
    left = similarity.deduplicate(corpus(texts, ids=[f"{k:02d}" for k in range(34)], words_only=True), similarity=0.9)
    assert sorted(r[0] for r in left.meta.select("doc_id").collect()) == ["00", "31", "33"] and pairs[0].count() <= 1
    last = similarity.duplicates(corpus(texts, ids=[f"{k:02d}" for k in range(34)], words_only=True), similarity=0.9, keep="last")
    assert sorted(r[0] for r in last.collect()) == [f"{k:02d}" for k in (*range(30), 31)]


def test_windows_are_counted_in_rows(corpus, monkeypatch):
    """No position and no edge is shuffled; texts are cut between documents, and sums are made in steps."""
    from textloom.operators import windows

    for name in ("AT_ONCE", "A_TASK", "RECORDS", "ROWS"):
        monkeypatch.setattr(windows, name, 4)
    c = corpus([*TEXTS, "a a a a b", " ", "a"], words_only=True)
    for size in (1, 3, 40):
        net = network.semnet_window(c, measure="count_directed", window=size)
        assert "Exchange" not in plan(net.edges) and rows(net.edges) == rows(network.semnet_window(plain(c), measure="count_directed", window=size).edges)
        assert rows(net.vertices) == rows(network.semnet_window(plain(c), measure="count_directed", window=size).vertices)
    none = network.semnet_window(corpus(["", "a"], words_only=True), measure="count_directed", window=2)
    assert rows(none.edges) == [] and rows(network.backbone_filter(none, 0.5).edges) == []


@pytest.mark.parametrize("alpha", [0.05, 0.5, 1.1])
def test_backbone_is_counted_in_rows(corpus, alpha):
    """The sums of the words go to the packed counts, and no edge is shuffled."""
    c = corpus(["the end of the ring"] * 9 + TEXTS + ["b a x y z a b end end ring"], words_only=True)
    net = network.semnet_window(c, measure="count_directed", window=2)
    e = network.backbone_filter(net, alpha, delete_isolates=False).edges
    old = network.semnet_window(plain(c), measure="count_directed", window=2)
    assert "Exchange" not in plan(e) and rows(e) == rows(network.backbone_filter(old, alpha).edges) and e.count() > 0
    few = network.replace(net, edges=net.edges.where("src <> 'a'"))
    assert rows(network.backbone_filter(few, alpha).edges) == rows(network.backbone_filter(network.replace(old, edges=old.edges.where("src <> 'a'")), alpha).edges)


def test_bags_are_made_once(corpus):
    """The tokens aren't gathered again, the model reads written bags, and the topics don't depend on how they came."""
    from textloom.operators import topics

    c = corpus(TEXTS * 5, words_only=True)
    made = [topics.lda(x, k=2, iterations=3, min_docfreq=2) for x in (c, plain(c))]
    assert "Exchange" not in plan(made[0].bags) and "Generate" not in plan(made[0].bags)
    assert made[0].bags.count() == sum(1 for t in TEXTS if t) * 5 and rows(made[0].terms(4)) == rows(made[1].terms(4))
    assert made[0].documents().count() == 2 * made[0].bags.count()
