"""Search, dictionaries and keywords in context on small texts with known results."""

import random

import pytest
from textloom.operators import aggregate, dictionary, greedy, kwic, query, search

T3 = ["Renewable fuel is better than fossil fuels!", "A fueled debate about fuel", "Mark Rutte is simply Rutte"]
CONTEXTS = [T3[0], T3[1], "Mark Rutte is just Rutte. Bos, by contrast, is at most times not Wouter", "Hey, A ~ symbol!! Can I match that?"]


def features(c, q, **how):
    return [r.feature for r in search.search_features(c, q, **how).orderBy("doc_id", "token_id").collect()]


def test_features(corpus):
    c = corpus(T3, list("abc"), split_sentences=True)
    wanted = {
        '"renewable fuel" AND better': ["Renewable", "fuel", "better"], "fuel": ["fuel", "fuel"], '"a fueled debate"': ["A", "fueled", "debate"], '"renewable fuels"~10': ["Renewable", "fuels"],
        '"renewable fuels"~2': [], "fuel fuels": ["fuel", "fuels", "fuel"], "fuel*": ["fuel", "fuels", "fueled", "fuel"], "fue?s": ["fuels"], "Rutte~s": ["Rutte", "Rutte"], "rutte~s": [],
        "fuel* AND (renewable green clean)": ["Renewable", "fuel"], "fuel* AND (green~g renewable~g clean~g)": ["fuel", "fuels"], "fuel* AND (renewable green clean)~g": ["fuel", "fuels"],
        'fuel AND ("a debate"~4 OR "renewable fuel")~g': ["fuel", "fuel"], '"mark rutte"~10': ["Mark", "Rutte"],
    }
    hits = search.search_features(c, list(wanted), codes=list(wanted)).orderBy("doc_id", "token_id").collect()
    for q, words in wanted.items():
        assert [r.feature for r in hits if r.code == q] == words, q
    assert features(c, "fuel* AND (renewable green clean)", mode="features") == ["Renewable", "fuel", "fuels"]
    assert features(c, '"mark rutte"~10', mode="features") == ["Mark", "Rutte", "Rutte"]
    assert aggregate.count(c, hits=search.search_features(c, ["fuel", "mark"]), what="hits").collect() == [("total", 3, 18, 2, 1)]


def test_unique_and_ghosts(corpus):
    c = corpus(["A B C"])
    assert features(c, "A AND (B C)", mode="features") == ["A", "B", "C"]
    assert features(c, "(B C) AND A") == ["A", "B"]
    assert features(c, "(B C) AND A~g") == ["B", "C"]
    assert features(c, "A~g AND (B C)") == ["B", "C"]
    b = corpus(["mr. bob smith"])
    assert len(features(b, 'Bob OR "bob smith"')) == 2
    assert len(features(b, 'Bob OR "bob smith"', keep_longest=False)) == 1


def test_contexts(corpus):
    c = corpus(CONTEXTS, list("abcd"), split_sentences=True)

    def contexts(q, level="document", **how):
        return sorted((r.doc_id, r.sentence) for r in search.search_contexts(c, q, context_level=level, **how).collect())

    assert contexts("mark AND rutte") == [("c", None)]
    assert [d for d, _ in contexts("mark AND rutte", inverse=True)] == ["a", "b", "d"]
    assert contexts('"mark rutte"', "sentence") == [("c", 1)]
    assert [s for _, s in contexts('"mark rutte"', "sentence", inverse=True)] == [1, 1, 2, 1, 2]
    number = {'"rutte bos"~5': (1, 0), "wouter AND bos": (1, 1), "wouter NOT bos": (0, 0), "wouter NOT (bos OR banaan)": (0, 0), "wouter NOT (bos AND banaan)": (1, 1), "bos~s": (0, 0), "Bos~s": (1, 1), '"wouter bos"~10s': (0, 0), '"Wouter Bos"~s10': (1, 1), '"bos wouter"~5': (None, 0), '"bos wouter"~10': (None, 1), 'wouter NOT "bos wouter"~10': (None, 0), 'wouter NOT "bos wouter"~3': (None, 1)}
    for k, level in enumerate(("document", "sentence")):
        found = search.search_contexts(c, list(number), codes=list(number), context_level=level).collect()
        for q, n in number.items():
            assert n[k] is None or sum(r.code == q for r in found) == n[k], (q, level)
    assert [r.doc_id for r in search.search_features(c, "!").orderBy("doc_id", "token_id").collect()] == ["a", "d", "d"]
    sub = search.subset_query(c, '"mark rutte"~2', context_level="sentence")
    assert [r.doc_id for r in sub.meta.collect()] == ["c"]


def test_conditions_and_columns(corpus, spark):
    c = corpus(T3, list("abc")).set("upper", "upper(token)").merge_meta(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "doc_id string, year int"), ["doc_id"])
    assert features(c, "fuel~[year = 2]") == ["fuel"]
    assert features(c, "fuel*~{token_id > 2}") == ["fuels", "fuel"]
    assert features(c, "upper: RUTTE~s") == ["Rutte", "Rutte"]


def test_kwic(corpus):
    c = corpus(T3, list("abc"), split_sentences=True)
    assert [r.kwic for r in kwic.kwic(c, query="better", ntokens=2).collect()] == ["...fuel is <better> than fossil..."]
    row = kwic.kwic(c, query='"renewable fuels"~10', ntokens=2).first()
    assert row.feature == "Renewable -> fuels" and "[...]" in row.kwic


def test_dictionaries(corpus):
    c = corpus(["this is a test", "This town is not big enough for a test"])
    coded = dictionary.code_dictionary(c, ["this is", "a", "test"]).tokens.orderBy("doc_id", "token_id").collect()
    assert [r.code_id for r in coded] == [1, 1, 2, 3] + [None] * 7 + [1, 2]
    hits = dictionary.search_dictionary(c, [{"string": "this is", "code": "a"}, {"string": "a", "code": "b"}, {"string": "test", "code": "c"}])
    assert [r.token_id for r in hits.orderBy("doc_id", "token_id").collect()] == [1, 2, 3, 4, 8, 9]
    y = corpus(["yay :) :* happy.", "boo sad :("])
    assert [r.token for r in dictionary.replace_dictionary(y, [":)", ":\\*", ":("]).tokens.orderBy("doc_id", "token_id").collect()] == ["yay", ":)", ":*", "happy", ".", "boo", "sad", ":("]


def test_spacing_of_signs(corpus):
    c = corpus(["Some good, the bad and an ugly, is nice : ) but not pretty :("], split_sentences=True)
    c = dictionary.replace_dictionary(c, {":(": ": (", "the_bad": "the bad"})
    scores = [{"string": s, "sentiment": v} for s, v in [("good", 1), ("bad", -1), ("ugl*", -1), ("nice", 1), ("not pret*", -1), (":)", 1), (": (", -1)]]
    got = [r.sentiment for r in dictionary.code_dictionary(c, scores).tokens.orderBy("token_id").collect()]
    assert got == [None, 1, None, -1, None, None, -1, None, None, 1, 1, 1, None, -1, -1, -1]
    coded = search.code_features(c, ["happy# \\:\\)", "sad# \\:\\("])
    assert [r.code for r in coded.tokens.orderBy("token_id").collect() if r.code] == ["happy", "happy", "sad"]


@pytest.mark.parametrize("bad", ["a AND b OR c", "(a", 'a"', "AND a", "a AND", "a NOT b NOT c", '"a AND b"', "x)", "(a AND b)~{x", '"a "b c"~3"~5', '<a <b c>~3>~5', "a AND AND b"])
def test_errors(bad):
    with pytest.raises(query.QueryError):
        query.parse(bad)


def test_labels():
    assert query.labelled(["x# a b", "c", "d"]) == [("x", "a b"), ("query_1", "c"), ("query_2", "d")]
    with pytest.raises(query.QueryError):
        query.labelled(["x# a", "x# b"])


def test_features_include_unique():
    """What is in a complete hit is in the features too, for queries without ghosts."""
    rng = random.Random(1)
    for text in ['a AND b', '"a b"~3', '(a b) AND c', 'a AND ("b c"~2)', '<(a b) c>', 'a OR b']:
        x = query.parse(text)
        for k, leaf in enumerate(query.leaves(x)):
            leaf.number = k
        for _ in range(50):
            words = [rng.choice("abcd") for _ in range(12)]
            found = {leaf.number: [(None, p, 1) for p, w in enumerate(words) if w in leaf.terms] for leaf in query.leaves(x)}
            unique = {r.at for r in greedy.evaluate(x, found, False)}
            assert unique <= {r.at for r in greedy.evaluate(x, found, True)}
