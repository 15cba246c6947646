"""Patterns over dependency trees: tokens with ``parent`` (a token_id of the sentence, or null or 0 at a root) and ``relation``.

A pattern is a tree of nodes; a node has a condition, maybe a label, and children or
parents that must be (or must not be) there. Matching is one self-join by (document,
sentence, parent) for each edge of the pattern, so it is a plan and not a loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.corpus import Condition, Corpus, expr

_KEY = ["doc_id", "sentence"]


@dataclass(frozen=True)
class Node:
    """``where``: condition on the token; ``label``: what a match is called; ``required``: without it there is no match."""

    where: Condition = "true"
    label: str | None = None
    children: tuple[Node, ...] = ()
    parents: tuple[Node, ...] = ()
    without_children: tuple[Condition, ...] = ()
    required: bool = True
    fill: bool = True


@dataclass
class _Names:
    used: list[tuple[str, Node]] = field(default_factory=list)

    def new(self, node: Node) -> str:
        self.used.append((f"__n{len(self.used)}", node))
        return self.used[-1][0]


def _rows(t: DataFrame, where: Condition, at: str, parent: str) -> DataFrame:
    return t.where(F.coalesce(expr(where), F.lit(False))).select(*_KEY, F.col("token_id").alias(at), F.col("parent").alias(parent))


def _matched(t: DataFrame, node: Node, names: _Names) -> tuple[DataFrame, str]:
    """doc_id, sentence and a column of token ids for each node of the pattern."""
    at = names.new(node)
    m = _rows(t, node.where, at, f"{at}_p")
    for bad in node.without_children:
        other = _rows(t, bad, "__c", "__p")
        m = m.join(other, [m[k] == other[k] for k in _KEY] + [m[at] == other["__p"]], "left_anti")
    for child, down in [*((c, True) for c in node.children), *((c, False) for c in node.parents)]:
        s, own = _matched(t, child, names)
        s = s.withColumnsRenamed({k: f"__{k}" for k in _KEY})
        edge = (F.col(f"{own}_p") == F.col(at)) if down else (F.col(f"{at}_p") == F.col(own))
        on = [F.col(k) == F.col(f"__{k}") for k in _KEY] + [edge]
        m = m.join(s, on, "inner" if child.required else "left").drop(*[f"__{k}" for k in _KEY])
    return m, at


def matches(t: DataFrame, pattern: Node) -> DataFrame:
    """doc_id, sentence, match (the root's token_id), label, token_id, fill (0): a row for each labelled token of each match."""
    names = _Names()
    m, root = _matched(t, pattern, names)
    labelled = [F.struct(F.lit(n.label).alias("label"), F.col(c).alias("token_id"), F.lit(n.fill).alias("fills")) for c, n in names.used if n.label]
    out = m.select(*_KEY, F.col(root).alias("match"), F.explode(F.array(*labelled)).alias("x")).select(*_KEY, "match", "x.*")
    return out.where("token_id is not null").distinct()


def annotate(corpus: Corpus, column: str, patterns: dict[str, Node], fill: bool = True, depth: int = 20, overwrite: bool = True) -> Corpus:
    """Adds ``column`` (label), ``column_id`` (match) and ``column_fill`` (distance from the labelled token).

    A token has one label: that of the first pattern, then of the first match by
    position. With ``fill`` descendants of a labelled token that have no label get
    its, from the nearest; ``depth`` bounds the distance.
    """
    if not corpus.has_sentences:
        raise ValueError("patterns need sentences")
    if column in corpus.tokens.columns and not overwrite:
        raise ValueError(f"the column {column} is there already")
    t = corpus.tokens.drop(column, f"{column}_id", f"{column}_fill")
    found = None
    for k, (name, pattern) in enumerate(patterns.items()):
        m = matches(t, pattern).withColumns({"__k": F.lit(k), "__name": F.lit(name)})
        found = m if found is None else found.unionByName(m)
    first = W.partitionBy(*_KEY, "token_id").orderBy("__k", "match", "label")
    own = found.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    own = own.select(*_KEY, "token_id", "label", F.concat_ws(".", F.col("doc_id").cast("string"), F.col("sentence").cast("string"), F.col("match").cast("string"), "__name").alias("id"), "fills")
    t = t.join(own, [*_KEY, "token_id"], "left")
    names = {"label": column, "id": f"{column}_id", "fill": f"{column}_fill"}
    if not fill:
        t = t.withColumn("fill", F.when(F.col("label").isNotNull(), 0)).drop("fills")
        return Corpus(t.withColumnsRenamed(names), corpus.meta, corpus.model)
    below = _by_sentence(t, ["token_id", "parent", "label", "id", "fills"], _filled(depth), "token_id int, label string, id string, fill int")
    t = t.drop("label", "id", "fills").join(below, [*_KEY, "token_id"], "left")
    return Corpus(t.withColumnsRenamed(names), corpus.meta, corpus.model)


def _by_sentence(t: DataFrame, columns: list[str], work: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Runs ``work`` on the rows of each sentence, which are few, in Arrow batches; its tuples are rows of ``schema``."""
    kinds = {f.name: f.dataType.simpleString() for f in t.select(*_KEY).schema.fields}
    rows = t.groupBy(*_KEY).agg(F.collect_list(F.struct(*[F.col(c) for c in columns])).alias("rows"))
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32() if x.split()[1] == "int" else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for k, own in enumerate(batch.column(2).to_pylist()):
                found = work(own)
                out += found
                of += [k] * len(found)
            take = pa.array(of, type=pa.int64())
            cols = [pa.array([r[j] for r in out], type=x) for j, x in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *cols], names=[*_KEY, *names])

    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", " + schema)


def _filled(depth: int) -> Callable[[list[dict]], list[tuple]]:
    """A token without a label has that of its nearest labelled ancestor, if that fills and is within ``depth``."""

    def work(rows: list[dict]) -> list[tuple]:
        by = {r["token_id"]: r for r in rows}
        out = []
        for r in rows:
            at, far = r, 0
            while at is not None and at["label"] is None and far < depth:
                at, far = by.get(at["parent"]), far + 1
            if at is not None and at["label"] is not None and (far == 0 or at["fills"]):
                out.append((r["token_id"], at["label"], at["id"], far))
        return out

    return work


def _text() -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token_id", "token"))), lambda x: x["token"]), " ")


def aggregate_annotation(corpus: Corpus, column: str, by: list[str] | None = None, text: bool | list[str] = False, labels: list[str] | None = None, **aggregates: tuple[str, Column | str]) -> DataFrame:
    """One row for each match: aggregates of the tokens with a label (name = (label, expression)) and ``<label>_txt``."""
    t = corpus.tokens.where(F.col(f"{column}_id").isNotNull())
    labels = labels or sorted(r[0] for r in t.select(column).distinct().collect() if r[0] is not None)
    keys = [*_KEY, f"{column}_id", *(by or [])]
    out = t.select(*keys).distinct()
    for label in labels:
        own = [expr(x).alias(name) for name, (of, x) in aggregates.items() if of == label]
        if text is True or (text and label in text):
            own.append(_text().alias(f"{label}_txt"))
        if own:
            out = out.join(t.where(F.col(column) == label).groupBy(*keys).agg(*own), keys, "left")
    return out


def fold(corpus: Corpus, column: str, labels: list[str], text: bool = False, drop: bool = True, **aggregates: Column | str) -> Corpus:
    """Aggregates the tokens with some labels to columns of the other tokens of their match."""
    keys = [*_KEY, f"{column}_id"]
    own = corpus.tokens.where(F.col(column).isin(labels))
    aggs = [expr(x).alias(name) for name, x in aggregates.items()]
    if text:
        aggs.append(_text().alias("_".join(labels) + "_txt"))
    a = own.groupBy(*keys).agg(*aggs)
    t = corpus.tokens.where(~F.coalesce(F.col(column).isin(labels), F.lit(False))) if drop else corpus.tokens
    return Corpus(t.join(a, keys, "left"), corpus.meta, corpus.model)


def clause_patterns() -> dict[str, Node]:
    """Subject, verb and predicate by universal dependencies: active, passive, copula."""
    subject = Node("relation in ('nsubj', 'csubj')", "subject")
    passive = Node("relation in ('nsubj:pass', 'nsubjpass')", "predicate")
    agent = Node("relation in ('obl:agent', 'obl', 'nmod')", "subject", children=(Node("relation = 'case' and lower(token) = 'by'"),))
    return {
        "passive": Node("POS like 'V%'", "verb", children=(passive, agent)),
        "active": Node("POS like 'V%'", "verb", children=(subject, Node("relation in ('obj', 'dobj', 'xcomp', 'obl')", "predicate", required=False))),
        "copula": Node("true", "predicate", children=(subject, Node("relation = 'cop'", "verb"))),
    }


SAY = ("acknowledge", "add", "admit", "affirm", "announce", "argue", "ask", "assert", "believe", "claim", "comment", "conclude", "confirm", "declare", "deny", "emphasize", "explain", "insist", "mention", "note", "observe", "promise", "remark", "repeat", "reply", "report", "say", "state", "stress", "suggest", "warn", "think", "tell", "write")


def quote_patterns(verbs: tuple[str, ...] = SAY) -> dict[str, Node]:
    """Source, verb and quote of reported speech."""
    say = "lemma in (" + ", ".join(f"'{v}'" for v in verbs) + ")"
    source = Node("relation in ('nsubj', 'nsubj:pass')", "source")
    return {
        "complement": Node(say, "verb", children=(source, Node("relation in ('ccomp', 'parataxis')", "quote"))),
        "inverted": Node("relation <> 'nsubj'", "quote", children=(Node(f"relation = 'parataxis' and {say}", "verb", children=(source,)),)),
        "according": Node("true", "quote", children=(Node("relation in ('obl', 'nmod')", "source", children=(Node("relation = 'case' and lower(token) = 'according'"),)),)),
    }


def split_conjunctions(corpus: Corpus, rounds: int = 3, relation: str = "conj") -> Corpus:
    """A conjunct gets its head's relation and parent, so ``a and b run`` has two subjects; ``rounds`` bounds chains."""
    t = corpus.tokens
    for _ in range(rounds):
        h = t.select(*_KEY, F.col("token_id").alias("parent"), F.col("parent").alias("__p"), F.col("relation").alias("__r"))
        t = t.join(h, [*_KEY, "parent"], "left")
        ok = (F.col("relation") == relation) & (F.col("__r") != relation) & F.col("__p").isNotNull()
        t = t.withColumns({"parent": F.when(ok, F.col("__p")).otherwise(F.col("parent")), "relation": F.when(ok, F.col("__r")).otherwise(F.col("relation"))}).drop("__p", "__r")
    return Corpus(t.select(*corpus.tokens.columns), corpus.meta, corpus.model)


def isolate(corpus: Corpus, relations: tuple[str, ...] = ("acl:relcl", "advcl", "parataxis", "appos"), depth: int = 40) -> Corpus:
    """Cuts subordinate clauses off: their heads become roots, and ``clause`` is the root that each token hangs under."""
    t = corpus.tokens
    cut = F.col("relation").isin(*relations)
    t = t.withColumns({"parent": F.when(~cut, F.col("parent")), "relation": F.when(cut, F.lit("ROOT")).otherwise(F.col("relation"))})
    roots = _by_sentence(t, ["token_id", "parent"], _roots(depth), "token_id int, clause int")
    return Corpus(t.join(roots, [*_KEY, "token_id"], "left"), corpus.meta, corpus.model)


def _roots(depth: int) -> Callable[[list[dict]], list[tuple]]:
    def work(rows: list[dict]) -> list[tuple]:
        parent = {r["token_id"]: r["parent"] for r in rows}
        out = []
        for at in parent:
            up, far = at, 0
            while parent.get(up) in parent and far < depth:
                up, far = parent[up], far + 1
            out.append((at, up))
        return out

    return work
