"""PII: contextual extraction, bootstrapped from seed entities.

1. Mentions are the tokens with a digit or an ``@``, and those without that a
   recogniser knows; short groups of digits before a mention with a digit or an
   ``@`` are part of it (phone and card numbers with spaces). A mention's
   patterns are lexical: its shape (digits, letters and mixed runs by class and
   coarse length, other signs as they are), what stands before ``=`` or ``:``
   in it, the first letters of a mixed run, and the words left and right of it.
2. Strict recognisers mark seeds of seven kinds among the identifiers: e-mail,
   IPv4, phone, payment card (with check digit), social security number, access
   key and password.
3. Patterns and identifiers are a bipartite graph, scored in rounds. A pattern's
   confidence in a kind is the score of its identifiers of that kind over the
   score of its identifiers of any kind, plus ``unknown`` for each identifier that
   has none yet; it needs ``support`` identifiers of the kind. An identifier's
   score in a kind is 1 for a seed of the kind, else the noisy-or of its patterns
   with a confidence of ``least`` or more. Identifiers of ``accept`` or more count
   as known in the next round, so confident patterns find identifiers that no
   recogniser knows, and these strengthen further patterns. After the first three
   rounds they go on until one knows no identifier that none before it knew.

All documents are read once, whole; mentions and graph are written in the shared
folder, and each round is two joins and two sums in Spark.

Defined results: null and empty texts have no mentions. Rows that repeat a doc_id
are searched one by one, and each mention's row is given once for each (doc_id,
start, identifier). A null doc_id is kept as null. Of kinds with equal scores the
first by name is given. Without seeds there are no results. Extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm._common import only, written

ROUNDS, SUPPORT, LEAST, UNKNOWN, ACCEPT = 3, 3, 0.5, 0.05, 0.6

_MARK = re.compile(r"[0-9@]")
#: A mark, or what a seed without one has.
_START = re.compile(r"[0-9@]|(?:AKIA|ASIA)[A-Z]|gh[pousr]_|sk-|(?i:password|passwd|pwd|secret|api_key|token)[=:]")
_GROUP = re.compile(r"[+(]?[0-9]{1,4}\)?")
_RUN = re.compile(r"[^\W_]+", re.UNICODE)
_SPACE = re.compile(r"\s")
_EDGE = "\"'`.,;:!?<>[]{}"


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_SEEDS = [
    ("access_key", re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}")),
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("ip", re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")),
    ("password", re.compile(r"(?i)(?:password|passwd|pwd|secret|api_key|token)[=:]\S{6,}")),
    ("phone", re.compile(r"\+\d{1,3}[ -]\(?\d{2,4}\)?[ -]\d{3,4}[ -]\d{3,4}|\(\d{3}\) \d{3}-\d{4}")),
    ("ssn", re.compile(r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")),
]
KINDS = ("access_key", "card", "email", "ip", "password", "phone", "ssn")


def seed_kind(identifier: str) -> str | None:
    """The kind that a strict recogniser gives to the whole identifier."""
    for kind, rx in _SEEDS:
        if rx.fullmatch(identifier):
            return kind
    digits = identifier.replace(" ", "").replace("-", "")
    if 13 <= len(digits) <= 19 and digits.isascii() and digits.isdigit() and digits[0] in "3456" and _luhn(digits):
        return "card"
    return None


def _class(m: re.Match) -> str:
    run = m.group()
    if run.isdigit():
        return "d" if len(run) < 5 else "D" if len(run) < 9 else "N"
    if run.isalpha():
        return "a"
    return "x" if len(run) < 8 else "X"


def shape(identifier: str) -> str:
    return _RUN.sub(_class, identifier)


def patterns(identifier: str, left: str, right: str) -> list[str]:
    """The lexical patterns of a mention."""
    out = [f"shape {shape(identifier)}", f"left {left}", f"right {right}"]
    head = re.match(r"([^\W\d_]{2,})[=:]", identifier)
    if head:
        out.append(f"key {head.group(1).lower()}")
    mixed = re.match(r"([A-Z]{3,})[A-Z0-9]*\d[A-Z0-9]*$", identifier)
    if mixed:
        out.append(f"head {mixed.group(1)[:4]}")
    return out


def _inner(token: str) -> str:
    """A token without the signs around it."""
    inner = token.strip(_EDGE)
    return inner.rstrip(")" + _EDGE) if inner.endswith(")") and "(" not in inner else inner


def mentions(text: str) -> list[tuple[int, str, str, str]]:
    """(start, identifier, word to the left, word to the right) of every token with a digit or an @, or that is a seed."""
    spans: list[tuple[int, int, bool]] = []
    at, n = 0, len(text)
    while m := _START.search(text, at):
        a = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        stop = _SPACE.search(text, m.end())
        b = stop.start() if stop else n
        marked = _MARK.search(text, a, b) is not None
        if marked or seed_kind(_inner(text[a:b])):
            spans.append((a, b, marked))
        at = b
    merged: list[list[int]] = []
    open_ = False
    for a, b, marked in spans:
        if open_ and marked and a == merged[-1][1] + 1 and text[a - 1] == " ":
            merged[-1][1] = b
        else:
            merged.append([a, b])
        open_ = _GROUP.fullmatch(text, a, b) is not None
    out = []
    for a, b in merged:
        token = text[a:b]
        start = a + len(token) - len(token.lstrip(_EDGE))
        inner = _inner(token)
        if inner:
            before, after = text[max(0, a - 60) : a].split(), text[b : b + 60].split()
            out.append((start, inner, before[-1].strip(_EDGE).lower() if before else "", after[0].strip(_EDGE).lower() if after else ""))
    return out


_MENTIONS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("identifier", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for start, identifier, left, right in mentions(text.as_py() or ""):
                rows.append({"doc_id": doc, "start": start, "identifier": identifier, "kind": seed_kind(identifier), "patterns": patterns(identifier, left, right)})
        yield pa.RecordBatch.from_pylist(rows, schema=_MENTIONS)


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, support: int = SUPPORT, least: float = LEAST, unknown: float = UNKNOWN, accept: float = ACCEPT) -> DataFrame:
    """identifier, kind, score of the known identifiers, from distinct (pattern, identifier) and the seeds (identifier, kind).

    Without ``rounds``: at least ``ROUNDS``, and until no identifier is new.
    """
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    fixed = seeds.withColumn("score", F.lit(1.0))
    known, ever = fixed, fixed.select("identifier", "kind")
    for k in itertools.count(1) if rounds is None else range(1, rounds + 1):
        by_kind = edges.join(known, "identifier").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
        one = edges.join(known.select("identifier").distinct(), "identifier").groupBy("pattern").agg(F.count("*").alias("known"))
        whole = by_kind.groupBy("pattern").agg(F.sum("score").alias("all"))
        conf = by_kind.where(F.col("n") >= support).join(whole, "pattern").join(one, "pattern").join(size, "pattern")
        conf = conf.select("pattern", "kind", (F.col("score") / (F.col("all") + unknown * (F.col("size") - F.col("known")))).alias("conf")).where(F.col("conf") >= least)
        conf = written(conf, "patterns")
        new = edges.join(F.broadcast(conf) if conf.count() <= 100_000 else conf, "pattern").groupBy("identifier", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-9)))))).alias("score"))
        new = new.join(fixed.select("identifier"), "identifier", "left_anti").where(F.col("score") >= accept)
        known = written(fixed.unionByName(new), "known")
        if rounds is None:
            fresh = written(known.select("identifier", "kind").join(ever, ["identifier", "kind"], "left_anti"), "fresh")
            if k >= ROUNDS and not fresh.limit(1).count():
                break
            ever = ever.unionByName(fresh)
    return known


def find_pii(docs: DataFrame, **how) -> DataFrame:
    """doc_id, start, identifier, kind, score, seed (whether a recogniser knows it) of every mention of a known identifier."""
    found = only(docs, "doc_id", "text").where("text is not null").mapInArrow(_extract, "doc_id long, start int, identifier string, kind string, patterns array<string>")
    found = written(found, "mentions")
    edges = written(found.select(F.explode("patterns").alias("pattern"), "identifier").distinct(), "graph")
    seeds = written(found.where("kind is not null").select("identifier", "kind").distinct(), "seeds")
    known = score_graph(edges, seeds, **how)
    best = known.withColumn("nth", F.row_number().over(W.partitionBy("identifier").orderBy(F.desc(F.round("score", 9)), "kind"))).where("nth = 1")
    best = best.select("identifier", F.col("kind").alias("best"), F.round("score", 6).alias("score"))
    out = found.select("doc_id", "start", "identifier", F.col("kind").isNotNull().alias("seed")).distinct().join(best, "identifier")
    return out.select("doc_id", "start", "identifier", F.col("best").alias("kind"), "score", "seed")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_pii": op4_pii}
ORACLE: dict[str, str] = {}
