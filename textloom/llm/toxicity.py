"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

The text is folded: lower case, accents and invisible characters dropped,
homoglyphs (Cyrillic, Greek, full-width, mathematical letters) and digit or
sign substitutions (``1d10t``, ``$tup!d``) replaced by the letter they stand
for, anything else by one space between words; punctuation that ends a clause
stays as a word of its own that isn't counted, so no phrase spans it. Signs stand for letters only
before a letter, and ``!``, ``|`` and ``\u00a1`` only between letters, so ``idiot!``
and ``idiot$$$`` are ``idiot``. ``l`` and ``i`` fold to the same letter, as ``1``,
``|`` and ``!`` are used for both.

The lexicon has terms and stems (``term*``, any word that begins so). To those
given, ``learned`` adds stems and words of any language by a bounded sample of
labelled documents: those whose distinct contexts (the word and its neighbours,
so that copies of a document count once) are ``RATIO`` times as frequent in toxic
as in clean documents. The weight is half the decimal logarithm of that ratio,
at most 2.

The automaton finds all terms in one pass, words and phrases. A term that lies
within an exception phrase (``trash can``) doesn't count; of the terms that begin
at the same word the one of the highest weight counts. The score is the weight of
all hits per 1000 words; a document is rejected if it has at least ``min_weight``
of hits and at least ``threshold`` of score.

Defined results: a null or empty text scores 0 and is kept; a null ``doc_id``
is scored as any other row; repeated rows each have their own result; extra
columns are passed through by ``filter_toxic`` and ignored by ``toxicity``.
Labels with a null doc_id or a null ``toxic`` are ignored; of several labels of a
doc_id the highest holds. Without labels, or without toxic ones, nothing is
learned.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import only, written

#: Terms and weights: 1 for an insult, 2 for a strong one or contempt for a person, 3 for a threat or slur-like abuse.
LEXICON: dict[str, float] = {
    "idiot": 1, "idiots": 1, "idiotic": 1, "moron": 1, "morons": 1, "moronic": 1, "stupid": 1, "dumb": 1, "dumbass": 2,
    "loser": 1, "losers": 1, "trash": 1, "garbage": 1, "worthless": 1, "pathetic": 1, "disgusting": 1, "clown": 1, "clowns": 1,
    "scum": 2, "scumbag": 2, "vermin": 2, "imbecile": 1, "cretin": 1, "dimwit": 1, "halfwit": 1, "nitwit": 1, "jerk": 1,
    "creep": 1, "freak": 1, "pig": 1, "swine": 1, "filth": 1, "filthy": 1, "bastard": 2, "bastards": 2, "bitch": 2, "asshole": 2,
    "assholes": 2, "fuck": 2, "fucking": 2, "fucker": 2, "shit": 1, "shitty": 1, "bullshit": 1, "crap": 1, "degenerate": 1,
    "subhuman": 3, "parasite": 1, "retard": 2, "retarded": 2, "kill yourself": 3, "go die": 3, "hope you die": 3, "shut up": 1,
    "drop dead": 2, "piece of shit": 2, "waste of space": 2, "hate you": 1,
    "idioten": 1, "dummkopf": 1, "abschaum": 2, "arschloch": 2, "arschlocher": 2, "schwein": 1, "drecksau": 2, "scheisse": 1, "hurensohn": 2,
    "wichser": 2, "vollidiot": 1, "trottel": 1, "schwachkopf": 1, "missgeburt": 2, "untermensch": 3, "fotze": 2, "schlampe": 2, "halt die fresse": 2,
    "verpiss dich": 2, "bring dich um": 3, "idiota": 1, "idiotas": 1, "imbecil": 1, "estupido": 1, "estupida": 1, "basura": 1, "cabron": 2,
    "mierda": 1, "gilipollas": 2, "hijo de puta": 2, "puta": 2, "pendejo": 2, "maricon": 2, "escoria": 2, "callate": 1, "vete a la mierda": 2,
    "matate": 3, "connard": 2, "connasse": 2, "salaud": 2, "salope": 2, "ordure": 1, "debile": 1, "encule": 2, "batard": 2, "merde": 1,
    "pute": 2, "abruti": 1, "cretin": 1, "ta gueule": 2, "va te faire foutre": 2, "sous merde": 2, "va mourir": 3,
}
#: Phrases within which terms don't count.
EXCEPTIONS: tuple[str, ...] = (
    "trash can", "trash cans", "trash bin", "garbage can", "garbage collection", "garbage collector", "garbage truck", "clown fish", "clown car",
    "guinea pig", "guinea pigs", "pig iron", "idiot proof", "crap shoot", "stupid simple", "dumb terminal", "dumb luck", "filthy rich",
    "sore loser", "control freak", "scum line", "pond scum", "freak accident", "swine flu",
)
#: Rejected from this weight per 1000 words and this weight in all.
THRESHOLD, MIN_WEIGHT = 2.0, 2.0
#: Learning: at most so many labelled documents; the least number of contexts of a term in toxic ones, and how much more frequent it is there.
SAMPLE, SUPPORT, RATIO = 10_000, 8, 12.0
#: Letters of a learned stem.
STEM = (4, 8)


def _fold_table() -> dict[int, str]:
    """Code point to ``a-z``, or to '' for what is invisible; what is missing separates words."""
    table: dict[str, str] = {c: c for c in "abcdefghijklmnopqrstuvwxyz"}
    for c in map(chr, [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA), *range(0x2100, 0x2190)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalpha():
            table[c] = base.lower()
    table |= dict(zip("ßøłđħıœæðþ", "soldhioadt")) | dict(zip("ØŁĐĦŒÆÐÞ", "oldhoadt"))
    table |= dict(zip("абвгдеёзиіїйјклмнопрсѕтуўфхһцчшьыэюяԁԛԝԍ", "abbrdeeeiiiijklmhonpcstyyfxhcywbbeuqdqwg"))
    table |= dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "abydeznoikluvxonpotuoxyw"))
    for c in [*table]:
        up = c.upper()
        if len(up) == 1 and up not in table:
            table[up] = table[c]
    table |= dict(zip("АВЕЅІЈКМНОРСТУХ", "abesijkmhopctyx")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abezhikmnoptyx"))
    table |= dict.fromkeys(".,;:?…", ".") | dict(zip("01345789", "oieastbg")) | {"@": "@", "$": "$", "!": "!", "|": "!", "€": "€", "£": "£", "¡": "!"}
    table = {c: "i" if x == "l" else x for c, x in table.items()}
    for c in [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0xFE00, 0xFE10)]:
        table[chr(c)] = ""
    return {ord(c): x for c, x in table.items()}


class _Fold(dict):
    def __missing__(self, key: int) -> str:
        return " "


FOLD = _Fold(_fold_table())
_SIGN = re.compile("[$@€£!]")
_LOOSE = re.compile("[$@€£!]+(?![a-z$@€£!])|(?<![a-z$@€£])!+")
_LETTER = str.maketrans("$@€£!", "saeii")


def fold(text: str) -> str:
    """Folded words, with one space before, between and after them."""
    s = text.translate(FOLD)
    if _SIGN.search(s):
        s = _LOOSE.sub(lambda m: "." if "!" in m.group() else " ", s).translate(_LETTER)
    return f" {' '.join(s.replace('.', ' . ').split())} "


def _key(term: str) -> str:
    """What the automaton looks for: a stem is open at its end."""
    key = fold(term.removesuffix("*"))
    return key.rstrip() if term.endswith("*") else key


class Matcher:
    """The automaton over folded lexicon and exceptions."""

    def __init__(self, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        weights: dict[str, float] = {}
        for term, w in (LEXICON if lexicon is None else lexicon).items():
            weights[_key(term)] = max(w, weights.get(_key(term), 0))
        spare = {fold(x) for x in (EXCEPTIONS if exceptions is None else exceptions)} - {"  "}
        for nothing in ("  ", ""):
            weights.pop(nothing, None)
        for key in weights.keys() | spare:
            self.automaton.add_word(key, (len(key), weights.get(key, 0.0), key in spare))
        self.any = bool(len(self.automaton))
        if self.any:
            self.automaton.make_automaton()

    def score(self, text: str | None) -> tuple[float, int, int]:
        """Weight of the hits, their number, and the number of words."""
        s = fold(text or "")
        n = 0 if s == "  " else s.count(" ") - 1 - s.count(".")
        if not n or not self.any:
            return 0.0, 0, n
        found = [(end - size + 1, end, w, spare) for end, (size, w, spare) in self.automaton.iter(s)]
        if not found:
            return 0.0, 0, n
        safe = [(a, e) for a, e, _, spare in found if spare]
        hits: dict[int, float] = {}
        for a, e, w, _ in found:
            if w > hits.get(a, 0) and not any(x <= a and e <= y for x, y in safe):
                hits[a] = w
        return round(float(sum(hits.values())), 6), len(hits), n


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = SUPPORT, ratio: float = RATIO, lexicon: dict[str, float] | None = None) -> dict[str, float]:
    """``lexicon`` and the stems and words that are typical of documents labelled toxic.

    At most ``sample`` labelled documents are used, those with the least digests of
    their doc_id; all their words are. A word or stem is learned if it has
    ``support`` contexts in toxic documents, is ``ratio`` times as frequent there,
    and no shorter stem of it is learned.
    """
    lexicon = LEXICON if lexicon is None else lexicon
    order = F.md5(F.col("doc_id").cast("string"))
    marked = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(order, "doc_id").limit(sample)

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fold(t) for t in texts])

    d = only(docs, "doc_id", "text").where("text is not null").join(F.broadcast(marked), "doc_id").select("toxic", folded("text").alias("text"))
    words = d.select("toxic", F.filter(F.split("text", " "), lambda w: ~w.isin("", ".")).alias("w"))
    at = lambda k: F.coalesce(F.get("w", k), F.lit(""))
    context = F.explode(F.transform("w", lambda w, k: F.struct(at(k - 1).alias("left"), w.alias("word"), at(k + 1).alias("right"))))
    contexts = written(words.select("toxic", context.alias("c")).select("toxic", "c.*").distinct(), "contexts")
    total = {r["toxic"]: r["n"] for r in contexts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(1):
        return dict(lexicon)
    known = [fold(t).strip() for t in lexicon]
    stems = F.when(F.length("word") > STEM[0], F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("word") - 1)), lambda k: F.concat(F.substring("word", F.lit(1), k), F.lit("*")))).otherwise(F.array().cast("array<string>"))
    terms = contexts.where(~F.col("word").isin(known)).select("toxic", F.explode(F.concat(F.array("word"), stems)).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    rate = ((F.col("bad") + 0.5) / (total[1] + 1)) / ((F.col("good") + 0.5) / (total.get(0, 0) + 1))
    found = {r["term"]: r["ratio"] for r in counts.where(F.col("bad") >= support).select("term", rate.alias("ratio")).where(F.col("ratio") >= ratio).collect()}
    shorter = lambda t: any(f"{t[:k]}*" in found for k in range(STEM[0], len(t.removesuffix("*")) + (not t.endswith("*"))))
    return dict(lexicon) | {t: min(2.0, round(math.log10(x) / 2, 1)) for t, x in found.items() if not shorter(t)}


def scorer(lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None):
    """A pandas UDF: text to (weight, hits, words)."""

    @F.pandas_udf("weight double, hits int, words int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Matcher(lexicon, exceptions)
        for texts in batches:
            yield pd.DataFrame([m.score(t) for t in texts], columns=["weight", "hits", "words"]).astype({"weight": "float64", "hits": "int32", "words": "int32"})

    return score


def _per_mille(s):
    return s["weight"] * 1000 / F.greatest(s["words"], F.lit(1))


def toxicity(docs: DataFrame, threshold: float = THRESHOLD, min_weight: float = MIN_WEIGHT, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None) -> DataFrame:
    """The rejected documents: doc_id, weight, hits, words, score (weight per 1000 words)."""
    s = only(docs, "doc_id", "text").select("doc_id", scorer(lexicon, exceptions)("text").alias("s"))
    s = s.select("doc_id", F.col("s.weight").alias("weight"), F.col("s.hits").alias("hits"), F.col("s.words").alias("words"), F.round(_per_mille(F.col("s")), 6).alias("score"))
    return s.where((F.col("weight") >= min_weight) & (F.col("score") >= threshold))


def filter_toxic(docs: DataFrame, threshold: float = THRESHOLD, min_weight: float = MIN_WEIGHT, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` without the rejected documents; no shuffle, each row is judged where it is read."""
    s = F.col("__toxicity")
    out = docs.withColumn("__toxicity", scorer(lexicon, exceptions)("text"))
    return out.where(~((s["weight"] >= min_weight) & (F.round(_per_mille(s), 6) >= threshold))).drop("__toxicity")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, lexicon=learned(docs, labels))


def _sql() -> str:
    """DuckDB SQL for ``op8_toxicity``: words as rows, terms joined with them; the folding is written by SQL's own functions."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def folded(x: str) -> str:
        x = f"strip_accents(lower({x}))"
        x = f"regexp_replace({x}, '[\\x{{300}}-\\x{{36F}}\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
        x = f"translate({x}, {quote('01345789ßøłđœæðþ|¡' + 'абвгдеёзиіїйјклмнопрсѕтуўфхһцчшьыэюяԁԛԝԍ' + 'αβγδεζηθικλμνξοπρστυφχψω')}, {quote('oieastbgsoldoadt!!' + 'abbrdeeeiiiijklmhonpcstyyfxhcywbbeuqdqwg' + 'abydeznoikluvxonpotuoxyw')})"
        x = f"regexp_replace(regexp_replace({x}, '[.,;:?…]', '.', 'g'), '[^a-z$@€£!.]', ' ', 'g')"
        x = f"regexp_replace({x}, '[$@€£]*![$@€£!]*([ .]|$)', '.\\1', 'g')"
        x = f"regexp_replace({x}, '[$@€£]+([ .]|$)', ' \\1', 'g')"
        x = f"regexp_replace({x}, '(^|[ .])!+', '\\1.', 'g')"
        return f"trim(regexp_replace(regexp_replace(translate({x}, '$@€£!l', 'saeiii'), '[.]', ' . ', 'g'), ' +', ' ', 'g'))"

    terms = ", ".join(f"({quote(t)}, {float(w)})" for t, w in LEXICON.items())
    spare = ", ".join(f"({quote(t)})" for t in EXCEPTIONS)
    lo, hi = STEM
    return f"""
WITH base AS (SELECT term, max(weight) AS weight FROM (SELECT {folded('t')} AS term, w AS weight FROM (VALUES {terms}) v(t, w)) GROUP BY term),
spare AS (SELECT DISTINCT {folded('t')} AS term FROM (VALUES {spare}) v(t)),
docs AS (SELECT row_number() OVER () AS row, doc_id, w, list_filter(w, lambda x: x <> '.') AS v FROM (SELECT doc_id, CASE WHEN f = '' THEN [] ELSE string_split(f, ' ') END AS w FROM (SELECT doc_id, {folded("coalesce(text, '')")} AS f FROM documents))),
marked AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {SAMPLE}),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
near AS (SELECT row, k, word, lead(word) OVER o AS r, lead(word, 2) OVER o AS r2, lead(word, 3) OVER o AS r3, lead(word, 4) OVER o AS r4 FROM words WINDOW o AS (PARTITION BY row ORDER BY k)),
plain AS (SELECT row, toxic, unnest(v) AS word, generate_subscripts(v, 1) AS k FROM docs JOIN marked USING (doc_id)),
contexts AS (SELECT DISTINCT toxic, l, word, r FROM (SELECT toxic, word, lag(word) OVER o AS l, lead(word) OVER o AS r FROM plain WINDOW o AS (PARTITION BY row ORDER BY k))),
total AS (SELECT coalesce(sum(toxic), 0) AS bad, coalesce(sum(1 - toxic), 0) AS good FROM contexts),
parts AS (SELECT toxic, unnest([word || ' '] || list_transform(range({lo}, least({hi} + 1, length(word))), lambda k: word[1:k])) AS term FROM contexts WHERE word NOT IN (SELECT term FROM base)),
counts AS (SELECT term, sum(toxic) AS bad, sum(1 - toxic) AS good FROM parts GROUP BY term),
ratios AS (SELECT term, ((c.bad + 0.5) / (t.bad + 1)) / ((c.good + 0.5) / (t.good + 1)) AS ratio FROM counts c, total t WHERE c.bad >= {SUPPORT}),
found AS (SELECT term, ratio FROM ratios WHERE ratio >= {RATIO}),
stems AS (SELECT a.term, least(2.0, round(log10(a.ratio) / 2, 1)) AS weight FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.term <> a.term AND starts_with(a.term, b.term) AND NOT ends_with(b.term, ' '))),
grams AS (
  SELECT row, k, 1 AS n, word AS g FROM near UNION ALL SELECT row, k, 2, word || ' ' || r FROM near UNION ALL SELECT row, k, 3, concat_ws(' ', word, r, r2) FROM near WHERE r2 IS NOT NULL
  UNION ALL SELECT row, k, 4, concat_ws(' ', word, r, r2, r3) FROM near WHERE r3 IS NOT NULL UNION ALL SELECT row, k, 5, concat_ws(' ', word, r, r2, r3, r4) FROM near WHERE r4 IS NOT NULL),
hits AS (
  SELECT row, k, k + n - 1 AS e, weight FROM grams JOIN base ON g = term
  UNION ALL SELECT row, k, k, weight FROM words JOIN stems ON starts_with(word || ' ', term)),
safe AS (SELECT row, k, k + n - 1 AS e FROM grams JOIN spare ON g = term),
best AS (SELECT row, k, max(weight) AS weight FROM hits h WHERE NOT EXISTS (SELECT 1 FROM safe s WHERE s.row = h.row AND s.k <= h.k AND h.e <= s.e) GROUP BY row, k),
sums AS (SELECT row, round(CAST(sum(weight) AS DOUBLE), 6) AS weight, CAST(count(*) AS INTEGER) AS hits FROM best GROUP BY row)
SELECT doc_id, weight, hits, CAST(len(v) AS INTEGER) AS words, round(weight * 1000 / greatest(len(v), 1), 6) AS score FROM docs JOIN sums USING (row)
WHERE weight >= {MIN_WEIGHT} AND round(weight * 1000 / greatest(len(v), 1), 6) >= {THRESHOLD}"""


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE = {"op8_toxicity": _sql()}
