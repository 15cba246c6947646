"""Column functions on text: tokens, sentences, normalisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: A token by Unicode word boundaries, close to UAX 29: words with inner apostrophes or dots, numbers with inner marks, other signs one by one.
TOKEN = (
    r"[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*"
    r"(?:(?:(?<=[\p{L}\p{M}])[.'’:·](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))[\p{L}\p{N}_][\p{L}\p{N}\p{M}_]*)*"
    r"|[^\s]"
)
#: Words alone, as SQL engines have them too.
WORD = r"[\p{L}\p{N}]+"
#: The end of a sentence, with the white space after it: closing marks before white space that no lower-case letter follows, or a line's end.
SENTENCE_END = r"(?:[.!?…]+[\"'’”)\]]*\s+(?=[^\s\p{Ll}])|\s*\n\s*)"


def tokens(text: Column | str, pattern: str = TOKEN) -> Column:
    """Array of the tokens."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(0))


def words(text: Column | str) -> Column:
    """Array of lower-case words."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(WORD), F.lit(0))


def split_text(text: str, sentences: bool = False, max_tokens: int | None = None, max_sentences: int | None = None) -> Iterator[tuple[int, int, str, str, int, int]]:
    """(sentence, token_id, token, space, start, end) of each token; offsets are 1-based, ``space`` is the white space after it."""
    import regex

    token, stop = regex.compile(TOKEN), regex.compile(SENTENCE_END)
    begins = [0, *(m.end() for m in stop.finditer(text))] if sentences else [0]
    found = token.finditer(text)
    s = n = 0
    used = 0
    m = next(found, None)
    while m is not None:
        moved = False
        while s + 1 < len(begins) and begins[s + 1] <= m.start():
            s, moved = s + 1, True
        if n == 0 or moved:
            used += 1
        if max_sentences and used > max_sentences:
            break
        n += 1
        if max_tokens and n > max_tokens:
            break
        later = next(found, None)
        yield used, n, m.group(), text[m.end() : later.start() if later else len(text)], m.start() + 1, m.end()
        m = later


#: Tokens in a batch that goes from Python to the JVM.
TOKENS_A_BATCH = 20_000


def split(df: DataFrame, column: str, sentences: bool, max_tokens: int | None, max_sentences: int | None, size: int = TOKENS_A_BATCH) -> DataFrame:
    """A row for each token by ``split_text``, with the other columns. Neither side holds more than ``size`` tokens at once."""
    kept = [c for c in df.columns if c != column]
    kind = [("sentence", pa.int32()), ("token_id", pa.int32()), ("token", pa.string()), ("space", pa.string()), ("start", pa.int32()), ("end", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.select(kept)
            rows, found = [], []

            def out() -> pa.RecordBatch:
                b = others.take(pa.array(rows, pa.int32()))
                arrays = [pa.array(x, t) for x, (_, t) in zip(zip(*found), kind)]
                return pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*kept, *(n for n, _ in kind)])

            for k, text in enumerate(batch.column(column)):
                for t in split_text(text.as_py(), sentences, max_tokens, max_sentences):
                    rows.append(k)
                    found.append(t)
                    if len(found) >= size:
                        yield out()
                        rows, found = [], []
            if found:
                yield out()

    fields = StructType([*df.select(*kept).schema.fields, *(StructField(n, StringType() if t == pa.string() else IntegerType()) for n, t in kind)])
    return df.mapInArrow(run, fields)


@F.pandas_udf(StringType())
def as_ascii(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Latin letters without accents and their like; what has no ASCII form is dropped."""
    special = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ð": "d", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})
    for s in values:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.translate(special)).encode("ascii", "ignore").decode())


def keep_kind(x: Column, punctuation: bool, numbers: bool) -> Column:
    """``x``, or null if it has only signs (``punctuation``), only digits (``numbers``), or only either."""
    if punctuation and numbers:
        return F.when(x.rlike(r"\p{L}"), x)
    if punctuation:
        return F.when(x.rlike(r"[\p{L}\p{N}]"), x)
    if numbers:
        return F.when(x.rlike(r"[^\p{N}\s]"), x)
    return x


def wildcard_regex(term: str) -> str:
    """Anchored regular expression of a term with ``*`` (any characters), ``?`` (one or none) and backslash escapes."""
    out, k = [], 0
    while k < len(term):
        c = term[k]
        if c == "\\" and k + 1 < len(term):
            k += 1
            out.append(re.escape(term[k]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".?")
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def has_wildcard(term: str) -> bool:
    return re.search(r"(?<!\\)[*?]", term) is not None


def unescaped(term: str) -> str:
    return re.sub(r"\\(.)", r"\1", term)
