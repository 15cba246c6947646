"""Chat formatting in budgeted windows.

A conversation is cut into training windows of at most ``budget`` tokens, by
prefix sums of its turns' tokens:

* a window is a span of whole turns; a turn is never cut;
* leading system turns are repeated in every window and count in its budget;
* a window begins with history: the longest suffix of the turns before it that
  has at most ``history`` tokens and leaves room for the window's first new turn;
* the targets are the assistant's turns; one that is repeated as history is
  masked, so each is trained on once.

The tokens of a turn are those of its rendering, ``<|role|>\\n text \\n``, in the
byte-level BPE vocabulary at ``tokenizer`` (a .tiktoken file).

One shuffle brings a conversation's turns together; the search for the spans is
a binary search on the prefix sums.

Defined results: turns are ordered by (turn, role, text), nulls first, and exact
copies of a turn's row are one turn. A row with a null conv_id belongs to no
conversation and is left out. A null role is ``user``; a null text is empty.
Roles are compared in lower case. A turn that exceeds the budget on its own has a
window of its own without history, ``over_budget``, whole. System turns with no
room left for any turn make the windows ``over_budget`` likewise. A conversation
of system turns alone has one window, without targets. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import only

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BUDGET, HISTORY = 512, 128


def encoder(path: str):
    """The vocabulary at ``path`` as a tiktoken encoding; special strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n"


def windows(tokens: list[int], system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first turn shown, first new turn, turn after the last) of each window; the first ``system`` turns are in all of them."""
    prefix = np.concatenate([[0], np.cumsum(tokens)])
    room, n = budget - int(prefix[system]), len(tokens)
    out = []
    new = system
    while new < n:
        # The most history that is allowed and leaves room for the first new turn.
        most = min(history, room - tokens[new]) if new > system else 0
        shown = max(system, int(np.searchsorted(prefix, prefix[new] - most))) if most > 0 else new
        end = int(np.searchsorted(prefix, prefix[shown] + room, side="right")) - 1
        end = max(end, new + 1)
        out.append((shown, new, end))
        new = end
    return out or [(n, n, n)]


_SCHEMA = "conv_id long, window int, first_turn int, new_turn int, end_turn int, n_tokens int, over_budget boolean, text string, targets array<struct<begin:int,end:int>>, masked int"


def _format(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa_

        spans = pa_.list_(pa_.struct([("begin", pa_.int32()), ("end", pa_.int32())]))
        schema = pa_.schema([("conv_id", pa_.int64()), *[(c, pa_.int32()) for c in ("window", "first_turn", "new_turn", "end_turn", "n_tokens")], ("over_budget", pa_.bool_()), ("text", pa_.string()), ("targets", spans), ("masked", pa_.int32())])
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = [t["n"] for t in turns]
                system = 0
                while system < len(turns) and turns[system]["role"] == "system":
                    system += 1
                for w, (shown, new, end) in enumerate(windows(tokens, system, budget, history)):
                    text, targets, masked, used = [], [], 0, 0
                    at = 0
                    for k in [*range(system), *range(shown, end)]:
                        t = turns[k]
                        s = render(t["role"], t["text"])
                        if t["role"] == "assistant":
                            if k >= new:
                                targets.append({"begin": at + len(s) - len(t["text"]) - 1, "end": at + len(s)})
                            else:
                                masked += 1
                        text.append(s)
                        at += len(s)
                        used += tokens[k]
                    rows.append({"conv_id": conv, "window": w, "first_turn": shown, "new_turn": new, "end_turn": end, "n_tokens": used, "over_budget": used > budget, "text": "".join(text), "targets": targets, "masked": masked})
                if len(rows) > 500:
                    yield pa_.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa_.RecordBatch.from_pylist(rows, schema=schema)

    return run


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each window: its turns, tokens, text, the character spans to train on, and how many targets are masked."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(tokenizer)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) for t in texts], dtype="int32")

    role, text = F.lower(F.coalesce("role", F.lit("user"))), F.coalesce("text", F.lit(""))
    turns = only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    turns = turns.withColumn("n", count(F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "role", "text", "n"))).alias("turns"))
    return whole.mapInArrow(_format(budget, history), _SCHEMA)


def op1_chat_windows(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op1_chat_windows": op1_chat_windows}
ORACLE: dict[str, str] = {}
