"""Chat formatting into budgeted windows.

A turn is written as

    ### <role>
    <text></turn>

and a line end. In roles and texts a backslash stands before every backslash and `#`, and between `<` and `/`; in roles a line end is `\\n`. So neither `###` nor
`</turn>` occurs in what is escaped, and unescaping is exact.

A window has the conversation's system turn (its first turn with that role), then as many of the turns before as the history allows, then new turns as long as the sum of tokens
stays in the budget. The spans are found from prefix sums of the turns' tokens and never cut a turn: a turn that is alone larger than the budget has a window without history, over
the budget. Each turn is new in exactly one window; the loss covers the texts of new assistant turns only, so repeated targets are masked.

Turns are numbered within their conversation from sorted ranges, and conversations are dealt in blocks of BLOCK turns, to which the last turns before and the system turn are copied. No
conversation meets in one task to be formatted, however long; windows end where blocks end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut, few_rows, partitions
from quillstone.llm.pieces import Pieces, ids_of, library_cache

BUDGET, HISTORY, BLOCK = 1024, 256, 1024
SCHEMA = "conv_id long, block long, window int, text string, n_tokens long, n_turns int, n_repeated int, loss array<struct<start:long,end:long>>"


def escaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([\\#])", r"\\$1"), F.lit("</"), F.lit("<\\/"))


def turn_text(role: Column, text: Column) -> Column:
    """A turn as it is written."""
    head = F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("### "), head, F.lit("\n"), escaped(text), F.lit("</turn>\n"))


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out += [text[at:i], "\n" if text[i + 1] == "n" else text[i + 1]]
        at = i + 2
    return "".join([*out, text[at:]])


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the text's start and end of each turn of a window."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index("</turn>\n", line + 1)
        out.append((unescape(text[at + 4 : line]), unescape(text[line + 1 : end]), line + 1, end))
        at = end + len("</turn>\n")
    return out


class Spans:
    """Turn-aligned windows over a block's turns, which come in order: copied ones first, then its own. Holds one window and its history."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history, self.system = budget, history, None
        self.turns: list[tuple] = []  # (at, role, body, tokens)
        self.total = [0]  # prefix sums of their tokens
        self.new = self.room = 0  # where new turns begin, and the tokens that all of them may have
        self.head: tuple | None = None

    def copied(self, turn: tuple, system: bool) -> None:
        if system:
            self.system = turn
        else:
            self._append(turn)
            self.new = len(self.turns)

    def _append(self, turn: tuple) -> None:
        self.turns.append(turn)
        self.total.append(self.total[-1] + turn[3])

    def add(self, turn: tuple) -> tuple | None:
        """Take the next own turn; the window before it, if it ends there."""
        out = None
        if len(self.turns) == self.new or self.total[-1] + turn[3] > self.room:
            out = self.close()
            self.head = self.system
            self.room = self.budget - (self.head[3] if self.head else 0)
            spare = max(0, min(self.history, self.room - turn[3]))
            back = int(np.searchsorted(self.total, self.total[-1] - spare, "left"))
            self.turns, self.total = self.turns[back:], [t - self.total[back] for t in self.total[back:]]
            self.new = len(self.turns)
        if self.system is None and turn[1] == "system":
            self.system = turn
        self._append(turn)
        return out

    def close(self) -> tuple | None:
        """The turns of the window and how many of them are repeated; None if nothing is new."""
        if len(self.turns) == self.new:
            return None
        head = [self.head] if self.head and all(t[0] != self.head[0] for t in self.turns) else []
        return head + self.turns, len(head) + self.new


def told(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows (conv_id, turn, role, text) as conv_id, at (their place in the conversation by turn, role and text; nulls first), role, body (the turn as written) and tokens.

    Turns are sorted by ranges and counted where they lie. Only the first conversation of a range can have begun before it, so what is added to those counts is
    a row a range at most.
    """
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, F.asc_nulls_first("text"))
    bodies = dealt.select("conv_id", F.spark_partition_id().alias("part"), "role", turn_text(F.col("role"), F.col("text")).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, nth = library_cache(tokenizer), "none yet", 0
        for batch in few_rows(batches):
            _, offsets = ids_of(Pieces(batch.column("body"), keep_runs=True), cache)
            places = []
            for conv in batch.column("conv_id").to_pylist():
                last, nth = conv, nth + 1 if conv == last else 0
                places.append(nth)
            yield batch.append_column("tokens", pa.array(np.diff(offsets).astype(np.int64))).append_column("nth", pa.array(places, pa.int64()))

    found = cut(bodies.mapInArrow(count, "conv_id long, part int, role string, body string, tokens long, nth long"), "turns")
    before = F.sum("turns").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("turns")
    begun = found.groupBy("conv_id", "part").agg(F.count("*").alias("turns")).withColumn("before", before).filter("before > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before")
    met = found.join(F.broadcast(begun), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return met.select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("at"), "role", "body", "tokens")


def windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text): conv_id, block, window, text, n_tokens, n_turns, n_repeated (turns at the start that other windows have as new, the system turn included), loss.

    loss has the spans [start, end) of text, in code points, that are learnt. Tokens are those of each turn by itself. Null texts and roles are empty, a null conv_id is a conversation
    of its own, turns come in order of turn (null first), role and text; rows that repeat are turns that repeat. Other columns don't matter. An empty table gives no windows.
    """
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))

    turns_ = told(rows, tokenizer)
    own = turns_.withColumn("block", F.floor(F.col("at") / block)).withColumn("kind", F.lit(2))
    # The last turns of a block are history for the next one (a turn has two tokens at least, and history reaches no further back); the system turn goes to each block after its own.
    tail = own.filter(F.col("at") % block >= block - min(block, max(1, history // 2))).withColumn("block", F.col("block") + 1).withColumn("kind", F.lit(1))
    last = turns_.groupBy("conv_id").agg(F.floor(F.max("at") / block).alias("last"), F.min(F.when(F.col("role") == "system", F.col("at"))).alias("sys"))
    last = last.withColumnRenamed("conv_id", "c")
    long = last.filter("last > 0 and sys is not null")
    system = turns_.join(long, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("sys"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("kind", F.lit(0))
    system = system.filter(F.col("block") > F.floor(F.col("sys") / block)).select(own.columns)
    dealt = own.unionByName(tail).unionByName(system).repartition(partitions(turns.sparkSession), "conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "at")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, number, out, size = None, Spans(budget, history), 0, [], 0
        for batch in batches:
            for conv, block_no, kind, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "kind", "at", "role", "body", "tokens")), strict=True):
                done = None
                if (conv, block_no) != key:
                    done, last_key, last_number = open_.close(), key, number
                    key, open_, number = (conv, block_no), Spans(budget, history), 0
                    if done:
                        out.append(formed(last_key, last_number, *done))
                        size += len(out[-1]["text"])
                if kind < 2:
                    open_.copied(tuple(turn), kind == 0)
                elif done := open_.add(tuple(turn)):
                    out.append(formed(key, number, *done))
                    size += len(out[-1]["text"])
                    number += 1
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, WINDOW)
                    out, size = [], 0
        if done := open_.close():
            out.append(formed(key, number, *done))
        if out:
            yield pa.RecordBatch.from_pylist(out, WINDOW)

    return dealt.mapInArrow(form, SCHEMA)


WINDOW = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def formed(key: tuple, number: int, turns: list[tuple], repeated: int) -> dict:
    """A window's row from its turns (at, role, body, tokens)."""
    at, loss = 0, []
    for i, (_, role, body, _) in enumerate(turns):
        if i >= repeated and role == "assistant":
            loss.append({"start": at + body.index("\n") + 1, "end": at + len(body) - len("</turn>\n")})
        at += len(body)
    return {
        "conv_id": key[0], "block": key[1], "window": number, "text": "".join(t[2] for t in turns), "n_tokens": sum(t[3] for t in turns),
        "n_turns": len(turns), "n_repeated": repeated, "loss": loss,
    }


def read_windows(rows: DataFrame) -> DataFrame:
    """Of each conversation, from its windows alone: n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars, loss_sha256 (what the loss covers, unescaped), formatted_chars.

    Such digests run over a whole conversation: its windows pass through one task, as a stream.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, state = "none yet", [], None

        def told() -> dict:
            n, turns, chars, loss, size = state
            return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}

        for batch in batches:
            for small in few_rows([batch], 100):
                for conv, text, repeated, spans in zip(*(small.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss")), strict=True):
                    if conv != key:
                        out += [told()] if state else []
                        key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    new = parse(text)[repeated:]
                    state[0] += len(new)
                    for role, said, _, _ in new:
                        state[1].update(f"{role}\n{said}\n".encode())
                    for s in spans:
                        said = unescape(text[s["start"] : s["end"]])
                        state[2] += len(said)
                        state[3].update(said.encode())
                    state[4] += len(text)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, DIGEST)
                out = []
        out += [told()] if state else []
        if out:
            yield pa.RecordBatch.from_pylist(out, DIGEST)

    dealt = rows.select("conv_id", "block", "window", "text", "n_repeated", "loss").repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block", "window")
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
