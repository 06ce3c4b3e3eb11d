"""Mixing sources to target weights by fitting a subset sum over exact token lengths.

Documents are counted by source and length. A source's target is whole copies of everything, then a budget less than
one copy; of that budget an even share of each length is taken, and a bounded-knapsack dynamic programme over all
lengths closes the gap. Which documents of a length are taken is settled by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import SPACE, cut, text_or_empty, whole_row

WEIGHTS = (5, 2, 1)
MOST = 3
#: So many words at least are left to the knapsack, if there are so many.
ROOM = 1 << 15
#: Rows that a cell has on average at most.
CELL = 1 << 16


def n_words() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (skey, source, source_size) with target: the total shared by weight, none above most times its size.

    Filled like connected vessels: in the order of cap over weight, the first level that no later cap cuts is the
    level of all. One row per source meets in one task, sums only.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    everything, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped, heavy = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - capped) / (F.sum("weight").over(everything) - heavy))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return s.select("skey", "source_size", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that the lengths sum to budget, or as near below as any sum of what is left at the end comes.

    An even share of each length, from the longest down, where what a length doesn't fill goes on to the next one: less
    than the longest document stays open. Documents of the shorter lengths are given back until ROOM words, or as many
    as the longest has, are open, and a bounded knapsack over all lengths fills those: its tables grow with the longest
    document, not with the budget.
    """
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(counts)
    take, due, left = {}, 0, budget
    for n in sorted(counts, reverse=True):
        due += n * counts[n] * budget
        take[n] = min(counts[n], due // (n * total)) if n else 0
        due -= take[n] * n * total
        left -= take[n] * n
    room = max(ROOM, max(counts))
    for n in sorted(counts):
        if n and (back := min(take[n], -(-max(0, room - left) // n))) > 0:
            take[n] -= back
            left += back * n
    # Bounded knapsack over a bit set: bit b says that b words can be filled; `by` names the step that first filled them.
    full, reach, steps = (1 << (left + 1)) - 1, 1, []
    by = np.zeros(left + 1, np.int32)
    for n in sorted(counts, reverse=True):
        spare, part = counts[n] - take[n], 1
        while n and n <= left and spare > 0 and not reach >> left & 1:
            use = min(part, spare)
            new = reach << n * use & full & ~reach
            reach |= new
            steps.append((n, use))
            by[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(steps)
            spare, part = spare - use, part * 2
    at = reach.bit_length() - 1
    while at:
        n, use = steps[by[at] - 1]
        take[n] += use
        at -= n * use
    return take


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    size, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
    base = min(MOST, int(target // size)) if size else 0
    budget = round(target - base * size) if base < MOST else 0
    take = fit(dict(zip(rows["size"].tolist(), rows.n.tolist(), strict=True)), budget)
    return pd.DataFrame({"skey": rows.skey, "size": rows["size"], "base": base, "quota": [take.get(n, 0) for n in rows["size"].tolist()], "source_size": size, "target": target})


def _copies(rows: DataFrame, seed: int, cell_rows: int) -> DataFrame:
    """at, doc_id, size, source_size, target and copies of rows with a number (at, from monotonically_increasing_id)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    keys = cut(rows.select("at", "doc_id", key.alias("skey"), n_words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("h")), "mix-keys")
    bits = min(40, max(10, (keys.count() // cell_rows).bit_length()))
    cell = F.shiftrightunsigned("h", 64 - bits)
    of_cell = ["skey", "size", "cell"]
    cells = cut(keys.withColumn("cell", cell).groupBy(*of_cell).agg(F.count("*").alias("n")), "mix-cells")
    lengths = cells.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = targets(sources.withColumn("source", F.when(F.col("skey") != "null", F.expr("substring(skey, 2)"))))
    quotas = cut(lengths.join(sources, "skey").groupBy("skey").applyInPandas(_quotas, "skey string, size long, base int, quota long, source_size long, target double"), "mix-quotas")
    # Only rows that repeat an id and text can fill a cell beyond its size; their places in the input split it.
    over = cells.filter(F.col("n") > 8 * cell_rows).select(*of_cell, F.lit(True).alias("over"))
    if over.isEmpty():
        keys, split = keys.withColumn("cell", cell).withColumn("part", F.lit(0).cast("long")), cells.withColumn("part", F.lit(0).cast("long"))
    else:
        place = F.shiftright("at", 33) * 1024 + F.shiftright(F.col("at").bitwiseAND((1 << 33) - 1), 16)
        keys = keys.withColumn("cell", cell).join(over, of_cell, "left").withColumn("part", F.when(F.col("over"), place).otherwise(0)).drop("over")
        split = keys.groupBy(*of_cell, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("cell", "part")) - F.col("n")
    split = split.withColumn("before", before).join(quotas, ["skey", "size"])
    rank = F.row_number().over(Window.partitionBy(*of_cell, "part").orderBy("h", "at"))
    ranked = keys.withColumn("rank", rank).join(split.drop("n"), [*of_cell, "part"])
    copies = F.col("base") + (F.col("before") + F.col("rank") <= F.col("quota")).cast("int")
    return ranked.select("at", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: int = 42, cell_rows: int = CELL) -> DataFrame:
    """One row per document: doc_id, size (words; null text: 0), source_size, target, copies, taken = size * copies.

    A null source is a source of its own, last in the order. Equal rows and rows that repeat an id are separate documents.
    Empty texts have size 0 and take nothing. Documents of one source and length are told apart by a hash of id and text,
    in cells by its upper bits, and in parts of a cell by place where rows repeat both; so no source, length or
    repeated row has to fit in one task; only the counts by length of a source do.
    """
    out = _copies(docs.withColumns({"at": F.monotonically_increasing_id()}), seed, cell_rows)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 42, cell_rows: int = CELL) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs. Rows that repeat an id are taken or left each by itself."""
    rows = cut(docs.select(whole_row(docs).alias("row"), F.monotonically_increasing_id().alias("at")), "mix-rows")
    often = _copies(rows.select("at", "row.doc_id", "row.source", "row.text"), seed, cell_rows).filter("copies > 0").select("at", "copies")
    return rows.join(often, "at").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
