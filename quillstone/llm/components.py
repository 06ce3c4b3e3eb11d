"""Connected components of links between documents, on executors only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, drop


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of links, a star for each component: (u, its smallest member)."""
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, root = flat[: len(u)], flat[len(u) :], np.arange(len(ids))
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        far = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["u", "v"])


#: Up to so many links (16 bytes each) are settled by one task; beyond, by rounds on all executors.
FEW = 1 << 20


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_forest of all links of a task at once."""
    held = list(batches)
    if held:
        yield from _forest([pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if sum(b.num_rows for b in held) else [])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links (u long, v long) to (id, root): each linked id and the smallest id of its component.

    Links are contracted: each id hooks to its smallest neighbour, hooks are followed to their roots, and links between
    roots go on to the next round. No component is gathered in a task. Null links are left out.
    """
    links = cut(links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).dropna().filter("u != v").mapInArrow(_forest, "u long, v long"), "links")
    if links.count() <= few:
        whole = cut(links.coalesce(1).mapInArrow(_whole, "u long, v long"), "roots")
        drop(links)
        # Stars have no row for their smallest members, which are their own roots.
        return whole.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(whole.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    whole = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")), "hooks")
        while True:
            up = hooks.select(F.col("u").alias("v"), F.col("v").alias("w"))
            jumped = cut(hooks.join(up, "v").select("u", F.col("w").alias("v"), (F.col("w") != F.col("v")).alias("moved")), "hooks")
            drop(hooks)
            hooks = jumped
            if hooks.filter("moved").isEmpty():
                break
        if whole is None:
            whole = cut(hooks.select("u", "v"), "roots")
        else:
            up = hooks.select(F.col("u").alias("v"), F.col("v").alias("w"))
            longer = cut(whole.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")), "roots")
            drop(whole)
            whole = longer
        of = lambda c: hooks.select(F.col("u").alias(c), F.col("v").alias(f"{c}{c}"))  # noqa: E731, B023
        left = links.join(of("u"), "u").join(of("v"), "v").select(F.col("uu").alias("u"), F.col("vv").alias("v")).filter("u != v").distinct()
        left = cut(left.mapInArrow(_forest, "u long, v long"), "links")
        drop(links, hooks)
        links = left
    return (links if whole is None else whole).select(F.col("u").alias("id"), F.col("v").alias("root"))
