"""Connected components of an edge table, by alternating large and small stars in written tables.

Each task first replaces its own edges by stars around the smallest node that they reach (in pieces of
PIECE edges), so that there are fewer edges and rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import drop_written, written


PIECE = 500_000


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components, of each piece of a task only stars."""

    def stars(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
        names = pc.unique(pa.concat_arrays([a, b]))
        names = names.take(pc.sort_indices(names))
        x, y = (pc.index_in(c, value_set=names).to_numpy() for c in (a, b))
        label = np.arange(len(names))
        while True:  # the smaller label of an edge's ends goes to both, and to whatever they point to
            low = np.minimum(label[x], label[y])
            before = label.copy()
            for end in (x, y):
                np.minimum.at(label, label[end], low)
                np.minimum.at(label, end, low)
            label = label[label]
            if (label == before).all():
                break
        rest = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(rest)), names.take(pa.array(label[rest]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PIECE:
                yield stars(*[pa.concat_arrays([h.column(c) for h in held]) for c in ("a", "b")])
                held, size = [], 0
        if size:
            yield stars(*[pa.concat_arrays([h.column(c) for h in held]) for c in ("a", "b")])

    return edges.mapInArrow(run, edges.schema)


def _stars(edges: DataFrame, to_smaller: bool) -> DataFrame:
    """One round: each node's neighbours are linked to the smallest of them (or the node itself).

    Large star: the larger neighbours of every node. Small star: the smaller ones, and the node.
    """
    if to_smaller:
        half = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = half.groupBy("a").agg(F.min("b").alias("low"))
        moved = half.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = moved.union(low.select("a", F.col("low").alias("b")))
    else:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        out = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of nodes of any type that can be ordered -> (node, component): the smallest node reachable.

    Nodes without an edge to another node are left out; an empty table gives an empty one.
    """
    now, mark = written(_contracted(edges.select("a", "b").filter("a <> b")), "edges"), None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == mark:
            break
        mark = (row.n, row.s)
        after = written(_stars(_stars(now, False), True), "edges")
        drop_written(now)
        now = after
    low = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(low)
