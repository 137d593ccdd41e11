"""Connected components of a graph given by a table of links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: Links up to which one task finds the components, in some 100 MB.
SMALL = 1 << 20


def _found_here(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a few links: labels sink to the least, along links and from label to label."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = np.concatenate([table.column(c).to_numpy() for c in ("a", "b")])
    nodes, place = np.unique(ends, return_inverse=True)
    a, b = place[: table.num_rows], place[table.num_rows :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]  # the least nodes of the trees so far: one is hung under the other
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[label[at : at + (1 << 16)]])], ["node", "root"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b: long); root is one node of the component.

    A few links are worked through by one task.  More by randomised contraction: in each round every node joins the neighbour (or
    itself) that comes first in that round's random order, and each group
    becomes one node.  The order is a seeded hash, so a lost task is made again
    alike.  The links shrink by a constant factor a round, whatever their shape;
    each round ends in a table in the shared folder.  Loops, repeated links and
    links with a null end add nothing.  No links: no rows.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def ranked(node: Column, turn: int) -> Column:
        return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), node.alias("node"))

    links = written(tidy(links), "links")
    if links.count() <= SMALL:
        return links.coalesce(1).mapInArrow(_found_here, "node long, root long")
    turns: list[DataFrame] = []
    while not links.isEmpty():
        turn = len(turns)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(ranked(F.col("b"), turn)).alias("m"))
        to = written(least.select(F.col("a").alias("node"), F.least("m", ranked(F.col("a"), turn))["node"].alias("root")), "turn")
        turns.append(to)
        left = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        links, before = written(tidy(moved), "links"), links
        dropped(before)
    if not turns:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round back: where a node's root went later
    found = turns[-1]
    for to in reversed(turns[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = to.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return found
