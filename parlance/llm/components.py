"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import forget, mapped, written

#: Nodes that a task holds at a time, some 300 bytes each.
HELD = 50_000


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that hang together what a task's edges do: each node with the least of its own."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def contracted() -> pa.RecordBatch:
        found = [(x, r) for x in up if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ((), ()))], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        if len(up) > HELD:
            yield contracted()
            up.clear()
    yield contracted()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root of each node of edges (two long columns); root is the smallest node of its component.

    Every node is joined to its least neighbour, from above and from below in turn, until nothing
    changes: the number of rounds grows with the logarithm of the longest chain. Before each round tasks make
    stars of what they hold, which leaves fewer edges and rounds. Each round is written
    to the shared folder, so lineage stays short and nothing is gathered on the driver but a count and
    a checksum. Nulls and loops are passed over; no edges give no rows.
    """
    ends = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(mapped(ends, stars, "u long, v long"), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = written(mapped(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), stars, "u long, v long"), "edges")
        before, state = state, _state(then)
        forget(now)
        now = then
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1_000_003), F.sum(F.col("v") % 1_000_003)).first())
