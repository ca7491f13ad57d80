"""Connected components of an edge table by repeated contraction.

On request (``early``), each task first joins up the edges it has, in bounded chunks, and hands on one edge a node at most: copies
and chains shrink to stars before anything is moved. This suits edges that the JVM makes: where Python makes them, every task
would need a second worker. If no more than ``LAST_EDGES`` are left, one task joins them up and labels the
nodes. Otherwise each round hooks every node onto the node of least random priority within two steps of it and contracts the
edges. Stars and cliques vanish in one round; other graphs lose a constant factor of their edges a round in expectation, so the
driver's loop runs O(log n) times and sees only a count. Edges are aggregated with partial aggregation, so a hub node
costs no more than its share of the rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskline.session import cut

#: Contracted edges that one task takes, a few megabytes; edges that a task joins up at once before the first exchange.
LAST_EDGES, CHUNK = 200_000, 500_000


def _labels(a: list, b: list) -> dict:
    """The least node of its component for each node of the edges, by union-find."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def _join_up(frames: Iterator[pa.RecordBatch], chunk: int | None) -> Iterator[pa.RecordBatch]:
    """``(a, b)``: each node of the edges with the least node of its component, chunk by chunk (None: all at once)."""
    a, b, kind = [], [], None
    for frame in itertools.chain(frames, [None]):
        if frame is not None:
            kind = frame.column(0).type
            a += frame.column(0).to_pylist()
            b += frame.column(1).to_pylist()
        if a and (frame is None or (chunk and len(a) >= chunk)):
            found = _labels(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), kind)], names=["a", "b"])
            a, b = [], []


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, last_edges: int | None = None, early: bool = False) -> DataFrame:
    """``(node, component)`` for every node on an edge; ``component`` is the smallest node id reachable.

    Nulls: an edge with a null end is ignored. Self loops give their node a component of its own. Repeated edges count
    once. An empty edge table gives an empty result. Nodes without an edge are not listed (they are their own component).
    """
    known = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    few = LAST_EDGES if last_edges is None else last_edges
    # Nodes whose ids Python would not give back as they were (timestamps, decimals) are only told apart by Spark.
    plain = isinstance(known.schema["a"].dataType, (T.IntegralType, T.StringType))
    join_up = lambda df, chunk: df.mapInArrow(lambda frames: _join_up(frames, chunk), known.schema)
    known = cut(join_up(known, CHUNK) if plain and early else known.distinct())
    live, hooks = known.where("a <> b"), []
    if plain and known.count() <= few:
        # Dealt out again: a table of one known partition would draw what it is joined with into one task.
        return cut(join_up(known.coalesce(1), None).toDF("node", "component").repartition("node"))
    while n := live.count():
        if n <= few and plain:
            hooks.append(cut(join_up(live.coalesce(1), None).toDF("v", "to")))
            break
        if len(hooks) == max_rounds:
            raise RuntimeError("connected components did not settle")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(hooks))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = live.union(live.select("b", "a"))
        # Kept apart, so that both sides of the next join are plain exchanges and a hub's rows can be split among tasks.
        near = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("b"), F.least("m", rank("a")).alias("m")))
        hook = cut(both.join(near, "b").groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("v"), F.col("m.v").alias("to")))
        hooks.append(hook)
        ends = lambda col: hook.select(F.col("v").alias(col), F.col("to").alias(f"{col}2"))  # noqa: B023, E731
        live = cut(live.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct())
    # A round's hooks are followed through those of the later rounds, which have ever fewer nodes.
    label = hooks.pop() if hooks else known.limit(0).select(F.col("a").alias("v"), F.col("b").alias("to"))
    for hook in reversed(hooks):
        label = hook.join(label.select(F.col("v").alias("to"), F.col("to").alias("then")), "to", "left").select("v", F.coalesce("then", "to").alias("to"))
    nodes = known.select(F.col("a").alias("node")).union(known.select("b")).distinct()
    labels = cut(nodes.join(label.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("to", "node").alias("label")))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
