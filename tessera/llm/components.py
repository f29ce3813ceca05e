"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and joins on node ids with partial sums, so a node with
very many edges costs no single task more than its share, and nothing comes to the driver
but two numbers that tell whether the edges changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = pairs.join(lowest, "u")
    out = both.where(F.col("v") > F.col("u")) if large else both
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: comparable ids); the component is its least id.

    Loops and repeated edges count once; edges with a null end are none; no edges, no rows.
    """
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds if state[0] else 0):
        new = materialise(_star(_star(now, True), False), "stars")
        discard(now)
        now, last, state = new, state, _state(new)
        if state == last:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def joined_components(parts: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after further edges ``more`` (a, b) between those of ``parts``: only
    edges between components, of which there are few, go through rounds again."""
    name = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    over = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    tops = materialise(connected_components(over), "tops")
    moved = parts.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return moved.unionByName(tops.join(parts.select("node"), "node", "left_anti").select("node", "component"))
