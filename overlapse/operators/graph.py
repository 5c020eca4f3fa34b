"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlapse.workspace import materialise, release, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of each node are linked to the least node among them.

    The least neighbour is an aggregate (combined before the shuffle), and a node
    with very many neighbours is split by Catalyst's skew join.
    """
    near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, apart: int | None = None) -> DataFrame:
    """(node, component): every node of an edge table (a, b) with the least node of its component.

    Alternating large-star and small-star steps; each round is written to the shared
    folder, and so is the result (``remove`` deletes it). Null ends and loops are ignored apart
    from naming their node; direction and repetition don't matter. An empty table gives an
    empty result. Rounds grow with the logarithm of the size; more than ``max_rounds`` is an error.
    From ``apart`` edges on, what each star step makes is written, so that the shuffles of one step alone lie on disk at once.
    """
    clean = edges.select("a", "b")
    nodes = clean.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    nodes = materialise(nodes, "cc-nodes")
    current = clean.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialise(current, "cc-edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    seen, settled = mark(current), False
    for _ in range(max_rounds):
        if settled or not seen[0]:
            break
        large, many = _star(current, True), apart is not None and seen[0] >= apart
        if many:
            release(current)
            large = materialise(large, "cc-large")
            release(large)
        step = materialise(_star(large, False), "cc-edges")
        if many:
            remove(large)
            release(step)
        now = mark(step)
        remove(current)
        current, seen, settled = step, now, now == seen
    else:
        if not settled:
            raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    # every edge now leads from a node to the least node of its component
    found = nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    out = materialise(found, "cc-found")
    remove(nodes)
    remove(current)
    return out
