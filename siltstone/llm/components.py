"""Connected components of an edge table, and the least node of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch


#: A node's edges are dealt into so many parts, so that no task has all edges of one node.
SALTS = 1024


def _with_least(edges: DataFrame) -> DataFrame:
    """Add ``m``, the least ``b`` of the edges of each ``a``.

    The least of each part of a node's edges, then of the parts, then back to
    the parts and from there to the edges: at most ``SALTS`` rows of a node meet.
    """
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = edges.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy(F.col("a").alias("n")).agg(F.min("m").alias("m"))
    back = parts.select(F.col("a").alias("p"), F.col("salt").alias("s")).join(least, F.col("p") == F.col("n")).select("p", "s", "m")
    return edges.join(back, (F.col("a") == F.col("p")) & (F.col("salt") == F.col("s"))).select("a", "b", "m")


def connected_components(edges: DataFrame, scratch: Scratch, label: str, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; a component is its least node.

    Alternates two steps until nothing changes: every node hands the least of
    its neighbours to its larger ones, then to its smaller ones. Edges never
    grow in number and the rounds grow with the logarithm of the nodes. Each
    round is a table of its own, so a lost executor repeats one round at most.
    Edges from a node to itself and repeated edges count once or not at all; an
    edge with a null is not one.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    links = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    turn, before = 0, _digest(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = scratch.keep(large.where("a <> b").distinct(), f"{label}-large")
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        links = scratch.keep(small.where("a <> b").distinct(), f"{label}-{turn + 1}")
        scratch.drop(f"{label}-{turn}", f"{label}-large")
        turn, last, before = turn + 1, before, _digest(links)
        if before == last:
            break
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
    return tuple(row)
