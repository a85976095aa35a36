"""Connected components of an edge table by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import discard, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every neighbour of u (the larger ones, or the smaller ones and u itself) moves to u's least neighbour.

    The least neighbour comes from a partially aggregated group and is joined back, so a node with very many
    neighbours is split like any skewed join key.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b): any order, repeats and loops allowed. Returns (node, component) for every node with an
    edge to another node; component is the least node reachable. Each round is written to the shared folder."""
    now = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct())
    seen = None
    for _ in range(rounds):
        large = settle(_stars(now, True))
        before, now = now, settle(_stars(large, False))
        discard(before, large)
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sign["n"], sign["s"]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = (sign["n"], sign["s"])
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def class_least(members: DataFrame, klass: str, value: str, spread_by: str, into: str, salts: int = 16) -> DataFrame:
    """members and `into`, the least value of each row's class. Only the classes' least values are copied, `salts` times, so
    that the rows of one very large class meet theirs in as many tasks."""
    least = members.groupBy(klass).agg(F.min(value).alias(into)).withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return members.withColumn("salt_", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).join(least, [klass, "salt_"]).drop("salt_")
