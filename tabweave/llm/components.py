"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations to the least neighbour (partial sums first, so hubs don't pile up) and joins back.
A round's links are written to the shared folder, so plans stay short and a lost executor repeats one round at most.
Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, label): for every node of the links (u, v), the smallest node that it can reach. Self links are allowed."""
    now = scratch.write(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc0")
    before = None
    for k in range(1, most_rounds + 1):
        both = _both(now)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u > v now; small star: the lower neighbours of u, and u itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        seen = Observation()
        after = small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        now = scratch.write(after.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), f"cc{k % 2 + 1}")
        state = (seen.get["n"], seen.get["sum"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    # each component is a star around its least node
    return now.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("label"))).distinct()
