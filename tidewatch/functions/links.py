"""Following links between rows by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpointed


def follow(begins: DataFrame, links: DataFrame) -> DataFrame:
    """All nodes that are reached from ``begins`` (``node``) over ``links`` (``node``, ``to``).

    A node has one link at most. Each round visits the next nodes and makes all links twice as
    long, so a chain of n links takes about log2(n) rounds; nothing but numbers moves.
    """
    links, visited = checkpointed(links), checkpointed(begins.distinct())
    count = visited.count()
    while True:
        ahead = visited.join(links, "node").select(F.col("to").alias("node"))
        visited = checkpointed(visited.union(ahead).distinct())
        more = visited.count()
        if more == count:
            return visited
        count = more
        links = checkpointed(links.alias("a").join(links.alias("b"), F.col("a.to") == F.col("b.node"))
                             .select("a.node", "b.to"))
