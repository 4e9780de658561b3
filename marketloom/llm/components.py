"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for each node of edges(a, b).

    Alternates the large-star and small-star steps, which converge in a logarithmic number of
    rounds. Every step is a grouped minimum and a join on the node, and each round is written to
    the shared folder, so lineage stays short. A node with very many neighbours is
    never gathered: only its minimum is. The loop ends when nothing changes any more. Self-links and null ids are ignored.

    Returns node, component; nodes without a link do not appear. Ties cannot occur; no edges give no rows.
    """
    current = written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("merge"), "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct()
        )
        after = written(small, "edges")
        # A forest of stars has no node that is both a member and a centre.
        if after.select("u").join(after.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").isEmpty() and (
            after.groupBy("u").count().where("count > 1").isEmpty()
        ):
            break
        current = after
    current = after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(centres)
