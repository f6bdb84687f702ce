"""Connected components of an edge table by alternating star operations.

Every round is two joins and two partial aggregations (Kiveris et al., "Connected
components in MapReduce and beyond", 2014); the number of rounds grows with the logarithm
of the number of nodes. Edges stay in tables, none reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.shared import materialize, release


def _parents(edges: DataFrame) -> DataFrame:
    """Smallest lower neighbour and number of lower neighbours of each node that has one."""
    return materialize(
        edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"), F.count("*").alias("n")),
        "parents",
    )


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Rows ``node``, ``component`` for each node of an edge that joins two nodes.

    ``component`` is the smallest node reachable. Self-loops and edges with a null end are
    ignored, repeated edges count once, and an empty table gives an empty result. Nodes
    without an edge are not returned: each is its own component.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    star = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(a.isNotNull() & b.isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct(),
        "edges",
    )
    while True:
        parents = _parents(star)
        is_star = star.join(parents, F.col("lo") == F.col("node"), "left_semi").limit(1).count() == 0
        if is_star and parents.where("n > 1").limit(1).count() == 0:
            release(parents)
            break
        # Large star: hang every node on the smallest neighbour of its lower neighbour.
        large = materialize(
            star.join(parents, F.col("lo") == F.col("node"), "left")
            .select("hi", F.coalesce("low", "lo").alias("lo"))
            .distinct(),
            "edges",
        )
        release(star, parents)
        # Small star: hang a node and its lower neighbours on the smallest of them.
        parents = _parents(large)
        joined = large.join(parents, F.col("hi") == F.col("node"))
        star = materialize(
            joined.select(
                F.explode(
                    F.array(
                        F.struct(F.col("hi").alias("hi"), F.col("low").alias("lo")),
                        F.struct(F.col("lo").alias("hi"), F.col("low").alias("lo")),
                    )
                ).alias("e")
            )
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct(),
            "edges",
        )
        release(large, parents)
    ends = star.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = star.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return ends.unionByName(roots)
