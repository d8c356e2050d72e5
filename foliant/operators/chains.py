"""Chains of replaced ids (J-14): where each id leads in the end.

Pointer doubling: a round replaces each pointer by the pointer of what it points
at, so a chain of n links is resolved in about log2(n) equi-joins.  Only rows that
haven't arrived are joined, against all rows; AQE broadcasts them once they are
few and splits a target that many rows point at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.stage import staged


def _resolved(links: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(arrived, circling) of links (id, to): arrived has (id, head, steps) of the
    ids that lead to one without a link; circling has (id, to), a power of the
    links of those that lead into a cycle.

    The ids that take more than 2**k steps hold one of exactly 2**k + 1 if they
    hold any that arrives, so a round in which none arrives leaves only cycles.
    """
    ends = links.select(F.col("to").alias("_end")).distinct().join(links.select(F.col("id").alias("_end")), "_end", "left_anti")
    now = staged(links.join(ends, F.col("to") == F.col("_end"), "left").select("id", "to", F.lit(1).cast("long").alias("steps"), F.col("_end").isNotNull().alias("there")))
    arrived, left = now.where("there"), now.where("not there")
    n = left.count()
    while n:
        other = arrived.unionByName(left).select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("there").alias("_there"))
        now = staged(left.join(other, F.col("to") == F.col("_id")).select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_there").alias("there")))
        arrived, left = arrived.unionByName(now.where("there")), now.where("not there")
        was, n = n, left.count()
        if n == was:
            break
    return arrived.select("id", F.col("to").alias("head"), "steps"), left.select("id", "to")


def _cycles(circling: DataFrame) -> DataFrame:
    """(id) of the ids that lie on a cycle: what enough steps from all of them
    still reach.  The images shrink until they are the cycles, on which a step
    only changes places."""
    n = -1
    while True:
        reached = circling.select(F.col("to").alias("id")).distinct()
        was, n = n, reached.count()
        if n == was:
            return reached
        other = circling.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        circling = staged(circling.join(other, F.col("to") == F.col("_id")).select("id", F.col("_to").alias("to")))


def chase(links: DataFrame, key: str = "id", to: str = "to") -> DataFrame:
    """J-14: (id, head, steps, cyclic): where each id of ``links`` leads.

    An id is followed until one has no link or was met before.  So an id on a
    cycle stays itself, one that leads into a cycle ends at the first of its ids,
    and steps are those it takes to its head.  An id may have one link; of several
    the smallest counts.  A null link is none, and such an id has no row.
    """
    links = staged(links.where(F.col(key).isNotNull() & F.col(to).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(to).alias("to")))
    arrived, circling = _resolved(links)
    plain = arrived.withColumn("cyclic", F.lit(False))
    if circling.isEmpty():
        return plain
    members = staged(_cycles(circling))
    on = members.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("cyclic"))
    tails = links.join(circling.select("id"), "id", "left_semi").join(members, "id", "left_anti")
    into, _ = _resolved(tails)
    return plain.unionByName(on).unionByName(into.withColumn("cyclic", F.lit(True)))
