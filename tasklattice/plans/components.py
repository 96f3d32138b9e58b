"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.plans.lineage import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component), where component is the least id that ``id`` is linked to
    through any chain. Links may be given in one direction and repeatedly; a link
    of an id with itself makes it a component of its own. No links, no rows.

    Each round takes the least label among the neighbours and then the label of
    that label, so a chain of n links needs about log n rounds. Labels are cut
    from their lineage in every round; only a count of changes reaches the driver.
    """
    ends = links.select(F.col(a).alias("id"), F.col(b).alias("to"))
    both = cut(ends.unionByName(ends.select(F.col("to").alias("id"), F.col("id").alias("to"))).filter(F.col("id").isNotNull() & F.col("to").isNotNull()).distinct())
    labels = cut(both.groupBy("id").agg(F.least("id", F.min("to")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("near")), "to").groupBy("id").agg(F.min("near").alias("near"))
        nearer = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        moved = cut(nearer.join(root, "component").select("id", "was", F.least("component", "root").alias("component")))
        if moved.filter(F.col("was") != F.col("component")).isEmpty():
            return moved.select("id", "component")
        labels = moved.select("id", "component")
