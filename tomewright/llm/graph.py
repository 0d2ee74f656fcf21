"""Connected components of a link table, by rounds of joins.

Every node keeps the smallest node it has seen.  A round takes the minimum
over its neighbours and then jumps to the label of that label, so labels halve
their distance to the root; rounds end when none changes.  Each round is
written to the shared folder, so a lost executor costs no recomputation of
earlier rounds.  Nodes with many neighbours are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, root): root is the smallest node reachable; nodes without links are absent."""
    both = links.where("a <> b").select("a", "b")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("root")))
    while True:
        seen = (both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("m")))
        near = label.join(seen, "node", "left").select("node", F.col("root").alias("old"),
                                                       F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = near.join(label.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        after = cut_lineage(jump.select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        label = after.select("node", "root")
        if after.where("old <> root").isEmpty():
            return label
