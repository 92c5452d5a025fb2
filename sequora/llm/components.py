"""Connected components of a table of links, by rounds of joins and aggregations on the cluster.

Each round gives every node the least label among its neighbours and itself, then follows labels of labels.
Labels only ever fall, so the rounds end when none changes. Tables between rounds are written to the shared folder. Every node is
linked with itself too, so a round needs no join for the nodes' own labels: what the driver plans grows with the joins of a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm.store import cut

#: Links for each file of the tables between rounds.
LINKS_PER_FILE = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): label is the least node that links reach."""
    ends = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")))
    both = cut(links.where("a != b").select(F.explode(ends).alias("end")).select("end.*").distinct(), "links")
    files = 2 + both.count() // LINKS_PER_FILE
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels", files)
    while True:
        # the least label around each node, its own included; a node with many links is read in splits, summed before it is dealt
        own = F.min(F.when(F.col("a") == F.col("b"), F.col("label")))
        around = both.join(labels.hint("merge"), both.b == labels.node).groupBy(F.col("a").alias("node")).agg(own.alias("was"), F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = cut(around.join(jump.hint("merge"), "label", "left").select("node", "was", F.least("label", "root").alias("label")), "labels", files)
        labels = moved.select("node", "label")
        if moved.where("label != was").isEmpty():
            return labels
