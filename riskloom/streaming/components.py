"""Components that take new edges batch by batch (K1, K2 on a growing edge table).

A stored table points every node to a node of its component, at last to the smallest one. A batch of edges looks up
the roots of its own nodes, contracts its edges onto them, and runs the rounds over the contracted
edges alone. It writes pointers for its new nodes, for roots that were merged away, and, shortened, for the nodes that
it touched. Nodes of merged components that no batch touches keep their pointer, which leads over the old root to the
new one; ``labels`` resolves all of them by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.graph import connected_components
from riskloom.session import checkpoint_dir
from riskloom.sources.tables import materialised
from riskloom.streaming.state import Increments


class GrowingComponents:
    """The pointer table under ``path``. Labels only ever get smaller, so increments merge by their minimum."""

    def __init__(self, path: str, buckets: int = 32):
        self.pointers = Increments(f"{path}/pointers", "node string, parent string", ["node"], {"parent": "min"}, buckets=buckets)

    def roots(self, nodes: DataFrame, batch: int) -> DataFrame:
        """(node, root, stored) of the distinct ``nodes``: as earlier batches have left them, and the pointer stored for the node
        itself (null: a new node, its own root). One lookup per pointer on the way, of the keys still under way."""
        known = materialised(self.pointers.of_keys(nodes, batch), "pointers")
        found = nodes.join(known, "node", "left").select("node", F.coalesce("parent", "node").alias("root"), F.col("parent").alias("stored"))
        found = found.checkpoint()
        while True:
            under_way = found.where("stored <> node").select(F.col("root").alias("node")).distinct()
            step = materialised(self.pointers.of_keys(under_way, batch).where("parent <> node"), "pointers")
            if step.isEmpty():
                return found
            found = (found.join(step.select(F.col("node").alias("root"), F.col("parent").alias("further")), "root", "left")
                     .select("node", F.coalesce("further", "root").alias("root"), "stored").checkpoint())

    def add(self, edges: DataFrame, batch: int, src: str = "user", dst: str = "device") -> DataFrame:
        """Take the edges of ``batch`` (null ends are no edge; a loop makes no node). Returns (node, component) of the nodes it
        touched. A batch that is run again replaces what it wrote."""
        checkpoint_dir(edges.sparkSession)
        e = materialised(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
                         .select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "new-edges")
        nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
        found = self.roots(nodes, batch)
        ends = found.select("node", "root")
        contracted = (e.join(ends.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                      .join(ends.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select("ra", "rb"))
        merged = materialised(connected_components(contracted, "ra", "rb").select(F.col("node").alias("root"), "component"), "merged-roots")
        touched = materialised(found.join(merged, "root", "left").select("node", F.coalesce("component", "root").alias("component"), "stored"), "touched")
        pointers = (touched.where(F.col("stored").isNull() | (F.col("stored") != F.col("component"))).select("node", F.col("component").alias("parent"))
                    .unionByName(merged.where("root <> component").select(F.col("root").alias("node"), F.col("component").alias("parent"))))
        self.pointers.write(pointers.groupBy("node").agg(F.min("parent").alias("parent")), batch)
        return touched.select("node", "component")

    def labels(self, spark: SparkSession, batch: int) -> DataFrame:
        """(node, component) of every node that the batches before ``batch`` hold."""
        checkpoint_dir(spark)
        p = self.pointers.before(spark, batch).checkpoint()
        while True:
            further = p.where("node <> parent").select(F.col("node").alias("parent"), F.col("parent").alias("further"))
            step = p.join(further, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"), F.col("further").isNotNull().alias("moved")).checkpoint()
            if step.where("moved").isEmpty():
                return step.select("node", F.col("parent").alias("component"))
            p = step.select("node", "parent")
