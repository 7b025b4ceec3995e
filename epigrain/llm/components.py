"""Connected components of a link table by label spreading and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


#: Links that one task may join in memory (16 bytes each, twice that for the nodes).
TASK_LINKS = 1_000_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        above: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while above.setdefault(root, root) != root:
                root = above[root]
            while above[x] != root:
                above[x], x = root, above[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                above[max(a, b)] = min(a, b)
        nodes = sorted(above)
        for s in range(0, len(nodes), 100_000):
            part = nodes[s : s + 100_000]
            arrays = [pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "root"])

    return written(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "labels")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round lets every node take the smallest label among its neighbours and then the label of its label, so a chain shrinks
    by a factor each round. Up to ``TASK_LINKS`` links are joined by one task instead, with the same result. An empty table gives an empty result.
    """
    if edges.count() <= TASK_LINKS:
        return _in_one_task(edges)
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        took = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
        )
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(took.join(above, "root").select("node", "was", F.least("root", "next").alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("was <> root").isEmpty():
            return labels
