"""Connected components of a table of edges, by passing least labels until none changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def forest(edges: DataFrame) -> DataFrame:
    """a, b: for each partition of `edges` as many edges as join the same nodes, each node to the least of its tree. A task
    holds the nodes of its own partition."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        arrow = pa.int64()
        for batch in batches:
            arrow = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = [x for x in root if root[x] != x]
        for k in range(0, len(nodes), 10_000):
            some = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, arrow), pa.array([find(x) for x in some], arrow)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the least node of each component; of nodes that have an edge. `edges` has columns a and b.

    Edges shrink to a forest of each partition first, by their first node, so a node with many neighbours leaves few. Then each
    round a node takes the least label among its neighbours', then its label's own label; labels end as component
    minima after a number of rounds that grows with the logarithm of path lengths in most graphs. Labels and edges are
    tables in the shared folder, so no round recomputes an earlier one; a round's table goes when the next stands. Messages are
    reduced before each exchange."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = materialise(forest(edges.where("a <> b").select("a", "b").repartition(n, "a")), "edges")
    both = few.union(few.select(F.col("b"), F.col("a")))
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        last = labels.select("node", "label")
        sent = both.join(last, both["b"] == last["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        new = last.join(sent, last["node"] == sent["a"]).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = last.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = new.join(jump, new["label"] == jump["at"], "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        before, labels = labels, materialise(new, "labels")
        changed = labels.where("label <> was").limit(1).count()
        discard(before)
        if not changed:
            discard(few)
            return labels.select("node", "label")
    raise RuntimeError("components did not settle")
