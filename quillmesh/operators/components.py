"""Connected components: tasks contract edges to spanning forests, then minimum labels spread with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.storage import written


#: Nodes of a task's spanning forest that are held before it is sent on.
FOREST_NODES = 500_000


class SpanningForest:
    """Edges as a spanning forest of stars: (least node of the component, node), so each node goes out about once."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, i: int) -> int:
        up = self.up
        while (p := up.get(i, i)) != i:
            up[i] = i = up.get(p, p)
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def taken(self) -> list[tuple[int, int]]:
        """The edges so far; the forest is empty afterwards."""
        out = [(self.find(i), i) for i in list(self.up)]
        self.up = {}
        return out


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b) with the components of `edges` (two bigint columns), but about one edge for each node and task: edges are dealt out
    at random to a few tasks, which replace them by spanning forests. Dense groups lose most of their edges here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = SpanningForest()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def sent() -> pa.RecordBatch:
            own = forest.taken()
            return pa.record_batch([pa.array([v[i] for v in own], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(i, j)
            if len(forest.up) > FOREST_NODES:
                yield sent()
        yield sent()

    tasks = max(4, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return edges.repartition(tasks).mapInArrow(run, "a long, b long").distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = SpanningForest()
    for batch in batches:
        for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(i, j)
    out = forest.taken()
    yield pa.record_batch([pa.array([v[1] for v in out], pa.int64()), pa.array([v[0] for v in out], pa.int64())], ["node", "label"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = FOREST_NODES) -> DataFrame:
    """(node, component): for every node of `edges` the smallest node that it reaches.

    Edges are first contracted to spanning forests within tasks. If at most `one_task` edges are left, one task joins them, which
    bounds what it holds. Else labels spread in rounds until nothing changes: each round sends labels along edges in both
    directions, then follows labels of labels, so a path of length n needs about log n rounds. Messages are pre-aggregated before
    their shuffle; a hub's edges join through splittable skew joins; labels are written to the shared folder each round. Null
    ends are dropped; an empty edge table gives an empty result; repeated edges and loops change nothing.
    """
    e = edges.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).where("src is not null and dst is not null and src <> dst")
    e = written(contracted(e).select(F.col("a").alias("src"), F.col("b").alias("dst")), "edges")
    loops = edges.select(F.col(a).cast("long").alias("node")).unionByName(edges.select(F.col(b).cast("long").alias("node"))).where("node is not null").distinct()
    if e.count() <= one_task:
        labels = written(e.coalesce(1).mapInArrow(_stars, "node long, label long"), "labels")
    else:
        both = written(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
        labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
        changed = True
        while changed:
            sent = both.join(labels, both.src == labels.node).groupBy("dst").agg(F.min("label").alias("heard"))
            heard = labels.join(sent, labels.node == sent.dst, "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("next"))
            heard = written(heard, "heard")
            up = heard.select(F.col("node").alias("at"), F.col("next").alias("over"))
            jumped = written(heard.join(up, heard.next == up.at, "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("over", "next")).alias("label")), "labels")
            changed = bool(jumped.where("old <> label").limit(1).count())
            labels = jumped.select("node", "label")
    return loops.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))
