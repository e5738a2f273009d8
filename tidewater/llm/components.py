"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.staging import write_stage


def components(links: DataFrame) -> DataFrame:
    """a, b -> node, label: the least node of its component.

    Every round takes the least label around each node and then that label's
    own label; it ends when nothing changes.  Labels are written each round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = write_stage(both, "links")
    labels = write_stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = write_stage(lower.join(up, "label", "left").select("node", "old", F.least("label", "top").alias("label")), "labels")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def few_components(links: DataFrame) -> DataFrame:
    """The same in one task, for links whose number has been checked; a, b are binary."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for rows in batches:
            for a, b in zip(rows["a"], rows["b"]):
                a, b = top(bytes(a)), top(bytes(b))
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        yield pd.DataFrame({"node": nodes, "label": [top(x) for x in nodes]})

    return links.select("a", "b").coalesce(1).mapInPandas(joined, "node binary, label binary")
