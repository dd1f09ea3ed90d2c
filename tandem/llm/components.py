"""Connected components of an undirected graph of links, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.skew import hot_keys, split_join
from tandem.llm.storage import written


def least_labels(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """For each vertex (v, label) the least label among those of its component, and root, a vertex that stands for the component.

    links: a, b, in either direction, all of them vertices; repeated ones do no harm. A round takes the least (label, root) of the neighbours
    and then that which this root has, so the rounds grow with the logarithm of a component's diameter. Labels of different
    vertices may be equal. Each round is written to the shared folder. A star's centre, and the root of a large component, are keys of many rows: their
    rows are aggregated before the shuffle or split over tasks.
    """
    count = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    stars = hot_keys(count(both, "b"), ["b"], both.count())
    now = written(vertices.select("v", "label", F.col("v").alias("root")), "labels")
    total = now.count()
    while True:
        reached = split_join(both, now.select(F.col("v").alias("b"), "label", "root"), ["b"], stars, F.col("a"))
        near = reached.groupBy(F.col("a").alias("v")).agg(F.min(F.struct("label", "root")).alias("near"))
        own = F.struct("label", "root")
        met = now.join(near, "v", "left").select("v", own.alias("was"), F.least(own, F.coalesce("near", own)).alias("best"))
        met = written(met.withColumn("r", F.col("best.root")), "labels")
        far = now.select(F.col("v").alias("r"), own.alias("far"))
        jumped = split_join(met, far, ["r"], hot_keys(count(met, "r"), ["r"], total), F.col("v")).select("v", "was", F.least("best", "far").alias("best"))
        after = written(jumped.select("v", "best.label", "best.root", (F.col("best") < F.col("was")).alias("moved")), "labels")
        if after.where("moved").isEmpty():
            return after.select("v", "label", "root")
        now = after
