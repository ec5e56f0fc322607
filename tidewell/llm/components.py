"""Connected components of an edge table, by joins; nothing of it passes through the driver but counts and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import cut, forget, hot_keys, join_hot


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a, b): comp is the smallest vertex of its component.

    Each round every vertex takes the smallest label among itself and its neighbours, then the label of
    that label. Labels only fall, and the second step halves paths, so rounds grow with the logarithm of
    the longest path. Edges of a hub meet its label by a broadcast of the hubs' labels, and so do the members of
    a component that holds many vertices (``join_hot``). A round's tables are deleted after the next one's.
    Null ends are ignored; an empty table gives an empty one.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(both, ["b"])
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("comp")))
    while True:
        of_end = labels.select(F.col("v").alias("b"), F.col("comp").alias("near"))
        if hubs is None:
            met = both.join(of_end, "b")
        else:
            met = both.join(hubs, "b", "left_semi").join(F.broadcast(of_end.join(hubs, "b", "left_semi")), "b")
            met = met.unionByName(both.join(hubs, "b", "left_anti").join(of_end, "b"))
        near = met.groupBy(F.col("a").alias("v")).agg(F.min("near").alias("m"))
        lower = cut(labels.join(near, "v").select("v", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")))
        roots = lower.select(F.col("v").alias("comp"), F.col("comp").alias("top"))
        after = cut(join_hot(lower, roots, ["comp"]).select("v", F.least("comp", "top").alias("comp"), "was"))
        forget(lower)
        forget(labels)
        labels = after.select("v", "comp")
        labels.tidewell_path = after.tidewell_path
        if after.where("comp <> was").isEmpty():  # labels only fall, so this comes
            forget(both)
            return labels
