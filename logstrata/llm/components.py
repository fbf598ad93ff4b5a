"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to (node, label): each node with the least node it is connected to.

    In each round a node points to the least among itself and its neighbours, and
    from there on to where that one points. Then edges are written anew between
    the nodes that are pointed to, each once; those within one are gone. The next round
    sees only what is left, so its edges and nodes grow fewer. Everything stays
    distributed; only whether edges are left reaches the driver. No edges give no
    rows.
    """
    spark, rounds = edges.sparkSession, []
    left = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    while not left.isEmpty():
        ends = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = written(ends.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("up")), "ups")
        on = small(up.select(F.col("node").alias("up"), F.col("up").alias("label")))
        labels = written(up.join(on, "up").select("node", "label"), "labels")
        drop(up)
        rounds.append(labels)
        near = small(labels)
        moved = left.join(near.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(near.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
        after = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), "edges")
        drop(left)
        left = after
    if not rounds:
        return spark.createDataFrame([], "node long, label long")
    out = rounds[0]
    for labels in rounds[1:]:
        on = small(labels.select(F.col("node").alias("label"), F.col("label").alias("next")))
        out = out.join(on, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return out


def joined(members: DataFrame, *extra) -> DataFrame:
    """``members`` (node, center: long) to a row for each node: node, label, and the aggregates ``extra`` of its rows.

    Nodes with a center in common have the same label, and so on along chains. A
    node keeps its least center as its one edge. Only the pairs of centers that meet in
    a node, each once, go through :func:`components`, so its work grows with the
    centers and not with the members.
    """
    found = written(members.groupBy("node").agg(F.array_sort(F.collect_set("center")).alias("centers"), *extra), "centers")
    links = found.filter(F.size("centers") > 1).select(F.col("centers")[0].alias("u"), F.explode(F.slice("centers", F.lit(2), F.size("centers"))).alias("v"))
    labels = small(written(components(links), "center-labels"))
    on = labels.select(F.col("node").alias("center"), "label")
    rest = [c for c in found.columns if c not in ("node", "centers")]
    return found.withColumn("center", F.col("centers")[0]).join(on, "center", "left").select("node", F.coalesce("label", "center").alias("label"), *rest)
