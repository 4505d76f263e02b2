"""Graphs between chunks and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.session import cut


def projection(mentions: DataFrame, item: str, through: str, low: int, high: int) -> DataFrame:
    """(a, b, weight): items that share keywords, by the number of them.

    Keywords with fewer than ``low`` or more than ``high`` items link nothing:
    the bound also bounds the pairs a keyword gives.
    """
    m = mentions.select(item, through).distinct()
    fit = m.groupBy(through).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(low, high)).select(through)
    held = m.join(fit, through)
    pairs = held.toDF(through, "a").join(held.toDF(through, "b"), through).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): of undirected weighted edges (a, b, weight) under labels (node, label)."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    named = edges.join(la, "a").join(lb, "b")
    inner = named.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0)).alias("within"))
    ends = named.select(F.explode(F.array(F.struct(F.col("la").alias("label"), "weight"), F.struct(F.col("lb").alias("label"), "weight"))).alias("e")).select("e.*")
    degree = ends.groupBy("label").agg(F.sum("weight").alias("d")).agg(F.sum(F.pow(F.col("d").cast("double"), 2.0)).alias("dd"))
    whole = inner.withColumn("_1", F.lit(1)).join(degree.withColumn("_1", F.lit(1)), "_1")
    return whole.select(F.round(F.col("within") / F.col("m") - resolution * F.col("dd") / F.pow(2.0 * F.col("m"), 2.0), 9).alias("modularity"))


def dense_ids(pairs: DataFrame, item: str) -> DataFrame:
    """(item, id): whole numbers from 0 without gaps, in the order of the items.

    The items are numbered within ranges of their order, and each range begins after
    the rows of those before it; only a row a range is gathered.
    """
    laid = cut(pairs.select(item).distinct().repartitionByRange(item).withColumn("_p", F.spark_partition_id()))
    sizes = laid.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    nth = F.row_number().over(W.partitionBy("_p").orderBy(item)) - 1
    return laid.withColumn("_k", nth).join(F.broadcast(before), "_p").select(item, (F.col("_b") + F.col("_k")).alias("id"))


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, label): connected components, each named by its least node.

    Each round every node takes the least label among its neighbours' and then
    that label's own label, which halves the paths; the lineage is cut.  It ends when
    nothing changes; should that not happen within ``rounds``, it is an error.
    """
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"))
    for _ in range(rounds):
        near = both.join(labels.toDF("y", "l"), "y").groupBy("x").agg(F.min("l").alias("l"))
        lowered = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("label", "l").alias("new"), F.col("label").alias("old"))
        jumped = lowered.join(labels.toDF("new", "far"), "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old")
        jumped = cut(jumped)
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def communities(edges: DataFrame, rounds: int = 10, resolution: float = 1.0, least: int = 1) -> DataFrame:
    """(node, label): communities of weighted edges (a, b, weight) by moves that raise the modularity.

    Every node begins by itself.  A node moves to the neighbouring community with the
    greatest gain, weight to it less ``resolution`` times what chance would give; only
    a half of the nodes, another by hash in each round, move, so that two don't swap for ever.  The
    best labelling met in ``rounds`` rounds by modularity stands, so more rounds never
    make it worse.  Communities of fewer than ``least`` nodes are left out.
    """
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("weight").cast("double").alias("weight")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), F.col("weight").cast("double"))))
    strength = cut(both.groupBy(F.col("x").alias("node")).agg(F.sum("weight").alias("k")))
    labels = cut(strength.select("node", F.col("node").alias("label")))
    if labels.isEmpty():
        return labels
    whole = strength.agg(F.sum("k")).first()[0]
    best, score, quiet = labels, modularity(edges, labels, resolution).first()[0], 0
    for i in range(rounds):
        weight_in = labels.join(strength, "node").groupBy("label").agg(F.sum("k").alias("s"))
        own = labels.join(strength, "node")
        votes = both.where("x <> y").join(labels.toDF("y", "l"), "y").groupBy(F.col("x").alias("node"), "l").agg(F.sum("weight").alias("w"))
        stay = own.select("node", F.col("label").alias("l"), F.lit(0.0).alias("w"))
        rated = votes.unionByName(stay).groupBy("node", "l").agg(F.sum("w").alias("w")).join(own, "node").join(weight_in.withColumnRenamed("label", "l"), "l")
        others = F.col("s") - F.when(F.col("l") == F.col("label"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / whole, 9)
        # Of equal gains the one's own community, then the least label.
        choice = rated.groupBy("node").agg(F.max(gain).alias("g"), F.max(F.when(F.col("l") == F.col("label"), gain)).alias("own"))
        tied = rated.withColumn("gain", gain).join(choice, "node").where(F.col("gain") == F.col("g")).groupBy("node").agg(F.min("l").alias("new"), F.first("own").alias("own"), F.first("g").alias("g"))
        moves = (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0) & (F.col("g") > F.col("own"))
        after = cut(labels.join(tied, "node").select("node", F.when(moves, F.col("new")).otherwise(F.col("label")).alias("label"), F.col("label").alias("old")))
        labels = after.select("node", "label")
        now = modularity(edges, labels, resolution).first()[0]
        if now > score:
            best, score = labels, now
        quiet = quiet + 1 if after.where("label <> old").isEmpty() else 0
        if quiet == 3:
            break
    sizes = best.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return best.join(sizes, "label", "left_semi").select("node", "label")
