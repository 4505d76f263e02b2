"""Retrieval metrics, slices and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.session import cut


def ir_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, place: str, k: int) -> DataFrame:
    """(query, ndcg, recall, precision, mrr) at k; a query without relevant items has none."""
    wanted = relevant.select(query, item).distinct()
    sizes = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("n"))
    head = ranked.where(F.col(place) <= k).select(query, item, F.col(place).alias("p"))
    returned = head.groupBy(query).agg(F.count(F.lit(1)).alias("got"))
    found = head.join(wanted, [query, item]).groupBy(query).agg(
        F.sum(1.0 / F.log2(F.col("p") + 1.0)).alias("dcg"), F.count(F.lit(1)).alias("hits"), F.min("p").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(returned, query, "left").join(found, query, "left").select(
        query,
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"),
        F.round(zero(F.col("hits") / F.col("n")), 6).alias("recall"),
        F.round(zero(F.col("hits") / F.least(F.lit(k), F.col("got"))), 6).alias("precision"),
        F.round(zero(1.0 / F.col("first")), 6).alias("mrr"),
    )


def bootstrap(values: DataFrame, order: str, value: str, rounds: int) -> DataFrame:
    """(n, mean, low, high): the mean and its 2.5 and 97.5 % percentiles over resamples.

    Draw j of round r takes the value at a hash of (r, j), so the result does not
    hang on a generator's state.  The values are numbered and laid out in a table; each
    round draws by a join on the number, so nothing is gathered in one row.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    n = rows.count()
    spark = values.sparkSession
    if not n:
        return spark.createDataFrame([(0, None, None, None)], "n bigint, mean double, low double, high double")
    laid = cut(rows.repartitionByRange("o", "v").withColumn("_p", F.spark_partition_id()))
    sizes = laid.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    numbered = laid.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy("o", "v")) - 1).join(F.broadcast(before), "_p").select((F.col("_b") + F.col("_k")).alias("i"), "v")
    drawn = F.conv(F.substring(F.sha1(F.concat_ws(":", F.col("r").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("bigint") % n
    draws = spark.range(rounds).withColumnRenamed("id", "r").select("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).select("r", drawn.alias("i")).groupBy("r", "i").agg(F.count(F.lit(1)).alias("times"))
    tries = draws.join(numbered, "i").groupBy("r").agg((F.sum(F.col("v") * F.col("times")) / n).alias("m"))
    bounds = tries.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return bounds.crossJoin(rows.agg(F.avg("v").alias("mean"))).select(F.lit(n).cast("bigint").alias("n"), *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def interval(mean: Column, low: Column, high: Column, digits: int = 4) -> Column:
    """A mean with its interval as text, n/a without a value."""
    short = lambda c: F.regexp_replace(F.round(c, digits).cast("string"), r"\.0$", ".0")
    return F.when(mean.isNull(), "n/a").otherwise(F.concat(short(mean), F.lit(" ["), short(low), F.lit(", "), short(high), F.lit("]")))


def faithfulness(rows: DataFrame, gold: DataFrame, query: str, item: str, ok: str) -> DataFrame:
    """(rows, verified, insufficient, false_negative, n) before and behind the gate.

    A false negative is a query one of whose own items (``gold``) was found and refused;
    behind the gate none can be, as the refused ones are gone.
    """
    flag = F.coalesce(F.col(ok), F.lit(False))
    share = lambda df, name: df.agg(F.lit(name).alias("rows"), F.round(F.avg(flag.cast("double")), 6).alias("verified"), F.round(F.avg((~flag).cast("double")), 6).alias("insufficient"), F.count(F.lit(1)).alias("n"))
    refused = rows.join(gold.select(query, item).distinct(), [query, item]).groupBy(query).agg(F.max((~flag).cast("int")).alias("_m"))
    missed = gold.select(query).distinct().join(refused, query, "left").agg(F.round(F.avg(F.coalesce("_m", F.lit(0)).cast("double")), 6).alias("false_negative"))
    both = share(rows, "ungated").crossJoin(missed).unionByName(share(rows.where(flag), "gated").withColumn("false_negative", F.lit(0.0)))
    return both.select("rows", "verified", "insufficient", "false_negative", "n")


def progress(done: Column, total: Column, seconds: Column) -> dict[str, Column]:
    """pct and eta (whole seconds) of a stage; no eta before anything is done or once all is."""
    rate = done / seconds
    return {"pct": F.when(total > 0, F.round(100.0 * done / total, 2)).otherwise(0.0), "eta": F.when((done > 0) & (seconds > 0) & (done < total), F.floor((total - done) / rate).cast("bigint"))}


def f1(hits: Column, found: Column, wanted: Column) -> Column:
    """The harmonic mean of precision and recall, 0 where nothing was hit."""
    return F.when((found > 0) & (wanted > 0) & (hits > 0), 2.0 * hits / (found + wanted)).otherwise(0.0)


def priority(agreement: Column, variance: Column, impact: Column, most: Column, tier: Column) -> Column:
    """The place of a page in the review queue: doubt, reach and kind of source."""
    doubt = (1 - F.coalesce(agreement, F.lit(0.0))) + 0.30 * F.coalesce(variance, F.lit(0.0))
    reach = F.when(most > 0, impact / most).otherwise(0.0)
    return F.round(0.40 * doubt + 0.40 * reach + 0.20 * F.when(tier == "primary", 1.0).otherwise(0.3), 6)
