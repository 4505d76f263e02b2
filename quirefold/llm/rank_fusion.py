"""One ranking from differently scaled scores: robust rank aggregation.

Each leg (list of scores) is reduced to places, 1 + the number of items with a
better score, and to normalised ranks, place / items of the leg.  An item's
normalised ranks are sorted; under the hypothesis that the legs rank it at
random the k-th smallest of n ranks follows Beta(k, n - k + 1), whose tail is a
binomial sum.  The least of these n probabilities times n (at most 1) is the
item's significance ``rho``; items are ranked by it.  A scale or distribution of
scores has no influence, each leg has the same say.

Defined cases: a null or NaN score, and a null query, leg or item, is no hit; of
repeated hits the best score counts; equal scores share the better place; an
item absent from a leg has the normalised rank 1 there; an empty table gives an
empty result; further columns are ignored.

Rows of ``fuse`` also carry the number of items of each of their legs, from which
``clear_winners`` knows the greatest rho a winner can have.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.ranking import places

def leg_places(hits: DataFrame, query: str, leg: str, item: str, score: str) -> DataFrame:
    """(query, leg, item, score, place, of), one row for each item of a leg."""
    sound = F.col(score).isNotNull() & ~F.isnan(score)
    for c in (query, leg, item):
        sound = sound & F.col(c).isNotNull()
    best = hits.where(sound).groupBy(query, leg, item).agg(F.max(F.col(score).cast("double")).alias("score"))
    return places(best, [query, leg], "score")


def significance(ranks: Column, n: int) -> Column:
    """rho of ``n`` normalised ranks given as an ascending array."""
    tails = []
    for k in range(1, n + 1):
        r = F.element_at(ranks, k)
        tails.append(sum((F.lit(float(comb(n, j))) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(n - j)) for j in range(k, n + 1)), F.lit(0.0)))
    return F.least(F.lit(1.0), F.lit(float(n)) * (F.least(*tails) if n > 1 else tails[0]))


def fuse(hits: DataFrame, legs: list[str], query: str = "query_id", leg: str = "leg", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """(query, item, rho, one ``place_<leg>`` and ``of_<leg>`` a leg): a row for each item of each query."""
    placed = leg_places(hits, query, leg, item, score).where(F.col(leg).isin(legs))
    per = placed.groupBy(query, item).agg(
        *[F.max(F.when(F.col(leg) == x, F.col("place"))).alias(f"place_{x}") for x in legs],
        *[F.max(F.when(F.col(leg) == x, F.col("of"))).alias(f"of_{x}") for x in legs],
    )
    ranks = F.array_sort(F.array(*[F.coalesce(F.col(f"place_{x}") / F.col(f"of_{x}"), F.lit(1.0)) for x in legs]))
    return per.withColumn("rho", significance(ranks, len(legs)))


def ranking(fused: DataFrame, query: str = "query_id") -> DataFrame:
    """The one ranking: adds ``place`` by significance, equal rho sharing a place."""
    return places(fused.withColumn("_less", -F.col("rho")), [query], "_less").drop("_less", "of")


def winning_rho(legs: list[str], worst: int = 3) -> Column:
    """The greatest rho of an item first in all legs but one and at worst ``worst``-th there.

    rho grows with every normalised rank, so it is that of the worst such places,
    taken over the legs in which the item may not be first.
    """
    each = []
    for last in legs:
        at = [F.least(F.lit(1.0), F.lit(float(worst if x == last else 1)) / F.col(f"of_{x}")) for x in legs]
        each.append(significance(F.array_sort(F.array(*at)), len(legs)))
    return F.greatest(*each) if len(each) > 1 else each[0]


def clear_winners(fused: DataFrame, legs: list[str]) -> DataFrame:
    """Items with a place in every leg, first in all but one of them and at worst third there.

    Significance selects the candidates: those of a rho no greater than a winner
    can have.  Their places are then checked.
    """
    likely = fused.where(F.col("rho") <= winning_rho(legs) * (1 + 1e-9))
    at = [F.col(f"place_{x}") for x in legs]
    firsts = sum((F.when(p == 1, 1).otherwise(0) for p in at), F.lit(0))
    keep = (firsts >= len(legs) - 1) & (F.greatest(*at) <= 3)
    for p in at:
        keep = keep & p.isNotNull()
    return likely.where(keep)
