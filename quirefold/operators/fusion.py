"""Fusing the readings of several recognisers."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from quirefold.functions import rules

FUSED = StructType([StructField("text", StringType()), StructField("agreement", DoubleType()), StructField("edits", IntegerType())])


@F.pandas_udf(FUSED)
def fuse_two(anchor: pd.Series, other: pd.Series) -> pd.DataFrame:
    """Two readings in one: the other's where they differ, the anchor's where the other has nothing.

    ``agreement`` is the share of the fused text on which both agree.
    """
    rows = []
    for a, b in zip(anchor, other):
        a, b = a or "", b or ""
        if a == b or not a or not b:
            rows.append((a or b, float(bool(a) and bool(b)), int(a != b)))
            continue
        parts, same, edits = [], 0, 0
        for op, a0, a1, b0, b1 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            edits += op != "equal"
            same += (a1 - a0) * (op == "equal")
            parts.append(a[a0:a1] if op in ("equal", "delete") else b[b0:b1])
        fused = "".join(parts)
        rows.append((fused, round(same / len(fused), 4) if fused else 0.0, edits))
    return pd.DataFrame(rows, columns=["text", "agreement", "edits"])


def has_text(x: Column) -> Column:
    return F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))


def source_of(paddle: Column, first: Column, second: Column) -> Column:
    """Which readings are fused: the anchor with the better of the others, one alone, or none."""
    a = has_text(paddle)
    good_b, good_c = (has_text(x) & rules.quality_fault(x, paddle).isNull() for x in (first, second))
    return (
        F.when(a & good_c, "anchor+second")
        .when(a & good_b, "anchor+first")
        .when(a, "anchor")
        .when(good_c, "second")
        .when(good_b, "first")
        .otherwise("none")
    )


def fused(rows: DataFrame, paddle: str, first: str, second: str) -> DataFrame:
    """Adds ``policy``, ``text``, ``agreement`` and ``edits``; only two readings that differ are aligned, and those in Arrow batches.

    ``agreement`` is null where one reading stands alone; all have failed where ``policy`` is none, and the text is empty.
    """
    a, b, c = F.col(paddle), F.col(first), F.col(second)
    named = rows.withColumn("policy", source_of(a, b, c))
    other = F.when(F.col("policy").isin("anchor+second", "second"), c).when(F.col("policy").isin("anchor+first", "first"), b)
    both = F.col("policy").startswith("anchor+")
    kept = [x for x in rows.columns if x not in (paddle, first, second)]
    chosen = named.select(*kept, "policy", F.when(F.col("policy").startswith("anchor"), a).alias("_a"), other.alias("_o"), both.alias("_both"))
    # The alignment runs only where there are two readings and they are not the same text.
    apart = F.col("_both") & (F.col("_a") != F.col("_o"))
    aligned = chosen.withColumn("_f", fuse_two(F.when(apart, F.col("_a")), F.when(apart, F.col("_o"))))
    return aligned.select(
        *kept, "policy",
        F.when(apart, F.col("_f.text")).otherwise(F.coalesce("_a", "_o", F.lit(""))).alias("text"),
        F.when(apart, F.col("_f.agreement")).when(F.col("_both"), 1.0).alias("agreement"),
        F.when(apart, F.col("_f.edits")).otherwise(0).alias("edits"),
    )
