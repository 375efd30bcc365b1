"""Problem 1: percentiles of very large numeric columns, with a bound on the relative error of the value.

A value x is counted in the bucket ceil(log(|x|) / log(g)) of its sign, where g = (1 + a) / (1 - a). The bucket's
representative 2 g^i / (g + 1) differs from every value in it by at most a * |x|. A sketch is a table of bucket counts;
sketches of other partitions, files or days are combined by adding up equal buckets. The number of buckets per group is
bounded by the format of doubles (about 1,420 / a of either sign), whatever the number of rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Sizes that 32 bits hold to their full precision.
FLOATS = (2.0**-126, 3.4e38)


class Accuracy:
    """The relative error a that quantiles keep to; a little of it is left for rounding to 32 bits."""

    def __init__(self, error: float = 0.01):
        if not 0 < error < 1:
            raise ValueError("the error must lie between 0 and 1")
        self.error = error
        inner = error - 2e-7 if error > 1e-6 else error * 0.8
        self.gamma = (1 + inner) / (1 - inner)
        self.log_gamma = math.log(self.gamma)

    def bucket(self, x: Column) -> Column:
        """Signed bucket: (sign, index). Positive and negative values have mirrored buckets, zero has its own."""
        return F.when(x == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(x)) / F.lit(self.log_gamma)).cast("int"))

    def value(self, sign: Column, index: Column) -> Column:
        size = F.pow(F.lit(self.gamma), index) * F.lit(2 / (self.gamma + 1))
        # the power itself may exceed a double where the value doesn't
        largest = F.least(F.pow(F.lit(self.gamma), index - 1) * F.lit(2 * self.gamma / (self.gamma + 1)), F.lit(sys.float_info.max))
        return F.when(sign == 0, F.lit(0.0)).otherwise(sign * F.when(size < float("inf"), size).otherwise(largest))


def sketch(df: DataFrame, groups: Sequence[str], values: Mapping[str, Column], accuracy: Accuracy | None = None) -> DataFrame:
    """Bucket counts: groups, metric, kind, sign, bucket, n.

    kind is ``value``, or ``null``, ``nan``, ``-inf`` or ``inf`` for what has no bucket; those are counted apart. Null groups form
    groups of their own. One row of df adds one count to each metric; rows are never gathered, as counts are summed
    before and after the shuffle. An empty table gives no rows; repeated rows count as often as they stand.
    """
    accuracy = accuracy or Accuracy()
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("x")) for m, v in values.items()]))
    rows = df.select(*groups, metrics.alias("_m")).select(*groups, "_m.metric", "_m.x")
    x = F.col("x")
    kind = F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("value")
    rows = rows.select(*groups, "metric", kind.alias("kind"), x)
    is_value = F.col("kind") == "value"
    return (
        rows.withColumn("sign", F.when(is_value, F.signum(x)).cast("int"))
        .withColumn("bucket", F.when(is_value, accuracy.bucket(x)))
        .groupBy(*groups, "metric", "kind", "sign", "bucket")
        .agg(F.count("*").alias("n"))
    )


def combine(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of one accuracy, added up to the given (coarser or equal) groups."""
    return sketches.groupBy(*groups, "metric", "kind", "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], probs: Sequence[float], accuracy: Accuracy | None = None) -> DataFrame:
    """One row per group and metric: n, n_null, n_nan, rel_error and a column ``p…`` for each of probs.

    p is the value of rank floor(p * (n - 1)), counted from 0, among the n finite and infinite values; what is given
    differs from it by at most rel_error times its size. A group without values has null percentiles. Estimates are
    rounded to 32 bits, inside the stated error, where 32 bits hold their size in full; others stay doubles.
    """
    accuracy = accuracy or Accuracy()
    by = [*groups, "metric"]
    has = F.col("kind").isin("value", "inf", "-inf")
    # all values of a sign in order: falling bucket for negative ones
    place = F.when(F.col("kind") == "-inf", F.lit(-(2**31))).when(F.col("kind") == "inf", F.lit(2**31)).otherwise(F.col("sign") * (F.col("bucket").cast("bigint") + 2**24))
    w = Window.partitionBy(*by).orderBy("_place")
    ranked = sketches.filter(has).withColumn("_place", place)
    ranked = ranked.withColumn("_to", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    estimate = F.when(F.col("kind") == "inf", float("inf")).when(F.col("kind") == "-inf", float("-inf")).otherwise(accuracy.value(F.col("sign"), F.col("bucket")))
    ranked = ranked.withColumn("_x", F.when(F.abs(estimate).between(*FLOATS), estimate.cast("float").cast("double")).otherwise(estimate))
    out = []
    for p in probs:
        rank = F.floor(F.lit(float(p)) * (F.col("_all") - 1))
        out.append(F.max(F.when((F.col("_to") > rank) & (F.col("_to") - F.col("n") <= rank), F.col("_x"))).alias(f"p{p * 100:g}".replace(".", "_")))
    found = ranked.groupBy(*by).agg(*out)
    counts = sketches.groupBy(*by).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("kind") == "nan", F.col("n")).otherwise(0)).alias("n_nan"),
    )
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    return counts.alias("c").join(found.alias("f"), on, "left").select("c.*", F.lit(accuracy.error).alias("rel_error"), *[f"f.{c}" for c in found.columns if c not in by])
