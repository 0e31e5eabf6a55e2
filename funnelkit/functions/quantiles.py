"""Exact lower medians of whole numbers by narrowing histograms.

The values of each key are counted once; then four rounds narrow the median's
place by 16 bits each: the counts are summed per bucket of the bits seen so
far, the bucket in which the running sum reaches the rank is taken, and the
next round looks only into it.  A window partition holds at most 65,536
buckets, every sum is combined map-side, and all rounds read the one exchange
of the counts.  The result is the element ``percentile_disc(0.5)`` gives, for
inputs of every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16


def exact_medians(values: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``keys, n, total, median`` per key over the non-null bigint ``value``: number, exact sum (decimal), lower median.

    The keys are a fixed vocabulary (platforms, metrics), so the rows that a round sends to every task have that bound.
    """
    c = F.col
    counts = values.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    at_key, up_to = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    state = None
    for shift in range(64 - BITS, -1, -BITS):
        bucket = F.shiftright(value, shift).alias("bucket")
        if state is None:
            sums = counts.groupBy(*keys, bucket).agg(F.sum("c").alias("c"), F.sum(c(value).cast("decimal(20,0)") * c("c")).cast("decimal(38,0)").alias("s"))
            sums = sums.withColumns({"n": F.sum("c").over(at_key), "total": F.sum("s").over(at_key)})
            sums = sums.withColumn("rank", F.expr("(n + 1) div 2"))
        else:
            inside = counts.join(F.broadcast(state), keys).where(F.shiftright(value, shift + BITS) == c("at"))
            sums = inside.groupBy(*keys, "n", "total", "rank", bucket).agg(F.sum("c").alias("c"))
        run = sums.withColumn("cum", F.sum("c").over(up_to)).where((c("cum") >= c("rank")) & (c("cum") - c("c") < c("rank")))
        state = run.select(*keys, "n", "total", (c("rank") - c("cum") + c("c")).alias("rank"), c("bucket").alias("at"))
    return state.select(*keys, "n", c("total").cast("decimal(38,0)").alias("total"), c("at").alias("median"))
