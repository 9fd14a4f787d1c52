"""Ranks and quantiles of groups of any size: by ranges and counts, never by a window or a buffer over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS, LEVELS = 1024, 4
BROADCAST_ROWS = 200_000


def placed(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their place from 0 in the order of their group, and `size`, how many the group has.

    Rows are dealt by ranges of (group, order), so a group lies in as many ranges as its size asks for; a row's place is its place
    in its range and the counts of its group in the ranges before.  Rows equal in `order` are told apart by nothing: make it a key.
    """
    ranged = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    # A group has one row here for each range it lies in.
    before = Window.partitionBy(*group).orderBy("_range")
    counts = counts.select(*group, "_range", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("size")).checkpoint()
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    out = ranged.withColumn("_in", inside).join(counts, [*group, "_range"])
    return out.withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_range")


def nth(counts: DataFrame, group: list[str], value: str, n: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """wanted (group, nth: from 1) with `found`, the nth least value of the group; null where there are fewer.

    counts: group, value and n (how often it comes).  A span that holds the nth is narrowed LEVELS times to one of `buckets` parts;
    what it holds in the end is put in order.  Windows see a bucket a row.
    """
    keys = [*group, "nth"]
    some = counts.select(*group, F.col(value).cast("double").alias("_v"), F.col(n).alias("_n")).where("_v IS NOT NULL AND _n > 0").checkpoint()
    spans = some.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    spans = wanted.join(spans, group).where("nth BETWEEN 1 AND _all").select(*keys, F.col("nth").alias("_left"), "_lo", "_hi")
    running = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b"))

    def inside(spans: DataFrame) -> DataFrame:
        return some.join(spans, group).where("_v BETWEEN _lo AND _hi")

    for _ in range(LEVELS):
        part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
        sums = inside(spans).groupBy(*keys, "_left", part.cast("int").alias("_b")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        sums = sums.withColumn("_upto", running).where("_upto >= _left AND _upto - _n < _left")
        spans = sums.select(*keys, (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_lo", "_hi").checkpoint()
    by_value = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    last = inside(spans).groupBy(*keys, "_left", "_v").agg(F.sum("_n").alias("_n")).withColumn("_upto", by_value)
    found = last.where("_upto >= _left AND _upto - _n < _left").select(*keys, F.col("_v").alias("found"))
    return wanted.join(found, keys, "left")


def quantiles(counts: DataFrame, group: list[str], value: str, n: str, q: float, buckets: int = BUCKETS) -> DataFrame:
    """group and `quantile`, linearly interpolated between the two nearest ranks; groups without values are left out."""
    sizes = counts.where(F.col(value).isNotNull()).groupBy(*group).agg(F.sum(n).alias("_all")).checkpoint()
    at = F.lit(float(q)) * (F.col("_all") - 1)
    two = sizes.select(*group, F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("nth")).select(*group, (F.col("nth") + 1).cast("long").alias("nth"))
    ends = nth(counts, group, value, n, two, buckets).groupBy(*group).agg(F.min("found").alias("_low"), F.max("found").alias("_high"))
    share = at - F.floor(at)
    return sizes.join(ends, group).select(*group, (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("quantile"))
