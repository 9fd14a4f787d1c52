"""Ranking and threshold metrics as grouped aggregations.

AUROC needs no self-join: rows are first counted by (group, score), then one running count per group gives the pairs
ranked rightly.  Scores are dealt over buckets, so a group's running count is over buckets first and within each bucket
then, and no group is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.operators import selection

#: Credit, in halves, for a fake and a real with equal scores.
TIES = {"fakes_first": 2, "midrank": 1}


def histogram(df: DataFrame, group: list[str]) -> DataFrame:
    """Fakes and reals by group and score; label 1 is fake."""
    return df.groupBy(*group, "score").agg(F.count_if(F.col("label") == 1).alias("nf"), F.count_if(F.col("label") == 0).alias("nr"))


def auroc_of_histogram(hist: DataFrame, group: list[str], ties: dict[str, str], buckets: int = 1024) -> DataFrame:
    """Per group n_fake, n_real and one AUROC column per entry of ties (column -> policy); null where a class is empty."""
    bucketed = hist.withColumn("bucket", F.floor(F.col("score") * buckets))
    totals = bucketed.groupBy(*group, "bucket").agg(F.sum("nf").alias("nf"))
    above = F.coalesce(F.sum("nf").over(Window.partitionBy(*group).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*group, "bucket", above.alias("above"))
    inside = Window.partitionBy(*group, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("within", F.coalesce(F.sum("nf").over(inside), F.lit(0))).join(totals, [*group, "bucket"])
    before = F.col("above") + F.col("within")
    sums = [F.sum(F.col("nr") * (2 * before + TIES[p] * F.col("nf"))).alias(f"_{c}") for c, p in ties.items()]
    out = ranked.groupBy(*group).agg(F.sum("nf").alias("n_fake"), F.sum("nr").alias("n_real"), *sums)
    pairs = 2 * F.col("n_fake") * F.col("n_real")
    return out.select(*group, "n_fake", "n_real", *[F.try_divide(F.col(f"_{c}").cast("double"), pairs.cast("double")).alias(c) for c in ties])


def auroc(df: DataFrame, group: list[str], ties: dict[str, str] | None = None) -> DataFrame:
    return auroc_of_histogram(histogram(df, group), group, ties or {"auroc": "fakes_first"})


def at_threshold(df: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """Balanced accuracy and F1 at a threshold; empty classes count as one row, F1 is 0 without hits."""
    fake, high = F.col("label") == 1, F.col("score") >= threshold
    counts = df.groupBy(*group).agg(
        F.count_if(fake & high).alias("tp"), F.count_if(~fake & high).alias("fp"), F.count_if(fake).alias("p"), F.count_if(~fake).alias("n")
    )
    return counts.select(*group, balanced_accuracy().alias("bacc"), f1().alias("f1"))


def balanced_accuracy() -> Column:
    sens = F.col("tp") / F.greatest(F.lit(1), F.col("p")).cast("double")
    spec = (F.col("n") - F.col("fp")) / F.greatest(F.lit(1), F.col("n")).cast("double")
    return (sens + spec) / 2


def f1() -> Column:
    return F.when(F.col("tp") > 0, 2e0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).otherwise(0e0)


def all_metrics(df: DataFrame, group: list[str]) -> DataFrame:
    ranked = auroc(df, group, {"auroc_ff": "fakes_first", "auroc_mid": "midrank"})
    return ranked.join(at_threshold(df, group), group)


def against_pool(df: DataFrame, detector: str, slice_by: str, least: int) -> DataFrame:
    """AUROC of each slice's fakes against all reals of the detector, for slices of at least `least` fakes.

    Rows are counted by score once, in a table that all else is taken from; they are never copied per slice.
    """
    counts = histogram(df, [detector, slice_by]).checkpoint()
    fakes = counts.where("nf > 0").select(detector, slice_by, "score", "nf")
    large = fakes.groupBy(detector, slice_by).agg(F.sum("nf").alias("n")).where(F.col("n") >= least).select(detector, slice_by)
    reals = counts.where("nr > 0").groupBy(detector, "score").agg(F.sum("nr").alias("nr"))
    some = fakes.join(large, [detector, slice_by]).select(detector, slice_by, "score", "nf", F.lit(0).cast("long").alias("nr"))
    pool = large.join(reals, detector).select(detector, slice_by, "score", F.lit(0).cast("long").alias("nf"), "nr")
    hist = some.union(pool).groupBy(detector, slice_by, "score").agg(F.sum("nf").alias("nf"), F.sum("nr").alias("nr"))
    return auroc_of_histogram(hist, [detector, slice_by], {"auroc": "fakes_first"})


def against_own_pool(df: DataFrame, detector: str, platform: str, least: int, least_same: int = 1) -> DataFrame:
    """AUROC of each platform's fakes against its own reals if there are least_same of them, else all reals.

    Rows are counted by score once, in a table that all else is taken from.
    """
    counts = histogram(df, [detector, platform]).checkpoint()
    large = counts.groupBy(detector, platform).agg(F.sum("nf").alias("nf"), F.sum("nr").alias("own"))
    large = large.where(F.col("nf") >= least).select(detector, platform, F.when(F.col("own") >= least_same, "same").otherwise("global").alias("real_src"))
    reals = counts.where("nr > 0").select(detector, platform, "score", "nr")
    own = large.where("real_src = 'same'").join(reals, [detector, platform]).select(detector, platform, "real_src", "score", "nr")
    every = reals.groupBy(detector, "score").agg(F.sum("nr").alias("nr"))
    rest = large.where("real_src = 'global'").join(every, detector).select(detector, platform, "real_src", "score", "nr")
    fakes = counts.where("nf > 0").select(detector, platform, "score", "nf")
    fakes = fakes.join(large, [detector, platform]).select(detector, platform, "real_src", "score", "nf", F.lit(0).cast("long").alias("nr"))
    pool = own.union(rest).select(detector, platform, "real_src", "score", F.lit(0).cast("long").alias("nf"), "nr")
    hist = fakes.union(pool).groupBy(detector, platform, "real_src", "score").agg(F.sum("nf").alias("nf"), F.sum("nr").alias("nr"))
    return auroc_of_histogram(hist, [detector, platform, "real_src"], {"auroc": "fakes_first"})


def tpr_at_fpr(df: DataFrame, group: list[str], fpr: float = 0.05) -> DataFrame:
    """Share of fakes at or over the (1 - fpr) quantile of reals, linearly interpolated."""
    reals = df.where("label = 0").groupBy(*group, "score").agg(F.count("*").alias("n"))
    cut = selection.quantiles(reals, group, "score", "n", 1 - fpr).withColumnRenamed("quantile", "threshold")
    hits = df.where("label = 1").join(cut, group).groupBy(*group, "threshold")
    hits = hits.agg(F.count_if(F.col("score") >= F.col("threshold")).alias("hit"), F.count("*").alias("n"))
    return hits.select(*group, "threshold", (F.col("hit") / F.col("n")).alias("tpr"))


def rank_normalized(df: DataFrame, detector: str = "detector", item: str = "video") -> DataFrame:
    """Ranks from 0 to 1 of each detector's scores, ties in the order of items; the last score of a pair counts."""
    last = df.groupBy(detector, item).agg(F.max_by("score", "seq").alias("score"), F.max("label").alias("label"))
    ranked = selection.placed(last, [detector], ["score", item])
    norm = F.col("place") / F.greatest(F.col("size") - 1, F.lit(1)).cast("double")
    return ranked.withColumn("rank_norm", norm).drop("place", "size")


def ensemble(df: DataFrame, detector: str = "detector", item: str = "video") -> DataFrame:
    """Mean of an item's ranks over its detectors, n_det of them, and how sure that mean is of the label."""
    mean = rank_normalized(df, detector, item).groupBy(item).agg(
        F.max("label").alias("label"), F.count("*").alias("n_det"), F.avg("rank_norm").alias("ensemble")
    )
    conf = F.when(F.col("label") == 1, F.col("ensemble")).otherwise(1 - F.col("ensemble"))
    return mean.withColumn("conf", conf).withColumn("is_hard", F.col("conf") < 0.6)


def auroc_stable(df: DataFrame, group: list[str], seq: str = "seq", buckets: int = 1024) -> DataFrame:
    """Per group the AUROC when equal scores keep the order of `seq`: a real loses to a fake only if that comes first.

    Rows of one score are dealt over buckets of `seq`, which are counted first, as scores are in auroc_of_histogram, so a
    score that very many rows share is not one task's work.
    """
    hist = histogram(df, group)
    strict = auroc_of_histogram(hist, group, {"above": "fakes_first"})
    tied = hist.where((F.col("nf") > 0) & (F.col("nr") > 0)).select(*group, "score", F.col("nf").alias("all_nf"), F.col("nr").alias("all_nr"))
    rows = df.join(tied, [*group, "score"]).withColumn("bucket", F.floor(F.col(seq) / buckets))
    fake = F.when(F.col("label") == 1, 1).otherwise(0)
    sums = rows.groupBy(*group, "score", "bucket").agg(F.sum(fake).alias("nf"))
    earlier = Window.partitionBy(*group, "score").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "score", "bucket", F.coalesce(F.sum("nf").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(*group, "score", "bucket").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(fake).over(inside), F.lit(0))).join(sums, [*group, "score", "bucket"])
    # Where all tied fakes come first a real loses to all; what comes after a real is given back.
    lost = rows.where("label = 0").groupBy(*group).agg(F.sum(F.col("all_nf") - F.col("earlier") - F.col("inside")).alias("lost"))
    pairs = F.col("n_fake").cast("double") * F.col("n_real")
    rank = F.round(F.col("above") * pairs) - F.coalesce("lost", F.lit(0)).cast("double")
    return strict.join(lost, group, "left").select(*group, "n_fake", "n_real", F.try_divide(rank, pairs).alias("auroc"))


def slices_against_reals(slices: DataFrame, reals: DataFrame, detector: str, fpr: float = 0.05) -> DataFrame:
    """AUROC, balanced accuracy and F1 at 0.5, and the share of fakes over the (1 - fpr) quantile of all reals, by slice.

    slices: detector, slice, pool, score, nf (counts of fakes); reals: detector, pool, score, nr, where the pool `global`
    holds all.  Everything is taken from counts by score.
    """
    keys = [detector, "slice", "pool"]
    over = lambda n, c: F.sum(F.when(c, F.col(n)).otherwise(0))
    high = F.col("score") >= 0.5
    cut = reals.where("pool = 'global'").groupBy(detector).agg(F.percentile("score", F.lit(1 - fpr), F.col("nr")).alias("cut"))
    fakes = slices.join(cut, detector, "left").groupBy(*keys).agg(F.sum("nf").alias("p"), over("nf", high).alias("tp"), over("nf", F.col("score") >= F.col("cut")).alias("hit"))
    pools = reals.groupBy(detector, "pool").agg(F.sum("nr").alias("n"), over("nr", high).alias("fp"))
    pool = slices.select(*keys).distinct().join(reals, [detector, "pool"])
    none = F.lit(0).cast("long")
    hist = slices.select(*keys, "score", "nf", none.alias("nr")).union(pool.select(*keys, "score", none, "nr"))
    hist = hist.groupBy(*keys, "score").agg(F.sum("nf").alias("nf"), F.sum("nr").alias("nr"))
    area = auroc_of_histogram(hist, keys, {"auroc": "fakes_first"})
    at = fakes.join(pools, [detector, "pool"])
    bacc = (F.col("tp") / F.col("p").cast("double") + (F.col("n") - F.col("fp")) / F.col("n").cast("double")) / 2
    at = at.select(*keys, bacc.alias("bacc"), f1().alias("f1"), (F.col("hit") / F.col("p")).alias("tpr5"))
    return area.join(at, keys)
