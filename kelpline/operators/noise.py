"""Wrong labels by confident learning: joint counts of given and true labels, and what to prune by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators import selection


def confident_joint(rows: DataFrame) -> DataFrame:
    """given, actual and n: rows of (item, label, probs) that are confidently of a class, by the label they were given.

    A class is confident where a row's probability of it is at least the mean of the rows that were given it; of several the most
    probable counts, the first of equal ones.  Every given class has itself once at least.
    """
    mean = rows.groupBy("label").agg(F.avg(F.get("probs", F.col("label").cast("int"))).alias("cut"))
    cuts = F.map_from_entries(F.collect_list(F.struct("label", "cut")))  # a row for each class
    told = rows.join(F.broadcast(mean.agg(cuts.alias("cuts"))))  # joins one row
    place = lambda p, k: F.when(p >= F.try_element_at("cuts", k.cast(rows.schema["label"].dataType)), F.struct(p.alias("p"), (-k).alias("k")))
    best = F.array_max(F.array_compact(F.transform("probs", place)))
    counts = told.select(F.col("label").alias("given"), (-best["k"]).alias("actual")).where("actual IS NOT NULL")
    counts = counts.groupBy("given", "actual").agg(F.count("*").alias("n"))
    own = mean.select(F.col("label").alias("given"), F.col("label").cast("int").alias("actual"), F.lit(1).cast("long").alias("n"))
    return counts.unionByName(own).groupBy("given", "actual").agg(F.max("n").alias("n"))


def calibrated(joint: DataFrame, rows: DataFrame) -> DataFrame:
    """given, actual and n: the joint scaled so that each given label has as many rows as it was given, rounded down off the diagonal."""
    sums = joint.groupBy("given").agg(F.sum("n").alias("sum"))
    sizes = rows.groupBy(F.col("label").alias("given")).agg(F.count("*").alias("size"))
    scaled = joint.join(sums, "given").join(sizes, "given")
    return scaled.select("given", "actual", F.floor(F.col("n") * F.col("size") / F.col("sum")).alias("n"))


def label_issues(rows: DataFrame) -> DataFrame:
    """item, given, suggested and self_conf of the rows of (item, label, probs) that are likely mislabelled.

    By noise rate: for each given label s and other class k, as many rows as the calibrated joint has in that cell, those of the
    greatest margin p_k - p_s (all that are equal at the cut).  Rows whose most probable class is the given one stay.  suggested is
    the most probable class; the first of equal ones.  The margin of the last row pruned is selected by counts, see `selection`.
    """
    cells = calibrated(confident_joint(rows), rows).where("given <> actual AND n > 0").select("given", "actual", F.col("n").alias("prune"))
    own = F.get("probs", F.col("label").cast("int"))
    each = rows.select("item", F.col("label").alias("given"), own.alias("self_conf"), F.posexplode("probs").alias("actual", "p"), "probs")
    margins = each.where("given <> actual").withColumn("margin", F.round(F.col("p") - F.col("self_conf"), 9)).select("item", "given", "actual", "self_conf", "margin", "probs").join(cells, ["given", "actual"])
    counts = margins.groupBy("given", "actual", "margin").agg(F.count("*").alias("n"), F.max("prune").alias("prune")).checkpoint()
    sizes = counts.groupBy("given", "actual").agg(F.sum("n").alias("size"), F.max("prune").alias("prune"))
    wanted = sizes.select("given", "actual", F.greatest(F.col("size") - F.col("prune") + 1, F.lit(1)).cast("long").alias("nth"))
    cut = selection.nth(counts, ["given", "actual"], "margin", "n", wanted).select("given", "actual", F.col("found").alias("cut"))
    out = margins.join(cut, ["given", "actual"]).where("margin >= cut")
    most = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    out = out.select("item", "given", most.alias("suggested"), "self_conf").where(F.col("given") != F.col("suggested"))
    return out.dropDuplicates(["item"])
