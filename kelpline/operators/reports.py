"""Reports on detectors: gaps to reference values, hard cases by group, averages over classes, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators import metrics


def gaps(scores: DataFrame, reference: dict[str, float], detector: str = "detector") -> DataFrame:
    """Per detector its AUROC, balanced accuracy and F1, what the reference says, the difference, and the number of scores."""
    out = metrics.all_metrics(scores, [detector])
    said = F.try_element_at(F.create_map(*[F.lit(x) for kv in reference.items() for x in kv]), F.col(detector))
    return out.select(
        detector, F.round("auroc_ff", 4).alias("auroc"), F.round("bacc", 4).alias("bacc"), F.round("f1", 4).alias("f1"), said.alias("reference"),
        F.round(F.col("auroc_ff") - said, 4).alias("delta"), (F.col("n_fake") + F.col("n_real")).alias("n"),
    )


def hard_counts(items: DataFrame, groups: dict[str, tuple[int, str, int]]) -> DataFrame:
    """Of items (label, is_hard, columns of groups): name, value, hard, total and rate of each group.

    groups: name -> (label, column, least total).  One pass and one shuffle of counts serves all groups.
    """
    each = F.array(*[
        F.when(F.col("label") == label, F.struct(F.lit(name).alias("name"), F.coalesce(F.col(column), F.lit("_unlabeled")).alias("value"), F.lit(least).alias("least")))
        for name, (label, column, least) in groups.items()
    ])
    counts = items.select("is_hard", F.explode(F.array_compact(each)).alias("g")).groupBy("g.name", "g.value", "g.least")
    counts = counts.agg(F.count_if(F.col("is_hard")).alias("hard"), F.count("*").alias("total")).where("total >= least")
    return counts.select("name", "value", "hard", "total", F.round(F.col("hard") / F.greatest(F.lit(1), F.col("total")), 4).alias("rate"))


def class_averages(classes: DataFrame, detector: str = "detector") -> DataFrame:
    """Per detector the plain (macro) means of recall, precision and F1 of its classes, and how many there are."""
    means = [F.round(F.avg(c), 9).alias(f"macro_{c}") for c in ("recall", "precision", "f1")]
    return classes.groupBy(detector).agg(*means, F.count("*").alias("classes"))


def documents(results: DataFrame, slice_column: str, least: int, detector: str = "detector") -> DataFrame:
    """A JSON document for each detector (name, document) with the AUROC of each of its slices, in order of their names.

    results: detector, slice_column, n_fake, n_real and auroc; a detector has as many rows as there are slices to report.
    """
    one = F.struct(F.col(slice_column).alias("slice"), "n_fake", "n_real", F.col("auroc").cast("decimal(5,4)").alias("auroc"))
    rows = results.groupBy(detector).agg(F.max("n_fake").alias("most"), F.array_sort(F.collect_list(one)).alias("results"))
    body = F.struct(F.lit(least).alias("min_fake"), F.col("most").alias("max_n_fake"), F.col("results"))
    return rows.select(F.col(detector).alias("name"), F.to_json(body).alias("document"))
