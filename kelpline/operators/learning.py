"""Agreement of clusterings, rankings, k-means and linear models on feature vectors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.operators import selection


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """nmi (arithmetic mean) and ari of two labellings, from their contingency table."""
    table = contingency(rows, a, b)
    choose = lambda n: n * (n - 1) / 2e0
    plogp = lambda n, total: -(n / total) * F.log(n / total)
    total = table.agg(F.sum("n").cast("double").alias("t"))
    rows_of = lambda k: table.groupBy(k).agg(F.sum("n").cast("double").alias("n")).join(total)  # noqa: E731  joins one row
    entropy = lambda k: rows_of(k).agg(F.sum(plogp(F.col("n"), F.col("t"))).alias(f"h_{k}"), F.sum(choose(F.col("n"))).alias(f"c_{k}"))
    joint = table.withColumn("n", F.col("n").cast("double")).join(total)
    joint = joint.agg(F.sum(plogp(F.col("n"), F.col("t"))).alias("h"), F.sum(choose(F.col("n"))).alias("c"), F.max("t").alias("t"))
    one = joint.join(entropy("a")).join(entropy("b"))  # three rows of one
    shared = F.col("h_a") + F.col("h_b") - F.col("h")
    expected = F.col("c_a") * F.col("c_b") / choose(F.col("t"))
    most = (F.col("c_a") + F.col("c_b")) / 2
    return one.select(F.try_divide(2 * shared, F.col("h_a") + F.col("h_b")).alias("nmi"), F.try_divide(F.col("c") - expected, most - expected).alias("ari"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of mean ranks, null for fewer than three rows.

    rows is a small table of groups (detectors, generators): ranks are over all of it.
    """
    def ranked(c: str):
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2e0

    both = rows.select(ranked(x).alias("p"), ranked(y).alias("q"))
    return both.agg(F.count("*").alias("n"), F.corr("p", "q").alias("rho")).select("n", F.when(F.col("n") >= 3, F.col("rho")).alias("rho"))


def vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", array_to_vector("features"))


def kmeans_sweep(rows: DataFrame, ks: list[int], seed: int = 7) -> DataFrame:
    """k, silhouette (squared Euclidean) and cost of k-means on standardized features, best k first."""
    v = vectors(rows)
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(v).transform(v).select("id", "s").checkpoint()
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="s").fit(scaled)
        silhouette = ClusteringEvaluator(featuresCol="s").evaluate(model.transform(scaled))
        out.append((k, float(silhouette), float(model.summary.trainingCost)))
    return rows.sparkSession.createDataFrame(out, "k int, silhouette double, cost double").orderBy(F.desc("silhouette"))


def stratified_folds(rows: DataFrame, by: str, folds: int, seed: str = "0") -> DataFrame:
    """rows with a fold from 0 to folds - 1: those of each class are dealt in turn, in the order of a keyed hash, so that the
    parts of a class differ in size by one at most."""
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("id").cast("string")).cast("binary"))
    ranked = selection.placed(rows.withColumn("_order", order), [by], ["_order", "id"])
    return ranked.withColumn("fold", F.pmod("place", F.lit(folds)).cast("int")).drop("_order", "place", "size")


def cross_validated(rows: DataFrame, folds: int = 5) -> DataFrame:
    """id, generator, fold, predicted, confidence and top3 (classes, likeliest first) out of fold, by multinomial regression
    balanced over classes; features are standardized by the other folds alone."""
    named = stratified_folds(rows.where("generator IS NOT NULL"), "generator", folds)
    counts = named.groupBy("generator").agg(F.count("*").alias("n"))
    named = vectors(named.join(counts, "generator").withColumn("weight", 1e0 / F.col("n")))
    indexer = StringIndexer(inputCol="generator", outputCol="y", stringOrderType="alphabetAsc").fit(named)
    known = indexer.transform(named).checkpoint()
    parts = []
    for fold in range(folds):
        there, here = known.where(F.col("fold") != fold), known.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(there)
        model = LogisticRegression(featuresCol="s", labelCol="y", weightCol="weight", regParam=0.01, maxIter=50).fit(scaler.transform(there))
        parts.append(model.transform(scaler.transform(here)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    names = F.array(*[F.lit(x) for x in indexer.labels])
    ranked = F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("minus"), i.alias("i")))
    ranked = F.transform(F.slice(F.array_sort(ranked), 1, 3), lambda x: F.get(names, x["i"]))
    return out.select("id", "generator", "fold", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"), ranked.alias("top3"))


def early_stop(rows: DataFrame, series: str, step: str, value: str, patience: int) -> DataFrame:
    """Per series: best_step (the first of the greatest value), best_value, steps_run and stopped.

    Values are read in the order of steps until `patience` of them in a row do not exceed the greatest so far (a strict
    comparison, so an equal one counts as none); null and NaN values never exceed.  A series is a run's measurements, one a step.
    """
    order = Window.partitionBy(series).orderBy(step)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    v = F.when(~F.isnan(value), F.col(value))
    at = rows.select(series, step, v.alias("_v"), F.row_number().over(order).alias("_at"), F.max(v).over(before).alias("_most"))
    better = F.col("_v").isNotNull() & (F.col("_most").isNull() | (F.col("_v") > F.col("_most")))
    at = at.withColumn("_last", F.coalesce(F.max(F.when(better, F.col("_at"))).over(order), F.lit(0))).withColumn("_better", better)
    at = at.withColumn("_idle", F.col("_at") - F.col("_last"))
    ended = F.coalesce(F.max(F.when(F.col("_idle") >= patience, 1)).over(before), F.lit(0))
    run = at.withColumn("_ended", ended).where("_ended = 0")
    best = F.max_by(F.struct(step, "_v"), F.when(F.col("_better"), F.col("_at"))).alias("_best")
    out = run.groupBy(series).agg(best, F.count("*").alias("steps_run"), (F.max("_idle") >= patience).alias("stopped"))
    return out.select(series, F.col(f"_best.{step}").alias("best_step"), F.col("_best._v").alias("best_value"), "steps_run", "stopped")


def aligned_features(tables: list[DataFrame], names: list[str]) -> DataFrame:
    """id and one array per table (id, features), and their concatenation `features`; all tables must have the same ids, once each.

    Ids are compared by counts and one join; a table with other ids, or an id twice, is an error that says which.
    """
    counts = [t.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first() for t in tables]
    for name, c in zip(names, counts, strict=True):
        if c.n != c.ids or c.n != counts[0].n:
            raise ValueError(f"{name} has {c.n} rows of {c.ids} ids, {names[0]} has {counts[0].n}")
    out = tables[0].select("id", F.col("features").alias(names[0]))
    for t, name in zip(tables[1:], names[1:], strict=True):
        out = out.join(t.select("id", F.col("features").alias(name)), "id")
    out = out.checkpoint()
    if out.count() != counts[0].n:
        raise ValueError(f"ids of {', '.join(names)} differ: {out.count()} of {counts[0].n} are in all")
    return out.withColumn("features", F.concat(*names))


def linear_probe(rows: DataFrame) -> DataFrame:
    """auroc and n of a linear probe on rows with label 1 or 0, tested on a fifth by keyed hash."""
    v = vectors(rows).withColumn("y", F.col("label").cast("double")).withColumn("test", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=1e-3, maxIter=50).fit(v.where(~F.col("test")))
    scored = model.transform(v.where("test"))
    auroc = BinaryClassificationEvaluator(labelCol="y").evaluate(scored)
    return scored.agg(F.lit(float(auroc)).alias("auroc"), F.count("*").alias("n"))
