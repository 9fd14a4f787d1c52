"""Registered queries about detector scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.operators import metrics, noise, selection
from kelpline.sources import adapters as A
from kelpline.sources.session import with_checkpoints

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scored(spark, sf_dir):
    """Scores with the platform and generator of their video; empty generators have none."""
    v = A.videos(spark, sf_dir).select(F.col("id").alias("video_id"), "source_platform", F.nullif("claimed_generator", F.lit("")).alias("generator"))
    return A.scores(spark, sf_dir).join(v, "video_id")


SCORED = f"WITH {A.VIDEOS_SQL}, {A.SCORES_SQL}, x AS (SELECT s.*, v.source_platform, nullif(v.claimed_generator, '') AS generator FROM v_scores s JOIN v_videos v ON v.id = s.video_id)"


def auroc_sql(source: str, group: str, ties: dict[str, int], extra: str = "") -> str:
    """CTEs h and r: score counts of `source` (columns of group, score, label) and the sums of an AUROC per group."""
    sums = ", ".join(f"sum(nr * (2 * before + {w} * nf))::DOUBLE / (2 * sum(nf) * sum(nr))::DOUBLE AS {c}" for c, w in ties.items())
    sums = ", ".join(
        f"CASE WHEN sum(nf) > 0 AND sum(nr) > 0 THEN sum(nr * (2 * before + {w} * nf))::DOUBLE / (2 * sum(nf) * sum(nr))::DOUBLE END AS {c}" for c, w in ties.items()
    )
    return (
        f"h AS (SELECT {group}, score, count(*) FILTER (label = 1) AS nf, count(*) FILTER (label = 0) AS nr FROM {source} GROUP BY ALL),"
        f" c AS (SELECT *, coalesce(sum(nf) OVER (PARTITION BY {group} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),"
        f" r AS (SELECT {group}, sum(nf)::BIGINT AS n_fake, sum(nr)::BIGINT AS n_real, {sums} FROM c GROUP BY {group})"
    )


THRESHOLD = (
    "t AS (SELECT {g}, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,"
    " count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {s} GROUP BY {g}),"
    " m AS (SELECT {g}, (tp / greatest(1, p)::DOUBLE + (n - fp) / greatest(1, n)::DOUBLE) / 2 AS bacc,"
    " CASE WHEN tp > 0 THEN 2e0 * tp / (tp + fp + p) ELSE 0e0 END AS f1 FROM t)"
)


@query(
    f"WITH {A.SCORES_SQL}, " + auroc_sql("v_scores", "detector", {"auroc_ff": 2, "auroc_mid": 1}) + ", " + THRESHOLD.format(g="detector", s="v_scores")
    + " SELECT detector, n_fake, n_real, auroc_ff, auroc_mid, bacc, f1 FROM r JOIN m USING (detector)"
)
def auroc_by_detector(spark, sf_dir):
    return metrics.all_metrics(A.scores(spark, sf_dir), ["detector"])


@query(
    f"WITH {A.BIG_SCORES_SQL}, " + auroc_sql("v_bigscores", "detector, platform", {"auroc_ff": 2, "auroc_mid": 1}) + ", "
    + THRESHOLD.format(g="detector, platform", s="v_bigscores")
    + " SELECT detector, platform, n_fake, n_real, auroc_ff, auroc_mid, bacc, f1 FROM r JOIN m USING (detector, platform)"
)
def auroc_big(spark, sf_dir):
    return metrics.all_metrics(A.big_scores(spark, sf_dir), ["detector", "platform"])


@query(
    SCORED + ", g AS (SELECT detector, coalesce(generator, '_unlabeled') AS generator, score FROM x WHERE label = 1),"
    " k AS (SELECT detector, generator FROM g GROUP BY ALL HAVING count(*) >= 5),"
    " u AS (SELECT g.detector, g.generator, score, 1 AS label FROM g JOIN k USING (detector, generator)"
    " UNION ALL SELECT x.detector, k.generator, x.score, 0 FROM x JOIN k ON k.detector = x.detector WHERE label = 0), "
    + auroc_sql("u", "detector, generator", {"auroc": 2}) + " SELECT detector, generator, n_fake, n_real, auroc FROM r"
)
def auroc_by_detector_generator(spark, sf_dir):
    df = scored(with_checkpoints(spark), sf_dir).withColumn("generator", F.coalesce("generator", F.lit("_unlabeled")))
    return metrics.against_pool(df, "detector", "generator", 5)


@query(
    SCORED + ", k AS (SELECT detector, source_platform, CASE WHEN count(*) FILTER (label = 0) >= 30 THEN 'same' ELSE 'global' END AS real_src FROM x"
    " GROUP BY ALL HAVING count(*) FILTER (label = 1) >= 5),"
    " u AS (SELECT x.detector, x.source_platform, real_src, score, 1 AS label FROM x JOIN k ON k.detector = x.detector AND k.source_platform = x.source_platform WHERE label = 1"
    " UNION ALL SELECT k.detector, k.source_platform, real_src, score, 0 FROM x JOIN k ON k.detector = x.detector AND (k.source_platform = x.source_platform OR real_src = 'global')"
    " WHERE label = 0), " + auroc_sql("u", "detector, source_platform, real_src", {"auroc": 2})
    + " SELECT detector, source_platform, real_src, n_fake, n_real, auroc FROM r"
)
def auroc_by_detector_platform(spark, sf_dir):
    return metrics.against_own_pool(scored(with_checkpoints(spark), sf_dir), "detector", "source_platform", 5, 30)


@query(SCORED + ", " + auroc_sql("x", "source_platform", {"a": 2}) + " SELECT source_platform, n_fake, n_real, CASE WHEN n_fake >= 5 AND n_real >= 1 THEN a END AS auroc FROM r")
def group_heatmap(spark, sf_dir):
    out = metrics.auroc(scored(spark, sf_dir), ["source_platform"])
    return out.withColumn("auroc", F.when((F.col("n_fake") >= 5) & (F.col("n_real") >= 1), F.col("auroc")))


@query(
    f"WITH {A.SCORES_SQL}, q AS (SELECT detector, quantile_cont(score, 0.95) AS threshold FROM v_scores WHERE label = 0 GROUP BY 1)"
    " SELECT detector, threshold, count(*) FILTER (score >= threshold) / count(*)::DOUBLE AS tpr FROM v_scores JOIN q USING (detector) WHERE label = 1 GROUP BY 1, 2"
)
def tpr_at_fpr(spark, sf_dir):
    return metrics.tpr_at_fpr(A.scores(with_checkpoints(spark), sf_dir), ["detector"])


@query(
    SCORED + ", u AS (SELECT 'all' AS slice_group, 'all' AS slice_label, score, label FROM x"
    " UNION ALL SELECT 'platform', source_platform, score, label FROM x UNION ALL SELECT 'not_bilibili', 'complement', score, label FROM x WHERE source_platform <> 'bilibili'), "
    + auroc_sql("u", "slice_group, slice_label", {"auroc": 2}) + " SELECT slice_group, slice_label, n_fake, n_real, auroc FROM r"
)
def slice_matrix(spark, sf_dir):
    slices = F.array(
        F.struct(F.lit("all").alias("slice_group"), F.lit("all").alias("slice_label")),
        F.struct(F.lit("platform").alias("slice_group"), F.col("source_platform").alias("slice_label")),
        F.when(F.col("source_platform") != "bilibili", F.struct(F.lit("not_bilibili").alias("slice_group"), F.lit("complement").alias("slice_label"))),
    )
    # Counts by platform and score come first, so each slice copies counts and not rows.
    counts = metrics.histogram(scored(spark, sf_dir), ["source_platform"]).withColumn("s", F.explode(F.array_compact(slices)))
    hist = counts.groupBy("s.slice_group", "s.slice_label", "score").agg(F.sum("nf").alias("nf"), F.sum("nr").alias("nr"))
    return metrics.auroc_of_histogram(hist, ["slice_group", "slice_label"], {"auroc": "fakes_first"})


REFERENCE = {"click": 0.9613, "view": 0.9466, "purchase": 0.954}


@query(
    f"WITH {A.SCORES_SQL}, " + auroc_sql("v_scores", "detector", {"auroc": 2})
    + ", f(detector, reference) AS (VALUES ('click', 0.9613e0), ('view', 0.9466e0), ('purchase', 0.954e0))"
    " SELECT detector, auroc, reference, auroc - reference AS delta FROM r LEFT JOIN f USING (detector)"
)
def gap_table(spark, sf_dir):
    out = metrics.auroc(A.scores(spark, sf_dir), ["detector"])
    known = F.create_map(*[F.lit(x) for kv in REFERENCE.items() for x in kv])
    return out.withColumn("reference", F.try_element_at(known, "detector")).select("detector", "auroc", "reference", (F.col("auroc") - F.col("reference")).alias("delta"))


ENSEMBLE = (
    f"WITH {A.SCORES_SQL}, w AS (SELECT detector, video, arg_max(score, seq) AS score, max(label) AS label FROM v_scores GROUP BY 1, 2),"
    " k AS (SELECT *, (row_number() OVER (PARTITION BY detector ORDER BY score, video) - 1) / greatest(count(*) OVER (PARTITION BY detector) - 1, 1)::DOUBLE AS rank_norm FROM w),"
    " e AS (SELECT video, max(label) AS label, count(*) AS n_det, avg(rank_norm) AS ensemble FROM k GROUP BY 1),"
    " f AS (SELECT *, CASE WHEN label = 1 THEN ensemble ELSE 1 - ensemble END AS conf FROM e)"
)


@query(ENSEMBLE + " SELECT video, label, n_det, round(ensemble, 9) AS ensemble, round(conf, 9) AS conf FROM f")
def rank_ensemble(spark, sf_dir):
    return metrics.ensemble(A.scores(with_checkpoints(spark), sf_dir)).select("video", "label", "n_det", F.round("ensemble", 9).alias("ensemble"), F.round("conf", 9).alias("conf"))


@query(ENSEMBLE + " SELECT video, n_det, round(conf, 9) AS conf FROM f WHERE conf < 0.6 ORDER BY round(conf, 9), video LIMIT 100")
def hard_cases(spark, sf_dir):
    hard = metrics.ensemble(A.scores(with_checkpoints(spark), sf_dir)).where("is_hard").select("video", "n_det", F.round("conf", 9).alias("conf"))
    return hard.orderBy("conf", "video").limit(100)


@query(
    ENSEMBLE.replace("WITH ", f"WITH {A.VIDEOS_SQL}, ", 1)
    + " SELECT source_platform AS platform, count(*) FILTER (conf < 0.6) AS hard, count(*) AS total, count(*) FILTER (conf < 0.6) / greatest(count(*), 1)::DOUBLE AS rate"
    " FROM f JOIN v_videos v ON concat(CAST(v.id AS STRING), '.mp4') = f.video GROUP BY 1"
)
def hard_rates(spark, sf_dir):
    v = A.videos(spark, sf_dir).select(F.concat(F.col("id").cast("string"), F.lit(".mp4")).alias("video"), F.col("source_platform").alias("platform"))
    out = metrics.ensemble(A.scores(with_checkpoints(spark), sf_dir)).join(v, "video").groupBy("platform").agg(F.count_if(F.col("is_hard")).alias("hard"), F.count("*").alias("total"))
    return out.withColumn("rate", F.col("hard") / F.greatest(F.lit(1), F.col("total")))


@query(
    ENSEMBLE + ", b AS (SELECT label, avg(conf) AS cut FROM f GROUP BY 1)"
    " SELECT video, CAST(label AS INTEGER) AS given, round(conf, 9) AS self_conf, CAST(row_number() OVER (ORDER BY round(conf, 9), video) AS INTEGER) AS issue_rank"
    " FROM f JOIN b USING (label) WHERE round(conf, 6) < round(cut, 6) AND 1 - conf >= 0.5 ORDER BY issue_rank LIMIT 100"
)
def label_issues(spark, sf_dir):
    """Rows less sure of their label than its mean and surer of the other: likeliest wrong labels first, a hundred."""
    from pyspark.sql import Window

    f = metrics.ensemble(A.scores(with_checkpoints(spark), sf_dir))
    f = f.join(f.groupBy("label").agg(F.avg("conf").alias("cut")), "label").where((F.round("conf", 6) < F.round("cut", 6)) & (1 - F.col("conf") >= 0.5))
    top = f.select("video", F.col("label").alias("given"), F.round("conf", 9).alias("self_conf")).orderBy("self_conf", "video").limit(100)
    return top.withColumn("issue_rank", F.row_number().over(Window.orderBy("self_conf", "video")))


@query(
    f"WITH {A.SCORES_SQL}, b AS (SELECT *, CASE WHEN score >= 0.8 THEN '0.8-1.01' WHEN score >= 0.6 THEN '0.6-0.8' WHEN score >= 0.4 THEN '0.4-0.6' WHEN score >= 0.2 THEN '0.2-0.4' END AS bin FROM v_scores)"
    " SELECT detector, bin, count(*) AS n, count(*) FILTER (label = 1) AS n_fake FROM b WHERE bin IS NOT NULL GROUP BY 1, 2"
)
def confidence_bins(spark, sf_dir):
    s = F.col("score")
    bins = F.when(s >= 0.8, "0.8-1.01").when(s >= 0.6, "0.6-0.8").when(s >= 0.4, "0.4-0.6").when(s >= 0.2, "0.2-0.4")
    rows = A.scores(spark, sf_dir).withColumn("bin", bins).where("bin IS NOT NULL")
    return rows.groupBy("detector", "bin").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_fake"))


@query(
    f"WITH {A.SCORES_SQL}, c AS (SELECT detector, label AS actual, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM v_scores GROUP BY ALL)"
    " SELECT detector, actual, pred, n, n / (sum(n) OVER (PARTITION BY detector, actual))::DOUBLE AS share FROM c"
)
def confusion(spark, sf_dir):
    from pyspark.sql import Window

    c = A.scores(spark, sf_dir).groupBy("detector", F.col("label").alias("actual"), F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("pred")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("detector", "actual")))


@query(
    SCORED + ", h0 AS (SELECT detector, source_platform, score, label FROM x), " + auroc_sql("h0", "detector, source_platform", {"auroc": 2})
    + " SELECT detector, max(auroc) FILTER (source_platform = 'bilibili') AS bilibili, max(auroc) FILTER (source_platform = 'reddit') AS reddit,"
    " max(auroc) FILTER (source_platform = 'showcase') AS showcase, max(auroc) FILTER (source_platform = 'youtube') AS youtube FROM r GROUP BY 1"
)
def detector_matrix(spark, sf_dir):
    out = metrics.auroc(scored(spark, sf_dir), ["detector", "source_platform"])
    return out.groupBy("detector").pivot("source_platform", ["bilibili", "reddit", "showcase", "youtube"]).agg(F.max("auroc"))


@query(
    f"WITH {A.SCORES_SQL}, s AS (SELECT detector, avg(score) FILTER (label = 1) AS f, avg(score) FILTER (label = 0) AS r, stddev_pop(score) AS sd, median(score) AS med FROM v_scores GROUP BY 1)"
    " SELECT detector, round(f, 9) AS mean_fake, round(r, 9) AS mean_real, round(sd, 9) AS std, round(med, 9) AS median FROM s"
)
def score_summary(spark, sf_dir):
    """Means, deviation and median; the median is found from counts by score, without a buffer of a detector's scores."""
    scores = A.scores(with_checkpoints(spark), sf_dir)
    s = F.col("score")
    counts = scores.groupBy("detector", "score").agg(F.count("*").alias("n"))
    middle = selection.quantiles(counts, ["detector"], "score", "n", 0.5)
    out = scores.groupBy("detector").agg(
        F.avg(F.when(F.col("label") == 1, s)).alias("f"), F.avg(F.when(F.col("label") == 0, s)).alias("r"), F.stddev_pop(s).alias("sd")
    ).join(middle, "detector", "left")
    return out.select("detector", F.round("f", 9).alias("mean_fake"), F.round("r", 9).alias("mean_real"), F.round("sd", 9).alias("std"), F.round("quantile", 9).alias("median"))


@query(
    ENSEMBLE
    + ", pr AS (SELECT video, label, [1 - ensemble, ensemble] AS probs FROM f), t AS (SELECT label, avg(probs[label + 1]) AS cut FROM pr GROUP BY 1),"
    " c AS (SELECT p.label AS given, CASE WHEN a AND b THEN CASE WHEN probs[2] > probs[1] THEN 1 ELSE 0 END WHEN a THEN 0 WHEN b THEN 1 END AS true_ FROM (SELECT pr.*, probs[1] >= (SELECT cut FROM t WHERE label = 0) AS a, probs[2] >= (SELECT cut FROM t WHERE label = 1) AS b FROM pr) p),"
    " j0 AS (SELECT given, true_, count(*) AS n FROM c WHERE true_ IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT label, label, 1 FROM t), j AS (SELECT given, true_, max(n) AS n FROM j0 GROUP BY 1, 2),"
    " q AS (SELECT given, true_, floor(n * (SELECT count(*) FROM pr WHERE label = given) / (sum(n) OVER (PARTITION BY given))::DOUBLE)::BIGINT AS prune FROM j),"
    " m AS (SELECT video, label AS given, 1 - label AS other, probs[label + 1] AS conf, round(probs[2 - label] - probs[label + 1], 9) AS margin FROM pr),"
    " o AS (SELECT m.video AS video, m.given AS given, m.other AS other, m.conf AS conf, m.margin AS margin, prune, row_number() OVER (PARTITION BY m.given ORDER BY margin DESC) AS place FROM m JOIN q ON q.given = m.given AND q.true_ = m.other AND prune > 0),"
    " z AS (SELECT o.given AS given, min(margin) AS cut FROM o WHERE place <= prune GROUP BY 1)"
    " SELECT video, CAST(o.given AS INTEGER) AS given, CAST(other AS INTEGER) AS suggested, round(conf, 9) AS self_conf FROM o JOIN z ON z.given = o.given WHERE margin >= cut AND margin > 0"
)
def confident_issues(spark, sf_dir):
    """All rows whose label the ensemble's ranks contradict, by the joint counts of given and true labels."""
    f = metrics.ensemble(A.scores(with_checkpoints(spark), sf_dir))
    rows = f.select(F.col("video").alias("item"), "label", F.array(1 - F.col("ensemble"), F.col("ensemble")).alias("probs")).checkpoint()
    out = noise.label_issues(rows)
    return out.select(F.col("item").alias("video"), F.col("given").cast("int").alias("given"), "suggested", F.round("self_conf", 9).alias("self_conf"))
