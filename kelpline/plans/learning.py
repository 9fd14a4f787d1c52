"""Registered queries with order-dependent folds, agreement measures and small models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelpline.operators import folds, learning, metrics, vectors
from kelpline.plans.evaluation import SCORED, auroc_sql, scored
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


def pairs_of(spark, sf_dir):
    return vectors.hamming_pairs(A.phash(spark, sf_dir).select("id", "hash"))


def nodes_of(spark, sf_dir):
    """One row for each distinct hash, in the order of ids."""
    rows = A.phash(spark, sf_dir).groupBy("hash").agg(F.min("id").alias("id"))
    return rows.select("id", F.col("id").alias("seq"), F.pmod(F.col("id"), F.lit(7)).alias("quality"))


NODES_SQL = "SELECT min(id) AS id, hash, min(id) % 7 AS quality FROM v_phash GROUP BY hash"


def fold_sql(existing_wins: bool = False, nearest: bool = True) -> str:
    """CTEs of a fold over k (id, hash, quality) in the order of ids: p, pairs; c, components; t, pointers (id, duplicate_of_id).

    Each step of s takes the next row of every component, finds the first of its neighbours that is alive still (by distance, then
    id; without nearest by id alone), and notes who points at whom (loser, winner).
    """
    order = "p.distance, a.id" if nearest else "a.id"
    loses = "true" if existing_wins else "quality < best.quality"
    return (
        "p AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash)) AS distance FROM k a JOIN k b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 6),"
        " u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),"
        " l(id, component) AS (SELECT a, a FROM u UNION SELECT u.b, min(l.component) FROM l JOIN u ON u.a = l.id GROUP BY 1),"
        " c AS (SELECT id, min(component) AS component FROM l GROUP BY 1),"
        f" near AS (SELECT p.b AS id, list({{'id': a.id, 'quality': a.quality}} ORDER BY {order}) AS near FROM p JOIN k a ON a.id = p.a GROUP BY 1),"
        " o AS (SELECT c.component, k.id, k.quality, near.near, row_number() OVER (PARTITION BY c.component ORDER BY k.id) AS place FROM k JOIN c USING (id) LEFT JOIN near USING (id)),"
        " s(component, place, alive, loser, winner) AS (SELECT component, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM c GROUP BY 1 UNION ALL"
        f" SELECT component, place, CASE WHEN best IS NULL THEN list_append(alive, id) WHEN {loses} THEN alive ELSE list_append(list_filter(alive, lambda x: x <> best.id), id) END,"
        f" CASE WHEN best IS NULL THEN NULL WHEN {loses} THEN id ELSE best.id END, CASE WHEN best IS NULL THEN NULL WHEN {loses} THEN best.id ELSE id END"
        " FROM (SELECT o.component, o.place, o.id, o.quality, s.alive, list_filter(o.near, lambda x: list_contains(s.alive, x.id))[1] AS best FROM s JOIN o ON o.component = s.component AND o.place = s.place + 1) e),"
        " t AS (SELECT loser AS id, winner AS duplicate_of_id FROM s WHERE loser IS NOT NULL)"
    )


@query()
def dedup_greedy(spark, sf_dir):
    spark = with_checkpoints(spark)
    pairs = pairs_of(spark, sf_dir).select("a", "b", (-F.col("distance")).cast("long").alias("sim"))
    return folds.greedy_duplicates(nodes_of(spark, sf_dir), pairs)


@query(f"WITH RECURSIVE {A.PHASH_SQL}, k AS ({NODES_SQL}), {fold_sql(existing_wins=True)} SELECT k.id, t.duplicate_of_id FROM k LEFT JOIN t USING (id)")
def pairwise_duplicates(spark, sf_dir):
    """Each row against the nearest row that was kept before it, which always stays."""
    spark = with_checkpoints(spark)
    pairs = pairs_of(spark, sf_dir).select("a", "b", (-F.col("distance")).cast("long").alias("sim"))
    return folds.greedy_duplicates(nodes_of(spark, sf_dir), pairs, existing_wins=True)


@query()
def leader_clusters(spark, sf_dir):
    spark = with_checkpoints(spark)
    return folds.leader_clusters(nodes_of(spark, sf_dir).select("id", "seq"), pairs_of(spark, sf_dir))


@query(
    f"WITH RECURSIVE {A.PHASH_SQL}, k AS ({NODES_SQL}), {fold_sql(existing_wins=True, nearest=False)},"
    " w AS (SELECT k.id, coalesce(t.duplicate_of_id, k.id) AS cluster FROM k LEFT JOIN t USING (id)), g AS (SELECT cluster, count(*) AS size FROM w GROUP BY 1)"
    " SELECT count(*) AS clusters, count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size > 1) AS multi, CAST(sum(size - 1) AS BIGINT) AS redundant, sum(size - 1) / greatest(sum(size), 1)::DOUBLE AS rate FROM g"
)
def near_dup_summary(spark, sf_dir):
    sizes = leader_clusters(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("size"))
    out = sizes.agg(
        F.count("*").alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") > 1).alias("multi"),
        F.sum(F.col("size") - 1).alias("redundant"), F.sum("size").alias("n"),
    )
    return out.select("clusters", "singletons", "multi", "redundant", (F.col("redundant") / F.greatest(F.lit(1), F.col("n"))).alias("rate"))


@query(f"WITH {A.VIDEOS_SQL} SELECT id, coalesce(duplicate_of_id, id) AS canonical FROM v_videos")
def resolve_canonical(spark, sf_dir):
    return folds.resolve_chains(A.videos(with_checkpoints(spark), sf_dir).select("id", "duplicate_of_id"))


LABELLED = f"WITH {A.PLANTED_SQL}, a AS (SELECT (id % 1000000) % 12 AS a, coalesce(generator, 'none') AS b FROM v_planted)"


@query(
    LABELLED + ", c AS (SELECT a, b, count(*)::DOUBLE AS n FROM a GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), ra AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),"
    " h AS (SELECT (SELECT sum(-(n / t) * ln(n / t)) FROM c, t) AS h, (SELECT sum(-(n / t) * ln(n / t)) FROM ra, t) AS ha, (SELECT sum(-(n / t) * ln(n / t)) FROM rb, t) AS hb,"
    " (SELECT sum(n * (n - 1) / 2) FROM c) AS c, (SELECT sum(n * (n - 1) / 2) FROM ra) AS ca, (SELECT sum(n * (n - 1) / 2) FROM rb) AS cb, (SELECT t * (t - 1) / 2 FROM t) AS ct)"
    " SELECT round(2 * (ha + hb - h) / (ha + hb), 6) AS nmi, round((c - ca * cb / ct) / ((ca + cb) / 2 - ca * cb / ct), 6) AS ari FROM h"
)
def nmi(spark, sf_dir):
    rows = A.planted(spark, sf_dir).select((F.col("id") % 1000000 % 12).alias("a"), F.coalesce("generator", F.lit("none")).alias("b"))
    out = learning.agreement(rows, "a", "b")
    return out.select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"))


PLATFORM_DETECTOR = SCORED + ", h0 AS (SELECT detector, source_platform, score, label FROM x), " + auroc_sql("h0", "detector, source_platform", {"ff": 2, "mid": 1})


@query(
    PLATFORM_DETECTOR + ", k AS (SELECT rank() OVER (ORDER BY ff) + (count(*) OVER (PARTITION BY ff) - 1) / 2e0 AS p, rank() OVER (ORDER BY mid) + (count(*) OVER (PARTITION BY mid) - 1) / 2e0 AS q FROM r)"
    " SELECT count(*) AS n, round(corr(p, q), 9) AS rho FROM k"
)
def spearman(spark, sf_dir):
    """How alike two tie policies rank the detectors over platforms."""
    rows = metrics.auroc(scored(spark, sf_dir), ["detector", "source_platform"], {"ff": "fakes_first", "mid": "midrank"})
    return learning.spearman(rows, "ff", "mid").select("n", F.round("rho", 9).alias("rho"))


@query(
    f"WITH {A.SCORES_SQL}, s AS (SELECT *, CAST(CASE WHEN video_id % 10 < 1 THEN 1 WHEN video_id % 10 < 2 THEN 2 WHEN video_id % 10 < 5 THEN 3 ELSE 4 END AS INTEGER) AS part FROM v_scores),"
    " u AS (SELECT k.step, detector, score, label FROM s JOIN (SELECT unnest([1, 2, 3, 4])::INTEGER AS step) k ON part <= step), " + auroc_sql("u", "detector, step", {"auroc": 2})
    + " SELECT detector, step, auroc, (auroc - lag(auroc) OVER (PARTITION BY detector ORDER BY step)) * 100 AS gain_pp FROM r"
)
def marginal_gain(spark, sf_dir):
    """AUROC on growing shares of the rows, and what each step adds."""
    part = F.expr("CASE WHEN video_id % 10 < 1 THEN 1 WHEN video_id % 10 < 2 THEN 2 WHEN video_id % 10 < 5 THEN 3 ELSE 4 END")
    counts = metrics.histogram(A.scores(spark, sf_dir).withColumn("part", part), ["detector", "part"])
    steps = counts.withColumn("step", F.explode(F.sequence("part", F.lit(4))))
    hist = steps.groupBy("detector", "step", "score").agg(F.sum("nf").alias("nf"), F.sum("nr").alias("nr"))
    out = metrics.auroc_of_histogram(hist, ["detector", "step"], {"auroc": "fakes_first"})
    before = F.lag("auroc").over(Window.partitionBy("detector").orderBy("step"))
    return out.select("detector", "step", "auroc", ((F.col("auroc") - before) * 100).alias("gain_pp"))


@query()
def kmeans_sweep(spark, sf_dir):
    return learning.kmeans_sweep(A.features(with_checkpoints(spark), sf_dir), [3, 5, 8])


@query()
def family_classifier(spark, sf_dir):
    return learning.cross_validated(A.features(with_checkpoints(spark), sf_dir)).select("id", "generator", "fold", "predicted", "confidence", F.array_join("top3", ",").alias("top3"))


@query()
def linear_probe(spark, sf_dir):
    return learning.linear_probe(A.features(spark, sf_dir).withColumn("label", F.when(F.col("label") < 5, 1).otherwise(0)))


@query(
    f"WITH RECURSIVE {A.PHASH_SQL}, n AS ({NODES_SQL}), k AS (SELECT id, hash, CASE WHEN id % 3 = 0 THEN 6 - quality ELSE quality END AS quality FROM n WHERE id % 110 <> 0), {fold_sql()}"
    " SELECT k.id, coalesce(c.component, k.id) AS component, t.duplicate_of_id FROM k LEFT JOIN t USING (id) LEFT JOIN c USING (id)"
)
def refolded_duplicates(spark, sf_dir):
    """Pointers after some rows changed quality and others went: only components they were in are folded again.

    The result is that of a fold of all rows, which the SQL does.
    """
    rows, pairs = nodes_of(with_checkpoints(spark), sf_dir), pairs_of(spark, sf_dir).select("a", "b", (-F.col("distance")).cast("long").alias("sim"))
    state = folds.folded_state(rows, pairs)
    changed = rows.where("id % 3 = 0 OR id % 110 = 0").select("id")
    new = rows.where("id % 110 <> 0").withColumn("quality", F.when(F.col("id") % 3 == 0, 6 - F.col("quality")).otherwise(F.col("quality")))
    return folds.refolded(new, pairs, state, changed)


# Pointers that make chains and cycles, and series of measurements

#: Chains of seven, cycles of three with a row that leads to each, and pointers to no row.
POINTER = "CASE doc_id % 12 WHEN 0 THEN NULL WHEN 7 THEN doc_id + 2 WHEN 8 THEN doc_id - 1 WHEN 9 THEN doc_id - 1 WHEN 10 THEN doc_id - 1 WHEN 11 THEN -doc_id ELSE doc_id - 1 END"


@query(
    f"WITH RECURSIVE p AS (SELECT doc_id AS id, {POINTER} AS dest FROM documents), k AS (SELECT p.*, EXISTS (SELECT 1 FROM p q WHERE q.id = p.dest) AS known FROM p),"
    " w(id, place, steps) AS (SELECT id, id, 0 FROM k UNION ALL SELECT w.id, coalesce(k.dest, k.id), w.steps + 1 FROM w JOIN k ON k.id = w.place WHERE k.dest IS NOT NULL AND w.steps < 12),"
    " e AS (SELECT w.id AS id, bool_or(k.id IS NULL) AS stale, min(w.place) FILTER (w.steps >= 8) AS low FROM w LEFT JOIN k ON k.id = w.place GROUP BY w.id),"
    " f AS (SELECT w.id AS id, max(w.place) FILTER (k.id IS NULL) AS gone, max(w.place) FILTER (k.dest IS NULL AND k.id IS NOT NULL) AS head FROM w LEFT JOIN k ON k.id = w.place GROUP BY w.id)"
    " SELECT e.id, coalesce(CASE WHEN stale THEN gone END, head, low) AS canonical, CASE WHEN head IS NULL AND NOT stale THEN low END AS cycle, stale FROM e JOIN f USING (id)"
)
def pointer_chains(spark, sf_dir):
    """Ends of chains, and cycles by name."""
    rows = A.table(with_checkpoints(spark), sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(POINTER).alias("duplicate_of_id"))
    return folds.pointer_chains(rows)


@query(
    "WITH m AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events),"
    " b AS (SELECT *, most IS NULL OR value > most AS better FROM m), l AS (SELECT *, place - max(CASE WHEN better THEN place ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS idle FROM b),"
    " s AS (SELECT user_id, min(place) FILTER (idle >= 4) AS stop FROM l GROUP BY 1)"
    " SELECT user_id, max(event_id) FILTER (better) AS best_step, max(value) AS best_value, count(*) AS steps_run, max(idle) >= 4 AS stopped FROM l JOIN s USING (user_id) WHERE stop IS NULL OR place <= stop GROUP BY 1"
)
def early_stops(spark, sf_dir):
    """The best step of each user's series of values, read until four in a row are no better."""
    return learning.early_stop(A.table(spark, sf_dir, "events"), "user_id", "event_id", "value", 4)


@query(
    f"WITH {A.PLANTED_SQL} SELECT f.id, CAST(len(f.features) + len(p.features) AS INTEGER) AS dims, round(f.features[3], 6) AS a, round(p.features[3], 6) AS b, round(list_sum(list_transform(list_zip(f.features, p.features), lambda x: x[1] * x[2])), 6) AS dot"
    " FROM v_features f JOIN v_features p USING (id)"
)
def aligned_features(spark, sf_dir):
    """Two feature sets of the same rows side by side, in one array."""
    f = A.features(with_checkpoints(spark), sf_dir)
    out = learning.aligned_features([f, f.select("id", "features")], ["first", "second"])
    return out.select("id", F.size("features").alias("dims"), F.round(F.get("features", F.lit(2)), 6).alias("a"), F.round(F.get("features", F.lit(66)), 6).alias("b"), F.round(vectors.dot("first", "second"), 6).alias("dot"))
