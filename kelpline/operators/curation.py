"""Filters with a verdict for each row, catalogue queries, merges, slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions import text as T

# Tiers of label sources; other sources have none.
TIERS = {"tier1_gallery": 1, "tier2_platform_tag": 2, "tier2_channel_whitelist": 2, "tier3_llm": 3}


def quality_reason(min_resolution: int, min_short_edge: int, min_duration: float, max_duration: float) -> Column:
    """The first failing rule, corrupt before resolution before duration; null if a row passes."""
    w, h = F.coalesce("resolution_w", F.lit(0)), F.coalesce("resolution_h", F.lit(0))
    small = (F.greatest(w, h) < min_resolution) | (F.least(w, h) < min_short_edge)
    length = F.col("duration_sec")
    return (
        F.when(F.col("file_size_bytes") == 0, "corrupt")
        .when((w > 0) & (h > 0) & small, "resolution")
        .when((length < min_duration) | (length > max_duration), "duration")
    )



def tier_of(source: Column) -> Column:
    """The tier of a label source; null for unknown sources and null."""
    out = F.lit(None).cast("int")
    for name, number in TIERS.items():
        out = F.when(source == name, number).otherwise(out)
    return out


def whitelist_verdict(name: Column, allowed: list[str], banned: list[str]) -> Column:
    """missing, blacklisted (looked up first), whitelisted or unknown."""
    return F.when(name.isNull(), "missing").when(name.isin(*banned), "blacklisted").when(name.isin(*allowed), "whitelisted").otherwise("unknown")


def verdict_kept(verdict: Column, strict: bool) -> Column:
    return verdict == "whitelisted" if strict else verdict != "blacklisted"


def judged(is_ai: Column, confidence: Column, error: Column, text: Column, least: float = 0.7) -> Column:
    """A judge's answer as a decision: kept without text, on errors, or if sure enough."""
    return (F.coalesce(F.trim(text), F.lit("")) == "") | error.isNotNull() | F.coalesce(is_ai & (confidence >= least), F.lit(False))


def reject_stage(accept: list[int], allowed: list[str], banned: list[str], strict: bool, **quality) -> Column:
    """The first stage of quality, tier and whitelist that rejects a row; null if it survives."""
    verdict = whitelist_verdict(F.col("claimed_generator"), allowed, banned)
    return (
        F.when(quality_reason(**quality).isNotNull(), "quality")
        .when(~F.coalesce(tier_of(F.col("label_source")).isin(*accept), F.lit(False)), "tier")
        .when(~verdict_kept(verdict, strict), "whitelist")
    )


def listed(videos: DataFrame, status: str | None = None, label: str | None = None, q: str | None = None, shortest: float | None = None) -> DataFrame:
    """Rows of a catalogue page: excluded ones only if asked for; q is looked for in title and source_id."""
    out = videos.where(F.col("status") == status) if status else videos.where("status <> 'excluded'")
    out = out.where(F.col("label") == label) if label else out
    out = out.where(F.col("duration_sec") >= shortest) if shortest is not None else out
    return out.where(F.col("title").ilike(f"%{q}%") | F.col("source_id").ilike(f"%{q}%")) if q else out


SORTS = ("created_at", "published_at", "duration_sec", "title")


def page(videos: DataFrame, sort: str, descending: bool, number: int, size: int) -> DataFrame:
    """One page in order, with its row numbers `pos`; unknown sort columns are created_at, ties go by id."""
    c = F.col(sort if sort in SORTS else "created_at")
    order = [c.desc_nulls_last() if descending else c.asc_nulls_first(), F.col("id").asc()]
    rows = videos.orderBy(*order).limit(number * size)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order))).where(F.col("pos") > (number - 1) * size)


def showcase_tier() -> Column:
    drawn = T.any_term(F.lower("title"), T.CARTOON_TERMS) | T.any_term(T.tag_text(F.col("content_tags")), T.CARTOON_TERMS)
    name = F.col("claimed_generator")
    return (
        F.when(F.col("featured_at").isNotNull(), 0).when(drawn, 3).when(name.isin(*T.TOP_GENERATORS), 1).when(name.isin(*T.BOTTOM_GENERATORS), 3).otherwise(2)
    )


def showcase(videos: DataFrame, n: int) -> DataFrame:
    order = [F.col("tier").asc(), F.col("featured_at").desc_nulls_last(), F.col("published_at").desc_nulls_last(), F.col("crawled_at").desc_nulls_last(), F.col("id")]
    rows = videos.where("status <> 'excluded'").withColumn("tier", showcase_tier()).orderBy(*order).limit(n)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def pending(videos: DataFrame, n: int) -> DataFrame:
    """Work that is left, oldest first: canonical rows that have no blob and were not captioned."""
    todo = videos.where("status <> 'excluded' AND blob_url IS NULL AND duplicate_of_id IS NULL AND caption_model IS NULL")
    return todo.orderBy("crawled_at", "id").limit(n)


def unreviewed(videos: DataFrame, reviews: DataFrame) -> DataFrame:
    return videos.join(reviews, videos["id"] == reviews["video_id"], "left_anti")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], overwrite: list[str], fill: list[str], keep: list[str]) -> DataFrame:
    """existing with a batch merged in: columns of `overwrite` take the new value even if null, those of `fill` only if
    it isn't, those of `keep` never; rows with new keys are added; `action` says what became of each row.
    Of rows with one key in a batch the last by `seq` counts.
    """
    last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).where("_n = 1")
    old, new = existing.withColumn("_old", F.lit(True)).alias("o"), last.withColumn("_new", F.lit(True)).alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.join(new, same, "full")
    hit = F.col("n._new").isNotNull()
    columns = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    columns += [F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwrite]
    columns += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fill]
    columns += [F.when(F.col("o._old").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in keep]
    action = F.when(F.col("o._old").isNull(), "inserted").when(hit, "updated").otherwise("kept")
    return both.select(*columns, action.alias("action"))


def patched(existing: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields that a patch has overwrite, all others stay."""
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = existing.join(p, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns])


def without_videos(videos: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows but the deleted ones; pointers to deleted rows become null."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    left = videos.join(ids, videos["id"] == ids["_gone"], "left_anti")
    pointed = left.join(ids, left["duplicate_of_id"] == ids["_gone"], "left")
    return pointed.withColumn("duplicate_of_id", F.when(F.col("_gone").isNull(), F.col("duplicate_of_id"))).drop("_gone")


def frozen(videos: DataFrame, reviews: DataFrame, start: str, end: str) -> DataFrame:
    """Reviewed canonical rows whose publication, or else crawl, lies in [start, end), with their latest decision."""
    latest = reviews.groupBy("video_id").agg(F.max_by("decision", "review_no").alias("decision"))
    at = F.coalesce("published_at", "crawled_at")
    rows = videos.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")) & F.col("duplicate_of_id").isNull())
    return rows.where("status = 'reviewed'").join(latest, rows["id"] == latest["video_id"]).drop("video_id")


def slice_counts(rows: DataFrame) -> DataFrame:
    """Counters of a slice: decisions of all rows, platforms and generators of the approved ones; kind, name, n."""
    name = F.coalesce(F.nullif("claimed_generator", F.lit("")), F.lit("unknown"))
    kinds = F.array(
        F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("name")),
        F.when(F.col("decision") == "approved", F.struct(F.lit("platform").alias("kind"), F.col("source_platform").alias("name"))),
        F.when(F.col("decision") == "approved", F.struct(F.lit("generator").alias("kind"), name.alias("name"))),
    )
    return rows.select(F.explode(F.array_compact(kinds)).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def manifest_rows(rows: DataFrame, version: str) -> DataFrame:
    """Entries of a slice's manifest, one row each, so that a manifest of any size is written as JSON lines."""
    name = F.coalesce(F.nullif("claimed_generator", F.lit("")), F.lit("unknown"))
    license_ = F.lit("unknown")
    return rows.select(F.lit(version).alias("version"), "id", "source_platform", "source_id", "label", name.alias("claimed_generator"), "decision", "blob_url", license_.alias("source_license"))


def benchmark_rows(videos: DataFrame, platform: str | None = None, limit: int | None = None) -> DataFrame:
    """Canonical rows with a file of their own, and its path; the first `limit` by id if asked for."""
    rows = videos.where(F.col("duplicate_of_id").isNull() & F.col("blob_url").startswith("file://"))
    rows = rows if platform is None else rows.where(F.col("source_platform") == platform)
    rows = rows.withColumn("local_path", F.expr("substr(blob_url, 8)"))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def backfilled(videos: DataFrame, found: DataFrame, platforms: list[str]) -> DataFrame:
    """videos with published_at from found (id, published_at) where it is missing, on the named platforms."""
    late = found.select("id", F.col("published_at").alias("_found"))
    wanted = F.col("published_at").isNull() & F.col("source_platform").isin(platforms)
    return videos.join(late, "id", "left").withColumn("published_at", F.when(wanted, F.col("_found")).otherwise(F.col("published_at"))).drop("_found")


def first_inserts(existing: DataFrame, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """existing with the rows of new keys, each key's earliest by `at`."""
    new = batch.groupBy(*keys).agg(F.min(at).alias(at)).join(existing, keys, "left_anti")
    return existing.unionByName(new)


def may_start(runs: DataFrame, group: str) -> DataFrame:
    """Per group the run that is under way (the first of them), and whether another may start."""
    active = F.when(F.col("status").isin("running", "cancelling"), F.col("id"))
    return runs.groupBy(group).agg(F.min(active).alias("active_id")).withColumn("allowed", F.col("active_id").isNull())


def closed_window_rows(videos: DataFrame, reviews: DataFrame, frozen_at: Column) -> DataFrame:
    """Reviewed canonical rows by month of publication: `sliced` if reviewed before the month's slice was frozen, else `late`.

    A slice is not opened again, so late rows go to a side output.  reviews: video_id, reviewed_at (the first counts).
    """
    first = reviews.groupBy("video_id").agg(F.min("reviewed_at").alias("reviewed_at"))
    rows = videos.where("duplicate_of_id IS NULL AND published_at IS NOT NULL").join(first, F.col("video_id") == F.col("id"))
    rows = rows.withColumn("month", F.date_trunc("month", "published_at").cast("timestamp_ntz"))
    return rows.withColumn("fate", F.when(F.col("reviewed_at") < frozen_at, "sliced").otherwise("late"))


def recomputed(videos: DataFrame, selected: Column) -> DataFrame:
    """id and duplicate_of_id after the selected rows' pointers were cleared and found again: each points at the first row,
    by crawl, with its source_id; rows that were not selected keep theirs and come before all that are."""
    order = F.struct(selected.alias("later"), "crawled_at", "id")
    first = videos.groupBy("source_id").agg(F.min(order).alias("first"))
    rows = videos.join(first, "source_id")
    new = F.when(F.col("first.id") != F.col("id"), F.col("first.id"))
    return rows.select("id", F.when(selected, new).otherwise(F.col("duplicate_of_id")).alias("duplicate_of_id"))


def recent(runs: DataFrame, at: str, key: str, n: int, within: str | None = None) -> DataFrame:
    """The n latest rows, of all or of each value of `within`, with their place; rows without a time come last, ties by the
    higher key."""
    order = [F.col(at).desc_nulls_last(), F.col(key).desc()]
    if within is None:
        runs = runs.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*([within] if within else [])).orderBy(*order))
    return runs.withColumn("place", place).where(F.col("place") <= n)


def with_blobs(videos: DataFrame, blobs: DataFrame) -> DataFrame:
    """Videos that a file of the listing (id as text) belongs to."""
    names = blobs.select(F.col("id").try_cast("long").alias("_file")).where("_file IS NOT NULL")
    return videos.join(names, videos["id"] == names["_file"], "left_semi")


def withdrawn(artefacts: dict[str, DataFrame], videos: DataFrame, requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each artefact (rows with an id) after requests (source_platform, source_id, reason) to leave, and the
    errata: artefact, id, reason of each row that went.

    A request takes out every video of its source, copies too.  A video with several requests has the least of their reasons;
    a request without a reason counts as `unspecified`.
    """
    asked = requests.where("source_platform IS NOT NULL AND source_id IS NOT NULL").groupBy("source_platform", "source_id")
    asked = asked.agg(F.coalesce(F.min("reason"), F.lit("unspecified")).alias("reason"))
    gone = videos.select("id", "source_platform", "source_id").join(asked, ["source_platform", "source_id"])
    gone = gone.groupBy("id").agg(F.min("reason").alias("reason"))
    left = {name: rows.join(gone, "id", "left_anti") for name, rows in artefacts.items()}
    errata = [rows.select("id").distinct().join(gone, "id").select(F.lit(name).alias("artefact"), "id", "reason") for name, rows in artefacts.items()]
    return left, reduce(DataFrame.unionByName, errata)
