"""Rules that turn harvested platform records (JSON) into candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions import text as T

#: Phrases by which a text says that its video is generated.
GENERATED_TERMS = [
    "ai generated", "ai-generated", "ai generated video", "generated by ai", "created with ai", "made with sora", "made with kling",
    "made with runway", "made with pika", "made with luma", "made with minimax", "made with hailuo", "made with veo", "sora generated",
    "kling generated", "text to video", "text-to-video", "aigc", "ai创作", "ai生成", "#aiart", "#aivideo", "#sora", "#kling", "#runway",
]
VIDEO_ENDINGS = ["mp4", "webm", "mov", "gifv"]
VIDEO_HOSTS = ["v.redd.it", "youtube.com", "youtu.be", "streamable.com", "vimeo.com"]


def first_path(record: Column, paths: list[str]) -> Column:
    """The first of the JSON paths that a record has."""
    return F.coalesce(*[F.get_json_object(record, p) for p in paths])


def is_video_url(url: Column) -> Column:
    """Whether a URL ends like a video or is on a host of videos."""
    low = F.lower(url)
    ends = F.regexp_replace(low, r"[?#].*$", "").rlike(r"\.(?:" + "|".join(VIDEO_ENDINGS) + ")$")
    return F.coalesce(ends | T.any_term(low, VIDEO_HOSTS), F.lit(False))


def video_url(record: Column) -> Column:
    """The post's own video, else that of the post it repeats, else its link if that is a video."""
    link = F.get_json_object(record, "$.url")
    own = first_path(record, ["$.media.reddit_video.fallback_url", "$.crosspost.media.reddit_video.fallback_url"])
    return F.coalesce(own, F.when(is_video_url(link), link))


def any_flag(record: Column, paths: list[str]) -> Column:
    """Whether any of the JSON paths holds true or a number but 0."""
    flags = [F.coalesce(~F.get_json_object(record, p).isin("", "0", "false", "null"), F.lit(False)) for p in paths]
    return reduce(lambda a, b: a | b, flags)


def duration_kept(seconds: Column, shortest: float, longest: float, missing: str) -> Column:
    """Whether a length is in range; missing lengths `reject`, `pass`, or count as `zero`."""
    value = F.coalesce(seconds, F.lit(0e0)) if missing == "zero" else seconds
    return F.coalesce((value >= shortest) & (value <= longest), F.lit(missing == "pass"))


def platform_gate(labelled: Column, mode: str) -> Column:
    """require: only records the platform labels as generated; forbid: only others; skip: all."""
    known = F.coalesce(labelled, F.lit(False))
    return {"require": known, "forbid": ~known, "skip": F.lit(True)}[mode]


def gaming(tags: Column, terms: list[str]) -> Column:
    """Whether one of the tags is one of the terms as a whole."""
    return F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(t) for t in terms])), F.lit(False))


def channel_label_source(disclosed: Column, whitelisted: Column, text: Column) -> Column:
    """Why an upload counts as generated: the platform says so, its channel is known for it, or its text says so; null for
    none of these (the upload is not taken)."""
    return (
        F.when(disclosed, "tier2_platform_tag")
        .when(whitelisted, "tier2_channel_whitelist")
        .when(T.any_term(F.lower(text), GENERATED_TERMS), "tier3_llm")
    )


def best_file(files: Column, highest: int = 720) -> Column:
    """The link of the tallest video of at most `highest` lines, the last of equal ones, else of the first file.

    files: array of (link, height, file_type); a missing height counts as 0.
    """
    fits = lambda f: (F.coalesce(f["height"], F.lit(0)) <= highest) & F.coalesce(f["file_type"].startswith("video/"), F.lit(False))
    ranked = F.transform(files, lambda f, i: F.struct(fits(f).alias("fits"), F.coalesce(f["height"], F.lit(0)).alias("height"), i.alias("i"), f["link"].alias("link")))
    best = F.array_max(F.filter(ranked, lambda f: f["fits"]))
    return F.coalesce(best["link"], F.try_element_at(files, F.lit(1))["link"])


def clip_sample(clips: DataFrame, most: int, shortest: float, longest: float, seed: int) -> DataFrame:
    """At most `most` clips with a length in range, of a sample of three times as many; clips: id, start_sec, end_sec.

    Clips are picked by a hash of seed and id, so a sample is the same on every run and for any partitioning.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    some = clips.withColumn("_order", order).orderBy("_order", "id").limit(3 * most)
    length = (F.col("end_sec") - F.col("start_sec")).cast("double")
    return some.withColumn("duration_sec", length).where(F.col("duration_sec").between(shortest, longest)).orderBy("_order", "id").limit(most).drop("_order")


def gallery_records(clips: DataFrame) -> DataFrame:
    """One record for each address of a clip, that of its first page; source_id is made of the address."""
    first = clips.groupBy("cdn_url").agg(F.min_by("page_url", "page_id").alias("page_url"), F.count("*").alias("n_pages"))
    return first.select(F.substring(F.sha1("cdn_url"), 1, 16).alias("source_id"), F.col("cdn_url").alias("source_url"), "page_url", "n_pages")


def search_item(raw: Column) -> dict[str, Column]:
    """Fields of an item of a search, given as JSON."""
    at = lambda p: F.get_json_object(raw, p)
    text = lambda p: F.coalesce(at(p), F.lit(""))
    return {
        "bvid": text("$.bvid"), "title": T.clean_title(text("$.title")), "description": text("$.description"), "tag_str": text("$.tag"),
        "duration_sec": T.duration_seconds(at("$.duration")), "pubdate": F.coalesce(at("$.pubdate").cast("bigint"), F.lit(0)),
        "mid": at("$.mid"), "author": at("$.author"), "typename": at("$.typename"), "play": at("$.play"), "source": F.lit("search"),
    }


def newest_item(raw: Column) -> dict[str, Column]:
    """The same fields of an item of a list of newest uploads, which nests some and has no tags."""
    at = lambda p: F.get_json_object(raw, p)
    text = lambda p: F.coalesce(at(p), F.lit(""))
    return {
        "bvid": text("$.bvid"), "title": text("$.title"), "description": text("$.desc"), "tag_str": F.lit(""),
        "duration_sec": T.duration_seconds(at("$.duration")), "pubdate": F.coalesce(at("$.pubdate").cast("bigint"), F.lit(0)),
        "mid": at("$.owner.mid"), "author": at("$.owner.name"), "typename": at("$.tname"), "play": at("$.stat.view"),
        "source": F.concat(F.lit("newlist:rid="), at("$.tid")),
    }
