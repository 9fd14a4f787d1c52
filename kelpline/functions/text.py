"""Text rules as column expressions: ordered patterns, term tables, durations, domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of generators by pattern, in this order; the first that is found counts.
GENERATOR_PATTERNS = [
    (r"\bsora\s*2(?:\.0)?\b", "sora2"),
    (r"\bsora\s*1(?:\.0)?\b", "sora1"),
    (r"\bsora\b", "sora2"),
    (r"\bveo[\s\-]*3\b", "veo3"),
    (r"\bveo[\s\-]*2\b", "veo2"),
    (r"\bveo\b", "veo3"),
    (r"\bkling[\s\-]*2\.1\b", "kling21"),
    (r"\bkling[\s\-]*2(?:\.0)?\b", "kling2"),
    (r"\bkling[\s\-]*1(?:\.\d)?\b", "kling1"),
    (r"可灵\s*2\.1", "kling21"),
    (r"可灵\s*2", "kling2"),
    (r"可灵|kling", "kling21"),
    (r"\b(?:runway[\s\-]*)?gen[\s\-]*4\b", "runway-gen4"),
    (r"\b(?:runway[\s\-]*)?gen[\s\-]*3\b", "runway-gen3"),
    (r"\b(?:runway[\s\-]*)?gen[\s\-]*2\b", "runway_gen2"),
    (r"\brunway\b", "runway-gen4"),
    (r"\bpika[\s\-]*2(?:\.\d)?\b", "pika2"),
    (r"\bpika[\s\-]*1(?:\.\d)?\b", "pika1"),
    (r"\bpika\b", "pika2"),
    (r"\bhailuo\b", "hailuo"),
    (r"\bminimax\b", "hailuo"),
    (r"\bhunyuan(?:[\s\-]*video)?\b", "hunyuan"),
    (r"混元", "hunyuan"),
    (r"\bwan[\s\-]*2\.1\b", "wan21"),
    (r"通义\s*万相", "wan21"),
    (r"\bltx[\s\-]*video\b", "ltxv"),
    (r"\bltxv\b", "ltxv"),
    (r"\bmochi[\s\-]*1\b", "mochi1"),
    (r"\bmochi\b", "mochi1"),
    (r"\bdreamina[\s\-]*3\b", "dreamina3"),
    (r"\bdreamina\b", "dreamina3"),
    (r"\bjimeng\b", "dreamina3"),
    (r"即梦", "dreamina3"),
    (r"\bdream[\s\-]*machine\b", "luma"),
    (r"\bluma\b", "luma"),
    (r"\bvidu\b", "vidu"),
    (r"\bpixverse\b", "pixverse"),
    (r"\bstable[\s\-]*video(?:[\s\-]*diffusion)?\b", "stable_video_diffusion"),
    (r"\bsvd\b", "stable_video_diffusion"),
    (r"\banimate[\s\-]*diff\b", "animatediff"),
    (r"\bzeroscope\b", "zeroscope"),
    (r"\bmodel[\s\-]*scope(?:[\s\-]*t2v)?\b", "modelscope_t2v"),
]
# Families, in this order.
FAMILIES = [
    "kling", "sora", "veo", "dreamina", "runway", "pika", "hailuo", "luma", "vidu", "wan", "pixverse", "hunyuan",
    "stable", "animatediff", "ltxv", "modelscope",
]
# Generators that come first or last in a showcase, and words for drawn pictures.
TOP_GENERATORS = [
    "sora2", "sora", "veo3", "kling21", "kling2", "runway-gen4", "dreamina3", "hailuo", "luma", "vidu", "wan21", "pixverse",
    "hunyuan", "pika2",
]
BOTTOM_GENERATORS = [
    "runway_gen2", "runway-gen3", "veo2", "pika1", "stable_video_diffusion", "kling1", "ltxv", "animatediff", "modelscope_t2v",
]
CARTOON_TERMS = ["anime", "cartoon", "waifu", "mmd", "动画", "动漫", "卡通", "二次元", "漫画", "国漫", "番剧", "手办", "萌宠"]
# Terms of titles and tags that keep a video out, each list in this order.
AVATAR_TERMS = [
    "vtuber", "vtube", "vup", "虚拟主播", "虚拟偶像", "虚拟up主", "虚拟youtuber", "虚拟yt", "管人痴", "皮套", "中之人", "hololive", "a-soul", "asoul",
    "にじさんじ", "彩虹社", "neuro-sama", "vedal",
]
AVATAR_NAMES = [
    "东雪莲", "東雪蓮", "阿梓", "嘉然", "乃琳", "贝拉", "珈乐", "向晚", "嘉心糖", "乃贝", "鹿鸣", "叶瞬光", "neuro", "夏色まつり", "神楽めあ",
    "月ノ美兎", "月之美兔",
]
TUTORIAL_TERMS = [
    "教程", "教学", "入门", "保姆级", "手把手", "教会你", "一分钟教会", "秒教会", "使用方法", "使用指南", "ai教程", "工作流", "comfyui", "comfy ui",
    "整合包", "一键包", "一键整合", "本地部署", "免安装", "附安装包", "tutorial", "step by step", "step-by-step", "how to use",
    "how to make", "how to create", "beginner", "walkthrough", "guide",
]
TUTORIAL_TAG_TERMS = [
    "教程", "教学", "入门教程", "入门教学", "保姆级", "手把手", "教会你", "跟我学", "学习ai", "ai学习", "学ai", "ai教程", "ai教学", "sd教程", "sd教学", "sd学习",
    "comfyui教程", "comfyui教学", "comfyui入门", "工作流教程", "提示词教学", "tutorial", "beginner", "walkthrough",
]
# Terms that keep a title out while it is harvested, and names among titles.
HARVEST_TITLE_TERMS = [
    "教程", "教学", "入门", "保姆级", "手把手", "全流程", "秘籍", "方法", "攻略", "测评", "评测", "对比", "反应", "盘点", "讲解", "解说", "教会你", "使用方法",
    "使用指南", "工作流", "comfyui", "comfy ui", "整合包", "一键包", "一键整合", "本地部署", "免安装", "附安装包", "tutorial", "how to", "guide", "review",
    "reaction", "tips", "step by step", "step-by-step", "walkthrough", "beginner",
]
HARVEST_AVATAR_NAMES = [
    "a-soul", "asoul", "东雪莲", "東雪蓮", "阿梓", "嘉然", "乃琳", "贝拉", "珈乐", "向晚", "嘉心糖", "乃贝", "hololive", "neuro-sama", "vedal", "夏色まつり",
    "神楽めあ", "月ノ美兎", "月之美兔", "にじさんじ", "彩虹社",
]
TUTORIAL_NEGATIVE = ["从零开始的异世界"]
MUSIC_TERMS = [
    "[suno", "【suno", "ai翻唱", "ai歌手", "ai配乐", "ai cover", "ai歌曲", "ai音乐生成", "ai作曲", "ai编曲", "ai作词", "ai写歌", "ai原创歌曲", "ai原创音乐",
]
VIDEO_NEGATIVE = ["ai电影", "ai短片", "ai动画", "ai视频", "ai剧集", "ai仿真人", "ai真人", "ai短剧", "ai长片", "ai mv"]
ANCHOR_TERMS = [
    "ai主播", "ai女主播", "ai男主播", "ai数字人", "ai虚拟主播", "数字人主播", "数字主播", "ai数字分身", "ai带货", "ai播报", "ai播音", "ai新闻主播", "ai直播间",
]
ANCHOR_TAG_TERMS = ["ai主播", "ai女主播", "ai男主播", "ai数字人", "数字人主播", "数字主播", "数字分身", "ai带货", "ai播报", "ai播音", "ai新闻主播", "ai虚拟主播"]
# Tags of music and of swapped faces, titles of the latter, and tags of tools that rescue a video.
MUSIC_TAGS = [
    "ai翻唱", "ai歌手", "ai配乐", "ai歌曲", "ai cover", "sunoai", "ai音乐征集大赛", "全能音乐挑战赛", "ai虚拟之声实验室", "翻唱", "古风翻唱", "戏腔", "说唱",
    "中文说唱", "嘻哈", "hiphop", "rap", "kpop", "k-pop", "cover",
]
FACE_TAGS = ["换脸", "ai换脸", "换头", "人脸替换", "deepfacelab", "deepfacelive", "roop", "faceswap", "face swap", "facefusion", "insightface"]
FACE_TERMS = ["换脸", "换头", "人脸替换", "deepfacelab", "deepfacelive", "roop换脸", "facefusion"]
TOOL_TAGS = [
    "pika", "pika ai", "pikalabs", "kling", "可灵", "可灵ai", "runway", "即梦", "dreamina", "hailuo", "luma", "dream machine", "hunyuan", "通义", "万相",
    "通义万相", "wan2", "ai视频", "ai动画", "ai生成视频", "视频生成",
]
# Generators as one platform's titles name them, the first match counts.
SHORT_VIDEO_PATTERNS = [
    (r"sora\s*2", "sora2"),
    (r"sora", "sora2"),
    (r"可灵|kling", "kling21"),
    (r"即梦|dreamina", "dreamina3"),
    (r"runway", "runway-gen4"),
    (r"veo\s*3", "veo3"),
    (r"hailuo|海螺|minimax", "hailuo"),
    (r"pika", "pika2"),
    (r"luma|dream\s*machine", "luma"),
    (r"hunyuan|混元", "hunyuan"),
    (r"通义万相|wanx|wan\s*2", "wan21"),
    (r"stable\s*video|svd", "stable_video_diffusion"),
    (r"seedance", "seedance"),
    (r"vidu", "vidu"),
    (r"pixverse", "pixverse"),
    (r"gen[\s-]?mo", "genmo"),
]


def first_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that a text matches, letter case aside; null for none and for empty texts."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(name)) for p, name in patterns])


def generator(text: Column) -> Column:
    return first_pattern(text, GENERATOR_PATTERNS)


def family(name: Column) -> Column:
    """The first family that a generator's name contains, else the name in lower case."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(f), F.lit(f)) for f in FAMILIES], low)


def first_term(text: Column, terms: list[str]) -> Column:
    """The first of the terms that a text contains; null for none."""
    return F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in terms])


def any_term(text: Column, terms: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(t) for t in terms]), F.lit(False))


def tag_text(tags: Column) -> Column:
    """Tags of a JSON list in lower case, parted by tabs; a text that is no list as it is; null as empty."""
    parsed = F.from_json(tags, "array<string>")
    return F.coalesce(F.lower(F.array_join(parsed, "\t")), F.lower(tags), F.lit(""))


def tags_any(tags: Column, terms: list[str]) -> Column:
    """Whether any tag of an array contains any term."""
    return F.coalesce(F.exists(tags, lambda t: any_term(F.lower(t), terms)), F.lit(False))


def tag_rule(tags: Column, terms: list[str], rescue: list[str]) -> Column:
    """Tags that hold a term and none of the terms that rescue a video."""
    return tags_any(tags, terms) & ~tags_any(tags, rescue)


def exclusion_reason(title: Column, tags: Column) -> Column:
    """Why a video is kept out, `category:term`: avatars (terms, then names), tutorials, music, presenters, in this order;
    null if it stays."""
    low, tag = F.lower(F.coalesce(title, F.lit(""))), tag_text(tags)
    said = lambda name, term: F.concat(F.lit(f"{name}:"), term)
    either = lambda terms: F.coalesce(*[F.when(tag.contains(t) | low.contains(t), F.lit(t)) for t in terms])
    tutorial = F.coalesce(said("tut", first_term(low, TUTORIAL_TERMS)), said("tut_tag", first_term(tag, TUTORIAL_TAG_TERMS)))
    return F.coalesce(
        said("vt_tag", either(AVATAR_TERMS)),
        said("vt_name", either(AVATAR_NAMES)),
        F.when(~any_term(F.coalesce(title, F.lit("")), TUTORIAL_NEGATIVE), tutorial),
        F.when(~any_term(low, VIDEO_NEGATIVE), said("ai_music", first_term(low, MUSIC_TERMS))),
        said("ai_anchor", first_term(low, ANCHOR_TERMS)),
        said("ai_anchor_tag", first_term(tag, ANCHOR_TAG_TERMS)),
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of `90`, `1:30` or `1:01:30`; null for what is none of these or not over 0 as a plain number."""
    parts = F.split(text, ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    plain = text.try_cast("double")
    return (
        F.when(F.size(parts) == 1, F.when(plain > 0, plain))
        .when(F.size(parts) == 2, (number(1) * 60 + number(2)).cast("double"))
        .when(F.size(parts) == 3, (number(1) * 3600 + number(2) * 60 + number(3)).cast("double"))
    )


#: A date, or a date and a time with or without seconds, fraction and zone.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO date or time; one without a zone is in UTC; null for what is neither."""
    zone = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    seconds = F.regexp_replace(zone, r"([T ]\d{2}:\d{2})(?=Z|[+-])", "$1:00")
    return F.when(text.rlike(ISO), F.unix_micros(seconds.try_cast("timestamp")))


def age_cutoff(now: Column, max_age_days: int | None) -> Column:
    """The earliest time, in microseconds since 1970, of what is at most so many days old at `now` (also microseconds); null
    where there is no limit, that is for none and for 0 days."""
    return now - F.lit(max_age_days * 86_400_000_000) if max_age_days and max_age_days > 0 else F.lit(None).cast("long")


def domain(url: Column) -> Column:
    """What stands between the scheme, if any, and the next slash."""
    return F.lower(F.split_part(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), F.lit("/"), F.lit(1)))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def clean_title(title: Column) -> Column:
    """A title without <em> tags and with the five common entities resolved."""
    plain = F.regexp_replace(title, r"</?em[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return plain


def fixed_url(url: Column) -> Column:
    """`//host/..` with https, http addresses as they are, null else."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("http"), url)


def frame_rate(text: Column) -> Column:
    """`30000/1001` as a number; null for a zero or missing divisor."""
    return F.try_divide(F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double"))


def sample_times(duration: Column, n: int) -> Column:
    """n times spread evenly from a little after 0 to a little before the end."""
    eps = F.least(F.lit(0.5), duration * 0.1)
    step = (duration - 2 * eps) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: eps + step * i)


def umbrella_platform(platform: Column, tags: Column) -> Column:
    """What follows `platform:` in the first tag that begins so; the platform itself without one or with bad JSON."""
    start = F.concat(platform, F.lit(":"))
    first = F.get(F.filter(F.from_json(tags, "array<string>"), lambda t: t.startswith(start)), 0)
    return F.coalesce(F.substring(first, F.length(start) + 1, F.length(first)), platform)


def unfenced(answer: Column) -> Column:
    """A text without the lines that begin with three backticks, if it begins with them itself."""
    plain = F.trim(answer)
    lines = F.filter(F.split(plain, "\n"), lambda x: ~F.trim(x).startswith("```"))
    return F.when(plain.startswith("```"), F.trim(F.array_join(lines, "\n"))).otherwise(plain)


def raw_url(repo: Column, path: Column) -> Column:
    """The address that a dataset's file is loaded from."""
    return F.format_string("https://huggingface.co/datasets/%s/resolve/main/%s", repo, path)


def safe_name(name: Column) -> Column:
    """Whether a file name stays in its folder."""
    return ~(name.contains("/") | name.contains("..") | name.contains("\\"))


def compact_date(text: Column) -> Column:
    """`20240131` as a date; null for other lengths and for what is no date."""
    return F.when(F.length(text) == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def middle_time(duration: Column) -> Column:
    """The time of the middle frame, half a second in at least."""
    return F.greatest(F.lit(0.5), duration / 2)


def frame_index(frames: Column, i: Column, n: int) -> Column:
    """The frame in the middle of the i-th of n equal parts of a video, one of its frames."""
    return F.least(F.greatest(frames - 1, F.lit(0)), F.floor(frames * (i + 0.5) / n).cast("int"))
