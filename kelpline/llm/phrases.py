"""Phrase collocations by stripes (op11).

A stripe is a prefix with an associative counter of the words that come next.  Level m counts phrases of m words: each task
gathers stripes of its texts, Spark brings those of one prefix together, and they are merged element by element.  A merged
stripe gives the prefix's frequent extensions, the prefix's total and the most frequent extension, which is what a longer
phrase takes from the prefix (subsumption).  The stripe of the empty prefix holds the words, and its total is n.

Levels prune each other: a phrase can be frequent only if its first and its last m - 1 words are.  Tasks test both with a bit
map of fixed size (`bitmaps`), which never says no wrongly; what it lets through besides costs rows and is dropped by its
count.  The next word of a stripe is keyed by the hash of the prefix's last words and itself, so that a phrase is a pair of
64-bit hashes of level m - 1, and the table of level m - 1 joined on both gives its text and the counts of all its parts.
Hashes include the language.  (Two different phrases of one level would be taken for one only if hashes of 64 bits met.)

Memory and skew: a task's counter is emitted when it holds MOST_ENTRIES; stripes are shuffled in buckets, a row for each bucket
and task.  There are as many buckets as IN_BUCKET occurrences of the level below in each ask for, so merging, which holds one
bucket at a time, needs the same memory at every size; the stripe of a prefix that occurs WIDE times or more is dealt over all
buckets by next word.

Defined cases: a null text is empty, a null language `und` (one with the texts whose language that is); empty tables give no
rows; repeated rows count each time; long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.bitmaps import Bitmap, bitmap
from kelpline.llm.common import stored
from kelpline.llm.shingles import mix, span_hashes

U = np.uint64
_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_BREAK)] = 2
_STEP = U(0xD6E8FEB86659FD93)
#: Bytes of texts that are hashed at once; entries of a task's counter; occurrences of a wide prefix, and those a bucket may hold.
CHUNK, MOST_ENTRIES = 1 << 21, 1_500_000
WIDE, IN_BUCKET = 20_000, 1 << 18
BROADCAST_ROWS = 200_000

WORDS = "hash long, lang string, word string, n long"
#: Stripes of one bucket: the prefixes, how many next words each has, and these in a row.
STRIPES = "bucket int, prefixes array<long>, sizes array<int>, nexts array<long>, counts array<long>"
MERGED = "prefix long, total long, most long, nexts array<long>, counts array<long>, hashes array<long>"


def language_hash(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1)


def longer(hashes: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer: of each and the next."""
    return mix(hashes[:-1] * _STEP + hashes[1:])


class Words:
    """The words of some texts: bytes, spans, hashes with language, and the piece that each lies in."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data, self.langs = b"\n".join(texts) + b"\n", langs
        data = np.frombuffer(self.data, np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text = np.searchsorted(np.cumsum(lengths), self.starts, side="right")
        keys = np.array([language_hash(x) for x in langs], np.uint64)
        self.hashes = mix(span_hashes(data, self.starts, self.ends) * keys[self.text]) if len(self.starts) else np.zeros(0, np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[Words]:
    """Words of about `size` bytes of texts at a time, or of one longer text; only texts with words."""
    texts, langs, n = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            text = (text or "").encode().lower()
            if texts and n + len(text) > size:
                yield Words(texts, langs)
                texts, langs, n = [], [], 0
            texts.append(text)
            langs.append(lang)
            n += len(text) + 1
    if texts:
        yield Words(texts, langs)


class Counter:
    """Counts by hash with some values of each, in arrays that are merged as they grow."""

    def __init__(self, most: int = MOST_ENTRIES):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append((keys[first], counts, *(v[first] for v in values)))
        self.size += len(first)

    def full(self) -> bool:
        """Whether over half of `most` entries are left when those of one hash are merged."""
        if self.size > self.most:
            merged = self.merged()
            self.parts, self.size = [merged], len(merged[0])
            return self.size > self.most // 2
        return False

    def merged(self) -> tuple[np.ndarray, ...]:
        keys, counts, *values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        return keys, np.bincount(place, counts, len(keys)).astype(np.int64), *(v[first] for v in values)

    def take(self) -> tuple[np.ndarray, ...]:
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripes of the empty prefix: counts of words by language, and their totals in rows without word."""
    found: dict[int, list] = {}
    totals: dict[str, int] = {}

    def rows(columns) -> pa.RecordBatch:
        types = (("hash", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()))
        return pa.record_batch([pa.array(x, t) for x, (_, t) in zip(columns, types, strict=True)], [name for name, _ in types])

    def taken() -> pa.RecordBatch:
        keys = np.fromiter(found, np.uint64, len(found)).view(np.int64)
        return rows([keys, *([v[i] for v in found.values()] for i in range(3))])

    for words in chunks(batches):
        if not len(words.hashes):
            continue
        keys, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
        for lang, n in zip(words.langs, np.bincount(words.text, minlength=len(words.langs)).tolist(), strict=True):
            totals[lang] = totals.get(lang, 0) + n
        places = (words.starts[first].tolist(), words.ends[first].tolist(), words.text[first].tolist())
        for h, start, end, text, n in zip(keys.tolist(), *places, counts.tolist(), strict=True):
            if h in found:
                found[h][2] += n
            else:
                found[h] = [words.langs[text], words.data[start:end].decode(), n]
        if len(found) > MOST_ENTRIES // 4:
            yield taken()
            found = {}
    if found:
        yield taken()
    if totals:
        yield rows([[0] * len(totals), list(totals), [None] * len(totals), list(totals.values())])


def _lists(values: np.ndarray, cuts: np.ndarray, kind: type = np.int64) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view(kind)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places at which a row differs from the one before, 0 among them."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def count_next(level: int, frequent, wide, buckets: int):
    """A mapper to the stripes of phrases of `level` words; frequent, wide: broadcast bit maps of the level below.

    A stripe lies in the bucket of its prefix; that of a wide prefix is dealt over all by next word.  A task gives one row for
    each bucket.
    """

    def taken(counter: Counter) -> pa.RecordBatch:
        _, counts, prefix, nexts = counter.take()
        key = np.where(wide.value.may_hold(prefix), mix(prefix + nexts * _STEP), mix(prefix))
        bucket = ((key >> U(33)) % U(buckets)).astype(np.int32)
        order = np.lexsort((prefix, bucket))
        bucket, counts, prefix, nexts = bucket[order], counts[order], prefix[order], nexts[order]
        stripes, rows = _changes(bucket, prefix), _changes(bucket)
        sizes = np.diff(np.append(stripes, len(prefix))).astype(np.int32)
        of_row, cuts = np.append(np.searchsorted(stripes, rows), len(stripes)), np.append(rows, len(prefix))
        columns = [pa.array(bucket[rows]), _lists(prefix[stripes], of_row), _lists(sizes, of_row, np.int32), _lists(nexts, cuts), _lists(counts, cuts)]
        return pa.record_batch(columns, ["bucket", "prefixes", "sizes", "nexts", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for words in chunks(batches):
            hashes, piece = words.hashes, words.piece
            for _ in range(level - 2):
                hashes = longer(hashes)
            if len(piece) < level:
                continue
            known = frequent.value.may_hold(hashes)
            at = np.flatnonzero(known[:-1] & known[1:] & (piece[level - 1 :] == piece[: len(piece) - level + 1]))
            if len(at):
                prefix, nexts = hashes[at], hashes[at + 1]
                counter.add(mix(prefix * _STEP + nexts), prefix, nexts)
                if counter.full():
                    yield taken(counter)
        if counter.parts:
            yield taken(counter)

    return count


def merge_stripes(least: int):
    """A mapper of rows sorted by bucket to merged stripes: totals, and the extensions that come `least` times or more."""

    def merged(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Element by element: equal next words of a prefix are added."""
        prefix, nexts, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((nexts, prefix))
        prefix, nexts, counts = prefix[order], nexts[order], counts[order]
        cuts = _changes(prefix, nexts)
        prefix, nexts, counts = prefix[cuts], nexts[cuts], np.add.reduceat(counts, cuts)
        first = _changes(prefix)
        total, most = np.add.reduceat(counts, first), np.maximum.reduceat(counts, first)
        kept = counts >= least
        hashes = mix(prefix[kept].view(np.uint64) * _STEP + nexts[kept].view(np.uint64))
        bounds = np.append(0, np.cumsum(np.add.reduceat(kept, first, dtype=np.int64)))
        columns = [pa.array(prefix[first]), pa.array(total), pa.array(most), *(_lists(x, bounds) for x in (nexts[kept], counts[kept], hashes))]
        return pa.record_batch(columns, ["prefix", "total", "most", "nexts", "counts", "hashes"]).filter(pa.array(most >= least))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            for i, b in enumerate(batch.column("bucket").to_pylist()):
                prefixes, sizes, nexts, counts = (batch.column(c)[i].values.to_numpy() for c in ("prefixes", "sizes", "nexts", "counts"))
                if b != bucket and parts:
                    yield merged(parts)
                    parts = []
                bucket = b
                parts.append((np.repeat(prefixes, sizes), nexts, counts))
        if parts:
            yield merged(parts)

    return merge


def _level(texts: DataFrame, below: DataFrame, level: int, least: int, wide: int, in_bucket: int) -> DataFrame | None:
    """The table of frequent phrases of `level` words, from that of one word fewer; None if there are none."""
    spark = texts.sparkSession
    n, places = below.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return None
    hot = below.where(F.col("n") >= wide).select("hash")
    maps = [spark.sparkContext.broadcast(bitmap(x, k)) for x, k in ((below.select("hash"), n), (hot, hot.count()))]
    buckets = min(1 << 30, max(64, int(places) // in_bucket))
    stripes = texts.mapInArrow(count_next(level, *maps, buckets), STRIPES).repartition("bucket").sortWithinPartitions("bucket")
    merged = stored(stripes.mapInArrow(merge_stripes(least), MERGED), f"phrases-{level}-stripes")
    found = merged.select("prefix", F.explode(F.arrays_zip("nexts", "counts", "hashes")).alias("x")).select("prefix", F.col("x.nexts").alias("suffix"), F.col("x.counts").alias("n"), F.col("x.hashes").alias("hash"))
    first = below.select(F.col("hash").alias("prefix"), "lang", F.col("phrase").alias("start"), "heads")
    rest = below.select(F.col("hash").alias("suffix"), "last", "tails")
    rows = found.join(first, "prefix").join(rest, "suffix")
    one = F.array("n")
    out = rows.select("hash", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "n", F.concat("heads", one).alias("heads"), F.concat("tails", one).alias("tails"), "prefix", "suffix")
    return stored(out, f"phrases-{level}")


def _words_of(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The table of frequent words, and n by language."""
    counts = texts.mapInArrow(count_words, WORDS).groupBy("hash", "lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("word").isNull() | (F.col("n") >= least)), "phrases-words")
    word = F.col("word").alias("phrase")
    words = counts.where("word IS NOT NULL").select("hash", "lang", word, F.col("word").alias("last"), "n", F.array("n").alias("heads"), F.array("n").alias("tails"))
    return words, counts.where("word IS NULL").select("lang", F.col("n").alias("words"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, wide: int = WIDE, in_bucket: int = IN_BUCKET) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to `longest` words that come `least` times or more, and the number of words by language.

    Phrases: hash, lang, phrase, n, heads and tails (counts of its first 1, 2, ... and last 1, 2, ... words), and most (the
    count of the most frequent phrase, one word longer, that it lies in; null if none is frequent).
    """
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    below, totals = _words_of(texts, least)
    levels: list[DataFrame] = []
    for level in range(2, longest + 1):
        below = _level(texts, below, level, least, wide, in_bucket)
        if below is None:
            break
        levels.append(below)
    if not levels:
        none = docs.sparkSession.createDataFrame([], "hash long, lang string, phrase string, n long, heads array<long>, tails array<long>, most long")
        return none, totals
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.union(more)
    inside = phrases.where(F.size("heads") > 2).select(F.explode(F.array("prefix", "suffix")).alias("hash"), "n")
    most = inside.groupBy("hash").agg(F.max("n").alias("most"))
    return phrases.select("hash", "lang", "phrase", "n", "heads", "tails").join(most, "hash", "left"), totals


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, percent: int = 100, wide: int = WIDE, in_bucket: int = IN_BUCKET) -> DataFrame:
    """Each language's `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of a occurrences, cut after k words into parts of l and r, scores floor(1000 a n / (l r)); its lowest cut counts, the
    first of equal ones.  Phrases in a longer frequent one with percent/100 of their occurrences or more are dropped: it is
    enough to look one word further, as a phrase between the two is at least as frequent as the longer one.
    """
    phrases, totals = frequent_phrases(docs, least, longest, wide, in_bucket)
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    rows = phrases.where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("n"))).join(totals, "lang")
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of four counts pass 64 bits
    size = F.size("heads")

    def cut(k):
        left, right = F.get("heads", k - 1), F.get("tails", size - k - 1)
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole(F.col("n")) * whole(F.col("words"))).cast("decimal(34,0)"), whole(left) * whole(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    rows = rows.select("lang", "phrase", "n", "words", best.alias("best"))
    rows = rows.select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("words").alias("n"), "best.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY 1),
o AS (SELECT lang, m, array_to_string(words[j : j + m - 1], ' ') AS phrase FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS j FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(words) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 100),
g AS (SELECT *, string_split(phrase, ' ') AS words FROM f),
c AS (SELECT lang, m, phrase, a, words, unnest(range(1, m)) AS k FROM g WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, CAST(1000::HUGEINT * c.a * t.n // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM c JOIN t USING (lang)
 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.k + 1 : c.m], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
z AS (SELECT lang, array_to_string(words[j : j + q - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, words, m, a, q, unnest(range(1, m - q + 2)) AS j FROM g, (SELECT unnest([2, 3, 4]) AS q) WHERE q < m) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN z USING (lang, phrase) WHERE cut = 1 AND (z.most IS NULL OR 100 * z.most < 100 * b.a)),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM e WHERE rank <= 2000
"""
