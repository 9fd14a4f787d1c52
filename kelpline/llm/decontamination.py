"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is 13 consecutive words of an item, or a whole item of fewer.  Of both sides, every run of W k-grams of K words
keeps its least hash; since K + W - 1 = 13, any 13 words that a document shares with an item lie over one such run on
either side and keep the same hash.  The join of these fingerprints therefore finds every document to look at.  Items of
fewer than 13 words are looked for by the hash of all their words instead.  In the documents found, hits are extended
word by word: each run of words that equals a window of an item is marked, and the marks' union is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import ascii_lower, stored

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of at most so many rows are broadcast, after they have been counted; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SPLIT), "")


def _runs(items: Column, n: Column, length: Column | int) -> Column:
    """Starts (from 1) of the runs of `length` items; none if there are fewer items."""
    last = n - F.lit(length) + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def grams(items: str, k: int) -> Column:
    """Hashes of all runs of k words of a column.

    The column stands by name: a lambda would compute a longer expression anew for each run.
    """
    return F.transform(_runs(F.col(items), F.size(items), k), lambda i: F.xxhash64(F.slice(items, i, k)))


def winnow(hashes: str, w: int) -> Column:
    """Distinct least hashes of all runs of w hashes."""
    return F.array_distinct(F.transform(_runs(F.col(hashes), F.size(hashes), w), lambda i: F.array_min(F.slice(hashes, i, w))))


def _spots(items: str, length: int) -> Column:
    """Start and words of each run of `length` words."""
    starts = _runs(F.col(items), F.size(items), length)
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.concat_ws(" ", F.slice(items, i, length)).alias("gram")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has been counted to have few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 7, share: int = 20, digests: bool = False
) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    documents: doc_id, text; benchmark: item_id, text; other columns are not looked at.  Null or empty texts have no
    words and no hits.  Equal rows get equal results, rows with one doc_id and different texts each their own.  Items
    without words or without item_id never occur.  A document is contaminated if it has a hit and at least one word in
    `share` is hit.  An empty benchmark leaves every document clean.  With digests, the xxhash64 of each text is given too.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.size("w"))
    wide = F.least(F.col("n"), F.lit(window))
    windows = items.select("item_id", wide.alias("length"), F.explode(_runs(F.col("w"), F.col("n"), wide)).alias("i"), "w")
    windows = windows.select("item_id", "length", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("length"))).alias("gram"))
    windows = stored(windows.distinct(), "benchmark-windows")
    long = items.where(F.col("n") >= window).select(grams("w", k).alias("h"))
    fingerprints = long.select(F.lit(window).alias("length"), F.explode(winnow("h", window - k + 1)).alias("print"))
    short = items.where(F.col("n") < window).select(F.col("n").alias("length"), F.xxhash64("w").alias("print"))
    fingerprints = stored(fingerprints.union(short).distinct(), "benchmark-prints")
    n_windows, n_prints = windows.count(), fingerprints.count()
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `window` numbers

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    found = None
    split = rows.select("doc_id", "digest", words(F.col("text")).alias("w"))
    for length in lengths:
        hashed = split.select("doc_id", "digest", grams("w", k if length == window else length).alias("h"))
        prints = winnow("h", window - k + 1) if length == window else F.array_distinct("h")
        these = _small(fingerprints.where(F.col("length") == length).select("print"), n_prints)
        some = hashed.select("doc_id", "digest", F.explode(prints).alias("print")).join(these, "print", "left_semi")
        some = some.select("doc_id", "digest")
        found = some if found is None else found.union(some)
    sizes = rows.select("doc_id", "digest", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if found is None:
        hits = rows.limit(0).select("doc_id", "digest", F.lit(0).alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        found = stored(found.distinct(), "decontamination-found")
        these = _small(found, found.count()).alias("f")
        same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest"))
        texts = rows.alias("d").join(these, same, "left_semi").dropDuplicates(["doc_id", "digest"])
        texts = texts.select("doc_id", "digest", words(F.col("text")).alias("w"))
        places = None
        for length in lengths:
            some = texts.select("doc_id", "digest", F.explode(_spots("w", length)).alias("spot"))
            some = some.select("doc_id", "digest", F.lit(length).alias("length"), F.col("spot.i").alias("i"), F.col("spot.gram").alias("gram"))
            places = some if places is None else places.union(some)
        hits = places.join(_small(windows, n_windows), ["length", "gram"]).groupBy("doc_id", "digest").agg(
            F.collect_set(F.struct("i", "length")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items")
        )
        covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["i"], s["i"] + s["length"] - 1)))
        hits = hits.select("doc_id", "digest", F.size(F.array_distinct(covered)).alias("n_hit"), "items")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.digest") == F.col("h.digest"))
    out = sizes.alias("d").join(hits.alias("h"), same, "left")
    names = F.coalesce("h.items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("h.n_hit"), F.lit(0)).cast("long")
    return out.select(
        "d.doc_id",
        *(["d.digest"] if digests else []),
        "d.n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(names)), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {documents}
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT s.doc_id, s.i, s.n, win.item_id FROM spots s JOIN win USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
