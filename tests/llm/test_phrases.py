import re
from collections import Counter

import pytest

from kelpline.llm import phrases as P


def plain(rows, top=2000, least=3, longest=5, percent=100):
    """Counts, cuts and drops by the rule, in plain Python."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    frequent = {k: a for k, a in counts.items() if a >= least}
    for (lang, words), a in frequent.items():
        m = len(words)
        if m < 2 or any(lng == lang and 100 * b >= percent * a and len(w) > m and any(w[i : i + m] == words for i in range(len(w) - m + 1)) for (lng, w), b in frequent.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, m)]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            yield r[0], ranks[r[0]], *r[1:]


def rows_of(spark, texts, **more):
    df = spark.createDataFrame([(t, lang, i, "x", 0) for i, (t, lang) in enumerate(texts)], "text string, lang string, prefix long, word string, n long")
    return sorted(map(tuple, P.collocations(df.repartition(5), **more).collect()))


TEXTS = [
    ("The cat sat on the mat. the CAT sat on\tthe mat! a b a b a b a b", "en"), ("the cat sat on the mat, \x00\x1f zwei", None), ("a a a a a a a a", "en"), ("A a", "de"),
    ("", "en"), (None, "en"), (None, None), (" \t\n", "xx"), ("ÄÖ äö ÄÖ äö ÄÖ äö\x0bÄÖ äö ÄÖ äö", "und"), ("x y\rx y\x0cx y;x y:x y?x z y", "en"), ("the cat sat on the mat", "en"), ("the cat sat on the mat", "en"),
    ("ÀÖ äö ÀÖ äö ÀÖ äö zz", "und"), ("long " * 3000 + "tail", "en"), ("w" * 100_000 + " v " + "w" * 100_000 + " v " + "w" * 100_000 + " v", "de"),
]


@pytest.mark.parametrize("more", [{}, {"percent": 50}, {"longest": 3, "top": 2}])
def test_equals_plain_python(spark, more):
    assert rows_of(spark, TEXTS, least=3, **more) == sorted(plain(TEXTS, **more))


def test_small_counters_chunks_and_shards_give_the_same(spark, documents, monkeypatch):
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").limit(40).collect()]
    want = sorted(plain(rows, least=8))
    assert len(want) > 40
    assert rows_of(spark, rows, least=8, wide=10, in_bucket=50) == want
    counter, words = P.Counter(50), P.Words([b"a b a b. b a", b"a c"], ["en", "de"])
    for _ in range(40):
        counter.add(words.hashes, words.hashes)
        counter.full()
    keys, counts, values = counter.take()
    assert counts.sum() == 40 * 8 and (keys == values).all() and len(keys) == 4 and counter.parts == []


def test_a_bucket_that_spans_batches_is_merged_once():
    import pyarrow as pa

    rows = [(0, [1], [2], [5, 6], [1, 1]), (0, [1, 2], [1, 1], [5, 9], [2, 4]), (0, [1], [2], [6, 7], [1, 9]), (1, [2], [1], [5], [3]), (4, [3], [1], [8], [2]), (4, [3], [1], [8], [1])]
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    schema = pa.schema(list(zip(("bucket", "prefixes", "sizes", "nexts", "counts"), kinds, strict=True)))
    for size in (1, 2, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + size]), schema)], schema=schema) for i in range(0, 6, size)]
        out = [r for b in P.merge_stripes(3)(iter(batches)) for r in b.to_pylist()]
        assert [(r["prefix"], r["total"], r["most"], r["nexts"], r["counts"]) for r in out] == [(1, 14, 9, [5, 7], [3, 9]), (2, 4, 4, [9], [4]), (2, 3, 3, [5], [3]), (3, 3, 3, [8], [3])]
        assert all(len(r["hashes"]) == len(r["nexts"]) for r in out)


def test_no_rows(spark, no_documents):
    assert P.collocations(no_documents).collect() == []
    assert rows_of(spark, [("a b", "en")], least=3) == []
