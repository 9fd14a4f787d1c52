import collections
import itertools
import pathlib
import time
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from kelpline.llm import common, near_dedup, substring_dedup


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = collections.Counter((a, b) for v in where.values() for n, b in enumerate(v) for a in v[:n])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)) if rows[i][0] is not None)


def found(df):
    out = near_dedup.near_duplicates(df).where("doc_id IS NOT NULL").collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out)


def test_near_duplicates(documents):
    assert found(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_near_duplicates_odd(odd_documents, no_documents):
    assert found(odd_documents) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_chains_and_borderline_groups(spark):
    """Copies of copies, each linked to the next alone, and a group that shares half of its words."""
    words = [f"a{i}" for i in range(100)]
    rows, doc = [], list(words)
    for step in range(12):
        doc = doc[:-2] + [] if step % 2 else [f"x{step}"] + doc
        rows.append((step, " ".join(doc)))
    half = " ".join(f"h{i}" for i in range(60))
    rows += [(100 + k, half + " " + " ".join(f"t{k}_{i}" for i in range(60 - k))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_large_buckets_are_dealt_further(spark, monkeypatch):
    """Groups that share most words, some linked and some not, in buckets over the bound of a task."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    rows = []
    for g in range(3):
        shared = [f"g{g}w{i}" for i in range(144)]
        for k in range(30):
            own = [f"g{g}t{k}x{i}" for i in range(30 if k % 3 else 12)]
            rows.append((1000 * g + k, " ".join(shared[: 72 + k % 5] + own + shared[72 + k % 5 :])))
            if k % 10 == 0:
                rows.append((1000 * g + 500 + k, " ".join(shared[: 72 + k % 5] + own + shared[72 + k % 5 : -1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert found(df) == want and 1 < len({r[2] for r in want}) < len(rows)


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    both = np.concatenate([a[:1500], b])
    x, y = near_dedup.set_sketch(a), near_dedup.set_sketch(both)
    assert (near_dedup.merge(near_dedup.set_sketch(a[:900]), near_dedup.set_sketch(a[900:])) == x).all()
    greater, less = (x > y).sum(keepdims=True), (x < y).sum(keepdims=True)
    j = near_dedup.estimate(greater, less, near_dedup.REGISTERS - greater - less, np.array([2000.0]), np.array([3500.0]))
    assert abs(j[0] - 1500 / 4000) < 0.12


def test_compact_windows_cover_all_runs():
    rng = np.random.default_rng(1)
    for n in (5, 17, 60, 200):
        values = rng.integers(0, 40, n).astype(np.uint64)
        windows = list(zip(*(x.tolist() for x in substring_dedup.compact_windows(values, 5)), strict=True))
        for i in range(n):
            for j in range(i + 4, n):
                inside = [(l, c, r) for l, c, r in windows if l <= i <= c <= j < r]
                assert len(inside) == 1 and values[inside[0][1]] == values[i : j + 1].min()


def test_compact_windows_of_several_texts():
    rng = np.random.default_rng(4)
    sizes = [30, 3, 5, 80, 46]
    values = rng.integers(0, 25, sum(sizes)).astype(np.uint64)
    starts = np.cumsum([0, *sizes[:-1]])
    got = list(zip(*(x.tolist() for x in substring_dedup.compact_windows(values, 5, starts[1:])), strict=True))
    want = []
    for s, n in zip(starts.tolist(), sizes, strict=True):
        want += [(l + s, c + s, r + s) for l, c, r in zip(*(x.tolist() for x in substring_dedup.compact_windows(values[s : s + n], 5)), strict=True)]
    assert got == want


def test_repeated_passages(documents):
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in documents.collect()}
    seen = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    got = substring_dedup.repeated_passages(documents).collect()
    cover = collections.defaultdict(set)
    for r in got:
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_doc_id != r.doc_id
        cover[r.doc_id].update(range(r.start_word, r.end_word))
    for i, w in words.items():
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                assert set(range(k, k + 50)) <= cover[i]


def test_overlapping_passages_of_different_texts(spark):
    """A text shares overlapping words with one text and with another; neither hides the other."""
    rows = []
    for k in range(60):
        p = [f"p{k}_{i}" for i in range(72)]
        own = [[f"o{k}_{j}_{i}" for i in range(60)] for j in range(6)]
        rows += [(3 * k, own[0] + p + own[1]), (3 * k + 1, own[2] + p[:60] + own[3]), (3 * k + 2, own[4] + p[22:] + own[5])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: (r.start_word, r.end_word) for r in substring_dedup.repeated_passages(df).collect()}
    # A similar passage may take in a few words around what is shared.
    assert set(got) == set(range(180))
    for k in range(60):
        for j, end in enumerate((132, 120, 110)):
            assert 45 <= got[3 * k + j][0] <= 60 and end <= got[3 * k + j][1] <= end + 15


def test_links_of_overlapping_passages(spark):
    """A stretch of passages shared with two texts keeps both links; a class has its links, whoever led."""
    p = [f"p{i}" for i in range(150)]
    own = [[f"o{j}_{i}" for i in range(60)] for j in range(20)]
    rows = [(1, own[0] + p + own[1]), (2, own[2] + p[:70] + own[3]), (3, own[4] + p[60:] + own[5])]
    q = [f"q{i}" for i in range(80)]
    rows += [(10 + k, own[6 + k] + q) for k in range(5)] + [(20, own[11] + q), (21, own[11] + q)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = substring_dedup.passage_links(df).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in got}
    assert {(1, 2), (1, 3), (2, 1), (3, 1), (20, 21), (21, 20)} <= pairs == {(b, a) for a, b in pairs}
    ids = collections.defaultdict(set)
    for r in got:
        ids[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, ids.values())) == [[1, 2, 3], [10, 11, 12, 13, 14, 20, 21]]
    rows = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.class_id, r.class_links) for r in rows} == {(r.doc_id, r.class_id, r.class_links) for r in got}
    assert {r.class_links for r in rows if r.doc_id >= 10} == {len([r for r in got if r.doc_id >= 10]) // 2}


def test_repeated_passages_with_an_edit(spark, odd_documents, no_documents):
    passage = [f"p{i}" for i in range(160)]
    edited = passage[:80] + ["new"] + passage[81:]
    own = lambda k: [f"d{k}_{i}" for i in range(100)]
    rows = [(1, own(1) + passage + own(2)), (2, own(3) + edited + own(4)), (3, own(5) + passage[:40] + own(6))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: (r.start_word, r.end_word, r.other_doc_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {1: (100, 260, 2), 2: (100, 260, 1)}
    assert {r.doc_id for r in substring_dedup.repeated_passages(odd_documents).collect()} == {5, 6, 7, None}
    assert substring_dedup.repeated_passages(no_documents).count() == 0


def test_recall_of_edited_passages(spark):
    """Planted passages of 50 to 60 words and similarity 0.75 to 0.9, held against their true similarity."""
    rng = np.random.default_rng(7)
    rows, planted = [], []
    for k in range(120):
        n = int(rng.integers(50, 61))
        passage = [f"p{k}_{i}" for i in range(n)]
        edited = list(passage)
        at = int(rng.integers(0, n - 1))
        for i in range(at, at + 1 + k % 2):
            edited[i] = f"e{k}_{i}"
        a, b = shingles(" ".join(passage)), shingles(" ".join(edited))
        if 0.75 <= len(a & b) / len(a | b) <= 0.9:
            planted += [(2 * k, 2 * k + 1)]
        own = [[f"o{k}_{j}_{i}" for i in range(40)] for j in range(4)]
        rows += [(2 * k, " ".join(own[0] + passage + own[1])), (2 * k + 1, " ".join(own[2] + edited + own[3]))]
    assert len(planted) >= 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.other_doc_id for r in substring_dedup.repeated_passages(df).collect()}
    missed = [(i, j) for i, j in planted if found.get(i) != j or found.get(j) != i]
    assert not missed


def test_runs_of_repeated_shingles():
    """Both texts hold a passage twice, one version edited; a repeated line before a passage with another diagonal."""
    row = lambda k, n: np.arange(1000 * k, 1000 * k + n, dtype=np.uint64)
    passage, line = row(1, 48), row(2, 6)
    edited = np.concatenate([passage[:21], row(3, 5), passage[26:]])
    x, y = np.concatenate([edited, row(4, 70), edited]), np.concatenate([passage, row(5, 70), passage])
    for p, q in ((x, y), (y, x)):
        got = substring_dedup.common_runs(p, q, 46, 0.75)
        for at in (0, 118):
            assert any(a <= at and at + 48 <= b for a, b, *_ in got) and any(c <= at and at + 48 <= d for _, _, c, d, _ in got)
    x = np.concatenate([line, passage])
    y = np.concatenate([line, row(6, 90), line, row(7, 80), passage, row(8, 70), passage])
    got = substring_dedup.common_runs(x, y, 46, 0.75)
    assert {(182, 230), (300, 348)} <= {(c, d) for _, _, c, d, _ in got}


@pytest.mark.parametrize("need", [1, 5])
def test_supported(need):
    h = np.array([0, 1, 2, 3, 4, 0])
    l, c, r = np.array([0, 0, 0, 0, 0, 500]), np.array([30, 31, 32, 33, 34, 530]), np.array([90, 90, 90, 90, 90, 590])
    assert substring_dedup.supported(h, l, c, r, 46, need).tolist() == [True] * 5 + [need == 1]


def similar_groups(groups):
    """Four texts a group, two with a passage of 60 words and two with it but for one word."""
    rows = []
    for g in range(groups):
        p = [f"p{g}_{i}" for i in range(60)]
        for k, passage in enumerate((p, p, [*p[:30], f"e{g}", *p[31:]], [*p[:30], f"e{g}", *p[31:]])):
            own = [[f"o{g}_{k}_{j}_{i}" for i in range(40)] for j in range(2)]
            rows.append((4 * g + k, " ".join(own[0] + passage + own[1])))
    return rows


@pytest.mark.parametrize("block", [32768, 8])
def test_explained_passages_meet_similar_ones(spark, monkeypatch, block):
    """Exact copies explain all four texts of a group; the two passages are linked all the same, also in dealt groups."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    groups = 60 if block > 8 else 6
    df = spark.createDataFrame(similar_groups(groups), "doc_id long, text string")
    ids = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(df).collect():
        ids[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, ids.values())) == [[4 * g + k for k in range(4)] for g in range(groups)]


def test_chains_of_similar_passages(spark):
    """Each version of a passage has exact copies and is similar to the next version only."""
    rows = []
    for g in range(10):
        p = [f"p{g}_{i}" for i in range(64)]
        for version in range(6):
            p = list(p)
            p[9 * version + 8] = f"e{g}_{version}"
            for k in range(2):
                own = [[f"o{g}_{version}_{k}_{j}_{i}" for i in range(40)] for j in range(2)]
                rows.append((100 * g + 10 * version + k, " ".join(own[0] + p + own[1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(df).collect():
        ids[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, ids.values())) == [[100 * g + 10 * v + k for v in range(6) for k in range(2)] for g in range(10)]


@pytest.mark.parametrize("limits", [{"BLOCK": 2}, {"ROOM": 200}])
def test_large_groups_keep_all_pairs(spark, monkeypatch, limits):
    """Places of a large group that share one signature, and no further one, still meet; no tile is above the limits by much."""
    for name, value in limits.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rows = [(7, t, 10, 60, 20, 30, 100 + t, True) for t in range(1, 13)]
    places = spark.createDataFrame(rows, "signature long, text_key long, l int, r int, c int, d int, label long, bare boolean")
    groups = collections.defaultdict(set)
    for r in substring_dedup._tiled(substring_dedup._merged(substring_dedup._grouped(places))).collect():
        assert (r.l, r.r) == (10, 60)
        groups[r.group].add(r.text_key)
    met = {pair for texts in groups.values() for pair in itertools.combinations(sorted(texts), 2)}
    assert met == set(itertools.combinations(range(1, 13), 2))
    assert len(groups) > 1 and all(len(texts) < 12 for texts in groups.values())


def test_stored_tables_leave_no_shuffle_files(spark):
    """The shuffle files of a stored table go with its write and not when the driver collects garbage; the setting stays."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = lambda: {p for d in manager.localDirsString() for p in pathlib.Path(d).rglob("shuffle_*")}
    before, was = found(), spark.conf.get(common.CLEANUP)
    df = common.stored(spark.range(1000).repartition(4, "id"), "test-shuffle")
    until = time.time() + 10
    while found() - before and time.time() < until:
        time.sleep(0.1)
    assert not found() - before
    assert df.count() == 1000 and spark.conf.get(common.CLEANUP) == was
    common.dropped(df)


def test_places_of_texts_in_a_row(spark):
    """Texts whose windows come in one batch get the places that each gets alone."""
    windows = [(t, h, 100 + h, 0, 30 + h + t, 90) for t in range(1, 6) for h in range(substring_dedup.HASHES)]
    columns = [f.split()[0] for f in substring_dedup.PLACE.split(", ")]
    places = lambda rows: {tuple(r) for r in substring_dedup._places(spark.createDataFrame(rows, substring_dedup.WINDOW), 46).select(columns).collect()}
    together = places(windows)
    assert {r[2] for r in together} == set(range(1, 6)) and {r[1] for r in together} == set(range(-1, substring_dedup.HASHES))
    assert together == {r for t in (1, 5) for r in places([w for w in windows if w[0] == t])} | {r for r in together if r[2] in (2, 3, 4)}


def test_only_pairs_that_can_be_similar_are_compared(monkeypatch):
    """Two places that share four of five shingles have similarity 2/3 at most: they are told without a comparison of runs."""
    rows = []
    for g in range(3):
        for text in (0, 1):
            own = [10_000 * g + 100 * k + (text and k % 5 == 4) for k in range(100)]
            rows.append((g, 2 * g + text, 0, 2 * g + text, np.array(own, np.uint64).tobytes()))
    rows += [(3, t, 0, t, np.arange(10**6, 10**6 + 60, dtype=np.uint64).tobytes()) for t in (6, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["group", "text_key", "l", "label", "grams"])
    compared = []
    common_runs = substring_dedup.common_runs
    monkeypatch.setattr(substring_dedup, "common_runs", lambda *a: compared.append(1) or common_runs(*a))
    frame = mock.MagicMock()
    for method in ("join", "select", "repartition", "sortWithinPartitions"):
        getattr(frame, method).return_value = frame
    frame.mapInArrow.side_effect = lambda run, schema: [r for b in run(iter([batch])) for r in b.to_pylist()]
    found = substring_dedup._group_repeats(frame, frame, 46, 0.75)
    assert [(r["x"], r["y"], r["x_from"], r["x_to"]) for r in found] in ([(6, 7, 0, 64)], [(7, 6, 0, 64)])
    assert len(compared) == 1


def test_densest_and_may_join():
    """The share is that of the best run of any length; what brute force finds similar is never ruled out."""
    rng = np.random.default_rng(5)
    for n in (3, 9, 40, 41):
        flags = rng.random((20, n)) < 0.6
        brute = [max((f[i:j].mean() for i in range(n) for j in range(i + 9, n + 1)), default=0) for f in flags]
        assert np.allclose(substring_dedup.densest(flags, 9), brute)
    for _ in range(200):
        x = np.arange(80, dtype=np.uint64)
        y = np.where(rng.random(80) < rng.choice([0.05, 0.14, 0.3]), x + np.uint64(10**6), x)
        if substring_dedup.common_runs(x, y, 46, 0.75):
            assert substring_dedup.shares(x, y, 46, 0.75)
