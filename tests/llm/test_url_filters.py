from kelpline.llm import url_filters as U

ODD = [
    (1, None), (2, ""), (3, "no scheme/a"), (4, "HTTP://WWW.Example.ORG/en/12?x#y"), (5, "http://example.org"), (6, "http://notexample.org/es/1"),
    (7, "http://a.example.org/es/1"), (8, "x://com/de/"), (9, "http://u:p@a.co.uk:80/q://b"), (10, "http://ÄB.com/fr/\n1"), (4, "HTTP://WWW.Example.ORG/en/12?x#y"),
    (None, "http://9.9.9.9/"), (11, "http://b.com?/fr/"),
]


def judged(spark, rows, labels=(), **more):
    pages = spark.createDataFrame([(*r, "z", "n") for r in rows], "page_id long, url string, host string, n string")
    labels = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return U.filtered(pages, U.outcomes(labels), **more)


def test_hosts_paths_and_rules(spark):
    found = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in judged(spark, ODD).collect()}
    assert judged(spark, ODD).count() == len(ODD)
    assert found == {
        (1, "", ""): (None, "allow"), (2, "", ""): (None, "allow"), (3, "", ""): (None, "allow"), (4, "www.example.org", "/en/12"): ("example.org/en/1", "block"),
        (5, "example.org", ""): (None, "allow"), (6, "notexample.org", "/es/1"): ("org/", "allow"), (7, "a.example.org", "/es/1"): ("example.org/es/", "block"),
        (8, "com", "/de/"): ("com/de/", "block"), (9, "u:p@a.co.uk:80", "/q://b"): (None, "allow"), (10, "Äb.com", "/fr/\n1"): ("com/fr/", "allow"),
        (None, "9.9.9.9", "/"): (None, "allow"), (11, "b.com", ""): (None, "allow"),
    }


def test_domains(spark):
    hosts = ["u:p@a.b.co.uk:80", "www.example.com", "com", "", "1.2.3.4", "x.y.z.de.", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    d = U.domain(df["host"])
    assert [tuple(r) for r in df.select(d, U.suffix(d)).collect()] == [
        ("b.co.uk", "co.uk"), ("example.com", "com"), ("com", ""), ("", ""), ("1.2.3.4", ""), ("z.de", "de"), ("co.uk", "uk")
    ]


def plain(counts):
    """The same reputations in plain Python: host -> (a, b)."""
    level = lambda groups: max(min(sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in groups) / (sum(n * (n - 1) * m * (1 - m) for n, k, m in groups) or 1), 0.9), 0.0001)
    tree = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in counts}
    add = lambda at: {x: tuple(sum(counts[h][i] for h in counts if tree[h][at] == x) for i in (0, 1)) for x in {t[at] for t in tree.values()}}
    domains, suffixes = add(0), add(1)
    all_n, all_k = (sum(c[i] for c in counts.values()) for i in (0, 1))
    shrink = lambda group, mean: (lambda s: ({x: (k + s * mean[x]) / (n + s) for x, (n, k) in group.items()}, s))(round(1 / level([(n, k, mean[x]) for x, (n, k) in group.items()]) - 1, 6))
    of_suffix, _ = shrink(suffixes, dict.fromkeys(suffixes, all_k / all_n))
    of_domain, _ = shrink(domains, {d: of_suffix[d.split(".")[-1]] for d in domains})
    mean = {h: of_domain[tree[h][0]] for h in counts}
    _, s = shrink(counts, mean)
    return {h: (s * mean[h] + k, s * (1 - mean[h]) + n - k) for h, (n, k) in counts.items()}


def test_posteriors_equal_plain_python_and_bad_hosts_are_blocked(spark):
    counts = {"a.bad.com": (60, 55), "b.bad.com": (3, 3), "c.bad.com": (0, 0), "a.good.com": (80, 4), "b.good.com": (2, 2), "x.other.net": (50, 5), "y.other.net": (40, 3)}
    df = spark.createDataFrame([(h, n, k) for h, (n, k) in counts.items()], "host string, n long, k long")
    found = {r.host: (r.a, r.b) for r in U.reputations(df).collect()}
    want = plain(counts)
    assert set(found) == set(want)
    for h in want:
        assert all(abs(x - y) < 1e-9 * max(1, y) for x, y in zip(found[h], want[h], strict=True))
    rows, labels, i = [], [], 0
    for h, (n, k) in counts.items():
        for j in range(n + 1):
            rows.append((i, f"http://{h}/{j}"))
            if j < n:
                labels.append((i, 0 if j < k else 1, 0))
            i += 1
    labels += [(None, 0, 1), (0, None, None), (10**6, 0, 0)]
    out = judged(spark, rows, labels)
    verdicts = {(r.host, r.verdict) for r in out.collect()}
    assert ("a.bad.com", "block") in verdicts and len(verdicts) == len(counts)
    assert {h for h, v in verdicts if v == "block"} <= {"a.bad.com", "b.bad.com", "c.bad.com"}
    salted = judged(spark, rows, labels, broadcast_rows=0)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, out.collect()))


def test_no_labels_and_no_pages(spark):
    assert {r.verdict for r in judged(spark, [(1, "http://a.net/"), (2, "http://b.net/")]).collect()} == {"allow"}
    assert judged(spark, []).count() == 0
