import hashlib
import re

import numpy as np
import pytest

from kelpline.llm import chat, decontamination, topk
from kelpline.llm.templates import TemplateError, compile_template, fold, parse


def rendered(source, **values):
    return "".join(t for t, _ in compile_template(source)(values))


@pytest.mark.parametrize(
    ("source", "values", "text"),
    [
        ("a{{ 1 + 2 }}b", {}, "a3b"), ("{{ x.y | upper }}", {"x": {"y": "q"}}, "Q"), ("{{ x['y'] }}", {"x": {"y": None}}, ""), ("{{ 'a' if x else 'b' }}", {"x": 0}, "b"),
        ("{% for i in r %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", {"r": "xyz"}, "1x,2y,3z"),
        ("{% if a == 1 %}one{% elif a in [] %}{% endif %}", {"a": 1}, None), ("{% set k = 'v' %}{{ k }}{# no #}", {}, "v"),
        ("x {%- if true -%} y {%- endif %} z", {}, "xy z"), ("{{ x.__class__ }}", {"x": "text"}, ""), ("{{ '\\n' }}", {}, "\n"),
    ],
)
def test_templates(source, values, text):
    if text is None:
        with pytest.raises(TemplateError):
            rendered(source, **values)
    else:
        assert rendered(source, **values) == text


@pytest.mark.parametrize("source", ["{{ f() }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x | nothing }}", "{{ a b }}", "{% import os %}", "{{ 'open }}"])
def test_template_errors(source):
    with pytest.raises(TemplateError):
        rendered(source)


def test_constants_are_folded():
    assert fold(parse("a{{ 1 + 1 }}{% if 1 == 2 %}x{% else %}b{% endif %}{{ 'c' | upper }}"), {"upper": str.upper}) == [("text", "a2bC")]


def test_escape_round_trip():
    for text in ("\\### Assistant: </turn> ok", "#####", "\\h\\t\\\\", "</turn></turn>", "", "##</tur"):
        hidden = chat.escape(text)
        assert "###" not in hidden and "</turn>" not in hidden and chat.unescape(hidden) == text


def test_chat_odd(spark):
    schema = "conv_id long, turn long, role string, text string, chunk int, loss string"
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, None, "a:b\n", "x"), (2, 0, "user", "y" * 300_000), (3, 0, "user", "q"), (3, 1, "assistant", "r###")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], schema)
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: v.n_turns for k, v in out.items()} == {1: 3, None: 1, 2: 1, 3: 2}
    assert out[3].loss_chars == 4 and out[3].loss_sha256 == hashlib.sha256(b"r###").hexdigest()
    assert out[None].turns_sha256 == hashlib.sha256(b"a:b\n\nx\n").hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def brute_hits(doc, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    w, hit, found = split(doc), set(), set()
    for item_id, text in items:
        v = split(text)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item_id))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination_brute(spark, odd_documents, no_documents):
    a = " ".join(f"q{i}" for i in range(40))
    items = [(1, a), (2, "short one"), (3, None), (4, ""), (10, "Q3 q4 Q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15!"), (5, "a b a b a b a b a b a b a b a b"), (1, "solo")]
    docs = [(1, "x " * 20 + a[30:120]), (2, "a short, one; and solo"), (3, None), (4, ""), (5, "a b " * 30), (6, "q1 q2 q3"), (6, a), (None, a), (7, a), (7, a)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n_words", "2 AS length")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS n_hit", "'p' AS print")
    key = lambda r: tuple(map(repr, r))
    got = sorted(map(tuple, decontamination.contamination(df, bench).collect()), key=key)
    assert got == sorted([(i, *brute_hits(t, items)) for i, t in docs], key=key)
    assert decontamination.contamination(no_documents, bench).count() == 0
    assert not decontamination.contamination(odd_documents, bench.limit(0)).where("contaminated OR n_hit > 0").count()


def test_decontamination_native(documents, spark, sf_dir):
    out = decontamination.contamination(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_top_k_brute(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).round(1).tolist()) for i in range(700)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(1000, 1400)] + [(2000, None), (2001, [1.0, None, 2.0]), (2002, [float("nan"), 1.0, 1.0]), (2003, []), (None, [1.0, 1.0, 1.0]), (50, rows[50][1]), (100, [9.0, 9.0, 9.0]), (2050, [1e9, 1.0, 0.0]), (2100, [1.0, 2.0])]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard"))
    got = topk.inner_product_top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and i not in (2000, 2001, 2002, 2003)]
    want = set()
    for own, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for at, (i, x) in enumerate(whole) if at != own and len(x) == len(v))
            want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.inner_product_top_k(vectors.limit(0), vectors, 5).count() == 0
