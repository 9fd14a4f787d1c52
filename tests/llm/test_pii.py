import re

import regex

from kelpline.llm import pii

PATTERN = r"\S+@[\w.]+|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\(\d{3}\) \d{3}-\d{4}|(?i:token) = \"\w+"


def test_surrogates_are_distinct_and_coreferent(documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    new, old = {}, {}
    for r in pii.pseudonymized(documents).collect():
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
        for a, b in zip(re.findall(PATTERN, before[r.doc_id]), re.findall(PATTERN, r.text), strict=True):
            assert a != b and new.setdefault(a, b) == b and old.setdefault(b, a) == a


def test_types_and_formats(spark):
    text = "Mr. John Smith, Mrs. Smith: 1-743-555-3824 or +1 (743) 555-3824. 4111111111111111, 4111-1111-1111-1111. Г-жа Анна Иванова. SSN 123-45-6789"
    out = pii.pseudonymized(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    m = re.fullmatch(
        r"Mr\. (\w+) (\w+), Mrs\. (\w+): (\d-\d{3}-\d{3}-\d{4}) or (\+\d \(\d{3}\) \d{3}-\d{4})\. (\d{16}), ([\d-]{19})\. Г-жа ([а-яА-Я]+) ([а-яА-Я]+)\. SSN (\d{3}-\d\d-\d{4})", out
    )
    assert m and m[2] == m[3] and not {"John", "Smith", "Анна", "Иванова"} & set(m.groups())
    assert any(m[1].startswith(x) for x in pii.GIVEN["m"]) and any(m[8].startswith(x) for x in pii.GIVEN_CYRILLIC["f"])
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(m[4]) == digits(m[5]) and m[6] == digits(m[7])
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(m[6])))
    assert total % 10 == 0


def test_collisions_are_resolved(spark, monkeypatch):
    """With few surrogates to choose from, first attempts collide; the last ones are distinct and none is real."""
    monkeypatch.setattr(pii, "SYLLABLES", ["ba"] * 15 + ["de"])
    monkeypatch.setattr(pii, "GIVEN", {k: ["Al"] * 8 for k in "fmu"})
    rows = [(i, f"Mr. Name{chr(97 + i)}") for i in range(12)]
    out = [r.text for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(out)) == 12 and not set(out) & {t for _, t in rows}


def test_odd(odd_documents, no_documents):
    out = pii.pseudonymized(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[1] is None and kept[2] == "" and "mail@ex.org" not in kept[10] and "1.2.3.4" not in kept[10]
    assert pii.pseudonymized(no_documents).count() == 0


def test_native(documents):
    plan = pii.pseudonymized(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymized(df).orderBy("doc_id").collect()]


def test_one_person_has_one_name(spark):
    """Whatever the title, and also where the name stands without one."""
    out = replaced(spark, "Dr. Anna Weber met Frau Anna Weber", "Mr. John Smith wrote. John Smith left; Smith too. Smithson stays.", "Prof. Anna Weber")
    m = re.fullmatch(r"Dr\. (\w+) (\w+) met Frau (\w+) (\w+)", out[0])
    assert m[1] == m[3] and m[2] == m[4] and any(m[1].startswith(x) for x in pii.GIVEN["f"])
    assert out[2] == f"Prof. {m[1]} {m[2]}"
    m = re.fullmatch(r"Mr\. (\w+) (\w+) wrote\. (\w+) (\w+) left; (\w+) too\. Smithson stays\.", out[1])
    assert m[1] == m[3] and m[2] == m[4] == m[5] and not {"John", "Smith"} & set(m.groups())


def test_ibans_stay_valid(spark):
    (out,) = replaced(spark, "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 now")
    for iban, shape in zip(re.findall(r"[A-Z]{2}\d{2}[A-Z0-9 ]+\d", out), (r"DE\d\d( \d{4}){4} \d\d", r"GB\d\d[A-Z]{4}\d{14}"), strict=True):
        assert re.fullmatch(shape, iban)
        signs = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1


def test_clashing_columns(spark):
    names = ["_pii_matches", "_pii0_matches", "_pii0_known", "m", "p", "kind", "canon", "a.b"]
    df = spark.createDataFrame([(1, "me@ex.org", *range(len(names)))], ["doc_id", "text", *names])
    out = pii.pseudonymized(df)
    row = out.first()
    assert out.columns == df.columns and "me@ex.org" not in row.text and list(row)[2:] == list(range(len(names)))


def test_plain_replacement(documents):
    """A brute-force version in Python: what the patterns find, and nothing else, changes, and equal values change alike."""
    any_of = regex.compile(pii.ANY)
    new = {}
    after = {r.doc_id: r.text for r in pii.pseudonymized(documents).collect()}
    for r in documents.collect():
        text, found = r.text or "", [m for m in any_of.finditer(r.text or "")]
        if not found:
            assert after[r.doc_id] == r.text
            continue
        kept = [regex.escape(p) for p in any_of.split(text)]
        m = regex.fullmatch("(.*?)".join(kept), after[r.doc_id], regex.DOTALL)
        assert m
        for old, now in zip(found, m.groups(), strict=True):
            assert old[0] != now and len(now) > 3 and new.setdefault(old[0], now) == now


def test_more_short_addresses_than_short_surrogates(spark):
    """An address of two letters has 256 surrogates of its own length; 300 are told apart all the same."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{x}@{y}.co" for x in letters for y in letters][:300]
    rows = spark.createDataFrame([(i, f"write to {n} now") for i, n in enumerate(names)], "doc_id long, text string")
    found = [re.fullmatch(r"write to (\S+@\S+\.co) now", r.text)[1] for r in pii.pseudonymized(rows, "k").collect()]
    assert len(set(found)) == 300 and not set(found) & set(names)


def test_common_words_stay(spark):
    """A word of a name that begins a sentence alone may be a common word; beside another or within a sentence it is the name."""
    out = replaced(spark, "Mr. Will Young said: Will you come? Young people do. Then Young left. Will Young came.", "Mr. Smith Monday is off. Monday came.")
    m = re.fullmatch(r"Mr\. (\w+) (\w+) said: Will you come\? Young people do\. Then (\w+) left\. (\w+) (\w+) came\.", out[0])
    assert m and m[1] == m[4] and m[2] == m[3] == m[5] and not {"Will", "Young"} & set(m.groups())
    assert re.fullmatch(r"Mr\. (?!Smith)\w+ Monday is off\. Monday came\.", out[1])


def test_compound_names(spark):
    out = replaced(spark, "Mrs. Mary Jones-Lee and Jones", "Mr. O'Brien met Mr. Brien", "Mr. Smith's car, Smith’s dog", "Prof. Lee")
    m = re.fullmatch(r"Mrs\. (\w+) (\w+)-(\w+) and (\w+)", out[0])
    assert m and m[2] == m[4] and m[2] != m[3] and not {"Mary", "Jones", "Lee"} & set(m.groups())
    assert out[3] == f"Prof. {m[3]}"
    m = re.fullmatch(r"Mr\. O'(\w+) met Mr\. (\w+)", out[1])
    assert m and m[1] == m[2] != "Brien"
    m = re.fullmatch(r"Mr\. (\w+)'s car, (\w+)’s dog", out[2])
    assert m and m[1] == m[2] != "Smith"


def test_versions_are_no_addresses(spark):
    out = replaced(spark, "version 1.2.3.4 and v1.2.3.4 at 10.20.30.40", "x" * 200_000 + " Mr. " + "A" + "a-b" * 30_000)
    assert re.fullmatch(r"version 1\.2\.3\.4 and v1\.2\.3\.4 at (?!10\.20\.30\.40)\d+\.\d+\.\d+\.\d+", out[0])
    assert len(out[1]) > 200_000
