import hashlib
from collections import Counter

import public_tokenizers
import pytest

from kelpline.llm import alignment as A

TEXTS = [
    None, "", "one", "One two  three", " lead and trail ", "line\nbreak \n x\t y\r\nz", "a▁b", "▁", "<|endoftext|> <s> </s> <0x41>", "café 可灵 \U0001f600 é ﬁ ½ 　\xa0x", "\x00 \x1f\x1e y",
    "one", "one", "don't we'll I'm 12345 x=1;y=2;", "   ", "tail  ", "-" * 3000, "漢字" * 1500, "wordwithoutanyspace" * 300, "many words " * 2000, "﻿x ​ y",
]


@pytest.fixture(scope="module")
def plain():
    """The contract in plain Python over whole texts: rows by text, and the corpus counts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = {i: n for n, i in t.get_vocab().items()}
    signs = A._byte_signs()

    def spans(tokens):
        out, at = [], 0
        for x in tokens:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    def rows(texts):
        found, counts = [], Counter()
        for text in texts:
            ids_a = t.encode(" " + text, add_special_tokens=False).ids if text else []
            ids_b = s.encode(text) if text else []
            raw_a = [bytes(signs[c] for c in names[i]) for i in ids_a]
            raw_b = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [s.id_to_piece(i)]]
            if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
                found.append(None)
                continue
            sa, sb = spans(raw_a), spans(raw_b)
            cuts = sorted({e for _, e in sa} & {e for _, e in sb})
            groups, i, j = [], 0, 0
            for c in cuts:
                g = ([], [])
                while i < len(sa) and sa[i][1] <= c:
                    g[0].append(ids_a[i])
                    i += 1
                while j < len(sb) and sb[j][1] <= c:
                    g[1].append(ids_b[j])
                    j += 1
                groups.append("|".join(",".join(map(str, x)) for x in g))
            links, j0 = [], 0
            for i, (x, y) in enumerate(sa):
                while j0 < len(sb) and sb[j0][1] <= x:
                    j0 += 1
                j = j0
                while j < len(sb) and sb[j][0] < y:
                    links.append((ids_a[i], ids_b[j]))
                    j += 1
            counts.update(set(links))
            found.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        best = Counter()
        for (a, _), n in counts.items():
            best[a] = max(best[a], n)
        zero = (0, 0, 0, 0, 0, 0, "")
        return [zero if f is None else (*f[:3], len(f[3]), sum(counts[x] == best[x[0]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for f in found]

    return rows


def digests(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, n_best long").repartition(3)
    return [tuple(r)[1:] for r in sorted(A.alignment_digests(df, **more).collect())]


def test_equals_plain_python(spark, plain):
    want = plain(TEXTS)
    assert sum(r[0] == 0 for r in want) < 6
    assert digests(spark, TEXTS) == want


def test_equals_plain_python_on_documents_and_in_slices(spark, plain, documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(80).collect()]
    want = plain(texts)
    assert digests(spark, texts) == want
    assert digests(spark, texts, slice_rows=3000) == want


def test_lanes_of_any_length_give_the_same(monkeypatch):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    table = A.loaded(*paths)
    texts = [t for t in TEXTS if t]
    emit = A.Digests(table.a, table.b)
    want = emit(list(range(len(texts))), A.Batch(table, texts))
    for lane in (1, 3, 17, 1 << 20):
        monkeypatch.setattr(A, "LANE", lane)
        assert emit(list(range(len(texts))), A.Batch(table, texts)) == want
    monkeypatch.setattr(A, "MOST_UNITS", 2)
    assert emit(list(range(len(texts))), A.Batch(table, texts)) == want and len(table.places) < 200


def test_full_rows_rebuild_texts_and_groups(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    table = A.loaded(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    a, b = table.a, table.b
    for r in A.alignments(df).collect():
        text = TEXTS[r.doc_id]
        if not r.a_ids:
            assert not (r.b_ids or r.a_cuts or r.link_a)
            continue
        whole = (" " + text).encode()
        assert b"".join(a.vocabulary.bytes[i] for i in r.a_ids) == whole == b"".join(b.vocabulary.bytes[i] for i in r.b_ids)
        start = [0, 0]
        for cut in zip(r.a_cuts, r.b_cuts, strict=True):
            one, two = (b"".join(side.vocabulary.bytes[i] for i in ids[s:e]) for side, ids, s, e in zip((a, b), (r.a_ids, r.b_ids), start, cut, strict=True))
            assert one == two
            start = cut
        assert start == (len(r.a_ids), len(r.b_ids)) and len(r.link_a) == len(r.a_ids) + len(r.b_ids) - len(r.a_cuts)


def test_no_rows(spark, no_documents):
    assert A.alignment_digests(no_documents).collect() == []
