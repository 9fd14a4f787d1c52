import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import packing, token_files
from kelpline.llm.tokens import tokenizer, word_vocabulary


def whole(text, end=True):
    coder = tokenizer(word_vocabulary())
    return np.array(coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1] * end, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aA .,'\ńΣİ<|endoftext|>\x1c ")), max_size=60))
def test_joined_words_are_whole_texts(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    coder = tokenizer(word_vocabulary())
    assert np.frombuffer(coder.encode([text], 1)[0], coder.dtype).tolist() == whole(text).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=1200), st.integers(0, 20))
def test_frames_round_trip(ids, shift):
    ids = np.array(ids, np.uint64) >> np.uint64(shift)
    data = token_files.frame(3, 1, [None, 5], [len(ids), 0], ids.astype(np.uint32)) + b"\n"
    ((part, number, docs, lengths, back),) = token_files.frames(data)
    assert (part, number, docs.tolist(), lengths.tolist()) == (3, 1, [token_files.NULL_ID, 5], [len(ids), 0])
    assert back.tolist() == ids.tolist()


def test_token_files(documents):
    got = token_files.token_files(documents).orderBy("doc_id").collect()
    start = 0
    for row, doc in zip(got, documents.orderBy("doc_id").collect(), strict=True):
        ids = whole(doc.text)
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_odd(spark, odd_documents, no_documents, tmp_path):
    got = token_files.token_files(odd_documents)
    assert got.count() == odd_documents.count()
    assert {r.n_tokens for r in got.where("doc_id IN (1, 2, 3)").collect()} == {1}
    assert token_files.token_files(no_documents).count() == 0
    path = "file://" + str(tmp_path / "files")
    token_files.write_token_files(odd_documents, path)
    kept = token_files.read_token_files(spark, path, keep_ids=True)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in kept.collect())


def test_spans_of_token_files(spark, documents, tmp_path, monkeypatch):
    """Ranges of ids over blocks, frames and files equal those of the whole texts laid end to end."""
    monkeypatch.setattr(token_files, "FILE_FRAMES", 2)
    path = "file://" + str(tmp_path / "spans")
    token_files.write_token_files(documents, path, frame_ids=3000)
    every = np.concatenate([whole(r.text) for r in documents.orderBy("doc_id").collect()])
    for start, stop in ((0, 10), (2990, 9100), (12_345, 12_346), (len(every) - 700, len(every) + 50), (40, 40)):
        rows = sorted(token_files.read_span(spark, path, start, stop).collect())
        got = np.concatenate([r.ids for r in rows]) if rows else np.zeros(0)
        assert got.tolist() == every[start:stop].tolist()


@pytest.mark.parametrize("length", [64, 2048])
def test_pack_sequences(documents, odd_documents, no_documents, length):
    for table in (documents, odd_documents):
        pieces = packing.pack_sequences(table, length).toPandas()
        texts = {}
        for r in table.collect():
            texts.setdefault(r.doc_id, []).append(whole(r.text))
        by_doc = pieces.assign(doc_id=pieces.doc_id.astype("Int64")).groupby("doc_id", dropna=False).length.sum()
        for doc_id, ids in texts.items():
            if doc_id is not None:
                assert by_doc[doc_id] == sum(map(len, ids))
        for r in pieces.itertuples():
            if r.doc_id == r.doc_id and len(texts[int(r.doc_id)]) == 1:
                ids = texts[int(r.doc_id)][0]
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens
        ordered = pieces.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
        sizes = ordered.groupby("sequence_id").length.sum()
        assert (sizes == ordered.groupby("sequence_id").sequence_tokens.max()).all()
        assert all(n == length or n & (n - 1) == 0 for n in sizes)
    assert packing.pack_sequences(no_documents, length).count() == 0


def test_hilbert_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)) == {1}
