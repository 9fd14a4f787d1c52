"""Cross-tokenizer alignment by lockstep merging (op13).

Tokens of two vocabularies over one text, A (byte-level) and B (sentence pieces), are spans of the same bytes.  Both rows of ends
are merged like sorted lists, but for a whole batch of documents at once: one NumPy state vector holds a pointer into A and one
into B for every lane; each step links the two tokens of every lane, advances the one that ends first (both where they end
together, which cuts a group there), and lanes that are done are compacted away.  A document is one lane or, if it is longer than
LANE bytes, one lane for each LANE bytes of it, so that no text keeps a batch waiting: a pair of tokens is linked in the lane in
which its overlap begins.

Encoding: a text parts into units at spaces after other than white space.  Neither vocabulary has a token across such a space
(checked for B when it is loaded; A's pattern has none), so tokens of a text are those of its units in a row.  New units of a
batch are encoded many at once, and a table of bounded size keeps them from one batch to the next (tests compare with whole
texts).

Corpus counts: a document's distinct id pairs are exploded and counted by Spark, which combines them before the shuffle.  The
table of counts has a row for each pair of ids that is ever linked; it is looked up in slices of at most SLICE rows, each
broadcast, whatever its size: few passes over the stored rows, no join by a hot pair.

Defined cases: a text that is null, empty, or that the tokens of A or of B do not give back byte for byte after a space (as with
U+2581, which B takes for a space) has no tokens: zeros and ''.  Repeated rows are documents of their own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import count, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import stored

#: Bytes of a lane; bytes of texts aligned at once; rows of counts that are broadcast at once.
LANE, BATCH_BYTES = 512, 3 << 20
SLICE = 2_000_000
#: Units of the table before it is begun anew; units encoded at once; the longest unit among these.
MOST_UNITS, GROUP, LONGEST_UNIT = 500_000, 2000, 200
#: A space after a sign that is neither white space nor the sign that B writes for a space.
_CUT = re.compile("(?<=[^\\s▁]) ")
_ASCII_SPACE = [chr(c) for c in range(128) if chr(c).isspace()]
_OTHER_SPACE = ["▁", *(chr(c) for c in range(128, 0x10000) if chr(c).isspace())]
#: How byte-level vocabularies part texts, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FULL = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, link_a array<int>, link_b array<int>"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def units(text: str) -> list[str]:
    """Parts of a text, each of which stands after a space; joined by spaces they are the text."""
    odd = text[0] == " " or any(c + " " in text for c in _ASCII_SPACE) or not (text.isascii() or not any(c in text for c in _OTHER_SPACE))
    return _CUT.split(text) if odd else text.split(" ")


def _byte_signs() -> dict[str, int]:
    """Bytes by the sign that stands for them in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _places(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, in a row."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(start - before, sizes)


class ByteLevel:
    """A byte-level vocabulary in a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        signs = _byte_signs()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {}
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(signs[c] for c in piece) if piece not in special else piece.encode()
            if piece not in special:
                ranks[self.bytes[i]] = i
        self.fast = self._fast(path, ranks)

    @staticmethod
    def _fast(path: str, ranks: dict[bytes, int]):
        """The same vocabulary for a faster library, if ids are in the order of merges; else None."""
        model = json.loads(Path(path).read_text())["model"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if not merged or any(model["vocab"][m] != 256 + i for i, m in enumerate(merged)):
            return None
        import tiktoken

        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text after a space."""
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_plain(self, text: str) -> list[int]:
        """The same for a text of short units."""
        return self.fast.encode_ordinary(" " + text) if self.fast else self.encode([text])[0]


class Pieces:
    """A sentencepiece model with byte fallback that puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if not all(re.fullmatch("▁*[^▁]*", n) for n in names):
            raise ValueError(f"{path} has pieces with a space inside: texts cannot be cut at spaces")
        self.bytes = [bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids if t else [self.space] for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]

    def encode_plain(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Side:
    """A vocabulary with the ids of the units of a table, in a row."""

    def __init__(self, vocabulary: ByteLevel | Pieces):
        self.vocabulary = vocabulary
        self.dtype = np.dtype("<u2" if len(vocabulary.bytes) <= 1 << 16 else "<u4")
        self.lengths = np.array([len(b) for b in vocabulary.bytes], np.int32)
        self.bytes, self.starts = np.frombuffer(b"".join(vocabulary.bytes), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.clear()

    def clear(self) -> None:
        self.ids, self.bounds = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def add(self, groups: list[list[str]], others: list[str]) -> list[bool]:
        """Ids of more units, those of groups first; whether they give each unit's bytes back."""
        parts, sizes, same = [], [], []
        for group in groups:
            ids = np.array(self.vocabulary.encode_plain(" ".join(group)), self.dtype)
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(u.encode()) + 1 for u in group])
            cuts = np.searchsorted(ends, wanted)
            if self._gives(ids, (" " + " ".join(group)).encode()) and (ends[cuts] == wanted).all():
                parts.append(ids)
                sizes.append(np.diff(cuts + 1, prepend=0))
                same += [True] * len(group)
            else:
                self._add_singly(group, parts, sizes, same)
        self._add_singly(others, parts, sizes, same)
        self.ids = np.concatenate([self.ids, *parts])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes)))
        return same

    def _add_singly(self, units: list[str], parts: list, sizes: list, same: list[bool]) -> None:
        found = self.vocabulary.encode(units)
        found = [np.array(ids, self.dtype) for ids in found]
        parts += found
        sizes.append(np.array([len(ids) for ids in found], np.int64))
        same += [self._gives(ids, (" " + u).encode()) for u, ids in zip(units, found, strict=True)]

    def _gives(self, ids: np.ndarray, raw: bytes) -> bool:
        return self.bytes[_places(self.starts[ids], self.lengths[ids])].tobytes() == raw

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of the table in a row, and how many of each."""
        start = self.bounds[places]
        sizes = self.bounds[places + 1] - start
        return self.ids[_places(start, sizes)].astype(np.int32), sizes


class Units:
    """Units by their place in a table of both sides' ids; the table is begun anew when it is large."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.places: dict[str, int] = {}
        self.same: list[bool] = []

    def of(self, parts: list[str]) -> np.ndarray:
        if len(self.places) > MOST_UNITS or len(self.a.ids) > 16 * MOST_UNITS:
            self.places, self.same = {}, []
            self.a.clear()
            self.b.clear()
        found = np.fromiter(map(self.places.get, parts, repeat(-1)), np.int64, len(parts))
        missed = np.flatnonzero(found < 0).tolist()
        if missed:
            self._add({parts[i] for i in missed})
            found[missed] = [self.places[parts[i]] for i in missed]
        return found

    def _add(self, new: set[str]) -> None:
        others = [u for u in new if not u or len(u) > LONGEST_UNIT or u[-1] == "▁" or u[-1].isspace()]
        plain = list(new.difference(others))
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        same = zip(*(side.add(groups, others) for side in (self.a, self.b)), strict=True)
        self.places.update(zip(plain + others, count(len(self.places)), strict=False))
        self.same += [x and y for x, y in same]


class Batch:
    """Some documents aligned: ids of both sides, links (places of both sides) and group ends, of all documents in a row."""

    def __init__(self, table: Units, texts: list[str | None]):
        parts = [units(t) if t else [] for t in texts]
        places = table.of([u for p in parts for u in p])
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        wrong = np.zeros(len(texts), bool)
        wrong[doc[~np.array(table.same, bool)[places]]] = True
        places, doc = places[~wrong[doc]], doc[~wrong[doc]]
        rows = []
        for side in (table.a, table.b):
            ids, sizes = side.take(places)
            rows += [ids, side.lengths[ids], np.bincount(doc, sizes, len(texts)).astype(np.int64)]
        self.a, self.a_len, self.n_a, self.b, self.b_len, self.n_b = rows
        self.a_doc = np.repeat(np.arange(len(texts)), self.n_a)
        self.link_a, self.link_b, self.a_last, self.b_last = self._merged()

    def _lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each lane."""
        size = np.bincount(self.a_doc, self.a_len, len(self.n_a)).astype(np.int64)
        start = np.cumsum(size) - size
        many = -(-size // LANE)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = np.repeat(start, many) + within * LANE
        return first, np.minimum(first + LANE, np.repeat(start + size, many))

    def _merged(self) -> tuple[np.ndarray, ...]:
        """Lockstep: one state vector (pa, pb, stop) of all lanes."""
        a_end, b_end = np.cumsum(self.a_len, dtype=np.int32), np.cumsum(self.b_len, dtype=np.int32)
        a_last, b_last = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
        first, stop = self._lanes()
        pa, pb = (np.searchsorted(x, first, side="right").astype(np.int32) for x in (a_end, b_end))
        # Overlaps that began before a lane are of the lane before.
        begins = np.maximum(a_end[pa] - self.a_len[pa], b_end[pb] - self.b_len[pb]) >= first
        links_a, links_b = [], []
        while len(pa):
            ea, eb = a_end[pa], b_end[pb]
            links_a.append(pa if begins is None else pa[begins])
            links_b.append(pb if begins is None else pb[begins])
            begins = None
            even = ea == eb
            a_last[pa[even]] = True
            b_last[pb[even]] = True
            live = np.minimum(ea, eb) < stop
            pa, pb = pa + (ea <= eb), pb + (eb <= ea)
            if not live.all():
                pa, pb, stop = pa[live], pb[live], stop[live]
        none = np.zeros(0, np.int32)
        return *(np.concatenate(x) if x else none for x in (links_a, links_b)), a_last, b_last

    def group_order(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of A and of B stands when groups follow each other, a group's tokens of A before those of B."""
        a_cut, b_cut = np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1
        a_group, b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        return np.arange(len(self.a)) + np.append(0, b_cut)[a_group], np.arange(len(self.b)) + np.append(a_cut, 0)[b_group]


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_bounds(counts), pa.int32()), pa.array(values, kind))


class Digests:
    """Rows of DIGESTS from batches."""

    def __init__(self, a: Side, b: Side):
        ids = [str(i).encode() for i in range(max(len(a.lengths), len(b.lengths)))]
        n_a, self.n_b = len(a.lengths), len(b.lengths)
        self.written = [x + sign for x, sign in [(i, s) for s in (b",", b"|") for i in ids[:n_a]] + [(i, s) for s in (b",", b";") for i in ids[: self.n_b]]]
        self.a_at, self.b_at = n_a, 2 * n_a

    def __call__(self, doc_ids: list[int | None], x: Batch) -> pa.RecordBatch:
        n = len(doc_ids)
        codes = np.zeros(len(x.a) + len(x.b), np.int32)
        a_place, b_place = x.group_order()
        codes[a_place] = x.a + self.a_at * x.a_last
        codes[b_place] = x.b + self.b_at + self.n_b * x.b_last
        bounds = _bounds(x.n_a + x.n_b)
        said = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            said.append(hashlib.sha256(b"".join(map(self.written.__getitem__, codes[i:j].tolist()))[:-1]).hexdigest() if j > i else "")
        space = self.a_at * self.n_b
        doc = x.a_doc[x.link_a]
        keys = np.sort(doc * np.int64(space) + x.a[x.link_a].astype(np.int64) * self.n_b + x.b[x.link_b])
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(keys)))
        per_doc = np.bincount(keys[new] // space, minlength=n)
        groups = np.bincount(x.a_doc[x.a_last], minlength=n)
        links = np.bincount(doc, minlength=n)
        columns = [pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, groups, links)), pa.array(said, pa.string())]
        columns += [_lists(keys[new] % space, per_doc, pa.int64()), _lists(times, per_doc, pa.int32())]
        return pa.record_batch(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def full_rows(doc_ids: list[int | None], x: Batch) -> pa.RecordBatch:
    """Rows of FULL: ids, ends of groups (tokens before them) and links (places of tokens), in the order of the text."""
    n = len(doc_ids)
    a_start, b_start = _bounds(x.n_a)[:-1], _bounds(x.n_b)[:-1]
    b_doc = np.repeat(np.arange(n), x.n_b)
    order = np.argsort(x.link_a.astype(np.int64) + x.link_b, kind="stable")
    la, lb = x.link_a[order], x.link_b[order]
    links = np.bincount(x.a_doc[la], minlength=n)
    cuts = []
    for last, doc, start in ((x.a_last, x.a_doc, a_start), (x.b_last, b_doc, b_start)):
        at = np.flatnonzero(last)
        cuts.append(_lists(at + 1 - start[doc[at]], np.bincount(doc[at], minlength=n), pa.int32()))
    ids = [_lists(x.a, x.n_a, pa.int32()), _lists(x.b, x.n_b, pa.int32())]
    places = [_lists(la - a_start[x.a_doc[la]], links, pa.int32()), _lists(lb - b_start[b_doc[lb]], links, pa.int32())]
    return pa.record_batch([pa.array(doc_ids, pa.int64()), *ids, *cuts, *places], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts", "link_a", "link_b"])


_loaded: dict[tuple[str, str], Units] = {}


def loaded(a_path: str, b_path: str) -> Units:
    """One table per Python worker, kept between its tasks."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Units(Side(ByteLevel(a_path)), Side(Pieces(b_path)))
    return _loaded[a_path, b_path]


def _aligned(docs: DataFrame, schema: str, emitter: Callable[[Side, Side], Callable], a_path: str | None, b_path: str | None) -> DataFrame:
    import public_tokenizers

    paths = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(*paths)
        emit = emitter(table.a, table.b)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            start = size = 0
            for end, text in enumerate(texts):
                size += len(text or "")
                if size >= BATCH_BYTES:
                    yield emit(ids[start : end + 1], Batch(table, texts[start : end + 1]))
                    start, size = end + 1, 0
            if start < len(texts):
                yield emit(ids[start:], Batch(table, texts[start:]))

    return docs.select("doc_id", "text").mapInArrow(align, schema)


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Ids, group ends and links of every document, as in FULL; a document without tokens has empty lists."""
    return _aligned(docs, FULL, lambda a, b: full_rows, a_path, b_path)


def pair_counts(digests: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (whether n is the highest of its A id); a pair is a * |B| + b, see Digests."""
    return digests.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _with_best(counts: DataFrame, n_b: int) -> DataFrame:
    first = F.floor(F.col("pair") / n_b)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("highest"))
    return counts.withColumn("a", first).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _looked_up(rows: DataFrame, table: pa.Table) -> DataFrame:
    """rows with the counts of a slice of pairs added to n_best and count_sum."""
    order = np.argsort(table["pair"].to_numpy())
    told = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = told.value
        for batch in batches:
            pairs = batch.column("pairs")
            values, times = pairs.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            here = known[at] == values
            bounds = _bounds(np.asarray(pairs.value_lengths().fill_null(0)))
            out = {}
            for name, amounts in (("n_best", best[at]), ("count_sum", n[at])):
                sums = _bounds(np.where(here, times * amounts.astype(np.int64), 0))
                out[name] = pa.array(np.asarray(batch.column(name)) + sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())
            yield pa.record_batch([out.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(add, rows.schema)


def alignment_digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, slice_rows: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    rows = stored(_aligned(docs, DIGESTS, Digests, a_path, b_path), "alignment-digests")
    n_b = _vocabulary_size(b_path)
    table = stored(_with_best(pair_counts(rows), n_b), "alignment-pairs")
    slices = max(1, -(-table.count() // slice_rows))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("n_best", zero).withColumn("count_sum", zero)
    for k in range(slices):
        some = table if slices == 1 else table.where(F.pmod("pair", F.lit(slices)) == k)
        found = some.toArrow()
        if found.num_rows:
            rows = _looked_up(rows, found)
        if k + 1 < slices:
            rows = stored(rows, "alignment-sums")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _vocabulary_size(b_path: str | None) -> int:
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model")).vocab_size()
