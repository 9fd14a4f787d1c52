"""Near-duplicate passages by compact windows.

A text is its row of 5-word shingles.  For a hash function, the Cartesian tree over a text's hash values gives its
compact windows: (l, c, r) stands for all runs from i to j with l <= i <= c <= j < r, whose least hash is the one at c.
Runs of two texts that share most least hashes are similar.

1. Equal texts are one text; whether a passage repeats in copies of one text is known without windows.
2. Windows whose least hash another text has too are kept (keys go to blocks of keys, packed), then those in places, with
   room for a passage, that kept windows of NEED of the HASHES functions cover.
3. Windows of neighbouring functions (the last and the first are neighbours, too) whose intervals intersect in room for a
   passage make a signature of both least hashes; the intersection is where the passage lies.  Places of texts with the
   same signature are a group: an interval join over two functions.
4. Exact runs of 50 words in two texts are linked with the first text that has each, by a hash of the run.
5. Places of one signature inside equal runs are one class, and one of each class goes on.  In each group these are set
   against a leader: pairs of a text and a leader are chained to regions and the shingles of the regions are compared: runs
   of common shingles of enough words and a Jaccard similarity of 0.75 or more are repeats.
6. Groups that still hold places of several components of links, or in none, are compared inside of tasks, component with
   component until all that can be joined are; only confirmed repeats come out.  So a place that one repeat explains is
   still set against the similar places that this repeat does not join it with.  A group of more than BLOCK places is dealt
   to blocks, and every two of them are compared in a task of their own.  So no group is expanded into its pairs, and none
   is cut: rows shuffled grow with the places, and those of larger groups by one more copy for each BLOCK / 2 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.common import dropped, stored
from kelpline.llm.components import connected_components
from kelpline.llm.shingles import digest, hashed_texts, mix, normalized, shingle_hashes

SHINGLE = 5
#: A passage of similarity 0.75 shares the least hash of two neighbours among 8 functions with probability 0.988, one of
#: 0.8 with 0.996 (calculated; a test measures it).
HASHES, NEED = 8, 2
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
BROADCAST_ROWS = 200_000
#: Most places, and most of their shingles together, of a group that is compared in one task; larger ones are compared in tiles.
BLOCK, ROOM = 32768, 1 << 22
#: Places whose flags are looked at together.
FLAGS = 1 << 14
#: Blocks of keys for each shuffle partition.
KEY_BLOCKS = 4
SPAN = ("x", "x_from", "x_to", "y", "y_from", "y_to")
WINDOW = "text_key long, hash int, key long, l int, c int, r int"
PACKED = "block int, rows binary"
PLACE = "signature long, hash int, text_key long, l int, r int, c int, d int"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    m, w = values, 1
    while w * 2 <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(values) - width + 1], m[width - w : len(values) - w + 1])


def _nearest(values: np.ndarray, of: np.ndarray, step: int, passes: np.ufunc) -> np.ndarray:
    """For each value the nearest one in the direction of step, in the same row, that is not passed; -1 if there is none.

    A value that is passed hands on to where it leads itself.
    """
    n = len(values)
    to = np.arange(n) + step
    to[(to < 0) | (to >= n)] = -1
    some = np.arange(n)
    while len(some):
        next_ = to[some]
        inside = (next_ >= 0) & (of[next_] == of[some])
        to[some[~inside]] = -1
        some, next_ = some[inside], next_[inside]
        on = passes(values[next_], values[some])
        some = some[on]
        to[some] = to[next_[on]]
    return to


def compact_windows(values: np.ndarray, least: int, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c and r of the windows of a row of hash values that hold runs of at least `least` values, by c.

    cuts: where further texts begin in values; no window spans two texts.  The first of equal values counts as the least.
    The nodes of the Cartesian tree with room for a run are its least places; only these are linked with their parents.
    """
    n = len(values)
    text = np.zeros(n, np.int64)
    if cuts is not None:
        text[cuts] = 1
        text = np.cumsum(text)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    low = _least(values, least)
    whole = text[: len(low)] == text[least - 1 :]
    rows = np.lib.stride_tricks.sliding_window_view(values, least)
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(whole & new)
    edges = np.flatnonzero(new | ~whole)
    nexts = np.append(edges, len(low))[np.searchsorted(edges, starts, "right")]  # where the same least value ends
    found = []
    while len(starts):
        c = starts + rows[starts].argmin(axis=1)
        found.append(c)
        on = c + 1 < nexts  # an equal value takes over from the first
        starts, nexts = c[on] + 1, nexts[on]
    centres = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    at, value, of = np.append(centres, 0), values[centres], text[centres]
    # The nearest place before that has no greater value, and the next one with a smaller one, in the same text.
    before, after = _nearest(value, of, -1, np.greater), _nearest(value, of, 1, np.greater_equal)
    left = np.where(before < 0, first[of - text[0]], at[before] + 1)
    right = np.where(after < 0, np.append(first[1:], n)[of - text[0]], at[after])
    wide = right - left >= least
    return left[wide], centres[wide], right[wide]


def _covered(hashes: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For each place of a text, how many functions have a window over it."""
    n = int(r.max())
    covers = np.zeros(n, np.int64)
    for h in range(HASHES):
        on = hashes == h
        steps = np.bincount(l[on], minlength=n + 1) - np.bincount(r[on], minlength=n + 1)
        covers += np.cumsum(steps[:n]) > 0
    return covers


def _stretches_of(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Rows of `least` true flags or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def supported(hashes: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int, need: int, covers: np.ndarray | None = None) -> np.ndarray:
    """Which windows of one text have their least hash in a run of `least` places that all lie in windows of `need`
    hash functions: a passage shared by that many is such a run.  Takes one pass over windows and places (none over windows
    if their counts by place, covers, are known)."""
    covers = _covered(hashes, l, r) if covers is None else covers
    long = np.zeros(len(covers), bool)
    for a, b in _stretches_of(covers >= need, least):
        long[a:b] = True
    return long[c]


def signatures(hashes: np.ndarray, keys: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """signature, function, l, r, c and d of the intersections of windows of neighbouring functions of one text.

    Given are those whose least hashes one run of `least` places can hold; of wider intersections the places near them.
    """
    out = []
    of = [np.flatnonzero(hashes == h) for h in range(HASHES)]
    of = [i[np.argsort(c[i], kind="stable")] for i in of]
    for h in range(HASHES):
        a, b = of[h], of[(h + 1) % HASHES]
        low, high = np.searchsorted(c[b], c[a] - least, "right"), np.searchsorted(c[b], c[a] + least)
        n = high - low
        p = np.repeat(a, n)
        q = b[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        left, right = np.maximum(l[p], l[q]), np.minimum(r[p], r[q])
        # Both least hashes lie in any run that the two windows stand for.
        first, last = np.minimum(c[p], c[q]), np.maximum(c[p], c[q])
        on = (right - left >= least) & (first >= left) & (last < right)
        p, q, left, right, first, last = (x[on] for x in (p, q, left, right, first, last))
        sign = mix(keys[p].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys[q].view(np.uint64)).view(np.int64)
        out.append((sign, np.full(len(p), h, np.int32), np.maximum(left, first - 2 * least), np.minimum(right, last + 2 * least + 1), first, last))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(norm: bytes) -> int:
    return int.from_bytes(digest(norm)[:8], "little", signed=True)


def _texts(rows: DataFrame) -> DataFrame:
    """doc_id, digest, text_key (null without words) and n_words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normalized(t) for t in batch.column(2).to_pylist()]
            keys = pa.array([_keyed(x) if x else None for x in norms], pa.int64())
            words = pa.array([x.count(b" ") + 1 if x else 0 for x in norms], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, words], ["doc_id", "digest", "text_key", "n_words"])

    return rows.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest long, text_key long, n_words long")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast df if it has few rows, by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same_row(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of the rows that are equal in their first `keys` columns; rows come in order, one group is held."""
    held: list[np.ndarray] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in held[:keys]])) + 1
        start = 0
        for end in cuts.tolist():
            yield [c[start:end] for c in held]
            start = end
        held = [c[start:] for c in held]
    if held and len(held[0]):
        yield held


def _packed(parts: Iterator[tuple[np.ndarray, np.ndarray]], blocks: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Records (given with a key each) by block of keys: many at once in one binary value, so that Spark moves few rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def made() -> pa.RecordBatch:
        keys, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        block = (mix(keys.view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        block, rows = block[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(first[1:], len(block)).tolist()
        data = [rows[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(data, pa.binary())], ["block", "rows"])

    for key, rows in parts:
        if len(key):
            held.append((np.ascontiguousarray(key), rows))
            size += len(key)
        if size >= most:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def _blocks(batches: Iterator[pa.RecordBatch], record: np.dtype) -> Iterator[np.ndarray]:
    """Whole blocks of records that _packed made."""
    for _, data in _by_key(batches, 1):
        yield np.frombuffer(b"".join(data), record)


def _dealt(packed: DataFrame) -> DataFrame:
    return packed.repartition("block").sortWithinPartitions("block")


def _block_count(df: DataFrame) -> int:
    return KEY_BLOCKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _record(fields: str) -> np.dtype:
    return np.dtype([(f.split()[0], {"long": "<i8", "int": "<i4"}[f.split()[1]]) for f in fields.split(", ")])


def _rows(records: np.ndarray, fields: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(records[c])) for c in names], names)


def _windows(singles: DataFrame, least: int) -> DataFrame:
    """Windows whose least hash two texts have, packed by block of texts.  They are packed, too, for their way to the block
    of keys that all equal ones meet in."""
    blocks = _block_count(singles)
    window = _record(WINDOW)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                norms = [normalized(t) for t in batch.slice(at, 128).column(0).to_pylist()]
                some = [(_keyed(x), shingle_hashes(w, SHINGLE)) for x, w in zip(norms, hashed_texts(norms), strict=True) if len(w) >= least + SHINGLE - 1]
                if not some:
                    continue
                texts = np.array([k for k, _ in some])
                grams = np.concatenate([g for _, g in some])
                lengths = np.array([len(g) for _, g in some])
                starts = np.cumsum(lengths) - lengths
                # Several functions' values stand in a row, as further texts, so that few calls do all.
                at_once = max(1, min(HASHES, (1 << 19) // len(grams)))
                for h in range(0, HASHES, at_once):
                    values = mix((grams ^ _SEEDS[h : h + at_once, None]).ravel())
                    n = len(values) // len(grams)
                    begins = (starts + len(grams) * np.arange(n)[:, None]).ravel()
                    l, c, r = compact_windows(values, least, begins[1:])
                    of = np.searchsorted(begins, c, "right") - 1
                    row = np.zeros(len(c), window)
                    row["text_key"], row["hash"] = texts[of % len(texts)], h + of // len(texts)
                    row["l"], row["c"], row["r"] = l - begins[of], c - begins[of], r - begins[of]
                    row["key"] = values[c].view(np.int64)
                    yield row["key"], row

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for row in _blocks(batches, window):
            order = np.argsort(row["key"], kind="stable")
            key, text = row["key"][order], row["text_key"][order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff(np.append(first, len(key)))
            several = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
            kept = row[order[np.repeat(several, counts)]]
            yield kept["text_key"], kept

    packed = singles.select("text").mapInArrow(lambda batches: _packed(each(batches), blocks), PACKED)
    return _dealt(packed).mapInArrow(lambda batches: _packed(shared(batches), blocks), PACKED)


def _chunked(rows: Iterator[tuple], names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows of arrays, each of some size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def _packed_places(windows: DataFrame, least: int) -> DataFrame:
    """Per text and signature: where (l to r) and at which least hashes (c, d); and the parts of texts, covered by windows
    of all functions, that can hold an exact run (hash -1).  Places and parts are packed by block of texts."""
    window, place = _record(WINDOW), _record(PLACE)

    def made(columns: tuple) -> np.ndarray:
        out = np.zeros(len(columns[0]), place)
        for name, x in zip(place.names, columns, strict=True):
            out[name] = x
        return out

    def of_texts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[np.argsort(rows["text_key"], kind="stable")]
        # Texts stand in a row, so far from each other that nothing reaches from one into the next.
        text, hashes, keys = rows["text_key"], rows["hash"], rows["key"]
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        counts = np.diff(np.append(first, len(text)))
        room = np.maximum.reduceat(rows["r"], first).astype(np.int64) + 3 * least
        base = np.cumsum(room) - room
        begins = np.repeat(base, counts)
        names = text[first]
        l, c, r = (rows[x] + begins for x in ("l", "c", "r"))

        def back(x: np.ndarray, of: np.ndarray) -> np.ndarray:
            return (x - base[of]).astype(np.int32)

        exact = places = np.zeros(0, place)
        covers = _covered(hashes, l, r)
        found = _stretches_of(covers == HASHES, least)
        if found:
            a, b = np.array(found, np.int64).T
            of = np.searchsorted(base, a, "right") - 1
            a, b = back(a, of), back(b, of)
            exact = made((np.zeros(len(a), np.int64), -1, names[of], a, b, a, b))
        on = supported(hashes, l, c, r, least, NEED, covers)
        if on.any():
            sign, h, left, right, p, q = signatures(hashes[on], keys[on], l[on], c[on], r[on], least)
            of = np.searchsorted(base, p, "right") - 1
            places = made((sign, h, names[of], *(back(x, of) for x in (left, right, p, q))))
        return exact, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in _by_key(batches, 1):
            both = of_texts(np.frombuffer(b"".join(data), window))
            columns = [pa.array(block[:1]), *(pa.array([x.tobytes()], pa.binary()) for x in both)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "exact", "rows"])

    return stored(_dealt(windows).mapInArrow(run, "block int, exact binary, rows binary"), "substring-places")


def _exact_parts(places: DataFrame) -> DataFrame:
    """text_key, l and r of the parts that can hold an exact run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _rows(np.frombuffer(data, _record(PLACE)), "text_key long, l int, r int")

    return places.select("exact").mapInArrow(run, "text_key long, l int, r int")


def _places(windows: DataFrame, least: int) -> DataFrame:
    """_packed_places of windows that come as rows, as rows."""
    window, place = _record(WINDOW), _record(PLACE)
    blocks = _block_count(windows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, window)
            for name in window.names:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            yield rows["text_key"], rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in (x for c in batch.columns for x in c.to_pylist()):
                yield _rows(np.frombuffer(data, place), PLACE)

    packed = windows.mapInArrow(lambda batches: _packed(each(batches), blocks), PACKED)
    return _packed_places(packed, least).select("exact", "rows").mapInArrow(run, PLACE)


def _cut(rows: DataFrame, classes: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (text_key, l, r) with their shingles; each text is read and split once."""
    wanted = spans.distinct().groupBy("text_key").agg(F.collect_list(F.struct("l", "r")).alias("spans"))
    wanted = stored(wanted.join(classes.select("text_key", "doc_id", "digest"), "text_key"), "substring-cuts")

    names, types = ["text_key", "l", "r", "grams"], (pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                keys, texts, spans = (c.to_pylist() for c in batch.slice(at, 128).columns)
                norms = [normalized(t) for t in texts]
                some = [(k, x, s) for k, x, s in zip(keys, norms, spans, strict=True) if _keyed(x) == k]
                out: list[tuple] = []
                size = 0
                for (key, _, places), words in zip(some, hashed_texts([x for _, x, _ in some]), strict=True):
                    grams = shingle_hashes(words, SHINGLE)
                    for x in places:
                        out.append((key, x["l"], x["r"], grams[x["l"] : x["r"]].tobytes()))
                        size += len(out[-1][3])
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    found = rows.alias("d").join(_small(wanted).alias("c"), _same_row("d", "c")).select("text_key", "text", "spans")
    return found.mapInArrow(run, "text_key long, l int, r int, grams binary").dropDuplicates(["text_key", "l", "r"])


def _exact(parts: DataFrame, least: int) -> DataFrame:
    """Every run of `least` shingles that two texts have, linked with its first place by text_key, and rows of such runs
    joined: x, x_from, x_to, y, y_from, y_to (words)."""

    blocks = _block_count(parts)
    place, link = _record("run long, x long, place int"), _record("x long, y long, shift int, place int")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for name, start, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                found = shingle_hashes(np.frombuffer(data, np.uint64), least).view(np.int64)
                out = np.zeros(len(found), place)
                out["run"], out["x"], out["place"] = found, name, start + np.arange(len(found), dtype=np.int32)
                yield out["run"], out

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in _blocks(batches, place):
            order = np.lexsort((rows["place"], rows["x"], rows["run"]))
            run, x, at = (rows[c][order] for c in place.names)
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            counts = np.diff(np.append(first, len(run)))
            final = np.repeat(first + counts - 1, counts)
            first = np.repeat(first, counts)
            on = np.flatnonzero((x[first] != x[final]) & (first != np.arange(len(run))))
            # The first text's further places are linked with another text.
            to = np.where(x[on] != x[first[on]], first[on], final[on])
            out = np.zeros(len(on), link)
            out["x"], out["y"], out["shift"], out["place"] = x[on], x[to], at[to] - at[on], at[on]
            yield out["x"], out

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, link):
            rows = rows[np.lexsort((rows["place"], rows["shift"], rows["y"], rows["x"]))]
            x, y, shift, at = (rows[c] for c in link.names)
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)])
            start = np.flatnonzero(new)
            low, high, by = at[start], at[np.append(start[1:], len(at)) - 1] + least + SHINGLE - 1, shift[start]
            columns = (x[start], low, high, y[start], low + by, high + by)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], list(SPAN))

    packed = parts.mapInArrow(lambda batches: _packed(runs(batches), blocks), PACKED)
    packed = _dealt(packed).mapInArrow(lambda batches: _packed(ends(batches), blocks), PACKED)
    return stored(_dealt(packed).mapInArrow(joined, SPANS), "substring-exact")


def _regions(pairs: DataFrame, least: int) -> DataFrame:
    """Regions (x from x_l to x_r, y from y_l to y_r) to compare, of windows with the same least hash, chained."""
    schema = "x long, y long, x_l int, x_r int, y_l int, y_r int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for pair in _by_key(batches, 2):
            x, y = int(pair[0][0]), int(pair[1][0])
            order = np.lexsort((pair[6], pair[3]))
            region: list[int] = []
            for l, c, r, yl, yc, yr in zip(*(p[order].tolist() for p in pair[2:]), strict=True):
                if region and c - last[0] <= 2 * least and abs((c - yc) - (last[0] - last[1])) <= least:
                    region = [min(region[0], l), max(region[1], r), min(region[2], yl), max(region[3], yr)]
                else:
                    if region:
                        out.append((x, y, *region))
                    region = [l, r, yl, yr]
                last = (c, yc)
            out.append((x, y, *region))
            if len(out) > 20_000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        fields = [f.split() for f in schema.split(", ")]
        types = [pa.int64() if f[1] == "long" else pa.int32() for f in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f[0] for f in fields])

    columns = ("x", "y", "l", "c", "r", "yl", "yc", "yr")
    return pairs.select(*columns).distinct().repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(run, schema)


def _along(x: np.ndarray, y: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Stretches where x equals y on one diagonal."""
    a, b = max(0, -shift), min(len(x), len(y) - shift)
    same = np.concatenate([[False], x[a:b] == y[a + shift : b + shift], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(a + i, a + j, shift) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _follow(x: np.ndarray, y: np.ndarray, done: set[int]) -> list[tuple[int, int, int]]:
    """Stretches of x in y along the diagonals of shingles that y has once, then, as long as a place of x that y has is
    uncovered, along all diagonals of the first such place; diagonals in `done` were followed, new ones are added."""
    if not len(x) or not len(y):
        return []
    values, counts = np.unique(y, return_counts=True)
    by_value, starts = np.argsort(y, kind="stable"), np.cumsum(counts) - counts
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    bare = values[at] == x
    out: list[tuple[int, int, int]] = []

    def follow(shifts: list[int]) -> None:
        for shift in shifts:
            if shift not in done:
                done.add(shift)
                new = _along(x, y, shift)
                out.extend(new)
                for i, j, _ in new:
                    bare[i:j] = False

    single = np.flatnonzero(bare & (counts[at] == 1))
    follow(np.unique(by_value[starts[at[single]]] - single).tolist())
    for i in np.flatnonzero(bare & (counts[at] > 1)).tolist():
        if bare[i]:
            follow((by_value[starts[at[i]] : starts[at[i]] + counts[at[i]]] - i).tolist())
    return out


def stretches(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, to, shift) of stretches of x that stand in y, shifted, in order of their starts.

    They cover each place of either that the other has, however short; one is left out if another holds it on both sides.
    """
    done: set[int] = set()
    out = _follow(x, y, done)
    seen = np.zeros(len(y), bool)
    for i, j, shift in out:
        seen[i + shift : j + shift] = True
    if (~seen & np.isin(y, x)).any():
        back = {-shift for shift in done}
        out += [(i + shift, j + shift, -shift) for i, j, shift in _follow(y, x, back)]
    held = np.zeros((4, len(out)), np.int64)
    kept: list[tuple[int, int, int]] = []
    for i, j, shift in sorted(out, key=lambda s: (s[0] - s[1], s[0], s[2])):
        a, b, c, d = held[:, : len(kept)]
        if not ((a <= i) & (b >= j) & (c <= i + shift) & (d >= j + shift)).any():
            held[:, len(kept)] = i, j, i + shift, j + shift
            kept.append((i, j, shift))
    return sorted(kept)


def _single_stretches(place: np.ndarray) -> list[tuple[int, int, int]]:
    """stretches of x and y, neither of which repeats a shingle, from the places of x's shingles in y."""
    on = np.flatnonzero(place >= 0)
    if not len(on):
        return []
    shift = place[on] - on
    new = np.flatnonzero(np.concatenate([[True], (on[1:] != on[:-1] + 1) | (shift[1:] != shift[:-1])]))
    last = np.append(new[1:], len(on)) - 1
    return list(zip(on[new].tolist(), (on[last] + 1).tolist(), shift[new].tolist(), strict=True))


def _chains(parts: list[tuple[int, int, int]], least: int) -> list[list[tuple[int, int, int]]]:
    """Stretches dealt into rows that go on in both texts, each to the row with the nearest diagonal."""
    chains: list[list[tuple[int, int, int]]] = []
    going: list[int] = []
    common: list[int] = []
    for i, j, shift in parts:
        best, far = -1, 0
        still = []
        for k in going:
            a, b, last = chains[k][-1]
            room = max(2 * least, (common[k] + j - i) // 2)
            if i - b <= max(2 * least, common[k] + j - i):
                still.append(k)
                step = abs(shift - last)
                if j > b and j + shift > b + last and i + shift >= a + last and i - b <= room and step <= room and (best < 0 or step < far):
                    best, far = k, step
        going = still
        if best < 0:
            best = len(chains)
            chains.append([])
            common.append(0)
            going.append(best)
        chains[best].append((i, j, shift))
        common[best] += j - i
    return chains


def may_repeat(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> bool:
    """Whether x has a run of `least` shingles or more of which y has the share that the similarity asks for."""
    place = np.minimum(np.searchsorted(y, x, sorter=(order := np.argsort(y, kind="stable"))), len(y) - 1)
    common = y[order[place]] == x
    if common.sum() < similarity * least:
        return False
    _, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    # Shingles that x repeats may count once.
    weights = np.where(common, 1.0, np.where(counts[at] > 1, 0.0, -similarity / (1 - similarity)))
    sums = np.concatenate([[0], np.cumsum(weights)])
    width = min(least, len(x))
    return bool((sums[width:] - np.minimum.accumulate(sums)[: len(sums) - width] > -1e-6).any())


def densest(common: np.ndarray, least: int) -> np.ndarray:
    """For each row of flags the largest share of true ones in a run of `least` places or more; 0 without room for one.

    Runs of 2 * least - 1 are enough: one of two parts of a longer run has its share at least.
    """
    most, n = np.zeros(len(common)), common.shape[1]
    if n < least:
        return most
    sums = np.zeros((len(common), n + least), np.float32)  # of places past the end there are none
    np.cumsum(common, axis=1, out=sums[:, 1 : n + 1])
    sums[:, n + 1 :] = sums[:, n : n + 1]
    runs = np.lib.stride_tricks.sliding_window_view(sums[:, least:], least, axis=1)
    parts = (1 / np.arange(least, 2 * least)).astype(np.float32)
    step = max(1, FLAGS // len(common))
    for i in range(0, n - least + 1, step):
        some = runs[:, i : i + step]
        most = np.maximum(most, ((some - sums[:, i : i + some.shape[1], None]) * parts).max(axis=(1, 2)))
    return most


def may_join(here: np.ndarray, there: np.ndarray, similarity: float) -> np.ndarray:
    """Whether runs that share `here` of one side's shingles and `there` of the other's at most can be similar enough.

    Runs of n and m shingles with c in common have similarity c / (n + m - c), so n / c + m / c is 1 + 1 / similarity at most.
    """
    return 1 / np.maximum(here, 1e-9) + 1 / np.maximum(there, 1e-9) <= 1 + 1 / similarity + 1e-4


def shares(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> bool:
    """may_join of two rows of shingles; a row that repeats one may share all."""
    sides = []
    xs, ys = np.sort(x), np.sort(y)
    for one, ordered, others in ((x, xs, ys), (y, ys, xs)):
        if (ordered[1:] == ordered[:-1]).any():
            sides.append(np.ones(1))
        else:
            found = others[np.minimum(np.searchsorted(others, one), len(others) - 1)] == one
            sides.append(densest(found[None, :], least))
    return bool(may_join(*sides, similarity)[0])


def _places_in(x: np.ndarray, ordered: np.ndarray, others: np.ndarray) -> np.ndarray | None:
    """Running count of the places of x whose shingle is among others; None if x repeats a shingle (it may count once)."""
    if (ordered[1:] == ordered[:-1]).any():
        return None
    at = np.minimum(np.searchsorted(others, x), len(others) - 1)
    return np.concatenate([[0], np.cumsum(others[at] == x)])


def common_runs(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(x from, x to, y from, y to, Jaccard) of the widest runs of stretches that are similar enough."""
    runs: list[list] = []  # x from, x to, y from, y to, stretches
    order = np.argsort(y, kind="stable")
    xs, ys = np.sort(x), y[order]
    place = None  # of each shingle of x in y (-1 if not there), where neither side repeats one
    if len(y) and not (xs[1:] == xs[:-1]).any() and not (ys[1:] == ys[:-1]).any():
        at = np.minimum(np.searchsorted(ys, x), len(ys) - 1)
        place = np.where(ys[at] == x, order[at], -1)
    for chain in _chains(stretches(x, y) if place is None else _single_stretches(place), least):
        i, j, shift = np.array(chain).T
        # What a stretch adds to those before it; the first of a run adds all of itself.
        over = np.maximum(0, np.maximum(j[:-1] - i[1:], j[:-1] + shift[:-1] - i[1:] - shift[1:]))
        added = j - i - np.concatenate([[0], np.minimum(over, (j - i)[1:])])
        sums = np.cumsum(added)
        reached = -1
        for k in range(len(chain)):
            n = sums[k:] - sums[k] + j[k] - i[k]
            wide, high = j[k:] - i[k], (j + shift)[k:] - i[k] - shift[k]
            last = k + int(np.flatnonzero(n >= similarity * (wide + high - n))[-1])
            if last > reached:
                reached = last
                runs.append([int(i[k]), int(j[last]), int(i[k] + shift[k]), int(j[last] + shift[last]), chain[k : last + 1]])
    out = []
    if not runs:
        return out
    in_y, in_x = _places_in(x, xs, ys), _places_in(y, ys, xs)
    for a, b, c, d, parts in runs:
        # A passage may begin or end with an edit: what is a little short is taken with the places around it.
        short = max(0, least - min(b - a, d - c))
        left = min(short, a, c)
        right = min(short - left, len(x) - b, len(y) - d)
        left = min(short - right, a, c)
        a, b, c, d = a - left, b + right, c - left, d + right
        if min(b - a, d - c) < least:
            continue
        # No more places are common than those of one side that the other has anywhere.
        few = any(n is not None and n[j] - n[i] < similarity * (j - i) - 1e-9 for n, i, j in ((in_y, a, b), (in_x, c, d)))
        if few and max(j - i for i, j, _ in parts) < least:
            continue
        if place is None:
            p, q = np.unique(x[a:b]), np.unique(y[c:d])
            both, every = len(np.intersect1d(p, q, assume_unique=True)), len(p) + len(q)
        else:
            both, every = int(((place[a:b] >= c) & (place[a:b] < d)).sum()), b - a + d - c
        jaccard = both / (every - both)
        if jaccard >= similarity:
            out.append((a, b, c, d, jaccard))
        else:
            out += [(i, j, i + shift, j + shift, 1.0) for i, j, shift in parts if j - i >= least]
    return out


def _repeats(regions: DataFrame, parts: DataFrame, least: int, similarity: float) -> DataFrame:
    """Confirmed repeats of regions: x, x_from, x_to, y, y_from, y_to (words).  A part that very many are compared with is
    copied, so that they are dealt over many tasks."""
    copies = regions.groupBy("y", "y_l", "y_r").agg(F.ceil(F.count("*") / 64).cast("int").alias("copies"))
    one, two = (parts.select(*[F.col(c).alias(n) for c, n in zip(parts.columns, (t, f"{t}_l", f"{t}_r", f"{t}_grams"), strict=True)]) for t in "xy")
    two = two.join(copies, ["y", "y_l", "y_r"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mine = F.pmod(F.xxhash64("x", "x_l"), F.col("copies")).cast("int")
    some = regions.join(copies, ["y", "y_l", "y_r"]).withColumn("copy", mine).drop("copies").join(one, ["x", "x_l", "x_r"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, l, y, m, p, q in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                one, two = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                some = may_repeat(one, two, least, similarity) and shares(one, two, least, similarity)
                for a, b, c, d, _ in common_runs(one, two, least, similarity) if some else ():
                    out.append((x, l + a, l + b + SHINGLE - 1, y, m + c, m + d + SHINGLE - 1))
            if out:
                yield _spans(out)

    both = some.join(two.drop("copies"), ["y", "y_l", "y_r", "copy"])
    return both.select("x", "x_l", "y", "y_l", "x_grams", "y_grams").mapInArrow(compare, SPANS)


SPANS = "x long, x_from int, x_to int, y long, y_from int, y_to int"


def _spans(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(SPAN))


def _tagged(places: DataFrame, spans: DataFrame) -> DataFrame:
    """places with tag and shift of the span (x, x_from, x_to, tag, shift) of their text that holds both of their least
    hashes, the one with the least tag of several; found is false, and both are 0, where none does."""
    names = [f.split()[0] for f in PLACE.split(", ")]
    schema = PLACE + ", tag long, shift int, found boolean"
    zero = F.lit(0)
    ends = spans.select(
        zero.cast("long").alias("signature"), zero.alias("hash"), F.col("x").alias("text_key"), zero.alias("l"), zero.alias("r"), F.col("x_from").cast("int").alias("c"),
        (F.col("x_to") - SHINGLE).cast("int").alias("d"), F.col("tag").cast("long").alias("tag"), F.col("shift").cast("int").alias("shift"), zero.alias("kind"),
    )
    rows = places.select(*names, zero.cast("long").alias("tag"), zero.alias("shift"), F.lit(1).alias("kind")).unionByName(ends.distinct())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text, kind, sign, h, l, r, c, d, tags, shifts in _by_key(batches, 1):
            n = len(kind) - int(kind.sum())  # the spans come before the places, both by their starts
            if n == len(kind):
                continue
            at, last = c[n:], d[n:]
            tag, shift, found = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32), np.zeros(len(at), bool)
            low, high = np.searchsorted(at, c[:n]), np.searchsorted(at, d[:n], "right")
            for k in np.lexsort((shifts[:n], tags[:n]))[::-1].tolist():
                inside = low[k] + np.flatnonzero(last[low[k] : high[k]] <= d[k])
                tag[inside], shift[inside], found[inside] = tags[k], shifts[k], True
            yield sign[n:], h[n:], text[n:], l[n:], r[n:], at, last, tag, shift, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chunked(each(batches), [f.split()[0] for f in schema.split(", ")])

    rows = rows.select("text_key", "kind", "signature", "hash", "l", "r", "c", "d", "tag", "shift")
    return rows.repartition("text_key").sortWithinPartitions("text_key", "kind", "c").mapInArrow(run, schema)


def _representatives(places: DataFrame, exact: DataFrame, texts: DataFrame) -> DataFrame:
    """One place of each signature and class of equal places, of the signatures that several texts have still, each with
    the leader of its signature (y, yl, yc, yr): the place of the text with the least hash.

    A place inside an exact run of an earlier text is of the class of its place there.  Places come packed by block of
    texts, meet the runs of these, and go on packed by block of signatures, one of a class from each task.
    """
    blocks = _block_count(places)
    place, span = _record(PLACE), _record("text_key long, tag long, c int, d int, shift int")
    named = _record("text_key long, order long")
    classed = _record("signature long, origin long, order long, text_key long, l int, r int, c int, d int, hash int")
    led = PLACE + ", y long, yl int, yc int, yr int"

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            x, x_from, x_to, y, y_from = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            out = np.zeros(len(x), span)
            out["text_key"], out["tag"], out["c"], out["d"], out["shift"] = x, y, x_from, x_to - SHINGLE, y_from - x_from
            yield out["text_key"], out

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            out = np.zeros(batch.num_rows, named)
            out["text_key"], out["order"] = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield out["text_key"], out

    def least_of(rows: np.ndarray) -> np.ndarray:
        """The first place of each class, in order of signatures and classes."""
        rows = rows[np.lexsort((rows["origin"], rows["signature"]))]
        new = np.concatenate([[True], (rows["signature"][1:] != rows["signature"][:-1]) | (rows["origin"][1:] != rows["origin"][:-1])])
        of = np.cumsum(new) - 1
        # Classes of one place are done.
        alone = (np.bincount(of) == 1)[of]
        more = rows[~alone]
        more = more[np.lexsort((*(more[c] for c in ("hash", "d", "c", "r", "l", "text_key", "order")), of[~alone]))]
        first = np.concatenate([[True], (more["signature"][1:] != more["signature"][:-1]) | (more["origin"][1:] != more["origin"][:-1])])[: len(more)]
        return np.concatenate([rows[alone], more[first]])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, kind, data in _by_key(batches, 1):
            runs = np.frombuffer(b"".join(data[kind == 0]), span)
            rows = np.frombuffer(b"".join(data[kind == 1]), place)
            if not len(rows):
                continue
            rows = rows[np.lexsort((rows["c"], rows["text_key"]))]
            runs = runs[np.lexsort((-runs["shift"], -runs["tag"], runs["text_key"]))]
            tag, at = rows["text_key"].copy(), rows["c"].astype(np.int64)
            found = np.zeros(len(rows), bool)
            begins, ends = (np.searchsorted(rows["text_key"], runs["text_key"], side) for side in ("left", "right"))
            for i, j, y, c, d, shift in zip(begins.tolist(), ends.tolist(), *(runs[f].tolist() for f in ("tag", "c", "d", "shift")), strict=True):
                low, high = np.searchsorted(rows["c"][i:j], (c, d + 1)) + i
                inside = low + np.flatnonzero(rows["d"][low:high] <= d)
                tag[inside], at[inside], found[inside] = y, rows["c"][inside] + shift, True
            out = np.zeros(len(rows), classed)
            for name in place.names:
                out[name] = rows[name]
            order = np.sort(np.frombuffer(b"".join(data[kind == 2]), named), order="text_key")
            out["order"] = order["order"][np.searchsorted(order["text_key"], rows["text_key"])]
            out["origin"] = mix(mix(tag.view(np.uint64)) ^ at.view(np.uint64)).view(np.int64)
            out = least_of(out)
            yield out["signature"], out

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, classed):
            rows = least_of(rows)
            rows = rows[np.lexsort((rows["c"], rows["r"], rows["l"], rows["text_key"], rows["order"], rows["signature"]))]
            sign, text = rows["signature"], rows["text_key"]
            first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
            counts = np.diff(np.append(first, len(sign)))
            on = np.repeat(np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first), counts)
            kept, leaders = rows[on], rows[np.repeat(first, counts)[on]]
            for i in range(0, len(kept), 100_000):
                some, lead = kept[i : i + 100_000], leaders[i : i + 100_000]
                columns = [some[c] for c in place.names] + [lead[c] for c in ("text_key", "l", "c", "r")]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [f.split()[0] for f in led.split(", ")])

    earlier = exact.where("y < x").select(*SPAN[:5]).mapInArrow(lambda batches: _packed(spans(batches), blocks), PACKED)
    hashed = texts.select("text_key", F.xxhash64("text_key")).mapInArrow(lambda batches: _packed(orders(batches), blocks), PACKED)
    both = earlier.select("block", F.lit(0).alias("kind"), "rows").union(places.select("block", F.lit(1), "rows")).union(hashed.select("block", F.lit(2), "rows"))
    return stored(_dealt(_dealt(both).mapInArrow(lambda batches: _packed(classes(batches), blocks), PACKED)).mapInArrow(shared, led), "substring-shared")


def _labelled(places: DataFrame, links: DataFrame) -> DataFrame:
    """places (signature, text_key, l, r, c, d) with the label of the component of links that both least hashes lie in
    (bare: in none, with a label of their own)."""
    spans, _, labels = _components(links.select("x", "x_from", "x_to").distinct(), links)
    merged = spans.groupBy("node", "x").agg(F.min("x_from").alias("x_from"), F.max("x_to").alias("x_to")).join(labels, "node")
    merged = merged.select("x", "x_from", "x_to", F.xxhash64("label").alias("tag"), F.lit(0).alias("shift"))
    label = F.when(F.col("found"), F.col("tag")).otherwise(F.xxhash64("text_key", "c", "d"))
    found = _tagged(places, merged).select("signature", "text_key", "l", "r", "c", "d", label.alias("label"), (~F.col("found")).alias("bare"))
    return stored(found, "substring-labelled")


def _merged(places: DataFrame) -> DataFrame:
    """Per group, text and component the places that overlap as one: group, text_key, l, r and label."""
    schema = "group long, text_key long, label long, l int, r int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for group, text, label, bare, l, r in _by_key(batches, 3):
                reach = np.maximum.accumulate(r)
                new = np.concatenate([[True], l[1:] >= reach[:-1]])
                at = np.flatnonzero(new)
                own = mix(text[at].view(np.uint64) ^ mix(l[at].astype(np.uint64) + np.uint64(1))).view(np.int64)
                yield group[at], text[at], np.where(bare[at].astype(bool), own, label[at]), l[at], np.maximum.reduceat(r, at)

        yield from _chunked(each(), ["group", "text_key", "label", "l", "r"])

    label = F.when(F.col("bare"), F.lit(0)).otherwise(F.col("label")).alias("label")  # bare places that overlap are one
    rows = places.select("group", "text_key", label, "bare", "l", "r").distinct()
    return rows.repartition("group", "text_key").sortWithinPartitions("group", "text_key", "label", "l").mapInArrow(run, schema)


def _grouped(places: DataFrame) -> DataFrame:
    """Labelled places with their group, of the signatures that several texts and components have; groups of the same texts
    are one group."""
    sizes = places.groupBy("signature").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("text_key").alias("p"), F.max("text_key").alias("q"))
    sizes = stored(sizes.where("a <> b AND p <> q").select("signature"), "substring-sizes")
    ready = places.join(_small(sizes), "signature").withColumnRenamed("signature", "group")
    h = F.xxhash64("text_key")
    texts = ready.select("group", "text_key").distinct().groupBy("group").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s"))
    texts = texts.select("group", F.xxhash64("n", "x", "s").alias("same"))
    return ready.join(texts, "group").select(F.col("same").alias("group"), "text_key", "l", "r", "label", "bare")


def _tiled(groups: DataFrame) -> DataFrame:
    """Groups of merged places, those with more than BLOCK places or ROOM shingles as tiles.

    The places of such a group are dealt to blocks of half that size, and a tile is what two blocks hold: any two places of
    the group meet in a tile, so none is left out, and no task holds more than a tile.  A place comes in as many tiles as
    there are blocks.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.col("r") - F.col("l")).alias("w"))
    blocks = F.greatest(F.ceil(2 * F.col("n") / BLOCK), F.ceil(2 * F.col("w") / ROOM)).cast("int").alias("blocks")
    large = stored(sizes.where((F.col("n") > BLOCK) | (F.col("w") > ROOM)).select("group", blocks), "substring-large")
    if large.isEmpty():
        return groups
    large = _small(large)
    block = F.pmod(F.xxhash64("text_key", "label", "l"), F.col("blocks")).cast("int")
    dealt = groups.join(large, "group").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("group")
    return groups.join(large, "group", "left_anti").unionByName(dealt.select(tile, *[c for c in groups.columns if c != "group"]))


def _group_repeats(groups: DataFrame, parts: DataFrame, least: int, similarity: float) -> DataFrame:
    """Confirmed repeats of places with others of their groups: as many as join all components of a group that can be
    joined.  Places of the group's largest component are not set against each other."""

    def compare(rows: list[tuple]) -> list[tuple]:
        out = []
        # Shingles that another text of the group has; a place without room for a repeat among them shares none.
        texts = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
        grams = [np.frombuffer(r[4], np.uint64) for r in rows]
        lengths = np.array([len(g) for g in grams])
        values, every = np.unique(np.concatenate(grams), return_inverse=True)
        of = np.repeat(texts, lengths)
        low, high = np.full(len(values), len(rows)), np.full(len(values), -1)
        np.minimum.at(low, every, of)
        np.maximum.at(high, every, of)
        common = (low < high)[every]
        counts = np.add.reduceat(common, np.cumsum(lengths) - lengths, dtype=np.int64)
        on = counts >= similarity * least
        every, lengths, texts = every[np.repeat(on, lengths)], lengths[on], texts[on]
        rows, grams = [r for r, k in zip(rows, on.tolist(), strict=True) if k], [g for g, k in zip(grams, on.tolist(), strict=True) if k]
        roots = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)[1]  # components that repeats join
        if len(set(texts.tolist())) < 2 or (roots == roots[0]).all():
            return out
        # Each row's shingles as numbers, in order and once each, and the rows that have each number.
        edges = np.concatenate([[0], np.cumsum(lengths)])
        pairs = np.unique(np.repeat(np.arange(len(rows)), lengths) * len(values) + every)
        of, once = pairs // len(values), pairs % len(values)
        begins = np.searchsorted(of, np.arange(len(rows) + 1))
        single = np.diff(begins) == lengths
        by_number = of[np.argsort(once, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(once, minlength=len(values)))])
        held, other = np.zeros(len(values), bool), np.zeros(len(values), bool)
        rest = np.flatnonzero(roots != np.bincount(roots).argmax())
        done = np.zeros(len(rows), bool)
        for k in rest.tolist():
            done[k] = True
            if (roots == roots[k]).all():
                break
            _, x, l, _, _ = rows[k]
            mine = once[begins[k] : begins[k + 1]]
            n = starts[mine + 1] - starts[mine]
            some = n > 1
            some_of, n = mine[some], n[some]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[some_of], n)
            both = np.bincount(by_number[at], minlength=len(rows))
            near = np.flatnonzero((both >= similarity * least) & (roots != roots[k]) & (texts != texts[k]) & ~done)
            near = near[np.argsort(-both[near], kind="stable")]
            held[mine] = True
            own = every[edges[k] : edges[k + 1]]
            # Some at a time: those whose component the ones before joined are not looked at.
            size = max(1, FLAGS // max(lengths[k], lengths[near].max(initial=1)))
            while len(near):
                some, near = near[:size], near[size:]
                theirs = np.zeros((len(some), int(lengths[some].max())), bool)
                flags = np.zeros((len(some), int(lengths[k])), bool)
                for i, j in enumerate(some.tolist()):
                    theirs[i, : lengths[j]] = held[every[edges[j] : edges[j + 1]]]
                    numbers = once[begins[j] : begins[j + 1]]
                    other[numbers] = True
                    flags[i] = other[own]
                    other[numbers] = False
                here = densest(flags, least) if single[k] else np.ones(len(some))
                there = np.where(single[some], densest(theirs, least), 1.0)
                for j in some[may_join(here, there, similarity)].tolist():
                    if roots[j] == roots[k] or not ((single[k] and single[j]) or may_repeat(grams[k], grams[j], least, similarity)):
                        continue
                    m = rows[j][2]
                    found = common_runs(grams[k], grams[j], least, similarity)
                    out += [(x, l + a, l + b + SHINGLE - 1, rows[j][1], m + c, m + d + SHINGLE - 1) for a, b, c, d, _ in found]
                    if found:
                        roots[roots == roots[j]] = roots[k]
                near = near[roots[near] != roots[k]]
            held[mine] = False
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += compare(held)
                    held = []
                held.append(row)
            if out:
                yield _spans(out)
        if held and (out := compare(held)):
            yield _spans(out)

    full = groups.join(parts, ["text_key", "l", "r"]).select("group", "text_key", "l", "label", "grams")
    return full.repartition("group").sortWithinPartitions("group", "text_key", "l", "label").mapInArrow(run, SPANS)


def _both_ways(found: DataFrame) -> DataFrame:
    flipped = found.select(*[F.col(c).alias(n) for c, n in zip(("y", "y_from", "y_to", "x", "x_from", "x_to"), SPAN, strict=True)])
    return found.select(*SPAN).union(flipped)


def _linked(documents: DataFrame, min_words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their text_key, distinct texts, and the confirmed repeats of different texts, from both sides."""
    least = min_words - SHINGLE + 1
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    named = stored(_texts(rows), "substring-texts")
    classes = named.where("text_key IS NOT NULL").groupBy("text_key").agg(
        F.min(F.struct("doc_id", "digest")).alias("first"), F.max("doc_id").alias("final"), F.count("*").alias("n"), F.max("n_words").alias("n_words")
    )
    classes = stored(classes.select("text_key", "first.doc_id", "first.digest", "final", "n", "n_words"), "substring-classes")
    # One row for each distinct text goes on.
    copies = named.join(classes.where("n > 1").select("text_key", F.col("doc_id").alias("first"), F.col("digest").alias("first_digest")), "text_key")
    copies = copies.where(~(F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("first_digest"))))
    copies = stored(copies.select("doc_id", "digest"), "substring-copies")
    singles = rows.alias("d").join(_small(copies).alias("c"), _same_row("d", "c"), "left_anti")
    windows = stored(_windows(singles, least), "substring-windows")
    places = _packed_places(windows, least)
    dropped(windows, copies)
    exact = _exact(_cut(rows, classes, _exact_parts(places)), least)
    shared = _representatives(places, exact, classes)
    dropped(places)
    pairs = shared.where("text_key <> y").withColumnRenamed("text_key", "x")
    regions = stored(_regions(pairs, least), "substring-regions")
    sides = regions.select(F.col("x").alias("text_key"), F.col("x_l").alias("l"), F.col("x_r").alias("r")).union(regions.select("y", "y_l", "y_r"))
    parts = stored(_cut(rows, classes, sides), "substring-parts")
    found = stored(_repeats(regions, parts, least, similarity), "substring-repeats")
    dropped(regions, parts)
    links = stored(_both_ways(exact.select(*SPAN).union(found)).distinct(), "substring-links")
    merged = stored(_merged(_grouped(_labelled(shared, links))), "substring-merged")
    groups = stored(_tiled(merged), "substring-groups")
    dropped(shared, merged)
    more = stored(_cut(rows, classes, groups.select("text_key", "l", "r")), "substring-parts")
    links = links.union(_both_ways(stored(_group_repeats(groups, more, least, similarity), "substring-repeats")))
    links = stored(links.distinct(), "substring-links")
    dropped(groups, more)
    return named, classes, links


def _components(spans: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """spans (x, x_from, x_to) with the node that they and all spans of their text that overlap are, the links between
    nodes (with a and b), and the component of each node (node, label)."""
    order = Window.partitionBy("x").orderBy("x_from", "x_to")
    before = F.max("x_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before >= F.col("x_from"), 0).otherwise(1))
    spans = spans.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    node = F.encode(F.concat_ws(":", F.col("x").cast("string"), F.col("stretch").cast("string")), "utf-8")
    spans = stored(spans.select("x", "x_from", "x_to", node.alias("node")), "substring-spans")
    ends = links.where("x < y").join(spans.withColumnRenamed("node", "a"), ["x", "x_from", "x_to"])
    other = spans.select(*[F.col(c).alias(n) for c, n in zip(spans.columns, ("y", "y_from", "y_to", "b"), strict=True)])
    ends = stored(ends.join(other, ["y", "y_from", "y_to"]), "substring-ends")
    labels = stored(spans.select("node", F.col("node").alias("label")).distinct(), "substring-labels")
    return spans, ends, connected_components(labels, ends.select("a", "b").distinct())


def _stretches(classes: DataFrame, links: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """links with class_id and class_links, and the merged stretches x, start_word, end_word with them.

    A text that several rows have is one stretch.  A class is a component of stretches over links; class_links counts
    its links, each once, and the further rows of its texts.
    """
    whole = classes.where((F.col("n") > 1) & (F.col("n_words") >= min_words))
    whole = whole.select(F.col("text_key").alias("x"), F.lit(0).alias("x_from"), F.col("n_words").cast("int").alias("x_to"))
    spans = links.select("x", "x_from", "x_to").union(whole).distinct()
    spans, ends, labels = _components(spans, links)
    merged = spans.groupBy("node", "x").agg(F.min("x_from").alias("start_word"), F.max("x_to").alias("end_word")).join(labels, "node")
    merged = stored(merged, "substring-stretches")
    n = ends.join(labels, F.col("a") == F.col("node")).groupBy("label").agg(F.count("*").alias("n"))
    more = merged.join(classes.where((F.col("n") > 1) & (F.col("n_words") >= min_words)).select(F.col("text_key").alias("x"), (F.col("n") - 1).alias("n")), "x")
    n = stored(n.union(more.select("label", "n")).groupBy("label").agg(F.sum("n").alias("class_links")), "substring-class-links")
    named = merged.join(n, "label").withColumn("class_id", F.decode("label", "utf-8"))
    named = stored(named.select("node", "x", "start_word", "end_word", "class_id", "class_links"), "substring-named")
    found = links.join(spans, ["x", "x_from", "x_to"]).join(named.select("node", "class_id", "class_links"), "node")
    return found.select(*SPAN, "class_id", "class_links"), named


def passage_links(documents: DataFrame, min_words: int = 50, similarity: float = 0.75) -> DataFrame:
    """The confirmed repeats themselves: doc_id, text_key, start_word, end_word, other_doc_id, other_text_key, other_start,
    other_end, class_id and class_links.

    Passages as in repeated_passages.  A passage that many texts have is linked with representatives, and all that are
    linked over some row of links have one class_id; class_links is the number of links in the class.  Each link is given
    from both sides.  Equal texts have one text_key; the rows that have it besides the first, by doc_id, are linked with
    it as a whole, from both sides.
    """
    named, classes, links = _linked(documents, min_words, similarity)
    found, merged = _stretches(classes, links, min_words)
    x, y = (classes.select(F.col("text_key").alias(t), F.col("doc_id").alias(n)) for t, n in (("x", "doc_id"), ("y", "other_doc_id")))
    names = ("doc_id", "text_key", "start_word", "end_word", "other_doc_id", "other_text_key", "other_start", "other_end", "class_id", "class_links")
    found = found.join(x, "x").join(y, "y").select("doc_id", "x", "x_from", "x_to", "other_doc_id", "y", "y_from", "y_to", "class_id", "class_links").toDF(*names)
    many = classes.where((F.col("n") > 1) & (F.col("n_words") >= min_words)).select("text_key", F.col("doc_id").alias("first"), "n_words")
    rank = F.row_number().over(Window.partitionBy("text_key").orderBy("doc_id", "digest"))
    copies = named.join(many.select("text_key"), "text_key", "left_semi").withColumn("rank", rank).where("rank > 1").select("doc_id", "text_key")
    copies = copies.join(many, "text_key").join(merged.select(F.col("x").alias("text_key"), "class_id", "class_links"), "text_key")
    end = F.col("n_words").cast("int")
    sides = [copies.select(a, "text_key", F.lit(0), end, b, "text_key", F.lit(0), end, "class_id", "class_links").toDF(*names) for a, b in (("doc_id", "first"), ("first", "doc_id"))]
    return found.union(sides[0]).union(sides[1])


def repeated_passages(documents: DataFrame, min_words: int = 50, similarity: float = 0.75) -> DataFrame:
    """Per document and maximal stretch of repeated passages: doc_id, start_word, end_word, n_words, other_doc_id, n_links,
    class_id and class_links (as in passage_links, which gives the links themselves).

    documents: doc_id and text; other columns are not looked at.  Words are those of near_dedup.  A passage repeats if
    another row has one with a Jaccard similarity of 5-word shingles of at least `similarity`, both of min_words words or
    more.  Overlapping repeats of a document are one stretch (end_word is exclusive); other_doc_id is the least doc_id it
    was confirmed with, n_links the number of confirmations.  Every run of min_words words that two texts have is covered.
    A place is set against the others of its signatures until all that can be joined are of one class, not once for each link;
    what an edited passage holds besides a confirmed repeat, at its ends, may be missed.  Each row of equal texts of min_words words is one stretch as a whole.  Null, empty and short texts give no rows; rows without doc_id give rows without doc_id.
    """
    named, classes, links = _linked(documents, min_words, similarity)
    found, merged = _stretches(classes, links, min_words)
    partner = classes.select(F.col("text_key").alias("y"), F.col("doc_id").alias("other"))
    spans = found.join(partner, "y").groupBy("x", "x_from", "x_to").agg(F.min("other").alias("other"), F.count("*").alias("n_links"))
    spans = spans.join(merged, "x").where("x_from >= start_word AND x_to <= end_word")
    spans = spans.groupBy("x", "start_word", "end_word", "class_id", "class_links").agg(F.min("other").alias("other_doc_id"), F.sum("n_links").alias("n_links"))
    spans = spans.join(classes.where("n = 1").select(F.col("text_key").alias("x"), "doc_id"), "x")
    spans = spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id", "n_links", "class_id", "class_links")
    many = classes.where((F.col("n") > 1) & (F.col("n_words") >= min_words))
    copies = named.join(many.select("text_key", F.col("doc_id").alias("first"), "final", "n"), "text_key")
    copies = copies.join(merged.select(F.col("x").alias("text_key"), "class_id", "class_links"), "text_key")
    other = F.when(F.col("doc_id") == F.col("first"), F.col("final")).otherwise(F.col("first"))
    whole = copies.select(
        "doc_id", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("end_word"), F.col("n_words").cast("int").alias("n_words"),
        other.alias("other_doc_id"), (F.col("n") - 1).alias("n_links"), "class_id", "class_links",
    )
    return whole.unionByName(spans)
