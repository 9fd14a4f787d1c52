"""Near-duplicate documents by SetSketch registers.

A register keeps the least of an exponentially distributed hash over a document's shingles, truncated to an
exponentially spaced scale: registers of a union are the greater of the two (mergeable), and two sets agree in a register
about as often as they share shingles (locality-sensitive).

1. Equal word sequences are one node.  Every later step is about distinct texts.
2. Nodes that agree in all registers of a band share a bucket.
3. In each bucket every node is set against the bucket's leader, the node whose buckets are the largest; each node keeps
   the STARS pairs whose similarity, estimated by likelihood from all registers and both set sizes, is highest.  These are
   confirmed on the full shingle sets, and confirmed pairs join components.
4. Buckets that still hold several components are compared within tasks: each pair of nodes of different components
   that is likely by its registers is looked at on the full sets, in the first bucket that both share, and only confirmed
   links come out.  Nodes come with their sets, once for each open bucket they are in.
5. A bucket of more than BLOCK open nodes is dealt by further registers before that: nodes that agree in eight of them
   meet in smaller buckets, again and again until a bucket is small.  So no bucket is expanded into all its pairs, and
   none is cut: the rows shuffled grow with the open nodes, never with the square of a bucket.

A pair of similarity 0.75 misses all buckets with probability (1 - 0.75**4)**40, under 3e-7; where all its buckets are dealt
again, with under 1e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.common import dropped, stored
from kelpline.llm.components import connected_components
from kelpline.llm.shingles import digest, hashed_texts, normalized, shingle_hashes

ROWS, BANDS = 4, 40
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Pairs estimated below this are not confirmed: 4.4 standard deviations under the threshold 0.75.
PLAUSIBLE = 0.6
#: Pairs with leaders that are confirmed for each node; what else its buckets hold is compared in them.
STARS = 3
#: Most nodes, and most shingles, of a bucket that is compared in one task.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 23
#: Larger buckets are dealt by so many rows of so many further registers, at most LEVELS times.
FURTHER, FURTHER_ROWS, LEVELS = 19, 8, 3
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(5)
_MULTIPLY = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def set_sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        least = np.minimum(least, (low[i : i + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarities for counts of registers in which the first set (of size n) is greater, less, equal.

    With u and v the sets' shares of n + m, registers are greater, less or equal with probabilities in proportion to
    u - vJ, v - uJ and J as the base goes to 1.  The likelihood's derivative is a square equation in J.
    """
    u = n / (n + m)
    v = 1 - u
    count = greater + less + equal
    linear = (equal + greater) * v**2 + (equal + less) * u**2
    root = np.sqrt(np.maximum(0.0, linear**2 - 4 * count * equal * (u * v) ** 2))
    return (linear - root) / (2 * count * u * v)


def _estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimates for rows of registers a against b."""
    greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    return estimate(greater, less, REGISTERS - greater - less, n.astype(float), m.astype(float))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")


def sketches(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), n_shingles, node (16-byte digest of the word sequence; null without words)
    and registers (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                norms = [normalized(t) for t in some.column(2).to_pylist()]
                sets = [np.unique(shingle_hashes(w, shingle)) for w in hashed_texts(norms)]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(x) if x else None for x in norms], pa.binary()),
                        pa.array([set_sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "digest", "n_shingles", "node", "registers"],
                )

    return _keyed(documents).mapInArrow(run, "doc_id long, digest long, n_shingles long, node binary, registers binary")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast df (narrow rows) if it has few, by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, band, n and node, for buckets of several nodes; buckets of the same nodes in several bands are one."""
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("registers"), i * F.lit(2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket")),
    )
    members = nodes.select("node", F.explode(bands).alias("b")).select("node", "b.band", "b.bucket")
    h = F.xxhash64("node")
    sets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s"), F.min("band").alias("band"))
    shared = sets.where("n > 1").groupBy("n", "x", "s").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", "n")
    shared = stored(shared, "near-buckets")
    return stored(members.join(_small(shared), "bucket").select("bucket", "band", "n", "node"), "near-members")


def _sets(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and hashes (its sorted shingle set) of the wanted nodes, each read from one row (doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                norms = [normalized(t) for t in some.column(1).to_pylist()]
                # Another text may have the same digest: only the node's own counts.
                same = [digest(x) == node for x, node in zip(norms, some.column(0).to_pylist(), strict=True)]
                sets = [np.unique(shingle_hashes(w, shingle)).tobytes() for w in hashed_texts(norms)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], ["node", "hashes"]).filter(pa.array(same))

    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.digest") == F.col("w.digest"))
    texts = _keyed(documents).alias("d").join(_small(wanted).alias("w"), same).select("node", "text")
    return texts.mapInArrow(run, "node binary, hashes binary").dropDuplicates(["node"])


def _star_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node its likeliest pairs with leaders of its buckets."""
    central = stored(members.groupBy("node").agg(F.sum("n").alias("central")), "near-central")
    led = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("b")).select("bucket", F.col("b.node").alias("b"))
    leaders = stored(led, "near-leaders")
    pairs = members.join(_small(leaders), "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("registers").alias("x"), F.col("n_shingles").alias("n"))
    right = nodes.select(F.col("node").alias("b"), F.col("registers").alias("y"), F.col("n_shingles").alias("m"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _estimated(_registers(batch.column(2)), _registers(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["a", "b", "score"])

    scored = both.mapInArrow(score, "a binary, b binary, score double").where(F.col("score") >= PLAUSIBLE)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))  # a node has BANDS leaders at most
    pairs = stored(scored.withColumn("rank", rank).where(F.col("rank") <= STARS).select("a", "b"), "near-pairs")
    dropped(central, leaders)
    return pairs


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return stored(two.select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary"), "near-confirmed")


def _dealt(members: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Members of larger buckets in buckets of those that agree in further registers, too."""
    seed = np.random.default_rng(100 + level)
    orders = [[int(i) for i in seed.permutation(REGISTERS)[: FURTHER_ROWS * FURTHER]] for _ in range(BANDS)]
    # Each band looks at the registers in another order.
    order = F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in orders]), F.col("band") + 1)

    def bucket(k: Column) -> Column:
        signs = [F.substring(F.col("registers"), F.element_at(order, k * FURTHER_ROWS + i + 1) * 2 + 1, F.lit(2)) for i in range(FURTHER_ROWS)]
        return F.xxhash64("bucket", k, *signs)

    some = F.transform(F.sequence(F.lit(0), F.lit(FURTHER - 1)), bucket)
    return members.join(nodes.select("node", "registers"), "node").select(F.explode(some).alias("bucket"), "band", "label", "node", "n_shingles", F.lit(True).alias("further"))


def _sized(members: DataFrame) -> DataFrame:
    """bucket, n and shingles of the buckets with several labels."""
    sizes = members.groupBy("bucket").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    return stored(sizes.where("p <> q").select("bucket", "n", "shingles"), "near-open")


def _open_blocks(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that hold several components, in buckets of bounded size; and per node the bands (as bits)
    whose buckets were dealt further."""
    tagged = members.join(labels, "node").join(nodes.select("node", "n_shingles"), "node")
    tagged = stored(tagged.select("bucket", "band", "label", "node", "n_shingles", F.lit(False).alias("further")), "near-tagged")
    ready, bits = None, None
    for level in range(LEVELS + 1):
        sizes = _sized(tagged)
        large = (F.col("n") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)
        large = large if level < LEVELS else F.lit(False)
        opened = tagged.join(_small(sizes.select("bucket", large.alias("large"))), "bucket")
        now = opened.where("NOT large").drop("large")
        ready = now if ready is None else ready.unionByName(now)
        if sizes.where(large).isEmpty():
            break
        more = opened.where("large").drop("large")
        if bits is None:
            bits = stored(more.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, CAST(band AS INT))")).alias("bits")), "near-bits")
        tagged = stored(_dealt(more, nodes, level).distinct(), "near-tagged")
    return ready, bits


class _Block:
    """The nodes of one bucket, with registers and sets."""

    def __init__(self, rows: list[tuple], percent: int):
        self.band, self.further = rows[0][1], rows[0][2]
        self.names, labels, self.bits, regs, sets = zip(*(r[3:] for r in rows), strict=True)
        self.table = np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS)
        code = {x: k for k, x in enumerate(dict.fromkeys(labels))}
        self.codes = np.array([code[x] for x in labels])
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent

    def _mine(self, k: int, at: np.ndarray) -> np.ndarray:
        """Which pairs are looked at here: where no bucket of both was dealt further, in the first that they share."""
        if self.further:
            return np.ones(len(at), bool)
        agree = (self.table[at].reshape(-1, BANDS, ROWS) == self.table[k].reshape(BANDS, ROWS)).all(axis=2)
        dealt = ((self.bits[k] >> np.arange(BANDS)) & 1).astype(bool)
        return (agree.argmax(axis=1) == self.band) | (agree & dealt).any(axis=1)

    def links(self) -> list[tuple[bytes, bytes]]:
        """Confirmed links that join the components of this bucket."""
        roots = np.arange(self.codes.max() + 1)
        out = []
        main = np.bincount(self.codes).argmax()
        rest = np.flatnonzero(self.codes != main)
        done = np.zeros(len(self.codes), bool)
        for k in rest.tolist():
            done[k] = True
            at = np.flatnonzero((roots[self.codes] != roots[self.codes[k]]) & ~done)
            n, m = self.sizes[k], self.sizes[at]
            at = at[100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)]
            at = at[(self.table[at] == self.table[k]).sum(axis=1) > 0.4 * REGISTERS]
            if not len(at):
                continue
            s = _estimated(np.broadcast_to(self.table[k], (len(at), REGISTERS)), self.table[at], np.full(len(at), n), self.sizes[at])
            at = at[s >= PLAUSIBLE]
            at = at[self._mine(k, at)] if len(at) else at
            if not len(at):
                continue
            mine, others = self.sets[k], np.concatenate([self.sets[j] for j in at.tolist()])
            place = np.minimum(np.searchsorted(mine, others), n - 1)
            both = np.bincount(np.repeat(np.arange(len(at)), self.sizes[at]), mine[place] == others, len(at))
            for j in at[100 * both >= self.percent * (n + self.sizes[at] - both)].tolist():
                p, q = roots[self.codes[k]], roots[self.codes[j]]
                if p != q:
                    roots[roots == p] = q
                    out.append((self.names[k], self.names[j]))
        return out


def _block_links(blocks: DataFrame, nodes: DataFrame, sets: DataFrame, bits: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) between components within buckets."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += _Block(held, percent).links()
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield made(out)
                out = []
        if held:
            out += _Block(held, percent).links()
        if out:
            yield made(out)

    full = blocks.join(nodes.select("node", "registers"), "node").join(sets, "node")
    full = full.join(bits, "node", "left") if bits is not None else full.withColumn("bits", F.lit(0).cast("long"))
    full = full.select("bucket", "band", "further", "node", "label", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"), "registers", "hashes")
    return stored(full.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a binary, b binary"), "near-links")


def _classes(documents: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of documents with their node, and nodes with the least doc_id of each (first), label and component_id."""
    rows = stored(sketches(documents, shingle), "near-sketches")
    words = rows.where("node IS NOT NULL")
    row = F.min(F.struct("doc_id", "digest")).alias("row")
    nodes = words.groupBy("node").agg(F.min("doc_id").alias("first"), row, F.any_value("registers").alias("registers"), F.any_value("n_shingles").alias("n_shingles"))
    nodes = stored(nodes.select("node", "first", "row.doc_id", "row.digest", "registers", "n_shingles"), "near-nodes")
    members = _buckets(nodes)
    labels = stored(members.select("node").distinct().withColumn("label", F.col("node")), "near-labels")
    wanted = stored(labels.join(nodes.select("node", "doc_id", "digest"), "node").select("node", "doc_id", "digest"), "near-wanted")
    sets = stored(_sets(documents, wanted, shingle), "near-sets")
    pairs = _star_pairs(members, nodes)
    labels = connected_components(labels, _confirmed(pairs, sets, percent))
    blocks, bits = _open_blocks(members, nodes, labels)
    labels = connected_components(labels, _block_links(blocks, nodes, sets, bits, percent))
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "near-named")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = stored(named.join(least, "label").select("node", "first", "label", "component_id"), "near-classes")
    dropped(members, wanted, sets, pairs, named)
    return rows, classes


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id and kept.

    documents: doc_id and text; other columns are not looked at.  Texts are lower-cased (A-Z) and split at white space;
    a text of fewer words than a shingle is one shingle.  Documents are linked if 100 * intersection >= percent * union.
    component_id is the least doc_id reachable over links, itself included; kept: doc_id = component_id.  Null, empty and
    blank texts have no shingles and no links.  Rows without doc_id take part in links but name no component (one of such
    rows alone has a null component_id and is kept).  Rows with one doc_id are one document each for its own text.
    """
    rows, classes = _classes(documents, shingle, percent)
    out = rows.select("doc_id", "n_shingles", "node").join(classes.select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(documents: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """Per distinct doc_id and text of documents: doc_id, digest (xxhash64 of the text) and stays.

    Of each group of near_duplicates one stays: of the rows of its least doc_id (none only if all are without) the one
    with the least text digest.  Texts without words are in no group and stay.
    """
    rows, classes = _classes(documents, shingle, percent)
    keyed = stored(rows.select("doc_id", "digest", "node").distinct(), "near-keys")
    first = F.min(F.struct(F.col("first").isNull().alias("bare"), "first", "node"))
    best = classes.groupBy("label").agg(first.alias("best"))
    best = stored(best.select(F.col("best.node").alias("node"), F.col("best.first").alias("doc_id")), "near-best")
    same = F.col("k.node").eqNullSafe(F.col("b.node")) & F.col("k.doc_id").eqNullSafe(F.col("b.doc_id"))
    kept = keyed.alias("k").join(best.alias("b"), same, "left_semi").groupBy("doc_id", "node").agg(F.min("digest").alias("kept"))
    out = keyed.alias("k").join(kept.alias("b"), same, "left")
    stays = F.col("k.node").isNull() | F.coalesce(F.col("k.digest") == F.col("b.kept"), F.lit(False))
    return out.select("k.doc_id", "k.digest", stays.alias("stays"))
