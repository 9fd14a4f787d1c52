"""Duplicates in a stream: an index of bit hashes as state, and pointers as a table that grows by batches.

A hash lies in most + 1 bands, and two hashes at most `most` bits apart agree in one of them (pigeonhole).  The stream is keyed
by band, so each key's state holds the rows of one band: a new row is set against them, its pairs come out (each in the first
band that both share), and it joins them.  What the pairs mean is decided once for a batch, by a fold over the batch's rows in
their order against the rows that still stand for others: the better of a row and its nearest neighbour survives.  A row that
loses is a tombstone, which comes back as a second source of the stream and takes the row out of the state of its bands.  Until it
has arrived the fold passes the row over, so when tombstones arrive changes no result.

    folder/rows/batch=N, folder/pointers/batch=N, folder/gone/batch=N

Everything a batch writes lies in folders with its number, and it reads only those of smaller numbers: a batch that is run again
after a failure writes the same again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kelpline.operators import folds
from kelpline.operators.vectors import bands

ROW = "id long, seq long, quality long, hash long"
EVENT = ROW + ", gone boolean"
FOUND = "id long, seq long, quality long, hash long, other long, distance int"
#: State needs a store that keeps entries one by one.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Places before that of any row of a batch: rows of earlier batches have no pairs among themselves that are not decided.
BEFORE = -(1 << 62)


class BandIndex(StatefulProcessor):
    """The rows of one band: state (id -> hash) and the pairs of each new row with them."""

    def __init__(self, most: int, bits: int):
        self.most, self.cuts = most, [bits * i // (most + 1) for i in range(most + 2)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "id long", "hash long")

    def _first_band(self, differ: int) -> int:
        return next(i for i in range(self.most + 1) if not (differ >> self.cuts[i]) & ((1 << (self.cuts[i + 1] - self.cuts[i])) - 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        band = int(key[0])
        events = pd.concat(rows).sort_values(["gone", "seq", "id"], ascending=[False, True, True])
        here = {int(k[0]): int(v[0]) for k, v in self.rows.iterator()} if self.rows.exists() else {}
        out = []
        for e in events.itertuples(index=False):
            new = int(e.id)
            if e.gone:
                if here.pop(new, None) is not None:
                    self.rows.removeKey((new,))
                continue
            if band == 0:
                out.append((new, int(e.seq), int(e.quality), int(e.hash), None, None))
            if new in here:  # came before; the batch drops it, too
                continue
            for other, hash_ in here.items():
                differ = (int(e.hash) ^ hash_) & ((1 << 64) - 1)
                if differ.bit_count() <= self.most and self._first_band(differ) == band:
                    out.append((new, None, None, None, other, differ.bit_count()))
            here[new] = int(e.hash)
            self.rows.updateValue((new,), (int(e.hash),))
        # As objects: beside nulls pandas would make numbers of 62 bits floats.
        frame = pd.DataFrame(out, columns=["id", "seq", "quality", "hash", "other", "distance"], dtype=object).astype("Int64")
        yield frame.astype({"distance": "Int32"})

    def close(self) -> None:
        pass


def candidates(events: DataFrame, most: int, bits: int) -> DataFrame:
    """Rows of FOUND from a stream of EVENT: every new row once, and its pairs with rows that came before it."""
    banded = events.select("*", F.explode(bands("hash", most, bits)).alias("part")).select("part.band", "part.key", "id", "seq", "quality", "hash", "gone")
    return banded.groupBy("band", "key").transformWithStateInPandas(BandIndex(most, bits), FOUND, "Append", "None")


def _known(spark: SparkSession, folder: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """What batches have written, of those numbered under `before`."""
    empty = spark.createDataFrame([], schema + ", batch long")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    rows = spark.read.schema(schema + ", batch long").parquet(f"{folder}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def decide(found: DataFrame, number: int, folder: str) -> None:
    """Fold one batch of FOUND into the tables of `folder`."""
    spark = found.sparkSession
    found = found.checkpoint()
    earlier, dead = _known(spark, folder, "rows", ROW, number), _known(spark, folder, "pointers", "id long, duplicate_of_id long", number).select("id")
    rows = found.where("other IS NULL").groupBy("id").agg(F.min_by(F.struct("seq", "quality", "hash"), "seq").alias("r")).select("id", "r.*")
    rows = rows.join(earlier.select("id"), "id", "left_anti").checkpoint()
    pairs = found.where("other IS NOT NULL").select(F.col("id").alias("b"), F.col("other").alias("a"), (-F.col("distance")).cast("long").alias("sim"))
    pairs = pairs.join(rows.select(F.col("id").alias("b")), "b", "left_semi").join(dead.select(F.col("id").alias("a")), "a", "left_anti").checkpoint()
    old = earlier.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("id", F.lit(BEFORE).alias("seq"), "quality", "hash").dropDuplicates(["id"])
    all_rows = rows.unionByName(old).checkpoint()
    points = folds.greedy_duplicates(all_rows, pairs).where("duplicate_of_id IS NOT NULL").checkpoint()
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    write(points, "pointers")
    write(all_rows.join(points.select("id"), "id", "left_semi").select("id", "seq", "quality", "hash"), "gone")
    write(rows, "rows")


def dedup_stream(rows: DataFrame, folder: str, checkpoint: str, most: int = 6, bits: int = 62) -> StreamingQuery:
    """Start the stream: rows (id, seq, quality, hash) in, tables of `folder` out; runs until what is there now is done.

    Rows come in the order of batches, in a batch by seq and id; a row that comes late is taken when it comes, and an id that came
    before is passed over.  Rows with a null id or hash have no duplicates and are left out.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/gone")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(gone)
    again = spark.readStream.schema(ROW + ", batch long").parquet(f"{folder}/gone").drop("batch")
    events = rows.where("id IS NOT NULL AND hash IS NOT NULL").select("id", "seq", "quality", "hash", F.lit(False).alias("gone")).unionByName(again.withColumn("gone", F.lit(True)))
    found = candidates(events, most, bits)
    return found.writeStream.foreachBatch(lambda df, number: decide(df, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pointers(spark: SparkSession, folder: str) -> DataFrame:
    """id and duplicate_of_id of all rows that have come."""
    rows = _known(spark, folder, "rows", ROW).select("id")
    return rows.join(_known(spark, folder, "pointers", "id long, duplicate_of_id long").select("id", "duplicate_of_id"), "id", "left")


def closed_window_sink(folder: str, frozen: DataFrame, month: Column):
    """A foreachBatch writer of (id, at, ...) rows to `folder`/open, or to `folder`/late where the row's month is frozen.

    frozen: month and frozen_batch, the number of the batch from which on the month's slice is closed.  It is read for each batch
    anew, so a table that another job writes is followed; a batch that is run again overwrites what it wrote.
    """

    def write(rows: DataFrame, number: int) -> None:
        closed = frozen.where(F.col("frozen_batch") <= number).select("month").distinct().withColumn("closed", F.lit(True))
        told = rows.withColumn("month", month).join(closed, "month", "left").checkpoint()
        for name, some in (("open", told.where("closed IS NULL")), ("late", told.where("closed"))):
            some.drop("closed").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return write
