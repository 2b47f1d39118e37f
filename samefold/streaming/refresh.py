"""Snapshots kept up to date from a stream of changes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from samefold.plans import fingerprints
from samefold.schemas import FINGERPRINT
from samefold.storage import persisted


def latest(changes: DataFrame) -> DataFrame:
    """The last change (kind, ref, ts, ...) of each item; of several at one time, the one with the larger other columns."""
    w = Window.partitionBy("kind", "ref").orderBy(F.desc("ts"), *(F.desc(c) for c in sorted(changes.columns) if c not in ("kind", "ref", "ts")))
    return changes.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def watched(changes: DataFrame, previous: DataFrame, fields: list[str]) -> DataFrame:
    """Changes in which a watched field differs from the previous state (kind, ref, fields), and new
    items. Without watched fields every change counts."""
    if not fields:
        return changes
    old = previous.select("kind", "ref", F.xxhash64(*fields).alias("__old"))
    out = changes.join(old, ["kind", "ref"], "left")
    return out.where(F.col("__old").isNull() | (F.col("__old") != F.xxhash64(*(F.col(f) for f in fields)))).drop("__old")


class SnapshotStore:
    """Numbered snapshots of the fingerprints in a folder; a reader takes the last complete one.

    A snapshot is a table of `BUCKETS` folders by hash of (kind, ref). A new one is written beside the
    others and gets its number by renaming, which only one writer of a number can do; folders in which
    nothing changed are left where they are, and the new snapshot's list names them. The list
    also holds the last batch of each stream, so a batch is known when it is run again."""

    BUCKETS = 32

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(self.path))]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def _list(self, version: int) -> dict:
        fs = self._fs()
        stream = fs.open(self._path(f"{self.path}/v{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def done(self, stream: str) -> int:
        """The last batch of a stream that is in the newest snapshot, or -1."""
        have = self.versions()
        return self._list(have[-1])["batches"].get(stream, -1) if have else -1

    def read(self, version: int | None = None) -> DataFrame:
        """The newest snapshot, or an older one; empty without any."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], FINGERPRINT)
        folders = self._list(have[-1] if version is None else version)["folders"]
        if not folders:
            return self.spark.createDataFrame([], FINGERPRINT)
        return self.spark.read.schema(FINGERPRINT).parquet(*folders.values())

    def _bucket(self):
        return F.pmod(F.xxhash64("kind", "ref"), F.lit(self.BUCKETS)).cast("int")

    def write(self, df: DataFrame, touched: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """A new snapshot; its number. With `touched` (kind, ref) only the buckets of those are written;
        df must agree with the newest snapshot elsewhere."""
        fs, have = self._fs(), self.versions()
        before = self._list(have[-1]) if have else {"folders": {}, "batches": {}}
        rows = df.select(*(f.split()[0] for f in FINGERPRINT.split(", "))).withColumn("bucket", self._bucket())
        kept: dict[str, str] = {}
        if touched is not None and have:
            hit = {r.b for r in touched.select(self._bucket().alias("b")).distinct().collect()}  # BUCKETS rows at most
            kept = {b: p for b, p in before["folders"].items() if int(b) not in hit}
            rows = rows.where(F.col("bucket").isin(*hit)) if hit else rows.where("false")
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.repartition(self.BUCKETS, "bucket").write.partitionBy("bucket").parquet(part)
        new = {s.getPath().getName().split("=")[1]: s.getPath().toString() for s in fs.listStatus(self._path(part)) if s.getPath().getName().startswith("bucket=")}
        told = json.dumps({"folders": kept | new, "batches": before["batches"] | (dict([batch]) if batch else {})})
        draft = self._path(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(told, "utf-8"))
        out.close()
        version = have[-1] + 1 if have else 0
        if fs.exists(self._path(f"{self.path}/v{version}")) or not fs.rename(draft, self._path(f"{self.path}/v{version}")):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made version {version}; read it and try again")
        return version


class StateTable:
    """The last state of each item that a stream told, as one table for each batch; the newest row counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, schema: str) -> DataFrame:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(self.path)
        return latest(rows.withColumnRenamed("batch", "ts")).drop("ts")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def refresh_stream(changes: DataFrame, items: Callable[[SparkSession], DataFrame], store: SnapshotStore, checkpoint: str, watch: tuple[str, list[str]] | None = None, after: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """A stream of (kind, ref, ts) that keeps the store's snapshot equal to the catalogs. A batch
    reads the current items again, so late, repeated and unordered changes do no harm and no
    watermark is needed. A batch that is run again finds its number in the store and does nothing.

    watch: a folder for the last state that each item's changes told, and the fields that matter; changes
    in which none of them differs are passed over. after: called with the refs of a batch whose rows were written, to look at their pictures."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if batch_id <= store.done(checkpoint):
            return
        last = latest(df)
        spark = df.sparkSession
        new = last
        if watch:
            state = StateTable(spark, watch[0])
            new = persisted(watched(last, state.read("kind string, ref string, " + ", ".join(f"`{f}` {last.schema[f].dataType.simpleString()}" for f in watch[1])), watch[1]), "watched")
        refs = persisted(new.select("kind", "ref"), "changed")
        for left in range(TRIES - 1, -1, -1):
            try:
                snapshot, _ = fingerprints.refresh(store.read(), refs, items(df.sparkSession))
                store.write(snapshot, refs, (checkpoint, batch_id))
                break
            except RuntimeError:
                if not left:
                    raise
        if watch:
            state.add(new.select("kind", "ref", *watch[1]), batch_id)
        if after:
            after(refs)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


#: Writes that a batch tries when others write snapshots too.
TRIES = 5
