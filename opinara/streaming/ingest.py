"""Incremental ingestion and live aggregates with Structured Streaming."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from opinara.operators.ranking import top_rows
from opinara.session import materialise
from opinara.sources.store import VersionedTable

BatchFn = Callable[[DataFrame], DataFrame]
_STATE = "spark.sql.streaming.stateStore"
DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
STATE_STORE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Groups that keys are dealt to where Python keeps their state; a checkpoint is bound to it.
GROUPS = 4096
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream with a fixed schema."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def _run(stream: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed_state(spark: SparkSession) -> None:
    """Keep state on the executors' disks, with changes as checkpoints, unless the session has chosen its store."""
    for name, value in STATE_STORE.items():
        if spark.conf.get(name, None) in (None, DEFAULT_STORE, "false"):
            spark.conf.set(name, value)


def _packed(stream: DataFrame, columns: list[str]) -> Column:
    """Columns as one text, which Python passes on without a look at their types."""
    return F.to_json(F.struct(*columns), JSON_TIMES)


def _unpacked(packed: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    return packed.select(F.from_json("payload", schema, JSON_TIMES).alias("row"), *more).select("row.*", *more)


def _dealt(stream: DataFrame, keys: list[str], groups: int) -> list[Column]:
    """``group`` and ``key``: Python is called once for a group of keys, as a call for each key costs far more than its rows."""
    plain = lambda c: F.when(F.col(c) == 0, F.lit(0)).otherwise(F.col(c)) if stream.schema[c].dataType.typeName() in ("float", "double") else F.col(c)
    return [F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("group"), F.to_json(F.struct(*[plain(c).alias(c) for c in keys]), JSON_TIMES).alias("key")]


def _state_lines() -> tuple[Callable, Callable]:
    """Read and write the lines of a group's state; JSON texts hold no line feed and no tab. Made here, so that workers need no import."""
    def lines(state) -> list[str]:
        return zlib.decompress(state.get[0]).decode().split("\n") if state.exists else []

    def keep(state, lines: list[str]) -> None:
        state.update((zlib.compress("\n".join(lines).encode(), 1),))

    return lines, keep


def unseen(stream: DataFrame, keys: list[str], keep_all: bool = False, groups: int = GROUPS) -> DataFrame:
    """Rows whose key never came before; the state is the keys.

    Of several rows of a new key in one batch any one is kept, or with
    ``keep_all`` every one, for the caller to choose from; the state is then
    held by groups of keys, and a batch rewrites those it has new keys for.
    """
    _keyed_state(stream.sparkSession)
    if not keep_all:
        return stream.dropDuplicates(keys)

    lines, keep = _state_lines()

    def fresh(_key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, new = set(lines(state)), set()
        for rows in batches:
            some = [k not in held for k in rows["key"]]
            new.update(rows["key"][some])
            yield rows.loc[some, ["payload"]]
        if new:
            keep(state, sorted(held | new))

    rows = stream.select(*_dealt(stream, keys, groups), _packed(stream, stream.columns).alias("payload"))
    new = rows.groupBy("group").applyInPandasWithState(fresh, "payload string", "keys binary", "append", GroupStateTimeout.NoTimeout)
    return _unpacked(new, stream.schema)


def ingest_once(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list | None = None) -> StreamingQuery:
    """Append rows whose key was never stored, exactly once.

    Which keys were stored is state of the stream, by key: no batch reads the
    target. With an ``order`` the first row of a key's first batch is stored,
    otherwise any (rows of a key are then taken to be alike). Each batch
    overwrites its own partition, so a batch that is run again after a failure
    leaves no copies.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if order is None else top_rows(batch, keys, order, 1)
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    return _run(unseen(stream, keys, keep_all=order is not None), checkpoint, write)


def signed_changes(stream: DataFrame, key: str, version: str, deleted: str, groups: int = GROUPS) -> DataFrame:
    """What each change takes back (``sign`` -1) and puts in its place (+1).

    ``stream`` has changes of rows by ``key``; the one with the highest
    ``version`` holds, whenever it arrives, and one of a version already held
    is a repeat. Rows are the columns other than these three. The state is the
    row that holds, or the version of its deletion, by groups of keys.
    """
    columns = [c for c in stream.columns if c not in (version, deleted)]
    _keyed_state(stream.sparkSession)

    lines, keep = _state_lines()

    def change(_key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for rows in batches:
            for k, v, p in zip(rows["key"], rows["version"], rows["payload"], strict=True):
                now = (v, p is not None, p or "")
                if k not in best or now > best[k]:
                    best[k] = now
        held = {line[: line.index("\t")]: line for line in lines(state)}  # key, version, row; a deleted row is an empty text
        payloads, signs, moved = [], [], False
        for k, (v, _, new) in best.items():
            line = held.get(k)
            _, at, old = line.split("\t") if line is not None else (k, None, "")
            if at is None or v > int(at):
                held[k], moved = f"{k}\t{int(v)}\t{new}", True
                if old != new:
                    for p, sign in ((old, -1), (new, 1)):
                        if p:
                            payloads.append(p)
                            signs.append(sign)
        if moved:  # what is late or comes again leaves the state as it is
            keep(state, list(held.values()))
        if payloads:
            yield pd.DataFrame({"payload": payloads, "sign": signs})

    payload = F.when(~F.coalesce(F.col(deleted), F.lit(False)), _packed(stream, columns))
    rows = stream.select(*_dealt(stream, [key], groups), F.coalesce(F.col(version).cast("long"), F.lit(0)).alias("version"), payload.alias("payload"))
    signed = rows.groupBy("group").applyInPandasWithState(change, "payload string, sign int", "held binary", "append", GroupStateTimeout.NoTimeout)
    return _unpacked(signed, stream.select(*columns).schema, "sign")


def refresh_sums(stream: DataFrame, key: str, version: str, deleted: str, measures: Callable[[DataFrame], DataFrame], table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Keep additive aggregates up to date under inserts, changes and deletions.

    ``measures`` turns rows into the table's keys and sums; each batch adds the
    sums of what it puts in place less those of what it takes back, in one
    version of the table, so a batch's work goes with its changes alone.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        sign = F.col("sign")
        deltas = measures(batch).select(*table.keys, *[(F.col(c) * sign).cast(_type(c)).alias(c) for c in table.sums])
        # written whole first: the state moves on with it, even if the table has the batch already
        table.add(materialise(table.added(deltas), "deltas"), writer=checkpoint, batch=batch_id)

    signed = signed_changes(stream, key, version, deleted)
    kinds = {f.name: f.dataType for f in measures(signed).schema}
    _type = kinds.get
    return _run(signed, checkpoint, write)


def dedupe_within(stream: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Drop repeated keys that arrive within the delay; state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def annotate_stream(stream: DataFrame, annotate: BatchFn, target: str, checkpoint: str) -> StreamingQuery:
    """Run an annotation step on new reviews and append its rows.

    The stream's checkpoint is the list of what is done; a batch run again
    replaces its own output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        annotate(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(target)

    return _run(stream, checkpoint, write)


def refresh_products(stream: DataFrame, recompute: BatchFn, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Recompute and replace the rows of every product a batch touches, where they do not add up.

    ``recompute`` takes the touched product ids and gives their new rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("product_id").distinct()
        table.replace(recompute(ids), ids, writer=checkpoint, batch=batch_id)

    return _run(stream, checkpoint, write)


def monthly_counts(stream: DataFrame, time: str) -> DataFrame:
    """Rows per month so far; the state is one number per month."""
    month = F.trunc(F.col(time).cast("date"), "month")
    return stream.groupBy(month.alias("month")).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows per time window so far; final, and out of the state, once the watermark has passed it."""
    spans = stream.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("n"))
    return spans.select(F.col("window.start").alias("window_start"), "n")


def keep_updates(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Store what changed in each batch, windows still open included; ``latest`` gives the current rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(target)

    return (
        counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest(updates: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key in the last batch that changed it."""
    return updates.groupBy(key).agg(F.max_by(value, "batch_id").alias(value))


def keep_latest(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Store the full current result of a small live aggregate."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return (
        counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
