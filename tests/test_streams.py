"""Streams over several batches: restarts, batches that run again, and aggregates against a full recompute."""

from __future__ import annotations

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from opinara.session import scratch_dir
from opinara.sources.store import VersionedTable
from opinara.streaming import ingest as ST

ROWS = "k string, at int, ts timestamp_ntz, price decimal(12,3)"


class Source:
    """A folder that gets one file per batch."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, scratch_dir(spark, "test-stream")

    def put(self, rows) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run_again(self, query: str) -> None:
        """Forget that the last batch was finished, as after a crash before its commit."""
        commits = f"{self.path}/{query}/commits"
        last = max(int(n) for n in os.listdir(commits) if n.isdigit())
        for name in (str(last), f".{last}.crc"):
            os.remove(f"{commits}/{name}")


def brute_first(batches):
    """Of each key, the first row by ``at`` of the first batch that has it."""
    out = {}
    for rows in batches:
        new = {}
        for r in rows:
            if r[0] not in out and (r[0] not in new or r[1] < new[r[0]][1]):
                new[r[0]] = r
        out |= new
    return sorted(out.values(), key=repr)


@pytest.fixture
def batches():
    import datetime
    import decimal

    rng = random.Random(8)
    row = lambda: (rng.choice([None, *"abcdefgh"]), rng.randint(0, 10**6), datetime.datetime(2024, 1, 2, 3, 4, 5, rng.randint(0, 999_999)), decimal.Decimal(rng.randint(0, 10**9)) / 1000)
    return [[row() for _ in range(n)] for n in (3, 8, 8, 8)]


def test_the_first_row_of_a_key_is_stored_once(spark, batches):
    source = Source(spark, ROWS)
    target = f"{source.path}/out"

    def run():
        ST.ingest_once(source.stream(), target, f"{source.path}/q", ["k"], ["at"]).awaitTermination()
        got = spark.read.parquet(target).select("k", "at", "ts", "price")
        return sorted(map(tuple, got.collect()), key=repr)

    for i, rows in enumerate(batches):
        source.put(rows)
        assert run() == brute_first(batches[: i + 1])
    source.run_again("q")
    assert run() == brute_first(batches)


def test_no_batch_reads_the_store(spark):
    """Keys are still known when what was stored is out of reach."""
    source = Source(spark, "k string, v int")
    target = f"{source.path}/out"
    run = lambda: ST.ingest_once(source.stream(), target, f"{source.path}/q", ["k"]).awaitTermination()
    source.put([("a", 1), ("b", 1), (None, 1)])
    run()
    shutil.move(target, f"{source.path}/elsewhere")
    source.put([("a", 2), ("c", 2), (None, 2), ("b", 2)])
    source.put([("c", 3), ("d", 3), ("a", 3)])
    run()
    assert sorted(map(tuple, spark.read.parquet(target).select("k", "v").collect())) == [("c", 2), ("d", 3)]


CHANGES = "key long, product string, sentiment string, w decimal(10,2), version int, deleted boolean"


def measures(rows):
    return rows.withColumns({"n": F.lit(1).cast("long"), "good": (F.col("sentiment") == "good").cast("long"), "w": F.col("w").cast("decimal(20,2)")}).withColumn("good", F.coalesce("good", F.lit(0)))


def test_sums_follow_inserts_changes_and_deletions(spark):
    from decimal import Decimal

    rng, source, held = random.Random(4), Source(spark, CHANGES), {}
    table = VersionedTable(spark, f"{source.path}/table", ["product"], sums=["n", "good", "w"])
    run = lambda: ST.refresh_sums(source.stream(), "key", "version", "deleted", measures, table, f"{source.path}/q").awaitTermination()

    def want():
        out = {}
        for version, product, sentiment, w, deleted in held.values():
            if not deleted:
                n, good, total = out.get(product, (0, 0, Decimal(0)))
                out[product] = (n + 1, good + (sentiment == "good"), total + w)
        return out

    def got():
        return {r.product: (r.n, r.good, r.w) for r in table.read().collect()}

    version = 0
    for _ in range(4):
        rows = []
        for key in rng.sample(range(30), 18):
            version += 1
            late = rng.random() < 0.2
            v = version - 40 if late else version
            row = (key, rng.choice(["hot", "hot", "p", None]), rng.choice(["good", "bad", None]), Decimal(rng.randint(0, 500)) / 100, v, rng.random() < 0.25)
            rows += [row, row]
            if key not in held or v > held[key][0]:
                held[key] = (v, *row[1:4], row[5])
        source.put(rows)
        run()
        assert got() == want()
    source.run_again("q")
    run()
    assert got() == want()


def test_state_is_kept_on_disk_unless_the_session_chose(spark):
    ST._keyed_state(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_python_is_called_by_group_of_keys(spark):
    """Many keys share a group's state: a batch of thousands of new keys takes seconds, and no two keys are mixed up."""
    import time

    source = Source(spark, "k double, s string, v int")
    target = f"{source.path}/out"
    run = lambda: ST.ingest_once(source.stream(), target, f"{source.path}/q", ["k", "s"], ["v"]).awaitTermination()
    texts = [None, "", "a\tb", "a\nb", "ä"]
    first = [(float(i), texts[i % 5], i % 7) for i in range(30_000)] + [(0.0, "z", 2), (-0.0, "z", 1)]
    source.put(first)
    start = time.time()
    run()
    assert time.time() - start < 60  # a call for each key took over two milliseconds of a core
    source.put([(*r[:2], -1) for r in first] + [(1.0, "new", 5), (1.0, "new", 4)])
    run()
    got = sorted(map(tuple, spark.read.parquet(target).select("k", "s", "v").collect()), key=repr)
    want = [*first[:-2], (0.0, "z", 1), (1.0, "new", 4)]
    assert sorted(((r[0] + 0.0, *r[1:]) for r in got), key=repr) == sorted(want, key=repr)


def test_a_late_batch_leaves_the_state_as_it_is(spark):
    """What was seen before changes nothing, so no group's state is written again."""
    source = Source(spark, CHANGES)
    table = VersionedTable(spark, f"{source.path}/table", ["product"], sums=["n", "good", "w"])
    rows = [(i, "p", "good", None, 2, False) for i in range(50)]
    written = []
    for batch in (rows, rows, [(*r[:4], 1, True) for r in rows]):
        source.put(batch)
        query = ST.refresh_sums(source.stream(), "key", "version", "deleted", measures, table, f"{source.path}/q")
        query.awaitTermination()
        written.append(sum(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]))
    assert written[0] > 0 and written[1:] == [0, 0] and table.read().first()["n"] == 50
