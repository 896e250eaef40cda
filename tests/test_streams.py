"""Streams over several batches: repeats, restarts, what a batch writes, and states that stay small."""

import functools
import os

import duckdb
from compare import same
from pyspark.sql import functions as F

from homerank import registry
from homerank.operators import corpus
from homerank.streaming import feeds
from homerank.streaming.deltas import Deltas

ROWS = "id string, fingerprint string, ingest_seq bigint, rent bigint"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "fingerprint", "ingest_seq", "rent").collect())


def test_ingest_equals_merging_whole_tables(spark, tmp_path):
    """Batches with inserts, updates that change a fingerprint, reposts and repeats; every batch merged twice; bases every two batches."""
    batches = [[(f"p{(b * 7 + i * 3) % 23}", f"f{(b + i * 5) % 17}", 100 * b + i, i) for i in range(12)] for b in range(7)]
    schema = spark.createDataFrame([], ROWS).schema
    store = Deltas(spark, str(tmp_path / "corpus"), schema, buckets=3, every=2)
    merge, whole = feeds.merge_into(store), spark.createDataFrame([], ROWS)
    for number, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, ROWS)
        merge(rows, number)
        merge(rows, number)
        whole = spark.createDataFrame(corpus.upsert(whole, rows).drop("action").collect(), ROWS)
        assert rows_of(store.latest(number + 1, "id")) == rows_of(whole)
    kept = sorted(x for x in os.listdir(tmp_path / "corpus") if not x.startswith("."))
    assert kept == ["base-2", "base-3", "batch-2", "batch-3", "batch-4", "batch-5", "batch-6"] or kept == ["base-2", "base-3", "batch-4", "batch-5", "batch-6"]


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    store = Deltas(spark, str(tmp_path / "corpus"), schema, buckets=2, every=100)
    merge, written = feeds.merge_into(store), []
    for number in range(4):
        n = 20_000 if number == 0 else 50
        merge(spark.range(number * 1_000_000, number * 1_000_000 + n).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("f"), "id").alias("fingerprint"), F.col("id").alias("ingest_seq"), (F.col("id") % 1000).alias("rent")), number)
        written.append(size(tmp_path / "corpus" / f"batch-{number}"))
    assert max(written[1:]) < 1.2 * min(written[1:]) < written[0] / 5


def test_tokens_once_after_their_state_has_ended(spark, tmp_path):
    schema = "event_id bigint, user_id bigint"
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Deltas(spark, str(tmp_path / "seen"), spark.createDataFrame([], schema).schema, buckets=2, every=3)
    progress = []
    for round_ in range(3):  # each ends and starts again where it was
        for k in range(2):
            spark.range(100).select((F.col("id") + 50 * round_).alias("event_id"), F.lit(1).cast("bigint").alias("user_id")).union(spark.range(5).select("id", "id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.seen_tokens(feed(), late="1 millisecond")
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(feeds.first_seen(store)).start()
        query.awaitTermination(120)
        progress += [p for p in query.recentProgress]
    batches = max(p["batchId"] for p in progress) + 1
    ids = [r["event_id"] for r in store.read(batches).select("event_id").collect()]
    assert len(ids) == len(set(ids)) == 200
    # The state holds no more than the batch's tokens and those of the batch before.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 220


def test_posting_rate_keeps_a_row_a_shard(spark, tmp_path):
    rows = [(1, "2030-01-01 00:00:00"), (1, "2030-01-01 06:00:00"), (2, "2030-01-01 11:00:00"), (1, "2029-12-31 12:00:00"), (3, "2030-01-02 00:00:00")]
    for r in rows:
        spark.createDataFrame([r], "user_id bigint, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.shard_counts(spark.readStream.schema("user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    store = Deltas(spark, str(tmp_path / "rates"), stream.schema, buckets=2, every=2)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(feeds.changes(store, "user_id")).start()
    query.awaitTermination(120)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    out = feeds.posting_rate(store.latest(query.lastProgress["batchId"] + 1, "user_id"), F.lit("2030-01-01 12:00:00").cast("timestamp"))
    got = {r["user_id"]: (r["posts"], r["rate"]) for r in out.collect()}
    assert got == {1: (3, 3 / 24), 2: (1, 1.0), 3: (1, None)}


def test_ingest_takes_adverts_in_the_order_in_which_they_came(spark, sf, tmp_path):
    """Of adverts with one fingerprint, in different batches or in one, the first stays (four copies of the orders, of which keys differ)."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    copies = [orders.withColumn("o_orderkey", F.col("o_orderkey") + 600_000 * i) for i in (3, 1, 0, 2)]
    functools.reduce(type(orders).unionByName, copies).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert same(registry.queries()["stream_ingest"](spark, str(tmp_path)), db, registry.oracle_sql()["stream_ingest"]) == ""
