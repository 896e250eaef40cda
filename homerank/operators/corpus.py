"""Duplicates, merges and queues of adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint_key(area_key: str = "area_key") -> Column:
    """What makes two adverts one home: area, size, rooms, floor, prices and the point to five places."""
    return F.concat_ws("|", F.coalesce(F.col(area_key), F.lit("")), "area_sqm", "rooms", "floor", "deposit", "rent", F.floor(F.col("lat") * 1e5 + 0.5), F.floor(F.col("lon") * 1e5 + 0.5))


def fingerprint(area_key: str = "area_key") -> Column:
    return F.sha2(fingerprint_key(area_key), 256)


def dedup_first(rows: DataFrame, key: str = "fingerprint", order: str = "ingest_seq") -> DataFrame:
    """The first row of each fingerprint: one aggregation with a map-side part, so many reposts of one home make no hot group."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("__k")).agg(F.min_by(whole, order).alias("__r")).select("__r.*")


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The corpus after a batch; all have id, fingerprint, ingest_seq. Adds `action`: kept, updated or inserted.

    In batch order a row is skipped when another id owns its fingerprint, else it updates its own stored row, else it is
    inserted and owns the fingerprint from then on. The last update of an id counts.
    """
    owner = stored.groupBy("fingerprint").agg(F.min_by("id", "ingest_seq").alias("owner"))
    known = stored.select("id", F.lit(True).alias("known"))
    new = batch.join(owner, "fingerprint", "left").join(known, "id", "left")
    # Of rows that insert, the first of a fingerprint owns it within the batch: a map-side minimum, joined back.
    first = new.filter("owner IS NULL AND known IS NULL").groupBy("fingerprint").agg(F.min(F.struct("ingest_seq", "id")).alias("__first"))
    new = new.join(first, "fingerprint", "left").withColumn("owner", F.coalesce("owner", F.when(F.col("__first.ingest_seq") < F.col("ingest_seq"), F.col("__first.id")), "id"))
    taken = new.filter(F.col("owner") == F.col("id"))
    last = taken.groupBy("id").agg(F.max_by(F.struct(*[F.col(c) for c in stored.columns]), "ingest_seq").alias("__r"), F.max("known").alias("known"))
    changed = last.select("__r.*", F.when(F.col("known"), "updated").otherwise("inserted").alias("action"))
    return stored.join(changed.select("id"), "id", "left_anti").withColumn("action", F.lit("kept")).unionByName(changed)


def upsert_counts(merged: DataFrame, batch: DataFrame) -> DataFrame:
    """One row for a batch with one row an id: inserted, updated, skipped_duplicate, total."""
    done = merged.agg(F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "updated").alias("updated"), F.count(F.lit(1)).alias("total"))
    return done.crossJoin(F.broadcast(batch.agg(F.count(F.lit(1)).alias("given")))).select("inserted", "updated", (F.col("given") - F.col("inserted") - F.col("updated")).alias("skipped_duplicate"), "total")  # one row


def backfill(stored: DataFrame, stamp: str | None, revision: str, flag: str, whole_rule: Column, late_rule: Column) -> tuple[DataFrame, str]:
    """(stored with its flag brought up to date, the stamp it has then): by both rules where there is no flag yet, by the later rule on
    unflagged rows where the stamp is stale, and not at all where it is current, so a second run changes nothing."""
    if flag not in stored.columns:
        return stored.withColumn(flag, F.coalesce(whole_rule, F.lit(False))), revision
    if stamp == revision:
        return stored, revision
    return stored.withColumn(flag, F.col(flag) | F.coalesce(late_rule, F.lit(False))), revision
