import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from tidewell.streaming import events, locks

KIND = "id long, k0 string, us timestamp, bad boolean"
BEGIN = datetime.datetime(2026, 1, 1)


def plain_locks(rows, most, window):
    """Each attempt judged by a list of its key's failures, in order."""
    failures, out = {}, []
    for _, key, at, bad in rows:
        near = [t for t in failures.get(key, []) if (at - t).total_seconds() < window]
        wait = int(window - (at - near[0]).total_seconds()) + 1 if len(near) >= most else 0
        out.append((key, at, bool(bad), wait > 0, wait))
        failures[key] = near if wait else [*near, at] if bad else []
    return sorted(out, key=repr)


def ran(spark, lots, folder, **options):
    """The judged attempts of lots that come one batch after the other."""
    for i, lot in enumerate(lots):
        spark.createDataFrame(lot, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(KIND).parquet(f"{folder}/in")
        events.drained(locks.failure_locks(stream, ["k0"], "us", F.col("bad"), order=F.col("id"), **options), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def test_three_batches_equal_a_plain_walk(spark, tmp_path):
    random.seed(3)
    lots, at = [], 0
    for lot in range(3):
        rows = []
        for i in range(400):
            at += random.choice([0, 1, 5, 40])  # ties go by id
            key = random.choice(["a", "a", "a", "b", None, ""])
            rows.append((lot * 1000 + i, key, BEGIN + datetime.timedelta(seconds=at), random.choice([True, True, False, None])))
        lots.append(rows)
    shuffled = [random.sample(rows, len(rows)) for rows in lots]
    got = ran(spark, shuffled, tmp_path, most=3, window=120, held=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_locks([r for rows in lots for r in rows], 3, 120)


def test_state_goes_with_its_window(spark, tmp_path):
    at = lambda s: BEGIN + datetime.timedelta(seconds=s)
    lots = [[(1, "a", at(0), True), (2, "b", at(1), True), (3, "c", at(2), True), (4, "c", at(3), False), (5, "d", None, True)], [(6, "b", at(5000), True)], [(7, "z", at(9000), False)]]
    got = ran(spark, lots, tmp_path, most=1, window=100)
    assert got.count() == 6 and got.where("bloqueado").select("k0", "espera").collect() == [("c", 100)]
    left = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "fallos").load()
    assert left.select("key.k0").distinct().collect() == []


def test_a_key_beyond_memory_is_merged_from_runs():
    random.seed(4)
    rows = [(random.randrange(1000), i, random.random() < 0.5) for i in range(20_000)]
    random.shuffle(rows)
    frames = [pd.DataFrame(rows[i : i + 700], columns=["us", "rank", "bad"]) for i in range(0, len(rows), 700)]
    assert list(locks.by_time(iter(frames), 1000)) == list(locks.by_time(iter(frames))) == sorted(rows)
    assert list(locks.by_time([])) == []
