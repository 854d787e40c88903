from pyspark.sql import functions as F

from tidewell.operators import history, rows


def hot(spark, n=5000):
    """Two thirds of the rows have one key, some none; columns are called like those inside."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(0, n, 1, 6).select("id", key.alias("key"), ((F.col("id") * 7919) % n).alias("at"), F.lit("x").alias("part"), F.lit(1).alias("place"))


def ranks(df):
    """(key, id) to its place by ``at`` within its key."""
    out, groups = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        groups.setdefault(r["key"], []).append(r["id"])
    for key, ids in groups.items():
        out |= {(key, i): n for n, i in enumerate(ids, 1)}
    return out


def test_numbers_and_batches_within_hot_keys(spark):
    df = hot(spark)
    want = ranks(df)
    got = rows.numbered(df, ["at"], "n", ["key"])
    assert got.columns == [*df.columns, "n"] and {(r["key"], r["id"]): r["n"] for r in got.collect()} == want
    lots = rows.batches(df, ["at"], 7, ["key"])
    assert {(r["key"], r["id"]): r["lote"] for r in lots.collect()} == {k: (n - 1) // 7 for k, n in want.items()}
    whole = rows.batches(df, [F.desc("at")], 100)
    assert all(r["lote"] == (4999 - r["at"]) // 100 for r in whole.collect())
    assert rows.batches(df.where("false"), ["at"], 7, ["key"]).count() == 0 == rows.batches(df.where("false"), ["at"], 7).count()


def test_rows_beyond_the_first_of_hot_keys(spark):
    df = hot(spark)
    want = ranks(df)
    for keep in (1, 5):
        got = history.beyond_newest(df, "key", ["at"], keep)
        assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(i for (_, i), n in want.items() if n > keep)
    kept, lost = rows.first_per_key(df, F.col("key"), ["at"])
    assert sorted(r["id"] for r in kept.collect()) == sorted(i for (k, i), n in want.items() if n == 1 or k is None)
    assert sorted(r["id"] for r in lost.collect()) == sorted(i for (k, i), n in want.items() if n > 1 and k is not None)
