"""Arrivals: each key once over batches that break off and are run again; bases and bounds of the store."""

import pytest

from tidewell.streaming import arrivals as arriving
from tidewell.streaming.arrivals import SeenStore, arrive, arrivals, unseen

SCHEMA = "medio string, url string, id long"
DAYS = [
    [("a", "u1", 1), ("a", "u1", 2), ("b", "u1", 3), ("a", None, 4), ("a", "", 5), (None, "u1", 6)],
    [("a", "u1", 7), ("a", "u2", 8), ("b", "u2", 9), ("a", "", 10)],
    [("a", "u2", 11), ("b", "u1", 12), ("c", "u1", 13)],
    [],
    [("c", "u1", 14), ("c", "u0", 15)],
]
FRESH = {(0, i) for i in (1, 3, 4, 5, 6)} | {(1, i) for i in (8, 9, 10)} | {(2, 13), (4, 15)}


def store_at(path, **how):
    return SeenStore(str(path), "medio", "url", "medio string, url string", **how)


def kept(spark, out):
    return sorted((r.lote, r.id) for r in spark.read.parquet(str(out)).collect())


@pytest.mark.parametrize("fold", [1, 2, 16])
def test_a_batch_run_again_changes_nothing(spark, tmp_path, fold):
    store, out = store_at(tmp_path / "store", fold=fold), str(tmp_path / "out")
    for number, rows in enumerate(DAYS):
        for _ in range(2):
            arrive(spark.createDataFrame(rows, SCHEMA), number, store, out, ["id"])
    assert kept(spark, out) == sorted(FRESH)
    known = [tuple(r) for r in store.before(spark, len(DAYS)).select("medio", "url").collect()]
    assert sorted(known) == [("a", "u1"), ("a", "u2"), ("b", "u1"), ("b", "u2"), ("c", "u0"), ("c", "u1")]


def test_a_stream_that_breaks_off(spark, tmp_path):
    """A run that fails after its rows were written, and one that fails after the store, are made up for."""
    store, out, state = store_at(tmp_path / "store", fold=2), str(tmp_path / "out"), str(tmp_path / "state")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    failed = []

    def breaking(batch, number, *rest):
        if number == 1 and len(failed) < 2:
            if failed:
                arrive(batch, number, *rest)
            else:
                unseen(batch, store.before(spark, number), ["medio", "url"], ["id"]).limit(1).write.parquet(f"{out}/lote={number}")
            failed.append(number)
            raise RuntimeError("broken off")
        arrive(batch, number, *rest)

    number = 0
    for rows in filter(None, DAYS):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(3):
            try:
                arrivals(stream, store, out, state, ["id"], breaking)
                break
            except Exception:  # noqa: BLE001 - the stream tells its failure in a type of its own
                assert failed
        number += 1
    assert len(failed) == 2
    assert kept(spark, out) == sorted((min(lote, 3), i) for lote, i in FRESH)


def test_bounds_and_bases(spark, tmp_path):
    """Of each outlet the last keys are kept, whether or not a base lies between; old files go."""
    out = str(tmp_path / "out")
    for fold in (1, 3, 100):
        store = store_at(tmp_path / f"s{fold}", most=2, fold=fold)
        for n in range(7):
            arrive(spark.createDataFrame([("a", f"u{n}", n), ("b", f"u{9 - n}", n)], SCHEMA), n, store, f"{out}{fold}", ["id"])
        assert sorted(map(tuple, store.before(spark, 7).select("medio", "url").collect())) == [("a", "u5"), ("a", "u6"), ("b", "u8"), ("b", "u9")]
    assert not (tmp_path / "s1" / "nuevo" / "lote=0").exists() and (tmp_path / "s100" / "nuevo" / "lote=0").exists()
    assert arriving.SeenStore("x", "g", "k", "g string, k string").most == 20000
