import numpy as np
from helpers import signals_df
from pyspark.sql import functions as F

from undula.operators import connectivity as con
from undula.sources import store, tables


def test_sink_cache_and_missing_results(spark, tmp_path):
    path = str(tmp_path / "dfc")
    signals = signals_df(spark, {s: np.random.default_rng(s).normal(size=(30, 4)) for s in range(3)})
    calls = []

    def compute(window_size, lag):
        calls.append((window_size, lag))
        return con.dfc_stream(signals, window_size, lag)

    assert store.load(spark, path) is None
    first = store.read_through(spark, path, lambda: compute(6, 1), window_size=6, lag=1)
    again = store.read_through(spark, path, lambda: compute(6, 1), window_size=6, lag=1)
    assert calls == [(6, 1)] and first.count() == again.count() == 3 * 25 * 6

    wanted = [{"window_size": w, "lag": 1} for w in (6, 8)]
    done = store.complete_missing(spark, path, wanted, compute, expected_rows=400)
    assert done == [{"window_size": 8, "lag": 1}]
    assert store.complete_missing(spark, path, wanted, compute, expected_rows=400) == []
    # a rewritten partition leaves the others alone
    store.save(con.dfc_stream(signals, 8, 1).where("frame < 2"), path)
    counts = {r.window_size: r["count"] for r in store.load(spark, path).groupBy("window_size").count().collect()}
    assert counts == {6: 450, 8: 36}
    assert store.complete_missing(spark, path, wanted, compute, expected_rows=400) == [{"window_size": 8, "lag": 1}]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "cohort")
    cohort = spark.createDataFrame([(1, "g0", "control", "2m", 0.5), (2, "g1", "treated", "4m", None)], tables.COHORT)
    store.save_csv(cohort, path)
    assert sorted(store.load_csv(spark, path, tables.COHORT).collect()) == sorted(cohort.collect())


def test_merge_counts_missing_cells(spark):
    grid = spark.range(3).crossJoin(spark.range(2).withColumnRenamed("id", "w"))
    parts = spark.createDataFrame([(0, 0, 1.0), (2, 1, 2.0)], "id long, w long, v double")
    merged = store.merge_onto_grid(parts, grid, ["id", "w"])
    assert store.count_missing(merged, "v").first().n_missing == 4
    assert merged.where(F.col("v").isNotNull()).count() == 2


def test_only_the_manifest_is_believed(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "killed"), []
    signals = signals_df(spark, {0: np.random.default_rng(1).normal(size=(20, 3))})

    def compute(window_size, lag):
        calls.append(window_size)
        return con.dfc_stream(signals, window_size, lag)

    # A job that is lost after its files and before its manifest row.
    con.dfc_stream(signals, 6, 1).where("frame < 3").write.partitionBy("window_size", "lag").parquet(f"{path}/runs/run=dead")
    assert store.load(spark, path) is None and store.load(spark, path, window_size=6, lag=1) is None
    whole = store.read_through(spark, path, lambda: compute(6, 1), window_size=6, lag=1)
    assert calls == [6] and whole.count() == 15 * 3 and whole.columns.count("window_size") == 1
    entries = store.manifest(spark, path).collect()
    assert [(r.window_size, r.lag, r.rows) for r in entries] == [(6, 1, 45)]
    assert store.load(spark, path, window_size=7) is None

    # The last save of a parameter set counts, also beside a lost one.
    store.save(con.dfc_stream(signals, [6, 8], 1).where("frame < 4"), path)
    found = {r.window_size: r["count"] for r in store.load(spark, path).groupBy("window_size").count().collect()}
    assert found == {6: 12, 8: 12}
    store.save(con.dfc_stream(signals, 9, 1).limit(0), path)
    assert store.load(spark, path, window_size=9) is None


def test_tolerant_scan_keeps_what_can_be_read(spark, tmp_path):
    path = tmp_path / "series"
    signals_df(spark, {0: np.ones((4, 2))}).coalesce(1).write.parquet(str(path / "a"))
    spark.createDataFrame([(1, None, 0, 2.0), (1, 0, 0, 3.0)], tables.SIGNALS).coalesce(1).write.parquet(str(path / "b"))
    spark.createDataFrame([("x", "y")], "subject string, t string").coalesce(1).write.parquet(str(path / "foreign"))
    (path / "damaged").mkdir()
    (path / "damaged" / "part-0.parquet").write_bytes(b"PAR1 this is no parquet file PAR1")
    rows, rejected = tables.tolerant_scan(spark, f"{path}/*")
    assert rows.count() == 9 and rows.columns == tables.SIGNALS.fieldNames()
    found = {(r.file.split("/")[-2], r.reason): r.n for r in rejected.collect()}
    assert found.pop(("b", "no key")) == 1
    assert {name for name, _ in found} == {"damaged", "foreign"}


def test_tolerant_scan_of_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("subject,t,region,value\n0,0,0,1.5\n0,x,1,2\n0,1,,3\n0,2,0,\n")
    (tmp_path / "b.csv").write_text("subject,t,region,value\n")
    rows, rejected = tables.tolerant_scan(spark, str(tmp_path), kind="csv")
    assert sorted((r.t, r.value) for r in rows.collect()) == [(0, 1.5), (2, None)]
    found = {(r.file.split("/")[-1], r.reason): r.n for r in rejected.collect()}
    assert found == {("a.csv", "broken row"): 1, ("a.csv", "no key"): 1, ("b.csv", "not readable or empty"): 0}
