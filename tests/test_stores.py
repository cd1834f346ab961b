import pytest
from pyspark.sql import functions as F

from tallymill.sources import stores
from tallymill.streaming import events


def test_shards_wide_csv_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([(f"i{k}", "d" + str(k % 2), k) for k in range(10)], "item_id string, dataset string, v int")
    stores.write_shards(df, str(tmp_path / "s"), ["dataset"], rows=2)
    stores.write_shards(df.limit(0), str(tmp_path / "s"), ["dataset"])
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 10 and len(list((tmp_path / "s" / "dataset=d0").glob("*.parquet"))) >= 3
    p = spark.createDataFrame([("r", 0, "i", "d", 1, m, 0.5, 1) for m in ("a", "b")], "run string, seed int, item_id string, dataset string, y int, method string, score double, pred int")
    stores.write_wide(p, str(tmp_path / "w"), ["a", "b"])
    assert {"a_scores", "b_preds"} <= set(spark.read.parquet(str(tmp_path / "w")).columns)
    stores.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 10
    assert stores.provenance(spark, {"b": 1, "a": 2}).collect()[0]["config"] == '{"a": 2, "b": 1}'


def test_jsonl_log(spark, tmp_path):
    path = str(tmp_path / "log")
    stores.append_jsonl(spark.createDataFrame([("a", 1)], "id string, n int"), path)
    stores.append_jsonl(spark.createDataFrame([("b", 2)], "id string, n int"), path)
    assert {tuple(r) for r in stores.read_jsonl(spark, path, "id string, n int").collect()} == {("a", 1), ("b", 2)}


def test_fit_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "item_id string, y int")
    fp = stores.FitStore.fingerprint(rows)
    assert fp == stores.FitStore.fingerprint(rows.orderBy(F.desc("item_id"))) != stores.FitStore.fingerprint(rows.limit(1))
    store = stores.FitStore(spark, str(tmp_path / "fits"))
    assert store.load(fp) is None
    store.save(fp, 0, {"c": 1}, {"auroc": 0.5})
    assert store.load(fp).count() == 1 and store.load("other") is None


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    row = "select {i}L as event_id, timestamp'{t}' as ts, 'view' as event_type, {v}D as value"
    first = spark.sql(row.format(i=1, t="2024-01-01 01:00:00", v=2)).union(spark.sql(row.format(i=1, t="2024-01-01 01:00:00", v=2))).union(spark.sql(row.format(i=2, t="2024-01-01 02:00:00", v=3)))
    first.coalesce(1).write.mode("append").parquet(src)
    events.ingest(spark, src, "*.parquet", out, state)
    assert [(r["n"], r["total"]) for r in events.result(spark, out).collect()] == [(2, 5.0)]
    spark.sql(row.format(i=3, t="2024-01-01 03:00:00", v=4)).coalesce(1).write.mode("append").parquet(src)
    events.ingest(spark, src, "*.parquet", out, state)
    assert [(r["n"], r["total"]) for r in events.result(spark, out).collect()] == [(3, 9.0)]


def test_entry_without_the_subpackage(monkeypatch, spark):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def no_llm(name, *a, **k):
        if name.startswith("tallymill.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    names = entry.queries()
    assert "metrics_by_scope" in names and not any(n.startswith("p1_") for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


def test_missing_rows_are_an_error(spark):
    from tallymill.operators.records import require_all

    with pytest.raises(LookupError):
        require_all(spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([], "id string"), "id")


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "doc")
    stores.write_json(spark.createDataFrame([("a", [1, 2])], "id string, v array<long>"), path)
    stores.write_json(spark.createDataFrame([("b", [3])], "id string, v array<long>"), path)
    assert [tuple(r) for r in stores.read_json(spark, path).select("id", "v").collect()] == [("b", [3])]
    (tmp_path / "lines.json").write_text('{"id": "x",\n "v": [1]}')
    assert stores.read_json(spark, str(tmp_path / "lines.json"), "id string, v array<int>").first()["v"] == [1]


def test_out_of_fold_scores_replace_what_was_there(spark, tmp_path):
    store = stores.OofStore(spark, str(tmp_path / "oof"))
    schema = "item_id string, fold int, y int, score double, pred int, dataset string, group_id string"
    store.save(spark.createDataFrame([("a", 0, 1, 0.5, 1, "d", "g")], schema), "r0", 0, "m")
    store.save(spark.createDataFrame([("a", 0, 1, 0.4, 0, "d", "g")], schema), "r0", 0, "n")
    store.save(spark.createDataFrame([("a", 0, 1, 0.9, 1, "d", "g"), ("b", 1, 0, 0.1, 0, "d", "g")], schema), "r0", 0, "m")
    assert {(r["method"], r["item_id"], r["score"]) for r in store.load("r0").collect()} == {("m", "a", 0.9), ("m", "b", 0.1), ("n", "a", 0.4)}
    assert tuple(store.load().columns) == stores.OofStore.COLUMNS
