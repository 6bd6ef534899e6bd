"""One result per run: whatever breaks, and wherever, readers see whole runs only."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators.clean import clean, dedup_rows
from ledgerfold.plans import etl
from ledgerfold.plans.etl import run_etl
from ledgerfold.plans.service import answer
from ledgerfold.sources import Store
from ledgerfold.sources.readers import ROW_INDEX, land_source
from ledgerfold.sources.store import DATASET_TABLES


def _export(path, n, first=0):
    lines = ["customer_id,mrr,plan,status,start_date,seats"]
    for i in range(first, first + n):
        revenue = 90000 if i % 17 == 3 else 100 + i % 9
        lines.append(f"c{i},{revenue},basic,active,2023-{1 + i % 5:02d}-03,{i % 6}")
    path.write_text("\n".join([*lines, lines[1], lines[2] + ",too,many"]) + "\n")
    return str(path)


def state(store):
    return {t: sorted(map(str, store.table(t).drop("created_at").collect())) for t in DATASET_TABLES}


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("consistent")
    store = Store(spark, str(folder / "store"))
    run_etl(spark, store, "d", "csv", path=_export(folder / "a.csv", 40), key=("customer_id",))
    return store, state(store), _export(folder / "b.csv", 25, 500)


class Broken(Exception):
    pass


def _raise(*_, **__):
    raise Broken("here")


STEPS = [
    (etl, "land_source"), (etl, "canonical_table"), (etl, "clean"), (etl, "transform_subscriptions"), (etl, "label"),
    (etl, "validation_report"), (Store, "write_subscriptions"), (etl, "snapshots"), (Store, "write_metrics"),
    (Store, "write_rejects"), (etl, "anomalies"), (Store, "write_anomalies"), (etl, "label_report"),
]


@pytest.mark.parametrize("owner, name", STEPS, ids=[n for _, n in STEPS])
def test_a_run_broken_at_a_step_changes_no_table(first, spark, monkeypatch, owner, name):
    store, before, path = first
    monkeypatch.setattr(owner, name, _raise)
    with pytest.raises(Broken):
        run_etl(spark, store, "d", "csv", path=path, key=("customer_id",))
    assert state(store) == before and before["anomalies"] and before["rejects"]
    assert store.datasets().first()["status"] == "failed"


def test_a_run_broken_at_its_last_event_changes_no_table(first, spark, monkeypatch):
    store, before, path = first
    append = Store.append_rows

    def broken(self, table, *rows):
        if table == "datasets" and rows[0]["status"] == "ready":
            raise Broken("here")
        append(self, table, *rows)

    monkeypatch.setattr(Store, "append_rows", broken)
    with pytest.raises(Broken):
        run_etl(spark, store, "d", "csv", path=path, key=("customer_id",))
    assert state(store) == before


def test_rows_written_but_not_published_are_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda *names: spark.createDataFrame(
        [("d", n, "p", 10.0, "active") for n in names], "dataset_id string, customer_id string, plan string, mrr double, status string")
    store.write_subscriptions(rows("a", "b"))
    store.write_subscriptions(rows("x"), run_id="r1")
    assert {r["customer_id"] for r in store.table("subscriptions").collect()} == {"a", "b"}
    later = datetime(2200, 1, 1)
    store.append_rows("datasets", {"id": "d", "name": "n", "status": "failed", "run_id": "r1", "updated_at": later})
    assert {r["customer_id"] for r in store.table("subscriptions").collect()} == {"a", "b"}
    store.append_rows("datasets", {"id": "d", "name": "n", "status": "ready", "run_id": "r1", "updated_at": later})
    assert {r["customer_id"] for r in store.table("subscriptions").collect()} == {"x"}
    assert store.table("metrics").count() == 0


def test_old_runs_are_removed_and_others_left(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = _export(tmp_path / "a.csv", 12)
    store.write_subscriptions(spark.createDataFrame(
        [("d", "u", "p", 1.0, "s")], "dataset_id string, customer_id string, plan string, mrr double, status string"), run_id="under-way")
    for _ in range(3):
        run_etl(spark, store, "d", "csv", path=path, key=("customer_id",), detect=False)
    folders = {p.name for p in (tmp_path / "store" / "subscriptions" / "dataset_id=d").iterdir()}
    assert len(folders) == 3 and "run_id=under-way" in folders
    assert store.table("subscriptions").count() == 12
    store.delete_dataset("d")
    assert store.table("subscriptions").count() == 0 and store.datasets().count() == 0


def test_report_counts_what_was_lost(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    lines = ["customer_id,mrr,plan,status,start_date"] + [
        f"c{i},{10 + i},p,active,{'2023-01-05' if i % 3 else 'soon'}" + (",x" if i % 10 == 9 else "") for i in range(60)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    run = run_etl(spark, store, "d", "csv", path=str(tmp_path / "a.csv"), detect=False)
    lost = sum(i % 3 == 0 for i in range(60) if i % 10 != 9)
    cleaning = json.loads(store.datasets().first()["validation_report"])["cleaning"]
    assert (cleaning["lines_skipped"], cleaning["dates_lost"], cleaning["original_rows"]) == (6, {"start_date": lost}, 54)
    assert run.lines_skipped == 6 and run.rows_processed == 54
    rejects = {r["row_index"]: r for r in store.table("rejects").collect()}
    assert sorted(rejects) == [i for i in range(60) if i % 3 == 0 or i % 10 == 9]
    assert rejects[9]["line"] == "c9,19,p,active,soon,x" and rejects[9]["reason"] == "more than 5 fields"
    assert (rejects[3]["column_name"], rejects[3]["value"], rejects[3]["line"]) == ("start_date", "soon", None)


def test_numbers_run_over_files_and_copies_keep_the_first(spark, tmp_path):
    for part in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part-{part}.csv").write_text(
            "a,b\n" + "".join(f"{part * 50 + i},x{i}\n" for i in range(50)) + "0,x0\n1,x1,long\n")
    landed = land_source(spark, "csv", path=str(tmp_path / "in"))
    assert (landed.records, landed.rejected) == (153, 3)
    rows = {r[ROW_INDEX]: (r["a"], r["b"]) for r in landed.frame.collect()}
    assert len(rows) == 153 and rows[0] == rows[50] == rows[154] == (0, "x0") and rows[52] == (50, "x0")
    assert sorted(r[ROW_INDEX] for r in landed.rejects.collect()) == [51, 103, 155]
    least = {(r["a"], r["b"]): r[ROW_INDEX] for r in dedup_rows(landed.frame, ROW_INDEX).collect()}
    assert len(least) == 150 and least[0, "x0"] == 0
    cleaned = clean(landed.frame, row_index=ROW_INDEX)
    assert {r["a"]: r[ROW_INDEX] for r in cleaned.frame.collect()} == {float(a): n for (a, _), n in least.items()}
    assert cleaned.partial.duplicates_removed == 3


@pytest.mark.parametrize("kind", ["parquet", "json", "sql"])
def test_numbers_of_other_sources(spark, tmp_path, kind):
    rows = spark.range(1000, numPartitions=4).selectExpr("id as a", "id * 2 as b")
    if kind == "sql":
        rows.write.parquet(str(tmp_path / "t"))
        spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("numbered_source")
        landed = land_source(spark, "sql", query="select * from numbered_source")
    else:
        getattr(rows.write, kind)(str(tmp_path / "t"))
        landed = land_source(spark, kind, path=str(tmp_path / "t"))
    assert landed.records == 1000 and landed.rejected == 0
    found = landed.frame.collect()
    assert sorted(r[ROW_INDEX] for r in found) == list(range(1000))
    assert kind == "sql" or all(r["a"] == r[ROW_INDEX] for r in found)  # a statement's result has no order


def test_empty_sources_have_no_numbers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    landed = land_source(spark, "csv", path=str(tmp_path / "e.csv"))
    assert landed.records == 0 and landed.frame.columns == ["a", "b", ROW_INDEX] and landed.frame.count() == 0


def test_a_run_counts_while_it_writes(spark, tmp_path, monkeypatch):
    """No job of a run only counts: rows, labels, caps and anomalies come with the writes."""
    from pyspark.sql import DataFrame

    def refused(self):
        raise AssertionError("a count job")

    store = Store(spark, str(tmp_path / "store"))
    path = _export(tmp_path / "a.csv", 40)
    small = DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: small(self) if "offset_" in self.columns else refused(self))
    run = run_etl(spark, store, "d", "csv", path=path, key=("customer_id",))
    monkeypatch.undo()
    assert run.rows_processed == 41 and run.rows_final == 40 and run.lines_skipped == 1
    assert run.anomalies_found == store.table("anomalies").count() > 0
    assert run.cleaning.outliers_capped == {"mrr": 3}
    plans = {r["field"]: (r["rows"], r["labelled"]) for r in run.enrichment.collect()}
    assert plans["plan_category"] == (40, 40)


def test_capped_counts_equal_those_of_a_pass(spark):
    frame = spark.createDataFrame([(float(i % 7), 10.0 ** (i % 50 == 0) * 5) for i in range(200)], "mrr double, seats double")
    cleaned = clean(frame.withColumn("k", F.monotonically_increasing_id()))
    counted, aggregates = cleaned.counted()
    seen = counted.agg(*aggregates).first().asDict() if aggregates else {}
    counts = dict(cleaned.with_counts(seen).outliers_capped)
    cleaned.partial.outliers_capped = {}
    assert counts == cleaned.report().outliers_capped


def test_cut_results_are_marked(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write_subscriptions(spark.range(250).selectExpr(
        "'d' as dataset_id", "cast(id as string) as customer_id", "'p' as plan", "1.0D as mrr", "'active' as status"))
    whole, cut = answer(store, "some", "select * from saas_subscriptions limit 100"), answer(store, "all", "select * from saas_subscriptions")
    assert (len(whole), whole.truncated, len(cut), cut.truncated) == (100, False, 100, True)
    log = {r["question"]: r["truncated"] for r in store.table("query_log").collect()}
    assert log == {"some": False, "all": True}


@pytest.mark.parametrize("sql", [
    "select * from hidden_table where exists (with hidden_table as (select 1) select * from hidden_table)",
    "with a as (select 1 as x) select * from a, (select * from hidden_table)",
    "select x from saas_metrics union all (with saas_metrics as (select * from hidden_table) select x from saas_metrics)",
    "select * from spark_catalog.default.hidden_table", "select * from hidden_view", "select * from global_temp.hidden_global",
    "select try_reflect('java.lang.System', 'getProperty', 'user.home')", "select input_file_name() from saas_metrics",
    "select (select max(x) from default.hidden_table) from saas_metrics", "select * from python_worker_logs()",
    "with saas_metrics as (select * from parquet.`/tmp`) select * from saas_metrics",
    "select y from saas_metrics",
])
def test_only_given_tables_are_read(spark, sql):
    from ledgerfold.operators import serving

    if not spark.catalog.tableExists("hidden_table"):
        spark.sql("create table hidden_table using parquet as select 7 as x")
        spark.sql("create view hidden_view as select * from hidden_table")
        spark.range(1).toDF("x").createOrReplaceGlobalTempView("hidden_global")
    tables = {"saas_metrics": spark.createDataFrame([(1,)], "x int")}
    with pytest.raises(ValueError):
        serving.safe_sql(spark, sql, tables)
    legal = "with m as (select x from saas_metrics), n as (select * from m) select n.x, r.id from n, range(2) r, (values (1)) v(y) where x = y"
    assert serving.safe_sql(spark, legal, tables).count() == 2


@pytest.fixture(scope="module", autouse=True)
def no_hidden_table(spark):
    yield
    spark.sql("drop view if exists hidden_view")
    spark.sql("drop table if exists hidden_table")


def _prepared(spark, first, n):
    return spark.range(first, first + n).selectExpr(
        "concat('c', id) as customer_id", "'p' as plan", "cast(id % 7 + 0.1 as double) as mrr", "'active' as status",
        "id % 3 = 0 as churned", "timestamp_ntz '2023-01-15 00:00:00' + make_interval(0, cast(id % 9 as int)) as start_date",
        "if(id % 3 = 0, timestamp_ntz '2023-05-02 00:00:00' + make_interval(0, cast(id % 5 as int)), null) as churn_date")


def _metrics(store):
    return sorted(map(str, store.table("metrics").drop("id", "created_at").collect()))


@pytest.fixture
def kept_up(spark, tmp_path):
    from ledgerfold.plans.etl import write_months

    store = Store(spark, str(tmp_path / "store"))
    first = _prepared(spark, 0, 300).withColumn("dataset_id", F.lit("d"))
    store.write_subscriptions(first, one_dataset=True, run_id="r0")
    write_months(store, "d", first, "r0")
    store.publish("d", dict.fromkeys(("subscriptions", "metrics", "month_pairs"), "r0"))
    return store


def test_appended_rows_alone_are_read(kept_up, spark, tmp_path, monkeypatch):
    from ledgerfold.operators.snapshot import monthly_snapshot
    from ledgerfold.plans.increments import append_subscriptions, compact, remove_subscriptions

    store, table = kept_up, Store.table
    monkeypatch.setattr(Store, "table", lambda self, name: table(self, name) if name != "subscriptions" else _raise())
    append_subscriptions(store, "d", _prepared(spark, 1000, 200))
    append_subscriptions(store, "d", _prepared(spark, 5000, 1).limit(0))
    monkeypatch.undo()
    assert store.table("subscriptions").count() == 500

    def whole(rows):
        other = Store(spark, str(tmp_path / f"other{rows.count()}"))
        other.write_metrics(monthly_snapshot(rows).withColumn("dataset_id", F.lit("d")))
        return _metrics(other)

    both = _prepared(spark, 0, 300).unionByName(_prepared(spark, 1000, 200))
    assert _metrics(store) == whole(both)
    gone = both.filter("mrr > 4").select("customer_id")
    remove_subscriptions(store, "d", gone)
    assert _metrics(store) == whole(both.filter("mrr <= 4"))
    before = sorted(r["customer_id"] for r in store.table("subscriptions").collect())
    assert before == sorted(r["customer_id"] for r in both.filter("mrr <= 4").collect())
    append_subscriptions(store, "d", both.filter("mrr > 4"))
    compact(store, "d")
    store.drop_old_runs("d", keep=1)
    assert _metrics(store) == whole(both) and store.table("subscriptions").count() == 500
    assert len(list((tmp_path / "store" / "subscriptions" / "dataset_id=d").iterdir())) == 1


def test_a_failed_append_changes_nothing(kept_up, spark, monkeypatch):
    from ledgerfold.plans import increments

    before = state(kept_up)
    for owner, name in ((Store, "write_metrics"), (increments, "merge_pairs"), (Store, "publish")):
        monkeypatch.setattr(owner, name, _raise)
        with pytest.raises(Broken):
            increments.append_subscriptions(kept_up, "d", _prepared(spark, 1000, 50))
        monkeypatch.undo()
        assert state(kept_up) == before
