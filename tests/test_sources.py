import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions.scratch import scratch_root, stage
from ledgerfold.sources import (
    Store, file_fingerprints, normalize_headers, read_csv, read_json_records, read_source, read_sql,
    source_metadata,
)
from ledgerfold.sources.readers import jdbc_options, sniff_delimiter, source_fingerprint
from ledgerfold.sources.store import dataset_list, query_history, taken_names


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_upload_text(spark, tmp_path):
    path = _write(tmp_path / "u.csv", "customer_id,mrr,plan,churned\nc1,100.5,starter,false\nc2,200,growth,true\n")
    df = read_csv(spark, path)
    assert df.dtypes == [("customer_id", "string"), ("mrr", "double"), ("plan", "string"), ("churned", "boolean")]
    assert df.orderBy("customer_id").collect()[1] == ("c2", 200.0, "growth", True)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_long_rows_go_and_short_rows_stay(spark, tmp_path, sep):
    lines = ["A b,C-d,E", "1,x,y", "2,x", "3,x,y,z", '4,"q,q",y', '5,"u,u"', '6,"a,b",c,', "7,,w"]
    text = "\n".join(line.replace(",", sep) for line in lines) + "\n"
    df = read_csv(spark, _write(tmp_path / "r.csv", text))
    assert df.columns == ["a_b", "c_d", "e"]
    rows = {r["a_b"]: (r["c_d"], r["e"]) for r in df.collect()}
    assert rows == {1: ("x", "y"), 2: ("x", None), 4: (f"q{sep}q", "y"), 5: (f"u{sep}u", None), 7: (None, "w")}
    assert df.count() == 5 and df.select("e").count() == 5


def test_no_value_texts(spark, tmp_path):
    path = _write(tmp_path / "n.csv", 'k,v,t\n1,NA,""\n2,n/a,None\n3,7,x\n')
    rows = {r["k"]: (r["v"], r["t"]) for r in read_csv(spark, path).collect()}
    assert rows == {1: (None, None), 2: (None, None), 3: (7, "x")}


def test_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv(spark, _write(tmp_path / "e.csv", ""))


def test_sniffing_ignores_quoted_delimiters():
    assert sniff_delimiter('"a,b,c,d";e;f') == ";"


def test_json_payloads(spark, tmp_path):
    many = {"data": {"items": [{"Id": 1, "user": {"first.name": "a", "tags": ["x", "y"]}}, {"Id": 2}]}}
    path = _write(tmp_path / "p.json", json.dumps(many))
    df = read_json_records(spark, path, data_key="data.items")
    rows = {r["id"]: (r["user_first_name"], r["user_tags"]) for r in df.collect()}
    assert rows == {1: ("a", ["x", "y"]), 2: (None, None)}
    one = _write(tmp_path / "o.json", json.dumps({"data": {"a": 1, "b": {"c": 2}}}))
    assert read_json_records(spark, one, data_key="data").collect() == [(1, 2)]
    with pytest.raises(ValueError):
        read_json_records(spark, one, data_key="data.a")
    with pytest.raises(KeyError):
        read_json_records(spark, one, data_key="data.zz")
    listed = _write(tmp_path / "l.json", json.dumps([{"a": 1}, {"a": 2}]))
    assert read_json_records(spark, listed, multiline=True).count() == 2


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Monthly Revenue` int, `client-id` int, `a.b` int")
    assert normalize_headers(df).columns == ["monthly_revenue", "client_id", "a.b"]
    assert normalize_headers(df, dots=True).columns[2] == "a_b"


def test_dispatch(spark, tmp_path):
    path = _write(tmp_path / "t.tsv", "a\tb\n1\t2\n")
    assert read_source(spark, "CSV", path=path).collect() == [(1, 2)]
    with pytest.raises(ValueError, match="no reader"):
        read_source(spark, "ftp", path=path)
    with pytest.raises(ValueError, match="cannot read"):
        read_source(spark, "csv", path="x.pdf")
    with pytest.raises(ValueError):
        read_source(spark, "sql", query="")
    spark.range(3).createOrReplaceTempView("three")
    assert read_sql(spark, "select id as `My Id` from three").columns == ["my_id"]
    meta = source_metadata(spark.range(3), "three", "sql").first()
    assert (meta["rows"], meta["columns"]) == (3, "id")


def test_jdbc_options_split_the_read():
    with pytest.raises(ValueError, match="split"):
        jdbc_options("jdbc:x", "select 1")
    split = jdbc_options("jdbc:x", "select * from t", ("id", 0, 100, 8), user="u")
    assert split["dbtable"] == "(select * from t) source" and split["numPartitions"] == "8"
    assert "query" not in split and split["user"] == "u"


def test_fingerprints(spark, tmp_path):
    import hashlib
    _write(tmp_path / "a.csv", "a,b\n1,2\n")
    _write(tmp_path / "big.csv", "x" * 100)
    digest = lambda b: hashlib.sha256(b).hexdigest()[:16]
    want = {"a.csv": digest(b"a,b\n1,2\n"), "big.csv": digest(b"x" * 100)}
    assert {r["path"].rsplit("/", 1)[1]: r["fingerprint"] for r in file_fingerprints(spark, str(tmp_path)).collect()} == want
    assert source_fingerprint(spark, str(tmp_path / "a.csv")) == want["a.csv"]
    assert source_fingerprint(spark, str(tmp_path)) == digest("".join(sorted(want.values())).encode())


def test_equal_headers_are_told_apart(spark, tmp_path):
    df = read_csv(spark, _write(tmp_path / "h.csv", "A b,a-b,a_b_2,A B\n1,2,3,4\n"))
    assert df.columns == ["a_b", "a_b_3", "a_b_2", "a_b_4"] and df.first() == (1, 2, 3, 4)


def test_long_whole_numbers_keep_their_digits(spark, tmp_path):
    lines = ["a,b,c,d"] + [f"123456789012345678{i},1234567890123456789012345{i},{'9' * 40}{i},{i}.5" for i in range(3)]
    df = read_csv(spark, _write(tmp_path / "w.csv", "\n".join(lines) + "\n"))
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)", "string", "double"]
    assert [df.select(c).distinct().count() for c in "abcd"] == [3, 3, 3, 3]


def test_values_that_do_not_fit_end_the_write(spark, store):
    rows = _subs(spark, "d", "x")
    for bad in ({"seats": F.lit("99999999999999999999")}, {"mrr": F.lit(None).cast("double")},
                {"mrr": F.lit("1e60")}, {"status": F.lit(None).cast("string")}):
        with pytest.raises(Exception, match="cannot hold|is null"):
            store.write_subscriptions(rows.withColumns(bad))
    store.write_subscriptions(rows.withColumn("mrr", F.lit(99999999999999999999.0)))
    assert float(store.table("subscriptions").first()["mrr"]) == 1e20


def test_empty_result_replaces_and_fields_survive(spark, store):
    store.write_subscriptions(_subs(spark, "d1", "x").unionByName(_subs(spark, "d2", "y")))
    store.write_subscriptions(_subs(spark, "d1", "x").filter("false"), one_dataset=True, datasets=("d1",))
    assert [r["dataset_id"] for r in store.table("subscriptions").collect()] == ["d2"]
    t = datetime(2024, 1, 1)
    store.append_rows("datasets", {"id": "d1", "name": "n", "status": "pending", "etl_config": "h", "created_at": t,
                                   "updated_at": t, "error_message": "old"})
    store.append_rows("datasets", {"id": "d1", "status": "ready", "created_at": t.replace(hour=5),
                                   "updated_at": t.replace(hour=5)})
    state = store.datasets().first()
    assert (state["name"], state["etl_config"], state["status"], state["created_at"], state["error_message"]) == (
        "n", "h", "ready", t, None)


def test_scratch_is_the_session_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(10).withColumn("v", F.col("id") * 2), "t")
    assert df.agg(F.sum("v")).first()[0] == 90
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def _subs(spark, dataset, *names):
    return spark.createDataFrame([(dataset, n, "p", 10.0, "active", "junk") for n in names],
                                 "dataset_id string, customer_id string, plan string, mrr double, "
                                 "status string, unknown_column string")


def test_replacing_touches_one_dataset(spark, store):
    assert store.table("subscriptions").count() == 0
    store.write_subscriptions(_subs(spark, "a b/c", "x", "y").unionByName(_subs(spark, "d2", "z")))
    store.write_subscriptions(_subs(spark, "d2", "w"))
    rows = store.table("subscriptions").collect()
    assert sorted((r["dataset_id"], r["customer_id"]) for r in rows) == [
        ("a b/c", "x"), ("a b/c", "y"), ("d2", "w")]
    assert len({r["id"] for r in rows}) == 3 and rows[0]["created_at"] is not None
    store.delete("a b/c")
    assert [r["customer_id"] for r in store.table("subscriptions").collect()] == ["w"]


def test_stored_filter_prunes_partitions(spark, store):
    store.write_subscriptions(_subs(spark, "d1", "x").unionByName(_subs(spark, "d2", "y")))
    plan = store.table("subscriptions").filter("dataset_id = 'd1'")
    assert "PartitionFilters: [isnotnull(dataset_id" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 1


def test_registry_states(spark, store):
    t = datetime(2024, 1, 1)
    for i, (key, status) in enumerate([("d1", "pending"), ("d2", "ready"), ("d1", "ready"), ("d3", "failed")]):
        store.append_rows("datasets", {"id": key, "name": f"n_{key}", "status": status, "created_at": t,
                                       "updated_at": t.replace(hour=i)})
    assert {r["id"]: r["status"] for r in store.datasets().collect()} == {
        "d1": "ready", "d2": "ready", "d3": "failed"}
    wanted = spark.createDataFrame([("n_d1",), ("n_d3",), ("new",)], "name string")
    assert [r[0] for r in taken_names(wanted, store.datasets()).collect()] == ["n_d1"]
    store.write_subscriptions(_subs(spark, "d1", "x"))
    store.delete_dataset("d1")
    assert sorted(r["id"] for r in store.datasets().collect()) == ["d2", "d3"]
    assert store.table("subscriptions").count() == 0
    assert [r["id"] for r in dataset_list(store.datasets(), skip=1).collect()] == ["d3"]


def test_history_is_newest_first(spark, store):
    for i in range(5):
        store.append_rows("query_log", {"id": str(i), "question": "q", "created_at": datetime(2024, 1, 1 + i)})
    assert [r["id"] for r in query_history(store.table("query_log"), 2).collect()] == ["4", "3"]
