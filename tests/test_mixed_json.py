"""JSON payloads whose shapes and types drift."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerfold.plans.etl import run_etl
from ledgerfold.sources import Store
from ledgerfold.sources.readers import ROW_INDEX, land_source, read_json_mixed


def _lines(path, *payloads):
    path.write_text("\n".join(p if isinstance(p, str) else json.dumps(p) for p in payloads) + "\n")
    return str(path)


def test_shapes_and_types(spark, tmp_path):
    path = _lines(
        tmp_path / "a.json",
        {"d": {"r": [{"Id": 1, "u": {"a-b": 1.5, "t": [1, 2]}, "x": 5, "n": None}, {"Id": 2, "x": "five", "u": None}]}},
        {"d": {"r": {"Id": 3, "x": {"deep": [1]}, "big": 12345678901234567890, "f": True}}},
        {"d": {"r": 7}}, {"d": {"r": [8, {"Id": 4, "x": 1.25}]}}, {"d": {}}, {"e": 1}, "{broken", "", {"d": {"r": []}}, {"d": {"r": [None]}})
    rows, rejects = read_json_mixed(spark, path, "d.r")
    assert sorted(rows.columns) == ["big", "f", "id", "n", "u_a_b", "u_t", "x"]
    found = {r["id"]: r.asDict() for r in rows.collect()}
    assert {k: v["x"] for k, v in found.items()} == {1: "5", 2: "five", 3: '{"deep":[1]}', 4: "1.25"}
    assert found[1]["u_t"] == [1, 2] and found[1]["u_a_b"] == 1.5 and found[2]["u_a_b"] is None
    assert str(found[3]["big"]) == "12345678901234567890" and found[3]["f"] is True and found[1]["n"] is None
    reasons = sorted(r["reason"] for r in rejects.collect())
    assert reasons == ["a record that is no object"] * 3 + ["no JSON"] + ["no records at the key"] * 2
    assert {r["line"] for r in rejects.filter("reason = 'no JSON'").collect()} == {"{broken"}


@pytest.mark.parametrize("key, payload", [
    (None, [{"a": 1}, {"a": 2}]), ("it's.k", {"it's": {"k": [{"a": 1}, {"a": 2}]}}), ('q"r', {'q"r': [{"a": 1}, {"a": 2}]})])
def test_keys_of_any_name_and_whole_files(spark, tmp_path, key, payload):
    (tmp_path / "w.json").write_text(json.dumps(payload, indent=2))
    rows, rejects = read_json_mixed(spark, str(tmp_path / "w.json"), key, multiline=True)
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and rejects.count() == 0


def test_nothing_to_read(spark, tmp_path):
    for text in ("", "[]\n", "{broken\n"):
        (tmp_path / "n.json").write_text(text)
        rows, rejects = read_json_mixed(spark, str(tmp_path / "n.json"))
        assert rows.columns == [] and rejects.count() == (1 if "broken" in text else 0)


def test_headers_that_become_equal(spark, tmp_path):
    rows, _ = read_json_mixed(spark, _lines(tmp_path / "h.json", {"A b": 1, "a-b": 2, "a": {"b": 3}}))
    assert sorted(rows.columns) == ["a_b", "a_b_2", "a_b_3"] and sorted(rows.first()) == [1, 2, 3]


def test_a_run_on_mixed_payloads(spark, tmp_path):
    payloads = [{"items": [{"customer_id": f"c{i}", "mrr": i if i % 2 else str(i), "plan": "p", "status": "active"}]}
                if i % 3 else {"items": {"customer_id": f"c{i}", "mrr": i, "plan": "p", "status": "active"}} for i in range(30)]
    path = _lines(tmp_path / "p.json", *payloads, {"items": 3}, "{")
    landed = land_source(spark, "json", path=path, data_key="items", mixed=True)
    assert (landed.records, landed.rejected) == (30, 2)
    assert {r["customer_id"]: r[ROW_INDEX] for r in landed.frame.collect()} == {f"c{i}": i for i in range(30)}
    store = Store(spark, str(tmp_path / "store"))
    run_etl(spark, store, "d", "api", path=path, data_key="items", mixed=True, key=("customer_id",), detect=False)
    stored = store.table("subscriptions").agg(F.count("*"), F.sum(F.col("mrr").cast("double"))).first()
    assert tuple(stored) == (30, sum(range(30)))
    assert {r["row_index"]: r["reason"] for r in store.table("rejects").collect()} == {
        30: "a record that is no object", 31: "no JSON"}
