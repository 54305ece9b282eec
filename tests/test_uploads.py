"""Stored sets, exact medians, references of formulas, registries: by mechanism."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallywright.operators import aggregates, expressions as ex, joins, normalise as nm
from tallywright.sources import snapshots, uploads

FIELDS = [nm.Field("id", "NUMBER", True), nm.Field("budget", "CURRENCY", True)]


def judged(spark, n, bad):
    rows = spark.createDataFrame([(str(i), None if i < bad else "£5") for i in range(n)], "id string, budget string")
    return nm.judged(nm.coerce(rows, FIELDS), FIELDS, strict=True)


def test_a_commit_is_withheld_and_the_old_set_stands(spark, tmp_path):
    path = str(tmp_path / "set")
    assert uploads.commit_judged(judged(spark, 10, 5), path) == 1
    with pytest.raises(uploads.TooManyRejected, match="6 of 10"):
        uploads.commit_judged(judged(spark, 10, 6), path)
    assert sorted(os.listdir(path)) == ["_schemas", "version=1"]
    assert uploads.committed(spark, path).count() == 5 and uploads.committed(spark, path, "rejected").count() == 5
    assert uploads.commit_judged(judged(spark, 4, 0), path) == 2
    assert uploads.committed(spark, path).count() == 4 and uploads.committed(spark, path, "rejected").count() == 0
    assert uploads.committed(spark, path, version=1).count() == 5
    assert uploads.commit_judged(judged(spark, 1, 0).limit(0), path) == 3 and uploads.committed(spark, path).collect() == []


def test_one_pass_counts_and_writes(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = judged(spark, 40, 10)
    uploads.commit_judged(rows.mapInArrow(touch, rows.schema), str(tmp_path / "set"))
    assert seen.value == 40


def test_reprocess_by_the_newest_mapping(spark, tmp_path):
    root = str(tmp_path)
    raw = spark.createDataFrame([("1", "10", "20"), ("2", "x", "30")], "Ref string, Net string, Gross string")
    uploads.store_raw(raw, root, "f", "invoice")
    assert not uploads.is_stale(spark, root, "f")
    uploads.store_mapping(spark, root, "f", "invoice", {"Ref": "id", "Net": "budget", "Gross": None, "Gone": "share"})
    assert uploads.reprocess(spark, root, "f", "invoice", FIELDS, "t1") == 1
    assert uploads.is_stale(spark, root, "f") and not uploads.is_stale(spark, root, "other")
    assert sorted((r["id"], r["budget"]) for r in uploads.derived(spark, root, "f", "invoice").collect()) == [(1.0, 10.0), (2.0, None)]
    uploads.mark(spark, root, "f", False, "t2")
    uploads.mark(spark, root, "g", True, "t2")
    assert not uploads.is_stale(spark, root, "f") and uploads.is_stale(spark, root, "g")
    uploads.store_mapping(spark, root, "f", "invoice", {"Ref": "id", "Gross": "budget"})
    assert uploads.reprocess(spark, root, "f", "invoice", FIELDS, "t3", strict=True) == 2
    assert sorted((r["id"], r["budget"]) for r in uploads.derived(spark, root, "f", "invoice").collect()) == [(1.0, 20.0), (2.0, 30.0)]
    uploads.mark(spark, root, "f", False, "t4")
    uploads.store_mapping(spark, root, "f", "invoice", {"Ref": "budget", "Net": "id"})
    uploads.store_raw(raw.where("Net = 'x'"), root, "f", "invoice")
    with pytest.raises(uploads.TooManyRejected):
        uploads.reprocess(spark, root, "f", "invoice", FIELDS, "t5", strict=True)
    assert not uploads.is_stale(spark, root, "f") and uploads.derived(spark, root, "f", "invoice").count() == 2
    uploads.delete_upload(spark, root, "f", "invoice", "t6")
    assert uploads.is_stale(spark, root, "f") and uploads.versions(spark, f"{root}/derived/firm_id=f/kind=invoice") == []


@pytest.mark.parametrize("kind", ["even", "odd", "ties", "two", "spread", "one", "all equal", "two thirds equal"])
def test_exact_median(spark, kind):
    rng = random.Random(4)
    values = {
        "even": [rng.gauss(0, 1) for _ in range(5000)], "odd": [rng.random() for _ in range(4999)], "ties": [float(rng.randrange(3)) for _ in range(3000)], "two": [1.0] * 500 + [2.0] * 500,
        "spread": [10.0 ** rng.uniform(-300, 300) * rng.choice([1, -1]) for _ in range(4000)], "one": [7.5], "all equal": [3.0] * 900, "two thirds equal": [0.0] * 2000 + [rng.random() for _ in range(1000)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "x double").repartition(6)
    for most in (50, 100_000):
        assert aggregates.exact_median(df, "x", most) == statistics.median(values)


def test_median_of_nothing(spark):
    row = aggregates.summarise(spark.createDataFrame([(None,), (None,)], "x double"), "x").first()
    assert (row["median"], row["mean"], row["present"], row["missing"]) == (None, None, 0, 2)


def test_references_to_self_and_to_one_entity(spark):
    results = spark.createDataFrame([("F", "1", 10.0, {"wip": 1.0}), ("F", "2", 20.0, {"wip": 2.0, "x": 5.0}), ("F", "3", None, None), ("S", "1", 7.0, None)], "kpi_key string, entity_id string, value double, additional map<string,double>")
    entities = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    node = lambda **more: {"type": "formula", "id": "F", **more}
    value = lambda tree, r=results: {int(k): v for k, v in ((x["entity_id"], x["value"]) for x in ex.evaluate(tree, entities, "id", results=r).collect())}
    assert value(node()) == value(node(entityBinding="self")) == {1: 10.0, 2: 20.0, 3: None, 4: None}
    assert value(node(entityBinding="2")) == {1: 20.0, 2: 20.0, 3: 20.0, 4: 20.0}
    assert value(node(valueKey="wip")) == {1: 1.0, 2: 2.0, 3: None, 4: None}
    assert value(node(valueKey="x", entityBinding="2")) == dict.fromkeys((1, 2, 3, 4), 5.0)
    assert value(node(valueKey="gone", entityBinding="2")) == value(node(entityBinding="99")) == dict.fromkeys((1, 2, 3, 4))
    assert value({"type": "snippet", "id": "S", "entityBinding": "1"}) == dict.fromkeys((1, 2, 3, 4), 7.0)
    both = {"type": "operator", "operator": "subtract", "left": node(), "right": node(entityBinding="1", valueKey="wip")}
    assert value(both) == {1: 9.0, 2: 19.0, 3: None, 4: None}
    assert value(node(valueKey="wip"), results.drop("additional")) == dict.fromkeys((1, 2, 3, 4))


def test_cross_references_with_one_hot_key(spark):
    winners = spark.createDataFrame([("earner", "7", "Ann Lee"), ("earner", "9", "Ann Lee"), ("client", "1", "Acme"), ("matter", "5", "M5"), ("department", "2", "Tax")], "entity string, id string, name string")
    rows = [(i, None, "LEE, ann", None, "ACME", "5", None, "2", None) for i in range(300)] + [(900, 9, None, "1", None, None, "M5", None, "tax"), (901, 8, None, None, "Other", None, None, "3", "own"), (902, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "no int, lawyer_id int, lawyer_name string, client_id string, display_name string, matter_id string, matter_number string, department_id string, department string")
    got = {r["no"]: tuple(r)[1:] for r in joins.cross_reference(df, winners).collect()}
    assert got[0] == got[299] == (7, "LEE, ann", "1", "ACME", "5", "M5", "2", "Tax", ["matter_number", "lawyer_id", "client_id", "department"])
    assert got[900] == (9, "Ann Lee", "1", "Acme", "5", "M5", "2", "tax", ["matter_id", "lawyer_name", "display_name", "department_id"])
    assert got[901] == (8, None, None, "Other", None, None, "3", "own", []) and got[902] == (*[None] * 8, [])
    assert len(got) == 303


def test_a_look_up_reads_few_rows_of_a_snapshot(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "ROW_GROUP_BYTES", 64 << 10)
    n = 60_000
    rows = spark.range(n).select(F.lit("f").alias("firm_id"), F.lit("matter").alias("entity_type"), F.sha2(F.col("id").cast("string"), 256).alias("entity_id"), F.lit("K").alias("kpi_key"), F.col("id").cast("double").alias("kpi_value"),
                                 F.when(F.col("id") % 2 == 0, "green").otherwise("red").alias("rag_status"), F.lit("x").alias("display_value"), F.lit("current").alias("period"), F.current_timestamp().alias("pulled_at")).repartition(3)
    assert snapshots.replace(rows, str(tmp_path / "s")) == n
    wanted = rows.where("kpi_value = 777").first()["entity_id"]
    one = snapshots.entity_kpis(spark, str(tmp_path / "s"), "f", "matter", wanted)
    assert [r["kpi_value"] for r in one.collect()] == [777.0]
    report = snapshots.scan_report(snapshots.entity_kpis(spark, str(tmp_path / "s"), "f", "matter", wanted))
    assert report["files"] == 3 and 0 < report["rows"] < n / 4, report
    assert snapshots.formula_kpis(spark, str(tmp_path / "s"), "f", "none").collect() == []
    assert {tuple(r) for r in snapshots.rag_summary(snapshots.scan(spark, str(tmp_path / "s"), "f")).collect()} == {("K", n // 2, 0, n // 2, 0), ("all", n // 2, 0, n // 2, 0)}
