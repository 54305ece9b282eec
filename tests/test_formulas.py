"""The stored formula registry, and details whose cases are written out by hand."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import scalars as sc
from tallywright.operators import kpi, lists, quality
from tallywright.plans.domain import load
from tallywright.plans.kpi_queries import CONFIG, ref
from tallywright.operators import kpi_table
from tallywright.sources import formulas, snapshots, uploads

from .compare import TESTDATA

REF = lambda name: {"type": "formula", "id": name}
ONE = {"type": "constant", "value": 1}


def test_versions_deletion_and_refusals(spark, tmp_path):
    root = str(tmp_path)
    put = lambda name, tree, **more: formulas.store(spark, root, "f", name, tree, ["a"], {}, **more)
    assert formulas.current(spark, root, "f") == {}
    assert put("x", ONE) == 1 and put("x", {"type": "field", "field": "a"}) == 2 and put("y", REF("x")) == 1
    with pytest.raises(formulas.InvalidFormula, match="unknown field b"):
        put("z", {"type": "field", "field": "b"})
    with pytest.raises(formulas.InvalidFormula, match="unknown formula"):
        put("z", REF("nobody"))
    with pytest.raises(formulas.InvalidFormula, match="cycle"):
        put("x", REF("y"))
    with pytest.raises(formulas.InvalidFormula, match="built in"):
        put("F-1", ONE, built_in={"F-1"})
    with pytest.raises(formulas.InvalidFormula, match="read by y"):
        formulas.delete(spark, root, "f", "x")
    assert formulas.delete(spark, root, "f", "y") == 2 and formulas.delete(spark, root, "f", "x") == 3
    assert formulas.current(spark, root, "f") == {} and formulas.current(spark, root, "other") == {}
    assert put("y", ONE) == 3
    assert sorted((r["formula_id"], r["version"], r["is_current"]) for r in formulas.versions(spark, root, "f").collect()) == [("x", 1, False), ("x", 2, False), ("x", 3, True), ("y", 1, False), ("y", 2, False), ("y", 3, True)]


def test_templates(spark):
    template = {"type": "operator", "operator": "add", "left": {"type": "field", "field": "{{what}}"}, "right": {"type": "constant", "value": "{{n}}"}}
    assert formulas.instantiate(template, {"what": "a", "n": 3}, ["a"], {})["right"]["value"] == 3
    for parameters in ({"what": "b", "n": 3}, {"what": "a"}):
        with pytest.raises(formulas.InvalidFormula):
            formulas.instantiate(template, parameters, ["a"], {})


def test_chained_runs_and_changes(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 0.0)], "id int, a double")
    double = lambda name: {"type": "operator", "operator": "multiply", "left": REF(name), "right": {"type": "constant", "value": 2}}
    out = formulas.run({"c": double("b"), "b": double("a"), "a": {"type": "field", "field": "a"}}, df, "id")
    assert sorted(map(tuple, out.where("kpi_key = 'c'").collect()), key=str) == [("c", "1", 8.0), ("c", "2", None), ("c", "3", 0.0)]
    assert formulas.run({}, df, "id").collect() == []
    live = spark.createDataFrame([("1", 10.0), ("2", None), ("3", 4.0), ("4", 0.0), ("5", 2.0)], "entity_id string, value double")
    trial = spark.createDataFrame([("1", 15.0), ("2", 7.0), ("3", None), ("4", 1.0), ("6", None)], "entity_id string, value double")
    changed = formulas.changes(live, trial)
    assert {r["entity_id"]: (r["delta"], r["percent_change"]) for r in changed.collect()} == {"1": (5.0, 50.0), "2": (7.0, None), "3": (-4.0, None), "4": (1.0, None), "5": (-2.0, None), "6": (None, None)}
    assert tuple(formulas.summary(changed).first()) == (6, 3, 2, 1, 1.4)


def test_the_table_of_all_formulas_equals_the_single_ones(spark):
    p = load(spark, f"{TESTDATA}/sf0.001")
    rows = kpi_table.all_rows(p, CONFIG, ref())
    plans = [kpi.f_tu_02(p, ref()), kpi.f_rb_04(p), kpi.f_wl_02(p), kpi.f_pr_03(p, CONFIG), kpi.f_cs_01(p, CONFIG)]
    for one in plans:
        key = one.first()["kpi_key"]
        both = [sorted(map(tuple, x.select("entity_type", "entity_id", "value").collect()), key=str) for x in (rows.where(F.col("kpi_key") == key), one)]
        assert both[0] == both[1], key


def test_the_table_without_any_facts(spark):
    p = load(spark, f"{TESTDATA}/sf0.001")
    from dataclasses import replace

    bare = replace(p, time_entries=p.time_entries.where("false"), invoices=p.invoices.where("false"), disbursements=p.disbursements.where("false"))
    got = {(r["kpi_key"], r["entity_type"]): r["n"] for r in kpi_table.all_rows(bare, CONFIG, ref()).groupBy("kpi_key", "entity_type").agg(F.count("*").alias("n")).collect()}
    assert got["F-BS-01", "matter"] == p.matters.count() and ("F-RB-01", "matter") not in got
    earners = {r["entity_id"]: r["value"] for r in kpi_table.all_rows(bare, CONFIG, ref()).where("kpi_key = 'F-TU-02'").collect()}
    assert earners and set(earners.values()) == {None}


def test_result_texts(spark):
    cases = [(1234.5, "currency", "£1,234.50"), (2.345, "ratio", "2.35x"), (1234.5, "number", "1,235"), (12.25, "percentage", "12.3%"), (3.4, "days", "3 days"), (0.0, "boolean", "No"), (None, "currency", None)]
    for value, kind, text in cases:
        assert spark.createDataFrame([(value,)], "v double").select(sc.display_result(F.col("v"), kind)).first()[0] == text


def test_flags_and_filters(spark):
    flags = spark.createDataFrame([("A", "high", "matter", "1", "2001-01-03"), ("A", "medium", "matter", "2", "2001-01-09"), ("B", "high", "client", "3", "2001-01-05")], "flag string, severity string, entity_type string, entity_id string, flagged_at string")
    assert [r["entity_id"] for r in snapshots.flags_page(flags).collect()] == ["3", "1", "2"]
    assert [r["entity_id"] for r in snapshots.flags_page(flags, entity_type="matter", limit=1).collect()] == ["2"]
    assert tuple(snapshots.flag_counts(snapshots.flags_page(flags)).first()) == (3, 2, 1, 0, "2001-01-09")
    assert tuple(snapshots.flag_counts(flags.limit(0)).first()) == (0, 0, 0, 0, None)
    assert lists.filtered(flags, {"severity": ""}, {"flag": []}, {"entity_id": None}).count() == 3
    assert lists.filtered(flags, {"severity": "high"}, {"flag": ["B"]}).count() == 1


def test_calculation_status():
    cases = {(True, True, "x"): "calculating", (False, True, "x"): "error", (False, True, None): "stale", (False, False, "x"): "current"}
    assert {c: uploads.calculation_status(*c) for c in cases} == cases


def test_quality_of_nothing(spark):
    none = spark.createDataFrame([], "matched boolean, billable_value double, activity string, display_name string, date_paid date")
    row = quality.facts(none, none, none)
    kinds = {k for ks in quality.IMPACT.values() for k in ks}
    assert quality.entity_issues(row).collect() == [] and quality.gaps(row, kinds).collect() == [] and quality.advice(row, kinds).collect() == []
    assert [r["subject"] for r in quality.advice(row, set()).collect()] == ["feeEarner", "wipJson", "fullMattersJson", "invoicesJson", "closedMattersJson", "contactsJson"]
    assert quality.coverage(spark, {"wipJson"}).where("present").count() == 1
