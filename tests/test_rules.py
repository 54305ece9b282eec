"""Rules whose cases are written out by hand: no twin, no shared constants."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tallywright.operators import classify, expressions, lists, normalise, quality, transforms
from tallywright.sources import files, paged


def test_bands_by_kpi(spark):
    cases = [
        ("F-WL-02", 5.0, "green"), ("F-WL-02", 10.0, "amber"), ("F-WL-02", 10.1, "red"), ("F-WL-03", 90.0, "green"), ("F-WL-03", 80.0, "amber"), ("F-WL-03", 74.9, "red"),
        ("F-BS-01", 95.0, "amber"), ("F-BS-01", 95.1, "red"), ("F-WL-04", 60.0, "green"), ("F-TU-01", 74.9, "amber"), ("F-TU-01", None, "neutral"), ("F-WL-03", -1.0, "neutral"), ("F-XX-01", 1.0, "neutral"),
    ]
    rows = spark.createDataFrame([(k, "matter", str(i), v) for i, (k, v, _) in enumerate(cases)], "kpi_key string, entity_type string, entity_id string, value double")
    got = {int(r["entity_id"]): r["status"] for r in classify.evaluate(rows, classify.threshold_table(spark)).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(cases)}


def test_risk_rules(spark):
    cases = [
        ("F-WL-01", "matter", 30.0, {("WIP_AGE_HIGH", "medium"), ("DORMANT_MATTER", "medium")}), ("F-WL-01", "matter", 30.5, {("WIP_AGE_HIGH", "high"), ("DORMANT_MATTER", "medium")}), ("F-WL-01", "matter", 14.0, set()),
        ("F-WL-04", "firm", 31.0, {("WIP_AGE_HIGH", "high")}), ("F-BS-01", "matter", 86.0, {("BUDGET_BURN_CRITICAL", "high")}), ("F-BS-01", "matter", 85.0, {("BUDGET_BURN_CRITICAL", "medium")}),
        ("F-DM-01", "client", 61.0, {("DEBTOR_DAYS_HIGH", "high")}), ("F-DM-01", "client", 200.0, {("DEBTOR_DAYS_HIGH", "high")}), ("F-DM-01", "invoice", 91.0, {("DEBTOR_DAYS_HIGH", "high"), ("BAD_DEBT_RISK", "medium")}),
        ("F-DM-01", "invoice", 121.0, {("DEBTOR_DAYS_HIGH", "high"), ("BAD_DEBT_RISK", "high")}), ("F-WL-02", "feeEarner", 10.0, {("WRITE_OFF_SPIKE", "medium")}), ("F-WL-02", "firm", 10.5, {("WRITE_OFF_SPIKE", "high")}), ("F-WL-02", "matter", 50.0, set()),
    ]
    rows = spark.createDataFrame([(k, e, str(i), v) for i, (k, e, v, _) in enumerate(cases)], "kpi_key string, entity_type string, entity_id string, value double")
    got = {i: set() for i in range(len(cases))}
    for r in classify.risk_flags(rows).collect():
        got[int(r["entity_id"])].add((r["flag"], r["severity"]))
    assert got == {i: flags for i, (*_, flags) in enumerate(cases)}


def test_too_many_rejects_abort(spark):
    rows = spark.createDataFrame([("a", None), ("b", "blank row"), ("c", "blank row")], "x string, reject string")
    with pytest.raises(ValueError):
        normalise.abort_when_mostly_rejected(rows)
    assert normalise.abort_when_mostly_rejected(rows.limit(2)).count() == 1


def test_embedded_and_whole_placeholders():
    assert expressions.substitute({"a": "{{x}}", "b": ["of {{ y }} and {{x}}"]}, {"x": 3, "y": "z"}) == {"a": 3, "b": ["of z and 3"]}


def test_entries_join_by_number_only_without_ids(spark):
    matters = spark.createDataFrame([(1, "M1"), (None, "M2"), (3, "M3")], "matter_id long, matter_number string")
    entries = spark.createDataFrame([(1, "M9", "a"), (None, "M3", "b"), (2, "M2", "c"), (2, "M3", "d"), (None, None, "e")], "matter_id long, matter_number string, name string")
    got = sorted((r["own_number"], r["name"]) for r in lists.entries_of(matters, entries).collect())
    assert got == [("M1", "a"), ("M2", "c"), ("M3", "b")]


def test_empty_texts_and_missing_structs_of_api_records(spark):
    raw = spark.createDataFrame([("1", None, "COMPLETED"), ("2", ("9", ""), "QUOTE")], "_id string, department struct<_id:string,title:string>, status string")
    raw = raw.selectExpr("*", "1L as number", "'c' as case_name", "5.0D as financial_limit", *[f"cast(null as struct<_id:string,name:string,surname:string,rates:array<struct<value:double,default:boolean>>>) as {c}" for c in ("responsible_lawyer", "responsible_supervisor")],
                         "cast(null as struct<_id:string,title:string>) as case_type", "cast(null as array<struct<contact:struct<_id:string,display_name:string>>>) as clients")
    kinds = spark.createDataFrame([], "id string, title string, is_fixed_fee boolean")
    names = spark.createDataFrame([("9", "Property")], "id string, title string")
    got = {r["matter_id"]: (r["department_name"], r["is_active"], r["is_closed"], r["is_fixed_fee"], r["lawyer_name"], r["client_ids"]) for r in transforms.matters(raw, kinds, names).collect()}
    assert got == {"1": (None, False, True, False, None, []), "2": ("Property", True, False, False, None, [])}


def test_missing_chunks_are_waited_for(spark, tmp_path):
    spark.createDataFrame([(0, "a"), (2, "b")], "chunk int, x string").write.partitionBy("chunk").json(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        files.read_chunks(spark, str(tmp_path / "c"), 3)
    assert files.read_chunks(spark, str(tmp_path / "c"), 2).count() == 2


def test_pages_over_http_with_retries(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[1])
            asked.append(page)
            if page == 2 and asked.count(2) == 1:
                self.send_response(429)
                self.end_headers()
                return
            body = ('{"rows": [{"id": %d, "more": {"x": "a"}}, {"id": %d}], "next": %s}' % (page, page * 10, page + 1 if page < 3 else "null")).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/items?page={{page}}"
    by_page = paged.read_pages(spark, "id long, more struct<x:string>", url=url, pages="3", pause="0.01")
    assert sorted((r["id"], r["more"] and r["more"]["x"]) for r in by_page.collect()) == [(1, "a"), (2, "a"), (3, "a"), (10, None), (20, None), (30, None)]
    by_cursor = paged.read_pages(spark, "id long", url=url, cursor="next", token="t", pause="0.01")
    assert by_cursor.agg(F.sum("id")).first()[0] == 66
    server.shutdown()


def test_readiness_of_single_formulas(spark):
    have = spark.createDataFrame([("feeEarner", 1), ("timeEntry", 1), ("matter", 0)], "entity string, rows long")
    got = {r["formula"]: r["state"] for r in quality.readiness_states(have, ("workingDaysPerWeek", "bankHolidaysPerYear")).collect()}
    assert (got["F-TU-02"], got["F-TU-01"], got["F-RB-02"], got["F-WL-01"], got["SN-005"]) == ("READY", "PARTIAL", "PARTIAL", "BLOCKED", "BLOCKED")
