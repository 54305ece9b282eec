"""Small cases written out by hand, of functions whose queries run over tables elsewhere."""

from pyspark.sql import functions as F

from tallywright.functions import scalars as sc
from tallywright.operators import classify, expressions as ex, joins, quality
from tallywright.plans.domain import REF_DATE
from tallywright.plans.list_queries import mapping_issues
from tallywright.sources import files, snapshots


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_auto_map_levels(spark):
    headers = spark.createDataFrame([(x,) for x in ("Matter_Number", "Budgt", "Responsible", "Old Name", "zzz", "statis", "satus", "")], "header string")
    fields = spark.createDataFrame([("matterNumber", 0, True), ("budget", 1, False), ("lawyerName", 2, False), ("status", 3, True), ("stats", 4, False)], "field string, ordinal int, required boolean")
    got = rows(files.auto_map(headers, fields, {"responsible": "lawyername"}, {"Old Name": "status"}))
    assert got == sorted([
        ("Matter_Number", "matterNumber", "exact", True), ("Budgt", "budget", "fuzzy", False), ("Responsible", "lawyerName", "alias", False), ("Old Name", "status", "template", True),
        ("zzz", None, "unmapped", False), ("statis", "status", "fuzzy", True), ("satus", "status", "fuzzy", True), ("", None, "unmapped", False),
    ], key=str)  # of equally near fields the first; ``statis`` is one edit from both


def test_near_fields_meet_by_deletions_and_not_in_pairs(spark):
    headers = spark.createDataFrame([("x",)], "header string")
    fields = spark.createDataFrame([("y", 0)], "field string, ordinal int")
    plan = files.auto_map(headers, fields, {})._jdf.queryExecution().optimizedPlan().toString()
    physical = files.nearest_fields(headers.selectExpr("header", "header as n"), fields.selectExpr("field", "field as k", "ordinal"))._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" in plan and "NestedLoop" not in physical and "Cartesian" not in physical


def test_deletions_find_every_pair_within_two_edits(spark):
    words = ["", "a", "ab", "abc", "abcd", "bcda", "acbd", "xabcd", "abxxcd", "axbxcd", "abdc", "zzzz", "aabbccdd"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    d = df.select("w", F.explode(files.deletions(F.col("w"))).alias("k"))
    met = {tuple(r) for r in d.alias("a").join(d.alias("b"), "k").select("a.w", "b.w").distinct().collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    assert {(a, b) for a in words for b in words if edits(a, b) <= 2} <= met


def test_mapping_issues(spark):
    mapping = spark.createDataFrame([("a", "matterId"), ("b", "matterId"), ("c", "budget"), ("d", "zzz")], "header string, field string")
    fields = spark.createDataFrame([("matterId", True), ("status", True), ("budget", False)], "field string, required boolean")
    assert rows(mapping_issues(mapping, fields)) == [("duplicate", "matterId"), ("missing", "status"), ("unknown", "zzz")]


def test_dataset_detection(spark):
    samples = {"a": (["Matter Number", "matter_id", "Status", "department", "Budget"], "json"), "b": (["Pay Model", "name", "email"], "csv"), "c": (["billable"], "json"), "d": (["contact_id", "display.name"], "json")}
    want = {"a": ("fullMattersJson", "high"), "b": ("feeEarnerCsv", "medium"), "c": (None, "none"), "d": ("contactsJson", "medium")}
    assert {k: files.detect_dataset(*v) for k, v in samples.items()} == want
    frame = spark.createDataFrame([(k, h, form) for k, (hs, form) in samples.items() for h in hs], "upload string, header string, form string")
    assert {r["upload"]: (r["kind"], r["confidence"]) for r in files.detect_datasets(frame).collect()} == want


def test_configuration_round_trip():
    stored = snapshots.export_config({"hours": {"weekly": 35.0}, "share": 55})
    assert snapshots.import_config(stored, {"hours": {"weekly": 37.5, "days": 5}, "share": 60}) == {"hours": {"weekly": 35.0, "days": 5}, "share": 55}


def test_evaluation_order():
    ref = lambda i: {"type": "formula", "id": i}
    one = {"type": "constant", "value": 1}
    assert ex.evaluation_order({"b": ref("a"), "a": one, "c": {"type": "operator", "operator": "add", "left": ref("b"), "right": ref("a")}, "0": one}) == ["0", "a", "b", "c"]


def test_names_and_people(spark):
    people = spark.createDataFrame([(1, "Dr John Smith", 0), (2, "Ann Lee", 1), (3, "Jane Smith", 2)], "lawyer_id long, lawyer_name string, i int")
    raw = spark.createDataFrame([("a", "john smith"), ("b", "Mrs. Lee"), ("c", "J. Smith"), ("e", "Nobody Else"), ("f", None)], "k string, raw string")
    assert rows(joins.match_names(raw, people, "raw", "lawyer_name", "lawyer_id", "i").select("k", "lawyer_id", "level")) == [("a", 1, 1), ("b", 2, 2), ("c", 1, 2), ("e", None, None), ("f", None, None)]
    one = spark.createDataFrame([("Dr John Smith",)], "x string")
    assert set(one.select(sc.name_variants(F.col("x"))).first()[0]) == {"john smith", "smith, john", "smith john", "j smith", "j. smith", "smith j", "smith, j", "smith"}
    api = spark.createDataFrame([(1, "John Smith", "js@x", "A1"), (2, "Ann Lee", "AL@x", None), (3, "Bo Chan", None, None), (4, "Cy Young", None, None), (5, "Di Fox", None, None)], "id long, name string, email string, account_id string")
    extra = spark.createDataFrame([("Someone Else", None, "A1", 10.0), ("Other", "al@X", None, 20.0), ("bo  chan", None, None, 30.0), ("Cyril Young", None, None, 40.0), ("E Roe", None, None, 50.0)], "name string, email string, account_id string, salary double")
    assert rows(joins.merge_people(api, extra, ["salary"]).select("id", "salary", "matched_by")) == [(1, 10.0, 1), (2, 20.0, 2), (3, 30.0, 3), (4, 40.0, 4), (5, None, None)]


def test_utilisation_drop(spark):
    now = spark.createDataFrame([("F-TU-01", "feeEarner", "1", 40.0), ("F-TU-01", "feeEarner", "2", 75.0), ("F-TU-01", "feeEarner", "3", 99.0)], "kpi_key string, entity_type string, entity_id string, value double")
    before = spark.createDataFrame([("F-TU-01", "1", 80.0), ("F-TU-01", "2", 100.0), ("F-TU-01", "3", 100.0)], "kpi_key string, entity_id string, value double")
    assert rows(classify.risk_flags(now, before).select("flag", "severity", "entity_id", "value")) == [("UTILISATION_DROP", "high", "1", 50.0), ("UTILISATION_DROP", "medium", "2", 25.0)]


def test_effective_overrides(spark):
    stored = [(1, "rate", 10.0, "2000-01-01", None), (1, "rate", 9.0, "1999-01-01", "1999-12-31"), (1, "hours", 5.0, "2001-01-01", "2001-12-31"), (2, "rate", 7.0, "2002-01-01", None)]
    frame = spark.createDataFrame(stored, "id long, field string, value double, valid_from string, valid_to string")
    assert rows(quality.effective_overrides(frame, REF_DATE).select("id", F.explode("overrides").alias("field", "value"))) == [(1, "hours", 5.0), (1, "rate", 10.0)]


def test_upload_status(spark):
    uploads = spark.createDataFrame([("invoicesJson", "pending", "2001-02-01", 5), ("invoicesJson", "processed", "2001-01-01", 4), ("wipJson", "failed", "2001-01-03", 0)], "kind string, status string, uploaded string, rows long")
    got = rows(quality.upload_status(uploads, ["invoicesJson", "wipJson", "tasksJson"]).select("kind", "status", "uploaded", "rows"))
    assert got == [("invoicesJson", "processed", "2001-01-01", 4), ("tasksJson", "missing", None, 0), ("wipJson", "failed", "2001-01-03", 0)]


def test_working_days_need_both_days(spark):
    frame = spark.createDataFrame([("2024-01-05", "2024-01-08"), (None, "2024-01-08"), ("2024-01-05", None)], "a string, b string")
    assert [r[0] for r in frame.select(sc.working_days_between(F.to_date("a"), F.to_date("b"))).collect()] == [1, None, None]
