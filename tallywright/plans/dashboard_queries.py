"""Frames of the six dashboards, their CSV exports, and readiness of formulas, with DuckDB twins.

The twins spell every constant out by hand; they import none from the operators.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg
from ..operators import classify, kpi, lists, quality
from ..session import scratch_path
from ..sources import files, snapshots
from .domain import REF_DATE, load, rnd, sql
from .kpi_queries import CONFIG, LONG_NEEDS, _status, long_table, pct, ref, with_
from .list_queries import MD
from .practice_queries import MATTERS, d, matter_totals, n, plain

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, path: plain(run(load(spark, path)))
    ORACLE[name] = oracle


# --- firm overview ---------------------------------------------------------------------


def cards(kpis):
    """Means of utilisation and realisation, and the firm's lock-up, in one row."""
    of = lambda key, entity: F.when((F.col("kpi_key") == key) & (F.col("entity_type") == entity), F.col("value"))
    return kpis.agg(
        sc.js_round(F.avg(of("F-TU-01", "feeEarner")), 4).alias("utilisation"), sc.js_round(F.avg(of("F-RB-01", "matter")), 4).alias("realisation"), F.max(of("F-WL-04", "firm")).alias("lockup"))


add("qry_01_cards", lambda p: cards(long_table(p)), with_(f"""SELECT {rnd("avg(CASE WHEN kpi_key = 'F-TU-01' THEN value END)")} AS utilisation, {rnd("avg(CASE WHEN kpi_key = 'F-RB-01' THEN value END)")} AS realisation, max(CASE WHEN kpi_key = 'F-WL-04' THEN value END) AS lockup FROM kp""", *LONG_NEEDS))
add("qry_01_utilisation_counts", lambda p: classify.evaluate(long_table(p).where("kpi_key = 'F-TU-01'"), classify.threshold_table(p.matters.sparkSession)).groupBy("status").agg(F.count("*").alias("earners")),
    with_(f"SELECT {_status()} AS status, count(*) AS earners FROM kp WHERE kpi_key = 'F-TU-01' GROUP BY 1", *LONG_NEEDS))
_BAND = "CASE WHEN age_days IS NULL OR age_days <= 30 THEN '0-30' WHEN age_days <= 60 THEN '31-60' WHEN age_days <= 90 THEN '61-90' WHEN age_days <= 180 THEN '91-180' ELSE '180+' END"
_BANDS = "(VALUES (0, '0-30'), (1, '31-60'), (2, '61-90'), (3, '91-180'), (4, '180+')) AS b(position, band)"
add("qry_01_age_bands", lambda p: agg.band_histogram(matter_totals(p), F.coalesce(kpi.wip_band(F.col("age_days")), F.lit("0-30")), ["0-30", "31-60", "61-90", "91-180", "180+"], "billable").select("position", "band", "items", "value"),
    sql(f"SELECT CAST(position AS BIGINT) AS position, band, coalesce(items, 0) AS items, {d('value', 'value')} FROM {_BANDS} LEFT JOIN (SELECT {_BAND} AS band, count(*) AS items, sum(billable) AS value FROM mg GROUP BY 1) USING (band)", MATTERS))
add("qry_01_trend", lambda p: agg.monthly(p.invoices, "invoice_date", "total").select("month", "value"), sql(f"SELECT strftime(invoice_date, '%Y-%m') AS month, {d('sum(total)', 'value')} FROM iv GROUP BY 1 ORDER BY 1 DESC LIMIT 12"))
add("qry_01_departments", lambda p: matter_totals(p).where("billable > 0 or outstanding > 0").join(p.matter_departments, "matter_id").groupBy("department").agg(F.count("*").alias("matters"), agg.total("chargeable_value").alias("value")),
    sql(f"SELECT department, count(*) AS matters, {d('sum(chargeable_value)', 'value')} FROM mg JOIN md USING (matter_id) WHERE billable > 0 OR outstanding > 0 GROUP BY department", f"{MATTERS}, {MD}"))

# --- fee earners -----------------------------------------------------------------------


def earner_rows(p):
    """A row per fee earner with its measures, from one grouping of entries and one of invoices."""
    own = kpi.earner_measures(p, CONFIG, ref())
    return own.select(F.col("lawyer_id").cast("string").alias("entity_id"), "utilisation", "hourly_rate", F.col("kept").alias("revenue"), "gap_days", "profit", "department", "grade", "pay_model")


_ROWS = """er AS (SELECT CAST(lawyer_id AS VARCHAR) AS entity_id, department, grade, pay_model, {u} AS utilisation, {h} AS hourly_rate, {r} AS revenue, {g} AS gap_days, {p} AS profit
    FROM ep LEFT JOIN (SELECT lawyer_id, sum(CASE WHEN is_chargeable THEN minutes ELSE 0 END) AS m, max(entry_date) AS last FROM te GROUP BY lawyer_id) USING (lawyer_id))""".format(
    u=rnd(pct("coalesce(m, 0) / 60.0::DOUBLE", "1702.5")), h=rnd("g / nullif(coalesce(m, 0) / 60.0::DOUBLE, 0)"), r=rnd("g * sn_003"), p=rnd("profit"),
    g=rnd(f"CASE WHEN last IS NOT NULL THEN (SELECT count(*) FROM generate_series(last + 1, DATE '{REF_DATE}', INTERVAL 1 DAY) AS t(d) WHERE isodow(d) < 6) END"))
add("qry_02_rows", lambda p: earner_rows(p), with_("SELECT * FROM er", "rv", "sn", "ep").replace("\nSELECT * FROM er", f",\n{_ROWS}\nSELECT * FROM er"))
add("qry_02_alerts", lambda p: earner_rows(p).where("gap_days > 5").select("entity_id", "gap_days"), with_("SELECT * FROM er", "rv", "sn", "ep").replace("\nSELECT * FROM er", f",\n{_ROWS}\nSELECT entity_id, gap_days FROM er WHERE gap_days > 5"))
add("qry_02_filtered", lambda p: earner_rows(p).where("pay_model = 'FeeShare' and grade = 'Partner'").select("entity_id", "revenue"), with_("SELECT * FROM er", "rv", "sn", "ep").replace("\nSELECT * FROM er", f",\n{_ROWS}\nSELECT entity_id, revenue FROM er WHERE pay_model = 'FeeShare' AND grade = 'Partner'"))

# --- work in progress ------------------------------------------------------------------


def wip_headline(matters):
    """Unbilled work, the part older than 60 days with its share and status, the expected leakage of it, and the write-off rate."""
    old = F.col("age_days") > 60
    row = matters.agg(agg.total("billable").alias("unbilled"), agg.total("write_off").alias("write_off"), agg.total("billable", old).alias("at_risk"))
    share = F.coalesce(sc.percent(F.col("at_risk"), F.nullif(F.col("unbilled"), F.lit(0))), F.lit(0.0))
    return row.select(
        "unbilled", (F.col("unbilled") + F.col("write_off")).alias("gross"), "at_risk", sc.js_round(share, 4).alias("at_risk_percent"), classify.half_open(share, (30, 1e12), (15, 30)).alias("status"),
        sc.js_round(F.col("at_risk").cast("double") * 0.3).alias("leakage"), sc.js_round(F.coalesce(sc.percent(F.col("write_off"), F.nullif(F.col("unbilled"), F.lit(0))), F.lit(0.0)), 4).alias("write_off_rate"))


_OLD = "sum(CASE WHEN age_days > 60 THEN billable ELSE 0 END)"
_SHARE = pct("r", "u")
add("qry_03_headline", lambda p: wip_headline(matter_totals(p)),
    sql(f"""SELECT {d('u', 'unbilled')}, {d('u + w', 'gross')}, {d('r', 'at_risk')}, {rnd(_SHARE)} AS at_risk_percent, CASE WHEN {_SHARE} >= 30 THEN 'red' WHEN {_SHARE} >= 15 THEN 'amber' ELSE 'green' END AS status,
    {rnd('CAST(r AS DOUBLE) * 0.3::DOUBLE', 0)} AS leakage, {rnd(pct('w', 'u'))} AS write_off_rate FROM (SELECT sum(billable) AS u, sum(write_off) AS w, {_OLD} AS r FROM mg)""", MATTERS))
add("qry_03_exposure", lambda p: p.disbursements.groupBy("matter_id").agg(agg.total("exposure").alias("value"), F.max("age_days").alias("age")).where("value > 0"),
    sql(f"SELECT matter_id, {d('sum(exposure)', 'value')}, CAST(max(age_days) AS BIGINT) AS age FROM di GROUP BY matter_id HAVING sum(exposure) > 0"))

# --- billing ---------------------------------------------------------------------------

add("qry_04_aged_debtors", lambda p: agg.band_histogram(p.invoices.where("outstanding > 0"), sc.banded(F.greatest(F.lit(0), F.coalesce("days_overdue", F.lit(0))), [("0-30", 30), ("31-60", 60), ("61-90", 90), ("91-120", 120), ("120+", None)]), ["0-30", "31-60", "61-90", "91-120", "120+"], "outstanding").select("position", "band", "items", "value"),
    sql(f"""SELECT CAST(position AS BIGINT) AS position, band, coalesce(items, 0) AS items, {d('value', 'value')} FROM (VALUES (0, '0-30'), (1, '31-60'), (2, '61-90'), (3, '91-120'), (4, '120+')) AS b(position, band)
    LEFT JOIN (SELECT CASE WHEN days_overdue <= 30 THEN '0-30' WHEN days_overdue <= 60 THEN '31-60' WHEN days_overdue <= 90 THEN '61-90' WHEN days_overdue <= 120 THEN '91-120' ELSE '120+' END AS band, count(*) AS items, sum(outstanding) AS value FROM iv WHERE outstanding > 0 GROUP BY 1) USING (band)"""))
add("qry_04_trend", lambda p: p.invoices.groupBy(sc.month_key(F.col("invoice_date")).alias("month")).agg(agg.total("total").alias("invoiced"), agg.total(F.col("total") - F.col("outstanding")).alias("collected")).orderBy(F.desc("month")).limit(12),
    sql(f"SELECT strftime(invoice_date, '%Y-%m') AS month, {d('sum(total)', 'invoiced')}, {d('sum(total - outstanding)', 'collected')} FROM iv GROUP BY 1 ORDER BY 1 DESC LIMIT 12"))
add("qry_04_invoice_rows", lambda p: lists.page_with_total(p.invoices.select("invoice_id", "outstanding", lists.invoice_rag(F.col("outstanding"), F.col("days_overdue") > 0).alias("rag")), [F.asc("invoice_id")], 50),
    sql(f"SELECT invoice_id, {d('outstanding', 'outstanding')}, CASE WHEN outstanding > 0 AND days_overdue > 0 THEN 'red' WHEN outstanding > 0 THEN 'amber' ELSE 'green' END AS rag, total FROM (SELECT invoice_id, outstanding, days_overdue, count(*) OVER () AS total FROM iv) x ORDER BY invoice_id LIMIT 50"))

# --- matters ---------------------------------------------------------------------------


def risk_list(matters, most: int = 20):
    """The first matters at risk, oldest work first, each with its first issue."""
    burn = F.when(F.col("budget") > 0, sc.percent(F.col("billable"), F.col("budget")))
    real = F.when((F.col("net_billing") > 0) & (F.col("billable") > 0), sc.percent(F.col("net_billing"), F.col("billable")))
    issue = F.when(burn > 100, F.concat(F.lit("Budget "), sc.js_round(burn).cast("long").cast("string"), F.lit("% consumed"))).when(
        real < 70, F.concat(F.lit("Realisation "), sc.js_round(real).cast("long").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("WIP age "), F.coalesce("age_days", F.lit(0)).cast("string"), F.lit(" days")))
    at_risk = F.coalesce(F.col("age_days") > 60, F.lit(False)) | F.coalesce(burn > 100, F.lit(False)) | F.coalesce(real < 70, F.lit(False))
    return matters.where(at_risk).orderBy(F.col("age_days").desc_nulls_last(), F.asc("matter_id")).limit(most).select("matter_id", issue.alias("issue"), F.col("billable").alias("value"))


_B, _R = pct("billable", "budget"), pct("net_billing", "billable")
add("qry_05_risk_list", lambda p: risk_list(matter_totals(p)),
    sql(f"""SELECT matter_id, CASE WHEN b > 100 THEN 'Budget ' || CAST(floor(b + 0.5) AS BIGINT) || '% consumed' WHEN r < 70 THEN 'Realisation ' || CAST(floor(r + 0.5) AS BIGINT) || '%' ELSE 'WIP age ' || coalesce(age_days, 0) || ' days' END AS issue, {d('billable', 'value')} FROM (
    SELECT *, CASE WHEN budget > 0 THEN {_B} END AS b, CASE WHEN net_billing > 0 AND billable > 0 THEN {_R} END AS r FROM mg) WHERE age_days > 60 OR b > 100 OR r < 70 ORDER BY age_days DESC NULLS LAST, matter_id LIMIT 20""", MATTERS))
add("qry_05_headline", lambda p: matter_totals(p).agg(F.count_if((F.col("billable") > 0) | (F.col("outstanding") > 0)).alias("active"), agg.total("billable").alias("value"), sc.js_round(F.avg("age_days"), 4).alias("mean_age"),
    sc.js_round(F.avg(F.when((F.col("billable") > 0) & (F.col("net_billing") > 0), sc.percent(F.col("net_billing"), F.col("billable")))), 4).alias("mean_realisation")),
    sql(f"SELECT CAST(count(*) FILTER (billable > 0 OR outstanding > 0) AS BIGINT) AS active, {d('sum(billable)', 'value')}, {rnd('avg(age_days)')} AS mean_age, {rnd(f'avg(CASE WHEN billable > 0 AND net_billing > 0 THEN {_R} END)')} AS mean_realisation FROM mg", MATTERS))

# --- clients ---------------------------------------------------------------------------


def client_headline(clients):
    """(what, client_id, amount): how many clients, the one with the largest billing, and the one with the largest debt."""
    top = lambda column, what: clients.where(F.col(column) > 0).orderBy(F.desc(column), "client_id").limit(1).select(F.lit(what).alias("what"), "client_id", F.col(column).cast("double").alias("amount"))
    count = clients.agg(F.lit("clients").alias("what"), F.lit(None).cast("long").alias("client_id"), F.count("*").cast("double").alias("amount"))
    return count.unionByName(top("net_billing", "top client")).unionByName(top("outstanding", "most at risk"))


_CL = "cg AS (SELECT cl.client_id, coalesce(sum(net_billing), 0) AS b, coalesce(sum(outstanding), 0) AS o FROM cl LEFT JOIN mg USING (client_id) GROUP BY cl.client_id)"
add("qry_06_headline", lambda p: client_headline(agg.clients(p.clients, matter_totals(p))),
    sql("SELECT 'clients' AS what, CAST(NULL AS BIGINT) AS client_id, CAST(count(*) AS DOUBLE) AS amount FROM cg UNION ALL SELECT * FROM (SELECT 'top client', client_id, CAST(b AS DOUBLE) FROM cg WHERE b > 0 ORDER BY b DESC, client_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'most at risk', client_id, CAST(o AS DOUBLE) FROM cg WHERE o > 0 ORDER BY o DESC, client_id LIMIT 1)", f"{MATTERS}, {_CL}"))
add("qry_06_departments", lambda p: p.matters.join(p.matter_departments, "matter_id").groupBy("client_id").agg(F.array_join(F.sort_array(F.collect_set("department")), "|").alias("departments"), F.count("*").alias("matters")),
    sql("SELECT client_id, string_agg(DISTINCT department, '|' ORDER BY department) AS departments, count(*) AS matters FROM ma JOIN md USING (matter_id) GROUP BY client_id", MD))

# --- exports ---------------------------------------------------------------------------


def exports(p):
    """A frame of each dashboard, as its CSV export has it."""
    totals = matter_totals(p)
    return {
        "firm": agg.monthly(p.invoices, "invoice_date", "total"), "earners": p.fee_earners.select("lawyer_id", "lawyer_name", "department", "grade"), "wip": totals.where("billable > 0").select("matter_id", "billable", "age_days"),
        "billing": p.invoices.where("outstanding > 0").select("invoice_id", "outstanding", "due_date"), "matters": totals.select("matter_id", "status", "budget"), "clients": agg.clients(p.clients, totals).select("client_id", "matters", "net_billing"),
    }


def _exported(p):
    spark, out = p.matters.sparkSession, None
    for name, frame in exports(p).items():
        path = scratch_path(spark, f"export-{name}")
        snapshots.write_csv(frame, path)
        read = files.read_csv(spark, path)
        own = read.select(F.lit(name).alias("dashboard"), *[F.col(f"`{column}`").alias(f"c{i}") for i, column in enumerate(read.columns)])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.select("dashboard", *[sc.coerce_string(F.col(f"c{i}")).alias(f"c{i}") for i in range(4)])


_TEXT = lambda *columns: ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
_TOTAL = lambda c: f"CAST(coalesce({c}, 0) AS DECIMAL(38,4))"
add("snk_08_dashboards", _exported, sql(f"""
SELECT 'firm' AS dashboard, month AS c0, {_TEXT(_TOTAL('total'))} AS c1, {_TEXT('n')} AS c2, NULL AS c3 FROM (SELECT strftime(invoice_date, '%Y-%m') AS month, sum(total) AS total, count(*) AS n FROM iv GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
UNION ALL SELECT 'earners', {_TEXT('lawyer_id', 'lawyer_name', 'department', 'grade')} FROM fe UNION ALL SELECT 'wip', {_TEXT('matter_id', _TOTAL('billable'), 'age_days')}, NULL FROM mg WHERE billable > 0
UNION ALL SELECT 'billing', {_TEXT('invoice_id', 'outstanding', 'due_date')}, NULL FROM iv WHERE outstanding > 0 UNION ALL SELECT 'matters', {_TEXT('matter_id', 'status', 'budget')}, NULL FROM ma
UNION ALL SELECT 'clients', {_TEXT('client_id', 'count(matter_id)', _TOTAL('sum(net_billing)'))}, NULL FROM cl LEFT JOIN mg USING (client_id) GROUP BY client_id""", MATTERS))
add("snk_11_sorted_table", lambda p: _sorted_export(p), sql(f"SELECT invoice_id, {d('outstanding', 'outstanding')} FROM iv WHERE outstanding > 0"))


def _sorted_export(p):
    """The sorted, visible columns of a table as CSV, read back."""
    spark, path = p.matters.sparkSession, scratch_path(p.matters.sparkSession, "table")
    snapshots.write_csv(p.invoices.where("outstanding > 0"), path, ["invoice_id", "outstanding"], [F.desc("outstanding"), F.asc("invoice_id")])
    return files.read_csv(spark, path).select(F.col("invoice_id").cast("long").alias("invoice_id"), F.col("outstanding").cast("double").alias("outstanding"))


def _order_of_export(p):
    """(rows, fallen): rows of a sorted table's files, and how many are larger than the row before, also over the border of two files."""
    spark, path = p.matters.sparkSession, scratch_path(p.matters.sparkSession, "table")
    snapshots.write_csv(p.invoices.where("outstanding > 0"), path, ["invoice_id", "outstanding"], [F.desc("outstanding"), F.asc("invoice_id")])
    lines = spark.read.option("header", True).csv(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("outstanding").cast("decimal(18,4)").alias("v"))
    inside = lines.withColumn("before", F.lag("v").over(W.partitionBy("file").orderBy("at"))).groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("v") > F.col("before")).alias("bad"), F.max("v").alias("most"), F.min("v").alias("least"))
    return inside.withColumn("end", F.lag("least").over(W.orderBy("file"))).agg(F.sum("n").alias("rows"), F.sum(F.col("bad") + F.when(F.col("most") > F.col("end"), 1).otherwise(0)).alias("fallen"))  # a row a file


add("snk_11_order", _order_of_export, sql("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS fallen FROM iv WHERE outstanding > 0"))

# --- readiness -------------------------------------------------------------------------


def _readiness(p):
    """States where disbursements are not there, and neither are salaries nor a cost-rate method."""
    have = {"feeEarner": p.fee_earners, "timeEntry": p.time_entries, "matter": p.matters, "invoice": p.invoices, "client": p.clients, "department": p.matter_departments, "disbursement": p.disbursements.where("false")}
    out = None
    for name, frame in have.items():
        own = frame.limit(1).agg(F.lit(name).alias("entity"), F.count("*").alias("rows"))
        out = own if out is None else out.unionByName(own)
    settings = ("weeklyTargetHours", "workingDaysPerWeek", "annualLeaveEntitlement", "bankHolidaysPerYear", "defaultFirmRetainPercent", "utilisationApproach", "revenueAttribution", "scorecardWeights")
    return quality.readiness_states(out, settings)


_STATES = {
    "READY": ("F-TU-02", "F-TU-03", "F-RB-04", "F-WL-04", "F-PR-03", "F-PR-04", "F-PR-05", "F-BS-02", "F-CS-01", "F-CS-02", "SN-002", "SN-003"), "ENHANCED": ("F-RB-01", "F-RB-02", "F-RB-03", "F-WL-01", "F-WL-02", "F-BS-01", "F-DM-01"),
    "PARTIAL": ("F-TU-01", "F-DM-02", "SN-001", "SN-004"), "BLOCKED": ("F-WL-03", "F-PR-01", "F-PR-02", "F-CS-03", "SN-005"),
}
add("rdy_01_states", _readiness, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{s}')" for s, ks in _STATES.items() for k in ks) + ") AS t(formula, state)")
