"""Joins, aggregations, windows and dashboards over the domain views, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg
from ..operators import dashboards, joins, kpi
from ..operators.kpi import WIP_BANDS
from .domain import REF_DATE, load, rnd, sql
from .kpi_queries import CAST_D, LONG_NEEDS, long_table, pct, ref, with_

QUERIES: dict = {}
ORACLE: dict = {}
MONEY = ("billable", "chargeable_value", "write_off", "net_billing", "invoiced", "outstanding", "paid", "revenue", "orphan_value", "orphaned_value", "value")


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: plain(run(load(spark, d)))
    ORACLE[name] = oracle


def plain(df):
    """Decimals as doubles, dates as text, counts as longs: types that both engines agree on."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append(c.cast("double").alias(name) if kind.startswith("decimal") else c.cast("string").alias(name) if kind == "date" else c.cast("long").alias(name) if kind == "int" else c)
    return df.select(*out)


def d(x: str, name: str) -> str:
    return f"{CAST_D(f'coalesce({x}, 0)')} AS {name}"


def n(x: str, name: str) -> str:
    return f"CAST(coalesce({x}, 0) AS BIGINT) AS {name}"


TM = """tm AS (SELECT matter_id, sum(minutes) AS minutes, sum(CASE WHEN is_chargeable THEN minutes ELSE 0 END) AS chargeable_minutes, sum(CASE WHEN NOT is_chargeable THEN minutes ELSE 0 END) AS other_minutes,
  sum(billable_value) AS billable, sum(CASE WHEN is_chargeable THEN billable_value ELSE 0 END) AS chargeable_value, sum(write_off) AS write_off, count(*) AS entries, min(entry_date) AS oldest, max(entry_date) AS newest, max(age_days) AS age_days
  FROM te GROUP BY matter_id)"""
IM = """im AS (SELECT matter_id, count(*) AS invoices, sum(subtotal) AS net_billing, sum(total) AS invoiced, sum(outstanding) AS outstanding, sum(total - outstanding) AS paid, max(invoice_date) AS latest_invoice FROM iv GROUP BY matter_id)"""
MA = f"""mg AS (SELECT ma.*, {n('minutes', 'minutes')}, {n('chargeable_minutes', 'chargeable_minutes')}, {n('other_minutes', 'other_minutes')}, coalesce(billable, 0) AS billable, coalesce(chargeable_value, 0) AS chargeable_value,
  coalesce(write_off, 0) AS write_off, {n('entries', 'entries')}, oldest, newest, age_days, {n('invoices', 'invoices')}, coalesce(net_billing, 0) AS net_billing, coalesce(invoiced, 0) AS invoiced, coalesce(outstanding, 0) AS outstanding, coalesce(paid, 0) AS paid, latest_invoice
  FROM ma LEFT JOIN tm USING (matter_id) LEFT JOIN im USING (matter_id))"""
MATTERS = f"{TM}, {IM}, {MA}"
FG = """fg AS (SELECT fe.*, coalesce(minutes, 0) AS minutes, coalesce(chargeable_minutes, 0) AS chargeable_minutes, coalesce(billable, 0) AS billable, coalesce(write_off, 0) AS write_off, coalesce(matters, 0) AS matters,
  coalesce(orphan_minutes, 0) AS orphan_minutes, coalesce(orphan_value, 0) AS orphan_value, coalesce(entries, 0) AS entries, newest, coalesce(revenue, 0) AS revenue, coalesce(outstanding, 0) AS outstanding, coalesce(invoices, 0) AS invoices
  FROM fe LEFT JOIN (SELECT lawyer_id, sum(minutes) AS minutes, sum(CASE WHEN is_chargeable THEN minutes ELSE 0 END) AS chargeable_minutes, sum(billable_value) AS billable, sum(write_off) AS write_off, count(DISTINCT CASE WHEN matched THEN matter_id END) AS matters,
     sum(CASE WHEN NOT matched THEN minutes ELSE 0 END) AS orphan_minutes, sum(CASE WHEN NOT matched THEN billable_value ELSE 0 END) AS orphan_value, count(*) AS entries, max(entry_date) AS newest FROM te GROUP BY lawyer_id) USING (lawyer_id)
  LEFT JOIN (SELECT lawyer_id, sum(subtotal) AS revenue, sum(outstanding) AS outstanding, count(*) AS invoices FROM iv GROUP BY lawyer_id) USING (lawyer_id))"""


def matter_totals(p):
    return agg.matters(p.matters, p.time_entries, p.invoices)


def earner_totals(p):
    return agg.fee_earners(p.fee_earners, p.time_entries, p.invoices, ref())


add("agg_01_matter", lambda p: matter_totals(p).select("matter_id", "minutes", "chargeable_minutes", "other_minutes", "billable", "chargeable_value", "write_off", "entries", "oldest", "newest", "age_days", "invoices", "net_billing", "invoiced", "outstanding", "paid", "latest_invoice", "discrepancy"),
    sql(f"""SELECT matter_id, minutes, chargeable_minutes, other_minutes, {d('billable', 'billable')}, {d('chargeable_value', 'chargeable_value')}, {d('write_off', 'write_off')}, entries, CAST(oldest AS VARCHAR) AS oldest, CAST(newest AS VARCHAR) AS newest,
    CAST(age_days AS BIGINT) AS age_days, invoices, {d('net_billing', 'net_billing')}, {d('invoiced', 'invoiced')}, {d('outstanding', 'outstanding')}, {d('paid', 'paid')}, CAST(latest_invoice AS VARCHAR) AS latest_invoice,
    CASE WHEN billable > 0 AND net_billing > 0 THEN CASE WHEN {CAST_D('abs(billable - net_billing)')} / {CAST_D('billable')} > 0.1 THEN 'major' ELSE 'minor' END END AS discrepancy FROM mg""", MATTERS))
add("agg_03_fee_earner", lambda p: earner_totals(p).select("lawyer_id", "department", "minutes", "chargeable_minutes", "billable", "write_off", "matters", "orphan_minutes", "orphan_value", "entries", "revenue", "outstanding", "invoices", "gap_days"),
    sql(f"""SELECT lawyer_id, department, {n('minutes', 'minutes')}, {n('chargeable_minutes', 'chargeable_minutes')}, {d('billable', 'billable')}, {d('write_off', 'write_off')}, {n('matters', 'matters')}, {n('orphan_minutes', 'orphan_minutes')}, {d('orphan_value', 'orphan_value')},
    {n('entries', 'entries')}, {d('revenue', 'revenue')}, {d('outstanding', 'outstanding')}, {n('invoices', 'invoices')}, CAST(greatest(0, date_diff('day', newest, DATE '{REF_DATE}')) AS BIGINT) AS gap_days FROM fg""", FG))
CG = "cg AS (SELECT client_id, count(*) AS matters, sum(billable) AS billable, sum(net_billing) AS net_billing, sum(outstanding) AS outstanding, sum(paid) AS paid, max(age_days) AS oldest_days FROM mg GROUP BY client_id)"
CLIENT_COLUMNS = f"{n('matters', 'matters')}, {d('billable', 'billable')}, {d('net_billing', 'net_billing')}, {d('outstanding', 'outstanding')}, {d('paid', 'paid')}, CAST(oldest_days AS BIGINT) AS oldest_days"
add("agg_04_client", lambda p: agg.clients(p.clients, matter_totals(p)), sql(f"SELECT cl.client_id, display_name, segment, {CLIENT_COLUMNS} FROM cl LEFT JOIN cg USING (client_id)", f"{MATTERS}, {CG}"))
add("agg_05_department", lambda p: agg.departments(earner_totals(p), matter_totals(p).join(p.matter_departments, "matter_id", "left")), sql(f"SELECT department, fee_earners, {n('minutes', 'minutes')}, billable, revenue, outstanding FROM (SELECT department, count(*) AS fee_earners, {d('sum(billable)', 'billable')}, {d('sum(revenue)', 'revenue')}, {d('sum(outstanding)', 'outstanding')} FROM fg GROUP BY department) LEFT JOIN (SELECT n_name AS department, sum(minutes) AS minutes FROM te JOIN orders ON matter_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) USING (department)", FG))
_ORPHAN = "sum(CASE WHEN NOT matched THEN billable_value ELSE 0 END)"
add("agg_06_firm", lambda p: agg.firm(p.time_entries, p.invoices).withColumn("orphan_percent", sc.js_round(F.col("orphan_percent"), 4)),
    sql(f"""SELECT * FROM (SELECT {n('sum(minutes)', 'minutes')}, {d('sum(billable_value)', 'billable')}, {d('sum(write_off)', 'write_off')}, count(*) AS entries, CAST(count(*) FILTER (NOT matched) AS BIGINT) AS orphan_entries, {d(_ORPHAN, 'orphan_value')},
    {rnd(pct(_ORPHAN, 'sum(billable_value)'))} AS orphan_percent FROM te), (SELECT count(*) AS invoices, {d('sum(subtotal)', 'net_billing')}, {d('sum(outstanding)', 'outstanding')} FROM iv)"""))
add("agg_07_join_statistics", lambda p: agg.join_statistics(p.time_entries), sql(f"SELECT CAST(count(*) FILTER (matched) AS BIGINT) AS matched, CAST(count(*) FILTER (NOT matched) AS BIGINT) AS orphaned, {d(_ORPHAN, 'orphaned_value')} FROM te"))
add("agg_08_field_statistics", lambda p: agg.field_statistics(p.matters, ["client_id", "status", "budget", "case_type"]),
    sql(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS rows, CAST(count(*) FILTER ({f} IS NULL) AS BIGINT) AS missing, count(DISTINCT {f}) AS distinct_values FROM ma" for f in ("client_id", "status", "budget", "case_type"))))
add("agg_10_activity", lambda p: agg.activity_breakdown(p.with_activity(), "lawyer_id").select("lawyer_id", F.explode("activities").alias("activity", "a")).select("lawyer_id", "activity", "a.hours", "a.value"),
    sql(f"SELECT lawyer_id, coalesce(activity, '__unknown__') AS activity, {rnd('sum(minutes) / 60.0::DOUBLE')} AS hours, {d('sum(billable_value)', 'value')} FROM te GROUP BY ALL"))
add("agg_11_invoices_by_matter", lambda p: agg.invoices_by(p.invoices, "matter_id"), sql(f"SELECT matter_id, invoices, {d('net_billing', 'net_billing')}, {d('invoiced', 'invoiced')}, {d('outstanding', 'outstanding')}, {d('paid', 'paid')}, CAST(latest_invoice AS VARCHAR) AS latest_invoice FROM im", IM))
add("agg_13_recording_gap", lambda p: p.time_entries.groupBy("lawyer_id").agg(F.greatest(F.lit(0), F.datediff(ref(), F.max("entry_date"))).alias("gap_days")), sql("SELECT lawyer_id, CAST(greatest(0, min(age_days)) AS BIGINT) AS gap_days FROM te GROUP BY lawyer_id"))
add("agg_14_summary", lambda p: agg.summarise(kpi.f_rb_01(p), "value").select(*[sc.js_round(F.col(c), 2).alias(c) for c in ("mean", "median", "least", "most", "total")], "present", "missing"),
    with_(f"SELECT {', '.join(f'{rnd(x, 2)} AS {a}' for x, a in (('avg(value)', 'mean'), ('median(value)', 'median'), ('min(value)', 'least'), ('max(value)', 'most'), ('sum(value)', 'total')))}, count(value) AS present, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS missing FROM (SELECT {rnd(pct('coalesce(net, 0)', 'wip'))} AS value FROM ma JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) WHERE wip > 0)", "wm", "nm"))
_AGE_CASE = "CASE " + " ".join(f"WHEN age_days <= {u} THEN '{b}'" for b, u, _ in WIP_BANDS if u) + f" ELSE '{WIP_BANDS[-1][0]}' END"
_POSITIONS = "(VALUES " + ", ".join(f"({i}, '{b}')" for i, (b, _, _) in enumerate(WIP_BANDS)) + ") AS b(position, band)"
add("agg_17_age_bands", lambda p: agg.band_histogram(p.time_entries.where("matched"), kpi.wip_band(F.col("age_days")), [b for b, _, _ in WIP_BANDS], "billable_value").withColumn("share", sc.js_round(F.col("share"), 4)),
    sql(f"SELECT band, CAST(position AS BIGINT) AS position, coalesce(items, 0) AS items, {d('value', 'value')}, {rnd(pct('coalesce(value, 0)', '(sum(value) OVER ())'))} AS share FROM {_POSITIONS} LEFT JOIN (SELECT {_AGE_CASE} AS band, count(*) AS items, sum(billable_value) AS value FROM te WHERE matched GROUP BY 1) USING (band)"))
add("agg_18_monthly", lambda p: agg.monthly(p.invoices, "invoice_date", "subtotal"), sql(f"SELECT strftime(invoice_date, '%Y-%m') AS month, {d('sum(subtotal)', 'value')}, count(*) AS items FROM iv GROUP BY 1 ORDER BY 1 DESC LIMIT 12"))
add("agg_19_grouped_entries", lambda p: p.time_entries.groupBy("lawyer_id").agg(agg.total("billable_value").alias("value"), agg.hours(agg.total("minutes")).alias("hours"), sc.js_round(F.avg("age_days"), 4).alias("mean_age"), F.count("*").alias("items")),
    sql(f"SELECT lawyer_id, {d('sum(billable_value)', 'value')}, {rnd('sum(minutes) / 60.0::DOUBLE')} AS hours, {rnd('avg(age_days)')} AS mean_age, count(*) AS items FROM te GROUP BY lawyer_id"))
add("agg_20_case_types", lambda p: matter_totals(p).groupBy("case_type", "status").agg(F.count("*").alias("matters"), agg.total("billable").alias("billable"), sc.js_round(F.avg(F.when(F.col("age_days") > 0, F.col("age_days"))), 4).alias("mean_age")),
    sql(f"SELECT case_type, status, count(*) AS matters, {d('sum(billable)', 'billable')}, {rnd('avg(CASE WHEN age_days > 0 THEN age_days END)')} AS mean_age FROM mg GROUP BY ALL", MATTERS))
add("agg_21_exposure", lambda p: p.disbursements.groupBy("matter_id").agg(agg.total("exposure").alias("value"), F.max("age_days").alias("oldest_days")), sql(f"SELECT matter_id, {d('sum(exposure)', 'value')}, CAST(max(age_days) AS BIGINT) AS oldest_days FROM di GROUP BY matter_id"))
add("agg_23_coverage", lambda p: p.time_entries.agg(sc.js_round(sc.percent(F.count_if(F.col("matched")), F.count("*")), 4).alias("coverage"), sc.js_round(sc.percent(F.count_if(~F.col("matched")), F.count("*")), 4).alias("orphan_rate"), F.countDistinct(F.when(~F.col("matched"), F.col("matter_id"))).alias("unresolved")),
    sql(f"SELECT {rnd(pct('count(*) FILTER (matched)', 'count(*)'))} AS coverage, {rnd(pct('count(*) FILTER (NOT matched)', 'count(*)'))} AS orphan_rate, count(DISTINCT CASE WHEN NOT matched THEN matter_id END) AS unresolved FROM te"))
add("agg_24_wip_totals", lambda p: p.time_entries.agg(agg.total("billable_value").alias("value"), agg.total("billable_value", F.col("is_chargeable")).alias("chargeable_value"), agg.total("billable_value", ~F.col("matched")).alias("orphan_value"), F.count("*").alias("entries")),
    sql(f"SELECT {d('sum(billable_value)', 'value')}, {d('sum(CASE WHEN is_chargeable THEN billable_value END)', 'chargeable_value')}, {d(_ORPHAN, 'orphan_value')}, count(*) AS entries FROM te"))
add("agg_25_mode", lambda p: agg.mode(p.with_activity(), "lawyer_id", "activity", "entry_date"), sql("SELECT lawyer_id, activity, n FROM (SELECT *, row_number() OVER (PARTITION BY lawyer_id ORDER BY n DESC, seen, activity) AS rn FROM (SELECT lawyer_id, activity, count(*) AS n, min(entry_date) AS seen FROM te GROUP BY ALL)) WHERE rn = 1"))
add("agg_27_preload", lambda p: p.time_entries.groupBy("lawyer_id").agg(agg.hours(agg.total("minutes", F.col("is_chargeable"))).alias("hours")), sql(f"SELECT lawyer_id, {rnd('sum(CASE WHEN is_chargeable THEN minutes ELSE 0 END) / 60.0::DOUBLE')} AS hours FROM te GROUP BY lawyer_id"))
add("agg_28_difference", lambda p: joins.difference(kpi.f_rb_01(p), kpi.f_rb_01(p, "adjusted_fixed_fee")).agg(F.count_if(F.col("delta") != 0).alias("affected"), F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("declined"), F.count_if(F.col("delta") == 0).alias("unchanged")),
    with_(f"SELECT CAST(count(*) FILTER (d <> 0) AS BIGINT) AS affected, CAST(count(*) FILTER (d > 0) AS BIGINT) AS improved, CAST(count(*) FILTER (d < 0) AS BIGINT) AS declined, CAST(count(*) FILTER (d = 0) AS BIGINT) AS unchanged FROM (SELECT CASE WHEN is_fixed_fee THEN 100.0::DOUBLE - v ELSE 0 END AS d FROM (SELECT is_fixed_fee, {rnd(pct('coalesce(net, 0)', 'wip'))} AS v FROM ma JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) WHERE wip > 0))", "wm", "nm"))
add("agg_29_heatmap", lambda p: dashboards.heatmap(p.time_entries), sql(f"SELECT CAST(CAST(date_trunc('week', entry_date) AS DATE) AS VARCHAR) AS week, {', '.join(f'{rnd(f'coalesce(sum(CASE WHEN isodow(entry_date) = {i} THEN minutes END), 0) / 60.0::DOUBLE')} AS {w}' for i, w in enumerate(('mon', 'tue', 'wed', 'thu', 'fri'), 1))} FROM te WHERE isodow(entry_date) < 6 GROUP BY 1"))
add("jon_02_fallback", lambda p: joins.fallback_join(p.time_entries.select(F.when(F.col("matter_id") % 3 != 0, F.col("matter_id")).alias("own_id"), F.concat(F.lit("M"), F.col("matter_id").cast("string")).alias("own_number"), "minutes"),
    p.matters.where("matter_id % 10 <> 3"), [("own_id", "matter_id"), ("own_number", "matter_number")], ["client_id", "status"], [F.asc("matter_id")]).groupBy("matched_by", "status").agg(F.count("*").alias("entries"), agg.total("minutes").alias("minutes"), F.countDistinct("client_id").alias("clients")),
    sql("""SELECT CAST(CASE WHEN a.matter_id IS NOT NULL THEN 1 WHEN b.matter_id IS NOT NULL THEN 2 END AS BIGINT) AS matched_by, coalesce(a.status, b.status) AS status, count(*) AS entries, CAST(sum(minutes) AS BIGINT) AS minutes, count(DISTINCT coalesce(a.client_id, b.client_id)) AS clients
    FROM te LEFT JOIN (SELECT * FROM ma WHERE matter_id % 10 <> 3) a ON te.matter_id % 3 <> 0 AND te.matter_id = a.matter_id LEFT JOIN (SELECT * FROM ma WHERE matter_id % 10 <> 3) b ON 'M' || te.matter_id = b.matter_number GROUP BY 1, 2"""))
add("jon_07_invoice_context", lambda p: p.invoices.join(p.matters.select("matter_id", F.col("status").alias("matter_status"), "case_type"), "matter_id", "left").join(p.clients.select("client_id", "segment"), "client_id", "left").groupBy("matter_status", "segment").agg(F.count("*").alias("invoices"), agg.total("outstanding").alias("outstanding")),
    sql(f"SELECT ma.status AS matter_status, segment, count(*) AS invoices, {d('sum(outstanding)', 'outstanding')} FROM iv LEFT JOIN ma USING (matter_id) LEFT JOIN cl ON iv.client_id = cl.client_id GROUP BY ALL"))
add("jon_19_or_join", lambda p: joins.or_join(p.clients.select("client_id", F.col("client_id").alias("a"), (F.col("client_id") + 1).alias("b")), p.matters.select("matter_id", F.col("client_id").alias("c")), [("a", "c"), ("b", "c")], "client_id", "matter_id").groupBy("client_id").agg(F.count("*").alias("matters")),
    sql("SELECT cl.client_id, count(*) AS matters FROM cl JOIN ma ON ma.client_id = cl.client_id OR ma.client_id = cl.client_id + 1 GROUP BY cl.client_id"))
add("jon_22_semi", lambda p: p.fee_earners.join(p.time_entries.where("age_days <= 30"), "lawyer_id", "left_semi").select("lawyer_id", "grade"), sql("SELECT lawyer_id, grade FROM fe WHERE lawyer_id IN (SELECT lawyer_id FROM te WHERE age_days <= 30)"))
add("jon_23_anti", lambda p: p.matters.join(p.time_entries, "matter_id", "left_anti").select("matter_id", "status"), sql("SELECT matter_id, status FROM ma WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.matter_id = ma.matter_id)"))
add("jon_24_full_outer", lambda p: joins.difference(p.time_entries.where("age_days > 1000").groupBy(F.col("matter_id").alias("entity_id")).agg(agg.total("minutes").alias("value")), p.invoices.where("outstanding > 0").groupBy(F.col("matter_id").alias("entity_id")).agg(F.count("*").alias("value"))),
    sql("SELECT entity_id, live, trial, trial - live AS delta FROM (SELECT matter_id AS entity_id, CAST(sum(minutes) AS BIGINT) AS live FROM te WHERE age_days > 1000 GROUP BY 1) FULL JOIN (SELECT matter_id AS entity_id, count(*) AS trial FROM iv WHERE outstanding > 0 GROUP BY 1) USING (entity_id)"))
add("win_05_top_details", lambda p: agg.top_rows(p.invoices, ["client_id"], [F.desc("outstanding"), F.asc("invoice_id")], 3).select("client_id", "position", "invoice_id", "outstanding"),
    sql(f"SELECT client_id, CAST(position AS BIGINT) AS position, invoice_id, {d('outstanding', 'outstanding')} FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY outstanding DESC, invoice_id) AS position FROM iv) WHERE position <= 3"))
add("win_06_percent_of_total", lambda p: p.fee_earners.join(p.time_entries, "lawyer_id").groupBy("grade").agg(agg.total("write_off").alias("value")).withColumn("share", sc.js_round(sc.percent(F.col("value"), F.sum("value").over(W.partitionBy())), 4)),
    sql(f"SELECT grade, {d('v', 'value')}, {rnd(pct('v', '(sum(v) OVER ())'))} AS share FROM (SELECT grade, sum(write_off) AS v FROM fe JOIN te USING (lawyer_id) GROUP BY grade)"))
add("srt_03_top_clients", lambda p: agg.clients(p.clients, matter_totals(p)).orderBy(F.desc("net_billing"), "client_id").limit(10).select("client_id", "display_name", "net_billing"),
    sql(f"SELECT client_id, display_name, {d('net_billing', 'net_billing')} FROM cl LEFT JOIN cg USING (client_id) ORDER BY coalesce(net_billing, 0) DESC, client_id LIMIT 10", f"{MATTERS}, {CG}"))
add("srt_04_page", lambda p: dashboards.page(p.invoices.select("invoice_id", "status", "outstanding"), [F.asc("status"), F.asc("invoice_id")], 50, 100), sql(f"SELECT invoice_id, status, {d('outstanding', 'outstanding')} FROM iv ORDER BY status, invoice_id LIMIT 50 OFFSET 100"))
add("set_03_distinct", lambda p: p.fee_earners.select(F.col("department").alias("name")).union(p.clients.select(F.col("segment").alias("name"))).distinct(), sql("SELECT department AS name FROM fe UNION SELECT segment FROM cl"))
add("set_06_routes", lambda p: dashboards.route_invoices(p.invoices), sql("SELECT 'open' AS route, count(*) AS n FROM iv WHERE outstanding > 0 UNION ALL SELECT 'overdue', count(*) FROM iv WHERE outstanding > 0 AND days_overdue > 0 UNION ALL SELECT 'paid', count(*) FROM iv WHERE outstanding < total"))
add("flt_12_overdue", lambda p: dashboards.invoice_list(p.invoices, "overdue").select("invoice_id", "outstanding", "days_overdue"), sql(f"SELECT invoice_id, {d('outstanding', 'outstanding')}, days_overdue FROM iv WHERE outstanding > 0 AND days_overdue > 0"))
add("qry_01_leakage", lambda p: dashboards.leakage(p), sql(f"SELECT matter_id, {d('value', 'value')}, CAST(age AS BIGINT) AS age_days, {rnd('CAST(age * value AS DOUBLE) / 1000', 0)} AS risk FROM (SELECT matter_id, max(age_days) AS age, sum(billable_value) AS value FROM te WHERE matched GROUP BY matter_id) ORDER BY risk DESC, matter_id LIMIT 10"))
add("qry_02_fee_earners", lambda p: dashboards.pivot_kpis(long_table(p).where("entity_type = 'feeEarner'"), ["F-TU-01", "F-WL-02"]),
    with_("SELECT entity_id, max(CASE WHEN kpi_key = 'F-TU-01' THEN value END) AS \"F-TU-01\", max(CASE WHEN kpi_key = 'F-WL-02' THEN value END) AS \"F-WL-02\" FROM kp WHERE entity_type = 'feeEarner' GROUP BY entity_id", *LONG_NEEDS))
add("qry_03_wip", lambda p: dashboards.wip_departments(p), sql(f"SELECT department, {d('sum(billable_value)', 'value')}, {d('sum(CASE WHEN age_days > 60 THEN billable_value END) * 0.3', 'leakage')}, {rnd(pct('sum(write_off)', 'sum(billable_value) + sum(write_off)'))} AS write_off_rate FROM te JOIN fe USING (lawyer_id) WHERE matched GROUP BY department"))
_START = f"CAST(date_trunc('month', DATE '{REF_DATE}' - INTERVAL 1 MONTH) AS DATE)"
add("qry_04_billing", lambda p: dashboards.billing_period(p.invoices, ref()), sql(f"SELECT count(*) AS invoices, {d('sum(subtotal)', 'net_billing')}, {d('sum(total - outstanding)', 'paid')}, {d('sum(outstanding)', 'outstanding')} FROM iv WHERE invoice_date >= {_START}"))
_BURNT = pct("billable", "budget")
_REALISED = pct("net_billing", "nullif(billable, 0)")
add("qry_05_at_risk", lambda p: dashboards.at_risk_matters(matter_totals(p)),
    sql(f"SELECT matter_id, CAST(age_days AS BIGINT) AS age_days, {rnd(f'CASE WHEN budget > 0 THEN {_BURNT} END')} AS burn, {rnd(_REALISED)} AS realisation FROM mg WHERE age_days > 60 OR (budget > 0 AND {_BURNT} > 100) OR {_REALISED} < 70", MATTERS))
add("qry_06_clients", lambda p: dashboards.client_rows(agg.clients(p.clients, matter_totals(p)), 5), sql(f"SELECT client_id, {n('matters', 'matters')}, {d('net_billing', 'net_billing')}, {d('outstanding', 'outstanding')}, {rnd(pct('outstanding', 'nullif(net_billing, 0)'))} AS open_percent FROM cl JOIN cg USING (client_id) WHERE matters >= 5", f"{MATTERS}, {CG}"))
