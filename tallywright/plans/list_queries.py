"""Lists, lookups, indexes, filters and document sinks over the domain views, with DuckDB twins.

The twins spell every constant out by hand; they import none from the operators.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg
from ..operators import dashboards, joins, kpi, lists
from ..operators import normalise as nm
from ..session import scratch_path, table
from ..sources import datasets, files, paged, snapshots
from .domain import REF_DATE, load, rnd, sql
from .kpi_queries import pct, ref
from .practice_queries import MATTERS, d, matter_totals, n, plain

QUERIES: dict = {}
ORACLE: dict = {}
REF = f"DATE '{REF_DATE}'"


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, path: plain(run(spark, path))
    ORACLE[name] = oracle


def on(run):
    """A query over the loaded views."""
    return lambda spark, path: run(load(spark, path))


MD = "md AS (SELECT o_orderkey AS matter_id, n_name AS department FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"

# --- filters ---------------------------------------------------------------------------

add("flt_04_generic", on(lambda p: dashboards.filtered(p.matters, {"status": "IN_PROGRESS", "matter_number": "m1", "is_fixed_fee": "no", "case_type": ""}, {"matter_number": "contains", "is_fixed_fee": "boolean"}).select("matter_id")),
    sql("SELECT matter_id FROM ma WHERE status = 'IN_PROGRESS' AND contains(lower(matter_number), 'm1') AND NOT is_fixed_fee"))
add("flt_13_matter_list", on(lambda p: lists.by_metadata(matter_totals(p), p.matters.select("matter_id", "status").join(p.matter_departments, "matter_id", "left"), {"status": "COMPLETED", "department": None}).select("matter_id", "billable")),
    sql(f"SELECT matter_id, {d('billable', 'billable')} FROM mg WHERE status = 'COMPLETED'", MATTERS))
add("flt_13_by_department", on(lambda p: lists.by_metadata(matter_totals(p), p.matter_departments.where("department is not null"), {"department": p.matter_departments.agg(F.min("department")).first()[0]}).agg(F.count("*").alias("matters"), agg.total("billable").alias("billable"))),
    sql(f"SELECT count(*) AS matters, {d('sum(billable)', 'billable')} FROM mg WHERE matter_id IN (SELECT matter_id FROM md WHERE department = (SELECT min(department) FROM md))", f"{MATTERS}, {MD}"))
add("flt_14_dashboard_filters", on(lambda p: matter_totals(p).where((F.col("case_type").startswith("1")) & (F.col("billable") >= 50_000) & (F.col("budget") > 0)).join(p.matter_departments, "matter_id", "left").groupBy("department").agg(F.count("*").alias("matters"), agg.total("billable").alias("billable"))),
    sql(f"SELECT department, count(*) AS matters, {d('sum(billable)', 'billable')} FROM mg LEFT JOIN md USING (matter_id) WHERE case_type LIKE '1%' AND billable >= 50000 AND budget > 0 GROUP BY department", f"{MATTERS}, {MD}"))
add("flt_14_client_revenue", on(lambda p: agg.clients(p.clients, matter_totals(p)).where("net_billing >= 400000 and matters >= 3").select("client_id", "matters")),
    sql("SELECT client_id, count(*) AS matters FROM mg JOIN cl USING (client_id) GROUP BY client_id HAVING sum(net_billing) >= 400000 AND count(*) >= 3", MATTERS))
_AUDIT = "event_type = (SELECT min(event_type) FROM events) AND ts >= (SELECT min(ts) FROM events) AND ts < (SELECT min(ts) FROM events) + INTERVAL 10 DAY"


def _audit(spark, path):
    events = table(spark, path, "events")
    kind, first = events.agg(F.min("event_type"), F.min("ts")).first()
    day = F.to_timestamp(F.lit(str(first)))
    bounds = spark.range(1).select(day.cast("string").alias("a"), (day + F.expr("INTERVAL 10 DAYS")).cast("string").alias("b")).first()
    found = lists.audit_search(events, {"event_type": kind}, bounds["a"], bounds["b"], "event_type", f"%{kind[1:].upper()}%")
    return lists.page_with_total(found.select("event_id"), [F.asc("event_id")], 20, 5)


add("flt_17_audit_search", _audit, f"SELECT event_id, total FROM (SELECT event_id, count(*) OVER () AS total FROM events WHERE {_AUDIT}) ORDER BY event_id LIMIT 20 OFFSET 5")
add("flt_18_risk_filter", lambda spark, path: snapshots.recent_flags(
    table(spark, path, "orders").where("o_orderstatus = 'O' and o_orderpriority like '1%'").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.lit("high").alias("severity")), 10, [F.desc("o_orderdate"), F.asc("id")]).select("id", "severity"),
    "SELECT o_orderkey AS id, 'high' AS severity FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
add("flt_19_invoice_tabs", on(lambda p: _tabs(p)),
    sql("""SELECT 'all' AS tab, count(*) AS n FROM iv UNION ALL SELECT 'outstanding', count(*) FROM iv WHERE outstanding > 0 UNION ALL SELECT 'overdue', count(*) FROM iv WHERE outstanding > 0 AND days_overdue > 0
    UNION ALL SELECT 'paid', count(*) FROM iv WHERE outstanding = 0 UNION ALL SELECT 'writtenOff', count(*) FROM iv WHERE outstanding > 0 AND days_overdue > 0"""))


def _tabs(p):
    """Rows of every tab, counted in one pass."""
    return lists.invoice_tab_counts(p.invoices)


add("flt_12_paid", on(lambda p: dashboards.invoice_list(p.invoices, "paid").select("invoice_id")), sql("SELECT invoice_id FROM iv WHERE outstanding = 0"))
add("flt_12_outstanding", on(lambda p: dashboards.invoice_list(p.invoices, "outstanding").select("invoice_id")), sql("SELECT invoice_id FROM iv WHERE outstanding > 0"))

# --- joins -----------------------------------------------------------------------------

add("jon_01_unique_last", lambda spark, path: lists.index_unique(table(spark, path, "orders"), "o_custkey", "o_totalprice", "o_orderkey"), "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
add("win_02_first_wins", lambda spark, path: lists.index_unique(table(spark, path, "orders"), "o_custkey", "o_totalprice", "o_orderkey", last=False), "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
add("jon_01_multi", lambda spark, path: lists.index_multi(table(spark, path, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("orders")),
    "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")


def _earner_names(spark, path):
    li, s = table(spark, path, "lineitem"), table(spark, path, "supplier")
    people = s.select(F.col("s_suppkey").alias("lawyer_id"), F.concat(F.lit("Dr Ann L"), F.col("s_suppkey").cast("string")).alias("lawyer_name"))
    own = F.col("l_suppkey").cast("string")
    raw = li.select(F.when(F.col("l_linenumber") % 4 == 0, F.col("l_suppkey")).alias("own_id"), F.when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("ANN  L"), own)).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("Bo L"), own)).when(F.col("l_linenumber") % 4 == 3, F.lit("Nobody")).alias("raw"))
    direct = raw.where("own_id is not null").join(people.select("lawyer_id"), F.col("own_id") == F.col("lawyer_id"), "left").select("lawyer_id", F.when(F.col("lawyer_id").isNotNull(), 0).alias("level"))
    named = joins.match_names(raw.where("own_id is null").select("raw"), people, "raw", "lawyer_name", "lawyer_id", "lawyer_id").select("lawyer_id", "level")
    return direct.unionByName(named).groupBy("lawyer_id", "level").agg(F.count("*").alias("entries"))


add("jon_03_entry_to_earner", _earner_names, """SELECT lawyer_id, CAST(level AS BIGINT) AS level, count(*) AS entries FROM (SELECT CASE WHEN l_linenumber % 4 < 3 THEN s_suppkey END AS lawyer_id, CASE WHEN s_suppkey IS NOT NULL AND l_linenumber % 4 < 3 THEN l_linenumber % 4 END AS level
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL""")
add("jon_04_names_of_entries", lambda spark, path: joins.match_names(
    table(spark, path, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("mr  ANN L"), (F.col("c_custkey") % 50).cast("string"))).otherwise(F.concat(F.lit("Zoe L"), (F.col("c_custkey") % 50).cast("string"))).alias("raw")),
    table(spark, path, "supplier").select(F.col("s_suppkey").alias("lawyer_id"), F.concat(F.lit("Ann L"), F.col("s_suppkey").cast("string")).alias("lawyer_name")), "raw", "lawyer_name", "lawyer_id", "lawyer_id").select("k", "lawyer_id", "level"),
    "SELECT c_custkey AS k, s_suppkey AS lawyer_id, CAST(CASE WHEN s_suppkey IS NOT NULL THEN 1 + c_custkey % 2 END AS BIGINT) AS level FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 50")
add("jon_11_registered_variants", lambda spark, path: joins.registry_variants(table(spark, path, "supplier").select(F.lit("earner").alias("entity"), F.col("s_suppkey").alias("id"), F.concat(F.lit("Ann L"), F.col("s_suppkey").cast("string")).alias("name"))).groupBy("id").agg(F.count("*").alias("variants"), F.min("variant").alias("first")),
    "SELECT id, count(*) AS variants, min(variant) AS first FROM (SELECT variant, min(id) AS id FROM (SELECT s_suppkey AS id, unnest(list_distinct(['ann l' || s_suppkey, 'l' || s_suppkey || ', ann', 'l' || s_suppkey || ' ann', 'a l' || s_suppkey, 'a. l' || s_suppkey, 'l' || s_suppkey || ' a', 'l' || s_suppkey || ', a', 'l' || s_suppkey])) AS variant FROM supplier) GROUP BY variant) GROUP BY id")
add("jon_13_merge_table", lambda spark, path: joins.merge_people(
    table(spark, path, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Ann L"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("L"), F.col("s_suppkey").cast("string"), F.lit("@x")).alias("email"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey").cast("string")).alias("account_id")),
    table(spark, path, "supplier").where("s_suppkey % 5 > 0").select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("ann  l"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("Bo L"), F.col("s_suppkey").cast("string"))).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("l"), F.col("s_suppkey").cast("string"), F.lit("@X"))).alias("email"), F.col("s_suppkey").cast("string").alias("account_id"), F.col("s_acctbal").alias("salary")), ["salary"]).select("id", "salary", "matched_by"),
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS salary, CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 WHEN s_suppkey % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS matched_by FROM supplier")
add("jon_18_earner_context", on(lambda p: lists.earner_context(p.fee_earners, p.time_entries, p.matter_departments, p.fee_earners.where("lawyer_id % 3 = 0").select("lawyer_id", F.lit(100.0).alias("target")), p.fee_earners.where("lawyer_id % 2 = 0").select("lawyer_id", F.lit(80.0).alias("target")))),
    sql(f"""SELECT fe.lawyer_id, department AS top_department, coalesce(hours, 0) AS hours, CASE WHEN fe.lawyer_id % 3 = 0 THEN 100.0::DOUBLE WHEN fe.lawyer_id % 2 = 0 THEN 80.0::DOUBLE END AS target FROM (SELECT lawyer_id FROM fe) fe
    LEFT JOIN (SELECT lawyer_id, department FROM (SELECT lawyer_id, department, row_number() OVER (PARTITION BY lawyer_id ORDER BY c DESC, department) AS rn FROM (SELECT lawyer_id, department, count(*) AS c FROM te JOIN md USING (matter_id) GROUP BY ALL)) WHERE rn = 1) USING (lawyer_id)
    LEFT JOIN (SELECT lawyer_id, {rnd('sum(minutes) / 60.0::DOUBLE')} AS hours FROM te GROUP BY lawyer_id) USING (lawyer_id)""", MD))
add("jon_20_three_way_or", on(lambda p: joins.or_join(
    p.clients.select("client_id", F.col("client_id").alias("a"), (F.col("client_id") + 1).alias("b"), F.concat(F.lit("M"), F.col("client_id").cast("string")).alias("c")), p.matters.select("matter_id", F.col("client_id").alias("x"), F.col("matter_number").alias("y")), [("a", "x"), ("b", "x"), ("c", "y")], "client_id", "matter_id").groupBy("client_id").agg(F.count("*").alias("matters"))),
    sql("SELECT cl.client_id, count(*) AS matters FROM cl JOIN ma ON ma.client_id = cl.client_id OR ma.client_id = cl.client_id + 1 OR ma.matter_number = 'M' || cl.client_id GROUP BY cl.client_id"))
add("jon_21_conditional_key", on(lambda p: lists.entries_of(
    p.matters.select(F.when(F.col("matter_id") % 3 > 0, F.col("matter_id")).alias("matter_id"), "matter_number"),
    p.time_entries.select(F.when(F.col("matter_id") % 2 == 0, F.col("matter_id")).alias("matter_id"), F.concat(F.lit("M"), F.col("matter_id").cast("string")).alias("matter_number"), "minutes")).groupBy("own_number").agg(agg.total("minutes").alias("minutes"), F.count("*").alias("entries"))),
    sql("SELECT matter_number AS own_number, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) AS entries FROM ma JOIN te USING (matter_id) GROUP BY 1"))
add("jon_26_version_diff", lambda spark, path: lists.version_diff(
    table(spark, path, "orders").withColumn("version", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))).select("o_custkey", "version", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderkey") % 2).alias("parity")),
    "o_custkey", 1, 2, ["status", "priority", "parity"]).select("o_custkey", F.array_join("changed", ",").alias("changed")),
    """WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority, o_orderkey % 2 AS parity FROM orders)
    SELECT a.o_custkey, concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.priority <> b.priority THEN 'priority' END, CASE WHEN a.parity <> b.parity THEN 'parity' END) AS changed FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.version = 1 AND b.version = 2""")
_FIRST = "(SELECT min(matter_id) FROM te)"
add("jon_27_matter_detail", on(lambda p: lists.matter_detail(p.matters, p.time_entries, p.invoices, "M" + str(p.time_entries.agg(F.min("matter_id")).first()[0])).select(
    "matter_id", "status", "n_entries", "n_invoices", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["entry_date"].cast("string"), e["lawyer_id"].cast("string"), e["minutes"].cast("string"))), ",").alias("entries"))),
    sql(f"""SELECT matter_id, status, coalesce(c, 0) AS n_entries, coalesce(i, 0) AS n_invoices, s AS entries FROM ma LEFT JOIN (SELECT matter_id, count(*) AS c, string_agg(entry_date || ':' || lawyer_id || ':' || minutes, ',' ORDER BY entry_date, lawyer_id, minutes) AS s FROM te GROUP BY matter_id) USING (matter_id)
    LEFT JOIN (SELECT matter_id, count(*) AS i FROM iv GROUP BY matter_id) USING (matter_id) WHERE matter_id = {_FIRST}"""))

# --- aggregates, windows, order, sets --------------------------------------------------

add("agg_26_api_matters", on(lambda p: agg.matters(p.matters.select("matter_id"), p.time_entries.withColumn("billable_value", F.col("billable_value") + F.col("write_off")), p.invoices.withColumn("subtotal", F.col("total"))).select("matter_id", "billable", "net_billing", "age_days")),
    sql(f"SELECT matter_id, {d('w', 'billable')}, {d('t', 'net_billing')}, CAST(a AS BIGINT) AS age_days FROM ma LEFT JOIN (SELECT matter_id, sum(billable_value + write_off) AS w, max(age_days) AS a FROM te GROUP BY matter_id) USING (matter_id) LEFT JOIN (SELECT matter_id, sum(total) AS t FROM iv GROUP BY matter_id) USING (matter_id)"))
add("agg_10_by_matter", on(lambda p: p.time_entries.groupBy(F.when(F.col("matched"), F.col("matter_id")).alias("matter_id")).agg(agg.total("billable_value").alias("value"), agg.hours(agg.total("minutes")).alias("hours"), F.count("*").alias("entries"))),
    sql(f"SELECT CASE WHEN matched THEN matter_id END AS matter_id, {d('sum(billable_value)', 'value')}, {rnd('sum(minutes) / 60.0::DOUBLE')} AS hours, count(*) AS entries FROM te GROUP BY 1"))
add("agg_19_by_client", on(lambda p: p.time_entries.groupBy("matter_id").agg(agg.total("billable_value").alias("v"), agg.total("minutes").alias("m"), F.sum("age_days").alias("a"), F.count("*").alias("n")).join(p.matters.select("matter_id", "client_id"), "matter_id").groupBy("client_id").agg(
    agg.total("v").alias("value"), agg.hours(agg.total("m")).alias("hours"), sc.js_round(F.sum("a") / F.sum("n"), 4).alias("mean_age"), F.sum("n").alias("items"))),
    sql(f"SELECT client_id, {d('sum(billable_value)', 'value')}, {rnd('sum(minutes) / 60.0::DOUBLE')} AS hours, {rnd('avg(age_days)')} AS mean_age, count(*) AS items FROM te JOIN ma USING (matter_id) GROUP BY client_id"))
add("agg_19_details", on(lambda p: agg.top_rows(p.time_entries.select("lawyer_id", "entry_date", "matter_id", "minutes"), ["lawyer_id"], [F.asc("entry_date"), F.asc("matter_id"), F.asc("minutes")], 20).groupBy("lawyer_id").agg(F.count("*").alias("shown"), agg.total("minutes").alias("minutes"))),
    sql("SELECT lawyer_id, count(*) AS shown, CAST(sum(minutes) AS BIGINT) AS minutes FROM (SELECT lawyer_id, minutes, row_number() OVER (PARTITION BY lawyer_id ORDER BY entry_date, matter_id, minutes) AS rn FROM te) WHERE rn <= 20 GROUP BY lawyer_id"))
add("agg_20_realisation", on(lambda p: matter_totals(p).groupBy("case_type").agg(F.count("*").alias("matters"), sc.js_round(F.avg(F.when((F.col("billable") > 0) & (F.col("net_billing") > 0), sc.percent(F.col("net_billing"), F.col("billable")))), 4).alias("mean_realisation"))),
    sql(f"SELECT case_type, count(*) AS matters, {rnd('avg(CASE WHEN billable > 0 AND net_billing > 0 THEN ' + pct('net_billing', 'billable') + ' END)')} AS mean_realisation FROM mg GROUP BY case_type", MATTERS))
add("agg_20_departments", on(lambda p: matter_totals(p).join(p.matter_departments, "matter_id", "left").groupBy(F.coalesce("department", F.lit("Unknown")).alias("department")).agg(F.count("*").alias("matters"), agg.total("billable").alias("billable"))),
    sql(f"SELECT coalesce(department, 'Unknown') AS department, count(*) AS matters, {d('sum(billable)', 'billable')} FROM mg LEFT JOIN md USING (matter_id) GROUP BY 1", f"{MATTERS}, {MD}"))
add("agg_21_first_client", on(lambda p: p.disbursements.join(p.matters.select("matter_id", "client_id"), "matter_id", "left").groupBy("matter_id").agg(agg.total("exposure").alias("value"), F.max("age_days").alias("oldest_days"), F.min_by("client_id", F.struct("lawyer_id", "age_days")).alias("client_id"))),
    sql(f"SELECT matter_id, {d('sum(exposure)', 'value')}, CAST(max(di.age_days) AS BIGINT) AS oldest_days, min(client_id) AS client_id FROM di LEFT JOIN ma USING (matter_id) GROUP BY matter_id"))
add("agg_27_unattributed", on(lambda p: p.invoices.join(p.fee_earners.where("not is_system_account").select("lawyer_id", F.lit(True).alias("known")), "lawyer_id", "left").agg(agg.total("subtotal").alias("invoiced"), agg.total("subtotal", F.col("known").isNull()).alias("unattributed"))),
    sql(f"SELECT {d('sum(subtotal)', 'invoiced')}, {d('sum(CASE WHEN lawyer_id NOT IN (SELECT lawyer_id FROM fe WHERE NOT is_system_account) THEN subtotal END)', 'unattributed')} FROM iv"))
add("agg_28_mean_delta", on(lambda p: joins.difference(kpi.f_rb_01(p), kpi.f_rb_01(p, "adjusted_fixed_fee")).agg(sc.js_round(F.avg("delta"), 4).alias("mean_delta"))),
    sql(f"SELECT {rnd('avg(CASE WHEN is_fixed_fee THEN 100.0::DOUBLE - v ELSE 0 END)')} AS mean_delta FROM (SELECT is_fixed_fee, {rnd(pct('coalesce(net, 0)', 'wip'))} AS v FROM ma JOIN (SELECT matter_id, sum(billable_value) AS wip FROM te WHERE matched GROUP BY matter_id) USING (matter_id) LEFT JOIN (SELECT matter_id, sum(subtotal) AS net FROM iv GROUP BY matter_id) USING (matter_id) WHERE wip > 0)"))
add("agg_30_effective", on(lambda p: _overrides(p)), sql("SELECT lawyer_id AS id, 'rate' AS field, CASE WHEN lawyer_id % 2 = 0 THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS value FROM fe UNION ALL SELECT lawyer_id, 'hours', 30.0::DOUBLE FROM fe WHERE lawyer_id % 3 = 0"))


def _overrides(p):
    from ..operators import quality

    k = F.col("lawyer_id")
    row = lambda field, value, start, end, when: p.fee_earners.where(when).select(k.alias("id"), F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(start).alias("valid_from"), F.lit(end).cast("string").alias("valid_to"))
    rows = row("rate", 10.0, "2000-01-01", None, "true").unionByName(row("rate", 20.0, "2001-01-01", None, "lawyer_id % 2 = 0")).unionByName(row("rate", 99.0, "2002-01-01", None, "true"))
    rows = rows.unionByName(row("hours", 30.0, "2001-01-01", "2001-12-31", "lawyer_id % 3 = 0")).unionByName(row("hours", 99.0, "1999-01-01", "1999-12-31", "true"))
    return quality.effective_overrides(rows, REF_DATE).select("id", F.explode("overrides").alias("field", "value"))


add("win_09_recording_grid", on(lambda p: lists.recording_grid(p.fee_earners, p.time_entries, ref(), 20).groupBy("day").agg(F.count("*").alias("earners"), F.count_if("has_entries").alias("recorded"))),
    sql(f"SELECT CAST(day AS VARCHAR) AS day, count(*) AS earners, count(e.lawyer_id) AS recorded FROM (SELECT lawyer_id, day FROM fe, (SELECT CAST(d AS DATE) AS day FROM generate_series({REF} - 60, {REF} - 1, INTERVAL 1 DAY) AS t(d) WHERE isodow(d) < 6 ORDER BY d DESC LIMIT 20)) g LEFT JOIN (SELECT DISTINCT lawyer_id, entry_date AS day FROM te) e USING (lawyer_id, day) GROUP BY day"))
add("srt_04_page_with_total", on(lambda p: lists.page_with_total(p.invoices.select("invoice_id", "outstanding"), [F.desc("outstanding"), F.asc("invoice_id")], 50, 100)),
    sql(f"SELECT invoice_id, {d('outstanding', 'outstanding')}, total FROM (SELECT invoice_id, outstanding, count(*) OVER () AS total FROM iv) x ORDER BY x.outstanding DESC, invoice_id LIMIT 50 OFFSET 100"))
add("srt_03_by_outstanding", on(lambda p: agg.clients(p.clients, matter_totals(p)).orderBy(F.desc("outstanding"), "client_id").limit(10).select("client_id", "outstanding")),
    sql(f"SELECT client_id, {d('o', 'outstanding')} FROM (SELECT cl.client_id, coalesce(sum(outstanding), 0) AS o FROM cl LEFT JOIN mg USING (client_id) GROUP BY cl.client_id) ORDER BY o DESC, client_id LIMIT 10", MATTERS))
add("srt_05_nulls_last", on(lambda p: dashboards.sort_nulls_last(p.matters.select("matter_id", F.when(F.col("matter_id") % 7 != 0, F.col("matter_id")).alias("k")), "k", True).limit(30).select("matter_id")),
    sql("SELECT matter_id FROM ma WHERE matter_id % 7 <> 0 ORDER BY matter_id DESC LIMIT 30"))
add("srt_07_recommendations", lambda spark, path: lists.recommendations(table(spark, path, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "feeEarner").otherwise("invoicesJson").alias("kind"))),
    "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Upload WIP / Lawyer Time export'), (1, 'Upload Full Matters export'), (3, 'Upload Closed Matters export'), (3, 'Upload Contacts export')) AS t(priority, title)")
add("srt_08_opportunities", on(lambda p: kpi.at_risk(p).where("at_risk > 0").orderBy(F.desc("at_risk"), "matter_id").limit(25).select("matter_id", "at_risk")),
    sql(f"""SELECT matter_id, {rnd('sum(lost)')} AS at_risk FROM (SELECT matter_id, CAST({rnd("CAST(billable_value AS DOUBLE) * (1 - CASE WHEN age_days <= 30 THEN 0.95::DOUBLE WHEN age_days <= 60 THEN 0.85::DOUBLE WHEN age_days <= 90 THEN 0.7::DOUBLE WHEN age_days <= 180 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END)")} AS DECIMAL(18,4)) AS lost
    FROM te WHERE matched) GROUP BY matter_id HAVING sum(lost) > 0 ORDER BY at_risk DESC, matter_id LIMIT 25"""))
add("srt_10_sort_by", on(lambda p: lists.page_with_total(matter_totals(p).select("matter_id", "budget"), lists.sorted_by("budget", "desc", "matter_id"), 20).select("matter_id", "total")),
    sql("SELECT matter_id, total FROM (SELECT matter_id, budget, count(*) OVER () AS total FROM ma) ORDER BY budget DESC NULLS LAST, matter_id LIMIT 20"))
add("set_01_union_all", lambda spark, path: (lambda li: li.where("l_linenumber = 1").select("l_orderkey", F.lit("a").alias("kind")).unionByName(li.where("l_linenumber = 2").select("l_orderkey", "l_tax"), allowMissingColumns=True).unionByName(li.where("l_linenumber = 1").select(F.lit("a").alias("kind"), "l_orderkey"), allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("l_tax").alias("taxed")))(table(spark, path, "lineitem")),
    "SELECT CASE WHEN l_linenumber = 1 THEN 'a' END AS kind, CAST(count(*) * max(CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(CASE WHEN max(l_linenumber) = 1 THEN 0 ELSE count(*) END AS BIGINT) AS taxed FROM lineitem WHERE l_linenumber < 3 GROUP BY 1")


def _headers(spark, path):
    to = scratch_path(spark, "headers")
    table(spark, path, "region").select("r_regionkey", "r_name").write.json(to + "/a")
    table(spark, path, "nation").select("n_nationkey", F.col("n_name").alias("r_name")).write.json(to + "/b")
    df = spark.read.json([to + "/a", to + "/b"])
    return files.unpivoted(df).groupBy("field").agg(F.count("*").alias("rows"), F.count("value").alias("present"))


add("set_02_header_union", _headers, "WITH r AS (SELECT count(*) AS a FROM region), n AS (SELECT count(*) AS b FROM nation) SELECT field, a + b AS rows, CASE field WHEN 'r_regionkey' THEN a WHEN 'n_nationkey' THEN b ELSE a + b END AS present FROM r, n, (VALUES ('r_regionkey'), ('r_name'), ('n_nationkey')) AS f(field)")
add("set_04_gone", on(lambda p: p.matters.select(F.col("matter_id").alias("k")).join(p.invoices.select(F.col("matter_id").alias("k")), "k", "left_anti")), sql("SELECT matter_id AS k FROM ma EXCEPT SELECT matter_id FROM iv"))
add("set_07_membership", on(lambda p: _membership(p)), sql("""SELECT in_wip, in_invoices, count(*) AS matters FROM (SELECT matter_id IN (SELECT matter_id FROM te) AS in_wip, matter_id IN (SELECT matter_id FROM iv) AS in_invoices FROM ma) GROUP BY ALL"""))


def _membership(p):
    there = lambda df, name: df.select("matter_id").distinct().withColumn(name, F.lit(True))
    out = p.matters.select("matter_id").join(there(p.time_entries, "in_wip"), "matter_id", "left").join(there(p.invoices, "in_invoices"), "matter_id", "left")
    return out.select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_wip", "in_invoices")]).groupBy("in_wip", "in_invoices").agg(F.count("*").alias("matters"))


# --- scalar functions over tables ------------------------------------------------------

add("scl_20_nested_path", lambda spark, path: table(spark, path, "customer").select("c_custkey", F.get_json_object(F.format_string('{"a":{"b":{"c":"%s"},"n":%d}}', "c_name", "c_custkey"), "$.a.b.c").alias("name"), F.get_json_object(F.format_string('{"a":{"n":%d}}', "c_custkey"), "$.a.x").alias("none")),
    "SELECT c_custkey, c_name AS name, CAST(NULL AS VARCHAR) AS none FROM customer")
add("scl_23_iso_compare", lambda spark, path: table(spark, path, "lineitem").withColumn("iso", F.date_format("l_shipdate", "yyyy-MM-dd")).where("iso >= '1996-01-01' and iso < '1997-01-01'").groupBy("l_suppkey").agg(F.max("iso").alias("latest")),
    "SELECT l_suppkey, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS latest FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' GROUP BY l_suppkey")
add("scl_table_names", lambda spark, path: table(spark, path, "supplier").select("s_suppkey", sc.normalise_name(F.concat(F.lit("  Dr.  "), F.col("s_name"))).alias("name"), sc.coerce_string(F.when(F.col("s_suppkey") % 2 == 0, F.lit("\t ")).otherwise(F.concat(F.lit(" "), F.col("s_name")))).alias("trimmed")),
    "SELECT s_suppkey, lower(s_name) AS name, CASE WHEN s_suppkey % 2 = 1 THEN s_name END AS trimmed FROM supplier")
add("scl_06_account_names", lambda spark, path: table(spark, path, "supplier").select("s_suppkey", sc.normalise_account_name(F.concat(F.lit("Dr  "), F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(" (Disabled)")).otherwise(""))).alias("name")), "SELECT s_suppkey, 'dr ' || lower(s_name) AS name FROM supplier")
add("scl_table_numbers", lambda spark, path: table(spark, path, "part").select("p_partkey", sc.coerce_number(F.concat(F.lit("£"), F.col("p_size").cast("string"), F.lit(".5x"))).alias("number"), sc.coerce_percentage(F.when(F.col("p_size") % 2 == 0, F.lit("0.25")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%")))).alias("percent"), sc.js_round(F.col("p_size") - 10.5).alias("rounded"), sc.safe_div(F.lit(10), F.col("p_size") % 3).alias("ratio")),
    "SELECT p_partkey, p_size + 0.5::DOUBLE AS number, CASE WHEN p_size % 2 = 0 THEN 25.0::DOUBLE WHEN p_size = 1 THEN 100.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS percent, floor(p_size - 10.5::DOUBLE + 0.5) AS rounded, CASE WHEN p_size % 3 > 0 THEN 10.0::DOUBLE / (p_size % 3) END AS ratio FROM part")
add("scl_table_dates", lambda spark, path: table(spark, path, "orders").select("o_orderkey", F.to_date(sc.coerce_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))).alias("day"), sc.coerce_boolean(F.when(F.col("o_orderkey") % 3 == 0, " YES ").when(F.col("o_orderkey") % 3 == 1, "0")).alias("flag"), sc.working_days_between(F.to_date("o_orderdate"), ref()).alias("working_days")),
    f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag,
    CAST((date_diff('day', DATE '1970-01-05', {REF} + 1) // 7 * 5 + least(date_diff('day', DATE '1970-01-05', {REF} + 1) % 7, 5)) - (date_diff('day', DATE '1970-01-05', CAST(o_orderdate AS DATE) + 1) // 7 * 5 + least(date_diff('day', DATE '1970-01-05', CAST(o_orderdate AS DATE) + 1) % 7, 5)) AS BIGINT) AS working_days FROM orders""")
add("scl_17_debt_bands", on(lambda p: p.invoices.where("outstanding > 0").groupBy(sc.banded(F.col("days_overdue"), [("0-30", 30), ("31-60", 60), ("61-90", 90), ("91-120", 120), ("120+", None)]).alias("band")).agg(F.count("*").alias("n"), agg.total("outstanding").alias("value"))),
    sql(f"SELECT CASE WHEN days_overdue <= 30 THEN '0-30' WHEN days_overdue <= 60 THEN '31-60' WHEN days_overdue <= 90 THEN '61-90' WHEN days_overdue <= 120 THEN '91-120' ELSE '120+' END AS band, count(*) AS n, {d('sum(outstanding)', 'value')} FROM iv WHERE outstanding > 0 GROUP BY 1"))

# --- projections -----------------------------------------------------------------------

# Other spellings of the dataset kinds.
KIND_ALIASES = {
    "fullMatters": "fullMattersJson", "closedMatters": "closedMattersJson", "wip": "wipJson", "invoices": "invoicesJson", "contacts": "contactsJson", "disbursements": "disbursementsJson", "tasks": "tasksJson",
    "feeEarners": "feeEarner", "lawyers": "feeEarner", "matters": "fullMattersJson", "closedmatters": "closedMattersJson", "lawyerTime": "wipJson", "unbilledwip": "wipJson", "invoice": "invoicesJson",
    "contact": "contactsJson", "disbursement": "disbursementsJson", "task": "tasksJson",
}


def canonical_kind(c):
    """The dataset kind that a spelling means; others stay."""
    names = F.create_map(*[F.lit(x) for kv in KIND_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, c), c)


_SPELLINGS = ["lawyers", "matters", "wip", "invoice", "tasksJson", "other"]
add("prj_19_kind_aliases", lambda spark, path: table(spark, path, "orders").select(canonical_kind(F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "SELECT CASE o_orderkey % 6 WHEN 0 THEN 'feeEarner' WHEN 1 THEN 'fullMattersJson' WHEN 2 THEN 'wipJson' WHEN 3 THEN 'invoicesJson' WHEN 4 THEN 'tasksJson' ELSE 'other' END AS kind, count(*) AS n FROM orders GROUP BY 1")


def visible(df, columns: list[str], hidden: set[str]):
    """The columns in their order, without the hidden ones."""
    return df.select(*[c for c in columns if c not in hidden])


add("prj_17_visible_columns", on(lambda p: visible(p.matters, ["matter_number", "status", "client_id", "matter_id"], {"client_id"})), sql("SELECT matter_number, status, matter_id FROM ma"))


def mapping_issues(mapping, fields):
    """(issue, field): fields that several headers map to, required ones that none does, and targets that are no fields."""
    per = mapping.groupBy("field").agg(F.count("*").alias("n")).join(fields, "field", "full_outer")
    issue = F.when(F.col("required").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("n").isNull() & F.col("required"), "missing")
    return per.select(issue.alias("issue"), "field").where("issue is not null")


# --- document sinks and reads ----------------------------------------------------------


def _sets(spark, path):
    """Two stored versions of enriched matters, the second written twice; the latest is read."""
    to = scratch_path(spark, "enriched")
    m = load(spark, path).matters.select("matter_id", "status")
    snapshots.replace_set(m.where("matter_id % 2 = 0"), to, "firm-1", "matter", 1)
    snapshots.replace_set(m, to, "firm-1", "matter", 2)
    snapshots.replace_set(m, to, "firm-1", "matter", 2)
    return snapshots.latest_set(spark, to, "firm-1", "matter")


add("snk_01_enriched_sets", lambda spark, path: _sets(spark, path).groupBy("status").agg(F.count("*").alias("n")), sql("SELECT status, count(*) AS n FROM ma GROUP BY status"))
add("src_19_latest_set", lambda spark, path: _sets(spark, path).where("matter_id % 3 = 0").select("matter_id", "version"), sql("SELECT matter_id, CAST(2 AS BIGINT) AS version FROM ma WHERE matter_id % 3 = 0"))


def _kpi_documents(spark, path):
    to = scratch_path(spark, "kpis")
    rows = kpi.f_bs_01(load(spark, path))
    snapshots.replace_set(rows, to, "firm-1", "kpis", 1)
    return snapshots.latest_set(spark, to, "firm-1", "kpis").agg(F.count("*").alias("rows"), F.count("value").alias("measured"))


add("snk_02_kpi_documents", _kpi_documents, sql("SELECT count(*) AS rows, CAST(count(*) FILTER (budget > 0) AS BIGINT) AS measured FROM ma"))


def _flags(spark, path):
    to = scratch_path(spark, "flags")
    o = table(spark, path, "orders").select(F.lit("firm-1").alias("firm_id"), F.lit("matter").alias("entity_type"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("flag"))
    snapshots.replace(o, to)
    snapshots.replace(o.where("flag = 'O'"), to)  # all flags of the firm are replaced
    return spark.read.parquet(to).groupBy("flag").agg(F.count("*").alias("n"))


add("snk_04_risk_flags", _flags, "SELECT o_orderstatus AS flag, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")


def _registry(spark, path):
    to = scratch_path(spark, "registry")
    s = table(spark, path, "supplier").select(F.lit("firm-1").alias("firm_id"), F.lit("earner").alias("entity_type"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    snapshots.replace(s.where("id % 2 = 0"), to)
    snapshots.replace(snapshots.upserted(spark.read.schema(s.schema).parquet(to), s.where("id % 3 = 0").withColumn("name", F.lit("new")), ["firm_id", "entity_type", "id"]), to + "-2")
    return spark.read.parquet(to + "-2").select("id", "name")


add("snk_06_registry_upsert", _registry, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
add("qry_16_delete_set", lambda spark, path: _deleted(spark, path), sql("SELECT 'invoice' AS kind, count(*) AS n FROM iv"))


def _deleted(spark, path):
    """An upload is deleted: its derived set goes, the other sets stay."""
    to, p = scratch_path(spark, "sets"), load(spark, path)
    snapshots.replace_set(p.matters.select("matter_id"), to, "firm-1", "matter", 1)
    snapshots.replace_set(p.invoices.select("matter_id"), to, "firm-1", "invoice", 1)
    snapshots.delete_set(spark, to, "firm-1", "matter")
    return spark.read.parquet(to).where("firm_id = 'firm-1'").groupBy("kind").agg(F.count("*").alias("n"))


# --- quality ---------------------------------------------------------------------------


def _records(p):
    k = F.col("matter_id")
    te = p.time_entries.select(F.when(k % 5 > 0, k).alias("matter_id"), F.when(k % 4 > 0, F.concat(F.lit("M"), k.cast("string"))).alias("matter_number"), F.when(F.col("lawyer_id") % 3 > 0, F.col("lawyer_id")).alias("lawyer_id"), F.concat(F.lit("L"), F.col("lawyer_id").cast("string")).alias("lawyer_name"))
    ma = p.matters.select("matter_id", "matter_number", F.lit(None).cast("long").alias("lawyer_id"), F.lit(None).cast("string").alias("lawyer_name"))
    return te, ma


def _quality(p):
    te, ma = _records(p)
    return lists.cross_reference_quality(te.unionByName(ma), te, ma.where("matter_id % 2 = 0"))


_ALL = "r AS (SELECT CASE WHEN matter_id % 5 > 0 THEN matter_id END AS i, CASE WHEN matter_id % 4 > 0 THEN matter_id END AS k, CASE WHEN lawyer_id % 3 > 0 THEN lawyer_id END AS li, lawyer_id AS ln, TRUE AS wip FROM te UNION ALL SELECT matter_id, matter_id, NULL, NULL, FALSE FROM ma)"
add("dq_02_cross_reference", on(lambda p: _quality(p).select(sc.js_round(F.col("matter_coverage"), 4).alias("matter_coverage"), sc.js_round(F.col("earner_coverage"), 4).alias("earner_coverage"), "unresolved_ids", "unresolved_numbers", "unresolved_names", "orphans", "entries", sc.js_round(F.col("orphan_rate"), 4).alias("orphan_rate"))),
    sql(f"""SELECT {rnd(pct('count(*) FILTER (i IS NOT NULL AND k IS NOT NULL)', 'count(*)'))} AS matter_coverage, {rnd(pct('count(*) FILTER (li IS NOT NULL)', 'count(ln)'))} AS earner_coverage, CAST(count(*) FILTER (i IS NOT NULL AND k IS NULL) AS BIGINT) AS unresolved_ids,
    CAST(count(*) FILTER (i IS NULL AND k IS NOT NULL) AS BIGINT) AS unresolved_numbers, count(DISTINCT CASE WHEN li IS NULL THEN ln END) AS unresolved_names, CAST(count(*) FILTER (wip AND (k IS NULL OR k % 2 = 1)) AS BIGINT) AS orphans, CAST(count(*) FILTER (wip) AS BIGINT) AS entries,
    {rnd(pct('count(*) FILTER (wip AND (k IS NULL OR k % 2 = 1))', 'count(*) FILTER (wip)'))} AS orphan_rate FROM r""", _ALL))
add("dq_02_known_gaps", on(lambda p: lists.known_gaps(_quality(p))), sql("SELECT 'LOW_IDENTIFIER_COVERAGE' AS code, 'warning' AS severity FROM r HAVING 100.0 * count(*) FILTER (i IS NOT NULL AND k IS NOT NULL) / count(*) < 70 UNION ALL SELECT 'WIP_ORPHAN_GAP', 'warning' FROM r WHERE wip HAVING 100.0 * count(*) FILTER (k IS NULL OR k % 2 = 1) / count(*) > 20", _ALL))

# --- lists -----------------------------------------------------------------------------

add("qry_07_fee_earners", on(lambda p: agg.fee_earners(p.fee_earners, p.time_entries, p.invoices, ref()).where("entries > 0").select("lawyer_id", "department", "entries", "revenue")),
    sql(f"SELECT lawyer_id, department, n AS entries, {d('r', 'revenue')} FROM fe JOIN (SELECT lawyer_id, count(*) AS n FROM te GROUP BY lawyer_id) USING (lawyer_id) LEFT JOIN (SELECT lawyer_id, sum(subtotal) AS r FROM iv GROUP BY lawyer_id) USING (lawyer_id)"))
add("qry_07_wip", on(lambda p: lists.page_with_total(p.time_entries.where("not matched").select("matter_id", "lawyer_id", "entry_date", "minutes"), [F.asc("entry_date"), F.asc("matter_id"), F.asc("lawyer_id"), F.asc("minutes")], 1000)),
    sql("SELECT matter_id, lawyer_id, CAST(entry_date AS VARCHAR) AS entry_date, CAST(minutes AS BIGINT) AS minutes, total FROM (SELECT *, count(*) OVER () AS total FROM te WHERE NOT matched) t ORDER BY t.entry_date, matter_id, lawyer_id, t.minutes LIMIT 1000"))
add("qry_07_invoices", on(lambda p: lists.page_with_total(p.invoices.where("outstanding > 0 and not days_overdue > 0").select("invoice_id", "status"), [F.asc("invoice_id")], 500)),
    sql("SELECT invoice_id, status, total FROM (SELECT invoice_id, status, count(*) OVER () AS total FROM iv WHERE outstanding > 0 AND NOT days_overdue > 0) ORDER BY invoice_id LIMIT 500"))
add("qry_07_disbursements", on(lambda p: p.disbursements.where("exposure > 0").groupBy("lawyer_id").agg(F.count("*").alias("n"), agg.total("exposure").alias("exposure"))), sql(f"SELECT lawyer_id, count(*) AS n, {d('sum(exposure)', 'exposure')} FROM di WHERE exposure > 0 GROUP BY lawyer_id"))
add("qry_07_firm_summary", on(lambda p: p.matters.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("matters by status").alias("what"), F.col("status").alias("key"), "n").unionByName(p.fee_earners.groupBy("pay_model").agg(F.count("*").alias("n")).select(F.lit("earners by pay model").alias("what"), F.col("pay_model").alias("key"), "n"))),
    sql("SELECT 'matters by status' AS what, status AS key, count(*) AS n FROM ma GROUP BY status UNION ALL SELECT 'earners by pay model', pay_model, count(*) FROM fe GROUP BY pay_model"))

# --- sources ---------------------------------------------------------------------------


def _pages(spark, records, key, label):
    """Records as files of fifty, written where tasks run; an URL names them, the reader is the same for http.

    ``key`` counts the records from 0 without gaps.
    """
    to = scratch_path(spark, label)
    to = to if "://" in to else f"file://{to}"
    page = (F.floor(F.col(key) / 50) + 1).cast("int")
    bodies = records.groupBy(page.alias("page")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*records.columns))).alias("rows"))).alias("body"))

    def write(rows):
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(to)
        where.create_dir(folder, recursive=True)
        for row in rows:
            with where.open_output_stream(f"{folder}/{row['page']}.json") as out:
                out.write(row["body"].encode())

    bodies.foreachPartition(write)
    return to + "/{page}.json"


def _paged(spark, path):
    s = table(spark, path, "supplier").select("s_suppkey", "s_name", F.struct(F.col("s_nationkey").alias("key")).alias("nation"))
    df = paged.read_pages(spark, "s_suppkey long, s_name string, nation struct<key:long>", url=_pages(spark, s, "s_suppkey", "pages"), lanes="3")
    return df.select("s_suppkey", "s_name", F.col("nation.key").alias("nation"))


add("src_14_paged_reads", _paged, "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")


def _api_records(spark, path):
    """Customers as records of the API: the number counts them, the rest follows from it."""
    k = F.col("c_custkey")
    one_of = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (k % len(texts) + 1).cast("int"))
    return table(spark, path, "customer").select(
        k.alias("number"), k.cast("string").alias("_id"), F.col("c_name").alias("case_name"), F.col("c_name").alias("title"), F.col("c_name").alias("display_name"),
        one_of("IN_PROGRESS", "COMPLETED", "QUOTE", "DELETED", "ON_HOLD").alias("status"), one_of("true", "false", "false").alias("is_archived"),
        F.struct((k % 7).cast("string").alias("_id"), F.concat(F.lit("D"), (k % 7).cast("string")).alias("title")).alias("department"), F.lit("secret").alias("password"),
    )


def _pulled(name):
    return lambda spark, path: datasets.pull(spark, "", name, url=_pages(spark, _api_records(spark, path), "number", name), lanes="4")


_RECORDS = "r AS (SELECT c_custkey AS k, ['IN_PROGRESS', 'COMPLETED', 'QUOTE', 'DELETED', 'ON_HOLD'][c_custkey % 5 + 1] AS status, c_custkey % 3 > 0 AS live FROM customer)"
add("src_16_matters", lambda spark, path: _pulled("matters")(spark, path).groupBy("status", F.col("department.title").alias("department")).agg(F.count("*").alias("n"), F.sum("number").alias("numbers"), F.count("responsible_lawyer").alias("lawyers")),
    f"WITH {_RECORDS} SELECT status, 'D' || k % 7 AS department, count(*) AS n, CAST(sum(k) AS BIGINT) AS numbers, CAST(0 AS BIGINT) AS lawyers FROM r WHERE status IN ('IN_PROGRESS', 'QUOTE', 'ON_HOLD') GROUP BY ALL")
add("src_16_tasks", lambda spark, path: _pulled("tasks")(spark, path).groupBy("status").agg(F.count("*").alias("n"), F.count("title").alias("titles")),
    f"WITH {_RECORDS} SELECT status, count(*) AS n, count(*) AS titles FROM r WHERE status <> 'DELETED' GROUP BY status")
add("src_16_contacts", lambda spark, path: _pulled("contacts")(spark, path).select("_id", "display_name", "type"),
    "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name AS display_name, CAST(NULL AS VARCHAR) AS type FROM customer WHERE c_custkey % 3 > 0")


def _chunks(spark, path):
    to = scratch_path(spark, "chunks")
    n = table(spark, path, "nation")
    n.withColumn("chunk", F.col("n_nationkey") % 4).repartition("chunk").write.partitionBy("chunk").json(to)
    return files.read_chunks(spark, to, 4).select(F.col("n_nationkey").cast("long"), "n_name")


add("src_08_chunked_upload", _chunks, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")


def _routed(spark, path):
    to = scratch_path(spark, "routed")
    r = table(spark, path, "region")
    r.select(F.col("r_regionkey").cast("string"), "r_name").write.option("header", True).csv(to + "/a.csv")
    r.select(F.col("r_regionkey").cast("string"), "r_name").coalesce(1).write.json(to + "/b.json")
    out = None
    for name in ("a.csv", "b.json"):
        own = files.read_any(spark, f"{to}/{name}").select(F.lit(name).alias("file"), F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
        out = own if out is None else out.unionByName(own)
    return out


add("src_05_format_routing", _routed, "SELECT f AS file, CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region, (VALUES ('a.csv'), ('b.json')) AS t(f)")


def _sniffed(spark, path):
    """Suppliers as uploads without a name to go by: a document with another array before the rows, and CSV."""
    to = scratch_path(spark, "sniffed")
    r = table(spark, path, "supplier").select("s_suppkey", "s_name", F.lit(1).alias("one"))
    r.groupBy("one").agg(F.to_json(F.struct(F.array().cast("array<string>").alias("errors"), F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("items"))).alias("value")).select("value").coalesce(1).write.text(to + "/x")
    r.select("s_suppkey", "s_name").repartition(2, "s_suppkey").write.option("header", True).csv(to + "/y")
    out = None
    for name in ("x", "y"):
        own = files.read_upload(spark, f"{to}/{name}").select(F.lit(name).alias("file"), F.lit(files.sniff(spark, f"{to}/{name}")).alias("form"), F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
        out = own if out is None else out.unionByName(own)
    return out


add("src_06_sniffed_upload", _sniffed, "SELECT f AS file, form, s_suppkey, s_name FROM supplier, (VALUES ('x', 'json'), ('y', 'csv')) AS t(f, form)")
add("src_16_one_table_an_endpoint", lambda spark, path: _paged(spark, path).where("nation < 5").groupBy("nation").agg(F.count("*").alias("n")), "SELECT CAST(s_nationkey AS BIGINT) AS nation, count(*) AS n FROM supplier WHERE s_nationkey < 5 GROUP BY 1")


# --- measures, audits and reports ------------------------------------------------------

add("agg_01_hours", on(lambda p: matter_totals(p).select("matter_id", agg.hours(F.col("minutes")).alias("hours"), agg.hours(F.col("chargeable_minutes")).alias("chargeable_hours"), agg.hours(F.col("other_minutes")).alias("other_hours"), (F.col("billable") - F.col("chargeable_value")).alias("other_value"))),
    sql(f"SELECT matter_id, {rnd('minutes / 60.0::DOUBLE')} AS hours, {rnd('chargeable_minutes / 60.0::DOUBLE')} AS chargeable_hours, {rnd('other_minutes / 60.0::DOUBLE')} AS other_hours, {d('billable - chargeable_value', 'other_value')} FROM mg", MATTERS))
add("agg_06_counts", on(lambda p: p.fee_earners.agg(F.count("*").alias("earners"), F.count_if(F.col("pay_model") == "Salaried").alias("salaried"), F.count_if(F.col("pay_model") == "FeeShare").alias("fee_share")).crossJoin(F.broadcast(p.matters.agg(F.count("*").alias("matters"), F.count_if(F.col("status") == "IN_PROGRESS").alias("in_progress"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))))),
    sql("SELECT * FROM (SELECT count(*) AS earners, CAST(count(*) FILTER (pay_model = 'Salaried') AS BIGINT) AS salaried, CAST(count(*) FILTER (pay_model = 'FeeShare') AS BIGINT) AS fee_share FROM fe), (SELECT count(*) AS matters, CAST(count(*) FILTER (status = 'IN_PROGRESS') AS BIGINT) AS in_progress, CAST(count(*) FILTER (status = 'COMPLETED') AS BIGINT) AS completed FROM ma)"))
add("agg_08_missing_percent", on(lambda p: agg.field_statistics(p.matters, ["budget", "status"]).select("field", sc.js_round(sc.percent(F.col("missing"), F.col("rows")), 4).alias("missing_percent"))),
    sql(" UNION ALL ".join(f"SELECT '{f}' AS field, {rnd(pct(f'count(*) FILTER ({f} IS NULL)', 'count(*)'))} AS missing_percent FROM ma" for f in ("budget", "status"))))
add("dq_01_discrepancies", on(lambda p: matter_totals(p).where("discrepancy = 'major'").withColumn("percent", F.abs(sc.percent(F.col("billable") - F.col("net_billing"), F.col("billable")))).groupBy(F.when(F.col("percent") > 30, "high").otherwise("medium").alias("severity")).agg(F.count("*").alias("matters"))),
    sql(f"SELECT CASE WHEN p > 30 THEN 'high' ELSE 'medium' END AS severity, count(*) AS matters FROM (SELECT {pct('abs(billable - net_billing)', 'billable')} AS p FROM mg WHERE billable > 0 AND net_billing > 0) WHERE p > 10 GROUP BY 1", MATTERS))
add("prj_14_audit", lambda spark, path: nm.audit_fields(table(spark, path, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("Password"), F.lit(None).cast("string").alias("token"), F.col("c_mktsegment").alias("API_KEY")), {"password", "token", "api_key"}),
    "SELECT 'Password' AS field, count(*) AS rows FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'API_KEY', count(c_mktsegment) FROM customer")


def _csv_report(spark, path):
    to = scratch_path(spark, "uneven")
    k = F.col("r_regionkey")
    rows = table(spark, path, "region").select(F.when(k == 0, " , ").when(k == 1, "1,a,extra").otherwise(F.concat_ws(",", k.cast("string"), "r_name")).alias("value"))
    head = spark.createDataFrame([("key,name",)], "value string")
    head.unionByName(rows).coalesce(1).write.text(to)
    return files.csv_report(spark, to)


add("src_01_report", _csv_report, "SELECT count(*) - 1 AS kept, CAST(1 AS BIGINT) AS skipped, CAST(1 AS BIGINT) AS uneven FROM region")
add("jon_10_provenance", lambda spark, path: joins.apply_registry(
    table(spark, path, "lineitem").where("l_linenumber <= 3").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("id"), F.when(F.col("l_linenumber") == 2, F.upper(F.concat(F.lit("Ann L"), F.col("l_suppkey").cast("string")))).alias("name")),
    table(spark, path, "supplier").select(F.lit("earner").alias("entity"), F.col("s_suppkey").alias("id"), F.concat(F.lit("Ann L"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("x").alias("dataset")), "earner", "id", "name").select("l_orderkey", "l_linenumber", "id", F.array_join("cross_referenced", ",").alias("filled")),
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber < 3 THEN l_suppkey END AS id, CASE l_linenumber WHEN 1 THEN 'name' WHEN 2 THEN 'id' ELSE '' END AS filled FROM lineitem WHERE l_linenumber <= 3")
add("prj_01_auto_map_table", lambda spark, path: files.auto_map(
    table(spark, path, "part").select(F.regexp_replace("p_brand", "#", "_").alias("header")).distinct().withColumn("position", F.lit(0)), table(spark, path, "part").select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("field")).distinct().withColumn("ordinal", F.lit(0)), {}).select("header", "field", "how"),
    "SELECT DISTINCT replace(p_brand, '#', '_') AS header, lower(replace(p_brand, '#', '')) AS field, 'exact' AS how FROM part")


def _uploads(spark, path):
    from ..operators import quality

    e = table(spark, path, "events")
    own = e.select(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 10 == 0, "processed").when(F.col("event_id") % 3 == 0, "pending").otherwise("failed").alias("status"), F.format_string("%012d", "event_id").alias("uploaded"), F.col("event_id").alias("rows"))
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    return quality.upload_status(own, [*kinds, "zzz"])


add("qry_14_status_of_uploads", _uploads, """SELECT kind, status, uploaded, rows FROM (SELECT event_type AS kind, CASE WHEN event_id % 10 = 0 THEN 'processed' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'failed' END AS status, lpad(CAST(event_id AS VARCHAR), 12, '0') AS uploaded, CAST(event_id AS BIGINT) AS rows,
    row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE 2 END, event_id DESC) AS rn FROM events) WHERE rn = 1 UNION ALL SELECT 'zzz', 'missing', NULL, 0""")
