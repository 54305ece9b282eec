"""Fallbacks and splits of formulas, quality rules, client profiles and dashboard filters, with DuckDB twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg
from ..operators import classify, kpi, lists, quality
from ..session import scratch_path
from ..sources import formulas, snapshots
from .domain import load, rnd, sql
from .kpi_queries import CONFIG, HOURS, LONG_NEEDS, RISK_RULES, WORKDAYS, pct, ref, row, with_
from .list_queries import MD
from .practice_queries import MATTERS, d, matter_totals, plain

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, path: plain(run(load(spark, path)))
    ORACLE[name] = oracle


# --- formulas --------------------------------------------------------------------------

_BY_GRADE = """SELECT '{e}' AS entity_type, CAST({i} AS VARCHAR) AS entity_id, grade, CAST(sum(CASE WHEN write_off > 0 THEN write_off ELSE 0 END) AS DOUBLE) AS amount, count(*) FILTER (write_off > 0) AS entries,
  {p} AS percent FROM w GROUP BY {g}grade HAVING count(*) FILTER (write_off > 0) > 0"""
add("f_wl_02_by_grade", kpi.f_wl_02_by_grade, sql(" UNION ALL ".join(
    _BY_GRADE.format(e=e, i=i, g=g, p=rnd(pct("sum(CASE WHEN write_off > 0 THEN write_off ELSE 0 END)", f"(SELECT sum(write_off) FROM w AS x{where})")))
    for e, i, g, where in (("matter", "matter_id", "matter_id, ", " WHERE x.matter_id = w.matter_id"), ("feeEarner", "lawyer_id", "lawyer_id, ", " WHERE x.lawyer_id = w.lawyer_id"), ("firm", "'firm'", "", ""))),
    "w AS (SELECT te.*, coalesce(grade, 'unknown') AS grade FROM te LEFT JOIN fe USING (lawyer_id))"))
_HELD = "fa LEFT JOIN (SELECT lawyer_id, sum(CASE WHEN is_chargeable THEN minutes ELSE 0 END) / 60.0::DOUBLE AS h FROM te GROUP BY lawyer_id) USING (lawyer_id) LEFT JOIN rv USING (lawyer_id)"
add("f_rb_02_rate_capture", lambda p: kpi.rate_capture(replace(p, fee_earners=p.fee_earners.withColumn("rate", F.when(F.col("lawyer_id") % 6 == 0, 0).when(F.col("lawyer_id") % 7 > 0, F.col("rate"))))),
    with_(f"""SELECT lawyer_id, {rnd('e')} AS effective_rate, CASE WHEN e IS NOT NULL THEN CAST(r AS DOUBLE) END AS charge_out_rate, {rnd('CASE WHEN e = 0 AND r IS NOT NULL THEN 0.0::DOUBLE WHEN e > 0 AND r > 0 THEN e / r * 100.0::DOUBLE END')} AS rate_capture
    FROM (SELECT lawyer_id, CAST(coalesce(gross, 0) AS DOUBLE) / nullif(coalesce(h, 0), 0) AS e, CASE WHEN lawyer_id % 6 = 0 THEN 0 WHEN lawyer_id % 7 > 0 THEN rate END AS r FROM {_HELD})""", "fa", "rv"))
add("f_tu_02_told_gap", lambda p: kpi.f_tu_02(replace(p, time_entries=p.time_entries.withColumn("entry_date", F.when(F.col("lawyer_id") % 3 > 0, F.col("entry_date"))).where("lawyer_id % 4 > 0"),
    fee_earners=p.fee_earners.withColumn("recording_gap_days", F.when(F.col("lawyer_id") % 5 > 0, F.col("lawyer_id") + 2))), ref()),
    with_(row("F-TU-02", "feeEarner", "lawyer_id", f"coalesce(CASE WHEN last IS NOT NULL THEN {WORKDAYS} END, CASE WHEN lawyer_id % 5 > 0 THEN lawyer_id + 2 END)",
              "FROM fa LEFT JOIN (SELECT lawyer_id, max(CASE WHEN lawyer_id % 3 > 0 THEN entry_date END) AS last FROM te WHERE lawyer_id % 4 > 0 GROUP BY lawyer_id) USING (lawyer_id)"), "fa"))


def _velocity(p):
    """Matters of every second client have no entries here; what is known of them stands in."""
    k = F.col("matter_id")
    told = p.matters.select("matter_id", F.when(k % 5 > 1, k % 97).alias("wip_age_days"), (k % 3).alias("invoices"), F.when(k % 4 > 0, (k % 11).cast("decimal(18,4)")).otherwise(F.lit(0)).cast("decimal(18,4)").alias("wip"))
    return kpi.f_rb_04(replace(p, time_entries=p.time_entries.where("matter_id % 2 = 0")), told)


_TOLD = """a AS (SELECT matter_id, CASE WHEN matter_id % 5 > 1 THEN matter_id % 97 END AS age, matter_id % 3 AS invoices, CAST(CASE WHEN matter_id % 4 > 0 THEN matter_id % 11 ELSE 0 END AS DECIMAL(18,4)) AS wip FROM ma),
e AS (SELECT matter_id, avg(age_days) AS v, CAST(sum(age_days * billable_value) AS DOUBLE) AS x, CAST(sum(billable_value) AS DOUBLE) AS w FROM te WHERE matched AND matter_id % 2 = 0 GROUP BY matter_id),
t AS (SELECT matter_id, CASE WHEN invoices > 0 AND wip = 0 THEN 0.0::DOUBLE ELSE CAST(age AS DOUBLE) END AS v, wip FROM a WHERE matter_id NOT IN (SELECT matter_id FROM e) AND (invoices > 0 AND wip = 0 OR age IS NOT NULL OR wip > 0)),
u AS (SELECT * FROM e UNION ALL SELECT matter_id, v, v * CAST(wip AS DOUBLE), CASE WHEN v IS NOT NULL THEN CAST(wip AS DOUBLE) END FROM t)"""
_DEC = lambda c: f"sum(CAST({rnd(c)} AS DECIMAL(28,4)))"
add("f_rb_04_told_age", _velocity, sql(row("F-RB-04", "matter", "matter_id", "v", "FROM u") + " UNION ALL " + row("F-RB-04", "firm", "'firm'", f"CAST({_DEC('x')} AS DOUBLE) / nullif(CAST({_DEC('w')} AS DOUBLE), 0)", "FROM u"), _TOLD))
add("f_wl_03_invoiced", lambda p: kpi.f_wl_03(replace(p, disbursements=p.disbursements.where("matter_id % 3 > 0")), p.matters.where("matter_id % 4 < 2").select("matter_id", (F.col("matter_id") % 6).cast("decimal(18,4)").alias("invoiced_disbursements"))),
    sql(row("F-WL-03", "matter", "matter_id", pct("t - x", "t"), "FROM b WHERE t <> 0") + " UNION ALL " + row("F-WL-03", "firm", "'firm'", pct("sum(t) - sum(x)", "sum(t)"), "FROM b WHERE t <> 0 HAVING sum(t) > 0"),
        """m AS (SELECT matter_id, sum(subtotal) AS t, sum(exposure) AS x FROM di WHERE matter_id % 3 > 0 GROUP BY matter_id),
        b AS (SELECT * FROM m UNION ALL SELECT matter_id, CAST(matter_id % 6 AS DECIMAL(18,4)), 0 FROM ma WHERE matter_id % 4 < 2 AND matter_id NOT IN (SELECT matter_id FROM m))"""))
add("f_pr_05_unbilled", lambda p: kpi.f_pr_05(replace(p, invoices=p.invoices.where("invoice_id < 0")), CONFIG), sql(row("F-PR-05", "firm", "'firm'",
    "(SELECT CAST(sum(billable_value) AS DOUBLE) FROM te) - (SELECT CAST(coalesce(sum(annual_salary), 0) AS DOUBLE) FROM fe WHERE pay_model = 'Salaried' AND NOT is_system_account) - (SELECT CAST(coalesce(sum(exposure), 0) AS DOUBLE) FROM di) - 100000.0::DOUBLE", "")))


def _costs(p):
    """Fee earners with monthly costs besides their salary, and what the firm keeps of a thousand they bill."""
    k = F.col("lawyer_id")
    e = p.fee_earners.withColumns({
        "monthly_employer_ni": F.when(k % 2 == 0, F.lit(100.0)), "monthly_pension": F.when(k % 3 == 0, F.lit(50.5)), "monthly_variable_pay": (k % 5).cast("double"),
        "firm_lead_percent": F.when(k % 8 == 0, F.lit(55.0)), "firm_retain_percent": F.when(k % 3 == 0, F.lit(45.0)), "pay_model": F.when(k % 9 > 0, F.col("pay_model"))})
    return kpi.snippets(e, CONFIG).select("lawyer_id", sc.js_round(F.col("sn_004"), 4).alias("sn_004"), sc.js_round(F.col("sn_001"), 4).alias("sn_001"), sc.js_round(kpi.retained(F.lit(1000.0), e, CONFIG), 4).alias("sn_003"))


_PAY = "CASE WHEN lawyer_id % 9 > 0 AND pay_model = 'Salaried' THEN CAST(annual_salary AS DOUBLE) + 12 * (CASE WHEN lawyer_id % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN lawyer_id % 3 = 0 THEN 50.5::DOUBLE ELSE 0 END + lawyer_id % 5) END"
add("sn_003_sn_004_parts", _costs, sql(f"""SELECT lawyer_id, {rnd(_PAY)} AS sn_004, {rnd(f'({_PAY}) / {HOURS}')} AS sn_001,
    CASE WHEN lawyer_id % 9 = 0 THEN NULL WHEN pay_model = 'Salaried' THEN 1000.0::DOUBLE ELSE 1000.0::DOUBLE * CASE WHEN lawyer_id % 8 = 0 THEN 55 WHEN lawyer_id % 3 = 0 THEN 45 ELSE 40 END / 100 END AS sn_003 FROM fe"""))

# --- client profiles -------------------------------------------------------------------


def _profiles(p):
    """Matters of two clients each, invoices of one, some of them drafts."""
    k = F.col("matter_id")
    m = p.matters.join(p.matter_departments, "matter_id", "left").select(
        F.array("client_id", F.col("client_id") + 1, "client_id").alias("client_ids"), (F.col("status") == "IN_PROGRESS").alias("is_active"), F.concat(F.col("created").cast("string"), F.lit("T10:00:00Z")).alias("created"),
        F.concat(F.date_add("created", (k % 50).cast("int")).cast("string"), F.lit("T10:00:00Z")).alias("updated"), F.when(k % 4 > 0, F.col("department")).alias("department"))
    i = p.invoices.select(F.array("client_id").alias("client_ids"), F.when(k % 3 == 0, "DRAFT").when(k % 3 == 1, "PAID").otherwise("ISSUED").alias("status"), "total", "outstanding", (F.col("total") - F.col("outstanding")).alias("paid"), F.col("invoice_date").cast("string").alias("invoice_date"))
    return lists.client_profiles(p.clients, m, i).withColumn("departments", F.array_join("departments", "|"))


add("jon_15_full_profiles", _profiles, sql(f"""SELECT cl.client_id, display_name, coalesce(n, 0) AS matters, coalesce(active, 0) AS active_matters, first_matter, last_matter, greatest(last_invoice, last_update) AS last_activity, coalesce(departments, '') AS departments,
    {d('t', 'total')}, {d('o', 'outstanding')}, {d('t - o', 'paid')} FROM cl LEFT JOIN (
      SELECT client_id, count(*) AS n, CAST(count(*) FILTER (status = 'IN_PROGRESS') AS BIGINT) AS active, CAST(min(created) AS VARCHAR) AS first_matter, CAST(max(created) AS VARCHAR) AS last_matter, CAST(max(created + CAST(matter_id % 50 AS INTEGER)) AS VARCHAR) AS last_update,
        string_agg(DISTINCT CASE WHEN matter_id % 4 > 0 THEN department END, '|' ORDER BY CASE WHEN matter_id % 4 > 0 THEN department END) AS departments
      FROM (SELECT matter_id, status, created, department, unnest([client_id, client_id + 1]) AS client_id FROM ma LEFT JOIN md USING (matter_id)) GROUP BY client_id) USING (client_id)
    LEFT JOIN (SELECT client_id, sum(total) AS t, sum(outstanding) AS o, CAST(max(invoice_date) AS VARCHAR) AS last_invoice FROM iv WHERE matter_id % 3 > 0 GROUP BY client_id) USING (client_id)""", MD))

# --- data quality ----------------------------------------------------------------------


def _facts(p):
    """Clients are known of three matters in four, activities of none, payment dates of none."""
    known = p.matters.join(p.clients.where("client_id % 4 > 0").select("client_id", "display_name"), "client_id", "left")
    return quality.facts(p.time_entries.withColumn("activity", F.lit(None).cast("string")), known, p.invoices.withColumn("date_paid", F.lit(None).cast("date")))


_HAVE = {"wipJson", "invoicesJson", "contactsJson"}
_FACTS = "q AS (SELECT (SELECT count(*) FROM te) AS entries, (SELECT count(*) FROM te WHERE NOT matched) AS orphans, (SELECT count(*) FROM ma) AS matters, (SELECT count(*) FROM ma WHERE client_id % 4 = 0 OR client_id NOT IN (SELECT client_id FROM cl)) AS unresolved, (SELECT 100.0::DOUBLE * CAST(sum(CASE WHEN NOT matched THEN billable_value ELSE 0 END) AS DOUBLE) / CAST(sum(billable_value) AS DOUBLE) FROM te) AS share)"
add("dq_01_issues", lambda p: quality.entity_issues(_facts(p)), sql("""SELECT 'wipJson' AS dataset, 'orphaned_records' AS issue, CASE WHEN share > 20 THEN 'error' ELSE 'warning' END AS severity, orphans AS affected, entries AS total, CAST(floor(100.0 * orphans / entries + 0.5) AS BIGINT) AS percent FROM q WHERE orphans > 0
    UNION ALL SELECT 'fullMattersJson', 'unresolved_references', CASE WHEN unresolved > 0.2 * matters THEN 'warning' ELSE 'info' END, unresolved, matters, CAST(floor(100.0 * unresolved / matters + 0.5) AS BIGINT) FROM q WHERE unresolved > 0""", _FACTS))
add("dq_01_gaps", lambda p: quality.gaps(_facts(p), _HAVE), sql("""SELECT 'ORPHANED_WIP' AS gap, CASE WHEN floor(share + 0.5) > 20 THEN 'error' ELSE 'warning' END AS severity, 'SN-001 SN-002 SN-003 SN-004' AS formulas FROM q WHERE share > 5
    UNION ALL SELECT 'MISSING_CLIENT_IDS', 'warning', 'SN-007 SN-008' FROM q WHERE unresolved > 0 UNION ALL SELECT 'MISSING_DATE_PAID', 'warning', 'SN-009 SN-010' FROM iv HAVING count(*) > 0 UNION ALL SELECT 'MISSING_ACTIVITY_TYPE', 'info', 'SN-011' FROM q WHERE entries > 0
    UNION ALL SELECT 'MISSING_FEE_EARNER_DATA', 'error', 'SN-005 SN-006 SN-007' UNION ALL SELECT 'MISSING_CLOSED_MATTERS', 'warning', 'SN-003 SN-004'""", _FACTS))
add("dq_01_advice", lambda p: quality.advice(_facts(p), _HAVE).select("priority", "subject"), sql("""SELECT CAST(priority AS BIGINT) AS priority, subject FROM (VALUES (1, 'feeEarner'), (1, 'fullMattersJson'), (3, 'closedMattersJson')) AS t(priority, subject)
    UNION ALL SELECT 2, 'date paid of invoices' FROM iv HAVING count(*) > 0 UNION ALL SELECT 2, 'client ids of matters' FROM q WHERE unresolved > 0""", _FACTS))
add("agg_07_join_report", lambda p: agg.join_report(p.time_entries, p.matters, p.clients.where("client_id % 4 > 0")), sql(
    f"SELECT (SELECT count(*) FROM te WHERE matched) AS matched, orphans AS orphaned, (SELECT {d('sum(billable_value)', 'x').split(' AS x')[0]} FROM te WHERE NOT matched) AS orphaned_value, matters - unresolved AS resolved, unresolved FROM q", _FACTS))
add("agg_08_samples", lambda p: agg.field_samples(p.matters, ["status", "case_type", "matter_number"], 3).withColumn("samples", F.array_join("samples", "|")),
    sql(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS missing, count(DISTINCT {c}) AS distinct_values, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM ma WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples FROM ma" for c in ("status", "case_type", "matter_number"))))

# --- dashboards ------------------------------------------------------------------------


def _matter_rows(p):
    """Matters with the department, and the fee earner who recorded most on them."""
    lead = p.time_entries.groupBy("matter_id", "lawyer_id").agg(F.sum("minutes").alias("m")).groupBy("matter_id").agg(F.max_by("lawyer_id", F.struct("m", -F.col("lawyer_id"))).alias("lawyer_id"))
    return matter_totals(p).join(p.matter_departments, "matter_id", "left").join(lead, "matter_id", "left")


_LEAD = "ld AS (SELECT matter_id, arg_max(lawyer_id, (m, -lawyer_id)) AS lawyer_id FROM (SELECT matter_id, lawyer_id, sum(minutes) AS m FROM te GROUP BY ALL) GROUP BY matter_id)"
add("flt_14_matters", lambda p: lists.filtered(_matter_rows(p), {"department": "NATION_3", "status": ""}, {"lawyer_id": [1, 2, 3, 4, 5, 6, 7, 8, 9], "case_type": []}, {"billable": 1000, "budget": None}, {"age_days": 5000}).select("matter_id", "lawyer_id", "status", "billable"),
    sql(f"SELECT matter_id, lawyer_id, status, {d('billable', 'billable')} FROM mg JOIN md USING (matter_id) JOIN ld USING (matter_id) WHERE department = 'NATION_3' AND lawyer_id BETWEEN 1 AND 9 AND billable >= 1000 AND age_days <= 5000", f"{MATTERS}, {MD}, {_LEAD}"))
add("flt_14_entries", lambda p: lists.filtered(p.time_entries.join(p.fee_earners.select("lawyer_id", "department", "grade", "pay_model"), "lawyer_id", "left"), {"pay_model": "Salaried", "lawyer_id": None}, {"grade": ["Partner", "Junior"]}, {"age_days": 30}).groupBy("department", "grade").agg(F.count("*").alias("n"), agg.total("billable_value").alias("value")),
    sql(f"SELECT department, grade, count(*) AS n, {d('sum(billable_value)', 'value')} FROM te JOIN fe USING (lawyer_id) WHERE pay_model = 'Salaried' AND grade IN ('Partner', 'Junior') AND age_days >= 30 GROUP BY ALL"))
add("flt_14_invoices", lambda p: lists.filtered(p.invoices.join(p.fee_earners.select("lawyer_id", "department"), "lawyer_id", "left"), {"status": "ISSUED"}, {"department": ["NATION_1", "NATION_2", "NATION_5"]}, {}, {"days_overdue": 3000}).select("invoice_id", "department"),
    sql("SELECT invoice_id, department FROM iv JOIN fe USING (lawyer_id) WHERE status = 'ISSUED' AND department IN ('NATION_1', 'NATION_2', 'NATION_5') AND days_overdue <= 3000"))


def _charts(p):
    """Bars of utilisation by fee earner, means by grade, and hours by month, as chart frames (chart, label, series, value)."""
    m = kpi.earner_measures(p, CONFIG, ref())
    bars = m.select(F.lit("utilisation").alias("chart"), F.col("lawyer_name").alias("label"), F.lit("percent").alias("series"), F.col("utilisation").alias("value"))
    grades = m.groupBy("grade").agg(F.avg("utilisation").alias("u"), F.sum(F.col("kept").cast("decimal(28,4)")).cast("double").alias("k"))
    pairs = grades.select(F.lit("grades").alias("chart"), F.col("grade").alias("label"), F.explode(F.create_map(F.lit("utilisation"), F.col("u"), F.lit("kept"), F.col("k"))).alias("series", "value"))
    months = p.time_entries.groupBy(sc.month_key(F.col("entry_date")).alias("label"), F.when(F.col("is_chargeable"), "chargeable").otherwise("other").alias("series")).agg((F.sum("minutes") / 60.0).alias("value"))
    return bars.unionByName(pairs).unionByName(months.select(F.lit("hours").alias("chart"), "label", "series", "value")).withColumn("value", sc.js_round(F.col("value"), 2))


_UTIL = rnd(pct("coalesce(m, 0) / 60.0::DOUBLE", str(HOURS)))
_KEPT = rnd("g * sn_003")
add("qry_02_charts", _charts, with_("", "rv", "sn", "ep").rstrip() + f""",
u AS (SELECT ep.*, {_UTIL} AS u, {_KEPT} AS k FROM ep LEFT JOIN (SELECT lawyer_id, sum(CASE WHEN is_chargeable THEN minutes ELSE 0 END) AS m FROM te GROUP BY lawyer_id) USING (lawyer_id))
SELECT 'utilisation' AS chart, lawyer_name AS label, 'percent' AS series, {rnd('u', 2)} AS value FROM u UNION ALL SELECT 'grades', grade, 'utilisation', {rnd('avg(u)', 2)} FROM u GROUP BY grade
UNION ALL SELECT 'grades', grade, 'kept', {rnd('sum(CAST(k AS DECIMAL(28,4)))', 2)} FROM u GROUP BY grade
UNION ALL SELECT 'hours', strftime(entry_date, '%Y-%m'), CASE WHEN is_chargeable THEN 'chargeable' ELSE 'other' END, {rnd('sum(minutes) / 60.0::DOUBLE', 2)} FROM te GROUP BY ALL""")
add("qry_07_clients", lambda p: lists.page_with_total(agg.clients(p.clients, matter_totals(p)).where("matters > 0").select("client_id", "matters", "net_billing"), [F.desc("net_billing"), F.asc("client_id")], 200),
    sql(f"SELECT client_id, n AS matters, {d('b', 'net_billing')}, total FROM (SELECT *, count(*) OVER () AS total FROM (SELECT client_id, count(*) AS n, sum(net_billing) AS b FROM cl JOIN mg USING (client_id) GROUP BY client_id)) ORDER BY b DESC, client_id LIMIT 200", MATTERS))
add("qry_07_departments", lambda p: matter_totals(p).join(p.matter_departments, "matter_id").groupBy("department").agg(F.count("*").alias("matters"), F.count_if(F.col("status") == "IN_PROGRESS").alias("active"), agg.total("billable").alias("billable"), agg.total("outstanding").alias("outstanding")),
    sql(f"SELECT department, count(*) AS matters, CAST(count(*) FILTER (status = 'IN_PROGRESS') AS BIGINT) AS active, {d('sum(billable)', 'billable')}, {d('sum(outstanding)', 'outstanding')} FROM mg JOIN md USING (matter_id) GROUP BY department", f"{MATTERS}, {MD}"))

# --- user-defined formulas -------------------------------------------------------------

_field = lambda name: {"type": "field", "field": name}
_two = lambda o, a, b: {"type": "operator", "operator": o, "left": a, "right": b}
_const = lambda v: {"type": "constant", "value": v}


def _registry(p):
    """Two formulas, the second reading the first, which is then stored again; a third is deleted."""
    spark, root = p.matters.sparkSession, scratch_path(p.matters.sparkSession, "formulas")
    put = lambda name, tree: formulas.store(spark, root, "firm-1", name, tree, p.matters.columns, {"invoice": p.invoices.columns})
    put("base", _two("divide", _field("budget"), _const(1000)))
    put("double", _two("multiply", {"type": "formula", "id": "base"}, _const(2)))
    put("gone", formulas.instantiate({"type": "field", "field": "{{which}}"}, {"which": "client_id"}, p.matters.columns, {}))
    put("base", _two("subtract", _two("divide", _field("budget"), _const(1000)), _two("percentage", _field("client_id"), _const(1000))))
    formulas.delete(spark, root, "firm-1", "gone")
    return spark, root


def _versions(p):
    spark, root = _registry(p)
    live = formulas.current(spark, root, "firm-1")
    values = formulas.run(live, p.matters, "matter_id").groupBy("kpi_key").agg(F.count("value").alias("measured"))
    return formulas.versions(spark, root, "firm-1").select("formula_id", "version", "is_current", "deleted").join(values.withColumnRenamed("kpi_key", "formula_id"), "formula_id", "left")


add("qry_12_versions", _versions, sql("""SELECT formula_id, CAST(version AS BIGINT) AS version, is_current, deleted, CASE WHEN formula_id <> 'gone' THEN (SELECT count(budget) FROM ma) END AS measured
FROM (VALUES ('base', 1, FALSE, FALSE), ('base', 2, TRUE, FALSE), ('double', 1, TRUE, FALSE), ('gone', 1, FALSE, FALSE), ('gone', 2, TRUE, TRUE)) AS t(formula_id, version, is_current, deleted)"""))


def _trial(p):
    """What ``double`` would change by if matters on hold had no value and others three times their base."""
    spark, root = _registry(p)
    live = formulas.run(formulas.current(spark, root, "firm-1"), p.matters, "matter_id")
    held = {"type": "compare", "operator": "=", "left": _field("status"), "right": _const("ON_HOLD")}
    trial = {"type": "ifThen", "condition": held, "then": _two("divide", _const(1), _const(0)), "else": _two("multiply", {"type": "formula", "id": "base"}, _const(3))}
    new = formulas.run({"double": trial}, p.matters, "matter_id", results=live.where("kpi_key = 'base'"))
    return formulas.changes(live.where("kpi_key = 'double'"), new)


_BASE = "b AS (SELECT matter_id, status, CAST(budget AS DOUBLE) / 1000.0::DOUBLE - CAST(client_id AS DOUBLE) / 1000.0::DOUBLE * 100.0::DOUBLE AS b FROM ma), c AS (SELECT CAST(matter_id AS VARCHAR) AS entity_id, b * 2.0::DOUBLE AS o, CASE WHEN status <> 'ON_HOLD' THEN b * 3.0::DOUBLE END AS n FROM b)"
add("qry_12_trial", lambda p: _trial(p).select("entity_id", sc.js_round(F.col("delta"), 4).alias("delta"), "percent_change"),
    sql(f"SELECT entity_id, {rnd('coalesce(n - o, n, -o)')} AS delta, {rnd('(n - o) / nullif(abs(o), 0) * 100.0::DOUBLE', 2)} AS percent_change FROM c", _BASE))
add("qry_12_trial_summary", lambda p: formulas.summary(_trial(p)), sql(f"""SELECT count(*) AS entities, CAST(count(*) FILTER (d > 0) AS BIGINT) AS improved, CAST(count(*) FILTER (d < 0) AS BIGINT) AS declined, CAST(count(*) FILTER (d IS NULL OR d = 0) AS BIGINT) AS unchanged,
    {rnd(f'CAST(sum(CAST({rnd("d")} AS DECIMAL(28,4))) AS DOUBLE) / count(d)')} AS mean_change FROM (SELECT coalesce(n - o, n, -o) AS d FROM c)""", _BASE))

# --- flags, headers and texts ----------------------------------------------------------


def _flags(p):
    """Risk flags of matters and clients, flagged on days that follow from their ids."""
    found = classify.risk_flags(kpi.kpi_rows(p, CONFIG))
    return found.select("flag", "severity", "entity_type", "entity_id", F.date_sub(ref(), (F.length("entity_id") * 3 + F.ascii(F.reverse("entity_id")) % 10).cast("int")).cast("string").alias("flagged_at"))


_FLAGS = "g AS (SELECT flag, severity, entity_type, entity_id, CAST(DATE '2001-08-15' - CAST(length(entity_id) * 3 + ascii(reverse(entity_id)) % 10 AS INTEGER) AS VARCHAR) AS flagged_at FROM ({rules}) WHERE entity_type <> 'invoice')"


def _flag_twin(body: str) -> str:
    return with_(body, *LONG_NEEDS, "kr").replace("\n" + body, ",\n" + _FLAGS.format(rules=RISK_RULES) + "\n" + body)


add("flt_18_flags", lambda p: snapshots.flags_page(_flags(p), "high", "matter", "WIP_AGE_HIGH", 40).select("flag", "severity", "entity_id", "flagged_at"),
    _flag_twin("SELECT flag, severity, entity_id, flagged_at FROM g WHERE severity = 'high' AND entity_type = 'matter' AND flag = 'WIP_AGE_HIGH' ORDER BY flagged_at DESC, entity_id, flag LIMIT 40"))
add("qry_10_flag_counts", lambda p: snapshots.flag_counts(snapshots.flags_page(_flags(p), limit=500)), _flag_twin(
    "SELECT count(*) AS total, CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high, CAST(count(*) FILTER (severity = 'medium') AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low, max(flagged_at) AS flagged_at FROM (SELECT * FROM g ORDER BY flagged_at DESC, entity_id, flag LIMIT 500)"))
_SPELLED = (("Responsible Lawyer Name", "lawyerid"), ("Total_Fees", "subtotal"), ("is-billable", "billablevalue"), ("Has.Notes", "notes"), ("Matter Ref", "matternumber"), ("Issue", "sue"), ("isX", "isx"), ("Total", "total"), ("Client  Name", "displayname"), ("Responsible Total", "total"))
add("scl_09_headers", lambda p: p.activities.select(F.get(F.array(*[F.lit(x) for x, _ in _SPELLED]), (F.col("part_key") % len(_SPELLED)).cast("int")).alias("header")).groupBy("header", sc.canonical_header(F.col("header")).alias("name")).agg(F.count("*").alias("n")),
    f"SELECT header, name, count(*) AS n FROM part JOIN (VALUES {', '.join(f'({i}, {chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for i, (a, b) in enumerate(_SPELLED))}) AS t(i, header, name) ON p_partkey % {len(_SPELLED)} = i GROUP BY ALL")
add("scl_18_result_texts", lambda p: p.invoices.select("invoice_id", sc.display_result(F.col("outstanding"), "currency").alias("money"), sc.display_result(F.col("outstanding") / 1000, "ratio").alias("ratio"), sc.display_result(-F.col("total"), "number").alias("number"), sc.display_result(F.col("days_overdue"), "days").alias("days")),
    sql("""SELECT invoice_id, '£' || format('{:,.2f}', CAST(round(CAST(CAST(outstanding AS DOUBLE) AS DECIMAL(28,6)), 2) AS DOUBLE)) AS money, CAST(round(CAST(CAST(outstanding AS DOUBLE) / 1000 AS DECIMAL(28,6)), 2) AS VARCHAR) || 'x' AS ratio,
    format('{:,}', CAST(round(CAST(-CAST(total AS DOUBLE) AS DECIMAL(28,6)), 0) AS BIGINT)) AS number, days_overdue || ' days' AS days FROM iv"""))
add("qry_11_affected", lambda p: quality.affected_formulas(p.fee_earners.select(F.when(F.col("lawyer_id") % 2 == 0, "disbursement").otherwise("costRateMethod").alias("name"))),
    "SELECT formula FROM (VALUES ('F-WL-03', 1), ('F-CS-03', 1), ('F-PR-01', 0), ('F-PR-01', 1), ('F-PR-02', 1), ('SN-005', 1)) AS t(formula, kind), supplier GROUP BY formula")
