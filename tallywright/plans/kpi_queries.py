"""KPI queries over the domain views, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, kpi
from ..operators.kpi import DEBT_BANDS, WIP_BANDS, FirmConfig
from .domain import REF_DATE, load, rnd, sql

CONFIG = FirmConfig()
HOURS = CONFIG.available_hours

QUERIES: dict = {}
ORACLE: dict = {}

CAST_D = lambda x: f"CAST({x} AS DOUBLE)"
#: Shared expressions of the twins.
CTES = {
    "wm": "wm AS (SELECT matter_id, sum(billable_value) AS wip, max(age_days) AS age, avg(age_days) AS mean_age FROM te WHERE matched GROUP BY matter_id)",
    "nm": "nm AS (SELECT matter_id, sum(subtotal) AS net FROM iv GROUP BY matter_id)",
    "rv": "rv AS (SELECT lawyer_id, sum(subtotal) AS gross FROM iv GROUP BY lawyer_id)",
    "fa": "fa AS (SELECT * FROM fe WHERE NOT coalesce(is_system_account, FALSE))",
    "dm": "dm AS (SELECT matter_id, sum(subtotal) AS t, sum(exposure) AS x FROM di GROUP BY matter_id)",
    "sn": f"""sn AS (SELECT *, CASE WHEN pay_model = 'Salaried' THEN {CAST_D('annual_salary')} / {HOURS} END AS sn_001, {CAST_D(HOURS)} AS sn_002,
        CASE WHEN pay_model = 'Salaried' THEN 1.0::DOUBLE ELSE {CONFIG.retain / 100}::DOUBLE END AS sn_003, CASE WHEN pay_model = 'Salaried' THEN {CAST_D('annual_salary')} END AS sn_004,
        CASE WHEN pay_model = 'FeeShare' THEN {CAST_D('rate')} * {CONFIG.fee_share_percent}::DOUBLE / 100 ELSE {CAST_D('annual_salary')} / {HOURS} END AS sn_005 FROM fe)""",
    "mc": f"""mc AS (SELECT matter_id, sum(minutes) AS minutes, {CAST_D('sum(minutes * cost_rate)')} / 60.0::DOUBLE AS labour FROM (
        SELECT matter_id, lawyer_id, sum(minutes) AS minutes FROM te WHERE matched GROUP BY ALL) JOIN (SELECT lawyer_id, CAST({rnd('sn_005')} AS DECIMAL(18,4)) AS cost_rate FROM sn) USING (lawyer_id) GROUP BY matter_id)""",
    "ep": f"""ep AS (SELECT sn.*, {CAST_D('coalesce(gross, 0)')} AS g, CASE WHEN pay_model = 'FeeShare' THEN {CAST_D('coalesce(gross, 0)')} * {CONFIG.retain}::DOUBLE / 100 - 2500.0::DOUBLE
        ELSE {CAST_D('coalesce(gross, 0)')} - coalesce(sn_004, 0) END AS profit FROM sn LEFT JOIN rv USING (lawyer_id) WHERE NOT coalesce(is_system_account, FALSE))""",
}


def with_(body: str, *names: str) -> str:
    return sql(body, ",\n".join(CTES[n] for n in names))


def row(key: str, entity: str, entity_id: str, value: str, rest: str) -> str:
    return f"SELECT '{key}' AS kpi_key, '{entity}' AS entity_type, CAST({entity_id} AS VARCHAR) AS entity_id, {rnd(value)} AS value {rest}"


def pct(a: str, b: str) -> str:
    return f"({CAST_D(a)} / nullif({CAST_D(b)}, 0) * 100.0::DOUBLE)"


def ref():
    """The reference date as a column; made when a session is there."""
    return F.to_date(F.lit(REF_DATE))


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = run
    ORACLE[name] = oracle


def _on(formula):
    """A query from a formula over the loaded views."""
    return lambda spark, d: formula(load(spark, d))


def _util(condition: str) -> str:
    return row("F-TU-01", "feeEarner", "lawyer_id", pct("coalesce(m, 0) / 60.0::DOUBLE", str(HOURS)),
               f"FROM fa LEFT JOIN (SELECT lawyer_id, sum(CASE WHEN {condition} THEN minutes ELSE 0 END) AS m FROM te GROUP BY lawyer_id) USING (lawyer_id)")


for variant, condition in (("strict_chargeable", "is_chargeable"), ("broad_chargeable", "NOT do_not_bill"), ("recorded", "TRUE")):
    add(f"f_tu_01_{variant}", _on(lambda p, v=variant: kpi.f_tu_01(p, CONFIG, v)), with_(_util(condition), "fa"))
WORKDAYS = f"(SELECT count(*) FROM generate_series(last + 1, DATE '{REF_DATE}', INTERVAL 1 DAY) AS t(d) WHERE isodow(d) < 6)"
add("f_tu_02", _on(lambda p: kpi.f_tu_02(p, ref())), with_(row("F-TU-02", "feeEarner", "lawyer_id", f"CASE WHEN last IS NOT NULL THEN {WORKDAYS} END", "FROM fa LEFT JOIN (SELECT lawyer_id, max(entry_date) AS last FROM te GROUP BY lawyer_id) USING (lawyer_id)"), "fa"))
add("f_tu_03", _on(kpi.f_tu_03), with_(row("F-TU-03", "feeEarner", "lawyer_id", pct("o", "m"),
    "FROM fa LEFT JOIN (SELECT lawyer_id, sum(minutes) AS m, sum(CASE WHEN do_not_bill OR write_off > 0 OR NOT matched OR NOT is_chargeable THEN minutes ELSE 0 END) AS o FROM te GROUP BY lawyer_id) USING (lawyer_id)"), "fa"))
REAL = pct("coalesce(net, 0)", "wip")
_REAL_FROM = "FROM ma JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) WHERE wip > 0"
add("f_rb_01_all_matters", _on(kpi.f_rb_01), with_(row("F-RB-01", "matter", "matter_id", REAL, _REAL_FROM), "wm", "nm"))
add("f_rb_01_time_billed_only", _on(lambda p: kpi.f_rb_01(p, "time_billed_only")), with_(row("F-RB-01", "matter", "matter_id", REAL, _REAL_FROM + " AND NOT is_fixed_fee"), "wm", "nm"))
add("f_rb_01_adjusted_fixed_fee", _on(lambda p: kpi.f_rb_01(p, "adjusted_fixed_fee")), with_(row("F-RB-01", "matter", "matter_id", f"CASE WHEN is_fixed_fee THEN 100.0::DOUBLE ELSE {REAL} END", _REAL_FROM), "wm", "nm"))
for base, condition in (("chargeable", "is_chargeable"), ("billable", "is_chargeable"), ("total", "TRUE")):
    add(f"f_rb_02_{base}", _on(lambda p, b=base: kpi.f_rb_02(p, b)), with_(row("F-RB-02", "feeEarner", "lawyer_id", f"{CAST_D('coalesce(gross, 0)')} / nullif(coalesce(m, 0) / 60.0::DOUBLE, 0)",
        f"FROM fa LEFT JOIN (SELECT lawyer_id, sum(CASE WHEN {condition} THEN minutes ELSE 0 END) AS m FROM te GROUP BY lawyer_id) USING (lawyer_id) LEFT JOIN rv USING (lawyer_id)"), "fa", "rv"))
add("f_rb_03", _on(lambda p: kpi.f_rb_03(p, CONFIG)), with_(row("F-RB-03", "feeEarner", "lawyer_id", f"{CAST_D('coalesce(gross, 0)')} * sn_003", "FROM sn LEFT JOIN rv USING (lawyer_id) WHERE NOT is_system_account"), "rv", "sn"))
WEIGHTED = "(CAST(sum(age_days * billable_value) AS DOUBLE) / nullif(CAST(sum(billable_value) AS DOUBLE), 0))"
add("f_rb_04", _on(kpi.f_rb_04), with_(row("F-RB-04", "matter", "matter_id", "mean_age", "FROM wm") + " UNION ALL " + row("F-RB-04", "firm", "'firm'", WEIGHTED, "FROM te WHERE matched"), "wm"))
for variant, measure in (("oldest_entry", "max(age_days)"), ("average_entry", "avg(age_days)"), ("weighted_average", WEIGHTED)):
    add(f"f_wl_01_{variant}", _on(lambda p, v=variant: kpi.f_wl_01(p, v)), sql(row("F-WL-01", "matter", "matter_id", measure, "FROM te WHERE matched GROUP BY matter_id") + " UNION ALL " + row("F-WL-01", "firm", "'firm'", measure, "FROM te WHERE matched")))
RECOVERY = "CASE " + " ".join(f"WHEN age_days <= {u} THEN {r}::DOUBLE" for _, u, r in WIP_BANDS if u) + f" ELSE {WIP_BANDS[-1][2]}::DOUBLE END"
LOST = f"{CAST_D('billable_value')} * (1 - {RECOVERY})"
AT_RISK = f"CAST({rnd(LOST)} AS DECIMAL(18,4))"
CTES["ar"] = f"ar AS (SELECT matter_id, CAST(sum(billable_value) AS DECIMAL(18,4)) AS value, {rnd(f'sum({AT_RISK})')} AS at_risk FROM te WHERE matched GROUP BY matter_id)"
add("f_wl_01_at_risk", lambda spark, d: kpi.at_risk(load(spark, d)).select("matter_id", F.col("value").cast("double").alias("value"), "at_risk"), with_("SELECT matter_id, CAST(value AS DOUBLE) AS value, at_risk FROM ar", "ar"))
_WO = pct("sum(write_off)", "sum(billable_value) + sum(write_off)")
_WO_ALL = " UNION ALL ".join(row("F-WL-02", e, i, _WO, "FROM te" + (f" GROUP BY {i}" if e != "firm" else "")) for e, i in (("matter", "matter_id"), ("feeEarner", "lawyer_id"), ("firm", "'firm'")))
add("f_wl_02", _on(kpi.f_wl_02), sql(_WO_ALL))
_DR = pct("sum(subtotal) - sum(exposure)", "sum(subtotal)")
_DR_ALL = row("F-WL-03", "matter", "matter_id", _DR, "FROM di GROUP BY matter_id HAVING sum(subtotal) <> 0") + " UNION ALL " + row("F-WL-03", "firm", "'firm'", _DR, "FROM di")
add("f_wl_03", _on(kpi.f_wl_03), sql(_DR_ALL))
add("f_wl_04", _on(kpi.f_wl_04), sql(row("F-WL-04", "firm", "'firm'", "coalesce((SELECT avg(age_days) FROM te WHERE matched), 0) + coalesce((SELECT avg(days_overdue) FROM iv WHERE outstanding > 0 AND days_overdue > 0), 0)", "")))
_REV, _COST = CAST_D("coalesce(net, wip, 0)"), f"(coalesce(labour, 0) + {CAST_D('coalesce(x, 0)')})"
_FULL = f"({_COST} + coalesce(minutes, 0) / 60.0::DOUBLE * {CONFIG.overhead_per_hour}::DOUBLE)"
for variant, cost in (("standard", _COST), ("full", _FULL)):
    add(f"f_pr_01_{variant}", _on(lambda p, v=variant: kpi.f_pr_01(p, CONFIG, v)), with_(row("F-PR-01", "matter", "matter_id", f"CASE WHEN {_REV} = 0 AND {cost} = 0 THEN NULL ELSE {_REV} - {cost} END",
        "FROM ma LEFT JOIN nm USING (matter_id) LEFT JOIN wm USING (matter_id) LEFT JOIN mc USING (matter_id) LEFT JOIN dm USING (matter_id)"), "nm", "wm", "sn", "mc", "dm"))
add("f_pr_02", _on(lambda p: kpi.f_pr_02(p, CONFIG)), with_(row("F-PR-02", "feeEarner", "lawyer_id", "profit", "FROM ep"), "rv", "sn", "ep"))
CTES["md"] = "md AS (SELECT o_orderkey AS matter_id, n_name AS department FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_LABOUR = f"CAST({rnd('labour')} AS DECIMAL(18,4))"
add("f_pr_03", _on(lambda p: kpi.f_pr_03(p, CONFIG)), with_(row("F-PR-03", "department", "department", "CASE WHEN r = 0 AND l + x + 4000.0::DOUBLE = 0 THEN NULL ELSE r - (l + x + 4000.0::DOUBLE) END",
    f"""FROM (SELECT department, {CAST_D('coalesce(r, 0)')} AS r, {CAST_D('coalesce(l, 0)')} AS l, {CAST_D('coalesce(x, 0)')} AS x FROM (SELECT department FROM fe UNION SELECT department FROM md)
    LEFT JOIN (SELECT department, sum(gross) AS r FROM fe JOIN rv USING (lawyer_id) GROUP BY department) USING (department)
    LEFT JOIN (SELECT department, sum({_LABOUR}) AS l, sum(x) AS x FROM md LEFT JOIN mc USING (matter_id) LEFT JOIN dm USING (matter_id) GROUP BY department) USING (department) WHERE department IS NOT NULL)"""), "rv", "sn", "mc", "dm", "md"))
_MEAN = f"(SELECT {rnd('avg(sn_005)')} FROM sn)"
_HOURS = "(SELECT matter_id, sum(minutes) AS worked FROM te WHERE matched GROUP BY matter_id)"
_SIMPLE = f"(coalesce(worked, 0) / 60.0::DOUBLE * {_MEAN})"
add("f_pr_01_simple", _on(lambda p: kpi.f_pr_01(p, CONFIG, "simple")), with_(row("F-PR-01", "matter", "matter_id", f"CASE WHEN {_REV} = 0 AND {_SIMPLE} = 0 THEN NULL ELSE {_REV} - {_SIMPLE} END", f"FROM ma LEFT JOIN nm USING (matter_id) LEFT JOIN wm USING (matter_id) LEFT JOIN {_HOURS} USING (matter_id)"), "nm", "wm", "sn"))
add("f_pr_01_margin", _on(lambda p: kpi.profit_margin(p, CONFIG)), with_(row("F-PR-01-margin", "matter", "matter_id", f"CASE WHEN {_REV} > 0 THEN ({_REV} - {_COST}) / {_REV} * 100.0::DOUBLE END", "FROM ma LEFT JOIN nm USING (matter_id) LEFT JOIN wm USING (matter_id) LEFT JOIN mc USING (matter_id) LEFT JOIN dm USING (matter_id)"), "nm", "wm", "sn", "mc", "dm"))
add("f_wl_04_from_invoice_date", _on(lambda p: kpi.f_wl_04(p, "from_invoice_date", ref())), sql(row("F-WL-04", "firm", "'firm'", f"coalesce((SELECT avg(age_days) FROM te WHERE matched), 0) + coalesce((SELECT avg(greatest(0, date_diff('day', invoice_date, DATE '{REF_DATE}'))) FROM iv WHERE outstanding > 0), 0)", "")))
add("f_bs_01_by_hours", _on(kpi.f_bs_01_hours), sql(row("F-BS-01", "matter", "matter_id", f"CASE WHEN budget > 0 THEN minutes / 60.0::DOUBLE / nullif({CAST_D('budget')} / nullif(mean_rate, 0), 0) * 100.0::DOUBLE END",
    f"FROM ma LEFT JOIN (SELECT matter_id, sum(minutes) AS minutes, {CAST_D('sum(rate)')} / count(rate) AS mean_rate FROM te LEFT JOIN fe USING (lawyer_id) WHERE matched GROUP BY matter_id) USING (matter_id)")))
for method, cost in (("direct", f"{CAST_D('annual_salary')} / {HOURS}"), ("market_rate", f"CASE WHEN lawyer_id % 2 = 0 THEN 75.0::DOUBLE ELSE {CAST_D('annual_salary')} / {HOURS} END")):
    add(f"sn_005_{method}", lambda spark, d, m=method: kpi.snippets(load(spark, d).fee_earners.withColumn("market_rate", F.when(F.col("lawyer_id") % 2 == 0, F.lit(75.0))), CONFIG, m).select("lawyer_id", kpi.js_round(F.col("sn_005"), 4).alias("sn_005")),
        sql("SELECT lawyer_id, " + rnd(f"CASE WHEN pay_model = 'FeeShare' THEN CAST(rate AS DOUBLE) * 60.0::DOUBLE / 100 ELSE {cost} END") + " AS sn_005 FROM fe"))
add("f_pr_04", _on(lambda p: kpi.f_pr_04(p, CONFIG)), with_(row("F-PR-04", "client", "client_id", f"{CAST_D('coalesce(sum(net), 0)')} - {CAST_D('coalesce(sum(l), 0)')} - {CAST_D('coalesce(sum(x), 0)')}",
    f"FROM ma LEFT JOIN nm USING (matter_id) LEFT JOIN (SELECT matter_id, CAST({rnd('labour')} AS DECIMAL(18,4)) AS l FROM mc) USING (matter_id) LEFT JOIN dm USING (matter_id) GROUP BY client_id"), "nm", "sn", "mc", "dm"))
_SALARIES = "coalesce(sum(CASE WHEN pay_model = 'Salaried' THEN annual_salary END), 0)"
_SHARE = rnd(f"g * {100 - CONFIG.retain}::DOUBLE / 100")
_SHARES = f"coalesce(sum(CASE WHEN pay_model = 'FeeShare' THEN CAST({_SHARE} AS DECIMAL(18,4)) END), 0)"
_NET, _EXPOSED = (f"(SELECT {CAST_D(f'coalesce(sum({c}), 0)')} FROM {t})" for c, t in (("subtotal", "iv"), ("exposure", "di")))
add("f_pr_05", _on(lambda p: kpi.f_pr_05(p, CONFIG)), with_(row("F-PR-05", "firm", "'firm'", f"{_NET} - {CAST_D(_SALARIES)} - {CAST_D(_SHARES)} - {_EXPOSED} - {CONFIG.overhead_total}::DOUBLE", "FROM ep"), "rv", "sn", "ep"))
BURN = f"CASE WHEN budget > 0 THEN {pct('coalesce(wip, 0)', 'budget')} END"
add("f_bs_01", _on(kpi.f_bs_01), with_(row("F-BS-01", "matter", "matter_id", BURN, "FROM ma LEFT JOIN wm USING (matter_id)"), "wm"))
add("f_bs_02", _on(kpi.f_bs_02), with_(row("F-BS-02", "matter", "matter_id", rnd(f"{rnd(BURN)} - {pct('coalesce(net, 0)', 'budget')}", 2), "FROM ma LEFT JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) WHERE budget > 0"), "wm", "nm"))
_AGE = "(CAST(sum(age * outstanding) AS DOUBLE) / nullif(CAST(sum(outstanding) AS DOUBLE), 0))"
CTES["od"] = "od AS (SELECT *, coalesce(days_overdue, 0) AS age FROM iv WHERE outstanding > 0)"
_DM_ALL = row("F-DM-01", "client", "client_id", _AGE, "FROM od GROUP BY client_id") + " UNION ALL " + row("F-DM-01", "firm", "'firm'", _AGE, "FROM od")
add("f_dm_01", _on(kpi.f_dm_01), with_(_DM_ALL, "od"))
_BAND = "CASE " + " ".join(f"WHEN age <= {u} THEN '{n}'" for n, u in DEBT_BANDS if u) + f" ELSE '{DEBT_BANDS[-1][0]}' END"
_BANDS = ", ".join(f"CAST(coalesce(sum(CASE WHEN {_BAND} = '{n}' THEN outstanding END), 0) AS DOUBLE) AS band_{i}" for i, (n, _) in enumerate(DEBT_BANDS))


def top_debtors(spark, d: str):
    """The five clients with the oldest outstanding-weighted debt; ties by client id."""
    p = load(spark, d)
    money = ["outstanding", *(f"band_{i}" for i in range(len(DEBT_BANDS)))]
    debt = kpi.aged_debt(p.invoices, "client_id").orderBy(F.desc("weighted_age"), "client_id").limit(5)
    return debt.join(p.clients, "client_id").select("client_id", "display_name", "weighted_age", F.col("longest").cast("long").alias("longest"), "invoices", *[F.col(m).cast("double").alias(m) for m in money])


add("f_dm_01_top_debtors", top_debtors, with_(f"""SELECT client_id, display_name, weighted_age, longest, invoices, outstanding, {', '.join(f'band_{i}' for i in range(len(DEBT_BANDS)))} FROM (
    SELECT client_id, {rnd(_AGE)} AS weighted_age, CAST(max(age) AS BIGINT) AS longest, count(*) AS invoices, CAST(sum(outstanding) AS DOUBLE) AS outstanding, {_BANDS} FROM od GROUP BY client_id) JOIN cl USING (client_id)
    ORDER BY weighted_age DESC, client_id LIMIT 5""", "od"))
add("f_dm_02_payment_behaviour", _on(lambda p: kpi.f_dm_02(p)), sql(row("F-DM-02", "client", "client_id", "avg(days_overdue)", "FROM iv WHERE outstanding = 0 GROUP BY client_id HAVING count(*) >= 3")))
_U = rnd(pct("coalesce(m, 0) / 60.0::DOUBLE", str(HOURS)))
CTES["tu"] = f"tu AS (SELECT fa.*, {_U} AS u FROM fa LEFT JOIN (SELECT lawyer_id, sum(CASE WHEN is_chargeable THEN minutes ELSE 0 END) AS m FROM te GROUP BY lawyer_id) USING (lawyer_id))"
_GAP = f"({CONFIG.target_hours}::DOUBLE - u / 100 * {HOURS}::DOUBLE)"
_IDLE = rnd(f"{_GAP} * rate")
_IDLE_SUM = f"coalesce(sum(CAST({_IDLE} AS DECIMAL(18,4))), 0)"
_UNBILLED = f"greatest(0.0::DOUBLE, (SELECT {CAST_D('sum(billable_value)')} FROM te WHERE matched) - {_NET})"
add("f_cs_01", _on(lambda p: kpi.f_cs_01(p, CONFIG)), with_(row("F-CS-01", "firm", "'firm'",
    f"(SELECT {CAST_D(_IDLE_SUM)} FROM tu WHERE u < 100 AND {_GAP} > 0) + {_UNBILLED} + (SELECT {CAST_D('sum(CAST(at_risk AS DECIMAL(18,4)))')} FROM ar)", ""), "fa", "tu", "ar"))
_C = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, 0.0::DOUBLE), 100.0::DOUBLE) END"
add("f_cs_02", _on(lambda p: kpi.f_cs_02(p, CONFIG, ref())), with_(row("F-CS-02", "feeEarner", "lawyer_id", rnd(
    f"((((((0.0::DOUBLE + coalesce({_C('u')}, 50) * 25) + coalesce({_C('fr')}, 50) * 20) + coalesce({_C('100 - 10 * g')}, 50) * 15) + coalesce({_C('100 - 2 * w')}, 50) * 15) + coalesce({_C(pct('gross', str(CONFIG.target_revenue)))}, 50) * 15) + coalesce({_C('100 - 0.5::DOUBLE * age')}, 50) * 10) / 100", 0),
    f"""FROM tu LEFT JOIN rv USING (lawyer_id) LEFT JOIN (SELECT lawyer_id, CASE WHEN last IS NOT NULL THEN CAST({WORKDAYS} AS DOUBLE) END AS g FROM (SELECT lawyer_id, max(entry_date) AS last FROM te GROUP BY lawyer_id)) USING (lawyer_id)
        LEFT JOIN (SELECT lawyer_id, {rnd(_WO)} AS w FROM te GROUP BY lawyer_id) USING (lawyer_id) LEFT JOIN (SELECT lawyer_id, max(age_days) AS age FROM te WHERE matched GROUP BY lawyer_id) USING (lawyer_id), (SELECT {rnd(pct('sum(coalesce(net, 0))', 'sum(wip)'))} AS fr FROM ma JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) WHERE wip > 0)"""), "fa", "tu", "rv", "wm", "nm"))
add("f_rb_01_firm", _on(kpi.f_rb_01_firm), with_(row("F-RB-01", "firm", "'firm'", pct("sum(coalesce(net, 0))", "sum(wip)"), _REAL_FROM), "wm", "nm"))
_CS03 = with_(row("F-CS-03", "matter", "matter_id", rnd(
    f"((((0.0::DOUBLE + coalesce({_C('100 - 0.5::DOUBLE * age')}, 50)) + coalesce({_C(f'CASE WHEN burn IS NOT NULL THEN 100 - 2 * greatest(0.0::DOUBLE, burn - 80) END')}, 50)) + coalesce({_C('realised')}, 50)) + coalesce({_C('recovered')}, 50)) / 4", 0),
    f"""FROM (SELECT matter_id, CAST(age AS DOUBLE) AS age, {rnd(BURN)} AS burn, CASE WHEN wip > 0 THEN {rnd(REAL)} END AS realised, CASE WHEN t <> 0 THEN {rnd(pct('t - x', 't'))} END AS recovered
        FROM ma LEFT JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) LEFT JOIN dm USING (matter_id))"""), "wm", "nm", "dm")
add("f_cs_03", _on(kpi.f_cs_03), _CS03)
_PARTS = f"""h AS (SELECT CAST(matter_id AS VARCHAR) AS entity_id, age, {rnd(BURN)} AS burn, CASE WHEN wip > 0 THEN {rnd(REAL)} END AS realised, CASE WHEN t <> 0 THEN {rnd(pct('t - x', 't'))} END AS recovered
    FROM ma LEFT JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) LEFT JOIN dm USING (matter_id))"""
CTES["h"] = _PARTS
add("f_cs_03_flags", _on(kpi.health_flags), with_("SELECT entity_id, 'Over budget' AS flag FROM h WHERE burn > 100 UNION ALL SELECT entity_id, 'Aged WIP at risk' FROM h WHERE age > 90 UNION ALL SELECT entity_id, 'Low realisation' FROM h WHERE realised < 60 UNION ALL SELECT entity_id, 'Low disbursement recovery' FROM h WHERE recovered < 50", "wm", "nm", "dm", "h"))
_CREEP = rnd(f"{rnd(BURN)} - {pct('coalesce(net, 0)', 'budget')}", 2)
add("f_bs_02_label", _on(lambda p: kpi.f_bs_02(p).groupBy(kpi.creep_label(F.col("value")).alias("label")).agg(F.count("*").alias("n"))),
    with_(f"SELECT CASE WHEN v >= 20 THEN 'High scope creep risk' WHEN v >= 10 THEN 'Moderate scope creep' WHEN v > 0 THEN 'Slight scope creep' ELSE 'On track or ahead' END AS label, count(*) AS n FROM (SELECT {_CREEP} AS v FROM ma LEFT JOIN wm USING (matter_id) LEFT JOIN nm USING (matter_id) WHERE budget > 0) GROUP BY 1", "wm", "nm"))
add("sn_snippets", lambda spark, d: kpi.snippets(load(spark, d).fee_earners, CONFIG).select("lawyer_id", *[kpi.js_round(F.col(f"sn_00{i}"), 4).alias(f"sn_00{i}") for i in range(1, 6)]),
    with_("SELECT lawyer_id, " + ", ".join(f"{rnd(f'sn_00{i}')} AS sn_00{i}" for i in range(1, 6)) + " FROM sn", "sn"))

#: One long table of KPIs that status, risk and snapshot queries share.
_AGED = row("F-WL-01", "matter", "matter_id", "max(age_days)", "FROM te WHERE matched GROUP BY matter_id") + " UNION ALL " + row("F-WL-01", "firm", "'firm'", "max(age_days)", "FROM te WHERE matched")
_LOCKUP = row("F-WL-04", "firm", "'firm'", "coalesce((SELECT avg(age_days) FROM te WHERE matched), 0) + coalesce((SELECT avg(days_overdue) FROM iv WHERE outstanding > 0 AND days_overdue > 0), 0)", "")
_LONG = {"F-WL-01": _AGED, "F-WL-02": _WO_ALL, "F-WL-03": _DR_ALL, "F-WL-04": _LOCKUP, "F-DM-01": _DM_ALL, "F-BS-01": row("F-BS-01", "matter", "matter_id", BURN, "FROM ma LEFT JOIN wm USING (matter_id)"),
         "F-RB-01": row("F-RB-01", "matter", "matter_id", REAL, _REAL_FROM), "F-TU-01": _util("is_chargeable")}
CTES["kp"] = "kp AS (" + " UNION ALL ".join(_LONG.values()) + ")"
LONG_NEEDS = ("fa", "wm", "nm", "od", "kp")


def long_table(p):
    """KPI rows of several formulas in one frame, from one pass over each source."""
    return kpi.kpi_rows(p, CONFIG)


#: Bands by hand, so that a wrong constant of the operators shows: KPI, comparison, green, amber.
_BANDS_BY_HAND = (
    ("F-TU-01", ">=", 75, 60), ("F-RB-01", ">=", 85, 70), ("F-WL-01", "<=", 30, 60), ("F-WL-02", "<=", 5, 10), ("F-WL-03", ">=", 90, 75), ("F-WL-04", "<=", 60, 90), ("F-DM-01", "<=", 30, 60), ("F-BS-01", "<=", 80, 95),
)


#: Those of KPIs that the shared table does not hold.
_MORE_BANDS = (("F-TU-02", "<=", 2, 5), ("F-TU-03", "<=", 25, 40), ("F-RB-02", ">=", 200, 150), ("F-RB-03", ">=", 3, 2), ("F-PR-01", ">=", 40, 25))


def _status(v: str = "value", every: bool = False) -> str:
    if every:  # KPIs without bands have no status
        arms = " ".join(f"WHEN kpi_key = '{k}' THEN CASE WHEN {v} IS NULL OR {v} < 0 THEN 'neutral' WHEN {v} {op} {g} THEN 'green' WHEN {v} {op} {a} THEN 'amber' ELSE 'red' END" for k, op, g, a in (*_BANDS_BY_HAND, *_MORE_BANDS))
        return f"CASE {arms} END"
    arms = " ".join(f"WHEN kpi_key = '{k}' THEN CASE WHEN {v} {op} {g} THEN 'green' WHEN {v} {op} {a} THEN 'amber' ELSE 'red' END" for k, op, g, a in _BANDS_BY_HAND)
    return f"CASE WHEN {v} IS NULL OR {v} < 0 THEN 'neutral' {arms} ELSE 'neutral' END"


_TO_NEXT = "CASE kpi_key " + " ".join(f"WHEN '{k}' THEN CASE status WHEN 'red' THEN {rnd(f'abs({a} - value)')} WHEN 'amber' THEN {rnd(f'abs({g} - value)')} END" for k, _, g, a in _BANDS_BY_HAND) + " END"
add("rag_01_status", lambda s, d: classify.evaluate(long_table(load(s, d)), classify.threshold_table(s)),
    with_(f"SELECT *, {_TO_NEXT} AS to_next FROM (SELECT *, {_status()} AS status FROM kp)", *LONG_NEEDS))
add("rag_03_counts", lambda s, d: classify.evaluate(long_table(load(s, d)), classify.threshold_table(s)).groupBy("kpi_key", "status").agg(F.count("*").alias("n")),
    with_(f"SELECT kpi_key, status, count(*) AS n FROM (SELECT kpi_key, {_status()} AS status FROM kp) GROUP BY ALL", *LONG_NEEDS))
add("rag_03_alerts", lambda s, d: classify.alerts(classify.evaluate(long_table(load(s, d)), classify.threshold_table(s))),
    with_(f"SELECT kpi_key, status, count(*) AS n, max(value) AS highest, min(value) AS lowest FROM (SELECT *, {_status()} AS status FROM kp) WHERE status IN ('red', 'amber') GROUP BY ALL", *LONG_NEEDS))


def _overridden(spark, d):
    p = load(spark, d)
    entities = p.fee_earners.select(F.col("lawyer_id").cast("string").alias("entity_id"), "grade", "pay_model")
    bands = classify.override(classify.threshold_table(spark), classify.override_table(spark), entities)
    out = kpi.f_tu_01(p, CONFIG, "recorded").withColumn("value", F.col("value") % 100).join(bands, ["entity_id", "kpi_key"])
    return out.select("entity_id", classify.status(F.col("value"), F.col("higher"), F.col("green"), F.col("amber")).alias("status"))


_OWN = "CASE WHEN grade = 'Partner' THEN {0} WHEN grade = 'Paralegal' THEN {1} WHEN pay_model = 'FeeShare' THEN {2} ELSE {3} END"
add("rag_01_overrides", _overridden, with_(f"""SELECT CAST(lawyer_id AS VARCHAR) AS entity_id, CASE WHEN u >= {_OWN.format(70, 65, 80, 75)} THEN 'green' WHEN u >= {_OWN.format(55, 50, 65, 60)} THEN 'amber' ELSE 'red' END AS status FROM (
    SELECT fa.*, {rnd(pct('coalesce(m, 0) / 60.0::DOUBLE', str(HOURS)))} % 100 AS u FROM fa LEFT JOIN (SELECT lawyer_id, sum(minutes) AS m FROM te GROUP BY lawyer_id) USING (lawyer_id))""", "fa"))
add("rag_04_half_open", lambda s, d: kpi.f_bs_01(load(s, d)).select("entity_id", "value", classify.half_open(F.col("value"), (100, 1e9), (80, 100)).alias("status")),
    with_(f"SELECT entity_id, value, CASE WHEN value IS NULL THEN 'neutral' WHEN value >= 100 AND value < 1e9 THEN 'red' WHEN value >= 80 AND value < 100 THEN 'amber' ELSE 'green' END AS status FROM ({_LONG['F-BS-01']})", "wm"))


def _risky(p):
    return long_table(p).unionByName(kpi.invoice_days(p))


#: Rules by hand: flag, KPI, entity type, high above, medium above.
_RISKS_BY_HAND = (
    ("WIP_AGE_HIGH", "F-WL-01", "matter", 30, 14), ("WIP_AGE_HIGH", "F-WL-04", "firm", 30, 14), ("BUDGET_BURN_CRITICAL", "F-BS-01", "matter", 85, 70), ("DEBTOR_DAYS_HIGH", "F-DM-01", "invoice", 60, 60), ("DEBTOR_DAYS_HIGH", "F-DM-01", "client", 60, 60),
    ("DORMANT_MATTER", "F-WL-01", "matter", 1e12, 14), ("BAD_DEBT_RISK", "F-DM-01", "invoice", 120, 90), ("WRITE_OFF_SPIKE", "F-WL-02", "feeEarner", 10, 5), ("WRITE_OFF_SPIKE", "F-WL-02", "firm", 10, 5),
)
CTES["kr"] = "kr AS (SELECT * FROM kp UNION ALL " + row("F-DM-01", "invoice", "invoice_id", "coalesce(days_overdue, 0)", "FROM iv WHERE outstanding > 0") + ")"
RISK_RULES = " UNION ALL ".join(f"SELECT '{f}' AS flag, CASE WHEN value > {h} THEN 'high' ELSE 'medium' END AS severity, entity_type, entity_id, value FROM kr WHERE kpi_key = '{k}' AND entity_type = '{e}' AND value > {m}" for f, k, e, h, m in _RISKS_BY_HAND)
add("rsk_flags", lambda s, d: classify.risk_flags(_risky(load(s, d))), with_(RISK_RULES, *LONG_NEEDS, "kr"))
_SEV = with_(f"SELECT flag, severity, count(*) AS n FROM ({RISK_RULES}) GROUP BY ALL", *LONG_NEEDS, "kr")
add("agg_22_severity_counts", lambda s, d: classify.risk_flags(_risky(load(s, d))).groupBy("flag", "severity").agg(F.count("*").alias("n")), _SEV)
_M = lambda c: f"(SELECT lawyer_id, {rnd(pct('coalesce(m, 0) / 60.0::DOUBLE', str(HOURS)))} AS v FROM fa LEFT JOIN (SELECT lawyer_id, sum(CASE WHEN {c} THEN minutes ELSE 0 END) AS m FROM te GROUP BY lawyer_id) USING (lawyer_id))"
add("win_07_utilisation_drop", lambda s, d: (lambda p: classify.risk_flags(kpi.f_tu_01(p, CONFIG), kpi.f_tu_01(p, CONFIG, "recorded")))(load(s, d)),
    with_(f"SELECT 'UTILISATION_DROP' AS flag, CASE WHEN fell > 30 THEN 'high' ELSE 'medium' END AS severity, 'feeEarner' AS entity_type, CAST(lawyer_id AS VARCHAR) AS entity_id, {rnd('fell')} AS value FROM (SELECT lawyer_id, (b.v - a.v) / b.v * 100 AS fell FROM {_M('is_chargeable')} a JOIN {_M('TRUE')} b USING (lawyer_id) WHERE b.v > 0) WHERE fell > 20", "fa"))
