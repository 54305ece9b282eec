"""Records as an API delivers them, built from the provided tables, through the API transforms.

The twins spell every constant out by hand; they import none from the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transforms as tr
from ..session import table
from .domain import REF_DATE
from .practice_queries import plain

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: plain(run(spark, d))
    ORACLE[name] = oracle


def _text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _who(key, when=None):
    """A person struct with two rates, the second the default."""
    k = F.col(key)
    rates = F.array(F.struct((k + 100).cast("double").alias("value"), F.lit(False).alias("default")), F.struct((k + 200).cast("double").alias("value"), (k % 3 > 0).alias("default")))
    own = F.struct(k.cast("string").alias("_id"), F.concat(F.lit("First"), k.cast("string")).alias("name"), F.concat(F.lit("Last"), k.cast("string")).alias("surname"), rates.alias("rates"))
    return own if when is None else F.when(when, own)


def raw_attorneys(spark, d):
    s = table(spark, d, "supplier")
    person = _who("s_suppkey")
    return s.select(
        person["_id"].alias("_id"), person["name"].alias("name"), person["surname"].alias("surname"), F.when(F.col("s_suppkey") % 4 == 0, "DISABLED").otherwise("ENABLED").alias("status"),
        F.when(F.col("s_suppkey") % 5 > 0, person["rates"]).alias("rates"), F.lower("s_name").alias("email"), F.lit(None).cast("string").alias("job_title"),
        F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("integration_account_id"), F.lit("secret").alias("password"),
    )


add("prj_10_attorneys", lambda spark, d: tr.attorneys(tr.pruned(raw_attorneys(spark, d), "attorney")).select("lawyer_id", "full_name", "email", "status", "default_rate", "n_rates", "job_title"),
    """SELECT CAST(s_suppkey AS VARCHAR) AS lawyer_id, 'First' || s_suppkey || ' Last' || s_suppkey AS full_name, lower(s_name) AS email, CASE WHEN s_suppkey % 4 = 0 THEN 'DISABLED' ELSE 'ENABLED' END AS status,
    CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 THEN CAST(s_suppkey + 200 AS DOUBLE) END AS default_rate, CAST(CASE WHEN s_suppkey % 5 > 0 THEN 2 ELSE 0 END AS BIGINT) AS n_rates, CAST(NULL AS VARCHAR) AS job_title FROM supplier""")
add("prj_13_pruned", lambda spark, d: tr.pruned(raw_attorneys(spark, d), "attorney").select(F.array_join(F.array(*[F.lit(c) for c in tr.pruned(raw_attorneys(spark, d), "attorney").columns]), ",").alias("fields")).groupBy("fields").agg(F.count("*").alias("n")),
    "SELECT '_id,name,surname,status,job_title,rates,email,integration_account_id' AS fields, count(*) AS n FROM supplier")


def raw_matters(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    contact = lambda c: F.struct(F.struct(c.cast("string").alias("_id"), F.concat(F.lit("Client "), c.cast("string")).alias("display_name")).alias("contact"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "IN_PROGRESS").otherwise("NOT_PROCEEDING")
    return o.select(
        k.cast("string").alias("_id"), k.alias("number"), F.col("o_clerk").alias("case_name") if "o_clerk" in o.columns else F.lit("case").alias("case_name"), status.alias("status"), F.col("o_totalprice").alias("financial_limit"),
        _who("o_custkey", k % 4 > 0).alias("responsible_lawyer"), _who("o_custkey", k % 8 == 0).alias("responsible_supervisor"),
        F.when(k % 3 > 0, F.struct((k % 5).cast("string").alias("_id"), F.when(k % 2 == 0, F.lit("Own")).otherwise("").alias("title"))).alias("department"),
        F.struct(F.substring("o_orderpriority", 1, 1).alias("_id"), F.lit(None).cast("string").alias("title")).alias("case_type"),
        F.when(k % 6 > 0, F.array(contact(F.col("o_custkey")), contact(F.col("o_custkey") + 1))).alias("clients"),
    )


def _case_types(spark, d):
    return table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("id"), F.substring("o_orderpriority", 3, 20).alias("title"), (F.substring("o_orderpriority", 1, 1) == "1").alias("is_fixed_fee")).distinct()


def _departments(spark, d):
    """Deleted departments are no names."""
    raw = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("title"), (F.col("r_regionkey") == 4).alias("is_deleted"))
    return raw.where(~F.coalesce("is_deleted", F.lit(False)))


_MATTERS = """SELECT CAST(o_orderkey AS VARCHAR) AS matter_id, o_orderkey AS matter_number, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'NOT_PROCEEDING' END AS status, o_totalprice AS budget,
    o_orderstatus = 'O' AS is_active, o_orderstatus <> 'O' AS is_closed, o_orderpriority LIKE '1%' AS is_fixed_fee, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS VARCHAR) END AS lawyer_id,
    CASE WHEN o_orderkey % 4 > 0 THEN 'First' || o_custkey || ' Last' || o_custkey END AS lawyer_name, CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 3 > 0 THEN CAST(o_custkey + 200 AS DOUBLE) END AS lawyer_rate,
    CASE WHEN o_orderkey % 8 = 0 THEN 'First' || o_custkey || ' Last' || o_custkey END AS supervisor_name, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Own' ELSE r_name END END AS department_name,
    substr(o_orderpriority, 3) AS case_type_name, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_custkey AS VARCHAR) END AS client_id, CASE WHEN o_orderkey % 6 > 0 THEN 'Client ' || o_custkey END AS client_name,
    CASE WHEN o_orderkey % 6 > 0 THEN o_custkey || '|' || (o_custkey + 1) ELSE '' END AS client_ids
    FROM orders LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 4) ON o_orderkey % 5 = r_regionkey"""
add("prj_10_matters", lambda spark, d: tr.matters(tr.pruned(raw_matters(spark, d), "matter"), _case_types(spark, d), _departments(spark, d)).select(
    "matter_id", "matter_number", "status", "budget", "is_active", "is_closed", "is_fixed_fee", "lawyer_id", "lawyer_name", "lawyer_rate", "supervisor_name", "department_name", "case_type_name", "client_id", "client_name", F.array_join("client_ids", "|").alias("client_ids")), _MATTERS)
add("flt_16_deleted_departments", lambda spark, d: _departments(spark, d).select("id", "title"), "SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS title FROM region WHERE r_regionkey NOT IN (4)")


def raw_entries(spark, d):
    li = table(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        F.concat_ws("-", k.cast("string"), n.cast("string")).alias("_id"), (F.col("l_returnflag") == "R").alias("do_not_bill"), F.col("l_extendedprice").alias("billable"), (F.col("l_extendedprice") * F.col("l_discount")).alias("write_off"),
        (F.col("l_quantity") * 6).alias("duration_minutes"), F.when(n % 2 == 0, n).alias("units"), F.struct(k.cast("string").alias("_id"), k.alias("number")).alias("matter"), _who("l_suppkey", n % 5 > 0).alias("assignee"),
        F.when(n % 3 > 0, F.struct(F.col("l_shipmode").alias("title"))).alias("activity") if "l_shipmode" in li.columns else F.when(n % 3 > 0, F.struct(F.col("l_linestatus").alias("title"))).alias("activity"),
        F.lit("work").alias("work_type"), F.col("l_shipdate").alias("date"), F.when(n % 2 == 1, k.cast("string")).alias("invoice"),
        F.when(n == 4, "CONSOLIDATED").when(n == 5, "DELETED").when(n == 6, "CONSOLIDATION_TARGET").when(n == 7, "").when(n > 1, "ACTIVE").alias("status"),
    )


add("prj_10_time_entries", lambda spark, d: tr.time_entries(tr.pruned(raw_entries(spark, d), "time_entry")).groupBy("is_chargeable", "entry_status", "units").agg(
    F.count("*").alias("n"), F.round(F.sum(F.col("hours").cast("decimal(18,4)")), 2).alias("hours"), F.count("lawyer_name").alias("named"), F.count("invoice_id").alias("billed"), F.sum(F.col("recorded_value").cast("decimal(18,4)")).alias("recorded")),
    """SELECT l_returnflag <> 'R' AND l_extendedprice > 0 AS is_chargeable, CASE l_linenumber WHEN 4 THEN 'CONSOLIDATED' WHEN 5 THEN 'DELETED' WHEN 6 THEN 'CONSOLIDATION_TARGET' WHEN 7 THEN '' ELSE 'ACTIVE' END AS entry_status,
    CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END AS BIGINT) AS units, count(*) AS n, CAST(round(sum(CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 6 / 60.0::DOUBLE ELSE l_quantity * 6 / 60.0::DOUBLE END AS DECIMAL(18,4))), 2) AS DOUBLE) AS hours,
    CAST(count(*) FILTER (l_linenumber % 5 > 0) AS BIGINT) AS named, CAST(count(*) FILTER (l_linenumber % 2 = 1) AS BIGINT) AS billed, CAST(sum(CAST(l_extendedprice + l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS recorded FROM lineitem GROUP BY ALL""")
add("flt_06_entry_statuses", lambda spark, d: tr.excluded(raw_entries(spark, d), "status", tr.EXCLUDED_ENTRY).groupBy("status").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber > 1 THEN 'ACTIVE' END AS status, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (4, 5, 6) GROUP BY 1")


def raw_invoices(spark, d):
    o = table(spark, d, "orders")
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        k.cast("string").alias("_id"), k.alias("invoice_number"), F.col("o_orderdate").alias("invoice_date"), F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"), F.when(k % 4 > 0, total).alias("subtotal"),
        F.when(k % 3 == 0, total / 2).alias("billing_amount"), F.when(k % 2 == 0, total * 2).alias("billable_entries"), F.when(k % 5 == 0, F.lit(10.0)).alias("total_firm_fees"), F.when(k % 7 == 0, F.lit(5.0)).alias("total_disbursements"),
        F.when(k % 6 == 0, F.lit(25.0)).alias("total_other_fees"), F.when(k % 2 == 0, F.lit(1.0)).alias("time_entries_override_value"), F.array(F.concat(k.cast("string"), F.lit("-1")), F.concat(k.cast("string"), F.lit("-3"))).alias("time_entries"),
        total.alias("total"), F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(total).alias("outstanding"), F.when(F.col("o_orderstatus") == "F", total).otherwise(0.0).alias("paid"), F.lit(0.0).alias("written_off"),
        F.when(k % 9 == 0, "DRAFT").when(k % 9 == 1, "WRITTEN_OFF").when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "O", "ISSUED").alias("status"),
        F.when(k % 10 > 0, F.struct(F.col("o_custkey").cast("string").alias("_id"), F.lit("Solicitor").alias("name"))).alias("solicitor"), F.when(k % 8 > 0, F.struct(k.cast("string").alias("_id"), k.alias("number"))).alias("matter"),
        F.array(F.struct(F.col("o_custkey").cast("string").alias("_id"), F.lit("c").alias("display_name"))).alias("clients"),
    )


#: Raw invoices in SQL, amounts with missing ones as they are.
_INV = """ri AS (SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS subtotal, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END AS billing_amount,
    CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE 0 END AS billable_entries, CASE WHEN o_orderkey % 5 = 0 THEN 10.0 ELSE 0 END AS firm_fees, CASE WHEN o_orderkey % 7 = 0 THEN 5.0 ELSE 0 END AS disb,
    CASE WHEN o_orderkey % 6 = 0 THEN 25.0 ELSE 0 END AS other_fees, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0 END AS override_value, o_totalprice AS total, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS outstanding,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS paid, CASE WHEN o_orderkey % 9 = 0 THEN 'DRAFT' WHEN o_orderkey % 9 = 1 THEN 'WRITTEN_OFF' WHEN o_orderstatus = 'F' THEN 'PAID' WHEN o_orderstatus = 'O' THEN 'ISSUED' ELSE '' END AS status,
    CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_custkey AS VARCHAR) END AS lawyer_id, CASE WHEN o_orderkey % 8 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS matter_id, CAST(o_orderdate AS DATE) AS invoice_date FROM orders)"""


def api_invoices(spark, d):
    return tr.invoices(tr.pruned(raw_invoices(spark, d), "invoice"))


add("prj_10_invoices", lambda spark, d: api_invoices(spark, d).select("invoice_id", "subtotal", "billing_amount", "billable_entries", "total_other_fees", "override_value", F.array_join("entry_ids", ",").alias("entry_ids"), "status", "lawyer_id", "matter_id", "client_id"),
    f"""WITH {_INV} SELECT invoice_id, coalesce(subtotal, 0.0) AS subtotal, coalesce(billing_amount, subtotal, 0.0) AS billing_amount, CAST(billable_entries AS DOUBLE) AS billable_entries, CAST(other_fees AS DOUBLE) AS total_other_fees, CAST(override_value AS DOUBLE) AS override_value,
    k || '-1,' || k || '-3' AS entry_ids, status, lawyer_id, matter_id, CAST(o_custkey AS VARCHAR) AS client_id FROM ri JOIN orders ON k = o_orderkey""")
add("prj_12_fee_earner_revenue", lambda spark, d: api_invoices(spark, d).select("invoice_id", "fee_earner_revenue"), f"WITH {_INV} SELECT invoice_id, CAST(coalesce(subtotal, 0) - firm_fees - disb AS DOUBLE) AS fee_earner_revenue FROM ri")


def raw_ledgers(spark, d):
    li = table(spark, d, "lineitem")
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    return li.select(
        F.concat_ws("-", k.cast("string"), n.cast("string")).alias("_id"), F.when(n % 3 == 0, "OFFICE_PAYMENT").when(n % 3 == 1, "CLIENT_TO_OFFICE").otherwise("OFFICE_RECEIPT").alias("type"), (-F.col("l_extendedprice")).alias("value"), (-F.col("l_tax")).alias("vat"),
        F.when(F.col("l_returnflag") == "N", -F.col("l_quantity")).when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_quantity")).alias("outstanding"), F.lit(None).cast("string").alias("reference"), F.col("l_suppkey").cast("string").alias("payee"),
        F.struct(k.cast("string").alias("_id"), k.alias("number")).alias("matter"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.struct(F.col("l_suppkey").cast("string").alias("_id")).alias("responsible_lawyer"),
        F.when(n % 2 == 0, k.cast("string")).alias("invoice"), F.when(n % 5 > 1, F.array(F.lit("x"))).alias("disbursements"), F.lit("OK").alias("status"),
    )


add("prj_10_disbursements", lambda spark, d: tr.disbursements(raw_ledgers(spark, d)).groupBy("type", "is_recovered").agg(F.count("*").alias("n"), F.sum(F.col("subtotal").cast("decimal(18,4)")).alias("subtotal"), F.sum(F.col("exposure").cast("decimal(18,4)")).alias("exposure")),
    """SELECT CASE l_linenumber % 3 WHEN 0 THEN 'OFFICE_PAYMENT' WHEN 1 THEN 'CLIENT_TO_OFFICE' ELSE 'OFFICE_RECEIPT' END AS type, l_returnflag = 'A' AS is_recovered, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS subtotal,
    CAST(sum(CAST(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS DECIMAL(18,4))) AS DOUBLE) AS exposure FROM lineitem GROUP BY ALL""")
add("flt_07_ledger_filters", lambda spark, d: tr.ledgers(raw_ledgers(spark, d), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("matter_id")), "1996-01-01").groupBy("type").agg(F.count("*").alias("n")),
    """SELECT CASE l_linenumber % 3 WHEN 0 THEN 'OFFICE_PAYMENT' WHEN 1 THEN 'CLIENT_TO_OFFICE' ELSE 'OFFICE_RECEIPT' END AS type, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    AND NOT (l_linenumber % 3 = 0 AND l_returnflag = 'A' AND l_shipdate < '1996-01-01') GROUP BY 1""")
add("set_06_ledger_routes", lambda spark, d: tr.routes(raw_ledgers(spark, d)).groupBy("route").agg(F.count("*").alias("n")),
    """SELECT route, count(*) AS n FROM (SELECT 'disbursements' AS route FROM lineitem WHERE l_linenumber % 3 = 0 UNION ALL SELECT 'invoicePayments' FROM lineitem WHERE l_linenumber % 3 > 0 AND l_linenumber % 2 = 0
    UNION ALL SELECT 'disbursementRecoveries' FROM lineitem WHERE l_linenumber % 3 > 0 AND l_linenumber % 5 > 1) GROUP BY route""")


def raw_tasks(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.cast("string").alias("_id"), F.lit("task").alias("title"), F.when(k % 11 > 0, F.to_date("o_orderdate")).alias("due_date"), F.when(k % 3 == 0, "DELETED").when(k % 3 == 1, "COMPLETED").when(k % 2 == 0, "NOT_STARTED").alias("status"), F.col("o_orderpriority").alias("priority"),
                    F.when(k % 5 > 0, F.struct(k.cast("string").alias("_id"), k.alias("number"))).alias("matter"), _who("o_custkey", k % 4 > 0).alias("assigned_to"))


add("prj_10_tasks", lambda spark, d: tr.tasks(raw_tasks(spark, d), F.to_date(F.lit("1998-01-01"))).groupBy("status", "is_overdue").agg(F.count("*").alias("n"), F.count("lawyer_name").alias("named"), F.count("matter_id").alias("on_matters")),
    """SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'COMPLETED' WHEN o_orderkey % 2 = 0 THEN 'NOT_STARTED' END AS status, coalesce(o_orderkey % 3 <> 1 AND o_orderkey % 2 = 0 AND o_orderkey % 11 > 0 AND CAST(o_orderdate AS DATE) < DATE '1998-01-01', FALSE) AS is_overdue,
    count(*) AS n, CAST(count(*) FILTER (o_orderkey % 4 > 0) AS BIGINT) AS named, CAST(count(*) FILTER (o_orderkey % 5 > 0) AS BIGINT) AS on_matters FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2""")
add("prj_10_contacts", lambda spark, d: tr.contacts(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.when(F.col("c_custkey") % 3 == 0, "Company").when(F.col("c_custkey") % 3 == 1, "Person").alias("type"), F.col("c_name").alias("display_name"), F.lit(None).cast("string").alias("company_name"))).select("client_id", "display_name", "is_company"),
    "SELECT CAST(c_custkey AS VARCHAR) AS client_id, c_name AS display_name, c_custkey % 3 = 0 AS is_company FROM customer")
add("prj_16_billing_type", lambda spark, d: table(spark, d, "orders").select(tr.billing_type(F.when(F.col("o_orderkey") % 3 == 0, "hourly").when(F.col("o_orderkey") % 3 == 1, "other"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 4 == 0)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'hourly' WHEN o_orderkey % 4 = 0 THEN 'fixed_fee' WHEN o_orderkey % 2 = 0 THEN 'hourly' ELSE 'unknown' END AS kind, count(*) AS n FROM orders GROUP BY 1")
add("prj_07_matter_rules", lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.array_join(tr.parsed_list(F.when(F.col("o_orderkey") % 2 == 0, F.format_string('["%d","%d"]', "o_custkey", F.col("o_custkey") + 1)).otherwise("plain")), "+").alias("client_ids")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '+' || (o_custkey + 1) END AS client_ids FROM orders")
add("jon_12_resolved", lambda spark, d: tr.filled(
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_suppkey").cast("string")).alias("lawyer_id"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(1.0)).alias("rate"), F.lit(None).cast("string").alias("lawyer_status")),
    tr.attorneys(raw_attorneys(spark, d)).select(F.col("lawyer_id").alias("id"), "default_rate", "status"), "lawyer_id", {"rate": "default_rate", "lawyer_status": "status"}).select("l_orderkey", "l_linenumber", "rate", "lawyer_status"),
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE WHEN l_linenumber % 4 > 0 AND l_suppkey % 5 > 0 AND l_suppkey % 3 > 0 THEN CAST(l_suppkey + 200 AS DOUBLE) END AS rate,
    CASE WHEN l_linenumber % 4 > 0 AND s_suppkey IS NOT NULL THEN CASE WHEN l_suppkey % 4 = 0 THEN 'DISABLED' ELSE 'ENABLED' END END AS lawyer_status FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")


def _closed(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    k = F.col("o_orderkey")
    return o.select(F.when(k % 2 == 0, k).alias("matter_id"), F.concat(F.lit("M"), k.cast("string")).alias("matter_number"), F.col("o_totalprice").alias("net_billing"), F.lit(3.0).alias("wip_billable"), k.alias("row_idx"))


add("jon_05_closed_supplement", lambda spark, d: tr.supplemented(
    table(spark, d, "orders").select(F.col("o_orderkey").alias("matter_id"), F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("matter_number"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1.0)).alias("net_billing"), F.lit(None).cast("double").alias("wip_billable")),
    _closed(spark, d), ["net_billing", "wip_billable"]).select("matter_id", "net_billing", "wip_billable", "has_closed"),
    "SELECT o_orderkey AS matter_id, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE WHEN o_orderstatus = 'F' THEN o_totalprice END AS net_billing, CASE WHEN o_orderstatus = 'F' THEN 3.0::DOUBLE END AS wip_billable, o_orderstatus = 'F' AS has_closed FROM orders")

# --- attribution over the API's records ------------------------------------------------


def _attributed(spark, d):
    entries = tr.time_entries(raw_entries(spark, d))
    return attribution(api_invoices(spark, d), entries)


def attribution(invoices, entries):
    """(lawyer_id, from_entries, uplift, other_fees, net_billing, outstanding, paid, invoices) by fee earner.

    Three grouped branches with one schema, added up once: values of entries billed on an
    attributed invoice to who worked them; what an overridden invoice bills above its
    entries, and its billing amount and other fees, to who signs it.
    """
    money = lambda c: c.cast("decimal(18,4)")
    zero = F.lit(0).cast("decimal(18,4)")
    valid = invoices.where(F.col("status").isin(*tr.ATTRIBUTED_INVOICE))
    worked = entries.where("lawyer_id is not null").join(valid.select("invoice_id"), "invoice_id", "left_semi").select("lawyer_id", money(F.col("billable")).alias("from_entries"))
    signed = valid.where("lawyer_id is not null")
    values = entries.select(F.col("entry_id"), money(F.col("billable")).alias("value"))
    listed = signed.where("override_value > 0").select("invoice_id", "lawyer_id", "billable_entries", F.explode_outer("entry_ids").alias("entry_id")).join(values, "entry_id", "left")
    uplift = listed.groupBy("invoice_id", "lawyer_id", "billable_entries").agg(F.coalesce(F.sum("value"), zero).alias("entered")).select(
        "lawyer_id", F.greatest(zero, money(F.col("billable_entries")) - F.col("entered")).cast("decimal(18,4)").alias("uplift"))
    other = F.col("billing_amount") + F.col("total_other_fees")
    fees = signed.select("lawyer_id", money(F.when(other > 0, other).otherwise(0)).alias("other_fees"), money(F.col("outstanding")).alias("outstanding"), money(F.col("paid")).alias("paid"), F.lit(1).alias("invoices"))
    every = worked.unionByName(uplift, allowMissingColumns=True).unionByName(fees, allowMissingColumns=True)
    out = every.groupBy("lawyer_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("from_entries", "uplift", "other_fees", "outstanding", "paid", "invoices")])
    return out.withColumn("net_billing", F.col("from_entries") + F.col("uplift") + F.col("other_fees"))


_D4 = lambda x: f"CAST({x} AS DECIMAL(18,4))"
add("agg_12_three_branches", _attributed, f"""WITH {_INV}, v AS (SELECT * FROM ri WHERE status IN ('ISSUED', 'PAID', 'CREDITED', 'WRITTEN_OFF')),
    e AS (SELECT l_orderkey || '-' || l_linenumber AS entry_id, CASE WHEN l_linenumber % 5 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS lawyer_id, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_orderkey AS VARCHAR) END AS invoice_id, {_D4('l_extendedprice')} AS value FROM lineitem),
    b AS (SELECT lawyer_id, value AS a, 0 AS u, 0 AS f, 0 AS o, 0 AS p, 0 AS n FROM e WHERE lawyer_id IS NOT NULL AND invoice_id IN (SELECT invoice_id FROM v)
      UNION ALL SELECT lawyer_id, 0, greatest(0, {_D4('billable_entries')} - coalesce((SELECT sum(value) FROM e WHERE e.entry_id IN (v.k || '-1', v.k || '-3')), 0)), 0, 0, 0, 0 FROM v WHERE lawyer_id IS NOT NULL AND override_value > 0
      UNION ALL SELECT lawyer_id, 0, 0, {_D4('coalesce(billing_amount, subtotal, 0) + other_fees')}, {_D4('outstanding')}, {_D4('paid')}, 1 FROM v WHERE lawyer_id IS NOT NULL)
    SELECT lawyer_id, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {n}' for c, n in (('a', 'from_entries'), ('u', 'uplift'), ('f', 'other_fees'), ('o', 'outstanding'), ('p', 'paid')))}, CAST(sum(n) AS BIGINT) AS invoices, CAST(sum(a) + sum(u) + sum(f) AS DOUBLE) AS net_billing FROM b GROUP BY lawyer_id""")
add("flt_08_billable_statuses", lambda spark, d: (lambda x: x.select(F.col("status").isin(*tr.BILLABLE_INVOICE).alias("on_matters"), F.col("status").isin(*tr.ATTRIBUTED_INVOICE).alias("on_earners")).groupBy("on_matters", "on_earners").agg(F.count("*").alias("n")))(api_invoices(spark, d)),
    f"WITH {_INV} SELECT status IN ('ISSUED', 'PAID', 'CREDITED') AS on_matters, status IN ('ISSUED', 'PAID', 'CREDITED', 'WRITTEN_OFF') AS on_earners, count(*) AS n FROM ri GROUP BY ALL")
add("agg_11_billable_by_matter", lambda spark, d: api_invoices(spark, d).where(F.col("status").isin(*tr.BILLABLE_INVOICE) & F.col("matter_id").isNotNull()).groupBy("matter_id").agg(
    F.sum(F.col("total").cast("decimal(18,4)")).alias("net_billing"), F.sum(F.col("outstanding").cast("decimal(18,4)")).alias("outstanding"), F.sum(F.col("paid").cast("decimal(18,4)")).alias("paid"), F.sum(F.col("written_off").cast("decimal(18,4)")).alias("written_off"),
    F.count("*").alias("invoices"), F.max(F.to_date("invoice_date")).alias("latest")),
    f"WITH {_INV} SELECT matter_id, {', '.join(f'CAST(sum({_D4(c)}) AS DOUBLE) AS {n}' for c, n in (('total', 'net_billing'), ('outstanding', 'outstanding'), ('paid', 'paid'), ('0.0', 'written_off')))}, count(*) AS invoices, CAST(max(invoice_date) AS VARCHAR) AS latest FROM ri WHERE status IN ('ISSUED', 'PAID', 'CREDITED') AND matter_id IS NOT NULL GROUP BY matter_id")
add("flt_09_window", lambda spark, d: table(spark, d, "orders").where(F.date_format("o_orderdate", "yyyy-MM-dd") >= F.date_format(F.add_months(F.to_date(F.lit(REF_DATE)), -48), "yyyy-MM-dd")).agg(F.count("*").alias("n")),
    "SELECT count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1997-08-15'")
