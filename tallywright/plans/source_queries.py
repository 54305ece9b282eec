"""Sources, sinks, normalisation and scalar functions as queries over the provided tables.

Where an operator reads files, the query writes a provided table in that format to the shared
scratch folder first and reads it back through the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import expressions as ex
from ..operators import normalise as nm
from ..operators.kpi import FirmConfig
from ..session import scratch_path, table
from ..sources import files, snapshots
from .domain import REF_DATE, load, rnd, sql
from .practice_queries import plain

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: plain(run(spark, d))
    ORACLE[name] = oracle


def values(columns: str, rows: list[tuple]) -> str:
    """A constant table in DuckDB SQL."""
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


# --- files -----------------------------------------------------------------------------


def _csv(spark, d):
    path = scratch_path(spark, "supplier-csv")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias(" Supplier Id "), F.col("s_name").alias("Name"), F.col("s_acctbal").alias("Balance")).write.option("header", True).csv(path)
    df = files.rename_headers(files.read_csv(spark, path), {"supplierid": "id"})
    return df.select(F.col("id").cast("long").alias("id"), "name", F.col("balance").cast("double").alias("balance"))


add("src_01_csv", _csv, "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")


def _json(spark, d):
    path = scratch_path(spark, "nation-json")
    nations = table(spark, d, "nation")
    nations.agg(F.array(F.struct(F.lit(1).alias("page"))).alias("meta"), F.array_sort(F.collect_list(F.struct(*nations.columns))).alias("data")).write.json(path)
    return files.read_json(spark, path).select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


add("src_02_json", _json, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")


def _flat(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.array("c_nationkey", F.col("c_nationkey") + 1).alias("keys"), F.struct(F.col("c_mktsegment").alias("s")).alias("seg")).alias("info"))
    flat = files.flatten_once(c)
    return flat.toDF(*[n.replace(".", "_") for n in flat.columns])


add("src_03_flatten", _flat, """SELECT c_custkey, c_name AS info_name, '[' || c_nationkey || ',' || (c_nationkey + 1) || ']' AS info_keys, '{"s":"' || c_mktsegment || '"}' AS info_seg FROM customer""")
add("src_07_headers", lambda spark, d: files.rename_headers(table(spark, d, "nation").toDF("Region Key#", "matter_budget", "ClientName"), {"matterbudget": "budget"}, {"clientname": "displayName"}),
    'SELECT CAST(n_nationkey AS BIGINT) AS "regionKey", n_name AS budget, CAST(n_regionkey AS BIGINT) AS "displayName" FROM nation')


def _as_text(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.concat(F.lit("£"), F.format_number("o_totalprice", 2)).alias("price"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        (F.col("o_orderkey") % 2 == 0).cast("string").alias("even"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"))


def _inferred(spark, d):
    found = files.infer_types(_as_text(spark, d))
    return spark.createDataFrame(list(found.items()), "field string, kind string")


add("src_09_infer", _inferred, values("field, kind", [("key", "number"), ("price", "currency"), ("day", "date"), ("even", "boolean"), ("priority", "string")]))


def _coerced(spark, d):
    df = _as_text(spark, d)
    kinds = {"key": "number", "price": "currency", "day": "date", "even": "boolean", "priority": "string"}
    return df.select(*[sc.coerce_detected(F.col(c), k).alias(c) for c, k in kinds.items()]).withColumn("day", F.to_date("day"))


add("src_10_coerce", _coerced, "SELECT CAST(o_orderkey AS DOUBLE) AS key, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 2) AS DOUBLE) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey % 2 = 0 AS even, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority FROM orders")
add("src_11_profile", lambda spark, d: files.profile(_as_text(spark, d).select("day", "even", "priority")).withColumn("samples", F.array_join("samples", "|")),
    "WITH t AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority FROM orders), "
    "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM t" for c in ("day", "even", "priority")) + "), "
    "c AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY value NULLS LAST) AS rn FROM u GROUP BY field, value) "
    "SELECT field, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS missing, count(value) AS distinct_values, string_agg(value, '|' ORDER BY value) FILTER (rn <= 5) AS samples, "
    "round(CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS DOUBLE) / sum(n) * 100, 4) AS missing_percent FROM c GROUP BY field")
add("src_17_refetch", lambda spark, d: (lambda have, every: have.unionByName(every.join(have.select("o_custkey").distinct(), "o_custkey", "left_anti").select(*have.columns)).dropDuplicates(["o_orderkey"]))(
    table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")),
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
add("src_18_control_total", lambda spark, d: load(spark, d).time_entries.agg(F.sum("billable_value").alias("fetched"), F.sum(F.when(F.col("matched"), F.col("billable_value"))).alias("control")).withColumn("warn", F.abs(F.col("fetched") - F.col("control")) / F.col("control") > 0.01),
    sql("SELECT CAST(a AS DOUBLE) AS fetched, CAST(b AS DOUBLE) AS control, abs(a - b) / b > 0.01 AS warn FROM (SELECT sum(billable_value) AS a, sum(CASE WHEN matched THEN billable_value END) AS b FROM te)"))
add("src_21_history", lambda spark, d: _history(spark, d), "SELECT CAST(l_orderkey % 3 AS BIGINT) AS firm_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS snapshot_date, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-05' AND DATE '1998-01-07' GROUP BY ALL")


def _history(spark, d):
    path = scratch_path(spark, "history")
    rows = table(spark, d, "lineitem").where("l_shipdate >= '1998-01-01' and l_shipdate < '1998-01-12'").groupBy((F.col("l_orderkey") % 3).alias("firm_id"), F.to_date("l_shipdate").alias("snapshot_date")).agg(F.count("*").alias("n"))
    rows.repartition("snapshot_date").write.partitionBy("snapshot_date").parquet(path)
    return snapshots.history(spark, path, "1998-01-05", "1998-01-07").select("firm_id", "snapshot_date", "n")


def _daily(spark, d):
    path = scratch_path(spark, "daily")
    base = table(spark, d, "nation").select(F.col("n_nationkey").alias("firm_id"), "n_name")
    snapshots.append_daily(base.where("firm_id < 10"), path, "2001-08-15")
    snapshots.append_daily(base, path, "2001-08-15", spark.read.parquet(path))
    return spark.read.parquet(path)


add("snk_05_daily_history", _daily, "SELECT CAST(n_nationkey AS BIGINT) AS firm_id, n_name, '2001-08-15' AS snapshot_date FROM nation")
add("snk_07_cleanup", lambda spark, d: snapshots.keep_best(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")]),
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")


def _csv_export(spark, d):
    path = scratch_path(spark, "export")
    snapshots.write_csv(table(spark, d, "customer"), path, ["c_custkey", "c_mktsegment"], [F.asc("c_custkey")])
    return files.read_csv(spark, path).select(F.col("c_custkey").cast("long"), "c_mktsegment")


add("snk_08_csv_export", _csv_export, "SELECT c_custkey, c_mktsegment FROM customer")

# --- normalisation ---------------------------------------------------------------------

FIELDS = [nm.Field("id", "NUMBER", True), nm.Field("budget", "CURRENCY", True), nm.Field("share", "PERCENTAGE"), nm.Field("flag", "BOOLEAN"), nm.Field("status", "SELECT", False, ("F", "O")), nm.Field("opened", "DATE")]


def _raw(spark, d):
    """Orders as untyped text with gaps, blanks and unreadable cells."""
    k = F.col("o_orderkey")
    text = table(spark, d, "orders").select(
        F.concat(F.lit(" "), k.cast("string")).alias("Order Id"), F.when(k % 4 > 0, F.concat(F.lit("£"), F.col("o_custkey").cast("string"), F.lit(",000.50 "))).alias("Price"),
        F.when(k % 3 == 0, "0.25").when(k % 3 == 1, "40%").otherwise("n/a").alias("Share"), F.when(k % 2 == 0, "Yes").otherwise("0").alias("Flag"), F.col("o_orderstatus").alias("Status"),
        F.when(k % 5 > 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("soon").alias("Opened"))
    blank = F.lit(" ").alias("x")
    return text.unionByName(table(spark, d, "region").select(*[blank.alias(c) for c in text.columns]))


_MAP = {"Order Id": "id", "Price": "budget", "Share": "share", "Flag": "flag", "Status": "status", "Opened": "opened"}
_NORMAL = "WITH r AS (SELECT CAST(o_orderkey AS DOUBLE) AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 1000 + 0.5::DOUBLE END AS budget, CASE o_orderkey % 3 WHEN 0 THEN 25.0::DOUBLE WHEN 1 THEN 40.0::DOUBLE END AS share, o_orderkey % 2 = 0 AS flag, o_orderstatus AS status, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS opened, o_orderkey AS k FROM orders) "


def _normal(spark, d):
    return nm.coerce(nm.remap(_raw(spark, d), _MAP), FIELDS).withColumn("opened", F.to_date("opened"))


add("prj_04_coerce", lambda spark, d: nm.judged(_normal(spark, d), FIELDS).where("reject is null").select("id", "budget", "share", "flag", "status", "opened"), _NORMAL + "SELECT id, budget, share, flag, status, CAST(opened AS VARCHAR) AS opened FROM r")
add("agg_09_warnings", lambda spark, d: nm.warning_counts(_normal(spark, d)), _NORMAL + "SELECT * FROM (SELECT 'share' AS field, count(*) AS n FROM r WHERE share IS NULL UNION ALL SELECT 'opened', count(*) FROM r WHERE opened IS NULL UNION ALL SELECT 'status', count(*) FROM r WHERE status NOT IN ('F', 'O')) WHERE n > 0")
add("flt_01_blank_rows", lambda spark, d: nm.judged(_normal(spark, d), FIELDS).groupBy(F.coalesce("reject", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n")), "SELECT 'kept' AS outcome, count(*) AS n FROM orders UNION ALL SELECT 'blank row', count(*) FROM region")
add("flt_02_required", lambda spark, d: nm.judged(_normal(spark, d), FIELDS, strict=True).groupBy(F.coalesce("reject", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n")),
    _NORMAL + "SELECT CASE WHEN budget IS NULL THEN 'missing budget' ELSE 'kept' END AS outcome, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'blank row', count(*) FROM region")
add("flt_03_abort", lambda spark, d: nm.abort_when_mostly_rejected(nm.judged(_normal(spark, d), FIELDS)).agg(F.count("*").alias("kept")), "SELECT count(*) AS kept FROM orders")
add("win_01_first_of_key", lambda spark, d: nm.first_of_key(table(spark, d, "orders").select(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("k"), "o_orderkey"), "k", "o_orderkey"),
    "SELECT o_custkey AS k, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1 UNION ALL SELECT NULL, o_orderkey FROM orders WHERE NOT coalesce(o_custkey % 3 > 0, FALSE)")


def _earners(spark, d):
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 3 == 0, F.format_string('[{"label":"a","value":%d},{"label":"b","value":%d,"default":true}]', k, k + 1)).when(k % 3 == 1, F.format_string('[{"label":"a","value":%d}]', k)).otherwise(k.cast("string")).alias("rate"),
        F.when(k % 3 == 0, "fee share").when(k % 3 == 1, "SALARIED").otherwise("Other").alias("pay_model"), F.when(k % 2 == 0, k * 1200.0).alias("annual_salary"), F.when(k % 5 == 0, F.lit(7.0)).alias("monthly_salary"), F.when(k % 4 == 0, F.lit(True)).alias("is_system_account"))
    return nm.fee_earner_rules(raw)


add("prj_05_fee_earner_rules", _earners, """SELECT s_suppkey AS id, CAST(CASE s_suppkey % 3 WHEN 0 THEN s_suppkey + 1 ELSE s_suppkey END AS DOUBLE) AS rate, CASE s_suppkey % 3 WHEN 0 THEN 'FeeShare' WHEN 1 THEN 'Salaried' ELSE 'Other' END AS pay_model,
    CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 1200 AS DOUBLE) END AS annual_salary, CASE WHEN s_suppkey % 5 = 0 THEN 7.0::DOUBLE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 100 AS DOUBLE) END AS monthly_salary, s_suppkey % 4 = 0 AS is_system_account FROM supplier""")


def _entries(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, q * 6).alias("minutes"), (q / 10).alias("hours"), F.when(F.col("l_linenumber") % 3 > 0, F.lit(120.0)).alias("rate"),
                                              F.lit(None).cast("double").alias("billable_value"), F.lit(None).cast("double").alias("write_off"), F.when(F.col("l_returnflag") == "R", F.lit(True)).alias("do_not_bill"), F.col("l_shipdate").alias("entry_date"))


add("prj_06_time_entry_rules", lambda spark, d: nm.time_entry_rules(_entries(spark, d)).select("l_orderkey", "l_linenumber", sc.js_round(F.col("minutes"), 4).alias("minutes"), sc.js_round(F.col("billable_value"), 4).alias("billable_value"), "write_off", "do_not_bill"),
    f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {rnd('CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 6 ELSE l_quantity / 10 * 60 END')} AS minutes, CASE WHEN l_linenumber % 3 > 0 THEN {rnd('120 * (CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 6 ELSE l_quantity / 10 * 60 END) / 60')} END AS billable_value, 0.0::DOUBLE AS write_off, l_returnflag = 'R' AS do_not_bill FROM lineitem")
add("prj_15_enrich_entries", lambda spark, d: nm.enrich_entries(nm.time_entry_rules(_entries(spark, d)), F.to_timestamp(F.lit(REF_DATE))).select("l_orderkey", "l_linenumber", "hours", "is_chargeable", "recorded_value", "age_days", "week", "month"),
    f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {rnd('(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 6 ELSE l_quantity / 10 * 60 END) / 60')} AS hours, coalesce(l_linenumber % 3 > 0 AND l_quantity > 0 AND l_returnflag <> 'R', FALSE) AS is_chargeable, "
    f"CASE WHEN l_linenumber % 3 > 0 THEN {rnd('120 * (' + rnd('(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 6 ELSE l_quantity / 10 * 60 END) / 60') + ')', 2)} END AS recorded_value, CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '{REF_DATE}') AS BIGINT) AS age_days, CAST(week(l_shipdate) AS BIGINT) AS week, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem")
add("prj_08_invoice_rules", lambda spark, d: nm.invoice_rules(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("paid"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(1.0)).alias("outstanding"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(9.0)).alias("total"))),
    "SELECT o_orderkey, p AS paid, o AS outstanding, CASE WHEN o_orderkey % 5 = 0 THEN 9.0::DOUBLE ELSE p + o END AS total FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0::DOUBLE END AS p, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o FROM orders)")
add("prj_09_disbursement_rules", lambda spark, d: nm.disbursement_rules(table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.format_string('[{"contact":"K%d","display_name":"%s"}]', "c_custkey", "c_name")).otherwise(F.col("c_custkey").cast("string")).alias("client_id"), F.lit(None).cast("string").alias("client_name"))),
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'K' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS client_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS client_name FROM customer")
add("prj_11_duration", lambda spark, d: table(spark, d, "part").select("p_partkey", sc.js_round(nm.duration_hours(F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.col("p_size") * 30), 4).alias("hours")),
    f"SELECT p_partkey, {rnd('CASE WHEN p_size % 2 = 0 AND p_size > 0 THEN p_size * 6 / 60.0::DOUBLE ELSE p_size * 30 / 60.0::DOUBLE END')} AS hours FROM part")
add("prj_14_strip", lambda spark, d: nm.strip_fields(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("Password"), F.struct("c_mktsegment", F.lit("x").alias("TOKEN")).alias("info")), {"password", "token"}).select("*", "info.*").drop("info"), "SELECT c_custkey, c_mktsegment FROM customer")

# --- user-defined formulas -------------------------------------------------------------

_f = lambda name: {"type": "field", "field": name}
_c = lambda v: {"type": "constant", "value": v}
_op = lambda o, a, b: {"type": "operator", "operator": o, "left": a, "right": b}


def formula(name: str, tree: dict, oracle: str, **more) -> None:
    def run(spark, d):
        p = load(spark, d)
        return ex.evaluate(tree, p.matters, "matter_id", {"invoice": p.invoices, "timeEntry": p.time_entries}, config={"hours": {"weekly": 37.5}}, **more)

    add(name, run, sql(f"SELECT CAST(matter_id AS VARCHAR) AS entity_id, {oracle} AS value FROM ma"))


formula("exp_operator", _op("percentage", _op("subtract", _f("budget"), _c(1000)), _f("client_id")), rnd("(CAST(budget AS DOUBLE) - 1000) / nullif(CAST(client_id AS DOUBLE), 0) * 100"), after={"round": 4})
formula("exp_lenient", _op("average", _op("min", _f("budget"), _c(50_000)), _op("max", _f("client_id"), _f("budget"))), rnd("(least(CAST(budget AS DOUBLE), 50000) + greatest(CAST(client_id AS DOUBLE), CAST(budget AS DOUBLE))) / 2"), after={"round": 4})
formula("exp_compare", {"type": "compare", "operator": "=", "left": _f("status"), "right": _c("COMPLETED")}, "CASE WHEN status = 'COMPLETED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
formula("exp_if_then", {"type": "ifThen", "condition": {"type": "compare", "operator": ">", "left": _f("budget"), "right": _c(100_000)}, "then": {"type": "config", "path": "hours.weekly"}, "else": _f("client_id")},
        "CASE WHEN budget IS NULL THEN NULL WHEN budget > 100000 THEN 37.5::DOUBLE ELSE CAST(client_id AS DOUBLE) END")
formula("exp_aggregation", _op("add", {"type": "aggregation", "operator": "countOf", "entity": "invoice", "filters": [{"field": "status", "operator": "equals", "value": "PAID"}]}, _op("multiply", _f("client_id"), {"type": "aggregation", "operator": "maxOf", "entity": "timeEntry", "field": "minutes", "filters": [{"field": "age_days", "operator": "greaterThan", "value": 100}]})),
        "CAST((SELECT count(*) FROM iv WHERE status = 'PAID') + client_id * (SELECT max(minutes) FROM te WHERE age_days > 100) AS DOUBLE)")
_agg = lambda o, field, *filters: {"type": "aggregation", "operator": o, "entity": "timeEntry", "field": field, "filters": list(filters)}
formula("exp_aggregation_kinds", _op("add", _op("divide", _agg("sumOf", "minutes"), _agg("averageOf", "minutes", {"field": "do_not_bill", "operator": "equals", "value": False})), _op("add", _agg("minOf", "age_days"), _op("multiply", _c(0), _f("client_id")))),
        rnd("CAST((SELECT sum(minutes) FROM te) AS DOUBLE) / (SELECT avg(minutes) FROM te WHERE NOT do_not_bill) + (SELECT min(age_days) FROM te)"), after={"round": 4})
formula("exp_template", ex.substitute(_op("multiply", {"type": "field", "field": "{{what}}"}, {"type": "constant", "value": "{{factor}}"}), {"what": "client_id", "factor": 3}), "CAST(client_id * 3 AS DOUBLE)")
formula("exp_post_process", _op("subtract", _c(0), _f("client_id")), "CAST(least(greatest(client_id * 2, 10), 100) AS DOUBLE)", after={"abs": True, "multiply": 2, "clamp": (10, 100), "round": 0})


def _with_results(spark, d):
    p = load(spark, d)
    results = p.invoices.select(F.lit("F-1").alias("kpi_key"), F.col("matter_id").cast("string").alias("entity_id"), F.col("outstanding").cast("double").alias("value"))
    return ex.evaluate(_op("add", {"type": "formula", "id": "F-1"}, _f("client_id")), p.matters, "matter_id", results=results)


add("exp_formula_reference", _with_results, sql("SELECT CAST(ma.matter_id AS VARCHAR) AS entity_id, CAST(outstanding AS DOUBLE) + ma.client_id AS value FROM ma LEFT JOIN iv USING (matter_id)"))
add("flt_05_formula_filter", lambda spark, d: load(spark, d).matters.where(ex.matches([{"field": "budget", "operator": "notEquals", "value": None}, {"field": "status", "operator": "notIn", "value": ["ON_HOLD"]}, {"field": "client_id", "operator": "greaterThan", "value": 5}])).select("matter_id"),
    sql("SELECT matter_id FROM ma WHERE budget IS NOT NULL AND status <> 'ON_HOLD' AND client_id > 5"))

add("flt_05_all_operators", lambda spark, d: load(spark, d).matters.where(ex.matches([
    {"field": "status", "operator": "in", "value": ["COMPLETED", "ON_HOLD"]}, {"field": "budget", "operator": "isNotNull", "value": None}, {"field": "client_id", "operator": "lessThan", "value": 100}, {"field": "is_fixed_fee", "operator": "equals", "value": False}])).select("matter_id"),
    sql("SELECT matter_id FROM ma WHERE status IN ('COMPLETED', 'ON_HOLD') AND budget IS NOT NULL AND client_id < 100 AND NOT is_fixed_fee"))
add("flt_05_is_null", lambda spark, d: load(spark, d).matters.where(ex.matches([{"field": "budget", "operator": "isNull", "value": None}])).select("matter_id"), sql("SELECT matter_id FROM ma WHERE budget IS NULL"))

# --- scalar functions ------------------------------------------------------------------


def scalar(name: str, cases: list[tuple], kinds: str, function, result: str = "string") -> None:
    """Cases dealt to the parts by their keys, texts in, text out (the expectations are written out by hand)."""
    def run(spark, d):
        known = F.array(*[F.lit(c[0]).cast(kinds) for c in cases])
        df = table(spark, d, "part").select((F.col("p_partkey") % len(cases)).cast("long").alias("position")).withColumn("x", F.get(known, F.col("position").cast("int")))
        return df.select("position", function(F.col("x")).cast(result).alias("y")).groupBy("position", "y").agg(F.count("*").alias("n"))

    told = values("position, y", [(i, c[1]) for i, c in enumerate(cases)])
    add(name, run, f"SELECT CAST(t.position AS BIGINT) AS position, CAST(y AS {'VARCHAR' if result == 'string' else 'DOUBLE'}) AS y, count(*) AS n FROM part JOIN ({told}) AS t ON p_partkey % {len(cases)} = t.position GROUP BY ALL")


scalar("scl_01_trim", [("  a b ", "a b"), ("   ", None), (None, None), ("\t x", "x")], "string", sc.coerce_string)
scalar("scl_02_number", [("12abc", 12.0), ("£1,234.50", 1234.5), ("abc", None), ("-3.5%", -3.5), (None, None)], "string", sc.coerce_number, "double")
scalar("scl_03_percentage", [("0.5", 50.0), ("1", 100.0), ("45%", 45.0), ("-0.2", -20.0), ("x", None)], "string", sc.coerce_percentage, "double")
scalar("scl_04_date", [("2024-02-03", "2024-02-03"), ("03/02/2024", "2024-02-03"), ("12/25/2024", "2024-12-25"), ("2024-13-40", None), (None, None)], "string", lambda c: F.to_date(sc.coerce_date(c)))
scalar("scl_05_boolean", [("Yes", "true"), ("0", "false"), ("maybe", None), (" TRUE ", "true")], "string", sc.coerce_boolean)
scalar("scl_06_name", [("Mr. John  Smith", "john smith"), ("Dr Ann Lee", "ann lee"), ("Missy Elliott", "missy elliott"), (None, None)], "string", sc.normalise_name)
scalar("scl_14_round", [(2.5, 3.0), (-2.5, -2.0), (2.4, 2.0), (None, None)], "double", sc.js_round, "double")
scalar("scl_16_safe_divide", [(0.0, None), (4.0, 2.5), (None, None)], "double", lambda c: sc.safe_div(F.lit(10), c), "double")
scalar("scl_18_display", [(1234.56, "£1,235"), (-10.2, "-£10"), (0.0, "£0"), (None, None)], "double", lambda c: sc.display(c, "currency"))
scalar("scl_18_display_percent", [(12.25, "12.3%"), (100.0, "100.0%"), (None, None)], "double", lambda c: sc.display(c, "percentage"))
scalar("scl_13_months_back", [("2024-05-31", "2024-03-02"), ("2024-03-15", "2023-12-15")], "string", lambda c: sc.months_back(F.to_date(c), 3))
scalar("win_08_working_days", [("2024-01-05", 1.0), ("2024-01-01", 5.0), ("2024-01-08", 0.0), ("2023-12-25", 10.0)], "string", lambda c: sc.working_days_between(F.to_date(c), F.to_date(F.lit("2024-01-08"))), "double")
scalar("sn_002_hours", [(0.0, FirmConfig().available_hours)], "double", lambda c: c + F.lit(FirmConfig().available_hours), "double")
