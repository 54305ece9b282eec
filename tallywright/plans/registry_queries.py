"""Name matching, registries, merges, snapshots, quality and readiness, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg
from ..operators import classify, joins, kpi_table, quality
from ..session import scratch_path, table
from ..sources import snapshots
from .domain import REF_DATE, load, rnd, sql
from .kpi_queries import CONFIG, ORACLE as KPI_ORACLE, _status, pct, ref, with_
from .practice_queries import d, n, plain
from .source_queries import values

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, run, oracle: str) -> None:
    QUERIES[name] = lambda spark, path: plain(run(spark, path))
    ORACLE[name] = oracle


# --- joins -----------------------------------------------------------------------------

add("jon_06_client_names", lambda spark, p: (lambda x: x.matters.join(x.clients.select("client_id", "display_name"), "client_id", "left").select("matter_id", "display_name"))(load(spark, p)), sql("SELECT matter_id, display_name FROM ma LEFT JOIN cl USING (client_id)"))
add("jon_08_disbursements", lambda spark, p: (lambda x: x.disbursements.join(x.matters.select("matter_id", "case_type"), "matter_id", "left").groupBy("case_type").agg(agg.total("subtotal").alias("value"), F.count("*").alias("n")))(load(spark, p)),
    sql(f"SELECT case_type, {d('sum(subtotal)', 'value')}, count(*) AS n FROM di LEFT JOIN ma USING (matter_id) GROUP BY case_type"))


def _pairs(spark, p):
    c = table(spark, p, "customer")
    first = c.select(F.lit("client").alias("entity"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("contacts").alias("dataset"), F.lit(0).alias("priority"), F.col("c_custkey").alias("row_idx"))
    other = c.where("c_custkey % 5 = 0").select(F.lit("client").alias("entity"), F.col("c_custkey").alias("id"), F.concat(F.col("c_name"), F.lit(" Ltd")).alias("name"), F.lit("invoices").alias("dataset"), F.lit(1).alias("priority"), F.col("c_custkey").alias("row_idx"))
    return first.where("c_custkey % 7 > 0").unionByName(other)


add("jon_09_registry", lambda spark, p: joins.registry(_pairs(spark, p))[0].select("id", "name", "dataset"),
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE c_name || ' Ltd' END AS name, CASE WHEN c_custkey % 7 > 0 THEN 'contacts' ELSE 'invoices' END AS dataset FROM customer WHERE c_custkey % 7 > 0 OR c_custkey % 5 = 0")
add("jon_09_conflicts", lambda spark, p: joins.registry(_pairs(spark, p))[1].select("id", "winner", "name"), "SELECT c_custkey AS id, c_name AS winner, c_name || ' Ltd' AS name FROM customer WHERE c_custkey % 7 > 0 AND c_custkey % 5 = 0")
add("jon_10_apply", lambda spark, p: joins.apply_registry(table(spark, p, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("kept")).alias("name")), joins.registry(_pairs(spark, p))[0], "client", "id", "name").select("o_orderkey", "id", "name"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 2 = 0 AND o_custkey % 7 > 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHEN o_orderkey % 2 = 0 AND o_custkey % 5 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' Ltd' END AS name FROM orders")


def _paid(spark, p):
    pay = table(spark, p, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("outstanding"), F.when(F.col("l_returnflag") == "R", "REVERSED").alias("status"), F.struct("l_shipdate", "l_linenumber").alias("row_idx"))
    return joins.date_paid(load(spark, p).invoices, pay).select("invoice_id", "date_paid")


add("jon_14_date_paid", _paid, sql("SELECT invoice_id, CAST(coalesce(a, b) AS VARCHAR) AS date_paid FROM iv LEFT JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) FILTER (l_linestatus = 'F') AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey) ON invoice_id = l_orderkey"))
add("jon_15_client_profiles", lambda spark, p: (lambda x: joins.array_containment(x.clients.select("client_id"), x.matters.select("matter_id", F.array("client_id", F.col("client_id") + 1, "client_id").alias("client_ids")), "client_id", "client_ids").groupBy("client_id").agg(F.count("*").alias("matters")))(load(spark, p)),
    sql("SELECT client_id, count(*) AS matters FROM (SELECT matter_id, unnest([client_id, client_id + 1]) AS client_id FROM ma) JOIN cl USING (client_id) GROUP BY client_id"))
add("jon_25_previous_period", lambda spark, p: (lambda t: t.withColumn("before", F.lag("n").over(W.partitionBy("o_custkey").orderBy("y"))).where("before is not null").select("o_custkey", "y", "n", "before"))(
    table(spark, p, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))),
    "SELECT * FROM (SELECT o_custkey, y, n, lag(n) OVER (PARTITION BY o_custkey ORDER BY y) AS before FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)) WHERE before IS NOT NULL")
add("win_03_unique_guard", lambda spark, p: table(spark, p, "part").withColumn("n", F.count("*").over(W.partitionBy("p_name", "p_brand"))).where("n = 1").select("p_partkey"), "SELECT p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY p_name, p_brand) = 1")
add("win_04_versions", lambda spark, p: (lambda w: table(spark, p, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("version"), F.lead("o_orderkey").over(w).isNull().alias("is_current")))(W.partitionBy("o_custkey").orderBy("o_orderkey")),
    "SELECT o_custkey, o_orderkey, row_number() OVER w AS version, lead(o_orderkey) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
add("set_04_except", lambda spark, p: table(spark, p, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, p, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti"), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
add("set_05_union_of_ids", lambda spark, p: quality.refresh_derived(table(spark, p, "part").where("p_partkey % 2 = 0").select(F.col("p_brand").alias("value")), spark.createDataFrame([("Brand#13",), ("gone",)], "value string")).groupBy("state").agg(F.count("*").alias("n")),
    "SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.value IS NULL THEN 'flagged' WHEN b.value IS NULL THEN 'new' ELSE 'kept' END AS state FROM (SELECT DISTINCT p_brand AS value FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (VALUES ('Brand#13'), ('gone')) b(value) ON a.value = b.value) GROUP BY state")

# --- snapshots -------------------------------------------------------------------------


def _snapshot(spark, p):
    x = load(spark, p)
    return snapshots.flatten(classify.evaluate(kpi_table.all_rows(x, CONFIG, ref()), classify.threshold_table(spark), keep_direction=True), "firm-1", f"{REF_DATE} 06:00:00")


#: What the snapshot holds: every formula by its own twin, statuses and texts by hand.
_FORMULAS = ("f_tu_01_strict_chargeable", "f_tu_02", "f_tu_03", "f_rb_01_all_matters", "f_rb_01_firm", "f_rb_02_chargeable", "f_rb_03", "f_rb_04", "f_wl_01_oldest_entry", "f_wl_02", "f_wl_03", "f_wl_04",
             "f_pr_01_standard", "f_pr_02", "f_pr_03", "f_pr_04", "f_pr_05", "f_bs_01", "f_bs_02", "f_dm_01", "f_cs_01", "f_cs_02", "f_cs_03")
_EVERY = " UNION ALL ".join(f"(SELECT * FROM ({KPI_ORACLE[f]}))" for f in _FORMULAS)
_TENTH = "CAST(round(CAST(value AS DECIMAL(28,6)), 1) AS VARCHAR)"
_SHOWN = f"""CASE WHEN value IS NULL THEN NULL WHEN kpi_key IN ('F-TU-01', 'F-TU-02', 'F-TU-03', 'F-RB-01', 'F-WL-02', 'F-WL-03', 'F-BS-01') THEN {_TENTH} || '%' WHEN kpi_key IN ('F-RB-04', 'F-WL-01', 'F-WL-04') THEN CAST(floor(value + 0.5) AS BIGINT) || ' days'
  WHEN kpi_key IN ('F-BS-02', 'F-CS-02', 'F-CS-03') THEN CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE {_TENTH} END
  ELSE CASE WHEN value < 0 AND round(CAST(abs(value) AS DECIMAL(28,6)), 0) > 0 THEN '-' ELSE '' END || '£' || format('{{:,}}', CAST(round(CAST(abs(value) AS DECIMAL(28,6)), 0) AS BIGINT)) END"""
_NAMES = """SELECT 'matter' AS entity_type, CAST(o_orderkey AS VARCHAR) AS entity_id, 'M' || o_orderkey AS entity_name FROM orders UNION ALL SELECT 'feeEarner', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
UNION ALL SELECT 'client', CAST(c_custkey AS VARCHAR), c_name FROM customer"""
_SNAP = f"""SELECT entity_type, entity_id, coalesce(entity_name, entity_id) AS entity_name, kpi_key, value AS kpi_value, {_status(every=True)} AS rag_status, {_SHOWN} AS display_value
FROM ({_EVERY}) LEFT JOIN ({_NAMES}) USING (entity_type, entity_id)"""
add("snp_01_snapshot", lambda spark, p: _snapshot(spark, p).select("entity_type", "entity_id", "entity_name", "kpi_key", "kpi_value", "rag_status", "display_value"), _SNAP)
add("rag_03_every_formula", lambda spark, p: classify.evaluate(kpi_table.all_rows(load(spark, p), CONFIG, ref()), classify.threshold_table(spark), keep_direction=True).where("higher is not null").groupBy("kpi_key").agg(
    F.count("*").alias("assigned"), *[F.count_if(F.col("status") == s).alias(s) for s in ("green", "amber", "red", "neutral")], F.max_by("entity_name", F.when(F.col("status") == "red", F.struct("value", "entity_name"))).alias("worst_name")),
    f"""SELECT kpi_key, count(*) AS assigned, {', '.join(f"CAST(count(*) FILTER (rag_status = '{s}') AS BIGINT) AS {s}" for s in ('green', 'amber', 'red', 'neutral'))},
    max({{'v': kpi_value, 'n': entity_name}}) FILTER (rag_status = 'red').n AS worst_name FROM ({_SNAP}) WHERE rag_status IS NOT NULL GROUP BY kpi_key""")

_STORED: dict[tuple[str, str], str] = {}


def _written(spark, p):
    """The path of a snapshot that is stored once for a session and folder of tables; reads of it are what a dashboard does."""
    key = (spark.sparkContext.applicationId, p)
    path = _STORED.get(key)
    if path is None or not snapshots.exists(spark, path):
        path = _STORED[key] = scratch_path(spark, "snapshots")
        snapshots.replace(_snapshot(spark, p), path)
    return path


def _stored(spark, p):
    path = _written(spark, p)
    again, to = spark.read.parquet(path), scratch_path(spark, "snapshots-again")
    columns = [c for c in again.columns if c != "firm_id"] + ["firm_id"]
    snapshots.replace(again.where("entity_type <> 'firm'").select(*columns), to)
    snapshots.replace(again.where("entity_type <> 'firm'").select(*columns), to)  # writing again replaces, never doubles
    return snapshots.scan(spark, to, "firm-1", entity_type="feeEarner", period="current", kpi_keys=["F-TU-01"]).select("entity_id", "kpi_key", "kpi_value", "rag_status")


add("snk_03_replace_and_scan", _stored, f"SELECT entity_id, kpi_key, kpi_value, rag_status FROM ({_SNAP}) WHERE entity_type = 'feeEarner' AND kpi_key = 'F-TU-01'")


add("qry_13_latest_pull", lambda spark, p: snapshots.latest_pull(spark.read.parquet(_written(spark, p)).select(F.col("entity_type").alias("firm_id"), F.expr("pulled_at - make_interval(0, 0, 0, 1 + length(kpi_key || entity_id) % 3)").alias("pulled_at"))).select("firm_id", F.date_format("pulled_at", "yyyy-MM-dd HH:mm").alias("pulled_at")),
    f"SELECT entity_type AS firm_id, strftime(max(TIMESTAMP '{REF_DATE} 06:00:00' - to_days(CAST(1 + length(kpi_key || entity_id) % 3 AS INTEGER))), '%Y-%m-%d %H:%M') AS pulled_at FROM ({_SNAP}) GROUP BY entity_type")
add("qry_08_entity_kpis", lambda spark, p: snapshots.scan(spark, _written(spark, p), "firm-1", entity_type="client", entity_ids=["7"]).select("kpi_key", "entity_type", "entity_id", F.col("kpi_value").alias("value"), F.col("rag_status").alias("status")),
    f"SELECT kpi_key, entity_type, entity_id, kpi_value AS value, rag_status AS status FROM ({_SNAP}) WHERE entity_type = 'client' AND entity_id = '7'")
add("qry_09_ordered_page", lambda spark, p: snapshots.ordered_page(snapshots.scan(spark, _written(spark, p), "firm-1", entity_type="matter", kpi_keys=["F-BS-01", "F-RB-01"]), 1000, 100).select("entity_id", "entity_name", "kpi_key"),
    f"SELECT entity_id, entity_name, kpi_key FROM (SELECT *, row_number() OVER (ORDER BY entity_type, entity_name, kpi_key, entity_id) AS rn FROM ({_SNAP}) WHERE entity_type = 'matter' AND kpi_key IN ('F-BS-01', 'F-RB-01')) WHERE rn BETWEEN 101 AND 1100")
add("src_20_page_in_order", lambda spark, p: snapshots.numbered_page(snapshots.scan(spark, _written(spark, p), "firm-1", period="current"), 500, 200),
    f"SELECT CAST(rn AS BIGINT) AS place, entity_type, entity_name, kpi_key FROM (SELECT *, row_number() OVER (ORDER BY entity_type, entity_name, kpi_key, entity_id) AS rn FROM ({_SNAP})) WHERE rn BETWEEN 201 AND 700")
add("qry_15_latest_results", lambda spark, p: _two_pulls(spark, p), f"SELECT kpi_key, count(*) AS n, '2001-08-15 06:00' AS pulled_at FROM ({_SNAP}) GROUP BY kpi_key")
add("qry_11_calculate", lambda spark, p: spark.read.parquet(_written(spark, p)).groupBy("kpi_key", "rag_status").agg(F.count("*").alias("n")), f"SELECT kpi_key, rag_status, count(*) AS n FROM ({_SNAP}) GROUP BY ALL")


def _two_pulls(spark, p):
    """Two pulls side by side; the newest is the one that counts."""
    now = spark.read.parquet(_written(spark, p))
    before = now.withColumn("pulled_at", F.col("pulled_at") - F.expr("INTERVAL 1 DAY"))
    every = now.unionByName(before)
    return every.join(F.broadcast(snapshots.latest_pull(every)), ["firm_id", "pulled_at"]).groupBy("kpi_key", F.date_format("pulled_at", "yyyy-MM-dd HH:mm").alias("pulled_at")).agg(F.count("*").alias("n"))


add("srt_06_recent_flags", lambda spark, p: snapshots.recent_flags(table(spark, p, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low").alias("severity")), 25, [F.desc("o_orderdate"), F.asc("id")]).select("id", "severity"),
    "SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' THEN 'medium' ELSE 'low' END AS severity FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25)")

# --- quality ---------------------------------------------------------------------------

add("dq_01_quality", lambda spark, p: (lambda x: quality.report(x.time_entries, x.matters.join(x.clients.select("client_id", "display_name"), "client_id", "left"), {"feeEarner", "wipJson", "fullMattersJson", "invoicesJson", "contactsJson"}))(load(spark, p)),
    sql(f"""SELECT orphans, {rnd('100.0 * orphan_value / value', 4)} AS orphan_percent, unresolved, CAST(100 - CASE WHEN 100.0 * orphan_value / value > 20 THEN 5 WHEN 100.0 * orphan_value / value > 5 THEN 3 ELSE 0 END - CASE WHEN unresolved > 0.2 * matters THEN 3 ELSE 0 END AS BIGINT) AS score FROM
    (SELECT CAST(count(*) FILTER (NOT matched) AS BIGINT) AS orphans, CAST(sum(CASE WHEN NOT matched THEN billable_value ELSE 0 END) AS DOUBLE) AS orphan_value, CAST(sum(billable_value) AS DOUBLE) AS value FROM te), (SELECT CAST(count(*) FILTER (display_name IS NULL) AS BIGINT) AS unresolved, count(*) AS matters FROM ma LEFT JOIN cl USING (client_id))"""))
add("dq_01_undated", lambda spark, p: (lambda x: quality.report(x.time_entries.withColumn("activity", F.lit(None).cast("string")), x.matters.join(x.clients.where("client_id % 2 = 0").select("client_id", "display_name"), "client_id", "left"), {"feeEarner", "wipJson", "invoicesJson"}, x.invoices.withColumn("date_paid", F.lit(None).cast("date"))).select("unresolved", "score"))(load(spark, p)),
    sql("""SELECT unresolved, CAST(80 - CASE WHEN share > 20 THEN 5 WHEN share > 5 THEN 3 ELSE 0 END - CASE WHEN unresolved > 0.2 * matters THEN 3 ELSE 0 END - 2 - 2 AS BIGINT) AS score FROM
    (SELECT 100.0 * CAST(sum(CASE WHEN NOT matched THEN billable_value ELSE 0 END) AS DOUBLE) / CAST(sum(billable_value) AS DOUBLE) AS share FROM te), (SELECT CAST(count(*) FILTER (client_id % 2 = 1) AS BIGINT) AS unresolved, count(*) AS matters FROM ma)"""))
