"""Domain views over the provided tables, in Spark and as DuckDB common table expressions.

Money is DECIMAL(18,4) from the first projection on, so sums are exact in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

REF_DATE = "2001-08-15"
MONEY = "decimal(18,4)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


@dataclass
class Practice:
    """The views that operators take."""

    fee_earners: DataFrame
    clients: DataFrame
    matters: DataFrame
    time_entries: DataFrame
    invoices: DataFrame
    disbursements: DataFrame
    #: (part_key, activity), for the few queries that ask what was done
    activities: DataFrame
    #: (matter_id, department)
    matter_departments: DataFrame

    def with_activity(self) -> DataFrame:
        return self.time_entries.join(self.activities, "part_key", "left")


def load(spark: SparkSession, sf_dir: str, ref_date: str = REF_DATE) -> Practice:
    """Views as lazy plans: each reads only the columns that a query goes on to use."""
    ref = F.to_date(F.lit(ref_date))
    supplier, nation, customer = (table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    orders, lineitem, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))

    salaried = F.col("s_suppkey") % 4 != 0
    fee_earners = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("lawyer_id"), F.col("s_name").alias("lawyer_name"), F.col("n_name").alias("department"),
        F.when(salaried, "Salaried").otherwise("FeeShare").alias("pay_model"), money(20000 + 10 * F.col("s_acctbal")).alias("annual_salary"),
        (150 + F.col("s_suppkey") % 10 * 25).cast("int").alias("rate"),
        F.element_at(F.array(*map(F.lit, ("Partner", "Senior", "Associate", "Junior", "Paralegal"))), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("grade"),
        (F.col("s_suppkey") % 23 == 22).alias("is_system_account"),
    )
    clients = customer.select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("segment"))
    matters = orders.select(
        F.col("o_orderkey").alias("matter_id"), F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("matter_number"), F.col("o_custkey").alias("client_id"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "IN_PROGRESS").otherwise("ON_HOLD").alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, money(F.col("o_totalprice"))).alias("budget"), F.to_date("o_orderdate").alias("created"),
        F.col("o_orderpriority").alias("case_type"), (F.col("o_orderkey") % 5 == 0).alias("is_fixed_fee"),
    )
    net = money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    worked = lineitem.where(F.to_date("l_shipdate") <= ref)
    time_entries = worked.select(
        F.col("l_orderkey").alias("matter_id"), F.col("l_suppkey").alias("lawyer_id"), F.col("l_partkey").alias("part_key"),
        (F.col("l_quantity") * 6).cast("int").alias("minutes"), net.alias("billable_value"), money(F.col("l_extendedprice") * F.col("l_discount")).alias("write_off"),
        (F.col("l_returnflag") == "R").alias("do_not_bill"), (F.col("l_returnflag") != "R").alias("is_chargeable"),
        F.to_date("l_shipdate").alias("entry_date"), F.datediff(ref, F.to_date("l_shipdate")).alias("age_days"), (F.col("l_orderkey") % 10 != 3).alias("matched"),
    )
    billed = lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(
        F.sum(net).cast(MONEY).alias("subtotal"), F.sum(net * F.col("l_tax").cast("decimal(4,2)")).cast(MONEY).alias("vat"), F.min("l_suppkey").alias("lawyer_id"),
    )
    total = (F.col("subtotal") + F.col("vat")).cast(MONEY)
    due = F.date_add(F.to_date("o_orderdate"), 30)
    invoices = orders.join(billed, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_orderkey").alias("matter_id"), F.col("o_custkey").alias("client_id"), "lawyer_id", "subtotal", "vat", total.alias("total"),
        F.when(F.col("o_orderstatus") == "F", F.lit(0)).when(F.col("o_orderstatus") == "P", total / 2).otherwise(total).cast(MONEY).alias("outstanding"),
        F.to_date("o_orderdate").alias("invoice_date"), due.alias("due_date"), F.datediff(ref, due).alias("days_overdue"),
        F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "P", "PART_PAID").otherwise("ISSUED").alias("status"),
    )
    disbursements = worked.where("l_returnflag = 'A' and l_quantity < 5").select(
        F.col("l_orderkey").alias("matter_id"), F.col("l_suppkey").alias("lawyer_id"), money(F.col("l_extendedprice") * 0.01).alias("subtotal"),
        F.when(F.col("l_linestatus") == "O", money(F.col("l_extendedprice") * 0.01)).otherwise(F.lit(0)).cast(MONEY).alias("exposure"),
        F.datediff(ref, F.to_date("l_shipdate")).alias("age_days"),
    )
    activities = part.select(F.col("p_partkey").alias("part_key"), F.col("p_type").alias("activity"))
    matter_departments = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("matter_id"), F.col("n_name").alias("department"))
    return Practice(fee_earners, clients, matters, time_entries, invoices, disbursements, activities, matter_departments)


#: The same views for DuckDB; a query appends its own expressions after ``WITH``.
CTE = f"""
fe AS (SELECT s_suppkey AS lawyer_id, s_name AS lawyer_name, n_name AS department, CASE WHEN s_suppkey % 4 <> 0 THEN 'Salaried' ELSE 'FeeShare' END AS pay_model,
         CAST(20000 + 10 * s_acctbal AS DECIMAL(18,4)) AS annual_salary, CAST(150 + s_suppkey % 10 * 25 AS INT) AS rate,
         ['Partner','Senior','Associate','Junior','Paralegal'][CAST(s_suppkey % 5 + 1 AS INT)] AS grade, s_suppkey % 23 = 22 AS is_system_account
       FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
cl AS (SELECT c_custkey AS client_id, c_name AS display_name, c_mktsegment AS segment FROM customer),
ma AS (SELECT o_orderkey AS matter_id, 'M' || o_orderkey AS matter_number, o_custkey AS client_id,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'ON_HOLD' END AS status,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,4)) END AS budget, CAST(o_orderdate AS DATE) AS created,
         o_orderpriority AS case_type, o_orderkey % 5 = 0 AS is_fixed_fee FROM orders),
te AS (SELECT l_orderkey AS matter_id, l_suppkey AS lawyer_id, p_type AS activity, CAST(l_quantity * 6 AS INT) AS minutes,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS billable_value, CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS write_off,
         l_returnflag = 'R' AS do_not_bill, l_returnflag <> 'R' AS is_chargeable, CAST(l_shipdate AS DATE) AS entry_date,
         date_diff('day', CAST(l_shipdate AS DATE), DATE '{REF_DATE}') AS age_days, l_orderkey % 10 <> 3 AS matched
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) <= DATE '{REF_DATE}'),
bl AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS subtotal,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) * CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS vat, min(l_suppkey) AS lawyer_id
       FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
iv AS (SELECT o_orderkey AS invoice_id, o_orderkey AS matter_id, o_custkey AS client_id, lawyer_id, subtotal, vat, CAST(subtotal + vat AS DECIMAL(18,4)) AS total,
         CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN (subtotal + vat) * 0.5 ELSE subtotal + vat END AS DECIMAL(18,4)) AS outstanding,
         CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_orderdate AS DATE) + 30 AS due_date, date_diff('day', CAST(o_orderdate AS DATE) + 30, DATE '{REF_DATE}') AS days_overdue,
         CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'P' THEN 'PART_PAID' ELSE 'ISSUED' END AS status
       FROM orders JOIN bl ON o_orderkey = l_orderkey),
di AS (SELECT l_orderkey AS matter_id, l_suppkey AS lawyer_id, CAST(l_extendedprice * 0.01 AS DECIMAL(18,4)) AS subtotal,
         CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice * 0.01 AS DECIMAL(18,4)) ELSE 0 END AS exposure, date_diff('day', CAST(l_shipdate AS DATE), DATE '{REF_DATE}') AS age_days
       FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{REF_DATE}' AND l_returnflag = 'A' AND l_quantity < 5)
"""


def sql(body: str, more: str = "") -> str:
    """A DuckDB statement over the views; ``more`` is further common table expressions."""
    return f"WITH {CTE.strip()}{', ' + more if more else ''}\n{body}"


def rnd(x: str, digits: int = 4) -> str:
    """``scalars.js_round`` in DuckDB."""
    return f"floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"
