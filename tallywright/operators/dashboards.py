"""Dashboard and list queries: filters, pages, pivots and headline rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import js_round, percent
from ..plans.domain import Practice
from .aggregates import hours, total


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a total order (``order`` must name a unique key last)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def filtered(df: DataFrame, filters: dict[str, object], modes: dict[str, str]) -> DataFrame:
    """Generic list filter: ``exact``, ``contains`` (any case) or ``boolean``; empty filters are skipped."""
    for name, value in filters.items():
        if value is None or value == "" or name not in df.columns:
            continue
        mode = modes.get(name, "exact")
        if mode == "contains":
            df = df.where(F.contains(F.lower(F.col(name).cast("string")), F.lit(str(value).lower())))
        elif mode == "boolean":
            df = df.where(F.coalesce(F.col(name).cast("boolean"), F.lit(False)) == (str(value).lower() in ("true", "1", "yes")))
        else:
            df = df.where(F.col(name).cast("string") == str(value))
    return df


def sort_nulls_last(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Table sort: nulls are last in either direction."""
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last())


def invoice_list(invoices: DataFrame, status: str) -> DataFrame:
    rules = {"overdue": "outstanding > 0 and days_overdue > 0", "outstanding": "outstanding > 0", "paid": "outstanding = 0"}
    return invoices.where(rules[status])


def route_invoices(invoices: DataFrame) -> DataFrame:
    """(route, n): a row may take several routes or none; one scan counts all."""
    routes = F.array_compact(F.array(
        F.when(F.col("outstanding") > 0, F.lit("open")), F.when((F.col("outstanding") > 0) & (F.col("days_overdue") > 0), F.lit("overdue")), F.when(F.col("outstanding") < F.col("total"), F.lit("paid")),
    ))
    return invoices.select(F.explode(routes).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def heatmap(entries: DataFrame) -> DataFrame:
    """Hours by Monday of the week and working day."""
    days = ["mon", "tue", "wed", "thu", "fri"]
    worked = entries.where(F.weekday("entry_date") < 5).groupBy(F.trunc("entry_date", "week").alias("week"))
    return worked.agg(*[hours(total("minutes", F.weekday("entry_date") == i)).alias(d) for i, d in enumerate(days)])


def leakage(p: Practice, top: int = 10) -> DataFrame:
    """Matters with the largest age times value; the sort keeps only its top rows per partition."""
    by = p.time_entries.where("matched").groupBy("matter_id").agg(F.max("age_days").alias("age_days"), total("billable_value").alias("value"))
    return by.withColumn("risk", js_round((F.col("age_days") * F.col("value")).cast("double") / 1000, 0)).orderBy(F.desc("risk"), "matter_id").limit(top)


def pivot_kpis(kpis: DataFrame, keys: list[str]) -> DataFrame:
    """One row an entity, one column a KPI; the keys are given, so no job looks for them."""
    return kpis.groupBy("entity_id").pivot("kpi_key", keys).agg(F.max("value"))


def wip_departments(p: Practice, leak: float = 0.3) -> DataFrame:
    """Work, expected leakage of what is older than 60 days, and write-off rate by department."""
    by = p.time_entries.where("matched").groupBy("lawyer_id").agg(total("billable_value").alias("v"), total("billable_value", F.col("age_days") > 60).alias("old"), total("write_off").alias("w"))
    rolled = by.join(p.fee_earners.select("lawyer_id", "department"), "lawyer_id").groupBy("department").agg(total("v").alias("value"), total("old").alias("old"), total("w").alias("w"))
    return rolled.select("department", "value", (F.col("old") * F.lit(leak).cast("decimal(3,1)")).alias("leakage"), js_round(percent(F.col("w"), F.col("value") + F.col("w")), 4).alias("write_off_rate"))


def billing_period(invoices: DataFrame, ref: Column) -> DataFrame:
    """Totals since the start of the month before ``ref``."""
    since = F.trunc(F.add_months(ref, -1), "MM")
    return invoices.where(F.col("invoice_date") >= since).agg(
        F.count("*").alias("invoices"), total("subtotal").alias("net_billing"), total(F.col("total") - F.col("outstanding")).alias("paid"), total("outstanding").alias("outstanding"))


def at_risk_matters(matters: DataFrame) -> DataFrame:
    """Matters older than 60 days, over budget, or realised below 70 percent."""
    burn = F.when(F.col("budget") > 0, percent(F.col("billable"), F.col("budget")))
    realised = percent(F.col("net_billing"), F.nullif(F.col("billable"), F.lit(0)))
    return matters.where((F.col("age_days") > 60) | (burn > 100) | (realised < 70)).select("matter_id", "age_days", js_round(burn, 4).alias("burn"), js_round(realised, 4).alias("realisation"))


def client_rows(clients: DataFrame, least_matters: int = 1) -> DataFrame:
    open_percent = js_round(percent(F.col("outstanding"), F.nullif(F.col("net_billing"), F.lit(0))), 4)
    return clients.where(F.col("matters") >= least_matters).select("client_id", "matters", "net_billing", "outstanding", open_percent.alias("open_percent"))
