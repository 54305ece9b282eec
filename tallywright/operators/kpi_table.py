"""All built-in KPIs of all grains from three shared groupings, for snapshots.

Entries are grouped once by matter and fee earner, invoices by matter, client and fee earner,
disbursements by matter; these groups are written, and so are the rows per matter and per fee
earner that follow from them. Every KPI is then a column of a row of its grain, so lineitems are
read once for work, once for invoices and once for disbursements, however many KPIs there are.
The single formulas of ``kpi`` give the same values one at a time.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import js_round, percent, safe_div, working_days_between
from ..plans.domain import Practice
from ..session import scratch_path
from .aggregates import total, zero
from .kpi import SCORE_WEIGHTS, FirmConfig, clamp, recovery, snippets


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Bases:
    """One row per matter and per fee earner with all sums, clients' open invoices, and the firm's totals."""

    matters: DataFrame
    earners: DataFrame
    clients: DataFrame
    firm: DataFrame


_WORK = ("n", "minutes", "chargeable_minutes", "other_minutes", "billable", "write_off", "m_n", "m_minutes", "m_wip", "m_age_sum", "m_age_value", "m_risk", "labour_minutes")


def _work(p: Practice, rates: DataFrame) -> DataFrame:
    """Entries by matter and fee earner."""
    matched = F.col("matched")
    other = F.col("do_not_bill") | (F.col("write_off") > 0) | ~matched | ~F.col("is_chargeable")
    lost = js_round(F.col("billable_value").cast("double") * (1 - recovery(F.col("age_days"))), 4).cast("decimal(18,4)")
    fine = p.time_entries.groupBy("matter_id", "lawyer_id").agg(
        F.count("*").alias("n"), total("minutes").alias("minutes"), total("minutes", F.col("is_chargeable")).alias("chargeable_minutes"), total("minutes", other).alias("other_minutes"),
        total("billable_value").alias("billable"), total("write_off").alias("write_off"), F.max("entry_date").alias("last"),
        F.count_if(matched).alias("m_n"), total("minutes", matched).alias("m_minutes"), total("billable_value", matched).alias("m_wip"), F.max(F.when(matched, F.col("age_days"))).alias("m_age"),
        total("age_days", matched).alias("m_age_sum"), F.sum(F.when(matched, F.col("age_days") * F.col("billable_value"))).alias("m_age_value"), F.sum(F.when(matched, lost)).alias("m_risk"),
    )
    return fine.join(rates, "lawyer_id", "left").withColumn("labour_minutes", F.col("m_minutes") * zero(F.col("cost_rate"))).drop("cost_rate")


def _summed(work: DataFrame, *keys: str) -> DataFrame:
    return work.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _WORK], F.max("last").alias("last"), F.max("m_age").alias("m_age"))


def bases(p: Practice, c: FirmConfig) -> Bases:
    """The rows that all KPIs are columns of."""
    rates = snippets(p.fee_earners, c).select("lawyer_id", js_round(F.col("sn_005"), 4).cast("decimal(18,4)").alias("cost_rate"))
    work = _written(_work(p, rates), "kpi-work")
    age, open_ = zero(F.col("days_overdue")), F.col("outstanding") > 0
    late = open_ & (F.col("days_overdue") > 0)
    billed = _written(p.invoices.groupBy("matter_id", "client_id", "lawyer_id").agg(
        total("subtotal").alias("net"), total("outstanding", open_).alias("open"), F.sum(F.when(open_, age * F.col("outstanding"))).alias("open_age"), F.count_if(open_).alias("open_n"),
        total("days_overdue", late).alias("late_sum"), F.count_if(late).alias("late_n"),
    ), "kpi-billed")
    spent = p.disbursements.groupBy("matter_id").agg(total("subtotal").alias("spent"), total("exposure").alias("exposure"))

    known = p.matters.select("matter_id", "matter_number", F.col("client_id").alias("client"), "budget", F.lit(True).alias("known"))
    departments = p.matter_departments.select("matter_id", "department")
    by_matter = billed.where("matter_id is not null").groupBy("matter_id").agg(F.sum("net").alias("net"))
    matters = known.join(_summed(work, "matter_id"), "matter_id", "full_outer").join(by_matter, "matter_id", "full_outer").join(spent, "matter_id", "full_outer").join(departments, "matter_id", "left")
    matters = _written(matters.withColumn("labour", F.col("labour_minutes").cast("double") / 60.0).withColumn("known", F.coalesce("known", F.lit(False))), "kpi-matters")

    by_earner = billed.groupBy("lawyer_id").agg(F.sum("net").alias("gross"))
    people = snippets(p.fee_earners, c).withColumn("active", ~F.coalesce("is_system_account", F.lit(False)))
    earners = _written(people.join(_summed(work, "lawyer_id"), "lawyer_id", "full_outer").join(by_earner, "lawyer_id", "left"), "kpi-earners")

    clients = billed.groupBy("client_id").agg(F.sum("open").alias("open"), F.sum("open_age").alias("open_age"), F.sum("open_n").alias("open_n"))
    return Bases(matters, earners, clients, _firm_row(matters, earners, billed, c))


def _firm_row(matters: DataFrame, earners: DataFrame, billed: DataFrame, c: FirmConfig) -> DataFrame:
    """One row of what the firm's KPIs are made of."""
    with_work = F.col("known") & (F.col("m_wip") > 0)
    of_matters = matters.agg(
        *[F.sum(x).alias(x) for x in ("billable", "write_off", "m_n", "m_wip", "m_age_sum", "m_age_value")], F.max("m_age").alias("m_age"), F.sum("spent").alias("spent"), total("exposure").alias("exposure"),
        F.sum(F.when(with_work, F.col("m_wip"))).alias("real_wip"), total("net", with_work).alias("real_net"), total("m_risk").alias("risk"))
    utilised = _utilisation(c)
    gap = F.lit(c.target_hours) - utilised / 100 * c.available_hours
    gross, active = zero(F.col("gross")).cast("double"), F.coalesce("active", F.lit(False))
    share = F.when(F.col("pay_model") == "FeeShare", js_round(gross * (100 - c.retain) / 100, 4).cast("decimal(18,4)"))
    of_earners = earners.agg(
        total(F.when(active & (F.col("pay_model") == "Salaried"), F.col("annual_salary"))).alias("salaries"), total(F.when(active, share)).alias("shares"),
        total(F.when(active & (utilised < 100) & (gap > 0), js_round(gap * F.col("rate"), 4).cast("decimal(18,4)"))).alias("idle"))
    of_invoices = billed.agg(total("net").alias("net"), *[F.sum(x).alias(x) for x in ("open", "open_age", "open_n", "late_sum", "late_n")])
    return of_matters.crossJoin(F.broadcast(of_earners)).crossJoin(F.broadcast(of_invoices))  # single rows


def _utilisation(c: FirmConfig) -> Column:
    return js_round(percent(zero(F.col("chargeable_minutes")) / 60.0, F.lit(c.available_hours)), 4)


def _unfolded(df: DataFrame, entity: str, entity_id: Column, name: Column, rules: list[tuple[str, Column | None, Column]]) -> DataFrame:
    """A row per KPI of each row for which its condition holds."""
    rows = F.array_compact(F.array(*[
        F.when(F.lit(True) if when is None else F.coalesce(when, F.lit(False)), F.struct(F.lit(key).alias("kpi_key"), js_round(value, 4).alias("value"))) for key, when, value in rules]))
    out = df.select(F.lit(entity).alias("entity_type"), entity_id.cast("string").alias("entity_id"), F.coalesce(name.cast("string"), entity_id.cast("string")).alias("entity_name"), F.explode(rows).alias("r"))
    return out.select("r.kpi_key", "entity_type", "entity_id", "entity_name", "r.value")


def matter_rows(b: Bases) -> DataFrame:
    """KPIs of matters; a matter that only entries or disbursements name has those of its work and costs."""
    worked, known = F.col("m_n") > 0, F.col("known")
    wip, net, budget = zero(F.col("m_wip")), zero(F.col("net")), F.col("budget")
    age = F.when(worked, F.col("m_age"))
    burn = js_round(F.when(budget > 0, percent(wip, budget)), 4)
    realised = js_round(F.when(F.col("m_wip") > 0, percent(net, wip)), 4)
    recovered = js_round(F.when(F.col("spent") != 0, percent(F.col("spent") - zero(F.col("exposure")), F.col("spent"))), 4)
    # work stands for billing only where there is some
    revenue = F.coalesce(F.col("net"), F.when(worked, F.col("m_wip")), F.lit(0)).cast("double")
    cost = F.when(worked, F.col("labour")).otherwise(0.0) + zero(F.col("exposure")).cast("double")
    parts = (clamp(100 - 0.5 * age), F.when(burn.isNotNull(), clamp(100 - 2 * F.greatest(F.lit(0.0), burn - 80))), clamp(realised), clamp(recovered))
    health = sum((F.coalesce(x, F.lit(50.0)) for x in parts), F.lit(0.0)) / 4
    return _unfolded(b.matters, "matter", F.col("matter_id"), F.col("matter_number"), [
        ("F-RB-01", known & (F.col("m_wip") > 0), realised),
        ("F-RB-04", worked, safe_div(F.col("m_age_sum"), F.col("m_n"))),
        ("F-WL-01", worked, age),
        ("F-WL-02", F.col("n") > 0, percent(F.col("write_off"), F.col("billable") + F.col("write_off"))),
        ("F-WL-03", F.col("spent") != 0, recovered),
        ("F-PR-01", known, F.when((revenue == 0) & (cost == 0), None).otherwise(revenue - cost)),
        ("F-BS-01", known, burn),
        ("F-BS-02", known & (budget > 0), js_round(burn - percent(net, budget), 2)),
        ("F-CS-03", known, js_round(health, 0)),
    ])


def earner_rows(b: Bases, c: FirmConfig, ref: Column) -> DataFrame:
    """KPIs of fee earners; system accounts have those of their write-offs only."""
    active, gross = F.coalesce("active", F.lit(False)), zero(F.col("gross")).cast("double")
    utilised, idle_days = _utilisation(c), working_days_between(F.col("last"), ref)
    lost = js_round(percent(F.col("write_off"), F.col("billable") + F.col("write_off")), 4)
    profit = F.when(F.col("pay_model") == "FeeShare", gross * c.retain / 100 - c.fee_share_overhead).otherwise(gross - zero(F.col("sn_004")))
    parts = {
        "utilisation": clamp(utilised), "realisation": clamp(F.col("realised")), "recording": clamp(100 - 10 * idle_days), "write_off": clamp(100 - 2 * lost),
        "revenue": clamp(percent(F.col("gross"), F.lit(c.target_revenue))), "age": clamp(100 - 0.5 * F.col("m_age")),
    }
    score = sum((F.coalesce(parts[k], F.lit(50.0)) * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0)) / 100
    firm = b.firm.select(js_round(percent(F.col("real_net"), F.col("real_wip")), 4).alias("realised"))
    return _unfolded(b.earners.crossJoin(F.broadcast(firm)), "feeEarner", F.col("lawyer_id"), F.col("lawyer_name"), [
        ("F-TU-01", active, utilised),
        ("F-TU-02", active, idle_days),
        ("F-TU-03", active, percent(F.col("other_minutes"), F.col("minutes"))),
        ("F-RB-02", active, safe_div(gross, zero(F.col("chargeable_minutes")) / 60.0)),
        ("F-RB-03", active, gross * F.col("sn_003")),
        ("F-WL-02", F.col("n") > 0, lost),
        ("F-PR-02", active, profit),
        ("F-CS-02", active, js_round(score, 0)),
    ])


def client_rows(b: Bases, names: DataFrame) -> DataFrame:
    """KPIs of clients: profit of those with matters, debt age of those with open invoices."""
    labour = js_round(F.when(F.col("m_n") > 0, F.col("labour")), 4).cast("decimal(18,4)")
    profits = b.matters.where("known").groupBy(F.col("client").alias("client_id")).agg(total("net").alias("n_"), total(labour).alias("l_"), total("exposure").alias("x_"), F.lit(True).alias("has_matters"))
    out = profits.join(b.clients, "client_id", "full_outer").join(names.select("client_id", "display_name"), "client_id", "left")
    d = lambda n: F.col(n).cast("double")
    return _unfolded(out, "client", F.col("client_id"), F.col("display_name"), [
        ("F-PR-04", F.col("has_matters"), d("n_") - d("l_") - d("x_")),
        ("F-DM-01", F.col("open_n") > 0, safe_div(F.col("open_age"), F.col("open"))),
    ])


def department_rows(b: Bases, c: FirmConfig) -> DataFrame:
    """Profit of departments: what their fee earners bill less what their matters cost."""
    revenue = b.earners.where("department is not null").groupBy("department").agg(total("gross").alias("revenue"))
    labour = js_round(F.when(F.col("m_n") > 0, F.col("labour")), 4).cast("decimal(18,4)")
    spent = b.matters.where("department is not null").groupBy("department").agg(total(labour).alias("labour"), total("exposure").alias("exposure"))
    d = lambda n: zero(F.col(n)).cast("double")
    cost = d("labour") + d("exposure") + c.overhead_per_department
    return _unfolded(revenue.join(spent, "department", "full_outer"), "department", F.col("department"), F.col("department"), [
        ("F-PR-03", None, F.when((d("revenue") == 0) & (cost == 0), None).otherwise(d("revenue") - cost))])


def firm_rows(b: Bases, c: FirmConfig) -> DataFrame:
    """KPIs of the firm."""
    d = lambda n: F.col(n).cast("double")
    return _unfolded(b.firm, "firm", F.lit("firm"), F.lit("firm"), [
        ("F-RB-01", None, percent(F.col("real_net"), F.col("real_wip"))),
        ("F-RB-04", None, safe_div(F.col("m_age_value"), F.nullif(F.col("m_wip"), F.lit(0)))),
        ("F-WL-01", None, F.col("m_age")),
        ("F-WL-02", None, percent(F.col("write_off"), F.col("billable") + F.col("write_off"))),
        ("F-WL-03", None, percent(F.col("spent") - F.col("exposure"), F.col("spent"))),
        ("F-WL-04", None, zero(safe_div(F.col("m_age_sum"), F.col("m_n"))) + zero(safe_div(F.col("late_sum"), F.col("late_n")))),
        ("F-PR-05", None, F.when(d("net") > 0, d("net")).otherwise(zero(d("billable"))) - d("salaries") - d("shares") - d("exposure") - c.overhead_total),
        ("F-DM-01", None, safe_div(F.col("open_age"), F.col("open"))),
        ("F-CS-01", None, d("idle") + F.greatest(F.lit(0.0), zero(d("m_wip")) - d("net")) + d("risk")),
    ])


def all_rows(p: Practice, c: FirmConfig, ref: Column) -> DataFrame:
    """(kpi_key, entity_type, entity_id, entity_name, value) of the 22 built-in KPIs."""
    b = bases(p, c)
    return functools.reduce(DataFrame.unionByName, (matter_rows(b), earner_rows(b, c, ref), client_rows(b, p.clients), department_rows(b, c), firm_rows(b, c)))
