"""Snippets and KPI formulas: each takes views and returns (kpi_key, entity_type, entity_id, value).

Snippets are columns on the fee-earner table (one projection, however many there are).
Formulas are grouped plans; a formula with several grains unions its groupings and labels
every row with its own grain. A null value means "not measurable", as each docstring says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import banded, js_round, percent, safe_div, working_days_between
from ..plans.domain import Practice
from .aggregates import total, weighted_average, zero


@dataclass(frozen=True)
class FirmConfig:
    """Working time, pay and overhead settings, folded into plans as literals."""

    days_per_week: int = 5
    weekly_hours: float = 37.5
    leave_days: int = 25
    holidays: int = 8
    fee_share_percent: float = 60.0
    retain_percent: float = 40.0
    monthly_on_cost: float = 0.0
    overhead_per_hour: float = 20.0
    overhead_total: float = 100_000.0
    overhead_per_department: float = 4_000.0
    fee_share_overhead: float = 2_500.0
    target_hours: float = 1_200.0
    target_revenue: float = 150_000.0

    @property
    def available_hours(self) -> float:
        return (52 * self.days_per_week - self.leave_days - self.holidays) * (self.weekly_hours / self.days_per_week)

    @property
    def retain(self) -> float:
        """Share of a fee-share earner's billing that the firm keeps."""
        return self.retain_percent or 100 - self.fee_share_percent


# Age bands by their upper bound in days, with the part of the value that is usually recovered.
WIP_BANDS = (("0-30", 30, 0.95), ("31-60", 60, 0.85), ("61-90", 90, 0.70), ("91-180", 180, 0.50), ("180+", None, 0.25))
DEBT_BANDS = (("current", 30), ("31-60", 60), ("61-90", 90), ("91-180", 180), ("180+", None))
SCORE_WEIGHTS = {"utilisation": 25, "realisation": 20, "recording": 15, "write_off": 15, "revenue": 15, "age": 10}


def wip_band(age: Column) -> Column:
    return banded(age, [(n, u) for n, u, _ in WIP_BANDS])


def recovery(age: Column) -> Column:
    out = F.when(age <= WIP_BANDS[0][1], F.lit(WIP_BANDS[0][2]))
    for _, upper, rate in WIP_BANDS[1:]:
        out = out.otherwise(F.lit(rate)) if upper is None else out.when(age <= upper, F.lit(rate))
    return out


#: Monthly parts of an employee's cost besides the salary, as far as a table has them.
MONTHLY_COSTS = ("monthly_employer_ni", "monthly_pension", "monthly_variable_pay")


def retained(amount: Column, earners: DataFrame, config: FirmConfig) -> Column:
    """What the firm keeps of an amount that a fee earner bills: all of a salaried one's, else by percent.

    The percent is the fee earner's own (``firm_lead_percent``), an override
    (``firm_retain_percent``), the firm's, or 40, in this order; without a pay model it is null.
    """
    percents = [F.col(c).cast("double") for c in ("firm_lead_percent", "firm_retain_percent") if c in earners.columns]
    share = F.coalesce(*percents, F.lit(config.retain_percent).cast("double"), F.lit(40.0))
    return F.when(F.col("pay_model") == "Salaried", amount).when(F.col("pay_model").isNotNull(), amount * (share / 100))


def snippets(earners: DataFrame, config: FirmConfig, method: str = "fully_loaded") -> DataFrame:
    """Adds sn_001 .. sn_005: loaded hourly cost, available hours, retained part, annual cost, cost rate."""
    salaried = (F.col("pay_model") == "Salaried") & F.col("annual_salary").isNotNull()
    monthly = sum((zero(F.col(x)).cast("double") for x in MONTHLY_COSTS if x in earners.columns), F.lit(float(config.monthly_on_cost)))
    annual = F.when(salaried, F.col("annual_salary").cast("double") + 12 * monthly)
    loaded = safe_div(annual, F.lit(config.available_hours))
    direct = F.when(salaried, safe_div(F.col("annual_salary"), F.lit(config.available_hours)))
    own = {"fully_loaded": loaded, "direct": direct, "market_rate": F.coalesce(F.col("market_rate").cast("double"), loaded) if "market_rate" in earners.columns else loaded}[method]
    return earners.withColumns({
        "sn_001": loaded, "sn_002": F.lit(config.available_hours), "sn_003": F.when(F.col("pay_model") == "Salaried", 1.0).otherwise(config.retain / 100), "sn_004": annual,
        "sn_005": F.when(F.col("pay_model") == "FeeShare", F.col("rate") * config.fee_share_percent / 100).otherwise(own),
    })


def kpi(df: DataFrame, key: str, entity: str, entity_id: str | Column, value: Column) -> DataFrame:
    entity_id = F.col(entity_id) if isinstance(entity_id, str) else entity_id
    return df.select(F.lit(key).alias("kpi_key"), F.lit(entity).alias("entity_type"), entity_id.cast("string").alias("entity_id"), js_round(value, 4).alias("value"))


def _firm(df: DataFrame, key: str, value: Column) -> DataFrame:
    return kpi(df, key, "firm", F.lit("firm"), value)


def _active(earners: DataFrame) -> DataFrame:
    return earners.where(~F.coalesce("is_system_account", F.lit(False)))


def f_tu_01(p: Practice, c: FirmConfig, variant: str = "strict_chargeable") -> DataFrame:
    """Utilisation of fee earners; no entries is 0, no available hours is null."""
    counts = {"strict_chargeable": F.col("is_chargeable"), "broad_chargeable": ~F.col("do_not_bill"), "recorded": F.lit(True)}[variant]
    worked = p.time_entries.groupBy("lawyer_id").agg(total("minutes", counts).alias("m"))
    out = _active(p.fee_earners).join(worked, "lawyer_id", "left")
    return kpi(out, "F-TU-01", "feeEarner", "lawyer_id", percent(zero(F.col("m")) / 60.0, F.lit(c.available_hours)))


def f_tu_02(p: Practice, ref: Column) -> DataFrame:
    """Working days since the last entry; without a dated entry the fee earner's ``recording_gap_days``, if known, else null."""
    last = p.time_entries.groupBy("lawyer_id").agg(F.max("entry_date").alias("last"))
    told = [F.col("recording_gap_days").cast("double")] if "recording_gap_days" in p.fee_earners.columns else []
    gap = F.coalesce(working_days_between(F.col("last"), ref).cast("double"), *told)
    return kpi(_active(p.fee_earners).join(last, "lawyer_id", "left"), "F-TU-02", "feeEarner", "lawyer_id", gap)


def f_tu_03(p: Practice) -> DataFrame:
    """Part of hours that is not chargeable; null without hours."""
    other = F.col("do_not_bill") | (F.col("write_off") > 0) | ~F.col("matched") | ~F.col("is_chargeable")
    sums = p.time_entries.groupBy("lawyer_id").agg(total("minutes", other).alias("o"), total("minutes").alias("m"))
    return kpi(_active(p.fee_earners).join(sums, "lawyer_id", "left"), "F-TU-03", "feeEarner", "lawyer_id", percent(F.col("o"), F.col("m")))


def f_rb_01(p: Practice, variant: str = "all_matters") -> DataFrame:
    """Billing over work of matters with work; fixed fees are left out or read 100 by variant."""
    wip = p.time_entries.where("matched").groupBy("matter_id").agg(total("billable_value").alias("wip")).where("wip > 0")
    net = p.invoices.groupBy("matter_id").agg(total("subtotal").alias("net"))
    out = p.matters.join(wip, "matter_id").join(net, "matter_id", "left")
    value = percent(zero(F.col("net")), F.col("wip"))
    if variant == "time_billed_only":
        out = out.where(~F.col("is_fixed_fee"))
    elif variant == "adjusted_fixed_fee":
        value = F.when(F.col("is_fixed_fee"), 100.0).otherwise(value)
    return kpi(out, "F-RB-01", "matter", "matter_id", value)


def f_rb_01_firm(p: Practice) -> DataFrame:
    """Realisation of the firm: net billing over work, of all matters with work."""
    wip = p.time_entries.where("matched").groupBy("matter_id").agg(total("billable_value").alias("wip")).where("wip > 0")
    net = p.invoices.groupBy("matter_id").agg(total("subtotal").alias("net"))
    both = p.matters.select("matter_id").join(wip, "matter_id").join(net, "matter_id", "left").agg(total("net").alias("n"), F.sum("wip").alias("w"))
    return _firm(both, "F-RB-01", percent(F.col("n"), F.col("w")))


def _revenue(p: Practice) -> DataFrame:
    return p.invoices.groupBy("lawyer_id").agg(total("subtotal").alias("gross"))


def f_rb_02(p: Practice, base: str = "chargeable") -> DataFrame:
    """Revenue per hour; null without hours."""
    worked = p.time_entries.groupBy("lawyer_id").agg(total("minutes", F.col("is_chargeable") if base != "total" else F.lit(True)).alias("m"))
    out = _active(p.fee_earners).join(worked, "lawyer_id", "left").join(_revenue(p), "lawyer_id", "left")
    return kpi(out, "F-RB-02", "feeEarner", "lawyer_id", safe_div(zero(F.col("gross")), zero(F.col("m")) / 60.0))


def rate_capture(p: Practice, base: str = "chargeable") -> DataFrame:
    """(lawyer_id, effective_rate, charge_out_rate, rate_capture): revenue per hour in percent of the rate that is charged.

    No hours give nulls, no revenue zeros; a charge-out rate of zero captures nothing that can be measured.
    """
    worked = p.time_entries.groupBy("lawyer_id").agg(total("minutes", F.col("is_chargeable") if base != "total" else F.lit(True)).alias("m"))
    out = _active(p.fee_earners).join(worked, "lawyer_id", "left").join(_revenue(p), "lawyer_id", "left")
    effective = safe_div(zero(F.col("gross")), zero(F.col("m")) / 60.0)
    capture = F.when(effective == 0, F.when(F.col("rate").isNotNull(), 0.0)).when(F.col("rate") > 0, percent(effective, F.col("rate")))
    return out.select("lawyer_id", js_round(effective, 4).alias("effective_rate"), F.when(effective.isNotNull(), F.col("rate").cast("double")).alias("charge_out_rate"), js_round(capture, 4).alias("rate_capture"))


def f_rb_03(p: Practice, c: FirmConfig) -> DataFrame:
    """Revenue that the firm keeps of each fee earner."""
    out = snippets(_active(p.fee_earners), c).join(_revenue(p), "lawyer_id", "left")
    return kpi(out, "F-RB-03", "feeEarner", "lawyer_id", zero(F.col("gross")).cast("double") * F.col("sn_003"))


def f_rb_04(p: Practice, aggregated: DataFrame | None = None) -> DataFrame:
    """Mean age of a matter's entries, and the value-weighted mean of the firm.

    ``aggregated`` (matter_id, wip_age_days, invoices, wip) stands in for matters without
    entries: fully billed ones are 0 days old, others as old as it says, those with work of
    unknown age null; it weighs in the firm's mean with its work.
    """
    entries = p.time_entries.where("matched")
    by = entries.groupBy("matter_id").agg(F.avg("age_days").alias("age"), F.sum(F.col("age_days") * F.col("billable_value")).cast("double").alias("weighted"), total("billable_value").cast("double").alias("weight"))
    if aggregated is not None:
        billed = (F.col("invoices") > 0) & (F.col("wip") == 0)
        age = F.when(billed, 0.0).otherwise(F.col("wip_age_days").cast("double"))
        told = aggregated.join(by, "matter_id", "left_anti").where(billed | F.col("wip_age_days").isNotNull() | (F.col("wip") > 0))
        by = by.unionByName(told.select("matter_id", age.alias("age"), (age * F.col("wip")).cast("double").alias("weighted"), F.when(age.isNotNull(), F.col("wip").cast("double")).alias("weight")))
    matters = kpi(by, "F-RB-04", "matter", "matter_id", F.col("age"))
    if aggregated is None:
        firm = entries.agg(weighted_average("age_days", "billable_value").alias("age"))
    else:
        firm = by.agg(safe_div(F.sum(js_round(F.col("weighted"), 4).cast("decimal(28,4)")), F.nullif(F.sum(js_round(F.col("weight"), 4).cast("decimal(28,4)")), F.lit(0))).alias("age"))
    return matters.unionByName(_firm(firm, "F-RB-04", F.col("age")))


def f_wl_01(p: Practice, variant: str = "oldest_entry") -> DataFrame:
    """Age of work in progress by matter and firm."""
    measure = {"oldest_entry": F.max("age_days"), "average_entry": F.avg("age_days"), "weighted_average": weighted_average("age_days", "billable_value")}[variant]
    entries = p.time_entries.where("matched")
    by, firm = entries.groupBy("matter_id").agg(measure.alias("age")), entries.agg(measure.alias("age"))
    return kpi(by, "F-WL-01", "matter", "matter_id", F.col("age")).unionByName(_firm(firm, "F-WL-01", F.col("age")))


def at_risk(p: Practice) -> DataFrame:
    """(matter_id, value, at_risk): what ageing work is not expected to recover."""
    lost = F.col("billable_value").cast("double") * (1 - recovery(F.col("age_days")))
    return p.time_entries.where("matched").groupBy("matter_id").agg(total("billable_value").alias("value"), js_round(F.sum(js_round(lost, 4).cast("decimal(18,4)")), 4).alias("at_risk"))


def f_wl_02(p: Practice) -> DataFrame:
    """Write-off part of work by matter, fee earner and firm; null without work. One pass by grouping sets."""
    sums = p.time_entries.groupingSets([["matter_id"], ["lawyer_id"], []], "matter_id", "lawyer_id").agg(
        total("write_off").alias("w"), total("billable_value").alias("b"), F.grouping_id().alias("g"),
    )
    value = percent(F.col("w"), F.col("b") + F.col("w"))
    grain = F.when(F.col("g") == 1, "matter").when(F.col("g") == 2, "feeEarner").otherwise("firm")
    name = F.coalesce(F.when(F.col("g") == 1, F.col("matter_id")).when(F.col("g") == 2, F.col("lawyer_id")).cast("string"), F.lit("firm"))
    return sums.select(F.lit("F-WL-02").alias("kpi_key"), grain.alias("entity_type"), name.alias("entity_id"), js_round(value, 4).alias("value"))


def f_wl_02_by_grade(p: Practice) -> DataFrame:
    """(entity_type, entity_id, grade, amount, entries, percent): write-offs by grade of who recorded them, of matters, fee earners and the firm.

    Only amounts above zero count, in percent of all that the entity wrote off; entries are
    grouped by matter and fee earner before they meet a grade.
    """
    gone = F.col("write_off") > 0
    fine = p.time_entries.groupBy("matter_id", "lawyer_id").agg(total("write_off").alias("w"), total("write_off", gone).alias("amount"), F.count_if(gone).alias("n"))
    graded = fine.join(p.fee_earners.select("lawyer_id", "grade"), "lawyer_id", "left").withColumn("grade", F.coalesce("grade", F.lit("unknown")))
    sums = graded.groupingSets([["matter_id", "grade"], ["lawyer_id", "grade"], ["grade"]], "matter_id", "lawyer_id", "grade").agg(
        F.sum("w").alias("w"), F.sum("amount").alias("amount"), F.sum("n").alias("entries"), F.grouping("matter_id").alias("no_matter"), F.grouping("lawyer_id").alias("no_earner"))
    entity = F.when(F.col("no_matter") == 0, "matter").when(F.col("no_earner") == 0, "feeEarner").otherwise("firm")
    name = F.coalesce(F.when(F.col("no_matter") == 0, F.col("matter_id")).when(F.col("no_earner") == 0, F.col("lawyer_id")).cast("string"), F.lit("firm"))
    out = sums.select(entity.alias("entity_type"), name.alias("entity_id"), "grade", "w", "amount", "entries")
    whole = F.sum("w").over(W.partitionBy("entity_type", "entity_id"))
    return out.withColumn("percent", js_round(F.when(whole > 0, percent(F.col("amount"), whole)).otherwise(0.0), 4)).where("entries > 0").select("entity_type", "entity_id", "grade", "amount", "entries", "percent")


def f_wl_03(p: Practice, invoiced: DataFrame | None = None) -> DataFrame:
    """Recovered part of disbursements by matter and firm.

    ``invoiced`` (matter_id, invoiced_disbursements) stands in for matters without records:
    what was invoiced is recovered.
    """
    measure = (total("subtotal").alias("t"), total("exposure").alias("x"))
    value = percent(F.col("t") - F.col("x"), F.col("t"))
    by = p.disbursements.groupBy("matter_id").agg(*measure)
    if invoiced is None:
        firm = p.disbursements.agg(*measure)
    else:
        told = invoiced.join(by, "matter_id", "left_anti").select("matter_id", F.col("invoiced_disbursements").alias("t"), F.lit(0).alias("x"))
        by = by.unionByName(told)
        firm = by.where("t <> 0").agg(total("t").alias("t"), total("x").alias("x")).where("t > 0")
    return kpi(by.where("t <> 0"), "F-WL-03", "matter", "matter_id", value).unionByName(_firm(firm, "F-WL-03", value))


def f_wl_04(p: Practice, variant: str = "from_due_date", ref: Column | None = None) -> DataFrame:
    """Lock-up days: mean age of matched work plus mean days of unpaid invoices.

    Days count from the due date, where positive; or from the invoice date, not below zero. A
    variant by payment date would have to fall back to due dates, for what is unpaid has none.
    """
    work = p.time_entries.where("matched").agg(F.avg("age_days").alias("w"))
    unpaid = p.invoices.where("outstanding > 0")
    if variant == "from_invoice_date":
        debt = unpaid.agg(F.avg(F.greatest(F.lit(0), F.datediff(ref, F.col("invoice_date")))).alias("d"))
    else:
        debt = unpaid.where("days_overdue > 0").agg(F.avg("days_overdue").alias("d"))
    return _firm(work.crossJoin(F.broadcast(debt)), "F-WL-04", zero(F.col("w")) + zero(F.col("d")))


def matter_costs(p: Practice, c: FirmConfig) -> DataFrame:
    """(matter_id, minutes, labour): minutes meet rates per matter and earner, after grouping."""
    fine = p.time_entries.where("matched").groupBy("matter_id", "lawyer_id").agg(total("minutes").alias("minutes"))
    rates = snippets(p.fee_earners, c).select("lawyer_id", js_round(F.col("sn_005"), 4).cast("decimal(18,4)").alias("cost_rate"))
    return fine.join(rates, "lawyer_id", "left").groupBy("matter_id").agg(
        F.sum("minutes").alias("minutes"), (F.sum(F.col("minutes") * zero(F.col("cost_rate"))).cast("double") / 60.0).alias("labour"),
    )


def matter_profit(p: Practice, c: FirmConfig, variant: str = "standard") -> DataFrame:
    """(matter_id, revenue, cost) of every matter: net billing, or work where there is none, against labour and exposure.

    ``full`` adds overhead by hour; ``simple`` takes all hours at the mean cost rate and nothing else.
    """
    net = p.invoices.groupBy("matter_id").agg(total("subtotal").alias("net"))
    wip = p.time_entries.where("matched").groupBy("matter_id").agg(total("billable_value").alias("wip"), total("minutes").alias("worked"))
    out = p.matters.select("matter_id").join(net, "matter_id", "left").join(wip, "matter_id", "left")
    revenue = F.coalesce(F.col("net"), F.col("wip"), F.lit(0)).cast("double")
    if variant == "simple":
        mean = snippets(p.fee_earners, c).agg(js_round(F.avg("sn_005"), 4).alias("mean_rate"))
        return out.crossJoin(F.broadcast(mean)).select("matter_id", revenue.alias("revenue"), (zero(F.col("worked")) / 60.0 * zero(F.col("mean_rate"))).alias("cost"))
    exposure = p.disbursements.groupBy("matter_id").agg(total("exposure").alias("exposure"))
    out = out.join(matter_costs(p, c), "matter_id", "left").join(exposure, "matter_id", "left")
    cost = zero(F.col("labour")) + zero(F.col("exposure")).cast("double")
    if variant == "full":
        cost = cost + zero(F.col("minutes")) / 60.0 * c.overhead_per_hour
    return out.select("matter_id", revenue.alias("revenue"), cost.alias("cost"))


def f_pr_01(p: Practice, c: FirmConfig, variant: str = "standard") -> DataFrame:
    """Revenue less cost of matters; null where both are nothing."""
    revenue, cost = F.col("revenue"), F.col("cost")
    return kpi(matter_profit(p, c, variant), "F-PR-01", "matter", "matter_id", F.when((revenue == 0) & (cost == 0), None).otherwise(revenue - cost))


def profit_margin(p: Practice, c: FirmConfig) -> DataFrame:
    """Profit of matters in percent of their revenue; null without revenue."""
    revenue = F.col("revenue")
    return kpi(matter_profit(p, c), "F-PR-01-margin", "matter", "matter_id", F.when(revenue > 0, percent(revenue - F.col("cost"), revenue)))


def earner_profit(p: Practice, c: FirmConfig) -> DataFrame:
    """Fee earners with gross billing and profit."""
    out = snippets(_active(p.fee_earners), c).join(_revenue(p), "lawyer_id", "left").withColumn("billed", F.col("gross").isNotNull()).withColumn("gross", zero(F.col("gross")).cast("double"))
    profit = F.when(F.col("pay_model") == "FeeShare", F.col("gross") * c.retain / 100 - c.fee_share_overhead).otherwise(F.col("gross") - zero(F.col("sn_004")))
    return out.withColumn("profit", profit)


def f_pr_02(p: Practice, c: FirmConfig) -> DataFrame:
    return kpi(earner_profit(p, c), "F-PR-02", "feeEarner", "lawyer_id", F.col("profit"))


def f_pr_03(p: Practice, c: FirmConfig) -> DataFrame:
    """Departments: what their earners bill, less labour and exposure of their matters and a share of overhead; null where all is nothing."""
    revenue = p.fee_earners.select("lawyer_id", "department").where("department is not null").join(_revenue(p), "lawyer_id", "left").groupBy("department").agg(total("gross").alias("revenue"))
    labour = matter_costs(p, c).select("matter_id", js_round(F.col("labour"), 4).cast("decimal(18,4)").alias("labour"))
    exposure = p.disbursements.groupBy("matter_id").agg(total("exposure").alias("exposure"))
    placed = p.matter_departments.where("department is not null")
    spent = placed.join(labour, "matter_id", "left").join(exposure, "matter_id", "left").groupBy("department").agg(total("labour").alias("labour"), total("exposure").alias("exposure"))
    out = revenue.join(spent, "department", "full_outer")
    d = lambda n: zero(F.col(n)).cast("double")
    cost = d("labour") + d("exposure") + c.overhead_per_department
    return kpi(out, "F-PR-03", "department", "department", F.when((d("revenue") == 0) & (cost == 0), None).otherwise(d("revenue") - cost))


def f_pr_04(p: Practice, c: FirmConfig) -> DataFrame:
    """Billing of clients less labour and exposure of their matters."""
    exposure = p.disbursements.groupBy("matter_id").agg(total("exposure").alias("exposure"))
    net = p.invoices.groupBy("matter_id").agg(total("subtotal").alias("net"))
    cost = matter_costs(p, c).select("matter_id", js_round(F.col("labour"), 4).cast("decimal(18,4)").alias("labour"))
    by = p.matters.join(net, "matter_id", "left").join(cost, "matter_id", "left").join(exposure, "matter_id", "left").groupBy("client_id").agg(
        total("net").alias("n"), total("labour").alias("l"), total("exposure").alias("x"))
    return kpi(by, "F-PR-04", "client", "client_id", F.col("n").cast("double") - F.col("l").cast("double") - F.col("x").cast("double"))


def f_pr_05(p: Practice, c: FirmConfig) -> DataFrame:
    """Profit of the firm: billing, or recorded work where nothing is billed, less salaries, fee shares, exposure and overhead."""
    earners = earner_profit(p, c)
    share = F.when(F.col("pay_model") == "FeeShare", js_round(F.col("gross") * (100 - c.retain) / 100, 4).cast("decimal(18,4)"))
    salary = F.when(F.col("pay_model") == "Salaried", F.col("annual_salary"))
    pay = earners.agg(total(salary).alias("s"), total(share).alias("f"))
    net = p.invoices.agg(total("subtotal").alias("n"))
    exposure = p.disbursements.agg(total("exposure").alias("x"))
    worked = p.time_entries.agg(total("billable_value").alias("w"))
    row = net.crossJoin(F.broadcast(pay)).crossJoin(F.broadcast(exposure)).crossJoin(F.broadcast(worked))
    d = lambda n: F.col(n).cast("double")
    return _firm(row, "F-PR-05", F.when(d("n") > 0, d("n")).otherwise(d("w")) - d("s") - d("f") - d("x") - c.overhead_total)


def f_bs_01(p: Practice) -> DataFrame:
    """Work over budget; null without a positive budget."""
    wip = p.time_entries.where("matched").groupBy("matter_id").agg(total("billable_value").alias("wip"))
    return kpi(p.matters.join(wip, "matter_id", "left"), "F-BS-01", "matter", "matter_id", F.when(F.col("budget") > 0, percent(zero(F.col("wip")), F.col("budget"))))


def f_bs_01_hours(p: Practice) -> DataFrame:
    """Hours over those that the budget buys at the mean charge-out rate of the matter's entries; null without budget or rate."""
    fine = p.time_entries.where("matched").groupBy("matter_id", "lawyer_id").agg(total("minutes").alias("minutes"), F.count("*").alias("n"))
    rated = fine.join(p.fee_earners.select("lawyer_id", "rate"), "lawyer_id", "left").groupBy("matter_id").agg(
        total("minutes").alias("minutes"), safe_div(F.sum(F.col("rate") * F.col("n")), F.sum(F.when(F.col("rate").isNotNull(), F.col("n")))).alias("mean_rate"))
    hours = F.col("minutes") / 60.0
    bought = safe_div(F.col("budget"), F.nullif(F.col("mean_rate"), F.lit(0.0)))
    return kpi(p.matters.join(rated, "matter_id", "left"), "F-BS-01", "matter", "matter_id", F.when(F.col("budget") > 0, percent(hours, bought)))


def creep_label(creep: Column) -> Column:
    return F.when(creep >= 20, "High scope creep risk").when(creep >= 10, "Moderate scope creep").when(creep > 0, "Slight scope creep").when(creep.isNotNull(), "On track or ahead")


def f_bs_02(p: Practice) -> DataFrame:
    """Budget burnt beyond what is billed of it."""
    net = p.invoices.groupBy("matter_id").agg(total("subtotal").alias("net"))
    burn = f_bs_01(p).select(F.col("entity_id").cast("long").alias("matter_id"), F.col("value").alias("burn"))
    out = p.matters.where("budget > 0").join(burn, "matter_id").join(net, "matter_id", "left")
    return kpi(out, "F-BS-02", "matter", "matter_id", js_round(F.col("burn") - percent(zero(F.col("net")), F.col("budget")), 2))


def aged_debt(invoices: DataFrame, *keys: str) -> DataFrame:
    """Outstanding-weighted age, extremes and bands of open invoices at any grain."""
    age = zero(F.col("days_overdue"))
    open_ = invoices.where("outstanding > 0").withColumn("age", age).withColumn("band", banded(age, list(DEBT_BANDS)))
    bands = [total("outstanding", F.col("band") == n).alias(f"band_{i}") for i, (n, _) in enumerate(DEBT_BANDS)]
    return open_.groupBy(*keys).agg(js_round(weighted_average("age", "outstanding"), 4).alias("weighted_age"), F.max("age").alias("longest"), F.count("*").alias("invoices"), total("outstanding").alias("outstanding"), *bands)


def f_dm_01(p: Practice) -> DataFrame:
    """Outstanding-weighted debt age of clients and the firm."""
    by, firm = aged_debt(p.invoices, "client_id"), aged_debt(p.invoices)
    return kpi(by, "F-DM-01", "client", "client_id", F.col("weighted_age")).unionByName(_firm(firm, "F-DM-01", F.col("weighted_age")))


def f_dm_02(p: Practice, least: int = 3) -> DataFrame:
    """Mean days that clients with at least so many settled invoices run past due (an extension)."""
    by = p.invoices.where("outstanding = 0").groupBy("client_id").agg(F.avg("days_overdue").alias("late"), F.count("*").alias("n")).where(F.col("n") >= least)
    return kpi(by, "F-DM-02", "client", "client_id", F.col("late"))


def f_cs_01(p: Practice, c: FirmConfig) -> DataFrame:
    """Recoverable value: idle target hours at rate, unbilled work, and work at risk."""
    util = f_tu_01(p, c).select(F.col("entity_id").cast("long").alias("lawyer_id"), F.col("value").alias("u"))
    gap = F.lit(c.target_hours) - F.col("u") / 100 * c.available_hours
    idle = p.fee_earners.join(util, "lawyer_id").where((F.col("u") < 100) & (gap > 0)).agg(total(js_round(gap * F.col("rate"), 4).cast("decimal(18,4)")).alias("idle"))
    wip = p.time_entries.where("matched").agg(total("billable_value").alias("wip"))
    net = p.invoices.agg(total("subtotal").alias("net"))
    risk = at_risk(p).agg(total(F.col("at_risk").cast("decimal(18,4)")).alias("risk"))
    row = idle.crossJoin(F.broadcast(wip)).crossJoin(F.broadcast(net)).crossJoin(F.broadcast(risk))
    d = lambda n: F.col(n).cast("double")
    return _firm(row, "F-CS-01", d("idle") + F.greatest(F.lit(0.0), d("wip") - d("net")) + d("risk"))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def earner_measures(p: Practice, c: FirmConfig, ref: Column) -> DataFrame:
    """Active fee earners with utilisation, gap_days, write_off_rate, age, gross, hourly_rate, kept and profit, from one grouping of entries and one of invoices."""
    worked = p.time_entries.groupBy("lawyer_id").agg(
        total("minutes", F.col("is_chargeable")).alias("m"), F.max("entry_date").alias("last"), total("write_off").alias("w"), total("billable_value").alias("b"), F.max(F.when(F.col("matched"), F.col("age_days"))).alias("age"))
    out = earner_profit(p, c).join(worked, "lawyer_id", "left")
    return out.withColumns({
        "utilisation": js_round(percent(zero(F.col("m")) / 60.0, F.lit(c.available_hours)), 4), "gap_days": js_round(working_days_between(F.col("last"), ref), 4),
        "write_off_rate": js_round(percent(F.col("w"), F.col("b") + F.col("w")), 4), "hourly_rate": js_round(safe_div(F.col("gross"), zero(F.col("m")) / 60.0), 4),
        "kept": js_round(F.col("gross") * F.col("sn_003"), 4), "profit": js_round(F.col("profit"), 4),
    })


def f_cs_02(p: Practice, c: FirmConfig, ref: Column) -> DataFrame:
    """Fee-earner score of 0 to 100 from six weighted parts; a missing part counts 50."""
    # realisation is the firm's, for there is none by earner
    out = earner_measures(p, c, ref).crossJoin(F.broadcast(f_rb_01_firm(p).select(F.col("value").alias("realised"))))
    billed = F.when(F.col("billed"), F.col("gross"))
    parts = {
        "utilisation": clamp(F.col("utilisation")), "realisation": clamp(F.col("realised")), "recording": clamp(100 - 10 * F.col("gap_days")), "write_off": clamp(100 - 2 * F.col("write_off_rate")),
        "revenue": clamp(percent(billed, F.lit(c.target_revenue))), "age": clamp(100 - 0.5 * F.col("age")),
    }
    score = sum((F.coalesce(parts[k], F.lit(50.0)) * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0)) / 100
    return kpi(out, "F-CS-02", "feeEarner", "lawyer_id", js_round(score, 0))


def f_cs_03(p: Practice) -> DataFrame:
    """Matter health of 0 to 100: mean of age, budget, realisation and recovery parts."""
    out, parts = _health(p)
    score = sum((F.coalesce(x, F.lit(50.0)) for x in parts), F.lit(0.0)) / 4
    return kpi(out, "F-CS-03", "matter", "entity_id", js_round(score, 0))


def health_flags(p: Practice) -> DataFrame:
    """(entity_id, flag): what a matter's health suffers from."""
    out, _ = _health(p)
    flags = F.array_compact(F.array(
        F.when(F.col("burn") > 100, "Over budget"), F.when(F.col("age") > 90, "Aged WIP at risk"), F.when(F.col("real") < 60, "Low realisation"), F.when(F.col("recovered") < 50, "Low disbursement recovery"),
    ))
    return out.select("entity_id", F.explode(flags).alias("flag"))


def _health(p: Practice) -> tuple[DataFrame, tuple[Column, ...]]:
    part = lambda df, name: df.where("entity_type = 'matter'").select("entity_id", F.col("value").alias(name))
    out = p.matters.select(F.col("matter_id").cast("string").alias("entity_id"))
    for df, name in ((f_wl_01(p), "age"), (f_bs_01(p), "burn"), (f_rb_01(p), "real"), (f_wl_03(p), "recovered")):
        out = out.join(part(df, name), "entity_id", "left")
    parts = (clamp(100 - 0.5 * F.col("age")), clamp(100 - 2 * F.greatest(F.lit(0.0), F.col("burn") - 80)), clamp(F.col("real")), clamp(F.col("recovered")))
    # a null burn keeps its part missing
    return out, (parts[0], F.when(F.col("burn").isNotNull(), parts[1]), parts[2], parts[3])


def kpi_rows(p: Practice, c: FirmConfig, additional: bool = False) -> DataFrame:
    """Eight KPIs of all grains from one grouping each of entries, invoices and disbursements.

    ``additional`` adds a map of the amounts that a value was made of, for formulas that ask for them.

    Every source is grouped once by grouping sets; the groups and the entities that must have
    a row even without facts meet in one grouping by entity, and a row's KPIs unfold from it.
    """
    matched = F.col("matched")
    worked = p.time_entries.groupingSets([["matter_id"], ["lawyer_id"], []], "matter_id", "lawyer_id").agg(
        F.grouping_id().alias("g"), total("write_off").alias("write_off"), total("billable_value").alias("billable"), total("billable_value", matched).alias("wip"), F.max(F.when(matched, F.col("age_days"))).alias("age"),
        F.sum(F.when(matched, F.col("age_days"))).alias("age_sum"), F.count_if(matched).alias("aged"), total("minutes", F.col("is_chargeable")).alias("chargeable"), F.lit(True).alias("has_work"),
    )
    open_, late = F.col("outstanding") > 0, (F.col("outstanding") > 0) & (F.col("days_overdue") > 0)
    age = zero(F.col("days_overdue"))
    billed = p.invoices.groupingSets([["matter_id"], ["client_id"], []], "matter_id", "client_id").agg(
        F.grouping_id().alias("g"), total("subtotal").alias("net"), F.sum(F.when(open_, F.col("outstanding"))).alias("open"), F.sum(F.when(open_, age * F.col("outstanding"))).alias("open_age"),
        F.count_if(open_).alias("open_n"), F.sum(F.when(late, F.col("days_overdue"))).alias("late_sum"), F.count_if(late).alias("late_n"),
    )
    spent = p.disbursements.groupingSets([["matter_id"], []], "matter_id").agg(F.grouping_id().alias("g"), total("subtotal").alias("spent"), total("exposure").alias("exposure"))

    def keyed(df: DataFrame, kinds: dict[int, tuple[str, str | None]]) -> DataFrame:
        kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for g, (entity, column) in kinds.items():
            kind = F.when(F.col("g") == g, entity).otherwise(kind)
            name = F.when(F.col("g") == g, F.col(column).cast("string") if column else F.lit("firm")).otherwise(name)
        own = [x for x in df.columns if x not in {"g", *(x for _, x in kinds.values())}]
        return df.select(kind.alias("entity_type"), name.alias("entity_id"), *own)

    facts = keyed(worked, {1: ("matter", "matter_id"), 2: ("feeEarner", "lawyer_id"), 3: ("firm", None)})
    facts = facts.unionByName(keyed(billed, {1: ("matter", "matter_id"), 2: ("client", "client_id"), 3: ("firm", None)}), allowMissingColumns=True)
    facts = facts.unionByName(keyed(spent, {0: ("matter", "matter_id"), 1: ("firm", None)}), allowMissingColumns=True)
    facts = facts.unionByName(p.matters.select(F.lit("matter").alias("entity_type"), F.col("matter_id").cast("string").alias("entity_id"), "budget", F.lit(True).alias("is_known")), allowMissingColumns=True)
    facts = facts.unionByName(_active(p.fee_earners).select(F.lit("feeEarner").alias("entity_type"), F.col("lawyer_id").cast("string").alias("entity_id"), F.lit(True).alias("is_known")), allowMissingColumns=True)
    one = facts.groupBy("entity_type", "entity_id").agg(*[F.max(x).alias(x) for x in facts.columns[2:]])

    entity = lambda name: F.col("entity_type") == name
    firm, known = entity("firm"), F.coalesce("is_known", F.lit(False))
    rules = (
        ("F-TU-01", entity("feeEarner") & known, percent(zero(F.col("chargeable")) / 60.0, F.lit(c.available_hours))),
        ("F-WL-01", entity("matter") & (F.col("aged") > 0) | firm, F.col("age")),
        ("F-WL-02", F.coalesce("has_work", F.lit(False)), percent(F.col("write_off"), F.col("billable") + F.col("write_off"))),
        ("F-WL-03", entity("matter") & (F.col("spent") != 0) | firm, percent(F.col("spent") - F.col("exposure"), F.col("spent"))),
        ("F-WL-04", firm, zero(safe_div(F.col("age_sum"), F.col("aged"))) + zero(safe_div(F.col("late_sum"), F.col("late_n")))),
        ("F-RB-01", entity("matter") & known & (F.col("wip") > 0), percent(zero(F.col("net")), F.col("wip"))),
        ("F-BS-01", entity("matter") & known, F.when(F.col("budget") > 0, percent(zero(F.col("wip")), F.col("budget")))),
        ("F-DM-01", entity("client") & (F.col("open_n") > 0) | firm, safe_div(F.col("open_age"), F.col("open"))),
    )
    rows = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(key).alias("kpi_key"), js_round(value, 4).alias("value"))) for key, when, value in rules]))
    out = one.select("*", F.explode(rows).alias("r"))
    if not additional:
        return out.select("r.kpi_key", "entity_type", "entity_id", "r.value")
    parts = {"wip": "wip", "budget": "budget", "netBilling": "net", "writeOff": "write_off", "billable": "billable", "outstanding": "open", "spent": "spent", "exposure": "exposure", "chargeableMinutes": "chargeable"}
    amounts = F.map_filter(F.create_map(*[x for name, column in parts.items() for x in (F.lit(name), F.col(column).cast("double"))]), lambda _, v: v.isNotNull())
    return out.select("r.kpi_key", "entity_type", "entity_id", "r.value", amounts.alias("additional"))


def invoice_days(p: Practice) -> DataFrame:
    """Days past due of open invoices, as rows of F-DM-01 by invoice, for the risk rules."""
    return kpi(p.invoices.where("outstanding > 0"), "F-DM-01", "invoice", "invoice_id", zero(F.col("days_overdue")))
