"""Data quality, readiness of formulas, derived entities, overrides and upload status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import js_round

# Points off for each dataset that is missing.
MISSING_PENALTY = {"feeEarner": 20, "wipJson": 20, "fullMattersJson": 15, "invoicesJson": 10, "contactsJson": 5}


def report(entries: DataFrame, matters: DataFrame, available: set[str], invoices: DataFrame | None = None) -> DataFrame:
    """One row: orphaned entries and their share of the value, matters without a client, and a score out of 100.

    All tables are single rows before they meet. Orphans over 20 percent cost 5 points, over
    5 percent 3; clients missing on over a fifth of the matters cost 3; invoices without any
    payment date, and entries without any activity, cost 2 each.
    """
    lost = ~F.col("matched")
    done = F.count("activity") if "activity" in entries.columns else F.lit(1)
    e = entries.agg(F.count_if(lost).alias("orphans"), F.sum(F.when(lost, F.col("billable_value")).otherwise(0)).cast("double").alias("lost_value"), F.sum("billable_value").cast("double").alias("value"), done.alias("with_activity"), F.count("*").alias("entries"))
    m = matters.agg(F.count_if(F.col("display_name").isNull()).alias("unresolved"), F.count("*").alias("matters"))
    row = e.join(F.broadcast(m))
    undated = F.lit(0)
    if invoices is not None:
        row = row.join(F.broadcast(invoices.agg(F.count("*").alias("invoices"), F.count("date_paid").alias("dated"))))
        undated = F.when((F.col("invoices") > 0) & (F.col("dated") == 0), 2).otherwise(0)
    percent = F.try_divide(F.lit(100.0) * F.col("lost_value"), F.col("value"))
    base = 100 - sum(points for kind, points in MISSING_PENALTY.items() if kind not in available)
    score = F.lit(base) - F.when(percent > 20, 5).when(percent > 5, 3).otherwise(0) - F.when(F.col("unresolved") > 0.2 * F.col("matters"), 3).otherwise(0) - undated - F.when((F.col("entries") > 0) & (F.col("with_activity") == 0), 2).otherwise(0)
    return row.select("orphans", js_round(percent, 4).alias("orphan_percent"), "unresolved", F.greatest(F.lit(0), score).cast("long").alias("score"))


# Datasets by how much their absence matters.
IMPACT = {
    "high": ("feeEarner", "wipJson", "fullMattersJson", "invoicesJson"),
    "medium": ("contactsJson", "closedMattersJson"),
    "low": ("disbursementsJson", "tasksJson"),
}
# Formulas that a gap affects.
AFFECTED = {
    "ORPHANED_WIP": "SN-001 SN-002 SN-003 SN-004", "MISSING_CLIENT_IDS": "SN-007 SN-008", "MISSING_DATE_PAID": "SN-009 SN-010", "MISSING_ACTIVITY_TYPE": "SN-011",
    "MISSING_FEE_EARNER_DATA": "SN-005 SN-006 SN-007", "MISSING_CLOSED_MATTERS": "SN-003 SN-004",
}


def facts(entries: DataFrame, matters: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row of counts that issues, gaps and advice follow from; each table is one row before they meet."""
    lost = ~F.col("matched")
    done = F.count("activity") if "activity" in entries.columns else F.lit(0)
    e = entries.agg(F.count("*").alias("entries"), F.count_if(lost).alias("orphans"), F.sum(F.when(lost, F.col("billable_value")).otherwise(0)).cast("double").alias("lost_value"), F.sum("billable_value").cast("double").alias("value"), done.alias("with_activity"))
    m = matters.agg(F.count("*").alias("matters"), F.count_if(F.col("display_name").isNull()).alias("unresolved"))
    i = invoices.agg(F.count("*").alias("invoices"), F.count("date_paid").alias("dated"))
    percent = F.coalesce(F.try_divide(F.lit(100.0) * F.col("lost_value"), F.col("value")), F.lit(0.0))
    return e.join(F.broadcast(m)).join(F.broadcast(i)).withColumn("orphan_percent", percent)


def _unfolded(row: DataFrame, *parts) -> DataFrame:
    return row.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*")


def entity_issues(row: DataFrame) -> DataFrame:
    """(dataset, issue, severity, affected, total, percent): entries without a matter, matters without a client."""
    def issue(when, dataset, what, severity, affected, total):
        share = js_round(F.lit(100.0) * F.col(affected) / F.nullif(F.col(total), F.lit(0))).cast("long")
        return F.when(when, F.struct(F.lit(dataset).alias("dataset"), F.lit(what).alias("issue"), severity.alias("severity"), F.col(affected).alias("affected"), F.col(total).alias("total"), share.alias("percent")))

    severe = F.when(F.col("orphan_percent") > 20, "error").otherwise("warning")
    unlinked = F.when(F.col("unresolved") > 0.2 * F.col("matters"), "warning").otherwise("info")
    return _unfolded(row, issue(F.col("orphans") > 0, "wipJson", "orphaned_records", severe, "orphans", "entries"), issue(F.col("unresolved") > 0, "fullMattersJson", "unresolved_references", unlinked, "unresolved", "matters"))


def _lacking(available: set[str]) -> tuple:
    undated = F.lit("invoicesJson" in available) & (F.col("invoices") > 0) & (F.col("dated") == 0)
    idle = F.lit("wipJson" in available) & (F.col("entries") > 0) & (F.col("with_activity") == 0)
    return undated, idle


def gaps(row: DataFrame, available: set[str]) -> DataFrame:
    """(gap, severity, formulas): what the data is known to lack, and the formulas that suffer."""
    undated, idle = _lacking(available)

    def gap(when, name, severity):
        return F.when(when, F.struct(F.lit(name).alias("gap"), severity.alias("severity"), F.lit(AFFECTED[name]).alias("formulas")))

    warning = F.lit("warning")
    return _unfolded(
        row,
        gap(F.col("orphan_percent") > 5, "ORPHANED_WIP", F.when(js_round(F.col("orphan_percent")) > 20, "error").otherwise("warning")), gap(F.col("unresolved") > 0, "MISSING_CLIENT_IDS", warning),
        gap(undated, "MISSING_DATE_PAID", warning), gap(idle, "MISSING_ACTIVITY_TYPE", F.lit("info")),
        gap(F.lit("feeEarner" not in available), "MISSING_FEE_EARNER_DATA", F.lit("error")), gap(F.lit("closedMattersJson" not in available), "MISSING_CLOSED_MATTERS", warning),
    )


def advice(row: DataFrame, available: set[str]) -> DataFrame:
    """(priority, position, subject): what to upload or add next, most urgent first."""
    undated, _ = _lacking(available)
    absent = lambda kind: F.lit(kind not in available)
    steps = (
        (1, absent("feeEarner"), "feeEarner"), (1, absent("wipJson"), "wipJson"), (1, absent("fullMattersJson"), "fullMattersJson"), (2, absent("invoicesJson"), "invoicesJson"), (2, undated, "date paid of invoices"),
        (2, F.col("unresolved") > 0, "client ids of matters"), (3, absent("closedMattersJson"), "closedMattersJson"), (3, absent("contactsJson"), "contactsJson"),
    )
    told = _unfolded(row, *[F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(i).alias("position"), F.lit(subject).alias("subject"))) for i, (priority, when, subject) in enumerate(steps)])
    return told.orderBy("priority", "position")


def coverage(spark, available: set[str]) -> DataFrame:
    """(dataset, impact, present) of every kind."""
    return spark.createDataFrame([(kind, impact, kind in available) for impact, kinds in IMPACT.items() for kind in kinds], "dataset string, impact string, present boolean")


def affected_formulas(changed: DataFrame) -> DataFrame:
    """(formula): formulas that read an entity or a setting of ``changed`` (name), by their requirements."""
    needs = [(f, name) for f, parts in REQUIREMENTS.items() for names in parts for name in names.split()]
    known = changed.sparkSession.createDataFrame(needs, "formula string, name string")
    return F.broadcast(known).join(changed.select("name").distinct(), "name").select("formula").distinct()


# What each formula needs, as (entities, optional entities, settings without which it is partial, settings without which it is blocked).
REQUIREMENTS = {
    "SN-001": ("feeEarner", "", "feeEarner.salaryData", ""),
    "SN-002": ("feeEarner", "", "weeklyTargetHours workingDaysPerWeek annualLeaveEntitlement bankHolidaysPerYear", ""),
    "SN-003": ("feeEarner", "", "defaultFirmRetainPercent", ""),
    "SN-004": ("feeEarner", "", "feeEarner.salaryData", ""),
    "SN-005": ("feeEarner", "", "defaultFeeSharePercent", "costRateMethod"),
    "F-TU-01": ("feeEarner timeEntry", "", "weeklyTargetHours workingDaysPerWeek annualLeaveEntitlement bankHolidaysPerYear feeEarner.perEarnerTargets", ""),
    "F-TU-02": ("feeEarner timeEntry", "", "workingDaysPerWeek bankHolidaysPerYear", ""),
    "F-TU-03": ("feeEarner timeEntry", "", "", ""),
    "F-RB-01": ("feeEarner timeEntry invoice", "matter", "utilisationApproach", ""),
    "F-RB-02": ("feeEarner timeEntry", "matter", "", ""),
    "F-RB-03": ("feeEarner invoice", "matter", "revenueAttribution", ""),
    "F-RB-04": ("matter timeEntry invoice", "", "", ""),
    "F-WL-01": ("matter timeEntry", "invoice", "", ""),
    "F-WL-02": ("feeEarner timeEntry", "matter invoice", "", ""),
    "F-WL-03": ("matter disbursement invoice", "", "", ""),
    "F-WL-04": ("matter timeEntry invoice", "", "", ""),
    "F-PR-01": ("matter feeEarner timeEntry", "invoice disbursement", "defaultFirmRetainPercent feeEarner.salaryData", "costRateMethod"),
    "F-PR-02": ("feeEarner invoice", "matter", "defaultFirmRetainPercent feeEarner.salaryData", "costRateMethod"),
    "F-PR-03": ("department feeEarner matter invoice", "", "", ""),
    "F-PR-04": ("client matter feeEarner invoice", "", "", ""),
    "F-PR-05": ("feeEarner department matter invoice", "", "", ""),
    "F-BS-01": ("matter timeEntry", "invoice", "", ""),
    "F-BS-02": ("matter timeEntry invoice", "", "", ""),
    "F-DM-01": ("invoice", "matter", "", ""),
    "F-DM-02": ("client invoice", "", "invoice.datePaid", ""),
    "F-CS-01": ("feeEarner timeEntry matter invoice", "", "weeklyTargetHours utilisationApproach", ""),
    "F-CS-02": ("feeEarner timeEntry matter invoice", "", "scorecardWeights", ""),
    "F-CS-03": ("matter timeEntry invoice disbursement", "", "scorecardWeights", ""),
}


def readiness_states(available: DataFrame, settings: tuple[str, ...]) -> DataFrame:
    """(formula, state) of every formula, from ``available`` (entity, rows) and the settings made.

    Blocked without a needed entity or setting, partial without an optional one, enhanced with
    all optional entities, else ready.
    """
    spark = available.sparkSession
    needs = [(f, kind, name) for f, parts in REQUIREMENTS.items() for kind, names in zip(("entity", "option", "setting", "must"), parts) for name in names.split()]
    made = spark.createDataFrame([(s,) for s in settings], "name string").withColumn("there", F.lit(True))
    there = available.where("rows > 0").select(F.col("entity").alias("name"), F.lit(True).alias("there")).unionByName(made)
    rows = spark.createDataFrame(needs, "formula string, kind string, name string").join(F.broadcast(there), "name", "left")
    missing = F.col("there").isNull()
    state = F.when(F.bool_or(missing & F.col("kind").isin("entity", "must")), "BLOCKED").when(F.bool_or(missing), "PARTIAL").when(F.bool_or(F.col("kind") == "option"), "ENHANCED").otherwise("READY")
    return rows.groupBy("formula").agg(state.alias("state"))


def refresh_derived(found: DataFrame, known: DataFrame) -> DataFrame:
    """(value, state): distinct values now found against those known: new, kept or flagged (gone)."""
    now, was = found.where("value is not null").distinct().withColumn("now", F.lit(True)), known.withColumn("was", F.lit(True))
    state = F.when(F.col("now").isNull(), "flagged").when(F.col("was").isNull(), "new").otherwise("kept")
    return now.join(was, "value", "full_outer").select("value", state.alias("state"))


def effective_overrides(overrides: DataFrame, day: str) -> DataFrame:
    """(id, overrides): map of the fields overridden on ``day``; of two the later start counts."""
    live = overrides.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    one = live.groupBy("id", "field").agg(F.max_by("value", "valid_from").alias("value"))
    return one.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("overrides"))


def upload_status(uploads: DataFrame, kinds: list[str]) -> DataFrame:
    """One row a dataset kind: its latest processed upload, else its latest; kinds without one read as missing."""
    rank = F.when(F.col("status") == "processed", 0).when(F.col("status").isin("processing", "pending"), 1).otherwise(2)
    best = uploads.withColumn("rn_", F.row_number().over(W.partitionBy("kind").orderBy(rank, F.desc("uploaded")))).where("rn_ = 1")
    every = uploads.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(best, "kind", "left").select("kind", F.coalesce("status", F.lit("missing")).alias("status"), "uploaded", F.coalesce("rows", F.lit(0)).alias("rows"))
