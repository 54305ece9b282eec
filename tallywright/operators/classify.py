"""Traffic-light status, distance to the next band, and risk flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import js_round

# Status bands by KPI as (higher is better, green bound, amber bound), in the KPI's own unit.
THRESHOLDS = {
    "F-TU-01": (True, 75.0, 60.0), "F-TU-02": (False, 2.0, 5.0), "F-TU-03": (False, 25.0, 40.0), "F-RB-01": (True, 85.0, 70.0), "F-RB-02": (True, 200.0, 150.0), "F-RB-03": (True, 3.0, 2.0), "F-WL-01": (False, 30.0, 60.0),
    "F-WL-02": (False, 5.0, 10.0), "F-WL-03": (True, 90.0, 75.0), "F-WL-04": (False, 60.0, 90.0), "F-DM-01": (False, 30.0, 60.0), "F-BS-01": (False, 80.0, 95.0), "F-PR-01": (True, 40.0, 25.0),
}
# Bands of their own for grades and pay models, as (kind, key, kpi, green bound, amber bound).
OVERRIDES = (("grade", "partner", "F-TU-01", 70.0, 55.0), ("pay", "feeShare", "F-TU-01", 80.0, 65.0), ("grade", "paralegal", "F-TU-01", 65.0, 50.0))
# Risk flags as (flag, kpi, entity type, high above or None, medium above or None).
RISKS = (
    ("WIP_AGE_HIGH", "F-WL-01", "matter", 30.0, 14.0), ("WIP_AGE_HIGH", "F-WL-04", "firm", 30.0, 14.0), ("BUDGET_BURN_CRITICAL", "F-BS-01", "matter", 85.0, 70.0), ("DEBTOR_DAYS_HIGH", "F-DM-01", "invoice", 60.0, None),
    ("DEBTOR_DAYS_HIGH", "F-DM-01", "client", 60.0, None), ("DORMANT_MATTER", "F-WL-01", "matter", None, 14.0), ("BAD_DEBT_RISK", "F-DM-01", "invoice", 120.0, 90.0), ("WRITE_OFF_SPIKE", "F-WL-02", "feeEarner", 10.0, 5.0),
    ("WRITE_OFF_SPIKE", "F-WL-02", "firm", 10.0, 5.0),
)


def threshold_table(spark, thresholds: dict[str, tuple[bool, float, float]] | None = None) -> DataFrame:
    rows = [(k, *v) for k, v in (THRESHOLDS if thresholds is None else thresholds).items()]
    return spark.createDataFrame(rows, "kpi_key string, higher boolean, green double, amber double")


def status(value: Column, higher: Column, green: Column, amber: Column) -> Column:
    """Inclusive bounds, best band first; a missing value or threshold, and a value below zero, is neutral."""
    good = F.when(higher, value >= green).otherwise(value <= green)
    fair = F.when(higher, value >= amber).otherwise(value <= amber)
    return F.when(value.isNull() | green.isNull() | (value < 0), "neutral").when(good, "green").when(fair, "amber").otherwise("red")


def evaluate(kpis: DataFrame, thresholds: DataFrame, keep_direction: bool = False) -> DataFrame:
    """KPI rows with status and the distance to the next better band; the threshold table is small by nature.

    ``keep_direction`` keeps ``higher``, which is null for KPIs without thresholds.
    """
    v, up = F.col("value"), F.col("higher")
    out = kpis.join(F.broadcast(thresholds), "kpi_key", "left").withColumn("status", status(v, up, F.col("green"), F.col("amber")))
    bound = F.when(F.col("status") == "red", F.col("amber")).when(F.col("status") == "amber", F.col("green"))
    out = out.withColumn("to_next", js_round(F.abs(bound - v), 4))
    return out.drop("green", "amber") if keep_direction else out.drop("higher", "green", "amber")


def override(thresholds: DataFrame, overrides: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, kpi_key, higher, green, amber): grade before pay model before the default, keys in any case."""
    def keyed(kind: str, column: str) -> DataFrame:
        own = overrides.where(F.col("kind") == kind).select("kpi_key", F.lower("key").alias("k"), F.col("green").alias(f"g_{kind}"), F.col("amber").alias(f"a_{kind}"))
        return own.withColumnRenamed("k", f"k_{column}")

    base = entities.crossJoin(F.broadcast(thresholds))
    base = base.withColumn("k_grade", F.lower("grade")).withColumn("k_pay_model", F.lower("pay_model"))
    out = base.join(F.broadcast(keyed("grade", "grade")), ["kpi_key", "k_grade"], "left").join(F.broadcast(keyed("pay", "pay_model")), ["kpi_key", "k_pay_model"], "left")
    return out.select("entity_id", "kpi_key", "higher", F.coalesce("g_grade", "g_pay", "green").alias("green"), F.coalesce("a_grade", "a_pay", "amber").alias("amber"))


def override_table(spark) -> DataFrame:
    return spark.createDataFrame(list(OVERRIDES), "kind string, key string, kpi_key string, green double, amber double")


def half_open(value: Column, red: tuple, amber: tuple) -> Column:
    """The dashboards' own rule: red first, bounds [low, high)."""
    inside = lambda b: (value >= b[0]) & (value < b[1])
    return F.when(value.isNull(), "neutral").when(inside(red), "red").when(inside(amber), "amber").otherwise("green")


def alerts(evaluated: DataFrame) -> DataFrame:
    """(status, rows) of what is red or amber, by KPI."""
    return evaluated.where(F.col("status").isin("red", "amber")).groupBy("kpi_key", "status").agg(F.count("*").alias("n"), F.max("value").alias("highest"), F.min("value").alias("lowest"))


def risk_flags(kpis: DataFrame, previous: DataFrame | None = None, drop: tuple[float, float] = (30.0, 20.0)) -> DataFrame:
    """(flag, severity, entity_type, entity_id, value): rules joined to KPI rows; strictly above the bounds.

    With ``previous`` KPI rows, utilisation that fell by more than ``drop`` percent is flagged too.
    """
    rules = kpis.sparkSession.createDataFrame(list(RISKS), "flag string, kpi_key string, entity_type string, high double, medium double")
    hit = kpis.join(F.broadcast(rules), ["kpi_key", "entity_type"]).where(F.col("value") > F.coalesce("medium", "high"))
    out = hit.select("flag", F.when(F.coalesce(F.col("value") > F.col("high"), F.lit(False)), "high").otherwise("medium").alias("severity"), "entity_type", "entity_id", "value")
    if previous is None:
        return out
    now = kpis.where("kpi_key = 'F-TU-01'").select("entity_type", "entity_id", "value")
    was = previous.where("kpi_key = 'F-TU-01' and value > 0").select("entity_id", F.col("value").alias("was"))
    fell = (F.col("was") - F.col("value")) / F.col("was") * 100
    drops = now.join(was, "entity_id").where(fell > drop[1]).select(
        F.lit("UTILISATION_DROP").alias("flag"), F.when(fell > drop[0], "high").otherwise("medium").alias("severity"), "entity_type", "entity_id", js_round(fell, 4).alias("value"))
    return out.unionByName(drops)
