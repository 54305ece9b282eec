"""The KPI snapshot table: flattening, idempotent writes, history, and scans with pushed filters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display

# Result type of each KPI, for its display text.
RESULT_TYPES = {
    "F-TU-01": "percentage", "F-TU-02": "percentage", "F-TU-03": "percentage", "F-RB-01": "percentage", "F-RB-02": "currency", "F-RB-03": "currency", "F-RB-04": "days",
    "F-WL-01": "days", "F-WL-02": "percentage", "F-WL-03": "percentage", "F-WL-04": "days", "F-PR-01": "currency", "F-PR-02": "currency", "F-PR-03": "currency", "F-PR-04": "currency", "F-PR-05": "currency",
    "F-BS-01": "percentage", "F-BS-02": "number", "F-DM-01": "currency", "F-DM-02": "number", "F-CS-01": "currency", "F-CS-02": "number", "F-CS-03": "number",
}


#: Row groups of a snapshot are small, so that a look-up reads little, and hold about so many ids.
ROW_GROUP_BYTES = 16 << 20
ROW_GROUP_IDS = 500_000


def flatten(kpis: DataFrame, firm_id: str, pulled_at: str, period: str = "current") -> DataFrame:
    """Evaluated KPI rows as snapshot rows with their display text; a KPI without thresholds has no status."""
    shown: Column = display(F.col("value"), "number")
    for kind in sorted(set(RESULT_TYPES.values()) - {"number"}):
        shown = F.when(F.col("kpi_key").isin(*[k for k, v in RESULT_TYPES.items() if v == kind]), display(F.col("value"), kind)).otherwise(shown)
    named = F.col("entity_name") if "entity_name" in kpis.columns else F.col("entity_id")
    status = F.when(F.col("higher").isNotNull(), F.col("status")) if "higher" in kpis.columns else F.col("status")
    return kpis.select(
        F.lit(firm_id).alias("firm_id"), F.to_timestamp(F.lit(pulled_at)).alias("pulled_at"), "entity_type", "entity_id", named.alias("entity_name"), "kpi_key", F.col("value").alias("kpi_value"),
        status.alias("rag_status"), F.lit(period).alias("period"), shown.alias("display_value"),
    )


def replace(rows: DataFrame, path: str) -> int:
    """Replace all rows of the firms that ``rows`` holds, others untouched; returns how many were written.

    Dynamic partition overwrite commits all new files before old partitions go, so a failed
    write leaves the old rows; running it again gives the same table. Rows are counted while
    they are written, and lie by entity type, so that scans skip what they do not ask for; a
    Bloom filter of the entity ids lets a look-up skip row groups of its own type too.
    """
    written = Observation()
    order = [c for c in ("firm_id", "entity_type", "kpi_key", "entity_id") if c in rows.columns]
    counted = rows.observe(written, F.count(F.lit(1)).alias("n")).sortWithinPartitions(*order)
    out = counted.write.option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP_BYTES)
    if "entity_id" in rows.columns:
        out = out.option("parquet.bloom.filter.enabled#entity_id", "true").option("parquet.bloom.filter.expected.ndv#entity_id", ROW_GROUP_IDS)
    out.mode("overwrite").partitionBy("firm_id").parquet(path)
    return written.get["n"]


def scan(spark: SparkSession, path: str, firm_id: str, entity_type: str | None = None, period: str | None = None, kpi_keys: list[str] | None = None, entity_ids: list[str] | None = None) -> DataFrame:
    """Snapshot rows of one firm; the firm prunes partitions, the rest is pushed to the files, which lie by entity type."""
    df = spark.read.parquet(path).where(F.col("firm_id") == firm_id)
    for column, value in (("entity_type", entity_type), ("period", period)):
        df = df.where(F.col(column) == value) if value is not None else df
    for column, values in (("kpi_key", kpi_keys), ("entity_id", entity_ids)):
        df = df.where(F.col(column).isin(*values)) if values else df
    return df


def entity_kpis(spark: SparkSession, path: str, firm_id: str, entity_type: str, entity_id: str) -> DataFrame:
    """All KPIs of one entity, with status and display text."""
    return scan(spark, path, firm_id, entity_type=entity_type, entity_ids=[entity_id]).select("kpi_key", "kpi_value", "rag_status", "display_value", "pulled_at")


def formula_kpis(spark: SparkSession, path: str, firm_id: str, kpi_key: str) -> DataFrame:
    """One KPI of all entities; no rows if it was not calculated."""
    return scan(spark, path, firm_id, kpi_keys=[kpi_key]).select("entity_type", "entity_id", "kpi_value", "rag_status", "display_value", "pulled_at")


def rag_summary(rows: DataFrame) -> DataFrame:
    """(kpi_key, green, amber, red, neutral): entities by status, and all KPIs together as ``all``."""
    counts = [F.count_if(F.col("rag_status") == s).alias(s) for s in ("green", "amber", "red", "neutral")]
    return rows.groupingSets([["kpi_key"], []], "kpi_key").agg(F.grouping("kpi_key").alias("g"), *counts).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("kpi_key")).alias("kpi_key"), "green", "amber", "red", "neutral")


def scan_report(df: DataFrame) -> dict[str, int]:
    """Runs a read and tells what its file scans took: files, bytes of them, and rows that left the files."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().executeCollect()
    names, out = {"numFiles": "files", "filesSize": "bytes", "numOutputRows": "rows"}, {"files": 0, "bytes": 0, "rows": 0}
    leaves = plan.finalPhysicalPlan().collectLeaves() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.collectLeaves()
    for i in range(leaves.size()):
        for key, name in names.items():
            metric = leaves.apply(i).metrics().get(key)
            out[name] += metric.get().value() if metric.isDefined() else 0
    return out


def ordered_page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of a scan by entity type, name and KPI; of equal names by id."""
    return rows.orderBy("entity_type", "entity_name", "kpi_key", "entity_id").offset(offset).limit(limit)


def numbered_page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(place, entity_type, entity_name, kpi_key) of one page, each row with its place in the whole order."""
    from pyspark.sql import Window as W

    page = ordered_page(rows, limit, offset)  # at most a page's rows are numbered
    order = W.orderBy("entity_type", "entity_name", "kpi_key", "entity_id")
    return page.select((F.row_number().over(order) + offset).cast("long").alias("place"), "entity_type", "entity_name", "kpi_key")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replace_set(rows: DataFrame, path: str, firm_id: str, kind: str, version: int) -> None:
    """One version of a firm's set of a kind (normalised, enriched or KPI rows): written again, it replaces itself."""
    out = rows.withColumns({"firm_id": F.lit(firm_id), "kind": F.lit(kind), "version": F.lit(version).cast("long")})
    out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("firm_id", "kind", "version").parquet(path)


def latest_set(spark: SparkSession, path: str, firm_id: str, kind: str) -> DataFrame:
    """Rows of the newest version of a set; partition folders alone tell the version, other versions are not read."""
    own = spark.read.parquet(path).where((F.col("firm_id") == firm_id) & (F.col("kind") == kind))
    newest = own.agg(F.max("version")).first()[0]
    return own.where(F.col("version") == newest)


def delete_set(spark: SparkSession, path: str, firm_id: str, kind: str) -> None:
    """All versions of a set go; other sets stay as they are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/firm_id={firm_id}/kind={kind}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upserted(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with rows of the same keys replaced and new ones added."""
    return existing.join(rows.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows)


def append_daily(rows: DataFrame, path: str, day: str, existing: DataFrame | None = None) -> DataFrame:
    """Append history rows of firms that have none for ``day`` yet; returns what was appended."""
    new = rows.withColumn("snapshot_date", F.to_date(F.lit(day)))
    if existing is not None:
        new = new.join(existing.select("firm_id", "snapshot_date").distinct(), ["firm_id", "snapshot_date"], "left_anti")
    new.write.mode("append").partitionBy("snapshot_date").parquet(path)
    return new


def history(spark: SparkSession, path: str, first: str, last: str, period: str | None = None) -> DataFrame:
    """History rows between two days, both included, newest first; whole partitions are pruned."""
    df = spark.read.parquet(path).where(F.col("snapshot_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return (df if period is None else df.where(F.col("period") == period)).orderBy(F.desc("snapshot_date"))


def keep_best(sets: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One stored set of each key: the first by ``order``."""
    from pyspark.sql import Window as W

    return sets.withColumn("rn_", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("rn_ = 1").drop("rn_")


def latest_pull(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("firm_id").agg(F.max("pulled_at").alias("pulled_at"))


def flags_page(flags: DataFrame, severity: str | None = None, entity_type: str | None = None, flag: str | None = None, limit: int = 50) -> DataFrame:
    """The ``limit`` most recent flags (by flagged_at, then id) that the filters leave, high severities first."""
    for column, value in (("severity", severity), ("entity_type", entity_type), ("flag", flag)):
        flags = flags if value is None else flags.where(F.col(column) == value)
    return recent_flags(flags, limit, [F.desc("flagged_at"), F.asc("entity_id"), F.asc("flag")])


def flag_counts(page: DataFrame) -> DataFrame:
    """One row of what a page of flags holds: all, by severity, and when the newest was flagged."""
    return page.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")], F.max("flagged_at").alias("flagged_at"))


def recent_flags(flags: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The ``limit`` most recent flags, then by severity and recency."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return flags.orderBy(*order).limit(limit).withColumn("severity_rank", rank).orderBy("severity_rank", *order)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[Column] | None = None) -> None:
    """The visible columns in their order as CSV with a header; part files stay as many as the sort made."""
    out = df.select(*columns) if columns else df
    (out.orderBy(*order) if order else out).write.mode("overwrite").option("header", True).csv(path)


def merged_config(defaults: dict, stored: dict) -> dict:
    """Stored settings over defaults: plain objects merge, anything else replaces."""
    out = dict(defaults)
    for key, value in stored.items():
        out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def export_config(config: dict) -> str:
    return json.dumps({"version": 1, "config": config}, sort_keys=True)


def import_config(text: str, defaults: dict) -> dict:
    found = json.loads(text)
    if found.get("version") != 1 or not isinstance(found.get("config"), dict):
        raise ValueError("not an exported configuration")
    return merged_config(defaults, found["config"])
