"""Uploads as stored sets: committed only if enough rows stand, mapped by stored mappings, reprocessed.

Below a root folder every firm and kind has its raw rows as they came, its mappings in
versions, and the sets derived from them in versions; a small table marks firms whose KPIs
are older than their data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import normalise
from . import snapshots

#: Share of rejected rows above which nothing is committed.
MOST_REJECTED = 0.5


class TooManyRejected(ValueError):
    """More rows were rejected than may be; what was stored before still stands."""


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a set, in order."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def commit_judged(judged: DataFrame, path: str, most: float = MOST_REJECTED) -> int:
    """Stores rows of ``normalise.judged``, kept and rejected apart, as the next version of a set.

    Both sides are written in one pass to a folder that no reader looks into, and counted while
    they are. If more than ``most`` of all rows were rejected the folder goes and
    ``TooManyRejected`` is raised; else it becomes the next version by being renamed. A job that
    fails leaves the older versions as they are.
    """
    spark = judged.sparkSession
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    seen = Observation()
    rows = judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("reject").alias("rejected"))
    rows.withColumn("outcome", F.when(F.col("reject").isNull(), "kept").otherwise("rejected")).write.partitionBy("outcome").parquet(staging)
    total, gone = seen.get["rows"], seen.get["rejected"]
    files, where = _folder(spark, staging)
    if total and gone / total > most:
        files.delete(where, True)
        raise TooManyRejected(f"{gone} of {total} rows rejected")
    version = max(versions(spark, path), default=0) + 1
    # partitions without rows leave no file to tell the columns
    spark.createDataFrame([(judged.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_schemas/{version}")
    if not files.rename(where, _folder(spark, f"{path}/version={version}")[1]):
        raise OSError(f"version {version} of {path} could not be committed")
    return version


def committed(spark: SparkSession, path: str, outcome: str = "kept", version: int | None = None) -> DataFrame:
    """The kept, or the rejected, rows of the newest version of a set, or of a given one."""
    version = version or max(versions(spark, path))
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schemas/{version}").first()[0]))
    df = spark.read.schema(schema.add("outcome", "string")).parquet(f"{path}/version={version}")
    df = df.where(F.col("outcome") == outcome).drop("outcome")
    return df.drop("reject") if outcome == "kept" else df


def store_mapping(spark: SparkSession, root: str, firm_id: str, kind: str, mapping: dict[str, str | None]) -> int:
    """A new version of the mapping of a kind's columns: a row a column, its field or null."""
    path = f"{root}/mappings/firm_id={firm_id}/kind={kind}"
    version = max(versions(spark, path), default=0) + 1
    rows = [(i, column, field) for i, (column, field) in enumerate(mapping.items())]
    spark.createDataFrame(rows, "position int, source_column string, field string").coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def stored_mapping(spark: SparkSession, root: str, firm_id: str, kind: str) -> dict[str, str]:
    """The columns that the newest mapping maps; a row a column comes to the driver."""
    path = f"{root}/mappings/firm_id={firm_id}/kind={kind}"
    newest = spark.read.parquet(f"{path}/version={max(versions(spark, path))}")
    return {r["source_column"]: r["field"] for r in newest.where("field is not null").orderBy("position").collect()}


def mark(spark: SparkSession, root: str, firm_id: str, stale: bool, since: str) -> None:
    """Marks a firm's KPIs as older than its data, or as up to date."""
    row = spark.createDataFrame([(firm_id, stale, since)], "firm_id string, is_stale boolean, stale_since string")
    snapshots.replace(row, f"{root}/state")


def is_stale(spark: SparkSession, root: str, firm_id: str) -> bool:
    """Whether the firm's KPIs are to be calculated anew; not so for a firm without a mark."""
    files, where = _folder(spark, f"{root}/state")
    if not files.exists(where):
        return False
    row = spark.read.parquet(f"{root}/state").where(F.col("firm_id") == firm_id).first()
    return bool(row and row["is_stale"])


def calculation_status(is_calculating: bool, stale: bool, error: str | None) -> str:
    """``calculating``, ``error`` (stale after a failure), ``stale`` or ``current``."""
    if is_calculating:
        return "calculating"
    if stale:
        return "error" if error else "stale"
    return "current"


def store_raw(rows: DataFrame, root: str, firm_id: str, kind: str) -> None:
    """The rows of an upload as they came, in place of those before."""
    rows.write.mode("overwrite").parquet(f"{root}/raw/firm_id={firm_id}/kind={kind}")


def reprocess(spark: SparkSession, root: str, firm_id: str, kind: str, fields: list[normalise.Field], now: str, strict: bool = False) -> int:
    """Derives a kind's set anew from its stored raw rows by its newest mapping; returns the version.

    The firm's KPIs are stale from then on. Raises, and changes nothing, where too many rows are
    rejected.
    """
    raw = spark.read.parquet(f"{root}/raw/firm_id={firm_id}/kind={kind}")
    mapping = {column: field for column, field in stored_mapping(spark, root, firm_id, kind).items() if column in raw.columns}
    rows = normalise.judged(normalise.coerce(normalise.remap(raw, mapping), fields), fields, strict)
    version = commit_judged(rows, f"{root}/derived/firm_id={firm_id}/kind={kind}")
    mark(spark, root, firm_id, True, now)
    return version


def derived(spark: SparkSession, root: str, firm_id: str, kind: str, outcome: str = "kept", version: int | None = None) -> DataFrame:
    """The newest derived set of a kind, or a given version of it."""
    return committed(spark, f"{root}/derived/firm_id={firm_id}/kind={kind}", outcome, version)


def delete_upload(spark: SparkSession, root: str, firm_id: str, kind: str, now: str) -> None:
    """The raw and derived rows of a kind go, and the firm's KPIs are stale."""
    for part in ("raw", "derived"):
        files, where = _folder(spark, f"{root}/{part}/firm_id={firm_id}/kind={kind}")
        files.delete(where, True)
    mark(spark, root, firm_id, True, now)
