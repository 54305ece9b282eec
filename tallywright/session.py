"""Session factory and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


def get_session(app: str = "tallywright", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided Parquet tables, read lazily through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares for checkpoints.

    Only a local master may leave it unset, as tests do; it then is a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; call it when nothing reads them any more."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{spark.sparkContext.applicationId}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
