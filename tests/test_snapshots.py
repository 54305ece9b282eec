from pyspark.sql import functions as F

from tallywright.sources import snapshots


def test_replace_counts_the_rows_of_every_firm(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = spark.range(2100).select(F.format_string("f%04d", F.floor(F.col("id") / 2)).alias("firm_id"), F.lit("client").alias("entity_type"), F.col("id").alias("kpi_value"))
    other = spark.createDataFrame([("other", "client", 1)], "firm_id string, entity_type string, kpi_value long")
    assert snapshots.replace(other, path) == 1
    assert snapshots.replace(rows.repartition(1, "firm_id"), path) == 2100
    assert spark.read.parquet(path).count() == 2101
