"""User-defined formulas as a stored registry: versions, templates, runs, and trials against what is live.

A firm's formulas are few; their trees come to the driver, are checked and compiled to columns
there, and what they compute stays in tables.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import js_round, safe_div
from ..operators import expressions as ex
from ..session import scratch_path

_SCHEMA = "formula_id string, version long, tree string, deleted boolean"
RESULTS = "kpi_key string, entity_id string, value double"


class InvalidFormula(ValueError):
    """A tree names what does not exist, or formulas read each other in a circle."""


def _rows(spark: SparkSession, root: str, firm_id: str) -> DataFrame:
    path = f"{root}/formulas/firm_id={firm_id}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path)


def versions(spark: SparkSession, root: str, firm_id: str) -> DataFrame:
    """(formula_id, version, tree, deleted, is_current) of all that was ever stored."""
    rows = _rows(spark, root, firm_id)
    newest = rows.groupBy("formula_id").agg(F.max("version").alias("newest"))
    return rows.join(newest, "formula_id").select("formula_id", "version", "tree", "deleted", (F.col("version") == F.col("newest")).alias("is_current"))


def current(spark: SparkSession, root: str, firm_id: str) -> dict[str, dict]:
    """The live trees by id; deleted formulas are none."""
    return {r["formula_id"]: json.loads(r["tree"]) for r in versions(spark, root, firm_id).where("is_current and not deleted").collect()}


def _append(spark: SparkSession, root: str, firm_id: str, formula_id: str, tree: dict | None) -> int:
    before = _rows(spark, root, firm_id).where(F.col("formula_id") == formula_id).agg(F.max("version")).first()[0] or 0
    row = spark.createDataFrame([(formula_id, before + 1, json.dumps(tree, sort_keys=True) if tree else None, tree is None)], _SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{root}/formulas/firm_id={firm_id}")
    return before + 1


def store(spark: SparkSession, root: str, firm_id: str, formula_id: str, tree: dict, columns: list[str], tables: dict[str, list[str]], built_in: set[str] = frozenset()) -> int:
    """Checks a tree and stores it as the formula's next version; built-in ids are refused."""
    if formula_id in built_in:
        raise InvalidFormula(f"{formula_id} is built in")
    others = current(spark, root, firm_id)
    wrong = ex.validate(tree, columns, tables, {*others, *built_in} - {formula_id})
    if wrong:
        raise InvalidFormula("; ".join(wrong))
    try:
        ex.evaluation_order({**others, formula_id: tree})
    except ValueError as circle:
        raise InvalidFormula(str(circle)) from circle
    return _append(spark, root, firm_id, formula_id, tree)


def delete(spark: SparkSession, root: str, firm_id: str, formula_id: str) -> int:
    """Marks a formula as gone; its versions stay. Formulas that others read are kept."""
    readers = [f for f, tree in current(spark, root, firm_id).items() if formula_id in ex.references(tree)]
    if readers:
        raise InvalidFormula(f"{formula_id} is read by {', '.join(sorted(readers))}")
    return _append(spark, root, firm_id, formula_id, None)


def instantiate(template: dict, parameters: dict[str, object], columns: list[str], tables: dict[str, list[str]], results: set[str] = frozenset()) -> dict:
    """A template with its parameters filled in, checked."""
    try:
        tree = ex.substitute(template, parameters)
    except KeyError as missing:
        raise InvalidFormula(f"no value for {missing}") from missing
    wrong = ex.validate(tree, columns, tables, set(results))
    if wrong:
        raise InvalidFormula("; ".join(wrong))
    return tree


def run(trees: dict[str, dict], entities: DataFrame, key: str, tables: dict[str, DataFrame] | None = None, results: DataFrame | None = None, config: dict | None = None) -> DataFrame:
    """(kpi_key, entity_id, value) of formulas that may read each other, each after those it reads.

    Every formula's rows are written before others read them, so that no plan grows with the
    depth of references.
    """
    spark = entities.sparkSession
    known = results.select("kpi_key", "entity_id", "value") if results is not None else spark.createDataFrame([], RESULTS)
    out = []
    for formula_id in ex.evaluation_order(trees):
        rows = ex.evaluate(trees[formula_id], entities, key, tables, known, config).select(F.lit(formula_id).alias("kpi_key"), "entity_id", "value")
        path = scratch_path(spark, "formula")
        rows.write.parquet(path)
        own = spark.read.schema(rows.schema).parquet(path)
        out.append(own)
        known = known.unionByName(own)
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RESULTS)


def changes(live: DataFrame, trial: DataFrame) -> DataFrame:
    """(entity_id, old_value, new_value, delta, percent_change) of every entity that either side has.

    An entity that only one side measures changes by its whole value.
    """
    both = live.select("entity_id", F.col("value").alias("old_value")).join(trial.select("entity_id", F.col("value").alias("new_value")), "entity_id", "full_outer")
    delta = F.coalesce(F.col("new_value") - F.col("old_value"), F.col("new_value"), -F.col("old_value"))
    percent = js_round(safe_div(F.col("new_value") - F.col("old_value"), F.abs("old_value")) * 100.0, 2)
    return both.select("entity_id", "old_value", "new_value", delta.alias("delta"), percent.alias("percent_change"))


def summary(changed: DataFrame) -> DataFrame:
    """One row: entities, how many improved, declined and stayed, and the mean change."""
    d = F.col("delta")
    exact = F.sum(js_round(d, 4).cast(T.DecimalType(28, 4)))
    return changed.agg(F.count("*").alias("entities"), F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("declined"), F.count_if(d.isNull() | (d == 0)).alias("unchanged"), js_round(safe_div(exact, F.count(d)), 4).alias("mean_change"))
