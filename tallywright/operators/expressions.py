"""User-defined formulas: JSON expression trees compiled to Catalyst columns.

A tree never runs as code. References to other results become one pivoted join, uncorrelated
aggregates one row that is joined once, and the rest a single projection.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import js_round, safe_div

COMPARISONS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
#: Operators that give null if either side is null.
STRICT = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b,
    "divide": safe_div, "percentage": lambda a, b: safe_div(a, b) * 100.0,
}
#: Operators that skip a null side.
LENIENT = {"min": F.least, "max": F.greatest, "average": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))}
AGGREGATES = {"sumOf": F.sum, "averageOf": F.avg, "countOf": lambda c: F.count("*"), "minOf": F.min, "maxOf": F.max}
KINDS = ("field", "snippet", "formula", "constant", "config", "operator", "compare", "ifThen", "aggregation")


def walk(node: dict) -> Iterator[dict]:
    """The node and all below it."""
    yield node
    for key in ("left", "right", "condition", "then", "else"):
        if isinstance(node.get(key), dict):
            yield from walk(node[key])


def validate(tree: dict, columns: list[str], tables: dict[str, list[str]], results: set[str]) -> list[str]:
    """What is wrong with a tree, before anything runs; an empty list if nothing."""
    wrong = []
    for node in walk(tree):
        kind = node.get("type")
        if kind not in KINDS:
            wrong.append(f"unknown node {kind}")
        elif kind == "field" and node["field"] not in columns:
            wrong.append(f"unknown field {node['field']}")
        elif kind in ("formula", "snippet") and node["id"] not in results:
            wrong.append(f"unknown {kind} {node['id']}")
        elif kind == "operator" and node["operator"] not in {*STRICT, *LENIENT}:
            wrong.append(f"unknown operator {node['operator']}")
        elif kind == "compare" and node["operator"] not in COMPARISONS:
            wrong.append(f"unknown comparison {node['operator']}")
        elif kind == "aggregation" and (node["operator"] not in AGGREGATES or node["entity"] not in tables or node.get("field") not in {None, *tables.get(node["entity"], ())}):
            wrong.append(f"unknown aggregation {node['operator']} over {node['entity']}")
    return wrong


def references(tree: dict) -> set[str]:
    """Ids of the formulas and snippets that a tree reads."""
    return {n["id"] for n in walk(tree) if n["type"] in ("formula", "snippet")}


def evaluation_order(trees: dict[str, dict]) -> list[str]:
    """Formula ids, each after those it reads, alphabetically where free; raises on a cycle."""
    from graphlib import TopologicalSorter

    sorter, out = TopologicalSorter({k: references(t) & trees.keys() for k, t in trees.items()}), []
    sorter.prepare()
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def matches(filters: list[dict]) -> Column:
    """All of (field, operator, value) hold, in two-valued logic: null equals only null."""
    out = F.lit(True)
    for f in filters:
        c, op, v = F.col(f["field"]), f["operator"], f.get("value")
        rule = {
            "equals": lambda: c.eqNullSafe(F.lit(v)), "notEquals": lambda: ~c.eqNullSafe(F.lit(v)), "greaterThan": lambda: F.coalesce(c > v, F.lit(False)), "lessThan": lambda: F.coalesce(c < v, F.lit(False)),
            "in": lambda: F.coalesce(c.isin(*v), F.lit(False)), "notIn": lambda: ~F.coalesce(c.isin(*v), F.lit(False)), "isNull": c.isNull, "isNotNull": c.isNotNull,
        }[op]()
        out = out & rule
    return out


def _reference(node: dict) -> tuple[str, str | None, str]:
    """(id, key of an additional value, entity): ``self`` is the entity that the formula is evaluated for."""
    return node["id"], node.get("valueKey") if node["type"] == "formula" else None, node.get("entityBinding", "self")


def _name(node: dict) -> str:
    if node["type"] in ("formula", "snippet"):
        return "ref_" + hashlib.sha256(json.dumps(_reference(node)).encode()).hexdigest()[:16]
    return "agg_" + hashlib.sha256(json.dumps(node, sort_keys=True).encode()).hexdigest()[:16]


def compile_node(node: dict, config: dict) -> Column:
    """The column of a node; results and aggregates are already columns of the row."""
    kind = node["type"]
    if kind == "field":
        return F.col(node["field"]).try_cast("double")
    if kind in ("formula", "snippet"):
        return F.col(_name(node))
    if kind == "constant":
        return F.lit(float(node["value"])) if not isinstance(node["value"], str) else F.lit(node["value"]).try_cast("double")
    if kind == "config":
        value = config
        for part in node["path"].split("."):
            value = value.get(part) if isinstance(value, dict) else None
        return F.lit(value).try_cast("double")
    if kind == "aggregation":
        return F.col(_name(node))
    if kind == "ifThen":
        test = compile_node(node["condition"], config)
        other = compile_node(node["else"], config) if node.get("else") else F.lit(None).cast("double")
        return F.when(test.isNull(), F.lit(None)).when(test != 0, compile_node(node["then"], config)).otherwise(other)
    a, b = compile_node(node["left"], config), compile_node(node["right"], config)
    if kind == "compare":
        number = COMPARISONS[node["operator"]](a, b)
        if node["operator"] != "=":
            return number.cast("double")
        texts = [F.col(n["field"]).cast("string") if n["type"] == "field" else F.lit(str(n["value"])) if n["type"] == "constant" else F.lit(None).cast("string") for n in (node["left"], node["right"])]
        # texts that are no numbers are compared as they stand; a number never equals a text
        return F.when(a.isNotNull() & b.isNotNull(), number).when(a.isNull() & b.isNull(), texts[0] == texts[1]).when(a.isNotNull(), F.when(texts[1].isNotNull(), F.lit(False))).otherwise(
            F.when(texts[0].isNotNull(), F.lit(False))).cast("double")
    return {**STRICT, **LENIENT}[node["operator"]](a, b)


def post_process(value: Column, steps: dict) -> Column:
    """abs, then multiply, then clamp, then round."""
    if steps.get("abs"):
        value = F.abs(value)
    if "multiply" in steps:
        value = value * float(steps["multiply"])
    low, high = steps.get("clamp", (None, None))
    if low is not None:
        value = F.when(value < low, float(low)).otherwise(value)
    if high is not None:
        value = F.when(value > high, float(high)).otherwise(value)
    return js_round(value, steps["round"]) if "round" in steps else value


def _referenced(df: DataFrame, tree: dict, key: str, results: DataFrame) -> DataFrame:
    """``df`` with a column for every reference: one join for those to the entity itself, one row for all others."""
    nodes = {_name(n): _reference(n) for n in walk(tree) if n["type"] in ("formula", "snippet")}

    def value(reference: tuple[str, str | None, str]) -> Column:
        own, value_key, entity = reference
        what = F.col("value") if value_key is None else F.try_element_at("additional", F.lit(value_key)) if "additional" in results.columns else F.lit(None).cast("double")
        fits = F.col("kpi_key") == own
        return F.max(F.when(fits if entity == "self" else fits & (F.col("entity_id") == entity), what))

    of_self = {name: r for name, r in nodes.items() if r[2] == "self"}
    bound = {name: r for name, r in nodes.items() if r[2] != "self"}
    if of_self:
        other = results.where(F.col("kpi_key").isin(*sorted({r[0] for r in of_self.values()}))).groupBy(F.col("entity_id").alias("ref_entity_")).agg(*[value(r).alias(name) for name, r in of_self.items()])
        df = df.join(other, F.col(key).cast("string") == F.col("ref_entity_"), "left")
    if bound:
        keys, ids = (sorted({r[i] for r in bound.values()}) for i in (0, 2))
        named = results.where(F.col("kpi_key").isin(*keys) & F.col("entity_id").isin(*ids))  # pushed to the files
        row = named.agg(*[value(r).alias(name) for name, r in bound.items()])
        df = df.join(F.broadcast(row))  # a single row
    return df


def evaluate(tree: dict, entities: DataFrame, key: str, tables: dict[str, DataFrame] | None = None, results: DataFrame | None = None, config: dict | None = None, after: dict | None = None) -> DataFrame:
    """(entity_id, value) of a formula for every entity.

    ``results`` (kpi_key, entity_id, value, and additional values by name) holds what other
    formulas gave; ``tables`` what aggregations run over. Aggregates of one table are one row,
    computed in one pass each.
    """
    df = entities
    if references(tree):
        df = _referenced(df, tree, key, results)
    aggregates = {_name(n): n for n in walk(tree) if n["type"] == "aggregation"}
    for entity in sorted({n["entity"] for n in aggregates.values()}):
        own = {k: n for k, n in aggregates.items() if n["entity"] == entity}
        row = tables[entity].agg(*[
            AGGREGATES[n["operator"]](F.when(matches(n.get("filters", [])), F.col(n["field"]).try_cast("double"))).alias(k) if n["operator"] != "countOf" else F.count_if(matches(n.get("filters", []))).cast("double").alias(k)
            for k, n in own.items()
        ])
        df = df.join(F.broadcast(row))  # a single row
    return df.select(F.col(key).cast("string").alias("entity_id"), post_process(compile_node(tree, config or {}), after or {}).alias("value"))


def substitute(template: dict, parameters: dict[str, object]) -> dict:
    """A template with each ``{{name}}`` replaced; a text that is one placeholder takes the parameter's type."""
    def inside(x):
        if isinstance(x, dict):
            return {k: inside(v) for k, v in x.items()}
        if isinstance(x, list):
            return [inside(v) for v in x]
        if not isinstance(x, str):
            return x
        if re.fullmatch(r"\{\{[^{}]*\}\}", x):
            return parameters[x[2:-2].strip()]
        return re.sub(r"\{\{([^{}]*)\}\}", lambda m: str(parameters[m[1].strip()]), x)

    return inside(template)
