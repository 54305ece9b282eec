"""Raw text rows to typed entity rows: remapping, coercion, rejects, duplicates, entity rules.

Each step is a projection, a filter or one window; counts of warnings are one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import COERCIONS, coerce_string, day_difference, js_round, month_key


@dataclass(frozen=True)
class Field:
    """A field of an entity: its key, type and whether strict mode asks for it."""

    key: str
    kind: str = "STRING"
    required: bool = False
    options: tuple[str, ...] = ()


def remap(df: DataFrame, mapping: dict[str, str], index: str = "row_index") -> DataFrame:
    """Mapped columns under their field names, and an index that is unique but has gaps."""
    return df.select(*[F.col(f"`{src}`").alias(to) for src, to in mapping.items()], F.monotonically_increasing_id().alias(index))


def coerce(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Typed fields; ``warnings`` lists those whose text did not read as the type, or is no option."""
    out, warned = [], []
    for f in (f for f in fields if f.key in df.columns):
        raw, value = F.col(f.key), COERCIONS[f.kind](F.col(f.key))
        out.append(value.alias(f.key))
        bad = coerce_string(raw).isNotNull() & (value.isNull() | (~value.isin(*f.options) if f.options else F.lit(False)))
        warned.append(F.when(bad, F.lit(f.key)))
    keys = {f.key for f in fields}
    return df.select(*out, *[c for c in df.columns if c not in keys], F.array_compact(F.array(*warned)).alias("warnings"))


def warning_counts(df: DataFrame) -> DataFrame:
    """(field, n) of the warnings that ``coerce`` left."""
    return df.select(F.explode("warnings").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def judged(df: DataFrame, fields: list[Field], strict: bool = False) -> DataFrame:
    """Rows with ``reject``: null for a row to keep, else why it goes.

    A row without any value is blank; in strict mode a row that lacks required fields goes too.
    """
    own = [f for f in fields if f.key in df.columns]
    blank = F.coalesce(*[F.col(f.key).cast("string") for f in own]).isNull()
    missing = F.array_compact(F.array(*[F.when(F.col(f.key).isNull(), F.lit(f.key)) for f in own if f.required]))
    lacking = (F.size(missing) > 0) if strict and any(f.required for f in own) else F.lit(False)
    return df.withColumn("reject", F.when(blank, "blank row").when(lacking, F.concat(F.lit("missing "), F.array_join(missing, ", "))))


def abort_when_mostly_rejected(df: DataFrame, most: float = 0.5) -> DataFrame:
    """The kept rows of ``judged``; raises if more than ``most`` of all rows were rejected (one count)."""
    total, gone = df.agg(F.count("*"), F.count("reject")).first()
    if total and gone / total > most:
        raise ValueError(f"{gone} of {total} rows rejected")
    return df.where("reject is null").drop("reject")


def first_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without key all stay.

    Rows without key skip the window, so that they never meet in one task.
    """
    ranked = df.where(F.col(key).isNotNull()).withColumn("rn_", F.row_number().over(W.partitionBy(key).orderBy(order))).where("rn_ = 1").drop("rn_")
    return ranked.unionByName(df.where(F.col(key).isNull()))


def pay_model(c: Column) -> Column:
    """Spellings of the two pay models; others stay."""
    low = F.regexp_replace(F.lower(c), r"[\s\-_]", "")
    return F.when(low.contains("fee"), "FeeShare").when(low.contains("salary") | low.contains("salaried"), "Salaried").otherwise(c)


def default_rate(c: Column) -> Column:
    """The rate out of a JSON list of rates: the first default, else the first; plain numbers as they are."""
    rates = F.from_json(c, "array<struct<label:string,value:double,`default`:boolean>>")
    chosen = F.coalesce(F.get(F.filter(rates, lambda r: F.coalesce(r["default"], F.lit(False))), F.lit(0)), F.get(rates, F.lit(0)))
    return F.when(F.startswith(c, F.lit("[")), chosen["value"]).otherwise(c.try_cast("double"))


def fee_earner_rules(df: DataFrame) -> DataFrame:
    """rate, pay_model, annual_salary, monthly_salary, is_system_account."""
    return df.withColumn("rate", default_rate(F.col("rate"))).withColumn("pay_model", pay_model(F.col("pay_model"))).withColumn(
        "monthly_salary", F.coalesce("monthly_salary", F.col("annual_salary") / 12)).withColumn("is_system_account", F.coalesce("is_system_account", F.lit(False)))


def time_entry_rules(df: DataFrame) -> DataFrame:
    """minutes from hours, value from rate and minutes, write-off 0, do_not_bill false where missing."""
    df = df.withColumn("minutes", F.coalesce("minutes", F.col("hours") * 60))
    return df.withColumn("billable_value", F.coalesce("billable_value", F.col("rate") * F.col("minutes") / 60)).withColumn(
        "write_off", F.coalesce("write_off", F.lit(0.0))).withColumn("do_not_bill", F.coalesce("do_not_bill", F.lit(False)))


def invoice_rules(df: DataFrame) -> DataFrame:
    df = df.withColumn("paid", F.coalesce("paid", F.lit(0.0))).withColumn("outstanding", F.coalesce("outstanding", F.lit(0.0)))
    return df.withColumn("total", F.coalesce("total", F.col("paid") + F.col("outstanding")))


def disbursement_rules(df: DataFrame) -> DataFrame:
    """The first contact of a JSON list as client id and name."""
    first = F.get(F.from_json("client_id", "array<struct<contact:string,display_name:string>>"), F.lit(0))
    listed = F.startswith("client_id", F.lit("["))
    return df.withColumn("client_name", F.when(listed, F.coalesce(first["display_name"], F.col("client_name"))).otherwise(F.col("client_name"))).withColumn(
        "client_id", F.when(listed, F.coalesce(first["contact"], F.col("client_id"))).otherwise(F.col("client_id")))


def duration_hours(units: Column, minutes: Column) -> Column:
    """Six-minute units before recorded minutes."""
    return F.when(units > 0, units * 6 / 60.0).otherwise(minutes / 60.0)


def enrich_entries(df: DataFrame, ref: Column) -> DataFrame:
    """hours, is_chargeable, recorded_value, age_days, week and month of time entries."""
    hours = js_round(F.col("minutes") / 60.0, 4)
    return df.withColumns({
        "hours": hours, "is_chargeable": (F.coalesce("billable_value", F.lit(0)) > 0) & ~F.coalesce("do_not_bill", F.lit(False)),
        "recorded_value": js_round(F.col("rate") * hours, 2), "age_days": day_difference(ref, F.col("entry_date")), "week": F.weekofyear("entry_date"), "month": month_key(F.col("entry_date")),
    })


def strip_fields(df: DataFrame, names: set[str]) -> DataFrame:
    """Without the named fields, in any case and at any depth of structs and arrays of structs."""
    from pyspark.sql import types as T

    low = {n.lower() for n in names}

    def kept(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            inner = [kept(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name.lower() not in low]
            return F.when(c.isNotNull(), F.struct(*inner)) if inner else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: kept(x, kind.elementType))
        return c

    return df.select(*[kept(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name.lower() not in low])


def audit_fields(df: DataFrame, names: set[str]) -> DataFrame:
    """(field, rows): in how many rows a top-level field of the named ones, in any case, holds a value."""
    own = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    cells = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in own]) if own else F.array().cast("array<string>")
    return df.select(F.explode(F.array_compact(cells)).alias("field")).groupBy("field").agg(F.count("*").alias("rows"))
