"""Records of the practice system's API, nested as they come, to flat entities.

One projection an entity; what lookups add is a join to a small dimension. A missing
struct gives nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalise import duration_hours

# Statuses of matters, entries and invoices that rules name.
ACTIVE_MATTER = ("IN_PROGRESS", "ON_HOLD", "EXCHANGED", "QUOTE")
CLOSED_MATTER = ("COMPLETED", "ARCHIVED", "CLOSED", "NOT_PROCEEDING", "DESTROYED", "LOCKED")
EXCLUDED_ENTRY = ("CONSOLIDATED", "CONSOLIDATION_TARGET", "DELETED")
BILLABLE_INVOICE = ("ISSUED", "PAID", "CREDITED")
ATTRIBUTED_INVOICE = ("ISSUED", "PAID", "CREDITED", "WRITTEN_OFF")

# Fields that are kept of each kind of record.
KEEP = {
    "attorney": ("_id", "name", "surname", "status", "job_title", "rates", "email", "integration_account_id"),
    "department": ("_id", "title", "is_deleted"),
    "case_type": ("_id", "title", "fixed_fee", "department", "is_deleted"),
    "matter": (
        "_id", "number", "status", "case_name", "financial_limit", "office_account_balance", "source", "source_contact_name", "responsible_lawyer", "responsible_supervisor", "paralegal",
        "department", "case_type", "clients", "last_status_update", "in_progress_date", "completed_date", "created_at", "updated_at",
    ),
    "time_entry": ("_id", "do_not_bill", "billable", "write_off", "duration_minutes", "units", "matter", "assignee", "activity", "work_type", "date", "department", "invoice", "status"),
    "invoice": (
        "_id", "invoice_number", "invoice_date", "due_date", "subtotal", "write_off", "vat", "total_firm_fees", "total", "outstanding", "paid", "written_off", "clients", "solicitor", "matter",
        "billing_amount", "billable_entries", "total_disbursements", "credited", "vat_percentage", "status", "time_entries_override_value", "time_entries", "total_other_fees",
    ),
    "ledger": ("_id", "type", "value", "vat", "outstanding", "reference", "payee", "matter", "date", "department", "responsible_lawyer", "contact", "invoice", "disbursements", "status"),
    "task": ("_id", "title", "due_date", "status", "priority", "matter", "assigned_to"),
    "contact": ("_id", "type", "display_name", "company_name"),
}


def pruned(raw: DataFrame, kind: str) -> DataFrame:
    """The fields that are kept of a kind of record, as far as they are there."""
    return raw.select(*[F.col(c) for c in KEEP[kind] if c in raw.columns])


def person(c: Column) -> Column:
    """First and last name of a person struct; null without one."""
    return F.when(c.isNotNull(), F.concat(c["name"], F.lit(" "), c["surname"]))


def default_rate(rates: Column) -> Column:
    """The value of the first rate marked as default, or null."""
    return F.get(F.filter(rates, lambda r: r["default"]), F.lit(0))["value"]


def attorneys(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_id").alias("lawyer_id"), F.concat("name", F.lit(" "), "surname").alias("full_name"), F.col("name").alias("first_name"), F.col("surname").alias("last_name"),
        "email", "integration_account_id", "status", default_rate(F.col("rates")).alias("default_rate"), F.coalesce(F.size("rates"), F.lit(0)).alias("n_rates"), "job_title",
    )


def matters(raw: DataFrame, case_types: DataFrame, departments: DataFrame) -> DataFrame:
    """``case_types`` (id, title, is_fixed_fee) and ``departments`` (id, title) fill what the record itself lacks or has empty."""
    kinds = case_types.select(F.col("id").alias("ct_"), F.col("title").alias("ct_title_"), F.col("is_fixed_fee").alias("ct_fixed_"))
    names = departments.select(F.col("id").alias("d_"), F.col("title").alias("d_title_"))
    joined = raw.join(kinds, F.col("case_type._id") == F.col("ct_"), "left").join(names, F.col("department._id") == F.col("d_"), "left")
    first = F.get("clients", F.lit(0))["contact"]
    filled = lambda own, other: F.nullif(F.coalesce(F.nullif(own, F.lit("")), other), F.lit(""))
    contacts = lambda field: F.coalesce(F.transform("clients", lambda c: c["contact"][field]), F.array().cast("array<string>"))
    return joined.select(
        F.col("_id").alias("matter_id"), F.col("number").alias("matter_number"), "case_name", "status", F.col("financial_limit").alias("budget"),
        F.coalesce(F.col("status").isin(*ACTIVE_MATTER), F.lit(False)).alias("is_active"), F.coalesce(F.col("status").isin(*CLOSED_MATTER), F.lit(False)).alias("is_closed"),
        F.coalesce("ct_fixed_", F.lit(False)).alias("is_fixed_fee"),
        F.col("responsible_lawyer._id").alias("lawyer_id"), person(F.col("responsible_lawyer")).alias("lawyer_name"), default_rate(F.col("responsible_lawyer.rates")).alias("lawyer_rate"),
        F.col("responsible_supervisor._id").alias("supervisor_id"), person(F.col("responsible_supervisor")).alias("supervisor_name"),
        F.col("department._id").alias("department_id"), filled(F.col("department.title"), F.col("d_title_")).alias("department_name"),
        F.col("case_type._id").alias("case_type_id"), filled(F.col("case_type.title"), F.col("ct_title_")).alias("case_type_name"),
        first["_id"].alias("client_id"), first["display_name"].alias("client_name"), contacts("_id").alias("client_ids"), contacts("display_name").alias("client_names"),
    )


def time_entries(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_id").alias("entry_id"), F.coalesce("activity.title", "work_type").alias("activity"), duration_hours(F.col("units"), F.col("duration_minutes")).alias("hours"),
        (~F.coalesce("do_not_bill", F.lit(False)) & (F.coalesce("billable", F.lit(0)) > 0)).alias("is_chargeable"), "do_not_bill", F.coalesce("units", F.lit(0)).alias("units"),
        "billable", "write_off", (F.col("billable") + F.col("write_off")).alias("recorded_value"), F.coalesce("status", F.lit("ACTIVE")).alias("entry_status"),
        F.col("assignee._id").alias("lawyer_id"), person(F.col("assignee")).alias("lawyer_name"), F.col("matter._id").alias("matter_id"), F.col("matter.number").alias("matter_number"),
        F.col("invoice").alias("invoice_id"), "date",
    )


def fee_earner_revenue(subtotal: Column, firm_fees: Column, disbursements: Column) -> Column:
    """What is left of a subtotal for fee earners; missing amounts count as nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(subtotal) - zero(firm_fees) - zero(disbursements)


def invoices(raw: DataFrame) -> DataFrame:
    """``time_entries`` may hold ids or embedded records."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    kind = raw.schema["time_entries"].dataType
    embedded = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    ids = F.transform("time_entries", lambda e: e["_id"]) if embedded else F.col("time_entries")
    first = F.get("clients", F.lit(0))
    return raw.select(
        F.col("_id").alias("invoice_id"), "invoice_number", "invoice_date", "due_date", zero("subtotal").alias("subtotal"), F.coalesce("billing_amount", "subtotal", F.lit(0)).alias("billing_amount"),
        zero("billable_entries").alias("billable_entries"), fee_earner_revenue(F.col("subtotal"), F.col("total_firm_fees"), F.col("total_disbursements")).alias("fee_earner_revenue"),
        zero("total_disbursements").alias("total_disbursements"), zero("total_other_fees").alias("total_other_fees"), zero("total_firm_fees").alias("total_firm_fees"),
        zero("time_entries_override_value").alias("override_value"), F.coalesce(ids, F.array().cast("array<string>")).alias("entry_ids"), "total", "outstanding", "paid", "written_off",
        F.coalesce("status", F.lit("")).alias("status"), F.col("solicitor._id").alias("lawyer_id"), F.col("solicitor.name").alias("lawyer_name"),
        F.col("matter._id").alias("matter_id"), F.col("matter.number").alias("matter_number"), first["_id"].alias("client_id"), first["display_name"].alias("client_name"),
    )


def disbursements(raw: DataFrame) -> DataFrame:
    """Ledger rows: amounts without sign; what is outstanding below zero is the firm's exposure."""
    open_ = F.col("outstanding")
    return raw.select(
        F.col("_id").alias("transaction_id"), "type", F.abs("value").alias("subtotal"), F.abs("vat").alias("vat"), open_.alias("outstanding"),
        F.when(open_ < 0, F.abs(open_)).otherwise(0).alias("exposure"), (open_ == 0).alias("is_recovered"), F.col("reference").alias("description"), F.col("payee").alias("supplier_id"),
        F.col("matter._id").alias("matter_id"), F.col("matter.number").alias("matter_number"), F.col("responsible_lawyer._id").alias("lawyer_id"), "date",
    )


def tasks(raw: DataFrame, now: Column) -> DataFrame:
    """Deleted tasks go; a task is overdue if it is due before ``now`` and not completed."""
    kept = excluded(raw, "status", ("DELETED",))
    return kept.select(
        F.col("_id").alias("task_id"), "title", "priority", "status", "due_date", F.coalesce((F.col("status") != "COMPLETED") & (F.col("due_date") < now), F.lit(False)).alias("is_overdue"),
        F.col("assigned_to._id").alias("lawyer_id"), person(F.col("assigned_to")).alias("lawyer_name"), F.col("matter._id").alias("matter_id"), F.col("matter.number").alias("matter_number"),
    )


def contacts(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("_id").alias("client_id"), "type", "display_name", F.coalesce(F.col("type") == "Company", F.lit(False)).alias("is_company"), "company_name")


def excluded(df: DataFrame, column: str, statuses: tuple[str, ...]) -> DataFrame:
    """Without rows of the named statuses; rows without status stay."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*statuses))


def ledgers(raw: DataFrame, archived: DataFrame, since: str) -> DataFrame:
    """Ledger rows of live matters, without office payments recovered before ``since``."""
    old = (F.col("type") == "OFFICE_PAYMENT") & (F.col("outstanding") == 0) & (F.col("date") < since)
    kept = raw.where(~F.coalesce(old, F.lit(False)))
    return kept.join(archived.select(F.col("matter_id").alias("archived_")).distinct(), F.col("matter._id") == F.col("archived_"), "left_anti")


def routes(ledger: DataFrame) -> DataFrame:
    """(_id, route): office payments are disbursements; receipts pay invoices, recover disbursements, both or neither."""
    receipt = F.col("type").isin("CLIENT_TO_OFFICE", "OFFICE_RECEIPT")
    taken = F.array_compact(F.array(
        F.when(F.col("type") == "OFFICE_PAYMENT", "disbursements"),
        F.when(receipt & (F.coalesce("invoice", F.lit("")) != ""), "invoicePayments"),
        F.when(receipt & (F.coalesce(F.size("disbursements"), F.lit(0)) > 0), "disbursementRecoveries"),
    ))
    return ledger.select("_id", F.explode(taken).alias("route"))


def billing_type(explicit: Column, fixed: Column) -> Column:
    return F.when(explicit.isin("fixed_fee", "hourly"), explicit).when(fixed, "fixed_fee").when(~fixed, "hourly").otherwise("unknown")


def parsed_list(c: Column) -> Column:
    """A JSON array of texts, or null where the text is none."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>"))


def filled(df: DataFrame, lookup: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """Null ``columns`` (own name to name in ``lookup``) filled by ``id_col``; what is there stays."""
    own = lookup.select(F.col("id").alias("l_"), *[F.col(c).alias(f"{c}_l_") for c in set(columns.values())])
    out = df.join(own, F.col(id_col) == F.col("l_"), "left")
    for name, source in columns.items():
        out = out.withColumn(name, F.coalesce(name, f"{source}_l_"))
    return out.select(*df.columns)


def supplemented(full: DataFrame, closed: DataFrame, columns: list[str]) -> DataFrame:
    """Matters with null ``columns`` taken from closed matters, by id and else by number; of several closed rows the last counts."""
    last = lambda key: closed.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, "row_idx").alias(f"{c}_{key}") for c in columns], F.lit(True).alias(f"has_{key}"))
    out = full.join(last("matter_id"), "matter_id", "left").join(last("matter_number"), "matter_number", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.when(F.col("has_matter_id"), F.col(f"{c}_matter_id")).otherwise(F.col(f"{c}_matter_number"))))
    return out.select(*full.columns, F.coalesce("has_matter_id", "has_matter_number", F.lit(False)).alias("has_closed"))
