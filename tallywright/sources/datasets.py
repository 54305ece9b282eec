"""The practice system's datasets: one table an endpoint, with its schema and filters."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paged import read_pages

_REF = "struct<_id: string, title: string>"
_PERSON = "struct<_id: string, name: string, surname: string, rates: array<struct<value: double, default: boolean>>>"
_CLIENTS = "array<struct<contact: struct<_id: string, display_name: string>>>"
_MATTER = "struct<_id: string, number: long, case_name: string>"


@dataclass(frozen=True)
class Dataset:
    """Where the records lie in the API, their fields, and what requests can filter by.

    ``parameters`` are (column, request name, kind, path in the record), as the paged source
    takes them. ``paged`` is off for what one request answers.
    """

    path: str
    schema: str
    method: str = "GET"
    field: str = "rows"
    paged: bool = True
    size: int = 50
    parameters: tuple[tuple[str, str, str, str], ...] = ()


# Paths, request fields and record fields of the API.
DATASETS = {
    "attorneys": Dataset("/attorneys", "_id string, name string, surname string, status string, job_title string, rates array<struct<value: double, default: boolean>>, email string, integration_account_id string", paged=False),
    "departments": Dataset("/departments", "_id string, title string, is_deleted boolean", paged=False),
    "case_types": Dataset("/case-types/active", f"_id string, title string, fixed_fee double, department {_REF}, is_deleted boolean", paged=False),
    "targets": Dataset("/targets/{competence}", "competence string, attorneys array<struct<_id: string, work_hours_per_day: double, non_chargeable_ratio: double>>, workday_rules struct<excluded_dates: array<string>>", field="", paged=False),
    "matters": Dataset(
        "/matters",
        f"_id string, number long, status string, case_name string, financial_limit double, office_account_balance double, source string, source_contact_name string, responsible_lawyer {_PERSON}, "
        f"responsible_supervisor {_PERSON}, paralegal {_PERSON}, department {_REF}, case_type {_REF}, clients {_CLIENTS}, last_status_update string, in_progress_date string, completed_date string, created_at string, updated_at string",
        parameters=(("status", "status", "any", "status"),),
    ),
    "time_entries": Dataset(
        "/time-entries/search",
        f"_id string, do_not_bill boolean, billable double, write_off double, duration_minutes double, units double, matter {_MATTER}, assignee {_PERSON}, activity {_REF}, work_type string, date string, department {_REF}, invoice string, status string",
        method="POST", field="result", parameters=(("date", "start", "from", "date"), ("assignee_id", "assignee", "one", "assignee._id")),
    ),
    "time_entry_summary": Dataset("/time-entries/summary", "total_duration_hours double, total_billable double, total_write_off double", method="POST", field="", paged=False, parameters=(("start", "start", "from", "start"),)),
    "invoices": Dataset(
        "/invoices/search",
        f"_id string, invoice_number long, invoice_date string, due_date string, subtotal double, write_off double, vat double, total_firm_fees double, total double, outstanding double, paid double, written_off double, "
        f"clients {_CLIENTS}, solicitor {_PERSON}, matter {_MATTER}, billing_amount double, billable_entries double, total_disbursements double, credited double, vat_percentage double, status string, "
        "time_entries_override_value double, time_entries array<string>, total_other_fees double",
        method="POST", field="", parameters=(("invoice_date", "start", "from", "invoice_date"),),
    ),
    "invoice_summary": Dataset("/invoices/summary", "unpaid double, paid double, total double", field="", paged=False),
    "ledgers": Dataset(
        "/ledgers/search",
        f"_id string, type string, value double, vat double, outstanding double, reference string, payee string, matter {_MATTER}, date string, department {_REF}, responsible_lawyer {_PERSON}, contact {_REF}, invoice string, disbursements array<string>, status string",
        method="POST", field="", parameters=(("type", "ledger_type", "one", "type"), ("date", "start", "from", "date")),
    ),
    "tasks": Dataset("/tasks", f"_id string, title string, due_date string, status string, priority string, matter {_MATTER}, assigned_to {_PERSON}"),
    "contacts": Dataset("/contacts", "_id string, type string, display_name string, company_name string, is_archived string", parameters=(("is_archived", "is_archived", "one", "is_archived"),)),
}

# What a pull leaves out or takes in.
PULLED_MATTERS = ("IN_PROGRESS", "ON_HOLD", "EXCHANGED", "QUOTE", "NOT_PROCEEDING")
EXCLUDED_ENTRIES = ("CONSOLIDATED", "CONSOLIDATION_TARGET", "DELETED")
LEDGER_TYPES = ("OFFICE_PAYMENT", "CLIENT_TO_OFFICE", "OFFICE_RECEIPT")


def read_dataset(spark: SparkSession, base_url: str, name: str, competence: str = "", **options: str) -> DataFrame:
    """All records of a dataset; filters on its parameter columns reach the request.

    ``options`` go to the paged source (login, lanes, pause, onFailure; ``url`` names another
    address). A target month without targets has no rows.
    """
    d = DATASETS[name]
    url = base_url + d.path.replace("{competence}", competence)
    if d.paged and d.method == "GET":
        url += "?page={page}&limit={size}"
    own = {
        "url": url, "method": d.method, "field": d.field, "size": str(d.size), "single": "false" if d.paged else "true",
        "parameters": json.dumps([list(p) for p in d.parameters]), **options,
    }
    return read_pages(spark, d.schema, **own)


def pull(spark: SparkSession, base_url: str, name: str, from_date: str | None = None, **options: str) -> DataFrame:
    """A dataset as a pull takes it: live matters, entries that were not merged or deleted, tasks
    that were not deleted, contacts that are not archived, and dated records from a day on."""
    df = read_dataset(spark, base_url, name, **options)
    dated = next((column for column, request, kind, _ in DATASETS[name].parameters if kind == "from"), None)
    if from_date and dated:
        df = df.where(F.col(dated) >= from_date)
    if name == "matters":
        df = df.where(F.col("status").isin(*PULLED_MATTERS))
    if name == "time_entries":
        df = df.where(~F.coalesce("status", F.lit("")).isin(*EXCLUDED_ENTRIES))
    if name == "tasks":
        df = df.where(F.coalesce("status", F.lit("")) != "DELETED")
    if name == "contacts":
        df = df.where(F.col("is_archived") == "false")
    return df
