"""List, lookup and detail queries: pages with totals, filters by joined metadata, nested children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import js_round, percent
from .aggregates import total, zero


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, with ``total``: the rows of all pages. The count is a single row."""
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def sorted_by(column: str, direction: str, *ties: str) -> list[Column]:
    """An order from a request's ``sortBy`` and ``sortDir``; nulls last in either direction."""
    c = F.col(column)
    return [c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last(), *[F.asc(t) for t in ties]]


def audit_search(events: DataFrame, equal: dict[str, object], since: str, until: str, column: str, like: str) -> DataFrame:
    """Events by equalities, a time range (end excluded) and a pattern in any case; all reach the scan as filters."""
    for name, value in equal.items():
        events = events.where(F.col(name) == F.lit(value))
    return events.where((F.col("ts") >= F.to_timestamp(F.lit(since))) & (F.col("ts") < F.to_timestamp(F.lit(until))) & F.col(column).ilike(like))


def invoice_rag(outstanding: Column, overdue: Column) -> Column:
    """Red is overdue, amber outstanding, green settled."""
    return F.when((outstanding > 0) & overdue, "red").when(outstanding > 0, "amber").otherwise("green")


def _tab_rules() -> dict[str, Column]:
    rag = invoice_rag(F.col("outstanding"), F.col("days_overdue") > 0)
    return {"all": F.lit(True), "outstanding": F.col("outstanding") > 0, "overdue": (F.col("outstanding") > 0) & (F.col("days_overdue") > 0), "paid": F.col("outstanding") == 0, "writtenOff": rag == "red"}


def invoice_tab(invoices: DataFrame, tab: str) -> DataFrame:
    """Rows of a tab of the billing page; the written-off tab shows what is red."""
    return invoices.where(_tab_rules()[tab])


def invoice_tab_counts(invoices: DataFrame) -> DataFrame:
    """(tab, n) of all tabs from one aggregation."""
    rules = _tab_rules()
    row = invoices.agg(*[F.count_if(rule).alias(tab) for tab, rule in rules.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(tab).alias("tab"), F.col(tab).alias("n")) for tab in rules])).alias("t")).select("t.*")


def filtered(df: DataFrame, equal: dict[str, object] | None = None, among: dict[str, list] | None = None, least: dict[str, object] | None = None, most: dict[str, object] | None = None) -> DataFrame:
    """Rows that a dashboard's filters leave: values that are wanted, one of several, at least or at most.

    Filters that are not set (null, empty text or list) leave all rows, and rows without a value
    fail those that are set.
    """
    unset = lambda v: v is None or v == "" or v == []
    for column, value in (equal or {}).items():
        df = df if unset(value) else df.where(F.col(column) == F.lit(value))
    for column, values in (among or {}).items():
        df = df if unset(values) else df.where(F.col(column).isin(*values))
    for column, value in (least or {}).items():
        df = df if unset(value) else df.where(F.col(column) >= F.lit(value))
    for column, value in (most or {}).items():
        df = df if unset(value) else df.where(F.col(column) <= F.lit(value))
    return df


# Statuses of invoices that count for a client.
CLIENT_INVOICES = ("ISSUED", "PAID", "CREDITED")


def client_profiles(contacts: DataFrame, matters: DataFrame, invoices: DataFrame) -> DataFrame:
    """Every contact (client_id, display_name) with what its matters and billable invoices add up to.

    ``matters`` has client_ids, is_active, created, updated (texts) and department, ``invoices``
    client_ids, status, total, outstanding, paid and invoice_date. Arrays are exploded and grouped
    by client before they meet the contacts. A client that an array names twice counts once.
    """
    each = lambda df: df.withColumn("client_id", F.explode(F.array_distinct("client_ids")))
    m = each(matters).groupBy("client_id").agg(
        F.count("*").alias("matters"), F.count_if("is_active").alias("active_matters"), F.min(F.substring("created", 1, 10)).alias("first_matter"), F.max(F.substring("created", 1, 10)).alias("last_matter"),
        F.max(F.substring("updated", 1, 10)).alias("last_update"), F.sort_array(F.collect_set("department")).alias("departments"))
    i = each(invoices.where(F.col("status").isin(*CLIENT_INVOICES))).groupBy("client_id").agg(
        *[F.sum(c).alias(c) for c in ("total", "outstanding", "paid")], F.max("invoice_date").alias("last_invoice"))
    out = contacts.select("client_id", "display_name").join(m, "client_id", "left").join(i, "client_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "client_id", "display_name", zero("matters"), zero("active_matters"), "first_matter", "last_matter", F.greatest("last_invoice", "last_update").alias("last_activity"),
        F.coalesce("departments", F.array().cast("array<string>")).alias("departments"), zero("total"), zero("outstanding"), zero("paid"))


def by_metadata(totals: DataFrame, metadata: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows of ``totals`` whose matter has all the wanted values in ``metadata`` (one row a matter)."""
    wanted = metadata
    for name, value in filters.items():
        if value is not None and value != "":
            wanted = wanted.where(F.col(name) == F.lit(value))
    return totals.join(wanted.select("matter_id"), "matter_id", "left_semi")


def index_unique(df: DataFrame, key: str, value: str, order: str, last: bool = True) -> DataFrame:
    """(key, value): the last row of each key by ``order``, or the first; rows without key are no entries."""
    own = df.where(F.col(key).isNotNull())
    return own.groupBy(key).agg((F.max_by if last else F.min_by)(value, order).alias(value))


def index_multi(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): all values of each key, in order."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def entries_of(matters: DataFrame, entries: DataFrame) -> DataFrame:
    """(matter, entry columns): by id where both sides have one, else by number; two equi-joins, never an OR."""
    own = matters.select(F.col("matter_id").alias("own_id"), F.col("matter_number").alias("own_number"))
    by_id = own.where("own_id is not null").join(entries.where("matter_id is not null"), F.col("own_id") == F.col("matter_id"))
    anonymous = entries.where("matter_id is null and matter_number is not null").join(own.where("own_number is not null"), F.col("own_number") == F.col("matter_number"))
    nameless = own.where("own_id is null and own_number is not null").join(entries.where("matter_id is not null and matter_number is not null"), F.col("own_number") == F.col("matter_number"))
    columns = ["own_id", "own_number", *entries.columns]
    return by_id.select(columns).unionByName(anonymous.select(columns)).unionByName(nameless.select(columns))


def version_diff(versions: DataFrame, key: str, first: int, second: int, fields: list[str]) -> DataFrame:
    """(key, changed): the fields in which two versions of one key differ, nulls equal to nulls."""
    side = lambda v, tag: versions.where(F.col("version") == v).select(key, *[F.col(f).alias(f"{f}_{tag}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")), F.lit(f)) for f in fields]))
    return side(first, "a").join(side(second, "b"), key).select(key, changed.alias("changed"))


def matter_detail(matters: DataFrame, entries: DataFrame, invoices: DataFrame, wanted: str, most_entries: int = 20, most_invoices: int = 10) -> DataFrame:
    """One matter by id or number, with its first entries and invoices nested; the lookup filters every side first."""
    one = matters.where((F.col("matter_id").cast("string") == wanted) | (F.col("matter_number") == wanted)).limit(1)
    children = entries.join(F.broadcast(one.select("matter_id")), "matter_id", "left_semi")
    bills = invoices.join(F.broadcast(one.select("matter_id")), "matter_id", "left_semi")
    listed = children.groupBy("matter_id").agg(F.count("*").alias("n_entries"), F.slice(F.sort_array(F.collect_list(F.struct("entry_date", "lawyer_id", "minutes", "billable_value"))), 1, most_entries).alias("entries"))
    billed = bills.groupBy("matter_id").agg(F.count("*").alias("n_invoices"), F.slice(F.sort_array(F.collect_list(F.struct("invoice_date", "invoice_id", "total", "outstanding"))), 1, most_invoices).alias("invoices"))
    return one.join(listed, "matter_id", "left").join(billed, "matter_id", "left").withColumn("n_entries", zero(F.col("n_entries"))).withColumn("n_invoices", zero(F.col("n_invoices")))


def working_days(ref: Column, n: int) -> Column:
    """The last n Mondays to Fridays before ``ref``, oldest first."""
    days = F.filter(F.sequence(F.date_sub(ref, 2 * n + 7), F.date_sub(ref, 1)), lambda x: F.weekday(x) < 5)
    return F.slice(days, -n, n)


def recording_grid(earners: DataFrame, entries: DataFrame, ref: Column, n: int) -> DataFrame:
    """(lawyer_id, day, has_entries) of every earner and each of the last n working days."""
    grid = earners.select("lawyer_id", F.explode(working_days(ref, n)).alias("day"))
    had = entries.where(F.col("entry_date") >= F.date_sub(ref, 2 * n + 7)).select("lawyer_id", F.col("entry_date").alias("day")).distinct().withColumn("has_entries", F.lit(True))
    return grid.join(had, ["lawyer_id", "day"], "left").withColumn("has_entries", F.coalesce("has_entries", F.lit(False)))


def earner_context(earners: DataFrame, entries: DataFrame, departments: DataFrame, csv_targets: DataFrame, api_targets: DataFrame) -> DataFrame:
    """Earners with the department most of their entries are in, their hours, and a target: uploaded before the API's."""
    worked = entries.join(departments, "matter_id").groupBy("lawyer_id", "department").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("lawyer_id").orderBy(F.desc("n"), F.asc("department")))
    top = worked.withColumn("rn", best).where("rn = 1").select("lawyer_id", F.col("department").alias("top_department"))
    hours = entries.groupBy("lawyer_id").agg(js_round(total("minutes") / 60.0, 4).alias("hours"))
    out = earners.select("lawyer_id").join(top, "lawyer_id", "left").join(hours, "lawyer_id", "left")
    out = out.join(csv_targets.select("lawyer_id", F.col("target").alias("own_")), "lawyer_id", "left").join(api_targets.select("lawyer_id", F.col("target").alias("api_")), "lawyer_id", "left")
    return out.select("lawyer_id", "top_department", zero(F.col("hours")).alias("hours"), F.coalesce("own_", "api_").alias("target"))


def cross_reference_quality(records: DataFrame, entries: DataFrame, matters: DataFrame) -> DataFrame:
    """One row: how many records carry both identifiers of matter and earner, unresolved ones, and orphaned entries.

    ``records`` (matter_id, matter_number, lawyer_id, lawyer_name) is the union of all datasets.
    """
    both = F.col("matter_id").isNotNull() & F.col("matter_number").isNotNull()
    named = F.col("lawyer_id").isNotNull() | F.col("lawyer_name").isNotNull()
    r = records.agg(
        F.coalesce(percent(F.count_if(both), F.count("*")), F.lit(100.0)).alias("matter_coverage"),
        F.coalesce(percent(F.count_if(F.col("lawyer_id").isNotNull() & F.col("lawyer_name").isNotNull()), F.nullif(F.count_if(named), F.lit(0))), F.lit(100.0)).alias("earner_coverage"),
        F.count_if(F.col("matter_id").isNotNull() & F.col("matter_number").isNull()).alias("unresolved_ids"), F.count_if(F.col("matter_number").isNotNull() & F.col("matter_id").isNull()).alias("unresolved_numbers"),
        F.countDistinct(F.when(F.col("lawyer_id").isNull(), F.col("lawyer_name"))).alias("unresolved_names"),
    )
    known = matters.select("matter_number").where("matter_number is not null").distinct()
    orphans = entries.join(known, "matter_number", "left_anti").agg(F.count("*").alias("orphans"))
    every = entries.agg(F.count("*").alias("entries"))
    out = r.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(every))
    return out.withColumn("orphan_rate", F.coalesce(percent(F.col("orphans"), F.col("entries")), F.lit(0.0)))


def known_gaps(quality: DataFrame, most_orphans: float = 20.0) -> DataFrame:
    """(code, severity): what the quality row is short of."""
    gaps = F.array_compact(F.array(
        F.when(F.col("matter_coverage") < 70, F.struct(F.lit("LOW_IDENTIFIER_COVERAGE").alias("code"), F.lit("warning").alias("severity"))),
        F.when((F.col("entries") > 0) & (F.col("orphan_rate") > most_orphans), F.struct(F.lit("WIP_ORPHAN_GAP").alias("code"), F.lit("warning").alias("severity"))),
    ))
    return quality.select(F.explode(gaps).alias("g")).select("g.*")


# What to do about a dataset that is missing, with its priority.
MISSING_ADVICE = (
    (1, "Upload fee earner file", "feeEarner"), (1, "Upload WIP / Lawyer Time export", "wipJson"), (1, "Upload Full Matters export", "fullMattersJson"), (2, "Upload Invoices export", "invoicesJson"),
    (3, "Upload Closed Matters export", "closedMattersJson"), (3, "Upload Contacts export", "contactsJson"),
)


def recommendations(uploads: DataFrame) -> DataFrame:
    """(priority, title) for every dataset kind without an upload, most urgent first."""
    advice = uploads.sparkSession.createDataFrame(list(MISSING_ADVICE), "priority int, title string, kind string")
    return advice.join(uploads.select("kind").distinct(), "kind", "left_anti").orderBy("priority", "title").select("priority", "title")
