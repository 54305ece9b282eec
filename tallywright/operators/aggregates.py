"""Aggregations by matter, fee earner, client, department and firm, and their building blocks.

Every function is one grouped plan (partial aggregation before the shuffle). Grains that
must keep members without facts join their facts to the dimension after grouping, so the
shuffle moves sums and never detail rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import js_round, month_key, safe_div


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def total(c: str | Column, when: Column | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return zero(F.sum(c if when is None else F.when(when, c)))


def hours(c: Column) -> Column:
    return js_round(c / 60.0, 4)


def time_by(entries: DataFrame, *keys: str) -> DataFrame:
    """Minutes, values and dates of time entries at any grain."""
    yes = F.col("is_chargeable")
    return entries.groupBy(*keys).agg(
        total("minutes").alias("minutes"), total("minutes", yes).alias("chargeable_minutes"), total("minutes", ~yes).alias("other_minutes"),
        total("billable_value").alias("billable"), total("billable_value", yes).alias("chargeable_value"), total("write_off").alias("write_off"),
        F.count("*").alias("entries"), F.min("entry_date").alias("oldest"), F.max("entry_date").alias("newest"), F.max("age_days").alias("age_days"),
    )


def invoices_by(invoices: DataFrame, *keys: str, net: str = "subtotal") -> DataFrame:
    """Billing measures at any grain; ``net`` may be ``total`` for gross billing."""
    paid = F.col("total") - F.col("outstanding")
    return invoices.groupBy(*keys).agg(
        F.count("*").alias("invoices"), total(net).alias("net_billing"), total("total").alias("invoiced"), total("outstanding").alias("outstanding"), total(paid).alias("paid"), F.max("invoice_date").alias("latest_invoice"),
    )


def matters(dim: DataFrame, entries: DataFrame, invoices: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Every matter with its work and billing; those without facts have zeros."""
    out = dim.join(time_by(entries, "matter_id"), "matter_id", "left").join(invoices_by(invoices, "matter_id"), "matter_id", "left")
    out = out.na.fill(0, ["minutes", "chargeable_minutes", "other_minutes", "entries", "invoices"])
    for c in ("billable", "chargeable_value", "write_off", "net_billing", "invoiced", "outstanding", "paid"):
        out = out.withColumn(c, zero(F.col(c)))
    gap = F.abs(F.col("billable") - F.col("net_billing"))
    both = (F.col("billable") > 0) & (F.col("net_billing") > 0)
    return out.withColumn("discrepancy", F.when(both, F.when(safe_div(gap, F.col("billable")) > tolerance, "major").otherwise("minor")))


def fee_earners(dim: DataFrame, entries: DataFrame, invoices: DataFrame, ref: Column) -> DataFrame:
    """Every fee earner with hours, distinct matched matters, orphan work and billing."""
    orphan = ~F.col("matched")
    work = entries.groupBy("lawyer_id").agg(
        total("minutes").alias("minutes"), total("minutes", F.col("is_chargeable")).alias("chargeable_minutes"), total("billable_value").alias("billable"), total("write_off").alias("write_off"),
        F.countDistinct(F.when(F.col("matched"), F.col("matter_id"))).alias("matters"), total("minutes", orphan).alias("orphan_minutes"), total("billable_value", orphan).alias("orphan_value"),
        F.count("*").alias("entries"), F.max("entry_date").alias("newest"),
    )
    billed = invoices.groupBy("lawyer_id").agg(total("subtotal").alias("revenue"), total("outstanding").alias("outstanding"), F.count("*").alias("invoices"))
    out = dim.join(work, "lawyer_id", "left").join(billed, "lawyer_id", "left")
    for c in ("minutes", "chargeable_minutes", "billable", "write_off", "matters", "orphan_minutes", "orphan_value", "entries", "revenue", "outstanding", "invoices"):
        out = out.withColumn(c, zero(F.col(c)))
    return out.withColumn("gap_days", F.greatest(F.lit(0), F.datediff(ref, F.col("newest"))))


def departments(earners: DataFrame, matters: DataFrame) -> DataFrame:
    """Departments with their earners' value and billing, and the minutes worked on their matters."""
    worked = matters.groupBy("department").agg(total("minutes").alias("minutes"))
    rolled = earners.groupBy("department").agg(F.count("*").alias("fee_earners"), total("billable").alias("billable"), total("revenue").alias("revenue"), total("outstanding").alias("outstanding"))
    return rolled.join(worked, "department", "left").withColumn("minutes", zero(F.col("minutes")))


def clients(dim: DataFrame, matter_totals: DataFrame) -> DataFrame:
    """Roll-up of matter aggregates by client, clients without matters included."""
    rolled = matter_totals.groupBy("client_id").agg(
        F.count("*").alias("matters"), total("billable").alias("billable"), total("net_billing").alias("net_billing"), total("outstanding").alias("outstanding"),
        total("paid").alias("paid"), F.max("age_days").alias("oldest_days"),
    )
    out = dim.join(rolled, "client_id", "left")
    for c in ("matters", "billable", "net_billing", "outstanding", "paid"):
        out = out.withColumn(c, zero(F.col(c)))
    return out


def firm(entries: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row for the firm; both sides are single rows before they meet."""
    orphan = ~F.col("matched")
    work = entries.agg(
        total("minutes").alias("minutes"), total("billable_value").alias("billable"), total("write_off").alias("write_off"), F.count("*").alias("entries"),
        F.count_if(orphan).alias("orphan_entries"), total("billable_value", orphan).alias("orphan_value"),
    )
    billed = invoices.agg(F.count("*").alias("invoices"), total("subtotal").alias("net_billing"), total("outstanding").alias("outstanding"))
    return work.crossJoin(F.broadcast(billed)).withColumn("orphan_percent", zero(safe_div(F.col("orphan_value"), F.col("billable")) * 100))


def join_statistics(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("orphaned"), total("billable_value", ~F.col("matched")).alias("orphaned_value"))


def activity_breakdown(entries: DataFrame, key: str) -> DataFrame:
    """(key, activities): a map from activity to hours and value; two-level grouping."""
    fine = entries.groupBy(key, F.coalesce("activity", F.lit("__unknown__")).alias("activity")).agg(total("minutes").alias("m"), total("billable_value").alias("v"))
    entry = F.struct("activity", F.struct(hours(F.col("m")).alias("hours"), F.col("v").cast("double").alias("value")))
    return fine.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("activities"))


def band_histogram(df: DataFrame, band: Column, names: list[str], value: str) -> DataFrame:
    """(band, position, items, value, share): every band, the empty ones with zeros."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, band string")
    grouped = df.groupBy(band.alias("band")).agg(F.count("*").alias("items"), total(value).alias("value"))
    out = F.broadcast(bands).join(grouped, "band", "left").withColumn("items", zero(F.col("items"))).withColumn("value", zero(F.col("value")))
    return out.withColumn("share", zero(safe_div(F.col("value"), F.sum("value").over(W.partitionBy())) * 100))


def weighted_average(x: str, weight: str) -> Column:
    """Mean of x by weight; a plain mean where the weights add up to nothing."""
    return F.coalesce(safe_div(F.sum(F.col(x) * F.col(weight)), F.nullif(F.sum(weight), F.lit(0))), F.avg(x))


def monthly(df: DataFrame, date: str, value: str, last: int = 12) -> DataFrame:
    """Value by month, the latest ``last`` months; the group count bounds the sort."""
    grouped = df.groupBy(month_key(F.col(date)).alias("month")).agg(total(value).alias("value"), F.count("*").alias("items"))
    return grouped.orderBy(F.desc("month")).limit(last)


def mode(df: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """Most frequent value of each key; of equals the one that came first by ``first``, then by itself."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(first).alias("seen"))
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), F.asc("seen"), F.asc(value)))
    return counted.withColumn("rn", best).where("rn = 1").select(key, value, "n")


def top_rows(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group (a window, with a group limit before its shuffle)."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("position") <= n)


#: Values that one task may sort to pick the median among them.
SORTED_VALUES = 100_000


def exact_median(df: DataFrame, value: str, most: int = SORTED_VALUES) -> float | None:
    """The middle value, or the mean of the two middle ones, exactly; null without values.

    Sketched quantiles just below and above the middle bound where it lies, and a count of what
    lies below, on and between the bounds verifies it. That repeats on what lies between until a
    single task may sort it, or until the middle is a bound itself; each round leaves a few
    thousandths of the rows, ties aside. No round moves more than a row a task.
    """
    v = F.col("v")
    own = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, low, high = own.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    below, inside, strict = 0, n, own  # how many lie below those that are looked at
    ranks = [(n - 1) // 2, n // 2]
    found: dict[int, float] = {}
    while len(found) < len(set(ranks)):
        open_ranks = [r for r in sorted(set(ranks)) if r not in found]
        if inside <= most:
            first, last = open_ranks[0] - below, open_ranks[-1] - below
            rows = strict.orderBy("v").offset(first).limit(last - first + 1).collect()
            found |= {r: rows[r - below - first]["v"] for r in open_ranks}
            break
        shares = [min(1.0, max(0.0, (r - below) / inside + shift)) for r, shift in ((open_ranks[0], -0.001), (open_ranks[-1], 0.001))]
        left, right = strict.agg(F.percentile_approx("v", shares, 10_000)).first()[0]
        for _ in range(2):
            counts = strict.agg(F.count_if(v < left), F.count_if(v == left), F.count_if((v > left) & (v < right)), F.count_if((v == right) & (v > left))).first()
            under, on_left, between, on_right = counts
            if below + under <= open_ranks[0] and open_ranks[-1] < below + under + on_left + between + on_right:
                break
            left, right = low, high  # the sketch missed: look at all
        for r in open_ranks:
            at = r - below - under
            if 0 <= at < on_left:
                found[r] = left
            elif at >= on_left + between:
                found[r] = right
        strict, below, inside, low, high = strict.where((v > left) & (v < right)), below + under + on_left, between, left, right
    return (found[ranks[0]] + found[ranks[1]]) / 2


def summarise(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, extremes, sum, count and missing of one column; exact."""
    c = F.col(value)
    return df.agg(
        F.avg(c).alias("mean"), F.lit(exact_median(df, value)).cast("double").alias("median"), F.min(c).alias("least"), F.max(c).alias("most"),
        F.sum(c).alias("total"), F.count(c).alias("present"), F.count_if(c.isNull()).alias("missing"),
    )


def join_report(entries: DataFrame, matters: DataFrame, clients: DataFrame) -> DataFrame:
    """One row: entries with and without a matter and their value, matters with and without a known client."""
    linked = matters.join(clients.select("client_id", F.lit(True).alias("known")), "client_id", "left").agg(F.count("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("unresolved"))
    return join_statistics(entries).join(F.broadcast(linked))


def field_samples(df: DataFrame, fields: list[str], most: int = 5) -> DataFrame:
    """(field, rows, missing, distinct_values, samples) of some fields, the smallest few values as samples.

    Values count by field first; the smallest of each part come before the smallest of all.
    """
    from ..sources.files import profile

    return profile(df.select(*[F.col(f).cast("string").alias(f) for f in fields]), most).select("field", "rows", "missing", "distinct_values", "samples")


def field_statistics(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, rows, missing, distinct): one pass over all fields at once."""
    aggs = [F.count("*").alias("rows")]
    for f in fields:
        aggs += [F.count_if(F.col(f).isNull()).alias(f"m_{f}"), F.countDistinct(f).alias(f"d_{f}")]
    row = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col("rows"), F.col(f"m_{f}").alias("missing"), F.col(f"d_{f}").alias("distinct_values")) for f in fields])
    return row.select(F.explode(each).alias("f")).select("f.*")
