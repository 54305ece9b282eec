"""Scalar column functions: coercions, rounding, dates, names and bands.

All are Catalyst expressions. They follow two-valued null logic where a business rule
needs it, and say so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of booleans, honorifics, date patterns in the order they are tried.
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")
TITLES = "mr|mrs|ms|miss|dr|prof|sir"
DATE_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy")


def js_round(x: Column, digits: int = 0) -> Column:
    """Round half toward plus infinity."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return safe_div(a, b) * 100.0


def coerce_string(x: Column) -> Column:
    """Trimmed of all white space; empty reads as null."""
    return F.nullif(F.regexp_replace(x, r"^[\s ﻿]+|[\s ﻿]+$", ""), F.lit(""))


def number_prefix(x: Column) -> Column:
    """The number that a text starts with, or null: ``12.5abc`` is 12.5."""
    return F.nullif(F.regexp_extract(x, r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)", 0), F.lit("")).try_cast("double")


def coerce_number(x: Column) -> Column:
    """Everything but digits, points and minus signs goes; then the numeric prefix."""
    return number_prefix(F.regexp_replace(x, r"[^0-9.\-]", ""))


def coerce_currency(x: Column) -> Column:
    """Currency signs, commas and spaces go; then the numeric prefix."""
    return number_prefix(F.regexp_replace(x, r"[£$€,\s]", ""))


def coerce_percentage(x: Column) -> Column:
    """Values up to 1 are fractions and read as percents."""
    n = number_prefix(F.regexp_replace(x, r"[%\s]", ""))
    return F.when(n <= 1, n * 100).otherwise(n)


def coerce_boolean(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def coerce_date(x: Column) -> Column:
    """First of the known patterns that fits; day before month where both could be meant."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(p)) for p in DATE_PATTERNS])


COERCIONS = {
    "STRING": coerce_string, "REFERENCE": coerce_string, "NUMBER": coerce_number, "CURRENCY": coerce_currency,
    "PERCENTAGE": coerce_percentage, "BOOLEAN": coerce_boolean, "DATE": coerce_date, "SELECT": coerce_string,
}


def day_difference(later: Column, earlier: Column) -> Column:
    """Whole days by milliseconds, time of day included (not calendar days)."""
    ms = F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))
    return F.floor(ms / F.lit(86_400_000)).cast("int")


def months_back(ref: Column, n: int) -> Column:
    """n calendar months before; a day that the month lacks runs over into the next."""
    first = F.add_months(F.trunc(ref, "MM"), -n)
    return F.date_add(first, F.dayofmonth(ref) - 1)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def working_days_between(start: Column, end: Column) -> Column:
    """Monday-to-Friday days in (start, end], in closed form; zero if end is not later, null without both."""
    def upto(d: Column) -> Column:  # working days since Monday 1970-01-05, that day excluded
        n = F.datediff(d, F.to_date(F.lit("1970-01-04")))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0), upto(end) - upto(start)).cast("int"))


def normalise_name(x: Column) -> Column:
    """Lower case, without honorific, single blanks."""
    low = F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return F.trim(F.regexp_replace(low, rf"^({TITLES})\.?\s+", ""))


def normalise_account_name(x: Column) -> Column:
    """Lower case and single blanks, without anything in parentheses; honorifics stay."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), r"\([^)]*\)", ""))


def surname(x: Column) -> Column:
    return F.element_at(F.split(normalise_name(x), " "), -1)


def name_variants(x: Column) -> Column:
    """Distinct spellings under which a person may be entered."""
    name = normalise_name(x)
    parts = F.split(name, " ")
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    initial = F.substring(first, 1, 1)
    forms = (
        name, F.concat(last, F.lit(", "), first), F.concat(last, F.lit(" "), first), F.concat(initial, F.lit(" "), last), F.concat(initial, F.lit(". "), last),
        F.concat(last, F.lit(" "), initial), F.concat(last, F.lit(", "), initial), F.concat(first, F.lit(" "), last), last,
    )
    return F.array_distinct(F.array(*forms))


def normalise_header(x: Column) -> Column:
    """Lower case with single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def banded(x: Column, bands: list[tuple[str, float | None]], missing: str | None = None) -> Column:
    """Name of the first band whose upper bound (None: none) is not exceeded."""
    out = F.when(x.isNull(), F.lit(missing))
    for name, upper in bands:
        out = out.otherwise(F.lit(name)) if upper is None else out.when(x <= upper, F.lit(name))
    return out


# What inference takes for booleans and dates.
DETECTED_TYPES = ("boolean", "currency", "number", "date")
BOOLEAN_TEXTS = ("true", "false", "yes", "no", "TRUE", "FALSE", "YES", "NO")
DETECTED_DATES = ("dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "dd MMM yyyy", "MMM dd yyyy")


def detected_as(x: Column, kind: str) -> Column:
    """Whether a trimmed text reads as ``kind``, for type inference."""
    numeric = F.regexp_replace(x, "[£$€,]", "").rlike(r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$")
    if kind == "boolean":
        return x.isin(*BOOLEAN_TEXTS)
    if kind == "currency":
        return x.rlike("[£$€]") & numeric
    if kind == "number":
        return numeric
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for p in DETECTED_DATES]).isNotNull()


def coerce_detected(x: Column, kind: str) -> Column:
    """A text as its inferred type; what does not read as it, and empty text, is null."""
    t = F.nullif(F.trim(x), F.lit(""))
    if kind == "boolean":
        return F.lower(t).isin("true", "yes", "1")
    if kind in ("currency", "number"):
        return coerce_currency(t)
    if kind == "date":
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in DETECTED_DATES])
    return t


def display_result(value: Column, kind: str, symbol: str = "£") -> Column:
    """A formula's value as text, as results show it: money with two decimals, ratios too, plain numbers with none.

    The other kinds read as in ``display``; a missing value stays null.
    """
    v = value.cast("double")
    exact = v.cast("decimal(28,6)")
    whole = F.round(exact, 0)
    forms = {
        "currency": F.concat(F.lit(symbol), F.format_number(F.round(exact, 2), 2)), "ratio": F.concat(F.round(exact, 2).cast("string"), F.lit("x")),
        "number": F.when((whole == 0) & (v < 0), "-0").otherwise(F.format_number(whole, 0)),
    }
    return F.when(v.isNotNull(), forms[kind]) if kind in forms else display(value, kind, symbol)


#: Words that a header may begin with and still mean the same, and other names of columns.
HEADER_PREFIXES = ("responsible", "total", "is", "has")
HEADER_ALIASES = {
    "lawyername": "lawyerid", "feeearnername": "lawyerid", "feeearner": "lawyerid", "feeearnerid": "lawyerid", "solicitor": "lawyerid", "solicitorname": "lawyerid",
    "matter": "matterid", "matterref": "matternumber", "reference": "matternumber", "ref": "matternumber", "casenumber": "matternumber", "caseref": "matternumber",
    "dateofentry": "date", "entrydate": "date", "transactiondate": "date", "postingdate": "date",
    "amountbillable": "billablevalue", "billable": "billablevalue", "billableamount": "billablevalue", "writeoff": "writeoffvalue", "amountwrittenoff": "writeoffvalue",
    "invoiceamount": "subtotal", "invoicetotal": "subtotal", "netbill": "netbilling", "fees": "subtotal", "invoiceno": "invoicenumber", "invnumber": "invoicenumber", "invoicenum": "invoicenumber",
    "clientname": "displayname", "contactname": "displayname", "fullname": "displayname",
}


def canonical_header(x: Column) -> Column:
    """A header without separators and without one leading filler word, then by its usual name.

    A filler word goes only where more than two characters are left.
    """
    plain = F.regexp_replace(F.lower(x), r"[\s_\-.]+", "")
    # the first of the words in their order that the header begins with
    short = F.regexp_replace(plain, f"^(?:{'|'.join(HEADER_PREFIXES)})(?=.{{3,}}$)", "")
    names = F.create_map(*[F.lit(t) for pair in HEADER_ALIASES.items() for t in pair])
    return F.coalesce(F.try_element_at(names, plain), F.try_element_at(names, short), short)


def display(value: Column, kind: str, symbol: str = "£") -> Column:
    """A KPI value as text by its result type; a missing value stays null.

    Digits are rounded half up on the decimal that the value prints as.
    """
    v = value.cast("double")
    tenth = F.round(v.cast("decimal(28,6)"), 1).cast("string")
    whole = F.round(F.abs(v).cast("decimal(28,6)"), 0)
    forms = {
        "currency": F.concat(F.when((v < 0) & (whole > 0), "-").otherwise(""), F.lit(symbol), F.format_number(whole, 0)), "percentage": F.concat(tenth, F.lit("%")), "hours": F.concat(tenth, F.lit(" hrs")),
        "days": F.concat(js_round(v).cast("long").cast("string"), F.lit(" days")), "ratio": F.concat(tenth, F.lit("x")), "boolean": F.when(v != 0, "Yes").otherwise("No"),
    }
    return F.when(v.isNotNull(), forms.get(kind, F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(tenth)))
