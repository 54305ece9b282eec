"""CSV and JSON sources: everything arrives as text, types are inferred or coerced afterwards.

Spark reads and splits the files; only headers, schemas and one row of statistics a table
come to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import DETECTED_TYPES, detected_as
from ..session import scratch_path
from .excel import read_excel
from .json_documents import split_document

#: Share of a column's non-empty values that must read as a type for the column to have it.
TYPE_SHARE = 0.9
SAMPLES = 5


def read_csv(spark: SparkSession, path: str, separator: str = ",", multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with a header row, all columns text.

    Headers lose surrounding blanks and a byte-order mark; rows whose fields are all blank are
    left out. Files of one folder share one header. Only without ``multi_line`` (fields that hold
    line breaks) are large files split.
    """
    df = spark.read.option("header", True).option("sep", separator).option("multiLine", multi_line).option("escape", '"').csv(path)
    df = df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])
    return without_blank_rows(df)


def csv_report(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """One row: kept rows, blank rows that were skipped, and rows with more or fewer fields than the header."""
    df = spark.read.option("header", True).option("sep", separator).option("escape", '"').csv(path)
    names = df.columns
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField("_broken", T.StringType())])
    df = spark.read.schema(schema).option("header", True).option("sep", separator).option("escape", '"').option("columnNameOfCorruptRecord", "_broken").csv(path)
    blank = ~F.exists(F.array(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "" for c in names]), lambda x: x)
    return df.agg(F.count_if(~blank).alias("kept"), F.count_if(blank).alias("skipped"), F.count_if(~blank & F.col("_broken").isNotNull()).alias("uneven"))


def without_blank_rows(df: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) != "" for c in df.columns]
    return df.where(F.exists(F.array(*filled), lambda x: x)) if filled else df


#: Bytes of JSON documents from which on they are split where their rows border.
SPLIT_BYTES = 64 << 20


def read_json(spark: SparkSession, path: str, lines: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of a JSON file: its root array, its ``data`` array, or its largest top-level array.

    ``lines`` reads one object a line, which splits. A small document is one record for the
    reader: its shape is chosen from the schema, and only where several arrays compete are they
    counted. From ``split_bytes`` on a document is first split into lines, in many tasks.
    """
    if not lines and _bytes_of(spark, path) >= split_bytes:
        to = scratch_path(spark, "json-lines")
        if split_document(spark, path, to) is not None:
            return spark.read.json(to)
    df = spark.read.option("multiLine", not lines).json(path)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    # a root array of one row that itself holds arrays of objects reads like a document
    if lines or not arrays or not _single_document(df):
        return df
    if "data" in arrays:
        best = "data"
    else:
        sizes = df.agg(*[F.coalesce(F.sum(F.size(F.col(f"`{a}`"))), F.lit(0)).alias(f"n{i}") for i, a in enumerate(arrays)]).first()
        best = arrays[max(range(len(arrays)), key=lambda i: (sizes[i], -i))]
    return df.select(F.explode(F.col(f"`{best}`")).alias("row_")).select("row_.*")


def _bytes_of(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def _single_document(df: DataFrame) -> bool:
    return len(df.take(2)) == 1


def flatten_once(df: DataFrame) -> DataFrame:
    """Structs become ``outer.inner`` columns; arrays, and anything deeper, JSON text."""
    out: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            out += [_leaf(c[inner.name], inner.dataType).alias(f"{field.name}.{inner.name}") for inner in field.dataType.fields]
        else:
            out.append(_leaf(c, field.dataType).alias(field.name))
    return df.select(*out)


def _leaf(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c


def camel_case(header: str) -> str:
    """``Title Case``, ``snake_case`` and ``PascalCase`` as camelCase; trailing % and # go."""
    words = re.split(r"[\s_]+", re.sub(r"[%#]+$", "", header.strip()))
    first, *rest = words
    return first[:1].lower() + first[1:] + "".join(w[:1].upper() + w[1:] for w in rest)


def rename_headers(df: DataFrame, everywhere: dict[str, str], own: dict[str, str] | None = None) -> DataFrame:
    """Columns in camelCase, then renamed by two tables whose keys are lower case."""
    names = []
    for c in df.columns:
        name = camel_case(c)
        name = everywhere.get(name.lower(), name)
        names.append((own or {}).get(name.lower(), name))
    return df.toDF(*names)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type of every text column by majority, from one aggregation over the whole table.

    The first of boolean, currency, number and date that ``TYPE_SHARE`` of the non-empty
    values read as; else, and for empty columns, string.
    """
    if not df.columns:
        return {}
    parts = []
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(f"`{c}`").cast("string"))
        parts.append(F.count_if(x != "").alias(f"n{i}"))
        parts += [F.count_if((x != "") & detected_as(x, kind)).alias(f"{kind}{i}") for kind in DETECTED_TYPES]
    row = df.agg(*parts).first()
    return {c: next((k for k in DETECTED_TYPES if row[f"n{i}"] and row[f"{k}{i}"] / row[f"n{i}"] >= TYPE_SHARE), "string") for i, c in enumerate(df.columns)}


def unpivoted(df: DataFrame) -> DataFrame:
    """(field, value): every cell of the table as text, column by column."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


#: Parts of a field's values that are searched apart.
SALTS = 256


def profile(df: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(field, rows, missing, missing_percent, distinct_values, samples): the smallest few values are the samples.

    Values are counted per field and value first, so the second step meets each value once.
    The smallest are sought within ``SALTS`` parts of a field's values and then among those
    found, so no task sorts all values of a field.
    """
    from pyspark.sql import Window as W

    counted = unpivoted(df).groupBy("field", "value").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    ranked = counted.withColumn("rn", F.row_number().over(W.partitionBy("field", "salt").orderBy(F.col("value").asc_nulls_last())))
    parts = ranked.groupBy("field", "salt").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("distinct_values"),
        F.collect_list(F.when(F.col("rn") <= samples, F.col("value"))).alias("samples"),
    )
    return parts.groupBy("field").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("distinct_values").alias("distinct_values"),
        F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, samples).alias("samples"),
    ).withColumn("missing_percent", F.round(F.col("missing") / F.col("rows") * 100, 4))


@dataclass(frozen=True)
class Signature:
    """Columns that tell a kind of dataset, lower case without separators."""

    kind: str
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    form: str
    required: tuple[str, ...] = ()


# Signatures of the nine dataset kinds.
SIGNATURES = (
    Signature("feeEarnerCsv", ("paymodel", "feeshare", "salary", "annualsalary", "chargeoutrate", "targetweeklyhours", "annualtarget", "chargeableweeklytarget"), ("department", "grade", "name", "email", "startdate"), "csv"),
    Signature("wipJson", ("billablevalue", "durationminutes", "matterid", "lawyerid", "donotbill", "writeoffvalue"), ("rate", "entryid", "casetype"), "json", ("billablevalue", "durationminutes", "matterid", "lawyerid", "donotbill")),
    Signature("fullMattersJson", ("matternumber", "matterid", "status", "createdate", "department"), ("budget", "client", "casetype", "netbilling", "responsiblelawyer"), "json"),
    Signature("closedMattersJson", ("matternumber", "invoicenetbilling", "invoiceddisbursements", "wipbillable", "wipwriteoff"), ("completeddate", "responsiblelawyer", "invoiceoutstanding"), "json"),
    Signature("invoicesJson", ("invoicedate", "duedate", "subtotal", "outstanding", "paid", "matternumber", "responsiblelawyer"), ("invoicenumber", "total", "vat", "writtenoff"), "json"),
    Signature("contactsJson", ("contactid", "displayname"), ("email", "phone", "address"), "json"),
    Signature("disbursementsJson", ("transactionid", "subtotal", "outstanding", "matternumber", "responsiblelawyerid"), ("disbursementdate", "clientid", "departmentid"), "json"),
    Signature("tasksJson", ("taskid", "duedate", "matterid", "lawyerid", "priority", "taskstatus"), ("title", "description"), "json"),
    Signature("lawyersJson", ("attorneyid", "responsiblelawyer"), ("lawyerid", "lawyername"), "json"),
)


def dataset_scores(columns: list[str], form: str) -> dict[str, int]:
    """Points of every kind: 15 a strong column (75 at most), 5 a weak one (25), 10 for the format; 100 at most."""
    have = {re.sub(r"[\s_\-.]+", "", c.lower()) for c in columns}
    out = {}
    for s in SIGNATURES:
        points = min(75, 15 * len(have & set(s.strong))) + min(25, 5 * len(have & set(s.weak)))
        out[s.kind] = 0 if set(s.required) - have else min(100, points + 10 * (points > 0 and form == s.form))
    return out


def detect_dataset(columns: list[str], form: str) -> tuple[str | None, str]:
    """(kind, confidence) of the best score; the first listed of equal ones."""
    scores = dataset_scores(columns, form)
    kind, best = max(scores.items(), key=lambda kv: kv[1])
    return (kind if best else None), "high" if best >= 60 else "medium" if best >= 35 else "low" if best else "none"


def detect_datasets(headers: DataFrame) -> DataFrame:
    """(upload, kind, score, confidence) of every upload, from its headers (upload, header, form).

    Headers meet the columns of the signatures, a short list; points add up by upload and kind
    as ``dataset_scores`` has it. The first listed of equal kinds is meant, none without points.
    """
    spark = headers.sparkSession
    columns = [(i, s.kind, c, 15 * (c in s.strong), 5 * (c in s.weak and c not in s.strong), int(c in s.required)) for i, s in enumerate(SIGNATURES) for c in dict.fromkeys((*s.strong, *s.weak))]
    signed = spark.createDataFrame(columns, "place int, kind string, name string, strong int, weak int, needed int")
    forms = spark.createDataFrame([(i, s.form, len(s.required)) for i, s in enumerate(SIGNATURES)], "place int, own_form string, all_needed int")
    named = headers.select("upload", "form", squeezed(F.col("header")).alias("name")).distinct()
    summed = named.join(F.broadcast(signed), "name").groupBy("upload", "form", "place", "kind").agg(
        F.least(F.sum("strong"), F.lit(75)).alias("strong"), F.least(F.sum("weak"), F.lit(25)).alias("weak"), F.sum("needed").alias("needed"))
    scored = summed.join(F.broadcast(forms), "place").where("needed = all_needed").select(
        "upload", "place", "kind", F.least(F.lit(100), F.col("strong") + F.col("weak") + F.when(F.col("form") == F.col("own_form"), 10).otherwise(0)).alias("score"))
    best = scored.groupBy("upload").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("place"))).alias("b"))
    out = headers.select("upload").distinct().join(best, "upload", "left").select("upload", F.col("b.kind").alias("kind"), F.coalesce("b.score", F.lit(0)).cast("long").alias("score"))
    return out.withColumn("confidence", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 35, "medium").when(F.col("score") > 0, "low").otherwise("none"))


#: Edits up to which a header may be a misspelled field.
MOST_EDITS = 2
#: Fixed value: a column with more empty values, in percent, is not suggested as a field of its own.
SUGGESTED_MISSING = 50


def squeezed(c: Column) -> Column:
    """Lower case without blanks, underscores, hyphens and points."""
    return F.regexp_replace(F.lower(c), r"[\s_\-.]+", "")


def deletions(c: Column, most: int = MOST_EDITS) -> Column:
    """All texts that up to ``most`` deletions leave of one.

    Two texts within ``most`` edits of each other have one of these in common, so they meet in
    an equi-join.
    """
    out = level = F.array(c)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(
            F.filter(F.sequence(F.lit(0), F.length(s)), lambda i: i > 0), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1))))))
        out = F.concat(out, level)
    return F.array_distinct(out)


def nearest_fields(headers: DataFrame, fields: DataFrame, most_edits: int = MOST_EDITS) -> DataFrame:
    """(header, near_field): for each header (header, n) the field (field, k, ordinal) with the fewest edits, the first of equal ones."""
    left = headers.select("header", "n", F.explode(deletions(F.col("n"), most_edits)).alias("left_over"))
    right = fields.select("field", "k", "ordinal", F.explode(deletions(F.col("k"), most_edits)).alias("left_over"))
    pairs = left.join(right, "left_over").drop("left_over").distinct().withColumn("edits", F.levenshtein("n", "k")).where(F.col("edits") <= most_edits)
    return pairs.groupBy("header").agg(F.min_by("field", F.struct("edits", "ordinal")).alias("near_field"))


def auto_map(headers: DataFrame, fields: DataFrame, aliases: dict[str, str], saved: dict[str, str] | None = None, most_edits: int = MOST_EDITS) -> DataFrame:
    """(header, field, how, required): each header's field by exact name, alias, saved mapping, or edit distance.

    ``headers`` has a column header, ``fields`` (field, ordinal) and may have required. Only
    headers that the first three leave over are compared with fields, and only with those that
    share a deletion with them.
    """
    spark = headers.sparkSession
    known = fields.select("field", "ordinal", (F.col("required") if "required" in fields.columns else F.lit(False)).alias("required")).withColumn("k", squeezed(F.col("field")))
    renamed = spark.createDataFrame([*aliases.items()] or [("", "")], "a string, target string").select("a", squeezed(F.col("target")).alias("k")).join(known.select("k", F.col("field").alias("alias_field")), "k").drop("k")
    remembered = spark.createDataFrame([*(saved or {}).items()] or [("", "")], "h string, saved_field string")
    own = headers.select("header").withColumn("n", squeezed(F.col("header")))
    out = own.join(known.select("k", F.col("field").alias("exact_field")), F.expr("n = k"), "left").drop("k").join(renamed, F.expr("n = a"), "left").join(remembered, F.expr("header = h"), "left")
    left_over = out.where(F.coalesce("exact_field", "alias_field", "saved_field").isNull()).select("header", "n")
    out = out.join(nearest_fields(left_over, known, most_edits), "header", "left")
    how = F.when(F.col("exact_field").isNotNull(), "exact").when(F.col("alias_field").isNotNull(), "alias").when(F.col("saved_field").isNotNull(), "template").when(F.col("near_field").isNotNull(), "fuzzy").otherwise("unmapped")
    mapped = out.select("header", F.coalesce("exact_field", "alias_field", "saved_field", "near_field").alias("field"), how.alias("how"))
    required = known.select("field", "required")
    return mapped.join(required, "field", "left").select("header", "field", "how", F.coalesce("required", F.lit(False)).alias("required"))


def mapping_report(mapped: DataFrame, headers: DataFrame, fields: DataFrame) -> DataFrame:
    """(issue, name, kind) of a mapping: required fields that no header maps to (``missing``), headers without a
    field (``unmapped``), and those of them that hold enough to be fields of their own (``suggested``, with their type).

    ``headers`` has header, missing_percent and kind, ``fields`` has field and required.
    """
    none = F.lit(None).cast("string")
    missing = fields.where("required").join(mapped, "field", "left_anti").select(F.lit("missing").alias("issue"), F.col("field").alias("name"), none.alias("kind"))
    bare = mapped.where(F.col("field").isNull()).join(headers, "header")
    suggested = bare.where(F.coalesce("missing_percent", F.lit(0.0)) <= SUGGESTED_MISSING).select(F.lit("suggested").alias("issue"), F.col("header").alias("name"), F.coalesce("kind", F.lit("string")).alias("kind"))
    return missing.unionByName(bare.select(F.lit("unmapped").alias("issue"), F.col("header").alias("name"), none.alias("kind"))).unionByName(suggested)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file by its extension: JSON documents and lines, CSV, or Excel; anything else by its first character."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    form = name.rsplit(".", 1)[-1] if "." in name else ""
    if form in ("json", "jsonl", "ndjson"):
        return read_json(spark, path, lines=form != "json" or sniff(spark, path, whole=False) == "lines")
    if form in ("csv", "txt"):
        return read_csv(spark, path)
    if form in ("xlsx", "xlsm"):
        return read_excel(spark, path)
    return read_upload(spark, path)


def sniff(spark: SparkSession, path: str, whole: bool = True) -> str:
    """``json`` for a text that begins with a bracket or brace, else ``csv``; with ``whole`` off, ``lines`` where every line is an object."""
    lines = [r[0].strip() for r in spark.read.text(path).where(F.trim("value") != "").limit(2).collect()]
    if not lines or lines[0][:1] not in ("{", "["):
        return "csv"
    if not whole and all(x.startswith("{") and x.endswith("}") for x in lines):
        return "lines"
    return "json"


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An upload without a name to go by: a JSON root array, or the first array of objects of a document, else CSV."""
    if sniff(spark, path) == "csv":
        return read_csv(spark, path)
    df = spark.read.option("multiLine", True).json(path)
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not arrays or not _single_document(df):
        return df
    return df.select(F.explode(F.col(f"`{arrays[0]}`")).alias("row_")).select("row_.*")


def read_chunks(spark: SparkSession, path: str, total: int) -> DataFrame:
    """An upload in ``chunk=n`` folders, once all of them are there; raises while some are missing."""
    df = spark.read.json(path)
    have = df.select("chunk").distinct().count()
    if have != total:
        raise ValueError(f"{have} of {total} chunks received")
    return df.drop("chunk")
